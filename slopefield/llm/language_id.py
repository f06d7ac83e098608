"""Language identification by unigram pieces with the segmentation summed out.

Every language has a probability for each piece of a fixed public vocabulary. The
probability of a word is the sum over all ways to cut it into pieces, which the forward
algorithm gives; a text's is the product over its words (maximal runs of letters, lower
case). Training is expectation maximisation: forward and backward sums give the expected
count of every piece in the words of each language.

At most ``train_rows`` labelled documents, chosen by a hash of id and text, are learnt from
(and as often in another language as such a row has one); scoring reads every document whole and shuffles nothing.

Defined cases: a text that is null or has no letter is ``und`` with score 0; runs of letters
of any length are summed over whole, but training cuts those over 64 bytes there; rows without a language are not learnt from and
repeated rows once; without any labelled row every text is ``und``. Ties go to the language that sorts first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopefield.llm import kernels as K
from slopefield.llm import lattice as L
from slopefield.llm.common import lean, stored, text_of

WORD_START = "▁"
LONGEST_RUN = 64
SLICE = 1 << 20
# Keeps products of piece probabilities near one: a weight per byte, taken out again.
BYTE_SCALE = 2.0
BACKGROUND = 0.02

_LETTER = K.byte_class(lambda b: 97 <= b <= 122 or b >= 128)


def vocabulary(model_file: str) -> list[tuple[bytes, int]]:
    """Pieces of lower-case letters with the single bytes of the fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out = {}
    for k in range(model.get_piece_size()):
        if model.is_byte(k):
            out.setdefault(bytes([int(model.id_to_piece(k)[3:5], 16)]), k)
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            piece = model.id_to_piece(k).encode()
            if _LETTER[np.frombuffer(piece, np.uint8)].all():
                out[piece] = k
    return [(piece, k) for k, piece in enumerate(sorted(out))]


def _words(data: np.ndarray, offsets: np.ndarray, hasher: K.ByteHasher, cut: bool):
    """(document of each word, distinct words as bytes and offsets, word -> distinct)."""
    documents, starts, ends = K.find_runs(data, offsets, _LETTER)
    long = ends - starts > LONGEST_RUN
    if cut and long.any():
        counts = -(-(ends - starts) // LONGEST_RUN)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        documents = np.repeat(documents, counts)
        begin = np.repeat(starts, counts) + inner * LONGEST_RUN
        ends = np.minimum(begin + LONGEST_RUN, np.repeat(ends, counts))
        starts = begin
    hashes = hasher.ranges(hasher.sums(data), starts, ends)
    _, where, place = np.unique(hashes, return_index=True, return_inverse=True)
    flat, flat_offsets = L.prefixed(data, starts[where], ends[where], WORD_START.encode())
    return documents, flat, flat_offsets, place


def _scaled(probabilities: np.ndarray, pieces: list[tuple[bytes, int]]) -> np.ndarray:
    lengths = np.array([len(p) for p, _ in pieces])
    return probabilities * np.exp(BYTE_SCALE * lengths)[:, None]


def _expected_counts(
    train: DataFrame, pieces: list[tuple[bytes, int]], languages: list[str], weights: np.ndarray
) -> np.ndarray:
    import pyarrow as pa

    column = {name: k for k, name in enumerate(languages)}
    shared = train.sparkSession.sparkContext.broadcast((pieces, weights))

    def expected(batches):
        pieces, weights = shared.value
        table = L.PieceTable(pieces)
        total = np.zeros((len(pieces), len(languages)))
        for batch in batches:
            owner = np.array([column[x] for x in batch.column(0).to_pylist()], np.int64)
            data, offsets = K.text_buffers(batch.column(1))
            for a, b in K.document_slices(offsets):
                part = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                documents, flat, flat_offsets, place = _words(*part, table.hasher, True)
                if not len(place):
                    continue
                edges = table.edges(flat, flat_offsets)
                count = np.zeros((len(flat_offsets) - 1, len(languages)))
                np.add.at(count, (place, owner[a + documents]), 1.0)
                alpha, beta = L.forward(edges, weights), L.backward(edges, weights)
                mass = alpha[edges.last]
                share = np.divide(count, mass, out=np.zeros_like(count), where=mass > 0)
                flow = alpha[edges.source] * weights[edges.piece] * beta[edges.target]
                flow *= share[edges.word]
                for k in range(len(languages)):
                    total[:, k] += np.bincount(edges.piece, flow[:, k], len(pieces))
        p, k = np.nonzero(total > 1e-6)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[p, k])],
            names=["piece", "language", "n"],
        )

    summed = (
        train.select("lang", "text")
        .mapInArrow(lean(expected), "piece int, language int, n double")
        .groupBy("piece", "language")
        .agg(F.sum("n").alias("n"))
    )
    out = np.zeros((len(pieces), len(languages)))
    for row in summed.collect():  # at most vocabulary x languages
        out[row.piece, row.language] = row.n
    return out


def _probabilities(counts: np.ndarray) -> np.ndarray:
    """Per language, with a little of all languages together and of an even spread."""
    own = counts / np.maximum(counts.sum(axis=0, keepdims=True), 1e-9)
    pooled = counts.sum(axis=1, keepdims=True) + 0.01
    pooled = pooled / pooled.sum()
    return (1 - BACKGROUND) * own + BACKGROUND * pooled


def train_model(
    train: DataFrame, model_file: str, rounds: int = 3
) -> tuple[list[tuple[bytes, int]], list[str], np.ndarray]:
    """(pieces, languages, scaled weights) from a stored table of lang and lower-case text."""
    languages = sorted(r.lang for r in train.select("lang").distinct().collect())
    pieces = vocabulary(model_file)
    even = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    weights = _scaled(even, pieces)
    for k in range(rounds):
        counts = _expected_counts(train, pieces, languages, weights)
        if k == 0:  # pieces that no language uses stay out, but for single bytes
            used = (counts.sum(axis=1) >= 0.5) | np.array([len(p) == 1 for p, _ in pieces])
            pieces = [(p, i) for i, (p, _) in enumerate(x for x, u in zip(pieces, used) if u)]
            counts = counts[used]
        weights = _scaled(_probabilities(counts), pieces)
    return pieces, languages, weights


def predict(texts: DataFrame, model, passed: list[str]) -> DataFrame:
    """The passed columns, lang_pred and score of lower-case ``text``."""
    import pyarrow as pa

    shared = texts.sparkSession.sparkContext.broadcast(model)
    count = len(passed)

    def run(batches):
        pieces, languages, weights = shared.value
        table = L.PieceTable(pieces)
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(count))
            names, scores = [], []
            for a, b in K.document_slices(offsets, SLICE):
                part = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                documents, flat, flat_offsets, place = _words(*part, table.hasher, False)
                total = np.zeros((b - a, len(languages)))
                if len(place):
                    edges = table.edges(flat, flat_offsets)
                    each = L.log_masses(edges, weights, table.longest)[place]
                    head = np.flatnonzero(
                        np.concatenate([[True], documents[1:] != documents[:-1]])
                    )
                    total[documents[head]] = np.add.reduceat(each, head, axis=0)
                lettered = np.bincount(documents, minlength=b - a) > 0
                best = total.argmax(axis=1)
                share = np.exp(total - total.max(axis=1, keepdims=True))
                share = share.max(axis=1) / share.sum(axis=1)
                names += [languages[k] if ok else "und" for k, ok in zip(best, lettered)]
                scores += np.where(lettered, share, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in range(count)],
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                ],
                names=[*passed, "lang_pred", "score"],
            )

    types = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in passed)
    return texts.select(*passed, "text").mapInArrow(lean(run), f"{types}, lang_pred string, score double")


def training_rows(labelled: DataFrame, most: int) -> DataFrame:
    """lang and text of the rows whose hash of id and text is among the ``most`` smallest.

    What is chosen follows from the rows alone, so that scans with other file splits choose
    the same; equal rows count once.
    """
    hashed = labelled.where("lang IS NOT NULL").select(
        F.xxhash64("id", "text").alias("at"), "lang", "text"
    )
    chosen = hashed.select("at").distinct().orderBy("at").limit(most)
    last = chosen.agg(F.max("at")).first()[0]
    if last is None:
        return hashed.select("lang", "text").limit(0)
    return hashed.where(F.col("at") <= last).dropDuplicates(["at", "lang"]).select("lang", "text")


def identify(
    docs: DataFrame,
    model_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_rows: int = 8_000,
    rounds: int = 3,
) -> DataFrame:
    """Per document row: row (its place in the scan that scores), id, held_out, lang_pred, score.

    Rows whose crc32 (of the id as text) leaves 2 when divided by 4 are not learnt from.
    """
    held_out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 4 == 2
    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.lower(text_of(text_col)).alias("text"),
    )
    train = stored(training_rows(source.where(~held_out), train_rows).repartition(16), "labelled")
    if train.isEmpty():
        return source.select(
            "row", "id", held_out.alias("held_out"), F.lit("und").alias("lang_pred"),
            F.lit(0.0).alias("score"),
        )
    model = train_model(train, model_file, rounds)
    return predict(source, model, ["row", "id"]).select(
        "row", "id", held_out.alias("held_out"), "lang_pred", "score"
    )
