"""Phrase collocations by direct-address tiling of frequency-ranked ids.

Words that occur ``least`` times or more in their language are numbered by falling frequency.
Texts become streams of those numbers. A pair of neighbours is a cell of a square of ranks,
which is cut into tiles: tiles with many pairs are counted by ``bincount`` straight into an
array, the others as sorted coordinates. Frequent pairs are ranked again and take the place of
the left neighbour, so that three words are a pair of (pair, word) and four a pair of
(triple, word). A phrase can only be frequent where both phrases of one word less are, and the
streams shrink to those places.

Tasks look ranks up in a block of at most ``block`` of them (12 bytes each); a vocabulary of more
ranks takes more passes over the streams. Other tasks have written the block, in order of its
keys, to files in the shared folder: the driver only knows their names. Counts of tasks are
summed by cell in a shuffle, so that no cell, word or language is gathered row by row in one
task. Words are looked up by 64-bit hashes (of language and word): for V frequent among W distinct words the chance of
any wrong look-up is V * W / 2^64. Phrases are looked up by their exact numbers.

Defined cases: a null text counts as empty and a null language as ``und``; rows count as often
as they are repeated; texts of any length are read whole. Ties go by phrase in UTF-8 byte
order. Without phrases, or without rows, the result is empty. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopefield.llm import kernels as K
from slopefield.llm.common import (
    committed_file,
    deleted,
    kept_in_worker,
    lean,
    opened,
    removed,
    stored,
    text_of,
)
from slopefield.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t"
LONGEST = 4

BLOCK_RANKS = 1 << 22
# About so many ranks of a block lie in one file.
FILE_RANKS = 1 << 19
# Side of a tile, and the pairs that make it worth an array of its own.
SIDE = 512
DENSE_PAIRS = SIDE * SIDE // 16
# Tiles of the ranks up to 64 * SIDE can be dense; so many are counted at once.
EDGE_TILES, TILES_AT_ONCE = 64, 8
# Bytes of streams that a task counts at once, and rows of counts that it sends at once.
COUNTED_BYTES = 1 << 21
SENT_ROWS = 1 << 16

_WORD = K.byte_class(lambda b: b not in BREAKS and b not in GAPS)
_BREAK = K.byte_class(lambda b: b in BREAKS)


def language_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("und"))


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Stored lang, word, f of all distinct words."""
    folded = F.translate(text_of(text_col), UPPER, LOWER)
    words = docs.select(
        language_of(lang_col).alias("lang"),
        F.explode(F.split(folded, r"[.,;:!?\n-\r \t]+")).alias("word"),
    ).where("word <> ''")
    return stored(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f")), "words")


def ranked(rows: DataFrame, *by: Column) -> tuple[DataFrame, int]:
    """(stored rows with their place from 0 in the given order, number of rows).

    Rows are sorted by ranges over all tasks; the driver sees one count per range.
    """
    placed = stored(
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("place", F.monotonically_increasing_id()),
        "placed",
    )
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: r.part):
        before.append((r.part, total))
        total += r.n
    starts = rows.sparkSession.createDataFrame(before, "part long, start long")
    inner = F.col("place").bitwiseAND((1 << 33) - 1)
    out = placed.join(F.broadcast(starts), part == F.col("part")).select(
        *rows.columns, (F.col("start") + inner).alias("rank")
    )
    return stored(out, "ranked"), total


def _language_hashes(hasher: K.ByteHasher, column) -> np.ndarray:
    """One hash per row of an Arrow string column, that of its language."""
    import pyarrow.compute as pc

    names = pc.dictionary_encode(column)
    data, offsets = K.text_buffers(names.dictionary)
    sums = hasher.sums(data)
    hashes = K.mixed(hasher.ranges(sums, offsets[:-1], offsets[1:]))
    return hashes[names.indices.to_numpy(zero_copy_only=False)]


def _word_keys(vocabulary: DataFrame) -> DataFrame:
    """rank and key (hash of language and word) of a vocabulary."""
    import pyarrow as pa

    def keyed(batches):
        plain, folding = K.ByteHasher(), K.ByteHasher(fold_case=True)
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            keys = folding.ranges(folding.sums(data), offsets[:-1], offsets[1:])
            keys = keys ^ _language_hashes(plain, batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), batch.column(2)], names=["key", "rank"]
            )

    return vocabulary.select("lang", "word", "rank").mapInArrow(lean(keyed), "key long, rank long")


def _blocks(keys: DataFrame, total: int, block: int) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """(folder, files and their rows) of a bounded block of ranks at a time; one block at least.

    Tasks write the files, each the keys of one range in order and behind them their ranks; the
    files come in order of their ranges. A folder goes when the next block is asked for.
    """
    import pyarrow as pa

    spark = keys.sparkSession
    for first in range(0, max(total, 1), block):
        folder = shared_folder(spark, "ranks")

        def written(batches, folder=folder):
            from pyspark import TaskContext

            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if not parts:
                return
            names, ranks = (np.concatenate(columns) for columns in zip(*parts))
            name = f"{TaskContext.get().partitionId():06d}.ranks"
            with committed_file(folder, name) as out:
                out.write(names.astype("<i8").tobytes())
                out.write(ranks.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([len(names)]), pa.array(names[:1])],
                names=["name", "n", "low"],
            )

        part = keys.where((F.col("rank") >= first) & (F.col("rank") < first + block))
        files = (
            part.select("key", "rank")
            .repartitionByRange(max(1, -(-min(block, total - first) // FILE_RANKS)), "key")
            .sortWithinPartitions("key")
            .mapInArrow(lean(written), "name string, n long, low long")
            .collect()
        )
        files.sort(key=lambda r: r.low)
        yield folder, [(f"{folder}/{r.name}", r.n) for r in files]
        removed(spark, folder)


def _read_block(block: tuple[str, list[tuple[str, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their ranks, kept for further tasks of the worker that look up the same."""
    folder, files = block

    def read():
        names = np.empty(sum(n for _, n in files), np.int64)
        ranks = np.empty(len(names), np.int32)
        at = 0
        for path, n in files:
            with opened(path) as file:
                names[at : at + n] = np.frombuffer(file.read(8 * n), "<i8")
                ranks[at : at + n] = np.frombuffer(file.read(4 * n), "<i4")
            at += n
        return names, ranks

    return kept_in_worker("ranks", folder, read)


def _looked_up(keys: np.ndarray, block: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rank of each key, -1 for those that the block does not have."""
    names, ranks = block
    if not len(names) or not len(keys):
        return np.full(len(keys), -1, np.int32)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, ranks[at], np.int32(-1))


def _squeezed(streams: list[np.ndarray], keep: np.ndarray, offsets: np.ndarray):
    """The kept places with one -1 behind each run of them, and the offsets of documents."""
    behind = np.zeros(len(keep), bool)
    behind[1:] = keep[:-1]
    starts = offsets[:-1][offsets[:-1] < len(keep)]
    behind[starts] = False
    shown = keep | behind
    out = [np.where(keep, s, np.int32(-1))[shown] for s in streams]
    places = np.concatenate([[0], np.cumsum(shown)])
    return out, places[offsets]


def _word_stream(docs: DataFrame, text_col: str, lang_col: str, vocabulary, total, block) -> DataFrame:
    """Stored streams of word ranks; -1 stands for breaks and words that are not frequent."""
    import pyarrow as pa

    table = docs.select(
        language_of(lang_col).alias("lang"), text_of(text_col).alias("text"),
        F.lit(None).cast("binary").alias("words"),
    )
    count = max(1, -(-total // block))
    for number, part in enumerate(_blocks(_word_keys(vocabulary), total, block)):
        last = number == count - 1

        def filled(batches, part=part, first=number == 0, last=last):
            known_ranks = _read_block(part)
            plain, folding = K.ByteHasher(), K.ByteHasher(fold_case=True)
            for batch in batches:
                data, offsets = K.text_buffers(batch.column(1))
                known, known_offsets = K.text_buffers(batch.column(2))
                known, known_offsets = known.view(np.int32), known_offsets // 4
                languages = _language_hashes(plain, batch.column(0))
                out, sizes = [], []
                for a, b in K.document_slices(offsets):
                    text = data[offsets[a] : offsets[b]]
                    inner = offsets[a : b + 1] - offsets[a]
                    documents, starts, ends = K.find_runs(text, inner, _WORD)
                    keys = folding.ranges(folding.sums(text), starts, ends)
                    keys ^= languages[a + documents]
                    codes = _looked_up(keys.view(np.int64), known_ranks)
                    if not first:
                        before = known[known_offsets[a] : known_offsets[b]]
                        codes = np.where(before >= 0, before, codes)
                    bounds = np.searchsorted(documents, np.arange(b - a + 1))
                    if last:
                        codes, bounds = _broken(text, starts, ends, codes, bounds)
                    out.append(codes)
                    sizes.append(np.diff(bounds))
                yield _stream_batch(batch if not last else None, out, sizes)

        schema = "words binary" if last else "lang string, text string, words binary"
        table = stored(table.mapInArrow(lean(filled), schema), "streams")
    return table


def _broken(text, starts, ends, codes, bounds):
    """The stream with a -1 wherever a break lies between two words of a document."""
    if not len(codes):
        return codes, bounds
    breaks = np.concatenate([[0], np.cumsum(_BREAK[text])])
    apart = np.zeros(len(codes), bool)
    apart[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
    first = bounds[:-1][bounds[:-1] < len(codes)]
    apart[first] = False
    added = np.concatenate([[0], np.cumsum(apart)])
    wide = np.full(len(codes) + added[-1], -1, np.int32)
    wide[np.arange(len(codes)) + added[1:]] = codes
    offsets = bounds + added[bounds]
    (wide,), offsets = _squeezed([wide], wide >= 0, offsets)
    return wide, offsets


def _stream_batch(carried, streams: list[np.ndarray], sizes: list[np.ndarray]):
    import pyarrow as pa

    flat = np.concatenate([np.zeros(0, np.int32), *streams])
    lengths = np.concatenate([np.zeros(0, np.int64), *sizes])
    offsets = np.concatenate([[0], np.cumsum(lengths)]) * 4
    column = K.binary_column(flat.view(np.uint8), offsets)
    if carried is None:
        return pa.RecordBatch.from_arrays([column], names=["words"])
    return pa.RecordBatch.from_arrays(
        [carried.column(0), carried.column(1), column], names=["lang", "text", "words"]
    )


def _places(words: np.ndarray, grams: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Where phrases of size + 1 words start whose two parts of ``size`` words are frequent."""
    ok = (grams[:-1] >= 0) & (grams[1:] >= 0) if len(grams) else np.zeros(0, bool)
    inner = offsets[1:-1]
    ok[inner[(inner > 0) & (inner < len(grams))] - 1] = False
    return np.flatnonzero(ok)


def tiled_counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key x << 32 | y of each distinct pair, its count)."""
    limit = EDGE_TILES * SIDE
    edge = (x < limit) & (y < limit)
    tile = np.where(edge, x // SIDE * EDGE_TILES + y // SIDE, -1).astype(np.int16)
    filled = np.bincount(tile[edge], minlength=EDGE_TILES * EDGE_TILES)
    dense = np.flatnonzero(filled >= DENSE_PAIRS)
    slot = np.full(EDGE_TILES * EDGE_TILES + 1, -1, np.int16)
    slot[dense] = np.arange(len(dense))
    slot = slot[tile]  # a tile of -1 looks at the last entry
    del edge, tile
    keys, counts = [], []
    for first in range(0, len(dense), TILES_AT_ONCE):
        mine = np.flatnonzero((slot >= first) & (slot < first + TILES_AT_ONCE))
        cell = x[mine] % SIDE * SIDE + y[mine] % SIDE
        at = (slot[mine].astype(np.int64) - first) * (SIDE * SIDE) + cell
        counted = np.bincount(at, minlength=TILES_AT_ONCE * SIDE * SIDE)
        cells = np.flatnonzero(counted)
        of = dense[first + cells // (SIDE * SIDE)]
        left = of // EDGE_TILES * SIDE + cells % (SIDE * SIDE) // SIDE
        right = of % EDGE_TILES * SIDE + cells % SIDE
        keys.append((left << 32) | right)
        counts.append(counted[cells])
    rest = np.flatnonzero(slot < 0)
    names, n = np.unique((x[rest] << 32) | y[rest], return_counts=True)
    return np.concatenate([*keys, names]), np.concatenate([*counts, n])


def _stream_columns(batches, size: int):
    """(words, grams, offsets) of several batches at once."""
    import pyarrow as pa

    def joined(held):
        table = pa.Table.from_batches(held)
        raw, offsets = K.text_buffers(table.column(0))
        words = raw.view(np.int32)
        grams = words if size == 1 else K.text_buffers(table.column(1))[0].view(np.int32)
        return words, grams, offsets // 4

    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= COUNTED_BYTES:
            yield joined(held)
            held, held_bytes = [], 0
    if held:
        yield joined(held)


def _counted(streams: DataFrame, size: int, least: int) -> DataFrame:
    """key (rank of the first ``size`` words << 32 | rank of the last) and f of the frequent
    phrases of size + 1 words."""
    import pyarrow as pa

    def counted(batches):
        kept_in_worker("ranks", "none", lambda: None)  # a block read before is not needed any more
        for words, grams, offsets in _stream_columns(batches, size):
            at = _places(words, grams, offsets, size)
            keys, counts = tiled_counts(grams[at].astype(np.int64), words[at + size].astype(np.int64))
            for a in range(0, len(keys), SENT_ROWS):
                part = slice(a, a + SENT_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[part]), pa.array(counts[part].astype(np.int64))],
                    names=["key", "n"],
                )

    return (
        streams.mapInArrow(lean(counted), "key long, n long")
        .groupBy("key")
        .agg(F.sum("n").alias("f"))
        .where(F.col("f") >= least)
    )


def _spelled(found: DataFrame, shorter: DataFrame | None) -> DataFrame:
    """key, f and ids (the ranks of all words) of phrases, from those of one word less."""
    first = F.shiftright("key", 32)
    last = F.col("key").bitwiseAND((1 << 32) - 1).cast("int")
    if shorter is None:
        return found.select("key", "f", F.array(first.cast("int"), last).alias("ids"))
    heads = shorter.select(F.col("rank").alias("_rank"), F.col("ids").alias("_head"))
    return found.join(heads, first == F.col("_rank")).select(
        "key", "f", F.array_append("_head", last).alias("ids")
    )


def _advanced(streams: DataFrame, size: int, keys: DataFrame, total: int, block: int) -> DataFrame:
    """Stored streams whose grams are the ranks of phrases of size + 1 words."""
    import pyarrow as pa

    count = max(1, -(-total // block))
    names = ["words", "grams"]
    for number, part in enumerate(_blocks(keys, total, block)):
        last = number == count - 1

        def filled(batches, part=part, first=number == 0, last=last):
            known_ranks = _read_block(part)
            for batch in batches:
                raw, offsets = K.text_buffers(batch.column(0))
                words, offsets = raw.view(np.int32), offsets // 4
                grams = words if size == 1 else K.text_buffers(batch.column(1))[0].view(np.int32)
                at = _places(words, grams, offsets, size)
                pairs = (grams[at].astype(np.int64) << 32) | words[at + size].astype(np.int64)
                more = np.full(len(words), -1, np.int32)
                more[at] = _looked_up(pairs, known_ranks)
                if not first:
                    before = K.text_buffers(batch.column(2))[0].view(np.int32)
                    more = np.maximum(more, before)
                out, bounds = [words, grams, more], offsets
                if last:
                    keep = np.zeros(len(words), bool)
                    for i in range(size + 1):
                        keep[np.flatnonzero(more >= 0) + i] = True
                    out, bounds = _squeezed([words, more], keep, offsets)
                yield pa.RecordBatch.from_arrays(
                    [K.binary_column(s.view(np.uint8), bounds * 4) for s in out],
                    names=names if last else [*names, "more"],
                )

        schema = "words binary, grams binary" + ("" if last else ", more binary")
        table = streams if number == 0 else table  # noqa: F821
        if "grams" not in table.columns:
            table = table.withColumn("grams", F.col("words"))
        table = stored(table.mapInArrow(lean(filled), schema), "streams")
    return table


def _scores(phrases: DataFrame, candidates: DataFrame) -> DataFrame:
    """ids, lang, a, l, r, score: of all cuts of a phrase the one of lowest score."""
    cuts = candidates.select(
        "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    ).select(
        "ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("_left"),
        F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("_right"),
    )
    left = phrases.select(F.col("ids").alias("_left"), F.col("f").alias("l"), "lang")
    right = phrases.select(F.col("ids").alias("_right"), F.col("f").alias("r"))
    joined = cuts.join(left, "_left").join(right, "_right")
    score = F.expr(
        "(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) DIV "
        "(CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))"
    )
    return (
        joined.withColumn("score", score)
        .groupBy("ids")
        .agg(
            F.max("a").alias("a"), F.max("lang").alias("lang"),
            F.min(F.struct("score", "k", "l", "r")).alias("cut"),
        )
        .select("ids", "lang", "a", "cut.l", "cut.r", "cut.score")
    )


def _not_inside(candidates: DataFrame, share: int) -> DataFrame:
    """Candidates that no longer one holds with ``share`` percent of their count."""
    parts = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("ids") - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.size("ids") - n + 1), lambda i: F.slice("ids", i, n)
            ),
        )
    )
    inside = (
        candidates.where(F.size("ids") > 2)
        .select(F.explode(parts).alias("_part"), F.col("f").alias("_f"))
        .groupBy("_part")
        .agg(F.max("_f").alias("_most"))
    )
    wide = "DECIMAL(22, 0)"
    held = F.expr(f"CAST(100 AS {wide}) * _most >= CAST({share} AS {wide}) * f")
    return candidates.join(inside, F.col("ids") == F.col("_part"), "left").where(
        F.col("_most").isNull() | ~held
    ).select(*candidates.columns)


def _first_rows(scored: DataFrame, vocabulary: DataFrame, top: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, score of each language's first ``top`` phrases."""
    order = [F.desc("score"), F.desc("a")]
    salt = F.xxhash64("ids")
    for salts in (64, 8):
        window = Window.partitionBy("lang", F.pmod(salt, F.lit(salts))).orderBy(*order)
        scored = scored.withColumn("_place", F.rank().over(window)).where(F.col("_place") <= top)
    scored = stored(scored.drop("_place"), "scored")
    words = vocabulary.select(F.col("rank").cast("int").alias("_id"), "word")
    spelled = (
        scored.select("ids", F.posexplode("ids").alias("_at", "_id"))
        .join(words, "_id")
        .groupBy("ids")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "word"))).alias("_words"))
        .select("ids", F.array_join("_words.word", " ").alias("phrase"))
    )
    window = Window.partitionBy("lang").orderBy(*order, "phrase")
    return (
        scored.join(spelled, "ids")
        .withColumn("rank", F.row_number().over(window).cast("long"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "score")
    )


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = 30,
    inside_percent: int = 80,
    top: int = 2000,
    block: int = BLOCK_RANKS,
) -> DataFrame:
    """Per language the first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts = word_counts(docs, text_col, lang_col)
    frequent = counts.where(F.col("f") >= least)
    vocabulary, total = ranked(frequent, F.desc("f"), F.col("lang"), F.col("word"))
    streams = _word_stream(docs, text_col, lang_col, vocabulary, total, block)
    tables = [vocabulary.select(F.array(F.col("rank").cast("int")).alias("ids"), "f", "lang")]
    shorter = None
    for size in range(1, LONGEST):
        found = stored(_counted(streams, size, least), "counted")
        found = stored(_spelled(found, shorter), "grams")
        tables.append(found.select("ids", "f", F.lit(None).cast("string").alias("lang")))
        if size + 1 < LONGEST:
            shorter, total = ranked(found, F.desc("f"), F.col("key"))
            used, streams = streams, _advanced(streams, size, shorter, total, block)
            deleted(used)
    deleted(streams)
    candidates = tables[1].unionByName(tables[2]).unionByName(tables[3])
    phrases = tables[0].unionByName(candidates)
    scored = _scores(phrases, _not_inside(candidates, inside_percent))
    rows = _first_rows(scored, vocabulary, top)
    sizes = counts.groupBy(F.col("lang").alias("_lang")).agg(F.sum("f").alias("n"))
    return rows.join(sizes, F.col("lang") == F.col("_lang")).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
