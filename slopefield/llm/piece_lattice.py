"""N-best segmentation into SentencePiece pieces, and decoding.

A text is escaped as the model does (spaces become U+2581, one is put in front) and forms
a lattice: a node per character border and an edge per piece, plus byte pieces where a
character has none. The score of a segmentation is the sum of its pieces' scores in the
model. Because no piece goes on after a word, the lattice falls apart at word starts into
words; the best segmentation of a text is that of its words.

1. *Forward Viterbi* over all distinct words of a slice at once gives the best score up to
   every node; the same from behind gives each word's best score over an edge, and so the
   exact loss of its second-best segmentation.
2. *Backward A-star.* From the end of a word, partial segmentations are extended to the left
   in order of (score so far) + (forward score of the node reached). The forward score is
   the exact best completion, so segmentations leave the queue in order of score: the first
   N that reach the start are the N best. Only words whose loss is among a text's N - 1
   smallest can differ in its N best segmentations, so only they are searched.
3. The text's N best combine the N best of those words, again best first.

Equal scores are ordered by piece ids. Decoding joins the pieces, turns U+2581 back into
spaces, drops the one in front, and reads byte pieces as UTF-8 (U+FFFD where they are not).

Defined cases: a null or empty text has no pieces (its only segmentation is empty) and
decodes to the empty string. A text with fewer segmentations than N has them all. Repeated
rows and ids are encoded row by row, texts of any length whole. Further columns are not
looked at, and an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopefield.llm import kernels as K
from slopefield.llm import lattice as L
from slopefield.llm.common import lean, text_of

SPACE = "▁"
_MARK = SPACE.encode()
SLICE = 1 << 18
LATTICE_BYTES = 1 << 15
# Fixed value: the score of pieces that a model was given rather than learnt.
ADDED_SCORE = -1e9


class PieceModel:
    """The vocabulary of a SentencePiece model as pieces with scores, for encoding and decoding."""

    def __init__(self, serialized: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        self.pieces: dict[bytes, int] = {}
        self.scores = np.full(model.get_piece_size(), -np.inf)
        self.text: list[bytes | None] = []
        self.byte_ids = np.full(256, -1)
        ordinary = []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.text.append(None)
                continue
            if model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.text.append(b"")
                continue
            raw = piece.encode()
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece goes on after a word start")
            self.text.append(raw)
            self.scores[k] = model.get_score(k)
            ordinary.append((raw, k))
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        # Byte pieces have no score of their own: each costs more than any learnt piece.
        learnt = [self.scores[k] for _, k in ordinary if self.scores[k] > ADDED_SCORE]
        self.worst = float(min(learnt)) - 1.0
        for byte in range(256):
            self.scores[self.byte_ids[byte]] = self.worst
        self.pieces = dict(ordinary)
        # A byte piece joins the lattice only where a character has no piece.
        single = {raw for raw, _ in ordinary if len(raw.decode()) == 1}
        self.single_ascii = np.array([bytes([b]) in single for b in range(256)])
        self.single = single
        self.table = L.PieceTable(ordinary)
        self.byte_of = {int(k): byte for byte, k in enumerate(self.byte_ids)}

    def escaped(self, text: str) -> bytes:
        return (SPACE + text.replace(" ", SPACE)).encode() if text else b""

    def missing_characters(self, data: np.ndarray) -> np.ndarray:
        """Mask of the bytes of characters without a piece."""
        lead = (data & 0xC0) != 0x80
        starts = np.flatnonzero(lead)
        ends = np.append(starts[1:], len(data))
        missing = np.zeros(len(data), bool)
        ascii_at = starts[ends - starts == 1]
        missing[ascii_at] = ~self.single_ascii[data[ascii_at]]
        wide = np.flatnonzero(ends - starts > 1)
        raw = data.tobytes()
        known: dict[bytes, bool] = {}
        for k in wide:
            c = raw[starts[k] : ends[k]]
            if c not in known:
                known[c] = c in self.single
            if not known[c]:
                missing[starts[k] : ends[k]] = True
        return missing

    def decode(self, ids) -> str:
        out = b"".join(
            bytes([self.byte_of[k]]) if self.text[k] is None else self.text[k] for k in ids
        )
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Borders of words in escaped bytes: before a run of spaces, and around every character
    that no piece joins with another (a line end)."""
    mark = np.zeros(len(data), bool)
    if len(data) >= 3:
        mark[:-2] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
    after = np.zeros(len(data), bool)
    after[3:] = mark[:-3]
    start = mark & ~after
    control = data < 32
    start |= control
    start[1:] |= control[:-1]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    start[filled] = True
    return np.flatnonzero(start)


class WordLattices:
    """Best segmentation and loss of the second best, for many words at once."""

    def __init__(self, model: PieceModel, data: np.ndarray, offsets: np.ndarray):
        self.model, self.data, self.offsets = model, data, offsets
        base = model.table.edges(data, offsets)
        self.first, self.last, self.nodes = base.first, base.last, base.nodes
        self.source, self.target = base.source, base.target
        self.piece, self.word, self.steps = base.piece.astype(np.int64), base.word, base.steps
        odd = np.flatnonzero(model.missing_characters(data))
        if len(odd):
            lengths = np.diff(offsets)
            owner = np.repeat(np.arange(len(lengths)), lengths)[odd]
            self.source = np.concatenate([self.source, odd + owner])
            self.target = np.concatenate([self.target, odd + 1 + owner])
            self.piece = np.concatenate([self.piece, model.byte_ids[data[odd]]])
            self.word = np.concatenate([self.word, owner])
            distance = self.target - self.first[self.word]
            order = np.argsort(distance * np.int64(self.nodes) + self.target, kind="stable")
            for name in ("source", "target", "piece", "word"):
                setattr(self, name, getattr(self, name)[order])
            counts = np.bincount(distance, minlength=int(lengths.max()) + 1)
            self.steps = np.concatenate([[0], np.cumsum(counts)])
        self.score = model.scores[self.piece]
        self._forward()

    def _forward(self) -> None:
        self.alpha = np.full(self.nodes, -np.inf)
        self.alpha[self.first] = 0.0
        self.best_edge = np.full(self.nodes, -1, np.int64)
        for t in range(1, len(self.steps) - 1):
            a, b = self.steps[t], self.steps[t + 1]
            if a == b:
                continue
            target = self.target[a:b]
            head = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            total = self.alpha[self.source[a:b]] + self.score[a:b]
            best = np.maximum.reduceat(total, head)
            sizes = np.diff(np.append(head, b - a))
            at = np.flatnonzero(total == np.repeat(best, sizes))
            group = np.repeat(np.arange(len(head)), sizes)[at]
            chosen = at[np.concatenate([[True], group[1:] != group[:-1]])]
            self.alpha[target[head]] = best
            self.best_edge[target[head]] = chosen + a

    def losses(self) -> np.ndarray:
        """How much the second-best segmentation of each word falls behind the best."""
        beta = np.full(self.nodes, -np.inf)
        beta[self.last] = 0.0
        depth = self.source - self.first[self.word]
        order = np.argsort(self.source - depth * np.int64(self.nodes + 1), kind="stable")
        source, target, score = self.source[order], self.target[order], self.score[order]
        depth = depth[order]
        cuts = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1]]))[: len(depth)]
        for a, b in zip(cuts, np.append(cuts[1:], len(depth))):
            own = source[a:b]
            head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            beta[own[head]] = np.maximum.reduceat(score[a:b] + beta[target[a:b]], head)
        through = self.alpha[self.source] + self.score + beta[self.target]
        through[self._on_best()] = -np.inf
        second = np.full(len(self.last), -np.inf)
        order = np.argsort(self.word, kind="stable")
        if len(order):
            names, head = np.unique(self.word[order], return_index=True)
            second[names] = np.maximum.reduceat(through[order], head)
        return self.alpha[self.last] - second

    def _on_best(self) -> np.ndarray:
        """Edges of the best segmentations of all words, walked back together."""
        out, at = [], self.last.copy()
        first = self.first.copy()
        while len(at):
            moving = at > first
            at, first = at[moving], first[moving]
            edge = self.best_edge[at]
            out.append(edge)
            at = self.source[edge]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def best_pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all words end to end, offsets)."""
        edges = self._on_best()
        order = np.argsort(self.target[edges], kind="stable")
        edges = edges[order]
        word = self.word[edges]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(self.last)))])
        return self.piece[edges], offsets

    def into(self, word: int) -> dict[int, list[tuple[int, int, float]]]:
        """Edges into every node of one word: (source, piece, score)."""
        a, b = self.first[word], self.last[word]
        if not hasattr(self, "_by_target"):
            self._by_target = np.argsort(self.target, kind="stable")
            self._sorted_target = self.target[self._by_target]
        lo, hi = np.searchsorted(self._sorted_target, [a, b + 1])
        out: dict[int, list[tuple[int, int, float]]] = {}
        for e in self._by_target[lo:hi]:
            out.setdefault(int(self.target[e]), []).append(
                (int(self.source[e]), int(self.piece[e]), float(self.score[e]))
            )
        return out

    def n_best(self, word: int, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, pieces) of a word by backward A-star, best first.

        Of equally good ones the forward path comes first.
        """
        into = self.into(word)
        start, end = int(self.first[word]), int(self.last[word])
        queue = [(-float(self.alpha[end]), (), end, 0.0)]
        found: list[tuple[float, tuple[int, ...]]] = []
        while queue and len(found) < n:
            _, pieces, node, behind = heapq.heappop(queue)
            if node == start:
                found.append((behind, pieces))
                continue
            for source, piece, score in into.get(node, ()):
                total = behind + score
                heapq.heappush(
                    queue, (-(total + float(self.alpha[source])), (piece, *pieces), source, total)
                )
        path, at = [], end
        while at > start:
            edge = self.best_edge[at]
            path.append(int(self.piece[edge]))
            at = int(self.source[edge])
        first = (float(self.alpha[end]), tuple(reversed(path)))
        return [first, *[f for f in found if f[1] != first[1]]][:n]


def combined(
    parts: list[list[tuple[float, tuple[int, ...]]]], n: int
) -> list[tuple[float, tuple[int, ...]]]:
    """The n best ways to take one entry of each list (each best first): (loss, choices)."""
    losses = [[p[0][0] - score for score, _ in p] for p in parts]
    best = (0,) * len(parts)
    queue, seen, out = [(0.0, best)], {best}, []
    while queue and len(out) < n:
        loss, choice = heapq.heappop(queue)
        out.append((loss, choice))
        for k, c in enumerate(choice):
            if c + 1 < len(parts[k]):
                further = (*choice[:k], c + 1, *choice[k + 1 :])
                if further not in seen:
                    seen.add(further)
                    heapq.heappush(queue, (loss - losses[k][c] + losses[k][c + 1], further))
    return out


class Segmenter:
    """N-best segmentation of texts; what is known of a word is kept for the next slice."""

    def __init__(self, model: PieceModel, n: int, cache_words: int = 100_000):
        self.model, self.n, self.cache_words = model, n, cache_words
        self._forget()

    def _forget(self) -> None:
        self.names = np.zeros(0, np.uint64)
        self.pieces, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self.searched: dict[int, list] = {}

    def _knows(self, names: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, names)
        found = at < len(self.names)
        found[found] = self.names[at[found]] == names[found]
        return found

    def _learn(self, names: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        """Add new distinct words; the arrays stay sorted by name."""
        parts = []
        # A lattice has many edges a byte: those of a few words at a time.
        for a, b in K.document_slices(offsets, LATTICE_BYTES):
            few = offsets[a : b + 1] - offsets[a]
            words = WordLattices(self.model, data[offsets[a] : offsets[b]], few)
            pieces, cuts = words.best_pieces()
            loss = words.losses() if self.n > 1 else np.full(b - a, np.inf)
            parts.append((pieces.astype(np.int32), np.diff(cuts), loss, words.alpha[words.last]))
        pieces, counts, loss, score = (np.concatenate(c) for c in zip(*parts))
        cuts = np.concatenate([[0], np.cumsum(counts)])
        joined = np.concatenate([self.names, names])
        order = np.argsort(joined)
        ends = np.concatenate([self.offsets[1:], cuts[1:] + self.offsets[-1]])
        begins = np.concatenate([self.offsets[:-1], cuts[:-1] + self.offsets[-1]])
        every = np.concatenate([self.pieces, pieces])
        self.pieces, self.offsets = K.gathered(every, begins[order], ends[order])
        self.names = joined[order]
        self.score = np.concatenate([self.score, score])[order]
        self.loss = np.concatenate([self.loss, loss])[order]

    def _search(self, wanted: dict[int, bytes]) -> None:
        """Search the words (by name) that were not searched before, on one common lattice."""
        new = {k: raw for k, raw in wanted.items() if k not in self.searched}
        if not new:
            return
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in new.values()])])
        data = np.frombuffer(b"".join(new.values()), np.uint8)
        words = WordLattices(self.model, data, offsets.astype(np.int64))
        for k, name in enumerate(new):
            self.searched[name] = words.n_best(k, self.n)

    def segment(self, texts: list[str]) -> list[list[tuple[float, np.ndarray]]]:
        """The n best segmentations (score, ids) of each text, best first."""
        raw = [self.model.escaped(t) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        if not len(data):
            return [[(0.0, np.zeros(0, np.int32))] for _ in texts]
        if len(self.names) > self.cache_words:
            self._forget()
        starts = word_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hasher = self.model.table.hasher
        hashes = hasher.ranges(hasher.sums(data), starts, ends)
        names, where, place = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~self._knows(names)
        if new.any():
            self._learn(names[new], *K.gathered(data, starts[where[new]], ends[where[new]]))
        known = np.searchsorted(self.names, names)[place]
        bounds = np.searchsorted(starts, offsets)
        close = []
        for d in range(len(texts)):
            loss = self.loss[known[bounds[d] : bounds[d + 1]]]
            count = min(self.n - 1, len(loss))
            few = np.argpartition(loss, count - 1)[:count] if count else np.zeros(0, np.int64)
            close.append(np.sort(few[np.isfinite(loss[few])]))
        at = np.concatenate([c + bounds[d] for d, c in enumerate(close)])
        self._search({int(hashes[w]): joined[int(starts[w]) : int(ends[w])] for w in at})
        out = []
        for d, few in enumerate(close):
            own = known[bounds[d] : bounds[d + 1]]
            flat, cuts = K.gathered(self.pieces, self.offsets[own], self.offsets[own + 1])
            total = float(self.score[own].sum())
            found = [(total, flat)]
            parts = [self.searched[int(hashes[bounds[d] + k])] for k in few]
            for lost, choice in combined(parts, self.n)[1:] if parts else []:
                ids, last = [], 0
                for k, c, part in zip(few, choice, parts):
                    if c:
                        ids += [flat[last : cuts[k]], np.array(part[c][1], np.int32)]
                        last = cuts[k + 1]
                found.append((total - lost, np.concatenate([*ids, flat[last:]])))
            out.append(found)
        return out


def encode_documents(
    docs: DataFrame,
    model_file: str,
    n_best: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    with_text: bool = False,
) -> DataFrame:
    """Per document row: id, n_pieces, pieces (best ids), scores (n best), alternatives (the
    other ids), ids_crc32 (of all n best as little-endian 32 bit), restored (the best, decoded as
    ``PieceModel.decode`` does, is the text: false where it holds U+2581 itself), and with
    ``with_text`` decoded, that text: one worker encodes and decodes."""
    import pyarrow as pa

    with open(model_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_pieces", "pieces", "scores", "alternatives", "ids_crc32", "restored"]
    names += ["decoded"] if with_text else []

    def run(batches):
        model = PieceModel(shared.value)
        segmenter = Segmenter(model, n_best)
        for batch in batches:
            _, offsets = K.text_buffers(batch.column(1))
            for a, b in K.document_slices(offsets, SLICE):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                rows = []
                for text, found in zip(texts, segmenter.segment(texts)):
                    crc = 0
                    for _, ids in found:
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    best = found[0][1]
                    decoded = model.decode(best.tolist())
                    rows.append(
                        (
                            len(best),
                            best.astype(np.int32) if with_ids else None,
                            [s for s, _ in found],
                            [i.astype(np.int32) for _, i in found[1:]] if with_ids else None,
                            crc,
                            decoded == text,
                            *([decoded] if with_text else []),
                        )
                    )
                columns = list(zip(*rows))
                kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()),
                         pa.list_(pa.list_(pa.int32())), pa.int64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        *[pa.array(list(c), k) for c, k in zip(columns, kinds)],
                    ],
                    names=names,
                )

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(
        lean(run),
        f"id {id_type}, n_pieces int, pieces array<int>, scores array<double>, "
        "alternatives array<array<int>>, ids_crc32 long, restored boolean"
        + (", decoded string" if with_text else ""),
    )


def decode_documents(encoded: DataFrame, model_file: str, ids_col: str = "pieces") -> DataFrame:
    """The encoded rows with a column ``text`` decoded from their pieces."""
    with open(model_file, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(series):
        import pandas as pd

        model = PieceModel(shared.value)
        for ids in series:
            yield pd.Series([None if x is None else model.decode(x) for x in ids])

    from collections.abc import Iterator

    import pandas as pd

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return encoded.withColumn("text", F.pandas_udf(run, "string")(F.col(ids_col)))
