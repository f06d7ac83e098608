"""Piece lattices of many words at once, over a fixed vocabulary.

``PieceTable.edges`` finds every piece at every place of the words: all places advance a
byte at a time together, and only those whose bytes still begin some piece go on. The
edges come sorted by how far into its word they end, so that a dynamic program over all
words is a short loop over that distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from slopefield.llm import kernels as K

_GATE = np.uint64((1 << 17) - 1)


@dataclass
class Edges:
    """Edges by the distance of their end from the word's start; nodes are bytes plus one end
    node per word."""

    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    word: np.ndarray
    steps: np.ndarray  # edges of distance t are steps[t] .. steps[t + 1]
    first: np.ndarray  # start node of each word
    last: np.ndarray  # end node of each word
    nodes: int

    def by_target(self):
        """For each distance in turn: (edge range, first edge of each target, targets)."""
        for t in range(1, len(self.steps) - 1):
            a, b = self.steps[t], self.steps[t + 1]
            if a < b:
                target = self.target[a:b]
                head = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
                yield slice(a, b), head, target[head]


class PieceTable:
    def __init__(self, pieces: list[tuple[bytes, int]]):
        self.hasher = K.ByteHasher()
        self.longest = max((len(p) for p, _ in pieces), default=0)
        levels: list[dict[bytes, list]] = [{} for _ in range(self.longest + 1)]
        for piece, number in pieces:
            for k in range(1, len(piece)):
                levels[k].setdefault(piece[:k], [False, -1])[0] = True
            levels[len(piece)].setdefault(piece, [False, -1])[1] = number
        self.levels = []
        for level in levels:
            names = list(level)
            data = np.frombuffer(b"".join(names), np.uint8)
            ends = np.cumsum([len(n) for n in names], dtype=np.int64)
            starts = ends - np.array([len(n) for n in names], np.int64)
            hashes = self.hasher.ranges(self.hasher.sums(data), starts, ends)
            order = np.argsort(hashes)
            gate = np.zeros(int(_GATE) + 1, bool)
            gate[(hashes & _GATE).astype(np.int64)] = True
            values = [level[names[k]] for k in order]
            self.levels.append(
                (
                    hashes[order],
                    gate,
                    np.array([v[0] for v in values], bool),
                    np.array([v[1] for v in values], np.int32),
                )
            )

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> Edges:
        """All pieces in words laid end to end."""
        sums = self.hasher.sums(data)
        lengths = np.diff(offsets)
        word = np.repeat(np.arange(len(lengths)), lengths)
        limit = np.repeat(offsets[1:], lengths)
        active = np.arange(len(data))
        at, size, piece = [], [], []
        for k in range(1, self.longest + 1):
            active = active[limit[active] - active >= k]
            if not len(active):
                break
            names, gate, begins, numbers = self.levels[k]
            found = self.hasher.ranges(sums, active, active + k)
            open_gate = gate[(found & _GATE).astype(np.int64)]
            active, found = active[open_gate], found[open_gate]
            if not len(active):
                break
            place = np.minimum(np.searchsorted(names, found), len(names) - 1)
            real = names[place] == found
            active, place = active[real], place[real]
            whole = numbers[place] >= 0
            at.append(active[whole])
            size.append(np.full(int(whole.sum()), k, np.int64))
            piece.append(numbers[place[whole]])
            active = active[begins[place]]
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        size = np.concatenate(size) if size else np.zeros(0, np.int64)
        piece = np.concatenate(piece) if piece else np.zeros(0, np.int32)
        owner = word[at]
        distance = at + size - offsets[owner]
        source, target = at + owner, at + size + owner
        order = np.argsort(distance * np.int64(len(data) + len(lengths) + 1) + target, kind="stable")
        longest = int(lengths.max()) if len(lengths) else 0
        counts = np.bincount(distance, minlength=longest + 1)
        words = np.arange(len(lengths))
        return Edges(
            source[order],
            target[order],
            piece[order],
            owner[order],
            np.concatenate([[0], np.cumsum(counts)]),
            offsets[:-1] + words,
            offsets[1:] + words,
            len(data) + len(lengths),
        )


def prefixed(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: bytes
) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the given ranges, each behind a prefix."""
    lengths = ends - starts + len(prefix)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    out = np.zeros(int(offsets[-1]), np.uint8)
    inside = np.repeat(starts - offsets[:-1] - len(prefix), lengths) + np.arange(offsets[-1])
    lead = np.zeros(int(offsets[-1]), bool)
    for k, byte in enumerate(prefix):
        out[offsets[:-1] + k] = byte
        lead[offsets[:-1] + k] = True
    out[~lead] = data[inside[~lead]]
    return out, offsets


def forward(edges: Edges, weights: np.ndarray) -> np.ndarray:
    """Per node and column, the sum over all segmentations up to it (weights: piece x column)."""
    alpha = np.zeros((edges.nodes, weights.shape[1]))
    alpha[edges.first] = 1.0
    for span, head, targets in edges.by_target():
        part = alpha[edges.source[span]] * weights[edges.piece[span]]
        alpha[targets] = np.add.reduceat(part, head, axis=0)
    return alpha


# Steps after which sums are brought back to one, so that words of any length stay in range.
RESCALE = 64


def log_masses(edges: Edges, weights: np.ndarray, longest: int) -> np.ndarray:
    """Logarithm of the sum over all segmentations of each word, per column.

    ``longest`` is the length of the longest piece: what lies further back is not read again,
    so only so many sums are rescaled with every step.
    """
    alpha = np.zeros((edges.nodes, weights.shape[1]))
    alpha[edges.first] = 1.0
    lengths = edges.last - edges.first
    logs = np.zeros((len(lengths), weights.shape[1]))
    for t in range(1, len(edges.steps) - 1):
        a, b = edges.steps[t], edges.steps[t + 1]
        if a < b:
            target = edges.target[a:b]
            head = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            part = alpha[edges.source[a:b]] * weights[edges.piece[a:b]]
            alpha[target[head]] = np.add.reduceat(part, head, axis=0)
        if t % RESCALE == 0:
            further = np.flatnonzero(lengths > t)
            if len(further):
                back = np.arange(max(0, t - longest + 1), t + 1)
                rows = edges.first[further][:, None] + back[None, :]
                sums = alpha[rows]
                top = sums.max(axis=1)
                top = np.where(top > 0, top, 1.0)
                alpha[rows] = sums / top[:, None, :]
                logs[further] += np.log(top)
    return logs + np.log(np.maximum(alpha[edges.last], 1e-300))


def backward(edges: Edges, weights: np.ndarray) -> np.ndarray:
    """Per node and column, the sum over all segmentations from it to the word's end."""
    beta = np.zeros((edges.nodes, weights.shape[1]))
    beta[edges.last] = 1.0
    distance = edges.source - edges.first[edges.word]
    order = np.argsort(-distance * np.int64(edges.nodes + 1) + edges.source, kind="stable")
    source, target, piece = edges.source[order], edges.target[order], edges.piece[order]
    distance = distance[order]
    cuts = np.flatnonzero(np.concatenate([[True], distance[1:] != distance[:-1]]))[: len(distance)]
    for a, b in zip(cuts, np.append(cuts[1:], len(distance))):
        own = source[a:b]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        part = beta[target[a:b]] * weights[piece[a:b]]
        beta[own[head]] = np.add.reduceat(part, head, axis=0)
    return beta
