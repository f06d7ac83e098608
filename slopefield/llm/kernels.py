"""NumPy kernels over the UTF-8 bytes of an Arrow batch: words, hashes, shingles, anchors.

All work on one flat byte array with document offsets, a slice of half a megabyte
at a time, so that memory does not depend on the batch. Hashes are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without a copy; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, item = (np.int64, 8) if wide else (np.int32, 4)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * item).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


def document_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes, one document at least."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class ByteHasher:
    """Hashes of any byte ranges of a text from one running sum, equal wherever the range lies."""

    def __init__(self, fold_case: bool = False):
        codes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        if fold_case:
            codes[65:91] = codes[97:123]
        self.codes = codes
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) > n:
            return
        size = 1 << (n + 1).bit_length()
        for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                step = np.uint64(pow(base, len(out), 1 << 64))
                out = np.concatenate([out, out * step])
            setattr(self, name, out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum(self.codes[data] * self.power[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (sums[ends] - sums[starts]) * self.inverse[starts]
        return mixed(raw + (ends - starts).astype(np.uint64))

    def windows(self, sums: np.ndarray, size: int) -> np.ndarray:
        """``ranges`` of every ``size`` consecutive bytes."""
        raw = sums[size:] - sums[: len(sums) - size]
        raw *= self.inverse[: len(raw)]
        raw += np.uint64(size)
        return mixed(raw)


def byte_class(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


def find_runs(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the maximal runs of bytes of a class within each document."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    member = inside[data]
    before = np.empty_like(member)
    before[0], before[1:] = False, member[:-1]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = False
    after = np.empty_like(member)
    after[-1], after[:-1] = False, member[1:]
    after[offsets[1:][filled] - 1] = False
    starts = np.flatnonzero(member & ~before)
    ends = np.flatnonzero(member & ~after) + 1
    documents = np.searchsorted(offsets, starts, side="right") - 1
    return documents, starts, ends


def run_counts(documents: np.ndarray, n_documents: int) -> np.ndarray:
    return np.bincount(documents, minlength=n_documents)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive hashes (position i covers i .. i+n-1)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = (out * np.uint64(_BASE)) + hashes[k : len(hashes) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return mixed(out)


def distinct_shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles of one document; fewer words make one shingle."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    if len(hashes) < n:
        return gram_hashes(hashes, len(hashes)) + np.uint64(len(hashes))
    return np.unique(gram_hashes(hashes, n))


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best() of each ``width`` consecutive values, from the bests of half as many."""
    out, have = values[: len(values) if len(values) >= width else 0], 1
    while len(out) and have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Positions that are smallest in some window of ``width`` consecutive values, ties included.

    Which positions a window yields depends on that window alone, so equal stretches
    of text pick equal positions. Inputs shorter than a window give none.
    """
    if len(values) < width:
        return np.zeros(0, np.int64)
    smallest = sliding(values, width, np.minimum)
    # No window over a position has a minimum above its value: picked if one reaches it.
    rim = np.zeros(width - 1, np.uint64)
    reached = sliding(np.concatenate([rim, smallest, rim]), width, np.maximum)
    return np.flatnonzero(reached == values)


def gathered(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the given ranges laid end to end."""
    lengths = ends - starts
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    where = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return data[where], offsets


def binary_column(data: np.ndarray, offsets: np.ndarray, kind=None):
    """An Arrow binary (or string) array over given bytes and byte offsets."""
    import pyarrow as pa

    return pa.Array.from_buffers(
        kind or pa.binary(),
        len(offsets) - 1,
        [
            None,
            pa.py_buffer(np.ascontiguousarray(offsets, np.int32)),
            pa.py_buffer(np.ascontiguousarray(data)),
        ],
    )


def with_end(batches) -> Iterator:
    """The batches and a None behind the last."""
    yield from batches
    yield None
