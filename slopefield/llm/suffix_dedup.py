"""Removal of long repeated byte strings by a suffix array of the texts' anchors.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too.

0. Equal texts are found by digest; one of them takes part in what follows.
1. *Anchors.* Each start p of such a string belongs to one anchor: the smallest hash of a
   101-byte stretch within the string. Equal strings have equal anchors at equal places,
   so a string can repeat only where its anchor does. A Bloom filter passes the anchors
   that may repeat; the others, most of all text, never leave their task.
2. *Suffix array.* Anchors in text order form a reduced string whose symbols name an
   anchor's whole range of starts with the bytes they cover. It is sorted by the difference
   cover of 3 (``suffix_array``): sample triples, recurse on their names, merge. Adjacent
   suffixes are compared: where their prefixes agree, all starts of the anchor repeat.
3. *Borders.* An anchor whose range is not repeated as a whole may repeat in part, where a
   repeat begins or ends. The bytes around such anchors, and around two members of every
   repeated range of the same hash, meet by hash; there every start is compared.
   Anchors that very many texts share are compared start by start through a count
   by hash instead, so that no group grows without bound.
4. Starts become spans of removed bytes, and texts with spans are cut.

Strings are judged on the input. Ranges and the starts of frequent anchors are told apart by two
64-bit hashes, starts of other anchors by one among those that share a 64-bit anchor. ``length`` must
be above 100.

Defined cases: a null text counts as empty; texts shorter than ``length`` keep all their
bytes; rows are told apart by their place in ``docs``, which must be a stored table, so
equal ids do no harm; what is kept of a multi-byte character stays as bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopefield.llm import kernels as K
from slopefield.llm.common import deleted, joined_with_groups, lean, numbered, stored, text_of
from slopefield.llm.exact_dedup import repeated_bits_of
from slopefield.llm.suffix_array import following, running_counts, suffix_ranks

STRETCH = 101
HOT_MEMBERS = 2048
PREFIX = 9


def _start_runs(
    values: np.ndarray, offsets: np.ndarray, length: int, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, first start, last start) of the runs of starts with one anchor: the
    first smallest of the ``width`` values from a start on. Sorted; places within the slice."""
    smallest = K.sliding(values, width, np.minimum)
    cut = np.empty(len(smallest), bool)
    np.not_equal(smallest[1:], smallest[:-1], out=cut[1:])
    cut[offsets[:-1][np.diff(offsets) >= length]] = True
    first = np.flatnonzero(cut)
    end = np.append(first[1:], len(smallest)) - 1
    # Strings that reach into the next document are none.
    d = np.searchsorted(offsets, first, side="right") - 1
    last = np.minimum(end, offsets[d + 1] - length)
    inside = first <= last
    d, first, last = d[inside], first[inside], last[inside]
    place = first + values[first[:, None] + np.arange(width)].argmin(axis=1)
    again = np.flatnonzero(place < last)
    if not len(again):
        return d, place, first, last
    # A smallest value that returns: each of its places has the starts behind the one before.
    counts = last[again] + width - place[again]
    run = np.repeat(again, counts)
    at = place[run] + np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    equal = values[at] == values[place[run]]
    run, at = run[equal], at[equal]
    behind = np.flatnonzero((run[1:] == run[:-1]) & (at[:-1] < last[run[1:]])) + 1
    run, more, since = run[behind], at[behind], at[behind - 1] + 1
    until = np.minimum(more, last[run])
    last = last.copy()
    last[again] = place[again]
    columns = ((d, d[run]), (place, more), (first, since), (last, until))
    d, place, first, last = (np.concatenate(c) for c in columns)
    order = np.argsort(first)
    return d[order], place[order], first[order], last[order]


def anchors_of(
    data: np.ndarray, offsets: np.ndarray, hasher: K.ByteHasher, length: int, named: bool = True
):
    """(document, place, first start, last start, hash, name of the whole range) of anchors.

    Places are within the document; a range of starts and its bytes have one name, which is
    left out (None) unless ``named``.
    """
    if not len(offsets) or np.diff(offsets).max(initial=0) < length:
        none = np.zeros(0, np.uint64)
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (none, none if named else None)
    sums = hasher.sums(data)
    values = hasher.windows(sums, STRETCH)
    d, place, first, last = _start_runs(values, offsets, length, length - STRETCH + 1)
    name = None
    if named:
        whole = hasher.ranges(sums, first, last + length)
        name = K.mixed(whole ^ K.mixed((place - first).astype(np.uint64)))
    begin = offsets[d]
    return d, place - begin, first - begin, last - begin, values[place], name


# Bytes whose hashes stay near the processor while anchors are looked for.
NEAR_BYTES = 1 << 17


def _each_slice(batch, column: int):
    data, offsets = K.text_buffers(batch.column(column))
    for a, b in K.document_slices(offsets, NEAR_BYTES):
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _repeated_anchors(docs: DataFrame, length: int, amount: int, max_bits: int) -> DataFrame:
    """Stored (row, place, first, last, hash, name) of anchors whose hash may repeat."""
    import pyarrow as pa

    def hashes_of(batches):
        hasher = K.ByteHasher()
        for batch in batches:
            for _, data, offsets in _each_slice(batch, 0):
                yield anchors_of(data, offsets, hasher, length, named=False)[4]

    expected = max(1024, 2 * amount // (length - STRETCH + 1))
    maybe = repeated_bits_of(docs.select("text"), hashes_of, expected, 12, max_bits)

    def found(batches):
        hasher = K.ByteHasher()
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for a, data, offsets in _each_slice(batch, 1):
                d, place, first, last, value, name = anchors_of(data, offsets, hasher, length)
                keep = maybe(value)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[a + d[keep]]),
                        pa.array(place[keep].astype(np.int32)),
                        pa.array(first[keep].astype(np.int32)),
                        pa.array(last[keep].astype(np.int32)),
                        pa.array(value[keep].view(np.int64)),
                        pa.array(name[keep].view(np.int64)),
                    ],
                    names=["row", "place", "first", "last", "hash", "name"],
                )

    schema = "row long, place int, first int, last int, hash long, name long"
    return stored(docs.select("row", "text").mapInArrow(lean(found), schema), "anchors")


def repeated_ranges(anchors: DataFrame) -> DataFrame:
    """Stored anchors with ``repeated``: whether the whole range of starts repeats elsewhere.

    By the suffix array of the reduced string: equal first symbols stand side by side.
    """
    symbols = running_counts(anchors.select("row", "place", "name", "hash"), ["row", "place"])
    # Symbols from 1 on; halving a 64-bit name leaves 63 bits to tell them apart.
    symbol = F.shiftrightunsigned("name", 1).bitwiseOR(F.lit(1))
    text = symbols.select(F.col("before").alias("i"), symbol.alias("c"), "hash")
    ranks = suffix_ranks(text.select("i", "c"), PREFIX)
    order = running_counts(text.join(ranks, "i").select("rank", "i", "c", "hash"), ["rank", "i"])
    deleted(ranks)
    # Neighbours in the order stand beside each other once more: positions as a new text.
    side = order.select(F.col("before").alias("i"), F.col("i").alias("at"), "c", "hash")
    beside = following(side, {"behind": ("c", 1), "behind_at": ("at", 1), "behind_hash": ("hash", 1)})
    # Equal names of different anchors are a collision: 127 bits tell ranges apart.
    equal = beside.where("c = behind AND hash = behind_hash")
    repeated = stored(
        equal.select("at").union(equal.select("behind_at")).distinct(), "repeated"
    )
    deleted(order)
    places = symbols.join(repeated, F.col("before") == F.col("at")).select(
        "row", "place", F.lit(True).alias("repeated")
    )
    found = stored(
        anchors.join(places, ["row", "place"], "left").withColumn(
            "repeated", F.coalesce("repeated", F.lit(False))
        ),
        "ranges",
    )
    deleted(symbols)
    return found


def _contexts(
    docs: DataFrame, members: DataFrame, hot: DataFrame, length: int, max_bits: int
) -> DataFrame:
    """Stored (row, place, first, last, hash, hot, bytes) of the wanted anchors (and few
    others, by a Bloom filter: true occurrences as well)."""
    import pyarrow as pa

    def twice(key):
        def noted(batches):
            for batch in batches:
                yield np.repeat(key(batch), 2)

        return noted

    def column(batch, k):
        return batch.column(k).to_numpy(zero_copy_only=False)

    def place_key(rows, places):
        return K.mixed(K.mixed(rows.view(np.uint64)) + places.astype(np.uint64))

    n = members.count()
    in_row = repeated_bits_of(
        members.select("row").distinct(),
        twice(lambda b: K.mixed(column(b, 0).view(np.uint64))), n, 16, max_bits,
    )
    in_place = repeated_bits_of(
        members.select("row", "place"),
        twice(lambda b: place_key(column(b, 0), column(b, 1))), n, 16, max_bits,
    )
    is_hot = repeated_bits_of(
        hot.select("hash"), twice(lambda b: column(b, 0).view(np.uint64)), hot.count(), 16, max_bits
    )

    def found(batches):
        hasher = K.ByteHasher()
        for batch in batches:
            rows = column(batch, 0)
            batch = batch.filter(pa.array(in_row(K.mixed(rows.view(np.uint64)))))
            rows = column(batch, 0)
            for a, data, offsets in _each_slice(batch, 1):
                d, place, first, last, value, _ = anchors_of(data, offsets, hasher, length, False)
                keep = in_place(place_key(rows[a + d], place))
                d, place, first, last, value = (
                    x[keep] for x in (d, place, first, last, value)
                )
                begin = offsets[d] + first
                flat, cuts = K.gathered(data, begin, offsets[d] + last + length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[a + d]),
                        pa.array(place.astype(np.int32)),
                        pa.array(first.astype(np.int32)),
                        pa.array(last.astype(np.int32)),
                        pa.array(value.view(np.int64)),
                        pa.array(is_hot(value)),
                        K.binary_column(flat, cuts),
                    ],
                    names=["row", "place", "first", "last", "hash", "hot", "bytes"],
                )

    schema = "row long, place int, first int, last int, hash long, hot boolean, bytes binary"
    return stored(docs.select("row", "text").mapInArrow(lean(found), schema), "contexts")


def _window_hashes(batch, hasher: K.ByteHasher, length: int):
    """(member, start, hash of the string with its place relative to the anchor) of all starts
    of the members of a batch with columns place, first, last, bytes at 1, 2, 3, 6."""
    place, first, last = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3))
    raw = batch.column(6).to_pylist()
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    counts = last - first + 1
    member = np.repeat(np.arange(len(place)), counts)
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[member] + step
    hashes = hasher.ranges(hasher.sums(data), begin, begin + length)
    start = first[member] + step
    return member, start, K.mixed(hashes ^ (place[member] - start).astype(np.uint64))


def _runs(row: np.ndarray, start: np.ndarray):
    """Runs of consecutive starts as (row, first, last) from sorted pairs."""
    cut = np.flatnonzero(
        np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
    )[: len(row)]
    end = np.append(cut[1:], len(row)) - 1
    return row[cut], start[cut], start[end[: len(cut)]]


RUNS = "row long, first int, last int"


def _run_batch(row, start):
    import pyarrow as pa

    order = np.lexsort((start, row))
    a, b, c = _runs(row[order], start[order])
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b.astype(np.int32)), pa.array(c.astype(np.int32))],
        names=["row", "first", "last"],
    )


def _border_runs(contexts: DataFrame, length: int) -> DataFrame:
    """Runs of repeated starts among the members that share an anchor hash."""
    import pyarrow as pa

    def compared(batches):
        hasher, held = K.ByteHasher(), None
        for batch in K.with_end(batches):
            if batch is not None:
                held = batch if held is None else pa.concat_batches([held, batch])
            if held is None or not held.num_rows:
                continue
            key = held.column(4).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            done = int(cuts[-1] if batch is None else cuts[-2])
            if not done:
                continue
            for part in _pieces(held.slice(0, done), cuts[cuts <= done]):
                member, start, hashes = _window_hashes(part, hasher, length)
                group = K.mixed(part.column(4).to_numpy().view(np.uint64))[member]
                _, place, count = np.unique(
                    hashes ^ group, return_inverse=True, return_counts=True
                )
                again = count[place] > 1
                rows = part.column(0).to_numpy()
                yield _run_batch(rows[member[again]], start[again])
            held = held.slice(done)

    def each(batches):
        hasher = K.ByteHasher()
        for batch in batches:
            for part in _pieces(batch, np.arange(batch.num_rows + 1)):
                member, start, hashes = _window_hashes(part, hasher, length)
                group = K.mixed(part.column(4).to_numpy().view(np.uint64))[member]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.column(0).to_numpy()[member]),
                        pa.array(start.astype(np.int32)),
                        pa.array((hashes ^ group).view(np.int64)),
                        pa.array(part.column(4).to_numpy()[member]),
                    ],
                    names=["row", "start", "string", "anchor"],
                )

    def as_runs(batches):
        for batch in batches:
            yield _run_batch(batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64))

    cold = (
        contexts.where("NOT hot")
        .repartition("hash")
        .sortWithinPartitions("hash")
        .mapInArrow(lean(compared), RUNS)
    )
    starts = stored(
        contexts.where("hot").mapInArrow(lean(each), "row long, start int, string long, anchor long"), "starts"
    )
    both = ["string", "anchor"]
    again = starts.groupBy(*both).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*both)
    hot = (
        starts.join(again, both, "left_semi").select("row", "start").mapInArrow(lean(as_runs), RUNS)
    )
    return cold.unionByName(hot)


def _pieces(batch, cuts: np.ndarray, limit: int = 8192):
    """Slices of a batch of about ``limit`` rows that end at given borders."""
    a = 0
    while a < cuts[-1]:
        b = int(cuts[min(np.searchsorted(cuts, a + limit), len(cuts) - 1)])
        yield batch.slice(a, b - a)
        a = b


def _merged_spans(runs: DataFrame, length: int) -> DataFrame:
    """(row, begins, ends) of the maximal removed spans of each row with any."""

    def merged(spans):
        import pandas as pd

        begins, ends = [], []
        for of_row in spans:
            pairs = sorted((s["first"], s["last"] + length) for s in of_row)
            out: list[list[int]] = []
            for a, b in pairs:
                if out and a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], b)
                else:
                    out.append([a, b])
            begins.append([o[0] for o in out])
            ends.append([o[1] for o in out])
        return pd.DataFrame({"begins": begins, "ends": ends})

    import pandas as pd

    merged.__annotations__ = {"spans": pd.Series, "return": pd.DataFrame}
    spans = F.pandas_udf(merged, "begins array<int>, ends array<int>")
    return (
        runs.groupBy("row")
        .agg(F.collect_list(F.struct("first", "last")).alias("spans"))
        .select("row", spans("spans").alias("merged"))
        .select("row", "merged.begins", "merged.ends")
    )


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 200,
    max_filter_bits: int = 1 << 28,
    with_bytes: bool = True,
) -> DataFrame:
    """Per document row: row, id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes)."""
    import pyarrow as pa

    if length < STRETCH:
        raise ValueError(f"length must be at least {STRETCH}")
    source = numbered(
        docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    )
    amount = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Equal texts take part once; each of them repeats as a whole.
    digests = stored(
        source.select("row", F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
                      F.octet_length("text").alias("size")),
        "digests",
    )
    groups = stored(
        digests.groupBy("sha").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n"))
        .where("n > 1"),
        "groups",
    )
    same = stored(
        joined_with_groups(digests, groups, "sha", "n", digests.count(), F.col("row"))
        .where("n IS NOT NULL")
        .select("row", "size", (F.col("row") != F.col("first_row")).alias("copy")),
        "copies",
    )
    copied = same.where(F.col("size") >= length).select(
        "row", F.lit(0).alias("first"), (F.col("size") - length).cast("int").alias("last")
    )
    found = _repeated_anchors(source, length, amount, max_filter_bits)
    flagged = found.join(same.where("copy").select("row"), "row", "left_anti")

    def anchor_hashes(batches):
        return (b.column(0).to_numpy().view(np.uint64) for b in batches)

    again = repeated_bits_of(
        flagged.select("hash"), anchor_hashes, flagged.count(), 16, max_filter_bits
    )

    @F.pandas_udf("boolean")
    def may_repeat(hashes):
        import pandas as pd

        return pd.Series(again(hashes.to_numpy().view(np.uint64)))

    anchors = stored(flagged.where(may_repeat("hash")), "shared-anchors")
    deleted(found)
    if anchors.isEmpty():
        runs = copied
    else:
        ranges = repeated_ranges(anchors)
        whole = ranges.where("repeated")
        part = ranges.where("NOT repeated").select("row", "place", "hash")
        mixed_hashes = part.select("hash").distinct()
        # Two members of every repeated range stand for all of it.
        # They are found by hash tables that merge before the shuffle, however many members a
        # range has; only they meet the hashes.
        packed = (
            F.col("row").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)")
            + F.col("place").cast("decimal(10,0)")
        ).cast("decimal(38,0)")
        two = (
            whole.groupBy("hash", "name")
            .agg(F.min(packed).alias("a"), F.max(packed).alias("b"))
            .join(mixed_hashes, "hash", "left_semi")
            .select("hash", F.explode(F.array("a", "b")).alias("m"))
            .selectExpr(f"CAST(m DIV {1 << 31} AS LONG) AS row", f"CAST(m % {1 << 31} AS INT) AS place", "hash")
        )
        members = stored(part.unionByName(two), "members")
        hot = (
            members.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > HOT_MEMBERS).select("hash")
        )
        contexts = _contexts(source, members, stored(hot, "hot"), length, max_filter_bits)
        runs = (
            whole.select("row", "first", "last")
            .unionByName(_border_runs(contexts, length))
            .unionByName(copied)
        )
    spans = stored(_merged_spans(runs, length), "spans")

    def noted(batches):
        for batch in batches:
            yield np.repeat(K.mixed(batch.column(0).to_numpy().view(np.uint64)), 2)

    cut = repeated_bits_of(spans.select("row"), noted, spans.count(), 16, max_filter_bits)

    @F.pandas_udf("boolean")
    def may_be_cut(rows):
        import pandas as pd

        return pd.Series(cut(K.mixed(rows.to_numpy().view(np.uint64))))

    def kept(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            begins, ends = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            n, removed, count, sha, rest = [], [], [], [], []
            for text, a, b in zip(texts, begins, ends):
                raw = text.encode()
                pieces, at = [], 0
                for x, y in zip(a or [], b or []):
                    pieces.append(raw[at:x])
                    at = y
                pieces.append(raw[at:])
                left = b"".join(pieces)
                n.append(len(raw))
                removed.append(len(raw) - len(left))
                count.append(len(a or []))
                sha.append(hashlib.sha256(left).hexdigest())
                rest.append(left if with_bytes else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(n, pa.int64()),
                    pa.array(removed, pa.int64()), pa.array(count, pa.int64()),
                    pa.array(sha, pa.string()), pa.array(rest, pa.binary()),
                ],
                names=["row", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    flagged_rows = source.withColumn("_cut", may_be_cut("row"))
    zero = F.lit(0).cast("long")
    same = flagged_rows.where("NOT _cut").select(
        "row", "id", F.octet_length("text").cast("long").alias("n_bytes"),
        zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
        (F.col("text").cast("binary") if with_bytes else F.lit(None).cast("binary")).alias("kept"),
    )
    cut_rows = (
        flagged_rows.where("_cut").select("row", "id", "text").join(spans, "row", "left")
        .select("row", "id", "text", "begins", "ends")
        .mapInArrow(
            lean(kept),
            "row long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
            "kept binary",
        )
    )
    return same.unionByName(cut_rows)
