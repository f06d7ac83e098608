"""Benchmark decontamination by a positional inverted index that is spread by document.

``build_index`` stores the postings of every training token: documents are taken in
segments of a few megabytes, and a segment holds, for each of its terms, the sorted word
positions, next to its documents' ids and word counts. A segment is written by one task
without any shuffle. ``phrase_hits`` reads from the index only the terms of the test
items, brings the lists of a segment together and intersects them shifted by their place
in the phrase, rarest list first. All occurrences are found; nothing is estimated.

Windows of the test items are made and counted by Spark; those with a term that the index
lacks go no further. The others are searched in blocks of about ``block_words`` words, which
bounds what passes the driver and what is sent to the tasks, and a segment looks only at the
windows whose rarest term it holds. A common word cannot make a task large: a task sees one
segment's lists, however often the word occurs elsewhere.

Defined cases: null or word-free texts have no words and no hits; null and word-free
items have no windows; a repeated item id counts once; repeated document rows are
reported row by row; a null item id is written as an empty string.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopefield.llm import kernels as K
from slopefield.llm.common import lean, stored, text_of

WINDOW = 10
SEGMENT_BYTES = 4 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
# Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z: digits, letters, all non-ASCII.
_WORD = K.byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)

INDEX_SCHEMA = "segment string, term string, positions binary, ids array<long>, n_words binary"


def words_of(text: str | None) -> list[str]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    _, starts, ends = K.find_runs(data, np.array([0, len(data)]), _WORD)
    raw = _FOLD[data].tobytes()
    return [raw[a:b].decode() for a, b in zip(starts, ends)]


class _Segment:
    """Collects the words of documents and lays them out as postings."""

    def __init__(self, hasher: K.ByteHasher):
        self.hasher = hasher
        self.bytes = 0
        self.ids, self.counts, self.hashes = [], [], []
        self.terms: list[tuple] = []

    def add(self, ids: list, data: np.ndarray, offsets: np.ndarray) -> None:
        documents, starts, ends = K.find_runs(data, offsets, _WORD)
        hashes = self.hasher.ranges(self.hasher.sums(data), starts, ends)
        self.ids += ids
        self.counts.append(K.run_counts(documents, len(ids)))
        self.hashes.append(hashes)
        distinct, where = np.unique(hashes, return_index=True)
        text, text_offsets = K.gathered(data, starts[where], ends[where])
        self.terms.append((distinct, _FOLD[text], text_offsets))
        self.bytes += len(data)

    def rows(self, name: str):
        import pyarrow as pa

        hashes = np.concatenate(self.hashes)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        if not len(hashes):
            first = first[:0]
        distinct = ordered[first]
        # The spelling of each term, from the first slice that holds it.
        known = np.concatenate([t[0] for t in self.terms])
        text = np.concatenate([t[1] for t in self.terms])
        shift = np.cumsum([0] + [len(t[1]) for t in self.terms[:-1]])
        begin = np.concatenate([t[2][:-1] + s for t, s in zip(self.terms, shift)])
        end = np.concatenate([t[2][1:] + s for t, s in zip(self.terms, shift)])
        known, pick = np.unique(known, return_index=True)
        pick = pick[np.searchsorted(known, distinct)]
        spelled, spelled_offsets = K.gathered(text, begin[pick], end[pick])
        ends = np.append(first, len(hashes)) * 4
        count = len(distinct)
        terms = K.binary_column(spelled, spelled_offsets, pa.string())
        postings = K.binary_column(order.astype("<u4").view(np.uint8), ends)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * count, pa.string()),
                terms,
                postings,
                pa.nulls(count, pa.list_(pa.int64())),
                pa.nulls(count, pa.binary()),
            ],
            names=["segment", "term", "positions", "ids", "n_words"],
        )
        counts = np.concatenate(self.counts).astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name], pa.string()),
                pa.array([None], pa.string()),
                pa.array([None], pa.binary()),
                pa.array([self.ids], pa.list_(pa.int64())),
                pa.array([counts], pa.binary()),
            ],
            names=["segment", "term", "positions", "ids", "n_words"],
        )


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """The stored index: one row per segment and term, and one per segment without a term."""

    def indexed(batches):
        from pyspark import TaskContext

        partition, number = TaskContext.get().partitionId(), 0
        hasher = K.ByteHasher(fold_case=True)
        segment = _Segment(hasher)
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for a, b in K.document_slices(offsets, min(K.SLICE_BYTES, segment_bytes)):
                ids = batch.column(0).slice(a, b - a).to_pylist()
                segment.add(ids, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if segment.bytes >= segment_bytes:
                    yield from segment.rows(f"{partition}-{number}")
                    segment, number = _Segment(hasher), number + 1
        if segment.ids:
            yield from segment.rows(f"{partition}-{number}")

    columns = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return stored(columns.mapInArrow(lean(indexed), INDEX_SCHEMA), "postings")


WINDOW_SCHEMA = "terms array<string>, owner string"


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Stored (terms, owners) of the distinct windows of the test items, made by the tasks."""
    import pyarrow as pa

    rows = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.col(text_col).cast("string").alias("text"),
    )

    def cut(batches):
        for batch in batches:
            for owner, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                size = min(window, len(words))
                found = {tuple(words[i : i + size]) for i in range(len(words) - size + 1) if size}
                terms = [list(w) for w in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.list_(pa.string())), pa.array([owner] * len(terms), pa.string())],
                    names=["terms", "owner"],
                )

    cuts = rows.mapInArrow(lean(cut), WINDOW_SCHEMA)
    return stored(cuts.groupBy("terms").agg(F.collect_set("owner").alias("owners")), "windows")


def searched_windows(index: DataFrame, windows: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """(stored windows all of whose terms occur, with their rarest term and block; blocks).

    How often a term occurs is summed over the segments of the index.
    """
    terms = windows.select("terms", F.explode(F.array_distinct("terms")).alias("term"))
    vocabulary = terms.select(F.col("term").alias("wanted")).distinct()
    amounts = (
        index.where("term IS NOT NULL")
        .select("term", (F.octet_length("positions") / 4).cast("long").alias("n"))
        .join(vocabulary, F.col("term") == F.col("wanted"), "left_semi")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
    )
    known = (
        terms.join(amounts, "term")
        .groupBy("terms")
        .agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "term")).alias("least"))
        .where(F.col("found") == F.size(F.array_distinct("terms")))
        .select("terms", F.col("least.term").alias("rarest"))
    )
    met = stored(windows.join(known, "terms"), "searched")
    words = met.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-words // block_words)
    return met.withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(max(1, blocks)))), blocks


def _occurrences(phrase: tuple, lists: dict[str, np.ndarray]) -> np.ndarray:
    """Start positions of a phrase: lists shifted by their place, intersected rarest first."""
    places = sorted(range(len(phrase)), key=lambda k: len(lists[phrase[k]]))
    found = lists[phrase[places[0]]] - places[0]
    for k in places[1:]:
        if not len(found):
            break
        other = lists[phrase[k]]
        at = np.searchsorted(other, found + k)
        inside = at < len(other)
        found = found[inside][other[at[inside]] == found[inside] + k]
    return found


def _near(terms: list[str], lists: dict[str, np.ndarray], span: int) -> np.ndarray:
    """Starts of the shortest stretches of at most ``span`` words that hold every term."""
    terms = sorted(set(terms), key=lambda t: len(lists[t]))
    out = []
    for anchor in lists[terms[0]]:
        around = []
        for t in terms:
            p = lists[t]
            a, b = np.searchsorted(p, [anchor - span + 1, anchor + span])
            if a == b:
                break
            around += [(int(x), t) for x in p[a:b]]
        else:
            around.sort()
            last: dict[str, int] = {}
            for x, t in around:
                last[t] = x
                if len(last) == len(terms) and x - min(last.values()) < span:
                    out.append((min(last.values()), x))
    return np.array(sorted(set(out)), np.int64).reshape(-1, 2)


def _searched(index: DataFrame, block: DataFrame, slop: int | None) -> DataFrame:
    """(segment, doc, start, end, items) of every occurrence of the block's windows."""
    spark = index.sparkSession
    # Bounded: the windows of one block, by the term that starts the search for them.
    by_rarest: dict[str, list] = {}
    for row in block.select("rarest", "terms", "owners").collect():
        by_rarest.setdefault(row.rarest, []).append((tuple(row.terms), sorted(row.owners)))
    shared = spark.sparkContext.broadcast(by_rarest)
    terms = block.select(F.explode("terms").alias("wanted")).distinct()
    lists = index.where("term IS NOT NULL").join(
        F.broadcast(terms), F.col("term") == F.col("wanted"), "left_semi"
    )
    heads = index.where("term IS NULL")
    wanted = lists.unionByName(heads).select("segment", "term", "positions", "n_words")

    def search(rows):
        import pandas as pd

        postings, counts = {}, None
        for term, positions, n_words in zip(rows["term"], rows["positions"], rows["n_words"]):
            if term is None:
                counts = np.frombuffer(n_words, "<u4").astype(np.int64)
            else:
                postings[term] = np.frombuffer(positions, "<u4").astype(np.int64)
        ends = np.cumsum(counts)
        out = []
        # Only windows whose rarest term the segment holds are looked at.
        for phrase, owners in (w for term in postings for w in shared.value.get(term, ())):
            if any(w not in postings for w in phrase):
                continue
            if slop is None:
                starts = _occurrences(phrase, postings)
                stops = starts + len(phrase) - 1
            else:
                starts, stops = _near(list(phrase), postings, len(phrase) + slop).T
            document = np.searchsorted(ends, starts, side="right")
            within = document == np.searchsorted(ends, stops, side="right")
            for d, a, b in zip(document[within], starts[within], stops[within]):
                base = int(ends[d] - counts[d])
                out.append((rows["segment"].iloc[0], int(d), int(a) - base, int(b) + 1 - base, owners))
        return pd.DataFrame(out, columns=["segment", "doc", "start", "stop", "items"])

    return wanted.groupBy("segment").applyInPandas(
        search, "segment string, doc int, start int, stop int, items array<string>"
    )


def matches(
    index: DataFrame,
    items: DataFrame,
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    slop: int | None = None,
    block_words: int = 1_000_000,
) -> DataFrame:
    """Every match as (segment, doc, start, stop, items): word positions within the document.

    Without ``slop`` exact phrases; with it, stretches of at most window + slop words
    that hold all words of a window in any order.
    """
    windows = item_windows(items, item_id_col, item_text_col, window)
    met, blocks = searched_windows(index, windows, block_words)
    found = index.sparkSession.createDataFrame(
        [], "segment string, doc int, start int, stop int, items array<string>"
    )
    for k in range(blocks):
        # Stored one by one: a plan over all blocks would grow with the test items.
        found = found.unionByName(stored(_searched(index, met.where(F.col("block") == k), slop), "matches"))
    return found


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    index = build_index(docs, id_col, text_col)
    hits = matches(index, items, item_id_col, item_text_col, window)
    spans = F.array_sort(F.collect_list(F.struct("start", "stop")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda at, s: F.struct(
            (at["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], at["reach"]))).alias("n"),
            F.greatest(at["reach"], s["stop"]).alias("reach"),
        ),
        lambda at: at["n"],
    )
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    per_document = (
        hits.groupBy("segment", "doc")
        .agg(spans.alias("spans"), names.alias("names"))
        .select(
            "segment", "doc", covered.cast("long").alias("n_hit"),
            F.size("names").cast("long").alias("n_items"),
            F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("items_sha256"),
        )
    )

    def listed(batches):
        import pyarrow as pa

        for batch in batches:
            for name, ids, counts in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * n, pa.string()),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(ids, pa.int64()),
                        pa.array(np.frombuffer(counts, "<u4").astype(np.int64)),
                    ],
                    names=["segment", "doc", "id", "n_words"],
                )

    everyone = (
        index.where("term IS NULL")
        .select("segment", "ids", "n_words")
        .mapInArrow(lean(listed), "segment string, doc int, id long, n_words long")
    )
    none = hashlib.sha256(b"").hexdigest()
    return everyone.join(per_document, ["segment", "doc"], "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
