"""Exact deduplication by two passes over a Bloom filter.

Pass 1 reads only 64-bit hashes. Each task notes the filter bits of its hashes; the
bits of all tasks are merged block by block into "set at least twice". Pass 2 looks
every hash up there: a hash with a clear bit occurs once, and its row passes straight
through. Only possibly repeated rows (all repeats, and few others) are shuffled, as
digest and id, never as text. A false positive costs a row's shuffle and nothing else.

Defined cases: a null text counts as empty. Of equal rows the one with the largest id
stays (a null id is smallest); of rows that agree in id too, one stays. Texts of any
length are compared by SHA-256 of their UTF-8 bytes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopefield.llm.common import BATCH_ROWS, joined_with_groups, lean, stored, text_of
from slopefield.session import session_settings

BLOCK_BITS = 1 << 16


def _filter_bits(hashes: np.ndarray, blocks: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits within it) of each hash: high bits choose the block, low ones the bits."""
    block = (hashes >> np.uint64(40)) % np.uint64(blocks)
    shifts = np.arange(probes, dtype=np.uint64) * np.uint64(16)
    bits = (hashes[:, None] >> shifts[None, :]) & np.uint64(BLOCK_BITS - 1)
    return block.astype(np.int64), bits.astype(np.uint16)


def repeated_bits_of(
    rows: DataFrame,
    hashes_of: Callable,
    expected: int,
    bits_per_hash: int,
    max_filter_bits: int,
    probes: int = 2,
) -> Callable[[np.ndarray], np.ndarray]:
    """Pass 1: a function telling which hashes (uint64) may occur more than once.

    ``hashes_of`` turns the Arrow batches of a task into arrays of hashes. The filter
    follows the ``expected`` hashes up to ``max_filter_bits``, which bounds what is sent
    to the tasks; a fuller filter only lets more rows take part in the later shuffle.
    """
    import pyarrow as pa

    size = min(max(expected * bits_per_hash, BLOCK_BITS), max_filter_bits)
    blocks = 1 << (max(1, -(-size // BLOCK_BITS)) - 1).bit_length()

    def noted(batches):
        found = list(hashes_of(batches))
        values, counts = np.unique(
            np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True
        )
        block, bits = _filter_bits(values, blocks, probes)
        order = np.argsort(block, kind="stable")
        block, bits, twice = block[order], bits[order], counts[order] > 1
        names, starts = np.unique(block, return_index=True)
        ends = np.append(starts[1:], len(block))
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array(names, pa.int64()),
                "once": pa.array(
                    [bits[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()
                ),
                "twice": pa.array(
                    [bits[a:b][twice[a:b]].tobytes() for a, b in zip(starts, ends)], pa.binary()
                ),
            }
        )

    def merged(key, rows_of_block):
        import pandas as pd

        seen, again = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
        for once, twice in zip(rows_of_block["once"], rows_of_block["twice"]):
            mine = np.unique(np.frombuffer(once, np.uint16))
            again[mine[seen[mine]]] = True
            again[np.frombuffer(twice, np.uint16)] = True
            seen[mine] = True
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(again).tobytes()]})

    parts = (
        rows.mapInArrow(lean(noted), "block long, once binary, twice binary")
        .groupBy("block")
        .applyInPandas(merged, "block long, bits binary")
    )
    bits = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    with session_settings(rows.sparkSession, **BATCH_ROWS):
        found = parts.collect()
    for row in found:
        bits[row.block] = np.frombuffer(row.bits, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def looked_up(hashes: np.ndarray) -> np.ndarray:
        block, bit = _filter_bits(hashes, blocks, probes)
        found = np.ones(len(block), bool)
        for k in range(probes):
            byte = shared.value[block, bit[:, k] >> 3]
            found &= (byte >> (7 - (bit[:, k] & 7)).astype(np.uint8)) & 1 == 1
        return found

    return looked_up


def possibly_repeated(
    digests: DataFrame, column: str, bits_per_row: int, max_filter_bits: int
) -> Column:
    """True for every row whose hash occurs again, false for nearly all others."""

    def hashes_of(batches):
        return (b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches)

    maybe = repeated_bits_of(
        digests.select(column), hashes_of, digests.count(), bits_per_row, max_filter_bits
    )

    @F.pandas_udf("boolean")
    def looked_up(hashes):
        import pandas as pd

        return pd.Series(maybe(hashes.to_numpy().view(np.uint64)))

    return looked_up(F.col(column))


def mark_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalize: Callable[[Column], Column] | None = None,
    bits_per_row: int = 16,
    max_filter_bits: int = 1 << 28,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``max_filter_bits`` (32 MB by default) bounds the broadcast filter. Give it
    ``bits_per_row`` times the rows if the cluster has the memory.
    """
    text = text_of(text_col) if normalize is None else normalize(text_of(text_col))
    digests = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.sha2(text.cast("binary"), 256).alias("sha"),
            F.xxhash64(text).alias("hash"),
        ),
        "digests",
    )
    flagged = digests.withColumn(
        "maybe", possibly_repeated(digests, "hash", bits_per_row, max_filter_bits)
    )
    flagged = stored(flagged.drop("hash"), "flagged")
    single = flagged.where(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha",
    )
    suspects = flagged.where("maybe").select("id", "row", "sha")
    groups = stored(
        suspects.groupBy("sha")
        .agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("sha", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"),
                "group_size"),
        "groups",
    )
    joined = joined_with_groups(
        suspects, groups, "sha", "group_size", suspects.count(), F.col("row")
    )
    repeated = joined.select(
        "id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha"
    )
    return single.unionByName(repeated).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept",
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 16,
    max_filter_bits: int = 1 << 28,
) -> DataFrame:
    """The rows that stay, with all their columns. Rows seen once are not shuffled."""
    text = text_of(text_col)
    hashes = stored(docs.select(F.xxhash64(text).alias("hash")), "hashes")
    maybe = possibly_repeated(hashes, "hash", bits_per_row, max_filter_bits)
    columns = docs.columns
    marked = docs.withColumn("hash", F.xxhash64(text)).withColumn("_maybe", maybe)
    single = marked.where(~F.col("_maybe")).select(*columns)
    suspects = marked.where("_maybe").withColumn("_sha", F.sha2(text.cast("binary"), 256))
    best = (
        suspects.select("_sha", F.col(id_col).alias("_id"))
        .groupBy("_sha")
        .agg(F.max("_id").alias("_keep_id"))
        .withColumnRenamed("_sha", "_best_sha")
    )
    keepers = suspects.join(
        best,
        (F.col("_sha") == F.col("_best_sha")) & F.col(id_col).eqNullSafe(F.col("_keep_id")),
        "left_semi",
    ).dropDuplicates(["_sha"])
    return single.unionByName(keepers.select(*columns))
