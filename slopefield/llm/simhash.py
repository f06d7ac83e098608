"""SimHash near-duplicates: fingerprints of word shingles, linked through vantage-point trees.

A bit of a fingerprint is 1 if it is set in more than half of the 64-bit hashes of a text's
shingles, repeats included. Documents link when their fingerprints differ in ``reach`` bits or
fewer; equal fingerprints are compared once, as one group. See ``vantage_tree`` for the search.

Defined cases: a null text counts as empty. A text of fewer words than a shingle has its whole
sequence as the only one; a text without words has fingerprint zero and links like any other.
Long texts are hashed a megabyte at a time. Equal rows and null ids are kept; a component is
named by its smallest id that is not null. An empty table gives an empty result. Further
columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopefield.llm.common import joined_with_groups, lean, stored
from slopefield.llm.components import components
from slopefield.llm.vantage_tree import near_prints

SEED = 42
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def words_by_piece(raw: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """Words (of anything but ASCII white space) with A-Z in lower case, a piece at a time."""
    at = 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + size)
        end = gap.start() if gap else len(raw)
        yield raw[at:end].lower().split()
        at = end


def shingle_hashes(raw: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles in order, repeats included, as arrays."""
    from itertools import islice, repeat

    import xxhash

    carried: list[bytes] = []
    whole = True
    for words in words_by_piece(raw):
        words = carried + words
        if len(words) >= width:
            whole = False
            shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(width))))
            count = len(words) - width + 1
            yield np.fromiter(
                map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count
            )
        carried = words[len(words) - width + 1 :] if len(words) >= width else words
    if whole and carried:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], np.uint64)


def fingerprint(raw: bytes, width: int = 3) -> int:
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(raw, width):
        total += len(hashes)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3
) -> DataFrame:
    """Stored (row, id, print) of every document; ``print`` is a signed 64-bit number."""
    import pyarrow as pa

    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )

    def hashed(batches):
        for batch in batches:
            texts = batch.column(2)
            prints = [fingerprint(texts[i].as_py() or b"", width) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array(np.array(prints, np.uint64).view(np.int64))],
                names=["row", "id", "print"],
            )

    return stored(source.mapInArrow(lean(hashed), "row long, id long, print long"), "prints")


def near_pairs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, reach: int = 3
) -> DataFrame:
    """All pairs (a, b, distance) of different fingerprints at most ``reach`` bits apart."""
    prints = fingerprints(docs, id_col, text_col, width).select("print").distinct()
    pairs = near_prints(prints, reach)
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return pairs.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), bits.alias("distance")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, reach: int = 3
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id."""
    prints = fingerprints(docs, id_col, text_col, width)
    groups = stored(
        prints.groupBy("print").agg(
            F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")
        ),
        "groups",
    )
    labels = components(near_prints(groups.select("print"), reach, spanning=True))
    joined = stored(
        groups.join(labels, groups["print"] == labels["node"], "left").select(
            "print", "least", "copies", F.coalesce("component", "print").alias("component")
        ),
        "joined",
    )
    smallest = stored(
        joined.groupBy("component").agg(
            F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")
        ),
        "smallest",
    )
    named = stored(
        joined_with_groups(
            joined.select("print", "copies", "component"), smallest, "component", "members",
            joined.count(), F.col("print"),
        ).select("print", "copies", "component_id"),
        "named",
    )
    rows = joined_with_groups(prints, named, "print", "copies", prints.count(), F.col("row"))
    return rows.select(
        "id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
