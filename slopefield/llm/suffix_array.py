"""A suffix array by the difference cover {1, 2} of 3, with distributed sorts only.

Positions that are not divisible by three are the sample. Their symbol triples are sorted
and named; if names repeat, the string of names is sorted by recursion. The remaining
suffixes are ordered by their first symbol and the rank of the sampled suffix behind it.
The merge counts, for every suffix, the suffixes of the other classes before it: a suffix
of class 0 compares with class 1 by (symbol, rank one on) and with class 2 by (two
symbols, rank two on). Both are plain sorts with running counts, so no task sees more than
its range of a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopefield.llm.common import deleted, stored

BUCKET = 1 << 16


def running_counts(df: DataFrame, keys: list[str], flag: str | None = None) -> DataFrame:
    """The rows with ``before`` (rows before them in the order of ``keys``) and, with a 0/1
    ``flag``, ``before1`` (those of them whose flag is 1). Stored."""
    import pyarrow as pa

    names = df.columns

    def count(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = ones = 0
        for batch in batches:
            n = batch.num_rows
            mark = batch.column(names.index(flag)).to_numpy() if flag else None
            total = ones + (mark.cumsum() - mark) if flag else [0] * n
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([part] * n, pa.int32()),
                    pa.array(range(seen, seen + n), pa.int64()),
                    pa.array(total, pa.int64()),
                ],
                names=[*names, "_part", "_before", "_before1"],
            )
            seen += n
            ones += int(mark.sum()) if flag else 0

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    local = stored(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(count, f"{types}, _part int, _before long, _before1 long"),
        "sorted",
    )
    ones = F.sum(flag) if flag else F.lit(0)
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), ones.alias("m")).collect()
    offsets, n, m = [], 0, 0
    for row in sorted(sizes, key=lambda r: r["_part"]):  # one row per task of the sort
        offsets.append((row["_part"], n, m))
        n, m = n + row["n"], m + (row["m"] or 0)
    shift = df.sparkSession.createDataFrame(offsets, "_part int, _n long, _m long")
    return local.join(F.broadcast(shift), "_part").select(
        *names,
        (F.col("_before") + F.col("_n")).alias("before"),
        *([(F.col("_before1") + F.col("_m")).alias("before1")] if flag else []),
    )


def following(df: DataFrame, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Rows of (i, ...) with values of the rows ``i + k``; 0 behind the end.

    Buckets of positions overlap by two rows, so every window is bounded.
    """
    bucket = F.floor(F.col("i") / BUCKET)
    main = df.withColumn("_bucket", bucket).withColumn("_rim", F.lit(False))
    rim = (
        df.where((F.col("i") % BUCKET < 2) & (F.col("i") >= BUCKET))
        .withColumn("_bucket", bucket - 1)
        .withColumn("_rim", F.lit(True))
    )
    order = Window.partitionBy("_bucket").orderBy("i")
    both = main.unionByName(rim)
    for name, (source, k) in columns.items():
        both = both.withColumn(name, F.coalesce(F.lead(source, k).over(order), F.lit(0)))
    return both.where(~F.col("_rim")).drop("_bucket", "_rim")


def suffix_ranks(text: DataFrame, prefix: int | None = None) -> DataFrame:
    """(i, rank) of the suffixes of a string given as (i, c): i from 0 without gaps, c >= 1.

    Ranks start at 1. With ``prefix`` suffixes need only be in order by that many symbols
    (at least); equal ones then come in any order and may share a rank.
    """
    n = text.count()
    columns = {"c1": ("c", 1), "c2": ("c", 2)}
    wide = stored(following(text.select("i", "c"), columns), "triples")
    sample = wide.where("i % 3 <> 0")
    dummy = n % 3 == 1  # a sampled suffix of length 0 ends the first half of the names
    if dummy:
        end = text.sparkSession.createDataFrame([(n, 0, 0, 0)], "i long, c long, c1 long, c2 long")
        sample = sample.unionByName(end)
    triples = running_counts(sample.select("c", "c1", "c2").distinct(), ["c", "c1", "c2"])
    triples = triples.withColumn("name", F.col("before") + 1).drop("before")
    named = stored(sample.join(triples, ["c", "c1", "c2"]).select("i", "name"), "named")
    count, distinct = named.count(), triples.count()
    deleted(triples)
    if distinct == count:
        ranks = named.select("i", F.col("name").alias("rank"))
    elif prefix is not None and prefix <= 3:
        ranks = running_counts(named, ["name", "i"]).select(
            "i", (F.col("before") + 1).alias("rank")
        )
    else:
        first = (n + 1) // 3 if not dummy else (n + 2) // 3  # positions 1, 4, 7, ...
        halves = F.when(F.col("i") % 3 == 1, F.floor(F.col("i") / 3)).otherwise(
            F.lit(first) + F.floor(F.col("i") / 3)
        )
        inner = suffix_ranks(
            named.select(halves.alias("i"), F.col("name").alias("c")),
            None if prefix is None else -(-prefix // 3),
        )
        back = F.when(F.col("i") < first, F.col("i") * 3 + 1).otherwise(
            (F.col("i") - first) * 3 + 2
        )
        ranks = inner.select(back.alias("i"), "rank")
    ranked = wide.select("i", "c", "c1").join(ranks, "i", "left").withColumn(
        "rank", F.coalesce("rank", F.lit(0))
    )
    ranked = stored(following(ranked, {"r1": ("rank", 1), "r2": ("rank", 2)}), "ranked")
    for used in (wide, named, ranks):
        deleted(used)
    kind = F.col("i") % 3
    by_one = running_counts(
        ranked.where(kind < 2).select("i", "c", "r1", "rank", kind.cast("int").alias("other")),
        ["c", "r1", "i"], "other",
    )
    by_two = running_counts(
        ranked.where(kind != 1).select(
            "i", "c", "c1", "r2", "rank", (kind == 2).cast("int").alias("other")
        ),
        ["c", "c1", "r2", "i"], "other",
    )
    ahead = F.col("rank") - F.lit(1 if dummy else 0)
    zeros = F.col("before") - F.col("before1")
    columns = ["i", "rank", "before", "before1"]
    sampled = (
        by_one.where("other = 1").select(columns).union(by_two.where("other = 1").select(columns))
    )
    twos = by_two.where("other = 0").select("i", F.col("before1").alias("twos"))
    rest = by_one.where("other = 0").join(twos, "i")
    out = stored(
        sampled.select("i", (ahead + zeros).alias("rank")).unionByName(
            rest.select("i", (F.col("before") + F.col("twos") + 1).alias("rank"))
        ),
        "suffixes",
    )
    for used in (ranked, by_one, by_two):
        deleted(used)
    return out
