"""Exact pairs of 64-bit fingerprints within a Hamming distance, by vantage-point trees.

A vantage point and a radius part a region into what lies inside and what lies outside.
Two fingerprints at most ``reach`` bits apart have distances to the vantage point that differ
by at most ``reach`` (triangle inequality): a pair on different sides has one end in the ring
just inside and the other in the ring just outside. The rings form a third region, in which only
pairs across are sought, and every region is parted again in the same way, a region of
pairs across into four. Everything else is pruned. Each pair is met in exactly one leaf.

The upper levels are split over all executors: a bounded sample proposes vantage points, all
fingerprints are routed to the regions they overlap, and regions that are still too large
are routed again. Leaves go on in the memory of one task. A region that no vantage point parts
(its fingerprints are too close together) is cut into tiles whose pairs are compared in full.
The sample decides how even the regions are and never which pairs are found.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopefield.llm.common import deleted, stored

# Rows of a region that one task may hold: 32,768 fingerprints are 256 KB.
LEAF_ROWS = 1 << 15
# Regions split and fingerprints sampled in one round: what the driver holds at once.
ROUND_REGIONS = 1 << 13
ROUND_SAMPLE = 1 << 18
# Below this many rows all pairs are compared.
SMALL = 512
CANDIDATES = 6
# A split must leave less than this share of the comparisons.
WORTH = 0.85


def distances(prints: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(prints ^ np.uint64(point)).astype(np.int16)


def rings(d: np.ndarray, radius: int, sides: np.ndarray, across: bool, reach: int):
    """(whether pairs across, rows, their sides) of the regions that a split makes."""
    outside = d > radius
    near_in, near_out = ~outside & (d > radius - reach), outside & (d <= radius + reach)
    if not across:
        yield False, np.flatnonzero(~outside), None
        yield False, np.flatnonzero(outside), None
        rows = np.flatnonzero(near_in | near_out)
        yield True, rows, outside[rows]
        return
    for keep in (~outside, outside):
        rows = np.flatnonzero(keep)
        yield True, rows, sides[rows]
    for first, second in ((near_in, near_out), (near_out, near_in)):
        rows = np.flatnonzero(np.where(sides, second, first))
        yield True, rows, sides[rows]


def comparisons(sides: np.ndarray | None, n: int) -> float:
    if sides is None:
        return n * (n - 1) / 2
    b = int(sides.sum())
    return float(b) * (n - b)


def best_split(prints: np.ndarray, sides, across: bool, reach: int) -> tuple[int, int] | None:
    """The vantage point (one of the fingerprints) and radius that leave least to compare."""
    n = len(prints)
    whole = comparisons(sides if across else None, n)
    best, found = WORTH * whole, None
    for at in np.linspace(0, n - 1, CANDIDATES).astype(np.int64):
        d = distances(prints, prints[at])
        radius = int(np.median(d))
        left = sum(
            comparisons(s, len(rows)) for _, rows, s in rings(d, radius, sides, across, reach)
        )
        if left < best:
            best, found = left, (int(prints[at]), radius)
    return found


@dataclass
class Forest:
    """Links that join what is not yet joined, among the rows of one leaf."""

    root: np.ndarray
    links: list = field(default_factory=list)

    def add(self, row: int, others: np.ndarray) -> None:
        roots, first = np.unique(self.root[others], return_index=True)
        new = roots != self.root[row]
        if not new.any():
            return
        self.links += [(row, int(o)) for o in others[first[new]]]
        names = np.arange(len(self.root))
        names[roots[new]] = self.root[row]
        self.root = names[self.root]


def close_pairs(prints: np.ndarray, sides, across: bool, reach: int, spanning: bool) -> np.ndarray:
    """Pairs of row numbers at most ``reach`` bits apart: all of them, or a spanning forest."""
    forest = Forest(np.arange(len(prints))) if spanning else None
    pairs = [np.zeros((0, 2), np.int64)]

    def compare(rows, sides, across):
        mine = rows[~sides] if across else rows
        other = rows[sides] if across else rows
        step = max(1, (1 << 18) // max(1, len(other)))
        for at in range(0, len(mine), step):
            block = mine[at : at + step]
            start = 0 if across else at
            near = np.bitwise_count(prints[block][:, None] ^ prints[other[start:]][None, :]) <= reach
            if not across:
                near &= np.arange(len(block))[:, None] < np.arange(len(other) - at)[None, :]
            if forest is None:
                a, b = np.nonzero(near)
                pairs.append(np.column_stack([block[a], other[start + b]]))
                continue
            for a in np.flatnonzero(near.any(axis=1)):
                forest.add(int(block[a]), other[start + np.flatnonzero(near[a])])

    # A stack instead of calls: the depth follows the data.
    open_regions = [(np.arange(len(prints)), sides, across)]
    while open_regions:
        rows, sides, across = open_regions.pop()
        if comparisons(sides if across else None, len(rows)) == 0:
            continue
        split = best_split(prints[rows], sides, across, reach) if len(rows) > SMALL else None
        if split is None:
            compare(rows, sides, across)
            continue
        d = distances(prints[rows], split[0])
        for kind, at, side in rings(d, split[1], sides, across, reach):
            open_regions.append((rows[at], side, kind))
    return np.array(forest.links, np.int64).reshape(-1, 2) if spanning else np.concatenate(pairs)


@dataclass
class Node:
    """A split with its children, or (without a split) a new region."""

    region: int
    split: tuple[int, int] | None = None
    children: list = field(default_factory=list)


def grown(prints, sides, across: bool, scale: float, reach: int, leaf: int, names) -> Node:
    """A tree over a sample that stands for ``scale`` times as many rows."""
    if len(prints) * scale <= leaf or len(prints) < 64:
        return Node(2 * next(names) + across)
    split = best_split(prints, sides, across, reach)
    if split is None:
        return Node(2 * next(names) + across)
    d = distances(prints, split[0])
    children = [
        grown(prints[rows], side, kind, scale, reach, leaf, names)
        for kind, rows, side in rings(d, split[1], sides, across, reach)
    ]
    return Node(-1, split, children)


def routed(node: Node, prints, sides, across: bool, reach: int):
    """(region, rows, sides) of every region of the tree that the fingerprints overlap."""
    open_nodes = [(node, np.arange(len(prints)), sides, across)]
    while open_nodes:
        node, rows, sides, across = open_nodes.pop()
        if not len(rows):
            continue
        if node.split is None:
            yield node.region, rows, sides
            continue
        d = distances(prints[rows], node.split[0])
        parts = rings(d, node.split[1], sides, across, reach)
        for child, (kind, at, side) in zip(node.children, parts):
            open_nodes.append((child, rows[at], side, kind))


POINT = "region long, side boolean, print long"


def _columns(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    region, side, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
    return region, side.astype(bool), prints.view(np.uint64)


def _batch(region, side, prints):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array(region, pa.int64()), pa.array(side, pa.bool_()), pa.array(prints.view(np.int64))],
        names=["region", "side", "print"],
    )


def _route(points: DataFrame, trees: dict[int, Node], reach: int) -> DataFrame:
    """The rows of the given regions, at the regions of their trees."""
    shared = points.sparkSession.sparkContext.broadcast(trees)

    def moved(batches):
        for batch in batches:
            region, side, prints = _columns(batch)
            order = np.argsort(region, kind="stable")
            names, starts = np.unique(region[order], return_index=True)
            for name, start, end in zip(names, starts, [*starts[1:], len(order)]):
                rows = order[start:end]
                across = bool(name & 1)
                sides = side[rows] if across else None
                for to, at, s in routed(shared.value[int(name)], prints[rows], sides, across, reach):
                    s = np.zeros(len(at), bool) if s is None else s
                    yield _batch(np.full(len(at), to), s, prints[rows[at]])

    found = stored(points.mapInArrow(moved, POINT), "regions")
    shared.unpersist()
    return found


def _oversize(points: DataFrame, leaf: int, most: int) -> list:
    sizes = points.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf)
    return sizes.orderBy(F.desc("n")).limit(most).collect()


def _sample(points: DataFrame, large: list, number: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """About ROUND_SAMPLE fingerprints of the given regions, as many of each."""
    each = max(64, ROUND_SAMPLE // len(large))
    shares = points.sparkSession.createDataFrame(
        [(r.region, max(1, r.n // each)) for r in large], "region long, share long"
    )
    chosen = points.join(F.broadcast(shares), "region").where(
        F.pmod(F.xxhash64("print", F.lit(number)), "share") == 0
    )
    rows = chosen.select("region", "side", "print").toPandas().sort_values(["region", "print"])
    return {
        int(region): (g["print"].to_numpy().view(np.uint64), g["side"].to_numpy().astype(bool))
        for region, g in rows.groupby("region")
    }


def near_prints(
    prints: DataFrame, reach: int = 3, spanning: bool = False, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """(a, b) of the distinct values of a long column ``print`` at most ``reach`` bits apart.

    ``spanning`` returns enough of the pairs to connect what all of them connect.
    """
    import itertools

    names = itertools.count(1)
    points = stored(
        prints.select(
            F.lit(0).cast("long").alias("region"), F.lit(False).alias("side"),
            F.col("print").cast("long").alias("print"),
        ),
        "regions",
    )
    spark = prints.sparkSession
    leaves, dense, tables = [], [], [points]
    for number in itertools.count():
        large = _oversize(points, leaf_rows, ROUND_REGIONS)
        if not large:
            leaves.append(points)
            break
        samples = _sample(points, large, number)
        trees = {}
        for r in large:
            sample, sides = samples.get(r.region, (np.zeros(0, np.uint64), np.zeros(0, bool)))
            across = bool(r.region & 1)
            scale = r.n / max(1, len(sample))
            tree = grown(sample, sides if across else None, across, scale, reach, leaf_rows, names)
            if tree.split is None:
                dense.append((r.region, -(-2 * r.n // leaf_rows)))
            trees[r.region] = tree
        split = [(r,) for r, t in trees.items() if t.split is not None]
        known = spark.createDataFrame(
            split + [(r,) for r, _ in dense], "region long"
        )
        leaves.append(points.join(F.broadcast(known), "region", "left_anti"))
        if dense:
            leaves.append(_tiles(points, dense))
            dense = []
        moving = points.join(
            F.broadcast(spark.createDataFrame(split, "region long")), "region", "left_semi"
        )
        if not split:
            break
        points = _route(moving.select("region", "side", "print"), trees, reach)
        tables.append(points)
    found = _leaf_pairs(leaves, reach, spanning)
    for used in tables:
        deleted(used)
    return found


def _tiles(points: DataFrame, dense: list[tuple[int, int]]) -> DataFrame:
    """Copies of a dense region's rows for each pair of its tiles."""
    tiles = points.sparkSession.createDataFrame(dense, "region long, tiles long")
    mine = F.pmod(F.xxhash64("print"), "tiles")
    rows = points.join(F.broadcast(tiles), "region").select(
        "region", "side", "print", mine.alias("mine"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"),
    )
    across = F.col("region").bitwiseAND(1) == 1
    first = F.when(across, ~F.col("side")).otherwise(F.col("mine") <= F.col("other"))
    return rows.select(
        "region",
        F.when(across, F.col("side")).otherwise(F.col("mine") > F.col("other")).alias("side"),
        "print",
        F.when(first, F.col("mine")).otherwise(F.col("other")).alias("low"),
        F.when(first, F.col("other")).otherwise(F.col("mine")).alias("high"),
    )


def _leaf_pairs(leaves: list[DataFrame], reach: int, spanning: bool) -> DataFrame:
    import pyarrow as pa

    none = F.lit(-1).cast("long")
    rows = None
    for leaf in leaves:
        if "low" not in leaf.columns:
            leaf = leaf.withColumns({"low": none, "high": none})
        leaf = leaf.select("region", "low", "high", "side", "print")
        rows = leaf if rows is None else rows.unionByName(leaf)

    def compared(table):
        region, low, high = (table.column(i)[0].as_py() for i in range(3))
        side = table.column(3).to_numpy().astype(bool)
        prints = table.column(4).to_numpy().view(np.uint64)
        across = bool(region & 1) or low != high
        pairs = close_pairs(prints, side if across else None, across, reach, spanning)
        ends = prints.view(np.int64)[pairs]
        return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})

    return stored(
        rows.groupBy("region", "low", "high").applyInArrow(compared, "a long, b long"), "links"
    )
