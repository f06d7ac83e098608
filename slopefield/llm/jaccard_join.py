"""Exact self-join by Jaccard similarity of word shingles, as a join in a metric space.

One minus the Jaccard similarity is a metric, but unrelated texts all have distance 1
from any text chosen as a pivot, so pivots alone cannot part them. The join therefore
descends through regions:

1. Equal sets are folded into one point.
2. *Slices.* Shingles fall by hash into slices; a point's part of a slice is its
   projection, and the distinct projections are the pivots of that slice's Voronoi
   regions. Points within the radius differ in at most D shingles, so among more than D
   filled slices one holds no difference: the pair meets in a region of radius 0. A point
   takes part in its fullest slices only, by the highest filling that still leaves more
   than D of them: of two points the one with the higher limit shares an unchanged slice
   that the other's lower limit admits too. Points with too few filled slices (rare) meet
   by single shingles instead. The number of slices follows the size of the union, in
   overlapping bands. A Bloom filter of repeated regions keeps lone regions, nearly all,
   from being shuffled.
3. *Pivots.* The point that shares most regions is its regions' pivot. Exact distances to
   the pivot connect everything within the radius at once: a region of a million near
   copies costs a million distances.
4. *Windows.* Points outside the radius are joined with each other and with the boundary
   points that the triangle inequality leaves possible, unless all are connected already.
   This goes on recursively inside a region: two far points split it (Hamming distance of
   parity sketches, itself a metric and never above the number of differing shingles),
   points within twice the radius of the border go to both sides, and what remains is
   verified on the full sets. Regions too large for a task are parted so on Spark first, over
   stored tables, by balls around pivots of a bounded sample; what nothing parts is compared tile by tile.
5. *Forests.* Points that share a region share many: a pair belongs to the first region that both
   hold. Of a region's pairs a task first returns a spanning forest, nearest sketches first. What
   its links leave unconnected is compared by the full sets in the tasks, which return links that
   join something only. No step makes more rows than its regions have, however many pairs of a
   group lie close to the radius.

Links carry over to connected components. No pair is lost: each step only drops pairs
that a counting or triangle argument excludes, or whose ends are connected already.

Defined cases: a null or word-free text has an empty set and links with nothing; a text
with fewer words than a shingle has its word sequence as one shingle; equal ids are
treated row by row. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopefield.llm import kernels as K
from slopefield.llm.common import joined_with_groups, lean, numbered, stored, text_of
from slopefield.llm.components import components
from slopefield.llm.exact_dedup import repeated_bits_of

SKETCH_BITS = 512
# Rows of an open region that one task may hold, and of a tile of one that nothing parts.
REGION_ROWS = 8192
TILE_ROWS = 2048
LEAF_ROWS = 64
# First regions of a point that its rows carry, and bytes of sets that a task compares at once.
LEAST_KEYS = 24
PIECE_BYTES = 1 << 25
# Regions parted in one round, and rows of them that the driver looks at for pivots.
ROUND_REGIONS, ROUND_SAMPLE = 2048, 1 << 16
# Balls that part a region at once, rounds, and the share of comparisons that may be left.
BALLS, ROUNDS, PARTED_SHARE = 16, 12, 0.7

# Words [^\x20\x09-\x0D]+ after A-Z became a-z.
_WORD = K.byte_class(lambda b: not (b == 32 or 9 <= b <= 13))


def band_limits(percent: int, largest: int) -> list[int]:
    """Upper ends of the bands of union sizes; in the first no two different sets link."""
    out = [99 // (100 - percent)]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


def slice_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Names of the regions of one set (sorted distinct 64-bit shingles)."""
    n = len(shingles)
    most = 100 * n // percent
    limits = band_limits(percent, most)
    if most <= limits[0]:
        return np.zeros(0, np.uint64)
    weights = K.mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    out, low = [], limits[0]
    for band, limit in enumerate(limits[1:], 1):
        if limit >= n and low < most:
            differing = (100 - percent) * limit // 100
            slices = differing + 2 + differing // 4
            own = (100 - percent) * min(limit, most) // 100
            place = ((shingles >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            sums = np.add.reduceat(weights, first)
            tag = (place[first] + np.uint64(band << 32)) * np.uint64(0x9E3779B97F4A7C15)
            names = K.mixed(sums ^ K.mixed(tag))
            if len(first) > own:
                held = np.diff(np.append(first, n))
                names = names[held >= np.sort(held)[-own - 1]]
            else:
                names = np.concatenate([names, K.mixed(weights + np.uint64(band))])
            out.append(names)
        low = limit
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bit j is the parity of the shingles that fall on it: two sketches differ in at most
    as many bits as their sets in shingles."""
    bits = np.bincount((K.mixed(shingles) % np.uint64(SKETCH_BITS)).astype(np.int64),
                       minlength=SKETCH_BITS)
    return np.packbits((bits & 1).astype(np.uint8))


def _sets(column, hasher: K.ByteHasher, words: int):
    """Sorted distinct shingles of each text of an Arrow column."""
    data, offsets = K.text_buffers(column)
    for a, b in K.document_slices(offsets):
        part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        documents, starts, ends = K.find_runs(part, local, _WORD)
        hashes = hasher.ranges(hasher.sums(part), starts, ends)
        bounds = np.searchsorted(documents, np.arange(b - a + 1))
        for d in range(b - a):
            yield K.distinct_shingles(hashes[bounds[d] : bounds[d + 1]], words)


def _points(docs: DataFrame, words: int, percent: int, max_filter_bits: int) -> DataFrame:
    """Stored: row, id, n, sig, and the names (keys) of its regions that may be shared."""
    source = docs.select("row", "id", "text")

    def region_names(batches):
        hasher = K.ByteHasher(fold_case=True)
        for batch in batches:
            found = [slice_keys(s, percent) for s in _sets(batch.column(0), hasher, words)]
            yield np.concatenate(found) if found else np.zeros(0, np.uint64)

    # About a quarter of a region per shingle, a shingle per six bytes or so.
    amount = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    looked_up = repeated_bits_of(
        source.select("text"), region_names, max(1024, amount // 24), 8, max_filter_bits
    )

    def described(batches):
        import pyarrow as pa

        hasher = K.ByteHasher(fold_case=True)
        for batch in batches:
            n, sig, keys, sizes = [], [], [], [0]
            for s in _sets(batch.column(2), hasher, words):
                n.append(len(s))
                a = int(K.mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                b = int(K.mixed(s ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
                sig.append(f"{len(s)}-{a:016x}{b:016x}")
                names = slice_keys(s, percent)
                names = names[looked_up(names)]
                keys.append(names)
                sizes.append(sizes[-1] + len(names))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(sig, pa.string()),
                    pa.ListArray.from_arrays(
                        pa.array(sizes, pa.int32()), pa.array(flat.view(np.int64))
                    ),
                ],
                names=["row", "id", "n", "sig", "keys"],
            )

    return stored(
        source.mapInArrow(lean(described), "row long, id long, n long, sig string, keys array<long>"),
        "points",
    )


def _full_sets(docs: DataFrame, nodes: DataFrame, words: int, max_filter_bits: int) -> DataFrame:
    """Stored sets and sketches of the given rows (and of few others, by a Bloom filter)."""

    def noted_twice(batches):
        for batch in batches:
            found = K.mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield np.repeat(found, 2)

    wanted = repeated_bits_of(nodes, noted_twice, nodes.count(), 16, max_filter_bits)

    def described(batches):
        import pyarrow as pa

        hasher = K.ByteHasher(fold_case=True)
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(wanted(K.mixed(rows.view(np.uint64)))))
            n, sets, sketches = [], [], []
            for s in _sets(batch.column(1), hasher, words):
                n.append(len(s))
                sets.append(s.tobytes())
                sketches.append(parity_sketch(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()),
                 pa.array(sketches, pa.binary())],
                names=["node", "n", "shingles", "sketch"],
            )

    return stored(
        docs.select("row", "text").mapInArrow(
            lean(described), "node long, n long, shingles binary, sketch binary"
        ),
        "sets",
    )


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, distance, link) of each pair, from the full sets."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))

    def compared(batches):
        import pyarrow as pa

        for batch in batches:
            distance, link = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                apart, near = shared_enough(p, q, percent)
                distance.append(apart)
                link.append(near)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(distance, pa.float64()),
                 pa.array(link, pa.bool_())],
                names=["a", "b", "distance", "link"],
            )

    return (
        pairs.join(two, "b")
        .join(one, "a")
        .select("a", "b", "set_a", "set_b")
        .mapInArrow(lean(compared), "a long, b long, distance double, link boolean")
    )


def region_candidates(
    distance: np.ndarray,
    outside: np.ndarray,
    component: np.ndarray,
    size: np.ndarray,
    sketch: np.ndarray,
    percent: int,
    tile: tuple[np.ndarray, np.ndarray] | None = None,
) -> np.ndarray:
    """Index pairs of a region that windows and sketches leave possible."""
    radius = (100 - percent) / 100 + 1e-9
    found: list[np.ndarray] = []

    def far(members, pivot):
        return np.bitwise_count(sketch[members] ^ sketch[pivot]).sum(axis=1, dtype=np.int64)

    def direct(members):
        for step in range(0, len(members), LEAF_ROWS * 2):
            i = members[step : step + LEAF_ROWS * 2]
            x, y = i[:, None], members[None, :]
            both = size[x] + size[y]
            ok = (component[x] != component[y]) & (outside[x] | outside[y]) & (x < y)
            ok &= np.abs(distance[x] - distance[y]) <= radius
            ok &= percent * np.maximum(size[x], size[y]) <= 100 * np.minimum(size[x], size[y])
            p, q = np.nonzero(ok)
            p, q, most = i[p], members[q], (100 - percent) * both[p, q] // (100 + percent)
            near = np.bitwise_count(sketch[p] ^ sketch[q]).sum(axis=1, dtype=np.int64) <= most
            found.append(np.stack([p[near], q[near]], axis=1))

    def joined(members):
        if len(members) <= LEAF_ROWS:
            return direct(members)
        if (component[members] == component[members[0]]).all() or not outside[members].any():
            return None
        first = members[int(np.argmax(far(members, members[0])))]
        to_first = far(members, first)
        to_second = far(members, members[int(np.argmax(to_first))])
        most = (100 - percent) * 2 * int(size[members].max()) // (100 + percent)
        lean = to_first - to_second
        near, other = members[lean <= 2 * most], members[lean >= -2 * most]
        if len(near) + len(other) > 1.5 * len(members):  # the border holds most: no split
            return direct(members)
        joined(near)
        joined(other)
        return None

    joined(np.arange(len(distance)))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if tile is not None and len(pairs):
        a, b = tile
        pairs = pairs[(a[pairs[:, 0]] & b[pairs[:, 1]]) | (b[pairs[:, 0]] & a[pairs[:, 1]])]
    return np.unique(pairs, axis=0)


def _hamming(sketches: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketches ^ pivot).sum(axis=1, dtype=np.int64)


def balls_of(sketches: np.ndarray, reach: int) -> list[tuple[np.ndarray, int]]:
    """Pivots and radii that part a sample: few points lie in the ring just outside a ball.

    One after the other, each ball takes what lies in it away from the rest. Empty if what
    would be left with the rings comes to more than PARTED_SHARE of comparing all.
    """
    n = len(sketches)
    found, work = [], 0.0
    rest = np.arange(n)
    for _ in range(2 * BALLS):
        if len(rest) < 2 or len(found) == BALLS:
            break
        pivot = sketches[rest[0]]
        d = np.sort(_hamming(sketches[rest], pivot))
        inside = np.arange(1, len(d) + 1)
        near = np.searchsorted(d, d + reach, side="right")
        cost = near.astype(float) ** 2 + (len(d) - inside).astype(float) ** 2
        cost[(near - inside) * 4 > inside] = np.inf  # the ring holds too many
        best = int(np.argmin(cost))
        if not cost[best] < len(d) ** 2:
            rest = np.roll(rest, -1)
            continue
        found.append((pivot, int(d[best])))
        work += float(near[best]) ** 2
        rest = rest[_hamming(sketches[rest], pivot) > d[best]]
    return found if found and work + float(len(rest)) ** 2 <= PARTED_SHARE * n**2 else []


def _sketches(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


def _parted(regions: DataFrame, percent: int, region_rows: int) -> DataFrame:
    """The open regions with those too large for a task parted by balls around pivots, and again
    until none is that large or nothing parts it.

    A ball's window is wider than the ball by the reach, and the rest is what lies in no ball:
    a pair within reach of which one point lies in a ball is in its window with both, any
    other pair is in the rest. A part whose points are all connected, or all inside, holds no
    further link and is dropped. Pivots and radii come from a bounded sample: they decide how
    even the parts are and never which pairs meet.
    """
    import pyarrow as pa

    spark = regions.sparkSession
    done, number = [], 0
    wide = regions.withColumn("part", F.lit(0).cast("long"))
    while True:
        large = (
            wide.groupBy("key", "part")
            .agg(
                F.count(F.lit(1)).alias("rows"), F.max("n").alias("largest"),
                F.min("component").alias("p"), F.max("component").alias("q"),
                F.bool_or("outside").alias("open"),
            )
            .where(F.col("rows") > region_rows)
            .orderBy(F.desc("rows"))
            .limit(ROUND_REGIONS)
            .collect()
        )
        if not large:
            done.append(wide)
            break
        each = max(32, ROUND_SAMPLE // len(large))
        shares = spark.createDataFrame(
            [(r.key, r.part, max(1, r.rows // each)) for r in large],
            "_key long, _part long, share long",
        )
        same = (F.col("key") == F.col("_key")) & (F.col("part") == F.col("_part"))
        mine = wide.join(F.broadcast(shares), same).drop("_key", "_part")
        drawn: dict[tuple, list] = {}
        for r in mine.where(F.pmod(F.xxhash64("node", F.lit(number)), "share") == 0).select(
            "key", "part", "sketch"
        ).collect():
            drawn.setdefault((r.key, r.part), []).append(bytes(r.sketch))
        splits = {}
        for r in large:
            reach = (100 - percent) * 2 * r.largest // (100 + percent)
            sample = drawn.get((r.key, r.part), [])
            balls = balls_of(_sketches(sample), reach) if number < ROUNDS and sample else []
            if r.p != r.q and r.open and balls:
                splits[r.key, r.part] = balls, reach
        closed = {(r.key, r.part) for r in large if r.p == r.q or not r.open}
        rest = [k for k in ((r.key, r.part) for r in large) if k not in splits and k not in closed]
        listed = spark.createDataFrame([(r.key, r.part) for r in large], "_key long, _part long")
        done.append(wide.join(F.broadcast(listed), same, "left_anti"))
        if rest:
            tiled = spark.createDataFrame(rest, "_key long, _part long")
            done.append(wide.join(F.broadcast(tiled), same, "left_semi"))
        if not splits:
            break
        shared = spark.sparkContext.broadcast(splits)
        chosen = spark.createDataFrame(list(splits), "_key long, _part long")
        names = wide.columns

        def moved(batches, shared=shared, names=names):
            for batch in batches:
                key, part = (
                    batch.column(names.index(c)).to_numpy(zero_copy_only=False)
                    for c in ("key", "part")
                )
                sketch = _sketches(batch.column(names.index("sketch")).to_pylist())
                for region in set(zip(key.tolist(), part.tolist())):
                    at = np.flatnonzero((key == region[0]) & (part == region[1]))
                    balls, reach = shared.value[region]
                    outer = np.ones(len(at), bool)
                    windows = []
                    for pivot, radius in balls:
                        d = _hamming(sketch[at], pivot)
                        windows.append(at[d <= radius + reach])
                        outer &= d > radius
                    for child, taken in enumerate([at[outer], *windows], 1):
                        rows = batch.take(pa.array(taken))
                        name = (region[1] + child * 0x9E3779B1) % (1 << 64)
                        part_of = K.mixed(np.array([name], np.uint64))
                        to = np.repeat(part_of.view(np.int64), rows.num_rows)
                        yield rows.set_column(names.index("part"), "part", pa.array(to))

        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wide.schema)
        wide = stored(
            wide.join(F.broadcast(chosen), same, "left_semi").mapInArrow(lean(moved), types),
            "parted",
        )
        shared.unpersist()
        number += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _tiles(
    regions: DataFrame, percent: int, region_rows: int = REGION_ROWS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """The rows of all open regions as tasks compare them: parted, or copied for pairs of tiles."""
    parted = stored(_parted(regions, percent, region_rows), "regions")
    parted = parted.withColumn("key", F.when(F.col("part") == 0, F.col("key")).otherwise(
        F.xxhash64("key", "part")))
    sizes = parted.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    # At most a tile in ``region_rows`` rows: few enough to broadcast.
    large = sizes.where(F.col("rows") > region_rows).select(
        F.col("key").alias("_key"), F.ceil(F.col("rows") / tile_rows).cast("int").alias("tiles")
    )
    rows = parted.join(F.broadcast(large), F.col("key") == F.col("_key"), "left")
    rows = _for_pairs(rows, F.coalesce("tiles", F.lit(1)), "mine", "low", "high", 0)
    passed = [c for c in regions.columns if c not in ("key", "part")]
    return rows.select("key", "low", "high", "mine", *passed)


def _for_pairs(rows: DataFrame, parts, mine: str, low: str, high: str, seed: int) -> DataFrame:
    """The rows of groups of ``parts`` parts, copied for every pair of parts (low, high)."""
    return (
        rows.withColumn("_parts", parts.cast("int"))
        .withColumn(mine, F.pmod(F.xxhash64("node", F.lit(seed)), F.col("_parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn(low, F.least(mine, "_other"))
        .withColumn(high, F.greatest(mine, "_other"))
        .drop("_parts", "_other")
    )


def _whole_tiles(batches, width: int):
    """(batch, bounds of the tiles in it): rows sorted by their first ``width`` columns, a tile whole."""
    import pyarrow as pa

    held = None
    for batch in K.with_end(batches):
        if batch is not None:
            held = batch if held is None else pa.concat_batches([held, batch])
        if held is None or not held.num_rows:
            continue
        names = [held.column(k).to_numpy(zero_copy_only=False) for k in range(width)]
        change = np.logical_or.reduce([c[1:] != c[:-1] for c in names])
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [held.num_rows]])
        last = len(cuts) - 1 if batch is None else len(cuts) - 2  # the last tile may go on
        if last:
            yield held, cuts[: last + 1]
        held = held.slice(cuts[last])


def owned(pairs: np.ndarray, least: np.ndarray, region: int) -> np.ndarray:
    """Whether no earlier region, of those that the rows carry, holds both points of a pair."""
    out = np.ones(len(pairs), bool)
    for step in range(0, len(pairs), 4096):
        x, y = (least[pairs[step : step + 4096, k]] for k in (0, 1))
        same = (x[:, :, None] == y[:, None, :]) & (x < region)[:, :, None]
        out[step : step + 4096] = ~same.any(axis=(1, 2))
    return out


def spanning(pairs: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Which of the pairs, best first, make a forest that spans the components they touch."""
    _, at = np.unique(component, return_inverse=True)
    x, y = at[pairs[:, 0]], at[pairs[:, 1]]
    root, taken, left = np.arange(len(component)), np.zeros(len(pairs), bool), np.arange(len(pairs))
    while True:
        left = left[root[x[left]] != root[y[left]]]
        if not len(left):
            return taken
        best = np.full(len(root), len(pairs))
        for end in (x, y):
            np.minimum.at(best, root[end[left]], left)
        picked = np.unique(best[best < len(pairs)])
        taken[picked] = True
        a, b, up = root[x[picked]], root[y[picked]], np.arange(len(root))
        while (up[a] != up[b]).any():
            low = np.minimum(up[a], up[b])
            for end in (a, b):
                np.minimum.at(up, up[end], low)
                np.minimum.at(up, end, low)
            up = up[up]
        root = up[root]


class _Tiles:
    """The tiles of a batch as arrays, and the pairs of one that windows and sketches leave."""

    def __init__(self, held, percent: int):
        self.percent = percent
        names = [c for c in held.schema.names if c not in ("sketch", "least", "shingles")]
        self.column = {c: held.column(c).to_numpy(zero_copy_only=False) for c in names}
        self.sketch = _sketches(held.column("sketch").to_pylist())
        self.least = None
        if "least" in held.schema.names:
            lists = held.column("least")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            self.least = np.full((len(sizes), LEAST_KEYS), np.iinfo(np.int64).max)
            at = np.arange(LEAST_KEYS) < sizes[:, None]
            self.least[at] = lists.flatten().to_numpy(zero_copy_only=False)

    def pairs(self, a: int, b: int, *parts: tuple[str, str, str]) -> np.ndarray:
        """Index pairs within rows a to b, nearest sketches first, each in its first region only."""
        c = {name: values[a:b] for name, values in self.column.items()}
        sketch = self.sketch[a:b]
        pairs = region_candidates(
            c["distance"], c["outside"], c["component"], c["n"], sketch, self.percent,
            (c["mine"] == c["low"], c["mine"] == c["high"]),
        )
        for mine, low, high in parts:
            is_low, is_high = c[mine] == c[low], c[mine] == c[high]
            x, y = pairs[:, 0], pairs[:, 1]
            pairs = pairs[(is_low[x] & is_high[y]) | (is_high[x] & is_low[y])]
        if self.least is not None:
            pairs = pairs[owned(pairs, self.least[a:b], c["region"][0])]
        apart = [
            np.bitwise_count(sketch[p[:, 0]] ^ sketch[p[:, 1]]).sum(axis=1, dtype=np.int64)
            for p in np.array_split(pairs, len(pairs) // 65536 + 1)
        ]
        share = np.concatenate(apart) / c["n"][pairs].sum(axis=1)
        return pairs[np.argsort(share, kind="stable")]


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartition(*by).sortWithinPartitions(*by, "node")


def _window_pairs(regions: DataFrame, percent: int, **rows: int) -> DataFrame:
    """Distinct candidate pairs of all open regions."""

    def windows(batches):
        import pyarrow as pa

        for held, cuts in _whole_tiles(batches, 3):
            tiles = _Tiles(held, percent)
            node = tiles.column["node"]
            found = [node[a:b][tiles.pairs(a, b)] for a, b in zip(cuts[:-1], cuts[1:])]
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]
            )

    tiled = _dealt(_tiles(regions, percent, **rows), "key", "low", "high")
    return tiled.mapInArrow(lean(windows), "a long, b long").distinct()


def _window_forests(regions: DataFrame, percent: int, **rows: int) -> DataFrame:
    """Stored: a spanning forest of each tile's candidate pairs (node, partner), and the tile's rows
    that have candidate pairs besides (partner is null)."""
    tiled = _tiles(regions, percent, **rows)

    def forests(batches):
        import pyarrow as pa

        for held, cuts in _whole_tiles(batches, 3):
            tiles = _Tiles(held, percent)
            edges, more = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                pairs = tiles.pairs(a, b)
                taken = spanning(pairs, tiles.column["component"][a:b])
                edges.append(tiles.column["node"][a:b][pairs[taken]])
                more.append(a + np.unique(pairs[~taken]))
            names = [*held.schema.names, "partner"]
            rest = held.take(pa.array(np.concatenate(more)))
            alone = pa.nulls(rest.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*rest.columns, alone], names=names)
            found = np.unique(np.concatenate(edges), axis=0)
            columns = [pa.nulls(len(found), f.type) for f in held.schema]
            columns[names.index("node")] = pa.array(found[:, 0])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found[:, 1])], names=names)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiled.schema)
    dealt = _dealt(tiled, "key", "low", "high")
    return stored(dealt.mapInArrow(lean(forests), f"{types}, partner long"), "forests")


def shared_enough(p: np.ndarray, q: np.ndarray, percent: int) -> tuple[float, bool]:
    """Jaccard distance of two sets, and whether they link."""
    at = np.searchsorted(p, q)
    at[at == len(p)] = 0
    shared = int(np.count_nonzero(p[at] == q))
    union = len(p) + len(q) - shared
    return 1.0 - shared / union, 100 * shared >= percent * union


def _links_by_sets(
    rows: DataFrame, sets: DataFrame, percent: int, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """Links between the components of each tile's rows, from the full sets: a spanning forest of
    them. A tile whose sets are large is compared piece by piece."""
    tile = ["key", "low", "high"]
    sizes = rows.groupBy(*tile).agg(
        F.min("component").alias("_p"), F.max("component").alias("_q"),
        F.ceil(8 * F.sum("n") / piece_bytes).alias("pieces"),
    )
    rows = rows.join(sizes.where("_p <> _q").drop("_p", "_q"), tile)
    rows = _for_pairs(rows, F.col("pieces"), "piece", "first", "second", 1).drop("pieces")
    by = [*tile, "first", "second"]
    rows = rows.join(sets.select("node", "shingles"), "node")
    rows = rows.select(*by, *[c for c in rows.columns if c not in by])

    def linked(batches):
        import pyarrow as pa

        for held, cuts in _whole_tiles(batches, len(by)):
            tiles, sets_of = _Tiles(held, percent), held.column("shingles")
            found = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                node = tiles.column["node"][a:b].tolist()
                up = {c: c for c in tiles.column["component"][a:b].tolist()}
                component = tiles.column["component"][a:b].tolist()

                def root(x, up=up):
                    while up[x] != x:
                        up[x] = x = up[up[x]]
                    return x

                for x, y in tiles.pairs(a, b, ("piece", "first", "second")).tolist():
                    p, q = root(component[x]), root(component[y])
                    if p == q:
                        continue
                    one, two = (
                        np.frombuffer(sets_of[int(a) + k].as_buffer(), np.uint64) for k in (x, y)
                    )
                    if shared_enough(one, two, percent)[1]:
                        up[p] = q
                        found.append((node[x], node[y]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
            )

    return _dealt(rows, *by).mapInArrow(lean(linked), "a long, b long")


def _more_links(
    regions: DataFrame, sets: DataFrame, links: DataFrame, labels: DataFrame, percent: int
) -> DataFrame:
    """The components of ``links`` (``labels``) with the further links of the open regions."""
    forests = _window_forests(regions, percent)
    pairs = forests.where("partner IS NOT NULL").select(
        F.col("node").alias("a"), F.col("partner").alias("b")
    )
    found = _measured(stored(pairs.distinct(), "pairs"), sets, percent)
    found = stored(found.where("link").select("a", "b"), "links")
    rest = forests.where("partner IS NULL").drop("partner")
    if not found.isEmpty():
        links = links.union(found)
        labels = components(links)
        rest = rest.drop("component").join(labels, "node", "left")
        rest = rest.withColumn("component", F.coalesce("component", "node"))
    if not rest.isEmpty():
        found = stored(_links_by_sets(rest, sets, percent), "links")
        if not found.isEmpty():
            labels = components(links.union(found))
    return labels


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    max_filter_bits: int = 1 << 28,
    row_col: str | None = None,
) -> DataFrame:
    """Per document row: row, id, n_shingles, component_id, kept.

    Documents link when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest id reachable by links, and ``kept`` marks the row of that
    id. ``row`` is the column ``row_col`` of ``docs`` (distinct, stored), or else a number
    that is stored with the texts before the first scan.
    """
    texts = F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")
    if row_col is None:
        source = numbered(docs.select(*texts))
    else:
        source = docs.select(F.col(row_col).alias("row"), *texts)
    points = _points(source, words, percent, max_filter_bits)
    filled = points.where("n > 0")
    folded = stored(
        filled.groupBy("sig").agg(
            F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"),
            F.min("id").alias("least_id"),
        ),
        "folded",
    )
    nodes = folded.select(F.col("node").alias("row"))
    met = (
        points.where(F.size("keys") > 0)
        .select("row", "keys")
        .join(nodes, "row", "left_semi")
        .select(F.col("row").alias("node"), F.explode("keys").alias("key"))
    )
    shared = met.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    regions = stored(met.join(shared, "key"), "regions")
    degree = regions.groupBy("node").agg(F.sum("c").alias("degree"))
    pivots = (
        regions.join(degree, "node")
        .groupBy("key")
        .agg(F.max(F.struct("degree", F.negate("node").alias("back"))).alias("best"))
        .select("key", F.negate("best.back").alias("pivot"))
    )
    placed = stored(regions.join(pivots, "key").select("key", "node", "pivot"), "placed")
    stars = placed.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    stars = stored(stars.distinct(), "stars")
    ends = stars.select("a").union(stars.select("b")).distinct()
    sets = _full_sets(source, ends, words, max_filter_bits)
    measured = stored(_measured(stars, sets, percent), "measured")
    links = measured.where("link").select("a", "b")
    labels = components(links)

    judged = placed.join(
        measured.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "distance", "link"),
        ["pivot", "node"],
    )
    nearest_outside = (
        judged.where("NOT link").groupBy("key").agg(F.min("distance").alias("edge"))
    )
    radius = (100 - percent) / 100 + 1e-9
    open_rows = (
        judged.join(nearest_outside, "key")
        .where(~F.col("link") | (F.col("distance") >= F.col("edge") - F.lit(radius)))
        .select("key", "node", "distance", (~F.col("link")).alias("outside"))
        .join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    parted = (
        open_rows.groupBy("key")
        .agg(F.min("component").alias("_p"), F.max("component").alias("_q"))
        .where("_p <> _q")
        .select("key")
    )
    open_rows = stored(open_rows.join(parted, "key", "left_semi"), "open-rows")
    least = open_rows.groupBy("node").agg(
        F.slice(F.array_sort(F.collect_list("key")), 1, LEAST_KEYS).alias("least")
    )
    open_regions = stored(
        open_rows.withColumn("region", F.col("key"))
        .join(least, "node")
        .join(sets.select("node", "n", "sketch"), "node"),
        "open",
    )
    labels = _more_links(open_regions, sets, links, labels, percent)

    grouped = folded.join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    grouped = stored(grouped, "grouped")
    smallest = stored(
        grouped.groupBy("component").agg(
            F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members")
        ),
        "smallest",
    )
    named = stored(
        joined_with_groups(
            grouped, smallest, "component", "members", grouped.count(), F.col("node")
        ).select("sig", "copies", "component", "component_id"),
        "named",
    )
    rows = joined_with_groups(
        filled.select("row", "id", "n", "sig"), named, "sig", "copies", filled.count(), F.col("row")
    )
    owner = rows.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(
        F.min("row").alias("row")
    )
    result = rows.join(
        owner.select("row", F.lit(True).alias("kept")), "row", "left"
    ).select("row", "id", F.col("n").alias("n_shingles"), "component_id",
             F.coalesce("kept", F.lit(False)).alias("kept"))
    empty = points.where("n = 0").select(
        "row", "id", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"),
        F.lit(True).alias("kept"),
    )
    return result.unionByName(empty)
