import random
import re

import numpy as np
import pytest
from odd_tables import EXTRA, words

from slopefield.llm import jaccard_join as J
from slopefield.llm.components import components


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute_force(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return [(i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)]


def as_rows(df):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_odd_rows_against_brute_force(odd, odd_rows, n, percent):
    found = J.similar_documents(odd, words=n, percent=percent)
    assert as_rows(found) == sorted(brute_force([r[:2] for r in odd_rows], n, percent), key=str)
    kept = [r for r in found.collect() if r.kept]
    groups = {(r.component_id, r.n_shingles > 0) for r in found.collect()}
    assert len({(r.component_id, r.n_shingles > 0) for r in kept}) == len(groups)


def near_copies(rng):
    rows, k = [], 0
    for size in (3, 8, 20, 60, 200, 400):
        for _ in range(4):
            base = words(rng, size).split()
            for _ in range(9):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    copy[rng.randrange(len(copy))] = words(rng, 1)
                rows.append((k, " ".join(copy)))
                k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [60, 85])
def test_near_copies_against_brute_force(table_of, percent, monkeypatch):
    rows = near_copies(random.Random(percent))
    df = table_of([(i, t, "en", None, None, *EXTRA) for i, t in rows])
    monkeypatch.setattr(J, "TILE_ROWS", 4)
    monkeypatch.setattr(J, "LEAF_ROWS", 2)
    found = J.similar_documents(df, words=4, percent=percent)
    assert as_rows(found) == sorted(brute_force(rows, 4, percent), key=str)


def test_empty_table(nothing):
    assert J.similar_documents(nothing).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_near_sets_share_a_region(percent):
    rng = np.random.default_rng(percent)
    for n in [*range(2, 40), 63, 94, 200, 700]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            most = (100 - percent) * len(a) // 100
            gone = int(rng.integers(0, most + 1))
            added = 0
            while 100 * (len(a) - gone) >= percent * (len(a) + added + 1):
                added += 1
            b = np.union1d(a[rng.permutation(len(a))[gone:]],
                           rng.integers(0, 1 << 63, added).astype(np.uint64))
            if len(np.intersect1d(a, b)) == len(a) == len(b):
                continue
            assert len(np.intersect1d(J.slice_keys(a, percent), J.slice_keys(b, percent)))


def test_windows_and_sketches_lose_no_link(monkeypatch):
    monkeypatch.setattr(J, "LEAF_ROWS", 3)
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 120).astype(np.uint64))
    sets = [base]
    for _ in range(60):
        keep = base[rng.random(len(base)) > rng.random() * 0.25]
        sets.append(np.union1d(keep, rng.integers(0, 1 << 63, 6).astype(np.uint64)))

    def similarity(a, b):
        return len(np.intersect1d(a, b)) / len(np.union1d(a, b))

    distance = np.array([1 - similarity(base, s) for s in sets])
    outside = distance > 0.2
    pairs = J.region_candidates(
        distance, outside, np.arange(len(sets)), np.array([len(s) for s in sets]),
        np.stack([J.parity_sketch(s).view(np.uint64) for s in sets]), 80,
    )
    found = {tuple(sorted(p)) for p in pairs.tolist()}
    for a in range(len(sets)):
        for b in range(a):
            if similarity(sets[a], sets[b]) >= 0.8 and (outside[a] or outside[b]):
                assert (b, a) in found


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)]
    edges += [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(1, 50)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


REGION = "key long, node long, distance double, outside boolean, component long, n long, sketch binary"


def region_of(spark, sets, key=7):
    rows = [
        (key, k, 0.9, True, k, len(s), J.parity_sketch(s).tobytes()) for k, s in enumerate(sets)
    ]
    return spark.createDataFrame(rows, REGION).repartition(6)


def similar_sets(rng, clusters, members):
    out = []
    for _ in range(clusters):
        base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        for _ in range(members):
            changed = rng.integers(0, 1 << 63, 4).astype(np.uint64)
            out.append(np.unique(np.concatenate([base[rng.random(300) > 0.02], changed])))
    return out


def linked(sets, percent):
    found = set()
    for a in range(len(sets)):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                found.add((b, a))
    return found


def test_large_regions_are_parted_without_losing_a_link(spark):
    sets = similar_sets(np.random.default_rng(6), 9, 14)
    regions = region_of(spark, sets)
    parts = J._parted(regions, 90, region_rows=40)
    sizes = [r["count"] for r in parts.groupBy("key", "part").count().collect()]
    assert len(sizes) > 3 and max(sizes) <= 40
    for rows in ({"region_rows": 40}, {"region_rows": 40, "tile_rows": 15}, {"region_rows": 10**6}):
        pairs = {tuple(sorted(r)) for r in J._window_pairs(regions, 90, **rows).collect()}
        assert pairs >= linked(sets, 90)


def test_a_region_that_nothing_parts_is_tiled_without_losing_a_link(spark):
    sets = similar_sets(np.random.default_rng(2), 1, 90)
    regions = region_of(spark, sets)
    pairs = J._window_pairs(regions, 80, region_rows=20, tile_rows=20).collect()
    assert {tuple(sorted(r)) for r in pairs} >= linked(sets, 80)


def test_rows_of_a_region_of_20_000_points_are_copied_less_than_20_times(spark):
    rng = np.random.default_rng(5)
    n = 20_000
    near = rng.integers(0, 256, (1, 64)).astype(np.uint8) ^ np.packbits(
        rng.random((n, 512)) < 0.02, axis=1
    )
    rows = [(1, k, 0.9, True, k, 200, near[k].tobytes()) for k in range(n)]
    regions = spark.createDataFrame(rows, REGION).repartition(8)
    copied = J._tiles(regions, 80).count()
    assert n <= copied < 20 * n


def stored_regions(spark, tmp_path, sets, keys, outside=True):
    """Each set in all regions of ``keys``, with its own component, as the join's tables have them."""
    least = sorted(keys)[: J.LEAST_KEYS]
    rows = [
        (key, k, 0.3, outside, k, len(s), J.parity_sketch(s).tobytes(), key, least)
        for key in keys
        for k, s in enumerate(sets)
    ]
    spark.createDataFrame(rows, REGION + ", region long, least array<long>").repartition(
        6
    ).write.parquet(str(tmp_path / "regions"))
    held = [(k, len(s), s.tobytes(), J.parity_sketch(s).tobytes()) for k, s in enumerate(sets)]
    spark.createDataFrame(
        held, "node long, n long, shingles binary, sketch binary"
    ).write.parquet(str(tmp_path / "sets"))
    return spark.read.parquet(str(tmp_path / "regions")), spark.read.parquet(str(tmp_path / "sets"))


def close_to_the_radius(rng, members):
    """Sets whose pairs lie around a distance of 0.2, some within and most outside."""
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    out = []
    for _ in range(members):
        keep = base[rng.random(300) > 0.06 + 0.03 * rng.random()]
        changed = rng.integers(0, 1 << 63, 300 - len(keep)).astype(np.uint64)
        out.append(np.unique(np.concatenate([keep, changed])))
    return out


def groups_of(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    found = {}
    for x in list(up):
        found.setdefault(root(x), set()).add(x)
    return sorted(map(sorted, found.values()))


def test_rows_of_the_windows_grow_with_the_rows_of_a_group_in_many_regions(spark, tmp_path):
    made = []
    for members in (40, 160):
        sets = close_to_the_radius(np.random.default_rng(3), members)
        folder = tmp_path / str(members)
        folder.mkdir()
        regions, _ = stored_regions(spark, folder, sets, range(10, 18))
        forests = J._window_forests(regions, 80)
        made.append(forests.count())
        pairs = J._window_pairs(regions.drop("least"), 80).count()
        assert pairs > 3 * members
        # One region of eight makes rows: its forest, and its rows for the comparison of sets.
        assert made[-1] <= 2 * members
    assert made[1] <= 5 * made[0]


@pytest.mark.parametrize("rows", [{}, {"region_rows": 20, "tile_rows": 20}])
def test_forests_and_sets_find_all_components(spark, tmp_path, monkeypatch, rows):
    sets = close_to_the_radius(np.random.default_rng(9), 70)
    sets += close_to_the_radius(np.random.default_rng(8), 30)
    regions, kept = stored_regions(spark, tmp_path, sets, [5, -3, 11])
    none = spark.createDataFrame([], "a long, b long")
    forests = J._window_forests
    monkeypatch.setattr(J, "_window_forests", lambda r, percent: forests(r, percent, **rows))
    labels = J._more_links(regions, kept, none, components(none), 80)
    found = {}
    for r in labels.collect():
        found.setdefault(r.component, []).append(r.node)
    want = groups_of(linked(sets, 80))
    assert sorted(map(sorted, found.values())) == want and sum(map(len, want)) < len(sets)


def test_sets_compared_in_pieces_give_the_same_components(spark, tmp_path):
    sets = close_to_the_radius(np.random.default_rng(4), 50)
    regions, kept = stored_regions(spark, tmp_path, sets, [5])
    rows = J._tiles(regions, 80)
    for piece_bytes in (1 << 25, 20_000):
        links = [tuple(r) for r in J._links_by_sets(rows, kept, 80, piece_bytes).collect()]
        assert groups_of(links) == groups_of(linked(sets, 80))
        assert {tuple(sorted(p)) for p in links} <= linked(sets, 80)


def test_a_pair_is_taken_in_its_first_region_alone():
    last = np.iinfo(np.int64).max
    least = np.array([[1, 4, 9], [2, 4, 9], [5, last, last]])
    pairs = np.array([[0, 1], [0, 2], [1, 2]])
    assert J.owned(pairs, least, 4).tolist() == [True, True, True]
    assert J.owned(pairs, least, 9).tolist() == [False, True, True]


def test_a_forest_spans_what_the_pairs_span():
    rng = np.random.default_rng(1)
    for n, m in ((2, 1), (30, 20), (60, 400)):
        pairs = rng.integers(0, n, (m, 2))
        component = rng.integers(0, n, n)
        taken = J.spanning(pairs, component)
        named = component[pairs]
        distinct = [p for p in named.tolist() if p[0] != p[1]]
        kept = [p for p in named[taken].tolist()]
        assert [g for g in groups_of(named.tolist()) if len(g) > 1] == groups_of(kept)
        assert len(kept) == sum(len(g) - 1 for g in groups_of(distinct))
