import random

import numpy as np
import pytest
import xxhash

from slopefield.llm import simhash as S
from slopefield.llm import vantage_tree as V


def plain_fingerprint(text, width=3):
    """Bit by bit, in Python numbers."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[ \t\n\x0b\f\r]+", folded) if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    if not shingles and words:
        shingles = [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_force(rows, reach=3):
    prints = [plain_fingerprint(t) for _, t in rows]
    component = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= reach and component[a] != component[b]:
                old, new = component[a], component[b]
                component = [new if c == old else c for c in component]
    least = {}
    for (i, _), c in zip(rows, component):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [(i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, prints, component)]


def found(df):
    return [tuple(r) for r in S.near_duplicates(df).collect()]


def as_sorted(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


def test_odd_rows_against_brute_force(odd, odd_rows):
    assert as_sorted(found(odd)) == as_sorted(brute_force([r[:2] for r in odd_rows]))


def test_near_copies_against_brute_force(table_of):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(300)]
    rows = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(3, 400))
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(text)))
    table = table_of([(i, t, *[None] * 10) for i, t in rows])
    expected = brute_force(rows)
    assert as_sorted(found(table)) == as_sorted(expected)
    assert len({r[2] for r in expected}) < len({r[1] for r in expected})


def test_empty_table(nothing):
    assert found(nothing) == []


@pytest.mark.parametrize("size", [1, 7, 50, 1 << 20])
def test_pieces_of_a_long_text_change_nothing(monkeypatch, size):
    raw = "Ärger  am  \t langen Text ".encode() * 30 + b"end"
    monkeypatch.setattr(S.words_by_piece, "__defaults__", (size,))
    assert S.fingerprint(raw) == plain_fingerprint(raw.decode())


def clouds(rng, n, spread):
    """Random fingerprints, and clouds of close ones around some of them."""
    far = rng.integers(0, 1 << 63, n).astype(np.uint64)
    near = []
    for center in far[: n // 20]:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, spread), replace=False).astype(np.uint64)
            near.append(center ^ np.bitwise_or.reduce(np.uint64(1) << flips))
    return np.unique(np.concatenate([far, np.array(near, np.uint64)]))


def all_pairs(prints, reach=3):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= reach
    return {tuple(p) for p in np.argwhere(near) if p[0] < p[1]}


@pytest.mark.parametrize("small", [8, 100])
def test_leaf_pairs_are_exact(monkeypatch, small):
    monkeypatch.setattr(V, "SMALL", small)
    prints = clouds(np.random.default_rng(small), 900, 6)
    pairs = V.close_pairs(prints, None, False, 3, False)
    assert len(pairs) == len({tuple(p) for p in pairs})
    assert {tuple(sorted(p)) for p in pairs} == all_pairs(prints)
    sides = np.random.default_rng(1).random(len(prints)) < 0.3
    across = V.close_pairs(prints, sides, True, 3, False)
    expected = {p for p in all_pairs(prints) if sides[p[0]] != sides[p[1]]}
    assert {tuple(sorted(p)) for p in across} == expected


def test_a_split_prunes_far_pairs():
    prints = np.random.default_rng(3).integers(0, 1 << 63, 20_000).astype(np.uint64)
    point, radius = V.best_split(prints, None, False, 3)
    parts = V.rings(V.distances(prints, point), radius, None, False, 3)
    left = sum(V.comparisons(side, len(rows)) for _, rows, side in parts)
    assert left < 0.7 * V.comparisons(None, len(prints))


@pytest.mark.parametrize("spanning", [False, True])
def test_regions_on_spark_are_exact(spark, spanning):
    prints = clouds(np.random.default_rng(9), 3000, 6)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long").repartition(5)
    rows = V.near_prints(df, 3, spanning, leaf_rows=400).collect()
    place = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    pairs = [tuple(sorted((place[r.a], place[r.b]))) for r in rows]
    expected = all_pairs(prints)
    if not spanning:
        assert sorted(pairs) == sorted(expected)
        return
    assert set(pairs) <= expected and len(pairs) < len(expected)
    forest = V.Forest(np.arange(len(prints)))
    whole = V.Forest(np.arange(len(prints)))
    for f, edges in ((forest, pairs), (whole, expected)):
        for a, b in edges:
            f.add(a, np.array([b]))
    groups = lambda r: {tuple(np.flatnonzero(r == v)) for v in np.unique(r)}
    assert groups(forest.root) == groups(whole.root)


def test_a_region_too_dense_to_split_is_tiled(spark):
    bits = np.array([(1 << a) | (1 << b) for a in range(40) for b in range(a)], np.uint64)
    df = spark.createDataFrame([(int(p),) for p in bits.view(np.int64)], "print long")
    rows = V.near_prints(df, 3, False, leaf_rows=100).collect()
    place = {int(p): i for i, p in enumerate(bits.view(np.int64))}
    pairs = sorted(tuple(sorted((place[r.a], place[r.b]))) for r in rows)
    assert pairs == sorted(all_pairs(bits))
