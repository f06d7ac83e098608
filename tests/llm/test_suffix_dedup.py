import collections
import hashlib
import random

import numpy as np
import pytest
from odd_tables import EXTRA, words

from slopefield.llm import kernels as K
from slopefield.llm import suffix_array as A
from slopefield.llm import suffix_dedup as S


def brute_force(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = collections.Counter(
        r[p : p + length] for r in raws for p in range(len(r) - length + 1)
    )
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if count[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


def as_rows(df):
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((*(r[n] for n in names), bytes(r.kept)) for r in df.collect())


def test_odd_rows_against_brute_force(odd, odd_rows):
    found = S.remove_repeats(odd)
    assert as_rows(found) == brute_force([r[1] for r in odd_rows], 200)
    assert sorted(str(r.id) for r in found.collect()) == sorted(str(r[0]) for r in odd_rows)


def mosaic(rng):
    """Texts put together from few parts, cut anywhere: repeats of every kind and border."""
    parts = [words(rng, 70) for _ in range(6)] + ["ab" * 180, "é" * 150]
    texts = []
    for _ in range(40):
        text = ""
        for _ in range(rng.randint(1, 5)):
            part = rng.choice(parts)
            a = rng.randint(0, len(part) - 1)
            text += part[a : a + rng.randint(1, 320)] + rng.choice(["", " ", words(rng, 3)])
        texts.append(text)
    return texts


@pytest.mark.parametrize("hot_members", [2048, 3])
def test_mosaics_against_brute_force(table_of, monkeypatch, hot_members):
    monkeypatch.setattr(S, "HOT_MEMBERS", hot_members)
    texts = mosaic(random.Random(hot_members))
    df = table_of([(k, t, "en", None, None, *EXTRA) for k, t in enumerate(texts)])
    assert as_rows(S.remove_repeats(df)) == brute_force(texts, 200)


def test_nothing_repeats_and_empty_table(table_of, nothing):
    df = table_of([(k, words(random.Random(k), 80), "en", None, None, *EXTRA) for k in range(3)])
    assert {r.n_removed for r in S.remove_repeats(df).collect()} == {0}
    assert S.remove_repeats(nothing).count() == 0
    with pytest.raises(ValueError):
        S.remove_repeats(df, length=100)


@pytest.mark.parametrize(("n", "letters"), [(1, 1), (2, 1), (3, 2), (7, 1), (31, 2), (64, 3)])
def test_suffix_array_against_sorting(spark, n, letters):
    rng = random.Random(n)
    s = [rng.randint(1, letters) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(s)), "i long, c long")
    found = {r.i: r["rank"] for r in A.suffix_ranks(df).collect()}
    assert found == {i: k + 1 for k, i in enumerate(sorted(range(n), key=lambda i: s[i:]))}


def test_suffix_array_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(A, "BUCKET", 4)
    rng = random.Random(1)
    s = [rng.randint(1, 3) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(s)), "i long, c long")
    found = {r.i: r["rank"] for r in A.suffix_ranks(df).collect()}
    assert found == {i: k + 1 for k, i in enumerate(sorted(range(50), key=lambda i: s[i:]))}


def test_anchors_of_a_slice_against_brute_force():
    """The first smallest of the hashes within each string, in one go over all documents."""
    rng, width = random.Random(9), 200 - S.STRETCH + 1
    texts = []
    for n in (0, 5, 199, 200, 201, 650, 900, 0, 420):
        period = rng.choice([1, 2, 7, 60, 101, 5000])
        base = "".join(rng.choice("ab") for _ in range(period))
        texts.append((base * (n // period + 1))[:n].encode())
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    hasher = K.ByteHasher()
    found = S.anchors_of(data, offsets, hasher, 200, named=False)
    assert found[5] is None
    want = []
    for d, raw in enumerate(texts):
        at = np.arange(max(0, len(raw) - S.STRETCH + 1))
        values = hasher.ranges(hasher.sums(np.frombuffer(raw, np.uint8)), at, at + S.STRETCH)
        for start in range(len(raw) - 199):
            place = start + int(values[start : start + width].argmin())
            if want and want[-1][:2] == [d, place]:
                want[-1][3] = start
            else:
                want.append([d, place, start, start, int(values[place])])
    assert [list(map(int, row)) for row in zip(*found[:5])] == want
