import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from odd_tables import EXTRA

from slopefield.llm import collocations as C


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_force(rows, least=30, top=2000):
    counts, words = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded(text)):
            w = tuple(x for x in re.split("[ \t]+", piece) if x)
            words[lang] += len(w)
            for k in range(1, 5):
                counts.update((lang, w[i : i + k]) for i in range(len(w) - k + 1))
    frequent = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    inside = {}
    for (lang, w), n in frequent.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = lang, w[i : i + k]
                inside[part] = max(inside.get(part, 0), n)
    out = []
    for (lang, w), a in frequent.items():
        if 100 * inside.get((lang, w), -1) >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = counts[lang, w[:k]], counts[lang, w[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    ranks, result = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append(
                (lang, ranks[lang], phrase.decode(), -a, left, right, words[lang], -score)
            )
    return sorted(result)


def found(df, **kwargs):
    return sorted(tuple(r) for r in C.collocations(df, **kwargs).collect())


def some_texts(rng, n):
    vocabulary = [f"{a}{b}" for a in "Abcdéfg" for b in ("", "x", "yz", "日")]
    phrases = [rng.choices(vocabulary, k=rng.randint(2, 6)) for _ in range(12)]
    rows = []
    for _ in range(n):
        out = []
        for _ in range(rng.randint(1, 12)):
            out += rng.choice(phrases) if rng.random() < 0.6 else rng.choices(vocabulary, k=3)
            out.append(rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!? "]).strip() or "")
        rows.append((" ".join(out), rng.choice(["en", "en", "de", None])))
    return rows


def as_table(table_of, rows):
    return table_of([(i, t, lang, None, None, *EXTRA) for i, (t, lang) in enumerate(rows)])


@pytest.mark.parametrize("block", [1 << 22, 7])
def test_phrases_against_brute_force(table_of, block):
    rows = some_texts(random.Random(block), 300)
    mine = found(as_table(table_of, rows), least=5, top=50, block=block)
    assert mine == brute_force(rows, least=5, top=50)
    assert {r[0] for r in mine} == {"en", "de", "und"} and {len(r[2].split()) for r in mine} >= {2, 3}


def test_ranks_do_not_pass_through_the_driver(spark, table_of, monkeypatch):
    rows = some_texts(random.Random(3), 300)
    table, seen, folders = as_table(table_of, rows), [], []
    collect, shared_folder = type(table).collect, C.shared_folder

    def counting(self):
        out = collect(self)
        seen.append(len(out))
        return out

    def refused(*args):
        raise AssertionError("all ranks in the driver")

    def noted(session, purpose):
        folders.append(shared_folder(session, purpose))
        return folders[-1]

    monkeypatch.setattr(type(table), "collect", counting)
    monkeypatch.setattr(type(table), "toPandas", refused)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    monkeypatch.setattr(C, "shared_folder", noted)
    monkeypatch.setattr(C, "FILE_RANKS", 16)  # several files a block
    for block in (1 << 22, 50):
        result = C.collocations(table, least=5, top=50, block=block)
        # Counts of ranges and names of files.
        assert max(seen) <= 16
        assert sorted(tuple(r) for r in collect(result)) == brute_force(rows, least=5, top=50)
    assert len(folders) > 6 and not any(os.path.exists(f) for f in folders)


def test_odd_rows_and_repeated_rows(odd, odd_rows, table_of):
    rows = [(r[1], r[2]) for r in odd_rows]
    assert found(odd, least=2) == brute_force(rows, least=2)
    again = rows * 3
    assert found(as_table(table_of, again), least=6) == brute_force(again, least=6)


def test_empty_table_and_no_phrases(nothing, odd):
    assert found(nothing) == []
    assert found(odd, least=10**6) == []


def test_dense_and_sparse_tiles_count_alike(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.minimum(rng.zipf(1.3, 200_000), 10**6) - 1
    y = np.minimum(rng.zipf(1.3, 200_000), 10**6) - 1
    expected = Counter(zip(x.tolist(), y.tolist()))
    for dense in (1, 2000, 10**9):
        monkeypatch.setattr(C, "DENSE_PAIRS", dense)
        keys, counts = C.tiled_counts(x, y)
        assert len(keys) == len(expected)
        assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(n) for k, n in zip(keys, counts)} == expected


def test_large_counts_stay_exact(spark):
    big = 3 * 10**17
    words = spark.createDataFrame(
        [([1], big, "en"), ([2], big + 1, "en"), ([1, 2], big - 1, None)],
        "ids array<int>, f long, lang string",
    )
    row = C._scores(words, words.where("size(ids) = 2")).first()
    assert row.score == 2_000_000 * (big - 1) // (2 * big + 1) and row.lang == "en"
