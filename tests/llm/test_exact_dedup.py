import hashlib
import random

import numpy as np

from slopefield.llm import exact_dedup as E


def brute_force(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for i, text in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        out.append((i, keep, len(ids), sha))
    return out


def test_odd_rows_against_brute_force(odd, odd_rows):
    found = E.mark_duplicates(odd).collect()
    mine = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(mine, key=key) == sorted(brute_force([r[:2] for r in odd_rows]), key=key)
    # One row of every distinct text stays, also where ids are equal or null.
    kept = [r.text_sha256 for r in found if r.kept]
    assert len(kept) == len(set(kept)) == len({r[1] or "" for r in odd_rows})


def test_dropping_keeps_columns_and_one_row_of_each_text(odd, odd_rows):
    left = E.drop_duplicates(odd)
    assert left.columns == odd.columns
    rows = left.collect()
    assert len(rows) == len({r[1] or "" for r in odd_rows})
    assert {r.doc_id for r in rows if r.text and r.text.startswith("repeated")} == {16}
    assert sum(not r.text for r in rows) == 1 and max(r.doc_id or 0 for r in rows if not r.text) == 8


def test_empty_table(nothing):
    assert E.mark_duplicates(nothing).count() == 0
    assert E.drop_duplicates(nothing).columns == nothing.columns


def test_a_full_filter_changes_nothing(odd):
    wide = sorted(map(str, E.mark_duplicates(odd).collect()))
    full = sorted(map(str, E.mark_duplicates(odd, max_filter_bits=1).collect()))
    assert wide == full


def test_filter_passes_every_repeat_and_few_others(spark):
    rng = np.random.default_rng(2)
    once = rng.integers(0, 1 << 62, 20_000)
    twice = rng.integers(0, 1 << 62, 500)
    values = np.concatenate([once, twice, twice])
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(int(v),) for v in values], "h long").repartition(7)
    hashes_of = lambda bs: (b.column(0).to_numpy().view(np.uint64) for b in bs)
    maybe = E.repeated_bits_of(df, hashes_of, len(values), 16, 1 << 28)
    assert maybe(twice.view(np.uint64)).all()
    assert maybe(once.view(np.uint64)).mean() < 0.05
