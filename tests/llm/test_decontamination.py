import hashlib
import random

from odd_tables import EXTRA, words

from slopefield.llm import decontamination as D

ITEMS = "item_id string, text string, segment string, term string"


def brute_force(rows, items, window=10):
    parsed = [("" if i is None else str(i), D.words_of(t)) for i, t in items]
    out = []
    for i, text in rows:
        w = D.words_of(text)
        hit, names = set(), set()
        for name, item in parsed:
            n = min(window, len(item))
            for a in range(len(item) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == item[a : a + n]:
                        hit |= set(range(b, b + n))
                        names.add(name)
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=str)


def items_for(odd_rows):
    by_id = {r[0]: r[1] for r in odd_rows}
    w = by_id[9].split()
    return [
        ("b", " ".join(by_id[1].split()[5:30]).upper()),
        ("a", " ".join(by_id[1].split()[20:31])),
        ("a", "no such words " * 5),
        ("10", " ".join(w[8000:8012])),
        ("9", "repeated row"),
        ("é", "日本 \U0001f600 Ünïcödé"),
        ("x", None),
        ("y", "... !"),
        (None, "text without an id"),
        ("z", "a"),
    ]


def as_rows(df):
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_odd_rows_against_brute_force(spark, odd, odd_rows):
    items = items_for(odd_rows)
    df = spark.createDataFrame([(*x, "s", "t") for x in items], ITEMS)
    want = brute_force([r[:2] for r in odd_rows], items)
    assert as_rows(D.contamination(odd, df)) == want


def test_blocks_and_segments_do_not_matter(spark, odd, odd_rows):
    items = items_for(odd_rows)
    df = spark.createDataFrame([(*x, "s", "t") for x in items], ITEMS)
    key = lambda d: {(r.segment.split("-")[0], r.start, r.stop, x)
                     for r in d.collect() for x in r["items"]}
    small = D.build_index(odd, segment_bytes=1)
    assert small.where("term IS NULL").count() > 3
    whole = D.build_index(odd)
    found = key(D.matches(small, df))
    assert found and found == key(D.matches(whole, df))
    assert found == key(D.matches(whole, df, block_words=1))


def test_empty_tables(spark, nothing, odd, odd_rows):
    none = spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([("a", "x y", "s", "t")], ITEMS)
    assert D.contamination(nothing, one).count() == 0
    rows = D.contamination(odd, none).collect()
    assert len(rows) == len(odd_rows) and not any(r.contaminated for r in rows)


def test_proximity(spark, table_of):
    docs = table_of(
        [(1, "red big fox and then a dog", "en", None, None, *EXTRA),
         (2, "dog " + "x " * 20 + "red fox", "en", None, None, *EXTRA)]
    )
    item = spark.createDataFrame([("i", "fox red dog", "s", "t")], ITEMS)
    index = D.build_index(docs)
    assert D.matches(index, item).count() == 0
    assert [(r.start, r.stop) for r in D.matches(index, item, slop=4).collect()] == [(0, 7)]
    assert D.matches(index, item, slop=3).count() == 0


def test_random_texts_against_brute_force(spark, table_of):
    rng = random.Random(9)
    rows = [(k, words(rng, rng.randint(0, 40), "ab")) for k in range(60)]
    items = [(str(k), words(rng, rng.randint(0, 14), "ab")) for k in range(30)]
    docs = table_of([(i, t, "en", None, None, *EXTRA) for i, t in rows])
    df = spark.createDataFrame([(*x, "s", "t") for x in items], ITEMS)
    for window in (2, 10):
        found = D.contamination(docs, df, window=window)
        assert as_rows(found) == brute_force(rows, items, window)
