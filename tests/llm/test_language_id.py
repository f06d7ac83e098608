import zlib

import numpy as np
import public_tokenizers
import pytest

from slopefield.llm import kernels as K
from slopefield.llm import language_id as I
from slopefield.llm import lattice as L

FILE = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    pieces = [(b"a", 0), (b"b", 1), (b"ab", 2), (b"ba", 3), (b"aba", 4)]
    weights = np.random.default_rng(1).random((5, 2))
    table = L.PieceTable(pieces)
    words = [b"ab", b"ababa", b"b", b"aabba"]
    data = np.frombuffer(b"".join(words), np.uint8)
    edges = table.edges(data, np.cumsum([0] + [len(w) for w in words]))

    def total(word):
        if not word:
            return np.ones(2)
        return sum(
            (weights[k] * total(word[len(p) :]) for p, k in pieces if word.startswith(p)),
            np.zeros(2),
        )

    want = np.array([total(w) for w in words])
    assert np.allclose(L.forward(edges, weights)[edges.last], want)
    assert np.allclose(L.backward(edges, weights)[edges.first], want)


def segmentations(word, pieces):
    if not word:
        yield []
    for p, k in pieces:
        if word.startswith(p):
            yield from ([k, *rest] for rest in segmentations(word[len(p) :], pieces))


def test_long_words_are_summed_whole():
    pieces = [(b"a", 0), (b"b", 1), (b"ab", 2), (b"ba", 3), (b"aba", 4)]
    weights = np.random.default_rng(3).random((5, 2)) / 50
    table = L.PieceTable(pieces)
    rng = np.random.default_rng(4)
    words = [bytes(rng.choice([97, 98], n).tolist()) for n in (1, 5, 63, 64, 65, 700, 2000)]
    data = np.frombuffer(b"".join(words), np.uint8)
    edges = table.edges(data, np.cumsum([0] + [len(w) for w in words]))
    found = L.log_masses(edges, weights, table.longest)
    for w, mine in zip(words, found):
        rest = [None] * len(w) + [np.zeros(2)]
        for i in reversed(range(len(w))):
            rest[i] = np.logaddexp.reduce(
                [np.log(weights[k]) + rest[i + len(p)] for p, k in pieces if w.startswith(p, i)]
            )
        assert np.allclose(mine, rest[0], rtol=1e-10)


def test_expected_counts_and_prediction_against_all_segmentations(spark):
    """One step of expectation maximisation, and the scores, by enumeration."""
    names = ["x", "y"]
    start = I.WORD_START.encode()
    pieces = [(start, 0), (b"a", 1), (b"b", 2), (b"ab", 3), (start + b"a", 4), (b"ba", 5)]
    weights = np.random.default_rng(7).random((6, 2))
    rows = [("x", "ab aba"), ("y", "bab b"), ("x", "a, bb"), ("y", "abab")]
    train = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    want = np.zeros((6, 2))
    for lang, text in rows:
        column = names.index(lang)
        for word in text.replace(",", "").split():
            ways = list(segmentations(start + word.encode(), pieces))
            odds = np.array([np.prod(weights[w, column]) for w in ways])
            for way, share in zip(ways, odds / odds.sum()):
                np.add.at(want[:, column], way, share)
    assert np.allclose(I._expected_counts(train, pieces, names, weights), want)

    found = I.predict(train, (pieces, names, weights), ["lang"]).collect()
    for r, (_, text) in zip(found, rows):
        logs = np.zeros(2)
        for word in text.replace(",", "").split():
            ways = list(segmentations(start + word.encode(), pieces))
            logs += np.log(np.sum([np.prod(weights[w], axis=0) for w in ways], axis=0))
        share = np.exp(logs - np.logaddexp(*logs))
        assert r.lang_pred == names[int(share.argmax())] and np.isclose(r.score, share.max())


def test_other_file_splits_train_on_the_same_rows(spark, tmp_path):
    """An executor less or more between two scans cuts the files otherwise."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = str(tmp_path / "docs")
    docs.repartition(6).write.parquet(path)
    table = spark.read.parquet(path).selectExpr("doc_id AS id", "lang", "lower(text) AS text")
    held_out = "crc32(CAST(id AS STRING)) % 4 = 2"
    free = I.training_rows(table.where(f"NOT ({held_out})"), 300)
    before = sorted(tuple(r) for r in free.collect())
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "30000")
    try:
        after = sorted(tuple(r) for r in free.select("*").collect())
    finally:
        spark.conf.set(key, old)
    assert before == after and 250 < len(before) <= 300
    held = {r.text for r in table.where(held_out).collect()}
    own = {r.text for r in table.where(f"NOT ({held_out})").collect()}
    assert not {t for _, t in before} & (held - own)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = I.identify(docs, FILE).join(docs.select("doc_id", "lang"), I.F.col("id") == docs.doc_id)
    rows = found.collect()
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(odd, odd_rows):
    rows = I.identify(odd, FILE).collect()
    assert len(rows) == len(odd_rows)
    assert {r.lang_pred for r in rows if r.id in (6, 7, 8, 12)} == {"und"}
    assert {r.lang_pred for r in rows if r.id in (9, 13)} <= {"en", "de", "fr"}
    assert {r.score for r in rows if r.id == 6} == {0.0}


def test_empty_and_unlabelled_tables(nothing, table_of, odd_rows):
    assert I.identify(nothing, FILE).count() == 0
    bare = table_of([(r[0], r[1], None, *r[3:]) for r in odd_rows], name="bare")
    assert {r.lang_pred for r in I.identify(bare, FILE).collect()} == {"und"}


@pytest.mark.parametrize("width", [1, 2, 5, 40])
def test_window_minima(width):
    values = np.random.default_rng(width).integers(0, 9, 60).astype(np.uint64)
    want = {
        p + k
        for p in range(len(values) - width + 1)
        for k in range(width)
        if values[p + k] == values[p : p + width].min()
    }
    assert K.window_minima(values, width).tolist() == sorted(want)
