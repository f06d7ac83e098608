import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopefield.llm import toxicity as X

LABELS = "doc_id long, toxic int, text string, row long"


@pytest.fixture(scope="module")
def model(spark):
    words = "you are an idiot and a clown this is stupid nice letter cool good book " * 40
    return X.character_model(spark.createDataFrame([(words,)], "text string"))


@pytest.mark.parametrize(
    ("typed", "meant"),
    [("1d10t", "idiot"), ("i d i o t", "idiot"), ("st-u-p-i-d", "stupid"), ("idiooooot", "idiot"),
     ("cl0wn", "clown"), ("$tup1d", "stupid"), ("coool", "cool"), ("gooood", "good"),
     ("lettter", "letter")],
)
def test_restoration(model, typed, meant):
    assert X.restored(typed, model) == meant


def by_enumeration(token, model):
    """The best of all ways through the lattice of a token."""
    edge, best = X._EDGE, None
    for way in itertools.product(*X._steps(token)):
        word = "".join(letters for letters, _ in way)
        symbols = [edge, edge, *(ord(c) - 97 if "a" <= c <= "z" else 26 for c in word), edge]
        score = sum(model[t] for t in zip(symbols, symbols[1:], symbols[2:]))
        score -= sum(cost for _, cost in way)
        if best is None or score > best[0]:
            best = score, word
    return best


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_finds_the_best_of_all_ways(model, seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        token = "".join(rng.choice(list("aidot01357@$!|-. é"), rng.integers(1, 8)))
        token += token[-1] * int(rng.integers(0, 3))
        score, word = by_enumeration(token, model)
        mine = X.restored(token, model)
        symbols = [X._EDGE] * 2 + [ord(c) - 97 if "a" <= c <= "z" else 26 for c in mine] + [X._EDGE]
        assert mine == word or sum(model[t] for t in zip(symbols, symbols[1:], symbols[2:])) >= score


def test_wanted_features_are_found_by_search():
    rng = np.random.default_rng(1)
    features = rng.integers(0, 50, 400).astype(np.uint64)
    wanted = np.unique(rng.integers(0, 60, 20)).astype(np.uint64)
    assert (X._among(features, wanted) == np.isin(features, wanted)).all()
    assert not X._among(features, wanted[:0]).any()


def test_character_model_is_a_distribution(model):
    assert np.allclose(np.exp(model).sum(axis=2), 1.0)


def test_suspicious_tokens_are_found_in_their_document():
    texts = ["plain words here 1984", "so i d i o t yes", "an 1d10t!", "nooo 5 a b"]
    raw = [t.encode() for t in texts]
    found = X.suspicious_tokens(
        np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    )
    assert sorted(found) == [(1, "i d i o t"), (2, "1d10t"), (3, "nooo")]


def labelled(table_of):
    # Every tenth text holds one of three bad words; all other words are the same.
    rng = np.random.default_rng(0)
    rows = []
    for k in range(900):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(30)]
        if k % 6 == 0:
            words.insert(int(rng.integers(0, 30)), ["grumbug", "snorkfool", "wretchy"][k // 6 % 3])
        rows.append((k, " ".join(words)))
    rows += [(9001, "you gr0mbug, gru-m-bug" + " and" * 9), (9002, "snorkf00l xyz")]
    return rows


def test_held_out_labels_are_predicted(spark, table_of):
    rows = labelled(table_of)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    labels = spark.createDataFrame(
        [(k, int(k % 6 == 0), "t", 1) for k in range(900)] + [(3, None, "t", 1), (None, 1, "t", 1)],
        LABELS,
    )
    found = {r.id: r for r in X.toxicity_scores(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [(i, r) for i, r in found.items() if r.held_out and i < 900]
    assert np.mean([r.predicted == int(i % 6 == 0) for i, r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    assert found[9002].predicted == 1  # restored before it is scored


def test_labels_of_held_out_rows_do_not_matter(spark, table_of):
    docs = spark.createDataFrame(labelled(table_of)[:200], "doc_id long, text string").coalesce(1)
    true = spark.createDataFrame([(k, int(k % 6 == 0), "t", 1) for k in range(200)], LABELS)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    false = true.withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.id: r.score for r in X.toxicity_scores(docs, x).collect()} for x in (true, false))
    assert a == pytest.approx(b)


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, nothing):
    none = spark.createDataFrame([], LABELS)
    rows = X.toxicity_scores(odd, none).collect()
    assert len(rows) == len(odd_rows) and {r.score for r in rows} == {0.0}
    some = spark.createDataFrame([(k, k % 2, "t", 1) for k in range(1, 18)], LABELS)
    rows = X.toxicity_scores(odd, some).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert X.toxicity_scores(nothing, some).count() == 0


def tokens(text, **how):
    raw = text.encode()
    return [t for _, t in X.suspicious_tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), **how)]


def test_tokens_hidden_at_their_ends_or_short_are_found():
    for token in ("$tupid", "1diot", "@ss", "as$", "naz!", "clow7", "a s s", "a-s-s", "a  s .. s"):
        assert tokens(f"you {token} there") == [token]
    assert tokens("an 1d10t!", doubtful=True) == ["1d10t", "1d10t!"]
    assert tokens("so @ s s then", doubtful=True) == ["@ s s"]
    assert tokens("in 1984 | 5 - 6 it cost $ 7") == tokens("plain words. or two") == []


def test_documents_with_all_bad_words_hidden_are_toxic(spark, table_of):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(900):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(30)]
        if k % 6 == 0:
            words.insert(int(rng.integers(0, 30)), ["zug", "snorkfool", "wretchy"][k // 6 % 3])
        rows.append((k, " ".join(words)))
    filler = rows[1][1]
    hidden = ["$norkfool", "z  u  g", "z-u-g", "2ug z u g", "$norkf00l!"]
    rows += [(9000 + k, f"{filler} {word} {filler}") for k, word in enumerate(hidden)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    labels = spark.createDataFrame([(k, int(k % 6 == 0), "t", 1) for k in range(900)], LABELS)
    found = {r.id: r.predicted for r in X.toxicity_scores(docs, labels).collect()}
    assert [found[9000 + k] for k in range(len(hidden))] == [1] * len(hidden)
    assert np.mean([found[k] for k in range(900) if k % 6]) < 0.03


def test_only_equal_and_near_texts_are_one_family(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(["the", *("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400))]) for _ in range(50)]
    rows = [(100 + k, k % 2, t) for k, t in enumerate(texts)]  # every text holds "the"
    rows += [(7, 0, texts[0]), (300, 0, texts[2] + " z"), (8, 0, texts[1]), (400, 1, ""), (401, 1, "a")]
    found = X.one_of_each_family(spark.createDataFrame(rows, "id long, label int, text string")).collect()
    ids = {r.id for r in found}
    assert 7 in ids and 100 not in ids  # the smallest id of equal texts
    assert {8, 101} <= ids  # other label
    assert {r[0] for r in rows} - ids <= {100, 300} and len(found) >= 53
    assert {r.id: r.text for r in found} == {i: t for i, _, t in rows if i in ids}
