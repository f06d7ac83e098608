import zlib

import numpy as np
import public_tokenizers
import pytest
from odd_tables import EXTRA

import corpus_pipeline
from slopefield.llm import piece_lattice as P

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(FILE, "rb") as f:
        return P.PieceModel(f.read())


def every_segmentation(model, text):
    raw = model.escaped(text)
    missing = model.missing_characters(np.frombuffer(raw, np.uint8)) if raw else []
    out = []

    def go(at, ids, score):
        if at == len(raw):
            out.append((score, tuple(ids)))
            return
        for end in range(at + 1, len(raw) + 1):
            k = model.pieces.get(raw[at:end])
            if k is not None:
                go(end, [*ids, k], score + model.scores[k])
        if missing[at]:
            go(at + 1, [*ids, int(model.byte_ids[raw[at]])], score + model.worst)

    go(0, [], 0.0)
    return sorted(out, key=lambda x: (-x[0], x[1]))


TEXTS = ["", "a", "the cat", " a  b", "x\ny", "日本語", "§☃ a", "thing is", "  ", "tab\tw", "a\n\n b "]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("n", [1, 5])
def test_n_best_against_all_segmentations(model, text, n):
    want = every_segmentation(model, text)
    found = P.Segmenter(model, n).segment([text])[0]
    assert len(found) == min(n, len(want))
    assert np.allclose([s for s, _ in found], [s for s, _ in want[:n]])
    assert len({tuple(ids) for _, ids in found}) == len(found)
    assert {tuple(ids) for _, ids in found} <= {ids for _, ids in want}
    for _, ids in found:
        assert model.decode(ids.tolist()) == text


def test_words_kept_from_earlier_slices_change_nothing(model):
    texts = ["the cat sat on the mat", "on the other hand", "", "the cat sat\non the mat", "mat mat"]
    together = P.Segmenter(model, 4).segment(texts)
    small = P.Segmenter(model, 4, cache_words=1)
    for text, want in zip(texts, together):
        found = small.segment([text])[0]
        assert [s for s, _ in found] == [s for s, _ in want]
        assert [i.tolist() for _, i in found] == [i.tolist() for _, i in want]


def test_round_trip_of_odd_rows(odd, odd_rows):
    encoded = P.encode_documents(odd, FILE, n_best=3)
    rows = P.decode_documents(encoded, FILE).collect()
    assert sorted((str(r.id), r.text) for r in rows) == sorted(
        (str(i), t or "") for i, t, *_ in odd_rows
    )
    for r in rows:
        assert r.restored and r.n_pieces == len(r.pieces)
        assert r.scores == sorted(r.scores, reverse=True)
        every = [r.pieces, *r.alternatives]
        assert r.ids_crc32 == zlib.crc32(b"".join(np.array(x, "<u4").tobytes() for x in every))


def test_empty_table(nothing):
    assert P.encode_documents(nothing, FILE).count() == 0
    assert P.decode_documents(P.encode_documents(nothing, FILE), FILE).count() == 0


def test_restored_is_the_decoded_text(table_of):
    texts = ["the cat", "a \u2581 b", "\u2581", " \u2603\n", "", None]
    rows = [(k, t, "en", None, None, *EXTRA) for k, t in enumerate(texts)]
    encoded = P.encode_documents(table_of(rows), FILE, n_best=2)
    found = {r.id: r for r in P.decode_documents(encoded, FILE).collect()}
    assert [found[k].restored for k in range(6)] == [True, False, False, True, True, True]
    assert all(r.restored == (r.text == (texts[k] or "")) for k, r in found.items())


def test_pipeline_stage_against_all_segmentations(spark, model, table_of):
    rows = [(k, t, "en", None, None, *EXTRA) for k, t in enumerate(TEXTS)]
    found = {r.doc_id: r for r in corpus_pipeline.encode(spark, table_of(rows), "").collect()}
    for k, text in enumerate(TEXTS):
        want, r = every_segmentation(model, text), found[k]
        assert r.decoded == text and r.restored and r.n_pieces == len(r.pieces)
        assert len(r.scores) == 1 + len(r.alternatives) == min(corpus_pipeline.N_BEST, len(want))
        assert np.allclose(r.scores, [s for s, _ in want[: corpus_pipeline.N_BEST]])
        ids = [tuple(x) for x in (r.pieces, *r.alternatives)]
        assert len(set(ids)) == len(ids) and set(ids) <= {x for _, x in want}
        assert all(model.decode(x) == text for x in ids)


def test_lattices_are_made_of_a_few_words_at_a_time(model, monkeypatch):
    sizes, made = [], P.WordLattices

    def noted(model, data, offsets):
        sizes.append(len(data))
        return made(model, data, offsets)

    text = " ".join(f"word{k} x{k * 7}" for k in range(3000))
    want = P.Segmenter(model, 1).segment([text])[0]
    monkeypatch.setattr(P, "WordLattices", noted)
    monkeypatch.setattr(P, "LATTICE_BYTES", 1000, raising=False)
    (score, ids), = P.Segmenter(model, 1).segment([text])[0]
    assert max(sizes) <= 1000 and len(sizes) > 10
    assert score == want[0][0] and ids.tolist() == want[0][1].tolist()


def test_batches_are_bounded_by_bytes(spark):
    from slopefield.llm.common import stored

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    long = spark.range(0, 2000, 1, 1).selectExpr("repeat('abcdefghij', 500) AS text")
    assert max(r.n for r in stored(long.mapInArrow(sizes, "n long"), "sizes").collect()) < 2 << 20
