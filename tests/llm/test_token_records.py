import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slopefield.llm import token_records as T

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_odd_rows_in_order_with_the_ids_of_the_library(odd, odd_rows):
    library = Tokenizer.from_file(FILE)
    files = T.write_records(odd, FILE, end_id=2)
    found = T.read_records(files).orderBy("start").collect()
    rows = sorted((r[:2] for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert len(found) == len(rows)
    for r, (i, text) in zip(found, rows):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        raw = np.array(ids, "<u4").tobytes()
        assert (r.id, r.start, r.n_tokens, bytes(r.ids)) == (i, start, len(ids), raw)
        assert r.ids_crc32 == zlib.crc32(raw)
        start += len(ids)


def test_index_gives_records_in_any_order(odd):
    files = T.write_records(odd, FILE, end_id=2).orderBy("part").collect()
    for f in files:
        dtype, ids, offsets = T.read_index(f["index"])
        assert len(ids) == f.records and offsets[0] == 0
        back = list(T.read_at(f.path, offsets[:-1][::-1], dtype))
        assert sum(map(len, back)) == f.tokens and all(x[-1] == 2 for x in back)


def test_empty_table(nothing):
    assert T.read_records(T.write_records(nothing, FILE, end_id=2)).count() == 0


def test_damage_is_noticed():
    good = T.frame(b"abcd")
    assert T.read_frame(io.BytesIO(good)) == b"abcd" and T.read_frame(io.BytesIO(b"")) is None
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            T.read_frame(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        T.read_frame(io.BytesIO(good[:-1]))


@pytest.mark.parametrize(
    "text",
    [
        "It's WE'LL don't 'sup ' '", "áb é İstanbul ΣΑΣ ς", "x y z\x1cq\x85r",
        "no_1 a-b.c,d 12.5% $$$ <|endoftext|> <|startoftext|>x", "ß ﬁ Ǆ ª º", "​ zero​width",
        "日本語 text\tand\r\nlines", "A" * 3000,
    ],
)
def test_words_are_encoded_as_the_library_encodes_the_text(text):
    with open(FILE, encoding="utf-8") as f:
        definition = f.read()
    encoder = T.WordEncoder(definition, cache_words=2)
    want = Tokenizer.from_str(definition).encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == want


def test_words_met_first_stay_known_when_the_cache_is_cut(monkeypatch):
    with open(FILE, encoding="utf-8") as f:
        encoder = T.WordEncoder(f.read(), cache_words=8)
    want = encoder.encode(["the cat"])
    encoder.encode([" ".join(f"rare{k}" for k in range(40))])
    learnt = []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: (learnt.extend(words), learn(words)))
    assert encoder.encode(["the cat"]) == want
    assert not learnt and len(encoder.words) <= 8
    encoder.encode(["rare39 new"])
    assert "new" in learnt
