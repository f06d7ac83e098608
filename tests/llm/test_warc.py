import gzip
import hashlib
import io

import pytest

from slopefield.llm import warc as W

PAGES = "page_id long, url string, html string, digest string, id long, payload string"


def pages(rows):
    return [(i, u, h, "d", 1, "p") for i, u, h in rows]


ROWS = [
    (1, "http://a/x y\r\nEvil: 1", "same " * 30),
    (5, "http://a/2", "same " * 30),
    (3, None, "same " * 30),
    (4, "http://b", "short"),
    (2, "http://c", "short"),
    (6, "http://d", None),
    (7, "http://e", ""),
    (8, "http://f", "Ä\r\n\r\nWARC/1.1\r\n" + "long ünï " * 40_000),
    (9, "http://g", "same " * 30 + "!"),
    (None, "http://h", "same " * 30),
]


def test_round_trip(table_of):
    df = table_of(pages(ROWS), PAGES, "pages")
    archives = W.write_archives(df, archive_bytes=500)
    assert archives.count() > 1
    found = {(r.id, r.url): r for r in W.read_archives(archives).collect()}
    assert len(found) == len(ROWS)
    for i, url, html in ROWS:
        r = found[i, url and " ".join(url.split())]
        raw = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        first = min(j for j, _, h in ROWS if (h or "") == (html or "") and j is not None)
        if len(raw) >= 100 and i != first:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", first, None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, raw)


def test_empty_table(table_of):
    archives = W.write_archives(table_of([], PAGES, "pages"))
    assert W.read_archives(archives).count() == 0


def record(**changes):
    raw = W.record_bytes("response", 1, "u", b"x" * 300, hashlib.sha256(b"x" * 300).hexdigest(),
                         None, "2020-01-01T00:00:00Z")
    for old, new in changes.get("replace", []):
        assert old in raw
        raw = raw.replace(old, new, 1)
    return gzip.compress(raw)


def test_sequential_members():
    stream = io.BytesIO(record() + record())
    assert [r["payload_bytes"] for r in W.read_records(stream)] == [300, 300]


@pytest.mark.parametrize(
    "bad",
    [
        record(replace=[(b"xxx", b"xxy")]),
        record(replace=[(b"WARC-Payload-Digest: sha256:", b"WARC-Payload-Digest: sha256:0")]),
        record(replace=[(b"WARC/1.1", b"WARD/1.1")]),
        record()[:-20],
        gzip.compress(b"WARC/1.1\r\nno end"),
    ],
)
def test_damage_is_noticed(bad):
    with pytest.raises(W.WarcError):
        list(W.read_records(io.BytesIO(bad)))
