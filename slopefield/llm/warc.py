"""WARC archives: a writer that stores equal payloads once, and a sequential reader.

One gzip member per record. The reader goes through an archive from its start in
chunks, inflates member after member, takes the block by its Content-Length and
verifies the block and payload digests; its memory does not depend on the archive.

A payload that occurs more than once is stored with the row of smallest id; the others
become ``revisit`` records that carry the HTTP header and the payload's digest only.

Defined cases: a null payload counts as empty, payloads under ``min_revisit_bytes`` are
always stored, rows that repeat the smallest id are all responses, rows with a null id
refer to the smallest id there is. A null URL leaves the target header out. A payload of any
length is one record, which passes writer and task whole; the reader inflates it by chunks and
keeps it only if it is asked for. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopefield.llm.common import (
    committed_file,
    joined_with_groups,
    lean,
    opened,
    stored,
    text_of,
)
from slopefield.llm.exact_dedup import possibly_repeated
from slopefield.session import shared_folder

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_PREFIX = "urn:x-row:"
CHUNK = 1 << 16


class WarcError(ValueError):
    """An archive that is damaged or breaks the framing."""


def record_bytes(
    kind: str, row_id, url: str | None, payload: bytes, digest: str, refers_to, date: str
) -> bytes:
    """One record, not yet compressed. ``payload`` is left out of a revisit."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if kind == "revisit" else http + payload
    header = [
        ("WARC-Type", kind),
        ("WARC-Date", date),
        ("WARC-Record-ID", f"<{RECORD_PREFIX}{'' if row_id is None else row_id}>"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        header.append(("WARC-Target-URI", " ".join(url.split())))
    if kind == "revisit":
        header.append(("WARC-Profile", REVISIT_PROFILE))
        header.append(("WARC-Refers-To", f"<{RECORD_PREFIX}{refers_to}>"))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in header)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def inflated_members(stream) -> Iterator[Iterator[bytes]]:
    """For each gzip member, an iterator over its bytes; take it to its end before the next."""
    rest = stream.read(CHUNK)

    def member():
        nonlocal rest
        inflate = zlib.decompressobj(31)
        while True:
            while rest and not inflate.eof:
                out = inflate.decompress(rest, CHUNK)
                rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if out:
                    yield out
                elif not rest:
                    break
            if inflate.eof:
                if not rest:
                    rest = stream.read(CHUNK)
                return
            more = stream.read(CHUNK)
            if not more:
                raise WarcError("archive ends inside a record")
            rest += more

    while rest:
        yield member()


class _Source:
    """Reads lines and counted bytes from an iterator of chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def header(self) -> bytes:
        while b"\r\n\r\n" not in self.held:
            more = next(self.chunks, None)
            if more is None:
                raise WarcError("record without an end of header")
            self.held += more
        head, _, self.held = self.held.partition(b"\r\n\r\n")
        return head

    def counted(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held:
                self.held = next(self.chunks, b"")
                if not self.held:
                    raise WarcError("record shorter than its Content-Length")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part

    def rest(self) -> bytes:
        return self.held + b"".join(self.chunks)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def read_records(stream, with_payload: bool = True) -> Iterator[dict]:
    """The records of an archive in order, each verified."""
    for chunks in inflated_members(stream):
        source = _Source(chunks)
        head = source.header()
        if not head.startswith(b"WARC/1."):
            raise WarcError("record does not start with its version")
        fields = _fields(head)
        block_hash, payload_hash = hashlib.sha256(), hashlib.sha256()
        http, kept, payload_bytes = b"", [], 0
        in_header = True
        for part in source.counted(int(fields["content-length"])):
            block_hash.update(part)
            if in_header:
                http += part
                if b"\r\n\r\n" not in http:
                    continue
                http, _, part = http.partition(b"\r\n\r\n")
                in_header = False
            payload_hash.update(part)
            payload_bytes += len(part)
            if with_payload:
                kept.append(part)
        if source.rest() != b"\r\n\r\n":
            raise WarcError("record does not end after its Content-Length")
        if fields["warc-block-digest"] != f"sha256:{block_hash.hexdigest()}":
            raise WarcError("block digest differs")
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        length = int(_fields(http)["content-length"])
        kind = fields["warc-type"]
        if kind == "response" and (digest != payload_hash.hexdigest() or length != payload_bytes):
            raise WarcError("payload digest or length differs")
        row_id = fields["warc-record-id"].strip("<>").removeprefix(RECORD_PREFIX)
        refers = fields.get("warc-refers-to")
        yield {
            "id": row_id or None,
            "url": fields.get("warc-target-uri"),
            "payload_bytes": length,
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": refers and refers.strip("<>").removeprefix(RECORD_PREFIX),
            "payload": b"".join(kept) if with_payload and kind == "response" else None,
        }


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 100,
    archive_bytes: int = 64 << 20,
    level: int = 4,
    date: str = "1970-01-01T00:00:00Z",
    bits_per_row: int = 16,
    max_filter_bits: int = 1 << 28,
) -> DataFrame:
    """Write the archives and return their list (path, records, bytes).

    A task starts another archive after ``archive_bytes``, so that reading splits as
    well as writing. Files appear under their names only when complete.
    """
    import pyarrow as pa

    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        text_of(payload_col).alias("payload"),
    )
    # Of payloads that can be revisited only those whose hash may occur again are shuffled;
    # all other pages are written where they are read.
    large = F.octet_length("payload") >= min_revisit_bytes
    hashed = rows.withColumn("hash", F.when(large, F.xxhash64("payload")))
    hashes = stored(hashed.where("hash IS NOT NULL").select("hash"), "hashes")
    maybe = possibly_repeated(hashes, "hash", bits_per_row, max_filter_bits)
    marked = hashed.withColumn("hash", F.coalesce("hash", F.lit(0).cast("long"))).withColumn(
        "again", large & maybe
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    suspects = stored(marked.where("again").select("id", "url", "digest", "payload"), "suspects")
    repeated = stored(
        suspects.groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1"),
        "payloads",
    )
    joined = joined_with_groups(
        suspects, repeated, "digest", "copies", suspects.count(), F.col("id")
    )
    nobody = F.lit(None).cast("long")
    placed = marked.where("NOT again").select(
        "id", "url", "digest", "payload", nobody.alias("refers_to")
    ).unionAll(
        joined.select(
            "id", "url", "digest", "payload",
            F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
        )
    )

    def written(batches):
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        queue = (
            row
            for batch in batches
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)),
                           batch.column(4).to_pylist())
        )
        row, part, found = next(queue, None), 0, []
        while row is not None:
            name = f"part-{partition:06d}-{part:04d}.warc.gz"
            records = size = 0
            with committed_file(folder, name) as out:
                while row is not None and size < archive_bytes:
                    row_id, url, digest, text, refers = row
                    record = record_bytes(
                        "response" if refers is None else "revisit",
                        row_id, url, text.encode(), digest, refers, date,
                    )
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = squeeze.compress(record) + squeeze.flush()
                    out.write(member)
                    size += len(member)
                    records += 1
                    row = next(queue, None)
            found.append((f"{folder}/{name}", records, size))
            part += 1
        yield pa.RecordBatch.from_pydict(
            {
                "path": pa.array([f[0] for f in found], pa.string()),
                "records": pa.array([f[1] for f in found], pa.int64()),
                "bytes": pa.array([f[2] for f in found], pa.int64()),
            }
        )

    return stored(placed.mapInArrow(lean(written), "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, with_payload: bool = True, batch: int = 512) -> DataFrame:
    """All records of the archives whose ``path`` a table lists, one task per few archives."""
    import pyarrow as pa

    schema = (
        "id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, payload binary"
    )

    def read(batches):
        def out(rows):
            number = lambda v: None if v is None else int(v)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number(r["id"]) for r in rows], pa.int64()),
                    pa.array([r["url"] for r in rows], pa.string()),
                    pa.array([r["payload_bytes"] for r in rows], pa.int64()),
                    pa.array([r["payload_digest"] for r in rows], pa.string()),
                    pa.array([r["record_type"] for r in rows], pa.string()),
                    pa.array([number(r["refers_to"]) for r in rows], pa.int64()),
                    pa.array([r["payload"] for r in rows], pa.binary()),
                ],
                names=[f.split()[0] for f in schema.split(", ")],
            )

        held = []
        for listed in batches:
            for path in listed.column(0).to_pylist():
                with opened(path) as stream:
                    for record in read_records(stream, with_payload):
                        held.append(record)
                        if len(held) >= batch:
                            yield out(held)
                            held = []
        if held:
            yield out(held)

    paths = archives.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(read, schema)
