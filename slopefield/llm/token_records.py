"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

Documents are put in id order by ranges, encoded, and written by each task as one file of
records and one index. A record is

    length      8 bytes, little endian
    checksum    4 bytes, masked CRC-32 of the length bytes
    ids         ``length`` bytes: unsigned 16 or 32 bit, little endian, end id included
    checksum    4 bytes, masked CRC-32 of the ids

and the index holds, after a short head, the document ids, a byte per id that is 0 for a
null one, and the offset of every record plus the end. A file appears under its name
only when complete. Reading streams a file record by record and verifies all checksums;
``read_at`` takes single records by their offsets.

Encoding is that of the ``tokenizers`` library. Words are encoded once per worker process and
kept (up to ``CACHE_WORDS``; beyond, the half learnt first stays): white space separates them for this vocabulary, so a text's ids
are those of its words. A vocabulary for which that does not hold is refused.

Defined cases: a null or empty text has the end id alone; null document ids come first;
equal ids are ordered by text; extra columns are ignored. A text is encoded whole, as one
record, whatever its length; repeated rows are repeated records.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopefield.llm.common import committed_file, kept_in_worker, opened, stored, text_of
from slopefield.session import shared_folder

CACHE_WORDS = 400_000
BATCH_DOCUMENTS = 256
INDEX_MAGIC = b"IDXR\x01"

# Plain words: Latin letters whose composed form is stable, then ASCII marks other than '.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\\[-`{-~]*)")


def masked(crc: int) -> int:
    """A CRC as stored: rotated and shifted, so that checksums of checksums stay apart."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join(
        (
            size,
            struct.pack("<I", masked(zlib.crc32(size))),
            payload,
            struct.pack("<I", masked(zlib.crc32(payload))),
        )
    )


def read_frame(stream) -> bytes | None:
    """The next payload, None at the end; raises if anything differs from its checksum."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(zlib.crc32(head[:8])):
        raise ValueError("damaged record length")
    (size,) = struct.unpack("<Q", head[:8])
    body = stream.read(size + 4)
    if len(body) < size + 4:
        raise ValueError("record ends early")
    payload = body[:size]
    if struct.unpack("<I", body[size:])[0] != masked(zlib.crc32(payload)):
        raise ValueError("damaged record")
    return payload


class WordEncoder:
    """Ids of texts, as little-endian bytes, with every distinct word encoded once."""

    def __init__(self, definition: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = spec["model"].get("end_of_word_suffix")
        pattern = (split[0].get("pattern") or {}).get("Regex", "")
        if not suffix or not split[0].get("invert") or "[^\\s\\p{L}\\p{N}]" not in pattern:
            raise ValueError("this vocabulary does not drop white space between words")
        self.whole = Tokenizer.from_str(definition)
        vocabulary = spec["model"]["vocab"]
        largest = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])])
        self.dtype = np.dtype("<u2" if largest < 1 << 16 else "<u4")
        self.ends_word = np.zeros(largest + 1, bool)
        for piece, k in vocabulary.items():
            self.ends_word[k] = piece.endswith(suffix)
        # The same model for words that are already normalised and separated.
        spec["normalizer"], spec["added_tokens"] = None, []
        spec["pre_tokenizer"] = {
            "type": "Sequence",
            "pretokenizers": [{"type": "WhitespaceSplit"}, split[-1]],
        }
        self.plain = Tokenizer.from_str(json.dumps(spec))
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}
        self.cache_words = cache_words

    def _encode_parts(self, parts: list[str]) -> None:
        lots = [parts[i : i + 500] for i in range(0, len(parts), 500)]
        found = self.plain.encode_batch_fast([" ".join(x) for x in lots], add_special_tokens=False)
        for lot, encoded in zip(lots, found):
            ids = np.array(encoded.ids)
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) != len(lot):
                raise ValueError("a word's ids do not end as expected")
            raw, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            begin = 0
            for word, end in zip(lot, (cuts * size).tolist()):
                self.parts[word] = raw[begin:end]
                begin = end

    def _learn(self, words: list[str]) -> None:
        plain, other, new = [], [], {}
        for word in words:
            found = _PLAIN.fullmatch(word)
            if found:
                stem, marks = found[1].lower(), found[2]
                plain.append((word, stem, marks))
                for part in (stem, marks):
                    if part not in self.parts:
                        new[part] = None
            else:
                other.append(word)
        self._encode_parts(list(new))
        for word, stem, marks in plain:
            self.words[word] = self.parts[stem] + self.parts[marks]
        encoded = self.whole.encode_batch_fast(other, add_special_tokens=False)
        for word, e in zip(other, encoded):
            self.words[word] = np.array(e.ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > self.cache_words:
            # What was learnt first stays: frequent words are met early, rare ones make up the rest.
            kept = max(1, self.cache_words // 2)
            self.words = dict(islice(self.words.items(), kept))
            self.parts = dict(islice(self.parts.items(), kept))
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.words
        new = set().union(*split).difference(known)
        if new:
            self._learn(list(new))
        return [b"".join(map(known.__getitem__, words)) for words in split]


def write_records(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """Write all documents in id order; return the stored list of files (part, path, index,
    records, tokens) whose order by ``part`` is the order of ids."""
    import pyarrow as pa

    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-records")
    with open(tokenizer_file, encoding="utf-8") as f:
        text = f.read()
    digest = hashlib.sha256(text.encode()).hexdigest()
    definition = spark.sparkContext.broadcast(text)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
        .repartitionByRange(F.col("id").asc_nulls_first())
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    )

    def written(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        batches = iter(batches)
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        encoder = kept_in_worker("encoder", digest, lambda: WordEncoder(definition.value))
        end = np.array([end_id], encoder.dtype).tobytes()
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}"
        ids, offsets, tokens = [], [0], 0
        with committed_file(folder, f"{name}.records") as out:
            batch = first
            while batch is not None:
                ids += batch.column(0).to_pylist()
                for at in range(0, batch.num_rows, BATCH_DOCUMENTS):
                    texts = batch.column(1).slice(at, BATCH_DOCUMENTS).to_pylist()
                    records = [frame(raw + end) for raw in encoder.encode(texts)]
                    for record in records:
                        offsets.append(offsets[-1] + len(record))
                    out.write(b"".join(records))
                batch = next(batches, None)
        tokens = (offsets[-1] - 16 * len(ids)) // encoder.dtype.itemsize
        with committed_file(folder, f"{name}.index") as out:
            out.write(INDEX_MAGIC + struct.pack("<BQ", encoder.dtype.itemsize, len(ids)))
            out.write(np.array([i or 0 for i in ids], "<i8").tobytes())
            out.write(np.array([i is not None for i in ids], np.uint8).tobytes())
            out.write(np.array(offsets, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part], pa.int32()),
                "path": [f"{folder}/{name}.records"],
                "index": [f"{folder}/{name}.index"],
                "records": pa.array([len(ids)], pa.int64()),
                "tokens": pa.array([tokens], pa.int64()),
            }
        )

    return stored(
        ordered.mapInArrow(
            written, "part int, path string, index string, records long, tokens long"
        ),
        "files",
    )


def read_index(path: str) -> tuple[np.dtype, list, np.ndarray]:
    """(type of the ids, document ids, offsets) of a file."""
    with opened(path) as stream:
        raw = stream.read()
    head = len(INDEX_MAGIC)
    if raw[:head] != INDEX_MAGIC:
        raise ValueError("no index of token records")
    width, n = struct.unpack_from("<BQ", raw, head)
    at = head + 9
    ids = np.frombuffer(raw, "<i8", n, at).tolist()
    valid = np.frombuffer(raw, np.uint8, n, at + 8 * n)
    offsets = np.frombuffer(raw, "<u8", n + 1, at + 9 * n)
    return np.dtype(f"<u{width}"), [i if v else None for i, v in zip(ids, valid)], offsets


def read_at(path: str, offsets: list[int], dtype: np.dtype) -> Iterator[np.ndarray]:
    """Single records by offset, in any order: what shuffled training reads do."""
    with opened(path) as stream:
        for offset in offsets:
            stream.seek(int(offset))
            yield np.frombuffer(read_frame(stream), dtype)


def read_records(files: DataFrame, with_ids: bool = True, batch: int = 256) -> DataFrame:
    """Per document: id, start (ids of all documents before it), n_tokens, ids_crc32, ids.

    ``files`` has one row per file, so that its running total is small.
    """
    import pyarrow as pa

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.select(
        "path", "index", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")
    )
    names = ["id", "start", "n_tokens", "ids_crc32", "ids"]

    def read(batches):
        for batch_of_files in batches:
            for path, index, base in zip(*(c.to_pylist() for c in batch_of_files.columns)):
                dtype, ids, _ = read_index(index)
                start = base
                with opened(path) as raw:
                    stream = io.BufferedReader(raw, 1 << 20)
                    for at in range(0, len(ids), batch):
                        rows = []
                        for doc in ids[at : at + batch]:
                            payload = read_frame(stream)
                            if payload is None:
                                raise ValueError("fewer records than the index has")
                            wide = np.frombuffer(payload, dtype).astype("<u4").tobytes()
                            n = len(wide) // 4
                            rows.append((doc, start, n, zlib.crc32(wide), wide if with_ids else None))
                            start += n
                        columns = list(zip(*rows))
                        kinds = [pa.int64()] * 4 + [pa.binary()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
                        )
                    if read_frame(stream) is not None:
                        raise ValueError("more records than the index has")

    return listed.repartition(max(1, files.count())).mapInArrow(
        read, "id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )
