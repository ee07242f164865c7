"""Token ids in length-delimited binary records, with an offset index for reads in any order.

A shard file is a run of records: length (unsigned 64 bits), masked checksum of the length, payload, masked checksum of the
payload. All numbers are little-endian. A checksum is zlib's CRC-32, rotated right by 15 bits plus a constant, so that a
checksum of data that hold checksums isn't trivial. The payload is a document's ids as unsigned 16-bit integers. The index file
beside it has a row for each record: doc_id, whether there is one, offset of the record, number of ids.

A task writes its range of documents as shards of SHARD_BYTES, or one record more, and keeps no more of their index than a buffer. Files get
a name of their attempt first and are renamed when complete: a repeated task replaces a shard by the same bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.llm.common import WRITTEN, only, shared_dir, table, written
from cuesheet.llm.tokens import Encoder, batches_of

END = 2
#: of the checksum's mask, as in TFRecord files
MASK = 0xA282EAD8
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("n_tokens", "<u4")])
SUMMARY = "shard long, records long, n_tokens long, bytes long, path string"
SHARD_BYTES, BUFFERED, SHOWN = 256 << 20, 4096, 64


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, offset: int) -> tuple[bytes, int]:
    """The payload of the record at `offset`, and where the next begins; ValueError if it was damaged."""
    length = bytes(data[offset : offset + 8])
    if len(length) < 8 or struct.unpack_from("<I", data, offset + 8)[0] != masked(length):
        raise ValueError(f"damaged length at byte {offset}")
    end = offset + 12 + struct.unpack("<Q", length)[0]
    payload = bytes(data[offset + 12 : end])
    if len(data) < end + 4 or struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {offset}")
    return payload, end + 4


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + uri.removeprefix("file:").replace("//", "/") if uri.startswith(("file:", "/")) else uri)


class Shard:
    """A shard that is being written: the records, and beside them the index."""

    def __init__(self, folder: str, name: str, attempt: int) -> None:
        self.files, base = store(folder)
        self.files.create_dir(base, recursive=True)
        self.path, self.at, self.attempt = f"{folder}/{name}", f"{base}/{name}", attempt
        self.out, self.idx = (self.files.open_output_stream(f"{self.at}.{kind}.{attempt}", buffer_size=1 << 20) for kind in ("rec", "idx"))
        self.index, self.records, self.n_tokens, self.offset = [], 0, 0, 0

    def add(self, key: int | None, payload: bytes) -> None:
        record, n = frame(payload), len(payload) // 2
        self.out.write(record)
        self.index.append((key or 0, key is not None, self.offset, n))
        self.records, self.n_tokens, self.offset = self.records + 1, self.n_tokens + n, self.offset + len(record)
        if len(self.index) == BUFFERED:
            self.flush()

    def flush(self) -> None:
        self.idx.write(np.array(self.index, INDEX).tobytes())
        self.index = []

    def close(self, number: int) -> pa.RecordBatch:
        self.flush()
        for x, kind in ((self.idx, "idx"), (self.out, "rec")):
            x.close()
            self.files.move(f"{self.at}.{kind}.{self.attempt}", f"{self.at}.{kind}")
        columns = [(number, pa.int64()), (self.records, pa.int64()), (self.n_tokens, pa.int64()), (self.offset, pa.int64()), (self.path, pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in columns], names=["shard", "records", "n_tokens", "bytes", "path"])


def write_records(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards and returns (shard, records, n_tokens, bytes, path), a row for each; the number `shard` counts up with the documents.

    Documents are in ascending doc_id order over all shards, those without doc_id first, equal ids by the first SHOWN characters of their text and
    then as they come; so the rows of one id, however many, may be dealt to several tasks. A null text counts as empty and gives the end id alone.
    Texts of any length are encoded whole. `tokenizer` is a path that every executor can open. Other columns are ignored; an empty
    table gives no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        encode, part_nr, shard, closing = None, 0, None, np.array([end], "<u2").tobytes()
        for part in batches_of(batches, 1):
            encode = encode or Encoder(tokenizer, blanks_dropped=True)
            for key, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                shard = shard or Shard(folder, f"shard-{at:08d}-{part_nr:06d}", attempt)
                shard.add(key, ids + closing)
                if shard.offset >= shard_bytes:
                    yield shard.close(at << 32 | part_nr)
                    shard, part_nr = None, part_nr + 1
        if shard is not None:
            yield shard.close(at << 32 | part_nr)

    rows = only(docs, doc_id, text).withColumns({"head": F.substring("text", 1, SHOWN), "nr": F.monotonically_increasing_id()})
    order = ("doc_id", "head", "nr")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    WRITTEN.append(folder)
    return written(dealt.mapInArrow(run, SUMMARY))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            files, name = store(path)
            with files.open_input_stream(f"{name}.idx") as index, files.open_input_stream(f"{name}.rec", buffer_size=1 << 20) as records:
                at = 0
                while data := index.read(INDEX.itemsize * BUFFERED):
                    some, crcs = np.frombuffer(data, INDEX), []
                    for offset, n in zip(some["offset"].tolist(), some["n_tokens"].tolist(), strict=True):
                        payload, size = unframe(memoryview(records.read(2 * n + 16)), 0)
                        if offset != at or len(payload) != 2 * n:
                            raise ValueError(f"{path}: the index has {n} ids at byte {offset}, the record {len(payload) // 2} at {at}")
                        crcs.append(zlib.crc32(np.frombuffer(payload, "<u2").astype("<u4").tobytes()))
                        at += size
                    sizes = some["n_tokens"].astype(np.int64)
                    before = start + np.cumsum(sizes) - sizes
                    start += int(sizes.sum())
                    ids = pa.array(some["doc_id"].copy(), mask=some["known"] == 0)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(before), pa.array(sizes), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read from the files and checked; start counts all ids before it."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = shards.select(before.alias("start"), "path")  # a row for each shard, not for each document
    n = max(1, shards.count())  # named, so that shards aren't put together for being few bytes here
    return found.repartition(n, "path").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    return read_digests(write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json")))
