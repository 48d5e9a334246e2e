"""Token ids in length-delimited binary records, with an offset index apart.

Each record is framed as: length (8 bytes, little-endian), masked CRC-32C of the length (4), payload,
masked CRC-32C of the payload (4); this is the common framing of record files. The payload is a header
(4 bytes: width of an id, plus NULL_ID where the document has no id), the doc_id (8 bytes, signed) and the
ids (2 bytes each where the vocabulary allows, else 4). Documents stand in ascending doc_id order over the
shards; ``part-P-K.rec`` names sort in that order. The index is a Parquet table (doc_id, shard, offset,
length, n_tokens), so a shuffled reader can fetch any record by itself.

One range shuffle of the texts by id sorts them; each task encodes its rows and writes its shards under a
temporary name that is renamed when complete, so a repeated task replaces its own files. Folders are opened
with pyarrow.fs, which reads local, HDFS, S3 and GCS paths; a shard is written and read in pieces.

Defined cases: null and empty texts are records of the end id alone; null ids come first and read back as
null; repeated rows give a record each, in the order of a hash of their text; an empty table gives an empty
index; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import checksums
from .common import land, light_batches
from .tokenizing import encoder

END_ID = 2
SHARD_BYTES = 256 << 20
READ_BYTES = 4 << 20
BATCH_BYTES = 3 << 19  # of text encoded at once
NULL_ID = 256
INDEX = "doc_id bigint, shard string, offset bigint, length bigint, n_tokens bigint"


def _folder(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/"):
        uri = "/" + uri[len("file:/"):].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def frame(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    return [h + struct.pack("<I", a) + p + struct.pack("<I", b) for h, a, p, b in
            zip(heads, checksums.masked(heads).tolist(), payloads, checksums.masked(payloads).tolist())]


def unframe(data: bytes, at: list[tuple[int, int]]) -> list[bytes]:
    """Payloads of the records at (offset, length of the whole record) in ``data``; checks all of it."""
    heads = [data[a:a + 8] for a, _ in at]
    payloads = [data[a + 12:a + n - 4] for a, n in at]
    crc = [struct.unpack_from("<I", data, a + 8)[0] for a, _ in at], [struct.unpack_from("<I", data, a + n - 4)[0] for a, n in at]
    if any(struct.unpack("<Q", h)[0] != len(p) for h, p in zip(heads, payloads)):
        raise ValueError("a record's length differs from the index")
    if checksums.masked(heads).tolist() != crc[0] or checksums.masked(payloads).tolist() != crc[1]:
        raise ValueError("a record's checksum is wrong")
    return payloads


class _Shards:
    """Writer of one task's shards."""

    def __init__(self, uri: str, part: int):
        self.fs, self.folder = _folder(uri)
        self.fs.create_dir(self.folder, recursive=True)
        self.part, self.k, self.out = part, -1, None

    def add(self, records: list[bytes]) -> list[tuple[str, int]]:
        where = []
        for r in records:
            if self.out is None or self.at + len(r) > SHARD_BYTES and self.at:
                self.close()
                self.k += 1
                self.name, self.at = f"part-{self.part:06d}-{self.k:04d}.rec", 0
                self.temp = f"{self.folder}/.{self.name}.{uuid.uuid4().hex[:8]}"
                self.out = self.fs.open_output_stream(self.temp)
            self.out.write(r)
            where.append((self.name, self.at))
            self.at += len(r)
        return where

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.folder}/{self.name}")
            self.out = None


def write_records(docs: DataFrame, uri: str, tokenizer: str | None = None, end_id: int = END_ID,
                  partitions: int | None = None) -> DataFrame:
    """Write all documents under ``uri`` and return the index, itself written to ``uri``/index."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .withColumn("_h", F.xxhash64("text")))
    rows = rows.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").drop("_h")

    def write(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        shards = _Shards(uri, TaskContext.get().partitionId())
        for batch in light_batches(batches, "text", BATCH_BYTES):
            ids = batch.column("doc_id").to_pylist()
            tokens = [t + end for t in enc.encode(batch.column("text"))]
            records = frame([struct.pack("<Iq", enc.width | (NULL_ID if i is None else 0), i or 0) + t for i, t in zip(ids, tokens)])
            where = shards.add(records)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([s for s, _ in where], pa.string()), pa.array([o for _, o in where], pa.int64()),
                 pa.array([len(r) for r in records], pa.int64()), pa.array([len(t) // enc.width for t in tokens], pa.int64())],
                names=["doc_id", "shard", "offset", "length", "n_tokens"])
        shards.close()
        enc.rest()

    index = f"{uri.rstrip('/')}/index"
    rows.mapInArrow(write, INDEX).write.mode("overwrite").parquet(index)
    return spark.read.parquet(index)


def read_records(index: DataFrame, uri: str, partitions: int | None = None) -> DataFrame:
    """(doc_id, shard, offset, before, ids): every record, checked; ``before`` counts the ids that stand
    before it in its shard. One task reads a whole shard, in pieces of about READ_BYTES."""
    schema = "doc_id bigint, shard string, offset bigint, before bigint, ids binary, width int"
    return _by_shard(index, partitions).mapInArrow(lambda batches: _read(batches, uri), schema)


def _by_shard(index: DataFrame, partitions: int | None) -> DataFrame:
    n = partitions or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("shard", "offset", "length").repartition(n, "shard").sortWithinPartitions("shard", "offset")


def _read(batches, uri: str):
    """Arrow batches of index rows, sorted by shard and offset, to batches of records."""

    def pieces(batches):
        shard, some, held = None, [], 0
        for batch in batches:
            for s, o, length in zip(*[c.to_pylist() for c in batch.columns]):
                if some and (s != shard or held + length > READ_BYTES):
                    yield shard, some
                    some, held = [], 0
                shard = s
                some.append((o, length))
                held += length
        if some:
            yield shard, some

    def read(batches):
        fs, folder = _folder(uri)
        last, before, file = None, 0, None
        for shard, some in pieces(batches):
            if shard != last:
                last, before, file = shard, 0, fs.open_input_file(f"{folder}/{shard}")
            start = some[0][0]
            data = file.read_at(some[-1][0] + some[-1][1] - start, start)
            ids, widths, doc, counts = [], [], [], []
            for p in unframe(data, [(o - start, length) for o, length in some]):
                head, d = struct.unpack_from("<Iq", p)
                doc.append(None if head & NULL_ID else d)
                widths.append(head & 255)
                ids.append(p[12:])
                counts.append(before)
                before += len(ids[-1]) // widths[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array([shard] * len(some), pa.string()), pa.array([o for o, _ in some], pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(widths, pa.int32())],
                names=["doc_id", "shard", "offset", "before", "ids", "width"])

    yield from read(batches)


def describe(index: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, offset) read back from the files."""
    def rows(batches):
        for b in batches:
            n, crc = [], []
            for data, width in zip(b.column("ids").to_pylist(), b.column("width").to_pylist()):
                ids = np.frombuffer(data, dtype="<u2" if width == 2 else "<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "shard", "offset", "before")] + [pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "offset", "before", "n_tokens", "ids_crc32"])

    found = _by_shard(index, None).mapInArrow(
        lambda batches: rows(_read(batches, uri)), "doc_id bigint, shard string, offset bigint, before bigint, n_tokens bigint, ids_crc32 bigint")
    # one row per shard is all that this window orders
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_start"))
    starts = land(starts, "record-starts")
    return found.join(starts, "shard").select("doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard", "offset")


def write_and_describe(docs: DataFrame, spark: SparkSession, tokenizer: str | None = None) -> DataFrame:
    """The query's form: records go to a new folder under spark.checkpoint.dir and are read back."""
    uri = scratch_path(spark, "token-records")
    return describe(write_records(docs, uri, tokenizer), uri)
