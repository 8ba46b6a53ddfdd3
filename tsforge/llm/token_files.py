"""Token-id files: one array of ids over all documents in doc_id order, with Elias-Fano document bounds.

Texts are range-partitioned and sorted by doc_id and encoded in batches; every task writes its ids as a run of shards,
so shards in name order are documents in doc_id order. A shard holds

    ids        little-endian, 2 bytes each if the vocabulary allows, else 4
    bounds     Elias-Fano: end offset of each document in the shard
    doc_ids    Elias-Fano: doc_id of each document that has one
    footer     id width, documents without doc_id (they come first), byte places of bounds and doc_ids, magic

A shard is closed once it has SHARD_IDS ids, so no file or buffer grows with the input; only one document longer than
that makes a larger shard. Every attempt of a task writes under temporary names of its own and renames, and a repeated task
ends with the same names and bytes: neither lost executors nor a second attempt beside the first leave a half-written
shard under a valid name. `write_shards` returns the manifest,
one narrow row per shard. Executors reach the target folder with pyarrow.fs (local or shared file systems, HDFS, S3, GCS).

Reading back goes through Spark's binary file source; offsets inside a shard come from the select structure, and the
number of ids before a shard from the manifest.

Defined cases: a NULL text is empty; an empty text has only the end id; rows without doc_id come first; rows repeated
with one doc_id follow each other in the order of their texts; an empty table makes no shard and returns no row.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsforge.llm.common import small_batches, stored, task_count, text_or_empty
from tsforge.llm.elias_fano import EliasFano, encode
from tsforge.llm.fast_ids import word_ids
from tsforge.session import scratch_path

SHARD_IDS = 1 << 22
END_ID = 1
FOOTER = "<IQQQ8s"
MAGIC = b"TOKSHRD1"
MANIFEST = "part int, shard int, file string, n_documents long, n_ids long, n_bytes long"


class ShardWriter:
    """Collects the documents of one task and writes shards."""

    def __init__(self, folder: str, part: int, width: int, shard_ids: int, attempt: int = 0) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
        self.fs.create_dir(self.root, recursive=True)
        self.part, self.width, self.shard_ids, self.attempt, self.shard = part, width, shard_ids, attempt, 0
        self._empty()

    def _empty(self) -> None:
        self.ids: list[bytes] = []
        self.ends: list[int] = []
        self.doc_ids: list[int] = []
        self.n, self.without = 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> bool:
        """True if the shard is full now."""
        self.ids.append(ids)
        self.n += len(ids) // self.width
        self.ends.append(self.n)
        if doc_id is None:
            self.without += 1
        else:
            self.doc_ids.append(doc_id)
        return self.n >= self.shard_ids

    def close(self) -> dict | None:
        if not self.ends:
            return None
        name = f"part-{self.part:07d}-{self.shard:05d}.tok"
        bounds, docs = encode(np.array(self.ends)), encode(np.array(self.doc_ids, np.int64))
        at = self.n * self.width
        foot = struct.pack(FOOTER, self.width, self.without, at, at + len(bounds), MAGIC)
        parts = [*self.ids, bounds, docs, foot]
        own = f"{self.root}/_{name}.{self.attempt}.writing"
        with self.fs.open_output_stream(own) as out:
            for x in parts:
                out.write(x)
        self.fs.move(own, f"{self.root}/{name}")
        row = {
            "part": self.part, "shard": self.shard, "file": name, "n_documents": len(self.ends), "n_ids": self.n,
            "n_bytes": sum(map(len, parts)),
        }
        self.shard += 1
        self._empty()
        return row


def read_shard(data: bytes) -> tuple[np.ndarray, EliasFano, np.ndarray, int]:
    """ids, bounds, doc_ids of the documents that have one, number of documents without (they come first)."""
    width, without, bounds_at, docs_at, magic = struct.unpack_from(FOOTER, data, len(data) - struct.calcsize(FOOTER))
    if magic != MAGIC:
        raise ValueError("not a token shard")
    ids = np.frombuffer(data, f"<u{width}", bounds_at // width)
    docs = EliasFano(data, docs_at)
    return ids, EliasFano(data, bounds_at), docs.select(0, docs.n), without


def _writer(folder: str, tokenizer_path: str, end_id: int, shard_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = word_ids(tokenizer_path)
        width = 2 if encoder.code == "H" else 4
        end = end_id.to_bytes(width, "little")
        task = TaskContext.get()
        writer = ShardWriter(folder, task.partitionId(), width, shard_ids, task.taskAttemptId())
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer.add(doc_id, encoder.encode(text.as_py()) + end):
                    rows.append(writer.close())
            if rows:
                yield pa.RecordBatch.from_pylist(rows, manifest_schema())
        if last := writer.close():
            yield pa.RecordBatch.from_pylist([last], manifest_schema())

    return run


def manifest_schema() -> pa.Schema:
    ints = [(n, pa.int64()) for n in ("n_documents", "n_ids", "n_bytes")]
    return pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), *ints])


def write_shards(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID,
    shard_ids: int = SHARD_IDS, text: str = "text",
) -> tuple[str, DataFrame]:
    """Encode docs and write their shards; the folder and the manifest."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or scratch_path(spark, "token-files")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    tasks = task_count(rows)
    ordered = rows.repartitionByRange(tasks, "doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return folder, stored(ordered.mapInArrow(_writer(folder, tokenizer_path, end_id, shard_ids), MANIFEST), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids, bounds, doc_ids, without = read_shard(content.as_py())
            ends = bounds.select(0, bounds.n)
            starts = np.concatenate(([0], ends[:-1]))
            crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_pydict({
                "file": [path.rsplit("/", 1)[-1]] * len(ends),
                "doc_id": pa.array([None] * without + doc_ids.tolist(), pa.int64()),
                "local": pa.array(starts, pa.int64()),
                "n_tokens": pa.array(ends - starts, pa.int64()),
                "ids_crc32": pa.array(crcs, pa.int64()),
            })


def read_documents(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards."""
    spark = manifest.sparkSession
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row per shard
    bases = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # Shards are megabytes each: a few files a task, a few at once in memory.
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "content")
    read = files.mapInArrow(_reader, "file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    return read.join(bases, "file").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
