"""Token ids in binary files: rANS containers in the order of doc_id.

``write`` puts documents in ascending doc_id order (null first; rows of one doc_id in the order of their text's hash) by a
range partitioning, encodes each and appends the end id. Each task packs its documents, in order, into segments of about
``SEGMENT`` ids; a segment is one container (see rans.py) with one frequency table over all of its ids, shared by its
blocks. Segments are rows (shard, seq, n_docs, n_tokens, doc_ids, lengths, payload) of Parquet files: Spark's writer commits
them, so a lost executor leaves no half file, and any store that Spark writes to will do. ``read`` needs those files only.

A null text is empty: its ids are the end id alone. A document longer than a segment makes a larger one; memory in a task is
bounded by the longest document or one segment. Repeated rows are written each. An empty table makes an empty store. Columns
other than doc_id and text are not read, whatever their names. The tokenizer's file is found by each worker for itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import rans
from .bpe import TOGETHER_BYTES, encoder, tokenizer_path
from .common import new_path, slices, text_bytes

END = 1
SEGMENT = 1 << 21

STORE = "shard int, seq int, n_docs long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, payload binary"
ARROW = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, segment: int = SEGMENT) -> None:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, seq = encoder(tokenizer or tokenizer_path()), TaskContext.get().partitionId(), 0
        ids, doc_ids, total = [], [], 0

        def packed() -> pa.RecordBatch:
            row = {"shard": shard, "seq": seq, "n_docs": len(doc_ids), "n_tokens": total, "doc_ids": doc_ids, "lengths": [len(x) for x in ids], "payload": rans.encode(np.concatenate(ids))}
            return pa.RecordBatch.from_pylist([row], ARROW)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, z in slices(texts, TOGETHER_BYTES):
                for doc_id, own in zip(names[a:z], coder.ids(texts[a:z])):
                    ids.append(np.append(own, own.dtype.type(end)))
                    doc_ids.append(doc_id)
                    total += len(own) + 1
                    if total >= segment:
                        yield packed()
                        ids, doc_ids, total, seq = [], [], 0, seq + 1
        if ids:
            yield packed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    # by the hash, too: null and repeated ids need not be one task's
    rows.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text").mapInArrow(run, STORE).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before."""
    store = spark.read.schema(STORE).parquet(path)
    totals = store.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    earlier = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = store.select("shard", "seq", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("before")).join(shards, "shard")
    starts = starts.select(F.col("shard").alias("s"), F.col("seq").alias("q"), (F.col("shard_start") + F.col("before")).alias("begin"))
    firsts = read_rows(store).select("shard", "seq", "doc_id", "offset", "n_tokens", "ids_crc32")
    placed = firsts.join(starts, (F.col("shard") == F.col("s")) & (F.col("seq") == F.col("q")))
    return placed.select("doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def read_rows(store: DataFrame) -> DataFrame:
    """One row a document, decoded from its segment: (shard, seq, doc_id, offset in the segment, n_tokens, ids_crc32)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, seq, doc_ids, lengths, payload = (batch.column(k)[i].as_py() for k in range(5))
                ids = rans.decode(payload)
                ends = np.cumsum(np.array(lengths, np.int64))
                if ends[-1] != len(ids):
                    raise ValueError(f"segment {shard}/{seq} holds {len(ids)} ids, not {ends[-1]}")
                offsets = ends - lengths
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets.tolist(), ends.tolist())]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(offsets), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["shard", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"])

    schema = "shard int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long"
    return store.select("shard", "seq", "doc_ids", "lengths", "payload").mapInArrow(run, schema)


def query(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    path = new_path(spark, "tokens")
    write(documents, path)
    return read(spark, path)
