"""What the operators share: table access, staged tables in the cluster's shared folder, Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python kernel works on at once; bounds its memory whatever the Arrow batch holds.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only where it is unset on one machine (tests, a laptop) is a temporary one
    chosen."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="resolva-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/resolva-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends here, so a lost executor costs one task, not the whole chain."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a staged table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps: executors delete them when the driver's references are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, want: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while want.lower() in have:
        want += "_"
    return want


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text is a range of its own, never cut."""
    start = size = 0
    for i, b in enumerate(texts):
        if size and size + len(b) > limit:
            yield start, i
            start, size = i, 0
        size += len(b)
    if start < len(texts):
        yield start, len(texts)
