"""Tables between the steps of a run, in the folder that all executors share. A written table ends the lineage: later plans start
at a scan, and a lost executor costs a task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="resolva-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/resolva-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


_kept: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def kept(spark: SparkSession, key: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, written once per application and ``key`` and read from there by every later plan."""
    place = (spark.sparkContext.applicationId, key, name)
    if place not in _kept:
        df = make()
        _kept[place] = write(df, name), df.schema
    path, schema = _kept[place]
    return spark.read.schema(schema).parquet(path)


def forget() -> None:
    """Later calls of ``kept`` write anew."""
    _kept.clear()
