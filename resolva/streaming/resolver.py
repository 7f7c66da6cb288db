"""Incremental resolution: S1 records arrive as a stream and meet a static table of targets; the checkpoint is the resume
mechanism. A claims table keeps targets exclusive over batches: the first committed claim wins (in batch mode the best score wins)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.decide import exclusive


def resolve_stream(stream: DataFrame, match: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """``match`` makes accepted pairs (sid, tid, score) of a batch of records; they go to ``out``/batch=<id>.

    A batch that is run again after a failure overwrites its own folder and does not see its own earlier claims.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        accepted = exclusive(match(df))
        if batch_id and (earlier := claims(spark, out, batch_id)) is not None:
            accepted = accepted.join(earlier, "tid", "left_anti")
        accepted.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def claims(spark: SparkSession, out: str, before: int) -> DataFrame | None:
    try:
        done = spark.read.parquet(out)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return done.where(F.col("batch") < before).select("tid").distinct()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Beyond the matching itself: counts of events by tumbling window and type, for streams and tables alike."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
