"""Sources and sinks: tab-separated record files, truth files, pair files, experiment logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

RECORD = ["entity_id", "business_name", "business_address", "country"]


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED").option("quote", '"').option("escape", '"').option("nullValue", "\u0001").option("emptyValue", "").csv(path)


def fill_records(df: DataFrame) -> DataFrame:
    """The four columns as strings; missing columns and nulls are empty."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in RECORD])


def read_records(spark: SparkSession, path: str, most: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Records of a source file; ``most`` cuts before ``ids`` (entity_id) filters."""
    df = fill_records(_tsv(spark, path))
    df = df.limit(most) if most is not None else df
    return df.join(ids.select("entity_id"), "entity_id", "left_semi") if ids is not None else df


def split_ids(matched: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(matched, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def truth_pairs(df: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids) -> (sid, tid)."""
    return df.select(F.trim("source1_entity_id").alias("sid"), F.explode(split_ids(F.col("matched_entity_ids"))).alias("tid")).distinct()


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities (sid, n_true), pairs (sid, tid))."""
    raw = _tsv(spark, path)
    return raw.select(F.trim("source1_entity_id").alias("sid"), F.size(split_ids(F.col("matched_entity_ids"))).alias("n_true")), truth_pairs(raw)


def stream_records(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in RECORD])
    return spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("maxFilesPerTrigger", files_at_once).csv(path).fillna("")


def benchmark_subset(entities: DataFrame, targets: DataFrame, truth: DataFrame, n: int, ratio: int) -> tuple[DataFrame, DataFrame]:
    """The first n entities by id, all their true targets, and up to n * ratio / 2 others of each source, by id."""
    chosen = entities.orderBy("entity_id").limit(n)
    true = truth.join(chosen.select(F.col("entity_id").alias("sid")), "sid", "left_semi").select(F.col("tid").alias("entity_id")).distinct()
    src = F.substring_index("entity_id", "-", 1)
    rest = targets.join(true, "entity_id", "left_anti").withColumn("place", F.row_number().over(Window.partitionBy(src).orderBy("entity_id")))
    return chosen, targets.join(true, "entity_id", "left_semi").unionByName(rest.where(F.col("place") <= n * ratio // 2).drop("place"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """A keyed table in which a later row replaces an earlier one."""
    last = F.max_by(F.struct(*df.columns), F.col(order))
    return df.groupBy(F.col(key).alias("k_")).agg(last.alias("r")).select("r.*")


def id_lists(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sid, matched): the sorted ids of each entity, comma-joined; empty for entities without pairs."""
    joined = pairs.groupBy("sid").agg(F.array_join(F.array_sort(F.collect_set("tid")), ",").alias("matched"))
    return entities.select("sid").join(joined, "sid", "left").select("sid", F.coalesce("matched", F.lit("")).alias("matched"))


def write_pairs(entities: DataFrame, pairs: DataFrame, path: str, column: str = "matched_entity_ids", one_file: bool = False) -> None:
    """The two-column TSV, ordered by entity; a line is text, so nothing is quoted."""
    rows = id_lists(entities, pairs)
    head = rows.sparkSession.createDataFrame([("", f"source1_entity_id\t{column}")], "sid string, value string")
    lines = head.unionByName(rows.select("sid", F.concat_ws("\t", "sid", "matched").alias("value")))
    lines = lines.coalesce(1).sortWithinPartitions("sid") if one_file else lines.orderBy("sid")
    lines.select("value").write.mode("overwrite").text(path)


def clipped(prediction: Column, least: float, most: float) -> Column:
    """NaN and infinities become ``least``; the rest is clipped."""
    odd = prediction.isNull() | F.isnan(prediction) | (F.abs(prediction) == float("inf"))
    return F.when(odd, F.lit(least)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), prediction)))


def write_predictions(df: DataFrame, key: str, prediction: str, path: str, least: float = 0.0, most: float = 1e12) -> None:
    df.select(key, clipped(F.col(prediction), least, most).alias(prediction)).write.mode("overwrite").option("header", True).csv(path)


def log_experiment(spark: SparkSession, path: str, record: dict) -> str:
    """Appends a JSON line; returns the row of a Markdown table (bars become slashes)."""
    import json

    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").write.mode("append").text(path)
    return "| " + " | ".join(str(v).replace("|", "/") for _, v in sorted(record.items())) + " |"
