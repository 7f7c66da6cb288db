"""Rules over input tables and result files. Every rule is a query; findings are rows (severity, rule, n, examples)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ID = r"^S[0-9]+-.+$"


def _finding(bad: DataFrame, severity: str, rule: str, example: str) -> DataFrame:
    # the first three ids by a top-k, so that a file of bad rows does not end in one array
    per = bad.groupBy(F.col(example).cast("string").alias("example")).agg(F.count("*").alias("c"))
    first = per.where("example is not null").orderBy("example").limit(3).agg(F.array_join(F.array_sort(F.collect_list("example")), ",").alias("examples"))
    counted = per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).where("n > 0")
    return counted.join(F.broadcast(first)).select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), "n", "examples")


def submission(rows: DataFrame, entities: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``rows`` (sid, matched: comma list) against the entities (sid) and, if given, the candidates in the same form."""
    split = rows.select("sid", F.explode(F.split("matched", ",")).alias("raw")).withColumn("tid", F.trim("raw")).where("tid <> ''")
    repeated = rows.groupBy("sid").agg(F.count("*").alias("c")).where("c > 1")
    found = [
        _finding(repeated, "error", "duplicate_rows", "sid"),
        _finding(split.groupBy("sid", "tid").agg(F.count("*").alias("c")).where("c > 1"), "error", "duplicate_ids", "sid"),
        _finding(split.where("tid = sid"), "error", "self_match", "sid"),
        _finding(split.where(~F.col("tid").rlike("^S[23]-")), "error", "bad_prefix", "tid"),
        _finding(entities.join(rows, "sid", "left_anti"), "error", "missing_entity", "sid"),
        _finding(rows.join(entities, "sid", "left_anti"), "error", "unknown_entity", "sid"),
    ]
    if candidates is not None:
        offered = candidates.select("sid", F.explode(F.split("matched", ",")).alias("raw")).select("sid", F.trim("raw").alias("tid"))
        found.append(_finding(split.join(offered, ["sid", "tid"], "left_anti"), "warning", "match_not_candidate", "sid"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def file_shape(lines: DataFrame, header: str) -> DataFrame:
    """``lines`` (value) of a TSV: wrong header, rows that are not two columns."""
    first = lines.where(F.col("value") == header).limit(1)
    spark = lines.sparkSession
    none = spark.range(1).join(first, how="left_anti", on=F.lit(True)).select(F.lit(header).alias("value"))
    odd = lines.where((F.size(F.split("value", "\t")) != 2) & (F.col("value") != ""))
    return _finding(none, "error", "header", "value").unionByName(_finding(odd, "error", "malformed_row", "value"))


def table_counts(df: DataFrame, key: str, target: str, columns: list[str]) -> DataFrame:
    """One row: rows, nulls of each column, duplicates after the first, invalid targets, in one aggregate."""
    t = F.col(target).cast("double")
    return df.agg(
        F.count("*").alias("n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in columns], (F.count(key) - F.countDistinct(key)).alias("duplicates"),
        F.count(F.when(F.isnan(t), 1)).alias("nan_target"), F.count(F.when(t < 0, 1)).alias("negative_target"), F.count(F.when(t == 0, 1)).alias("zero_target"),
    )
