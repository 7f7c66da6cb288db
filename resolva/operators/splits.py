"""Leakage-safe folds and target encodings. Folds come from hashes, so a row's fold needs no other row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def fold(key: Column, k: int, seed: int = 42) -> Column:
    """Group folds: equal keys share one."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)).cast("int")


def stratified(df: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold``: the labels of each fold differ by one at most."""
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))


def stratified_groups(df: DataFrame, group: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold``: groups stay whole; groups with equal shares of positive labels are dealt out in turn."""
    per = df.groupBy(group).agg(F.round(F.avg(label), 2).alias("share"), F.count("*").alias("n"))
    order = Window.partitionBy("share").orderBy(F.col("n").desc(), F.xxhash64(F.lit(seed), group), group)
    return df.join(per.select(group, ((F.row_number().over(order) - 1) % k).cast("int").alias("fold")), group)


def target_encoding(df: DataFrame, category: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """(category, encoded): (sum + m * mean of all) / (n + m)."""
    mean = df.agg(F.avg(target).alias("mean"))
    per = df.groupBy(category).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    return per.join(mean).select(category, ((F.col("s") + smoothing * F.col("mean")) / (F.col("n") + smoothing)).alias("encoded"))


def oof_target_encoding(df: DataFrame, category: str, target: str, fold_column: str, smoothing: float = 10.0) -> DataFrame:
    """(category, fold, encoded) from the rows of all other folds: their sums are the totals less the fold's own, in one pass."""
    cell = df.groupBy(category, fold_column).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    per, folds, all_ = Window.partitionBy(category), Window.partitionBy(fold_column), Window.partitionBy()
    whole = cell.withColumn("os", F.sum("s").over(per) - F.col("s")).withColumn("on", F.sum("n").over(per) - F.col("n"))
    whole = whole.withColumn("mean", (F.sum("s").over(all_) - F.sum("s").over(folds)) / (F.sum("n").over(all_) - F.sum("n").over(folds)))
    return whole.select(category, fold_column, F.when(F.col("on") > 0, (F.col("os") + smoothing * F.col("mean")) / (F.col("on") + smoothing)).otherwise(F.col("mean")).alias("encoded"))


def group_baseline(df: DataFrame, category: str, target: str, how: str = "median") -> DataFrame:
    """(category, baseline): the group's median or mean; ``apply_baseline`` falls back on that of all."""
    f = F.median if how == "median" else F.avg
    return df.groupBy(category).agg(f(target).alias("baseline"))


def apply_baseline(df: DataFrame, baseline: DataFrame, train: DataFrame, category: str, target: str, how: str = "median") -> DataFrame:
    f = F.median if how == "median" else F.avg
    return df.join(baseline, category, "left").join(train.agg(f(target).alias("of_all"))).withColumn("baseline", F.coalesce("baseline", "of_all")).drop("of_all")
