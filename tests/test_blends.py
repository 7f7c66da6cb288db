"""Weights, gates and cross-validation."""

import pytest
from pyspark.sql import functions as F

from resolva.operators import models


def test_alpha_by_f05(spark):
    df = spark.createDataFrame([("a", "x", 0.9, 0.1), ("a", "y", 0.1, 0.9), ("b", "z", 0.8, 0.2)], "sid string, tid string, p1 double, p2 double")
    truth, ents = spark.createDataFrame([("a", "x"), ("b", "z")], "sid string, tid string"), spark.createDataFrame([("a",), ("b",), ("c",)], "sid string")
    assert models.alpha_by_f05(df, "p1", "p2", ents, truth) == pytest.approx(0.7)  # the first weight at which 0.2 + 0.6 w reaches 0.6


def test_learned_gate_and_cross_validation(spark):
    rows = spark.range(80).select(F.col("id").cast("string").alias("sid"), (F.col("id") % 10 / 10).alias("top"), ((F.col("id") % 10) >= 5).cast("int").alias("label"))
    gated = models.learned_gate(rows, ["top"], "label", 2)
    assert gated.count() == 80 and gated.where("(score >= 0.5) <> (label = 1)").count() <= 8
    folded = rows.withColumn("fold", F.col("sid").cast("int") % 2)
    out, fitted = models.cross_validated(folded, "label", 2, lambda t: t.agg(F.avg("label")).first()[0], lambda m, t: t.withColumn("prediction", F.lit(m)))
    assert len(fitted) == 2 and out.count() == 80
