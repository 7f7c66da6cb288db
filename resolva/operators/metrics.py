"""Matching metrics. Truth and predictions are pair tables (sid, tid); the entities to score are given: they keep those without pairs.

All functions take truth and predictions by keyword only: exchanging them would turn F0.5 into F2 without an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def f_beta(tp: Column, n_pred: Column, n_true: Column, beta: float = 0.5) -> Column:
    p, r, b = tp / n_pred, tp / n_true, beta * beta
    return F.when((tp == 0) | (n_pred == 0) | (n_true == 0), 0.0).otherwise((1 + b) * p * r / (b * p + r))


def entity_scores(entities: DataFrame, *, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """``entities`` (sid, any others) -> with n_true, n_pred, tp, fp, fn, precision, recall, f05."""
    pairs = truth.select("sid", "tid").distinct().withColumn("t", F.lit(1)).join(predicted.select("sid", "tid").distinct().withColumn("p", F.lit(1)), ["sid", "tid"], "full")
    per = pairs.groupBy("sid").agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count(F.when(F.col("t") == F.col("p"), 1)).alias("tp"))
    full = entities.join(per, "sid", "left").fillna(0, ["n_true", "n_pred", "tp"])
    tp, n_pred, n_true = F.col("tp"), F.col("n_pred"), F.col("n_true")
    alone = F.when(n_pred == 0, 1.0).otherwise(0.0)
    return full.select(
        "*", (n_pred - tp).alias("fp"), (n_true - tp).alias("fn"),
        F.when(n_true == 0, alone).when(tp == 0, 0.0).otherwise(tp / n_pred).alias("precision"), F.when(n_true == 0, alone).when(tp == 0, 0.0).otherwise(tp / n_true).alias("recall"),
        F.when(n_true == 0, alone).otherwise(f_beta(tp, n_pred, n_true)).alias("f05"),
    )


def bucket(n_true: Column) -> Column:
    return F.when(n_true == 0, "0").when(n_true == 1, "1").when(n_true <= 3, "2-3").otherwise("4+")


def summary(scores: DataFrame) -> DataFrame:
    """``entity_scores`` with country -> one row for all, each country and each size of the truth, by grouping sets."""
    marked = scores.withColumn("bucket", bucket(F.col("n_true")))
    alone = F.col("n_true") == 0
    return marked.groupingSets([[], ["country"], ["bucket"]], "country", "bucket").agg(
        F.count("*").alias("n"), F.avg("f05").alias("f05"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg(F.when(alone, F.col("f05"))).alias("singleton_accuracy"), F.avg(F.when(~alone, F.col("f05"))).alias("matched_f05"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count(F.when(alone & (F.col("n_pred") > 0), 1)).alias("false_merges"),
    )


def slices(scores: DataFrame) -> DataFrame:
    """``entity_scores`` with country, n_clean, a_clean, n_is_indic -> (slice, n, f05): six overlapping slices."""
    tags = {
        "missing_name": F.col("n_clean") == "", "missing_address": F.col("a_clean") == "", "indic": F.col("n_is_indic"),
        "foreign": ~F.col("country").isin("us", "unknown"), "multi_match": F.col("n_true") >= 2, "singleton": F.col("n_true") == 0,
    }
    tagged = scores.select("f05", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tags.items()]), lambda x: x.isNotNull())).alias("slice"))
    return tagged.groupBy("slice").agg(F.count("*").alias("n"), F.avg("f05").alias("f05"))


def error_taxonomy(scores: DataFrame, sides: DataFrame, *, truth: DataFrame, predicted: DataFrame, candidates: DataFrame, match: float = 0.65) -> DataFrame:
    """(class, n, lost, share, cumulative): what each kind of error costs. ``sides`` (id, n_raw, a_raw); candidates (sid, tid, score)."""
    one = lambda df, c: df.select("sid", "tid").distinct().withColumn(c, F.lit(1))
    bad = scores.where("f05 < 1 - 1e-6").select("sid", "n_true", (1 - F.col("f05")).alias("deficit"), "fp", "fn")
    alone = bad.where("n_true = 0").select(F.lit("singleton_false_merge").alias("class"), F.col("deficit").alias("lost"))
    both = one(truth, "t").join(one(predicted, "p"), ["sid", "tid"], "full").where("t is null or p is null")
    wrong = both.join(bad.where("n_true > 0"), "sid").join(candidates.select("sid", "tid", "score"), ["sid", "tid"], "left")
    names = sides.select(F.col("id").alias("tid"), F.col("n_raw").alias("tn"), F.col("a_raw").alias("ta")), sides.select(F.col("id").alias("sid"), F.col("n_raw").alias("sn"), F.col("a_raw").alias("sa"))
    full = wrong.join(names[1], "sid").join(names[0], "tid", "left")
    other = lambda c: F.coalesce(F.col(c).rlike(r"[^\x00-\x7F]"), F.lit(False))
    gone = lambda c: F.coalesce(F.lower(F.trim(c)).isin("", "nan", "none", "null"), F.lit(True))
    same = lambda a, b: (F.coalesce(a, F.lit("")) != "") & (F.lower(a) == F.lower(b))
    kind = (
        F.when(F.col("p").isNull() & F.col("score").isNull(), F.when(other("sn") | other("tn"), "blocker_miss_transliteration").when(gone("sa") | gone("ta"), "blocker_miss_missing_address").otherwise("blocker_miss_lexical"))
        .when(F.col("p").isNull(), F.when(F.col("score") >= match, "margin_gate_cut").otherwise("model_under_threshold"))
        .when(same(F.col("sa"), F.col("ta")), "address_collision").when(same(F.col("sn"), F.col("tn")), "name_collision").otherwise("hard_negative")
    )
    each = full.select(kind.alias("class"), (F.col("deficit") / F.greatest(F.col("fp") + F.col("fn"), F.lit(1))).alias("lost")).unionByName(alone)
    rolled = each.groupBy("class").agg(F.count("*").alias("n"), F.sum("lost").alias("lost"))
    all_ = Window.partitionBy()
    order = Window.orderBy(F.col("lost").desc(), "class").rowsBetween(Window.unboundedPreceding, 0)
    return rolled.withColumn("share", 100 * F.col("lost") / F.sum("lost").over(all_)).withColumn("cumulative", F.sum("share").over(order))


def truth_structure(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: entities without match, with matches in both sources or one only, mean counts."""
    two = F.col("tid").startswith("S2")
    per = entities.join(truth.groupBy("sid").agg(F.count(F.when(two, 1)).alias("s2"), F.count(F.when(~two, 1)).alias("s3")), "sid", "left").fillna(0, ["s2", "s3"])
    return per.agg(F.count("*").alias("n"), F.count(F.when((F.col("s2") == 0) & (F.col("s3") == 0), 1)).alias("none"), F.count(F.when((F.col("s2") > 0) & (F.col("s3") > 0), 1)).alias("both"), F.count(F.when((F.col("s2") > 0) & (F.col("s3") == 0), 1)).alias("only_s2"), F.count(F.when((F.col("s2") == 0) & (F.col("s3") > 0), 1)).alias("only_s3"), F.avg("s2").alias("mean_s2"), F.avg("s3").alias("mean_s3"))


def regression(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: mae, rmse, smape (per cent)."""
    a, p = F.col(actual), F.col(predicted)
    size = (F.abs(a) + F.abs(p)) / 2
    return df.agg(F.avg(F.abs(a - p)).alias("mae"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"), (100 * F.avg(F.when(size == 0, 0.0).otherwise(F.abs(a - p) / size))).alias("smape"))


def blend_losses(df: DataFrame, label: str, one: str, two: str, steps: int = 10, eps: float = 1e-15) -> DataFrame:
    """(alpha, loss): log loss of alpha * one + (1 - alpha) * two for alpha = 0 .. 1, in one aggregate."""
    alphas = F.explode(F.array(*[F.lit(k / steps) for k in range(steps + 1)])).alias("alpha")
    mixed = df.select(F.col(label).alias("y"), F.col(one).alias("a"), F.col(two).alias("b"), alphas)
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("alpha") * F.col("a") + (1 - F.col("alpha")) * F.col("b")))
    return mixed.groupBy("alpha").agg(F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("loss"))
