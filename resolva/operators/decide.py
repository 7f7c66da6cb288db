"""From scored pairs (sid, tid, score) to accepted pairs. Every policy is a window over one key and breaks ties by id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


@dataclass(frozen=True)
class Policy:
    match: float = 0.65
    singleton: float = 0.55
    margin: float = 0.20
    most: int = 10


def _ranked(scored: DataFrame) -> DataFrame:
    own = Window.partitionBy("sid")
    return scored.withColumn("place", F.row_number().over(own.orderBy(F.col("score").desc(), "tid"))).withColumn("top", F.max("score").over(own))


def precision_policy(scored: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The top pair and those within the margin of it, if the top is good enough; up to ``most``."""
    good = (F.col("top") >= policy.singleton) & (F.col("top") >= policy.match)
    near = F.col("score") >= F.greatest(F.lit(policy.match), F.col("top") - policy.margin)
    return _ranked(scored).where(good & (F.col("place") <= policy.most) & ((F.col("place") == 1) | near)).select("sid", "tid", "score")


def expected_f05(scored: DataFrame, most: int = 8, least: float = 0.25, empty_below: float = 0.45) -> DataFrame:
    """The first m candidates by score, m chosen to make the expected F0.5 greatest (the smallest such m)."""
    own = Window.partitionBy("sid")
    running = own.orderBy(F.col("score").desc(), "tid").rowsBetween(Window.unboundedPreceding, 0)
    ranked = _ranked(scored).withColumn("sum", F.sum("score").over(running)).withColumn("total", F.greatest(F.sum("score").over(own), F.lit(1.0)))
    p, r = F.col("sum") / F.col("place"), F.col("sum") / F.col("total")
    value = F.when((F.col("place") <= most) & (F.col("score") >= least) & (F.col("top") >= empty_below), 1.25 * p * r / (0.25 * p + r))
    chosen = ranked.withColumn("value", F.round(value, 12)).withColumn("best", F.max(F.struct("value", (-F.col("place")).alias("minus"))).over(own))
    return chosen.where(F.col("value").isNotNull() & (F.col("place") <= -F.col("best.minus"))).select("sid", "tid", "score")


def exclusive(accepted: DataFrame) -> DataFrame:
    """Each target only for the entity that scores it highest, over all pairs there are."""
    own = Window.partitionBy("tid").orderBy(F.col("score").desc(), "sid")
    return accepted.withColumn("claim", F.row_number().over(own)).where("claim = 1").drop("claim")


def source_partition(accepted: DataFrame) -> DataFrame:
    """Of entities with more than one match: the best of each source, one of any other."""
    kind = F.when(F.upper("tid").rlike("^(S2|SOURCE2)"), 2).when(F.upper("tid").rlike("^(S3|SOURCE3)"), 3).otherwise(0)
    own = Window.partitionBy("sid", "kind").orderBy(F.col("score").desc(), "tid")
    return accepted.withColumn("kind", kind).withColumn("place", F.row_number().over(own)).where("place = 1").drop("kind", "place")


def without_contradictions(accepted: DataFrame, entities: DataFrame, targets: DataFrame, far: int = 500) -> DataFrame:
    """Drops pairs of different known countries, and of different streets whose house numbers lie far apart."""
    side = lambda df, p, k: df.select(F.col("id").alias(k), F.col("country").alias(f"{p}_c"), F.col("a_num").alias(f"{p}_n"), F.col("a_sal").alias(f"{p}_s"))
    both = accepted.join(side(entities, "x", "sid"), "sid").join(side(targets, "y", "tid"), "tid")
    abroad = (F.col("x_c") != "unknown") & (F.col("y_c") != "unknown") & (F.col("x_c") != F.col("y_c"))
    apart = F.abs(F.col("x_n").try_cast("long") - F.col("y_n").try_cast("long")) > far
    elsewhere = (F.col("x_s") != "") & (F.col("y_s") != "") & (F.col("x_s") != F.col("y_s")) & F.coalesce(apart, F.lit(False))
    return both.where(~abroad & ~elsewhere).select(*accepted.columns)


def abstention_gate(scored: DataFrame) -> DataFrame:
    """(sid, abstain): top score, best name overlap, best number overlap and margin all weak. ``scored`` has jaccard and number."""
    per = singleton_features(scored)
    return per.select("sid", ((F.col("top") < 0.48) & (F.col("max_jaccard") < 0.55) & (F.col("max_number") < 0.5) & (F.col("margin") < 0.08)).alias("abstain"))


def close_race_gate(scored: DataFrame, match: float = Policy.match) -> DataFrame:
    """(sid, abstain): a weak top with a strong second right behind."""
    per = singleton_features(scored)
    return per.select("sid", ((F.col("top") < match + 0.12) & (F.col("margin") < 0.035) & (F.col("top") - F.col("margin") > 0.35)).alias("abstain"))


def singleton_features(scored: DataFrame) -> DataFrame:
    """One row per entity: what its candidate list looks like. ``scored``: sid, tid, score, jaccard, number, addr."""
    # the deviation from sums of whole billionths: the same whatever the order of rows
    n, i = F.count("*").cast("decimal(12,0)"), F.round(F.col("score") * 1_000_000_000).cast("long")
    exact = n * F.sum((i * i).cast("decimal(19,0)")).cast("decimal(24,0)") - F.sum(i).cast("decimal(18,0)") * F.sum(i).cast("decimal(18,0)")
    spread = F.sqrt(exact.cast("double")) / F.count("*") / 1_000_000_000.0
    return scored.groupBy("sid").agg(
        F.max("score").alias("top"), F.avg("score").alias("mean"), spread.alias("spread"),
        (F.max("score") - F.coalesce(F.try_element_at(F.sort_array(F.collect_list("score"), False), F.lit(2)), F.lit(0.0))).alias("margin"),
        F.count("*").alias("n"), F.count(F.when(F.col("score") >= 0.3, 1)).alias("n_30"), F.count(F.when(F.col("score") >= 0.4, 1)).alias("n_40"),
        F.max("jaccard").alias("max_jaccard"), F.avg("jaccard").alias("mean_jaccard"), F.max("number").alias("max_number"), F.max("addr").alias("max_addr"), F.avg("addr").alias("mean_addr"),
    )


def policy_grid(scored: DataFrame, truth: DataFrame, entities: DataFrame, match: list[float], singleton: list[float], margin: list[float]) -> DataFrame:
    """(match, singleton, margin, f05) of every grid point, in one job: entities are rolled up to what a policy looks at, then met
    by the small literal grid. The first point with the greatest f05 is the choice."""
    spark: SparkSession = scored.sparkSession
    points = [(i, a, b, c) for i, (a, b, c) in enumerate((a, b, c) for a in match for b in singleton for c in margin)]
    grid = spark.createDataFrame(points, "point int, match double, singleton double, margin double")
    n_true = truth.groupBy("sid").agg(F.count("*").alias("n_true"))
    marked = _ranked(scored).join(truth.select("sid", "tid", F.lit(1).alias("hit")), ["sid", "tid"], "left")
    own = F.collect_list(F.struct("place", "score", F.coalesce("hit", F.lit(0)).alias("hit")))
    per = entities.select(F.col("id").alias("sid")).join(n_true, "sid", "left").join(marked.where("place <= 10").groupBy("sid").agg(own.alias("own"), F.max("top").alias("top")), "sid", "left")
    kept = F.when((F.col("top") >= F.col("singleton")) & (F.col("top") >= F.col("match")), F.filter("own", lambda x: (x["place"] == 1) | (x["score"] >= F.greatest(F.col("match"), F.col("top") - F.col("margin")))))
    met = per.join(F.broadcast(grid)).select("point", "match", "singleton", "margin", F.coalesce("n_true", F.lit(0)).alias("n_true"), kept.alias("kept"))
    counted = met.select("*", F.when(F.col("kept").isNull(), 0).otherwise(F.size("kept")).alias("n_pred"), F.coalesce(F.aggregate("kept", F.lit(0), lambda s, x: s + x["hit"]), F.lit(0)).alias("tp"))
    from .metrics import f_beta

    value = F.when(F.col("n_true") == 0, F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)).otherwise(f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true")))
    return counted.groupBy("point", "match", "singleton", "margin").agg(F.avg(value).alias("f05"))
