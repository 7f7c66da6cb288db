"""Hard negatives: candidate pairs that are not matches but look like it, in quotas, chosen by a seeded hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

HARD = ["model_fp", "same_name_diff_addr", "same_addr_diff_name", "nearby_hnum_locality", "bm25_fp", "reverse_fp"]


def classify(sides: DataFrame, *, truth: DataFrame, least: float = 0.35) -> DataFrame:
    """``sides`` (sid, tid, s_*, t_* views, and optionally score, by_bm25_name, by_bm25_addr, by_reverse) -> (sid, tid, bucket) of the
    pairs that are no matches. Two empty names count as the same name."""
    col = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in sides.columns else F.lit(default)
    same_name = (F.col("s_n_clean") == F.col("t_n_clean")) | ((F.col("s_n_sorted") != "") & (F.col("s_n_sorted") == F.col("t_n_sorted")))
    same_addr = (F.col("s_a_clean") != "") & (F.col("s_a_clean") == F.col("t_a_clean"))
    near = (F.col("s_a_zip") != "") & (F.col("s_a_zip") == F.col("t_a_zip")) & (F.col("s_a_num") != "") & (F.col("t_a_num") != "") & (F.col("s_a_num") != F.col("t_a_num"))
    kind = (
        F.when(col("score", 0.0) >= least, "model_fp").when(same_name & (F.col("s_a_clean") != F.col("t_a_clean")), "same_name_diff_addr").when(same_addr & ~same_name, "same_addr_diff_name")
        .when(near, "nearby_hnum_locality").when((col("by_bm25_name", 0.0) == 1) | (col("by_bm25_addr", 0.0) == 1), "bm25_fp").when(col("by_reverse", 0.0) == 1, "reverse_fp").otherwise("general")
    )
    return sides.join(truth.select("sid", "tid"), ["sid", "tid"], "left_anti").select("sid", "tid", kind.alias("bucket"))


def mine(classified: DataFrame, n_true: int, per_positive: int = 15, seed: int = 42) -> DataFrame:
    """A quarter of the target for each hard bucket at most; general pairs fill up the rest."""
    target = max(100, n_true * per_positive)
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed), "sid", "tid"), "sid", "tid"))
    ranked = classified.withColumn("place", place)
    hard = ranked.where((F.col("bucket") != "general") & (F.col("place") <= target // 4))
    taken = hard.agg(F.count("*").alias("taken"))
    general = ranked.where((F.col("bucket") == "general") & (F.col("place") <= target)).join(taken).where(F.col("place") <= target - F.col("taken")).drop("taken")
    return hard.unionByName(general).drop("place")


def hardest_per_entity(pairs: DataFrame, *, truth: DataFrame, most: int = 4) -> DataFrame:
    """(sid, tid, ...): each entity's first negatives by agreement and best score."""
    place = F.row_number().over(Window.partitionBy("sid").orderBy(F.col("agreement").desc(), F.col("best_score").desc(), "tid"))
    return pairs.join(truth.select("sid", "tid"), ["sid", "tid"], "left_anti").withColumn("place", place).where(F.col("place") <= most)


def by_hardness(scored: DataFrame, *, truth: DataFrame) -> DataFrame:
    """``scored`` (sid, tid, name_seq, addr_seq, name_jaccard): all negatives of an entity if 8 or fewer, else the top
    max(4, min(0.6 n, 15)) and the 6 after them."""
    own = Window.partitionBy("sid")
    hardness = F.round(0.4 * F.col("name_seq") + 0.3 * F.col("addr_seq") + 0.3 * F.col("name_jaccard"), 9)
    left = scored.join(truth.select("sid", "tid"), ["sid", "tid"], "left_anti").withColumn("hardness", hardness)
    ranked = left.withColumn("n", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy(F.col("hardness").desc(), "tid")))
    top = F.greatest(F.lit(4), F.least(F.floor(0.6 * F.col("n")), F.lit(15)))
    return ranked.where((F.col("n") <= 8) | (F.col("place") <= top + 6)).drop("n", "place")
