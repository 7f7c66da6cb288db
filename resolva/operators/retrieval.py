"""Multi-channel retrieval with provenance: hits are one long table (sid, tid, channel, rank, score), rolled up per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import CHANNELS

BUCKET = 35
RARE_BUCKET = 20
PROBE_MAX = 150
BM25_TOP = 25
K1, B = 1.2, 0.75
STOP_DF = 300
BUDGET, AMBIGUOUS_BUDGET, EXACT_BUDGET = 60, 120, 25
NO_KEYS = "cast(array() as array<struct<kind:string,key:string,channel:string,base:double>>)"


def _entry(kind: str, key: Column, channel: str = "", base: float = 0.0, when: Column | None = None) -> Column:
    good = key != "" if when is None else when & (key != "")
    return F.when(good, F.array(F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(channel).alias("channel"), F.lit(base).alias("base")))).otherwise(F.expr(NO_KEYS))


def _each(kind: str, values: Column, channel: str = "", base: float = 0.0) -> Column:
    return F.transform(values, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"), F.lit(channel).alias("channel"), F.lit(base).alias("base")))


def _pin(views_alias: str = "") -> tuple[Column, Column]:
    return F.concat_ws("|", "a_zip", "a_num"), (F.col("a_zip") != "") & (F.col("a_num") != "")


def _missing() -> Column:
    return F.transform(F.slice("a_salient", 1, 2), lambda s: F.when(F.col("a_num") != "", F.concat_ws("_", s, F.col("a_num"))).otherwise(s))


def index(targets: DataFrame) -> DataFrame:
    """(country, kind, key, tid, rank): bucket members in id order, capped. The cap is a row_number filter, which Spark pushes
    below the shuffle."""
    pin, has_pin = _pin()
    longest = F.reduce("n_tokens", F.lit(""), lambda best, t: F.when(F.char_length(t) > F.char_length(best), t).otherwise(best))
    rare = F.when((F.size("n_tokens") >= 2) & (F.char_length(longest) >= 6), longest).otherwise("")
    every = F.concat(
        _entry("name", F.col("n_clean")), _entry("name", F.col("n_legal")), _entry("name", F.col("n_sorted")), _entry("name", F.col("n_romanized")),
        _entry("addr", F.col("a_clean")), _entry("pin", pin, when=has_pin), _entry("rare", rare),
        F.when(F.col("n_clean") == "", _each("missing", _missing())).otherwise(F.expr(NO_KEYS)),
    )
    spread = targets.select(F.col("id").alias("tid"), "country", F.explode(F.array_distinct(F.transform(every, lambda e: F.struct(e["kind"].alias("kind"), e["key"].alias("key"))))).alias("e")).select("tid", "country", "e.kind", "e.key")
    rank = F.row_number().over(Window.partitionBy("country", "kind", "key").orderBy("tid"))
    return spread.withColumn("rank", rank).where((F.col("rank") <= RARE_BUCKET) | ((F.col("kind") != "rare") & (F.col("rank") <= BUCKET))).withColumn("rank", F.col("rank") - 1)


def probes(entities: DataFrame) -> DataFrame:
    pin, has_pin = _pin()
    every = F.concat(
        _entry("name", F.col("n_clean"), "exact_name", 1.0),
        _entry("name", F.col("n_legal"), "exact_name", 0.95, F.col("n_legal") != F.col("n_clean")),
        _entry("name", F.col("n_sorted"), "exact_name", 0.90, F.col("n_sorted") != F.col("n_clean")),
        _entry("name", F.col("n_romanized"), "cross_script", 0.85),
        _entry("addr", F.col("a_clean"), "exact_addr", 0.95),
        _entry("pin", pin, "numeric_loc", 0.80, has_pin),
        _entry("pin", pin, "sibling", 0.65, has_pin),
        _each("rare", F.filter("n_tokens", lambda t: F.char_length(t) >= 6), "rare_token", 0.85),
        F.when((F.col("n_clean") == "") & (F.col("a_clean") != ""), _each("missing", _missing(), "missing_field", 0.70)).otherwise(F.expr(NO_KEYS)),
    )
    return entities.select(F.col("id").alias("sid"), "country", F.explode(every).alias("e")).select("sid", "country", "e.*")


def bm25(entities: DataFrame, targets: DataFrame, tokens: str = "n_tokens", top: int = BM25_TOP) -> DataFrame:
    """(sid, tid, rank, score): the best ``top`` targets of each entity. Repeated query tokens count repeatedly."""
    docs = targets.select(F.col("id").alias("tid"), "country", tokens)
    size = docs.groupBy("country").agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens)).alias("avg_len"))
    terms = docs.select("tid", "country", F.size(tokens).alias("len"), F.explode(tokens).alias("token")).groupBy("tid", "country", "len", "token").agg(F.count("*").alias("tf"))
    df = terms.groupBy("country", "token").agg(F.count("*").alias("df")).where(F.col("df") <= STOP_DF)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = df.join(size, "country").select("country", "token", "avg_len", idf.alias("idf")).where("idf > 0")
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1.0))))
    posted = terms.join(weight, ["country", "token"]).select("country", "token", "tid", (F.col("idf") * part).alias("w"))
    asked = entities.select(F.col("id").alias("sid"), "country", F.explode(tokens).alias("token")).groupBy("sid", "country", "token").agg(F.count("*").alias("q"))
    # the sum in a fixed order of exact decimals, so that a rerun ranks alike
    summed = asked.join(posted, ["country", "token"]).groupBy("sid", "tid").agg(F.sum((F.col("q") * F.col("w")).cast("decimal(28,12)")).cast("double").alias("score"))
    place = F.row_number().over(Window.partitionBy("sid").orderBy(F.col("score").desc(), "tid"))
    return summed.withColumn("rank", place).where(F.col("rank") <= top).withColumn("rank", F.col("rank") - 1).select("sid", "tid", "rank", "score")


def hits(entities: DataFrame, targets: DataFrame, use_bm25: bool = True) -> DataFrame:
    """(sid, tid, channel, rank, score): for each channel the lowest rank and that hit's score; reverse included."""
    posted = index(targets)
    met = probes(entities).join(posted, ["country", "kind", "key"]).where(F.col("rank") < PROBE_MAX)
    bucket = posted.where("kind = 'pin'").groupBy("country", "kind", "key").agg(F.count("*").alias("n")).where("n > 20").drop("n").withColumn("channel", F.lit("sibling"))
    met = met.join(bucket, ["country", "kind", "key", "channel"], "left_anti")
    scored = met.select("sid", "tid", "channel", "rank", (F.col("base") / (1 + 0.05 * F.col("rank"))).alias("score"), (F.col("base") == 1.0).alias("clean"))
    name = scored.where("channel = 'exact_name' and clean").select("sid", "tid", "rank")
    both = name.join(scored.where("channel = 'exact_addr'").select("sid", "tid"), ["sid", "tid"])
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy("rank", "tid")) - 1).select("sid", "tid", F.lit("exact_both").alias("channel"), "rank", (1 / (1 + 0.05 * F.col("rank"))).alias("score"))
    every = scored.drop("clean").unionByName(both)
    if use_bm25:
        for column, channel in (("n_tokens", "bm25_name"), ("a_tokens", "bm25_addr")):
            every = every.unionByName(bm25(entities, targets, column).withColumn("channel", F.lit(channel)))
    best = every.groupBy("sid", "tid", "channel").agg(F.min(F.struct("rank", (-F.col("score")).alias("minus"))).alias("b")).select("sid", "tid", "channel", "b.rank", (-F.col("b.minus")).alias("score"))
    return best.unionByName(reverse(best.select("sid", "tid").distinct(), entities, targets))


def reverse(pairs: DataFrame, entities: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs whose target would find the entity: on one country a predicate on the pair, no second index."""
    seen = ["country", "n_clean", "n_sorted", "a_clean", "a_zip", "a_num"]
    s = entities.select(F.col("id").alias("sid"), *[F.col(c).alias(f"s_{c}") for c in seen])
    t = targets.select(F.col("id").alias("tid"), *[F.col(c).alias(f"t_{c}") for c in seen])
    same = lambda c: (F.col(f"t_{c}") != "") & (F.col(f"t_{c}") == F.col(f"s_{c}"))
    back = (F.col("s_country") == F.col("t_country")) & (same("n_clean") | same("n_sorted") | same("a_clean") | (same("a_zip") & same("a_num")))
    return pairs.join(s, "sid").join(t, "tid").where(back).select("sid", "tid", F.lit("reverse").alias("channel"), F.lit(0).alias("rank"), F.lit(1.0).alias("score"))


def provenance(found: DataFrame) -> DataFrame:
    """``found`` (hits) -> per pair: channel flags, agreement, best and second rank and score, gaps, reciprocal rank, two-way flag."""
    flags = [F.max(F.when(F.col("channel") == c, 1.0).otherwise(0.0)).alias(f"by_{c}") for c in CHANNELS]
    rolled = found.groupBy("sid", "tid").agg(*flags, F.count("*").alias("agreement"), F.array_sort(F.collect_list("rank")).alias("ranks"), F.sort_array(F.collect_list("score"), False).alias("scores"))
    rank = lambda k: F.try_element_at("ranks", F.lit(k))
    second = F.coalesce(rank(2), rank(1))
    score2 = F.coalesce(F.try_element_at("scores", F.lit(2)), F.lit(0.0))
    return rolled.select(
        "sid", "tid", *[f"by_{c}" for c in CHANNELS], F.col("agreement").cast("double").alias("agreement"), rank(1).cast("double").alias("best_rank"), second.cast("double").alias("second_rank"),
        (second - rank(1)).cast("double").alias("rank_gap"), F.element_at("scores", 1).alias("best_score"), score2.alias("second_score"), (F.element_at("scores", 1) - score2).alias("score_gap"),
        (1 / (1 + rank(1))).alias("reciprocal_rank"), F.when((F.col("by_reverse") == 1) & (F.col("agreement") > 1), 1.0).otherwise(0.0).alias("two_way"),
    )


def budget_cut(rolled: DataFrame, entities: DataFrame) -> DataFrame:
    """The best pairs of each entity within its budget, by agreement, best score, best rank, id."""
    seen = F.col("country").isin("us", "in", "india")
    wide = (F.col("n_clean") == "") | (F.col("a_clean") == "") | ~seen
    budgets = entities.select(F.col("id").alias("sid"), F.when(wide, AMBIGUOUS_BUDGET).otherwise(BUDGET).alias("budget"))
    own = Window.partitionBy("sid")
    exact = F.max("by_exact_both").over(own)
    place = F.row_number().over(own.orderBy(F.col("agreement").desc(), F.col("best_score").desc(), "best_rank", "tid"))
    cut = rolled.join(budgets, "sid").withColumn("place", place).withColumn("exact", exact)
    return cut.where(F.col("place") <= F.when(F.col("exact") == 1, F.least("budget", F.lit(EXACT_BUDGET))).otherwise(F.col("budget"))).drop("budget", "exact")
