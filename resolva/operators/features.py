"""The 96 features of a candidate pair: 86 of the pair, 4 of its peers, 6 of its context. All built in but for four string
ratios, which run as Arrow UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import similarity as S
from ..functions.constants import CHANNELS

PROVENANCE = [*[f"by_{c}" for c in CHANNELS], "agreement", "best_rank", "second_rank", "rank_gap", "best_score", "second_score", "score_gap", "reciprocal_rank", "two_way"]
NEUTRAL = {"agreement": 1.0, "best_score": 0.5, "score_gap": 0.5, "reciprocal_rank": 1.0}

NAME = ["name_raw", "name_clean", "name_legal", "name_compact", "name_seq", "name_jw", "name_jaccard", "name_overlap", "name_containment", "name_sort", "name_set", "name_grams3", "name_grams4", "name_prefix", "name_suffix", "name_first", "name_last", "name_acronym", "name_len_diff", "name_len_ratio", "name_count_diff", "name_translit", "name_missing", "name_number"]
ADDRESS = ["addr_raw", "addr_clean", "addr_seq", "addr_jw", "addr_jaccard", "addr_overlap", "addr_salient", "addr_set", "addr_grams3", "postal", "postal_prefix", "house", "house_abs", "house_rel", "house_digits", "city", "state", "locality", "agree", "conflict", "addr_len_diff", "addr_missing", "addr_numbers"]
NUMERIC = ["num_shared", "num_jaccard", "num_sequence", "num_house", "num_apart", "num_postal", "num_only", "num_conflict"]
CROSS = ["x_product", "x_harmonic", "x_min", "x_max", "x_diff", "x_name_addr", "x_house_name", "x_name_number", "x_country", "is_s2", "is_s3"]
PAIR = [*NAME, *ADDRESS, *NUMERIC, *PROVENANCE, *CROSS]
CONSENSUS = ["has_peer", "peer_jaccard", "peer_number", "peer_score"]
CONTEXT = ["density", "single_candidate", "competition", "single_claimant", "target_margin", "house_support"]
ALL = [*PAIR, *CONSENSUS, *CONTEXT]


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def with_sides(pairs: DataFrame, entities: DataFrame, targets: DataFrame) -> DataFrame:
    """``pairs`` with the views of both records as ``s_*`` and ``t_*``."""
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    return pairs.join(side(entities, "s"), F.col("sid") == F.col("s_id")).join(side(targets, "t"), F.col("tid") == F.col("t_id"))


def _both(name: str) -> tuple[Column, Column]:
    return F.col(f"s_{name}"), F.col(f"t_{name}")


def _same(name: str) -> Column:
    s, t = _both(name)
    return flag((s != "") & (s == t))


def with_ratios(sides: DataFrame) -> DataFrame:
    """Adds name_jw, name_sort, name_set, addr_jw, addr_set in one pass of Arrow batches, without a shuffle."""
    words = lambda c: F.array_join(c, " ")
    return sides.select(
        "*", S.jaro_winkler("s_n_clean", "t_n_clean").alias("name_jw"), S.token_sort_ratio(words("s_n_tokens"), words("t_n_tokens")).alias("name_sort"), S.token_set_ratio(words("s_n_tokens"), words("t_n_tokens")).alias("name_set"),
        S.jaro_winkler("s_a_clean", "t_a_clean").alias("addr_jw"), S.token_set_ratio(words("s_a_tokens"), words("t_a_tokens")).alias("addr_set"),
    )


def pair_features(sides: DataFrame, ratios: bool = True) -> DataFrame:
    """``with_sides`` (and provenance columns, if there are) -> sid, tid and the 86 features in the order of PAIR."""
    df = with_ratios(sides) if ratios else sides.withColumns({c: F.lit(0.0) for c in ("name_jw", "name_sort", "name_set", "addr_jw", "addr_set")})
    for c in PROVENANCE:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(NEUTRAL.get(c, 0.0)))) if c in df.columns else df.withColumn(c, F.lit(NEUTRAL.get(c, 0.0)))
    sc, tc = _both("n_clean")
    sa, ta = _both("a_clean")
    length = lambda c: F.char_length(c)
    sx, tx = _both("n_acronym")
    rom = lambda p: F.when(F.col(f"{p}_n_romanized") != "", F.col(f"{p}_n_romanized")).otherwise(F.col(f"{p}_n_clean"))
    sn, tn = _both("n_numbers")
    sp, tp = _both("a_postal")
    sh, th = _both("a_num")
    # what others build on first, so that nothing is computed twice
    df = df.withColumns({
        "name_seq": S.levenshtein_ratio(sc, tc), "addr_seq": S.levenshtein_ratio(sa, ta),
        "postal": flag(F.arrays_overlap(sp, tp)), "house": _same("a_num"),
        "house_abs": F.when((sh != "") & (th != ""), F.coalesce(F.abs(sh.try_cast("long") - th.try_cast("long")).cast("double"), F.lit(0.0))).otherwise(0.0),
        "s_nums": F.array_union("s_a_numbers", sn), "t_nums": F.array_union("t_a_numbers", tn),
    })
    df = df.withColumn("num_shared", F.size(F.array_intersect("s_nums", "t_nums")).cast("double"))
    conflict = F.when((F.col("postal") == 0) & (F.size(sp) > 0) & (F.size(tp) > 0), 1.0).otherwise(0.0) + F.when((F.col("house") == 0) & (sh != "") & (th != "") & (F.col("house_abs") > 10), 1.0).otherwise(0.0)
    df = df.withColumn("conflict", conflict)
    three = lambda c: F.transform(F.filter(c, lambda x: F.char_length(x) >= 3), lambda x: F.substring(x, 1, 3))
    larger = F.greatest(F.coalesce(sh.try_cast("long"), F.lit(0)), F.coalesce(th.try_cast("long"), F.lit(0)), F.lit(1))
    ns, as_ = F.col("name_seq"), F.col("addr_seq")
    values = {
        "name_raw": _same("n_raw"), "name_clean": _same("n_clean"), "name_legal": _same("n_legal"), "name_compact": _same("n_compact"),
        "name_jaccard": S.jaccard(*_both("n_tokens")), "name_overlap": F.size(F.array_intersect(*_both("n_tokens"))).cast("double"), "name_containment": S.containment(*_both("n_tokens")),
        "name_grams3": S.jaccard(*_both("n_grams3")), "name_grams4": S.jaccard(*_both("n_grams4")), "name_prefix": _same("n_prefix"), "name_suffix": _same("n_suffix"), "name_first": _same("n_first"), "name_last": _same("n_last"),
        "name_acronym": F.when((sx != "") & (sx == tx), 1.0).when(((sx != "") & F.contains("t_n_compact", sx)) | ((tx != "") & F.contains("s_n_compact", tx)), 0.8).otherwise(0.0),
        "name_len_diff": F.abs(length(sc) - length(tc)).cast("double"), "name_len_ratio": F.least(length(sc), length(tc)) / F.greatest(length(sc), length(tc), F.lit(1)), "name_count_diff": F.abs(F.size("s_n_tokens") - F.size("t_n_tokens")).cast("double"),
        "name_translit": F.when(F.col("s_n_is_indic") | F.col("t_n_is_indic"), S.levenshtein_ratio(rom("s"), rom("t"))).otherwise(0.0), "name_missing": flag((sc == "") | (tc == "")), "name_number": flag(F.arrays_overlap(sn, tn)),
        "addr_raw": _same("a_raw"), "addr_clean": _same("a_clean"), "addr_jaccard": S.jaccard(*_both("a_tokens")), "addr_overlap": F.size(F.array_intersect(*_both("a_tokens"))).cast("double"), "addr_salient": S.jaccard(*_both("a_salient")), "addr_grams3": S.jaccard(*_both("a_grams3")),
        "postal_prefix": flag(F.arrays_overlap(three(sp), three(tp))), "house_rel": F.col("house_abs") / larger, "house_digits": F.when((sh != "") & (th != ""), S.levenshtein_ratio(sh, th)).otherwise(0.0),
        "city": S.levenshtein_ratio(*_both("a_sal")), "state": S.levenshtein_ratio(*_both("a_sal2")), "locality": S.jaccard(F.slice("s_a_salient", 1, 3), F.slice("t_a_salient", 1, 3)),
        "agree": F.col("postal") + F.col("house"), "addr_len_diff": F.abs(length(sa) - length(ta)).cast("double"), "addr_missing": flag((sa == "") | (ta == "")), "addr_numbers": S.jaccard(*_both("a_numbers")),
        "num_jaccard": S.jaccard(F.col("s_nums"), F.col("t_nums")), "num_sequence": flag((F.size("s_a_numbers") > 0) & (F.col("s_a_numbers") == F.col("t_a_numbers"))), "num_house": F.col("house"), "num_apart": (F.size(F.array_union("s_nums", "t_nums")) - F.col("num_shared")).cast("double"),
        "num_postal": F.col("postal"), "num_only": flag((F.col("num_shared") > 0) & (ns < 0.3)), "num_conflict": flag(F.col("conflict") > 0),
        "x_product": ns * as_, "x_harmonic": F.when(ns + as_ > 0, 2 * ns * as_ / (ns + as_)).otherwise(0.0), "x_min": F.least(ns, as_), "x_max": F.greatest(ns, as_), "x_diff": F.abs(ns - as_),
        "x_name_addr": flag((_same("n_clean") == 1) & (as_ >= 0.5)), "x_house_name": flag((F.col("house") == 1) & (ns >= 0.7)), "x_name_number": F.when(F.col("num_shared") > 0, ns).otherwise(0.0),
        "x_country": flag(F.col("s_country") == F.col("t_country")), "is_s2": flag(F.col("tid").startswith("S2")), "is_s3": flag(F.col("tid").startswith("S3")),
    }
    return df.select("sid", "tid", *[values[c].cast("double").alias(c) if c in values else F.col(c).cast("double").alias(c) for c in PAIR])


def consensus(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """``pairs`` (sid, tid) -> (sid, tid, CONSENSUS): how the candidates of the other source under the same entity look."""
    side = targets.select(F.col("id").alias("tid"), (F.col("src") == "S2").alias("two"), F.col("src").alias("src"), F.col("n_tokens").alias("toks"), F.col("a_num").alias("num"))
    own = pairs.select("sid", "tid").join(side, "tid")
    peers = own.where("src in ('S2', 'S3')").select(F.col("sid").alias("p_sid"), (F.col("src") == "S2").alias("p_two"), F.col("toks").alias("p_toks"), F.col("num").alias("p_num"))
    met = own.join(peers, (F.col("sid") == F.col("p_sid")) & (F.col("two") != F.col("p_two")), "left")
    same = F.when((F.col("num") != "") & (F.col("num") == F.col("p_num")), 1.0).otherwise(0.0)
    rolled = met.groupBy("sid", "tid").agg(F.max(F.when(F.col("p_sid").isNotNull(), 1.0).otherwise(0.0)).alias("has_peer"), F.max(F.when(F.col("p_sid").isNotNull(), S.jaccard(F.col("toks"), F.col("p_toks"))).otherwise(0.0)).alias("peer_jaccard"), F.max(same).alias("peer_number"))
    return rolled.withColumn("peer_score", F.col("peer_jaccard") * F.col("peer_number"))


def context(pairs: DataFrame, entities: DataFrame, targets: DataFrame, score: str | None = None) -> DataFrame:
    """(sid, tid, CONTEXT): candidates of the entity, claimants of the target, the target's margin, house number support."""
    s, t = Window.partitionBy("sid"), Window.partitionBy("tid")
    margin = F.lit(0.0)
    if score:  # the best and the second score of a target, however many claim it
        pairs = pairs.withColumn("claim_", F.row_number().over(t.orderBy(F.col(score).desc(), "sid")))
        best, second = (F.max(F.when(F.col("claim_") == k, F.col(score))).over(t) for k in (1, 2))
        margin = best - F.coalesce(second, F.lit(0.0))
    counted = pairs.select("sid", "tid", F.count("*").over(s).cast("double").alias("density"), F.count("*").over(t).cast("double").alias("competition"), margin.cast("double").alias("target_margin"))
    nums = counted.join(entities.select(F.col("id").alias("sid"), F.col("a_num").alias("x")), "sid").join(targets.select(F.col("id").alias("tid"), F.col("a_num").alias("y")), "tid")
    return nums.select("sid", "tid", "density", flag(F.col("density") == 1).alias("single_candidate"), "competition", flag(F.col("competition") == 1).alias("single_claimant"), "target_margin", flag((F.col("x") != "") & (F.col("x") == F.col("y"))).alias("house_support"))


def feature_matrix(pairs: DataFrame, entities: DataFrame, targets: DataFrame) -> DataFrame:
    """All 96 columns. ``pairs``: sid, tid and, if known, the provenance columns; read three times, so keep them."""
    made = pair_features(with_sides(pairs, entities, targets))
    return made.join(consensus(pairs, targets), ["sid", "tid"]).join(context(pairs, entities, targets), ["sid", "tid"])
