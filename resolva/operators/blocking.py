"""Tiered blocking: every index is an equi-join on (country, channel, key) against postings that are filtered by bucket size
before the join, so no key fans out beyond its cap, whatever its skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CAPS = {"clean": 150, "legal": 150, "first_two": 150, "sorted": 150, "condensed": 150, "num_sal": 100, "pin_num": 80, "pin_sal": 60, "num_pair": 60, "rare": 40, "sal_pair": 50, "prefix_pair": 50, "fallback": 35}
TIER = {"clean": 1, "legal": 1, "first_two": 1, "sorted": 1, "condensed": 1, "num_sal": 2, "pin_num": 2, "pin_sal": 2, "num_pair": 2, "rare": 2, "sal_pair": 3, "prefix_pair": 3, "fallback": 4}
RARE_MAX = 40
MAX_CANDIDATES = 150


def _keys(channel: str, values: Column) -> Column:
    return F.transform(values, lambda k: F.struct(F.lit(channel).alias("channel"), k.alias("key")))


def _one(value: Column, when: Column | None = None) -> Column:
    good = value != "" if when is None else when & (value != "")
    return F.when(good, F.array(value)).otherwise(F.expr("cast(array() as array<string>)"))


def _product(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat_ws("|", a, b))))


def _ordered_pairs(values: Column, most: int) -> Column:
    some = F.slice(values, 1, most)
    return F.flatten(F.transform(some, lambda a, i: F.transform(F.slice(values, i + 2, F.greatest(most - 1 - i, F.lit(0))), lambda b: F.concat_ws("|", F.least(a, b), F.greatest(a, b)))))


def keys(views: DataFrame, probe: bool) -> DataFrame:
    """(id, country, channel, key), distinct. Romanized forms are indexed, not probed."""
    rom, rom_tokens = F.col("n_romanized"), F.col("n_romanized_tokens")
    long_rom = F.array_join(F.array_sort(F.filter(F.slice(rom_tokens, 1, 4), lambda t: F.char_length(t) >= 3)), "_")
    indexed = F.lit(not probe) & F.col("n_is_indic")
    nums, sals, pins = F.col("a_digits"), F.col("a_salient"), F.col("a_postal")
    both = F.transform(F.slice("n_tokens", 1, 2), lambda t: F.substring(t, 1, 3))
    prefixes = F.when((F.size("n_tokens") >= 2) & F.forall(F.slice("n_tokens", 1, 2), lambda t: F.char_length(t) >= 3), F.array(F.array_join(F.array_sort(both), "|"))).otherwise(F.expr("cast(array() as array<string>)"))
    pair = F.when(F.size(nums) >= 2, F.array(F.array_join(F.array_sort(F.slice(nums, 1, 2)), "|"))).otherwise(F.expr("cast(array() as array<string>)"))
    rare = F.filter(F.when(indexed, F.concat("n_tokens", rom_tokens)).otherwise(F.col("n_tokens")), lambda t: F.char_length(t) >= 4)
    every = F.concat(
        _keys("clean", _one(F.col("n_clean"))),
        _keys("legal", F.concat(_one(F.col("n_legal")), _one(rom, indexed))),
        _keys("first_two", F.concat(_one(F.col("n_first_two")), _one(F.array_join(F.slice(rom_tokens, 1, 2), " "), indexed & (F.size(rom_tokens) >= 2)))),
        _keys("sorted", F.concat(_one(F.col("n_sorted")), _one(long_rom, indexed))),
        _keys("condensed", _one(F.col("n_condensed"), F.char_length("n_condensed") >= 5)),
        _keys("num_sal", _product(F.slice(nums, 1, 4), F.slice(sals, 1, 12))),
        _keys("pin_num", _product(F.slice(pins, 1, 2), F.slice(nums, 1, 2))),
        _keys("pin_sal", _product(F.slice(pins, 1, 2), F.slice(sals, 1, 4))),
        _keys("num_pair", pair),
        _keys("rare", rare),
        _keys("sal_pair", _ordered_pairs(sals, 5)),
        _keys("prefix_pair", prefixes),
        _keys("fallback", F.filter(F.slice(sals, 1, 2), lambda s: F.char_length(s) >= 5)),
    )
    return views.select("id", "country", F.explode(F.array_distinct(every)).alias("k")).select("id", "country", "k.channel", "k.key")


def token_frequency(targets: DataFrame) -> DataFrame:
    """(country, token, n): occurrences, not documents, of name tokens of four letters or more."""
    words = F.concat("n_tokens", F.when(F.col("n_is_indic"), F.col("n_romanized_tokens")).otherwise(F.expr("cast(array() as array<string>)")))
    return targets.select("country", F.explode(words).alias("token")).where(F.char_length("token") >= 4).groupBy("country", "token").agg(F.count("*").alias("n"))


def postings(targets: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """(country, channel, key, tid) of buckets within their cap; rare tokens also by corpus frequency."""
    found = keys(targets, probe=False)
    if channels:
        found = found.where(F.col("channel").isin(channels))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv]), F.col("channel"))
    sizes = found.groupBy("country", "channel", "key").agg(F.count("*").alias("n")).where(F.col("n") <= limit).drop("n")
    common = token_frequency(targets).where(F.col("n") > RARE_MAX).select("country", F.lit("rare").alias("channel"), F.col("token").alias("key"))
    sizes = sizes.join(common, ["country", "channel", "key"], "left_anti")
    return found.withColumnRenamed("id", "tid").join(sizes, ["country", "channel", "key"])


def hits(entities: DataFrame, targets: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """(sid, tid, tier): the best tier in which a pair meets; tier 4 marks fallback hits."""
    probes = keys(entities, probe=True).withColumnRenamed("id", "sid")
    met = probes.join(postings(targets, channels), ["country", "channel", "key"])
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in TIER.items() for x in kv]), F.col("channel"))
    return met.select("sid", "tid", tier.alias("tier"))


def candidates(entities: DataFrame, targets: DataFrame, most: int | None = MAX_CANDIDATES) -> DataFrame:
    """(sid, tid, tier): all of tier 1, then tiers 2 and 3 by id up to ``most``; fallback only where tiers 1 and 2 found two or fewer."""
    met = hits(entities, targets)
    tiers = met.distinct()
    found = tiers.groupBy("sid").agg(F.count(F.when(F.col("tier") <= 2, 1)).alias("sure"))
    allowed = tiers.join(found, "sid").where("tier < 4 or sure <= 2").withColumn("tier", F.least("tier", F.lit(3)))
    pairs = allowed.groupBy("sid", "tid").agg(F.min("tier").alias("tier"))
    if most is None:
        return pairs
    place = F.row_number().over(Window.partitionBy("sid").orderBy("tier", "tid"))
    return pairs.withColumn("place", place).where((F.col("tier") == 1) | (F.col("place") <= most)).drop("place")


def report(entities: DataFrame, pairs: DataFrame, truth: DataFrame, n_targets: int) -> DataFrame:
    """One row: recall, candidates per entity (mean, p95, p99, max), reduction ratio."""
    per = entities.select(F.col("id").alias("sid")).join(pairs.groupBy("sid").agg(F.count("*").alias("c")), "sid", "left").select(F.coalesce("c", F.lit(0)).alias("c"))
    sizes = per.agg(F.count("*").alias("n_entities"), F.avg("c").alias("mean"), F.percentile("c", F.lit(0.95)).alias("p95"), F.percentile("c", F.lit(0.99)).alias("p99"), F.max("c").alias("most"), F.sum("c").alias("n_pairs"))
    found = truth.join(pairs.select("sid", "tid", F.lit(1).alias("hit")), ["sid", "tid"], "left").agg(F.count("hit").alias("found"), F.count("*").alias("n_true"))
    recall = F.when(F.col("n_true") > 0, F.col("found") / F.col("n_true")).otherwise(1.0)
    return sizes.join(found).select("n_entities", "n_pairs", "n_true", "found", recall.alias("recall"), "mean", "p95", "p99", "most", (1 - F.col("n_pairs") / (F.col("n_entities") * F.lit(n_targets))).alias("reduction"))
