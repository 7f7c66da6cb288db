"""Features of a product catalog's texts, all built in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C

MULTIPLIER = r"(?i)(\d+)\s*x\s*\d+(?:\.\d+)?"
PACK = r"(?i)pack\s+of\s*(\d+)|set\s+of\s*(\d+)|combo\s+of\s*(\d+)|(\d+)\s*(?:pack|pk|pcs|pieces|count|units?|sets?|pairs?)"
UNITS = sorted([*C.GRAMS, *C.MILLILITRES, *C.OTHER_UNITS], key=len, reverse=True)
QUANTITY = r"(?i)(\d+(?:\.\d+)?)\s*(?<![a-zA-Z])(" + "|".join(UNITS) + r")(?![a-zA-Z])"
LABEL = r"(?i)(?:brand\s*:\s*|by\s+)([a-zA-Z0-9\-.&]+)"


def pack_count(text: Column) -> Column:
    """A multiplier as 3x500g wins, then a pack size of 1 to 1000, else 1."""
    times = F.regexp_extract(text, MULTIPLIER, 1).try_cast("int")
    groups = F.coalesce(*[F.nullif(F.regexp_extract(text, PACK, k), F.lit("")) for k in range(1, 5)]).try_cast("int")
    return F.coalesce(times, F.when(groups.between(1, 1000), groups), F.lit(1))


def quantity(text: Column) -> Column:
    """Struct (value, unit, grams, millilitres) of the first number with a unit; NULL where there is none."""
    value = F.regexp_extract(text, QUANTITY, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, QUANTITY, 2))
    factor = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), unit)
    return F.struct(value.alias("value"), F.when(unit == "", "unknown").otherwise(unit).alias("unit"), (value * factor(C.GRAMS)).alias("grams"), (value * factor(C.MILLILITRES)).alias("millilitres"))


def brand(text: Column) -> Column:
    """A label's word, else the first word if it is written like a name, else UNKNOWN."""
    label = F.regexp_extract(text, LABEL, 1)
    head = F.regexp_replace(F.regexp_extract(text, r"^\s*(\S+)", 1), r"[^\p{L}\p{N}_\s]", "")
    title = head.rlike(r"^(?:[^\p{L}]*\p{Lu}[\p{Ll}]*)+[^\p{L}]*$") | ((head == F.upper(head)) & head.rlike(r"\p{Lu}"))
    return F.when(label != "", label).when((F.char_length(head) > 1) & title, head).otherwise("UNKNOWN")


def text_stats(text: Column, prefix: str) -> list[Column]:
    c = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(c), F.lit(1))
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    return [
        F.char_length(c).cast("double").alias(f"{prefix}_char_len"), F.regexp_count(c, F.lit(r"\S+")).cast("double").alias(f"{prefix}_word_count"),
        share(r"\p{Nd}").alias(f"{prefix}_digit_ratio"), share(r"\p{Lu}").alias(f"{prefix}_upper_ratio"), share(r"[^\p{L}\p{N}\s]").alias(f"{prefix}_punct_ratio"),
    ]


def keyword_flags(text: Column) -> list[Column]:
    low = F.lower(F.coalesce(text, F.lit("")))
    return [F.contains(low, F.lit(k)).cast("int").alias(f"kw_{k}") for k in C.KEYWORDS]


def record_features(df: DataFrame, title: str, description: str, bullets: str, keep: list[str]) -> DataFrame:
    """``keep`` and the 43 features."""
    t, d, b = (F.coalesce(F.col(c), F.lit("")) for c in (title, description, bullets))
    every = df.withColumn("all_text", F.trim(F.concat_ws(" ", t, b, d)))
    every = every.withColumn("pack", pack_count(F.col("all_text"))).withColumn("q", quantity(F.col("all_text")))
    return every.select(
        *keep, F.col("pack").alias("pack_count"), brand(F.when(t != "", t).otherwise(F.col("all_text"))).alias("brand_candidate"), F.col("q.value").alias("extracted_value"), F.col("q.unit").alias("extracted_unit"),
        F.col("q.grams").alias("norm_weight_g"), F.col("q.millilitres").alias("norm_volume_ml"), (F.col("q.grams") * F.col("pack")).alias("effective_weight_g"), (F.col("q.millilitres") * F.col("pack")).alias("effective_volume_ml"), (F.col("q.value") * F.col("pack")).alias("effective_quantity"),
        *text_stats(F.col(title), "title"), *text_stats(F.col(description), "desc"), *text_stats(F.col(bullets), "bullets"), *keyword_flags(F.col("all_text")),
    )


def ordinal(df: DataFrame, category: str, train: DataFrame) -> DataFrame:
    """Adds ``code``: the category's place in order among those of ``train``; -1 if unseen; null counts as MISSING."""
    from pyspark.sql import Window

    value = F.coalesce(F.col(category), F.lit("MISSING"))
    codes = train.select(value.alias("cat")).distinct().withColumn("code", F.row_number().over(Window.orderBy("cat")) - 1)
    return df.withColumn("cat", value).join(codes, "cat", "left").withColumn("code", F.coalesce("code", F.lit(-1))).drop("cat")


def impute_median(df: DataFrame, column: str, train: DataFrame) -> DataFrame:
    return df.join(train.agg(F.percentile(column, F.lit(0.5)).alias("mid"))).withColumn(column, F.coalesce(F.col(column).cast("double"), F.col("mid"))).drop("mid")
