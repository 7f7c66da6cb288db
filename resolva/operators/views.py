"""Multi-view representations of a record's name and address, as flat columns computed once per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

RECORD = ["entity_id", "business_name", "business_address", "country"]


def with_views(records: DataFrame) -> DataFrame:
    """``records`` (RECORD) -> id, src, country key, name views ``n_*`` and address views ``a_*``.

    The folding UDF runs once for each of four strings; everything derived from them is built in. Persist or write the
    result: plans that read it more than once should not fold again.
    """
    # fmt: off
    base = records.select(
        F.col("entity_id").alias("id"), F.upper(F.substring_index("entity_id", "-", 1)).alias("src"), T.country_key(F.col("country")).alias("country"),
        F.trim(F.coalesce("business_name", F.lit(""))).alias("n_raw"), F.trim(F.coalesce("business_address", F.lit(""))).alias("a_raw"),
    )
    base = base.withColumn("n_is_indic", T.is_indic(F.col("n_raw")))
    folded = base.select("*", T.nfkd_fold("n_raw").alias("n_fold"), T.nfkd_fold("a_raw").alias("a_fold"), T.nfkd_fold(T.dba(F.col("n_raw"))).alias("d_fold"), T.nfkd_fold(T.split_social(F.col("n_raw"))).alias("s_fold"), T.nfkd_fold(F.when(F.col("n_is_indic"), T.romanize(F.col("n_raw"))).otherwise("")).alias("r_fold"))
    cleaned = folded.select(
        "id", "src", "country", "n_raw", "a_raw", "n_is_indic",
        T.clean_folded(F.col("n_fold")).alias("n_clean"), T.compact_folded(F.col("n_fold")).alias("n_compact"), T.clean_folded(F.col("d_fold")).alias("n_dba"),
        T.clean_folded(F.col("s_fold")).alias("n_social"), T.clean_folded(F.col("r_fold")).alias("r_clean"), T.clean_folded(F.col("a_fold")).alias("a_clean"),
    )
    left = cleaned.withColumn("n_left", T.legal_stripped(F.col("n_clean"))).withColumn("r_left", T.legal_stripped(F.col("r_clean"))).withColumn("n_joined", F.replace("n_clean", F.lit(" "), F.lit(""))).withColumn("a_joined", F.replace("a_clean", F.lit(" "), F.lit("")))
    stripped = left.withColumn("n_legal", T.without_terms(F.col("n_left"))).withColumn("n_romanized", T.without_terms(F.col("r_left"))).withColumn("a_norm", T.normalize_address(F.col("a_clean"))).withColumn("a_salient", T.salient(F.col("a_clean")))
    words = stripped.withColumn("n_tokens", T.tokens(F.col("n_legal"))).withColumn("a_tokens", T.tokens(F.col("a_norm"))).withColumn("a_numbers", T.numbers(F.col("a_raw"))).withColumn("a_postal", T.postal_codes(F.col("a_raw")))
    return words.select(
        "id", "src", "country", "n_raw", "n_clean", "n_compact", "n_dba", "n_legal", "n_social", "n_is_indic", "n_romanized", "n_tokens", "a_raw", "a_clean", "a_norm", "a_tokens", "a_numbers", "a_postal", "a_salient",
        T.expand_abbreviations(F.col("n_legal")).alias("n_expanded"),
        F.array_join(F.slice("n_tokens", 1, 2), " ").alias("n_first_two"), T.first(F.col("n_tokens")).alias("n_first"), T.first(F.col("n_tokens"), -1).alias("n_last"),
        F.substring("n_joined", 1, 4).alias("n_prefix"), F.right("n_joined", F.lit(4)).alias("n_suffix"), T.sorted_tokens(F.col("n_tokens")).alias("n_sorted"),
        T.char_ngrams(F.col("n_joined"), 3).alias("n_grams3"), T.char_ngrams(F.col("n_joined"), 4).alias("n_grams4"), T.numbers(F.col("n_raw"), "1,").alias("n_numbers"), T.acronym(F.col("n_clean")).alias("n_acronym"),
        F.filter(T.tokens(F.col("n_romanized")), lambda t: F.char_length(t) >= 2).alias("n_romanized_tokens"), T.condensed(F.col("n_raw")).alias("n_condensed"),
        T.first(F.col("a_numbers")).alias("a_num"), T.first(F.col("a_numbers"), 2).alias("a_num2"), T.first(F.col("a_postal")).alias("a_zip"), T.first(F.col("a_salient")).alias("a_sal"), T.first(F.col("a_salient"), 2).alias("a_sal2"),
        T.char_ngrams(F.col("a_joined"), 3).alias("a_grams3"), T.digit_runs(F.col("a_raw")).alias("a_digits"), (F.col("a_raw") == "").alias("a_empty"),
    )
    # fmt: on


def split_sides(views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(S1 records, target records)."""
    return views.where("src = 'S1'"), views.where("src <> 'S1'")
