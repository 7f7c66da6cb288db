"""Column functions on names, addresses and catalog texts. All but ``fold`` are built-in expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from . import constants as C

#: As Python's ``[\\W_]`` and ``\\b\\d+\\b``, for every code point.
NOT_WORD = r"[^\p{L}\p{N}]+"
NUMBER = r"(?<![\p{L}\p{N}_])\p{Nd}{%s}(?![\p{L}\p{N}_])"


@F.pandas_udf(StringType())
def nfkd_fold(text: pd.Series) -> pd.Series:
    """NFKD without combining marks; Spark has no built-in for it."""

    def one(s: str | None) -> str:
        if not s or s.isascii():
            return s or ""
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    return text.map(one)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s or ""))


def text_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def clean_folded(folded: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(folded), NOT_WORD, " "))


def clean(text: Column) -> Column:
    return clean_folded(nfkd_fold(F.coalesce(text, F.lit(""))))


def compact_folded(folded: Column) -> Column:
    return F.regexp_replace(F.lower(folded), "[^a-z0-9]", "")


def tokens(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def dba(text: Column) -> Column:
    """What follows d/b/a or t/a, else the text."""
    found = F.regexp_extract(text, r"(?i)\b(?:d\s*/?\s*b\s*/?\s*a|t\s*/?\s*a)\b[:\s]*(.+)", 1)
    return F.when(found != "", F.trim(found)).otherwise(text)


def legal_stripped(cleaned: Column) -> Column:
    """Without legal suffixes and terms; all tokens if nothing else is left. ``cleaned`` should be a column, not an expression."""
    left = cleaned
    for phrase in C.LEGAL_PHRASES:
        left = F.when(F.endswith(left, F.lit(phrase)), F.trim(F.substring(left, F.lit(1), F.char_length(left) - len(phrase)))).otherwise(left)
    return left


def without_terms(left: Column) -> Column:
    kept = F.filter(tokens(left), lambda t: ~t.isin(C.LEGAL_TERMS))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.array_join(tokens(left), " "))


def mapped(cleaned: Column, values: dict[str, str]) -> Column:
    table = text_map(values)
    return F.array_join(F.transform(tokens(cleaned), lambda t: F.coalesce(F.element_at(table, t), t)), " ")


def expand_abbreviations(cleaned: Column) -> Column:
    return mapped(cleaned, C.ABBREVIATIONS)


def normalize_address(cleaned: Column) -> Column:
    return mapped(cleaned, C.STREETS)


def split_social(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), "^[@#*]+", ""), "([a-z])([A-Z])", "$1 $2")


def acronym(cleaned: Column) -> Column:
    kept = F.filter(tokens(cleaned), lambda t: ~t.isin(C.LEGAL_TERMS) & (F.char_length(t) >= 2))
    return F.when(F.size(kept) >= 2, F.array_join(F.transform(F.slice(kept, 1, 6), lambda t: F.substring(t, 1, 1)), "")).otherwise("")


def sorted_tokens(words: Column) -> Column:
    kept = F.filter(words, lambda t: (F.char_length(t) >= 2) & ~t.isin(C.LEGAL_TERMS))
    return F.array_join(F.slice(F.array_sort(kept), 1, 5), "_")


def char_ngrams(text: Column, n: int) -> Column:
    """The distinct n-grams, in order of first place."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.char_length(text) >= n, F.array_distinct(grams)).otherwise(F.expr("cast(array() as array<string>)"))


def unpadded(numbers: Column) -> Column:
    return F.transform(numbers, lambda x: F.regexp_replace(x, "^0+(?=.)", ""))


def numbers(text: Column, most: str = "1,7") -> Column:
    return unpadded(F.regexp_extract_all(text, F.lit(NUMBER % most), F.lit(0)))


def digit_runs(text: Column) -> Column:
    return unpadded(F.regexp_extract_all(text, F.lit(r"\p{Nd}{1,7}"), F.lit(0)))


def postal_codes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER % "5,6"), F.lit(0))


def salient(cleaned: Column, least: int = 3) -> Column:
    return F.filter(tokens(cleaned), lambda t: (F.char_length(t) >= least) & ~t.isin(C.ADDRESS_STOP_WORDS) & ~t.rlike(r"^\p{Nd}+$"))


def first(values: Column, place: int = 1) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(place)), F.lit(""))


def condensed(text: Column, also: str = "") -> Column:
    s = F.regexp_replace(F.lower(text), r"https?://(?:www\.)?", "")
    s = F.regexp_replace(s, rf"\.(com|org|net|in|co|io|biz|info|gov{also})\b", "")
    return F.regexp_replace(F.regexp_replace(s, "^[@#*]+", ""), NOT_WORD, "")


def country_key(country: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(country)), F.lit("")), F.lit("unknown"))


def is_indic(text: Column) -> Column:
    return text.rlike(r"[ऀ-ൿ]")


def romanize(text: Column) -> Column:
    """Letters of the Brahmic blocks by their place in the block; other characters stay, zero-width ones go."""
    table = F.create_map(*[x for k, v in C.BRAHMIC.items() for x in (F.lit(k), F.lit(v))])

    def one(c: Column) -> Column:
        code = F.expr("ascii")(c) if False else F.ascii(c)
        return F.when(c.rlike(r"[ऀ-ൿ]"), F.coalesce(F.element_at(table, code % 0x80), F.lit(""))).otherwise(c)

    letters = F.transform(F.filter(F.split(F.regexp_replace(text, "[‌‍﻿]", ""), ""), lambda c: c != ""), one)
    return F.regexp_replace(F.array_join(letters, ""), r"([a-z])\1{2,}", "$1$1")
