"""String and set similarities. Two empty sides are alike (1), one empty side is not (0)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def guarded(a: Column, b: Column, value: Column) -> Column:
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(value)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return guarded(a, b, 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets."""
    shared, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / every)


def containment(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / least)


def jaro_winkler_pair(a: str, b: str) -> float:
    if not a or not b:
        return float(not a and not b)
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    open_at: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        open_at.setdefault(c, []).append(j)
    matched_a, matched_b = [], []
    for i, c in enumerate(a):
        places = open_at.get(c, ())
        for k, j in enumerate(places):
            if j > i + reach:
                break
            if j >= i - reach:
                matched_a.append(c)
                matched_b.append(j)
                del places[k]
                break
    m = len(matched_a)
    if not m:
        return 0.0
    crossed = sum(c != b[j] for c, j in zip(matched_a, sorted(matched_b)))
    jaro = (m / len(a) + m / len(b) + (m - crossed // 2) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest one, a bit for each letter of ``a`` (Hyyro's bit-vector method on Python integers)."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        met = state & where.get(c, 0)
        state = (state + met | state - met) & full
    return len(a) - state.bit_count()


def indel_pair(a: str, b: str) -> float:
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_pair(a: str, b: str) -> float:
    """Of blank-joined tokens: the best of the common part against each whole and of the wholes against each other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return float(not x and not y)
    common, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if common and not (left and right):
        return 1.0
    shared, one, two = " ".join(common), " ".join(common + left), " ".join(common + right)
    best = indel_pair(one, two)
    return max(best, indel_pair(shared, one), indel_pair(shared, two)) if common else best


def token_sort_pair(a: str, b: str) -> float:
    if not a or not b:
        return float(not a and not b)
    return indel_pair(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _over(pair):
    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([pair(x or "", y or "") for x, y in zip(a, b)], dtype=float)

    return ratio


jaro_winkler = _over(jaro_winkler_pair)
indel_ratio = _over(indel_pair)
token_sort_ratio = _over(token_sort_pair)
token_set_ratio = _over(token_set_pair)
