"""Quality rules as a ledger: every rule runs once per text and leaves one failure bit beside its measurements; policies,
which are versioned masks, and ablations then work on the bits alone and never look at a text again.

Words are runs of ``[^\\x20\\x09-\\x0D]``. A null text has no words; an empty text fails ``few_words``; texts are measured
whole, whatever their length. Repeated rows are measured alike and all kept or all rejected. An empty table gives an empty
ledger. The ledger is one struct column under a name that the table does not have, so no column of the table can clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .common import free_name, text_bytes

SPACE = bytes([0x20, *range(0x09, 0x0E)])
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; the position in RULES is the bit, so rules are only ever appended."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 12 * n_words)"),
    Rule("shouting", "n_upper > n_lower and n_upper >= 20"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: A policy rejects a text that fails any rule of its mask. Published versions do not change.
POLICIES = {"base-1": BASE, "web-1": BASE | BIT["symbols"] | BIT["duplicate_lines"], "web-2": sum(BIT.values())}
POLICY = "web-2"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if (size := len(seen)) == n:
        return 0
    if size < 2_000_000:
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        pair = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1]
        key = pair * size + ids[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, np.unique(twice))
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= hit
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    return (
        len(words),
        len(text.translate(None, SPACE + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(text) - len(text.translate(None, UPPER)),
        len(text) - len(text.translate(None, LOWER)),
    )


def with_ledger(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` with a struct column of the measurements and ``fail_bits``; and that column's name. One map-only pass."""
    raw, out = free_name(df, "measures"), free_name(df, "ledger")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(b) for b in text_bytes(batch.column(batch.schema.get_field_index(text)))]
            found = np.array(rows, np.int64).reshape(len(rows), len(MEASURES))
            column = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(MEASURES))], names=list(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, raw])

    schema = T.StructType([*df.schema.fields, T.StructField(raw, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))])
    measured = df.mapInArrow(run, schema)
    bits = F.lit(0).cast("long")
    for rule in RULES:
        condition = rule.fails
        for m in MEASURES:
            condition = _qualified(condition, m, raw)
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[rule.name]).cast("long")).otherwise(F.lit(0).cast("long")))
    ledger = F.struct(*[F.col(f"`{raw}`.{m}").alias(m) for m in MEASURES], bits.alias("fail_bits"))
    return measured.withColumn(out, ledger).drop(raw), out


def _qualified(condition: str, measure_name: str, struct: str) -> str:
    import re

    return re.sub(rf"(?<![\w.`]){measure_name}\b", f"`{struct}`.{measure_name}", condition)


def passes(fail_bits: Column, policy: str = POLICY) -> Column:
    return fail_bits.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablation(ledger: DataFrame, policy: str = POLICY, bits: str = "fail_bits") -> DataFrame:
    """(rule, failed, only_this_rule, kept_without): what each rule of a policy does, and what leaving it out would keep.

    The table is first reduced to counts by bit pattern, 2 ** len(RULES) rows at most.
    """
    mask = POLICIES[policy]
    counts = ledger.groupBy(F.col(bits).bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).cast("long").alias("bit")) for r in RULES if BIT[r.name] & mask])).alias("r")
    each = counts.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit")
    without = F.col("bits").bitwiseAND(F.lit(mask).cast("long").bitwiseXOR(F.col("bit"))) == 0
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this_rule"),
        F.sum(F.when(without, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def keep(df: DataFrame, policy: str = POLICY) -> DataFrame:
    """The rows that pass, with the columns of ``df``."""
    judged, ledger = with_ledger(df)
    return judged.where(passes(F.col(f"{ledger}.fail_bits"), policy)).select(*[F.col(f"`{c}`") for c in df.columns])


def query(documents: DataFrame) -> DataFrame:
    judged, ledger = with_ledger(documents.select("doc_id", "text"))
    bits = F.col(f"{ledger}.fail_bits")
    failed = ~passes(bits, "base-1")
    return judged.select(
        "doc_id", *[F.col(f"{ledger}.{m}").alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), (~failed & passes(bits)).alias("kept"), bits.alias("fail_bits"),
    )
