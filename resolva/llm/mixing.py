"""Mixing sources to target weights by capped water-filling.

A document's size is its number of ``[^\\x20\\x09-\\x0D]+`` words. Sources in code-point order, null last, take the weights in
turn; together they share ``BUDGET`` of all sizes. A source stops at ``EPOCHS`` times its size and what it can't take goes to
the others by weight, until nobody is above: with sources in order of cap per weight, the first that is not full fixes the
level of all later ones, so the fixed point is one running sum, over one row for each source.

Sampling is seeded and needs no state: a source at rate r takes every document floor(r) times, and once more the documents
that come first in the order of a hash of seed and document, until the fraction's words are used up. That place in the order
is found in two steps: sums by (source, slot of the hash), which are combined before the shuffle, show the slot where the
line falls; only the documents of that one slot are put in order. So a source with a third of all rows is no single task.

The last document before the line is the one that leaves the sum nearest to the target, so a source is off by half a
document at most. Null and empty texts have size 0 and take 0 words; a null source is a source; repeated rows are mixed
each for itself, in the order of a second hash; an empty table gives an empty result. With no word at all, targets are 0.
Texts are counted whole, whatever their length. No row is taken more often than the epochs say, those without a word included.
Columns beyond doc_id, text and source may have any names and are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import free_name, stage

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
EPOCHS = 2
SEED = 17
SLOTS = 4096


def size_of(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size: one row a source) -> with weight and target."""
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    cap = epochs * F.col("source_size")
    full = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, everyone = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    share = F.sum("source_size").over(everyone) * budget - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = share / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = weighed.withColumn("level", level).withColumn("open", cap >= F.col("level") * F.col("weight"))
    first = F.min(F.when(F.col("open"), F.struct(cap / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everyone)
    levelled = levelled.withColumn("at", F.coalesce(first["level"], F.lit(float("inf"))))
    return levelled.select("source", "source_size", "weight", F.least(cap.cast("double"), F.col("at") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, source, size and any others) -> with source_size, target and copies (how often the mix takes the row).

    ``docs`` is read three times: hand over a staged table.
    """
    u = F.xxhash64(F.lit(seed), "doc_id")
    marked = docs.withColumn("u", u).withColumn("slot", F.pmod(F.shiftrightunsigned("u", 20), F.lit(SLOTS)).cast("int"))
    slots = marked.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    slots, _ = stage(slots, "mix-slots")
    goal = targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, budget, epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal, _ = stage(goal.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    start = F.coalesce(F.sum("slot_size").over(Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = slots.withColumn("start", start)
    same = ranged["source"].eqNullSafe(goal["source"])
    ranged = ranged.join(goal, same).select(ranged["source"].alias("s"), F.col("slot").alias("k"), "start", "slot_size", "source_size", "target", "whole", "part")
    plan = ranged.withColumn("inside", F.when((F.col("part") > 0) & (F.col("start") + F.col("slot_size") <= F.col("part")), F.lit(1)).when(F.col("start") >= F.col("part"), F.lit(0)).otherwise(F.lit(2)))
    placed = marked.join(plan, marked["source"].eqNullSafe(plan["s"]) & (marked["slot"] == plan["k"])).drop("s", "k", "slot", "slot_size")
    order = Window.partitionBy("source").orderBy("u", F.col("doc_id").asc_nulls_last(), "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where("inside = 2").withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("extra", (F.col("before") + F.col("size") / 2 <= F.col("part")).cast("int")).drop("before")
    sure = placed.where("inside < 2").withColumn("extra", F.col("inside").cast("int"))
    return sure.unionByName(edge).withColumn("copies", F.least(F.col("whole") + F.col("extra"), F.lit(int(-(-epochs // 1))))).drop("u", "start", "whole", "part", "inside", "extra")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie) of each row, staged; tie tells apart rows of one doc_id."""
    return stage(docs.select("doc_id", "source", size_of().alias("size"), F.xxhash64("text").alias("tie")), "mix-sizes")[0]


def repeat_rows(docs: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it, with the columns of ``docs``. Rows of one doc_id, text and source are mixed each for
    itself; which of them stands how often is then told by their number, as nothing else tells them apart."""
    keys = ["doc_id", "tie", "source"]
    mixed = mix(measured(docs)).groupBy(*keys).agg(F.sum("copies").alias("total"), F.count("*").alias("alike")).where("total > 0")
    m_id, m_tie, m_source, total, alike, tie, k, n = names = [free_name(docs, f"mix_{c}") for c in ("id", "tie", "source", "total", "alike", "hash", "k", "n")]
    taken = mixed.select(*[F.col(c).alias(name) for c, name in zip([*keys, "total", "alike"], names)])
    same = F.col("doc_id").eqNullSafe(F.col(m_id)) & (F.col(tie) == F.col(m_tie)) & F.col("source").eqNullSafe(F.col(m_source))
    met = docs.withColumn(tie, F.xxhash64("text")).join(taken, same)
    lone, more = met.where(F.col(alike) == 1).withColumn(k, F.lit(1)), met.where(F.col(alike) > 1)
    numbered = lone.unionByName(more.withColumn(k, F.row_number().over(Window.partitionBy("doc_id", tie, "source").orderBy(F.lit(0)))))
    copies = F.floor(F.col(total) / F.col(alike)) + (F.col(k) <= F.col(total) % F.col(alike)).cast("int")
    return numbered.withColumn(n, F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(documents: DataFrame) -> DataFrame:
    mixed = mix(measured(documents))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
