"""Distributed union-find: connected components by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop, stage


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a, b) of one orderable type -> (node, root): root is the smallest node reachable.

    Each pass hangs every neighbour of a node on the smallest one (Kiveris et al., "Connected Components in
    MapReduce and Beyond", 2014); passes needed grow with the logarithm of the longest chain. Only a count and a
    checksum of the (distinct) edges travel to the driver. Every pass is written to the shared folder, so lineage stays one
    pass deep. Loops and repeated edges are allowed, null ends are left out; a node without a proper edge is not listed: it
    is its own root.
    """
    spark = edges.sparkSession
    star = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    star, path = stage(star, name)
    before = None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        star_, path_ = stage(small, name)
        now = tuple(star_.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        drop(spark, path)
        star, path = star_, path_
        if now == before or not now[0]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
