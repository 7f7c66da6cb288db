"""Near-duplicates by SimHash fingerprints, searched with BK-trees.

Fingerprint: A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``, 4-word shingles (repeats count; a shorter text is one
shingle), XXH64 with seed 42 of the space-joined shingle; a bit is set if it is set in over half of the hashes. A text
without words, null included, has fingerprint zero and links like any other.

Links join fingerprints that differ in ``RADIUS`` bits or fewer. Equal fingerprints are one vertex from the start, so
thousands of copies cost one row. Distinct fingerprints are dealt to shards: cut the 64 bits into RADIUS + 2 blocks, and
two that differ in RADIUS bits agree on at least two whole blocks, so each fingerprint goes to one shard for every pair
of blocks and no link can be missed (with more fingerprints, RADIUS + 3 blocks and triples). Each shard is a BK-tree:
children are keyed by their distance to the parent and a search follows only edges within the radius. The trees together
are as large as the corpus, so no tree is sent to all executors: the shuffle sends each tree to the one task that holds
its queries. A search reports one link per group of what it finds, not all pairs: the shard keeps a union-find and emits
a link only when it joins two groups. Components come from a distributed union-find over those links. Shards of two are compared
without a tree, and nodes of up to ``LEAF`` values are compared whole, so on corpora with few near copies most links come from
the blocks and a direct comparison; edges are followed in shards of more values.

A null doc_id is no component_id: a component has the smallest that is not null, or null. Repeated rows share a fingerprint.
Long texts are read whole. An empty table gives an empty result. Columns other than doc_id and text may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name, stage, text_bytes
from .components import connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Up to so many distinct fingerprints a shard key is a pair of blocks, beyond it a triple.
TRIPLES_FROM = 1 << 27
#: Values in a leaf of a tree.
LEAF = 4
#: Parts in which a component is joined with its smallest doc_id.
SALT = 16
LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    starts = [0, *[e + 1 for e in ends[: n - SHINGLE]]]
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :])], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``; byte lanes count eight bits at a time."""
    n = len(hashes)
    totals = np.zeros(64, np.int64)
    for begin in range(0, n, 255):
        part = hashes[begin : begin + 255]
        for shift in range(8):
            lanes = np.add.reduce((part >> np.uint64(shift)) & LANES)
            totals[shift::8] += np.frombuffer(np.uint64(lanes).tobytes(), np.uint8)
    return sum(1 << i for i in np.flatnonzero(2 * totals > n).tolist())


def fingerprints(df: DataFrame, out: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``out`` (long, the bits as signed)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(b) for b in text_bytes(batch.column(batch.schema.get_field_index(text)))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(found)], names=[*keep, out])

    schema = df.select(*[F.col(f"`{c}`") for c in keep]).schema.add(out, "long")
    return df.mapInArrow(run, schema)


def blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``n`` blocks that cover 64 bits."""
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class BKTree:
    """Over indexes of ``values``: children are keyed by their integer Hamming distance to the parent, the pivot; a node of
    ``LEAF`` values or fewer is a leaf that is compared whole."""

    __slots__ = ("members", "pivot", "children")

    def __init__(self, values: np.ndarray, members: np.ndarray) -> None:
        self.members, self.pivot, self.children = members, -1, {}
        if len(members) > LEAF:
            self.pivot, rest = members[0], members[1:]
            d = np.bitwise_count(values[rest] ^ values[self.pivot])
            self.children = {int(e): BKTree(values, rest[d == e]) for e in np.unique(d)}


def shard_links(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that make the same components as all pairs of ``values`` (distinct) within ``radius``: at most len - 1.

    All values search the tree together, each along the edges within its radius; a branch that is already in one component
    is searched only by the values outside it, so a large group of near copies doesn't cost all its pairs.
    """
    labels = np.arange(len(values))
    links: list[tuple[int, int]] = []

    def join(one: int, hits: np.ndarray) -> None:
        found, first = np.unique(labels[hits], return_index=True)
        if (other := found != (own := labels[one])).any():
            links.extend((int(values[one]), int(values[hits[f]])) for f in first[other])
            labels[np.isin(labels, found[other])] = own

    tree = BKTree(values, np.arange(len(values)))
    todo = [(tree, tree.members)]
    while todo:
        node, queries = todo.pop()
        own = labels[node.members]
        if (own == own[0]).all():
            queries = queries[labels[queries] != own[0]]
        if not len(queries):
            continue
        if not node.children:
            for one in node.members:
                join(one, queries[np.bitwise_count(values[queries] ^ values[one]) <= radius])
            continue
        d = np.bitwise_count(values[queries] ^ values[node.pivot]).astype(np.int64)
        join(node.pivot, queries[d <= radius])
        todo += [(child, queries[abs(d - e) <= radius]) for e, child in node.children.items()]
    return links


def links(distinct: DataFrame, column: str = "fp") -> DataFrame:
    """(a, b): pairs of distinct fingerprints in reach that make the components of all such pairs."""
    n = distinct.count()
    parts, agree = (RADIUS + 2, 2) if n <= TRIPLES_FROM else (RADIUS + 3, 3)
    keys = []
    for which, chosen in enumerate(combinations(blocks(parts), agree)):
        mask = sum(((1 << width) - 1) << first for first, width in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(which), F.col(column).bitwiseAND(F.lit(signed).cast("long"))))
    shards = distinct.select(F.explode(F.array(*keys)).alias("shard"), F.col(column).alias("fp"))
    dealt = shards.repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            found: list[tuple[int, int]] = []
            for i in np.flatnonzero(np.diff(cuts) > 1).tolist():
                members = fp[cuts[i] : cuts[i + 1]].view(np.uint64)
                if len(members) > 2:
                    found += shard_links(np.unique(members))
                elif (one := int(members[0]) ^ int(members[1])) and one.bit_count() <= RADIUS:
                    found.append((int(members[0]), int(members[1])))
            if found:
                pair = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        for batch in batches:
            key, fp = (np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in ((0, rest_key), (1, rest)))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left"))  # the last shard may go on in the next batch
            yield from out(key[:last], fp[:last]) if last else ()
            rest_key, rest = key[last:], fp[last:]
        if len(rest):
            yield from out(rest_key, rest)

    return dealt.mapInArrow(run, "a long, b long")


def components(marked: DataFrame, fp: str = "fp") -> DataFrame:
    """(node, root) of linked fingerprints; a fingerprint that is not listed is alone."""
    return connected_components(links(marked.select(F.col(fp).alias("fp")).distinct()), "simhash")


def rooted(marked: DataFrame, value: Column) -> DataFrame:
    """``marked`` (fp, ...) -> (fp, least, root, linked), staged: an aggregate of each fingerprint's rows, its root, and whether
    it is linked with another one."""
    least = marked.groupBy("fp").agg(value.alias("least"))
    found = components(marked)
    ends = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    joined = least.join(ends, least.fp == F.col("node"), "left")
    return stage(joined.select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")), "simhash-roots")[0]


def classes(marked: DataFrame) -> DataFrame:
    """``marked`` (doc_id, fp) -> (fp, component_id): the smallest doc_id of all linked fingerprints; null if none has one.

    Lone fingerprints need no join; a component is met in ``SALT`` parts, so a large one is not one task's.
    """
    found = rooted(marked, F.min("doc_id"))
    linked = found.where("linked").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int"))
    lowest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    lowest = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    alone = found.where("not linked").select("fp", F.col("least").alias("component_id"))
    return alone.unionByName(linked.join(lowest, ["root", "salt"]).select("fp", "component_id"))


def keep_one(df: DataFrame) -> DataFrame:
    """One row of each component stays, that of the smallest doc_id (null last, then the text's hash); columns as in ``df``."""
    names = df.columns
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
    marked, _ = stage(fingerprints(df.select("doc_id", "text", text_hash.alias("th")), "fp", ["doc_id", "th"]), "simhash")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    kept = rooted(marked, F.min(rank)).groupBy("root").agg(F.min("least").alias("r")).select(F.col("r.doc_id").alias("k_id"), F.col("r.th").alias("k_th"))
    th, rn = free_name(df, "th"), free_name(df, "rn")
    hashed = df.withColumn(th, text_hash)
    same = hashed["doc_id"].eqNullSafe(kept["k_id"]) & (hashed[th] == kept["k_th"])
    once = Window.partitionBy("doc_id", th).orderBy(F.lit(0))
    return hashed.join(kept, same, "left_semi").withColumn(rn, F.row_number().over(once)).where(F.col(rn) == 1).select(*[F.col(f"`{c}`") for c in names])


def query(documents: DataFrame) -> DataFrame:
    marked, _ = stage(fingerprints(documents.select("doc_id", "text"), "fp", ["doc_id"]), "simhash")
    joined = marked.join(classes(marked), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
