"""Benchmark decontamination by winnowing.

Words: A-Z in lower case, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. A window is WINDOW consecutive words of an item; an
item of fewer words, but not none, is one window as it stands. A document word inside any occurrence of a window is hit.

The method: hash every GRAM-word gram; in each run of WINDOW - GRAM + 1 grams keep the smallest hash. A shared span of
WINDOW words holds a whole run on both sides, and both sides keep the same gram of it, so every such span has a kept
fingerprint in common. Document fingerprints are joined to the benchmark's, and each meeting is extended word by word in
both directions; the words decide, so a collision of hashes can't make a hit. Words that no item has get number 0, which
can't be in a shared span: only stretches of WINDOW known words are hashed at all. For items that are shorter than WINDOW
every gram of their length is looked up.

The benchmark's index goes to every executor in blocks of at most ``BLOCK_BYTES`` of item text; a larger benchmark is
matched block after block, each pass adding to the hits that the rows carry. Documents are never shuffled.

Null and empty texts have no words and no hits; a null or empty item has no window. Items of one id count once; a null
item_id is the empty string. Repeated rows get the same answer each. An empty benchmark hits nothing, an empty table of
documents gives an empty result. Other columns of documents may have any names and are kept. Long and repetitive texts are
read whole; of the meetings of one diagonal only the first of each run is extended.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .common import free_name, slices, stage, text_bytes

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 16 << 20
PAIRS_AT_ONCE = 1 << 20

#: Other bytes become blanks, A-Z become a-z; bytes from 0x80 belong to characters that are all word characters.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def mix(ids: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number (the finalizer of splitmix64)."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    mixed = mix(ids)
    n = max(0, len(ids) - length + 1)
    total = np.zeros(n, np.uint64)
    for i in range(length):
        total = total * np.uint64(0x100000001B3) + mixed[i : i + n]
    return mix(total)


def winnow(hashes: np.ndarray, run: int) -> np.ndarray:
    """Positions whose hash is the smallest of some ``run`` consecutive ones; equal smallest ones all count."""
    n = len(hashes) - run + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = hashes[:n]
    for i in range(1, run):
        low = np.minimum(low, hashes[i : i + n])
    top = np.zeros(len(hashes), np.uint64)
    for i in range(run):
        top[i : i + n] = np.maximum(top[i : i + n], low)
    return np.flatnonzero(top == hashes)


class Index:
    """The benchmark's words as numbers and its fingerprints, by gram length: GRAM for windows, 1 to WINDOW - 1 for short items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, gram: int = GRAM) -> None:
        self.window, self.gram = window, gram
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        ids, owner, spans = [-1], [-1], []
        for name, text in sorted(set(items)):
            if words := words_of(text.encode()):
                spans.append((len(ids), len(words)))
                ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
                owner += [place[name]] * len(words)
                ids.append(-1)
                owner.append(-1)
        self.ids, self.owner = np.array(ids, np.int64), np.array(owner, np.int64)
        found: dict[int, list[np.ndarray]] = {}
        for start, n in spans:
            if n >= window:
                grams = gram_hashes(self.ids[start : start + n], gram)
                found.setdefault(gram, []).append(start + winnow(grams, window - gram + 1))
            else:
                found.setdefault(-n, []).append(np.array([start]))
        self.prints: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length, at in found.items():
            where = np.concatenate(at)
            hashes = np.concatenate([gram_hashes(self.ids[p : p + abs(length)], abs(length)) for p in where])
            order = np.argsort(hashes, kind="stable")
            self.prints[length] = hashes[order], where[order]

    def spans(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, end, item) of the shared spans in ``ids``, a sequence of word numbers that starts and ends with 0."""
        known = np.flatnonzero(np.diff(np.r_[0, ids != 0, 0].astype(np.int8)))
        starts, ends = known[::2], known[1::2]
        for length, (hashes, where) in self.prints.items():
            size, least = abs(length), self.window if length > 0 else -length
            fit = ends - starts >= least
            if not fit.any():
                continue
            lengths = (ends - starts)[fit]
            at = np.repeat(starts[fit] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            grams = gram_hashes(ids[at], size)
            near = winnow(grams, self.window - size + 1) if length > 0 else np.arange(len(grams))
            # a gram that runs over the end of a stretch is no gram of the document
            near = near[at[near + size - 1] - at[near] == size - 1]
            left, right = np.searchsorted(hashes, grams[near], "left"), np.searchsorted(hashes, grams[near], "right")
            many = right - left
            near, left, many = near[many > 0], left[many > 0], many[many > 0]
            for some in _portions(many):
                p = np.repeat(at[near[some]], many[some])
                q = where[np.repeat(left[some] - np.r_[0, np.cumsum(many[some])[:-1]], many[some]) + np.arange(many[some].sum())]
                yield self._extended(ids, p, q, size, least)

    def _extended(self, ids: np.ndarray, p: np.ndarray, q: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        same = np.ones(len(p), bool)
        for i in range(size):
            same &= ids[p + i] == self.ids[q + i]
        p, q = p[same], q[same]
        # meetings on one diagonal that touch lie in one shared span: the first of them is enough
        order = np.lexsort((p, p - q))
        p, q = p[order], q[order]
        fresh = np.r_[True, (np.diff(p - q) != 0) | (np.diff(p) > size)] if len(p) else np.empty(0, bool)
        p, q = p[fresh], q[fresh]
        left, right = np.zeros(len(p), np.int64), np.full(len(p), size)
        if least > size:
            for side, step in ((left, -1), (right, 1)):
                live = np.arange(len(p))
                while len(live):
                    reach = -side[live] - 1 if step < 0 else side[live]
                    live = live[ids[p[live] + reach] == self.ids[q[live] + reach]]
                    side[live] += 1
        enough = left + right >= least
        found = np.unique(np.stack([(p - left)[enough], (p + right)[enough], self.owner[q[enough]]]), axis=1)
        return found[0], found[1], found[2]


def _portions(many: np.ndarray) -> Iterator[slice]:
    start = total = 0
    for i, n in enumerate(many.tolist()):
        if total and total + n > PAIRS_AT_ONCE:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(many):
        yield slice(start, len(many))


def scan(texts: list[bytes], index: Index) -> Iterator[tuple[int, np.ndarray | None, list[str]]]:
    """(n_words, hit words or None, items) of each text."""
    flat, counts = [b""], []
    for b in texts:
        words = words_of(b)
        counts.append(len(words))
        flat += words
        flat.append(b"")
    ids = np.fromiter(map(index.vocabulary.get, flat, repeat(0)), np.int64, len(flat))
    first = 1 + np.r_[0, np.cumsum(np.array(counts[:-1], np.int64) + 1)].astype(np.int64)
    steps, touched = np.zeros(len(ids) + 1, np.int64), []
    for start, end, item in index.spans(ids):
        np.add.at(steps, start, 1)
        np.add.at(steps, end, -1)
        touched.append(np.stack([np.searchsorted(first, start, "right") - 1, item]))
    hit = np.cumsum(steps) > 0
    items: dict[int, list[str]] = {}
    if touched:
        for row, item in np.unique(np.concatenate(touched, axis=1), axis=1).T.tolist():
            items.setdefault(row, []).append(index.names[item])
    for i, n in enumerate(counts):
        yield n, hit[first[i] : first[i] + n] if i in items else None, items.get(i, [])


_indexes: dict[str, Index] = {}


def blocks_of(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items in parts of at most about ``limit`` bytes of text each; one item is never cut."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("name") + 16)).first()[0] or 0
    n = max(1, -(-2 * size // limit)) if size > limit else 1
    if n == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k) for k in range(n)]


def with_hits(df: DataFrame, benchmark: DataFrame, text: str = "text", limit: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``df`` with a struct column (n_words, n_hit, hits: bits of the hit words or null, items); and that column's name."""
    out = free_name(df, "found")
    shape = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])
    parts = blocks_of(benchmark, limit)
    for k, part in enumerate(parts):
        df = df.mapInArrow(_scanner(df.sparkSession, part, text, out if k else None, out), df.schema if k else T.StructType([*df.schema.fields, T.StructField(out, shape)]))
        if k < len(parts) - 1:
            df, _ = stage(df, "decontaminate")
    return df, out


def _scanner(spark: SparkSession, part: DataFrame, text: str, before: str | None, out: str):
    sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])
    key = uuid.uuid4().hex
    shape = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _indexes:
            _indexes.clear()
            _indexes[key] = Index(sent.value)
        index = _indexes[key]
        for batch in batches:
            texts = text_bytes(batch.column(batch.schema.get_field_index(text)))
            old = batch.column(batch.schema.get_field_index(before)).to_pylist() if before else [None] * len(texts)
            rows = []
            for a, b in slices(texts):
                for (n, hit, items), was in zip(scan(texts[a:b], index), old[a:b]):
                    if was and was["hits"] is not None:
                        earlier = np.unpackbits(np.frombuffer(was["hits"], np.uint8), count=n).astype(bool)
                        hit = earlier if hit is None else hit | earlier
                        items = sorted({*items, *was["items"]})
                    rows.append({"n_words": n, "n_hit": 0 if hit is None else int(hit.sum()), "hits": None if hit is None else np.packbits(hit).tobytes(), "items": sorted(items)})
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != before]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, shape)], names=[*[x for x in batch.schema.names if x != before], out])

    return run


def clean(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a hit word, with the columns of ``df``."""
    found, out = with_hits(df, benchmark)
    return found.where(F.col(f"{out}.n_hit") == 0).select(*[F.col(f"`{c}`") for c in df.columns])


def query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found, out = with_hits(documents.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", F.col(f"{out}.n_words").alias("n_words"), F.col(f"{out}.n_hit").alias("n_hit"), F.size(f"{out}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{out}.items", ","), 256).alias("items_sha256"), (F.col(f"{out}.n_hit") > 0).alias("contaminated"),
    )
