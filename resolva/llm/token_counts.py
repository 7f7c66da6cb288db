"""Token counts by a map-side lookup in two tiers.

Tier one is a compact table of the frequent pre-tokens (words between ASCII white space, see bpe.py) and their token counts,
made once from a bounded sample of ``SAMPLE_ROWS`` documents and broadcast: at most ``FREQUENT`` words of at most
``WORD_BYTES`` bytes, about 1 MB. It is only a head start and never decides a result. Tier two is a cache in each Python
worker: words that tier one lacks are encoded by the library, once for each worker, and remembered. Neither words nor texts
are shuffled.

Null counts as the empty text: 0 bytes, 0 tokens. Long texts are counted whole. Repeated rows get the same count each. An empty
table gives an empty result; ties between frequent words only decide which are broadcast. Columns other than doc_id and text
are not read, whatever their names. The tokenizer's file is found by each worker for itself.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import TOGETHER_BYTES, Encoder, tokenizer_path
from .common import slices, text_bytes

LIMIT = 2048
SAMPLE_ROWS = 2048
FREQUENT = 1 << 16
WORD_BYTES = 32
SAMPLERS = 8


def frequent_words(docs: DataFrame, path: str | None, rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> tuple[bytes, np.ndarray]:
    """(words joined by blanks, their token counts): the most frequent words of a seeded sample of about ``rows`` documents."""
    some = docs.select("text").sample(min(1.0, rows / max(docs.count(), 1)), 7)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = Encoder(path or tokenizer_path()), Counter()
        for batch in batches:
            for b in text_bytes(batch.column(0)):
                seen.update(w for w in coder.words(b) if len(w) <= WORD_BYTES)
                if len(seen) > 4 * most:
                    seen = Counter(dict(seen.most_common(most)))
        top = seen.most_common(most // SAMPLERS)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([c for _, c in top], pa.int64())], names=["word", "n"])

    seen: Counter[bytes] = Counter()
    for word, count in some.coalesce(SAMPLERS).mapInArrow(run, "word binary, n long").collect():  # FREQUENT rows at most
        seen[bytes(word)] += count
    words = [w for w, _ in seen.most_common(most)]
    return b" ".join(words), np.array([len(x) for x in Encoder(path or tokenizer_path()).encoded(words)], np.uint8)


class Counts(Encoder):
    """Token counts of texts: the broadcast table, then the worker's own cache, then the library."""

    def __init__(self, path: str, words: bytes = b"", lengths: Iterable[int] = ()) -> None:
        super().__init__(path, len)
        self.table = dict(zip(words.split(b" "), map(int, lengths)))

    def counts(self, texts: list[bytes]) -> list[int]:
        out: list[int] = []
        for a, b in slices(texts, TOGETHER_BYTES):
            values, places, firsts = self.coded(texts[a:b])
            sums = np.r_[0, np.cumsum(np.array(values, np.int64)[places])]
            out += np.diff(sums[firsts]).tolist()
        return out


_counts: dict[str, Counts] = {}


def with_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit)."""
    docs = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, path))

    key = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counts:
            _counts.clear()
            _counts[key] = Counts(path or tokenizer_path(), *sent.value)
        counter = _counts[key]
        for batch in batches:
            texts = text_bytes(batch.column(1))
            n = np.array(counter.counts(texts), np.int64)
            sizes = np.array([len(b) for b in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long")
    return docs.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def query(documents: DataFrame) -> DataFrame:
    return with_counts(documents)
