"""Toxicity by a convolutional text classifier, trained in numpy.

Words (as in the decontamination operator: lower case, punctuation dropped) are hashed into an embedding table; filters of
several widths slide over the whole text, their largest outputs are kept, and a logistic layer makes a score of them. The
first embedding coordinate starts from the smoothed log-odds of each hash bucket in the training texts; everything is then
trained by Adam. Scoring is map-only: the weights, a fixed few hundred KB, are broadcast.

Training rows are labelled rows that ``trains`` admits. At most ``SAMPLE`` of each label are fitted, the first in the order of
a seeded hash, a bounded and documented sample; one in four of them is set aside for calibration. There the raw score is
mapped (one monotone line on the logit) so that ``CUT`` is the best common threshold, and a threshold of its own is found
for each language. Language, source and doc_id are no inputs of a score; the language threshold only gives ``flagged``.

Null and empty texts have no words: they get the score of the last layer's bias alone, whatever side of the cut that is.
A text's score depends on no other row. Texts are scored whole. Repeated
rows score alike. Without a labelled row of either kind all scores are 0. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, text_bytes
from .decontaminate import words_of

BUCKETS = 1 << 22
#: Buckets get a row of the embedding table if so many training texts have them, and at most so many do.
TEXTS_MIN, ROWS_MAX = 4, 1 << 15
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
SAMPLE = 3000
EPOCHS = 8
#: Texts, split like the labels, that every hash bucket is taken to have had before.
PRIOR = 10
SEED = 11
CUT = 0.7
WORDS_MAX = 1 << 18
Params = dict[str, np.ndarray]


def buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, len(words))


def table_rows(hashed: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The embedding rows of buckets: 1 on; 0, which stays zero, for those without one and for padding."""
    if not len(kept):
        return np.zeros(len(hashed), np.int64)
    at = np.minimum(np.searchsorted(kept, hashed), len(kept) - 1)
    return np.where(kept[at] == hashed, at + 1, 0)


def kept_buckets(texts: list[np.ndarray]) -> np.ndarray:
    seen, texts_with = np.unique(np.concatenate([np.unique(t) for t in texts] or [np.zeros(0, np.int64)]), return_counts=True)
    seen, texts_with = seen[texts_with >= TEXTS_MIN], texts_with[texts_with >= TEXTS_MIN]
    return np.sort(seen[np.argsort(-texts_with, kind="stable")[:ROWS_MAX]])


def start(texts: list[np.ndarray], y: np.ndarray, size: int, rng: np.random.Generator) -> Params:
    has = np.zeros((2, size))
    for ids, label in zip(texts, y):
        has[int(label), np.unique(ids)] += 1
    share = np.bincount(y.astype(int), minlength=2)[:, None] / len(y)
    seen = has + PRIOR * share
    odds = np.log(seen / share)
    lean = odds[1] - odds[0]
    sure = np.maximum(np.abs(lean) - 2 * np.sqrt((1 / seen).sum(axis=0)), 0)  # a lean within two standard errors is none
    p: Params = {"embed": rng.normal(0, 0.02, (size, SIZE))}
    p["embed"][:, 0] += np.clip(np.sign(lean) * sure, -4, 4) / 2
    p["embed"][0] = 0
    for w in WIDTHS:
        p[f"filter{w}"] = rng.normal(0, 0.3 / np.sqrt(w), (w, SIZE, FILTERS))
        p[f"filter{w}"][:, 0, 0] += 1.0 / w
        p[f"bias{w}"] = np.zeros(FILTERS)
    p["out"] = rng.normal(0, 0.1, len(WIDTHS) * FILTERS)
    p["out"][::FILTERS] += 1.0
    p["out_bias"] = np.array([-1.0])
    return {k: v.astype(np.float32) for k, v in p.items()}


def pooled(p: Params, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest outputs of all filters over each text, and where. ``ids``: texts one after the other, each followed by
    max(WIDTHS) - 1 pads, from ``first`` on; an empty text is pads only. Windows begin at words: those that begin at a pad
    would reach into the next text and count as 0."""
    pad = max(WIDTHS) - 1
    pads = np.concatenate([np.r_[first[1:], len(ids)] - 1 - i for i in range(pad)])
    x = p["embed"][ids]
    best, where = [], []
    for w in WIDTHS:
        m = len(ids) - pad
        flat = sum(x[i : i + m] @ p[f"filter{w}"][i] for i in range(w)) + p[f"bias{w}"]
        flat = np.maximum(np.concatenate([flat, np.zeros((pad, FILTERS), np.float32)]), 0)
        flat[pads] = 0
        top = np.maximum.reduceat(flat, first, axis=0)
        best.append(top)
        where.append(flat)
    return np.concatenate(best, axis=1), where


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pad = np.zeros(max(WIDTHS) - 1, np.int64)
    parts = [x for t in texts for x in (t, pad)]
    return np.concatenate(parts), np.r_[0, np.cumsum([len(t) + len(pad) for t in texts])[:-1]]


def logits(p: Params, texts: list[np.ndarray]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    best, _ = pooled(p, *laid_out(texts))
    return best.astype(np.float64) @ p["out"] + p["out_bias"][0]


def loss(p: Params, texts: list[np.ndarray], y: np.ndarray) -> float:
    """Log loss with both labels weighing the same."""
    wrong = np.logaddexp(0, np.where(y > 0, -1, 1) * logits(p, texts))
    return float(wrong[y > 0].mean() + wrong[y < 1].mean())


def train(texts: list[np.ndarray], y: np.ndarray, size: int, judge: tuple[list[np.ndarray], np.ndarray], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01) -> Params:
    """The parameters after the epoch that has the least loss on the texts and labels of ``judge``."""
    rng = np.random.default_rng(SEED)
    p = start(texts, y, size, rng)
    first_moment = {k: np.zeros_like(v) for k, v in p.items()}
    second_moment = {k: np.zeros_like(v) for k, v in p.items()}
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    step, least, kept = 0, loss(p, *judge), {k: v.copy() for k, v in p.items()}
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            ids, first = laid_out([texts[i] for i in chosen])
            best, flat = pooled(p, ids, first)
            score = 1 / (1 + np.exp(-(best @ p["out"] + p["out_bias"][0])))
            error = ((score - y[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            grad: Params = {"out": best.T @ error + 1e-4 * p["out"], "out_bias": np.array([error.sum()], np.float32)}
            back = error[:, None] * p["out"][None, :]
            grad_embed = np.zeros((0, SIZE), np.float32)
            touched = np.zeros(0, np.int64)
            for j, w in enumerate(WIDTHS):
                part = slice(j * FILTERS, (j + 1) * FILTERS)
                top, g = best[:, part], back[:, part] * (best[:, part] > 0)
                # the winner of each text and filter: the first place that reaches the largest output
                ends = np.r_[first[1:], len(ids)]
                at = np.stack([a + np.argmax(flat[j][a:b], axis=0) for a, b in zip(first, ends)])
                gf = np.zeros_like(p[f"filter{w}"])
                for i in range(w):
                    word = ids[np.minimum(at + i, len(ids) - 1)]
                    x = p["embed"][word]
                    gf[i] = np.einsum("df,dfs->sf", g, x)
                    touched = np.r_[touched, word.ravel()]
                    grad_embed = np.concatenate([grad_embed, (g[:, :, None] * p[f"filter{w}"][i].T[None]).reshape(-1, SIZE)])
                grad[f"filter{w}"], grad[f"bias{w}"] = gf, g.sum(axis=0)
                del top
            step += 1
            rows, inverse = np.unique(touched, return_inverse=True)
            ge = np.zeros((len(rows), SIZE), np.float32)
            np.add.at(ge, inverse, grad_embed)
            ge[rows == 0] = 0
            for name, g, place in [("embed", ge, rows), *((n, v, slice(None)) for n, v in grad.items())]:
                m, v = first_moment[name], second_moment[name]
                m[place] = 0.9 * m[place] + 0.1 * g
                v[place] = 0.99 * v[place] + 0.01 * g * g
                # embeddings move a tenth as far: most buckets are seen a few times only
                p[name][place] -= (0.1 if name == "embed" else 1) * rate * m[place] / (1 - 0.9**step) / (np.sqrt(v[place] / (1 - 0.99**step)) + 1e-7)
        if (now := loss(p, *judge)) < least:
            least, kept = now, {k: v.copy() for k, v in p.items()}
    return kept


def best_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1, in the middle of the gap below it."""
    order = np.argsort(-raw, kind="stable")
    s, hits = raw[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + max(1, y.sum()))
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 0.5)


def fit(rows: list[tuple[bytes, str, int]]) -> dict:
    """``rows`` (text, lang, label), in a fixed order -> the model: parameters, the line on the logit, cuts by language."""
    y = np.array([r[2] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return {"params": None, "cuts": {}}
    hashed = [buckets(words_of(r[0])) for r in rows]
    kept = kept_buckets(hashed)
    texts = [table_rows(h, kept) for h in hashed]
    aside = np.arange(len(rows)) % 4 == 3
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside[:] = False
    held = aside if aside.any() else ~aside
    judge = [t for t, h in zip(texts, held) if h], y[held]
    params = train([t for t, a in zip(texts, aside) if not a], y[~aside], len(kept) + 1, judge)
    raw = logits(params, judge[0])
    cut, spread = best_cut(raw, y[held]), max(1e-3, float(np.std(raw)) / 2)
    langs = np.array([r[1] or "" for r in rows])[held]
    cuts = {}
    for lang in sorted(set(langs.tolist())):
        own = langs == lang
        if y[held][own].sum() >= 5 and (1 - y[held][own]).sum() >= 5:
            cuts[lang] = float(squash(np.array([best_cut(raw[own], y[held][own])]), cut, spread)[0])
    return {"params": params, "kept": kept, "cut": cut, "spread": spread, "cuts": cuts}


def squash(raw: np.ndarray, cut: float, spread: float) -> np.ndarray:
    """The threshold ``cut`` goes to CUT, monotone into 0 .. 1."""
    at = np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip((raw - cut) / spread * 2 + at, -500, 500)))


def sample(documents: DataFrame, labels: DataFrame, trains: Column, label: str = "toxic", most: int = SAMPLE) -> list[tuple[bytes, str, int]]:
    """At most ``most`` labelled training rows of each label, in the order of a seeded hash."""
    admitted = labels.where(trains).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    picked = [admitted.where(F.col("label") == k).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most) for k in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("l_id"), "label")
    rows = documents.select("doc_id", "text", "lang").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))  # 2 * most ids at most
    rows = rows.withColumn("rn", F.xxhash64(F.lit(SEED), "doc_id", "text")).orderBy("rn", "doc_id").select("text", "lang", "label").limit(4 * most)
    return [((r.text or "").encode(), r.lang, int(r.label)) for r in rows.collect()]


def score(documents: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and score."""
    sent, key = documents.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        if key not in _known:
            _known.clear()
            _known[key] = {}
        known = _known[key]
        for batch in batches:
            texts = text_bytes(batch.column(batch.schema.get_field_index(text)))
            if model["params"] is None:
                out = np.zeros(len(texts))
            else:
                raw = [logits(model["params"], list(_rows_of(texts[a:b], model["kept"], known))) for a, b in slices(texts, 1 << 20)]
                out = squash(np.concatenate(raw or [np.zeros(0)]), model["cut"], model["spread"])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(out, pa.float64())], names=[*keep, "score"])

    return documents.mapInArrow(run, documents.select(*keep).schema.add("score", "double"))


_known: dict[str, dict[bytes, int]] = {}


def _rows_of(texts: list[bytes], kept: np.ndarray, known: dict[bytes, int]) -> Iterator[np.ndarray]:
    lists = [words_of(b) for b in texts]
    new = list(set().union(*lists).difference(known))
    if len(known) + len(new) > WORDS_MAX:
        known.clear()
        new = list(set().union(*lists))
    known.update(zip(new, table_rows(buckets(new), kept).tolist()))
    for words in lists:
        yield np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(sample(documents, labels, ~held_out(F.col("doc_id"))))
    scored = score(documents.select("doc_id", "text", "lang"), model, ["doc_id", "lang"])
    cuts = F.lit(None).cast("double")
    for lang, cut in model["cuts"].items():
        cuts = F.when(F.col("lang") == lang, F.lit(cut)).otherwise(cuts)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (F.col("score") >= F.coalesce(cuts, F.lit(CUT))).alias("flagged"))
