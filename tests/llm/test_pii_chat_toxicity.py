"""Personal data, chat trees and toxicity against brute force, on the small tables and on odd rows."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from resolva.llm import chat, pii, toxicity
from resolva.llm.common import table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), list(PLAIN).index(kind), f"{kind}:{m.start()}:{m.end()}", kind))
    return sorted(out)


def test_pii(spark, sf):
    texts = [None, "", "a@b.c_d@e.f x@y", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 00000001.2.3.4 1.2.3", "é😀 4111 1111 1111 1111, 4111111111111112 4-1-1-1", "+1 (555) 555-0128. +12345 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "9" * 30_000, "a" * 50_000 + "@", "1." * 20_000, "7 " * 20_000, "@.@..@a.b. a..b@c-.d", "call (555) 555-0128 or bob [at] site [dot] org", "\n+1-2\n3 x@y.z\r\n", "0.0.0.0 999.1.1.1.1", "1.2.3.4@a.b"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x@y.zz"), (3, texts[3])]
    odd = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, t long, candidates string")
    for df in (table(spark, sf, "documents").select("doc_id", "text"), odd):
        want = []
        for doc_id, text in df.select("doc_id", "text").collect():
            found = brute_spans(text)
            counts = [sum(f[3] == k for f in found) for k in PLAIN]
            want.append((doc_id, *counts, hashlib.sha256(",".join(f[2] for f in found).encode()).hexdigest(), {f[2] for f in found}))
        got = [tuple(r) for r in pii.query(df).collect()]
        assert sorted(map(str, (g[:6] for g in got))) == sorted(map(str, (w[:6] for w in want)))
        extra = {}
        for g in got:
            ours = next(w for w in want if w[0] == g[0] and w[5] == g[5])
            mine = [x for x in g[6].split(",") if x]
            assert ours[6] <= set(mine)
            extra[g[0]] = sorted(set(mine) - ours[6])
            begins = [int(x.split(":")[1]) for x in mine]
            assert begins == sorted(begins)
    assert extra[0] == [] and extra[6] == []
    assert pii.query(odd.limit(0)).count() == 0
    counts = {(2, 2, 1, 2, 1): 50.0, (1, 1, 2, 2, 1): 5.0, (0, 0, 0, 1, 0): 40.0, (0, 2, 2, 1, 1): 5.0}
    after = pii.expectation_maximisation(counts)
    assert after[2, 2, 1, 2, 1] > 0.9 and after[0, 0, 0, 1, 0] < 0.1 and after[1, 1, 2, 2, 1] > 0.5


def test_added_spans(spark):
    """Loose spans that the method must add, and look-alikes that it must not."""
    rows, want = [], {}
    hexes = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    for i in range(60):
        tail = f"{i:04d}"
        good = [("phone", f"call tel ", f"212-555-{tail}"), ("phone", "phone: ", f"(415) 555-{tail}"), ("email", "mail bob at ", f"bob{i} [at] site [dot] org"), ("secret", 'api token = "', hexes(i)[:36]), ("secret", "the key: ", "ghp_" + hexes(i)[:30])]
        kind, before, what = good[i % len(good)]
        rows.append((i, f"Some words é before, {before}{what} and after"))
        begin = rows[-1][1].index(what)
        want[i] = f"{kind}:{begin}:{begin + len(what)}"
        bad = [f"commit {hexes(i)[:40]} fixed it", f"see https://example.org/{hexes(i)} there", "averyveryverylongcompoundwordwithoutfigures", f"order no. 1234.5678.9012.{tail}", "in 1999 and 2000, pages 12-34"][i % 5]
        rows.append((1000 + i, bad))
        rows.append((2000 + i, f"write to a{i}@b.com or +1 (212) 555-{tail}"))
    got = {r.doc_id: r for r in pii.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [i for i in want if got[i].spans == want[i]]
    wrong = [i for i in range(1000, 1060) if got[i].spans]
    assert len(found) >= 0.95 * len(want), [(rows[3 * i], got[i].spans) for i in want if i not in found][:5]
    assert len(wrong) <= 0.02 * 60, [(got[i]) for i in wrong][:5]
    assert all(got[2000 + i].n_email == 1 and got[2000 + i].n_phone == 1 and got[2000 + i].n_spans == 2 for i in range(60))


def brute_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark, sf):
    text = chat.ATTACK + "<|turn|>x<|says|>\\<\\[ $1 é😀\\\\ <|end|><|done|>"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 1, "assistant", text), (2, 5, None, None), (2, None, "assistant", ""), (None, 0, "<|says|>\n", "q\n"), (3, 0, "assistant", "\n"), (4, 0, "user", "x" * 100_000)] + [(9, i, "user" if i % 2 else "assistant", f"{i}") for i in range(37)]
    odd = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, node long, formatted long")
    for df in (table(spark, sf, "conversations"), odd):
        want = brute_chat([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()] + [(-7, 0, "user", chat.ATTACK), (-7, 1, "assistant", chat.ATTACK)])
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.query(df).collect()}
        assert got == want
    assert chat.query(odd.limit(0)).count() == 1
    formatted = chat.format_trees(chat.chains(odd), 1).where("tree = 1").first().formatted
    assert formatted.count(chat.END) == 3 and "</s>" not in formatted and "[INST]" not in formatted


def test_chat_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = con.sql(chat.ORACLE).df()[columns]
    got = chat.query(table(spark, sf, "conversations")).toPandas()[columns]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_reply_trees(spark):
    nodes = [("t", "a", None, 0.0), ("t", "b", "a", 3.0), ("t", "c", "a", 1.0), ("t", "d", "c", 9.0), ("t", "e", "d", 0.0), ("t", "z", "lost", 9.0), ("t", "y", "z", 9.0), ("t", "p", "q", 5.0), ("t", "q", "p", 5.0), ("u", "r", None, None)]
    df = spark.createDataFrame(nodes, "tree string, node string, parent string, score double")
    got = {}
    for r in chat.paths(df).collect():
        got.setdefault((r.tree, r["rank"]), []).append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {("t", 1): ["a", "c", "d", "e"], ("t", 2): ["a", "b"], ("u", 1): ["r"]}
    assert {r.leaf for r in chat.paths(df, 1).collect()} == {"e", "r"}


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = toxicity.query(documents, labels)
    known = rows.join(labels, "doc_id").where("held_out").collect()
    assert len(known) > 500
    positive = [r for r in known if r.toxic]
    assert sum(r.predicted == r.toxic for r in known) >= 0.965 * len(known)  # one toxic text in ten has none of the telling words here
    assert sum(r.predicted for r in positive) >= 0.85 * len(positive)
    for r in rows.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    # neither language nor source nor labels of held-out rows change a score
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    changed = toxicity.query(documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), other)
    assert sorted((r.doc_id, round(r.score, 9)) for r in rows.collect()) == sorted((r.doc_id, round(r.score, 9)) for r in changed.collect())


def test_toxicity_odd_rows(spark):
    rows = [Row(doc_id=i, text="you idiot scum " * 3 if i % 2 else "a fine day today", lang=None) for i in range(60)]
    rows += [Row(doc_id=100, text=None, lang="en"), Row(doc_id=101, text="", lang="en"), Row(doc_id=None, text="x", lang=None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, 0, 1), (100, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.query(df, labels).collect()}
    assert len(got) == 63 and got[100].score == got[101].score
    assert all(got[i].predicted == i % 2 for i in range(60))
    assert toxicity.query(df.limit(0), labels).count() == 0
    assert [r.score for r in toxicity.query(df, labels.limit(0)).collect()] == [0.0] * 63


@pytest.mark.parametrize("n", [0, 1, 5])
def test_empty_texts_are_pooled_to_zero(n):
    params = toxicity.start([np.array([1, 2]), np.array([3])], np.array([1.0, 0.0]), 10, np.random.default_rng(0))
    assert toxicity.logits(params, [np.zeros(0, np.int64)] * n).shape == (n,)


def slow_logit(p, ids):
    """The network word by word: pads of zeros after the text, filters slid over it, largest outputs, one logistic layer."""
    pad = max(toxicity.WIDTHS) - 1
    words = [p["embed"][i].astype(float) for i in [*ids, *[0] * pad]]
    best = []
    for w in toxicity.WIDTHS:
        outputs = [[0.0] * toxicity.FILTERS]
        for begin in range(len(ids)):
            outputs.append([float(p[f"bias{w}"][f]) + sum(float(words[begin + i] @ p[f"filter{w}"][i][:, f]) for i in range(w)) for f in range(toxicity.FILTERS)])
        best += [max(o[f] for o in outputs) for f in range(toxicity.FILTERS)]
    return sum(a * float(b) for a, b in zip(best, p["out"])) + float(p["out_bias"][0])


def test_toxicity_network_against_plain_loops():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 30, n) for n in (0, 1, 2, 3, 7, 40, 200)]
    y = np.array([0, 1, 0, 1, 1, 0, 1], np.float32)
    p = toxicity.start(texts, y, 30, rng)
    for w in toxicity.WIDTHS:
        p[f"bias{w}"] = rng.normal(0, 0.2, toxicity.FILTERS).astype(np.float32)
    got = toxicity.logits(p, texts)
    for one, ids in zip(got, texts):
        assert one == pytest.approx(slow_logit(p, ids), abs=1e-4)


def test_toxicity_training_lowers_the_loss_on_texts_set_aside():
    rng = np.random.default_rng(6)
    texts = [np.r_[rng.integers(3, 60, 12), [1 if i % 2 else 2], rng.integers(3, 60, 9)] for i in range(200)]
    y = np.array([i % 2 for i in range(200)], np.float32)
    judge = texts[150:], y[150:]
    before = toxicity.loss(toxicity.start(texts[:150], y[:150], 60, np.random.default_rng(toxicity.SEED)), *judge)
    after = toxicity.loss(toxicity.train(texts[:150], y[:150], 60, judge), *judge)
    assert after < 0.5 * before and after < 0.4


def test_toxicity_clashing_names_and_long_texts(spark):
    rows = [(i, ("you idiot scum " if i % 2 else "a fine day today ") * 3, "en", 0.5, 1, "x") for i in range(60)]
    rows += [(70, "a fine day today " * 60_000, "en", 0.5, 1, "x"), (71, "a fine day today " * 30_000 + "you idiot scum", "en", 0.5, 1, "x"), (3, rows[3][1], "en", 0.5, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, label int, l_id string")
    labels = spark.createDataFrame([(i, i % 2, "y") for i in range(60)], "doc_id long, toxic int, text string")
    got = {}
    for r in toxicity.query(df, labels).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[3]) == 2 and got[3][0] == got[3][1]
    # nothing of a long text goes unread: its last words decide
    assert got[70][0].predicted == 0 and got[71][0].predicted == 1
