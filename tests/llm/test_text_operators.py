"""The operators on texts against brute force, on the small tables and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

import corpus_pipeline
from resolva.llm import bpe, decontaminate, mixing, quality, rans, simhash, token_counts, token_store
from resolva.llm.common import table
from resolva.llm.components import connected_components

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("Found", T.LongType()), T.StructField("u", T.LongType())])


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here at all"), (5, long), (5, long), (6, "Same text, twice. " * 30), (7, "Same text, twice. " * 30), (8, "İ ﬁ 日本 <|endoftext|> é \x00 \x85"), (9, "a"), (None, None)]
    return spark.createDataFrame([(i, t, None, None if i == 7 else "s", "x", 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def frames(spark, sf, odd):
    return [table(spark, sf, "documents"), odd]


def ids_and_texts(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=str)


def test_decontaminate(spark, sf, odd):
    bench = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    bench += [(100, None), (101, ""), (102, "of the"), (103, bench[3][1]), (None, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x13 w14x14 w15x15"), (104, "here AT all")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    windows = {}
    for i, t in bench:
        w = WORD.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    for df in frames(spark, sf, odd):
        want = []
        for doc_id, text in ids_and_texts(df):
            w = WORD.findall((text or "").translate(LOW))
            hit, items = np.zeros(len(w), bool), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if found := windows.get(tuple(w[k : k + n])):
                        hit[k : k + n] = True
                        items |= found
            want.append((doc_id, len(w), int(hit.sum()), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit.any())))
        columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert by_id(decontaminate.query(df, benchmark), *columns) == sorted(want, key=str)
    found, out = decontaminate.with_hits(odd, benchmark, limit=500)  # many blocks of the benchmark
    whole, out2 = decontaminate.with_hits(odd, benchmark)
    assert sorted(map(str, found.select("doc_id", f"{out}.*").collect())) == sorted(map(str, whole.select("doc_id", f"{out2}.*").collect()))
    assert decontaminate.query(odd, benchmark.limit(0)).where("contaminated").count() == 0


def brute_quality(text):
    words = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = np.zeros(len(words), bool)
    for k, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            covered[k : k + 3] = True
    n, repeated = len(words), int(covered.sum())
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeated, n < 50 or 100 * repeated > 50 * n


def test_quality(spark, sf, odd, none):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df in frames(spark, sf, odd):
        got = quality.query(df)
        assert by_id(got, *columns) == sorted(((i, *brute_quality(t)) for i, t in ids_and_texts(df)), key=str)
        assert got.where("base_failed and kept").count() == 0
    assert quality.query(none).count() == 0
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").join(quality.query(docs), "doc_id").where("not base_failed")
    assert labels.where("quality = 1 and not kept").count() <= 0.01 * labels.where("quality = 1").count()
    assert sorted(quality.keep(odd).columns) == sorted(odd.columns)
    assert quality.repeated_words(b"a b c a b c x".split()) == 6


def test_ablation(spark, sf):
    judged = quality.query(table(spark, sf, "documents"))
    bits = [r.fail_bits for r in judged.select("fail_bits").collect()]
    mask = quality.POLICIES["web-2"]
    for r in quality.ablation(judged).collect():
        bit = quality.BIT[r.rule]
        assert r.failed == sum(b & bit != 0 for b in bits)
        assert r.only_this_rule == sum(b & mask == bit for b in bits)
        assert r.kept_without == sum(b & (mask ^ bit) == 0 for b in bits)


def brute_fingerprint(text):
    w = SPACED.findall((text or "").translate(LOW))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3) if w else 0)]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(x) for x in range(n)]


def test_simhash(spark, sf, odd, none):
    for df in frames(spark, sf, odd):
        rows = ids_and_texts(df)
        prints = [brute_fingerprint(t) for _, t in rows]
        value = np.array(prints, np.uint64)
        pairs = [(a, b) for a in range(len(rows)) for b in np.flatnonzero(np.bitwise_count(value[: a + 1] ^ value[a]) <= 4)]
        root = roots(len(rows), pairs)
        least = {}
        for k, (doc_id, _) in enumerate(rows):
            if doc_id is not None:
                least[root[k]] = min(doc_id, least.get(root[k], doc_id))
        want = [(doc_id, f"{prints[k]:016x}", least.get(root[k])) for k, (doc_id, _) in enumerate(rows)]
        assert by_id(simhash.query(df), "fingerprint", "component_id") == sorted(want, key=str)
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns and kept.count() == len(set(root))
    assert simhash.query(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_links_in_one_shard():
    rng = np.random.default_rng(3)
    for n, centres in ((900, 30), (3000, 2)):
        centre = rng.integers(0, 2**63, centres, dtype=np.uint64)
        flips = rng.integers(0, 64, (n, 6)).astype(np.uint64)
        near = centre[rng.integers(0, centres, n)]
        for k in range(6):
            near = np.where(rng.random(n) < 0.6, near ^ (np.uint64(1) << flips[:, k]), near)
        values = np.unique(near)
        pairs = [(a, b) for a in range(len(values)) for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 4)]
        place = {int(v): k for k, v in enumerate(values)}
        links = simhash.shard_links(values)
        assert len(links) < len(values) and all((a ^ b).bit_count() <= 4 for a, b in links)
        assert roots(len(values), pairs) == roots(len(values), [(place[a], place[b]) for a, b in links])


def test_components(spark):
    rng = np.random.default_rng(1)
    chain = [(k, k + 1) for k in range(100, 400)]
    edges = [tuple(map(int, e)) for e in rng.integers(1000, 1400, (300, 2))] + chain + [(7, 7), (None, 3), (2000, 1), *[(5000, k) for k in range(5001, 5200)]]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = roots(6000, [e for e in edges if None not in e])
    assert got == {k: r for k, r in enumerate(root) if r != k}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_counts(spark, sf, odd, none):
    library = bpe.Encoder(bpe.tokenizer_path()).library
    for df in frames(spark, sf, odd):
        want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ids_and_texts(df)]
        assert by_id(token_counts.query(df), "n_bytes", "n_tokens", "over_limit") == sorted(((*w, w[2] > 2048) for w in want), key=str)
    assert token_counts.query(none).count() == 0


def test_counts_do_not_depend_on_the_sample(spark, odd, monkeypatch):
    columns = ("n_bytes", "n_tokens", "over_limit")
    want = by_id(token_counts.query(odd), *columns)
    sample = token_counts.frequent_words
    for other in (lambda docs, path: (b"", []), lambda docs, path: sample(docs.limit(1), path), lambda docs, path: sample(docs, path, 10**9)):
        monkeypatch.setattr(token_counts, "frequent_words", other)
        assert by_id(token_counts.query(odd), *columns) == want


def test_words_alone_give_the_ids_of_the_text(monkeypatch):
    coder = bpe.Encoder(bpe.tokenizer_path())
    texts = ["", " ", "a<|endoftext|>b <|startoftext|>", "x <|ENDOFTEXT|> y", "İstanbul ĲǅÀ", "don't we'll ''s 'S é ²½ x y\x85z\x1c q​w", "日本語 ﬁ", "é J̌ a b", "5. 5.5, ..., .a é, é!", "ŉ ǰ ß ſ ª º Ⱥ", "ΑΣ ΑΣ."]
    texts += [chr(c) + s for c in range(0x20, 0x3000, 11) for s in ("", "a b" + chr(c) + "c", ".", "x, a.")]
    want = [coder.library.encode(t, add_special_tokens=False).ids for t in texts]
    raw = [t.encode() for t in texts]
    assert [x.tolist() for x in coder.ids(raw)] == want
    monkeypatch.setattr(bpe, "TABLE_MAX", 50)
    assert [x.tolist() for x in bpe.Encoder(bpe.tokenizer_path()).ids(raw)] == want


def test_rans_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 31, 32, 33, rans.BLOCK - 1, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK + 77):
        for ids in (rng.integers(0, 49408, n), np.full(n, 3), (rng.exponential(30, n)).astype(np.int64), rng.integers(0, 2**32, n)):
            data = rans.encode(ids)
            assert (rans.decode(data) == ids).all()
    assert (rans.decode(rans.encode(ids), (1, 3)) == ids[rans.BLOCK : 3 * rans.BLOCK]).all()
    words = rans.HEAD.unpack_from(data)[8]
    broken = bytearray(data)
    broken[-4 * words + 50] ^= 1  # in the first block
    with pytest.raises(ValueError):
        rans.decode(bytes(broken))
    with pytest.raises(ValueError):
        rans.decode(b"NOPE" + data[4:])


def test_token_store(spark, sf, odd, none, monkeypatch):
    library = bpe.Encoder(bpe.tokenizer_path()).library
    monkeypatch.setattr(token_store, "SEGMENT", 10_000)
    for df in frames(spark, sf, odd):
        rows, got = ids_and_texts(df), by_id(token_store.query(df), "start", "n_tokens", "ids_crc32")
        want = []
        for doc_id, text in rows:
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            want.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
        assert sorted((g[0], g[2], g[3]) for g in got if g[0] is not None) == sorted(w for w in want if w[0] is not None)
        at = 0
        for doc_id, start, n, _ in sorted(got, key=lambda g: g[1]):
            assert start == at
            at += n
        order = [g[0] for g in sorted(got, key=lambda g: g[1])]
        assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_store.query(none).count() == 0


def water_fill(sizes, budget=1.5, epochs=2):
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, full, left = {}, set(), budget * sum(sizes.values())
    while True:
        rest = [s for s in sources if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > epochs * sizes[s]]
        if not above:
            return target | share
        for s in above:
            full.add(s)
            target[s] = epochs * sizes[s]
            left -= target[s]


def test_mixing(spark, sf, odd, none):
    for df in frames(spark, sf, odd):
        rows = df.select("doc_id", "text", "source").collect()
        sizes = Counter()
        for r in rows:
            sizes[r.source] += len(SPACED.findall(r.text or ""))
        goal, got = water_fill(sizes), mixing.query(df).collect()
        assert len(got) == len(rows)
        source = {r.doc_id: r.source for r in rows}
        taken, largest = Counter(), Counter()
        for r in got:
            if r.doc_id is None:
                taken[None if r.source_size == sizes[None] and sizes[None] != sizes["s"] else "s"] += r.taken
                continue
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 2 * r.size
            taken[s] += r.taken
            largest[s] = max(largest[s], r.size)
        for s in goal:
            assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1
        assert sorted(map(str, got)) == sorted(map(str, mixing.query(df.repartition(5)).collect()))
    assert mixing.query(none).count() == 0


def test_no_row_beyond_the_epochs_and_clashing_names(spark):
    rows = [(i, "a b c" if i % 4 == 0 else "", "x") for i in range(40)] + [(100 + i, "w " * 400, "y") for i in range(5)]
    rows += [(70, "one two", "x"), (70, "one two", "x"), (None, None, None), (None, "q r s", None)]
    df = spark.createDataFrame([(*r, 1, 2, 3, "z") for r in rows], "doc_id long, text string, source string, copies long, mix_k long, Total long, size string")
    times = Counter(r.doc_id for r in mixing.repeat_rows(df).collect())
    per = Counter(i for i, _, _ in rows)
    assert all(times[i] <= 2 * per[i] for i in per) and mixing.repeat_rows(df).columns == df.columns
    want = Counter()
    for r in mixing.query(df).collect():
        want[r.doc_id] += r.taken
    size = {i: len((t or "").split()) for i, t, _ in rows if i is not None}
    assert all(times[i] * size[i] == want[i] for i in size)


def test_repetitive_texts_do_not_hang():
    index = decontaminate.Index([("1", "word " * 800), ("2", "a b c d e f g h i j k " * 40)])
    texts = [b"word " * 8000, b"x " + b"word " * 10 + b"y", b"word " * 9, b"a b c d e f g h i j k " * 400]
    got = [(n, 0 if hit is None else int(hit.sum()), items) for n, hit, items in decontaminate.scan(texts, index)]
    assert got == [(8000, 8000, ["1"]), (12, 10, ["1"]), (9, 0, []), (4400, 4400, ["2"])]


def test_stages_on_odd_tables(spark, small, odd, none):
    clash = odd.withColumnsRenamed({"n_words": "copies", "Found": "going_rid", "u": "mix_n"}).unionByName(odd.withColumnsRenamed({"n_words": "copies", "Found": "going_rid", "u": "mix_n"}))
    for df in (clash, none):
        for name, f in corpus_pipeline.STAGES[:-1]:
            assert f(spark, df, small).columns == df.columns, name
            assert f(spark, df, small).count() <= 2 * df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, small).count() == df.count()


def test_pipeline(spark, small):
    docs = table(spark, small, "documents")
    names = docs.columns
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, small)
        assert docs.columns == names, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 0
    ran = corpus_pipeline.run(spark, small)
    assert ran.count() == docs.count()


def passes_all_rules(text):
    n, chars, symbols, dup_lines, _, base_failed = brute_quality(text)
    n_lines = len([x for x in text.split("\n") if SPACED.search(x)])
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    return not (base_failed or 10 * symbols > n or 2 * dup_lines > n_lines or chars < 2 * n or chars > 12 * n or (upper > lower and upper >= 20))


def test_pipeline_against_brute_force(spark, small):
    docs = {r.doc_id: r for r in table(spark, small, "documents").collect()}
    left = sorted(i for i, r in docs.items() if passes_all_rules(r.text or ""))
    prints = np.array([brute_fingerprint(docs[i].text) for i in left], np.uint64)
    root = roots(len(left), [(a, b) for a in range(len(left)) for b in range(a) if int(prints[a] ^ prints[b]).bit_count() <= 4])
    left = [i for k, i in enumerate(left) if root[k] == k]
    windows = set()
    for r in table(spark, small, "benchmark").collect():
        w = WORD.findall((r.text or "").translate(LOW))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    words = {i: WORD.findall((docs[i].text or "").translate(LOW)) for i in left}
    clean = [i for i in left if not any(tuple(words[i][k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(words[i]) - n + 1))]
    assert 0 < len(clean) < len(left) < len(docs)
    size = {i: len(SPACED.findall(docs[i].text)) for i in clean}
    sizes, largest = Counter(), Counter()
    for i in clean:
        sizes[docs[i].source] += size[i]
        largest[docs[i].source] = max(largest[docs[i].source], size[i])
    goal = water_fill(sizes)
    got = sorted(corpus_pipeline.run(spark, small).collect(), key=lambda r: r.start)
    times = Counter(r.doc_id for r in got)
    assert set(times) <= set(clean)
    taken = Counter()
    for i in clean:
        source = docs[i].source
        whole = int(goal[source] / sizes[source] + 1e-9)
        assert whole <= times[i] <= min(2, whole + 1)
        taken[source] += times[i] * size[i]
    assert all(abs(taken[s] - goal[s]) <= largest[s] / 2 + 1 for s in goal)
    library, at = bpe.Encoder(bpe.tokenizer_path()).library, 0
    for r in got:
        ids = np.array([*library.encode(docs[r.doc_id].text, add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
