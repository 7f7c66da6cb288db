"""Blocking, retrieval, features, decisions, metrics, mining, models and streams on hand-made records."""

import pytest
from pyspark.sql import functions as F

from resolva.operators import blocking, decide, features, metrics, mining, models, retrieval, splits, validate, views
from resolva.sources import tables
from resolva.streaming import resolver

RECORDS = [
    ("S1-001", "Novent Owl PLLC", "9308 Home Ct, Des Plaines, IL", "US"), ("S1-002", "Boulangerie Parisienne SARL", "12 Rue de Rivoli, 75001 Paris", "FR"), ("S1-003", "Solar Hub", "5 Lake Rd, Pune 411001", "India"), ("S1-004", "", "900 Market St, Austin, TX 78701", "US"),
    ("S2-101", "Novent Ówl", "9308 Home Court, Des Plaines, Illinois", "US"), ("S3-102", "Novent [Owl], Inc", "9308 Home Ct Des Plaines", "US"), ("S3-20", "Boulangerie Parisienne", "12 r. de Rivoli, 75001 Paris", "fr"), ("S2-30", "", "900 Market Street, Austin, TX 78701", "US"),
    ("S2-40", "Solar Hub", "5 Lake Rd, Pune 411001", "US"), ("S2-50", "Another Company", "1 Nowhere Blvd", "US"),
]
TRUTH = [("S1-001", "S2-101"), ("S1-001", "S3-102"), ("S1-002", "S3-20"), ("S1-004", "S2-30")]


@pytest.fixture(scope="module")
def sides(spark):
    df = spark.createDataFrame(RECORDS, "entity_id string, business_name string, business_address string, country string")
    return views.split_sides(views.with_views(df).persist())


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame(TRUTH, "sid string, tid string")


def pairs_of(df):
    return {(r.sid, r.tid) for r in df.select("sid", "tid").collect()}


def test_blocking(spark, sides, truth):
    found = pairs_of(blocking.candidates(*sides))
    assert set(TRUTH) <= found
    assert ("S1-003", "S2-40") not in found  # another country
    again = pairs_of(blocking.candidates(sides[0].repartition(7), sides[1].repartition(3)))
    assert again == found
    row = blocking.report(sides[0], blocking.candidates(*sides), truth, 6).first()
    assert row.recall == 1.0 and row.found == 4


def test_bucket_caps_drop_heavy_keys(spark, sides):
    many = spark.createDataFrame([(f"S2-{i}", "Common Name", "", "us") for i in range(200)], "entity_id string, business_name string, business_address string, country string")
    one = spark.createDataFrame([("S1-1", "Common Name", "", "us")], "entity_id string, business_name string, business_address string, country string")
    assert blocking.candidates(views.with_views(one), views.with_views(many)).count() == 0
    assert blocking.candidates(views.with_views(one), views.with_views(many.limit(100))).count() == 100


def test_retrieval(sides, truth):
    hits = retrieval.hits(*sides).persist()
    assert set(TRUTH) <= pairs_of(hits)
    channels = {(r.sid, r.tid): set(r.c) for r in hits.groupBy("sid", "tid").agg(F.collect_set("channel").alias("c")).collect()}
    assert {"exact_name", "bm25_name", "reverse"} <= channels["S1-001", "S2-101"]
    assert "missing_field" in channels["S1-004", "S2-30"] and "numeric_loc" in channels["S1-002", "S3-20"]
    rolled = retrieval.provenance(hits)
    row = rolled.where("sid = 'S1-001' and tid = 'S2-101'").first()
    assert row.by_exact_name == 1 and row.two_way == 1 and row.best_rank == 0 and row.reciprocal_rank == 1
    assert set(TRUTH) <= pairs_of(retrieval.budget_cut(rolled, sides[0]))
    assert not {"bm25_name", "bm25_addr"} & {r.channel for r in retrieval.hits(*sides, use_bm25=False).select("channel").distinct().collect()}


def test_features(sides, truth):
    matrix = features.feature_matrix(retrieval.provenance(retrieval.hits(*sides)), *sides)
    assert len(features.PAIR) == 86 and len(features.ALL) == 96 and matrix.columns == ["sid", "tid", *features.ALL]
    row = matrix.where("sid = 'S1-001' and tid = 'S2-101'").first()
    assert row.name_legal == 1 and row.house == 1 and row.has_peer == 1 and row.peer_jaccard == 1 and row.x_country == 1 and row.is_s2 == 1
    assert matrix.where("sid = 'S1-004' and tid = 'S2-30'").first().name_missing == 1
    assert matrix.select(*[F.count(F.when(F.col(c).isNull() | F.isnan(c), 1)).alias(c) for c in features.ALL]).first() == tuple([0] * 96)


def scored(spark, rows):
    return spark.createDataFrame(rows, "sid string, tid string, score double")


def test_decisions(spark, sides):
    s = scored(spark, [("S1-1", "S2-10", 0.95), ("S1-1", "S3-20", 0.88), ("S1-1", "S2-11", 0.7), ("S1-2", "S2-99", 0.15), ("S1-3", "S2-10", 0.7)])
    policy = decide.precision_policy(s)
    assert pairs_of(policy) == {("S1-1", "S2-10"), ("S1-1", "S3-20"), ("S1-3", "S2-10")}
    assert pairs_of(decide.exclusive(policy)) == {("S1-1", "S2-10"), ("S1-1", "S3-20")}
    assert pairs_of(decide.expected_f05(s)) == {("S1-1", "S2-10"), ("S1-1", "S3-20"), ("S1-1", "S2-11"), ("S1-3", "S2-10")}
    assert pairs_of(decide.source_partition(s.where("sid = 'S1-1'"))) == {("S1-1", "S2-10"), ("S1-1", "S3-20")}
    cross = scored(spark, [("S1-003", "S2-40", 0.9), ("S1-001", "S2-101", 0.9)])
    assert pairs_of(decide.without_contradictions(cross, *sides)) == {("S1-001", "S2-101")}


def test_expected_f05_takes_the_best_prefix(spark):
    import itertools
    import random

    rng = random.Random(2)
    rows = [(f"S1-{i}", f"S2-{j:02d}", round(rng.random(), 3)) for i in range(30) for j in range(rng.randint(1, 12))]
    want = set()
    for sid, group in itertools.groupby(rows, lambda r: r[0]):
        ranked = sorted(group, key=lambda r: (-r[2], r[1]))
        p, total = [r[2] for r in ranked], max(1.0, sum(r[2] for r in ranked))
        best, keep = 0.0, 0
        for m in range(1, min(8, len(p)) + 1):
            if p[m - 1] < 0.25 or p[0] < 0.45:
                break
            precision, recall = sum(p[:m]) / m, sum(p[:m]) / total
            value = round(1.25 * precision * recall / (0.25 * precision + recall), 12)
            if value > best:
                best, keep = value, m
        want |= {(sid, r[1]) for r in ranked[:keep]}
    assert pairs_of(decide.expected_f05(scored(spark, rows))) == want


def test_metrics(spark):
    truth = spark.createDataFrame([("a", "S2-1"), ("a", "S3-2"), ("b", "S2-3")], "sid string, tid string")
    pred = spark.createDataFrame([("a", "S2-1"), ("a", "S3-2"), ("a", "S2-9"), ("c", "S2-4")], "sid string, tid string")
    ents = spark.createDataFrame([("a", "us"), ("b", "us"), ("c", "in"), ("d", "in")], "sid string, country string")
    got = {r.sid: r for r in metrics.entity_scores(ents, truth=truth, predicted=pred).collect()}
    assert got["a"].f05 == pytest.approx(0.7142857) and got["b"].f05 == 0 and got["c"].f05 == 0 and got["d"].f05 == 1
    swapped = {r.sid: r for r in metrics.entity_scores(ents, truth=pred, predicted=truth).collect()}
    assert swapped["a"].f05 == pytest.approx(0.9090909)  # F2 of the first: the arguments must not be exchanged
    whole = metrics.summary(metrics.entity_scores(ents, truth=truth, predicted=pred)).where("country is null and bucket is null").first()
    assert whole.false_merges == 1 and whole.singleton_accuracy == 0.5
    with pytest.raises(TypeError):
        metrics.entity_scores(ents, truth, pred)


def test_policy_grid_agrees_with_the_policy(spark):
    s = scored(spark, [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.5), ("c", "z", 0.7)])
    truth, ents = spark.createDataFrame([("a", "x"), ("c", "z")], "sid string, tid string"), spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    for r in decide.policy_grid(s, truth, ents, [0.4, 0.75], [0.4], [0.05, 0.2]).collect():
        kept = decide.precision_policy(s, decide.Policy(r.match, r.singleton, r.margin))
        scores = metrics.entity_scores(ents.withColumnRenamed("id", "sid"), truth=truth, predicted=kept)
        assert r.f05 == pytest.approx(scores.agg(F.avg("f05")).first()[0])


def test_mining(sides, truth):
    cands = blocking.candidates(*sides, most=None)
    bucket = mining.classify(features.with_sides(cands, *sides), truth=truth)
    assert not pairs_of(bucket) & set(TRUTH)
    mined = mining.mine(bucket, 4)
    assert pairs_of(mined) == pairs_of(mining.mine(bucket.repartition(5), 4)) <= pairs_of(bucket)


def test_folds(spark):
    rows = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("y"), (F.col("id") % 23).alias("g"))
    sizes = splits.stratified(rows, "k", "y", 5).groupBy("fold", "y").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in sizes)
    grouped = splits.stratified_groups(rows, "g", "y", 4)
    assert grouped.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert rows.select("g", splits.fold(F.col("g"), 5).alias("f")).distinct().groupBy("g").count().where("count > 1").count() == 0


def test_models(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 10 / 10).alias("f1"), (F.col("id") % 7 / 7).alias("f2"), ((F.col("id") % 10) >= 5).cast("int").alias("label"))
    for learner in ("gbt", "logistic"):
        model = models.Matcher(learner).fit(rows, ["f1", "f2"])
        got = model.score(rows)
        assert got.where("score < 0 or score > 1").count() == 0 and got.where("(score >= 0.5) <> (label = 1)").count() < 15
        assert max(model.importances(), key=model.importances().get) == "f1"
    model.save(str(tmp_path / "m"))
    assert models.Matcher.load(str(tmp_path / "m")).score(rows).where("score > 0.5").count() == got.where("score > 0.5").count()
    assert models.Matcher().fit(rows.where("label = 1"), ["f1"]).score(rows).select("score").distinct().collect() == [(1.0,)]
    models.save_choices(rows, str(tmp_path / "c"), {"decoder": "policy", "calibrated": False})
    assert models.load_choices(spark, str(tmp_path / "c")) == {"decoder": "policy", "calibrated": False}
    calibrated = models.Calibrator().fit(rows, "f1", "label").apply(rows, "f1")
    assert calibrated.where("f1 < 0 or f1 > 1").count() == 0
    assert models.Calibrator().fit(rows.where("label = 1"), "f1", "label").model is None
    assert 0 <= models.best_alpha(rows.withColumn("p", F.lit(0.5)), "label", "f1", "p") <= 1


def test_tables(spark, tmp_path, truth):
    path = str(tmp_path / "s.tsv")
    with open(path, "w") as f:
        f.write('entity_id\tbusiness_name\tcountry\nS1-1\tA "quoted"\tUS\nS1-2\t\tnull\n')
    got = {r.entity_id: r for r in tables.read_records(spark, path).collect()}
    assert got["S1-2"].business_name == "" and got["S1-2"].business_address == "" and got["S1-2"].country == "null"
    ents = spark.createDataFrame([("S1-001",), ("S1-003",)], "sid string")
    tables.write_pairs(ents, truth.where("sid = 'S1-001'"), str(tmp_path / "out"), one_file=True)
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == ["source1_entity_id\tmatched_entity_ids", "S1-001\tS2-101,S3-102", "S1-003\t"]
    sids, pairs = tables.read_truth(spark, str(tmp_path / "out"))
    assert pairs_of(pairs) == {("S1-001", "S2-101"), ("S1-001", "S3-102")} and {r.sid: r.n_true for r in sids.collect()} == {"S1-001": 2, "S1-003": 0}
    assert validate.file_shape(spark.read.text(str(tmp_path / "out")), lines[0]).count() == 0
    assert {r.rule for r in validate.file_shape(spark.createDataFrame([("a,b",)], "value string"), lines[0]).collect()} == {"header", "malformed_row"}
    row = tables.log_experiment(spark, str(tmp_path / "log"), {"name": "a|b", "f05": 0.5})
    assert row == "| 0.5 | a/b |" and spark.read.text(str(tmp_path / "log")).count() == 1
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (-5.0,), (5.0,), (None,)], "p double").select(tables.clipped(F.col("p"), 0.0, 3.0).alias("p"))
    assert [r.p for r in odd.collect()] == [0.0, 0.0, 0.0, 3.0, 0.0]


def test_stream_claims(spark, tmp_path, sides):
    for k, sid in enumerate(["S1-001", "S1-002"]):
        spark.createDataFrame([(sid, "S2-7", 0.6 + 0.3 * k), (sid, f"S2-{k}", 0.9)], "sid string, tid string, score double").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema("sid string, tid string, score double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    resolver.resolve_stream(stream, lambda df: df, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 3 and out.where("tid = 'S2-7'").count() == 1
