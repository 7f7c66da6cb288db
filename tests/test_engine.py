"""The whole run on a small, separable set of records."""

import random

import pytest

from resolva.plans.engine import Engine, EngineConfig, prepared


def records(n=45, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(120)]
    rows, truth = [], []
    for i in range(n):
        name, street = " ".join(rng.sample(words, 2)), rng.choice(words)
        rows.append((f"S1-{i:03d}", f"{name} LLC", f"{100 + i} {street} St, Town {10000 + 37 * i}", "US"))
        if i % 3:
            rows.append((f"S2-{i:03d}", f"{name.title()}, Inc.", f"{100 + i} {street} Street, Town {10000 + 37 * i}", "US"))
            truth.append((f"S1-{i:03d}", f"S2-{i:03d}"))
        else:
            rows.append((f"S3-{i:03d}", f"{name.split()[0]} {rng.choice(words)}", f"{900 - i} {rng.choice(words)} Ave", "US"))
    return rows, truth


def test_fit_match_save(spark, tmp_path):
    rows, truth_rows = records()
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    truth = spark.createDataFrame(truth_rows, "sid string, tid string")
    entities, targets = prepared(df)
    config = EngineConfig.from_json('{"folds": 2, "learners": ["logistic", "logistic"], "match_grid": [0.4, 0.6], "singleton_grid": [0.4], "margin_grid": [0.1]}')
    engine = Engine(config)
    whole = engine.fit(entities, targets, truth).where("country is null and bucket is null").first()
    assert whole.n == 45 and whole.f05 > 0.9
    findings = engine.export(entities, targets, str(tmp_path / "out"))
    assert findings.where("severity = 'error'").count() == 0
    got = {(r.sid, r.tid) for r in engine.match(entities, targets)[1].collect()}
    assert len(got & set(truth_rows)) >= 0.9 * len(truth_rows) and len({t for _, t in got}) == len(got)
    engine.save(spark, str(tmp_path / "engine"))
    again = {(r.sid, r.tid) for r in Engine.load(spark, str(tmp_path / "engine"), config).match(entities, targets)[1].collect()}
    assert again == got
    with pytest.raises(ValueError):
        EngineConfig.from_json('{"unknown": 1}')


def test_models_are_saved_with_one_label_and_with_two(spark, tmp_path):
    from resolva.operators.models import Matcher

    rows = [(float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(60)]
    for k, df in enumerate((spark.createDataFrame(rows, "x double, y double, label int"), spark.createDataFrame([(1.0, 2.0, 1)] * 5, "x double, y double, label int"))):
        model = Matcher("logistic").fit(df, ["x", "y"])
        model.save(f"file://{tmp_path}/m{k}")
        back = Matcher.load(f"file://{tmp_path}/m{k}", "logistic")
        assert [r.score for r in model.score(df).collect()] == [r.score for r in back.score(df).collect()]
