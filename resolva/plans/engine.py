"""The whole resolution run: retrieve, describe, train, calibrate, decide, constrain, report; and the same for new records."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import decide, features, metrics, mining, models, retrieval, splits, views
from ..sources import tables
from ..sources.staging import stage


@dataclass(frozen=True)
class EngineConfig:
    """Options of a run. ``from_json`` reads those that a file names and leaves the others."""

    folds: int = 5
    seed: int = 42
    learners: tuple[str, str] = ("gbt", "forest")
    bm25: bool = True
    mine_negatives: bool = True
    negatives_per_positive: int = 15
    calibration: str = "isotonic"
    match_grid: tuple[float, ...] = (0.35, 0.45, 0.55, 0.60, 0.65, 0.70, 0.80)
    singleton_grid: tuple[float, ...] = (0.30, 0.40, 0.50, 0.55, 0.65)
    margin_grid: tuple[float, ...] = (0.05, 0.10, 0.15, 0.20, 0.30)
    source_partition: bool = False
    features: tuple[str, ...] = field(default_factory=lambda: tuple(features.ALL))

    @staticmethod
    def from_json(text: str) -> EngineConfig:
        known = {f.name for f in dataclasses.fields(EngineConfig)}
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()}
        if unknown := set(given) - known:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return EngineConfig(**given)


class Engine:
    """``fit`` on records with truth, then ``match`` on any. All choices made in ``fit`` are kept and used in ``match``."""

    def __init__(self, config: EngineConfig | None = None) -> None:
        self.config = config or EngineConfig()
        self.one = self.two = self.calibrator = None
        self.choices: dict = {}

    def candidates(self, entities: DataFrame, targets: DataFrame) -> DataFrame:
        """Retrieved pairs within budget, with provenance, written once for the three readers of the features."""
        rolled = retrieval.provenance(stage(retrieval.hits(entities, targets, self.config.bm25), "hits"))
        return stage(retrieval.budget_cut(rolled, entities).drop("place"), "candidates")

    def described(self, entities: DataFrame, targets: DataFrame) -> DataFrame:
        return stage(features.feature_matrix(self.candidates(entities, targets), entities, targets), "features")

    def fit(self, entities: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
        """``entities`` and ``targets`` with views, ``truth`` (sid, tid) -> the report: metrics of out-of-fold decisions."""
        c, names = self.config, list(self.config.features)
        label = truth.select("sid", "tid").distinct().withColumn("label", F.lit(1.0))
        table = self.described(entities, targets).join(label, ["sid", "tid"], "left").fillna(0.0, ["label"]).withColumn("fold", splits.fold(F.col("sid"), c.folds, c.seed))
        table = stage(table, "training")
        parts = []
        for k in range(c.folds):
            train, test = self.training(table.where(F.col("fold") != k), entities, targets, truth), table.where(F.col("fold") == k)
            scored = models.Matcher(c.learners[0]).fit(train, names).score(test, "p1")
            parts.append(models.Matcher(c.learners[1]).fit(train, names).score(scored, "p2").select("sid", "tid", "label", "p1", "p2"))
        oof = parts[0]
        for p in parts[1:]:
            oof = oof.unionByName(p)
        oof = stage(oof, "out-of-fold")
        alpha = models.best_alpha(oof, "label", "p1", "p2")
        blended = oof.withColumn("score", models.blend(["p1", "p2"], weights=[alpha, 1 - alpha]))
        self.calibrator = models.Calibrator(c.calibration).fit(blended, "score", "label")
        scored = stage(self.calibrator.apply(blended, "score").select("sid", "tid", "score"), "scored")
        ids = entities.select("id")
        grid = decide.policy_grid(scored, truth, ids, list(c.match_grid), list(c.singleton_grid), list(c.margin_grid)).orderBy(F.col("f05").desc(), "point").first()
        policy = decide.Policy(grid.match, grid.singleton, grid.margin)
        self.choices = {"alpha": alpha, "calibrated": self.calibrator.model is not None, "policy": dataclasses.asdict(policy), "decoder": "policy"}
        value = lambda accepted: metrics.entity_scores(ids.withColumnRenamed("id", "sid"), truth=truth, predicted=accepted).agg(F.avg("f05")).first()[0]
        accepted = decide.precision_policy(scored, policy)
        best = value(accepted)
        if (other := value(decoded := decide.expected_f05(scored))) > best:
            accepted, best = decoded, other
            self.choices["decoder"] = "expected_f05"
        for name, step in (("exclusive", decide.exclusive), ("contradictions", lambda a: decide.without_contradictions(a, entities, targets))):
            self.choices[name] = (now := value(step(accepted))) >= best
            if self.choices[name]:
                accepted, best = step(accepted), now
        final = self.training(table, entities, targets, truth)
        self.one, self.two = models.Matcher(c.learners[0]).fit(final, names), models.Matcher(c.learners[1]).fit(final, names)
        scores = metrics.entity_scores(entities.select(F.col("id").alias("sid"), "country"), truth=truth, predicted=accepted)
        return metrics.summary(scores)

    def training(self, table: DataFrame, entities: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
        """Positives and mined negatives, or all pairs."""
        if not self.config.mine_negatives:
            return table
        found = mining.classify(features.with_sides(table.select("sid", "tid", "by_bm25_name", "by_bm25_addr", "by_reverse"), entities, targets), truth=truth)
        mined = mining.mine(found, table.where("label = 1").count(), self.config.negatives_per_positive, self.config.seed).select("sid", "tid")
        return stage(table.where("label = 1").unionByName(table.join(mined, ["sid", "tid"], "left_semi")), "mined")

    def match(self, entities: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(candidates, accepted pairs) of new records; constraints hold over all pairs at once."""
        described = self.described(entities, targets)
        scored = self.two.score(self.one.score(described, "p1"), "p2").withColumn("score", models.blend(["p1", "p2"], weights=[self.choices["alpha"], 1 - self.choices["alpha"]]))
        scored = self.calibrator.apply(scored.select("sid", "tid", "score"), "score").select("sid", "tid", "score")
        scored = stage(scored, "scored")
        accepted = decide.expected_f05(scored) if self.choices["decoder"] == "expected_f05" else decide.precision_policy(scored, decide.Policy(**self.choices["policy"]))
        if self.config.source_partition:
            accepted = decide.source_partition(accepted)
        accepted = decide.exclusive(accepted) if self.choices["exclusive"] else accepted
        return scored, decide.without_contradictions(accepted, entities, targets) if self.choices["contradictions"] else accepted

    def export(self, entities: DataFrame, targets: DataFrame, path: str) -> DataFrame:
        """Writes both result files and returns the findings of the validator."""
        from ..operators import validate

        scored, accepted = self.match(entities, targets)
        ids = entities.select(F.col("id").alias("sid"))
        tables.write_pairs(ids, scored, f"{path}/candidate_pairs", "candidate_entity_ids")
        tables.write_pairs(ids, accepted, f"{path}/matching_results")
        return validate.submission(tables.id_lists(ids, accepted), ids, tables.id_lists(ids, scored))

    def save(self, spark: SparkSession, path: str) -> None:
        self.one.save(f"{path}/one")
        self.two.save(f"{path}/two")
        if self.calibrator.model is not None:
            self.calibrator.model.write().overwrite().save(f"{path}/calibrator")
        models.save_choices(spark.range(1), f"{path}/choices", self.choices)

    @staticmethod
    def load(spark: SparkSession, path: str, config: EngineConfig | None = None) -> Engine:
        from pyspark.ml import PipelineModel

        out = Engine(config)
        out.choices = models.load_choices(spark, f"{path}/choices")
        out.one, out.two = models.Matcher.load(f"{path}/one"), models.Matcher.load(f"{path}/two")
        out.calibrator = models.Calibrator(out.config.calibration)
        if out.choices["calibrated"]:
            out.calibrator.model = PipelineModel.load(f"{path}/calibrator")
        return out


def prepared(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of all sources -> (S1, targets) with views, written once."""
    return views.split_sides(stage(views.with_views(records), "views"))
