"""Learners, calibration and blending on Spark ML; thresholds and weights are found by grouped aggregates."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, Imputer, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import metrics

LEARNERS = {
    "gbt": lambda: GBTClassifier(labelCol="label", maxIter=20, stepSize=0.1, maxDepth=5, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42),
    "forest": lambda: RandomForestClassifier(labelCol="label", numTrees=40, maxDepth=6, seed=42),
    "logistic": lambda: LogisticRegression(labelCol="label", regParam=0.01),
}


def deterministic(features: DataFrame, need_number: bool = False) -> Column:
    """The rule matcher: equal legal names or most tokens shared, and a shared number if asked for."""
    good = (F.col("name_legal") == 1) | (F.col("name_jaccard") >= 0.85)
    return (good & (F.col("num_shared") > 0)) if need_number else good


class Matcher:
    """Assembled features, a learner, and the probability of label 1 as ``score``. One label only: that label's constant."""

    def __init__(self, learner: str = "gbt") -> None:
        self.learner, self.model, self.constant = learner, None, None

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> Matcher:
        kinds = [r[0] for r in df.groupBy(label).count().select(label).limit(3).collect()]
        if len(kinds) < 2:
            self.constant = float(kinds[0]) if kinds else 0.0
            return self
        train = df.withColumn("label", F.col(label).cast("double"))
        self.model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), LEARNERS[self.learner]()]).fit(train)
        return self

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        if self.model is None:
            return df.withColumn(name, F.lit(self.constant))
        made = self.model.transform(df).withColumn(name, vector_to_array("probability")[1])
        return made.drop("features", "rawPrediction", "probability", "prediction")

    def importances(self) -> dict[str, float]:
        names, last = self.model.stages[0].getInputCols(), self.model.stages[-1]
        values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
        return dict(zip(names, map(float, values)))

    def save(self, path: str) -> None:
        """The fitted stages, and beside them the constant of a model that has seen one label only."""
        spark = SparkSession.getActiveSession()
        (self.model or PipelineModel([])).write().overwrite().save(f"{path}/stages")
        spark.createDataFrame([(json.dumps(self.constant),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/constant")

    @staticmethod
    def load(path: str, learner: str = "gbt") -> Matcher:
        out = Matcher(learner)
        out.constant = json.loads(SparkSession.getActiveSession().read.text(f"{path}/constant").first()[0])
        out.model = PipelineModel.load(f"{path}/stages") if out.constant is None else None
        return out


def save_choices(df: DataFrame, path: str, choices: dict) -> None:
    """What was decided beside the model (policy, calibration kept or not, decoder), as a one-line text file."""
    df.sparkSession.createDataFrame([(json.dumps(choices, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_choices(spark, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def out_of_fold(df: DataFrame, features: list[str], label: str, k: int, learner: str = "gbt") -> DataFrame:
    """``df`` with fold -> with score of a model that has not seen the row's fold."""
    parts = []
    for i in range(k):
        part = df.where(F.col("fold") == i)
        parts.append(Matcher(learner).fit(df.where(F.col("fold") != i), features, label).score(part))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Calibrator:
    """Isotonic or Platt; the identity if there is one label only, or if it does not lower the log loss."""

    def __init__(self, how: str = "isotonic") -> None:
        self.how, self.model = how, None

    def fit(self, df: DataFrame, score: str, label: str) -> Calibrator:
        if df.select(label).distinct().count() < 2:
            return self
        rows = df.select(F.col(score).alias("s"), F.col(label).cast("double").alias("label"))
        vector = VectorAssembler(inputCols=["s"], outputCol="features")
        learner = IsotonicRegression(featuresCol="features", labelCol="label") if self.how == "isotonic" else LogisticRegression(labelCol="label")
        self.model = Pipeline(stages=[vector, learner]).fit(rows)
        before = rows.agg(log_loss(F.col("label"), F.col("s"))).first()[0]
        after = self.apply(rows, "s").agg(log_loss(F.col("label"), F.col("s"))).first()[0]
        if after >= before:
            self.model = None
        return self

    def apply(self, df: DataFrame, score: str) -> DataFrame:
        if self.model is None:
            return df
        made = self.model.transform(df.withColumn("s", F.col(score)))
        value = F.col("prediction") if self.how == "isotonic" else vector_to_array("probability")[1]
        kept = [c for c in df.columns if c != score]
        return made.select(*kept, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias(score))


def log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def best_alpha(df: DataFrame, label: str, one: str, two: str) -> float:
    """The weight of ``one`` with the least log loss; the first of equals."""
    return metrics.blend_losses(df, label, one, two).orderBy("loss", "alpha").first().alpha


def alpha_by_f05(df: DataFrame, one: str, two: str, entities: DataFrame, truth: DataFrame, threshold: float = 0.6, steps: int = 20) -> float:
    """The weight of ``one`` with the greatest macro F0.5 of pairs at ``threshold`` or above; one aggregate for all weights."""
    weights = df.sparkSession.createDataFrame([(k / steps,) for k in range(steps + 1)], "alpha double")
    hits = df.select("sid", "tid", one, two).join(truth.select("sid", "tid", F.lit(1).alias("hit")), ["sid", "tid"], "left").join(F.broadcast(weights))
    taken = hits.where(F.col("alpha") * F.col(one) + (1 - F.col("alpha")) * F.col(two) >= threshold).groupBy("alpha", "sid").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    per = entities.select("sid").join(truth.groupBy("sid").agg(F.count("*").alias("n_true")), "sid", "left").join(F.broadcast(weights)).join(taken, ["alpha", "sid"], "left").fillna(0, ["n_true", "n_pred", "tp"])
    value = F.when(F.col("n_true") == 0, F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)).otherwise(metrics.f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true")))
    return per.groupBy("alpha").agg(F.avg(value).alias("f05")).orderBy(F.col("f05").desc(), "alpha").first().alpha


def learned_gate(per_entity: DataFrame, features: list[str], label: str, k: int = 5) -> DataFrame:
    """``per_entity`` (sid, features, label: 1 if the entity has a match) -> with score, out of fold: abstain where it is low."""
    from .splits import fold

    return out_of_fold(per_entity.withColumn("fold", fold(F.col("sid"), k)), features, label, k)


def cross_validated(df: DataFrame, target: str, k: int, make, predict) -> tuple[DataFrame, list]:
    """``df`` with fold -> (out-of-fold rows with prediction, the fold models). ``make(train)`` fits, ``predict(model, test)`` adds prediction."""
    fitted, parts = [], []
    for i in range(k):
        fitted.append(make(df.where(F.col("fold") != i)))
        parts.append(predict(fitted[-1], df.where(F.col("fold") == i)).select("fold", target, "prediction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, fitted


def blend(columns: list[str], how: str = "mean", weights: list[float] | None = None) -> Column:
    values = F.array(*[F.col(c).cast("double") for c in columns])
    if how == "median":
        ordered, n = F.array_sort(values), len(columns)
        return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    w = weights or [1 / len(columns)] * len(columns)
    return sum((F.col(c) * x for c, x in zip(columns, w)), F.lit(0.0))


def tabular(numeric: list[str], categories: list[str], target: str) -> Pipeline:
    """Median imputation, ordinal codes (unseen last), gradient-boosted regression of log1p(target)."""
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}_i" for c in numeric])]
    stages += [StringIndexer(inputCol=c, outputCol=f"{c}_k", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categories]
    stages += [VectorAssembler(inputCols=[*[f"{c}_i" for c in numeric], *[f"{c}_k" for c in categories]], outputCol="features")]
    return Pipeline(stages=[*stages, GBTRegressor(labelCol=target, maxIter=20, maxDepth=5, maxBins=256, seed=42)])


class TfidfRidge:
    """Word one- and two-grams, sublinear tf, smooth idf, unit length, ridge regression of log1p(target)."""

    def __init__(self, alpha: float = 1.0, vocabulary: int = 1 << 15) -> None:
        self.alpha, self.vocabulary = alpha, vocabulary

    def _counts(self, df: DataFrame, text: str) -> DataFrame:
        words = RegexTokenizer(inputCol=text, outputCol="w1", gaps=False, pattern=r"[\p{L}\p{N}_]{2,}").transform(df)
        both = NGram(n=2, inputCol="w1", outputCol="w2").transform(words)
        return both.withColumn("terms", F.concat("w1", "w2")).drop("w1", "w2")

    def fit(self, df: DataFrame, text: str, target: str) -> TfidfRidge:
        counted = self._counts(df, text)
        self.counter = CountVectorizer(inputCol="terms", outputCol="tf", minDF=2.0, vocabSize=self.vocabulary).fit(counted)
        n = counted.count()
        terms = counted.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        df_of = {r.t: r.df for r in terms.where("df >= 2").orderBy(F.col("df").desc(), "t").limit(4 * self.vocabulary).collect()}  # bounded by the vocabulary
        import math

        self.idf = [math.log((1 + n) / (1 + df_of.get(t, 1))) + 1 for t in self.counter.vocabulary]
        made = self._vectors(counted).withColumn("y", F.log1p(F.col(target)))
        self.model = LinearRegression(featuresCol="features", labelCol="y", regParam=self.alpha / max(1, n), elasticNetParam=0.0, standardization=False).fit(made)
        return self

    def _vectors(self, counted: DataFrame) -> DataFrame:
        import numpy as np
        from pyspark.ml.linalg import SparseVector, VectorUDT

        idf = np.array(self.idf)
        size = len(idf)

        @F.udf(VectorUDT())
        def weigh(v):
            return SparseVector(size, v.indices, (1 + np.log(v.values)) * idf[v.indices])

        return Normalizer(inputCol="weighed", outputCol="features").transform(self.counter.transform(counted).withColumn("weighed", weigh("tf"))).drop("terms", "tf", "weighed")

    def predict(self, df: DataFrame, text: str) -> DataFrame:
        made = self.model.transform(self._vectors(self._counts(df, text)))
        return made.withColumn("prediction", F.greatest(F.expm1("prediction"), F.lit(0.0))).drop("features")
