"""Forecast models (K21 to K26) as MLlib pipelines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, IsotonicRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checkpoint import cut, forget


def temporal_split(df: DataFrame, week: str, share: float = 0.2) -> DataFrame:
    """Df with is_test: the last round(share) of the distinct weeks (one at least); with fewer than 3 weeks, one row in five by hash."""
    weeks = df.select(week).distinct()
    # one row per week
    ranked = weeks.withColumns({"__i": F.row_number().over(Window.orderBy(week)), "__n": F.count("*").over(Window.partitionBy())})
    test = F.col("__i") > F.col("__n") - F.greatest(F.lit(1), F.bround(F.col("__n") * share, 0).cast("int"))
    out = df.join(F.broadcast(ranked), week)
    return out.withColumn("is_test", F.when(F.col("__n") >= 3, test).otherwise(F.pmod(F.xxhash64(*df.columns), F.lit(5)) == 0)).drop("__i", "__n")


def preparation(numbers: list[str], texts: list[str]) -> list:
    """Medians for missing numbers, one-hot for texts (a new value gets its own slot), one vector."""
    filled = [f"{c}__filled" for c in numbers]
    stages: list = [Imputer(inputCols=numbers, outputCols=filled, strategy="median")]
    for c in texts:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="frequencyDesc"))
    if texts:
        stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in texts], outputCols=[f"{c}__v" for c in texts], handleInvalid="keep"))
    return [*stages, VectorAssembler(inputCols=filled + [f"{c}__v" for c in texts], outputCol="features", handleInvalid="keep")]


@dataclass
class Forecast:
    value: PipelineModel
    chance: PipelineModel | None
    calibration: object | None
    numbers: list[str]
    texts: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """df with predicted and probability (0.5 where both outcomes weren't seen)."""
        out = self.value.transform(df).withColumnRenamed("prediction", "predicted").select(*df.columns, "predicted")
        if self.chance is None:
            return out.withColumn("probability", F.lit(0.5))
        scored = self.chance.transform(out).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1))).select(*out.columns, "probability")
        return _calibrated(self.calibration, scored) if self.calibration else scored

    def save(self, path: str) -> None:
        """The models and their columns under a path."""
        self.value.write().overwrite().save(f"{path}/value")
        for name, model in (("chance", self.chance), ("calibration", self.calibration)):
            if model is not None:
                model.write().overwrite().save(f"{path}/{name}")
        spark = SparkSession.active()
        rows = [(",".join(self.numbers), ",".join(self.texts), self.chance is not None, type(self.calibration).__name__)]
        spark.createDataFrame(rows, "numbers string, texts string, chance boolean, calibration string").coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, path: str) -> Forecast:
        about = SparkSession.active().read.json(f"{path}/about").first()
        kinds = {"IsotonicRegressionModel": IsotonicRegressionModel, "LogisticRegressionModel": LogisticRegressionModel}
        calibration = kinds[about.calibration].load(f"{path}/calibration") if about.calibration in kinds else None
        names = lambda x: x.split(",") if x else []
        return cls(PipelineModel.load(f"{path}/value"), PipelineModel.load(f"{path}/chance") if about.chance else None, calibration, names(about.numbers), names(about.texts))


def _calibrated(model, df: DataFrame) -> DataFrame:
    vec = VectorAssembler(inputCols=["probability"], outputCol="__p")
    got = model.transform(vec.transform(df))
    p = F.get(vector_to_array("__c"), F.lit(1)) if dict(got.dtypes).get("__c") == "vector" else F.col("__c")
    return got.withColumn("probability", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).select(*df.columns)


def fit(df: DataFrame, numbers: list[str], texts: list[str], target: str, label: str, trees: int = 60, depth: int = 5, forest: bool = False, seed: int = 42) -> Forecast:
    """A value and an escalation model on the rows whose target is known; the rarer label weighs more.

    The probability is calibrated on scores of models that didn't see the row: three folds by a hash, two where the rarer
    label has under six rows, none where it has under four. Isotonic from 200 rows on, else a logistic curve. The classifier
    itself learns from all rows. forest: random forests instead of boosted trees.
    """
    known = df.where(F.col(target).isNotNull()).withColumn(label, F.col(label).cast("double"))
    value = RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, seed=seed) if forest else GBTRegressor(labelCol=target, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed)
    model = Pipeline(stages=[*preparation(numbers, texts), value]).fit(known)
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0.0))).first()
    if not n or ones in (0, n):
        return Forecast(model, None, None, numbers, texts)
    rare = min(ones, n - ones)
    folds = 3 if rare >= 6 else 2 if rare >= 4 else 0
    weighed = known.withColumn("__w", F.when(F.col(label) == 1, float((n - ones) / ones)).otherwise(1.0))
    chance = RandomForestClassifier(labelCol=label, weightCol="__w", numTrees=trees, maxDepth=depth, seed=seed) if forest else GBTClassifier(labelCol=label, weightCol="__w", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed)
    pipe = Pipeline(stages=[*preparation(numbers, texts), chance])
    return Forecast(model, pipe.fit(weighed), _calibration(pipe, weighed, numbers, label, folds, n, seed), numbers, texts)


def _calibration(pipe: Pipeline, weighed: DataFrame, numbers: list[str], label: str, folds: int, n: int, seed: int):
    """The curve from out-of-fold probabilities to the label; None without folds, or where a fold's other rows have one label only."""
    if not folds:
        return None
    # both labels are dealt over the folds
    fold = F.pmod(F.xxhash64(*[F.col(c) for c in numbers], F.lit(seed)), F.lit(folds))
    dealt = cut(weighed.withColumn("__fold", fold))
    parts = []
    for k in range(folds):
        rest = dealt.where(F.col("__fold") != k)
        if rest.select(label).distinct().count() < 2:
            return None
        parts.append(pipe.fit(rest).transform(dealt.where(F.col("__fold") == k)).select(label, F.get(vector_to_array("probability"), F.lit(1)).alias("probability")))
    scored = VectorAssembler(inputCols=["probability"], outputCol="__p").transform(reduce(DataFrame.unionByName, parts))
    how = IsotonicRegression(featuresCol="__p", labelCol=label, predictionCol="__c") if n >= 200 else LogisticRegression(featuresCol="__p", labelCol=label, probabilityCol="__c", rawPredictionCol="__r", predictionCol="__d")
    out = how.fit(scored)
    forget(dealt)
    return out


def average_precision(rows: DataFrame, score: str, label: str) -> float:
    """The sum over distinct scores, from the highest, of precision times the gain in recall (no interpolation); 0 without positives."""
    by = rows.groupBy(F.col(score).alias("__s")).agg(F.count("*").alias("n"), F.sum(label).alias("up"))
    w = Window.orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)
    # one row per distinct score
    got = by.withColumns({"seen": F.sum("n").over(w), "hits": F.sum("up").over(w)}).agg(F.sum(F.col("up") * F.col("hits") / F.col("seen")).alias("x"), F.sum("up").alias("p")).first()
    return got.x / got.p if got.p else 0.0


def metrics(scored: DataFrame, target: str, label: str) -> dict[str, float]:
    """K25."""
    rows = scored.where(F.col(target).isNotNull()).withColumn(label, F.col(label).cast("double"))
    out = {m: RegressionEvaluator(labelCol=target, predictionCol="predicted", metricName=m).evaluate(rows) for m in ("rmse", "mae", "r2")}
    said = (F.col("probability") >= 0.5).cast("double")
    r = rows.agg(F.avg((said == F.col(label)).cast("double")).alias("acc"), F.sum(said * F.col(label)).alias("tp"), F.sum(said).alias("pp"), F.sum(label).alias("p"), F.avg(F.pow(F.col("probability") - F.col(label), 2)).alias("brier")).first()
    out |= {"accuracy": r.acc, "f1": 2 * r.tp / (r.pp + r.p) if r.pp + r.p else 0.0, "brier": r.brier}
    auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability", metricName="areaUnderROC").evaluate(rows)
    return out | {"auc": auc, "ap": average_precision(rows, "probability", label)}


def importances(model: Forecast) -> list[tuple[int, float]]:
    """(place in the vector, importance), the largest first."""
    return sorted(enumerate(model.value.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))
