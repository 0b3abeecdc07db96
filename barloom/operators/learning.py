"""Leak-safe cross-validation, and models of the pooled panel with pyspark.ml.

Folds are a small table (fold, test_start, test_stop, ...); rows join it by range. Models
are fitted once per fold on the pooled panel of all tickers; ``forecasters`` fits one per
ticker and fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import Imputer, StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path

C = F.col


def bounds(n: int, k: int) -> list[tuple[int, int]]:
    """k contiguous folds of n rows; the first n mod k hold one more."""
    if n < k + 1:
        raise ValueError("more rows than folds are needed")
    size, more = divmod(n, k)
    stops = [(i + 1) * size + min(i + 1, more) for i in range(k)]
    return list(zip([0, *stops[:-1]], stops, strict=True))


def positioned(df: DataFrame, horizon: int, order: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """Rows by date position: all tickers of a date share it, and labels end ``horizon`` dates later."""
    days = df.select("date").distinct()
    n = days.count()
    # one row per date
    pos = days.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1).withColumn("end_pos", F.least(C("pos") + horizon, F.lit(n - 1)))
    return df.join(pos, "date")


def purged(rows: DataFrame, folds: Sequence[tuple[int, int]], tests: Sequence[Sequence[int]], embargo_share: float = 0.01) -> DataFrame:
    """(path, role, row): for each set of test folds, which rows train.

    Rows whose label window meets the span from the first test row to the last test label are
    left out, as are those of the embargo after the last test fold. ``rows`` holds pos and end_pos.
    """
    spark, n = rows.sparkSession, folds[-1][1]
    embargo = int(n * embargo_share)
    plan = [(i, [folds[t][0] for t in ts], [folds[t][1] for t in ts]) for i, ts in enumerate(tests)]
    paths = spark.createDataFrame(plan, "path int, starts array<int>, stops array<int>")
    inside = F.exists(F.arrays_zip("starts", "stops"), lambda s: (C("pos") >= s["starts"]) & (C("pos") < s["stops"]))
    every = rows.crossJoin(F.broadcast(paths)).withColumn("test", inside)
    ends = every.filter("test").groupBy("path").agg(F.max("end_pos").alias("test_end"))
    every = every.join(F.broadcast(ends), "path")
    first, last = F.array_min("starts"), F.array_max("stops")
    overlap = (C("pos") <= C("test_end")) & (C("end_pos") >= first)
    embargoed = (C("pos") >= last) & (C("pos") < last + embargo)
    role = F.when(C("test"), "test").when(~overlap & ~embargoed, "train")
    return every.withColumn("role", role).filter("role is not null").drop("starts", "stops", "test", "test_end")


def purged_folds(rows: DataFrame, n: int, k: int = 5, embargo: float = 0.01) -> DataFrame:
    return purged(rows, bounds(n, k), [[i] for i in range(k)], embargo)


def combinatorial_folds(rows: DataFrame, n: int, k: int = 6, tests: int = 2, embargo: float = 0.01) -> DataFrame:
    return purged(rows, bounds(n, k), [list(c) for c in combinations(range(k), tests)], embargo)


def walk_forward(rows: DataFrame, n: int, splits: int, test: int, gap: int = 0) -> DataFrame:
    """Expanding training up to ``gap`` rows before each of the last ``splits`` test blocks."""
    starts = [n - (splits - i) * test for i in range(splits)]
    if starts[0] - gap <= 0:
        raise ValueError("no rows to train on")
    plan = rows.sparkSession.createDataFrame([(i, s) for i, s in enumerate(starts)], "path int, start int")
    every = rows.crossJoin(F.broadcast(plan))
    role = F.when(C("pos") < C("start") - gap, "train").when((C("pos") >= C("start")) & (C("pos") < C("start") + test), "test")
    return every.withColumn("role", role).filter("role is not null").drop("start")


def direction_model(features: Sequence[str], kind: str = "logistic", top: int | None = None) -> Pipeline:
    """Median imputation, scaling, an optional choice of the best features, and a classifier."""
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=[f"i_{c}" for c in features]),
        VectorAssembler(inputCols=[f"i_{c}" for c in features], outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
    ]
    last = "scaled"
    if top is not None:
        pick = UnivariateFeatureSelector(featuresCol="scaled", labelCol="label", outputCol="picked", selectionMode="numTopFeatures")
        stages.append(pick.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(top))
        last = "picked"
    common = {"featuresCol": last, "labelCol": "label", "weightCol": "weight"}
    models = {
        "logistic": lambda: LogisticRegression(regParam=0.01, maxIter=100, **common),
        "forest": lambda: RandomForestClassifier(numTrees=40, maxDepth=5, seed=7, **common),
        "boosted": lambda: GBTClassifier(maxIter=20, maxDepth=3, seed=7, **common),
    }
    return Pipeline(stages=[*stages, models[kind]()])


def balanced(df: DataFrame) -> DataFrame:
    """Weights that give both labels the same total."""
    totals = df.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    every = totals.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("labels"))
    return df.join(F.broadcast(totals.crossJoin(every)), "label").withColumn("weight", C("n") / (C("labels") * C("k"))).drop("n", "k", "labels")


def freed(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The model written and read again: a fitted one holds its training data, and with it the session, in the functions that tasks get."""
    path = shared_path(spark, "model")
    model.write().save(path)
    return PipelineModel.load(path)


def linear_probability(model: PipelineModel, features: Sequence[str]) -> Column:
    """The probability of an assembled, scaled logistic model as one dot product of columns; a null feature gives null."""
    scaler, fitted = model.stages[-2], model.stages[-1]
    weights = [w / s if s > 0 else 0.0 for w, s in zip(fitted.coefficients.toArray().tolist(), scaler.std.toArray().tolist(), strict=True)]
    shift = fitted.intercept - sum(w * m for w, m in zip(weights, scaler.mean.toArray().tolist(), strict=True))
    margin = F.lit(shift)
    for w, c in zip(weights, features, strict=True):
        margin = margin + w * C(c)
    return 1 / (1 + F.exp(-margin))


def out_of_fold(rows: DataFrame, features: Sequence[str], kind: str = "logistic", contrarian: bool = False, top: int | None = None) -> DataFrame:
    """Probabilities of the test rows of every path, each from a model fitted on its training rows."""
    parts = []
    for (path,) in rows.select("path").distinct().orderBy("path").collect():
        own = rows.filter(C("path") == path)
        model = freed(direction_model(features, kind, top).fit(balanced(own.filter("role = 'train'"))), rows.sparkSession)
        prob = F.get(vector_to_array("probability"), F.lit(1))
        scored = model.transform(own.filter("role = 'test'"))
        parts.append(scored.select("path", "ticker", "date", "label", (1 - prob if contrarian else prob).alias("prob")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def regimes(features: DataFrame, columns: Sequence[str], k: int = 3, seed: int = 7) -> DataFrame:
    """Gaussian-mixture regime and posterior of every row."""
    steps = [VectorAssembler(inputCols=list(columns), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), GaussianMixture(featuresCol="scaled", k=k, seed=seed, predictionCol="regime", probabilityCol="posterior")]
    clean = features.dropna(subset=list(columns))
    return freed(Pipeline(stages=steps).fit(clean), features.sparkSession).transform(clean).withColumn("posterior", vector_to_array("posterior")).drop("raw", "scaled")
