"""Models per ticker and fold against NumPy on one ticker, and against the folds of the panel."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import forecasters, learning, regimes

NAMES = [f"f{i}" for i in range(6)]


def history(ticker, n, seed, gaps=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(NAMES)))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=n) > 0.4).astype(int)
    x = np.where(rng.random(x.shape) < gaps, np.nan, x)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(n)]
    return [(ticker, d, None if i >= n - 5 else int(y[i]), *(None if np.isnan(v) else float(v) for v in x[i])) for i, d in enumerate(days)]


@pytest.fixture(scope="module")
def panel(spark):
    rows = history("A", 700, 1, 0.1) + history("B", 305, 2) + history("C", 60, 3) + [(t, d, None if y is None else 1, *x) for t, d, y, *x in history("D", 200, 4)]
    return rows, spark.createDataFrame(rows, "ticker string, date date, label int, " + ", ".join(f"{c} double" for c in NAMES)).repartition(3)


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(5)
    x, y, weight = rng.normal(size=(200, 4)), (rng.random(200) < 0.3).astype(float), rng.random(200) + 0.5
    w = forecasters.logistic(x, y, weight, 2.0)
    ones = np.column_stack([np.ones(200), x])
    slope = ones.T @ (weight * (1 / (1 + np.exp(-ones @ w)) - y)) + np.append(0, 2.0 * w[1:])
    assert np.abs(slope).max() < 1e-5
    apart = forecasters.logistic(np.array([[-1.0], [1.0]] * 20), np.array([0.0, 1.0] * 20), np.ones(40), 1.0)  # separable, yet bounded
    assert 1 < apart[1] < 10 and abs(apart[0]) < 1e-6


def test_one_ticker_by_hand(panel):
    """Impute, scale, weigh and fit each fold in NumPy alone, by gradient steps to the same optimum."""
    rows, df = panel
    got = {(r["fold"], r["date"]): r["prob"] for r in forecasters.probabilities(df, NAMES, 5, spread=2).filter("ticker = 'B'").collect()}
    own = [r for r in rows if r[0] == "B"]
    y = np.array([r[2] for r in own[:300]], float)
    x = np.array([r[3:] for r in own], float)
    assert len(got) == 301
    for fold, (lo, hi) in enumerate([(0, 150), (150, 300)]):  # 300 rows: two folds of 150, three rows of embargo
        train = [i for i in range(300) if not lo <= i < hi and not (i <= min(hi - 1 + 5, 299) and min(i + 5, 299) >= lo) and not hi <= i < hi + 5]
        mean, std = x[train].mean(axis=0), x[train].std(axis=0)
        a = np.column_stack([np.ones(len(train)), (x[train] - mean) / std])
        weight = np.where(y[train] == 1, 0.5 / y[train].mean(), 0.5 / (1 - y[train].mean()))
        w = np.zeros(7)
        for _ in range(20_000):
            w -= 0.005 * (a.T @ (weight * (1 / (1 + np.exp(-a @ w)) - y[train])) + np.append(0, w[1:]))
        for i in range(lo, hi):
            p = 1 / (1 + np.exp(-(w[0] + (x[i] - mean) / std @ w[1:])))
            assert abs(got[fold, own[i][1]] - p) < 1e-6
    assert (forecasters.FINAL, own[-1][1]) in got


def test_every_row_once_and_no_model(panel):
    rows, df = panel
    got = forecasters.probabilities(df, NAMES, 5, recipes=[forecasters.LOGISTIC, forecasters.Recipe(contrarian=True)], spread=3)
    seen = got.groupBy("ticker", "recipe").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("days"), F.max("fold").alias("folds")).collect()
    assert {(r["ticker"], r["recipe"]): (r["n"], r["days"], r["folds"]) for r in seen} == {(t, k): (n, n, f) for t, n, f in (("A", 696, 4), ("B", 301, 1)) for k in (0, 1)}
    both = got.groupBy("ticker", "fold", "date").agg(F.sum("prob").alias("s")).filter(F.abs(C("s") - 1) > 1e-9)
    assert both.count() == 0
    proof = {r["ticker"]: r for r in forecasters.evidence(got.filter("recipe = 0"), df).collect()}
    assert proof["A"]["accuracy"] > 0.65 and proof["A"]["auc"] > 0.7 and proof["A"]["oof_coverage"] == 1.0 and proof["A"]["proxy_pbo"] == 0.0 and set(proof) == {"A", "B"}
    assert forecasters.probabilities(df.limit(0), NAMES, 5).count() == 0


C = F.col


def test_fold_roles_are_those_of_the_panel(spark):
    days = spark.range(607).select(F.date_add(F.lit(dt.date(2020, 1, 1)), C("id").cast("int")).alias("date"), F.lit("T").alias("ticker"))
    want = {}
    for r in learning.purged_folds(learning.positioned(days, 5), 607, 5, 0.01).collect():
        want.setdefault((r["path"], r["role"]), set()).add(r["pos"])
    for fold, (train, test) in enumerate(forecasters.fold_roles(607, 5, 5)):
        assert set(train.tolist()) == want[fold, "train"] and set(test.tolist()) == want[fold, "test"]


@pytest.mark.parametrize("recipe", [forecasters.Recipe("forest", trees=40), forecasters.Recipe("boosted", trees=60, depth=4, rate=0.1)])
def test_trees_learn_what_lines_miss(recipe):
    rng = np.random.default_rng(8)
    x, u = rng.normal(size=(800, 6)), rng.normal(size=(400, 6))
    truth = lambda z: ((z[:, 0] > 0) ^ (z[:, 1] > 0)).astype(float)
    line = forecasters.Fit(x, truth(x), forecasters.LOGISTIC).probability(u)
    made = forecasters.Fit(x, truth(x), recipe).probability(u)
    assert ((line > 0.5) == truth(u)).mean() < 0.6 and ((made > 0.5) == truth(u)).mean() > 0.8
    assert np.array_equal(made, forecasters.Fit(x, truth(x), recipe).probability(u)) and 0 <= made.min() <= made.max() <= 1


def test_chosen_features_search_and_importances(panel):
    _, df = panel
    x, y = np.random.default_rng(2).normal(size=(300, 6)), np.arange(300) % 2
    x[:, 4] += 2 * y
    x[:, 2] -= y
    assert forecasters.Fit(x, y.astype(float), forecasters.Recipe(top=2)).columns.tolist() == [2, 4]
    found = forecasters.search(df, NAMES, 5, list(forecasters.penalties([1.0, 1e6]))).collect()
    assert [r["place"] for r in sorted(found, key=lambda r: r["objective"])] == [1, 2] and {r["folds"] for r in found} == {7}
    top = forecasters.importances(df, NAMES, 2).filter("ticker = 'A'").orderBy("nth").collect()
    assert {r["feature"] for r in top} == {"f0", "f1"} and top[0]["value"] >= top[1]["value"]


def test_linear_probability_is_the_models(spark, panel):
    _, df = panel
    rows = df.filter("ticker = 'B' and label is not null").withColumn("weight", F.lit(1.0))
    model = learning.direction_model(NAMES).fit(rows)
    plain = rows.select("date", learning.linear_probability(model, NAMES).alias("p"))
    theirs = learning.freed(model, spark).transform(rows).select("date", F.get(learning.vector_to_array("probability"), F.lit(1)).alias("q"))
    assert plain.join(theirs, "date").filter(F.abs(C("p") - C("q")) > 1e-9).count() == 0


def test_meta_probabilities_of_null_features(spark):
    many = spark.createDataFrame([(float(i), float(i > 50)) for i in range(100)] + [(None, 1.0)], "x double, meta_label double")
    got = regimes.meta_probabilities(many, many, ["x"])
    assert got.count() == 101 and got.filter("meta_prob is null").count() == 0
