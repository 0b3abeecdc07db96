"""Gates against their ladders by hand, ordered folds over many batches, calendars and clipped scores."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barloom.operators import allocation, events, folds, gates, paper, regimes, stats, timejoins

C = F.col


def one(spark, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))


def test_relevance_is_at_most_one(spark):
    """A volume over a thousand lifts its part over the weight; the score stays within 1."""
    df = one(spark, t="War in Korea").withColumn("topics", events.topics(C("t")))
    score = events.relevance(C("topics"), F.lit(1e9), F.lit(1e9), F.lit(-50.0), F.lit("Seoul"), C("t"))
    assert df.select(score.alias("s")).first()["s"] == 1.0
    plain = events.relevance(F.array(F.lit("general")), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(""), F.lit(""))
    assert abs(df.select(plain.alias("s")).first()["s"] - (0.35 * 0.3 + 0.1 * 0.55)) < 1e-12


def test_sequential_promotion(spark):
    def want(new, old, weeks):
        if weeks < 4:
            return "CONTINUE"
        z = (old - new - 0.02) / max(math.sqrt(2 * old * max(1 - old, 1e-9) / weeks), 1e-9)
        return "PROMOTE" if z >= math.log(0.8 / 0.05) else "STOP" if z <= math.log(0.2 / 0.95) else "CONTINUE"

    rows = [(new, old, weeks) for new in (0.01, 0.1, 0.24, 0.4) for old in (0.25, 1.0) for weeks in (1, 4, 30, 900)]
    df = spark.createDataFrame(rows, "new double, old double, weeks int")
    got = df.select("*", gates.sequential_promotion(C("new"), C("old"), C("weeks")).alias("s")).collect()
    assert all(r["s"] == want(r["new"], r["old"], r["weeks"]) for r in got)
    assert {r["s"] for r in got} == {"PROMOTE", "STOP", "CONTINUE"}


@pytest.mark.parametrize(("days", "alpha", "violations", "missing", "mdd", "want"), [(30, 0.0, 0, 0, 20.0, "PASS"), (29, 1.0, 0, 0, 0.0, "FAIL"), (40, -0.1, 0, 0, 0.0, "FAIL"), (40, 1.0, 1, 0, 0.0, "FAIL"), (40, 1.0, 0, 2, 0.0, "FAIL"), (40, 1.0, 0, 0, 20.1, "FAIL"), (None, 1.0, 0, 0, 0.0, "FAIL"), (31, None, None, None, None, "PASS")])
def test_forward_review(spark, days, alpha, violations, missing, mdd, want):
    cast = lambda v, kind: F.lit(v).cast(kind)
    review = gates.forward_review(cast(days, "int"), cast(alpha, "double"), cast(violations, "int"), cast(missing, "int"), cast(mdd, "double"))
    assert spark.range(1).select(review.alias("r")).first()["r"] == want


def test_volume_breakout_and_route(spark):
    got = spark.range(1).select(
        gates.volume_breakout(F.lit(3.0), F.lit(0.0), F.lit(99.5), F.lit(100.0)).alias("a"), gates.volume_breakout(F.lit(2.9), F.lit(0.5), F.lit(120.0), F.lit(100.0)).alias("b"),
        gates.volume_breakout(F.lit(300.0), F.lit(None).cast("double"), F.lit(1.0), F.lit(None).cast("double")).alias("c"), gates.advisor_route(F.lit(0.6), F.lit(0.0), F.lit(0.7), F.lit(0.5)).alias("d"),
        gates.advisor_route(F.lit(0.5), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("e"), gates.advisor_route(F.lit(1.0), F.lit(-1.0), F.lit(0.5), F.lit(0.6)).alias("f"),
    ).first()
    assert tuple(got) == (True, False, False, "deep", "shallow", "shallow")


def test_ordered_fold_over_many_batches(spark):
    """A run longer than an Arrow batch keeps its state; keys do not mix; an empty table has no rows."""
    rows = spark.range(50_000).select((C("id") % 2).alias("k"), C("id").alias("t"))

    def step(state, row):
        return (state[0] + 1, state[1] + row[1]), (state[0], state[1])

    out = folds.ordered_fold(rows, "k", ["t"], lambda: (0, 0), step, "nth long, before long")
    bad = out.filter((C("nth") != F.floor(C("t") / 2)) | (C("before") != F.floor(C("t") / 2) * (F.floor(C("t") / 2) - 1) + C("k") * F.floor(C("t") / 2)))
    assert out.count() == 50_000 and bad.count() == 0
    assert folds.ordered_fold(rows.limit(0), "k", ["t"], lambda: (0, 0), step, "nth long, before long").collect() == []


def test_stable_regimes_by_hand(spark):
    days = ["GREEN", "RED", "GREEN", "GREEN", "GREEN", "AMBER", "GREEN", "GREEN", "GREEN", "GREEN"]
    rows = [("T", dt.date(2024, 1, 1) + dt.timedelta(i), r) for i, r in enumerate(days)] + [("U", dt.date(2024, 1, 1), "AMBER")]
    got = {(r["ticker"], r["date"]): r["regime"] for r in events.stable_regimes(spark.createDataFrame(rows, "ticker string, date date, regime string")).collect()}
    want = ["GREEN", "RED", "RED", "RED", "GREEN", "AMBER", "AMBER", "AMBER", "GREEN", "GREEN"]
    assert [got["T", dt.date(2024, 1, 1) + dt.timedelta(i)] for i in range(10)] == want and got["U", dt.date(2024, 1, 1)] == "AMBER"


def test_next_session_across_months(spark):
    day = lambda s: dt.date.fromisoformat(s)
    calendar = spark.createDataFrame([(day(d),) for d in ("2024-01-03", "2024-03-01", "2024-03-05")], "day date")
    days = spark.createDataFrame([(day(d),) for d in ("2023-12-30", "2024-01-03", "2024-01-04", "2024-02-10", "2024-03-05", "2024-03-06")], "day date")
    got = {str(r["day"]): r["session"] and str(r["session"]) for r in timejoins.next_session(days, calendar).collect()}
    assert got == {"2023-12-30": "2024-01-03", "2024-01-03": "2024-01-03", "2024-01-04": "2024-03-01", "2024-02-10": "2024-03-01", "2024-03-05": "2024-03-05", "2024-03-06": None}
    with pytest.raises(PySparkException):
        timejoins.next_session(days, calendar, strict=True).collect()
    assert timejoins.next_session(days.filter("day < date '2024-03-06'"), calendar, strict=True).count() == 5


def test_conformal_quantiles_by_hand(spark):
    rows = [("A", 1, float(x)) for x in range(40)] + [("B", 1, 100.0), ("B", 1, None)]
    got = {r["regime"]: r for r in allocation.conformal_quantiles(spark.createDataFrame(rows, "regime string, horizon int, residual double")).collect()}
    level = math.ceil(41 * 0.9) / 40 * 39
    assert abs(got["A"]["q"] - level) < 1e-9 and not got["A"]["fallback"] and got["B"]["fallback"] and got["B"]["n"] == 1
    assert abs(got["B"]["q"] - math.ceil(42 * 0.9) / 41 * 40) < 1e-9


def test_rolling_rank_ic(spark):
    rows = [("T", dt.date(2024, 1, 1) + dt.timedelta(i), float(i % 5), float(-(i % 5))) for i in range(8)] + [("U", dt.date(2024, 1, 1) + dt.timedelta(i), 1.0, float(i)) for i in range(6)]
    got = stats.rolling_rank_ic(spark.createDataFrame(rows, "ticker string, date date, f double, r double"), "f", "r", 5).collect()
    assert all(abs(r["ic"] + 1) < 1e-12 for r in got if r["ticker"] == "T") and all(r["ic"] is None for r in got if r["ticker"] == "U")
    assert sum(r["ticker"] == "T" for r in got) == 4


def test_meta_probabilities_with_little_to_fit(spark):
    rows = spark.createDataFrame([(float(i), float(i % 2)) for i in range(10)], "x double, meta_label double")
    assert {r["meta_prob"] for r in regimes.meta_probabilities(rows, rows, ["x"]).collect()} == {0.5}
    assert {r["meta_prob"] for r in regimes.meta_probabilities(rows.limit(0), rows, ["x"]).collect()} == {0.5}
    many = spark.createDataFrame([(float(i), float(i > 50)) for i in range(100)], "x double, meta_label double")
    got = sorted((r["x"], r["meta_prob"]) for r in regimes.meta_probabilities(many, many, ["x"]).collect())
    assert got[0][1] < 0.2 < 0.8 < got[-1][1]


def test_benchmark_gate(spark):
    none = F.array().cast("array<string>")
    gate = lambda market, bars, issues: spark.range(1).select(paper.benchmark_gate(F.lit(market), F.lit(bars), issues).alias("g")).first()["g"]
    assert gate("NYSE", 0, none)["status"] == "NOT_APPLICABLE" and gate("KRX", 1, none)["not_promotable"]
    assert gate("krx", 5, none)["status"] == "PASS" and gate("KRX", 5, F.array(F.lit("OHLC_ORDER")))["status"] == "MISSING"
