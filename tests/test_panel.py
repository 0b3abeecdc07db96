"""Windows, factors and joins on hand-made and synthetic bars."""

from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import events, factors, indicators, timejoins
from barloom.operators.panel import align_features, as_of, normalise, synthetic_bars
from barloom.operators.smoothing import Smoothing, ema, smooth, span

BARS = "ticker string, date date, open double, high double, low double, close double, volume double"


def bars(spark, closes, ticker="A", start=date(2024, 1, 1)):
    rows = [(ticker, start + timedelta(days=i), c, c * 1.01, c * 0.99, c, 100.0 + i) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


@pytest.fixture(scope="module")
def panel(spark):
    return synthetic_bars(spark, 3, 300).cache()


def test_normalise_drops_bad_rows(spark):
    df = spark.createDataFrame([("A", "2024-01-01", "1", "2", "1", "1.5", "-5", "x"), ("A", "2024-01-02", "1", "2", "1", "0", "5", "x"), ("A", "2024-01-03", "1", "2", "1", "bad", "5", "x")], "Ticker string, DATE string, Open string, High string, low string, CLOSE string, Volume string, extra string")
    rows = normalise(df).collect()
    assert [(r["close"], r["volume"]) for r in rows] == [(1.5, 0.0)]
    with pytest.raises(ValueError, match="missing"):
        normalise(df.drop("Volume"))


def test_ema_forms_agree_with_pandas(spark, panel):
    one = panel.filter("ticker = 'T0'").orderBy("date").toPandas()
    want = one["close"].ewm(span=9, adjust=False, min_periods=9).mean()
    fold = panel.filter("ticker = 'T0'").select("date", ema(F.col("close"), span(9), 9).alias("e")).orderBy("date").toPandas()["e"]
    passed = smooth(panel.filter("ticker = 'T0'"), [Smoothing("e", "close", span(9), 9)]).orderBy("date").toPandas()["e"]
    assert (want - fold).abs().max() < 1e-8 and (want - passed).abs().max() < 1e-9
    assert fold.isna().sum() == passed.isna().sum() == 8


def test_constant_price_gives_nulls(spark):
    rows = indicators.raw_features(bars(spark, [10.0] * 40)).orderBy(F.desc("date")).first()
    assert rows["bb_pct"] is None and rows["ret_z_20"] is None and rows["rsi_14"] is None
    assert rows["sma_ratio_20"] == 0 and rows["trend_regime_slow"] == 0.0


def test_features_do_not_look_ahead(spark, panel):
    cut = panel.filter("ticker = 'T1'").orderBy("date").collect()[280]["date"]
    names = ["rsi_14", "macd_hist", "adx_14", "cci_20", "mfi_14", "obv", "drawdown_252", "hist_vol_20"]
    full = indicators.raw_features(panel).filter((F.col("date") == cut)).select("ticker", *names).orderBy("ticker").toPandas()
    known = indicators.raw_features(as_of(panel, cut)).filter((F.col("date") == cut)).select("ticker", *names).orderBy("ticker").toPandas()
    pd.testing.assert_frame_equal(full, known)


def test_feature_matrix_lags_features(spark, panel):
    m = indicators.feature_matrix(panel)
    assert m.count() == 3 * (300 - 253 - 5)
    raw = indicators.raw_features(panel).filter("ticker = 'T0'").select("date", "rsi_14").orderBy("date").collect()
    first = m.filter("ticker = 'T0'").orderBy("date").first()
    at = [r["date"] for r in raw].index(first["date"])
    assert first["rsi_14"] == pytest.approx(raw[at - 1]["rsi_14"])
    assert len(indicators.feature_names(m.drop("close"))) >= 91


def test_factor_registry(panel):
    assert len(factors.REGISTRY) >= 22
    out = factors.compute(panel, category="technical")
    assert out.count() == 900 and len(out.columns) == 11
    with pytest.raises(KeyError):
        factors.compute(panel, ["no_such"])


def test_rolling_rank_and_argmax(spark):
    df = bars(spark, [3.0, 1.0, 2.0, 2.0, 5.0, 5.0, 4.0, 1.0, 9.0, 2.0, 2.0])
    rows = df.select("date", factors.rolling_rank(F.col("close")).alias("r"), factors.ts_argmax(F.col("close"), 3).alias("m")).orderBy("date").collect()
    assert rows[8]["r"] is None and rows[9]["r"] == pytest.approx((2 + (3 + 1) / 2) / 10)
    assert [r["m"] for r in rows[2:6]] == [0.0, 1.0, 2.0, 1.0]


def test_align_features(spark):
    out = align_features(spark.createDataFrame([("A", date(2024, 1, 1), None)], "ticker string, date date, a double"), ["b", "a"])
    assert out.columns == ["ticker", "date", "b", "a"] and out.first()["a"] == 0.0


def test_adjustment_factors(spark):
    df = bars(spark, [100.0, 100.0, 50.0, 50.0, 40.0])
    day = lambda i: date(2024, 1, 1) + timedelta(days=i)
    actions = spark.createDataFrame([("A", day(2), "split", 2.0, None), ("A", day(4), "dividend", None, 10.0), ("A", day(4), "split", 2.0, None), ("A", day(0), "dividend", None, 5.0), ("A", day(3), "dividend", None, 500.0)], "ticker string, date date, type string, ratio double, cash_amount double")
    got = [round(r["factor"], 9) for r in timejoins.adjustment_factors(df, actions).orderBy("date").collect()]
    assert got == [0.2, 0.2, 0.4, 0.4, 1.0]


def test_weekdays(spark):
    days = [(date(2024, 1, 1) + timedelta(days=a), date(2024, 1, 1) + timedelta(days=b)) for a in range(9) for b in range(20)]
    rows = spark.createDataFrame(days, "a date, b date").select("a", "b", timejoins.weekdays_between(F.col("a"), F.col("b")).alias("n")).collect()
    for r in rows:
        want = sum((r["a"] + timedelta(days=k)).weekday() < 5 for k in range((r["b"] - r["a"]).days + 1))
        assert r["n"] == want


def test_as_of_joins(spark):
    left = spark.createDataFrame([("A", 1), ("A", 3), ("A", 9), ("B", 3)], "k string, t int")
    right = spark.createDataFrame([("A", 3, 30), ("A", 5, 50)], "k string, t int, v int")
    back = {(r["k"], r["t"]): r["v"] for r in timejoins.as_of_backward(left, right, ["k"], "t", ["v"]).collect()}
    strict = {(r["k"], r["t"]): r["v"] for r in timejoins.as_of_backward(left, right, ["k"], "t", ["v"], strict=True).collect()}
    ahead = {(r["k"], r["t"]): r["v"] for r in timejoins.as_of_forward(left, right, ["k"], "t", "v").collect()}
    assert back == {("A", 1): None, ("A", 3): 30, ("A", 9): 50, ("B", 3): None}
    assert strict == {("A", 1): None, ("A", 3): None, ("A", 9): 50, ("B", 3): None}
    assert ahead == {("A", 1): 30, ("A", 3): 30, ("A", 9): None, ("B", 3): None}


def test_shocks_two_and_three_days_apart(spark):
    closes = [100.0 + 0.01 * i for i in range(60)]
    for i in (30, 32, 35):
        closes[i:] = [c * 1.3 for c in closes[i:]]
    rows = events.volatility_windows(bars(spark, closes)).orderBy("start").collect()
    assert [(r["start"].day, r["end"].day) for r in rows] == [(31, 2), (5, 5)] and rows[0]["direction"] == "UP"


def test_hysteresis(spark):
    raw = ["GREEN", "RED", "GREEN", "GREEN", "GREEN", "AMBER", "GREEN", "GREEN"]
    df = spark.createDataFrame([("A", date(2024, 1, 1) + timedelta(days=i), r) for i, r in enumerate(raw)], "ticker string, date date, regime string")
    got = [r["regime"] for r in events.stable_regimes(df).orderBy("date").collect()]
    assert got == ["GREEN", "RED", "RED", "RED", "GREEN", "AMBER", "AMBER", "AMBER"]


def test_breaker(spark):
    days = [("A", date(2024, 1, 1) + timedelta(days=i), 1.0, r) for i, r in enumerate([0.0, -0.25, 0.5, 0.1])]
    got = [r["held"] for r in events.breaker(spark.createDataFrame(days, "ticker string, date date, held double, ret double")).orderBy("date").collect()]
    assert got == [1.0, 1.0, 0.0, 0.0]
