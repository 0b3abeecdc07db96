"""Streamed measures over many batches, averages scanned over segments, nearest patterns, block products and stops, by hand."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import allocation, patterns, stats, sweeps
from barloom.operators.sliding import Step, slide
from barloom.operators.smoothing import Smoothing, scanned

C = F.col
DAY = dt.date(2000, 1, 1)


def day(i):
    return DAY + dt.timedelta(i)


@pytest.fixture(scope="module")
def series(spark):
    """Ticker A is longer than an Arrow batch of 500 rows, with gaps; B is short; C is all null."""
    rng = np.random.default_rng(7)
    x = np.where(rng.random(2200) < 0.1, np.nan, rng.integers(0, 50, 2200).astype(float))
    x[700:760] = np.nan
    rows = [("A", day(i), None if np.isnan(v) else float(v), float(i % 7)) for i, v in enumerate(x)]
    rows += [("B", day(i), float(i), 1.0) for i in range(6)] + [("C", day(i), None, 2.0) for i in range(30)]
    return pd.DataFrame(rows, columns=["ticker", "date", "x", "y"]), spark.createDataFrame(rows, "ticker string, date date, x double, y double").repartition(4)


def check(got, want, name):
    got = got.sort_values("date")[name].to_numpy(dtype=float)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9, equal_nan=True), name


def test_slide_is_one_ticker_at_a_time(spark, series):
    pdf, df = series
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    steps = [
        Step("m", "mean", "x", 20), Step("s", "std", "x", 20, least=5), Step("hi", "max", "x", 9, least=1), Step("rk", "rank", "x", 252, least=10), Step("qu", "quantile", "x", 50, least=20, q=0.8),
        Step("sp", "spread", "y", 10), Step("lg", "lag", "x", 3), Step("run", "running", "x"), Step("av", "average", "x", alpha=0.1, least=5), Step("av2", "average", "av", alpha=0.3, least=2),
        Step("two", "sum", lambda c: c["x"] + c["y"], 4), Step("rc", "rank_correlation", "x", 6, by="y"),
    ]
    got = slide(df, steps).toPandas()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(pdf)
    for ticker, own in pdf.groupby("ticker"):
        g, x, y = got[got.ticker == ticker], own.x.astype(float), own.y
        check(g, x.rolling(20).mean(), "m")
        check(g, x.rolling(20, min_periods=5).std(), "s")
        check(g, x.rolling(9, min_periods=1).max(), "hi")
        ranks, quantiles, corrs = [], [], []
        for i in range(len(x)):
            w = x[max(0, i - 251) : i + 1].dropna()
            v = x.iloc[i]
            ranks.append(((w < v).sum() + ((w == v).sum() + 1) / 2) / len(w) if len(w) >= 10 and not np.isnan(v) else np.nan)
            w = np.sort(x[max(0, i - 49) : i + 1].dropna())
            quantiles.append(w[math.ceil(0.8 * (len(w) - 1))] if len(w) >= 20 else np.nan)
            a, b = x[max(0, i - 5) : i + 1], y[max(0, i - 5) : i + 1]
            fine = len(a) == 6 and not a.isna().any() and a.nunique() > 1 and b.nunique() > 1
            corrs.append(np.corrcoef(a.rank(), b.rank())[0, 1] if fine else np.nan)
        check(g, ranks, "rk")
        check(g, quantiles, "qu")
        check(g, corrs, "rc")
        check(g, x.shift(3), "lg")
        check(g, x.fillna(0).cumsum(), "run")
        once = x.ewm(alpha=0.1, adjust=False, min_periods=5).mean()
        check(g, once, "av")
        check(g, once.ewm(alpha=0.3, adjust=False, min_periods=2).mean(), "av2")
        check(g, (x + y).rolling(4).sum(), "two")
        check(g, y.rolling(10).apply(lambda w: np.abs(w - w.mean()).mean(), raw=True), "sp")


@pytest.mark.parametrize("days", [1, 40, 365, 100_000])
def test_scanned_averages_are_those_of_one_pass(series, days):
    """Segments of a day up to all: each starts from the state that the ones before it leave, gaps included."""
    pdf, df = series
    steps = [Smoothing("a", "x", 0.1, 5), Smoothing("b", "x", 2 / 201, 50), Smoothing("c", "y", 0.5, 1)]
    df = df if days > 1 else df.filter("date < date '2000-04-01'")
    got = scanned(df, steps, F.floor(F.unix_date("date") / days)).toPandas()
    for ticker, own in pdf.groupby("ticker"):
        own = own if days > 1 else own[own.date < dt.date(2000, 4, 1)]
        for s in steps:
            check(got[got.ticker == ticker], own[s.of].astype(float).ewm(alpha=s.alpha, adjust=False, min_periods=s.least).mean(), s.to)


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 5))
    v[250:260], v[299] = v[10], 0.0  # ties, and a vector without direction
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [])], "item_id long, vector array<double>").repartition(3)
    asked = items.filter("item_id % 10 = 0").withColumnRenamed("item_id", "query_id")
    u = patterns.unit(v)
    for block in (7, 4096):
        monkeypatch.setattr(patterns, "ITEM_BLOCK", block)
        monkeypatch.setattr(patterns, "QUERY_BLOCK", block)
        got = {}
        for r in patterns.similar(asked, items, 5, 0.2).collect():
            got.setdefault(r["query_id"], []).append((r["nth"], r["item_id"]))
        for q in range(0, 300, 10):
            cos = np.round(u @ u[q], 12)
            want = sorted((i for i in range(300) if i != q and cos[i] >= 0.2), key=lambda i: (-cos[i], i))[:5]
            assert [i for _, i in sorted(got.get(q, []))] == want, q


def test_walk_forward_by_hand(spark):
    rng = np.random.default_rng(4)
    n = 140
    x, ret = rng.normal(size=(n, 2)), rng.normal(size=n)
    rows = [("A", day(i), float(ret[i]), *map(float, x[i])) for i in range(n)] + [("B", day(i), 0.1, 1.0, float(i)) for i in range(60)]
    got = {r["fold"]: r for r in patterns.walk_forward(spark.createDataFrame(rows, "ticker string, date date, ret double, f double, g double"), ["f", "g"], splits=4).collect()}
    assert sorted(got) == [0, 1, 2, 3] and {r["ticker"] for r in got.values()} == {"A"}
    for k in range(4):
        train, lo = 60 + 20 * k, 65 + 20 * k
        hi = min(n, lo + 20)
        z = (x - x[:train].mean(axis=0)) / x[:train].std(axis=0)
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        pred = []
        for j in range(lo, hi):
            cos = z[:train] @ z[j]
            near = [i for i in np.argsort(-cos, kind="stable")[:7] if cos[i] >= 0.3]
            pred.append(np.average(ret[near], weights=cos[near]) if near else 0.0)
        actual = ret[lo:hi]
        assert (got[k]["train_n"], got[k]["test_n"]) == (train, hi - lo)
        assert got[k]["hit_rate"] == pytest.approx(np.mean(np.sign(pred) == np.sign(actual)))
        assert got[k]["r2"] == pytest.approx(1 - ((actual - pred) ** 2).sum() / ((actual - actual.mean()) ** 2).sum())


def test_covariance_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(allocation, "ASSETS", 3)
    monkeypatch.setattr(allocation, "DAYS", 20)
    rng = np.random.default_rng(6)
    r = np.where(rng.random((90, 8)) < 0.3, np.nan, rng.normal(size=(90, 8)) + 5)
    r[:, 7], r[:, 6] = np.where(np.arange(90) < 1, 2.0, np.nan), 1.0  # one day only; no variance
    rows = [(f"T{j}", day(i), float(r[i, j])) for i in range(90) for j in range(8) if not np.isnan(r[i, j])]
    df = spark.createDataFrame(rows, "ticker string, date date, ret double")
    got = {(x["a"], x["b"]): x for x in allocation.covariance(df, complete=False).collect()}
    for a in range(8):
        for b in range(8):
            both = ~np.isnan(r[:, a]) & ~np.isnan(r[:, b])
            x, y, g = r[both, a], r[both, b], got.get((f"T{a}", f"T{b}"))
            if not both.any():
                assert g is None
                continue
            assert g["days"] == both.sum()
            assert g["cov"] is None if len(x) < 2 else abs(g["cov"] - np.cov(x, y)[0, 1]) < 1e-10
            assert g["corr"] is None if len(x) < 2 or 6 in (a, b) else abs(g["corr"] - np.corrcoef(x, y)[0, 1]) < 1e-9
    full = allocation.covariance(df.filter("ticker < 'T2'")).count()
    assert full == 4


def test_stop_sweep_by_hand(spark):
    rng = np.random.default_rng(9)
    prices = {t: 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 120))) for t in ("A", "B")}
    df = spark.createDataFrame([(t, day(i), float(p)) for t, ps in prices.items() for i, p in enumerate(ps)], "ticker string, date date, close double")
    want = {}
    for ma in (3, 8):
        for stop in (0.02, 0.5):
            nets, trades = [], 0.0
            for ps in prices.values():
                held, entry, waits, moved, net = 0.0, math.nan, False, 0.0, []
                for i, p in enumerate(ps):
                    net.append(held * (p / ps[i - 1] - 1 if i else 0.0) - 0.001 * moved)
                    trades += moved
                    above = i + 1 >= ma and p > ps[i + 1 - ma : i + 1].mean()
                    waits = above and (waits or (held > 0 and p <= (1 - stop) * entry))
                    now = float(above and not waits)
                    if now and not held:
                        entry = p
                    moved, held = abs(now - held), now
                nets.append(net)
            daily = np.mean(nets, axis=0)
            equity = np.cumprod(1 + daily)
            want[ma, stop] = daily.mean() * 252, daily.mean() / daily.std() * 252**0.5, (equity / np.maximum.accumulate(equity) - 1).min(), trades
    got = sweeps.stop_sweep(df, [3, 8], [0.02, 0.5], fee=0.0005, slippage=0.0005).collect()
    assert len(got) == 4 and [r["sharpe"] for r in got] == sorted((r["sharpe"] for r in got), reverse=True)
    for r in got:
        assert np.allclose([r["ann_return"], r["sharpe"], r["max_drawdown"], r["trades"]], want[r["ma"], r["stop"]])
    assert want[3, 0.02] != want[3, 0.5] and len(sweeps.stop_sweep(df, [3, 8], [0.02, 0.5], top=1).collect()) == 1


def test_signal_quality_by_hand(spark):
    rng = np.random.default_rng(11)
    s, r = rng.integers(0, 5, 90).astype(float), rng.normal(size=90)
    rows = [("A", day(i), float(s[i]), float(r[i])) for i in range(89)] + [("A", day(89), 1.0, None)] + [("B", day(i), 1.0, float(i)) for i in range(40)]
    got = {x["ticker"]: x for x in stats.signal_quality(spark.createDataFrame(rows, "ticker string, date date, s double, r double"), "s", "r").collect()}
    rank = lambda a, b: np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]
    ics = [rank(s[i : i + 21], r[i : i + 21]) for i in range(0, 90 - 21, 5)]
    assert got["A"]["rank_ic"] == pytest.approx(rank(s[:89], r[:89])) and got["A"]["windows"] == len(ics)
    assert got["A"]["ir"] == pytest.approx(np.mean(ics) / np.std(ics, ddof=1))
    assert got["B"]["rank_ic"] is None and got["B"]["windows"] == 0 and got["B"]["ir"] is None


def test_ranks_of_a_snapshot(spark, tmp_path):
    """Ranks over many partitions are one sequence; what is missing is null, an alternative name fills in, an unmarked result is an error."""
    from pyspark.errors import PySparkException

    from barloom.sources import dashboard

    base = spark.range(500).select(
        F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"), F.lit("S").alias("track"), F.when(C("id") % 3 == 0, "ELIGIBLE_RECOMMENDATION").when(C("id") % 3 == 1, "AMBER_WATCHLIST").otherwise("RED_NOT_RECOMMENDED").alias("verdict"), (C("id") % 40).cast("double").alias("recommendation_rank_score"),
        *(F.lit(1.0).alias(c) for c in ("direction_prob", "expected_value_pct", "entry", "stop", "tp2", "risk_reward")), F.lit(True).alias("screening_output_only"), F.array(F.struct(F.lit("x").alias("name"))).alias("validations"), F.lit("12").alias("n_trades"), F.lit("y" * 300).alias("advisor_rationale"),
    ).repartition(7)
    rows = dashboard.snapshot(base)
    dashboard.write(rows, f"{tmp_path}/d")
    back = sorted(dashboard.read(spark, f"{tmp_path}/d", rows).collect(), key=lambda r: r["rank"])
    order = {"ELIGIBLE_RECOMMENDATION": 0, "AMBER_WATCHLIST": 1, "RED_NOT_RECOMMENDED": 2}
    want = sorted(base.collect(), key=lambda r: (order[r["verdict"]], -r["recommendation_rank_score"], r["ticker"]))
    assert [r["rank"] for r in back] == list(range(1, 501)) and [r["ticker"] for r in back] == [r["ticker"] for r in want]
    one = back[0]
    assert one["backtest"]["completed_trades"] == 12 and one["plan"]["tp1"] is None and one["pattern"]["kevpe_available"] is False and one["scores"]["raw_score"] == 39.0
    assert len(one["advisor"]["advisor_rationale"]) == 240 and one["reasons"] == []
    total = dashboard.summary(rows).first()
    assert (total["result_count"], total["eligible"], total["worst"]) == (500, 167, "RED_NOT_RECOMMENDED")
    with pytest.raises(ValueError, match="validations"):
        dashboard.snapshot(base.drop("validations"))
    with pytest.raises(PySparkException):
        dashboard.snapshot(base.withColumn("screening_output_only", C("ticker") != "T3")).collect()
    assert dashboard.snapshot(base.limit(0)).count() == 0


def test_corrected_bars_pass_the_ingest(spark, tmp_path):
    """A repeated bar is dropped, before and after a restart; one with other values is a later version; a batch run twice adds nothing."""
    from barloom.operators.panel import synthetic_bars
    from barloom.sources.lake import Lake
    from barloom.streaming import jobs

    bars = synthetic_bars(spark, 1, 6).withColumn("ts", C("date").cast("timestamp"))
    lake = Lake(spark, f"{tmp_path}/lake")

    def run(batch, state="state"):
        batch.write.mode("append").parquet(f"{tmp_path}/in")
        jobs.ingest(jobs.file_stream(spark, f"{tmp_path}/in", bars.schema), lake, f"{tmp_path}/{state}", "feed").trigger(availableNow=True).start().awaitTermination()

    run(bars.unionByName(bars))
    assert lake.versions().count() == 6
    last = bars.agg(F.max("date")).first()[0]
    run(bars.filter(C("date") == last).withColumn("close", C("close") * 2).unionByName(bars.filter(C("date") == last)))
    assert lake.versions().count() == 7
    closes = {r["date"]: r["close"] for r in lake.read().collect()}
    assert closes[last] == pytest.approx(2 * bars.filter(C("date") == last).first()["close"]) and len(closes) == 6
    run(bars.limit(0), "another")  # all files again, as after a lost checkpoint
    assert lake.versions().count() == 7


def test_snapshots_and_positions_over_a_restart(spark, tmp_path):
    import datetime as dt

    from barloom.streaming import jobs

    at = lambda h: dt.datetime(2024, 1, 1, h)
    schema = "ticker string, updated_at timestamp, payload string"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/n")
        jobs.snapshot_table(jobs.file_stream(spark, f"{tmp_path}/n", spark.createDataFrame([], schema).schema), f"{tmp_path}/t", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
        return {r["ticker"]: r["payload"] for r in jobs.newest_snapshots(spark, f"{tmp_path}/t").collect()}

    assert jobs.newest_snapshots(spark, f"{tmp_path}/t") is None
    assert run([("A", at(1), "a1"), ("A", at(3), "a3"), ("B", at(1), "b1")]) == {"A": "a3", "B": "b1"}
    assert run([("A", at(2), "a2"), ("B", at(4), "b4"), ("C", at(1), "c1")]) == {"A": "a3", "B": "b4", "C": "c1"}


def test_rules_at_their_edges(spark):
    from barloom.operators import rules

    rows = [("ok", 100.0, None), ("none", None, None), ("zero", 0.0, None), ("wild", 100.0, 0.3), ("nan", float("nan"), None)]
    df = spark.createDataFrame(rows, "ticker string, entry double, atr_pct double")
    got = {r["ticker"]: r for r in rules.short_verdicts(df).collect()}
    assert got["ok"]["gate"] == "RED" and got["ok"]["quantity"] == 37 and got["ok"]["risk_reward"] == pytest.approx(2.5)
    assert {got[t]["gate"] for t in ("none", "zero", "nan")} == {"ZERO"} and {got[t]["quantity"] for t in ("none", "zero", "nan")} == {0}
    assert got["wild"]["stop"] == pytest.approx(40.0)
    long = {r["ticker"]: r for r in rules.long_verdicts(df).collect()}
    assert long["ok"]["quantity"] == 90 and long["ok"]["gate"] == "RED" and long["none"]["gate"] == "ZERO"
    assert {r["track"]: r["value"] for r in rules.portfolio_targets(spark).collect()} == {"Track-S": 20_000.0, "Track-L": 75_000.0, "Cash": 5_000.0}
