"""Statistics, gates, allocation, folds, paper portfolio, lake, logs and streams."""

import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions import scalars
from barloom.operators import allocation, gates, learning, memory, paper, stats, timejoins
from barloom.operators.panel import synthetic_bars
from barloom.sources import lake as lakes
from barloom.sources import logs
from barloom.streaming import jobs


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_normal_functions(spark):
    xs = [-9.0, -3.0, -0.5, 0.0, 0.7, 2.5, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", scalars.normal_cdf(F.col("x")).alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), rel=1e-9)
    for r in df.select("x", scalars.normal_ppf(scalars.normal_cdf(F.col("x"))).alias("y")).filter("abs(x) < 3").collect():
        assert r["y"] == pytest.approx(r["x"], abs=1e-6)


def test_text_scalars(spark):
    r = one(spark, a=scalars.mask_secrets(F.lit("api_key=abc token: xyz ok=1 Bearer q.w-e")), b=scalars.strip_market(F.lit("005930.KS")), c=scalars.first_object(F.lit('say {"a": {"b": 1}} end')), d=scalars.mentions(F.lit("A.B"), F.lit("buy a.b now")), e=scalars.mentions(F.lit("A.B"), F.lit("buy axb now")))
    assert r["a"] == "api_key=*** token=*** ok=1 Bearer ***" and r["b"] == "005930" and r["c"] == '{"a": {"b": 1}}' and r["d"] and not r["e"]
    assert scalars.period_start("6mo", date(2024, 7, 1)) == date(2024, 7, 1) - timedelta(days=180)
    assert scalars.period_start("max", date(2024, 7, 1)).year == 1900


def test_information_coefficient(spark):
    df = spark.createDataFrame([("A", float(i), float(i * i)) for i in range(5)] + [("B", 1.0, float(i)) for i in range(5)] + [("C", 1.0, 2.0)], "ticker string, f double, r double")
    got = {r["ticker"]: r["ic"] for r in stats.information_coefficient(df, "f", "r", ["ticker"]).collect()}
    assert got["A"] == pytest.approx(1.0) and got["B"] is None and got["C"] is None


def test_drawdown_of_losses(spark):
    df = spark.createDataFrame([("A", date(2024, 1, i + 1), r) for i, r in enumerate([-0.1, -0.1, 0.05])], "k string, date date, ret double")
    r = stats.annualised(df, ["k"]).first()
    assert r["max_drawdown"] == pytest.approx(-0.1) and r["hit_rate"] == pytest.approx(1 / 3)


def test_deflated_sharpe_is_below_the_plain_one(spark):
    a = [F.lit(x) for x in (0.2, 100.0, 0.0, 3.0)]
    r = one(spark, p=stats.probabilistic_sharpe(a[0], F.lit(0.0), *a[1:]), d=stats.deflated_sharpe(a[0], 50, *a[1:]), n=stats.track_record_length(a[0], F.lit(0.0), a[2], a[3]), none=stats.track_record_length(F.lit(-1.0), F.lit(0.0), a[2], a[3]))
    assert 0 < r["d"] < r["p"] < 1 and r["n"] == math.ceil(1 + (1 + 0.02) * (1.6448536 / 0.2) ** 2) and r["none"] is None


def test_purged_folds_are_disjoint(spark):
    n = 60
    for horizon in (0, 5):
        rows = spark.createDataFrame([(i, min(i + horizon, n - 1)) for i in range(n)], "pos int, end_pos int")
        for fold in (learning.purged_folds(rows, n, 5, 0.05), learning.combinatorial_folds(rows, n, 6, 2, 0.05)):
            got = fold.collect()
            for path in {r["path"] for r in got}:
                test = [r for r in got if r["path"] == path and r["role"] == "test"]
                first, last = min(r["pos"] for r in test), max(r["end_pos"] for r in test)
                assert all(r["end_pos"] < first or r["pos"] > last for r in got if r["path"] == path and r["role"] == "train")
    assert learning.bounds(10, 3) == [(0, 4), (4, 7), (7, 10)]
    with pytest.raises(ValueError):
        learning.bounds(3, 3)


def test_verdicts_and_gates(spark):
    t = gates.SHORT
    check = lambda name, s: F.struct(F.lit(name).alias("name"), F.lit(s).alias("status"))
    good = F.array(*(check(f"C{i}", "PASS") for i in range(6)))
    r = one(
        spark, a=gates.verdict(F.lit(80.0), good, t), b=gates.verdict(F.lit(60.0), good, t), c=gates.verdict(F.lit(80.0), F.array(check("RISK_PLAN", "FAIL")), t),
        d=gates.readiness_gate(F.lit("ELIGIBLE_RECOMMENDATION"), F.lit("PASS"), F.lit(0.4), F.lit(0.6), F.lit(80)), e=scalars.worst_verdict(F.lit("ELIGIBLE_RECOMMENDATION"), F.lit("AMBER_WATCHLIST")), f=gates.source_priority(F.lit("krx-final")), g=gates.model_disagreement(F.array(F.lit(0.9), F.lit(20.0), F.lit(None).cast("double"))),
    )
    assert (r["a"], r["b"], r["c"]) == ("ELIGIBLE_RECOMMENDATION", "AMBER_REVIEW_ONLY", "ZERO_RISK_PLAN_FAILED")
    assert r["d"]["verdict"] == "AMBER_WATCHLIST" and r["d"]["blocking"] == ["ACCURACY_BELOW_50"] and r["e"] == "AMBER_WATCHLIST" and r["f"] == 1 and r["g"]


def test_capped_weights(spark):
    df = spark.createDataFrame([("d", "A", 8.0), ("d", "B", 1.0), ("d", "C", 1.0), ("e", "A", 0.0), ("e", "B", -1.0)], "k string, ticker string, weight double")
    got = {(r["k"], r["ticker"]): r["weight"] for r in allocation.capped(df, 0.5, ["k"]).collect()}
    assert got[("d", "A")] == pytest.approx(0.5) and got[("d", "B")] == pytest.approx(0.25) and got[("e", "A")] == pytest.approx(0.5)
    assert sum(v for (k, _), v in got.items() if k == "d") == pytest.approx(1.0)


def test_conformal_quantile_falls_back(spark):
    rows = [("X", 1, float(i)) for i in range(100)] + [("Y", 1, 5.0)]
    got = {r["regime"]: r for r in allocation.conformal_quantiles(spark.createDataFrame(rows, "regime string, horizon int, residual double")).collect()}
    assert got["Y"]["fallback"] and not got["X"]["fallback"] and got["X"]["q"] == pytest.approx(0.91 * 99)


def test_first_touch_order(spark):
    d = date(2024, 1, 1)
    entries = spark.createDataFrame([("A", d, 90.0, 110.0), ("B", d, 90.0, 110.0)], "ticker string, entry_date date, stop double, target double")
    bars = spark.createDataFrame([("A", d + timedelta(days=2), 120.0, 80.0, 100.0, -1), ("B", d + timedelta(days=1), 105.0, 95.0, 99.0, -1)], "ticker string, date date, high double, low double, close double, signal int")
    got = {r["ticker"]: (r["exit_reason"], r["exit_price"]) for r in timejoins.first_touch(entries, bars, 5).collect()}
    assert got == {"A": ("STOP", 90.0), "B": ("REVERSAL", 99.0)}


def test_paper_orders(spark):
    rows = [("r", i, t, 100.0) for i, t in enumerate(["A", "A", "B", "C", "D"])]
    got = [r["reason"] for r in paper.sized_orders(spark.createDataFrame(rows, "run_id string, nth int, ticker string, price double"), 10_000.0).orderBy("nth").collect()]
    assert got == ["FILLED", "DUPLICATE", "FILLED", "FILLED", "NEW_LIMIT"]


def test_every_signal_of_a_long_run_has_its_order(spark):
    from barloom.plans import catalog

    rows = [("long", i, f"t{i % 400}", None if i == 7 else 50.0) for i in range(1, 30_001)] + [("short", 1, "t1", 50.0)]
    out = paper.sized_orders(spark.createDataFrame(rows, "run_id string, nth int, ticker string, price double"), 10_000.0, most_open=300, most_new=200, share=0.001, buffer=0.0, slippage=0.0)
    got = {(r["run_id"], r["reason"]): r["n"] for r in out.groupBy("run_id", "reason").agg(F.count("*").alias("n")).collect()}
    assert got == {("long", "NO_CASH"): 30_000} | {("short", "NO_CASH"): 1}
    out = paper.sized_orders(spark.createDataFrame(rows, "run_id string, nth int, ticker string, price double"), 1e6, most_open=300, most_new=200, slippage=0.0).filter("run_id = 'long'")
    assert [r["nth"] for r in out.orderBy("nth").collect()] == list(range(1, 30_001))
    base = "/root/testdata/sf0.001"
    assert catalog.queries()["paper_orders"](spark, base).count() == spark.read.parquet(f"{base}/events.parquet").count()


def test_bootstraps_draw_the_whole_job(spark):
    from barloom.operators import events
    from barloom.plans import catalog

    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(300)]
    falls = spark.createDataFrame([("a", d, -0.01) for d in days], "ticker string, date date, ret double")
    r = stats.bootstrap_drawdowns(falls, ["ticker"]).first()
    assert r["paths"] == 2_000 and r["mdd_p50"] == pytest.approx(1 - 0.99**299)  # as long as the series
    m = spark.createDataFrame([(1, float(i % 10), 1.0 + (i % 10 == 9)) for i in range(1000)], "group int, ret double, weight double")
    r, mean = events.bootstrap_interval(m, draws=500).first(), (45 + 9) / 11
    error = (((sum(i * i for i in range(10)) + 81) / 11 - mean**2) / 1000) ** 0.5
    assert abs(r["mean"] - mean) < 0.3 * error and abs(r["low"] - mean + 1.96 * error) < 0.4 * error and abs(r["high"] - mean - 1.96 * error) < 0.4 * error
    base = "/root/testdata/sf0.001"
    assert {r["paths"] for r in catalog.queries()["bootstrap_drawdowns"](spark, base).collect()} == {2_000}
    users = spark.read.parquet(f"{base}/events.parquet").select("user_id").distinct().count()
    assert catalog.queries()["match_interval"](spark, base).count() == users


def test_upsert_keeps_old_outcome(spark):
    old = spark.createDataFrame([("a", 1, 5.0), ("b", 2, None)], "id string, v int, outcome double")
    new = spark.createDataFrame([("a", 9, None), ("c", 3, 1.0)], "id string, v int, outcome double")
    got = {r["id"]: (r["v"], r["outcome"]) for r in memory.upsert(old, new, ["id"], keep=["outcome"]).collect()}
    assert got == {"a": (9, 5.0), "b": (2, None), "c": (3, 1.0)}


def test_lake_point_in_time(spark, tmp_path):
    lake = lakes.Lake(spark, str(tmp_path))
    bars = synthetic_bars(spark, 2, 40)
    for day, by in ((1, 1.0), (3, 2.0)):
        lake.write(bars.withColumn("close", F.col("close") * by), "t", F.lit(f"2024-01-0{day}").cast("timestamp"))
    first = lake.read(["T0"], as_of=datetime(2024, 1, 2))
    assert first.count() == 40 and lake.read().count() == 80
    assert lake.read(["T0"]).agg(F.sum("close")).first()[0] == pytest.approx(2 * first.agg(F.sum("close")).first()[0])
    assert lake.read(["T0"], start=date(2022, 1, 10), end=date(2022, 1, 14)).count() == 5
    assert {r["ticker"] for r in lake.tickers().collect()} == {"T0", "T1"} and not lake.has("T9")
    with pytest.raises(LookupError):
        lake.read(as_of=datetime(2023, 1, 1))


def test_logs(spark, tmp_path):
    event = spark.createDataFrame([("run", "token=abc", {"api_key": "s", "n": "1"})], "event_type string, message string, metadata map<string,string>")
    logs.append_audit(event, f"{tmp_path}/audit")
    (tmp_path / "audit" / "part-bad.json").write_text("{broken\n")
    r = logs.read_audit(spark, f"{tmp_path}/audit").first()
    assert r["message"] == "token=***" and r["metadata"] == {"api_key": "***", "n": "1"}
    log = spark.createDataFrame([(date(2024, 1, 1), "A")], "date date, symbol string")
    with pytest.raises(ValueError, match="already"):
        logs.append_forward(log, log, f"{tmp_path}/log")
    logs.append_forward(log, log, f"{tmp_path}/log", "rerun")
    assert logs.counted_write(log, f"{tmp_path}/out", f"{tmp_path}/prov", "w") == 1


def test_wide_csv(spark, tmp_path):
    lines = ["date,A,B"] + [f"2024-01-{i + 1:02d},{i + 1},{'' if i else 7}" for i in range(20)]
    (tmp_path / "p.csv").write_text("\n".join(lines).replace(",5,", ",x,"))
    got = {r["date"].day: r["price"] for r in lakes.from_wide_csv(spark, f"{tmp_path}/p.csv").filter("asset = 'A'").collect()}
    assert got[5] == 4.0 and got[6] == 6.0 and len(got) == 20
    assert lakes.from_wide_csv(spark, f"{tmp_path}/p.csv").filter("asset = 'B'").count() == 0


def run_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_position_stream(spark, tmp_path):
    quotes = [("A", datetime(2024, 1, 1, i), p, 100.0, 90.0, 110.0) for i, p in enumerate([100.0, 112.0, 120.0, 109.0, 130.0])]
    df = spark.createDataFrame(quotes, "ticker string, ts timestamp, price double, entry double, stop double, tp1 double")
    df.write.parquet(f"{tmp_path}/q")
    got = run_stream(jobs.position_states(jobs.file_stream(spark, f"{tmp_path}/q", df.schema)), "positions")
    assert [(r["status"], r["stop"]) for r in sorted(got, key=lambda r: r["ts"])] == [("OPEN", 90.0), ("STOPPED", 110.0)]


def test_alert_and_log_streams(spark, tmp_path):
    rows = [("b", datetime(2024, 1, 1, i), e) for i, e in enumerate([100.0, 85.0, 80.0, 97.0])]
    df = spark.createDataFrame(rows, "book string, ts timestamp, equity double")
    df.write.parquet(f"{tmp_path}/e")
    got = run_stream(jobs.drawdown_alerts(jobs.file_stream(spark, f"{tmp_path}/e", df.schema)), "alerts")
    assert [r["alert"] for r in sorted(got, key=lambda r: r["ts"])] == ["DRAWDOWN", "RECOVERED"]
    log = spark.createDataFrame([(date(2024, 1, 1), "A", datetime(2024, 1, 1)), (date(2024, 1, 1), "A", datetime(2024, 1, 2))], "date date, symbol string, ts timestamp")
    log.write.parquet(f"{tmp_path}/l")
    assert len(run_stream(jobs.append_once(jobs.file_stream(spark, f"{tmp_path}/l", log.schema)), "once")) == 1


def test_ingest_and_snapshot_streams(spark, tmp_path):
    bars = synthetic_bars(spark, 1, 10).withColumn("ts", F.col("date").cast("timestamp"))
    bars.write.parquet(f"{tmp_path}/b")
    lake = lakes.Lake(spark, f"{tmp_path}/lake")
    q = jobs.ingest(jobs.file_stream(spark, f"{tmp_path}/b", bars.schema), lake, f"{tmp_path}/c1", "feed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert lake.read().count() == 10
    news = spark.createDataFrame([("A", datetime(2024, 1, 1), "old"), ("A", datetime(2024, 1, 2), "new")], "ticker string, updated_at timestamp, payload string")
    news.write.parquet(f"{tmp_path}/n")
    kept = {}
    q = jobs.latest_snapshots(jobs.file_stream(spark, f"{tmp_path}/n", news.schema), lambda: None, lambda df: kept.update({r["ticker"]: r["payload"] for r in df.collect()}), f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert kept == {"A": "new"}
