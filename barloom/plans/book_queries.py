"""Queries over positions, orders and audits: provider reports, compliance and trade statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import allocation, gates, memory, stats, timejoins
from ..operators.panel import brand_bars
from .catalog import query, rounded

C = F.col


@query(
    """WITH {BARS}, raw AS (SELECT ticker, date, open, high, low, CASE WHEN day(date) = 31 THEN NULL ELSE close END AS close, volume FROM bars UNION ALL SELECT ticker, date, open, high, low, close, volume FROM bars WHERE ticker = 'Brand#1' AND day(date) = 2),
a AS (SELECT ticker, count(*) AS rows, count(date) - count(DISTINCT date) AS duplicate_dates, count(*) FILTER (date > DATE '2001-11-01') AS future_rows, count(*) FILTER (close IS NULL) AS nulls, greatest(datediff('day', max(date), DATE '2001-11-01'), 0) AS age_days FROM raw GROUP BY ticker)
SELECT ticker, rows, duplicate_dates, future_rows, nulls, age_days, CASE WHEN duplicate_dates > 0 OR future_rows > 0 OR nulls > 0 OR age_days >= 365 THEN 'FAIL' WHEN age_days > 5 THEN 'AMBER' ELSE 'PASS' END AS status FROM a"""
)
def provider_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = brand_bars(spark, sf_dir)
    raw = bars.withColumn("close", F.when(F.dayofmonth("date") != 31, C("close"))).unionByName(bars.filter("ticker = 'Brand#1' and dayofmonth(date) = 2"))
    return gates.provider_report(raw, F.lit("2001-11-01").cast("date")).drop("failures")


@query(
    """WITH {BARS}, f AS (SELECT ticker, date, close, volume FROM bars), c AS (SELECT ticker, date, close * (1 + (day(date) % 4) / 200.0) AS close, volume / (1 + day(date) % 3) AS volume FROM bars),
j AS (SELECT ticker, date, abs(f.close - c.close) / c.close * 100 AS d, f.volume / c.volume AS l FROM f JOIN c USING (ticker, date))
SELECT ticker, date, round(d, 6) AS close_diff_pct, round(l, 6) AS volume_lag_ratio, CASE WHEN d > 1.0 OR l > 2.0 THEN 'AMBER_DATA_LAG' ELSE 'PASS' END AS status FROM j""",
    days="date",
)
def cache_against_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = brand_bars(spark, sf_dir)
    day = F.dayofmonth("date")
    cache = final.withColumns({"close": C("close") * (1 + (day % 4) / 200.0), "volume": C("volume") / (1 + day % 3)})
    return rounded(gates.cache_vs_final(cache, final).drop("blocking"))


@query(
    """WITH t AS (SELECT event_type AS track, value - 50 AS pnl FROM events)
SELECT track, count(*) AS trades, round(avg(CAST(pnl > 0 AS DOUBLE)), 6) AS win_rate, round(avg(pnl) FILTER (pnl > 0), 5) AS avg_win, round(avg(pnl) FILTER (pnl < 0), 5) AS avg_loss,
  round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END), 0), 6) AS profit_factor, round(avg(pnl), 5) AS expectancy FROM t GROUP BY track"""
)
def trade_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(C("event_type").alias("track"), (C("value") - 50).alias("pnl"))
    return rounded(stats.trade_summary(e, ["track"]), {"avg_win": 5, "avg_loss": 5, "expectancy": 5})


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey AS ticker, o_orderdate::DATE AS date FROM orders WHERE o_orderstatus <> 'F'), c AS (SELECT o_custkey AS ticker, o_orderdate::DATE AS close_date FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0)
SELECT o_orderkey FROM o WHERE EXISTS (SELECT 1 FROM c WHERE c.ticker = o.ticker AND o.date BETWEEN c.close_date AND c.close_date + 30)"""
)
def wash_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns({"ticker": C("o_custkey"), "date": F.to_date("o_orderdate")})
    buys = o.filter("o_orderstatus <> 'F'").withColumn("side", F.lit("BUY"))
    closed = o.filter("o_orderstatus = 'F'").select("ticker", C("date").alias("close_date"), F.when(C("o_orderkey") % 2 == 0, -1.0).otherwise(1.0).alias("pnl"))
    return timejoins.wash_sales(buys, closed).select("o_orderkey")


@query(
    """WITH s AS (SELECT event_id, user_id, ts::DATE AS day FROM events WHERE value <> 0 AND event_type <> 'click'), a AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'click')
SELECT event_id, user_id FROM s ANTI JOIN a USING (user_id, day)"""
)
def unaudited_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", C("user_id").alias("ticker"), F.to_date("ts").alias("day"), C("value").alias("score"), "event_type")
    return timejoins.unaudited(e.filter("event_type <> 'click'"), e.filter("event_type = 'click'")).select("event_id", C("ticker").alias("user_id"))


@query(
    """WITH p AS (SELECT p_partkey, p_type AS sector, 1.0 + (p_size % 5) / 10.0 AS beta FROM part), h AS (SELECT l_partkey, sum(l_quantity) AS quantity, max(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY l_partkey),
w AS (SELECT coalesce(sector, 'OTHER') AS sector, quantity * price AS worth, coalesce(beta, 1.0) AS beta FROM h LEFT JOIN p ON p_partkey = l_partkey AND p_partkey % 10 <> 0)
SELECT sector, round(sum(worth) / 1e9, 6) AS weight, round(max(worth) / 1e9, 6) AS largest, round(sum(worth * beta) / sum(worth), 6) AS beta FROM w GROUP BY sector"""
)
def sector_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.max(C("l_extendedprice") / C("l_quantity")).alias("price"))
    held = lines.withColumn("ticker", F.concat(C("l_partkey").cast("string"), F.lit(".KS")))
    sectors = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 10 <> 0").select(C("p_partkey").cast("string").alias("ticker"), C("p_type").alias("sector"), (1.0 + (C("p_size") % 5) / 10.0).alias("beta"))
    out = allocation.exposure(held, sectors, 1e9)
    return rounded(out.select("sector", "weight", (C("largest") / 1e9).alias("largest"), "beta"))


@query(
    """WITH s AS (SELECT event_type AS book, CASE event_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'x2' ELSE 'x5' END AS label, avg(value) / 50 - 1 AS sharpe FROM events GROUP BY ALL),
a AS (SELECT book, max(sharpe) FILTER (label = 'base') AS b, max(sharpe) FILTER (label = 'x2') AS x2, max(sharpe) FILTER (label = 'x5') AS x5 FROM s GROUP BY book)
SELECT book, round(b, 6) AS base, round(x2, 6) AS x2, round(x5, 6) AS x5, CASE WHEN b > 0 AND x2 > 0 AND x5 > -0.5 THEN 'PROMOTE' WHEN b > 0 THEN 'WATCH' ELSE 'REJECT' END AS verdict FROM a"""
)
def policy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    label = F.when(C("event_id") % 3 == 0, "base").when(C("event_id") % 3 == 1, "x2").otherwise("x5")
    s = e.groupBy(C("event_type").alias("book"), label.alias("label")).agg((F.avg("value") / 50 - 1).alias("sharpe"))
    return rounded(gates.policy_verdict(s, ["book"]).drop("blockers"))


@query(
    """WITH p AS (SELECT user_id AS ticker, ts, value, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, event_type FROM events)
SELECT 'CLOSED' AS rule, ticker AS key, count(*) AS n FROM p WHERE event_type <> 'click' AND was = 'click' GROUP BY ticker"""
)
def closing_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the closing rule: a position that was open (a click) and is not any more."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    status = F.when(C("event_type") == "click", "OPEN").otherwise("CLOSED")
    p = e.select(C("user_id").alias("ticker"), F.struct("ts", "event_id").alias("date"), status.alias("status"), C("value").alias("price"), F.lit(-1e9).alias("stop"), F.lit(1e9).alias("tp1"))
    none = spark.createDataFrame([], "book bigint, exposure double, drawdown double")
    models = spark.createDataFrame([], "ticker bigint, auc double, oof_coverage double")
    return memory.alerts(p, none, models).groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH {BARS}, m AS (SELECT ticker AS position, date, close AS price, first_value(close) OVER (PARTITION BY ticker ORDER BY date) AS entry FROM bars),
r AS (SELECT *, max(price) OVER w AS peak, min(price) OVER w AS trough FROM m WINDOW w AS (PARTITION BY position ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT position, date, round(peak / entry - 1, 6) AS mfe, round(trough / entry - 1, 6) AS mae FROM r""",
    days="date",
)
def position_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import paper

    w = Window.partitionBy("ticker").orderBy("date")
    marks = brand_bars(spark, sf_dir).select("ticker", "date", C("close").alias("price"), F.first("close").over(w).alias("entry"))
    marks = marks.withColumns({"stop": C("entry") * 0.5, "tp1": C("entry") * 2})
    return rounded(paper.position_path(marks).select(C("ticker").alias("position"), "date", "mfe", "mae"))
