"""Queries over signals, patterns and rules with stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import patterns, rules, stats, sweeps, timejoins
from ..operators.panel import brand_bars
from .catalog import query, rounded
from .risk_queries import _RET, _W, daily_returns

C = F.col


def _ranked(by: str, rows: str) -> str:
    rank = lambda x: f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"
    return f"SELECT {by}, f, r, {rank('f')} AS a, {rank('r')} AS b FROM {rows}"


@query(
    f"""WITH {{BARS}}, {_RET}, s AS (SELECT ticker, CASE WHEN ret > 0 THEN ret ELSE 0.0 END AS f, lead(close) OVER {_W}) / close - 1 AS r, row_number() OVER {_W}) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS bars FROM r),
k AS (SELECT * FROM s WHERE r IS NOT NULL), d AS (SELECT ticker, st AS start, f, r FROM k JOIN (SELECT ticker AS t, unnest(range(0, max(bars) - 21, 5)) AS st FROM s GROUP BY ticker) w ON t = ticker AND pos BETWEEN st AND st + 20),
wr AS ({_ranked("ticker, start", "d")}), wi AS (SELECT ticker, start, corr(a, b) AS ic FROM wr GROUP BY ALL HAVING count(*) >= 21 AND stddev_samp(f) > 1e-9 AND stddev_samp(r) > 1e-9),
i AS (SELECT ticker, count(*) AS windows, CASE WHEN count(*) >= 5 AND stddev_samp(ic) > 1e-9 THEN avg(ic) / stddev_samp(ic) END AS ir FROM wi GROUP BY ticker),
kr AS ({_ranked("ticker", "k")}) SELECT kr.ticker, round(corr(a, b), 6) AS rank_ic, round(corr(f, r), 6) AS ic, coalesce(any_value(windows), 0) AS windows, round(any_value(ir), 6) AS ir FROM kr LEFT JOIN i ON i.ticker = kr.ticker GROUP BY kr.ticker"""
)
def signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's gain as a signal of the next day's return: correlations, and their ratio over windows that start every fifth bar."""
    r = daily_returns(spark, sf_dir)
    ahead = F.lead("close").over(Window.partitionBy("ticker").orderBy("date")) / C("close") - 1
    gain = F.when(C("ret") > 0, C("ret")).otherwise(0.0)
    return rounded(stats.signal_quality(r.select("ticker", "date", gain.alias("s"), ahead.alias("ahead")), "s", "ahead"))


_PATTERNS = ("x1", "x2", "x3")
_Z = ", ".join(f"(p.{x} - m_{x}) / CASE WHEN s_{x} < 1e-9 THEN 1 ELSE s_{x} END AS z_{x}" for x in _PATTERNS)
_SIZE = "sqrt(" + " + ".join(f"z_{x} * z_{x}" for x in _PATTERNS) + ")"


@query(
    f"""WITH {{BARS}}, {_RET}, a AS (SELECT ticker, date, ln(close / lag(close) OVER {_W})) AS x1, ln(volume / lag(volume) OVER {_W})) AS x2, ln(close / lag(close, 5) OVER {_W})) AS x3, lead(close, 5) OVER {_W}) / close - 1 AS ret FROM r),
p AS (SELECT *, row_number() OVER {_W}) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM a WHERE x1 + x2 + x3 + ret IS NOT NULL),
f AS (SELECT ticker, n, k AS fold, 60 + k * greatest(1, (n - 60) // 5) AS train, 60 + k * greatest(1, (n - 60) // 5) + 5 AS a, least(n, 60 + k * greatest(1, (n - 60) // 5) + 5 + greatest(1, (n - 60) // 5)) AS b FROM (SELECT DISTINCT ticker, n FROM p WHERE n >= 65), (SELECT unnest(range(5)) AS k)),
m AS (SELECT p.ticker, fold, {", ".join(f"avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}" for x in _PATTERNS)} FROM f JOIN p ON p.ticker = f.ticker AND i < train GROUP BY ALL),
z AS (SELECT p.ticker, f.fold, p.i, p.ret, i < train AS known, {_Z} FROM f JOIN p ON p.ticker = f.ticker AND (i < train OR (i >= a AND i < b)) JOIN m ON m.ticker = f.ticker AND m.fold = f.fold),
u AS (SELECT ticker, fold, i, ret, known, {", ".join(f"CASE WHEN {_SIZE} > 0 THEN z_{x} / {_SIZE} ELSE 0 END AS u_{x}" for x in _PATTERNS)} FROM z),
c AS (SELECT q.ticker, q.fold, q.i, t.i AS j, t.ret, round({" + ".join(f"q.u_{x} * t.u_{x}" for x in _PATTERNS)}, 12) AS c FROM u q JOIN u t ON t.ticker = q.ticker AND t.fold = q.fold AND t.known WHERE NOT q.known),
b AS (SELECT ticker, fold, i, sum(c * ret) / sum(c) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY ticker, fold, i ORDER BY c DESC, j) AS nth FROM c WHERE c >= 0.3) WHERE nth <= 7 GROUP BY ALL),
o AS (SELECT u.ticker, u.fold, coalesce(pred, 0) AS pred, u.ret AS actual FROM u LEFT JOIN b USING (ticker, fold, i) WHERE NOT known)
SELECT o.ticker, CAST(o.fold AS INTEGER) AS fold, any_value(train) AS train_n, count(*) AS test_n, round(avg(CAST(sign(pred) = sign(actual) AS DOUBLE)), 6) AS hit_rate, round(avg(pred), 4) AS mean_pred, round(avg(actual), 4) AS mean_actual,
  round(CASE WHEN var_pop(actual) > 1e-12 THEN 1 - sum(pow(actual - pred, 2)) / (var_pop(actual) * count(*)) ELSE 0 END, 4) AS r2 FROM o JOIN f ON f.ticker = o.ticker AND f.fold = o.fold GROUP BY o.ticker, o.fold"""
)
def pattern_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's five-day returns foreseen from its nearest earlier days by return, volume change and five-day move."""
    w = Window.partitionBy("ticker").orderBy("date")
    bars = brand_bars(spark, sf_dir)
    rows = bars.select(
        "ticker", "date", F.log(C("close") / F.lag("close").over(w)).alias("x1"), F.log(C("volume") / F.lag("volume").over(w)).alias("x2"), F.log(C("close") / F.lag("close", 5).over(w)).alias("x3"),
        (F.lead("close", 5).over(w) / C("close") - 1).alias("ret"),
    ).dropna()
    return rounded(patterns.walk_forward(rows, _PATTERNS), {"mean_pred": 4, "mean_actual": 4, "r2": 4})


_MAS, _STOPS = (5, 10, 20, 50), (0.02, 0.05, 0.1)
_RULES = " UNION ALL ".join(f"SELECT {n} AS ma, ticker, date, n, close, ret, count(close) OVER {_W} ROWS {n - 1} PRECEDING) >= {n} AND close > avg(close) OVER {_W} ROWS {n - 1} PRECEDING) AS above FROM a" for n in _MAS)


@query(
    f"""WITH RECURSIVE {{BARS}}, c AS (SELECT ticker, date, pow(close, 0.1) AS close FROM bars), a AS (SELECT *, row_number() OVER {_W}) AS n, coalesce(close / lag(close) OVER {_W}) - 1, 0) AS ret FROM c), o AS ({_RULES}),
e AS (SELECT ticker, ma, stop, n, date, 0.0::DOUBLE AS net, 0.0::DOUBLE AS paid, CASE WHEN above THEN 1.0 ELSE 0.0 END::DOUBLE AS held, CASE WHEN above THEN 1.0 ELSE 0.0 END::DOUBLE AS moved, close AS entry, false AS waits FROM o, (SELECT unnest({list(_STOPS)})::DOUBLE AS stop) WHERE n = 1
  UNION ALL SELECT ticker, ma, stop, n, date, net, paid, CASE WHEN wanted THEN 1.0 ELSE 0.0 END::DOUBLE, abs(CASE WHEN wanted THEN 1.0 ELSE 0.0 END::DOUBLE - held), CASE WHEN wanted AND held = 0 THEN close ELSE entry END, waits
  FROM (SELECT *, above AND NOT waits AS wanted FROM (SELECT o.ticker, o.ma, e.stop, o.n, o.date, o.close, e.held * o.ret - 0.0005 * e.moved AS net, e.moved AS paid, e.held, e.entry, o.above, o.above AND (e.waits OR (e.held > 0 AND o.close <= (1 - e.stop) * e.entry)) AS waits
    FROM e JOIN o ON o.ticker = e.ticker AND o.ma = e.ma AND o.n = e.n + 1))),
d AS (SELECT ma, stop, date, avg(net) AS ret, sum(paid) AS paid FROM e GROUP BY ALL), h AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ma, stop ORDER BY date ROWS UNBOUNDED PRECEDING)) AS eq FROM d), x AS (SELECT *, eq / max(eq) OVER (PARTITION BY ma, stop ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM h),
y AS (SELECT ma, stop, avg(ret) * 252 AS ann, CASE WHEN stddev_pop(ret) * sqrt(252) > 1e-12 THEN avg(ret) * 252 / (stddev_pop(ret) * sqrt(252)) ELSE 0 END AS sharpe, min(dd) AS dd, sum(paid) AS trades FROM x GROUP BY ALL)
SELECT CAST(ma AS INTEGER) AS ma, stop, round(ann, 5) AS ann_return, round(sharpe, 5) AS sharpe, round(dd, 5) AS max_drawdown, trades FROM y ORDER BY sharpe DESC, ma, stop LIMIT 10"""
)
def stop_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of twelve rules of average and stop, on tamed prices."""
    return rounded(sweeps.stop_sweep(brand_bars(spark, sf_dir).withColumn("close", F.pow("close", F.lit(0.1))), _MAS, _STOPS), 5)


_CANDIDATES = """c AS (SELECT event_id AS n, 'T' || event_id AS ticker, value + 5 AS entry, (event_id % 101)::DOUBLE AS rsi, (event_id % 77)::DOUBLE AS adx, (event_id % 9) / 2.0 AS vr, (event_id % 5 - 2)::DOUBLE AS macd, (event_id % 7 - 3) / 100.0 AS r5,
  (event_id % 11 - 5) / 100.0 AS sma, (event_id % 13) / 12.0 AS bb, (event_id % 17 - 8) / 10.0 AS cmf, (event_id % 19 - 9) / 50.0 AS vi, CASE WHEN event_id % 4 > 0 THEN (event_id % 100) / 100.0 END AS prob, CASE WHEN event_id % 3 > 0 THEN (event_id % 23) / 200.0 END AS atr,
  (event_id % 6) * 2000000.0 AS dv, CASE WHEN event_id % 29 = 0 THEN -0.06 ELSE 0.0 END AS pnl, event_id % 31 = 0 AS margin, CASE WHEN event_id % 2 = 0 THEN (event_id % 100)::DOUBLE END AS quality, (event_id % 50) / 50.0 AS vol FROM events)"""


@query(
    f"""WITH {_CANDIDATES}, s AS (SELECT *, least(greatest(50 + CASE WHEN rsi BETWEEN 45 AND 68 THEN 10 WHEN rsi > 80 OR rsi < 25 THEN -8 ELSE 0 END + least(12, least(adx, 60) / 5) + least(10, least(vr, 4) * 3) + CASE WHEN macd > 0 THEN 8 ELSE -4 END + CASE WHEN r5 > 0 THEN 8 ELSE -5 END
    + CASE WHEN sma > 0 THEN 7 ELSE -4 END + CASE WHEN bb BETWEEN 0.35 AND 0.85 THEN 4 ELSE -3 END + least(greatest(cmf * 8, -6), 8) + CASE WHEN vi > 0.05 THEN 4 WHEN vi < -0.05 THEN -3 ELSE 0 END + (coalesce(prob, 0.5) - 0.5) * 30, 0), 100) AS score,
  entry * (1 - CASE WHEN atr > 0 THEN greatest(0.04, 2 * atr) ELSE 0.04 END) AS stop FROM c),
z AS (SELECT *, entry - stop AS risk, floor(20000 * 0.0075 / (entry - stop))::BIGINT AS qty, (entry * 1.1 - entry) / (entry - stop) AS reward FROM s),
g AS (SELECT *, least(CASE WHEN margin OR pnl <= -0.05 THEN 0 ELSE 3 END, CASE WHEN dv <> 0 AND dv < 5000000 THEN 1 ELSE 3 END, CASE WHEN reward < 2 THEN 2 ELSE 3 END, CASE WHEN score >= 75 THEN 3 WHEN score >= 65 THEN 2 ELSE 1 END, CASE WHEN qty * risk > 400 THEN 1 ELSE 3 END) AS g FROM z),
l AS (SELECT *, least(greatest(CASE WHEN quality > 0 THEN 0.35 * quality + 0.25 * 90 ELSE 70 + CASE WHEN sma > 0 THEN 8 ELSE -8 END + CASE WHEN r5 > 0 THEN 5 ELSE -5 END - least(15, greatest(0, vol - 0.25) * 35) END + (coalesce(prob, 0.5) - 0.5) * 10, 0), 100) AS score FROM c)
SELECT ticker, 'S' AS track, round(score, 6) AS score, ['ZERO', 'RED', 'AMBER', 'GREEN'][g + 1] AS gate, ['No Trade', 'Reject', 'Watch Only', 'Watch/Buy'][g + 1] AS verdict, round(entry, 6) AS entry, round(stop, 6) AS stop, round(entry * 1.05, 6) AS tp1, round(entry * 1.1, 6) AS tp2, round(reward, 6) AS risk_reward, round(risk, 6) AS risk_per_share,
  qty AS quantity, round(qty * entry, 6) AS position_value, round(qty * risk, 6) AS open_risk FROM g
UNION ALL SELECT ticker, 'L', round(score, 6), CASE WHEN score >= 80 THEN 'GREEN' WHEN score >= 70 THEN 'AMBER' ELSE 'RED' END, CASE WHEN score >= 80 THEN 'Eligible/DCA' WHEN score >= 70 THEN 'Hold/Monitor' ELSE 'Reject' END, round(entry, 6), round(entry * 0.88, 6), round(entry * 1.1, 6), round(entry * 1.2, 6), 0, 0, floor(9000 / entry)::BIGINT, round(floor(9000 / entry) * entry, 6), 0 FROM l"""
)
def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a candidate of both tracks, half of them with a quality to go by."""
    n = C("event_id")
    m = lambda k: (n % k).cast("double")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("T"), n.cast("string")).alias("ticker"), (C("value") + 5).alias("entry"), m(101).alias("rsi_14"), m(77).alias("adx_14"), (m(9) / 2).alias("volume_ratio_20"), (m(5) - 2).alias("macd_hist"), ((m(7) - 3) / 100).alias("return_5d"), ((m(7) - 3) / 100).alias("return_20d"),
        ((m(11) - 5) / 100).alias("sma_ratio_20"), ((m(11) - 5) / 100).alias("sma_ratio_200"), (m(13) / 12).alias("bb_pct"), ((m(17) - 8) / 10).alias("cmf_20"), ((m(19) - 9) / 50).alias("vi_diff_14"), F.when(n % 4 > 0, m(100) / 100).alias("prob"), F.when(n % 3 > 0, m(23) / 200).alias("atr_pct"),
        ((n % 6) * 2_000_000.0).alias("dollar_volume"), F.when(n % 29 == 0, -0.06).otherwise(0.0).alias("monthly_pnl_pct"), (n % 31 == 0).alias("allow_margin"), F.when(n % 2 == 0, m(100)).alias("business_quality"), F.when((n % 2 == 0) & (n % 100 > 0), 90.0).alias("earnings_quality"), (m(50) / 50).alias("hist_vol_20"),
    )
    return rounded(rules.short_verdicts(rows).unionByName(rules.long_verdicts(rows)))


@query(
    f"""WITH {{BARS}}, {_RET}, d AS (SELECT date, avg(ret) AS market FROM r WHERE ret IS NOT NULL GROUP BY date), x AS (SELECT o_orderdate::DATE AS date, count(*)::DOUBLE AS orders, avg(o_totalprice) / 1e6 AS price FROM orders WHERE day(o_orderdate) = 15 GROUP BY ALL)
SELECT d.date, round(market, 6) AS market, last_value(orders IGNORE NULLS) OVER (ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS x_orders, round(last_value(price IGNORE NULLS) OVER (ORDER BY d.date ROWS UNBOUNDED PRECEDING), 6) AS x_price FROM d LEFT JOIN x ON x.date = d.date""",
    days="date",
)
def exogenous_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean return of each day beside what the fifteenths of months say of orders, carried onto the days that follow."""
    market = daily_returns(spark, sf_dir).filter("ret is not null").groupBy("date").agg(F.avg("ret").alias("market"))
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("date"), (C("o_totalprice").cast("double") / 1e6).alias("price")).filter(F.dayofmonth("date") == 15)
    monthly = lines.groupBy("date").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.avg("price").alias("price"))
    return rounded(timejoins.onto_dates(market, monthly, ["orders", "price"]))
