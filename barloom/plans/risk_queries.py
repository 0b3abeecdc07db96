"""Queries over returns: factor measures, performance, backtest honesty, folds and models."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events, forecasters, gates, indicators, learning, stats
from ..operators.panel import brand_bars
from ..sources.shared import landed
from .catalog import query, rounded

C = F.col
_W = "(PARTITION BY ticker ORDER BY date"
_RET = f"r AS (SELECT ticker, date, close, volume, close / lag(close) OVER {_W}) - 1 AS ret FROM bars)"


def returns_of(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    return bars.select("ticker", "date", "close", "volume", (C("close") / F.lag("close").over(w) - 1).alias("ret"))


def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns_of(brand_bars(spark, sf_dir))


_RANKS = """k AS (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY f) + (count(*) OVER (PARTITION BY {by}, f) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY {by} ORDER BY t) + (count(*) OVER (PARTITION BY {by}, t) - 1) / 2.0 AS b FROM p)"""


@query(
    f"WITH {{BARS}}, {_RET}, p AS (SELECT ticker, f, t FROM (SELECT ticker, ret AS f, lead(close, 5) OVER {_W}) / close - 1 AS t FROM r) WHERE f IS NOT NULL AND t IS NOT NULL), "
    + _RANKS.format(by="ticker")
    + " SELECT ticker, count(*) AS n, round(corr(a, b), 6) AS ic FROM k GROUP BY ticker"
)
def factor_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    df = daily_returns(spark, sf_dir).withColumn("ahead", F.lead("close", 5).over(w) / C("close") - 1)
    return rounded(stats.information_coefficient(df, "ret", "ahead", ["ticker"]))


@query(
    f"WITH {{BARS}}, {_RET}, h AS (SELECT unnest([1, 5, 20]) AS horizon), "
    f"p AS (SELECT ticker, horizon, f, t FROM (SELECT ticker, 1 AS horizon, ret AS f, lead(close, 1) OVER {_W}) / close - 1 AS t FROM r UNION ALL SELECT ticker, 5, ret, lead(close, 5) OVER {_W}) / close - 1 FROM r UNION ALL SELECT ticker, 20, ret, lead(close, 20) OVER {_W}) / close - 1 FROM r) WHERE f IS NOT NULL AND t IS NOT NULL), "
    + _RANKS.format(by="ticker, horizon")
    + " SELECT ticker, horizon, count(*) AS n, round(corr(a, b), 6) AS ic FROM k GROUP BY ticker, horizon"
)
def factor_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.factor_decay(daily_returns(spark, sf_dir), "ret", [1, 5, 20]))


@query(
    f"""WITH {{BARS}}, {_RET}, p AS (SELECT ticker, f, t FROM (SELECT ticker, volume AS f, lead(close, 5) OVER {_W}) / close - 1 AS t FROM r) WHERE t IS NOT NULL),
c AS (SELECT ticker, list_sort(list_distinct(quantile_cont(f, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS cuts FROM p GROUP BY ticker)
SELECT ticker, CAST(greatest(len(list_filter(cuts, lambda x: x < f)), 1) AS INTEGER) AS bucket, round(avg(t), 6) AS mean_return, count(*) AS n FROM p JOIN c USING (ticker) GROUP BY ALL"""
)
def factor_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    df = daily_returns(spark, sf_dir).withColumn("ahead", F.lead("close", 5).over(w) / C("close") - 1)
    return rounded(stats.quantile_returns(df, "volume", "ahead"))


@query(
    f"""WITH {{BARS}}, k AS (SELECT ticker, date, rank() OVER (PARTITION BY ticker ORDER BY close) + (count(*) OVER (PARTITION BY ticker, close) - 1) / 2.0 AS k FROM bars),
l AS (SELECT ticker, k, lag(k) OVER {_W}) AS b FROM k)
SELECT ticker, round(corr(k, b), 6) AS rho, count(*) AS n, round(CASE WHEN corr(k, b) > 0 AND corr(k, b) < 1 THEN ln(0.5) / ln(corr(k, b)) END, 5) AS half_life FROM l WHERE b IS NOT NULL GROUP BY ticker"""
)
def factor_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.rank_autocorrelation(daily_returns(spark, sf_dir), "close")
    return rounded(out.withColumn("half_life", stats.half_life(C("rho"))), {"half_life": 5})


_HELD = f"s AS (SELECT ticker, date, coalesce(lag(CASE WHEN close < lag5 THEN 1.0 ELSE 0.0 END) OVER {_W}), 0) AS held, ret FROM (SELECT *, lag(close, 5) OVER {_W}) AS lag5 FROM r))"


def strategy_of(returns: DataFrame) -> DataFrame:
    """A tenth of the return after a five-day fall, with the change of the position as turnover."""
    w = Window.partitionBy("ticker").orderBy("date")
    df = returns.withColumn("on", F.when(C("close") < F.lag("close", 5).over(w), 1.0).otherwise(0.0))
    df = df.withColumn("held", F.coalesce(F.lag("on").over(w), F.lit(0.0)))
    moved = F.abs(C("held") - F.coalesce(F.lag("held").over(w), F.lit(0.0)))
    return df.select("ticker", "date", "held", moved.alias("moved"), (moved * 0.0005).alias("cost"), (0.1 * C("held") * F.coalesce("ret", F.lit(0.0))).alias("ret"))


def strategy_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategy_of(daily_returns(spark, sf_dir))


_STRATEGY = f"""{_RET}, {_HELD},
d AS (SELECT ticker, date, held, 0.1 * held * coalesce(ret, 0) AS ret, abs(held - coalesce(lag(held) OVER {_W}), 0)) AS moved FROM s),
e AS (SELECT *, exp(sum(ln(1 + ret)) OVER {_W} ROWS UNBOUNDED PRECEDING)) AS eq FROM d),
x AS (SELECT *, eq / max(eq) OVER {_W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)"""


@query(
    f"""WITH {{BARS}}, {_STRATEGY}
SELECT ticker, count(*) AS periods, round(avg(ret) * 252, 5) AS ann_return, round(stddev_pop(ret) * sqrt(252), 5) AS ann_vol,
  round(CASE WHEN stddev_pop(ret) * sqrt(252) > 1e-12 THEN avg(ret) * 252 / (stddev_pop(ret) * sqrt(252)) ELSE 0 END, 5) AS sharpe, round(min(dd), 6) AS max_drawdown,
  round(CASE WHEN abs(min(dd)) > 1e-12 THEN avg(ret) * 252 / abs(min(dd)) ELSE 0 END, 4) AS calmar, round(avg(CAST(ret > 0 AS DOUBLE)), 6) AS hit_rate, round(avg(moved), 6) AS avg_turnover,
  round(avg(moved * 0.0005) * 252, 6) AS ann_cost_drag FROM x GROUP BY ticker"""
)
def annualised_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.annualised(strategy_returns(spark, sf_dir), ["ticker"], turnover="moved", cost="cost")
    return rounded(out, {"ann_return": 5, "ann_vol": 5, "sharpe": 5, "calmar": 4})


@query(
    f"""WITH {{BARS}}, {_STRATEGY},
t AS (SELECT ticker, avg(ret) AS cvar FROM (SELECT ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY ret) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM d) WHERE k <= greatest(1, floor(n * 0.05)) GROUP BY ticker)
SELECT x.ticker, count(*) AS periods, round(sum(ln(1 + ret)), 5) AS log_growth, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252), 5) AS sharpe,
  round(avg(ret) / nullif(sqrt(avg(pow(least(ret, 0), 2))), 0) * sqrt(252), 4) AS sortino, round(min(dd), 6) AS max_drawdown, round(avg(CAST(held <> 0 AS DOUBLE)), 6) AS exposure, round(any_value(t.cvar), 6) AS cvar
FROM x JOIN t ON t.ticker = x.ticker GROUP BY x.ticker"""
)
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = strategy_returns(spark, sf_dir)
    out = stats.performance(rets, ["ticker"], exposure="held").withColumn("log_growth", F.log1p("total_return")).drop("annual_return", "calmar", "total_return").join(stats.tail_mean(rets, ["ticker"]), "ticker")
    return rounded(out, {"log_growth": 5, "sharpe": 5, "sortino": 4})


@query(
    f"""WITH {{BARS}}, {_STRATEGY}, m AS (SELECT ticker, count(*)::DOUBLE AS n, avg(ret) / nullif(stddev_samp(ret), 0) AS sr, skewness(ret) AS sk, kurtosis(ret) + 3 AS ku FROM d GROUP BY ticker),
z AS (SELECT *, greatest(1 - sk * sr + (ku - 1) / 4 * sr * sr, 1e-12) AS v FROM m)
SELECT ticker, CAST(n AS BIGINT) AS n_obs, round(sr, 6) AS sr, round(sk, 5) AS skew, round(ku, 4) AS kurt,
  CASE WHEN sr > 0 THEN CAST(ceil(1 + v * pow(1.6448536269514722 / sr, 2)) AS BIGINT) END AS track_length FROM z"""
)
def return_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.moments(strategy_returns(spark, sf_dir), ["ticker"])
    out = m.withColumn("track_length", stats.track_record_length(C("sr"), F.lit(0.0), C("skew"), C("kurt")))
    return rounded(out, {"skew": 5, "kurt": 4})


def _normal_sql(x: str) -> str:
    """The normal distribution function by Simpson's rule over 0 to x."""
    weight = "CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(0.5 + ({x}) / 1200 / sqrt(2 * pi()) * list_sum(list_transform(range(401), lambda i: {weight} * exp(-pow(i / 400.0 * ({x}), 2) / 2))))"


def _best_of(trials: int) -> float:
    """Expected largest of that many standard normal draws."""
    normal = NormalDist()
    return (1 - stats.EULER) * normal.inv_cdf(1 - 1 / trials) + stats.EULER * normal.inv_cdf(1 - 1 / (trials * math.e))


@query(
    f"""WITH {{BARS}}, {_STRATEGY}, m AS (SELECT ticker, count(*)::DOUBLE AS n, avg(ret) / nullif(stddev_samp(ret), 0) AS sr, skewness(ret) AS sk, kurtosis(ret) + 3 AS ku FROM d GROUP BY ticker),
z AS (SELECT ticker, sqrt(n - 1) / sqrt(greatest(1 - sk * sr + (ku - 1) / 4 * sr * sr, 1e-12)) AS scale, sr, {_best_of(25)} / sqrt(n - 1) AS best FROM m), u AS (SELECT ticker, sr * scale AS a, (sr - best) * scale AS b FROM z)
SELECT ticker, round({_normal_sql("a")}, 6) AS psr, round({_normal_sql("b")}, 6) AS dsr FROM u"""
)
def sharpe_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilistic and deflated Sharpe ratios."""
    m = stats.moments(strategy_returns(spark, sf_dir), ["ticker"])
    args = (C("n_obs"), C("skew"), C("kurt"))
    return rounded(m.select("ticker", stats.probabilistic_sharpe(C("sr"), F.lit(0.0), *args).alias("psr"), stats.deflated_sharpe(C("sr"), 25, *args).alias("dsr")))


@query(
    """WITH {BARS}, """
    + _STRATEGY
    + """, y AS (SELECT ticker, year(date) AS y, avg(ret) / nullif(stddev_pop(ret), 0) AS sharpe FROM d GROUP BY ALL)
SELECT ticker, count(sharpe) AS paths, round(coalesce(avg(CAST(sharpe <= 0 AS DOUBLE)), 1), 6) AS pbo, round(avg(CAST(sharpe > 0 AS DOUBLE)), 6) AS pass_rate,
  CASE WHEN coalesce(avg(CAST(sharpe <= 0 AS DOUBLE)), 1) <= 0.2 THEN 'PASS' WHEN coalesce(avg(CAST(sharpe <= 0 AS DOUBLE)), 1) <= 0.5 THEN 'AMBER' ELSE 'RED' END AS status FROM y GROUP BY ticker"""
)
def overfitting_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = strategy_returns(spark, sf_dir).groupBy("ticker", F.year("date").alias("y")).agg((F.avg("ret") / F.nullif(F.stddev_pop("ret"), F.lit(0.0))).alias("sharpe"))
    return rounded(stats.overfitting(years, ["ticker"]))


@query(
    """WITH p AS (SELECT l_shipdate::DATE AS date, p_type AS sector, sum(l_quantity) AS a, sum(l_extendedprice) AS b, avg(l_discount) AS rp, avg(l_tax) AS rb FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
w AS (SELECT date, sector, a / sum(a) OVER (PARTITION BY date) AS wp, b / sum(b) OVER (PARTITION BY date) AS wb, rp, rb FROM p),
t AS (SELECT *, sum(wb * rb) OVER (PARTITION BY date) AS rbt FROM w)
SELECT date, sector, round(sum((wp - wb) * (rb - rbt)), 6) AS allocation, round(sum(wb * (rp - rb)), 6) AS selection, round(sum((wp - wb) * (rp - rb)), 6) AS interaction,
  round(sum((wp - wb) * (rb - rbt)) + sum(wb * (rp - rb)) + sum((wp - wb) * (rp - rb)), 6) AS active FROM t GROUP BY GROUPING SETS ((date, sector), (date))""",
    days="date",
)
def brinson_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(C("p_partkey").alias("l_partkey"), C("p_type").alias("sector"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(part, "l_partkey")
    p = lines.groupBy(F.to_date("l_shipdate").alias("date"), "sector").agg(F.sum("l_quantity").alias("a"), F.sum("l_extendedprice").alias("b"), F.avg("l_discount").alias("rp"), F.avg("l_tax").alias("rb"))
    day = Window.partitionBy("date")
    return rounded(stats.brinson(p.select("date", "sector", (C("a") / F.sum("a").over(day)).alias("wp"), (C("b") / F.sum("b").over(day)).alias("wb"), "rp", "rb")))


@query(
    f"""WITH {{BARS}}, {_RET}, m AS (SELECT date, avg(ret) AS m FROM r WHERE ret IS NOT NULL GROUP BY date), j AS (SELECT r.ticker, r.date, ret, m FROM r LEFT JOIN m ON m.date = r.date),
w AS (SELECT ticker, date, count(CASE WHEN ret IS NOT NULL AND m IS NOT NULL THEN 1 END) OVER f AS n, regr_slope(ret, m) OVER f AS beta, regr_intercept(ret, m) OVER f AS alpha, regr_r2(ret, m) OVER f AS r2 FROM j WINDOW f AS {_W} ROWS 59 PRECEDING))
SELECT ticker, date, round(CASE WHEN n >= 60 THEN beta END, 5) AS beta, round(CASE WHEN n >= 60 THEN alpha END, 6) AS alpha, round(CASE WHEN n >= 60 THEN r2 END, 6) AS r2 FROM w""",
    days="date",
)
def rolling_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily_returns(spark, sf_dir)
    m = r.filter("ret is not null").groupBy("date").agg(F.avg("ret").alias("m"))
    return rounded(stats.rolling_regression(r.join(m, "date", "left"), "ret", "m"), {"beta": 5})


@query(
    f"""WITH {{BARS}}, {_STRATEGY}, k AS (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS multiple), n AS (SELECT ticker, multiple, ret - multiple * moved * 0.0005 AS net FROM d, k)
SELECT ticker, multiple, count(*) AS periods, round(avg(net) * 252, 5) AS ann_return, round(CASE WHEN stddev_pop(net) > 1e-13 THEN avg(net) * sqrt(252) / stddev_pop(net) ELSE 0 END, 5) AS sharpe,
  CASE WHEN stddev_pop(net) > 1e-13 THEN avg(net) * sqrt(252) / stddev_pop(net) ELSE 0 END > 0 AS passed FROM n GROUP BY ticker, multiple"""
)
def cost_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.cost_stress(strategy_returns(spark, sf_dir), ["ticker"])
    return rounded(out.select("ticker", "multiple", "periods", "ann_return", "sharpe", "passed"), 5)


def _sweep_sql(windows: tuple[int, ...]) -> str:
    rules = " UNION ALL ".join(f"SELECT {n} AS ma, ticker, date, r, CASE WHEN count(close) OVER {_W} ROWS {n - 1} PRECEDING) >= {n} AND close > avg(close) OVER {_W} ROWS {n - 1} PRECEDING) THEN 1.0 ELSE 0.0 END AS o FROM a" for n in windows)
    own = "(PARTITION BY ma, ticker ORDER BY date)"
    return f"""WITH {{BARS}}, c AS (SELECT ticker, date, pow(close, 0.1) AS close FROM bars), a AS (SELECT *, close / lag(close) OVER {_W}) - 1 AS r FROM c), o AS ({rules}),
h AS (SELECT *, coalesce(lag(o) OVER {own}, 0) AS held FROM o), m AS (SELECT *, abs(held - coalesce(lag(held) OVER {own}, 0)) AS moved FROM h), n AS (SELECT ma, date, avg(held * coalesce(r, 0) - 0.0005 * moved) AS ret, sum(moved) AS trades FROM m GROUP BY ma, date),
e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ma ORDER BY date ROWS UNBOUNDED PRECEDING)) AS eq FROM n), x AS (SELECT *, eq / max(eq) OVER (PARTITION BY ma ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)
SELECT ma, round(avg(ret) * 252, 5) AS ann_return, round(CASE WHEN stddev_pop(ret) * sqrt(252) > 1e-12 THEN avg(ret) * 252 / (stddev_pop(ret) * sqrt(252)) ELSE 0 END, 5) AS sharpe, round(min(dd), 5) AS max_drawdown, round(sum(trades), 5) AS trades FROM x GROUP BY ma"""


@query(_sweep_sql((5, 10, 20, 50, 100)))
def average_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.moving_average_sweep(brand_bars(spark, sf_dir).withColumn("close", F.pow("close", F.lit(0.1))), [5, 10, 20, 50, 100]), 5)


@query()
def bootstrap_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.bootstrap_drawdowns(strategy_returns(spark, sf_dir), ["ticker"]))


@query(
    """WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY l_shipdate::DATE) - 1 AS pos, l_shipdate::DATE AS date FROM (SELECT DISTINCT l_shipdate::DATE AS l_shipdate FROM lineitem)),
n AS (SELECT count(*) AS n FROM d), p AS (SELECT pos, least(pos + 5, n - 1) AS e FROM d, n),
f AS (SELECT i AS path, i * (n // 5) + least(i, n % 5) AS a, (i + 1) * (n // 5) + least(i + 1, n % 5) AS b, CAST(floor(n * 0.01) AS BIGINT) AS emb FROM n, (SELECT unnest(range(5)) AS i)),
g AS (SELECT f.*, least(b - 1 + 5, n - 1) AS last FROM f, n)
SELECT CAST(path AS INTEGER) AS path, role, count(*) AS n, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last FROM (
  SELECT path, pos, CASE WHEN pos >= a AND pos < b THEN 'test' WHEN NOT (pos <= last AND e >= a) AND NOT (pos >= b AND pos < b + emb) THEN 'train' END AS role FROM p, g) WHERE role IS NOT NULL GROUP BY ALL"""
)
def purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, n = _days(spark, sf_dir)
    return learning.purged_folds(days, n).groupBy("path", "role").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def _days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    dates = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("date")).distinct()
    days = learning.positioned(dates.withColumn("ticker", F.lit("")), 5)
    return days, dates.count()


@query(
    """WITH d AS (SELECT row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem)), n AS (SELECT count(*) AS n FROM d), p AS (SELECT pos, least(pos + 5, n - 1) AS e FROM d, n),
f AS (SELECT i, i * (n // 6) + least(i, n % 6) AS a, (i + 1) * (n // 6) + least(i + 1, n % 6) AS b FROM n, (SELECT unnest(range(6)) AS i)),
g AS (SELECT row_number() OVER (ORDER BY x.i, y.i) - 1 AS path, x.a AS a1, x.b AS b1, y.a AS a2, y.b AS b2, least(y.b - 1 + 5, n - 1) AS last, CAST(floor(n * 0.01) AS BIGINT) AS emb FROM f x JOIN f y ON x.i < y.i, n)
SELECT CAST(path AS INTEGER) AS path, role, count(*) AS n, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last FROM (
  SELECT path, pos, CASE WHEN (pos >= a1 AND pos < b1) OR (pos >= a2 AND pos < b2) THEN 'test' WHEN NOT (pos <= last AND e >= a1) AND NOT (pos >= b2 AND pos < b2 + emb) THEN 'train' END AS role FROM p, g) WHERE role IS NOT NULL GROUP BY ALL"""
)
def combinatorial_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, n = _days(spark, sf_dir)
    return learning.combinatorial_folds(days, n).groupBy("path", "role").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query(
    """WITH d AS (SELECT row_number() OVER (ORDER BY l_shipdate) - 1 AS pos FROM (SELECT DISTINCT l_shipdate::DATE AS l_shipdate FROM lineitem)), n AS (SELECT count(*) AS n FROM d),
f AS (SELECT i AS path, n - (4 - i) * 100 AS a FROM n, (SELECT unnest(range(4)) AS i))
SELECT CAST(path AS INTEGER) AS path, CASE WHEN pos < a - 5 THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM d, f WHERE pos < a - 5 OR (pos >= a AND pos < a + 100) GROUP BY ALL"""
)
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, n = _days(spark, sf_dir)
    return learning.walk_forward(days, n, 4, 100, 5).groupBy("path", "role").agg(F.count(F.lit(1)).alias("n"))


HORIZON = 5


def labelled(bars: DataFrame) -> tuple[DataFrame, list[str]]:
    """The feature matrix with the direction of the next bars as label, and its features; gaps are filled in by each fit, the newest bars have no label."""
    matrix = indicators.feature_matrix(bars, HORIZON, complete=False)
    return matrix.withColumnRenamed("target_direction", "label"), [c for c in indicators.feature_names(matrix) if c != "close"]


def scored_by(bars: DataFrame, recipe: forecasters.Recipe, spread: int) -> tuple[DataFrame, DataFrame]:
    """Probabilities of all folds and the newest bar by ticker, and the rows they are of."""
    rows, features = labelled(bars)
    rows = landed(rows, "labelled")
    return landed(forecasters.probabilities(rows, features, HORIZON, recipes=[recipe], spread=spread), "scored"), rows


def model_evidence(bars: DataFrame, recipe: forecasters.Recipe = forecasters.LOGISTIC, spread: int = 2) -> DataFrame:
    """Out-of-fold quality and newest probability of the direction model, per ticker."""
    return forecasters.evidence(*scored_by(bars, recipe, spread))


def honesty_evidence(bars: DataFrame) -> DataFrame:
    """What the honesty checks ask of each ticker's strategy."""
    r = landed(strategy_of(returns_of(bars)), "strategy")
    base = stats.annualised(r, ["ticker"]).select("ticker", "sharpe", (-100 * C("max_drawdown")).alias("mdd_pct"))
    stress = stats.cost_stress(r, ["ticker"]).groupBy("ticker").agg(F.bool_and("passed").alias("stress_passed"))
    years = r.groupBy("ticker", F.year("date").alias("y")).agg((F.avg("ret") / F.nullif(F.stddev_pop("ret"), F.lit(0.0))).alias("year_sharpe"))
    paths = stats.overfitting(years, ["ticker"], "year_sharpe").select("ticker", "pbo", "pass_rate")
    m = stats.moments(r, ["ticker"])
    dsr = m.select("ticker", stats.deflated_sharpe(C("sr"), 25, C("n_obs"), C("skew"), C("kurt")).alias("dsr"))
    trades = r.groupBy("ticker").agg(F.floor(F.sum("moved") / 2).alias("trades"), F.coalesce(F.avg(F.when(C("held") > 0, C("ret"))), F.lit(0.0)).alias("edge"), F.lit(0.0005).alias("cost"), F.lit(0.01).alias("embargo"))
    out = base
    for part in (stress, paths, dsr, trades):
        out = out.join(part, "ticker")
    return out


@query()
def out_of_fold_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purged-fold probabilities of one model of the pooled panel, on the whole feature matrix, and their quality per fold."""
    matrix = landed(indicators.feature_matrix(brand_bars(spark, sf_dir, "p_type")), "matrix")
    rows = matrix.withColumnRenamed("target_direction", "label")
    n = rows.select("date").distinct().count()
    parted = landed(learning.purged_folds(learning.positioned(rows, 5), n, 5), "folds")
    scored = learning.out_of_fold(parted, [c for c in indicators.feature_names(matrix) if c != "close"])
    return rounded(stats.average_rank_auc(scored, ["path"]), 4)


@query()
def model_by_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logistic model of each brand on all features: out-of-fold quality, and the newest probability from a final fit on all rows."""
    return rounded(model_evidence(brand_bars(spark, sf_dir)), 4)


@query()
def forest_by_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model_evidence(brand_bars(spark, sf_dir), forecasters.FOREST, 6), 4)


@query()
def boosted_by_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model_evidence(brand_bars(spark, sf_dir), forecasters.BOOSTED, 6), 4)


@query()
def chosen_features_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality per brand and fold of the contrarian model on the twenty best features of each fold."""
    scored, _ = scored_by(brand_bars(spark, sf_dir), forecasters.Recipe(top=20, contrarian=True), 1)
    return rounded(forecasters.fold_quality(scored).drop("recipe"), 4)


@query()
def feature_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty features of largest coefficient of each brand's model."""
    rows, features = labelled(brand_bars(spark, sf_dir))
    return rounded(forecasters.importances(rows, features), 4)


@query()
def parameter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and AUC, blended, of five penalties over all brands and folds."""
    rows, features = labelled(brand_bars(spark, sf_dir))
    grid = [0.1, 1.0, 10.0, 100.0, 1000.0]
    found = forecasters.search(rows, features, HORIZON, list(forecasters.penalties(grid)))
    return rounded(found.withColumn("penalty", F.element_at(F.array(*map(F.lit, grid)), C("recipe") + 1)), 5)


@query()
def regime_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily_returns(spark, sf_dir).filter("ret is not null")
    daily = r.groupBy("date").agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("spread")).dropna()
    return learning.regimes(daily, ["mean", "spread"]).groupBy("regime").agg(F.count(F.lit(1)).alias("days"))


@query(
    """WITH {BARS}, b AS (SELECT ticker, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS p, volume FROM bars),
d AS (SELECT ticker, greatest(coalesce(max(CASE WHEN p > 0 THEN (p - close) / p * 100 END), 0), 0) AS drop_pct, count(*) AS rows, max(volume) AS v FROM b GROUP BY ticker)
SELECT ticker, round(drop_pct, 5) AS drop_pct, CASE WHEN drop_pct < 10 THEN 'PASS' ELSE 'AMBER' END AS drop_status, CASE WHEN drop_pct < 10 THEN 'none' WHEN drop_pct < 20 THEN 'suspected_corp_action' ELSE 'unexplained_drop' END AS finding,
  rows, CASE WHEN rows < 30 OR v = 0 THEN 'RED' ELSE 'PASS' END AS schema_status FROM d"""
)
def data_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = brand_bars(spark, sf_dir)
    drop = gates.largest_drop(bars).withColumnRenamed("status", "drop_status")
    return rounded(drop.join(gates.completeness(bars).withColumnRenamed("status", "schema_status"), "ticker"), 5)


@query(
    """WITH {BARS}, s AS (SELECT ticker, date, close AS a, close * (1 + (day(date) % 5) / 100.0) AS b, CASE WHEN month(date) % 3 = 0 THEN 'KRX' WHEN month(date) % 3 = 1 THEN 'NYSE' ELSE 'LSE' END AS market, day(date) * 200 AS minutes FROM bars)
SELECT ticker, date, CASE WHEN abs(a - b) / ((a + b) / 2) * 100 <= 1 THEN 'PASS' WHEN abs(a - b) / ((a + b) / 2) * 100 <= 3 THEN 'AMBER' ELSE 'RED' END AS crosscheck,
  CASE WHEN market = 'KRX' AND minutes <= 1440 THEN 'PASS' WHEN market = 'KRX' AND minutes <= 4320 THEN 'AMBER' WHEN market = 'NYSE' AND minutes <= 1440 THEN 'PASS' WHEN market IN ('KRX', 'NYSE') THEN 'RED' ELSE 'AMBER' END AS freshness FROM s""",
    days="date",
)
def price_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, month = F.dayofmonth("date"), F.month("date")
    market = F.when(month % 3 == 0, "KRX").when(month % 3 == 1, "NYSE").otherwise("LSE")
    return brand_bars(spark, sf_dir).select("ticker", "date", gates.price_crosscheck(C("close"), C("close") * (1 + (day % 5) / 100.0)).alias("crosscheck"), gates.freshness(market, day * 200).alias("freshness"))


VOLATILITY_SQL = f"""b0 AS (SELECT ticker, date, coalesce(close / lag(close) OVER {_W}) - 1, 0) AS ret FROM bars),
m0 AS (SELECT *, abs(ret) AS a, CASE WHEN count(ret) OVER w >= 6 THEN median(ret) OVER w END AS m, CASE WHEN count(ret) OVER w >= 6 THEN stddev_pop(ret) OVER w END AS s FROM b0 WINDOW w AS {_W} ROWS 19 PRECEDING)),
d0 AS (SELECT *, abs(ret - m) AS d FROM m0), k0 AS (SELECT *, CASE WHEN count(d) OVER w >= 6 THEN 1.4826 * median(d) OVER w END AS mad FROM d0 WINDOW w AS {_W} ROWS 19 PRECEDING)),
z0 AS (SELECT *, abs(coalesce((ret - m) / CASE WHEN mad > 1e-12 THEN mad WHEN s > 1e-12 THEN s END, 0)) AS rz FROM k0), c0 AS (SELECT ticker, greatest(quantile_cont(abs(ret), 0.97), 0.02) AS cut FROM b0 GROUP BY ticker),
h0 AS (SELECT z0.* FROM z0 JOIN c0 USING (ticker) WHERE (rz >= 3 OR a >= cut) AND a >= 0.02), g0 AS (SELECT *, CASE WHEN date - lag(date) OVER {_W}) <= 2 THEN 0 ELSE 1 END AS opens FROM h0), r0 AS (SELECT *, sum(opens) OVER {_W}) AS run FROM g0),
v AS (SELECT *, 0.6 * least(vol_z_max / 5, 2) + 0.4 * least(peak_abs_ret / 0.05, 2) AS severity, CASE WHEN cum_return > 0 THEN 'UP' ELSE 'DOWN' END AS direction
  FROM (SELECT ticker, run, min(date) AS start, max(date) AS "end", count(*) AS days, exp(sum(ln(1 + ret))) - 1 AS cum_return, max(a) AS peak_abs_ret, max(rz) AS vol_z_max FROM r0 GROUP BY ticker, run))"""


@query(
    f"""WITH {{BARS}}, {VOLATILITY_SQL} SELECT ticker, start, "end", days, round(cum_return, 5) AS cum_return, round(peak_abs_ret, 5) AS peak_abs_ret, round(vol_z_max, 5) AS vol_z_max, direction, round(severity, 5) AS severity FROM v""",
    days='start "end"',
)
def volatility_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.volatility_windows(brand_bars(spark, sf_dir)), 5)


@query(
    f"""WITH RECURSIVE {{BARS}}, {_RET}, d AS (SELECT ticker, date, CASE WHEN abs(ret) > 0.5 THEN 'RED' WHEN abs(ret) > 0.2 THEN 'AMBER' ELSE 'GREEN' END AS raw, row_number() OVER {_W}) AS n FROM r),
k AS (SELECT *, CASE raw WHEN 'GREEN' THEN 0 WHEN 'RED' THEN 2 ELSE 1 END AS rk FROM d),
f AS (
  SELECT ticker, date, n, raw, raw AS regime, rk AS rrk, CAST(0 AS BIGINT) AS changed, CAST(1 AS BIGINT) AS run FROM k WHERE n = 1
  UNION ALL
  SELECT ticker, date, n, raw, CASE WHEN moves THEN raw ELSE regime END, CASE WHEN moves THEN rk ELSE rrk END, CASE WHEN moves THEN n - 1 ELSE changed END, run
  FROM (SELECT *, rk > rrk OR (raw <> regime AND n - 1 - changed >= 3 AND run >= 2) AS moves
    FROM (SELECT k.ticker, k.date, k.n, k.raw, k.rk, f.regime, f.rrk, f.changed, CASE WHEN k.raw = f.raw THEN f.run + 1 ELSE 1 END AS run FROM f JOIN k ON k.ticker = f.ticker AND k.n = f.n + 1)))
SELECT ticker, date, raw, regime FROM f""",
    days="date",
)
def stable_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regimes by the size of the daily move, with hysteresis, and the overlay's returns under a breaker."""
    r = daily_returns(spark, sf_dir)
    raw = F.when(F.abs("ret") > 0.5, "RED").when(F.abs("ret") > 0.2, "AMBER").otherwise("GREEN")
    return events.stable_regimes(r.select("ticker", "date", raw.alias("regime")))


@query(
    f"""WITH RECURSIVE {{BARS}}, c AS (SELECT ticker, date, pow(close, 0.1) AS close, row_number() OVER {_W}) AS n FROM bars), a AS (SELECT *, coalesce(close / lag(close) OVER {_W}) - 1, 0) AS ret FROM c),
v AS (SELECT *, CASE WHEN count(ret) OVER w >= 5 THEN stddev_pop(ret) OVER w END AS vol FROM a WINDOW w AS {_W} ROWS 19 PRECEDING)),
t AS (SELECT *, least(coalesce(least(0.15 / nullif(lag(vol) OVER {_W}) * sqrt(252), 0), 1.0), 1.0), 1.0) AS target FROM v), h AS (SELECT *, coalesce(lag(target) OVER {_W}), 1.0) AS held FROM t),
o AS (SELECT *, held * ret - abs(held - coalesce(lag(held) OVER {_W}), held)) * 5.0 / 1e4 AS net FROM h),
f AS (
  SELECT ticker, date, n, 1.0 * (1 + held * ret) AS eq, CAST(1 AS DOUBLE) AS peak, false AS cut, held AS held_cut FROM o WHERE n = 1
  UNION ALL
  SELECT ticker, date, n, eq * (1 + CASE WHEN cut THEN 0 ELSE held END * ret), peak, cut, CASE WHEN cut THEN 0 ELSE held END
  FROM (SELECT *, CASE WHEN was THEN eq / peak - 1 < -0.05 ELSE eq / peak - 1 <= -0.2 END AS cut
    FROM (SELECT o.ticker, o.date, o.n, o.held, o.ret, f.eq, greatest(f.peak, f.eq) AS peak, f.cut AS was FROM f JOIN o ON o.ticker = f.ticker AND o.n = f.n + 1)))
SELECT o.ticker, o.date, round(o.ret, 6) AS ret, round(o.held, 6) AS held, round(o.net, 6) AS net, round(f.held_cut, 6) AS held_cut FROM o JOIN f USING (ticker, date)""",
    days="date",
)
def overlay_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = brand_bars(spark, sf_dir).withColumn("close", F.pow("close", F.lit(0.1))).withColumn("weight", F.lit(1.0))
    daily = events.overlay(bars)
    cut = events.breaker(daily)
    return rounded(daily.select("ticker", "date", "ret", "held", "net").join(cut.select("ticker", "date", C("held").alias("held_cut")), ["ticker", "date"]), 6)
