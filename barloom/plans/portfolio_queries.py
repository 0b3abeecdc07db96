"""Queries over books: snapshot and verdicts, weights, sizing, paper portfolio, memory and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import allocation, gates, indicators, memory, paper, timejoins
from ..operators.panel import brand_bars
from ..sources.shared import landed, shared_path
from ..streaming import jobs
from .catalog import query, rounded
from .risk_queries import _RET, _W, daily_returns, honesty_evidence, model_evidence

C = F.col


def snapshot(bars: DataFrame) -> DataFrame:
    """The last bar of each ticker with its averages, ranges, returns and 0 to 100 regime score."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = indicators.smoothed(bars).withColumn("rows", F.row_number().over(w))
    rows = rows.withColumns({f"sma{n}": indicators.sma("close", n) for n in (20, 50)} | {"sma200": F.coalesce(indicators.sma("close", 200), indicators.sma("close", 50))})
    top = lambda n: F.max("high").over(w.rowsBetween(-(n - 1), 0))
    change = lambda n: F.coalesce(C("close") / F.lag("close", n).over(w) - 1, F.lit(0.0))
    rows = rows.withColumns(
        {
            "latest": C("close"), "high20": top(20), "atr_pct": C("atr_14") / C("close"), "avg_dollar_volume_20d": indicators.sma("dollar_volume", 20),
            "volume_ratio_20d": C("volume") / indicators.sma("volume", 20), "return_20d": change(20), "return_60d": change(60), "return_252d": change(252), "drawdown_252d": C("close") / top(252) - 1,
        }
    )
    on = lambda x, v: F.when(F.coalesce(x, F.lit(False)), v).otherwise(0.0)
    calm = F.when(C("atr_pct") <= 0.05, 10.0).when(C("atr_pct") <= 0.08, 5.0).otherwise(0.0)
    regime = on(C("close") > C("sma20"), 20.0) + on(C("close") > C("sma50"), 20.0) + on(C("close") > C("sma200"), 20.0) + on(C("sma20") > C("sma50"), 15.0) + on(C("sma50") > C("sma200"), 15.0) + calm
    last = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    return rows.withColumns({"market_regime_score": regime, "_back": last}).filter("_back = 1").drop("_back")


_SNAP_SQL = f"""WITH {{BARS}}, d AS (SELECT *, row_number() OVER {_W}) AS rows, close * volume AS dv, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars),
w AS (SELECT *, avg(close) OVER {_W} ROWS 19 PRECEDING) AS s20, avg(close) OVER {_W} ROWS 49 PRECEDING) AS s50, avg(close) OVER {_W} ROWS 199 PRECEDING) AS s200r,
  max(high) OVER {_W} ROWS 19 PRECEDING) AS high20, max(high) OVER {_W} ROWS 251 PRECEDING) AS high252, avg(dv) OVER {_W} ROWS 19 PRECEDING) AS adv, avg(volume) OVER {_W} ROWS 19 PRECEDING) AS av,
  coalesce(close / lag(close, 20) OVER {_W}) - 1, 0) AS r20, coalesce(close / lag(close, 252) OVER {_W}) - 1, 0) AS r252 FROM d),
l AS (SELECT *, CASE WHEN rows >= 200 THEN s200r ELSE s50 END AS s200 FROM w WHERE back = 1)
SELECT ticker, rows, round(close, 9) AS latest, round(s20, 3) AS sma20, round(s50, 3) AS sma50, round(s200, 3) AS sma200, round(high20, 9) AS high20, round(adv, 1) AS avg_dollar_volume_20d,
  round(volume / av, 6) AS volume_ratio_20d, round(r20, 6) AS return_20d, round(r252, 6) AS return_252d, round(close / high252 - 1, 6) AS drawdown_252d FROM l"""


@query(_SNAP_SQL)
def market_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["latest", "sma20", "sma50", "sma200", "high20", "avg_dollar_volume_20d", "volume_ratio_20d", "return_20d", "return_252d", "drawdown_252d"]
    return rounded(snapshot(brand_bars(spark, sf_dir)).select("ticker", "rows", *names), {"latest": 9, "sma20": 3, "sma50": 3, "sma200": 3, "high20": 9, "avg_dollar_volume_20d": 1})


@query()
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: bars, snapshot, model, honesty, risk plan, score, checks, verdict, gates and the ranked list, for both tracks."""
    bars = landed(brand_bars(spark, sf_dir), "bars")
    joined = snapshot(bars).join(model_evidence(bars), "ticker", "left").join(honesty_evidence(bars), "ticker")
    joined = joined.fillna({"prob": 0.5, "accuracy": 0.0, "auc": 0.5, "oof_coverage": 0.0})  # too few bars for a model
    joined = landed(joined.withColumn("honesty", gates.honesty(gates.honesty_checks())), "candidates")
    parts = []
    for t, score in ((gates.SHORT, gates.score_short), (gates.LONG, gates.score_long)):
        rows = joined.withColumns(gates.risk_plan(C("latest"), C("atr_pct"), t))
        rows = rows.withColumn("score", score(t)).withColumn("checks", gates.validation_checks(t))
        rows = rows.withColumn("verdict", gates.verdict(C("score"), C("checks"), t)).withColumn("gate", gates.readiness_gate(C("verdict"), C("honesty"), C("accuracy"), C("auc"), C("trades")))
        ev = 100 * (C("prob") * C("tp2_pct") - (1 - C("prob")) * C("stop_pct"))
        passed = F.size(F.filter("checks", lambda c: c["status"] == "PASS"))
        parts.append(rows.select("ticker", F.lit(t.name).alias("track"), F.round("score", 4).alias("score"), C("gate.verdict").alias("verdict"), F.round(ev, 4).alias("ev_pct"), passed.alias("passed"), F.round("stop", 4).alias("stop"), F.round("tp2", 4).alias("tp2"), "honesty"))
    return gates.ranked(parts[0].unionByName(parts[1]), 20)


_PAIRS = f"{_RET}, k AS (SELECT ticker, date, ret FROM r WHERE ret IS NOT NULL)"


@query(
    f"WITH {{BARS}}, {_PAIRS}, c AS (SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) AS cov, corr(x.ret, y.ret) AS corr, count(*) AS days FROM k x JOIN k y USING (date) GROUP BY ALL) SELECT a, b, round(cov, 4) AS cov, round(CASE WHEN days > 2 THEN corr END, 5) AS corr, days FROM c"
)
def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tickers; a pair is measured on the days that both have, as days of all tickers are few."""
    out = allocation.covariance(daily_returns(spark, sf_dir), complete=False)
    return rounded(out.withColumn("corr", F.when(C("days") > 2, C("corr"))), {"cov": 4, "corr": 5})


@query(
    f"WITH {{BARS}}, {_PAIRS}, c AS (SELECT x.ticker AS a, y.ticker AS b, coalesce(covar_samp(x.ret, y.ret), 0) AS cov FROM k x JOIN k y USING (date) GROUP BY ALL), s AS (SELECT a, b, CASE WHEN a = b THEN cov ELSE 0.7 * cov END AS cov FROM c), v AS (SELECT a AS k, sqrt(cov) AS s FROM s WHERE a = b), "
    "e AS (SELECT s.a, s.b, CASE WHEN s.a = s.b THEN 1.0 ELSE least(greatest(cov / (x.s * y.s), -0.999), 0.999) END AS corr FROM s JOIN v x ON x.k = s.a JOIN v y ON y.k = s.b) SELECT a, b, round(corr, 5) AS corr, round(sqrt(greatest((1 - corr) / 2, 0)), 5) AS distance FROM e"
)
def correlation_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(allocation.correlation_distance(allocation.shrunk(allocation.covariance(daily_returns(spark, sf_dir), complete=False))), 5)


@query(f"WITH {{BARS}}, {_RET}, v AS (SELECT ticker, var_samp(ret) AS v FROM r GROUP BY ticker) SELECT ticker, round((1 / v) / sum(1 / v) OVER (), 6) AS weight FROM v")
def inverse_variance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(allocation.inverse_variance(daily_returns(spark, sf_dir)))


@query(
    f"WITH {{BARS}}, {_RET}, z AS (SELECT ticker, quantile_cont(ret, 0.05) AS cut FROM r WHERE ret IS NOT NULL GROUP BY ticker), t AS (SELECT r.ticker, -avg(ret) AS cvar FROM r JOIN z ON z.ticker = r.ticker WHERE ret <= cut GROUP BY r.ticker) SELECT ticker, round(cvar, 6) AS cvar, round((1 / cvar) / sum(1 / cvar) OVER (), 6) AS weight FROM t"
)
def inverse_cvar_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(allocation.inverse_cvar(daily_returns(spark, sf_dir).filter("ret is not null")))


def _weights(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """Share of each brand in the volume of all days, weighed by an expression of the day."""
    bars = brand_bars(spark, sf_dir)
    shares = bars.groupBy("ticker").agg(F.sum(C("volume") * F.expr(by)).alias("v"))
    return shares.crossJoin(shares.agg(F.sum("v").alias("total"))).select("ticker", (C("v") / C("total")).alias("weight"))


_TARGET, _CURRENT = "dayofmonth(date)", "(32 - dayofmonth(date))"
_TWO = "t AS (SELECT ticker, sum(volume * day(date)) / sum(sum(volume * day(date))) OVER () AS w FROM bars GROUP BY ticker), c AS (SELECT ticker, sum(volume * (32 - day(date))) / sum(sum(volume * (32 - day(date)))) OVER () AS w FROM bars GROUP BY ticker), b AS (SELECT coalesce(t.ticker, c.ticker) AS ticker, coalesce(t.w, 0) AS target, coalesce(c.w, 0) AS current FROM t FULL JOIN c ON t.ticker = c.ticker)"


@query(f"WITH {{BARS}}, {_TWO} SELECT round(sum(abs(target - current)), 6) AS turnover, round(sum(abs(target - current)) * 5 / 10000, 8) AS cost FROM b")
def turnover_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(allocation.turnover(_weights(spark, sf_dir, _TARGET), _weights(spark, sf_dir, _CURRENT)), {"cost": 8})


@query(
    f"WITH {{BARS}}, {_TWO} SELECT ticker, round(current + CASE WHEN sum(abs(target - current)) OVER () > 0.05 THEN 0.05 / sum(abs(target - current)) OVER () ELSE 1 END * (target - current), 6) AS weight FROM b"
)
def capped_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(allocation.capped_turnover(_weights(spark, sf_dir, _TARGET), _weights(spark, sf_dir, _CURRENT), 0.05))


@query(
    f"""WITH {{BARS}}, {_TWO}, d AS (SELECT ticker, target * 1000000 AS tv, current * 1000000 AS cv, target * 1000000 - current * 1000000 AS delta FROM b)
SELECT ticker, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, round(abs(delta) / CASE WHEN tv > 0 THEN 10.0 ELSE 1.0 END, 3) AS quantity, round(tv, 2) AS target_value, round(delta, 2) AS delta FROM d WHERE abs(delta) >= 100"""
)
def rebalance_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _weights(spark, sf_dir, _TARGET).select("ticker", C("weight").alias("target_weight"), F.lit(10.0).alias("price"))
    held = _weights(spark, sf_dir, _CURRENT).select("ticker", (C("weight") * 1e6).alias("value"))
    return rounded(allocation.orders(target, held, 1e6), {"quantity": 3, "target_value": 2, "delta": 2})


def _capped_sql(cap: float, rounds: int = 20) -> str:
    """The excess over the cap goes to the others by room, round after round."""
    total = "sum({0}) OVER (PARTITION BY date)"
    steps = [f"w0 AS (SELECT date, ticker, volume / {total.format('volume')} AS w FROM bars)"]
    for i in range(rounds):
        excess, room = (total.format(f"greatest({x}, 0)") for x in (f"w - {cap}", f"{cap} - w"))
        moved = f"CASE WHEN w > {cap} THEN {cap} ELSE w + CASE WHEN {room} > 1e-12 THEN {excess} * ({cap} - w) / {room} ELSE 0 END END"
        steps.append(f"w{i + 1} AS MATERIALIZED (SELECT date, ticker, CASE WHEN {excess} > 1e-12 THEN {moved} ELSE w END AS w FROM w{i})")
    return f"WITH {{BARS}}, {', '.join(steps)} SELECT date, ticker, round(w, 9) AS weight FROM w{rounds}"


@query(_capped_sql(0.3), days="date")
def capped_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume shares per day, none above 30 percent."""
    bars = brand_bars(spark, sf_dir).select("date", "ticker", C("volume").alias("weight"))
    return rounded(allocation.capped(bars, 0.3, ["date"]), 9)


@query(
    f"""WITH {{BARS}}, {_RET}, s AS (SELECT date, ticker, -ret AS score, ret < -0.1 AS trade FROM r WHERE ret IS NOT NULL), u AS (SELECT *, CASE WHEN trade THEN greatest(score, 0) ELSE 0 END AS used FROM s),
h AS (SELECT date, ticker, least(coalesce(used / nullif(sum(abs(used)) OVER (PARTITION BY date), 0), 0), 0.25) AS weight FROM u)
SELECT date, ticker, round(weight, 6) AS weight FROM h UNION ALL SELECT date, '__CASH__', round(1 - sum(abs(weight)), 6) FROM h GROUP BY date""",
    days="date",
)
def signal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily_returns(spark, sf_dir).filter("ret is not null")
    return rounded(allocation.signal_weights(r.select("date", "ticker", (-C("ret")).alias("score"), (C("ret") < -0.1).alias("trade"))))


#: Linear quantile of the values ``a`` at the level that a finite sample needs.
_LEVEL = "list_transform([list_sort(list(a))], lambda v: list_transform([least(1.0, ceil((len(v) + 1) * 0.9) / len(v)) * (len(v) - 1)], lambda p: v[CAST(floor(p) AS BIGINT) + 1] + (p - floor(p)) * (v[CAST(ceil(p) AS BIGINT) + 1] - v[CAST(floor(p) AS BIGINT) + 1]))[1])[1]"


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily_returns(spark, sf_dir).filter("ret is not null")
    return r.select(F.when(F.month("date") == 2, "CRISIS").when(F.month("date") < 7, "CALM").otherwise("TREND").alias("regime"), (F.year("date") % 2).alias("horizon"), C("ret").alias("residual"))


@query(
    f"""WITH {{BARS}}, {_RET}, x AS (SELECT CASE WHEN month(date) = 2 THEN 'CRISIS' WHEN month(date) < 7 THEN 'CALM' ELSE 'TREND' END AS regime, CAST(year(date) % 2 AS INTEGER) AS horizon, abs(ret) AS a FROM r WHERE ret IS NOT NULL),
g AS (SELECT regime, horizon, list_sort(list(a)) AS v, count(*) AS n FROM x GROUP BY ALL), l AS (SELECT *, least(1.0, ceil((n + 1) * 0.9) / n) * (n - 1) AS p FROM g)
SELECT regime, horizon, n, round(v[CAST(floor(p) AS BIGINT) + 1] + (p - floor(p)) * (v[CAST(ceil(p) AS BIGINT) + 1] - v[CAST(floor(p) AS BIGINT) + 1]), 5) AS q, n < 30 AS fallback FROM l"""
)
def conformal_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(allocation.conformal_quantiles(_residuals(spark, sf_dir)), 5)


@query(
    f"""WITH {{BARS}}, {_RET}, x AS (SELECT CASE WHEN month(date) = 2 THEN 'CRISIS' WHEN month(date) < 7 THEN 'CALM' ELSE 'TREND' END AS regime, CAST(year(date) % 2 AS INTEGER) AS horizon, abs(ret) AS a FROM r WHERE ret IS NOT NULL),
l AS (SELECT regime, horizon, count(*) AS n, quantile_cont(a, least(1.0, ceil((count(*) + 1) * 0.9) / count(*))) AS q FROM x GROUP BY ALL), e AS (SELECT horizon, quantile_cont(a, least(1.0, ceil((count(*) + 1) * 0.9) / count(*))) AS q FROM x GROUP BY ALL),
u AS (SELECT l.regime, l.horizon, CASE WHEN l.n >= 30 THEN l.q ELSE e.q END AS q FROM l JOIN e USING (horizon))
SELECT regime, horizon, count(*) AS n, round(avg(CAST(a <= q AS DOUBLE)), 6) AS covered, avg(CAST(a <= q AS DOUBLE)) >= 0.85 AS honest FROM x JOIN u USING (regime, horizon) GROUP BY regime, horizon""".replace(
        "quantile_cont(a, least(1.0, ceil((count(*) + 1) * 0.9) / count(*)))", _LEVEL
    )
)
def conformal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _residuals(spark, sf_dir)
    return rounded(allocation.coverage(res, allocation.conformal_quantiles(res)), 6)


@query(
    f"""WITH {{BARS}}, {_RET}, p AS (SELECT ticker, date, -0.1 * ret AS e, lead(close) OVER {_W}) / close - 1 AS f, ret FROM r), k AS (SELECT * FROM p WHERE ret IS NOT NULL),
h AS (SELECT *, list_sort(list(e - f) FILTER (f IS NOT NULL) OVER {_W} ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)) AS past FROM k),
z AS (SELECT *, CASE WHEN len(past) >= 20 THEN past[CAST(ceil(0.8 * (len(past) - 1)) AS BIGINT) + 1] END AS z FROM h)
SELECT ticker, date, round(e - z, 5) AS lower, coalesce(e - z > 0, false) AS trade FROM z""",
    days="date",
)
def conformal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily_returns(spark, sf_dir)
    w = Window.partitionBy("ticker").orderBy("date")
    panel = r.select("ticker", "date", (-0.1 * C("ret")).alias("edge_hat"), (F.lead("close").over(w) / C("close") - 1).alias("fwd_return")).filter("edge_hat is not null")
    return rounded(allocation.conformal_gate(panel).select("ticker", "date", "lower", "trade"), 5)


@query(
    f"""WITH {{BARS}}, {_RET}, m AS (SELECT date, avg(ret) AS m FROM r WHERE ret IS NOT NULL GROUP BY date), b AS (SELECT r.ticker, CASE WHEN count(m) >= 30 THEN covar_samp(ret, m) / nullif(var_samp(m), 0) END AS beta FROM r JOIN m USING (date) WHERE ret IS NOT NULL GROUP BY r.ticker),
t AS (SELECT ticker, sum(volume * day(date)) / sum(sum(volume * day(date))) OVER () AS w FROM bars GROUP BY ticker)
SELECT ticker, round(w, 6) AS weight FROM t UNION ALL SELECT 'HEDGE', round(least(greatest(-sum(w * coalesce(beta, 1)), -1), 1), 5) FROM t LEFT JOIN b USING (ticker)"""
)
def beta_hedge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily_returns(spark, sf_dir).filter("ret is not null").select("ticker", "date", "ret")
    market = r.groupBy("date").agg(F.avg("ret").alias("ret"))
    out = allocation.beta_hedge(_weights(spark, sf_dir, _TARGET), r, market, "HEDGE")
    return out.select("ticker", F.when(C("ticker") == "HEDGE", F.round("weight", 5)).otherwise(F.round("weight", 6)).alias("weight"))


@query(
    """WITH u AS (SELECT user_id, event_type, sum(value) AS q, sum(CASE WHEN event_id % 50 = 0 THEN 0 ELSE value END) AS p FROM events GROUP BY ALL),
j AS (SELECT user_id || ':' || event_type AS ticker, q AS ours, p AS theirs FROM u)
SELECT ticker, round(ours, 4) AS ours, round(theirs, 4) AS theirs, round(theirs - ours, 4) AS difference, abs(theirs - ours) > 0.05 * greatest(abs(ours), abs(theirs)) AS is_large FROM j WHERE abs(theirs - ours) > 1e-6"""
)
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in both books; the broker's has some of no quantity."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ticker", F.concat_ws(":", "user_id", "event_type"))
    book = e.groupBy("ticker").agg(F.sum("value").alias("quantity"))
    broker = e.groupBy("ticker").agg(F.sum(F.when(C("event_id") % 50 == 0, 0.0).otherwise(C("value"))).alias("quantity"))
    return rounded(timejoins.reconcile(book, broker, tolerance=1e-6), 4)


_TRUST = {"click": 0.5, "error": 0.1, "purchase": 2.0}


@query(
    """WITH o AS (SELECT user_id AS ticker, event_type AS advisor, tanh(value / 50 - 0.5) AS score, (event_id % 10) / 10.0 AS confidence FROM events),
w AS (SELECT *, confidence * CASE advisor WHEN 'click' THEN 0.5 WHEN 'error' THEN 0.1 WHEN 'purchase' THEN 2.0 ELSE 1.0 END AS w FROM o)
SELECT ticker, round(least(greatest(coalesce(sum(score * w) / nullif(sum(w), 0), 0), -1), 1), 6) AS score, count(*) AS advisors FROM w GROUP BY ticker"""
)
def advisor_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    o = e.select(C("user_id").alias("ticker"), C("event_type").alias("advisor"), F.tanh(C("value") / 50 - 0.5).alias("score"), ((C("event_id") % 10) / 10.0).alias("confidence"))
    return rounded(allocation.advisor_blend(o, _TRUST))


@query(
    """WITH p AS (SELECT event_type AS advisor, count(*) FILTER (value > 50) + 1.0 AS a, count(*) FILTER (value <= 50) + 1.0 AS b FROM events GROUP BY event_type)
SELECT advisor, a, b, round(a / (a + b), 6) AS mean, round(a / (a + b) / sum(a / (a + b)) OVER (), 6) AS weight FROM p"""
)
def advisor_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(C("event_type").alias("advisor"), (C("value") / 100).alias("reward"))
    return rounded(allocation.posterior_weights(e))


@query("SELECT user_id AS run_id, count(*) AS signals, count(DISTINCT event_type) AS kinds, max(event_id) AS newest FROM events GROUP BY user_id")
def paper_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals of each paper run."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(C("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("signals"), F.count_distinct("event_type").alias("kinds"), F.max("event_id").alias("newest"))


@query(
    """WITH RECURSIVE s AS (SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS nth, event_type || '-' || (event_id % 4) AS ticker, (value + 1) * 1.001 AS fill FROM events),
f AS (
  SELECT run_id, 0 AS nth, CAST('' AS VARCHAR) AS ticker, CAST(0 AS BIGINT) AS quantity, CAST(0 AS DOUBLE) AS fill, CAST('' AS VARCHAR) AS reason, CAST(10000 AS DOUBLE) AS cash, CAST([] AS VARCHAR[]) AS held FROM (SELECT DISTINCT run_id FROM s)
  UNION ALL
  SELECT run_id, nth, ticker, CASE WHEN reason = 'FILLED' THEN q ELSE 0 END, fill, reason, cash - CASE WHEN reason = 'FILLED' THEN q * fill ELSE 0 END, CASE WHEN reason = 'FILLED' THEN list_append(held, ticker) ELSE held END
  FROM (SELECT *, CASE WHEN list_contains(held, ticker) THEN 'DUPLICATE' WHEN len(held) >= 10 THEN 'BOOK_FULL' WHEN len(held) >= 3 THEN 'NEW_LIMIT' WHEN q < 1 THEN 'NO_CASH' ELSE 'FILLED' END AS reason
    FROM (SELECT s.run_id, s.nth, s.ticker, s.fill, f.cash, f.held, CAST(greatest(floor(least(1000.0, f.cash - 500.0) / s.fill), 0) AS BIGINT) AS q FROM f JOIN s ON s.run_id = f.run_id AND s.nth = f.nth + 1)))
SELECT run_id, nth, ticker, quantity, round(fill, 7) AS fill, reason FROM f WHERE nth > 0"""
)
def paper_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every run folded in signal order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    signals = e.select(C("user_id").alias("run_id"), "nth", F.concat_ws("-", "event_type", (C("event_id") % 4)).alias("ticker"), (C("value") + 1).alias("price"))
    return rounded(paper.sized_orders(signals, 10_000.0), 7)


@query(
    f"""WITH {{BARS}}, m AS (SELECT date, avg(close) AS bc FROM bars GROUP BY date), b AS (SELECT ticker AS symbol, date, close, bc FROM bars JOIN m USING (date)),
l AS (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1, 0) AS own, coalesce(bc / lag(bc) OVER (PARTITION BY symbol ORDER BY date) - 1, 0) AS ben FROM b)
SELECT symbol, date, round(100 * (own - ben), 5) AS daily_alpha_pct, round(exp(sum(ln(1 + own)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)), 5) AS equity FROM l""",
    days="date",
)
def forward_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = brand_bars(spark, sf_dir)
    log = bars.join(bars.groupBy("date").agg(F.avg("close").alias("benchmark_close")), "date").withColumnRenamed("ticker", "symbol")
    return rounded(paper.forward_alpha(log).select("symbol", "date", "daily_alpha_pct", "equity"), 5)


@query(
    f"""WITH {{BARS}}, {_RET}, t AS (SELECT ticker, date, ret AS pnl FROM r WHERE ret IS NOT NULL),
w AS (SELECT *, count(*) FILTER (pnl > 0) OVER f AS wins, count(pnl) OVER f AS n, avg(pnl) FILTER (pnl > 0) OVER f AS g, -avg(pnl) FILTER (pnl <= 0) OVER f AS l FROM t WINDOW f AS {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ticker, date, round(CASE WHEN n < 8 THEN 0.1 ELSE least(greatest(coalesce((wins + 2.0) / (n + 4) - (1 - (wins + 2.0) / (n + 4)) * l / nullif(g, 0), 0), 0), 0.25) END, 6) AS fraction FROM w""",
    days="date",
)
def kelly_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = daily_returns(spark, sf_dir).filter("ret is not null").select("ticker", "date", C("ret").alias("pnl"))
    return rounded(paper.kelly(trades).select("ticker", "date", "fraction"))


@query(
    f"""WITH {{BARS}}, e AS (SELECT ticker, date, close / first_value(close) OVER (PARTITION BY ticker, date_trunc('month', date) ORDER BY date) - 1 AS m FROM bars)
SELECT ticker, date, round(m, 6) AS month_return, m <= -0.05 AS stopped FROM e""",
    days="date",
)
def monthly_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paper.monthly_stop(brand_bars(spark, sf_dir).select("ticker", "date", C("close").alias("equity")))
    return rounded(out.select("ticker", "date", "month_return", "stopped"))


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id) AS nth FROM events) SELECT event_id, event_type, user_id, nth FROM n WHERE nth <= 3"""
)
def newest_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.newest(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type", "user_id"], 3, [F.desc("ts"), "event_id"]).select("event_id", "event_type", "user_id", C("nth").cast("long").alias("nth"))


@query(
    """WITH o AS (SELECT user_id, event_type, max(value) AS value, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL), u AS (SELECT user_id, event_type, max(CASE WHEN user_id % 3 <> 0 THEN value END) AS value, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY user_id, event_type)
SELECT coalesce(o.user_id, u.user_id) AS user_id, coalesce(o.event_type, u.event_type) AS event_type, coalesce(u.value, o.value) AS value, coalesce(u.n, o.n) AS n FROM o FULL JOIN u ON o.user_id = u.user_id AND o.event_type = u.event_type"""
)
def memory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    side = lambda odd: e.filter(f"event_id % 2 = {odd}").groupBy("user_id", "event_type").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))
    new = side(1).withColumn("value", F.when(C("user_id") % 3 != 0, C("value")))
    return memory.upsert(side(0), new, ["user_id", "event_type"], keep=["value"])


@query(
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id) AS nth FROM events), p AS (SELECT * FROM k WHERE nth <= 2),
j AS (SELECT t.user_id, t.event_type, p.event_id AS other_session, p.user_id AS other, row_number() OVER (PARTITION BY t.user_id, t.event_type ORDER BY p.ts DESC, p.event_id) AS nth FROM (SELECT DISTINCT user_id, event_type FROM events) t JOIN p ON p.event_type = t.event_type AND p.user_id <> t.user_id)
SELECT user_id, event_type, other, other_session, nth FROM j WHERE nth <= 2"""
)
def cross_asset_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(C("user_id").alias("ticker"), C("event_type").alias("regime"), C("event_id").alias("session_id"), "ts")
    return timejoins.cross_asset(e, 2).select(C("ticker").alias("user_id"), C("regime").alias("event_type"), "other", C("other_session"), C("nth").cast("long").alias("nth"))


@query(
    """WITH s AS (SELECT user_id, event_type, status FROM (SELECT user_id, event_type, CASE WHEN round(avg(value), 9) > 60 THEN 'RED' WHEN round(avg(value), 9) > 45 THEN 'AMBER' ELSE 'PASS' END AS status FROM events GROUP BY ALL))
SELECT user_id, CASE WHEN bool_or(status = 'RED') THEN 'BLOCKED' WHEN bool_and(status = 'PASS') THEN 'APPROVED' WHEN bool_or(status = 'AMBER' AND user_id % 2 = 0) THEN 'PENDING_REVIEW' ELSE 'APPROVED_WITH_AMBER' END AS approval,
  count(*) FILTER (status = 'PASS') AS passed, count(*) AS gates FROM s GROUP BY user_id"""
)
def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates by mean values, which count to nine places: beyond them the order of summation decides."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 9).alias("v"))
    s = e.select("user_id", F.when(C("v") > 60, "RED").when(C("v") > 45, "AMBER").otherwise("PASS").alias("status"), (C("user_id") % 2 != 0).alias("cleared"))
    return gates.approval(s, ["user_id"])


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'yfinance' WHEN 'error' THEN 'KIS' ELSE 'other' END AS provider, CASE event_type WHEN 'click' THEN 0.85 WHEN 'error' THEN 0.88 ELSE 0.70 END AS trust,
  CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 99 END AS priority FROM events"""
)
def source_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    provider = F.when(C("event_type") == "click", "yfinance").when(C("event_type") == "error", "KIS").otherwise("other")
    source = F.when(C("event_id") % 4 == 0, "krx final").when(C("event_id") % 4 == 1, "pykrx-cache").when(C("event_id") % 4 == 2, "Public Web").otherwise("rumour")
    return e.select("event_id", provider.alias("provider"), gates.provider_trust(provider).alias("trust"), gates.source_priority(source).alias("priority"))


@query(
    """SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, round(first(value ORDER BY ts), 4) AS open, max(value) AS high, min(value) AS low, round(last(value ORDER BY ts), 4) AS close, count(*) AS volume FROM events GROUP BY ALL"""
)
def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from the event stream under a watermark, run to the end of the files there are."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    ticks = spark.readStream.schema(schema).format("parquet").load(f"{sf_dir}/events.parquet*")
    bars = jobs.tick_bars(ticks.select(C("event_type").alias("ticker"), C("ts").cast("timestamp").alias("ts"), C("value").alias("price"), F.lit(1).alias("size")))
    out = shared_path(spark, "stream")

    def land(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/bars/batch={n}")

    run = bars.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(land).start()
    run.awaitTermination()
    landed = spark.read.parquet(f"{out}/bars")
    last = landed.agg(F.max("batch").alias("batch"))
    rows = landed.join(F.broadcast(last), "batch", "left_semi").select("ticker", "ts", "open", "high", "low", "close", C("volume").cast("long").alias("volume"))
    return rounded(rows, 4)

