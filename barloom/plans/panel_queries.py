"""Queries over bars: panel, windows, features, factors, lake and corporate actions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import bounded, change, ratio
from ..operators import factors, indicators, timejoins
from ..operators.indicators import lag, rolling_max, rolling_min, rolling_std, rolling_sum, sma
from ..operators.panel import as_of, brand_bars, by_ticker, normalise
from ..operators.sliding import in_order, slide
from ..operators.smoothing import Smoothing, ema, scanned, span, wilder
from ..sources.lake import Lake, best_source, chart_records, read_universe, universe_changes, write_universe
from ..sources.shared import shared_path
from . import feature_sql
from .catalog import BARS_SQL, query, rounded

C = F.col
_W = "(PARTITION BY ticker ORDER BY date"


def _over(n: int) -> str:
    return f"OVER {_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_over(n)} >= {n} THEN {agg} {_over(n)} END"


@query("WITH {BARS} SELECT ticker, date, open, high, low, close, volume FROM bars", days="date")
def panel_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(brand_bars(spark, sf_dir))


@query(
    f"""WITH {{BARS}},
m AS (SELECT *, (high + low + close) / 3 AS typical FROM bars),
w AS (SELECT *, {_full("avg(close)", "close", 20)} AS mid, {_full("stddev_samp(close)", "close", 20)} AS dev,
  {_full("max(high)", "high", 14)} AS hi14, {_full("min(low)", "low", 14)} AS lo14,
  {_full("avg(typical)", "typical", 20)} AS tp20, {_full("avg(volume)", "volume", 20)} AS v20 FROM m),
k AS (SELECT *, 100 * (close - lo14) / nullif(hi14 - lo14, 0) AS kraw, list(typical) {_over(20)} AS tl FROM w)
SELECT ticker, date, round(mid, 4) AS sma_20, round((close - (mid - 2 * dev)) / nullif(4 * dev, 0), 6) AS bb_pct, round(4 * dev / nullif(mid, 0), 6) AS bb_width,
  round(CASE WHEN kraw IS NOT NULL THEN least(greatest(kraw, 0), 100) END, 6) AS stoch_k, round(CASE WHEN count(kraw) {_over(3)} >= 3 THEN least(greatest(avg(kraw) {_over(3)}, 0), 100) END, 6) AS stoch_d,
  round(CASE WHEN hi14 - lo14 <> 0 THEN least(greatest(-100 * (hi14 - close) / (hi14 - lo14), -100), 0) END, 6) AS williams_r,
  round((typical - tp20) / nullif(0.015 * list_sum(list_transform(tl, lambda x: abs(x - tp20))) / 20, 0), 4) AS cci_20,
  round(volume / nullif(v20, 0), 6) AS volume_ratio
FROM k""",
    days="date",
)
def window_oscillators(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = indicators.steps(brand_bars(spark, sf_dir)).withColumn("stoch_raw", indicators.stochastic_k())
    band = indicators.bollinger()
    out = bars.select(
        "ticker", "date", band["bb_mid"].alias("sma_20"), band["bb_pct"].alias("bb_pct"), band["bb_width"].alias("bb_width"),
        bounded(C("stoch_raw"), 0.0, 100.0).alias("stoch_k"), bounded(sma("stoch_raw", 3), 0.0, 100.0).alias("stoch_d"),
        indicators.williams_r().alias("williams_r"), indicators.cci().alias("cci_20"), ratio(C("volume"), sma("volume", 20)).alias("volume_ratio"),
    )
    return rounded(out, {"sma_20": 4, "cci_20": 4})


@query(
    f"""WITH {{BARS}},
p AS (SELECT *, lag(close) OVER {_W}) AS pc, lag(high) OVER {_W}) AS ph, lag(low) OVER {_W}) AS pl, (high + low + close) / 3 AS tp FROM bars),
t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, lag(tp) OVER {_W}) AS ptp,
  ((close - low) - (high - close)) / nullif(high - low, 0) * volume AS mfv FROM p),
f AS (SELECT *, CASE WHEN tp > ptp THEN tp * volume ELSE 0 END AS up, CASE WHEN tp < ptp THEN tp * volume ELSE 0 END AS dn FROM t),
s AS (SELECT *, {_full("sum(tr)", "tr", 14)} AS trs, {_full("sum(abs(high - pl))", "high - pl", 14)} AS vp, {_full("sum(abs(low - ph))", "low - ph", 14)} AS vm,
  {_full("sum(up)", "up", 14)} AS u, {_full("sum(dn)", "dn", 14)} AS d, {_full("sum(mfv)", "mfv", 20)} AS mf, {_full("sum(volume)", "volume", 20)} AS vs,
  {_full("avg(close)", "close", 20)} AS m20 FROM f)
SELECT ticker, date, round(tr, 9) AS true_range, round(vp / nullif(trs, 0), 6) AS vi_plus, round(vm / nullif(trs, 0), 6) AS vi_minus,
  round(100 - 100 / (1 + u / nullif(d, 0)), 6) AS mfi_14, round(CASE WHEN mf / nullif(vs, 0) IS NOT NULL THEN least(greatest(mf / nullif(vs, 0), -1), 1) END, 6) AS cmf_20,
  round((close - lag(m20, 11) OVER {_W})) / close, 6) AS dpo_20
FROM s""",
    days="date",
)
def window_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, down = indicators.mfi()
    bars = indicators.steps(brand_bars(spark, sf_dir)).withColumns({"up": up, "down": down, "sma_20": sma("close", 20)})
    plus, minus = indicators.vortex()
    mfi = 100 - 100 / (1 + ratio(rolling_sum(C("up"), 14), rolling_sum(C("down"), 14)))
    out = bars.select("ticker", "date", C("tr").alias("true_range"), plus.alias("vi_plus"), minus.alias("vi_minus"), mfi.alias("mfi_14"), indicators.cmf().alias("cmf_20"), ((C("close") - lag("sma_20", 11)) / C("close")).alias("dpo_20"))
    return rounded(out, {"true_range": 9})


@query(
    f"""WITH {{BARS}},
r AS (SELECT *, ln(close / lag(close) OVER {_W})) AS lr, close * volume AS dv, lag(close) OVER {_W}) AS pc FROM bars),
s AS (SELECT *, {_full("stddev_samp(lr)", "lr", 20)} AS sd, {_full("avg(lr)", "lr", 20)} AS mu, CASE WHEN lr < 0 THEN lr ELSE 0 END AS dn,
  {_full("avg(dv)", "dv", 20)} AS dv20, {_full("max(high)", "high", 60)} AS hi, {_full("min(low)", "low", 60)} AS lo,
  sum(coalesce(sign(close - pc), 0) * volume) OVER {_W} ROWS UNBOUNDED PRECEDING) AS obv FROM r)
SELECT ticker, date, round(close / nullif(lag(close, 5) OVER {_W}), 0) - 1, 6) AS return_5d, round(ln(close / lag(close, 20) OVER {_W})), 6) AS log_return_20d,
  round(open / pc - 1, 6) AS gap_return, round(abs(close - open) / nullif(high - low, 0), 6) AS candle_body,
  round(sd * sqrt(252), 6) AS hist_vol_20, round({_full("stddev_samp(dn)", "dn", 20)} * sqrt(252), 6) AS downside_vol_20, round((lr - mu) / nullif(sd, 0), 5) AS ret_z_20,
  round(dv20, 1) AS dollar_volume_20, round(close / hi - 1, 6) AS dist_high_60, round(close / lo - 1, 6) AS dist_low_60, round(obv, 2) AS obv,
  round(lead(close, 5) OVER {_W}) / close - 1, 6) AS target_return, CASE WHEN lead(close, 5) OVER {_W}) IS NOT NULL THEN CAST(lead(close, 5) OVER {_W}) / close - 1 > 0 AS INTEGER) END AS target_direction
FROM s""",
    days="date",
)
def window_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = indicators.steps(brand_bars(spark, sf_dir))
    down = F.when(C("log_ret") < 0, C("log_ret")).otherwise(0.0)
    goal = indicators.targets(5)
    out = bars.select(
        "ticker", "date", change(C("close"), lag("close", 5)).alias("return_5d"), F.log(C("close") / lag("close", 20)).alias("log_return_20d"), (C("open") / C("prior") - 1).alias("gap_return"),
        (F.abs(C("close") - C("open")) / C("candle")).alias("candle_body"), (rolling_std(C("log_ret"), 20) * 252**0.5).alias("hist_vol_20"), (rolling_std(down, 20) * 252**0.5).alias("downside_vol_20"),
        indicators.zscore(C("log_ret"), 20).alias("ret_z_20"), sma("dollar_volume", 20).alias("dollar_volume_20"), (C("close") / rolling_max(C("high"), 60) - 1).alias("dist_high_60"),
        (C("close") / rolling_min(C("low"), 60) - 1).alias("dist_low_60"), F.sum(F.coalesce(F.signum(C("close") - C("prior")), F.lit(0.0)) * C("volume")).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)).alias("obv"),
        goal["target_return"].alias("target_return"), goal["target_direction"].alias("target_direction"),
    )
    return rounded(out, {"obv": 2, "ret_z_20": 5, "dollar_volume_20": 1})


_EMA_SQL = """WITH RECURSIVE {BARS},
b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc FROM bars),
t AS (SELECT ticker, date, n, close, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS g, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS l FROM b),
e AS (
  SELECT ticker, date, n, close, close AS f, close AS s, tr AS a, g, l FROM t WHERE n = 1
  UNION ALL
  SELECT t.ticker, t.date, t.n, t.close, (1 - 2.0 / 13) * e.f + 2.0 / 13 * t.close, (1 - 2.0 / 27) * e.s + 2.0 / 27 * t.close, (1 - 1.0 / 14) * e.a + 1.0 / 14 * t.tr,
    coalesce((1 - 1.0 / 14) * e.g + 1.0 / 14 * t.g, t.g), coalesce((1 - 1.0 / 14) * e.l + 1.0 / 14 * t.l, t.l)
  FROM e JOIN t ON t.ticker = e.ticker AND t.n = e.n + 1)
SELECT ticker, date, round(CASE WHEN n >= 12 THEN f END, 4) AS ema_12, round(CASE WHEN n >= 26 THEN s END, 4) AS ema_26, round(CASE WHEN n >= 26 THEN (f - s) / close END, 6) AS macd_line,
  round(CASE WHEN n >= 14 THEN a END, 4) AS atr_14, round(CASE WHEN n >= 15 THEN 100 - 100 / (1 + g / nullif(l, 0)) END, 5) AS rsi_14
FROM e"""


@query(_EMA_SQL, days="date")
def recursive_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = indicators.smoothed(brand_bars(spark, sf_dir))
    out = bars.select("ticker", "date", "ema_12", "ema_26", (C("macd") / C("close")).alias("macd_line"), "atr_14", indicators.rsi(14).alias("rsi_14"))
    return rounded(out, {"ema_12": 4, "ema_26": 4, "atr_14": 4, "rsi_14": 5})


@query(_EMA_SQL, days="date")
def scanned_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same averages with each brand's years spread over tasks."""
    steps = [Smoothing("ema_12", "close", span(12), 12), Smoothing("ema_26", "close", span(26), 26), Smoothing("atr_14", "tr", wilder(14), 14)]
    steps += [Smoothing(f"{x}_14", x, wilder(14), 14) for x in ("gain", "loss")]
    bars = scanned(indicators.steps(brand_bars(spark, sf_dir)), steps, F.year("date"))
    out = bars.select("ticker", "date", "ema_12", "ema_26", ((C("ema_12") - C("ema_26")) / C("close")).alias("macd_line"), "atr_14", indicators.rsi(14).alias("rsi_14"))
    return rounded(out, {"ema_12": 4, "ema_26": 4, "atr_14": 4, "rsi_14": 5})


@query(
    """WITH RECURSIVE {BARS}, b AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars),
e AS (SELECT ticker, date, n, close AS y FROM b WHERE n = 1 UNION ALL SELECT b.ticker, b.date, b.n, 0.8 * e.y + 0.2 * b.close FROM e JOIN b ON b.ticker = e.ticker AND b.n = e.n + 1)
SELECT ticker, date, round(CASE WHEN n >= 9 THEN y END, 2) AS ema_9 FROM e""",
    days="date",
)
def folded_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same recursion without Python, as a fold over a bounded look-back."""
    return rounded(brand_bars(spark, sf_dir).select("ticker", "date", ema(C("close"), span(9), 9).alias("ema_9")), 2)


@query(feature_sql.matrix_sql(BARS_SQL.replace("p_brand", "p_type")), days="date")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By part type, whose bars hold several lines: a bar of one line has no range, which voids its features."""
    return rounded(indicators.feature_matrix(brand_bars(spark, sf_dir, "p_type")), feature_sql.PLACES)


@query(
    f"""WITH {{BARS}},
r AS (SELECT *, (high + low + close) / 3 AS tp, close / lag(close) OVER {_W}) - 1 AS ret, close * volume AS dv FROM bars),
s AS (SELECT *, abs(ret) / nullif(dv, 0) AS il FROM r)
SELECT ticker, date, round(-CASE WHEN count(open) {_over(10)} >= 10 AND NOT isnan(corr(open, volume) {_over(10)}) THEN corr(open, volume) {_over(10)} END, 5) AS alpha006,
  round(sign(volume - lag(volume) OVER {_W})) * -(close - lag(close) OVER {_W})), 9) AS alpha012,
  round(sqrt(high * low) - {_full("sum(tp * volume)", "tp", 5)} / nullif({_full("sum(volume)", "volume", 5)}, 0), 3) AS alpha041,
  round(-(low - close) * pow(open, 5) / nullif((low - high) * pow(close, 5), 0), 6) AS alpha054, round((close - open) / (high - low + 0.001), 6) AS alpha101,
  round(lag(close, 21) OVER {_W}) / nullif(lag(close, 252) OVER {_W}), 0) - 1, 6) AS momentum_12_1, round({_full("stddev_samp(ret)", "ret", 60)}, 6) AS volatility_60d,
  round(1e9 * {_full("avg(il)", "il", 21)}, 3) AS amihud_21
FROM s""",
    days="date",
)
def factor_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["alpha006", "alpha012", "alpha041", "alpha054", "alpha101", "momentum_12_1", "volatility_60d", "amihud_21"]
    out = factors.compute(brand_bars(spark, sf_dir), names).withColumn("amihud_21", 1e9 * C("amihud_21"))
    return rounded(out, {"alpha006": 5, "alpha012": 9, "alpha041": 3, "amihud_21": 3})


@query(
    f"""WITH {{BARS}}, l AS (SELECT ticker, date, volume, list(volume) {_over(252)} AS vs, list(close) {_over(5)} AS cs FROM bars)
SELECT ticker, date, round(CASE WHEN len(vs) >= 10 THEN (len(list_filter(vs, lambda x: x < volume)) + (len(list_filter(vs, lambda x: x = volume)) + 1) / 2.0) / len(vs) END, 6) AS rank_volume,
  CASE WHEN len(cs) >= 5 THEN CAST(list_position(cs, list_max(cs)) - 1 AS DOUBLE) END AS argmax_5 FROM l""",
    days="date",
)
def rolling_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_order(brand_bars(spark, sf_dir)).withColumn("argmax_5", factors.ts_argmax(C("close"), 5))
    return rounded(slide(rows, [factors.rank_step("rank_volume", "volume")], ready=True).select("ticker", "date", "rank_volume", "argmax_5"))


@query(feature_sql.zoo_sql(BARS_SQL), days="date")
def factor_zoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered factors with fundamentals made from the part table."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    made = part.groupBy(C("p_brand").alias("ticker")).agg((F.sum("p_retailprice") * 1e4).alias("market_cap"), F.avg("p_size").alias("pe"), (F.avg("p_size") / 10).alias("pb"), F.avg("p_retailprice").alias("ev_ebitda"), F.lit(0.12).alias("roe"), F.sum("p_size").cast("double").alias("net_income"), F.sum("p_retailprice").alias("ocf"))
    return rounded(factors.compute(brand_bars(spark, sf_dir), fundamentals=made), feature_sql.ZOO_PLACES)


@query(
    """WITH {BARS}, w AS (SELECT ticker, date_trunc('week', date)::DATE AS week, arg_max(close, date) AS c FROM bars GROUP BY ALL),
s AS (SELECT ticker, week, CASE WHEN count(c) OVER p >= 12 THEN CAST(avg(c) OVER f > avg(c) OVER p AS DOUBLE) END AS regime FROM w
  WINDOW p AS (PARTITION BY ticker ORDER BY week ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY ticker ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT b.ticker, b.date, s.regime FROM bars b LEFT JOIN s ON s.ticker = b.ticker AND s.week = date_trunc('week', b.date)::DATE""",
    days="date",
)
def weekly_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.weekly_regime(brand_bars(spark, sf_dir)).select("ticker", "date", "regime")


# --- lake and corporate actions ---------------------------------------------------------------


@query(
    """WITH {BARS}, v AS (SELECT ticker, date, close, 0 AS gen FROM bars UNION ALL SELECT ticker, date, close * 2, 1 FROM bars WHERE day(date) <= 10 UNION ALL SELECT ticker, date, close * 3, 2 FROM bars WHERE day(date) <= 5)
SELECT ticker, date, arg_max(close, gen) AS close FROM v WHERE gen <= 1 GROUP BY ticker, date""",
    days="date",
)
def lake_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ingests of the panel, read as of the second."""
    lake = Lake(spark, shared_path(spark, "lake"), grain="yyyy")
    bars = brand_bars(spark, sf_dir)
    for gen, (days, by) in enumerate(((31, 1), (10, 2), (5, 3))):
        lake.write(bars.filter(F.dayofmonth("date") <= days).withColumn("close", C("close") * by), f"gen{gen}", F.lit(f"2024-01-0{gen + 1} 00:00:00").cast("timestamp"))
    return lake.read(as_of=datetime(2024, 1, 2, 12, tzinfo=timezone.utc)).select("ticker", "date", "close")


@query(
    """WITH {BARS} SELECT ticker, date, CASE WHEN day(date) % 2 = 0 THEN 'lake' WHEN day(date) % 3 = 0 THEN 'cache' ELSE 'web' END AS source FROM bars""",
    days="date",
)
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = brand_bars(spark, sf_dir)
    of = {"lake": bars.filter(F.dayofmonth("date") % 2 == 0), "cache": bars.filter(F.dayofmonth("date") % 3 == 0), "web": bars}
    return best_source(of, ["lake", "cache", "web"]).select("ticker", "date", "source")


@query(
    """WITH {BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY ticker) AS rows FROM bars)
SELECT ticker, max(rows) AS rows, max(date) AS last_date, datediff('day', max(date), DATE '2002-01-01') AS age_days, count(*) AS bars FROM t WHERE k <= 60 GROUP BY ticker""",
    days="last_date",
)
def chart_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chart_records(brand_bars(spark, sf_dir), 60, F.lit("2002-01-01").cast("date"))
    return out.select("ticker", "rows", "last_date", "age_days", F.size("bars").cast("long").alias("bars"))


@query(
    """WITH {BARS}, o AS (SELECT DISTINCT ticker FROM bars WHERE date <= (SELECT min(date) FROM bars)), n AS (SELECT DISTINCT ticker FROM bars WHERE date >= (SELECT max(date) FROM bars))
SELECT ticker, 'LEFT' AS change FROM o WHERE ticker NOT IN (SELECT ticker FROM n) UNION ALL SELECT ticker, 'JOINED' FROM n WHERE ticker NOT IN (SELECT ticker FROM o)"""
)
def universe_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers quoted on the first day against those of the last, through written snapshots."""
    bars = brand_bars(spark, sf_dir)
    ends = bars.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    members = as_of(bars, ends["a"]).withColumn("as_of", F.lit("old")).unionByName(bars.filter(C("date") >= ends["b"]).withColumn("as_of", F.lit("new")))
    root = shared_path(spark, "universe")
    write_universe(members.select(F.lit("brands").alias("universe"), "as_of", "ticker"), root)
    return universe_changes(read_universe(spark, root, "brands", "old"), read_universe(spark, root, "brands", "new"))


_ACTIONS = "SELECT p_brand AS ticker, l_shipdate::DATE AS date, 'split' AS type, 2.0 AS ratio, NULL::DOUBLE AS cash FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 500 = 0 AND l_linenumber = 1 UNION ALL SELECT p_brand, l_shipdate::DATE, 'dividend', NULL, l_tax * 1000 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 400 = 1"


@query(
    f"""WITH {{BARS}}, a AS ({_ACTIONS}),
p AS (SELECT a.*, (SELECT arg_max(b.close, b.date) FROM bars b WHERE b.ticker = a.ticker AND b.date < a.date) AS lc FROM a),
s AS (SELECT ticker, date, CASE WHEN type = 'split' THEN -ln(ratio) WHEN cash <> 0 AND lc > 0 AND 1 - cash / lc > 0 THEN ln(1 - cash / lc) END AS step FROM p)
SELECT b.ticker, b.date, round(exp(coalesce(sum(s.step), 0)), 6) AS factor
FROM bars b LEFT JOIN s ON s.ticker = b.ticker AND s.date > b.date GROUP BY b.ticker, b.date""",
    days="date",
)
def back_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(C("p_partkey").alias("l_partkey"), C("p_brand").alias("ticker"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(part, "l_partkey").withColumn("date", F.to_date("l_shipdate"))
    none = F.lit(None).cast("double")
    splits = lines.filter("l_orderkey % 500 = 0 and l_linenumber = 1").select("ticker", "date", F.lit("split").alias("type"), F.lit(2.0).alias("ratio"), none.alias("cash_amount"))
    cash = lines.filter("l_orderkey % 400 = 1").select("ticker", "date", F.lit("dividend").alias("type"), none.alias("ratio"), (C("l_tax") * 1000).alias("cash_amount"))
    out = timejoins.adjusted(brand_bars(spark, sf_dir), splits.unionByName(cash))
    return rounded(out.select("ticker", "date", (C("adj_close") / C("close")).alias("factor")))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders), c AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem WHERE dayofweek(l_shipdate) NOT IN (0, 6))
SELECT o_orderkey, o.day, min(c.day) AS session FROM o LEFT JOIN c ON c.day >= o.day GROUP BY o_orderkey, o.day""",
    days="day session",
)
def next_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    sessions = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("day")).filter("dayofweek(day) not in (1, 7)").distinct()
    # distinct days are matched once and joined back, so the ordered part holds days, not orders
    found = timejoins.next_session(days.select("day").distinct(), sessions)
    return days.join(found, "day").select("o_orderkey", "day", "session")


@query(
    """SELECT o_orderkey, CAST(len(list_filter(generate_series(o_orderdate::DATE, o_orderdate::DATE + CAST(o_orderkey % 40 AS INTEGER), INTERVAL 1 DAY), lambda d: isodow(d) < 6)) AS INTEGER) AS weekdays FROM orders"""
)
def weekday_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    end = F.date_add(day, (C("o_orderkey") % 40).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", timejoins.weekdays_between(day, end).alias("weekdays"))


@query(
    f"""WITH {{BARS}}, e AS (SELECT ticker, date AS entry_date, close AS entry, close * 0.7 AS stop, close * 1.5 AS target FROM bars WHERE day(date) = 1),
b AS (SELECT ticker, date, high, low, close, CASE WHEN close < lag(close, 5) OVER {_W}) THEN -1 ELSE 1 END AS signal FROM bars),
h AS (SELECT e.*, b.date, CASE WHEN low <= stop THEN 'STOP' WHEN high >= target THEN 'TARGET' WHEN signal < 0 THEN 'REVERSAL' END AS reason,
  CASE WHEN low <= stop THEN stop WHEN high >= target THEN target ELSE close END AS price FROM e JOIN b ON b.ticker = e.ticker AND b.date > e.entry_date AND b.date <= e.entry_date + 30),
f AS (SELECT ticker, entry_date, min(date) AS exit_date, arg_min(reason, date) AS reason, arg_min(price, date) AS price FROM h WHERE reason IS NOT NULL GROUP BY ALL)
SELECT e.ticker, e.entry_date, f.exit_date, coalesce(f.reason, 'OPEN') AS exit_reason, f.price AS exit_price FROM e LEFT JOIN f USING (ticker, entry_date)""",
    days="entry_date exit_date",
)
def first_touch_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = brand_bars(spark, sf_dir).withColumn("signal", F.when(C("close") < lag("close", 5), -1).otherwise(1))
    entries = bars.filter(F.dayofmonth("date") == 1).select("ticker", C("date").alias("entry_date"), (C("close") * 0.7).alias("stop"), (C("close") * 1.5).alias("target"))
    return timejoins.first_touch(entries, bars, 30).select("ticker", "entry_date", "exit_date", "exit_reason", "exit_price")

