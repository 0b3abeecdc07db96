"""Queries over market regimes, the meta panel and track scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, regimes, stats
from ..operators.panel import brand_bars
from ..sources.shared import landed
from .catalog import query, rounded
from .gate_queries import _events, _mod
from .risk_queries import _RET, _W, daily_returns, returns_of

C = F.col


def _last(n: int, least: int, agg: str, x: str) -> str:
    over = f"OVER (ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {over} >= {least} THEN {agg}({x}) {over} END"


@query(
    f"""WITH {{BARS}}, r AS (SELECT ticker, date, pow(close, 0.1) / lag(pow(close, 0.1)) OVER {_W}) - 1 AS ret FROM bars), d AS (SELECT date, avg(ret) AS market, stddev_samp(ret) AS apart FROM r WHERE ret IS NOT NULL GROUP BY date), v AS (SELECT *, exp(sum(ln(1 + market)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav FROM d),
f AS (SELECT date, {_last(5, 3, "avg", "market")} AS a, {_last(21, 10, "avg", "market")} AS b, {_last(21, 10, "stddev_pop", "market")} * sqrt(252) AS c, {_last(63, 20, "stddev_pop", "market")} * sqrt(252) AS d, nav / {_last(63, 20, "max", "nav")} - 1 AS e, {_last(21, 10, "avg", "apart")} AS g FROM v)
SELECT date, round(a, 6) AS mkt_ret_5, round(b, 6) AS mkt_ret_21, round(c, 5) AS vol_21, round(d, 5) AS vol_63, round(e, 6) AS drawdown_63, round(g, 6) AS dispersion_21 FROM f WHERE a + b + c + d + e + g IS NOT NULL""",
    days="date",
)
def market_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of tamed prices: the mean of raw returns compounds beyond any number."""
    tamed = brand_bars(spark, sf_dir).withColumn("close", F.pow("close", F.lit(0.1)))
    return rounded(regimes.market_features(returns_of(tamed)), {"vol_21": 5, "vol_63": 5})


@query(
    f"""WITH RECURSIVE {{BARS}}, a AS (SELECT ticker, date, close, row_number() OVER {_W}) AS n, coalesce(close / lag(close) OVER {_W}) - 1, 0) AS ret_1, close / lag(close, 5) OVER {_W}) - 1 AS ret_5, close / lag(close, 21) OVER {_W}) - 1 AS ret_21, close / lag(close, 63) OVER {_W}) - 1 AS ret_63,
  lead(close, 5) OVER {_W}) / close - 1 AS fwd_return FROM bars),
e AS (SELECT ticker, n, ret_1 AS s, CAST(1 AS DOUBLE) AS w FROM a WHERE n = 1 UNION ALL SELECT a.ticker, a.n, e.s * (1 - 2.0 / 21) + a.ret_1, e.w * (1 - 2.0 / 21) + 1 FROM e JOIN a ON a.ticker = e.ticker AND a.n = e.n + 1),
v AS (SELECT a.*, CASE WHEN a.n >= 10 THEN stddev_pop(ret_1) OVER {_W} ROWS 19 PRECEDING) * sqrt(252) END AS vol_20, CASE WHEN a.n >= 20 THEN stddev_pop(ret_1) OVER {_W} ROWS 59 PRECEDING) * sqrt(252) END AS vol_60, CASE WHEN a.n >= 10 THEN s / w END AS drift FROM a JOIN e USING (ticker, n)),
p AS (SELECT *, CASE WHEN ret_21 + ret_5 + drift IS NOT NULL THEN least(greatest(0.5 * ret_21 + 0.25 * ret_5 + 0.25 * drift * 5, -0.12), 0.12) END AS score FROM v)
SELECT ticker, date, round(score, 6) AS primary_score, round(abs(score), 6) AS edge_hat, round(sign(score) * fwd_return, 6) AS signed_realized_edge, coalesce(CAST(sign(score) * fwd_return > 0.0005 AS DOUBLE), 0) AS meta_label, round(vol_20, 5) AS vol_20, round(vol_60, 5) AS vol_60 FROM p WHERE score + vol_20 + vol_60 + ret_63 IS NOT NULL""",
    days="date",
)
def meta_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regimes.meta_panel(brand_bars(spark, sf_dir), 5)
    return rounded(out.select("ticker", "date", "primary_score", "edge_hat", "signed_realized_edge", "meta_label", "vol_20", "vol_60"), {"vol_20": 5, "vol_60": 5})


@query()
def meta_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label's probability after 2000 from a model fitted on the years before, and its quality per brand."""
    panel = landed(regimes.meta_panel(brand_bars(spark, sf_dir), 5), "meta")
    scored = regimes.meta_probabilities(panel.filter("date < '2000-01-01' and fwd_return is not null"), panel.filter("date >= '2000-01-01' and fwd_return is not null"), ["ret_1", "ret_5", "ret_21", "ret_63", "vol_20", "vol_60", "primary_score"])
    return rounded(stats.average_rank_auc(scored, ["ticker"], "meta_prob", "meta_label"), 4)


@query(
    f"""WITH {{BARS}}, {_RET}, k AS (SELECT ticker, ret, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1 AS back FROM r WHERE ret IS NOT NULL), w AS (SELECT *, pow(1 - 2.0 / (least(60, greatest(10, n // 3)) + 1), back) AS w FROM k),
b AS (SELECT ticker, 0.7 * sum(w * ret) / sum(w) + 0.3 * avg(ret) FILTER (back < 252) AS daily FROM w GROUP BY ticker)
SELECT ticker, CAST(h + 1 AS INTEGER) AS step, round(daily * 5 * pow(0.8, h), 6) AS forecast FROM b, (SELECT unnest(range(4)) AS h)"""
)
def forecast_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regimes.forecast_path(daily_returns(spark, sf_dir), 4, 5, 0.8, 0.3))


@query(
    f"""WITH {{BARS}}, l AS (SELECT ticker, close, lag(close, 20) OVER {_W}) AS c1, lag(close, 62) OVER {_W}) AS c3, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars), m AS (SELECT ticker, coalesce(close / c1 - 1, 0) AS a, coalesce(close / c3 - 1, 0) AS b FROM l WHERE back = 1),
p AS (SELECT CASE WHEN ticker LIKE '%1' THEN 'ones' ELSE 'others' END AS basket, date, avg(close) AS p FROM bars GROUP BY ALL), d AS (SELECT basket, p / max(p) OVER (PARTITION BY basket ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM p), s AS (SELECT basket, CASE WHEN min(dd) >= -0.05 THEN 'normal' WHEN min(dd) >= -0.15 THEN 'mild' ELSE 'severe' END AS state FROM d GROUP BY basket)
SELECT m.ticker, round(m.a, 6) AS momentum_1m, round(m.b, 6) AS momentum_3m, round(CASE WHEN abs(o.a) > 1e-12 THEN m.a / o.a WHEN abs(m.a) <= 1e-12 THEN 1 ELSE 'inf'::DOUBLE END, 4) AS strength, state FROM m, (SELECT a FROM m WHERE ticker = 'Brand#1') o JOIN s ON s.basket = CASE WHEN m.ticker LIKE '%1' THEN 'ones' ELSE 'others' END"""
)
def regime_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum of each brand, its strength against the first one, and the drawdown state of its basket."""
    bars = brand_bars(spark, sf_dir)
    m = regimes.momentum_diagnostics(bars)
    baskets = bars.select("ticker").distinct().withColumn("basket", F.when(C("ticker").endswith("1"), "ones").otherwise("others"))
    first = m.filter("ticker = 'Brand#1'").select(C("momentum_1m").alias("other"))
    out = m.crossJoin(first).join(baskets, "ticker").join(regimes.drawdown_states(bars, baskets), "basket")
    return rounded(out.select("ticker", "momentum_1m", "momentum_3m", regimes.relative_strength(C("momentum_1m"), C("other")).alias("strength"), "state"), {"strength": 4})


_CANDIDATE = """c AS (SELECT event_id, value + 10 AS latest, (event_id % 10) / 100.0 AS atr_pct, 0.4 + (event_id % 30) / 60.0 AS prob, 0.45 + (event_id % 25) / 100.0 AS auc, 0.45 + (event_id % 15) / 100.0 AS accuracy, 40.0 AS sma20, 45.0 AS sma50, 50.0 AS sma200, 60.0 AS high20,
  (event_id % 21 - 10) / 50.0 AS return_20d, (event_id % 31 - 15) / 50.0 AS return_60d, (event_id % 41 - 20) / 50.0 AS return_252d, -(event_id % 40) / 100.0 AS drawdown_252d, (event_id % 4) * 500000.0 AS adv, (event_id % 17) / 10.0 AS vr, (event_id % 101)::DOUBLE AS regime, CASE WHEN event_id % 13 <> 0 THEN (event_id % 30) / 10.0 - 0.5 END AS sharpe, CASE WHEN event_id % 13 <> 0 THEN (event_id % 35)::DOUBLE END AS mdd FROM events),
u AS (SELECT *, least(0.08, greatest(0.04, 1.35 * atr_pct)) AS stop_pct FROM c), s AS (SELECT *, greatest(0.10, stop_pct * 2.0) AS tp2, greatest(latest * stop_pct, 1e-12) AS risk FROM u),
k AS (SELECT *, latest * tp2 / risk AS rr, greatest(0, least(100000 * 0.005 / risk, 100000 * 0.05 / latest)) AS quantity, (prob * tp2 - (1 - prob) * stop_pct) * 100 AS ev FROM s)"""


def _clip(x: str) -> str:
    return f"least(greatest({x}, 0), 1)"


@query(
    f"""WITH {_CANDIDATE},
z AS (SELECT *, {_clip("(prob - 0.5) / 0.22")} * 18 + {_clip("(auc - 0.5) / 0.18")} * 7 + {_clip("(accuracy - 0.5) / 0.15")} * 5
  + CASE WHEN latest > sma20 THEN 5 ELSE 0 END + CASE WHEN latest > sma50 THEN 5 ELSE 0 END + CASE WHEN sma20 > sma50 THEN 5 ELSE 0 END + CASE WHEN return_20d > 0 THEN 4 ELSE 0 END + CASE WHEN return_60d > 0 THEN 3 ELSE 0 END
  + CASE WHEN adv >= 1000000 THEN 8 ELSE 0 END + CASE WHEN vr >= 1.2 THEN 6 WHEN vr >= 0.8 THEN 3 ELSE 0 END + CASE WHEN latest >= high20 * 0.995 THEN 12 WHEN latest >= sma20 THEN 6 ELSE 0 END
  + CASE WHEN atr_pct <= 0.04 THEN 8 WHEN atr_pct <= 0.06 THEN 5 ELSE 1 END + {_clip("regime / 100")} * 8 + {_clip("(coalesce(sharpe, 0) + 0.2) / 1.7")} * 7 + {_clip("(18 - coalesce(mdd, 99)) / 18")} * 5
  + CASE WHEN rr >= 2 THEN 10 ELSE rr / 2 * 10 END + CASE WHEN ev > 2 THEN 5 WHEN ev > 0 THEN 3 ELSE 0 END AS short,
  CASE WHEN latest > sma200 THEN 10 ELSE 0 END + CASE WHEN sma50 > sma200 THEN 8 ELSE 0 END + CASE WHEN regime >= 60 THEN 7 WHEN regime >= 45 THEN 3 ELSE 0 END + {_clip("(return_252d + 0.10) / 0.35")} * 13 + {_clip("(return_60d + 0.08) / 0.22")} * 10
  + {_clip("(0.08 - atr_pct) / 0.08")} * 12 + CASE WHEN drawdown_252d BETWEEN -0.22 AND -0.03 THEN 14 WHEN drawdown_252d < -0.22 THEN 10 ELSE 6 END + {_clip("(prob - 0.5) / 0.18")} * 10 + {_clip("(auc - 0.5) / 0.18")} * 5 + {_clip("(30 - coalesce(mdd, 99)) / 30")} * 8
  + CASE WHEN rr >= 1.5 THEN 8 WHEN rr >= 1 THEN 4 ELSE 0 END + CASE WHEN adv >= 1000000 AND atr_pct <= 0.08 THEN 7 ELSE 3 END AS long FROM k)
SELECT event_id, round(latest * (1 - stop_pct), 7) AS stop, round(latest * (1 + tp2), 7) AS tp2, round(rr, 6) AS risk_reward, round(quantity, 6) AS quantity, round(ev, 6) AS ev_pct, round(least(short, 100), 5) AS score_short, round(least(long, 100), 5) AS score_long FROM z"""
)
def track_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk plan, expected value and both tracks' scores of a candidate made from each event."""
    from ..functions.scalars import expected_value_pct

    rows = _events(spark, sf_dir).select(
        "event_id", (C("value") + 10).alias("latest"), (_mod(10) / 100.0).alias("atr_pct"), (0.4 + _mod(30) / 60.0).alias("prob"), (0.45 + _mod(25) / 100.0).alias("auc"), (0.45 + _mod(15) / 100.0).alias("accuracy"),
        *(F.lit(v).alias(k) for k, v in {"sma20": 40.0, "sma50": 45.0, "sma200": 50.0, "high20": 60.0}.items()), ((_mod(21) - 10) / 50.0).alias("return_20d"), ((_mod(31) - 15) / 50.0).alias("return_60d"), ((_mod(41) - 20) / 50.0).alias("return_252d"),
        (-_mod(40) / 100.0).alias("drawdown_252d"), (_mod(4) * 500000.0).alias("avg_dollar_volume_20d"), (_mod(17) / 10.0).alias("volume_ratio_20d"), _mod(101).cast("double").alias("market_regime_score"),
        F.when(_mod(13) != 0, _mod(30) / 10.0 - 0.5).alias("sharpe"), F.when(_mod(13) != 0, _mod(35).cast("double")).alias("mdd_pct"),
    )
    rows = rows.withColumns(gates.risk_plan(C("latest"), C("atr_pct"), gates.SHORT))
    out = rows.select("event_id", "stop", "tp2", "risk_reward", "quantity", expected_value_pct(C("prob"), C("tp2_pct"), C("stop_pct")).alias("ev_pct"), gates.score_short().alias("score_short"), gates.score_long().alias("score_long"))
    return rounded(out, {"stop": 7, "tp2": 7, "score_short": 5, "score_long": 5})
