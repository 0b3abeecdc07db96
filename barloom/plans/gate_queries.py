"""Wide queries over gates, verdicts, sizing and journals: every event stands for a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import allocation, gates, memory, paper, stats
from ..operators.panel import brand_bars
from ..sources import logs
from .catalog import query, rounded
from .risk_queries import _RET, _STRATEGY, _W, daily_returns, strategy_returns

C = F.col


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _mod(n: int) -> Column:
    return C("event_id") % n


def _names(reasons: Column) -> Column:
    return F.array_join(reasons, ",")


def _sql_reasons(*rules: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{name}' END" for when, name in rules) + "], lambda x: x IS NOT NULL), ',')"


@query(
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN value / 100 END AS auc, (event_id % 100) / 100.0 AS acc, CASE WHEN event_id % 19 <> 0 THEN (event_id % 101)::DOUBLE END AS cov, 1.0 - event_id % 7 AS stop, event_id % 9 - 3.0 AS target,
  CASE WHEN event_id % 13 <> 0 THEN 0.5 END AS budget, (event_id % 5) * 0.6 AS reward, CASE WHEN event_id % 2 = 0 THEN 's' ELSE 'L' END AS track, CASE WHEN event_id % 17 <> 0 THEN value / 50 - 1 END AS sharpe, (event_id % 30)::DOUBLE AS mdd FROM events),
g AS (SELECT event_id, CASE WHEN auc IS NULL THEN 'RED' WHEN auc >= 0.55 AND acc >= 0.5 THEN 'PASS' WHEN auc >= 0.5 THEN 'AMBER' ELSE 'RED' END AS model, CASE WHEN cov >= 70 THEN 'PASS' WHEN cov >= 50 THEN 'AMBER' ELSE 'RED' END AS coverage,
  CASE WHEN budget IS NULL OR stop >= 0 OR target <= stop THEN 'RED' WHEN reward >= CASE track WHEN 's' THEN 2.0 ELSE 1.5 END THEN 'PASS' ELSE 'AMBER' END AS plan, CASE WHEN sharpe IS NULL THEN 'AMBER' WHEN mdd >= 20 THEN 'RED' WHEN sharpe >= 0 THEN 'PASS' ELSE 'AMBER' END AS backtest FROM e)
SELECT *, CASE WHEN 'RED' IN (model, coverage, plan, backtest) THEN 'RED' WHEN 'AMBER' IN (model, coverage, plan, backtest) THEN 'AMBER' ELSE 'PASS' END AS worst FROM g"""
)
def model_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model health, coverage, risk plan and backtest gates, and the worst of them."""
    auc, sharpe = F.when(_mod(11) != 0, C("value") / 100), F.when(_mod(17) != 0, C("value") / 50 - 1)
    plan = gates.risk_plan_gate(1.0 - _mod(7), _mod(9) - 3.0, F.when(_mod(13) != 0, 0.5), _mod(5) * 0.6, F.when(_mod(2) == 0, "s").otherwise("L"))
    out = _events(spark, sf_dir).select(
        "event_id", gates.model_health(auc, _mod(100) / 100.0).alias("model"), gates.oof_coverage(F.when(_mod(19) != 0, _mod(101).cast("double"))).alias("coverage"),
        plan.alias("plan"), gates.backtest_sanity(sharpe, _mod(30).cast("double")).alias("backtest"),
    )
    return out.withColumn("worst", gates.worst_status(F.array("model", "coverage", "plan", "backtest")))


_SIGNALS = ("BUY", "hold", "Sell")


def _pick(values: tuple, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql_pick(values: tuple, n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{n} % {len(values)} + 1]"


@query(
    f"""WITH e AS (SELECT event_id, value, event_type, upper({_sql_pick(_SIGNALS, "event_id")}) AS signal, upper({_sql_pick(_SIGNALS, "(event_id // 2)")}) AS rec, event_id % 5 = 0 AS static, event_id % 3 = 0 AS closed, event_id % 4 = 0 AS eod,
  {_sql_pick(("EOD_FINAL", "INTRADAY", "EOD_FINAL_CACHE"), "event_id")} AS bar, event_id % 6 = 0 AS outside, event_id % 12 = 0 AS evidence FROM events),
b AS (SELECT *, value >= 3 * greatest((event_id % 20)::DOUBLE, 1) AND value >= 0.995 * (event_id % 90) AS breakout, event_type IN ('error', 'purchase') AND (event_id % 10) / 10.0 >= 0.75 AS shocked, closed AND (NOT (eod AND bar = 'EOD_FINAL') OR bar LIKE '%CACHE%' OR bar LIKE '%INTRADAY%') AS unlocked,
  abs((event_id % 7) * 15.0 - CASE WHEN value / 100 BETWEEN 0 AND 1 THEN value ELSE value / 100 END) >= 50 AND event_id % 9 <> 0 AS apart FROM e),
r AS (SELECT *, {_sql_reasons(("static", "REC_USES_FILE_STATIC_SNAPSHOT"), ("signal <> rec", "SIGNAL_REC_SOURCE_MISMATCH"), ("event_id % 8 = 0", "SIGNAL_REC_BACKTEST_SOURCE_MISMATCH"), ("apart", "MODEL_DISAGREEMENT"))} AS source,
  {_sql_reasons(("unlocked", "EOD_FINAL_BAR_NOT_LOCKED"), ("outside AND NOT evidence", "EXTERNAL_MARKET_VALUES_NOT_LOCKED"), ("shocked AND signal = 'SELL'", "EVENT_SHOCK_SIGNAL_CONFLICT"), ("breakout AND unlocked", "VOLUME_BREAKOUT_REQUIRES_FINAL_BAR"))} AS lag,
  {_sql_reasons(("bar <> 'EOD_FINAL'", "BAR_TYPE_NOT_EOD_FINAL"), ("NOT eod", "EOD_FINAL_BAR_NOT_LOCKED"), ("NOT evidence", "SOURCE_EVIDENCE_LOCK_MISSING"), ("event_id % 4 > 2", "SOURCE_PRIORITY_TOO_LOW"))} AS final, CASE WHEN value < 5 THEN 'NO_PRICE' ELSE '' END AS hard FROM b)
SELECT event_id, breakout, shocked AND signal = 'SELL' AS shock, source, lag, final, CASE WHEN hard <> '' THEN 'RED_BLOCKED' WHEN lag <> '' THEN 'AMBER_DATA_LAG_EVENT_CONFLICT' WHEN source <> '' THEN 'AMBER_SOURCE_CONFLICT' ELSE 'READY' END AS status,
  round(CASE WHEN hard <> '' THEN least(value, 0) WHEN lag <> '' OR source <> '' THEN least(value, 44) ELSE least(value, 100) END, 4) AS score FROM r"""
)
def signal_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of source, data lag and events, the final-bar lock, and the readiness they leave."""
    signal, rec, bar = _pick(_SIGNALS, C("event_id")), _pick(_SIGNALS, F.floor(C("event_id") / 2)), _pick(("eod final", "Intraday", "EOD-FINAL CACHE"), C("event_id"))
    breakout = gates.volume_breakout(C("value"), _mod(20).cast("double"), C("value"), _mod(90).cast("double"))
    none = F.array().cast("array<string>")
    models = F.array(_mod(7) * 15.0, F.when(_mod(9) != 0, C("value") / 100))
    source = gates.source_conflicts(signal, rec, F.lit(""), F.when(_mod(5) == 0, "static file").otherwise("live"), F.array(F.lit("web"), F.when(_mod(8) == 0, "Cache").otherwise("WEB")), none, none, models)
    shocked = C("event_type").isin("error", "purchase") & (_mod(10) / 10.0 >= 0.75)
    lag = gates.lag_conflicts(_mod(3) == 0, _mod(4) == 0, bar, F.lit("web"), _mod(6) == 0, _mod(12) == 0, shocked, signal, breakout)
    final = gates.final_bar_reasons(gates.normalised(bar), _mod(4) == 0, _mod(12) == 0, _mod(4))
    hard = gates.reasons((C("value") < 5, "NO_PRICE"))
    ready = gates.readiness(hard, lag, source, none, C("value"))
    out = _events(spark, sf_dir).select(
        "event_id", breakout.alias("breakout"), gates.event_shock(C("event_type"), _mod(10) / 10.0, signal, ("error", "purchase")).alias("shock"), _names(source).alias("source"), _names(lag).alias("lag"),
        _names(final).alias("final"), ready["status"].alias("status"), ready["score"].alias("score"),
    )
    return rounded(out, 4)


@query(
    f"""WITH t AS (SELECT DISTINCT user_id AS ticker FROM events), p AS (SELECT user_id AS ticker, avg(CAST(value > 30 AS DOUBLE)) AS pass_rate FROM events WHERE user_id % 7 <> 0 GROUP BY user_id), b AS (SELECT user_id AS ticker, avg(CAST(value < 8 AS DOUBLE)) AS pbo FROM events GROUP BY user_id),
d AS (SELECT user_id AS ticker, avg(value) / 50 - 0.9 AS dsr FROM events GROUP BY user_id), q AS (SELECT user_id AS ticker, count(DISTINCT ts::DATE) AS days, avg(value) - 48 AS alpha, count(*) FILTER (event_id % 60 = 0) AS violations FROM events GROUP BY user_id),
j AS (SELECT t.ticker, pass_rate, pbo, dsr AS deflated_sharpe, days, alpha, violations, t.ticker % 5 <> 0 AS card FROM t LEFT JOIN p USING (ticker) LEFT JOIN b USING (ticker) LEFT JOIN d USING (ticker) LEFT JOIN q USING (ticker)),
f AS (SELECT *, {_sql_reasons(("coalesce(pass_rate < 0.6, true)", "CPCV_PATH_RATE"), ("coalesce(pbo > 0.2, true)", "PBO"), ("coalesce(deflated_sharpe <= 0, true)", "DEFLATED_SHARPE"), ("coalesce(days < 30, true)", "FORWARD_PAPER_DAYS"), ("coalesce(alpha < 0, true)", "FORWARD_PAPER_ALPHA"), ("violations > 0", "RULE_VIOLATIONS"), ("NOT card", "MODEL_CARD_PRESENT"))} AS failed FROM j)
SELECT ticker, round(pass_rate, 6) AS pass_rate, round(pbo, 6) AS pbo, round(deflated_sharpe, 6) AS deflated_sharpe, days, round(alpha, 9) AS alpha, violations, card, failed,
  CASE WHEN failed = '' THEN 'LIVE_REVIEW_CANDIDATE' WHEN NOT (failed LIKE '%CPCV%' OR failed LIKE '%PBO%' OR failed LIKE '%DEFLATED%' OR failed LIKE '%MODEL_CARD%') THEN 'PAPER_PASS' ELSE 'AMBER_WATCHLIST' END AS status FROM f"""
)
def live_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of four reports per user, in text or under another name in some, and its review."""
    e = _events(spark, sf_dir).withColumnRenamed("user_id", "ticker")
    share = lambda x: F.avg(x.cast("double"))
    paths = e.filter("ticker % 7 <> 0").groupBy("ticker").agg(share(C("value") > 30).cast("string").alias("path_pass_rate")).withColumn("pass_rate", F.lit("not known"))
    found = gates.readiness_snapshot(
        e, paths, e.groupBy("ticker").agg(share(C("value") < 8).alias("pbo")), e.groupBy("ticker").agg((F.avg("value") / 50 - 0.9).alias("dsr")),
        e.groupBy("ticker").agg(F.count_distinct(F.to_date("ts")).alias("days"), (F.avg("value") - 48).alias("alpha"), F.count_if(_mod(60) == 0).alias("violations")), e.filter("ticker % 5 <> 0"),
    )
    names = {"pass_rate": "pass_rate", "pbo": "pbo", "deflated_sharpe": "deflated_sharpe"}
    out = found.withColumn("deflated_sharpe", C("deflated_sharpe")).select("ticker", *names, "days", "alpha", "violations", "card", _names(C("decision.failed")).alias("failed"), C("decision.status").alias("status"))
    return rounded(out, {"alpha": 9})


@query(
    f"""WITH {{BARS}}, {_STRATEGY}, m AS (SELECT ticker, stddev_pop(ret) * sqrt(252) AS vol, avg(ret) * 252 AS ann, min(dd) AS mdd, avg(CAST(ret > 0.01 AS DOUBLE)) AS hit FROM x GROUP BY ticker),
y AS (SELECT ticker, CASE WHEN vol > 1e-12 THEN ann / vol ELSE 0 END AS sharpe, CASE WHEN abs(mdd) > 1e-12 THEN ann / abs(mdd) ELSE 0 END AS calmar, 100 * mdd AS mdd_pct, hit, ticker <> 'Brand#7' AS paper FROM m),
c AS (SELECT *, (CASE WHEN paper THEN 'PASS' ELSE 'FAIL' END) || ',' || (CASE WHEN sharpe >= 0.5 THEN 'PASS' ELSE 'WARN' END) || ',' || (CASE WHEN calmar >= 0.3 THEN 'PASS' ELSE 'WARN' END) || ',' || (CASE WHEN abs(mdd_pct) <= 15 THEN 'PASS' ELSE 'FAIL' END) || ',' || (CASE WHEN hit >= 0.33 THEN 'PASS' ELSE 'WARN' END) AS checks FROM y)
SELECT ticker, checks, CASE WHEN ticker = 'Brand#3' THEN 'BLOCKED_RISK_HALT' WHEN checks LIKE 'PASS,PASS,PASS,PASS,%' THEN 'CONDITIONAL_PASS_PAPER_TRADING_CANDIDATE' ELSE 'NOT_PASS' END AS verdict FROM c"""
)
def strategy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation list of every brand's strategy; one is halted, one not confined to paper."""
    r = strategy_returns(spark, sf_dir)
    m = stats.annualised(r, ["ticker"]).join(r.groupBy("ticker").agg(F.avg((C("ret") > 0.01).cast("double")).alias("hit")), "ticker")
    v = gates.strategy_validation(C("sharpe"), C("calmar"), 100 * C("max_drawdown"), C("hit"), C("ticker") != "Brand#7", C("ticker") == "Brand#3")
    return m.select("ticker", F.array_join(F.transform(v["checks"], lambda c: c["status"]), ",").alias("checks"), v["verdict"].alias("verdict"))


@query(
    """WITH e AS (SELECT event_id, (event_id % 12) / 100.0 AS atr, CASE WHEN event_id % 7 <> 0 THEN (event_id % 2)::DOUBLE END AS fast, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS slow, value, (event_id % 97) / 97.0 AS p FROM events),
r AS (SELECT *, CASE WHEN atr >= 0.08 THEN 'CRISIS' WHEN slow >= 0.5 THEN 'TREND' WHEN fast >= 0.5 AND atr <= 0.05 THEN 'CALM' WHEN atr >= 0.05 THEN 'RISK' ELSE 'CALM' END AS regime, round(greatest(0.1, least(0.55, p * 0.55)), 2) AS bull, round(greatest(0.1, least(0.45, (1 - p) * 0.65)), 2) AS bear FROM e),
m AS (SELECT *, CASE s WHEN 'bull' THEN value * 1.25 WHEN 'base' THEN value + (value * 1.13 - value) * 0.5 ELSE value * 0.875 END AS price FROM r, (SELECT unnest(['bull', 'base', 'bear']) AS s))
SELECT event_id, regime, CASE regime WHEN 'CRISIS' THEN 1.0 WHEN 'RISK' THEN 0.5 ELSE 0.0 END AS crisis_prob, s AS scenario, round(price, 8) AS price,
  coalesce(round((price - value) / nullif(value, 0) * 100, 1), 0.0) AS return_pct, CASE s WHEN 'bull' THEN bull WHEN 'bear' THEN bear ELSE round(greatest(0.1, 1 - bull - bear), 2) END AS probability FROM m"""
)
def sizing_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizing regime of each event and the bull, base and bear rows of a plan around its value."""
    regime = gates.sizing_regime(_mod(12) / 100.0, F.when(_mod(7) != 0, _mod(2).cast("double")), F.when(_mod(3) == 0, 1.0).otherwise(0.0))
    rows = gates.scenarios(C("value"), C("value") * 0.875, C("value") * 1.13, C("value") * 1.25, _mod(97) / 97.0)
    out = _events(spark, sf_dir).select("event_id", regime["regime"].alias("regime"), regime["crisis_prob"].alias("crisis_prob"), F.inline(rows))
    return rounded(out, 8)


@query(
    f"""WITH e AS (SELECT event_id, value, CASE WHEN event_id % 21 <> 0 THEN event_id % 60 END AS days, value - 40 AS alpha, (event_id % 25 = 0)::INT AS bad, (event_id % 31 = 0)::INT AS gone, (event_id % 28)::DOUBLE AS mdd, 0.2 + (event_id % 10) / 200.0 AS new, 0.24 AS old, event_id % 40 AS weeks FROM events),
z AS (SELECT *, (old - new - 0.02) / greatest(sqrt(2 * old * (1 - old) / nullif(weeks, 0)), 1e-9) AS z FROM e)
SELECT event_id, CASE WHEN coalesce(days, 0) < 30 OR alpha < 0 OR bad > 0 OR gone > 0 OR mdd > 20 THEN 'FAIL' ELSE 'PASS' END AS review, CASE WHEN weeks < 4 THEN 'CONTINUE' WHEN z >= ln(0.8 / 0.05) THEN 'PROMOTE' WHEN z <= ln(0.2 / 0.95) THEN 'STOP' ELSE 'CONTINUE' END AS promotion,
  CASE WHEN (old - new) / old > 0.05 THEN 'PROMOTE' ELSE 'STOP' END AS plain, CASE WHEN abs(value / 50 - 1 - (event_id % 20 / 10.0 - 1)) > 0.4 AND (event_id % 10) / 10.0 * 0.9 > 0.35 THEN 'deep' ELSE 'shallow' END AS route,
  CASE WHEN value / 100 - 0.5 >= -0.02 AND -(event_id % 28) / 100.0 >= -0.05 THEN 'PASS' ELSE 'FAIL' END AS month, {_sql_reasons(("event_id % 30 / 100.0 > 0.2 AND value / 100 - 0.5 < -0.05", "FORWARD_LOSS"), ("event_id % 30 / 100.0 > 0.15", "WEIGHT_CAP_BREACH"), ("event_id % 30 / 100.0 < 0.05", "WEIGHT_FLOOR_BREACH"))} AS sleeve,
  round(CASE WHEN event_id % 6 <> 0 THEN least(greatest(0.7 * value + 0.3 * (50 + 50 * (event_id % 20 / 10.0 - 1)), 0), 100) ELSE 0 END, 4) AS blended FROM z"""
)
def promotion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward review, sequential test, routing, forward month, sleeve caps and the advisor's blend."""
    new, old = 0.2 + _mod(10) / 200.0, F.lit(0.24)
    advice = _mod(20) / 10.0 - 1
    out = _events(spark, sf_dir).select(
        "event_id",
        gates.forward_review(F.when(_mod(21) != 0, _mod(60)), C("value") - 40, (_mod(25) == 0).cast("int"), (_mod(31) == 0).cast("int"), _mod(28).cast("double")).alias("review"),
        gates.sequential_promotion(new, old, F.greatest(_mod(40), F.lit(1))).alias("promotion"),
        gates.sequential_promotion(new, old, _mod(40), sequential=False).alias("plain"),
        gates.advisor_route(C("value") / 50 - 1, advice, _mod(10) / 10.0, F.lit(0.9), 0.4, 0.35).alias("route"),
        gates.forward_month(C("value") / 100 - 0.5, -_mod(28) / 100.0).alias("month"),
        _names(gates.sleeve_warnings(_mod(30) / 100.0, C("value") / 100 - 0.5, cap=0.15, floor=0.05)).alias("sleeve"),
        gates.advisor_blend(C("value"), advice, 0.3, _mod(6) != 0).alias("blended"),
    )
    return rounded(out, 4)


@query(
    f"""WITH e AS (SELECT event_id, event_type, (event_id % 100) / 100.0 AS cov, value / 50 - 1 AS sharpe, (event_id % 40)::DOUBLE AS mdd, (event_id % 9) / 10.0 AS edge, 0.2 AS cost, event_id % 4 AS embargo, event_id % 3 <> 0 AS stress, CASE WHEN event_id % 23 <> 0 THEN (event_id % 70) / 100.0 END AS pbo, 0.9 + (event_id % 10) / 100.0 AS dsr, (event_id % 90) / 90.0 AS rate FROM events),
k AS (SELECT event_type, pbo, [CASE WHEN cov >= 0.5 THEN 0 ELSE 2 END, CASE WHEN sharpe > 0 THEN 0 ELSE 1 END, CASE WHEN mdd <= 25 THEN 0 ELSE 2 END, CASE WHEN edge > 2 * cost THEN 0 WHEN edge > cost THEN 1 ELSE 2 END, CASE WHEN embargo > 0 THEN 0 ELSE 1 END, CASE WHEN stress THEN 0 ELSE 1 END,
  CASE WHEN pbo <= 0.2 THEN 0 WHEN pbo <= 0.5 THEN 1 ELSE 2 END, CASE WHEN dsr >= 0.95 THEN 0 ELSE 1 END, CASE WHEN rate >= 0.6 THEN 0 ELSE 1 END] AS c FROM e)
SELECT sum(len(list_filter(c, lambda x: x = 0)))::BIGINT AS pass, sum(len(list_filter(c, lambda x: x = 1)))::BIGINT AS amber, sum(len(list_filter(c, lambda x: x = 2)))::BIGINT AS red, 0::BIGINT AS zero, max(pbo) AS max_pbo, ['PASS', 'AMBER', 'RED'][max(list_max(c)) + 1] AS status, count(*) FILTER (list_max(c) = 0) AS sound FROM k"""
)
def honesty_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine honesty checks of every event's backtest, counted over the run."""
    rows = _events(spark, sf_dir).select(
        (_mod(100) / 100.0).alias("oof_coverage"), (C("value") / 50 - 1).alias("sharpe"), _mod(40).cast("double").alias("mdd_pct"), (_mod(9) / 10.0).alias("edge"), F.lit(0.2).alias("cost"), _mod(4).alias("embargo"),
        (_mod(3) != 0).alias("stress_passed"), F.when(_mod(23) != 0, _mod(70) / 100.0).alias("pbo"), (0.9 + _mod(10) / 100.0).alias("dsr"), (_mod(90) / 90.0).alias("pass_rate"),
    )
    rows = rows.withColumn("checks", gates.honesty_checks())
    sound = rows.agg(F.count_if(gates.honesty(C("checks")) == "PASS").alias("sound"))
    return gates.honesty_summary(rows).crossJoin(sound)


_VERDICTS = ("ELIGIBLE_RECOMMENDATION", "ACCUMULATE_RECOMMENDATION", "AMBER_REVIEW_ONLY", "RED_NOT_RECOMMENDED")


@query(
    f"""WITH e AS (SELECT event_id, {_sql_pick(_VERDICTS, "event_id")} AS v, {_sql_pick(_VERDICTS, "(event_id // 4)")} AS u, value, event_id % 5 AS m, CASE event_id % 3 WHEN 0 THEN '.KS' WHEN 1 THEN '.kq' ELSE '' END AS suffix FROM events)
SELECT event_id, CASE WHEN m = 0 AND (v LIKE 'ELIGIBLE%' OR v LIKE 'ACCUMULATE%') THEN 'AMBER_WATCHLIST' ELSE v END AS sized, CASE WHEN CASE WHEN v LIKE 'RED%' THEN 1 WHEN v LIKE 'AMBER%' THEN 2 ELSE 3 END <= CASE WHEN u LIKE 'RED%' THEN 1 WHEN u LIKE 'AMBER%' THEN 2 ELSE 3 END THEN v ELSE u END AS worst,
  {_sql_reasons(("value / 1000 > 0.1", "SINGLE_POSITION"), ("(event_id % 13) / 10.0 > 1", "LEVERAGE"), ("suffix <> '' AND abs((event_id % 9) / 10.0 - 0.4) > 0.3", "PRICE_LIMIT"))} AS blocked, round(CASE WHEN m = 0 THEN least(value, 44) ELSE value END, 4) AS capped FROM e"""
)
def order_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts lowered by sizing and by the worse of two, and what keeps an order back."""
    v, u = _pick(_VERDICTS, C("event_id")), _pick(_VERDICTS, F.floor(C("event_id") / 4))
    ticker = F.concat(C("event_type"), F.when(_mod(3) == 0, ".KS").when(_mod(3) == 1, ".kq").otherwise(""))
    out = _events(spark, sf_dir).select(
        "event_id", gates.sized_verdict(v, _mod(5)).alias("sized"), scalars.worst_verdict(v, u).alias("worst"),
        _names(gates.order_gate(ticker, None, C("value") / 1000, _mod(13) / 10.0, _mod(9) / 10.0 - 0.4)).alias("blocked"),
        gates.candidate_cap(C("value"), gates.reasons((_mod(5) == 0, "STALE"))).alias("capped"),
    )
    return rounded(out, 4)


@query(
    r"""WITH e AS (SELECT event_id, user_id, event_type, ts, props, value FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY ts::DATE, user_id, event_type ORDER BY ts) AS seq FROM e)
SELECT event_id, 'JRN-' || strftime(ts, '%Y-%m%d') || '-' || user_id || '-' || event_type || '-' || lpad(seq::VARCHAR, 3, '0') AS journal_id, strftime(ts, '%Y-%m') AS month, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS sha256,
  event_id % 4 IN (0, 1) AS yes, event_id % 4 = 2 AS no, round(CASE WHEN event_id % 3 = 0 THEN value ELSE event_id END, 4) AS number, regexp_extract('said ' || props || ' end', '\{.*\}', 0) AS object, event_type = 'error' AS named, event_id % 2 = 0 AS krx FROM n"""
)
def journal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal ids and digests, month keys, truth in words, first numbers and objects in text."""
    e = _events(spark, sf_dir).withColumns({"day": F.to_date("ts"), "ticker": C("user_id").cast("string"), "track": C("event_type")})
    said = _pick(("Yes", " true ", "off", "maybe"), C("event_id"))
    rows = memory.journal_ids(e)
    hashed = logs.journalled(_events(spark, sf_dir).select("event_id", "event_type")).select("event_id", "sha256")
    out = rows.join(hashed, "event_id").select(
        "event_id", "journal_id", scalars.month_key(C("ts")).alias("month"), "sha256", scalars.truthy(said).alias("yes"), scalars.falsy(said).alias("no"),
        scalars.first_number(F.lit("none"), F.when(_mod(3) == 0, C("value").cast("string")), C("event_id")).alias("number"), scalars.first_object(F.concat(F.lit("said "), C("props"), F.lit(" end"))).alias("object"),
        scalars.mentions(F.lit("ERROR"), F.concat(F.lit("an "), C("event_type"), F.lit("."))).alias("named"), scalars.is_krx(F.concat(C("event_type"), F.when(_mod(2) == 0, ".ks").otherwise(".us"))).alias("krx"),
    )
    return rounded(out, 4)


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, value AS entry, value * (1 - (event_id % 5 - 1) / 20.0) AS stop, value * 1.3 AS tp2, (event_id % 4)::DOUBLE AS quantity FROM events)
SELECT event_id, round((tp2 - entry) / (entry - stop), 4) AS reward_to_risk, round((entry - stop) * quantity, 4) AS risk_value, round(quantity * entry / 10000, 6) AS portfolio_share FROM e WHERE quantity > 0 AND stop < entry"""
)
def trade_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(C("event_id").alias("ticker"), C("value").alias("entry"), (C("value") * (1 - (_mod(5) - 1) / 20.0)).alias("stop"), (C("value") * 1.3).alias("tp2"), _mod(4).cast("double").alias("quantity"))
    return rounded(logs.trade_plan(e, 10_000.0).select(C("ticker").alias("event_id"), "reward_to_risk", "risk_value", "portfolio_share"), {"reward_to_risk": 4, "risk_value": 4})


@query(
    """WITH a AS (SELECT user_id AS factor, ['approved', 'retired', 'rejected', 'proposed'][event_id % 4 + 1] AS event, ts, event_id FROM events), l AS (SELECT factor, arg_max(event, ts) AS event, count(*) AS n FROM a GROUP BY factor)
SELECT factor, event, CASE event WHEN 'approved' THEN 'ACTIVE' WHEN 'retired' THEN 'RETIRED' WHEN 'rejected' THEN 'REJECTED' ELSE 'PENDING' END AS status FROM l"""
)
def factor_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _events(spark, sf_dir).select(C("user_id").alias("factor"), _pick(("approved", "retired", "rejected", "proposed"), C("event_id")).alias("event"), C("ts").alias("at"))
    return logs.factor_status(a).select("factor", "event", "status")


@query(
    f"""WITH e AS (SELECT event_type AS track, {_sql_pick(_VERDICTS, "event_id")} AS verdict, ['provider_attempt', 'recommend', 'other'][event_id % 3 + 1] AS kind, user_id, event_id % 200 AS session, value FROM events)
SELECT track, count(*) AS rows, count(*) FILTER (verdict LIKE 'ELIGIBLE%') AS eligible, count(*) FILTER (verdict LIKE 'AMBER%') AS amber, count(*) FILTER (verdict LIKE 'RED%') AS red, 0::BIGINT AS zero FROM e GROUP BY track"""
)
def ops_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(C("event_type").alias("track"), _pick(_VERDICTS, C("event_id")).alias("verdict"))
    return logs.ops_summary(e, ["track"])


@query(
    """WITH e AS (SELECT user_id AS ticker, ['provider_attempt', 'recommend', 'other'][event_id % 3 + 1] AS kind, event_type FROM events WHERE user_id % 9 <> 0 OR event_id % 3 <> 1)
SELECT ticker, count(*) AS events, CASE WHEN bool_or(kind = 'provider_attempt') AND bool_or(kind = 'recommend') THEN 'PASS' ELSE 'RED' END AS status FROM e GROUP BY ticker"""
)
def audit_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose ninth has no recommendation on record."""
    kind = _pick(("provider_attempt", "recommend", "other"), C("event_id"))
    e = _events(spark, sf_dir).filter((C("user_id") % 9 != 0) | (_mod(3) != 1)).select(C("user_id").alias("ticker"), kind.alias("event_type"))
    return gates.audit_evidence(e)


@query(
    """WITH s AS (SELECT user_id AS ticker, value / 50 - 1 AS score, (event_id % 10) / 20.0 AS q, (user_id % 10) / 10.0 AS crisis FROM events), k AS (SELECT *, CASE WHEN score - q <= 0 AND score + q >= 0 THEN 0 ELSE greatest(0, 1 - q / greatest(abs(score), 1e-9)) END AS conf FROM s),
m AS (SELECT ticker, CASE WHEN min(conf) > 0 THEN exp(sum(ln(CASE WHEN conf > 0 THEN conf END))) ELSE 0 END * abs(avg(sign(score))) * CASE WHEN max(crisis) < 0.5 THEN 1 ELSE 0 END AS m FROM k GROUP BY ticker) SELECT ticker, round(m, 6) AS multiplier FROM m"""
)
def size_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of confidences over all of each user's scores."""
    s = _events(spark, sf_dir).select(C("user_id").alias("ticker"), (C("value") / 50 - 1).alias("score"), (_mod(10) / 20.0).alias("q"), ((C("user_id") % 10) / 10.0).alias("crisis_prob"))
    return rounded(allocation.size_multiplier(s))


@query(
    f"""WITH {{BARS}}, {_RET}, l AS (SELECT DISTINCT date, CASE WHEN month(date) = 2 THEN 'CRISIS' WHEN month(date) < 7 THEN 'CALM' ELSE 'TREND' END AS regime FROM bars), m AS (SELECT regime, ticker, avg(ret) AS mean, stddev_pop(ret) AS vol FROM r JOIN l USING (date) GROUP BY ALL),
x AS (SELECT ticker, sum(p * mean) AS mean, sum(p * (vol * vol + mean * mean)) AS second FROM m JOIN (SELECT unnest(['CRISIS', 'CALM', 'TREND']) AS regime, unnest([0.2, 0.5, 0.3]) AS p) USING (regime) GROUP BY ticker)
SELECT ticker, round(mean, 6) AS mean, round(sqrt(greatest(second - mean * mean, 0)), 6) AS vol FROM x"""
)
def regime_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments by month's regime, mixed by the regimes' probabilities."""
    r = daily_returns(spark, sf_dir)
    label = F.when(F.month("date") == 2, "CRISIS").when(F.month("date") < 7, "CALM").otherwise("TREND")
    p = spark.createDataFrame([("CRISIS", 0.2), ("CALM", 0.5), ("TREND", 0.3)], "regime string, p double")
    return rounded(allocation.regime_mix(allocation.regime_moments(r, r.select("date", label.alias("regime")).distinct()), p))


@query(
    f"""WITH {{BARS}}, {_RET}, w AS (SELECT ticker, sum(volume) AS v, sum(volume * day(date)) AS u FROM bars GROUP BY ticker), s AS (SELECT ticker, v / sum(v) OVER () AS current, u / sum(u) OVER () AS target FROM w), d AS (SELECT date, sum(current * ret) AS ret FROM r JOIN s USING (ticker) WHERE ret IS NOT NULL GROUP BY date),
c AS (SELECT quantile_cont(ret, 0.05) AS cut, count(*) AS n FROM d), a AS (SELECT greatest(0, 1 - 0.01 * sum(abs(target - current)) / nullif(2 * sum(pow(target - current, 2)), 0)) AS alpha FROM s)
SELECT round((SELECT -avg(ret) FROM d, c WHERE ret <= cut), 6) AS cvar, (SELECT count(*) FROM d) AS days, round((SELECT alpha FROM a), 6) AS alpha, round((SELECT sum(abs(alpha * (target - current))) FROM s, a), 6) AS moved"""
)
def portfolio_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail loss of the volume-weighted book and how far a turnover penalty lets it move."""
    bars = brand_bars(spark, sf_dir).groupBy("ticker").agg(F.sum("volume").alias("v"), F.sum(C("volume") * F.dayofmonth("date")).alias("u"))
    total = bars.crossJoin(bars.agg(F.sum("v").alias("tv"), F.sum("u").alias("tu")))
    current, target = (total.select("ticker", (C(a) / C(b)).alias("weight")) for a, b in (("v", "tv"), ("u", "tu")))
    daily = allocation.portfolio_returns(current, daily_returns(spark, sf_dir).filter("ret is not null"))
    moved = allocation.turnover_shrink(target, current, 0.01)
    both = moved.select("ticker", C("weight").alias("new")).join(current.select("ticker", C("weight").alias("old")), "ticker").join(target.select("ticker", C("weight").alias("goal")), "ticker")
    shift = both.agg(F.sum(F.abs(C("new") - C("old"))).alias("moved"), (F.sum(F.abs(C("new") - C("old"))) / F.sum(F.abs(C("goal") - C("old")))).alias("alpha"))
    return rounded(allocation.portfolio_cvar(daily).crossJoin(daily.agg(F.count("ret").alias("days"))).crossJoin(shift))


@query(
    f"""WITH {{BARS}}, {_RET}, s AS (SELECT ticker, date, CASE WHEN ret > 0 THEN 1 WHEN ret < 0 THEN -1 ELSE 0 END AS s FROM r), l AS (SELECT *, lag(s) OVER {_W}) AS b FROM s)
SELECT ticker, round(avg(CAST(s <> 0 AS DOUBLE)), 6) AS active, count(*) FILTER (s <> b) AS transitions, count(*) AS n FROM l GROUP BY ticker"""
)
def signal_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily_returns(spark, sf_dir).withColumn("s", F.coalesce(F.signum("ret"), F.lit(0.0)).cast("int"))
    return rounded(stats.signal_profile(r, "s"))


@query(
    f"""WITH {{BARS}}, {_RET}, p AS (SELECT ticker, date, volume AS f, lead(close, 5) OVER {_W}) / close - 1 AS t FROM r), k AS (SELECT * FROM p WHERE t IS NOT NULL), l AS (SELECT *, list(f) OVER {_W} ROWS 20 PRECEDING) AS fs, list(t) OVER {_W} ROWS 20 PRECEDING) AS ts FROM k),
u AS (SELECT ticker, date, unnest(fs) AS f, unnest(ts) AS t FROM l WHERE len(fs) = 21), g AS (SELECT ticker, date, rank() OVER (PARTITION BY ticker, date ORDER BY f) + (count(*) OVER (PARTITION BY ticker, date, f) - 1) / 2.0 AS a, rank() OVER (PARTITION BY ticker, date ORDER BY t) + (count(*) OVER (PARTITION BY ticker, date, t) - 1) / 2.0 AS b FROM u),
i AS (SELECT ticker, date, corr(a, b) AS ic FROM g GROUP BY ticker, date)
SELECT ticker, count(*) AS windows, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic), 6) AS ir FROM i GROUP BY ticker"""
)
def rank_ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling rank correlations of volume with the return to come, their mean and ratio."""
    w = Window.partitionBy("ticker").orderBy("date")
    r = daily_returns(spark, sf_dir).withColumn("ahead", F.lead("close", 5).over(w) / C("close") - 1)
    ics = stats.rolling_rank_ic(r, "volume", "ahead")
    return rounded(stats.information_ratio(ics, ["ticker"]).select("ticker", C("n").alias("windows"), "mean_ic", "ir"))


@query(
    """WITH q AS (SELECT user_id AS run_id, count(*) FILTER (value > 40)::DOUBLE AS n, sum(value) AS v FROM events GROUP BY user_id), d AS (SELECT user_id AS symbol, ts::DATE AS date, 1000 + sum(value) - 200 AS equity, bool_or(event_id % 60 = 0) AS bad, avg(value) - 50 AS alpha FROM events GROUP BY ALL),
x AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM d),
s AS (SELECT symbol, count(*) AS days, count(*) FILTER (bad) AS violations, min(date) AS start, max(date) AS "end", arg_max(alpha, date) AS alpha, min(dd) AS m FROM x GROUP BY symbol)
SELECT symbol, days, violations, start, "end", round(alpha, 5) AS alpha, round(m, 6) AS max_drawdown, CASE WHEN -100 * m >= 10 THEN 'DRAWDOWN_10' WHEN -100 * m >= 8 THEN 'DRAWDOWN_8' ELSE '' END || CASE WHEN -100 * m - 15 > 3 THEN CASE WHEN -100 * m >= 8 THEN ',' ELSE '' END || 'WORSE_THAN_BENCHMARK' ELSE '' END AS flags FROM s""",
    days='start "end"',
)
def forward_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward log of each user summed up, with the flags of its drawdown."""
    log = _events(spark, sf_dir).groupBy(C("user_id").alias("symbol"), F.to_date("ts").alias("date")).agg((800 + F.sum("value")).alias("equity"), F.bool_or(_mod(60) == 0).alias("rule_violation"), (F.avg("value") - 50).alias("cumulative_alpha_pct"))
    out = paper.forward_summary(log)
    return rounded(out.withColumn("flags", _names(paper.promotion_drawdown(-100 * C("max_drawdown"), F.lit(15.0)))), {"alpha": 5})


@query(
    f"""WITH {{BARS}}, g AS (SELECT *, lag(close) OVER {_W}) AS before, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars),
i AS (SELECT ticker, date, n AS bars, {_sql_reasons(("n < 2", "TOO_FEW_BARS"), ("close / before < 0.6 OR close / before > 1.8", "SPLIT_SUSPECT"), ("high < greatest(open, close) OR low > least(open, close)", "OHLC_ORDER"))} AS issues FROM g WHERE back = 1),
e AS (SELECT event_id, user_id, event_type, value, event_id % 4 AS m, CASE WHEN event_id % 11 <> 0 THEN 0.4 + (event_id % 20) / 50.0 END AS auc, 0.45 + (event_id % 20) / 100.0 AS acc, 'Brand#' || (event_id % 25 + 1) AS ticker FROM events)
SELECT e.event_id, CASE WHEN m = 3 THEN 'UNKNOWN_MARKET' WHEN auc IS NULL THEN 'NO_MODEL_EVIDENCE' WHEN auc < 0.5 OR acc < 0.5 THEN 'MODEL_QUALITY' WHEN event_id % 3 = 1 THEN 'HOLD' WHEN value < 56 THEN 'LOW_SCORE' WHEN issues <> '' THEN split_part(issues, ',', 1) END AS reason FROM e LEFT JOIN i USING (ticker)"""
)
def signal_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason that keeps a signal out, the last bars of its brand among them."""
    issues = paper.bar_checks(brand_bars(spark, sf_dir)).select("ticker", "issues")
    e = _events(spark, sf_dir).select(
        "event_id", F.concat(F.lit("Brand#"), _mod(25) + 1).alias("ticker"), _pick(("KRX", "NYSE", "NASDAQ", "OTC"), C("event_id")).alias("market"), F.when(_mod(11) != 0, 0.4 + _mod(20) / 50.0).alias("auc"),
        (0.45 + _mod(20) / 100.0).alias("accuracy"), _pick(_SIGNALS, C("event_id")).alias("signal"), C("value").alias("score"),
    )
    return e.join(issues, "ticker", "left").select("event_id", paper.signal_gate().alias("reason"))


@query(
    f"""WITH c AS (SELECT event_id, user_id, ts::DATE AS day, CASE WHEN event_id % 2 = 0 THEN 'S' ELSE 'L' END AS track, value AS raw, ['PASS', 'AMBER', 'PASS', NULL][event_id % 4 + 1] AS honest, CASE WHEN event_id % 11 <> 0 THEN (event_id % 30) / 10.0 END AS ret, CASE WHEN event_id % 13 <> 0 THEN event_id % 90 END AS gap,
  CASE WHEN event_id % 3 <> 0 THEN 0.1 END AS advisor, 0.45 + (event_id % 20) / 100.0 AS acc, 0.48 + (event_id % 10) / 100.0 AS auc, value - 10 AS alpha, 30 + event_id % 70 AS trades FROM events), a AS (SELECT DISTINCT user_id, ts::DATE AS day, true AS seen FROM events WHERE event_type = 'click'),
k AS (SELECT c.*, coalesce(honest, 'AMBER') AS h, CASE WHEN ret IS NULL THEN 'AMBER' WHEN ret > 1.5 THEN 'PASS' ELSE 'FAIL' END AS x3, CASE WHEN gap IS NULL THEN 'AMBER' WHEN gap >= CASE track WHEN 'S' THEN 20 ELSE 63 END THEN 'PASS' ELSE 'FAIL' END AS e,
  {_sql_reasons(("acc < 0.5", "ACCURACY_BELOW_50"), ("auc < 0.5", "AUC_BELOW_0_50"), ("alpha < 0", "ALPHA_NEGATIVE"), ("trades < 50", "COMPLETED_TRADES_BELOW_50"))} AS m, CASE WHEN advisor IS NULL THEN 'NOT_APPLICABLE' WHEN seen THEN 'PASS' ELSE 'FAIL' END AS v FROM c LEFT JOIN a USING (user_id, day)),
o AS (SELECT *, {_sql_reasons(("h <> 'PASS'", "BACKTEST_HONESTY"), ("x3 = 'FAIL'", "COST_STRESS_3X"), ("e = 'FAIL'", "EMBARGO_STRESS"), ("v = 'FAIL'", "ADVISOR_AUDIT"))} AS b, h = 'PASS' AND x3 = 'PASS' AND e = 'PASS' AS ready FROM k)
SELECT event_id, m || CASE WHEN m <> '' AND b <> '' THEN ',' ELSE '' END || b AS blocking, round(CASE WHEN m <> '' THEN least(raw, 44) ELSE raw END, 4) AS investment_score, ready, CASE WHEN m <> '' THEN 'AMBER_WATCHLIST' WHEN ready THEN 'PASS' ELSE 'FAIL' END AS status,
  7 - (h <> 'PASS')::INT - (coalesce(ret, 0) <= 0.5)::INT - (coalesce(ret, 0) <= 1.0)::INT - (x3 <> 'PASS')::INT - (e <> 'PASS')::INT - (v <> 'PASS')::INT - (m <> '')::INT AS passed FROM o"""
)
def candidate_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readiness benchmark of a candidate made from each event; clicks are the audit."""
    e = _events(spark, sf_dir).withColumnsRenamed({"user_id": "ticker"}).withColumn("day", F.to_date("ts"))
    rows = e.select(
        "event_id", "ticker", "day", F.when(_mod(2) == 0, "S").otherwise("L").alias("track"), C("value").alias("raw_score"), F.element_at(F.array(F.lit("PASS"), F.lit("AMBER"), F.lit("PASS"), F.lit(None)), (_mod(4) + 1).cast("int")).alias("honesty"),
        F.when(_mod(11) != 0, _mod(30) / 10.0).alias("return_pct"), F.when(_mod(13) != 0, _mod(90)).alias("cv_gap"), F.when(_mod(3) != 0, 0.1).alias("advisor_score"), (0.45 + _mod(20) / 100.0).alias("accuracy"), (0.48 + _mod(10) / 100.0).alias("auc"),
        (C("value") - 10).alias("alpha_pct"), (30 + _mod(70)).alias("trades"),
    )
    out = gates.candidate_benchmark(rows, e.filter("event_type = 'click'"))
    passed = F.size(F.filter("checks", lambda c: c["status"] == "PASS"))
    return rounded(out.select("event_id", _names(C("blocking")).alias("blocking"), "investment_score", "ready", "status", passed.alias("passed")), 4)
