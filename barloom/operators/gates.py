"""Row-level gates, checks, scores and verdicts as Columns.

Statuses are PASS, AMBER, RED or ZERO. Column names in the arguments are those of the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, first_number, lookup, normalised, reasons, severity, spread, worst_verdict

C = F.col

# Source priorities and provider trust.
SOURCE_PRIORITY = {"KRX_FINAL": 1, "BROKER_FINAL": 1, "KRX_OR_BROKER_FINAL": 1, "TRUSTED_EOD_PROVIDER": 2, "PUBLIC_WEB": 3, "PYKRX:CACHE": 4, "PYKRX_CACHE": 4, "CACHE": 4}
PROVIDER_TRUST = {"yfinance": 0.85, "pykrx": 0.90, "fdr": 0.75, "openbb": 0.80, "alpaca": 0.88, "ibkr": 0.92, "kis": 0.88, "synthetic": 0.30, "auto": 0.80}
STATUS = {"PASS": 0, "AMBER": 1, "RED": 2, "ZERO": 3}


def ladder(*steps: tuple[Column, str], other: str) -> Column:
    out = F.when(*_step(steps[0]))
    for s in steps[1:]:
        out = out.when(*_step(s))
    return out.otherwise(other)


def _step(s: tuple[Column, str]) -> tuple[Column, Column]:
    return F.coalesce(s[0], F.lit(False)), F.lit(s[1])


def worst_status(statuses: Column) -> Column:
    ranks = F.transform(statuses, lambda s: lookup(s, STATUS, 0))
    return F.element_at(F.array(*map(F.lit, STATUS)), F.coalesce(F.array_max(ranks), F.lit(0)) + 1)


def source_priority(source: Column) -> Column:
    return lookup(normalised(source), SOURCE_PRIORITY, 99)


def provider_trust(provider: Column) -> Column:
    return lookup(F.lower(provider), PROVIDER_TRUST, 0.70)


def final_bar_reasons(bar_type: Column, eod: Column, evidence: Column, priority: Column) -> Column:
    return reasons(
        (F.upper(F.trim(F.coalesce(bar_type, F.lit("")))) != "EOD_FINAL", "BAR_TYPE_NOT_EOD_FINAL"),
        (~F.coalesce(eod, F.lit(False)), "EOD_FINAL_BAR_NOT_LOCKED"),
        (~F.coalesce(evidence, F.lit(False)), "SOURCE_EVIDENCE_LOCK_MISSING"),
        (F.coalesce(priority, F.lit(99)) > 2, "SOURCE_PRIORITY_TOO_LOW"),
    )


def cache_vs_final(cache: DataFrame, final: DataFrame) -> DataFrame:
    """Bars of both sources, their differences and what they block."""
    a = cache.select("ticker", "date", C("close").alias("cache_close"), C("volume").alias("cache_volume"))
    b = final.select("ticker", "date", C("close").alias("final_close"), C("volume").alias("final_volume"))
    diff = F.coalesce(F.abs(C("final_close") - C("cache_close")) / F.nullif("cache_close", F.lit(0.0)) * 100, F.lit(0.0))
    lag = F.coalesce(F.nullif("final_volume", F.lit(0.0)) / F.nullif("cache_volume", F.lit(0.0)), F.lit(0.0))
    why = reasons((diff > 1.0, "CACHE_CLOSE_DIFF_GT_1PCT"), (lag > 2.0, "CACHE_VOLUME_LAG_GT_2X"))
    out = a.join(b, ["ticker", "date"]).select("ticker", "date", diff.alias("close_diff_pct"), lag.alias("volume_lag_ratio"), why.alias("blocking"))
    return out.withColumn("status", F.when(F.size("blocking") > 0, "AMBER_DATA_LAG").otherwise("PASS"))


def freshness(market: Column, minutes: Column) -> Column:
    m = F.upper(market)
    us = m.isin("NYSE", "NASDAQ")
    return ladder((minutes.isNull(), "RED"), ((m == "KRX") & (minutes <= 1440), "PASS"), ((m == "KRX") & (minutes <= 4320), "AMBER"), (us & (minutes <= 1440), "PASS"), (us | (m == "KRX"), "RED"), other="AMBER")


def price_crosscheck(a: Column, b: Column) -> Column:
    apart = F.abs(a - b) / ((a + b) / 2) * 100
    return ladder((a.isNull() | b.isNull(), "AMBER"), ((a <= 0) | (b <= 0), "RED"), (apart <= 1, "PASS"), (apart <= 3, "AMBER"), other="RED")


def completeness(df: DataFrame) -> DataFrame:
    """Per ticker: enough rows, some volume, sound closes."""
    agg = df.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.max("volume").alias("top"), F.count_if(C("close").isNull() | (C("close") <= 0)).alias("bad"))
    return agg.select("ticker", "rows", ladder((C("rows") < 30, "RED"), (F.coalesce("top", F.lit(0.0)) == 0, "RED"), (C("bad") > 0, "RED"), other="PASS").alias("status"))


def largest_drop(df: DataFrame, limit: float = 20.0) -> DataFrame:
    """Per ticker the largest one-bar fall in percent and what it suggests."""
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))
    drop = F.when(before > 0, (before - C("close")) / before * 100)
    agg = df.select("ticker", drop.alias("d")).groupBy("ticker").agg(F.greatest(F.coalesce(F.max("d"), F.lit(0.0)), F.lit(0.0)).alias("drop_pct"))
    return agg.select("ticker", "drop_pct", F.when(C("drop_pct") < 10, "PASS").otherwise("AMBER").alias("status"), ladder((C("drop_pct") < 10, "none"), (C("drop_pct") < limit, "suspected_corp_action"), other="unexplained_drop").alias("finding"))


def model_health(auc: Column, accuracy: Column) -> Column:
    return ladder((auc.isNull() | accuracy.isNull(), "RED"), ((auc >= 0.55) & (accuracy >= 0.5), "PASS"), (auc >= 0.5, "AMBER"), other="RED")


def oof_coverage(pct: Column) -> Column:
    return ladder((pct >= 70, "PASS"), (pct >= 50, "AMBER"), other="RED")


def risk_plan_gate(stop_pct: Column, target_pct: Column, budget: Column, reward: Column, track: Column) -> Column:
    missing = stop_pct.isNull() | target_pct.isNull() | budget.isNull() | reward.isNull()
    return ladder((missing, "RED"), ((stop_pct >= 0) | (target_pct <= stop_pct), "RED"), (reward >= F.when(F.upper(track) == "S", 2.0).otherwise(1.5), "PASS"), other="AMBER")


def backtest_sanity(sharpe: Column, mdd_pct: Column) -> Column:
    return ladder((sharpe.isNull() | mdd_pct.isNull(), "AMBER"), (mdd_pct >= 20, "RED"), (sharpe >= 0, "PASS"), other="AMBER")


def approval(gates: DataFrame, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Approval from a table of gate results (status, cleared)."""
    red, every = F.bool_or(C("status").isin("RED", "ZERO")), F.bool_and(C("status") == "PASS")
    open_ = F.bool_or((C("status") == "AMBER") & ~F.coalesce("cleared", F.lit(False)))
    return gates.groupBy(*by).agg(ladder((red, "BLOCKED"), (every, "APPROVED"), (open_, "PENDING_REVIEW"), other="APPROVED_WITH_AMBER").alias("approval"), F.count_if(C("status") == "PASS").alias("passed"), F.count(F.lit(1)).alias("gates"))


def audit_evidence(events: DataFrame) -> DataFrame:
    has = lambda kind: F.bool_or(C("event_type") == kind)
    agg = events.groupBy("ticker").agg(F.count(F.lit(1)).alias("events"), has("provider_attempt").alias("p"), has("recommend").alias("r"))
    return agg.select("ticker", "events", F.when(C("p") & C("r"), "PASS").otherwise("RED").alias("status"))


def volume_breakout(volume: Column, mean: Column, close: Column, upper: Column) -> Column:
    """Volume three times its mean (at least 1) at or just under the upper band."""
    return F.coalesce((volume / F.greatest(mean, F.lit(1.0)) >= 3) & (close >= 0.995 * upper), F.lit(False))


def event_shock(category: Column, sentiment: Column, signal: Column, shocking: Sequence[str]) -> Column:
    return F.coalesce(category.isin(*shocking) & (sentiment >= 0.75) & (F.upper(signal) == "SELL"), F.lit(False))


def scaled(score: Column) -> Column:
    """Shares become percentages."""
    return F.when(score.between(0, 1), score * 100).otherwise(score)


def model_disagreement(scores: Column, limit: float = 50.0) -> Column:
    return F.coalesce(spread(F.transform(scores, scaled)) >= limit, F.lit(False))


def conflicts(values: Column, name: str) -> Column:
    """A reason if an array holds more than one distinct value."""
    return reasons((F.size(F.array_distinct(F.array_compact(values))) > 1, name))


def source_conflicts(signal: Column, rec_signal: Column, benchmark: Column, rec_mode: Column, sources: Column, modes: Column, times: Column, scores: Column) -> Column:
    """Reasons why a signal, its recommendation and its backtest do not belong together."""
    static = normalised(rec_mode).isin("FILE", "FILE_STATIC", "STATIC", "STATIC_FILE", "SNAPSHOT", "FILE_SNAPSHOT")
    said = lambda x: normalised(x) != ""
    apart = lambda xs: F.size(F.array_distinct(F.filter(F.transform(xs, normalised), lambda v: v != ""))) > 1
    return reasons(
        (static, "REC_USES_FILE_STATIC_SNAPSHOT"),
        (said(signal) & said(rec_signal) & (normalised(signal) != normalised(rec_signal)), "SIGNAL_REC_SOURCE_MISMATCH"),
        (said(signal) & said(benchmark) & (normalised(signal) != normalised(benchmark)), "SIGNAL_BENCHMARK_MISMATCH"),
        (apart(sources), "SIGNAL_REC_BACKTEST_SOURCE_MISMATCH"),
        (apart(modes), "SIGNAL_REC_BACKTEST_MODE_MISMATCH"),
        (apart(times), "SIGNAL_REC_BACKTEST_TIMESTAMP_MISMATCH"),
        (model_disagreement(scores), "MODEL_DISAGREEMENT"),
    )


def lag_conflicts(closed: Column, eod: Column, bar_type: Column, source: Column, external: Column, evidence: Column, shock: Column, signal: Column, breakout: Column) -> Column:
    """Reasons why the last bar cannot be trusted yet, or an event contradicts the signal."""
    known = lambda x: F.coalesce(x, F.lit(False))
    kind = normalised(bar_type)
    cached = normalised(source).contains("CACHE") | kind.contains("CACHE") | kind.contains("INTRADAY")
    unlocked = known(closed) & (~(known(eod) & kind.isin("EOD_FINAL", "FINAL_EOD")) | cached)
    return reasons(
        (unlocked, "EOD_FINAL_BAR_NOT_LOCKED"),
        (known(external) & ~known(evidence), "EXTERNAL_MARKET_VALUES_NOT_LOCKED"),
        (known(shock) & (normalised(signal) == "SELL"), "EVENT_SHOCK_SIGNAL_CONFLICT"),
        (known(breakout) & unlocked, "VOLUME_BREAKOUT_REQUIRES_FINAL_BAR"),
    )


def readiness(hard: Column, lag: Column, source: Column, failures: Column, score: Column) -> Column:
    """Status and capped score from reason arrays, the first kind that has any deciding."""
    status = ladder((F.size(hard) > 0, "RED_BLOCKED"), (F.size(lag) > 0, "AMBER_DATA_LAG_EVENT_CONFLICT"), (F.size(source) > 0, "AMBER_SOURCE_CONFLICT"), (F.size(failures) > 0, "AMBER_GATE_FAILURES"), other="READY")
    cap = F.when(F.size(hard) > 0, 0.0).when(F.size(lag) + F.size(source) + F.size(failures) > 0, 44.0).otherwise(100.0)
    return F.struct(status.alias("status"), F.least(score, cap).alias("score"), F.concat(hard, lag, source, failures).alias("reasons"))


def live_review(checks: dict[str, Column], paper: Sequence[str]) -> Column:
    """LIVE_REVIEW_CANDIDATE if all gates pass, PAPER_PASS if those for paper do, else AMBER_WATCHLIST."""
    failed = reasons(*((~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()))
    of_paper = F.array_intersect(failed, F.array(*map(F.lit, paper)))
    return F.struct(ladder((F.size(failed) == 0, "LIVE_REVIEW_CANDIDATE"), (F.size(of_paper) == 0, "PAPER_PASS"), other="AMBER_WATCHLIST").alias("status"), failed.alias("failed"))


def readiness_snapshot(tickers: DataFrame, paths: DataFrame, pbo: DataFrame, dsr: DataFrame, paper: DataFrame, cards: DataFrame) -> DataFrame:
    """Evidence of several reports per ticker, first known names first, and the live review of it.

    ``paths``: pass_rate or path_pass_rate; ``pbo``; ``dsr``: deflated_sharpe or dsr; ``paper``:
    days, alpha, violations; ``cards``: the tickers that have a model card.
    """
    first = lambda df, *names: df.select("ticker", first_number(*(C(n) for n in names if n in df.columns)).alias(names[0]))
    every = tickers.select("ticker").distinct()
    for report in (first(paths, "pass_rate", "path_pass_rate"), first(pbo, "pbo", "probability_of_backtest_overfitting"), first(dsr, "deflated_sharpe", "dsr"), paper.select("ticker", "days", "alpha", "violations")):
        every = every.join(report, "ticker", "left")
    every = every.join(cards.select("ticker", F.lit(True).alias("card")).distinct(), "ticker", "left").withColumn("card", F.coalesce("card", F.lit(False)))
    checks = {
        "CPCV_PATH_RATE": C("pass_rate") >= 0.6, "PBO": C("pbo") <= 0.2, "DEFLATED_SHARPE": C("deflated_sharpe") > 0, "FORWARD_PAPER_DAYS": C("days") >= 30,
        "FORWARD_PAPER_ALPHA": C("alpha") >= 0, "RULE_VIOLATIONS": C("violations") <= 0, "MODEL_CARD_PRESENT": C("card"),
    }
    return every.withColumn("decision", live_review(checks, ("CPCV_PATH_RATE", "PBO", "DEFLATED_SHARPE", "MODEL_CARD_PRESENT")))


def strategy_validation(sharpe: Column, calmar: Column, mdd_pct: Column, hit_rate: Column, paper_only: Column, halted: Column) -> Column:
    """Named checks of a strategy's metrics and the verdict; a short hit rate warns but does not fail."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    ok = {"BACKTEST_HONESTY": F.coalesce(paper_only, F.lit(False)), "SHARPE": zero(sharpe) >= 0.5, "CALMAR": zero(calmar) >= 0.3, "MAX_DRAWDOWN": F.abs(zero(mdd_pct)) <= 15, "TARGET_RETURN_10PCT": zero(hit_rate) >= 0.33}
    other = {"BACKTEST_HONESTY": "FAIL", "MAX_DRAWDOWN": "FAIL"}
    checks = F.array(*(F.struct(F.lit(k).alias("rule"), F.when(v, "PASS").otherwise(other.get(k, "WARN")).alias("status")) for k, v in ok.items()))
    good = ok["BACKTEST_HONESTY"] & ok["SHARPE"] & ok["CALMAR"] & ok["MAX_DRAWDOWN"]
    return F.struct(checks.alias("checks"), ladder((halted, "BLOCKED_RISK_HALT"), (good, "CONDITIONAL_PASS_PAPER_TRADING_CANDIDATE"), other="NOT_PASS").alias("verdict"))


def sizing_regime(atr_pct: Column, fast: Column, slow: Column) -> Column:
    """Coarse regime for sizing and the probability of a crisis that it stands for."""
    atr, fast, slow = (F.coalesce(x, F.lit(0.0)) for x in (atr_pct, fast, slow))
    label = ladder((atr >= 0.08, "CRISIS"), (slow >= 0.5, "TREND"), ((fast >= 0.5) & (atr <= 0.05), "CALM"), (atr >= 0.05, "RISK"), other="CALM")
    return F.struct(label.alias("regime"), lookup(label, {"CRISIS": 1.0, "RISK": 0.5}, 0.0).alias("crisis_prob"))


def scenarios(entry: Column, stop: Column, tp1: Column, tp2: Column, prob: Column) -> Column:
    """Bull, base and bear price, return in percent and probability of a risk plan."""
    middle = entry + (tp1 - entry) * 0.5
    share = lambda p: F.round((p - entry) / F.nullif(entry, F.lit(0.0)) * 100, 1)
    bull, bear = F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.55), prob * 0.55)), 2), F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.45), (1 - prob) * 0.65)), 2)
    row = lambda name, price, p: F.struct(F.lit(name).alias("scenario"), price.alias("price"), F.coalesce(share(price), F.lit(0.0)).alias("return_pct"), p.alias("probability"))
    return F.array(row("bull", tp2, bull), row("base", middle, F.round(F.greatest(F.lit(0.1), 1 - bull - bear), 2)), row("bear", stop, bear))


@dataclass(frozen=True)
class Track:
    """Limits of a track; the defaults are the short one's."""

    name: str = "S"
    green: float = 70.0
    amber: float = 55.0
    least_stop: float = 0.04
    hard_stop: float = 0.08
    stop_atr: float = 1.35
    tp1: float = 0.06
    tp1_stop: float = 1.10
    tp2: float = 0.10
    tp2_stop: float = 2.0
    reward: float = 2.0
    budget: float = 0.005
    position: float = 0.05
    mdd: float = 18.0
    regime: float = 45.0
    prob: float = 0.56
    rows: int = 260
    liquidity: float = 1_000_000.0
    coverage: float = 0.5


SHORT = Track()
LONG = Track("L", 70.0, 55.0, 0.10, 0.22, 2.0, 0.15, 0.75, 0.30, 1.5, 1.5, 0.01, 0.10, 30.0, 40.0, 0.53)


def risk_plan(entry: Column, atr_pct: Column, t: Track, capital: float = 100_000.0) -> dict[str, Column]:
    stop_pct = F.least(F.lit(t.hard_stop), F.greatest(F.lit(t.least_stop), t.stop_atr * F.coalesce(atr_pct, F.lit(0.0))))
    tp1, tp2 = F.greatest(F.lit(t.tp1), stop_pct * t.tp1_stop), F.greatest(F.lit(t.tp2), stop_pct * t.tp2_stop)
    risk = F.greatest(entry * stop_pct, F.lit(1e-12))
    quantity = F.greatest(F.lit(0.0), F.least(capital * t.budget / risk, capital * t.position / entry))
    return {
        "entry": entry, "stop": entry * (1 - stop_pct), "tp1": entry * (1 + tp1), "tp2": entry * (1 + tp2), "stop_pct": stop_pct, "tp2_pct": tp2,
        "risk_reward": entry * tp2 / risk, "quantity": quantity, "position_value": quantity * entry,
    }


def _points(*rules: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for when, value in rules:
        out = out + F.when(F.coalesce(when, F.lit(False)), value).otherwise(0.0)
    return out


def _steps(*rules: tuple[Column, float], other: float) -> Column:
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for when, value in rules[1:]:
        out = out.when(F.coalesce(when, F.lit(False)), value)
    return out.otherwise(other)


def score_short(t: Track = SHORT) -> Column:
    """0 to 100 from columns prob, auc, accuracy, the snapshot, sharpe, mdd_pct and the risk plan."""
    model = clip((C("prob") - 0.5) / 0.22) * 18 + clip((C("auc") - 0.5) / 0.18) * 7 + clip((C("accuracy") - 0.5) / 0.15) * 5
    trend = _points((C("latest") > C("sma20"), 5.0), (C("latest") > C("sma50"), 5.0), (C("sma20") > C("sma50"), 5.0), (C("return_20d") > 0, 4.0), (C("return_60d") > 0, 3.0))
    liquidity = _points((C("avg_dollar_volume_20d") >= t.liquidity, 8.0)) + _steps((C("volume_ratio_20d") >= 1.2, 6.0), (C("volume_ratio_20d") >= 0.8, 3.0), other=0.0)
    breakout = _steps((C("latest") >= C("high20") * 0.995, 12.0), (C("latest") >= C("sma20"), 6.0), other=0.0)
    calm = _steps((C("atr_pct") <= 0.04, 8.0), (C("atr_pct") <= 0.06, 5.0), other=1.0) + clip(C("market_regime_score") / 100) * 8
    tested = clip((F.coalesce("sharpe", F.lit(0.0)) + 0.2) / 1.7) * 7 + clip((t.mdd - F.coalesce("mdd_pct", F.lit(99.0))) / t.mdd) * 5
    ev = (C("prob") * C("tp2_pct") - (1 - C("prob")) * C("stop_pct")) * 100
    reward = F.when(C("risk_reward") >= t.reward, 10.0).otherwise(C("risk_reward") / t.reward * 10) + _steps((ev > 2, 5.0), (ev > 0, 3.0), other=0.0)
    return F.least(model + trend + liquidity + breakout + calm + tested + reward, F.lit(100.0))


def score_long(t: Track = LONG) -> Column:
    quality = _points((C("latest") > C("sma200"), 10.0), (C("sma50") > C("sma200"), 8.0)) + _steps((C("market_regime_score") >= 60, 7.0), (C("market_regime_score") >= 45, 3.0), other=0.0)
    momentum = clip((C("return_252d") + 0.10) / 0.35) * 13 + clip((C("return_60d") + 0.08) / 0.22) * 10
    value = _steps((C("drawdown_252d").between(-0.22, -0.03), 14.0), (C("drawdown_252d") < -0.22, 10.0), other=6.0)
    model = clip((C("prob") - 0.5) / 0.18) * 10 + clip((C("auc") - 0.5) / 0.18) * 5
    tested = clip((t.mdd - F.coalesce("mdd_pct", F.lit(99.0))) / t.mdd) * 8
    rest = _steps((C("risk_reward") >= 1.5, 8.0), (C("risk_reward") >= 1.0, 4.0), other=0.0) + _steps(((C("avg_dollar_volume_20d") >= t.liquidity) & (C("atr_pct") <= 0.08), 7.0), other=3.0)
    return F.least(quality + momentum + clip((0.08 - C("atr_pct")) / 0.08) * 12 + value + model + tested + rest, F.lit(100.0))


def validation_checks(t: Track) -> Column:
    """The nine named checks of a candidate as an array of (name, status)."""
    check = lambda name, ok, bad: F.struct(F.lit(name).alias("name"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise(bad).alias("status"))
    return F.array(
        check("DATA_ROWS", C("rows") >= t.rows, "FAIL"),
        check("LIQUIDITY", C("avg_dollar_volume_20d") >= t.liquidity, "AMBER"),
        check("MARKET_REGIME", C("market_regime_score") >= t.regime, "AMBER"),
        check("MODEL_EDGE", (C("prob") >= t.prob) & (C("accuracy") >= 0.5), "AMBER"),
        check("OOF_COVERAGE", C("oof_coverage") >= t.coverage, "AMBER"),
        check("BACKTEST_SANITY", (C("mdd_pct") <= t.mdd) & (C("sharpe") >= -0.25), "AMBER"),
        check("RISK_PLAN", (C("stop") > 0) & (C("stop") < C("entry")) & (C("risk_reward") >= t.reward - 1e-9), "FAIL"),
        F.struct(F.lit("TRACK_SCORE").alias("name"), _graded(C("score"), t).alias("status")),
        check("AUTOMATION_BOUNDARY", F.lit(True), "FAIL"),
    )


def _graded(score: Column, t: Track) -> Column:
    return ladder((score >= t.green, "PASS"), (score >= t.amber, "AMBER"), other="FAIL")


def verdict(score: Column, checks: Column, t: Track) -> Column:
    failed = lambda name: F.exists(checks, lambda c: (c["name"] == name) & (c["status"] == "FAIL"))
    passed = F.size(F.filter(checks, lambda c: c["status"] == "PASS"))
    best, middle = ("ELIGIBLE_RECOMMENDATION", "AMBER_REVIEW_ONLY") if t.name == "S" else ("ACCUMULATE_RECOMMENDATION", "AMBER_WATCHLIST")
    return ladder((failed("DATA_ROWS"), "RED_DATA_INSUFFICIENT"), (failed("RISK_PLAN"), "ZERO_RISK_PLAN_FAILED"), ((score >= t.green) & (passed >= 6), best), (score >= t.amber, middle), other="RED_NOT_RECOMMENDED")


def readiness_gate(verdict_: Column, honesty: Column, accuracy: Column, auc: Column, trades: Column) -> Column:
    """Verdict after the hard gates, with what blocks it."""
    why = reasons(
        (F.coalesce(honesty, F.lit("")) != "PASS", "BACKTEST_HONESTY_NOT_PASS"),
        (F.coalesce(accuracy, F.lit(0.0)) < 0.5, "ACCURACY_BELOW_50"),
        (F.coalesce(auc, F.lit(0.0)) < 0.5, "AUC_BELOW_0_50"),
        (F.coalesce(trades, F.lit(0)) < 50, "COMPLETED_TRADES_BELOW_50"),
    )
    return F.struct(F.when(F.size(why) > 0, "AMBER_WATCHLIST").otherwise(verdict_).alias("verdict"), why.alias("blocking"))


def advisor_blend(base: Column, advice: Column, weight: float, audited: Column) -> Column:
    """Score moved towards the advice (-1 to 1), 0 if it was not audited."""
    return F.when(F.coalesce(audited, F.lit(False)), F.least(F.greatest((1 - weight) * base + weight * (50 + 50 * advice), F.lit(0.0)), F.lit(100.0))).otherwise(0.0)


def sized_verdict(verdict_: Column, multiplier: Column) -> Column:
    """Sizing may lower a verdict, never raise it."""
    return F.when((multiplier <= 0) & verdict_.rlike("^(ELIGIBLE|ACCUMULATE)"), worst_verdict(verdict_, F.lit("AMBER_WATCHLIST"))).otherwise(verdict_)


def honesty_checks(limits: dict[str, float] | None = None) -> Column:
    """Checks over columns oof_coverage, sharpe, mdd_pct, edge, cost, embargo, stress_passed, pbo, dsr, pass_rate."""
    of = {"coverage": 0.5, "sharpe": 0.0, "mdd": 25.0, "pbo": 0.2, "pbo_red": 0.5, "dsr": 0.95, "paths": 0.6} | (limits or {})
    check = lambda name, status: F.struct(F.lit(name).alias("name"), status.alias("status"))
    return F.array(
        check("OOF_COVERAGE", ladder((C("oof_coverage") >= of["coverage"], "PASS"), other="RED")),
        check("SHARPE", ladder((C("sharpe") > of["sharpe"], "PASS"), other="AMBER")),
        check("MAX_DRAWDOWN", ladder((C("mdd_pct") <= of["mdd"], "PASS"), other="RED")),
        check("COST_BUFFER", ladder((C("edge") > 2 * C("cost"), "PASS"), (C("edge") > C("cost"), "AMBER"), other="RED")),
        check("EMBARGO", ladder((C("embargo") > 0, "PASS"), other="AMBER")),
        check("COST_STRESS", ladder((C("stress_passed"), "PASS"), other="AMBER")),
        check("PBO", ladder((C("pbo") <= of["pbo"], "PASS"), (C("pbo") <= of["pbo_red"], "AMBER"), other="RED")),
        check("DEFLATED_SHARPE", ladder((C("dsr") >= of["dsr"], "PASS"), other="AMBER")),
        check("PATH_PASS_RATE", ladder((C("pass_rate") >= of["paths"], "PASS"), other="AMBER")),
    )


def honesty(checks: Column) -> Column:
    return worst_status(F.transform(checks, lambda c: c["status"]))


def honesty_summary(rows: DataFrame) -> DataFrame:
    """Counts over nested checks, the worst status and the largest overfitting probability."""
    each = rows.select("pbo", F.explode("checks").alias("c"))
    worst = F.max(lookup(C("c.status"), STATUS, 0))
    return each.agg(*(F.count_if(C("c.status") == s).alias(s.lower()) for s in STATUS), F.max(F.when(C("pbo").between(0, 1), C("pbo"))).alias("max_pbo"), F.element_at(F.array(*map(F.lit, STATUS)), worst + 1).alias("status"))


def forward_review(days: Column, alpha: Column, violations: Column, missing: Column, mdd: Column, target: Column | int = 30, limit: float = 20.0) -> Column:
    """PASS if enough days, no loss against the benchmark, no violation, nothing missing and a small drawdown."""
    zero = lambda x: F.coalesce(x, F.lit(0))
    return ladder((zero(days) < target, "FAIL"), (zero(alpha) < 0, "FAIL"), (zero(violations) > 0, "FAIL"), (zero(missing) > 0, "FAIL"), (zero(mdd) > limit, "FAIL"), other="PASS")


def sequential_promotion(new: Column, old: Column, weeks: Column, effect: float = 0.02, alpha: float = 0.05, beta: float = 0.20, sequential: bool = True) -> Column:
    """Wald's test on Brier scores (lower is better) of a candidate against the model in use.

    CONTINUE under four weeks and between the bounds. Not ``sequential``: promote beyond five percent.
    """
    import math

    better = old - new
    if not sequential:
        return F.when(better / F.greatest(F.abs(old), F.lit(1e-9)) > 0.05, "PROMOTE").otherwise("STOP")
    sigma = F.sqrt(2.0 * old * F.greatest(1 - old, F.lit(1e-9)) / weeks)
    z = (better - effect) / F.greatest(sigma, F.lit(1e-9))
    return ladder((weeks < 4, "CONTINUE"), (z >= math.log((1 - beta) / alpha), "PROMOTE"), (z <= math.log(beta / (1 - alpha)), "STOP"), other="CONTINUE")


def advisor_route(a: Column, b: Column, confidence_a: Column, confidence_b: Column, apart: float = 0.5, least: float = 0.3) -> Column:
    """deep where two advisors that are sure of it disagree."""
    deep = (F.abs(a - b) > apart) & (confidence_a * confidence_b > least)
    return F.when(F.coalesce(deep, F.lit(False)), "deep").otherwise("shallow")


def policy_verdict(stress: DataFrame, by: Sequence[str]) -> DataFrame:
    """From rows per cost label (base, x2, x5): which levels hold and the verdict."""
    at = lambda label: F.max(F.when(C("label") == label, C("sharpe")))
    agg = stress.groupBy(*by).agg(at("base").alias("base"), at("x2").alias("x2"), at("x5").alias("x5"))
    why = reasons((C("base") <= 0, "BASE_SHARPE"), (C("x2") <= 0, "X2_SHARPE"), (C("x5") <= -0.5, "X5_SHARPE"))
    return agg.withColumn("blockers", why).withColumn("verdict", F.when(F.size("blockers") == 0, "PROMOTE").when(C("base") > 0, "WATCH").otherwise("REJECT"))


def forward_month(ret: Column, mdd: Column) -> Column:
    return F.when((ret >= -0.02) & (mdd >= -0.05), "PASS").otherwise("FAIL")


def sleeve_warnings(weight: Column, ret: Column, heavy: float = 0.20, loss: float = -0.05, cap: float | None = None, floor: float | None = None) -> Column:
    """A heavy sleeve that lost in the month, and breaches of its own cap and floor."""
    rules = [((weight > heavy) & (ret < loss), "FORWARD_LOSS")]
    if cap is not None:
        rules.append((weight > cap, "WEIGHT_CAP_BREACH"))
    if floor is not None:
        rules.append((weight < floor, "WEIGHT_FLOOR_BREACH"))
    return reasons(*rules)


def require_sound(df: DataFrame, least: int = 10) -> DataFrame:
    """The bars, or an error: dates unique per ticker, enough rows, positive prices."""
    found = df.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("d"), F.min("close").alias("low"))
    bad = found.filter((C("n") != C("d")) | (C("n") < least) | ~(C("low") > 0)).select("ticker").limit(5).collect()
    if bad:
        raise ValueError(f"unsound bars: {[r['ticker'] for r in bad]}")
    return df


def candidate_cap(score: Column, failures: Column) -> Column:
    return F.when(F.size(failures) > 0, F.least(score, F.lit(44.0))).otherwise(score)


def order_gate(ticker: Column, restricted: DataFrame | None = None, position_share: Column | None = None, leverage: Column | None = None, move_pct: Column | None = None) -> Column:
    """Compliance reasons over one order's shares of the portfolio and its price move."""
    rules = []
    if position_share is not None:
        rules.append((position_share > 0.10, "SINGLE_POSITION"))
    if leverage is not None:
        rules.append((leverage > 1.0, "LEVERAGE"))
    if move_pct is not None:
        rules.append(((F.upper(ticker).rlike(r"\.(KS|KQ)$")) & (F.abs(move_pct) > 0.30), "PRICE_LIMIT"))
    return reasons(*rules)


def ranked(df: DataFrame, n: int) -> DataFrame:
    """The best ``n`` candidates: verdict, score, expected value, ticker."""
    return df.orderBy(severity(C("verdict")).desc(), F.desc("score"), F.desc("ev_pct"), "ticker").limit(n)


def provider_report(bars: DataFrame, today: Column, least: int = 1, warn: int = 5, fail: int = 365) -> DataFrame:
    """Per ticker: rows, repeated and future dates, nulls, age in days, the status and its evidence.

    Bars may be raw: repeated, with nulls, from any source.
    """
    nulls = sum((F.count_if(C(c).isNull()) for c in ("open", "high", "low", "close", "volume")), F.lit(0))
    agg = bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"), (F.count("date") - F.count_distinct("date")).alias("duplicate_dates"), F.count_if(C("date") > today).alias("future_rows"), nulls.alias("nulls"),
        F.greatest(F.datediff(today, F.max("date")), F.lit(0)).alias("age_days"),
    )
    bad = reasons((C("rows") < least, "row_count"), (C("duplicate_dates") > 0, "duplicate_dates"), (C("future_rows") > 0, "future_rows"), (C("age_days") >= fail, "freshness_days"), (C("nulls") > 0, "null_critical_values"))
    old = C("age_days") > warn
    return agg.withColumn("failures", bad).withColumn("status", ladder((F.size("failures") > 0, "FAIL"), (old, "AMBER"), other="PASS"))


def provider_summary(reports: DataFrame) -> DataFrame:
    """Over a run's reports (with ``provider``): the worst status, providers, fewest rows and greatest age."""
    worst = F.max(F.when(C("status") == "FAIL", 2).when(C("status") == "AMBER", 1).otherwise(0))
    return reports.agg(F.element_at(F.array(F.lit("PASS"), F.lit("AMBER"), F.lit("FAIL")), worst + 1).alias("status"), F.array_sort(F.collect_set("provider")).alias("providers"), F.min("rows").alias("min_rows"), F.max("age_days").alias("max_age_days"))


def candidate_benchmark(candidates: DataFrame, audit: DataFrame, buffer_pct: float = 0.5, horizons: Sequence[int] = (20, 63)) -> DataFrame:
    """Candidates with seven checks, what blocks them, the capped score and the readiness for a manual review.

    ``candidates``: ticker, day, track, raw_score, honesty, return_pct, cv_gap, advisor_score,
    accuracy, auc, alpha_pct, trades; any but the first three may be null. ``audit``: ticker, day.
    """
    seen = audit.select("ticker", "day").distinct().withColumn("_audited", F.lit(True))
    rows = candidates.join(seen, ["ticker", "day"], "left")
    honest = F.coalesce("honesty", F.lit("AMBER"))
    stress = lambda k: F.when(C("return_pct").isNull(), "AMBER").when(C("return_pct") > k * buffer_pct, "PASS").otherwise("FAIL")
    horizon = F.when(C("track") == "S", horizons[0]).otherwise(horizons[1])
    embargo = F.when(C("cv_gap").isNull(), "AMBER").when(C("cv_gap") >= horizon, "PASS").otherwise("FAIL")
    advisor = F.when(C("advisor_score").isNull(), "NOT_APPLICABLE").when(C("_audited"), "PASS").otherwise("FAIL")
    model = reasons((C("accuracy") < 0.5, "ACCURACY_BELOW_50"), (C("auc") < 0.5, "AUC_BELOW_0_50"), (C("alpha_pct") < 0, "ALPHA_NEGATIVE"), (C("trades") < 50, "COMPLETED_TRADES_BELOW_50"))
    rows = rows.withColumns({"_honest": honest, "_x1": stress(1), "_x2": stress(2), "_x3": stress(3), "_embargo": embargo, "_advisor": advisor, "_model": model})
    quality = F.when(F.size("_model") > 0, "AMBER_WATCHLIST").otherwise("PASS")
    ready = (C("_honest") == "PASS") & (C("_x3") == "PASS") & (C("_embargo") == "PASS")
    other = reasons((C("_honest") != "PASS", "BACKTEST_HONESTY"), (C("_x3") == "FAIL", "COST_STRESS_3X"), (C("_embargo") == "FAIL", "EMBARGO_STRESS"), (C("_advisor") == "FAIL", "ADVISOR_AUDIT"))
    names = {"BACKTEST_HONESTY": "_honest", "COST_STRESS_1X": "_x1", "COST_STRESS_2X": "_x2", "COST_STRESS_3X": "_x3", "EMBARGO_STRESS": "_embargo", "ADVISOR_AUDIT": "_advisor"}
    checks = F.array(*(F.struct(F.lit(k).alias("name"), C(v).alias("status")) for k, v in names.items()), F.struct(F.lit("MODEL_QUALITY").alias("name"), quality.alias("status")))
    return rows.select(
        *candidates.columns, checks.alias("checks"), F.concat("_model", other).alias("blocking"), candidate_cap(C("raw_score"), C("_model")).alias("investment_score"), ready.alias("ready"),
        F.when(F.size("_model") > 0, "AMBER_WATCHLIST").when(ready, "PASS").otherwise("FAIL").alias("status"),
    )


def gate_counts(rows: DataFrame, by: Sequence[str] = ("track", "gate")) -> DataFrame:
    """Candidates per track and gate."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))
