"""The rule variant of track scores: points from the newest features, a plan of prices, sizes and gates.

Each row is a candidate: ticker, entry, and whatever features there are; a feature that is
null or not there counts as neutral. The short track scores momentum, the long one quality
or, without it, trend and calm. All of it is one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
# Gates from worst to best, and what each track calls them.
GATES = ("ZERO", "RED", "AMBER", "GREEN")
SHORT_NAMES = {"GREEN": "Watch/Buy", "AMBER": "Watch Only", "RED": "Reject", "ZERO": "No Trade"}
LONG_NAMES = {"GREEN": "Eligible/DCA", "AMBER": "Hold/Monitor", "RED": "Reject", "ZERO": "No Action"}


@dataclass(frozen=True)
class Rules:
    """Capital and its shares, the short track's stop, targets, risk per trade and limits, the long track's limits."""

    capital: float = 100_000.0
    short_share: float = 0.20
    long_share: float = 0.75
    cash_share: float = 0.05
    stop: float = 0.04
    tp1: float = 0.05
    tp2: float = 0.10
    risk_per_trade: float = 0.0075
    month_stop: float = -0.05
    least_score: float = 75.0
    least_reward: float = 2.0
    least_volume: float = 5_000_000.0
    open_risk: float = 0.02
    long_score: float = 80.0
    single_name: float = 0.12


def _value(df: DataFrame, name: str, neutral: float) -> Column:
    return F.coalesce(C(name).cast("double"), F.lit(neutral)) if name in df.columns else F.lit(neutral)


def _within(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def short_score(df: DataFrame) -> Column:
    rsi, adx = _within(_value(df, "rsi_14", 50.0), 0.0, 100.0), _within(_value(df, "adx_14", 20.0), 0.0, 60.0)
    volume, band = _within(_value(df, "volume_ratio_20", 1.0), 0.0, 4.0), _within(_value(df, "bb_pct", 0.5), 0.0, 1.0)
    flow, vortex = _within(_value(df, "cmf_20", 0.0), -1.0, 1.0), _value(df, "vi_diff_14", 0.0)
    either = lambda when, yes, no: F.when(when, yes).otherwise(no)
    score = 50.0 + F.when(rsi.between(45, 68), 10.0).when((rsi > 80) | (rsi < 25), -8.0).otherwise(0.0) + F.least(F.lit(12.0), adx / 5) + F.least(F.lit(10.0), volume * 3)
    score = score + either(_value(df, "macd_hist", 0.0) > 0, 8.0, -4.0) + either(_value(df, "return_5d", 0.0) > 0, 8.0, -5.0) + either(_value(df, "sma_ratio_20", 0.0) > 0, 7.0, -4.0)
    score = score + either(band.between(0.35, 0.85), 4.0, -3.0) + _within(flow * 8, -6.0, 8.0) + F.when(vortex > 0.05, 4.0).when(vortex < -0.05, -3.0).otherwise(0.0)
    return _within(score + (_value(df, "prob", 0.5) - 0.5) * 30, 0.0, 100.0)


def long_score(df: DataFrame) -> Column:
    parts = [_value(df, c, 0.0) for c in ("business_quality", "earnings_quality", "balance_sheet", "valuation")]
    quality = 0.35 * parts[0] + 0.25 * parts[1] + 0.20 * parts[2] + 0.20 * parts[3]
    trend = 70.0 + F.when(_value(df, "sma_ratio_200", 0.0) > 0, 8.0).otherwise(-8.0) + F.when(_value(df, "return_20d", 0.0) > 0, 5.0).otherwise(-5.0)
    trend = trend - F.least(F.lit(15.0), F.greatest(F.lit(0.0), _value(df, "hist_vol_20", 0.25) - 0.25) * 35)
    return _within(F.when(F.greatest(*parts) > 0, quality).otherwise(trend) + (_value(df, "prob", 0.5) - 0.5) * 10, 0.0, 100.0)


def size_by_risk(entry: Column, stop: Column, capital: float, risk: float, weight: Column | None = None) -> tuple[Column, Column, Column]:
    """Quantity, its value and its open risk: from the risk of a trade, or from a weight of the capital; zero without a stop below the entry."""
    sound = (entry > 0) & (stop > 0) & (stop < entry)
    by_risk = F.floor(capital * risk / F.nullif(entry - stop, F.lit(0.0)))
    by_weight = None if weight is None else F.floor(capital * _within(weight, 0.0, 1.0) / F.nullif(entry, F.lit(0.0)))
    quantity = by_risk if weight is None else F.when(weight.isNull(), by_risk).otherwise(by_weight)
    quantity = F.when(sound, F.greatest(F.lit(0), quantity)).otherwise(0).cast("long")
    return quantity, quantity * entry, quantity * F.when(sound, entry - stop).otherwise(0.0)


def _worst(*gates: Column) -> Column:
    """The worst of gates given as places in ``GATES``; a null one does not count."""
    return F.element_at(F.array(*map(F.lit, GATES)), F.least(F.lit(3), *gates) + 1)


def short_verdicts(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Candidates (ticker, entry, features; also atr_pct, dollar_volume, monthly_pnl_pct, allow_margin, allow_options where known) on the short track."""
    capital, entry = rules.capital * rules.short_share, C("entry").cast("double")
    allowed = [F.coalesce(C(c), F.lit(False)) for c in ("allow_margin", "allow_options") if c in df.columns]
    unsafe = allowed[0] if len(allowed) == 1 else allowed[0] | allowed[1] if allowed else F.lit(False)
    atr = _value(df, "atr_pct", 0.0)
    stop_pct = F.when(atr > 0, F.greatest(F.lit(rules.stop), 2 * atr)).otherwise(rules.stop)
    rows = df.withColumns({"_score": short_score(df), "_stop": entry * (1 - stop_pct), "_volume": _value(df, "dollar_volume", 0.0), "_month": _value(df, "monthly_pnl_pct", 0.0), "_unsafe": unsafe})
    risk = F.greatest(F.lit(0.0), entry - C("_stop"))
    quantity, value, at_risk = size_by_risk(entry, C("_stop"), capital, rules.risk_per_trade)
    rows = rows.withColumns({"_risk": risk, "_quantity": quantity, "_value": value, "_at_risk": at_risk, "_reward": F.when(risk > 0, (entry * (1 + rules.tp2) - entry) / F.nullif(risk, F.lit(0.0))).otherwise(0.0)})
    bad_entry = entry.isNull() | F.isnan(entry) | (F.abs(entry) == float("inf")) | (entry <= 0) | (C("_stop") >= entry)
    place = lambda when, gate: F.when(when, GATES.index(gate))
    gate = _worst(
        place(bad_entry | C("_unsafe") | (C("_month") <= rules.month_stop), "ZERO"), place((C("_volume") != 0) & (C("_volume") < rules.least_volume), "RED"), place(C("_reward") < rules.least_reward, "AMBER"),
        F.when(C("_score") < rules.least_score, F.when(C("_score") >= 65, 2).otherwise(1)), place(C("_at_risk") > capital * rules.open_risk, "RED"),
    )
    return _shown(rows, "S", gate, SHORT_NAMES, entry * (1 + rules.tp1), entry * (1 + rules.tp2))


def long_verdicts(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Candidates on the long track: fixed stop and targets, a single name's share of the capital."""
    entry = C("entry").cast("double")
    sound = entry.isNotNull() & ~F.isnan(entry) & (F.abs(entry) != float("inf")) & (entry > 0)
    quantity = F.when(sound, F.floor(rules.capital * rules.long_share * rules.single_name / F.nullif(entry, F.lit(0.0)))).otherwise(0).cast("long")
    rows = df.withColumns({"_score": long_score(df), "_stop": entry * 0.88, "_quantity": quantity, "_value": quantity * entry, "_risk": F.lit(0.0), "_at_risk": F.lit(0.0), "_reward": F.lit(0.0)})
    gate = _worst(F.when(~sound, 0), F.when(C("_score") >= rules.long_score, 3).when(C("_score") >= 70, 2).otherwise(1))
    return _shown(rows, "L", gate, LONG_NAMES, entry * 1.10, entry * 1.20)


def _shown(rows: DataFrame, track: str, gate: Column, names: dict[str, str], tp1: Column, tp2: Column) -> DataFrame:
    rows = rows.withColumns({"_gate": gate, "_tp1": tp1, "_tp2": tp2})
    verdict = F.element_at(F.create_map(*(F.lit(x) for item in names.items() for x in item)), C("_gate"))
    return rows.select(
        "ticker", F.lit(track).alias("track"), C("_score").alias("score"), C("_gate").alias("gate"), verdict.alias("verdict"), C("entry").cast("double").alias("entry"), C("_stop").alias("stop"), C("_tp1").alias("tp1"), C("_tp2").alias("tp2"),
        C("_reward").alias("risk_reward"), C("_risk").alias("risk_per_share"), C("_quantity").alias("quantity"), C("_value").alias("position_value"), C("_at_risk").alias("open_risk"),
    )


def portfolio_targets(spark: SparkSession, rules: Rules = Rules()) -> DataFrame:
    """Shares and values of the two tracks and of cash."""
    rows = [("Track-S", rules.short_share), ("Track-L", rules.long_share), ("Cash", rules.cash_share)]
    return spark.createDataFrame([(t, s, s * rules.capital) for t, s in rows], "track string, allocation double, value double")
