"""Technical indicators and the feature matrix over the panel.

All windows share one partitioning and order, so the panel is shuffled and sorted once.
Indicators come in levels: what needs another bar, then rolling windows over that, then
what is built from both. Recursive averages are made in one grouped pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bounded, change, ratio
from .panel import BARS, FIELDS, by_ticker, over_last
from .sliding import Step, in_order, slide
from .smoothing import Smoothing, span, wilder

C = F.col
YEAR = 252
RETURNS = (1, 2, 5, 10, 20, 60, 120, 252)
SMAS = (5, 10, 20, 50, 100, 200)
EMAS = (9, 21, 55)
RSIS = (7, 14, 28)


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_ticker())


def sma(x: str | Column, n: int) -> Column:
    x = C(x) if isinstance(x, str) else x
    return over_last(F.avg(x), x, n)


def rolling_sum(x: Column, n: int) -> Column:
    return over_last(F.sum(x), x, n)


def rolling_std(x: Column, n: int) -> Column:
    return over_last(F.stddev_samp(x), x, n)


def rolling_max(x: Column, n: int) -> Column:
    return over_last(F.max(x), x, n)


def rolling_min(x: Column, n: int) -> Column:
    return over_last(F.min(x), x, n)


def zscore(x: Column, n: int) -> Column:
    return ratio(x - sma(x, n), rolling_std(x, n))


def steps(df: DataFrame, *beside: str) -> DataFrame:
    """Columns that need the bar before: true range, moves, directional moves and log return. Columns ``beside`` stay."""
    prior, up, down = lag("close"), C("high") - lag("high"), lag("low") - C("low")
    move = C("close") - prior
    return df.select(
        *BARS,
        *beside,
        prior.alias("prior"),
        lag("high").alias("prior_high"),
        lag("low").alias("prior_low"),
        F.greatest(C("high") - C("low"), F.abs(C("high") - prior), F.abs(C("low") - prior)).alias("tr"),
        F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))).alias("gain"),
        F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))).alias("loss"),
        F.when((up > down) & (up > 0), up).otherwise(0.0).alias("plus_dm"),
        F.when((down > up) & (down > 0), down).otherwise(0.0).alias("minus_dm"),
        F.log(C("close") / prior).alias("log_ret"),
        ((C("high") + C("low") + C("close")) / 3).alias("typical"),
        (C("close") * C("volume")).alias("dollar_volume"),
        F.nullif(C("high") - C("low"), F.lit(0.0)).alias("candle"),
    )


SMOOTHINGS = (
    [Smoothing(f"ema_{n}", "close", span(n), n) for n in (9, 12, 13, 15, 20, 21, 26, 55)]
    + [Smoothing("atr_14", "tr", wilder(14), 14), Smoothing("ema2_15", "ema_15", span(15), 15), Smoothing("ema3_15", "ema2_15", span(15), 15)]
    + [Smoothing(f"{x}_{n}", x, wilder(n), n) for n in RSIS for x in ("gain", "loss")]
    + [Smoothing(f"{x}_14", x, wilder(14), 14) for x in ("plus_dm", "minus_dm")]
)


def _macd(bars: dict[str, np.ndarray]) -> np.ndarray:
    return bars["ema_12"] - bars["ema_26"]


def _dx(bars: dict[str, np.ndarray]) -> np.ndarray:
    plus, minus = bars["plus_dm_14"] / bars["atr_14"], bars["minus_dm_14"] / bars["atr_14"]
    return 100 * np.abs(plus - minus) / np.where(plus + minus != 0, plus + minus, np.nan)


#: MACD's signal and ADX smooth what the others give.
SECOND = [Smoothing("macd_signal_raw", _macd, span(9), 9), Smoothing("adx", _dx, wilder(14), 14)]


def smoothed(df: DataFrame) -> DataFrame:
    """All recursive averages in one pass per ticker, which shares its order with the bars before."""
    return slide(steps(in_order(df)), [s.step for s in (*SMOOTHINGS, *SECOND)], ready=True).withColumn("macd", C("ema_12") - C("ema_26"))


def rsi_raw(n: int) -> Column:
    return 100 - 100 / (1 + ratio(C(f"gain_{n}"), C(f"loss_{n}")))


def rsi(n: int) -> Column:
    return bounded(rsi_raw(n), 0.0, 100.0)


def stochastic_k(n: int = 14) -> Column:
    low = rolling_min(C("low"), n)
    return 100 * ratio(C("close") - low, rolling_max(C("high"), n) - low)


def williams_raw(n: int = 14) -> Column:
    high = rolling_max(C("high"), n)
    return -100 * ratio(high - C("close"), high - rolling_min(C("low"), n))


def williams_r(n: int = 14) -> Column:
    return bounded(williams_raw(n), -100.0, 0.0)


def cci(n: int = 20) -> Column:
    values = F.collect_list("typical").over(by_ticker(n))
    mean = sma("typical", n)
    spread = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / n
    return ratio(C("typical") - mean, 0.015 * spread)


def mfi(n: int = 14) -> Column:
    flow, before = C("typical") * C("volume"), lag("typical")
    up = F.when(C("typical") > before, flow).otherwise(0.0)
    down = F.when(C("typical") < before, flow).otherwise(0.0)
    return up, down


def money_flow_value() -> Column:
    return ((C("close") - C("low")) - (C("high") - C("close"))) / C("candle") * C("volume")


def cmf_raw(n: int = 20) -> Column:
    return ratio(rolling_sum(money_flow_value(), n), rolling_sum(C("volume"), n))


def cmf(n: int = 20) -> Column:
    return bounded(cmf_raw(n), -1.0, 1.0)


def vortex(n: int = 14) -> tuple[Column, Column]:
    total = rolling_sum(C("tr"), n)
    return ratio(rolling_sum(F.abs(C("high") - C("prior_low")), n), total), ratio(rolling_sum(F.abs(C("low") - C("prior_high")), n), total)


def bollinger(n: int = 20, width: float = 2.0) -> dict[str, Column]:
    mid, dev = sma("close", n), width * rolling_std(C("close"), n)
    return {"bb_upper": mid + dev, "bb_mid": mid, "bb_lower": mid - dev, "bb_width": ratio(2 * dev, mid), "bb_pct": ratio(C("close") - (mid - dev), 2 * dev)}


class Measures:
    """Sliding steps by what they measure; each method names a column of the pass, made once."""

    def __init__(self) -> None:
        self.steps: dict[str, Step] = {}

    def _add(self, kind: str, of: str, n: int) -> Column:
        name = f"_{kind}_{of.strip('_')}_{n}"
        self.steps[name] = Step(name, kind, of, n)
        return C(name)

    def mean(self, of: str, n: int) -> Column:
        return self._add("mean", of, n)

    def sum(self, of: str, n: int) -> Column:
        return self._add("sum", of, n)

    def std(self, of: str, n: int) -> Column:
        return self._add("std", of, n)

    def max(self, of: str, n: int) -> Column:
        return self._add("max", of, n)

    def min(self, of: str, n: int) -> Column:
        return self._add("min", of, n)

    def spread(self, of: str, n: int) -> Column:
        return self._add("spread", of, n)

    def lag(self, of: str, n: int = 1) -> Column:
        return self._add("lag", of, n)

    def made(self, to: str, of: Callable[[dict[str, np.ndarray]], np.ndarray]) -> str:
        """A column made from others of the same bar."""
        self.steps[to] = Step(to, "sum", of, 1)
        return to


def raw_features(df: DataFrame, beside: Mapping[str, Column] | None = None) -> DataFrame:
    """All features of the same bar, not yet lagged, beside the bars and the columns ``beside``, windows of ticker and date.

    One shuffle and sort: columns of the bar before are windows in that order, all sliding and
    recursive measures follow in one streamed pass, and the features are a projection over them.
    Numbers of a bar that are not finite count as null, so no feature is infinite either.
    """
    up, down = mfi()
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), C(c)) for c in FIELDS}
    beside = beside or {}
    ready = steps(in_order(df.withColumns(finite)).withColumns(dict(beside)), *beside).withColumns({"flow_up": up, "flow_down": down})
    ready = ready.withColumns(
        {
            "flow": C("typical") * C("volume"), "money_flow": money_flow_value(), "rise": F.abs(C("high") - C("prior_low")), "fall": F.abs(C("low") - C("prior_high")),
            "downside": F.when(C("log_ret") < 0, C("log_ret")).otherwise(0.0), "signed_volume": F.coalesce(F.signum(C("close") - C("prior")), F.lit(0.0)) * C("volume"),
        }
    )
    m = Measures()
    out: dict[str, Column] = {}
    for n in RETURNS:
        out[f"return_{n}d"] = change(C("close"), m.lag("close", n))
        out[f"log_return_{n}d"] = F.log(C("close") / m.lag("close", n))
    out["gap_return"] = C("open") / C("prior") - 1
    out["candle_body_pct"] = F.abs(C("close") - C("open")) / C("candle")
    out["upper_shadow_pct"] = (C("high") - F.greatest("close", "open")) / C("candle")
    out["lower_shadow_pct"] = (F.least("close", "open") - C("low")) / C("candle")
    for n in SMAS:
        out[f"sma_ratio_{n}"] = change(C("close"), m.mean("close", n))
        out[f"sma_slope_{n}"] = change(m.mean("close", n), m.lag(f"_mean_close_{n}", 5))
    for n in EMAS:
        out[f"ema_ratio_{n}"] = change(C("close"), C(f"ema_{n}"))
        out[f"ema_slope_{n}"] = change(C(f"ema_{n}"), m.lag(f"ema_{n}", 5))
    macd = C("ema_12") - C("ema_26")
    out |= {"macd_line": macd / C("close"), "macd_signal": C("macd_signal_raw") / C("close"), "macd_hist": (macd - C("macd_signal_raw")) / C("close"), "adx_14": C("adx")}
    out |= {f"rsi_{n}": rsi_raw(n) for n in RSIS}
    high, low = m.max("high", 14), m.min("low", 14)
    m.made("stoch_raw", lambda x: 100 * (x["close"] - x["_min_low_14"]) / np.where(x["_max_high_14"] != x["_min_low_14"], x["_max_high_14"] - x["_min_low_14"], np.nan))
    out |= {"stoch_k": C("stoch_raw"), "stoch_d": m.mean("stoch_raw", 3), "williams_r_14": -100 * ratio(high - C("close"), high - low)}
    out |= {"cci_20": ratio(C("typical") - m.mean("typical", 20), 0.015 * m.spread("typical", 20)), "roc_10": 100 * change(C("close"), m.lag("close", 10))}
    out |= {"atr_14": C("atr_14"), "atr_pct_14": C("atr_14") / C("close")}
    for n in (10, 20, 60):
        out[f"hist_vol_{n}"] = m.std("log_ret", n) * YEAR**0.5
        out[f"downside_vol_{n}"] = m.std("downside", n) * YEAR**0.5
        out[f"ret_z_{n}"] = ratio(C("log_ret") - m.mean("log_ret", n), m.std("log_ret", n))
    mid, dev = m.mean("close", 20), 2 * m.std("close", 20)
    m.steps["obv"] = Step("obv", "running", "signed_volume")
    out |= {"bb_width": ratio(2 * dev, mid), "bb_pct": ratio(C("close") - (mid - dev), 2 * dev), "obv": C("obv"), "obv_slope_20": change(C("obv"), m.lag("obv", 20))}
    out["vwap_ratio_20"] = change(C("close"), ratio(m.sum("flow", 20), m.sum("volume", 20)))
    out["mfi_14"] = 100 - 100 / (1 + ratio(m.sum("flow_up", 14), m.sum("flow_down", 14)))
    out |= {"volume_ratio_20": ratio(C("volume"), m.mean("volume", 20)), "dollar_volume_20": m.mean("dollar_volume", 20)}
    out |= {"dollar_volume_z_60": ratio(C("dollar_volume") - m.mean("dollar_volume", 60), m.std("dollar_volume", 60)), "cmf_20": ratio(m.sum("money_flow", 20), m.sum("volume", 20))}
    width = F.nullif(4 * C("atr_14"), F.lit(0.0))
    out |= {"kc_pct": (C("close") - (C("ema_20") - 2 * C("atr_14"))) / width, "kc_width": width / C("ema_20")}
    plus, minus = (ratio(m.sum(x, 14), m.sum("tr", 14)) for x in ("rise", "fall"))
    out |= {"vi_plus_14": plus, "vi_minus_14": minus, "vi_diff_14": plus - minus, "trix_15": 100 * change(C("ema3_15"), m.lag("ema3_15"))}
    out |= {"elder_bull_13": (C("high") - C("ema_13")) / C("close"), "elder_bear_13": (C("low") - C("ema_13")) / C("close"), "dpo_20": (C("close") - m.lag("_mean_close_20", 11)) / C("close")}
    for n in (20, 60, 252):
        top, bottom = m.max("high", n), m.min("low", n)
        out |= {f"dist_high_{n}": C("close") / top - 1, f"dist_low_{n}": C("close") / bottom - 1, f"drawdown_{n}": C("close") / top - 1}
    flag = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    out["trend_regime_fast"] = flag((C("close") > m.mean("close", 20)) & (m.mean("close", 20) > m.mean("close", 50)))
    out["trend_regime_slow"] = flag((C("close") > m.mean("close", 50)) & (m.mean("close", 50) > m.mean("close", 200)))
    limits = {f"rsi_{n}": (0.0, 100.0) for n in RSIS} | {"stoch_k": (0.0, 100.0), "stoch_d": (0.0, 100.0), "mfi_14": (0.0, 100.0), "williams_r_14": (-100.0, 0.0), "cmf_20": (-1.0, 1.0)}
    base = slide(ready, [*(s.step for s in (*SMOOTHINGS, *SECOND)), *m.steps.values()], ready=True)
    made = base.select(*BARS, *beside, *(x.alias(k) for k, x in out.items()))
    # as SQL text: one call for each feature instead of one for each operator in it
    return made.selectExpr(*BARS, *beside, *(f"CASE WHEN {k} IS NOT NULL THEN least(greatest({k}, {limits[k][0]}D), {limits[k][1]}D) END AS {k}" if k in limits else k for k in out))


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in BARS and not c.startswith("target_")]


def targets(horizon: int, threshold: float = 0.0) -> dict[str, Column]:
    future = F.lead("close", horizon).over(by_ticker()) / C("close") - 1
    return {"target_return": future, "target_direction": F.when(future.isNotNull(), (future > threshold).cast("int"))}


def feature_matrix(df: DataFrame, horizon: int = 5, lag_by: int = 1, threshold: float = 0.0, with_targets: bool = True, complete: bool = True) -> DataFrame:
    """The features of the bar ``lag_by`` before beside the return to come; rows with any null go.

    Instead of all features the few columns of the later bar move: each bar's features are
    given the date, close and targets of the bar ``lag_by`` after it.

    Without ``complete``, for models that fill in what is missing, rows stay that have half of
    the features, and the last ``horizon`` bars of a ticker without targets.
    """
    later = lambda c, n: F.lead(c, n).over(by_ticker()) if n else C(c)
    then = {"_date": later("date", lag_by), "_close": later("close", lag_by)}
    if with_targets:
        future = later("close", lag_by + horizon) / later("close", lag_by) - 1
        then |= {"target_return": future, "target_direction": F.when(future.isNotNull(), (future > threshold).cast("int"))}
    raw = raw_features(df, then)
    goal = [c for c in then if c.startswith("target_")]
    names = [c for c in raw.columns if c not in BARS and c not in then]
    # a row number keeps the filters above the projection; pushed below it they would compute each feature twice
    rows = raw.withColumn("_row", F.monotonically_increasing_id()).filter("_date is not null and _row >= 0").select("ticker", C("_date").alias("date"), C("_close").alias("close"), *names, *goal)
    return rows.dropna(subset=[*names, *goal] if complete else names, thresh=None if complete else len(names) // 2)
