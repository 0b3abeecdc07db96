"""Factor library over the panel: technical, formulaic, cross-sectional and trend factors.

Each factor is a function of the panel's columns; ``compute`` evaluates any selection of
them in one pass. Users add their own with ``register``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import change, correlation, ratio, signed_power
from .indicators import C, bollinger, cmf, lag, rolling_std, rolling_sum, rsi, sma, smoothed, steps, vortex
from .panel import by_ticker
from .sliding import Step, slide


@dataclass(frozen=True)
class Factor:
    name: str
    category: str
    lookback: int
    of: Callable[[], Column]
    needs: frozenset[str] = frozenset()


REGISTRY: dict[str, Factor] = {}
#: What ``prepared`` adds only for the factors that need it.
SMOOTHED, RANKS, PEAK, WEEKS, FUNDAMENTALS = "smoothed", "ranks", "peak", "weeks", "fundamentals"


def register(name: str, category: str, lookback: int, *needs: str) -> Callable:
    def add(of: Callable[[], Column]) -> Callable[[], Column]:
        if lookback <= 0:
            raise ValueError("lookback must be positive")
        REGISTRY[name] = Factor(name, category, lookback, of, frozenset(needs))
        return of

    return add


def rank_step(to: str, of: str, n: int = 252, least: int = 10) -> Step:
    """Average-tie rank of the last value among the last n, as a share, for a streamed pass over the bars."""
    return Step(to, "rank", of, n, least=least)


def rolling_rank(x: Column, n: int = 252, least: int = 10) -> Column:
    """The same as a Column; it looks at the whole window for every bar."""
    values = F.collect_list(x).over(by_ticker(n))
    less = F.size(F.filter(values, lambda v: v < x))
    equal = F.size(F.filter(values, lambda v: v == x))
    return F.when(x.isNotNull() & (F.size(values) >= least), (less + (equal + 1) / 2) / F.size(values))


def ts_argmax(x: Column, n: int) -> Column:
    """Place of the first maximum of the last n, from 0."""
    values = F.collect_list(x).over(by_ticker(n))
    return F.when(F.size(values) >= n, (F.array_position(values, F.array_max(values)) - 1).cast("double"))


def rolling_corr(x: Column, y: Column, n: int) -> Column:
    w = by_ticker(n)
    both = F.when(x.isNotNull() & y.isNotNull(), 1)
    return F.when(F.count(both).over(w) >= n, correlation(x, y, w))


for _name, _look, _of, *_needs in (
    ("rsi_14", 14, lambda: rsi(14), SMOOTHED),
    ("macd_histogram", 35, lambda: C("macd") - C("macd_signal_raw"), SMOOTHED),
    ("bb_pct_20", 20, lambda: bollinger()["bb_pct"]),
    ("adx_14", 28, lambda: C("adx"), SMOOTHED),
    ("cmf_20", 20, lambda: cmf()),
    ("volume_ratio_20", 20, lambda: ratio(C("volume"), sma("volume", 20))),
    ("vortex_diff_14", 14, lambda: vortex()[0] - vortex()[1]),
    ("return_5d", 5, lambda: change(C("close"), lag("close", 5))),
    ("sma_ratio_20", 20, lambda: change(C("close"), sma("close", 20))),
):
    register(_name, "technical", _look, *_needs)(_of)


@register("alpha003", "formulaic", 262, RANKS)
def alpha003() -> Column:
    return -rolling_corr(C("rank_open"), C("rank_volume"), 10)


@register("alpha006", "formulaic", 10)
def alpha006() -> Column:
    return -rolling_corr(C("open"), C("volume"), 10)


@register("alpha001", "formulaic", 280, PEAK)
def alpha001() -> Column:
    return C("rank_peak") - 0.5


@register("alpha012", "formulaic", 1)
def alpha012() -> Column:
    return F.signum(C("volume") - lag("volume")) * -(C("close") - lag("close"))


@register("alpha041", "formulaic", 5)
def alpha041() -> Column:
    vwap = ratio(rolling_sum(C("typical") * C("volume"), 5), rolling_sum(C("volume"), 5))
    return F.sqrt(C("high") * C("low")) - vwap


@register("alpha054", "formulaic", 1)
def alpha054() -> Column:
    return ratio(-(C("low") - C("close")) * F.pow("open", 5.0), (C("low") - C("high")) * F.pow("close", 5.0))


@register("alpha101", "formulaic", 1)
def alpha101() -> Column:
    return (C("close") - C("open")) / (C("high") - C("low") + 0.001)


@register("size", "fundamental", 1, FUNDAMENTALS)
def size() -> Column:
    return F.when(C("market_cap") > 0, F.log("market_cap"))


@register("value", "fundamental", 1, FUNDAMENTALS)
def value() -> Column:
    inverse = F.array_compact(F.array(*(F.when(C(c) > 0, 1 / C(c)) for c in ("pe", "pb", "ev_ebitda"))))
    return F.when(F.size(inverse) > 0, F.aggregate(inverse, F.lit(0.0), lambda a, v: a + v) / F.size(inverse))


@register("quality", "fundamental", 1, FUNDAMENTALS)
def quality() -> Column:
    return C("roe") - ratio(C("net_income"), C("ocf"))


@register("momentum_12_1", "price", 252)
def momentum() -> Column:
    return change(lag("close", 21), lag("close", 252))


@register("volatility_60d", "price", 60)
def volatility() -> Column:
    return rolling_std(C("day_return"), 60)


@register("amihud_21", "price", 21)
def amihud() -> Column:
    return sma(ratio(F.abs(C("day_return")), C("dollar_volume")), 21)


@register("trend_cross", "trend", 60, SMOOTHED, WEEKS)
def trend_cross() -> Column:
    """1 while the fast average is above the slow one, RSI is below its ceiling and the closed
    weeks do not fall; 0 before 60 bars. Without enough weeks the regime counts as rising."""
    n = F.row_number().over(by_ticker())
    up = (C("ema_12") > C("ema_26")) & (rsi(14) < 70) & (F.coalesce("weekly_regime", F.lit(1.0)) > 0)
    return F.when(n < 60, 0.0).otherwise(F.coalesce(up.cast("double"), F.lit(0.0)))


def prepared(df: DataFrame, needs: frozenset[str], fundamentals: DataFrame | None = None) -> DataFrame:
    """The panel with what the factors read; fundamentals, one row per ticker, join by ticker."""
    base = (smoothed(df) if SMOOTHED in needs else steps(df)).withColumn("day_return", change(C("close"), C("prior")))
    if RANKS in needs:
        base = slide(base, [rank_step("rank_open", "open"), rank_step("rank_volume", "volume")])
    if PEAK in needs:
        powered = signed_power(F.when(C("day_return") < 0, C("std_20")).otherwise(C("close")), 2.0)
        base = base.withColumn("std_20", rolling_std(C("day_return"), 20)).withColumn("alpha001_in", powered).withColumn("alpha001_peak", ts_argmax(C("alpha001_in"), 5))
        base = slide(base, [rank_step("rank_peak", "alpha001_peak")])
    if WEEKS in needs:
        base = weekly_regime(base).withColumnRenamed("regime", "weekly_regime")
    names = ("market_cap", "pe", "pb", "ev_ebitda", "roe", "net_income", "ocf")
    if FUNDAMENTALS not in needs:
        return base
    if fundamentals is None:
        return base.withColumns({c: F.lit(None).cast("double") for c in names})
    return base.join(fundamentals.select("ticker", *names), "ticker", "left")


def compute(df: DataFrame, names: Sequence[str] | None = None, category: str | None = None, fundamentals: DataFrame | None = None) -> DataFrame:
    chosen = [f for f in REGISTRY.values() if (names is None or f.name in names) and (category is None or f.category == category)]
    if names is not None and (unknown := set(names) - set(REGISTRY)):
        raise KeyError(f"unknown factors: {sorted(unknown)}")
    needs = frozenset().union(*(f.needs for f in chosen))
    return prepared(df, needs, fundamentals).select("ticker", "date", *(f.of().alias(f.name) for f in chosen))


def with_factors(features: DataFrame, bars: DataFrame, names: Sequence[str], fundamentals: DataFrame | None = None) -> DataFrame:
    """A feature table with chosen factors of the same (ticker, date) beside it; null where a factor has none."""
    clash = set(names) & set(features.columns)
    own = compute(bars, names, fundamentals=fundamentals).withColumnsRenamed({c: f"factor_{c}" for c in clash})
    return features.join(own, ["ticker", "date"], "left")


def weekly_regime(df: DataFrame, fast: int = 4, slow: int = 12) -> DataFrame:
    """Per bar, whether the last closed week's fast mean is above the slow one."""
    week = F.date_trunc("week", "date").cast("date")
    weeks = df.groupBy("ticker", week.alias("week")).agg(F.max_by("close", "date").alias("week_close"))
    w = Window.partitionBy("ticker").orderBy("week")
    mean = lambda n: F.avg("week_close").over(w.rowsBetween(-n, -1))
    full = F.count("week_close").over(w.rowsBetween(-slow, -1)) >= slow
    state = weeks.select("ticker", "week", F.when(full, (mean(fast) > mean(slow)).cast("double")).alias("regime"))
    return df.withColumn("week", week).join(state, ["ticker", "week"], "left").drop("week")
