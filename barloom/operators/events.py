"""Events and text: topics, relevance, sentiment, shocks, regimes and overlays."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, ratio
from .folds import ordered_fold

C = F.col
#: Matches drawn at a time by a bootstrap.
DRAWN = 1 << 18

# Topic keywords and weights.
TOPIC_KEYWORDS = {
    "war_conflict": ("war", "attack", "missile", "invasion", "conflict", "ceasefire", "terror", "military"),
    "pandemic_health": ("pandemic", "covid", "virus", "outbreak", "disease", "lockdown"),
    "central_bank": ("fed", "fomc", "rate", "interest", "inflation", "central bank", "boj", "ecb", "bok"),
    "oil_energy": ("oil", "crude", "opec", "energy", "gas", "middle east", "iran"),
    "fx_currency": ("won", "dollar", "currency", "exchange rate", "usdkrw", "yen"),
    "semiconductor_ai": ("semiconductor", "chip", "hbm", "ai", "nvidia", "samsung", "sk hynix", "memory"),
    "trade_supply": ("export", "import", "tariff", "sanction", "supply chain", "shipping", "port"),
    "politics_policy": ("election", "government", "policy", "regulation", "tax", "budget"),
    "disaster": ("earthquake", "tsunami", "flood", "hurricane", "fire", "disaster"),
}
TOPIC_WEIGHTS = {"war_conflict": 1.00, "pandemic_health": 0.95, "central_bank": 0.80, "oil_energy": 0.75, "fx_currency": 0.70, "semiconductor_ai": 0.65, "trade_supply": 0.65, "politics_policy": 0.55, "disaster": 0.60, "general": 0.30}
HOME_WORDS = ("korea", "south korea", "seoul", "krx", "kospi")
BULL_WORDS = ("growth", "beat", "record", "upgrade", "strong", "surge")
BEAR_WORDS = ("loss", "miss", "lawsuit", "downgrade", "weak", "plunge")


def _once(text: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a text that is computed once per row; written out, each term would lower-case the whole text again."""
    return F.get(F.transform(F.array(text), of), F.lit(0))


def _holds(text: Column, words: Sequence[str]) -> Column:
    return functools.reduce(operator.or_, (F.contains(text, F.lit(w)) for w in words))


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the text."""
    count = lambda low: functools.reduce(operator.add, (F.contains(low, F.lit(w)).cast("int") for w in words))
    return F.coalesce(_once(F.lower(text), count), F.lit(0))


def topics(text: Column) -> Column:
    flags = lambda low: F.array(*(F.when(_holds(low, words), F.lit(t)) for t, words in TOPIC_KEYWORDS.items()))
    found = _once(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array_compact(flags(low)))
    return _once(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("general"))))


def relevance(topics_: Column, volume: Column, diversity: Column, tone: Column, place: Column, headline: Column) -> Column:
    weights = F.create_map(*(F.lit(x) for item in TOPIC_WEIGHTS.items() for x in item))
    best = F.array_max(F.transform(topics_, lambda t: F.coalesce(F.try_element_at(weights, t), F.lit(0.3))))
    home = F.when(_once(F.lower(F.concat_ws(" ", place, headline)), lambda low: _holds(low, HOME_WORDS)), 1.0).otherwise(0.55)
    size = F.log1p(F.greatest(volume, F.lit(0.0))) / F.log1p(F.lit(1000.0))
    spread = F.log1p(F.greatest(diversity, F.lit(0.0))) / F.log1p(F.lit(100.0))
    return clip(0.35 * best + 0.25 * size + 0.20 * spread + 0.10 * F.least(F.abs(tone) / 10, F.lit(1.0)) + 0.10 * home)


def normalised_events(df: DataFrame) -> DataFrame:
    """Topic strings split at ; and , and numbers coerced; a missing ticker means every ticker."""
    number = lambda c, d: F.coalesce(C(c).cast("string").try_cast("double"), F.lit(d)).alias(c)
    parts = F.filter(F.transform(F.split(F.coalesce("topics", F.lit("")), "[;,]"), lambda t: F.trim(t)), lambda t: t != "")
    return df.select("ticker", C("date").cast("date").alias("date"), "headline", "country", number("tone", 0.0), number("volume", 1.0), number("source_diversity", 1.0), F.when(F.size(parts) > 0, parts).otherwise(topics(C("headline"))).alias("topics"))


def event_vector(ret: Column, vol_z: Column) -> Column:
    """Numbers of an event: topic flags, tone, log volume, diversity, relevance, return and volatility around it."""
    flags = [F.array_contains("topics", t).cast("double") for t in ("war_conflict", "pandemic_health", "central_bank", "oil_energy", "semiconductor_ai")]
    return F.array(*flags, C("tone"), F.log1p("volume"), F.log1p("source_diversity"), C("relevance"), ret, vol_z)


def sentiment(texts: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Mean of bull hits less bear hits per key and its label; mixed if both occur and cancel."""
    bull, bear = hits(C(text), BULL_WORDS), hits(C(text), BEAR_WORDS)
    agg = texts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(bull).alias("bull"), F.sum(bear).alias("bear"), F.avg(bull - bear).alias("score"))
    mixed = (C("bull") > 0) & (C("bear") > 0) & (F.abs("score") < 0.1)
    return agg.withColumn("label", F.when(mixed, "mixed").when(C("score") > 0.1, "bullish").when(C("score") < -0.1, "bearish").otherwise("neutral"))


def robust_z(x: Column, n: int, by: str = "ticker") -> tuple[Column, Column, Column, Column]:
    """Median, count, spread of the last n, for ``with_robust_z``."""
    w = Window.partitionBy(by).orderBy("date").rowsBetween(-(n - 1), 0)
    return F.percentile(x, F.lit(0.5)).over(w), F.count(x).over(w), F.stddev_pop(x).over(w), w


def with_robust_z(df: DataFrame, value: str, n: int = 20, name: str = "rz") -> DataFrame:
    """Deviation from the rolling median over 1.4826 times the rolling median of deviations, each from its own median."""
    median, count, spread, w = robust_z(C(value), n)
    least = max(5, n // 3)
    first = df.withColumns({"_m": F.when(count >= least, median), "_s": F.when(count >= least, spread)}).withColumn("_d", F.abs(C(value) - C("_m")))
    mad = 1.4826 * F.when(F.count("_d").over(w) >= least, F.percentile("_d", F.lit(0.5)).over(w))
    scale = F.when(mad > 1e-12, mad).when(C("_s") > 1e-12, C("_s"))
    return first.withColumn(name, F.coalesce((C(value) - C("_m")) / scale, F.lit(0.0))).drop("_m", "_s", "_d")


def volatility_windows(bars: DataFrame, z: float = 3.0, quantile: float = 0.97, least: float = 0.02, gap: int = 2, n: int = 20) -> DataFrame:
    """Runs of shocks at most ``gap`` days apart: direction, peak, compounded return and severity."""
    w = Window.partitionBy("ticker").orderBy("date")
    ret = bars.withColumn("ret", F.coalesce(C("close") / F.lag("close").over(w) - 1, F.lit(0.0))).withColumn("abs_ret", F.abs("ret"))
    scored = with_robust_z(ret, "ret", n).withColumn("rz", F.abs("rz"))
    cut = ret.groupBy("ticker").agg(F.greatest(F.percentile("abs_ret", F.lit(quantile)), F.lit(least)).alias("cut"))
    shocks = scored.join(cut, "ticker").filter(((C("rz") >= z) | (C("abs_ret") >= C("cut"))) & (C("abs_ret") >= least))
    apart = F.datediff("date", F.lag("date").over(w))
    runs = shocks.withColumn("run", F.sum(F.when(apart <= gap, 0).otherwise(1)).over(w))
    whole = F.exp(F.sum(F.log1p("ret"))) - 1
    out = runs.groupBy("ticker", "run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("days"), whole.alias("cum_return"), F.max("abs_ret").alias("peak_abs_ret"), F.max("rz").alias("vol_z_max"))
    severity = 0.6 * F.least(C("vol_z_max") / 5, F.lit(2.0)) + 0.4 * F.least(C("peak_abs_ret") / 0.05, F.lit(2.0))
    return out.withColumn("direction", F.when(C("cum_return") > 0, "UP").otherwise("DOWN")).withColumn("severity", severity).drop("run")


def stable_regimes(signals: DataFrame, confirm: int = 2, cool_off: int = 3) -> DataFrame:
    """Regimes with hysteresis: worse at once; better only after ``confirm`` days in a row and a cool-off."""
    rank = {"GREEN": 0, "RED": 2}

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        i, now, changed, last, run = state
        r = row[2]
        if i < 0:
            now, last = r, r
        i, run = i + 1, run + 1 if r == last else 1
        worse = rank.get(r, 1) > rank.get(now, 1)
        if i and (worse or (r != now and i - changed >= cool_off and run >= confirm)):
            now, changed = r, i
        return (i, now, changed, r, run), (now,)

    rows = signals.select("ticker", "date", C("regime").alias("raw"))
    return ordered_fold(rows, "ticker", ["date"], lambda: (-1, None, 0, None, 0), step, "regime string")


def overlay(bars: DataFrame, target_vol: float = 0.15, window: int = 20, most: float = 1.0, bps: float = 5.0) -> DataFrame:
    """Net returns of weights lagged one bar and scaled to a volatility target, beside buy and hold. Columns: weight."""
    w = Window.partitionBy("ticker").orderBy("date")
    frame = w.rowsBetween(-(window - 1), 0)
    ret = bars.withColumn("ret", F.coalesce(C("close") / F.lag("close").over(w) - 1, F.lit(0.0)))
    vol = ret.withColumn("vol", F.when(F.count("ret").over(frame) >= 5, F.stddev_pop("ret").over(frame)))
    scale = F.coalesce(F.least(ratio(F.lit(target_vol), F.lag("vol").over(w) * 252**0.5), F.lit(most)), F.lit(1.0))
    scaled = vol.withColumn("target", F.least(C("weight") * scale, F.lit(most)))
    held = scaled.withColumn("held", F.coalesce(F.lag("target").over(w), F.lit(1.0)))
    cost = F.abs(C("held") - F.coalesce(F.lag("held").over(w), C("held"))) * bps / 1e4
    return held.withColumn("cost", cost).withColumn("net", C("held") * C("ret") - C("cost")).select("ticker", "date", "ret", "target", "held", "cost", "net")


def breaker(daily: DataFrame, off: float = 0.20, on: float = 0.05) -> DataFrame:
    """Weights set to 0 from a drawdown of ``off`` until it has come back within ``on``."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        equity, peak, cut = state
        peak = max(peak, equity)
        down = equity / peak - 1
        cut = down < -on if cut else down <= -off
        held = 0.0 if cut else row[3]
        return (equity * (1 + held * row[2]), peak, cut), (held,)

    rows = daily.select("ticker", "date", C("ret").cast("double").alias("ret"), C("held").cast("double").alias("wanted"))
    return ordered_fold(rows, "ticker", ["date"], lambda: (1.0, 1.0, False), step, "held double").drop("wanted")


def ticker_context(bars: DataFrame, back: int = 20, n: int = 20) -> DataFrame:
    """Per ticker the return over the last ``back`` bars and the z-score of the last return; 0 where bars are few."""
    w = Window.partitionBy("ticker").orderBy("date")
    frame = w.rowsBetween(-(n - 1), 0)
    rows = bars.withColumns({"ret": F.coalesce(C("close") / F.lag("close").over(w) - 1, F.lit(0.0)), "bars": F.count(F.lit(1)).over(Window.partitionBy("ticker")), "then": F.lag("close", back).over(w)})
    spread = F.stddev_pop("ret").over(frame)
    z = F.when((C("bars") >= n + 2) & (spread > 1e-9), (C("ret") - F.avg("ret").over(frame)) / spread).otherwise(0.0)
    rows = rows.withColumns({"vol_z": z, "back": F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))})
    return rows.filter("back = 1").select("ticker", F.coalesce(C("close") / C("then") - 1, F.lit(0.0)).alias("recent_return"), "vol_z")


def pattern_confidence(low_pct: Column, high_pct: Column) -> Column:
    """high, medium or low by the width of an interval in percent."""
    width = high_pct - low_pct
    return F.when(width > 5, "low").when(width > 2, "medium").otherwise("high")


def supplement(signals: DataFrame) -> DataFrame:
    """Columns that a report adds of pattern signals (ticker, regime, risk_score, expected_return, ci_low, ci_high, reason): null and not available without a regime."""
    there = C("regime").isNotNull()
    shown = {"regime": C("regime"), "score": C("risk_score"), "expected_return_pct": C("expected_return"), "ci": F.array("ci_low", "ci_high"), "confidence": pattern_confidence(C("ci_low"), C("ci_high")), "reason": F.substring("reason", 1, 200)}
    return signals.select("ticker", there.alias("kevpe_available"), *(F.when(there, x).alias(f"kevpe_{c}") for c, x in shown.items()))


def _between(ordered: np.ndarray, at: float) -> float:
    """Value at a place between two of an ordered array, weighed as in Spark's percentile."""
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    return ordered[lo] if lo == hi or ordered[lo] == ordered[hi] else (hi - at) * ordered[lo] + (at - lo) * ordered[hi]


def bootstrap_interval(matches: DataFrame, draws: int = 200, seed: int = 7) -> DataFrame:
    """Percentile interval of the weighted mean return by redrawing matches (group, ret, weight).

    Redraws are made many at a time and summed up beside them; one row per group leaves the task.
    """
    each = matches.filter(C("ret").isNotNull() & (C("weight") > 0)).groupBy("group").agg(F.array_sort(F.collect_list(F.struct(C("ret").cast("double").alias("ret"), C("weight").cast("double").alias("weight")))).alias("m"))
    rows = each.select("group", F.xxhash64("group", F.lit(seed)).alias("own"), C("m.ret").alias("ret"), C("m.weight").alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for own, ret, weight in zip(b.column(1), b.column(2), b.column(3), strict=True):
                x, hi = ret.values.to_numpy(), np.cumsum(weight.values.to_numpy())
                rng, step = np.random.default_rng(own.as_py() % (1 << 64)), max(1, DRAWN // len(x))
                means = []
                for first in range(0, draws, step):
                    at = np.searchsorted(hi, rng.random((min(step, draws - first), len(x))) * hi[-1], side="right")
                    means.append(x[np.minimum(at, len(x) - 1)].mean(axis=1))
                m = np.concatenate(means)
                total, m = np.cumsum(m)[-1], np.sort(m)  # in order, as Spark adds
                found.append((total / draws, *(_between(m, p * (draws - 1)) for p in (0.025, 0.975))))
            columns = np.array(found, np.float64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], names=["group", "mean", "low", "high"])

    kind = matches.schema["group"].dataType.simpleString()
    return rows.mapInArrow(run, f"group {kind}, mean double, low double, high double")
