"""Factor measures, return statistics and backtest-honesty statistics as aggregates.

Functions take long tables and the columns that key a series; nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import correlation, normal_cdf, normal_ppf, ratio
from .sliding import Step, in_order, slide

YEAR = 252
EPS = 1e-12
EULER = 0.5772156649015329


def average_rank(x: Column, by: Sequence[str], order: str) -> Column:
    """Rank within ``by`` with ties at their mean; ``order`` is the column ranked."""
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count(x).over(Window.partitionBy(*by, order)) - 1) / 2.0


def aligned(left: DataFrame, right: DataFrame, on: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Inner join without null, NaN or infinite values."""
    out = left.join(right, list(on)).dropna()
    for c, kind in out.dtypes:
        if kind == "double":
            out = out.filter(~F.isnan(c) & (F.abs(c) != float("inf")))
    return out


def information_coefficient(df: DataFrame, factor: str, target: str, by: Sequence[str], method: str = "spearman") -> DataFrame:
    """Correlation per group; null for fewer than 3 pairs or no variance."""
    rows = df.select(*by, F.col(factor).alias("f"), F.col(target).alias("r")).dropna()
    if method == "spearman":
        rows = rows.select(*by, average_rank(F.col("f"), by, "f").alias("f"), average_rank(F.col("r"), by, "r").alias("r"))
    enough = (F.count("f") >= 3) & (F.stddev_pop("f") > EPS) & (F.stddev_pop("r") > EPS)
    return rows.groupBy(*by).agg(F.count("f").alias("n"), F.when(enough, correlation(F.col("f"), F.col("r"))).alias("ic"))


def rolling_rank_ic(df: DataFrame, factor: str, target: str, n: int = 21) -> DataFrame:
    """Spearman correlation over each ticker's last n pairs; null without variance in either."""
    rows = df.select("ticker", "date", F.col(factor).cast("double").alias("f"), F.col(target).cast("double").alias("r")).dropna()
    nth = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    out = slide(in_order(rows).withColumn("nth", nth), [Step("ic", "rank_correlation", "f", n, by="r")], ready=True)
    return out.filter(F.col("nth") >= n).select("ticker", "date", "ic")


def information_ratio(ics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ics.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), ratio(F.avg("ic"), F.stddev_samp("ic")).alias("ir"), F.count("ic").alias("n"))


def factor_decay(df: DataFrame, factor: str, horizons: Sequence[int], by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Rank correlation with the return over each horizon."""
    w = Window.partitionBy("ticker").orderBy("date")
    ahead = [F.struct(F.lit(h).alias("horizon"), (F.lead("close", h).over(w) / F.col("close") - 1).alias("ahead")) for h in horizons]
    long = df.select("ticker", "date", factor, F.array(*ahead).alias("a")).select("ticker", "date", factor, F.inline("a"))
    return information_coefficient(long, factor, "ahead", [*by, "horizon"])


def quantile_returns(df: DataFrame, factor: str, target: str, n: int = 5, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Mean return and count per factor bucket: linear quantile edges, right-closed, the lowest
    value in the first bucket, equal edges merged."""
    rows = df.select(*by, F.col(factor).alias("f"), F.col(target).alias("r")).dropna()
    cuts = rows.groupBy(*by).agg(F.percentile("f", F.array(*(F.lit(i / n) for i in range(n + 1)))).alias("cuts"))
    cuts = cuts.withColumn("cuts", F.array_sort(F.array_distinct("cuts")))
    bucket = F.greatest(F.size(F.filter("cuts", lambda c: c < F.col("f"))), F.lit(1))
    return rows.join(cuts, list(by)).groupBy(*by, bucket.alias("bucket")).agg(F.avg("r").alias("mean_return"), F.count("r").alias("n"))


def rank_autocorrelation(df: DataFrame, factor: str, lag: int = 1) -> DataFrame:
    rows = df.select("ticker", "date", F.col(factor).alias("f")).dropna()
    ranked = rows.select("ticker", "date", average_rank(F.col("f"), ["ticker"], "f").alias("k"))
    before = ranked.withColumn("b", F.lag("k", lag).over(Window.partitionBy("ticker").orderBy("date")))
    return before.dropna().groupBy("ticker").agg(correlation(F.col("k"), F.col("b")).alias("rho"), F.count("k").alias("n"))


def half_life(rho: Column) -> Column:
    return F.when((rho > 0) & (rho < 1), math.log(0.5) / F.log(rho))


def admission(ic: Column, ir: Column, crowding: Column, life: Column) -> Column:
    """Whether a new factor is strong, stable, unlike the known ones and slow enough."""
    return (F.abs(ic) >= 0.03) & (ir >= 0.3) & (F.abs(crowding) < 0.7) & (life >= 3)


def crowding(df: DataFrame, factor: str, known: Sequence[str]) -> DataFrame:
    """The largest absolute correlation with known factors."""
    pairs = F.array_compact(F.array(*(F.abs(correlation(F.col(factor), F.col(k))) for k in known)))
    return df.agg(F.array_max(pairs).alias("max_corr"))


def signal_profile(df: DataFrame, signal: str) -> DataFrame:
    """Share of active bars and number of changes per ticker."""
    before = F.lag(signal).over(Window.partitionBy("ticker").orderBy("date"))
    rows = df.select("ticker", F.col(signal).alias("s"), (F.col(signal) != before).alias("moved"))
    return rows.groupBy("ticker").agg(F.avg((F.col("s") != 0).cast("double")).alias("active"), F.count_if("moved").alias("transitions"), F.count("s").alias("n"))


def signal_quality(df: DataFrame, signal: str, ahead: str, window: int = 21, stride: int = 5, least: int = 30) -> DataFrame:
    """Per ticker the rank and plain correlation of a signal with the return to come, and the mean rank correlation of windows over its spread.

    Windows of ``window`` bars start every ``stride`` bars; a bar is sent to the few windows that
    hold it. A correlation needs ``least`` pairs (a window its own length) and variance on both
    sides; the ratio needs five windows. ``df``: ticker, date.
    """
    nth = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1
    rows = df.select("ticker", "date", F.col(signal).cast("double").alias("f"), F.col(ahead).cast("double").alias("r"), nth.alias("at"), F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("bars"))
    known = rows.filter(F.col("f").isNotNull() & F.col("r").isNotNull())
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - (window - 1)) / stride)).cast("int")
    last = F.least(F.floor(F.col("at") / stride), F.ceil((F.col("bars") - window) / stride) - 1).cast("int")  # windows start before the last ``window`` bars
    dealt = known.withColumns({"first": first, "last": last}).filter("first <= last").select("ticker", F.explode(F.sequence("first", "last")).alias("start"), "f", "r")

    def correlations(rows: DataFrame, by: Sequence[str], least: int) -> DataFrame:
        ranked = rows.select(*by, "f", "r", average_rank(F.col("f"), by, "f").alias("a"), average_rank(F.col("r"), by, "r").alias("b"))
        fine = (F.count(F.lit(1)) >= least) & (F.stddev_samp("f") > 1e-9) & (F.stddev_samp("r") > 1e-9)
        return ranked.groupBy(*by).agg(F.when(fine, correlation(F.col("a"), F.col("b"))).alias("rank_ic"), F.when(fine, correlation(F.col("f"), F.col("r"))).alias("ic"))

    windows = correlations(dealt, ["ticker", "start"], window).filter("rank_ic is not null")
    spread = F.stddev_samp("rank_ic")
    ratios = windows.groupBy("ticker").agg(F.count(F.lit(1)).alias("windows"), F.when((F.count(F.lit(1)) >= 5) & (spread > 1e-9), F.avg("rank_ic") / spread).alias("ir"))
    whole = correlations(known, ["ticker"], least)
    return whole.join(ratios, "ticker", "left").select("ticker", "rank_ic", "ic", F.coalesce("windows", F.lit(0)).alias("windows"), "ir")


# --- returns -------------------------------------------------------------------------------


def drawdowns(df: DataFrame, by: Sequence[str], ret: str = "ret", order: str = "date") -> DataFrame:
    """Adds equity (from 1), peak and drawdown. Returns must exceed -1."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("equity", F.exp(F.sum(F.log1p(F.coalesce(ret, F.lit(0.0)))).over(w)))
    return out.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def annualised(df: DataFrame, by: Sequence[str], ret: str = "ret", turnover: str | None = None, cost: str | None = None) -> DataFrame:
    """Mean times 252, population volatility, Sharpe, drawdown, Calmar, hit rate, turnover and cost drag."""
    x, vol = F.col(ret), F.stddev_pop(ret) * YEAR**0.5
    mean, worst = F.avg(ret) * YEAR, F.min("drawdown")
    return drawdowns(df.filter(x.isNotNull()), by, ret).groupBy(*by).agg(
        F.count(x).alias("periods"),
        mean.alias("ann_return"),
        vol.alias("ann_vol"),
        F.when(vol > EPS, mean / vol).otherwise(0.0).alias("sharpe"),
        worst.alias("max_drawdown"),
        F.when(F.abs(worst) > EPS, mean / F.abs(worst)).otherwise(0.0).alias("calmar"),
        F.avg((x > 0).cast("double")).alias("hit_rate"),
        (F.avg(F.coalesce(turnover, F.lit(0.0))) if turnover else F.lit(0.0)).alias("avg_turnover"),
        (F.avg(F.coalesce(cost, F.lit(0.0))) * YEAR if cost else F.lit(0.0)).alias("ann_cost_drag"),
    )


def performance(df: DataFrame, by: Sequence[str], ret: str = "ret", exposure: str | None = None) -> DataFrame:
    """Compounded summary of return series: total and annual return, Sharpe, Sortino, Calmar, drawdown, exposure."""
    x = F.col(ret)
    total = F.exp(F.sum(F.log1p(x))) - 1
    down = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2.0))))
    annual = F.pow(1 + total, YEAR / F.count(x)) - 1
    worst = F.min("drawdown")
    return drawdowns(df.filter(x.isNotNull()), by, ret).groupBy(*by).agg(
        F.count(x).alias("periods"),
        total.alias("total_return"),
        annual.alias("annual_return"),
        (ratio(F.avg(x), F.stddev_pop(x)) * YEAR**0.5).alias("sharpe"),
        (ratio(F.avg(x), down) * YEAR**0.5).alias("sortino"),
        worst.alias("max_drawdown"),
        ratio(annual, F.abs(worst)).alias("calmar"),
        (F.avg((F.col(exposure) != 0).cast("double")) if exposure else F.lit(1.0)).alias("exposure"),
    )


def trade_summary(trades: DataFrame, by: Sequence[str], pnl: str = "pnl") -> DataFrame:
    p = F.col(pnl)
    gain, loss = F.sum(F.when(p > 0, p).otherwise(0.0)), -F.sum(F.when(p < 0, p).otherwise(0.0))
    return trades.groupBy(*by).agg(F.count(p).alias("trades"), F.avg((p > 0).cast("double")).alias("win_rate"), F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p < 0, p)).alias("avg_loss"), ratio(gain, loss).alias("profit_factor"), F.avg(p).alias("expectancy"))


def tail_mean(df: DataFrame, by: Sequence[str], ret: str = "ret", share: float = 0.05) -> DataFrame:
    """Mean of the worst ``share`` of returns by count, at least one."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("k", F.row_number().over(w.orderBy(ret))).withColumn("n", F.count(ret).over(w))
    return ranked.filter(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * share))).groupBy(*by).agg(F.avg(ret).alias("cvar"))


def moments(df: DataFrame, by: Sequence[str], ret: str = "ret") -> DataFrame:
    """Sharpe per period and bias-corrected skewness and kurtosis (3 for a normal)."""
    n = F.count(ret).cast("double")
    skew = F.skewness(ret) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * (F.kurtosis(ret)) + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3
    return df.groupBy(*by).agg(F.count(ret).alias("n_obs"), ratio(F.avg(ret), F.stddev_samp(ret)).alias("sr"), F.when(n > 2, skew).alias("skew"), F.when(n > 3, kurt).alias("kurt"))


def _spread(sr: Column, skew: Column, kurt: Column) -> Column:
    return F.greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, F.lit(EPS))


def probabilistic_sharpe(sr: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Probability that the true ratio exceeds the benchmark (Bailey and Lopez de Prado, 2012)."""
    return F.when(n >= 2, normal_cdf((sr - benchmark) * F.sqrt(n - 1) / F.sqrt(_spread(sr, skew, kurt))))


def expected_best(trials: int, n: Column) -> Column:
    """Expected largest ratio of that many unskilled trials."""
    if trials <= 1:
        return F.lit(0.0)
    keep = lambda p: F.lit(max(min(p, 1 - EPS), EPS))
    top = (1 - EULER) * normal_ppf(keep(1 - 1 / trials)) + EULER * normal_ppf(keep(1 - 1 / (trials * math.e)))
    return top / F.sqrt(n - 1)


def deflated_sharpe(sr: Column, trials: int, n: Column, skew: Column, kurt: Column) -> Column:
    return probabilistic_sharpe(sr, expected_best(trials, n), n, skew, kurt)


def track_record_length(sr: Column, benchmark: Column, skew: Column, kurt: Column, alpha: float = 0.05) -> Column:
    """Observations needed to be sure; null where the ratio does not exceed the benchmark."""
    z = normal_ppf(F.lit(1 - alpha))
    return F.when(sr > benchmark, F.ceil(1 + _spread(sr, skew, kurt) * F.pow(z / (sr - benchmark), F.lit(2.0))))


def overfitting(paths: DataFrame, by: Sequence[str] = (), sharpe: str = "sharpe") -> DataFrame:
    """Share of paths without a positive ratio, 1 without paths, and what it amounts to."""
    pbo = F.coalesce(F.avg((F.col(sharpe) <= 0).cast("double")), F.lit(1.0))
    out = paths.groupBy(*by).agg(F.count(sharpe).alias("paths"), pbo.alias("pbo"), F.avg((F.col(sharpe) > 0).cast("double")).alias("pass_rate"))
    return out.withColumn("status", F.when(F.col("pbo") <= 0.2, "PASS").when(F.col("pbo") <= 0.5, "AMBER").otherwise("RED"))


def brinson(weights: DataFrame) -> DataFrame:
    """Allocation, selection and interaction by date and sector with totals (null sector).

    ``weights``: date, sector, wp, wb, rp, rb.
    """
    total = F.sum(F.col("wb") * F.col("rb")).over(Window.partitionBy("date"))
    parts = weights.select(
        "date", "sector",
        ((F.col("wp") - F.col("wb")) * (F.col("rb") - total)).alias("allocation"),
        (F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"),
        ((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction"),
    )
    sums = [F.sum(c).alias(c) for c in ("allocation", "selection", "interaction")]
    return parts.groupingSets([["date", "sector"], ["date"]], "date", "sector").agg(*sums).withColumn("active", F.col("allocation") + F.col("selection") + F.col("interaction"))


def rolling_regression(df: DataFrame, y: str, x: str, n: int = 60) -> DataFrame:
    """Slope, intercept and R squared of the last n bars, null before."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(n - 1), 0)
    full = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(w) >= n
    return df.select("ticker", "date", *(F.when(full, f(F.col(y), F.col(x)).over(w)).alias(k) for k, f in (("beta", F.regr_slope), ("alpha", F.regr_intercept), ("r2", F.regr_r2))))


def two_factor_regression(df: DataFrame, y: str, x1: str, x2: str, n: int = 60) -> DataFrame:
    """Betas of two factors over the last n bars from windowed covariances in closed form."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(n - 1), 0)
    cov = lambda a, b: F.covar_pop(a, b).over(w)
    det = cov(x1, x1) * cov(x2, x2) - cov(x1, x2) * cov(x1, x2)
    b1 = ratio(cov(x1, y) * cov(x2, x2) - cov(x2, y) * cov(x1, x2), det)
    b2 = ratio(cov(x2, y) * cov(x1, x1) - cov(x1, y) * cov(x1, x2), det)
    full = F.count(F.col(y) + F.col(x1) + F.col(x2)).over(w) >= n
    return df.select("ticker", "date", F.when(full, b1).alias("beta_1"), F.when(full, b2).alias("beta_2"))


def stress_replay(returns: DataFrame, scenarios: DataFrame, by: Sequence[str]) -> DataFrame:
    """Performance inside each scenario (scenario, start, end)."""
    days = scenarios.select("scenario", F.explode(F.sequence("start", "end")).alias("date"))  # so that the join is by equality
    hit = returns.join(days, "date")
    return performance(hit, [*by, "scenario"])


def cost_stress(returns: DataFrame, by: Sequence[str], multipliers: Sequence[float] = (1.0, 2.0, 3.0), cost: str = "cost") -> DataFrame:
    """Metrics at multiples of the cost; PASS while Sharpe stays positive."""
    levels = F.explode(F.array(*(F.lit(float(m)) for m in multipliers))).alias("multiple")
    stressed = returns.select("*", levels).withColumn("net", F.col("ret") - F.col("multiple") * F.col(cost))
    return annualised(stressed, [*by, "multiple"], "net").withColumn("passed", F.col("sharpe") > 0)


def moving_average_sweep(df: DataFrame, windows: Sequence[int], fee: float = 0.0005, top: int | None = 10) -> DataFrame:
    """Equal-weight results of holding above the moving average of the day before, per window length."""
    w = Window.partitionBy("ticker").orderBy("date")
    rules = []
    for n in windows:
        frame = w.rowsBetween(-(n - 1), 0)
        on = F.when(F.count("close").over(frame) >= n, (F.col("close") > F.avg("close").over(frame)).cast("double")).otherwise(0.0)
        rules.append(F.struct(F.lit(n).alias("ma"), on.alias("on")))
    long = df.select("ticker", "date", (F.col("close") / F.lag("close").over(w) - 1).alias("r"), F.array(*rules).alias("x")).select("ticker", "date", "r", F.inline("x"))
    own = Window.partitionBy("ticker", "ma").orderBy("date")
    held = long.withColumn("held", F.coalesce(F.lag("on").over(own), F.lit(0.0)))
    moved = F.abs(F.col("held") - F.coalesce(F.lag("held").over(own), F.lit(0.0)))
    net = held.withColumn("moved", moved).withColumn("net", F.col("held") * F.coalesce("r", F.lit(0.0)) - fee * F.col("moved"))
    daily = net.groupBy("ma", "date").agg(F.avg("net").alias("ret"), F.sum("moved").alias("trades"))
    trades = daily.groupBy("ma").agg(F.sum("trades").alias("trades"))
    out = annualised(daily, ["ma"]).select("ma", "ann_return", "sharpe", "max_drawdown").join(trades, "ma")
    return out if top is None else out.orderBy(F.desc("sharpe"), "ma").limit(top)


def bootstrap_drawdowns(returns: DataFrame, by: Sequence[str], paths: int = 2_000, periods: int | None = None, block: int = 20, seed: int = 7) -> DataFrame:
    """Largest drawdown of circular block-bootstrap paths, at the 50th, 95th and 99th percentile.

    Paths are as long as the series unless ``periods`` is given. A series is one array that
    tasks of 100 paths share; draws are seeded by series and path, so they repeat.
    ``returns``: by, ret, date; returns must exceed -1.
    """
    series = returns.filter(F.col("ret").isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("date", "ret"))).alias("s"))
    own = F.xxhash64(*by, F.lit(seed)).alias("own")
    parts = series.select(*by, own, F.col("s.ret").cast("array<double>").alias("ret"), F.explode(F.sequence(F.lit(0), F.lit(paths - 1), F.lit(100))).alias("first"))
    k = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            worst = []
            for own, ret, first in zip(*(b.column(k + i) for i in range(3)), strict=True):
                x = np.log1p(ret.values.to_numpy())
                size = periods or len(x)
                found = []
                for path in range(first.as_py(), min(first.as_py() + 100, paths)):
                    start = np.random.default_rng([own.as_py() % (1 << 64), path]).integers(0, len(x), -(-size // block))
                    at = (start[:, None] + np.arange(block)).ravel()[:size] % len(x)
                    equity = np.exp(np.cumsum(x[at]))
                    found.append(float((equity / np.maximum.accumulate(equity) - 1).min()))
                worst.append(found)
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(worst, pa.list_(pa.float64()))], names=[*by, "mdd"])

    kinds = ", ".join(f"`{c}` {returns.schema[c].dataType.simpleString()}" for c in by)
    worst = parts.repartition(*by, "first").mapInArrow(run, f"{kinds}, mdd array<double>").select(*by, F.explode("mdd").alias("mdd"))
    return worst.groupBy(*by).agg(F.count("mdd").alias("paths"), *(F.percentile(-F.col("mdd"), F.lit(p)).alias(f"mdd_p{round(100 * p)}") for p in (0.5, 0.95, 0.99)))


def average_rank_auc(df: DataFrame, by: Sequence[str], prob: str = "prob", label: str = "label") -> DataFrame:
    """Brier score, accuracy and AUC (from average ranks) per group."""
    ranked = df.withColumn("k", average_rank(F.col(prob), by, prob))
    pos = F.sum(F.col(label).cast("double"))
    n = F.count(prob).cast("double")
    auc = ratio(F.sum(F.when(F.col(label) == 1, F.col("k"))) - pos * (pos + 1) / 2, pos * (n - pos))
    return ranked.groupBy(*by).agg(F.count(prob).alias("n"), F.avg(F.pow(F.col(prob) - F.col(label), F.lit(2.0))).alias("brier"), F.avg(((F.col(prob) >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"), auc.alias("auc"))


