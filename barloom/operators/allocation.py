"""Weights, covariances, costs, rebalancing, sizing and compliance over long tables.

Weights are (date, ticker, weight); returns (date, ticker, ret). Covariances are long
(a, b, value): quadratic in the assets of a book, linear in its days.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lookup, ratio, reasons, strip_market
from ..sources.shared import landed
from .sliding import Step, slide
from .timejoins import target_vs_current

C = F.col
EPS = 1e-12
CASH = "__CASH__"


def covariance(returns: DataFrame, tickers: Sequence[str] | None = None, complete: bool = True) -> DataFrame:
    """Sample covariance and correlation of every pair of assets, quadratic in them.

    Over days on which all assets have a return, or with ``complete`` off over those of the pair.
    """
    rows = returns.filter(C("ret").isNotNull()).select("date", "ticker", "ret")
    if tickers is not None:
        rows = rows.filter(C("ticker").isin(*tickers))
    if complete:
        full = rows.agg(F.count_distinct("ticker").alias("n"))
        days = rows.groupBy("date").agg(F.count_distinct("ticker").alias("k")).crossJoin(full).filter("k = n").select("date")
        rows = rows.join(days, "date", "left_semi")
    return _pairs(rows)


#: Assets of a block, and days of a chunk.
ASSETS, DAYS = 256, 365


def _pairs(rows: DataFrame) -> DataFrame:
    """Covariance and correlation of all pairs of (date, ticker, ret), each over the days that both have.

    Assets are numbered and dealt to blocks. A task multiplies two blocks over a chunk of days
    as matrices with zeros and a mask where a return is missing, so a row is sent once per
    block and the sums of a chunk once per pair. Returns are taken from the asset's mean first.
    """
    kind = rows.schema["ticker"].dataType.simpleString()
    rows = landed(rows, "returns")
    named = rows.groupBy("ticker").agg(F.avg("ret").alias("mean")).withColumn("at", F.row_number().over(Window.orderBy("ticker")) - 1)  # one row per asset
    placed = rows.join(named, "ticker").select("date", "at", (C("ret") - C("mean")).cast("double").alias("ret"), F.floor(C("at") / ASSETS).cast("int").alias("block"), F.floor(F.unix_date(C("date").cast("date")) / DAYS).alias("chunk"))
    blocks = named.select(F.floor(C("at") / ASSETS).cast("int").alias("block")).distinct()
    with_right = blocks.crossJoin(blocks.select(C("block").alias("other"))).filter("block <= other")
    sides = with_right.select("block", F.struct(C("block").alias("i"), C("other").alias("j")).alias("pair")).union(with_right.filter("block < other").select("other", F.struct(C("block").alias("i"), C("other").alias("j"))))
    dealt = placed.join(sides, "block").select(C("pair.i").alias("i"), C("pair.j").alias("j"), "chunk", "date", "at", "ret", "block")

    def gram(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        at, ret, block = (table.column(c).to_numpy() for c in ("at", "ret", "block"))
        _, day = np.unique(table.column("date").to_numpy(), return_inverse=True)
        sides = []
        for own in (i, j):
            x, m = np.zeros((day.max() + 1, ASSETS)), np.zeros((day.max() + 1, ASSETS))
            mine = block == own
            x[day[mine], at[mine] - own * ASSETS], m[day[mine], at[mine] - own * ASSETS] = ret[mine], 1.0
            sides.append((x, m))
        (x, m), (y, k) = sides
        n = m.T @ k
        a, b = np.nonzero(n)
        sums = {"n": n, "sx": x.T @ k, "sy": m.T @ y, "sxx": (x * x).T @ k, "syy": m.T @ (y * y), "sxy": x.T @ y}
        return pa.table({"a": pa.array(a + i * ASSETS), "b": pa.array(b + j * ASSETS)} | {c: pa.array(v[a, b]) for c, v in sums.items()})

    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    sums = dealt.groupBy("i", "j", "chunk").applyInArrow(gram, "a long, b long, " + ", ".join(f"{c} double" for c in names)).groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in names))
    about = lambda s, u, v: C(s) - C(u) * C(v) / C("n")
    vx, vy, cxy = about("sxx", "sx", "sx"), about("syy", "sy", "sy"), about("sxy", "sx", "sy")
    found = sums.select("a", "b", F.when(C("n") > 1, cxy / (C("n") - 1)).alias("cov"), F.when((vx > EPS * C("sxx")) & (vy > EPS * C("syy")), cxy / F.sqrt(vx * vy)).alias("corr"), C("n").cast("long").alias("days"))
    # the pairs of two blocks are found once; of one block both ways
    across = F.floor(C("a") / ASSETS) != F.floor(C("b") / ASSETS)
    found = found.unionByName(found.filter(across).select(C("b").alias("a"), C("a").alias("b"), "cov", "corr", "days"))
    name = lambda c: named.select(C("at").cast("long").alias(c), C("ticker").alias(f"ticker_{c}"))
    out = found.join(name("a"), "a").join(name("b"), "b")
    return landed(out.select(C("ticker_a").cast(kind).alias("a"), C("ticker_b").cast(kind).alias("b"), "cov", "corr", "days"), "pairs")


def shrunk(cov: DataFrame, share: float = 0.3) -> DataFrame:
    """Off-diagonal values shrunk to 0, variances that are not positive replaced by the median one."""
    diag = cov.filter("a = b").select(C("a").alias("k"), C("cov").alias("v"))
    middle = diag.filter(C("v") > EPS).agg(F.percentile("v", F.lit(0.5)).alias("mid"))
    j = cov.crossJoin(middle)
    off = F.coalesce("cov", F.lit(0.0)) * (1 - share)
    return j.select("a", "b", F.when(C("a") != C("b"), off).when(C("cov") > EPS, C("cov")).otherwise(F.coalesce("mid", F.lit(1e-6))).alias("cov"))


def correlation_distance(cov: DataFrame) -> DataFrame:
    """Correlation, within 0.999 off the diagonal, and sqrt((1 - corr) / 2)."""
    var = cov.filter("a = b").select(C("a").alias("k"), F.sqrt(F.greatest("cov", F.lit(EPS))).alias("s"))
    j = cov.join(var.select(C("k").alias("a"), C("s").alias("sa")), "a").join(var.select(C("k").alias("b"), C("s").alias("sb")), "b")
    rho = F.least(F.greatest(F.coalesce(C("cov") / (C("sa") * C("sb")), F.lit(0.0)), F.lit(-0.999)), F.lit(0.999))
    return j.select("a", "b", F.when(C("a") == C("b"), 1.0).otherwise(rho).alias("corr")).withColumn("distance", F.sqrt(F.greatest((1 - C("corr")) / 2, F.lit(0.0))))


def _shares(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    raw = df.withColumn("_v", value)
    total = raw.groupBy(*by).agg(F.sum("_v").alias("_t"))
    return (raw.join(total, list(by)) if by else raw.crossJoin(total)).withColumn("weight", ratio(C("_v"), C("_t"))).drop("_v", "_t")


def inverse_variance(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    var = returns.groupBy(*by, "ticker").agg(F.var_samp("ret").alias("variance"))
    return _shares(var, 1 / F.greatest("variance", F.lit(EPS)), by).select(*by, "ticker", "weight")


def inverse_cvar(returns: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Weights by one over the mean loss of the returns at or below their alpha quantile."""
    cut = returns.groupBy("ticker").agg(F.percentile("ret", F.lit(alpha)).alias("cut"))
    tail = returns.join(cut, "ticker").filter(C("ret") <= C("cut")).groupBy("ticker").agg((-F.avg("ret")).alias("cvar"))
    return _shares(tail, 1 / F.greatest("cvar", F.lit(1e-6))).select("ticker", "cvar", "weight")


def portfolio_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Return per day of weights held (ticker, weight) or dated (date, ticker, weight)."""
    on = ["date", "ticker"] if "date" in weights.columns else ["ticker"]
    return returns.join(weights, on).groupBy("date").agg(F.sum(C("weight") * C("ret")).alias("ret"))


def portfolio_cvar(daily: DataFrame, alpha: float = 0.05, least: int = 20) -> DataFrame:
    cut = daily.agg(F.percentile("ret", F.lit(alpha)).alias("cut"), F.count("ret").alias("n"))
    return daily.crossJoin(cut).agg(F.when(F.max("n") >= least, -F.avg(F.when(C("ret") <= C("cut"), C("ret")))).otherwise(0.0).alias("cvar"))


def turnover(target: DataFrame, current: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    move = F.abs(C("target") - C("current"))
    return target_vs_current(target, current).agg(F.sum(move).alias("turnover"), (F.sum(move) * cost_bps / 1e4).alias("cost"))


def capped_turnover(target: DataFrame, current: DataFrame, cap: float) -> DataFrame:
    """Weights moved towards the target as far as the cap allows."""
    both = target_vs_current(target, current)
    total = both.agg(F.sum(F.abs(C("target") - C("current"))).alias("total"))
    scale = F.when(C("total") > cap + EPS, cap / C("total")).otherwise(1.0)
    return both.crossJoin(total).withColumn("weight", C("current") + scale * (C("target") - C("current"))).select("ticker", "weight")


def turnover_shrink(target: DataFrame, current: DataFrame, penalty: float) -> DataFrame:
    """The blend of target and current that balances squared error against L1 turnover, in closed form."""
    both, d = target_vs_current(target, current), C("target") - C("current")
    total = both.agg(ratio(F.sum(F.abs(d)), 2 * F.sum(d * d)).alias("share"))
    alpha = F.greatest(F.lit(0.0), 1 - penalty * C("share"))
    return both.crossJoin(total).withColumn("weight", C("current") + F.coalesce(alpha, F.lit(1.0)) * d).select("ticker", "weight")


def capped(weights: DataFrame, cap: float, by: Sequence[str], budget: float = 1.0, rounds: int = 20) -> DataFrame:
    """Long-only weights that sum to the budget, none above the cap: excess goes to the others by room.

    One array per book, folded in at most ``rounds`` steps.
    """
    positive = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    book = weights.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ticker", positive.alias("w")))).alias("b"))
    total = lambda ws: F.aggregate(ws, F.lit(0.0), lambda a, x: a + x)
    ws = F.transform("b", lambda s: s["w"])
    start = F.when(total(ws) > EPS, F.transform(ws, lambda x: x / total(ws) * budget)).otherwise(F.transform(ws, lambda x: F.lit(budget) / F.size("b")))

    def step(a: Column, _: Column) -> Column:
        excess = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.greatest(x - cap, F.lit(0.0)))
        room = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.greatest(cap - x, F.lit(0.0)))
        moved = F.transform(a, lambda x: F.when(x > cap, cap).otherwise(x + F.when(room > EPS, excess * (cap - x) / room).otherwise(0.0)))
        return F.when(excess > EPS, moved).otherwise(a)

    folded = book.withColumn("w", start).withColumn("w", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), C("w"), step))
    return folded.select(*by, F.inline(F.arrays_zip(F.transform("b", lambda s: s["ticker"]).alias("ticker"), C("w").alias("weight"))))


def orders(target: DataFrame, current: DataFrame, value: float, least: float = 100.0, cost_share: float = 0.0) -> DataFrame:
    """Trades from current values (ticker, value) to target weights (ticker, target_weight, price)."""
    positive = F.greatest("target_weight", F.lit(0.0))
    total = target.agg(F.sum(positive).alias("total"))
    t = target.crossJoin(total).select("ticker", "price", (ratio(positive, C("total")) * value).alias("target_value"))
    both = t.join(current.select("ticker", C("value").alias("held")), "ticker", "full_outer")
    delta = F.coalesce("target_value", F.lit(0.0)) - F.coalesce("held", F.lit(0.0))
    floor = max(least, cost_share * value * 0.5)
    quantity = F.abs(delta) / F.when(C("price") > 0, C("price")).otherwise(1.0)
    kept = both.withColumn("delta", delta).filter(F.abs(delta) >= floor)
    return kept.select("ticker", F.when(C("delta") > 0, "BUY").otherwise("SELL").alias("side"), quantity.alias("quantity"), F.coalesce("target_value", F.lit(0.0)).alias("target_value"), "delta")


def signal_weights(signals: DataFrame, gross: float = 1.0, cap: float = 0.25, long_short: bool = False) -> DataFrame:
    """Weights from gated scores (date, ticker, score, trade) with the rest in cash."""
    used = F.when(C("trade"), C("score") if long_short else F.greatest("score", F.lit(0.0))).otherwise(0.0)
    size = F.sum(F.abs("used")).over(Window.partitionBy("date"))
    raw = signals.withColumn("used", used).withColumn("weight", F.coalesce(ratio(C("used"), size) * gross, F.lit(0.0)))
    held = raw.select("date", "ticker", F.least(F.greatest("weight", F.lit(-cap)), F.lit(cap)).alias("weight"))
    rest = held.groupBy("date").agg((1 - F.sum(F.abs("weight"))).alias("weight")).select("date", F.lit(CASH).alias("ticker"), "weight")
    return held.unionByName(rest)


def beta_hedge(weights: DataFrame, returns: DataFrame, market: DataFrame, hedge: str, limit: float = 1.0, least: int = 30) -> DataFrame:
    """Weights with a hedge leg that offsets their beta; assets with fewer than ``least`` days count as 1."""
    pairs = returns.join(market.select("date", C("ret").alias("m")), "date")
    beta = pairs.groupBy("ticker").agg(F.when(F.count("m") >= least, ratio(F.covar_samp("ret", "m"), F.var_samp("m"))).alias("beta"))
    total = weights.join(beta, "ticker", "left").agg(F.sum(C("weight") * F.coalesce("beta", F.lit(1.0))).alias("b"))
    leg = total.select(F.lit(hedge).alias("ticker"), F.least(F.greatest(-C("b"), F.lit(-limit)), F.lit(limit)).alias("weight"))
    return weights.select("ticker", "weight").unionByName(leg)


def regime_moments(returns: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean and volatility per regime and asset. ``labels``: date, regime."""
    return returns.join(labels, "date").groupBy("regime", "ticker").agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("vol"), F.count("ret").alias("n"))


def regime_mix(moments: DataFrame, probabilities: DataFrame) -> DataFrame:
    """Moments weighted by the regimes' probabilities (regime, p)."""
    j = moments.join(probabilities, "regime").groupBy("ticker").agg(F.sum(C("p") * C("mean")).alias("mean"), F.sum(C("p") * (C("vol") ** 2 + C("mean") ** 2)).alias("second"))
    return j.select("ticker", "mean", F.sqrt(F.greatest(C("second") - C("mean") ** 2, F.lit(0.0))).alias("vol"))


# --- conformal sizing ----------------------------------------------------------------------


def sorted_quantile(values: Column, level: Column, higher: bool = False) -> Column:
    """Quantile of a sorted array: linear, or the next value above."""
    at = level * (F.size(values) - 1)
    low, top = F.floor(at).cast("int"), F.ceil(at).cast("int")
    if higher:
        return F.get(values, top)
    return F.get(values, low) + (at - low) * (F.get(values, top) - F.get(values, low))


def conformal_quantiles(residuals: DataFrame, alpha: float = 0.1, least: int = 30) -> DataFrame:
    """Per (regime, horizon) the finite-sample quantile of |residual|, that of the horizon where few.

    Each pool is ranked in a window, so a pool may be of any size; the linear quantile lies
    between the two ranks around its level.
    """
    sizes = lambda *by: Window.partitionBy(*by)

    def of(*by: str) -> DataFrame:
        rows = residuals.select(*by, F.abs("residual").alias("v")).filter("v is not null")
        ranked = rows.withColumn("k", F.row_number().over(sizes(*by).orderBy("v")) - 1).withColumn("n", F.count(F.lit(1)).over(sizes(*by)))
        at = F.least(F.lit(1.0), F.ceil((C("n") + 1) * (1 - alpha)) / C("n")) * (C("n") - 1)
        near = ranked.withColumn("at", at).filter(C("k").between(F.floor("at"), F.ceil("at")))
        low, top = F.min("v"), F.max("v")
        return near.groupBy(*by).agg(F.max("n").alias("n"), (low + (F.max("at") - F.floor(F.max("at"))) * (top - low)).alias("q"))

    every = of("horizon").select("horizon", C("q").alias("q_all"))
    return of("regime", "horizon").join(every, "horizon").select("regime", "horizon", "n", F.when(C("n") >= least, C("q")).otherwise(C("q_all")).alias("q"), (C("n") < least).alias("fallback"))


def confidence(score: Column, q: Column) -> Column:
    """1 less the interval's half width over the score; 0 where the interval holds 0."""
    holds = (score - q <= 0) & (score + q >= 0)
    return F.when(holds, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - q / F.greatest(F.abs(score), F.lit(1e-9))))


def size_multiplier(scores: DataFrame, by: Sequence[str] = ("ticker",), crisis: str = "crisis_prob") -> DataFrame:
    """Product of confidences times the agreement of signs, closed in a crisis. Columns: score, q."""
    conf = confidence(C("score"), C("q"))
    product = F.when(F.min(conf) > 0, F.exp(F.sum(F.log(conf)))).otherwise(0.0)
    gate = F.when(F.max(crisis) < 0.5, 1.0).otherwise(0.0)
    return scores.groupBy(*by).agg((product * F.abs(F.avg(F.signum("score"))) * gate).alias("multiplier"))


def coverage(residuals: DataFrame, quantiles: DataFrame, claimed: float = 0.9, tolerance: float = 0.05) -> DataFrame:
    """Share of residuals within their quantile against the share claimed."""
    hit = (F.abs("residual") <= C("q")).cast("double")
    out = residuals.join(quantiles.select("regime", "horizon", "q"), ["regime", "horizon"]).groupBy("regime", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("covered"))
    return out.withColumn("honest", C("covered") >= claimed - tolerance)


def conformal_gate(panel: DataFrame, window: int = 250, alpha: float = 0.2, cost: float = 0.0) -> DataFrame:
    """Per ticker and date: lower bound of the edge from the residuals known by then; trade if above cost.

    ``panel``: ticker, date, edge_hat, fwd_return, known residuals are those of earlier dates.
    """
    rows = panel.withColumn("_missed", C("edge_hat") - C("fwd_return"))
    steps = [Step("_known", "lag", "_missed", 1), Step("q", "quantile", "_known", window, least=20, q=1 - alpha)]
    out = slide(rows, steps).drop("_missed", "_known")
    bound = C("edge_hat") - C("q")
    return out.withColumn("lower", bound).withColumn("trade", F.coalesce(bound > cost, F.lit(False)))


# --- book ----------------------------------------------------------------------------------


def book_summary(positions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Open and closed counts, value, profit and warnings. Columns: ticker, status, quantity, price, entry."""
    open_ = C("status") == "OPEN"
    value, pnl = C("quantity") * C("price"), C("quantity") * (C("price") - C("entry"))
    return positions.groupBy(*by).agg(F.count_if(open_).alias("open"), F.count_if(~open_).alias("closed"), F.coalesce(F.sum(F.when(open_, value)), F.lit(0.0)).alias("value"), F.coalesce(F.sum(F.when(open_, pnl)), F.lit(0.0)).alias("unrealised"), F.array_sort(F.collect_set(F.when(open_ & (C("price") < 0.95 * C("entry")), C("ticker")))).alias("warnings"))


def exposure(positions: DataFrame, sectors: DataFrame, value: float) -> DataFrame:
    """Value and weight per sector with beta, by the ticker without its market suffix. Unknown sectors are OTHER."""
    named = positions.withColumn("key", strip_market(C("ticker"))).join(sectors.select(C("ticker").alias("key"), "sector", "beta"), "key", "left")
    worth = C("quantity") * C("price")
    out = named.groupBy(F.coalesce("sector", F.lit("OTHER")).alias("sector")).agg(F.sum(worth).alias("value"), F.max(worth).alias("largest"), ratio(F.sum(worth * F.coalesce("beta", F.lit(1.0))), F.sum(worth)).alias("beta"))
    return out.withColumn("weight", C("value") / value)


def portfolio_analytics(positions: DataFrame, sectors: DataFrame, capital: float, by: Sequence[str] = (), limits: dict[str, float] | None = None) -> DataFrame:
    """Exposure, cash, largest position and sector, value-weighted beta, value at risk, drawdown and what calls for a rebalance.

    ``positions``: ticker, track, status, quantity, price, entry, best (the highest move since
    entry) and vol, which may be null (0.02 a day); only open ones count. ``sectors``: ticker,
    sector, beta; unknown tickers are OTHER with beta 1.
    """
    of = {"total": 0.60, "S": 0.20, "L": 0.75, "sector": 0.30, "cash": 0.05} | (limits or {})
    open_ = positions.filter("status = 'OPEN'").join(sectors, "ticker", "left").withColumns({"sector": F.coalesce("sector", F.lit("OTHER")), "worth": C("quantity") * C("price")})
    share = lambda x: F.coalesce(x, F.lit(0.0)) / capital
    per = open_.groupBy(*by, "sector").agg(F.sum("worth").alias("w")).groupBy(*by).agg(F.max_by("sector", F.struct("w", "sector")).alias("top_sector"), F.max("w").alias("top"), F.sum("w").alias("every"))
    peak = F.sum(F.when((C("entry") > 0) & (C("quantity") > 0), C("entry") * (1 + C("best")) * C("quantity")))
    weighted = F.when(C("worth") > 0, C("worth"))
    book = open_.groupBy(*by).agg(
        F.sum("worth").alias("value"), *(F.sum(F.when(C("track") == t, C("worth"))).alias(f"track_{t}") for t in ("S", "L")), F.max("worth").alias("largest"), peak.alias("peak"),
        F.coalesce(ratio(F.sum(weighted * F.coalesce("beta", F.lit(1.0))), F.sum(weighted)), F.lit(1.0)).alias("beta"), (1.65 * F.avg(F.coalesce("vol", F.lit(0.02)))).alias("var_1d_95"),
    )
    both = book.join(per, list(by)) if by else book.crossJoin(per)
    rows = both.select(
        *by, share(C("value")).alias("exposure"), share(C("track_S")).alias("exposure_s"), share(C("track_L")).alias("exposure_l"), (1 - share(C("value"))).alias("cash"), share(C("largest")).alias("max_position"),
        "top_sector", ratio(C("top"), C("every")).alias("concentration"), "beta", "var_1d_95", F.coalesce(F.when(C("peak") > 0, (C("peak") - C("value")) / C("peak")), F.lit(0.0)).alias("drawdown"),
    )
    why = reasons((C("exposure_s") > of["S"], "TRACK_S"), (C("exposure_l") > of["L"], "TRACK_L"), (C("exposure") > of["total"], "TOTAL"), (C("concentration") > of["sector"], "SECTOR"), (C("cash") < of["cash"], "CASH"))
    return rows.withColumn("rebalance", why)


def advisor_blend(outputs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Confidence- and weight-weighted mean of advisor scores, within one. Columns: ticker, advisor, score, confidence."""
    w = C("confidence") * lookup(C("advisor"), weights, 1.0)
    mean = F.coalesce(ratio(F.sum(C("score") * w), F.sum(w)), F.lit(0.0))
    return outputs.groupBy("ticker").agg(F.least(F.greatest(mean, F.lit(-1.0)), F.lit(1.0)).alias("score"), F.count(F.lit(1)).alias("advisors"))


def posterior_weights(rewards: DataFrame, prior: float = 1.0) -> DataFrame:
    """Beta-Bernoulli posterior per advisor and weights by its mean. Columns: advisor, reward."""
    won = F.count_if(C("reward") > 0.5)
    post = rewards.groupBy("advisor").agg((won + prior).alias("a"), (F.count_if(C("reward") <= 0.5) + prior).alias("b"))
    return _shares(post.withColumn("mean", C("a") / (C("a") + C("b"))), C("mean"))


def attribution(rows: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Mean absolute contribution of each feature of a linear model per ticker."""
    each = [F.struct(F.lit(k).alias("feature"), (float(v) * (C(k) - F.avg(k).over(Window.partitionBy("ticker")))).alias("x")) for k, v in coefficients.items()]
    return rows.select("ticker", F.array(*each).alias("e")).select("ticker", F.inline("e")).groupBy("ticker", "feature").agg(F.avg(F.abs("x")).alias("mean_abs"))
