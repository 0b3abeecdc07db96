"""Market-regime features, the meta panel, forecast paths and regime diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .learning import balanced, linear_probability
from .panel import by_ticker
from .smoothing import look_back, span

C = F.col
YEAR = 252


def market_features(returns: DataFrame) -> DataFrame:
    """Per date over all tickers: mean returns, volatility, drawdown and dispersion; dates that lack any go.

    ``returns``: ticker, date, ret. Windows run over one row per date.
    """
    daily = returns.filter("ret is not null").groupBy("date").agg(F.avg("ret").alias("market"), F.stddev_samp("ret").alias("apart"))
    order = Window.orderBy("date")

    def last(n: int, least: int, of: Column, x: str) -> Column:
        w = order.rowsBetween(-(n - 1), 0)
        return F.when(F.count(x).over(w) >= least, of.over(w))

    rows = daily.withColumn("nav", F.exp(F.sum(F.log1p("market")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return rows.select(
        "date", last(5, 3, F.avg("market"), "market").alias("mkt_ret_5"), last(21, 10, F.avg("market"), "market").alias("mkt_ret_21"), (last(21, 10, F.stddev_pop("market"), "market") * YEAR**0.5).alias("vol_21"),
        (last(63, 20, F.stddev_pop("market"), "market") * YEAR**0.5).alias("vol_63"), (C("nav") / last(63, 20, F.max("nav"), "nav") - 1).alias("drawdown_63"), last(21, 10, F.avg("apart"), "apart").alias("dispersion_21"),
    ).dropna()


def weighted_mean(x: str, alpha: float, least: int) -> Column:
    """Exponentially weighted mean of a column without nulls, weights summing to one, over a bounded look-back."""
    values = F.collect_list(x).over(by_ticker(look_back(alpha)))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    mean = F.aggregate(values, start, lambda a, v: F.struct((a["s"] * (1 - alpha) + v).alias("s"), (a["w"] * (1 - alpha) + 1).alias("w")), lambda a: a["s"] / a["w"])
    return F.when(F.count(x).over(by_ticker(least)) >= least, mean)


def meta_panel(bars: DataFrame, horizon: int, cost_bps: float = 5.0) -> DataFrame:
    """Momentum, volatility and a clipped score per bar, its realised edge and whether that beat the cost.

    Rows that lack a feature go; the newest rows have no forward return and the label 0.
    """
    then = lambda n: C("close") / F.lag("close", n).over(by_ticker()) - 1
    vol = lambda n, least: F.when(F.count("ret_1").over(by_ticker(n)) >= least, F.stddev_pop("ret_1").over(by_ticker(n)) * YEAR**0.5)
    rows = bars.select("ticker", "date", "close", F.coalesce(then(1), F.lit(0.0)).alias("ret_1"), then(5).alias("ret_5"), then(21).alias("ret_21"), then(63).alias("ret_63"), (F.lead("close", horizon).over(by_ticker()) / C("close") - 1).alias("fwd_return"))
    rows = rows.withColumns({"vol_20": vol(20, 10), "vol_60": vol(60, 20), "drift": weighted_mean("ret_1", span(20), 10)})
    score = 0.50 * C("ret_21") + 0.25 * C("ret_5") + 0.25 * C("drift") * horizon
    rows = rows.withColumn("primary_score", F.when(score.isNotNull(), F.least(F.greatest(score, F.lit(-0.12)), F.lit(0.12))))
    edge = F.signum("primary_score") * C("fwd_return")
    out = rows.withColumns({"edge_hat": F.abs("primary_score"), "signed_realized_edge": edge, "meta_label": F.coalesce((edge > cost_bps / 1e4).cast("double"), F.lit(0.0)), "cost_return": F.lit(cost_bps / 1e4)})
    return out.drop("drift").dropna(subset=["primary_score", "vol_20", "vol_60", "ret_5", "ret_21", "ret_63"])


def meta_probabilities(train: DataFrame, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with ``meta_prob``: a balanced logistic model of the label, or its mean where there is too little to fit.

    Rows are scored by the model's coefficients; a null feature counts as 0.
    """
    known = train.dropna(subset=[*features, "meta_label"]).withColumn("label", C("meta_label").cast("int"))
    seen = known.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"), F.avg("label").alias("mean")).first()
    if seen["n"] < 50 or seen["labels"] < 2:
        return rows.withColumn("meta_prob", F.lit(0.5 if seen["mean"] is None else float(seen["mean"])))
    model = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", regParam=0.01, maxIter=50),
    ]).fit(balanced(known))
    return rows.fillna(0.0, subset=list(features)).withColumn("meta_prob", linear_probability(model, features))


def forecast_path(returns: DataFrame, horizon: int, rebalance_days: int, decay: float, shrink: float) -> DataFrame:
    """Expected return of each ticker's next steps: recent weighted mean and long mean, blended, fading step by step."""
    w = Window.partitionBy("ticker")
    rows = returns.filter("ret is not null").withColumns({"n": F.count(F.lit(1)).over(w), "back": F.row_number().over(w.orderBy(F.desc("date"))) - 1})
    width = F.least(F.lit(60), F.greatest(F.lit(10), F.floor(C("n") / 3)))
    weight = F.pow(1 - 2.0 / (width + 1), C("back"))
    base = rows.groupBy("ticker").agg(F.when(F.max("n") >= 10, F.sum(weight * C("ret")) / F.sum(weight)).alias("recent"), F.avg(F.when(C("back") < YEAR, C("ret"))).alias("past"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("h")
    daily = (1 - shrink) * C("recent") + shrink * C("past")
    return base.select("ticker", daily.alias("daily"), steps).select("ticker", (C("h") + 1).alias("step"), (C("daily") * rebalance_days * F.pow(F.lit(decay), C("h"))).alias("forecast"))


def momentum_diagnostics(bars: DataFrame, month: int = 21) -> DataFrame:
    """Return over one and three months to the newest bar; 0 where there are too few bars."""
    w = by_ticker()
    rows = bars.select("ticker", "date", "close", *(F.lag("close", n * month - 1).over(w).alias(f"c{n}") for n in (1, 3)), F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))).alias("back"))
    since = lambda n: F.coalesce(C("close") / C(f"c{n}") - 1, F.lit(0.0))
    return rows.filter("back = 1").select("ticker", since(1).alias("momentum_1m"), since(3).alias("momentum_3m"))


def relative_strength(a: Column, b: Column) -> Column:
    """a over b; 1 if neither moved, infinite if only a did."""
    return F.when(F.abs(b) > 1e-12, ratio(a, b)).otherwise(F.when(F.abs(a) <= 1e-12, 1.0).otherwise(float("inf")))


def drawdown_states(bars: DataFrame, baskets: DataFrame) -> DataFrame:
    """normal, mild or severe by the deepest fall of each basket's mean price. ``baskets``: ticker, basket."""
    price = bars.join(baskets, "ticker").groupBy("basket", "date").agg(F.avg("close").alias("p"))
    top = F.max("p").over(Window.partitionBy("basket").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    worst = price.select("basket", (C("p") / top - 1).alias("dd")).groupBy("basket").agg(F.min("dd").alias("worst"))
    return worst.withColumn("state", F.when(C("worst") >= -0.05, "normal").when(C("worst") >= -0.15, "mild").otherwise("severe"))
