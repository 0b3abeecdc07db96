"""Joins along time: corporate actions, as-of values, sessions, intervals and reconciliations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_backward(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """Adds to ``left`` the last ``values`` of ``right`` at or (strict) before its time.

    Both sides are merged and carried forward in one window per key: one shuffle, no range join.
    """
    tag = F.lit(1 if strict else 0)
    a = left.select("*", F.lit(None).cast("boolean").alias("_from_right"), *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values), (1 - tag).alias("_side"))
    b = right.select(*by, on, F.lit(True).alias("_from_right"), *values, tag.alias("_side"))
    every = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_from_right"), F.struct(*values)), ignorenulls=True).over(w)
    carried = every.withColumn("_last", last).filter("_from_right is null")
    return carried.select(*left.columns, *(F.col(f"_last.{v}").alias(v) for v in values))


def onto_dates(rows: DataFrame, features: DataFrame, values: Sequence[str], prefix: str = "x_") -> DataFrame:
    """``rows`` (one per date) with features of some dates, each carried to the dates that follow; null before the first.

    As in a reindex, values of dates that ``rows`` lacks are left out; each value is carried by itself. The window runs over one row per date.
    """
    both = rows.join(features.select("date", *(F.col(v).cast("double").alias(f"{prefix}{v}") for v in values)), "date", "left")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumns({f"{prefix}{v}": F.last(f"{prefix}{v}", ignorenulls=True).over(w) for v in values})


def as_of_forward(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str) -> DataFrame:
    """Adds the first ``value`` of ``right`` at or after the row's time.

    Times run backwards, so that the frame grows from its start and is carried on row by row.
    """
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(True).alias("_left"), F.lit(0).alias("_side"))
    b = right.select(*by, on, value, F.lit(False).alias("_left"), F.lit(1).alias("_side"))
    w = Window.partitionBy(*by).orderBy(F.desc(on), F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = a.unionByName(b, allowMissingColumns=True).withColumn("_next", F.last(value, ignorenulls=True).over(w))
    return every.filter("_left").select(*left.columns, F.col("_next").alias(value))


def adjustment_factors(bars: DataFrame, actions: DataFrame, dividends: bool = True) -> DataFrame:
    """Bars with ``factor``: the product of the multipliers of all later actions.

    A split multiplies earlier bars by 1 / ratio, a dividend by 1 - cash / last close before
    it; multipliers that are not positive, and actions before the first bar, do not count.
    Actions of one day multiply. Actions are merged into the bars' order and summed from
    the end, in logarithms.
    """
    priced = as_of_backward(actions, bars.select("ticker", "date", F.col("close").alias("last_close")), ["ticker"], "date", ["last_close"], strict=True)
    cash = 1 - F.col("cash_amount") / F.col("last_close")
    by = F.when((F.col("type") == "split") & (F.col("ratio") > 0), 1 / F.col("ratio"))
    if dividends:
        by = by.when((F.col("type") == "dividend") & (F.col("cash_amount") != 0) & (F.col("last_close") > 0) & (cash > 0), cash)
    steps = priced.select("ticker", "date", F.log(by).alias("step")).filter("step is not null").groupBy("ticker", "date").agg(F.sum("step").alias("step"))
    w = Window.partitionBy("ticker").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = steps.withColumn("through", F.sum("step").over(w)).withColumn("all", F.sum("step").over(Window.partitionBy("ticker")))
    total = later.groupBy("ticker").agg(F.max("all").alias("all"))
    joined = as_of_backward(bars, later.select("ticker", "date", "through"), ["ticker"], "date", ["through"]).join(total, "ticker", "left")
    return joined.withColumn("factor", F.exp(F.coalesce("all", F.lit(0.0)) - F.coalesce("through", F.lit(0.0)))).drop("through", "all")


def adjusted(bars: DataFrame, actions: DataFrame, dividends: bool = True) -> DataFrame:
    out = adjustment_factors(bars, actions, dividends)
    prices = {f"adj_{c}": F.col(c) * F.col("factor") for c in ("open", "high", "low", "close")}
    return out.withColumns(prices | {"adj_volume": F.col("volume") / F.when(F.col("factor") > 0, F.col("factor")).otherwise(1.0)})


def next_session(days: DataFrame, calendar: DataFrame, day: str = "day", strict: bool = False) -> DataFrame:
    """Adds ``session``: the first calendar day at or after ``day``; beyond the calendar null, or ``strict`` an error.

    Days and sessions are matched within months; a month without a later session takes the
    first one of the months to come, so no window holds more than a month of days.
    """
    month = F.trunc(day, "month").alias("_month")
    sessions = calendar.select(F.col("day").alias("session")).distinct()
    firsts = sessions.groupBy(F.trunc("session", "month").alias("_month")).agg(F.min("session").alias("_first"))
    months = days.select(month).distinct().join(firsts, "_month", "full_outer")
    ahead = Window.orderBy("_month").rowsBetween(1, Window.unboundedFollowing)  # a row per month
    later = months.select("_month", F.min("_first").over(ahead).alias("_later"))
    inside = as_of_forward(days.select("*", month), sessions.select(F.trunc("session", "month").alias("_month"), F.col("session").alias(day), "session"), ["_month"], day, "session")
    out = inside.join(later, "_month", "left").withColumn("session", F.coalesce("session", "_later"))
    if strict:
        out = out.withColumn("session", F.coalesce("session", F.raise_error(F.lit("a day lies beyond the calendar")).cast("date")))
    return out.select(*days.columns, "session")


def weekdays_between(a: Column, b: Column) -> Column:
    """Mondays to Fridays from a to b, both included; 0 if b is earlier."""
    upto = lambda d: F.floor((F.datediff(d, F.lit("1970-01-05").cast("date"))) / 7) * 5 + F.least(F.lit(5), F.pmod(F.datediff(d, F.lit("1970-01-05").cast("date")), F.lit(7)) + 1)
    return F.when(b >= a, upto(b) - upto(F.date_sub(a, 1))).otherwise(0).cast("int")


def matched_events(events: DataFrame, windows: DataFrame, before: int = 2, after: int = 3, top: int = 5) -> DataFrame:
    """Events inside each volatility window widened by a few days, the best ``top`` of each.

    Windows are short, so both sides are joined by day: a window is listed under each of its days.
    ``events``: ticker, date, relevance; ``windows``: ticker, start, end, severity.
    """
    days = windows.select("*", F.explode(F.sequence(F.date_sub("start", before), F.date_add("end", after))).alias("date"))
    joined = days.join(events, ["ticker", "date"]).withColumn("weight", F.col("relevance") * (1 + F.col("severity")))
    w = Window.partitionBy("ticker", "start").orderBy(F.desc("weight"), "date")
    return joined.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= top)


def carried_weights(bars: DataFrame, signals: DataFrame, default: float = 1.0) -> DataFrame:
    """Bars with the last signal weight carried forward."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = bars.join(signals.select("ticker", "date", F.col("weight").alias("_w")), ["ticker", "date"], "left")
    return joined.withColumn("weight", F.coalesce(F.last("_w", ignorenulls=True).over(w), F.lit(default))).drop("_w")


def reconcile(book: DataFrame, broker: DataFrame, tolerance: float = 1e-9, large: float = 0.05) -> DataFrame:
    """Differences between two books of (ticker, quantity); ``is_large`` beyond a share of the book."""
    a, b = book.select("ticker", F.col("quantity").alias("ours")), broker.select("ticker", F.col("quantity").alias("theirs"))
    both = a.join(b, "ticker", "full_outer").select("ticker", F.coalesce("ours", F.lit(0.0)).alias("ours"), F.coalesce("theirs", F.lit(0.0)).alias("theirs"))
    diff = F.col("theirs") - F.col("ours")
    return both.withColumn("difference", diff).filter(F.abs(diff) > tolerance).withColumn("is_large", F.abs(diff) > large * F.greatest(F.abs("ours"), F.abs("theirs")))


def unaudited(scores: DataFrame, audit: DataFrame) -> DataFrame:
    """Scores other than 0 without an audit row of their ticker and day."""
    return scores.filter("score <> 0").join(audit.select("ticker", "day").distinct(), ["ticker", "day"], "left_anti")


def wash_sales(orders: DataFrame, closed: DataFrame, days: int = 30) -> DataFrame:
    """Buys within ``days`` after a losing close of the same ticker."""
    losses = closed.filter("pnl < 0").select("ticker", F.explode(F.sequence("close_date", F.date_add("close_date", days))).alias("date")).distinct()
    return orders.filter("side = 'BUY'").join(losses, ["ticker", "date"], "left_semi")


def first_touch(entries: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """The first bar within ``horizon`` days after an entry that touches its stop, its target or reverses.

    On one bar the stop comes before the target and that before the reversal. ``entries``: ticker,
    entry_date, stop, target; ``bars``: ticker, date, high, low, close, signal. Entries are
    listed under the days they wait for, so the join is by equality.
    """
    waiting = entries.select("*", F.explode(F.sequence(F.date_add("entry_date", 1), F.date_add("entry_date", horizon))).alias("date"))
    hit = waiting.join(bars.select("ticker", "date", "high", "low", "close", "signal"), ["ticker", "date"])
    event = (
        F.when(F.col("low") <= F.col("stop"), F.struct(F.lit("STOP").alias("reason"), F.col("stop").alias("price")))
        .when(F.col("high") >= F.col("target"), F.struct(F.lit("TARGET").alias("reason"), F.col("target").alias("price")))
        .when(F.col("signal") < 0, F.struct(F.lit("REVERSAL").alias("reason"), F.col("close").alias("price")))
    )
    found = hit.withColumn("e", event).filter("e is not null").groupBy("ticker", "entry_date").agg(F.min("date").alias("exit_date"), F.min_by("e", "date").alias("e"))
    out = entries.join(found, ["ticker", "entry_date"], "left")
    return out.select(*entries.columns, "exit_date", F.coalesce("e.reason", F.lit("OPEN")).alias("exit_reason"), F.col("e.price").alias("exit_price"))


def forward_return(events: DataFrame, bars: DataFrame, ahead: int = 20) -> DataFrame:
    """Return from the first bar at or after an event to ``ahead`` bars later, or the last bar.

    Days are matched once each, whatever their number of events, so no task holds a ticker's events.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    last = F.last("close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    known = bars.select("ticker", "date", (F.coalesce(F.lead("close", ahead).over(w), last) / F.col("close") - 1).alias("forward_return"))
    days = as_of_forward(events.select("ticker", "date").distinct(), known, ["ticker"], "date", "forward_return")
    return events.join(days, ["ticker", "date"], "left").select(*events.columns, "forward_return")


def target_vs_current(target: DataFrame, current: DataFrame, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Both weights over the union of names; missing ones are 0."""
    t, c = target.select(*by, F.col("weight").alias("target")), current.select(*by, F.col("weight").alias("current"))
    return t.join(c, list(by), "full_outer").select(*by, F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("current", F.lit(0.0)).alias("current"))


def cross_asset(memory: DataFrame, k: int = 3) -> DataFrame:
    """For each (ticker, regime), the newest k entries of other tickers in that regime.

    Only a regime's k newest entries per ticker can be among them, which bounds the join.
    """
    newest = memory.withColumn("nth", F.row_number().over(Window.partitionBy("regime", "ticker").orderBy(F.desc("ts"), "session_id"))).filter(F.col("nth") <= k)
    best = newest.withColumn("place", F.row_number().over(Window.partitionBy("regime").orderBy(F.desc("ts"), "session_id")))
    # k entries of others are among a ticker's own k and the regime's 2 k newest
    short = best.filter(F.col("place") <= 2 * k).select("regime", F.col("ticker").alias("other"), F.col("session_id").alias("other_session"), F.col("ts").alias("other_ts"))
    pairs = memory.select("ticker", "regime").distinct().join(short, "regime").filter(F.col("other") != F.col("ticker"))
    w = Window.partitionBy("ticker", "regime").orderBy(F.desc("other_ts"), "other_session")
    return pairs.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)
