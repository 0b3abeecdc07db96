"""Paper portfolio: signal gates, order sizing in order, exits, forward log and Kelly fractions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import reasons
from .timejoins import next_session

C = F.col


def bar_checks(bars: DataFrame) -> DataFrame:
    """Per ticker, over the last two bars: suspected split, price limit, disorder and staleness."""
    w = Window.partitionBy("ticker").orderBy("date")
    last = bars.select("*", F.lag("close").over(w).alias("before"), F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("bars"), F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))).alias("back"))
    move = C("close") / C("before") - 1
    why = reasons(
        (C("bars") < 2, "TOO_FEW_BARS"),
        ((C("close") / C("before") < 0.6) | (C("close") / C("before") > 1.8), "SPLIT_SUSPECT"),
        (C("ticker").rlike(r"\.(KS|KQ)$") & (F.abs(move) > 0.3), "PRICE_LIMIT"),
        ((C("high") < F.greatest("open", "close")) | (C("low") > F.least("open", "close")), "OHLC_ORDER"),
    )
    return last.filter("back = 1").select("ticker", "date", "bars", why.alias("issues"))


def signal_gate(least_score: float = 56.0) -> Column:
    """The first reason that keeps a signal out; null lets it in. Columns: market, auc, accuracy, signal, score, issues."""
    return (
        F.when(~F.coalesce(C("market").isin("KRX", "NYSE", "NASDAQ"), F.lit(False)), "UNKNOWN_MARKET")
        .when(C("auc").isNull() | C("accuracy").isNull(), "NO_MODEL_EVIDENCE")
        .when((C("auc") < 0.5) | (C("accuracy") < 0.5), "MODEL_QUALITY")
        .when(F.upper("signal") == "HOLD", "HOLD")
        .when(C("score") < least_score, "LOW_SCORE")
        .when(F.size("issues") > 0, F.get("issues", F.lit(0)))
    )


def benchmark_gate(market: Column, bars: Column, issues: Column) -> Column:
    """Whether the benchmark of a market lets results be promoted: only KRX asks for one."""
    status = F.when(F.coalesce(F.upper(market), F.lit("")) != "KRX", "NOT_APPLICABLE").when(F.coalesce(bars, F.lit(0)) < 2, "MISSING").when(F.size(issues) > 0, "MISSING").otherwise("PASS")
    return F.struct(status.alias("status"), (status == "MISSING").alias("not_promotable"))


def fill_dates(orders: DataFrame, sessions: DataFrame) -> DataFrame:
    """Orders (market, run_date) with ``fill_date``: KRX orders fill at the next session, others on their day."""
    days = orders.filter("market = 'KRX'").select(C("run_date").alias("day")).distinct()
    found = next_session(days, sessions).select(C("day").alias("run_date"), "session")
    joined = orders.join(found, "run_date", "left")
    return joined.withColumn("fill_date", F.when(C("market") == "KRX", C("session")).otherwise(C("run_date"))).drop("session")


def sized_orders(signals: DataFrame, cash: float, most_open: int = 10, most_new: int = 3, share: float = 0.1, buffer: float = 0.05, slippage: float = 0.001) -> DataFrame:
    """Orders of each run in signal order: duplicates, full books and small cash are refused.

    Runs are folded row by row in sorted partitions, so a run may have any number of
    signals. A signal without a price has no fill. Columns: run_id, nth, ticker, price.
    """
    kind = signals.schema["run_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, new, held = None, None, 0, set()
        for b in batches:
            quantities, fills, why = [], [], []
            for run, ticker, price in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if left is None or run != now:
                    now, left, new, held = run, float(cash), 0, set()
                fill = None if price is None else price * (1 + slippage)
                quantity = 0 if fill is None else max(math.floor(min(cash * share, left - cash * buffer) / fill), 0)
                reason = "DUPLICATE" if ticker in held else "BOOK_FULL" if len(held) >= most_open else "NEW_LIMIT" if new >= most_new else "NO_CASH" if quantity < 1 else "FILLED"
                if reason == "FILLED":
                    left, new = left - quantity * fill, new + 1
                    held.add(ticker)
                quantities.append(quantity if reason == "FILLED" else 0)
                fills.append(fill)
                why.append(reason)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(quantities, pa.int64()), pa.array(fills, pa.float64()), pa.array(why, pa.string())], names=["run_id", "nth", "ticker", "quantity", "fill", "reason"])

    rows = signals.select("run_id", C("nth").cast("int").alias("nth"), C("ticker").cast("string").alias("ticker"), C("price").cast("double").alias("price"))
    return rows.repartition("run_id").sortWithinPartitions("run_id", "nth", "ticker", "price").mapInArrow(fold, f"run_id {kind}, nth int, ticker string, quantity bigint, fill double, reason string")


def equity_rows(fills: DataFrame, closes: DataFrame, cash: float) -> DataFrame:
    """Cash and value per run from its fills at the last closes (ticker, close)."""
    worth = fills.filter("quantity > 0").join(closes, "ticker", "left")
    return worth.groupBy("run_id").agg((cash - F.sum(C("quantity") * C("fill"))).alias("cash"), F.sum(C("quantity") * F.coalesce("close", "fill")).alias("value")).withColumn("equity", C("cash") + C("value"))


def position_path(marks: DataFrame, trail: float = 0.5) -> DataFrame:
    """Open positions day by day: peak, trough, excursions, and a stop midway to the peak once the first target was reached.

    Columns: ticker, date, price, entry, stop, tp1.
    """
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak, trough = F.max("price").over(w), F.min("price").over(w)
    out = marks.withColumns({"peak": peak, "trough": trough}).withColumns({"mfe": C("peak") / C("entry") - 1, "mae": C("trough") / C("entry") - 1})
    stop = F.when(C("peak") >= C("tp1"), F.greatest("stop", C("entry") + trail * (C("peak") - C("entry")))).otherwise(C("stop"))
    return out.withColumn("active_stop", stop).withColumn("status", F.when(C("price") <= C("active_stop"), "STOPPED").when(C("price") <= 1.02 * C("active_stop"), "STOP_NEAR").otherwise("OPEN"))


def forward_step(log: DataFrame, day: DataFrame) -> DataFrame:
    """New log rows for days not yet recorded. ``log``/``day``: date, symbol, close, benchmark_close."""
    return day.join(log.select("date", "symbol"), ["date", "symbol"], "left_anti")


def forward_alpha(log: DataFrame, start: float = 1.0) -> DataFrame:
    """Equity of symbol and benchmark chained from their closes, and the daily and cumulative difference."""
    w = Window.partitionBy("symbol").orderBy("date")
    own, bench = (C(c) / F.lag(c).over(w) - 1 for c in ("close", "benchmark_close"))
    rows = log.withColumns({"own": F.coalesce(own, F.lit(0.0)), "bench": F.coalesce(bench, F.lit(0.0))})
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chain = lambda c: start * F.exp(F.sum(F.log1p(c)).over(run))
    out = rows.withColumns({"equity": chain("own"), "benchmark_equity": chain("bench"), "daily_alpha_pct": 100 * (C("own") - C("bench"))})
    return out.withColumn("cumulative_alpha_pct", 100 * (C("equity") - C("benchmark_equity")) / start)


def forward_summary(log: DataFrame) -> DataFrame:
    """Distinct days, violations, span, last alpha and drawdown per symbol."""
    run = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = log.withColumn("dd", C("equity") / F.max("equity").over(run) - 1)
    return rows.groupBy("symbol").agg(F.count_distinct("date").alias("days"), F.count_if("rule_violation").alias("violations"), F.min("date").alias("start"), F.max("date").alias("end"), F.max_by("cumulative_alpha_pct", "date").alias("alpha"), F.min("dd").alias("max_drawdown"))


def promotion_drawdown(mdd: Column, benchmark: Column) -> Column:
    """Flags from drawdowns in percent: 8 and 10, or 3 worse than the benchmark."""
    return reasons((mdd >= 10, "DRAWDOWN_10"), (mdd.between(8, 10), "DRAWDOWN_8"), (mdd - benchmark > 3, "WORSE_THAN_BENCHMARK"))


def kelly(trades: DataFrame, prior: float = 2.0, least: int = 8, start: float = 0.10, low: float = 0.0, high: float = 0.25) -> DataFrame:
    """Fraction before each trade from those closed earlier. Columns: ticker, date, pnl."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    wins, n = F.coalesce(F.sum((C("pnl") > 0).cast("int")).over(w), F.lit(0)), F.count("pnl").over(w)
    gain, loss = F.avg(F.when(C("pnl") > 0, C("pnl"))).over(w), -F.avg(F.when(C("pnl") <= 0, C("pnl"))).over(w)
    p = (wins + prior) / (n + 2 * prior)
    edge = p - (1 - p) * loss / F.nullif(gain, F.lit(0.0))
    return trades.withColumn("fraction", F.when(n < least, start).otherwise(F.least(F.greatest(F.coalesce(edge, F.lit(low)), F.lit(low)), F.lit(high))))


def monthly_stop(equity: DataFrame, limit: float = 0.05) -> DataFrame:
    """Whether equity is ``limit`` or more below the month's first. Columns: ticker, date, equity."""
    month = Window.partitionBy("ticker", F.trunc("date", "month")).orderBy("date")
    first = F.first("equity").over(month)
    return equity.withColumn("month_return", C("equity") / first - 1).withColumn("stopped", C("month_return") <= -limit)
