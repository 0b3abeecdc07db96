"""Moving-average rules with stops over a grid, folded in one pass over each ticker's bars.

A cell of the grid is (window, stop). Its state on a ticker is what it holds, the price it
entered at and whether a stop has closed it. At a bar's close a cell that holds is stopped
when the price is at least ``stop`` below its entry; else it holds while the price is above
its average. A stopped cell waits until the price is no longer above the average before it
may enter again. What is held from one close earns the return to the next; every change
costs fee and slippage. All cells move together, as arrays over the grid, so the bars are
shuffled, sorted and read once whatever the grid's size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sliding import Step, in_order, numbers, runs_of, slide
from .stats import annualised

C = F.col


class Cells:
    """The state of all cells on one ticker."""

    def __init__(self, window: np.ndarray, stop: np.ndarray, cost: float):
        self.window, self.stop, self.cost = window, stop, cost
        self.held, self.moved = np.zeros(len(stop)), np.zeros(len(stop))
        self.entry, self.waits, self.before = np.full(len(stop), np.nan), np.zeros(len(stop), bool), np.nan

    def next(self, close: float, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bar's net returns and changes of position; then the positions for the next one."""
        ret = close / self.before - 1 if self.before > 0 else 0.0
        net, moved = self.held * ret - self.cost * self.moved, self.moved
        above = close > means[self.window]  # false without a mean
        self.waits &= above
        stopped = (self.held > 0) & (close <= (1 - self.stop) * self.entry)
        self.waits |= stopped & above
        wanted = (above & ~self.waits).astype(float)
        self.entry = np.where((wanted > 0) & (self.held == 0), close, self.entry)
        self.moved, self.held, self.before = np.abs(wanted - self.held), wanted, close
        return net, moved


def stop_sweep(bars: DataFrame, windows: Sequence[int], stops: Sequence[float], fee: float = 0.0005, slippage: float = 0.0, top: int | None = 10) -> DataFrame:
    """Equal-weight results over all tickers per (ma, stop), the best by Sharpe ratio. ``bars``: ticker, date, close."""
    grid = [(i, s) for i in range(len(windows)) for s in stops]
    window, stop = np.array([i for i, _ in grid]), np.array([s for _, s in grid], float)
    steps = [Step(f"ma_{n}", "mean", "close", n) for n in windows]
    rows = slide(in_order(bars.select("ticker", "date", C("close").cast("double").alias("close"))), steps, ready=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells = None, None
        for b in batches:
            close, means = numbers(b.column(2)), np.stack([numbers(b.column(3 + i)) for i in range(len(windows))], axis=1)
            for lo, hi in runs_of(b.column(0)):
                own = b.column(0)[lo].as_py()
                if cells is None or own != now:
                    now, cells = own, Cells(window, stop, fee + slippage)
                net, moved = zip(*(cells.next(close[i], means[i]) for i in range(lo, hi)), strict=True)
                for x in range(0, hi - lo, 2048):
                    n = min(2048, hi - lo - x)
                    days = b.column(1).slice(lo + x, n)
                    yield pa.RecordBatch.from_arrays(
                        [days.take(pa.array(np.repeat(np.arange(n), len(grid)))), pa.array(np.tile(np.arange(len(grid), dtype=np.int32), n)), pa.array(np.concatenate(net[x : x + n])), pa.array(np.concatenate(moved[x : x + n]))],
                        names=["date", "cell", "net", "moved"],
                    )

    kind = rows.schema["date"].dataType.simpleString()
    daily = rows.mapInArrow(run, f"date {kind}, cell int, net double, moved double").groupBy("cell", "date").agg(F.avg("net").alias("ret"), F.sum("moved").alias("moved"))
    trades = daily.groupBy("cell").agg(F.sum("moved").alias("trades"))
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), C("cell") + 1)
    out = annualised(daily, ["cell"]).join(trades, "cell").select(of([windows[i] for i, _ in grid]).alias("ma"), of(stop.tolist()).alias("stop"), "ann_return", "sharpe", "max_drawdown", "trades")
    return out if top is None else out.orderBy(F.desc("sharpe"), "ma", "stop").limit(top)
