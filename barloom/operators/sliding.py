"""Sliding and recursive measures of a ticker's bars, streamed over sorted partitions.

A partition holds whole tickers in order of date and is read batch by batch. Each step
carries what the next batch needs of a ticker: the last n - 1 values of a window, the state
of a recursive average, a running total. So a ticker may have any number of bars, and a
panel is shuffled and sorted once for all steps, however many.

Sums, spreads and extremes are updated from bar to bar; ranks and quantiles come from an
indexed skip list of the window's values, n log w in all, instead of a scan of the window
for every bar. Nulls are not counted; a result is null until ``least`` values are there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: A gap of so many bars over the weight of a new value leaves nothing of what was before.
_FORGOTTEN = 100


@dataclass(frozen=True)
class Step:
    """``to`` is a measure of ``of``: a column, the ``to`` of an earlier step, or made from those by name.

    Kinds: average (recursive, ``alpha``), sum, mean, std, min, max, spread (mean distance from the
    mean), rank (of the last value, as a share, ties averaged), quantile (``q``, the higher value),
    rank_correlation (with the column ``by``) over the last ``n`` bars; lag (``n`` bars before);
    running (total of all bars so far).
    """

    to: str
    kind: str
    of: str | Callable[[dict[str, np.ndarray]], np.ndarray]
    n: int = 1
    least: int | None = None
    alpha: float = 0.0
    q: float = 0.5
    by: str | None = None


class Average:
    """y = (1 - a) y + a x; the first value starts it, and old values fade over gaps. State: y, bars since, values seen."""

    def __init__(self, s: Step, y: float = np.nan, gap: int = 0, seen: int = 0):
        self.alpha, self.least = s.alpha, 1 if s.least is None else s.least
        self.y, self.gap, self.seen = y, gap, seen

    def __call__(self, x: np.ndarray) -> np.ndarray:
        known = ~np.isnan(x)
        before = [] if np.isnan(self.y) else [self.y, *[np.nan] * min(self.gap, int(_FORGOTTEN / self.alpha))]
        y = pd.Series(np.concatenate([before, x])).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[len(before) :]
        count = self.seen + np.cumsum(known)
        if len(x):
            self.y, self.seen = float(y[-1]), int(count[-1])
            last = np.flatnonzero(known)
            self.gap = len(x) - 1 - int(last[-1]) if len(last) else self.gap + len(x)
        return np.where(count >= self.least, y, np.nan)


class _Window:
    def __init__(self, s: Step):
        self.s, self.least, self.tail = s, s.n if s.least is None else s.least, np.zeros(0)

    def _measure(self, x: np.ndarray) -> np.ndarray:
        s = self.s
        if s.kind == "spread":
            out = np.full(len(x), np.nan)
            if len(x) >= s.n:
                w = np.lib.stride_tricks.sliding_window_view(x, s.n)
                out[s.n - 1 :] = np.abs(w - w.mean(axis=1, keepdims=True)).mean(axis=1)
            return out
        rolled = pd.Series(x).rolling(s.n, min_periods=self.least)
        if s.kind == "rank":
            return np.where(np.isnan(x), np.nan, rolled.rank(pct=True).to_numpy())
        if s.kind == "quantile":
            return rolled.quantile(s.q, interpolation="higher").to_numpy()
        return getattr(rolled, s.kind)().to_numpy()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        every = np.concatenate([self.tail, x])
        out = self._measure(every)[len(self.tail) :]
        self.tail = every[max(0, len(every) - self.s.n + 1) :]
        return out


class _RankCorrelation:
    """Null without variance on either side, or with a null in the window; windows are short, so ranks are counts of pairs."""

    def __init__(self, s: Step):
        self.n, self.by = s.n, s.by
        self.tail = np.zeros((2, 0))

    @staticmethod
    def _centred(w: np.ndarray) -> np.ndarray:
        less = (w[:, None, :] < w[:, :, None]).sum(axis=2)
        same = (w[:, None, :] == w[:, :, None]).sum(axis=2)
        return less + (same + 1) / 2 - (w.shape[1] + 1) / 2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        every = np.concatenate([self.tail, x], axis=1)
        out = np.full(every.shape[1], np.nan)
        windows = np.lib.stride_tricks.sliding_window_view(every, self.n, axis=1) if every.shape[1] >= self.n else np.zeros((2, 0, self.n))
        for lo in range(0, windows.shape[1], 4096):
            a, b = (self._centred(w[lo : lo + 4096]) for w in windows)
            scale = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            known = ~np.isnan(windows[:, lo : lo + 4096]).any(axis=(0, 2)) & (scale > 0)
            out[self.n - 1 + lo : self.n - 1 + lo + len(a)] = np.where(known, (a * b).sum(axis=1) / np.where(scale > 0, scale, 1.0), np.nan)
        fresh = out[self.tail.shape[1] :]
        self.tail = every[:, max(0, every.shape[1] - self.n + 1) :]
        return fresh


class _Lag:
    def __init__(self, s: Step):
        self.tail = np.full(s.n, np.nan)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        every = np.concatenate([self.tail, x])
        self.tail = every[len(x) :]
        return every[: len(x)]


class _Running:
    def __init__(self, s: Step):
        self.total = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self.total + np.cumsum(np.nan_to_num(x))
        self.total = float(out[-1]) if len(out) else self.total
        return out


def _started(s: Step) -> Callable[[np.ndarray], np.ndarray]:
    return {"average": Average, "lag": _Lag, "running": _Running, "rank_correlation": _RankCorrelation}.get(s.kind, _Window)(s)


def measured(columns: dict[str, np.ndarray], steps: Sequence[Step], states: Sequence[Callable]) -> dict[str, np.ndarray]:
    """The steps' results over the next bars of one ticker, whose states move on."""
    known, out = dict(columns), {}
    with np.errstate(all="ignore"):
        for s, state in zip(steps, states, strict=True):
            x = known[s.of] if isinstance(s.of, str) else s.of(known)
            known[s.to] = out[s.to] = state(x if s.by is None else np.stack([x, known[s.by]]))
    return out


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def runs_of(*keys: pa.Array) -> list[tuple[int, int]]:
    """Stretches of rows with the same keys."""
    n = len(keys[0])
    opens = np.zeros(n, bool)
    opens[:1] = True
    for key in keys:
        x = key.to_numpy(zero_copy_only=False)
        opens[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(opens).tolist()
    return list(zip(first, [*first[1:], n], strict=True)) if n else []


def in_order(df: DataFrame) -> DataFrame:
    """Whole tickers by partition, bars by date; windows by ticker and date keep this."""
    return df.repartition("ticker").sortWithinPartitions("ticker", "date")


def slide(df: DataFrame, steps: Sequence[Step], ready: bool = False) -> DataFrame:
    """``df`` with a double column per step. ``ready`` says that it comes from ``in_order``, at most through windows of ticker and date."""
    names, added = df.columns, [s.to for s in steps]
    wanted = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte") or f.dataType.typeName().startswith("decimal")]
    ticker, date = names.index("ticker"), names.index("date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states, last = None, None, None
        for b in batches:
            every = {c: numbers(b.column(names.index(c))) for c in wanted}
            made: dict[str, list[np.ndarray]] = {c: [] for c in added}
            for lo, hi in runs_of(b.column(ticker)):
                own, first = b.column(ticker)[lo].as_py(), b.column(date)[lo].as_py()
                if states is None or own != now:
                    now, states = own, [_started(s) for s in steps]
                elif first < last:
                    raise ValueError("bars are not in order")
                last = b.column(date)[hi - 1].as_py()
                for c, y in measured({k: v[lo:hi] for k, v in every.items()}, steps, states).items():
                    made[c].append(y)
            columns = [pa.array(np.concatenate([np.zeros(0), *made[c]]), pa.float64(), from_pandas=True) for c in added]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return (df if ready else in_order(df)).mapInArrow(run, kinds + "".join(f", `{c}` double" for c in added))
