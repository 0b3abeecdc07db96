"""Recursive smoothing: y0 = x0, y = (1 - a) y + a x, null until enough inputs are there.

``smooth`` computes any number of chained smoothings in one streamed pass per ticker
(``sliding``). ``scanned`` spreads a ticker's history over tasks: a stretch of bars maps the
average before it to the one after it by y -> c y + d, such maps are composed per segment of
dates, the segments' maps (one row each) are applied in order, and a second pass over the
segments starts each from its own state. ``ema`` is a Column: a fold over a bounded
look-back, exact to a relative 1e-12; it costs n times the look-back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .panel import by_ticker
from .sliding import Average, Step, numbers, runs_of, slide


def span(n: int) -> float:
    return 2.0 / (n + 1)


def wilder(n: int) -> float:
    return 1.0 / n


def look_back(alpha: float, error: float = 1e-12) -> int:
    return math.ceil(math.log(error) / math.log(1 - alpha))


def ema(x: Column, alpha: float, least: int) -> Column:
    k = look_back(alpha)
    values = F.collect_list(x).over(by_ticker(k))
    fold = F.aggregate(values, F.lit(None).cast("double"), lambda a, v: F.when(a.isNull(), v).otherwise((1 - alpha) * a + alpha * v))
    return F.when(F.count(x).over(by_ticker(least)) >= least, fold)


@dataclass(frozen=True)
class Smoothing:
    """``to`` is the smoothed ``of``: a column, the ``to`` of an earlier one, or made from a ticker's bars."""

    to: str
    of: str | Callable[[dict[str, np.ndarray]], np.ndarray]
    alpha: float
    least: int

    @property
    def step(self) -> Step:
        return Step(self.to, "average", self.of, least=self.least, alpha=self.alpha)


def smooth(df: DataFrame, steps: Sequence[Smoothing]) -> DataFrame:
    return slide(df, [s.step for s in steps])


def _summary(x: np.ndarray, s: Smoothing) -> list[float]:
    """Of a segment: its rows, values, rows before the first value, that value, the map (c, d) from there on, rows after the last."""
    known = np.flatnonzero(~np.isnan(x))
    if not len(known):
        return [len(x), 0, 0, np.nan, 1.0, 0.0, 0]
    fade = (1 - s.alpha) ** np.diff(known)
    c = float(np.prod(fade / (fade + s.alpha)))
    end = Average(s.step)
    end(x[known[0] :])
    return [len(x), len(known), int(known[0]), float(x[known[0]]), c, end.y - c * float(x[known[0]]), len(x) - 1 - int(known[-1])]


def _entered(segments: Sequence[Sequence[float]], alpha: float) -> list[tuple[float, int, int]]:
    """The state (y, rows since, values seen) before each segment, in order."""
    y, gap, seen, out = math.nan, 0, 0, []
    for rows, values, lead, first, c, d, trail in segments:
        out.append((y, gap, seen))
        if not values:
            gap += int(rows)
            continue
        fade = (1 - alpha) ** (gap + lead + 1)
        start = first if math.isnan(y) else (fade * y + alpha * first) / (fade + alpha)
        y, gap, seen = c * start + d, int(trail), seen + int(values)
    return out


def scanned(df: DataFrame, steps: Sequence[Smoothing], segment: Column) -> DataFrame:
    """``df`` with a column per smoothing of its columns, the bars of a ticker spread over tasks by ``segment``.

    Segments are integers that grow with the date (a year, say); a segment's bars are one
    task's work, and a ticker's segments, one row each, meet once between the passes.
    """
    names = df.columns
    kind = df.schema["ticker"].dataType.simpleString()
    rows = df.withColumn("_segment", segment.cast("long")).repartition("ticker", "_segment").sortWithinPartitions("ticker", "_segment", "date")
    read = [rows.columns.index(s.of) for s in steps]
    at = [rows.columns.index(c) for c in ("ticker", "_segment")]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
        """Whole segments; those of one task come one after the other."""
        now, held = None, []
        for b in batches:
            for lo, hi in runs_of(*(b.column(i) for i in at)):
                own = tuple(b.column(i)[lo].as_py() for i in at)
                if held and own != now:
                    yield now, held
                    held = []
                now = own
                held.append(b.slice(lo, hi - lo))
        if held:
            yield now, held

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ticker, number), held in stretches(batches):
            maps = [_summary(np.concatenate([numbers(b.column(i)) for b in held]), s) for i, s in zip(read, steps, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([ticker], held[0].column(at[0]).type), pa.array([number], pa.int64()), pa.array([maps], pa.list_(pa.list_(pa.float64())))], names=["ticker", "_segment", "maps"])

    def states(table: pa.Table) -> pa.Table:
        table = table.sort_by("_segment")
        maps = table.column("maps").to_pylist()
        found = [_entered([m[k] for m in maps], s.alpha) for k, s in enumerate(steps)]
        entry = [[list(map(float, found[k][i])) for k in range(len(steps))] for i in range(len(maps))]
        return table.select(["ticker", "_segment"]).append_column("_entry", pa.array(entry, pa.list_(pa.list_(pa.float64()))))

    entry = rows.mapInArrow(summaries, f"ticker {kind}, _segment long, maps array<array<double>>").groupBy("ticker").applyInArrow(states, f"ticker {kind}, _segment long, _entry array<array<double>>")
    added = [s.to for s in steps]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, averages = None, []
        for b in batches:
            made: list[list[np.ndarray]] = [[] for _ in steps]
            for lo, hi in runs_of(*(b.column(i) for i in at)):
                own = tuple(b.column(i)[lo].as_py() for i in at)
                if own != now:
                    now, averages = own, [Average(s.step, math.nan if e[0] is None else e[0], int(e[1]), int(e[2])) for s, e in zip(steps, b.column(len(names) + 1)[lo].as_py(), strict=True)]
                for k, (i, average) in enumerate(zip(read, averages, strict=True)):
                    made[k].append(average(numbers(b.column(i))[lo:hi]))
            columns = [pa.array(np.concatenate([np.zeros(0), *m]), pa.float64(), from_pandas=True) for m in made]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *columns], names=[*names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    with_entry = rows.join(entry, ["ticker", "_segment"]).select(*names, "_segment", "_entry").sortWithinPartitions("ticker", "_segment", "date")
    return with_entry.mapInArrow(apply, kinds + "".join(f", `{c}` double" for c in added))
