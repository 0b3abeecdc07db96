"""Ordered folds over sorted partitions: state machines whose step needs the row before.

Rows of a key meet in one partition, in order, and are folded batch by batch, so a key may
have any number of rows and nothing is held but its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, key: str, order: Sequence[str], start: Callable[[], tuple], step: Callable[[tuple, tuple], tuple[tuple, tuple]], out: str) -> DataFrame:
    """The rows of ``df`` with the columns of ``out`` (a schema string) that ``step`` gives.

    ``step`` takes the key's state and a row's columns and returns the new state and the
    row's results; ``start`` makes a key's first state.
    """
    names, at = df.columns, df.columns.index(key)
    added = [x.split()[0] for x in out.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            results = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or row[at] != now:
                    now, state = row[at], start()
                state, result = step(state, row)
                results.append(result)
            columns = zip(*results, strict=True) if results else ([] for _ in added)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, map(list, columns))], names=[*names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(fold, f"{kinds}, {out}")
