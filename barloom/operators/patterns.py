"""Nearest patterns by cosine in blocks, and their walk-forward test.

Vectors are packed into blocks; a pair of blocks is one matrix product in one task, which
keeps the k best items of each query. So k rows per query and item block are shuffled
instead of one per pair. Cosines are rounded to twelve places before they are ordered, so
that equal vectors tie whatever the product's order of summing, and ties go by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col
QUERY_BLOCK, ITEM_BLOCK = 1024, 4096
_PLACES = 12


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows without length stay zero."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def best(cosine: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (queries) and columns (items, in order of id) of the k best of each row that reach the floor, ties by column."""
    cosine = np.round(cosine, _PLACES)
    if cosine.shape[1] > k:
        least = np.maximum(-np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k], floor)
    else:
        least = np.full((len(cosine), 1), floor)
    row, item = np.nonzero(cosine >= least)
    order = np.lexsort((item, -cosine[row, item], row))
    row, item = row[order], item[order]
    first = np.searchsorted(row, np.arange(len(cosine)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], item[keep]


def packed(df: DataFrame, key: str, size: int) -> DataFrame:
    """Blocks of ``size`` rows of (key, vector): ids in order and unit vectors, one after the other. Null and empty vectors are left out."""
    kind = df.schema[key].dataType.simpleString()

    def block(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: r[0])
        x = unit(np.array([v for _, v in held], float))
        return pa.RecordBatch.from_arrays([pa.array([[i for i, _ in held]]), pa.array([x.astype("<f8").tobytes()], pa.binary())], names=["ids", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(row)
                if len(held) == size:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return df.select(key, "vector").filter((F.size("vector") > 0) & C(key).isNotNull()).mapInArrow(run, f"ids array<{kind}>, vectors binary")


def similar(queries: DataFrame, items: DataFrame, k: int = 7, floor: float = 0.30) -> DataFrame:
    """Top-k items per query by cosine, a query's own id aside. ``queries``: (query_id, vector); items (item_id, vector)."""
    q = packed(queries, "query_id", QUERY_BLOCK).withColumnsRenamed({"ids": "query_ids", "vectors": "asked"})
    pairs = packed(items, "item_id", ITEM_BLOCK).crossJoin(q)  # of blocks
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (items, "item_id"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                own, asked = b.column(0)[i].values, b.column(2)[i].values
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), "<f8").reshape(n, -1) for c, n in ((1, len(own)), (3, len(asked))))
                cosine = y @ x.T
                mine, theirs = own.to_numpy(zero_copy_only=False), asked.to_numpy(zero_copy_only=False)
                at = np.searchsorted(mine, theirs).clip(max=len(mine) - 1)
                same = np.flatnonzero(mine[at] == theirs)
                cosine[same, at[same]] = -2.0
                row, item = best(cosine, k, floor)
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(row)), own.take(pa.array(item)), pa.array(np.round(cosine[row, item], _PLACES))], names=["query_id", "item_id", "cosine"])

    scored = pairs.mapInArrow(run, f"query_id {kinds[0]}, item_id {kinds[1]}, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "item_id")
    return scored.withColumn("nth", F.row_number().over(w)).filter(C("nth") <= k)


def expected_returns(known: np.ndarray, returns: np.ndarray, asked: np.ndarray, k: int = 7, floor: float = 0.30) -> np.ndarray:
    """Mean return of each row's nearest known patterns, weighted by cosine, 0 where none is near; scales come from the known ones."""
    mean, apart = known.mean(axis=0), known.std(axis=0)
    apart = np.where(apart < 1e-9, 1.0, apart)
    x, y = unit((known - mean) / apart), unit((asked - mean) / apart)
    out = np.zeros(len(asked))
    for lo in range(0, len(y), QUERY_BLOCK):
        cosine = y[lo : lo + QUERY_BLOCK] @ x.T
        row, item = best(cosine, k, floor)
        weight = np.maximum(np.round(cosine[row, item], _PLACES), 0.0)
        total = np.bincount(row, weight, len(cosine))
        out[lo : lo + QUERY_BLOCK] = np.divide(np.bincount(row, weight * returns[item], len(cosine)), total, out=np.zeros(len(cosine)), where=total > 1e-12)
    return out


def walk_forward(rows: DataFrame, features: Sequence[str], splits: int = 5, least: int = 60, embargo: int = 5, k: int = 7, floor: float = 0.30) -> DataFrame:
    """Per ticker and fold: sizes, share of returns whose sign was foreseen, means, and out-of-sample R2 (0 without variance).

    ``rows``: ticker, date, ret (the return to come) and features, without nulls. Training
    grows from the first ``least`` rows by a fold at a time; ``embargo`` rows are left out
    before a fold. Each (ticker, fold) is a group of its own; a ticker with too few rows has
    none. A group is one ticker's history, and cosines are made a block of test rows at a time.
    """
    kind = rows.schema["ticker"].dataType.simpleString()
    sign: Callable[[np.ndarray], np.ndarray] = np.sign

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        table, nth = table.sort_by("date"), key[1].as_py()
        n = len(table)
        size = max(1, (n - least) // splits)
        train, start = least + nth * size, least + nth * size + embargo
        stop = min(n, start + size)
        out: dict[str, list] = {c: [] for c in ("train_n", "test_n", "hit_rate", "mean_pred", "mean_actual", "r2")}
        if n >= least + splits and stop > start:
            x = np.stack([table.column(c).to_numpy() for c in features], axis=1).astype(float)
            ret = table.column("ret").to_numpy().astype(float)
            pred, actual = expected_returns(x[:train], ret[:train], x[start:stop], k, floor), ret[start:stop]
            spread = float(((actual - actual.mean()) ** 2).sum())
            r2 = 1 - float(((actual - pred) ** 2).sum()) / spread if spread / len(actual) > 1e-12 else 0.0
            for c, v in zip(out, (train, stop - start, float((sign(pred) == sign(actual)).mean()), float(pred.mean()), float(actual.mean()), r2), strict=True):
                out[c].append(v)
        m = len(out["r2"])
        return pa.table({"ticker": pa.array([key[0].as_py()] * m, table.schema.field("ticker").type), "fold": pa.array([nth] * m, pa.int32())} | {c: pa.array(v, pa.int64() if c.endswith("_n") else pa.float64()) for c, v in out.items()})

    every = rows.select("ticker", "date", "ret", *features, F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("fold"))
    return every.groupBy("ticker", "fold").applyInArrow(fold, f"ticker {kind}, fold int, train_n long, test_n long, hit_rate double, mean_pred double, mean_actual double, r2 double")
