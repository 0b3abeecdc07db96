"""Structured Streaming: bar ingest, tick bars, snapshots, position states, alerts and reconciliation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.memory import upsert
from ..operators.panel import FIELDS
from ..operators.timejoins import reconcile
from ..sources.lake import Lake

C = F.col


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def tick_bars(ticks: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Bars from ticks (ticker, ts, price, size) under a watermark."""
    grouped = ticks.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "ticker")
    out = grouped.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"))
    return out.select("ticker", C("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def ingest(bars: DataFrame, lake: Lake, checkpoint: str, source: str, late: str = "7 days") -> DataStreamWriter:
    """Bars (with ``ts``) into the lake, once per (ticker, date, source) and values within the watermark.

    A corrected bar has other values and appends as a later version. A batch that is run again
    after a failure adds only what is not there yet.
    """
    values = F.sha2(F.to_json(F.struct(*FIELDS)), 256)
    once = bars.withColumns({"source": F.lit(source), "_values": values}).withWatermark("ts", late).dropDuplicatesWithinWatermark(["ticker", "date", "source", "_values"])

    def land(batch: DataFrame, _: int) -> None:
        if lake.exists():
            there = lake.versions().filter(C("_source") == source).select("ticker", "date", values.alias("_values"))
            batch = batch.join(there, ["ticker", "date", "_values"], "left_anti")
        lake.write(batch, source)

    return once.writeStream.option("checkpointLocation", checkpoint).foreachBatch(land)


def to_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """Each batch into a folder of its own number: one that is run again replaces itself."""

    def land(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(land)


def snapshot_table(news: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """``latest_snapshots`` kept as files: batch n merges what the batch before left, so that running it again gives the same."""

    def merge(batch: DataFrame, n: int) -> None:
        merged(batch, _version(batch.sparkSession, path, n), lambda df: df.write.mode("overwrite").parquet(f"{path}/batch={n}"))

    return news.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)


def _version(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a table of batches, or that before a batch."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    numbers = [n for n in (int(x[6:]) for x in names if x.startswith("batch=")) if before is None or n < before]
    return spark.read.parquet(f"{path}/batch={max(numbers)}") if numbers else None


def newest_snapshots(spark: SparkSession, path: str) -> DataFrame | None:
    return _version(spark, path)


def merged(batch: DataFrame, old: DataFrame | None, save: Callable[[DataFrame], None]) -> None:
    """The newest snapshot per ticker of a batch into the table that there is; one as old as the table's does not replace it."""
    new = batch.groupBy("ticker").agg(F.max("updated_at").alias("updated_at"), F.max_by("payload", "updated_at").alias("payload"))
    save(new if old is None else upsert(old, new.join(old.select("ticker", C("updated_at").alias("_seen")), "ticker", "left").filter("_seen is null or updated_at > _seen").drop("_seen"), ["ticker"]))


def latest_snapshots(news: DataFrame, table: Callable[[], DataFrame | None], save: Callable[[DataFrame], None], checkpoint: str) -> DataStreamWriter:
    """The newest snapshot per ticker, upserted batch by batch. Columns: ticker, updated_at, payload."""
    return news.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: merged(batch, table(), save))


def stale(snapshots: DataFrame, now, seconds: int = 3600) -> DataFrame:
    return snapshots.withColumn("stale", (now.cast("double") - C("updated_at").cast("double")) > seconds)


POSITION_OUT = "ticker string, ts timestamp, price double, peak double, stop double, status string"
POSITION_STATE = "peak double, stop double, status string"
STATUSES = ("OPEN", "STOP_NEAR", "STOPPED")


def position_states(quotes: DataFrame, trail: float = 0.5) -> DataFrame:
    """Position machine on quotes (ticker, ts, price, entry, stop, tp1): emits rows on every change of status.

    After the first target the stop trails midway between entry and peak; a stopped position
    stays stopped.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peak, stop, status = state.get if state.exists else (float("-inf"), float("-inf"), "NEW")
        if status == "STOPPED":
            return
        rows = pd.concat(list(parts))
        ts = rows["ts"].to_numpy()
        if (ts[1:] < ts[:-1]).any():
            rows = rows.sort_values("ts", kind="stable")
            ts = rows["ts"].to_numpy()
        price, entry, floor, tp1 = (rows[c].to_numpy(float) for c in ("price", "entry", "stop", "tp1"))
        # both only rise, so they are running maxima; fmax passes over missing values
        peaks = np.fmax.accumulate(np.fmax(price, peak))
        raised = np.where(peaks >= tp1, entry + trail * (peaks - entry), np.nan)
        stops = np.fmax.accumulate(np.fmax(np.fmax(floor, raised), stop))
        now = np.where(price <= stops, 2, np.where(price <= 1.02 * stops, 1, 0))
        end = int(np.argmax(now == 2)) + 1 if (now == 2).any() else len(now)
        told = np.flatnonzero(now[:end] != np.concatenate([[STATUSES.index(status) if status in STATUSES else -1], now[: end - 1]]))
        state.update((float(peaks[end - 1]), float(stops[end - 1]), STATUSES[now[end - 1]]))
        if len(told):
            yield pd.DataFrame({"ticker": key[0], "ts": ts[told], "price": price[told], "peak": peaks[told], "stop": stops[told], "status": [STATUSES[i] for i in now[told]]})

    return quotes.groupBy("ticker").applyInPandasWithState(run, POSITION_OUT, POSITION_STATE, "append", GroupStateTimeout.NoTimeout)


def drawdown_alerts(equity: DataFrame, limit: float = 0.10) -> DataFrame:
    """One alert per book (book, ts, equity) each time it falls ``limit`` below its peak, and one on recovery to half of that."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peak, on = state.get if state.exists else (float("-inf"), False)
        out = []
        for r in pd.concat(list(parts)).sort_values("ts", kind="stable").itertuples(index=False):
            peak = max(peak, r.equity)
            down = r.equity / peak - 1
            if (not on and down <= -limit) or (on and down >= -limit / 2):
                on = not on
                out.append((key[0], r.ts, down, "DRAWDOWN" if on else "RECOVERED"))
        state.update((peak, on))
        yield pd.DataFrame(out, columns=["book", "ts", "drawdown", "alert"])

    return equity.groupBy("book").applyInPandasWithState(run, "book string, ts timestamp, drawdown double, alert string", "peak double, on boolean", "append", GroupStateTimeout.NoTimeout)


def reconciler(broker: DataFrame, book: Callable[[], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Each batch of broker positions against the book as it is then: its differences, with ``pause`` where any is large."""

    def land(batch: DataFrame, n: int) -> None:
        found = reconcile(book(), batch)
        pause = found.agg(F.coalesce(F.bool_or("is_large"), F.lit(False)).alias("pause"))
        found.crossJoin(pause).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return broker.writeStream.option("checkpointLocation", checkpoint).foreachBatch(land)


def append_once(log: DataFrame, late: str = "7 days") -> DataFrame:
    """Forward-log rows (date, symbol, ts) once per key."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["date", "symbol"])


def shock_sessions(shocks: DataFrame, gap: str = "2 days", late: str = "7 days") -> DataFrame:
    """Shocks (ticker, ts, abs_ret) in sessions at most ``gap`` apart."""
    grouped = shocks.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "ticker")
    return grouped.agg(F.count(F.lit(1)).alias("days"), F.max("abs_ret").alias("peak_abs_ret")).select("ticker", C("w.start").alias("start"), C("w.end").alias("end"), "days", "peak_abs_ret")
