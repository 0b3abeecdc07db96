"""Streams over the events, stopped halfway and taken up again from their checkpoint, against the same rows in batch.

The events are landed in two parts. Each stream runs to the end of the first, stops, and a
new one starts from its checkpoint when the second is there, so states and keys seen must
survive. Sinks are written by batch number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.shared import shared_path
from ..streaming import jobs
from .catalog import query, rounded

C = F.col
_HALF = "h AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS half FROM events)"


def halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", C("ts").cast("timestamp"))
    ends = events.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("half"))
    split = events.crossJoin(ends)  # one row
    return [split.filter("ts < half").drop("half"), split.filter("ts >= half").drop("half")]


def resumed(spark: SparkSession, parts: list[DataFrame], build: Callable[[DataFrame, str, str], DataStreamWriter]) -> str:
    """Runs the stream that ``build`` makes of (input, output path, checkpoint) once per part; the output's path."""
    root = shared_path(spark, "stream")
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        run = build(jobs.file_stream(spark, f"{root}/in", part.schema), f"{root}/out", f"{root}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return f"{root}/out"


@query(
    """WITH RECURSIVE r AS (SELECT user_id, ts, 50 + value AS price, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS price, '-inf'::DOUBLE AS peak, '-inf'::DOUBLE AS stop, 'NEW' AS status, false AS told FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, n, ts, price, peak, stop, CASE WHEN was = 'STOPPED' THEN was ELSE now END, was <> 'STOPPED' AND now <> was FROM (
    SELECT *, CASE WHEN price <= stop THEN 'STOPPED' WHEN price <= 1.02 * stop THEN 'STOP_NEAR' ELSE 'OPEN' END AS now FROM (
      SELECT *, CASE WHEN peak >= 100 THEN greatest(low, 60 + 0.5 * (peak - 60)) ELSE low END AS stop FROM (
        SELECT r.user_id, r.n, r.ts, r.price, greatest(s.peak, r.price) AS peak, greatest(s.stop, 50.5) AS low, s.status AS was FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1))))
SELECT 'u' || user_id AS ticker, CAST(ts AS VARCHAR) AS ts, round(price, 4) AS price, round(peak, 4) AS peak, round(stop, 4) AS stop, status FROM s WHERE told"""
)
def streamed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position per user on its events as quotes; the states live over the restart."""

    def build(events: DataFrame, out: str, state: str) -> DataStreamWriter:
        quotes = events.select(F.concat(F.lit("u"), C("user_id").cast("string")).alias("ticker"), "ts", (50 + C("value")).alias("price"), F.lit(60.0).alias("entry"), F.lit(50.5).alias("stop"), F.lit(100.0).alias("tp1"))
        return jobs.to_batches(jobs.position_states(quotes), out, state)

    rows = spark.read.parquet(resumed(spark, halves(spark, sf_dir), build)).drop("batch")
    return rounded(rows.withColumn("ts", C("ts").cast("string")), 4)


@query(
    """WITH RECURSIVE r AS (SELECT event_type, ts, 1000 + value AS equity, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events),
s AS (SELECT event_type, 0::BIGINT AS n, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS down, '-inf'::DOUBLE AS peak, false AS alert, false AS told FROM (SELECT DISTINCT event_type FROM events)
  UNION ALL SELECT event_type, n, ts, down, peak, alert <> told, told FROM (SELECT *, (NOT alert AND down <= -0.1) OR (alert AND down >= -0.05) AS told FROM (
    SELECT r.event_type, r.n, r.ts, r.equity / greatest(s.peak, r.equity) - 1 AS down, greatest(s.peak, r.equity) AS peak, s.alert FROM s JOIN r ON r.event_type = s.event_type AND r.n = s.n + 1)))
SELECT event_type AS book, CAST(ts AS VARCHAR) AS ts, round(down, 6) AS drawdown, CASE WHEN alert THEN 'DRAWDOWN' ELSE 'RECOVERED' END AS alert FROM s WHERE told"""
)
def streamed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book per kind of event; its peak and whether an alert is open live over the restart."""

    def build(events: DataFrame, out: str, state: str) -> DataStreamWriter:
        return jobs.to_batches(jobs.drawdown_alerts(events.select(C("event_type").alias("book"), "ts", (1000 + C("value")).alias("equity"))), out, state)

    rows = spark.read.parquet(resumed(spark, halves(spark, sf_dir), build)).drop("batch")
    return rounded(rows.withColumn("ts", C("ts").cast("string")))


@query("SELECT CAST(ts::DATE AS VARCHAR) AS date, 'u' || user_id AS symbol, 1::BIGINT AS entries FROM events GROUP BY ALL")
def streamed_forward_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per day and user, whatever the number of events; the half falls within a day, whose keys are known after the restart."""

    def build(events: DataFrame, out: str, state: str) -> DataStreamWriter:
        return jobs.to_batches(jobs.append_once(events.select(F.to_date("ts").alias("date"), F.concat(F.lit("u"), C("user_id").cast("string")).alias("symbol"), "ts")), out, state)

    rows = spark.read.parquet(resumed(spark, halves(spark, sf_dir), build))
    return rows.groupBy("date", "symbol").agg(F.count(F.lit(1)).alias("entries"))


@query("SELECT 'u' || user_id AS ticker, CAST(max(ts) AS VARCHAR) AS updated_at, arg_max(event_type, ts) AS payload, (SELECT max(ts) FROM events) - max(ts) > INTERVAL 3600 SECONDS AS stale FROM events GROUP BY user_id")
def streamed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, and whether it is over an hour older than the newest of all."""

    def build(events: DataFrame, out: str, state: str) -> DataStreamWriter:
        return jobs.snapshot_table(events.select(F.concat(F.lit("u"), C("user_id").cast("string")).alias("ticker"), C("ts").alias("updated_at"), C("event_type").alias("payload")), out, state)

    rows = jobs.newest_snapshots(spark, resumed(spark, halves(spark, sf_dir), build))
    rows = jobs.stale(rows.crossJoin(rows.agg(F.max("updated_at").alias("now"))), C("now")).drop("now")
    return rows.withColumn("updated_at", C("updated_at").cast("string"))


@query(
    f"""WITH {_HALF}, p AS (SELECT CAST(ts >= half AS INTEGER) AS batch, 'u' || user_id AS ticker, sum(value) AS q FROM events, h GROUP BY ALL), b AS (SELECT ticker, q FROM p WHERE batch = 0),
j AS (SELECT k.batch, ticker, coalesce(b.q, 0) AS ours, coalesce(p.q, 0) AS theirs FROM (SELECT unnest(range(2)) AS batch) k CROSS JOIN (SELECT DISTINCT ticker FROM p) LEFT JOIN b USING (ticker) LEFT JOIN p USING (batch, ticker)),
d AS (SELECT *, theirs - ours AS difference, abs(theirs - ours) > 0.05 * greatest(abs(ours), abs(theirs)) AS is_large FROM j WHERE abs(theirs - ours) > 1e-9)
SELECT CAST(batch AS INTEGER) AS batch, ticker, round(ours, 4) AS ours, round(theirs, 4) AS theirs, round(difference, 4) AS difference, is_large, bool_or(is_large) OVER (PARTITION BY batch) AS pause FROM d"""
)
def streamed_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each half as the broker's positions against a book of the first half."""
    parts = [p.groupBy(F.concat(F.lit("u"), C("user_id").cast("string")).alias("ticker")).agg(F.sum("value").alias("quantity")) for p in halves(spark, sf_dir)]
    out = resumed(spark, parts, lambda broker, path, state: jobs.reconciler(broker, lambda: parts[0], path, state))
    return rounded(spark.read.parquet(out), 4)
