"""JSON lines, journals and result payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import mask_secrets, stable_sha

C = F.col

AUDIT = (
    "event_type string, status string, command string, ticker string, period string, provider_requested string, provider_used string,"
    " endpoint string, source string, message string, error_type string, duration_ms double, metadata map<string,string>, timestamp_utc timestamp"
)


def append_audit(events: DataFrame, path: str) -> None:
    """Appends audit events as JSON lines with secrets masked in messages and metadata."""
    hidden = F.map_from_entries(F.transform(F.map_entries("metadata"), lambda e: F.struct(e["key"], mask_secrets(e["value"], e["key"]).alias("value"))))
    events.withColumn("message", mask_secrets(C("message"))).withColumn("metadata", F.when(C("metadata").isNotNull(), hidden)).write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events; malformed lines are skipped."""
    return spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path)


def counted_write(df: DataFrame, path: str, log: str, event: str) -> int:
    """Writes a table and appends its row count, observed on the way, to a provenance log."""
    seen = Observation(event)
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    rows = seen.get["rows"]
    df.sparkSession.createDataFrame([(event, path, rows)], "event string, path string, rows long").withColumn("at", F.current_timestamp()).write.mode("append").json(log)
    return rows


def append_forward(log: DataFrame, batch: DataFrame, path: str, rerun_reason: str | None = None) -> None:
    """Appends to the forward log; a (date, symbol) that repeats, here or there, needs a reason."""
    keys = ["date", "symbol"]
    if rerun_reason is None:
        twice = batch.groupBy(*keys).count().filter("count > 1")
        known = batch.join(log.select(*keys), keys, "left_semi")
        if not twice.isEmpty() or not known.isEmpty():
            raise ValueError("a (date, symbol) is there already")
    batch.withColumn("rerun_reason", F.lit(rerun_reason).cast("string")).write.mode("append").parquet(path)


def journalled(entries: DataFrame) -> DataFrame:
    """Entries with the digest of their stable JSON."""
    return entries.withColumn("sha256", stable_sha(*map(C, sorted(entries.columns))))


def eligible(rows: DataFrame) -> DataFrame:
    return rows.filter(C("verdict").isin("ELIGIBLE_RECOMMENDATION", "ACCUMULATE_RECOMMENDATION"))


def open_positions(spark: SparkSession, path: str) -> DataFrame:
    """Eligible rows of a payload file (results: array of rows)."""
    return eligible(spark.read.option("multiLine", True).json(path).select(F.inline("results")))


def factor_status(audit: DataFrame) -> DataFrame:
    """The last lifecycle event of each factor as its status."""
    last = audit.groupBy("factor").agg(F.max_by("event", "at").alias("event"), F.max("at").alias("at"))
    return last.withColumn("status", F.when(C("event") == "approved", "ACTIVE").when(C("event") == "retired", "RETIRED").when(C("event") == "rejected", "REJECTED").otherwise("PENDING"))


def trade_plan(candidates: DataFrame, value: float) -> DataFrame:
    """Order terms of candidates with a risk plan: reward to risk, risk in money, share of the portfolio."""
    risk = (C("entry") - C("stop")) * C("quantity")
    return candidates.filter("quantity > 0 and stop < entry").select("ticker", "entry", "stop", "tp2", "quantity", ((C("tp2") - C("entry")) / (C("entry") - C("stop"))).alias("reward_to_risk"), risk.alias("risk_value"), (C("quantity") * C("entry") / value).alias("portfolio_share"))


def ops_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of verdicts by their first word."""
    has = lambda s: F.count_if(C("verdict").startswith(s)).alias(s.lower())
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), has("ELIGIBLE"), has("AMBER"), has("RED"), has("ZERO"))


def latest_run(runs: DataFrame, by: Column | str = "run_id") -> DataFrame:
    """Rows of the newest run."""
    return runs.join(F.broadcast(runs.agg(F.max(by).alias("run_id"))), "run_id", "left_semi")


def run_status(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The newest run's positions, rejections and drawdown of its equity. ``runs``: run_id, status, equity.

    Of an equity that is never above 0 the drawdown is not a number, as in floating point.
    """
    low, high = F.min("equity"), F.max("equity")
    share = F.when(high == 0, low * float("inf")).otherwise(low / high)
    return latest_run(runs).groupBy("run_id", *by).agg(F.count(F.lit(1)).alias("positions"), F.count_if(C("status") == "REJECTED").alias("rejected"), (share - 1).alias("drawdown"))
