"""Dashboard snapshots: ranked, nested rows of results, written as JSON lines and read back.

Results come with the columns that their run had. Those that every row must have are
checked; the others are filled with null, or with the first alternative that is there, so a
snapshot always has one schema. Ranks are those of a distributed sort: the rows are written
once in order, and each partition starts after the rows of the ones before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity
from .shared import landed

C = F.col
# What a result must have, and the parts of a row with their fields and kinds.
REQUIRED = ("ticker", "track", "verdict", "recommendation_rank_score", "direction_prob", "expected_value_pct", "entry", "stop", "tp2", "risk_reward", "screening_output_only", "validations")
PARTS = {
    "plan": "entry double, latest_close double, stop double, tp1 double, tp2 double, stop_pct double, tp2_pct double, risk_reward double, risk_budget_pct double, max_position_pct double, suggested_quantity double, suggested_position_value double",
    "model": "model_accuracy double, model_auc double, oof_coverage double, model_kind_used string, tft_prob double",
    "backtest": "backtest_return_pct double, alpha_pct double, completed_trades long, backtest_sharpe double, backtest_sortino double, backtest_mdd_pct double, profit_factor double",
    "sizing": "size_multiplier double, sizing_strategy_used string, sizing_coverage_status string",
    "pattern": "kevpe_available boolean, kevpe_regime string, kevpe_score double, kevpe_expected_return_pct double, kevpe_confidence string, kevpe_reason string",
    "advisor": "advisor_score double, advisor_rationale string, advisor_regime string",
}
#: Other names under which a field may come, in order.
ALTERNATIVES = {
    "alpha_pct": ("alpha_pct", "backtest_alpha_pct", "benchmark_alpha_pct", "alpha"),
    "completed_trades": ("completed_trades", "completedTrades", "n_trades", "trade_count"),
    "raw_score": ("raw_score", "recommendation_rank_score"),
}
DEFAULTS = {"kevpe_available": False}
RATIONALE = 240


def _field(results: DataFrame, name: str, kind: str) -> Column:
    """The field, the first alternative that is there and not null, its default or null."""
    there = [C(c).cast("string").try_cast(kind) if kind in ("double", "long") else C(c).cast(kind) for c in ALTERNATIVES.get(name, (name,)) if c in results.columns]
    found = F.coalesce(*there, F.lit(DEFAULTS.get(name)).cast(kind))
    if name == "advisor_rationale":
        found = F.when(F.length(found) > RATIONALE, F.concat(F.substring(found, 1, RATIONALE - 3), F.lit("..."))).otherwise(found)
    return found.alias(name)


def ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``rank`` from 1, by a sort over all partitions."""
    sorted_ = rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    kept = landed(sorted_, "ranked")
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row per partition
    return kept.join(before, "_part").withColumn("rank", C("before") + C("_at") + 1).drop("_part", "_at", "before")


def snapshot(results: DataFrame) -> DataFrame:
    """One nested row per result: rank, ticker, track, verdict, status, scores, the parts, and validations.

    Results that do not say ``screening_output_only`` are an error, as missing columns are.
    """
    if missing := sorted(set(REQUIRED) - set(results.columns)):
        raise ValueError(f"results lack {', '.join(missing)}")
    safe = F.when(F.coalesce(C("screening_output_only"), F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("not marked as screening output only: "), C("ticker"))).cast("boolean"))
    rows = ranked(results, [severity(C("verdict")).desc(), C("recommendation_rank_score").desc(), C("ticker"), C("track")])
    status = F.when(severity(C("verdict")) == 3, "PASS").when(severity(C("verdict")) == 2, "AMBER").otherwise("RED")
    parts = [F.struct(*(_field(results, *f.split()) for f in fields.split(", "))).alias(part) for part, fields in PARTS.items()]
    scores = F.struct(C("recommendation_rank_score").cast("double").alias("score"), _field(results, "raw_score", "double"), C("direction_prob").cast("double").alias("probability"), C("expected_value_pct").cast("double").alias("expected_value_pct"))
    reasons = F.coalesce(C("reasons"), F.array().cast("array<string>")) if "reasons" in results.columns else F.array().cast("array<string>")
    return rows.select(C("rank").cast("long").alias("rank"), "ticker", "track", "verdict", status.alias("status"), scores.alias("scores"), *parts, "validations", reasons.alias("reasons"), safe.alias("screening_output_only"))


def summary(rows: DataFrame) -> DataFrame:
    """One row beside the snapshot: how many results, eligible ones and of each status."""
    of = lambda s: F.count_if(C("status") == s).alias(s.lower())
    return rows.agg(F.count(F.lit(1)).alias("result_count"), F.count_if(severity(C("verdict")) == 3).alias("eligible"), of("PASS"), of("AMBER"), of("RED"), F.min_by("verdict", "rank").alias("best"), F.max_by("verdict", "rank").alias("worst"))


def write(rows: DataFrame, path: str) -> None:
    """JSON lines with nulls written out, so that every row shows every field."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).option("mode", "FAILFAST").json(path)


def approval_template(results: DataFrame) -> DataFrame:
    """The rows of a run for a reviewer to fill in."""
    known = [_field(results, c, "double") for c in ("entry", "stop", "tp1", "tp2", "risk_reward", "suggested_quantity", "suggested_position_value")]
    blank = [F.lit("").alias(c) for c in ("reviewer", "reviewed_at", "final_decision", "journal_reason")]
    return results.select("ticker", "track", "verdict", C("recommendation_rank_score").alias("score"), *known, F.lit("REVIEW_PENDING").alias("manual_action"), F.lit(True).alias("manual_approval_required"), F.lit(False).alias("broker_order_execution"), "screening_output_only", *blank)
