"""Memory tables, journals and alerts: newest-k retrieval, upserts and trims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def newest(df: DataFrame, by: Sequence[str], k: int, order: Sequence[Column | str]) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(C("nth") <= k)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``new`` rows replace ``old`` ones of the same keys; null ``keep`` columns keep the old value."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, F.lit(True).alias("_new"), *(C(c).alias(f"_n_{c}") for c in rest))
    both = old.withColumn("_old", F.lit(True)).join(n, list(keys), "full_outer")
    pick = lambda c: F.when(C("_new"), F.coalesce(f"_n_{c}", c) if c in keep else C(f"_n_{c}")).otherwise(C(c)).alias(c)
    return both.select(*keys, *map(pick, rest))


def set_outcome(memory: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes (session_id, outcome) written into the memory's rows."""
    return memory.join(outcomes.select("session_id", C("outcome").alias("_o")), "session_id", "left").withColumn("outcome", F.coalesce("_o", "outcome")).drop("_o")


def trimmed(memory: DataFrame, per_regime: int = 1000, since: Column | None = None) -> DataFrame:
    kept = newest(memory, ["regime"], per_regime, [F.desc("ts"), "session_id"]).drop("nth")
    return kept if since is None else kept.filter(C("ts") >= since)


def memory_stats(memory: DataFrame) -> DataFrame:
    """Entries, those with an outcome, and the newest time per regime."""
    return memory.groupBy("regime").agg(F.count(F.lit(1)).alias("entries"), F.count("outcome").alias("outcomes"), F.max("ts").alias("newest"))


def retrieve(requests: DataFrame, episodes: DataFrame, patterns: DataFrame, procedures: DataFrame, k: int = 3) -> DataFrame:
    """Per (ticker, regime, advisor): newest episodes, best patterns of the regime, and the procedure."""
    e = newest(episodes, ["ticker", "regime"], k, [F.desc("ts"), "session_id"]).groupBy("ticker", "regime").agg(F.array_sort(F.collect_list(F.struct("nth", "session_id"))).alias("episodes"))
    p = newest(patterns, ["regime"], k, [F.desc("confidence"), "pattern"]).groupBy("regime").agg(F.array_sort(F.collect_list(F.struct("nth", "pattern"))).alias("patterns"))
    return requests.join(e, ["ticker", "regime"], "left").join(p, "regime", "left").join(procedures.select("advisor", "regime", "procedure"), ["advisor", "regime"], "left")


def headlines(news: DataFrame, tickers: DataFrame, cap: int = 12) -> DataFrame:
    """One row per url, matched to the tickers its title names as a word; the newest ``cap`` of each."""
    words = F.array_distinct(F.split(F.upper("title"), r"[^A-Z0-9.]+"))
    one = news.dropDuplicates(["url"]).select("*", F.explode(words).alias("ticker"))
    return newest(one.join(tickers.select(F.upper("ticker").alias("ticker")).distinct(), "ticker"), ["ticker"], cap, [F.desc("published"), "url"])


def alerts(positions: DataFrame, book: DataFrame, models: DataFrame) -> DataFrame:
    """All rules' alerts as (rule, key, value): stops and targets near, closings, exposure, drawdown, model quality."""
    w = Window.partitionBy("ticker").orderBy("date")
    p = positions.withColumn("was", F.lag("status").over(w))
    rules = [
        p.filter((C("status") == "OPEN") & (C("price") <= 1.02 * C("stop"))).select(F.lit("STOP_NEAR").alias("rule"), C("ticker").alias("key"), C("price").alias("value")),
        p.filter((C("status") == "OPEN") & (C("price") >= 0.98 * C("tp1"))).select(F.lit("TARGET_NEAR"), "ticker", "price"),
        p.filter((C("status") != "OPEN") & (C("was") == "OPEN")).select(F.lit("CLOSED"), "ticker", "price"),
        book.filter("exposure > 0.95").select(F.lit("EXPOSURE"), "book", "exposure"),
        book.filter("drawdown <= -0.10").select(F.lit("DRAWDOWN"), "book", "drawdown"),
        models.filter("auc < 0.52").select(F.lit("MODEL_AUC"), "ticker", "auc"),
        models.filter("oof_coverage < 0.5").select(F.lit("MODEL_COVERAGE"), "ticker", "oof_coverage"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.union(r)
    return out


def journal_ids(entries: DataFrame) -> DataFrame:
    """JRN-YYYY-MMDD-T-TRACK-SEQ, numbered within day, ticker and track."""
    seq = F.row_number().over(Window.partitionBy("day", "ticker", "track").orderBy("ts"))
    return entries.withColumn("journal_id", F.format_string("JRN-%s-%s-%s-%03d", F.date_format("day", "yyyy-MMdd"), C("ticker"), C("track"), seq))
