"""Queries over texts, events and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import mask_secrets
from ..operators import events, patterns, timejoins
from ..operators.events import BEAR_WORDS, BULL_WORDS, HOME_WORDS, TOPIC_KEYWORDS, TOPIC_WEIGHTS
from ..operators.panel import brand_bars
from .catalog import query, rounded
from .risk_queries import VOLATILITY_SQL

C = F.col


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def _count(words) -> str:
    return "(" + " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in words) + ")"


_TOPICS = "list_filter([" + ", ".join(f"CASE WHEN {_any(k)} THEN '{t}' END" for t, k in TOPIC_KEYWORDS.items()) + "], lambda x: x IS NOT NULL)"
_BEST = "list_max(list_transform(topics, lambda x: CASE x " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in TOPIC_WEIGHTS.items()) + " END))"


@query(
    f"""WITH d AS (SELECT doc_id, source, lower(coalesce(text, '')) AS t, n_chars FROM documents), l AS (SELECT *, {_TOPICS} AS found, {_any(HOME_WORDS)} AS home FROM d),
p AS (SELECT *, CASE WHEN len(found) = 0 THEN ['general'] ELSE found END AS topics FROM l)
SELECT doc_id, array_to_string(topics, ',') AS topics, round(least(greatest(0.35 * {_BEST} + 0.25 * ln(1 + n_chars) / ln(1001) + 0.2 * ln(1 + doc_id % 100) / ln(101) + 0.1 * least(abs(CAST(doc_id % 7 AS DOUBLE)) / 10, 1) + 0.1 * CASE WHEN home THEN 1.0 ELSE 0.55 END, 0), 1), 6) AS relevance FROM p"""
)
def event_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("topics", events.topics(C("text")))
    score = events.relevance(C("topics"), C("n_chars"), C("doc_id") % 100, (C("doc_id") % 7).cast("double"), F.lit(""), C("text"))
    return rounded(d.select("doc_id", F.array_join("topics", ",").alias("topics"), score.alias("relevance")))


@query(
    f"""WITH d AS (SELECT source, lower(coalesce(text, '')) AS t FROM documents), h AS (SELECT source, {_count(BULL_WORDS)} AS bull, {_count(BEAR_WORDS)} AS bear FROM d),
s AS (SELECT source, count(*) AS n, sum(bull)::BIGINT AS bull, sum(bear)::BIGINT AS bear, avg(bull - bear) AS score FROM h GROUP BY source)
SELECT source, n, bull, bear, round(score, 6) AS score, CASE WHEN bull > 0 AND bear > 0 AND abs(score) < 0.1 THEN 'mixed' WHEN score > 0.1 THEN 'bullish' WHEN score < -0.1 THEN 'bearish' ELSE 'neutral' END AS label FROM s"""
)
def source_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.sentiment(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.coalesce("text", F.lit(""))), ["source"]))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0),
c AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS cosine FROM q JOIN e ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS nth FROM c WHERE cosine >= 0.3)
SELECT query_id, item_id, round(cosine, 5) AS cosine, nth FROM r WHERE nth <= 7"""
)
def similar_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(C("vec_id").alias("item_id"), C("embedding").alias("vector"))
    out = patterns.similar(e.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), e)
    return rounded(out.select("query_id", "item_id", "cosine", C("nth").cast("long").alias("nth")), 5)


@query(
    f"""WITH {{BARS}}, {VOLATILITY_SQL}, j AS (SELECT v.ticker, v.start, v."end", b.date, b.volume / (b.volume + 50) * (1 + v.severity) AS weight FROM v JOIN bars b ON b.ticker = v.ticker AND b.date BETWEEN v.start - 2 AND v."end" + 3),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker, start ORDER BY weight DESC, date) AS INTEGER) AS nth FROM j) SELECT ticker, start, "end", date, round(weight, 5) AS weight, nth FROM n WHERE nth <= 5""",
    days='start "end" date',
)
def matched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days as events of a brand, matched to its volatility windows."""
    bars = brand_bars(spark, sf_dir)
    windows = events.volatility_windows(bars).select("ticker", "start", "end", "severity")
    days = bars.select("ticker", "date", (C("volume") / (C("volume") + 50)).alias("relevance"))
    return rounded(timejoins.matched_events(days, windows).select("ticker", "start", "end", "date", "weight", "nth"), 5)


_NAMES = "api[_-]?key|token|secret|password|passwd|authorization|credential"
_MASKED = rf"regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\b([\w-]*(?:{_NAMES})[\w-]*)\s*[=:]\s*[^\s,;&]+', '\1=***', 'g'), '(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer ***', 'g')"


@query(f"SELECT doc_id, sha256({_MASKED}) AS masked_sha, {_MASKED} <> text AS changed FROM documents")
def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.sha2(mask_secrets(F.coalesce("text", F.lit(""))), 256).alias("masked_sha"), (mask_secrets(C("text")) != C("text")).alias("changed"))


@query()
def match_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the mean event value per user, weighted by type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = e.select(C("user_id").alias("group"), C("value").alias("ret"), (1 + C("event_id") % 3).cast("double").alias("weight"))
    return rounded(events.bootstrap_interval(m, draws=500), 4)


@query(
    """WITH e AS (SELECT event_id, 'T' || event_id AS ticker, CASE WHEN event_id % 5 > 0 THEN ['GREEN', 'AMBER', 'RED'][event_id % 3 + 1] END AS regime, (event_id % 100) / 100.0 AS score, value / 20 AS r, repeat(event_type || ' ', (event_id % 60)::INTEGER) AS reason, (event_id % 8)::DOUBLE AS w FROM events)
SELECT ticker, regime IS NOT NULL AS kevpe_available, regime AS kevpe_regime, CASE WHEN regime IS NOT NULL THEN score END AS kevpe_score, CASE WHEN regime IS NOT NULL THEN round(r, 4) END AS kevpe_expected_return_pct, CASE WHEN regime IS NOT NULL THEN round(r - w / 2, 4) END AS low, CASE WHEN regime IS NOT NULL THEN round(r + w / 2, 4) END AS high,
  CASE WHEN regime IS NOT NULL THEN CASE WHEN (r + w / 2) - (r - w / 2) > 5 THEN 'low' WHEN (r + w / 2) - (r - w / 2) > 2 THEN 'medium' ELSE 'high' END END AS kevpe_confidence, CASE WHEN regime IS NOT NULL THEN substr(reason, 1, 200) END AS kevpe_reason FROM e"""
)
def pattern_supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a pattern signal, a fifth of them without one."""
    n, r, w = C("event_id"), C("value") / 20, (C("event_id") % 8).cast("double") / 2
    signals = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("T"), n.cast("string")).alias("ticker"), F.when(n % 5 > 0, F.element_at(F.array(*map(F.lit, ("GREEN", "AMBER", "RED"))), (n % 3 + 1).cast("int"))).alias("regime"), ((n % 100) / 100.0).alias("risk_score"), r.alias("expected_return"),
        (r - w).alias("ci_low"), (r + w).alias("ci_high"), F.repeat(F.concat("event_type", F.lit(" ")), (n % 60).cast("int")).alias("reason"),
    )
    out = events.supplement(signals)
    return rounded(out.select("ticker", "kevpe_available", "kevpe_regime", "kevpe_score", "kevpe_expected_return_pct", F.element_at("kevpe_ci", 1).alias("low"), F.element_at("kevpe_ci", 2).alias("high"), "kevpe_confidence", "kevpe_reason"), 4)
