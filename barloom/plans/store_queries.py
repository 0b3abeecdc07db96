"""Queries over stores, memory, books, events and scores that other modules do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import VERDICT_SEVERITY, to_utc
from ..operators import allocation, events, gates, memory, paper, stats, timejoins
from ..operators.panel import brand_bars, field
from ..sources import dashboard, lake, logs
from ..sources.shared import shared_path
from .catalog import query, rounded
from .gate_queries import _events, _mod, _names, _pick, _sql_pick, _sql_reasons
from .risk_queries import _RET, _W, daily_returns, returns_of

C = F.col
_DAY = "2024-01-20 12:00:00"


@query("WITH {BARS} SELECT ticker, date, round(close, 8) AS close, CAST(day(date) AS DOUBLE) AS primary_score, 5.0 / 1e4 AS cost_return FROM bars", days="date")
def long_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars exported as CSV per ticker under the feed's own names, read back by name, then as a long panel with a defaulted column."""
    bars, root = brand_bars(spark, sf_dir), shared_path(spark, "csv")
    lake.export_csv(bars, f"{root}/bars")
    feed = spark.read.option("header", True).csv(f"{root}/bars").withColumnsRenamed({"date": "날짜", "close": "종가"})
    back = lake.renamed(feed)
    back.select(C("date").alias("Date"), C("ticker").alias("Asset"), F.dayofmonth(C("date").cast("date")).alias("primary_score"), C("close").alias("fwd_return")).write.option("header", True).csv(f"{root}/panel")
    out = lake.from_long_csv(spark, f"{root}/panel")
    return rounded(out.select("ticker", "date", C("fwd_return").alias("close"), "primary_score", "cost_return"), {"close": 8})


@query(
    f"""WITH y AS (SELECT * FROM events WHERE epoch(TIMESTAMP '{_DAY}') - epoch(ts) <= 240 * 3600) SELECT user_id AS key, count(*) AS entries, arg_max(event_id, ts) AS value FROM y WHERE user_id <> 3 GROUP BY user_id"""
)
def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of each key not older than ten days, one key invalidated."""
    now = F.lit(_DAY).cast("timestamp")
    entries = _events(spark, sf_dir).select(C("user_id").cast("string").alias("key"), C("ts").cast("timestamp").alias("stored_at"), C("event_id").alias("value"))
    young = lake.without(entries, "3", now, 240.0)
    counts = young.groupBy("key").agg(F.count(F.lit(1)).alias("entries"))
    return lake.fresh(young, now, 240.0).join(counts, "key").select(C("key").cast("long").alias("key"), "entries", "value")


_VERDICTS = ("ELIGIBLE_RECOMMENDATION", "ACCUMULATE_RECOMMENDATION", "AMBER_REVIEW_ONLY", "RED_NOT_RECOMMENDED")


@query(f"SELECT event_id AS ticker, {_sql_pick(_VERDICTS, 'event_id')} AS verdict, value AS score FROM events WHERE event_id % 4 < 2")
def eligible_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible rows of payload files, one file of results per user."""
    root = shared_path(spark, "payload")
    rows = _events(spark, sf_dir).select("user_id", C("event_id").alias("ticker"), _pick(_VERDICTS, C("event_id")).alias("verdict"), C("value").alias("score"))
    rows.groupBy("user_id").agg(F.collect_list(F.struct("ticker", "verdict", "score")).alias("results")).write.json(root)
    found = spark.read.json(root).select(F.inline("results"))
    return logs.eligible(found).select("ticker", "verdict", "score")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results of a run that has some of the optional fields, one of them under another name."""
    n = C("event_id")
    check = F.struct(F.lit("DATA").alias("name"), F.when(n % 3 == 0, "PASS").otherwise("AMBER").alias("status"))
    return _events(spark, sf_dir).select(
        F.concat(F.lit("T"), n.cast("string")).alias("ticker"), F.when(n % 2 == 0, "S").otherwise("L").alias("track"), _pick(_VERDICTS, n).alias("verdict"), F.round("value", 2).alias("recommendation_rank_score"),
        ((n % 100) / 100.0).alias("direction_prob"), (C("value") / 10).alias("expected_value_pct"), (C("value") + 10).alias("entry"), (C("value") + 9).alias("stop"), (C("value") + 13).alias("tp2"), F.lit(3.0).alias("risk_reward"),
        F.lit(True).alias("screening_output_only"), F.array(check).alias("validations"), F.when(n % 5 > 0, n % 90).alias("n_trades"), F.when(n % 4 > 0, C("value")).alias("backtest_alpha_pct"), F.lit(1.5).alias("alpha"),
        F.when(n % 7 > 0, F.repeat(C("event_type"), (n % 60).cast("int"))).alias("advisor_rationale"),
    )


@query(
    f"""WITH e AS (SELECT 'T' || event_id AS ticker, CASE WHEN event_id % 2 = 0 THEN 'S' ELSE 'L' END AS track, {_sql_pick(_VERDICTS, "event_id")} AS verdict, round(value, 2) AS score, event_id AS n, value, repeat(event_type, (event_id % 60)::INTEGER) AS r FROM events),
s AS (SELECT *, CASE verdict WHEN 'ELIGIBLE_RECOMMENDATION' THEN {VERDICT_SEVERITY.get("ELIGIBLE_RECOMMENDATION", 0)} WHEN 'ACCUMULATE_RECOMMENDATION' THEN {VERDICT_SEVERITY.get("ACCUMULATE_RECOMMENDATION", 0)} WHEN 'AMBER_REVIEW_ONLY' THEN {VERDICT_SEVERITY.get("AMBER_REVIEW_ONLY", 0)} ELSE {VERDICT_SEVERITY.get("RED_NOT_RECOMMENDED", 0)} END AS sev FROM e)
SELECT row_number() OVER (ORDER BY sev DESC, score DESC, ticker, track) AS rank, ticker, track, verdict, CASE sev WHEN 3 THEN 'PASS' WHEN 2 THEN 'AMBER' ELSE 'RED' END AS status, score AS raw_score, round(value + 13, 4) AS tp2, NULL::DOUBLE AS tp1, CASE WHEN n % 5 > 0 THEN n % 90 END AS trades,
  round(CASE WHEN n % 4 > 0 THEN value ELSE 1.5 END, 4) AS alpha_pct, CASE WHEN n % 7 > 0 THEN CASE WHEN length(r) > 240 THEN substr(r, 1, 237) || '...' ELSE r END END AS rationale, false AS pattern_there, CASE WHEN n % 3 = 0 THEN 'PASS' ELSE 'AMBER' END AS first_check FROM s"""
)
def dashboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows written as JSON lines, read back and flattened."""
    rows, path = dashboard.snapshot(_results(spark, sf_dir)), shared_path(spark, "dashboard")
    dashboard.write(rows, path)
    back = dashboard.read(spark, path, rows)
    return back.select(
        "rank", "ticker", "track", "verdict", "status", C("scores.raw_score").alias("raw_score"), F.round("plan.tp2", 4).alias("tp2"), C("plan.tp1").alias("tp1"), C("backtest.completed_trades").alias("trades"), F.round("backtest.alpha_pct", 4).alias("alpha_pct"),
        C("advisor.advisor_rationale").alias("rationale"), C("pattern.kevpe_available").alias("pattern_there"), F.element_at("validations", 1)["status"].alias("first_check"),
    )


@query(
    f"""SELECT 'T' || event_id AS ticker, CASE WHEN event_id % 2 = 0 THEN 'S' ELSE 'L' END AS track, {_sql_pick(_VERDICTS, "event_id")} AS verdict, round(value, 2) AS score, round(value + 10, 4) AS entry, round(value + 9, 4) AS stop, NULL::DOUBLE AS tp1, round(value + 13, 4) AS tp2, 3.0::DOUBLE AS risk_reward, NULL::DOUBLE AS suggested_quantity, NULL::DOUBLE AS suggested_position_value,
  'REVIEW_PENDING' AS manual_action, true AS manual_approval_required, false AS broker_order_execution, true AS screening_output_only, '' AS reviewer, '' AS reviewed_at, '' AS final_decision, '' AS journal_reason FROM events"""
)
def approval_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dashboard.approval_template(_results(spark, sf_dir)), 4)


@query(
    """WITH r AS (SELECT ts::DATE AS run_id, user_id, event_type, value, event_id FROM events), l AS (SELECT * FROM r WHERE run_id = (SELECT max(run_id) FROM r))
SELECT CAST(run_id AS VARCHAR) AS run_id, user_id, count(*) AS positions, count(*) FILTER (event_type = 'error') AS rejected, round(min(value) / max(value) - 1, 6) AS drawdown FROM l GROUP BY ALL"""
)
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run's positions, rejections and drawdown."""
    runs = _events(spark, sf_dir).select(F.to_date("ts").cast("string").alias("run_id"), "user_id", F.when(C("event_type") == "error", "REJECTED").otherwise("OPEN").alias("status"), C("value").alias("equity"))
    return rounded(logs.run_status(runs, ["user_id"]))


@query(
    f"""WITH {{BARS}}, s AS (SELECT *, CASE WHEN day(date) % 9 = 0 THEN day(date) / 10.0 END AS w FROM bars), c AS (SELECT *, coalesce(last_value(w IGNORE NULLS) OVER {_W} ROWS UNBOUNDED PRECEDING), 1.0) AS weight FROM s)
SELECT ticker, date, weight FROM c""",
    days="date",
)
def carried_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = brand_bars(spark, sf_dir)
    signals = bars.filter(F.dayofmonth("date") % 9 == 0).select("ticker", "date", (F.dayofmonth("date") / 10.0).alias("weight"))
    return timejoins.carried_weights(field(bars, "close"), signals).select("ticker", "date", "weight")


@query(
    f"""WITH {{BARS}}, k AS (SELECT ticker, date, coalesce(lead(close, 20) OVER {_W}), last_value(close) OVER {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / close - 1 AS r FROM bars),
e AS (SELECT o_orderkey, 'Brand#' || (o_orderkey % 25 + 1) AS ticker, o_orderdate::DATE AS date FROM orders)
SELECT o_orderkey, round(arg_min(r, k.date), 6) AS forward_return FROM e LEFT JOIN k ON k.ticker = e.ticker AND k.date >= e.date GROUP BY o_orderkey"""
)
def event_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return over twenty bars from the first bar at or after each order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit("Brand#"), C("o_orderkey") % 25 + 1).alias("ticker"), F.to_date("o_orderdate").alias("date"))
    return rounded(timejoins.forward_return(orders, brand_bars(spark, sf_dir)).select("o_orderkey", "forward_return"))


@query(
    """WITH e AS (SELECT event_type AS regime, user_id AS ticker, event_id AS session_id, ts, value FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY ticker, regime ORDER BY ts DESC, session_id) AS nth FROM e),
a AS (SELECT ticker, regime, string_agg(session_id::VARCHAR, ',' ORDER BY nth) AS episodes FROM k WHERE nth <= 3 GROUP BY ALL), q AS (SELECT event_type AS regime, props AS pattern, max(value) AS confidence FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY confidence DESC, pattern) AS nth FROM q), b AS (SELECT regime, string_agg(pattern, '|' ORDER BY nth) AS patterns FROM r WHERE nth <= 3 GROUP BY regime)
SELECT t.ticker, t.regime, t.ticker % 3 AS advisor, episodes, patterns, CASE WHEN t.ticker % 3 <> 2 THEN t.regime || '-' || t.ticker % 3 END AS procedure FROM (SELECT DISTINCT ticker, regime FROM e) t LEFT JOIN a USING (ticker, regime) LEFT JOIN b USING (regime)"""
)
def memory_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(C("event_type").alias("regime"), C("user_id").alias("ticker"), C("event_id").alias("session_id"), "ts", "value", C("props").alias("pattern"))
    requests = e.select("ticker", "regime", (C("ticker") % 3).alias("advisor")).distinct()
    patterns = e.groupBy("regime", "pattern").agg(F.max("value").alias("confidence"))
    procedures = requests.select("advisor", "regime", F.concat_ws("-", "regime", "advisor").alias("procedure")).distinct().filter("advisor <> 2")
    out = memory.retrieve(requests, e, patterns, procedures)
    joined = lambda c, f, by: F.array_join(F.transform(c, lambda x: x[f].cast("string")), by).alias(c)
    return out.select("ticker", "regime", "advisor", joined("episodes", "session_id", ","), joined("patterns", "pattern", "|"), "procedure")


@query(
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS nth FROM events)
SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN value / 10 ELSE value END AS outcome FROM n WHERE nth <= 1000 AND ts >= TIMESTAMP '{_DAY}'"""
)
def trimmed_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest thousand of each regime since a day, with outcomes that came later written in."""
    rows = _events(spark, sf_dir).select(C("event_id").alias("session_id"), C("event_type").alias("regime"), "ts", C("value").alias("outcome"))
    kept = memory.trimmed(rows, 1000, F.lit(_DAY).cast("timestamp_ntz"))
    later = rows.filter("session_id % 3 = 0").select("session_id", (C("outcome") / 10).alias("outcome"))
    return memory.set_outcome(kept, later).select(C("session_id").alias("event_id"), C("regime").alias("event_type"), "outcome")


@query(
    """WITH t AS (SELECT DISTINCT upper(split_part(p_name, ' ', 2)) AS ticker FROM part), n AS (SELECT p_partkey, upper(p_name) AS title FROM part), m AS (SELECT t.ticker, p_partkey, row_number() OVER (PARTITION BY t.ticker ORDER BY p_partkey DESC) AS nth FROM n JOIN t ON list_contains(string_split(title, ' '), t.ticker))
SELECT ticker, p_partkey AS url, nth FROM m WHERE nth <= 12"""
)
def headline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as headlines, each twice, matched to the words they name; the newest twelve of each."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    news = part.select(C("p_partkey").cast("string").alias("url"), C("p_name").alias("title"), C("p_partkey").alias("published"))
    tickers = part.select(F.split("p_name", " ")[1].alias("ticker")).distinct()
    return memory.headlines(news.unionByName(news), tickers).select("ticker", C("url").cast("long").alias("url"), C("nth").cast("long").alias("nth"))


@query(
    f"""WITH {{BARS}}, {_RET}, x AS (SELECT *, lead(close, 5) OVER {_W}) / close - 1 AS t, lag(ret) OVER {_W}) AS before FROM r), a AS (SELECT greatest(abs(corr(ret, volume)), abs(corr(ret, before))) AS crowd FROM x),
i AS (SELECT ticker, corr(ret, t) AS ic FROM x GROUP BY ticker), s AS (SELECT avg(ic) AS ic, avg(ic) / stddev_samp(ic) AS ir FROM i)
SELECT round(crowd, 5) AS max_corr, round(ic, 5) AS ic, round(ir, 4) AS ir, abs(ic) >= 0.03 AND ir >= 0.3 AND abs(crowd) < 0.7 AND 5.0 >= 3 AS admitted FROM a, s"""
)
def factor_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the last return would be let in as a factor beside volume and the return before it."""
    w = Window.partitionBy("ticker").orderBy("date")
    r = daily_returns(spark, sf_dir).withColumns({"ahead": F.lead("close", 5).over(w) / C("close") - 1, "before": F.lag("ret").over(w)})
    ic = stats.information_ratio(stats.information_coefficient(r, "ret", "ahead", ["ticker"], method="pearson"))
    out = stats.crowding(r, "ret", ["volume", "before"]).crossJoin(ic).withColumn("admitted", stats.admission(C("mean_ic"), C("ir"), C("max_corr"), F.lit(5.0)))
    return rounded(out.select("max_corr", C("mean_ic").alias("ic"), "ir", "admitted"), {"max_corr": 5, "ic": 5, "ir": 4})


@query(
    """WITH p AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 = 0 THEN 'STOPPED' ELSE 'OPEN' END AS status, (event_id % 7 + 1)::DOUBLE AS q, value, 40.0 AS entry FROM events)
SELECT user_id, count(*) FILTER (status = 'OPEN') AS open, count(*) FILTER (status <> 'OPEN') AS closed, round(coalesce(sum(q * value) FILTER (status = 'OPEN'), 0), 4) AS value, round(coalesce(sum(q * (value - entry)) FILTER (status = 'OPEN'), 0), 4) AS unrealised,
  count(DISTINCT event_type) FILTER (status = 'OPEN' AND value < 0.95 * entry) AS warnings FROM p GROUP BY user_id"""
)
def book_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _events(spark, sf_dir).select("user_id", C("event_type").alias("ticker"), F.when(_mod(3) == 0, "STOPPED").otherwise("OPEN").alias("status"), (_mod(7) + 1).cast("double").alias("quantity"), C("value").alias("price"), F.lit(40.0).alias("entry"))
    out = allocation.book_summary(p, ["user_id"])
    return rounded(out.withColumn("warnings", F.size("warnings").cast("long")), 4)


@query(
    """WITH r AS (SELECT user_id AS ticker, event_type AS provider, CASE WHEN count(*) < 8 THEN 'FAIL' WHEN count(*) < 11 THEN 'AMBER' ELSE 'PASS' END AS status, count(*) AS rows, max(event_id % 9) AS age_days FROM events GROUP BY ALL)
SELECT CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'AMBER') THEN 'AMBER' ELSE 'PASS' END AS status, array_to_string(list_sort(list_distinct(list(provider))), ',') AS providers, min(rows) AS min_rows, max(age_days) AS max_age_days FROM r"""
)
def provider_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _events(spark, sf_dir).groupBy(C("user_id").alias("ticker"), C("event_type").alias("provider")).agg(F.count(F.lit(1)).alias("rows"), F.max(_mod(9)).alias("age_days"))
    r = r.withColumn("status", F.when(C("rows") < 8, "FAIL").when(C("rows") < 11, "AMBER").otherwise("PASS"))
    return gates.provider_summary(r).withColumn("providers", F.array_join("providers", ","))


@query(
    f"""WITH {{BARS}}, {_RET}, d AS (SELECT *, ret - avg(ret) OVER (PARTITION BY ticker) AS a, volume - avg(volume) OVER (PARTITION BY ticker) AS b FROM r)
SELECT ticker, 'ret' AS feature, round(avg(abs(2.0 * a)), 6) AS mean_abs FROM d GROUP BY ticker UNION ALL SELECT ticker, 'volume', round(avg(abs(-0.01 * b)), 6) FROM d GROUP BY ticker"""
)
def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(allocation.attribution(daily_returns(spark, sf_dir), {"ret": 2.0, "volume": -0.01}))


@query(
    f"""WITH {{BARS}}, {_RET}, m AS (SELECT date, avg(ret) AS m, avg(volume) AS v FROM r WHERE ret IS NOT NULL GROUP BY date), j AS (SELECT r.ticker, r.date, ret, m, v FROM r JOIN m USING (date)),
c AS (SELECT ticker, date, count(ret + m + v) OVER w AS n, var_pop(m) OVER w AS s1, var_pop(v) OVER w AS s2, covar_pop(m, v) OVER w AS s12, covar_pop(m, ret) OVER w AS y1, covar_pop(v, ret) OVER w AS y2 FROM j WHERE ret IS NOT NULL WINDOW w AS {_W} ROWS 59 PRECEDING))
SELECT ticker, date, round(CASE WHEN n >= 60 THEN (y1 * s2 - y2 * s12) / nullif(s1 * s2 - s12 * s12, 0) END, 4) AS beta_1, round(CASE WHEN n >= 60 THEN (y2 * s1 - y1 * s12) / nullif(s1 * s2 - s12 * s12, 0) END, 5) AS beta_2 FROM c""",
    days="date",
)
def two_factor_betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily_returns(spark, sf_dir).filter("ret is not null")
    m = r.groupBy("date").agg(F.avg("ret").alias("m"), F.avg("volume").alias("v"))
    return rounded(stats.two_factor_regression(r.join(m, "date"), "ret", "m", "v"), {"beta_1": 4, "beta_2": 5})


@query(
    f"""WITH {{BARS}}, {_RET}, s AS (SELECT unnest(['spring', 'storm']) AS scenario, unnest([DATE '1996-03-01', DATE '1998-08-01']) AS a, unnest([DATE '1996-06-30', DATE '1998-10-31']) AS b), h AS (SELECT ticker, scenario, 0.1 * ret AS ret FROM r JOIN s ON date BETWEEN a AND b WHERE ret IS NOT NULL)
SELECT ticker, scenario, count(*) AS periods, round(exp(sum(ln(1 + ret))) - 1, 6) AS total_return, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252), 5) AS sharpe FROM h GROUP BY ticker, scenario"""
)
def scenario_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda d: F.lit(d).cast("date")
    rows = [F.struct(F.lit(n).alias("scenario"), day(a).alias("start"), day(b).alias("end")) for n, a, b in (("spring", "1996-03-01", "1996-06-30"), ("storm", "1998-08-01", "1998-10-31"))]
    scenarios = spark.range(1).select(F.inline(F.array(*rows)))
    out = stats.stress_replay(daily_returns(spark, sf_dir).withColumn("ret", 0.1 * C("ret")), scenarios, ["ticker"])
    return rounded(out.select("ticker", "scenario", "periods", "total_return", "sharpe"), {"sharpe": 5})


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, value, ts::DATE AS date FROM events), n AS (SELECT event_id, date, CASE WHEN event_id % 9 <> 0 THEN value / 10 ELSE 0.0 END AS tone, CASE WHEN event_id % 5 <> 0 THEN value ELSE 1.0 END AS volume, CASE event_id % 3 WHEN 0 THEN ['war_conflict', 'oil_energy'] WHEN 1 THEN ['central_bank'] ELSE ['general'] END AS topics FROM e)
SELECT event_id, date, array_to_string(topics, ',') AS topics, round(tone, 6) AS tone, round(ln(1 + volume), 6) AS size, list_contains(topics, 'oil_energy') AS oil, CASE WHEN event_id % 7 > 5 THEN 'low' WHEN event_id % 7 > 2 THEN 'medium' ELSE 'high' END AS confidence FROM n""",
    days="date",
)
def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with numbers in text and topics in a string, as vectors, and the confidence of an interval."""
    raw = _events(spark, sf_dir).select(
        "event_id", C("user_id").alias("ticker"), F.to_date("ts").alias("date"), F.lit("nothing said").alias("headline"), F.lit("").alias("country"), F.when(_mod(9) != 0, (C("value") / 10).cast("string")).otherwise("n/a").alias("tone"),
        F.when(_mod(5) != 0, C("value").cast("string")).alias("volume"), F.lit("2").alias("source_diversity"), _pick(("war_conflict; oil_energy", "central_bank,", " ; "), C("event_id")).alias("topics"),
    )
    rows = events.normalised_events(raw.withColumn("headline", C("event_id").cast("string"))).withColumn("relevance", F.lit(0.5))
    vector = events.event_vector(F.lit(0.0), F.lit(0.0))
    out = rows.withColumn("v", vector).withColumn("event_id", C("headline").cast("long"))
    width = (C("event_id") % 7).cast("double")
    return rounded(out.select("event_id", "date", F.array_join("topics", ",").alias("topics"), "tone", F.get("v", F.lit(6)).alias("size"), (F.get("v", F.lit(3)) > 0).alias("oil"), events.pattern_confidence(F.lit(0.0), width).alias("confidence")))


@query(
    f"""WITH {{BARS}}, r AS (SELECT *, coalesce(close / lag(close) OVER {_W}) - 1, 0) AS ret, lag(close, 20) OVER {_W}) AS p, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bars),
w AS (SELECT *, avg(ret) OVER f AS m, stddev_pop(ret) OVER f AS s FROM r WINDOW f AS {_W} ROWS 19 PRECEDING))
SELECT ticker, round(coalesce(close / p - 1, 0), 6) AS recent_return, round(CASE WHEN n >= 22 AND s > 1e-9 THEN (ret - m) / s ELSE 0 END, 5) AS vol_z FROM w WHERE back = 1"""
)
def ticker_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.ticker_context(brand_bars(spark, sf_dir)), {"vol_z": 5})


@query(
    f"""WITH {{BARS}}, {_RET}, a AS (SELECT ticker, date, ret FROM r WHERE ret IS NOT NULL), b AS (SELECT ticker, date, ln(volume - 10) AS v FROM bars WHERE volume > 10) SELECT ticker, count(*) AS days, round(sum(ret), 5) AS total, round(sum(v), 4) AS size FROM a JOIN b USING (ticker, date) GROUP BY ticker"""
)
def aligned_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound bars; returns and log volumes on the days that have both, finite."""
    bars = gates.require_sound(brand_bars(spark, sf_dir))
    sizes = bars.select("ticker", "date", F.when(C("volume") > 10, F.log(C("volume") - 10)).when(C("volume") == 10, F.lit(float("-inf"))).alias("v"))
    both = stats.aligned(returns_of(bars).select("ticker", "date", "ret"), sizes)
    return rounded(both.groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), F.sum("ret").alias("total"), F.sum("v").alias("size")), {"total": 5, "size": 4})


@query(
    """WITH f AS (SELECT user_id AS run_id, event_type || '-' || (event_id % 4) AS ticker, event_id % 5 AS q, value AS fill FROM events), c AS (SELECT event_type || '-' || (event_id % 4) AS ticker, avg(value) AS close FROM events WHERE event_id % 4 <> 3 GROUP BY ALL)
SELECT run_id, round(100000 - sum(q * fill), 4) AS cash, round(sum(q * coalesce(close, fill)), 4) AS value, round(100000 - sum(q * fill) + sum(q * coalesce(close, fill)), 4) AS equity FROM f LEFT JOIN c USING (ticker) WHERE q > 0 GROUP BY run_id"""
)
def run_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash, value and equity of each run from its fills; a name without a close keeps its fill."""
    ticker = F.concat_ws("-", "event_type", _mod(4))
    e = _events(spark, sf_dir).withColumn("ticker", ticker)
    closes = e.filter(_mod(4) != 3).groupBy("ticker").agg(F.avg("value").alias("close"))
    return rounded(paper.equity_rows(e.select(C("user_id").alias("run_id"), "ticker", _mod(5).alias("quantity"), C("value").alias("fill")), closes, 100_000.0), 4)


@query("SELECT user_id AS symbol, CAST(ts::DATE AS VARCHAR) AS date, count(*) AS n FROM events WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.user_id = events.user_id AND o.ts::DATE = events.ts::DATE AND o.event_type = 'purchase') GROUP BY ALL")
def forward_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a symbol that its log does not hold yet; days with a purchase are logged."""
    e = _events(spark, sf_dir).select(C("user_id").alias("symbol"), F.to_date("ts").alias("date"), "event_type")
    return paper.forward_step(e.filter("event_type = 'purchase'").distinct(), e).groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS track, ['G-05', 'G-06', 'G-07'][event_id % 3 + 1] AS gate, count(*) AS count FROM events GROUP BY ALL")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate_counts(_events(spark, sf_dir).select(C("event_type").alias("track"), _pick(("G-05", "G-06", "G-07"), C("event_id")).alias("gate")))


@query("SELECT event_type AS regime, count(*) AS entries, count(CASE WHEN event_id % 3 <> 0 THEN 1 END) AS outcomes, strftime(max(ts) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS newest_utc FROM events GROUP BY event_type")
def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regimes of the memory, the newest time read as Seoul's and given in UTC."""
    rows = _events(spark, sf_dir).select(C("event_type").alias("regime"), "ts", F.when(_mod(3) != 0, C("value")).alias("outcome"))
    return memory.memory_stats(rows).select("regime", "entries", "outcomes", F.date_format(to_utc(C("newest"), "Asia/Seoul"), "yyyy-MM-dd HH:mm").alias("newest_utc"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, ['KRX', 'NYSE', NULL][o_orderkey % 3 + 1] AS market, o_orderkey % 5 AS bars FROM orders), c AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem WHERE dayofweek(l_shipdate) NOT IN (0, 6)),
n AS (SELECT d, min(day) AS session FROM (SELECT DISTINCT d FROM o) LEFT JOIN c ON day >= d GROUP BY d)
SELECT o_orderkey, CAST(CASE WHEN market = 'KRX' THEN session ELSE d END AS VARCHAR) AS fill_date, CASE WHEN coalesce(market, '') <> 'KRX' THEN 'NOT_APPLICABLE' WHEN bars < 2 OR o_orderkey % 7 = 0 THEN 'MISSING' ELSE 'PASS' END AS benchmark FROM o JOIN n USING (d)"""
)
def fill_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When orders fill, and whether their market's benchmark is there."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("run_date"), F.when(C("o_orderkey") % 3 == 0, "KRX").when(C("o_orderkey") % 3 == 1, "NYSE").alias("market"))
    sessions = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("day")).filter("dayofweek(day) not in (1, 7)").distinct()
    issues = F.when(C("o_orderkey") % 7 == 0, F.array(F.lit("OHLC_ORDER"))).otherwise(F.array().cast("array<string>"))
    gate = paper.benchmark_gate(C("market"), C("o_orderkey") % 5, issues)
    return paper.fill_dates(orders, sessions).select("o_orderkey", C("fill_date").cast("string").alias("fill_date"), gate["status"].alias("benchmark"))


@query(
    f"""WITH p AS (SELECT user_id, event_type AS ticker, CASE WHEN event_id % 2 = 0 THEN 'S' ELSE 'L' END AS track, (event_id % 3)::DOUBLE AS q, value AS price, 40.0 AS entry, (event_id % 50) / 100.0 AS best, CASE WHEN event_id % 5 <> 0 THEN (event_id % 9) / 200.0 END AS vol FROM events WHERE event_id % 4 <> 1),
s AS (SELECT unnest(['click', 'error', 'purchase']) AS ticker, unnest(['web', 'ops', 'web']) AS sector, unnest([1.3, 0.7, 1.1]) AS beta), o AS (SELECT p.*, coalesce(sector, 'OTHER') AS sector, beta, q * price AS worth FROM p LEFT JOIN s USING (ticker)),
g AS (SELECT user_id, sector, sum(worth) AS w FROM o GROUP BY ALL), t AS (SELECT user_id, arg_max(sector, (w, sector)) AS top_sector, max(w) / nullif(sum(w), 0) AS concentration FROM g GROUP BY user_id),
b AS (SELECT user_id, sum(worth) / 10000 AS x, coalesce(sum(worth) FILTER (track = 'S'), 0) / 10000 AS xs, coalesce(sum(worth) FILTER (track = 'L'), 0) / 10000 AS xl, max(worth) / 10000 AS mp, coalesce(sum(worth * coalesce(beta, 1)) FILTER (worth > 0) / nullif(sum(worth) FILTER (worth > 0), 0), 1) AS beta, 1.65 * avg(coalesce(vol, 0.02)) AS v,
  sum(entry * (1 + best) * q) FILTER (q > 0) AS peak, sum(worth) AS value FROM o GROUP BY user_id)
SELECT user_id, round(x, 8) AS exposure, round(xs, 8) AS exposure_s, round(xl, 8) AS exposure_l, round(1 - x, 8) AS cash, round(mp, 8) AS max_position, top_sector, round(concentration, 6) AS concentration, round(beta, 6) AS beta, round(v, 8) AS var_1d_95, round(coalesce(CASE WHEN peak > 0 THEN (peak - value) / peak END, 0), 6) AS drawdown,
  {_sql_reasons(("xs > 0.2", "TRACK_S"), ("xl > 0.75", "TRACK_L"), ("x > 0.6", "TOTAL"), ("concentration > 0.3", "SECTOR"), ("1 - x < 0.05", "CASH"))} AS rebalance FROM b JOIN t USING (user_id)"""
)
def portfolio_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analytics of each user's open positions."""
    p = _events(spark, sf_dir).select(
        "user_id", C("event_type").alias("ticker"), F.when(_mod(2) == 0, "S").otherwise("L").alias("track"), F.when(_mod(4) != 1, "OPEN").otherwise("CLOSED").alias("status"), _mod(3).cast("double").alias("quantity"), C("value").alias("price"),
        F.lit(40.0).alias("entry"), (_mod(50) / 100.0).alias("best"), F.when(_mod(5) != 0, _mod(9) / 200.0).alias("vol"),
    )
    sectors = spark.createDataFrame([("click", "web", 1.3), ("error", "ops", 0.7), ("purchase", "web", 1.1)], "ticker string, sector string, beta double")
    out = allocation.portfolio_analytics(p, sectors, 10_000.0, ["user_id"])
    return rounded(out.withColumn("rebalance", _names(C("rebalance"))), {k: 8 for k in ("exposure", "exposure_s", "exposure_l", "cash", "max_position", "var_1d_95")})
