"""Ties, zero denominators and steps whose work must not grow faster than their rows."""

import functools
import itertools
import math
import operator
from datetime import date, datetime, timedelta
from decimal import Decimal

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barloom.llm.scratch import small_batches
from barloom.llm.textkernel import blocks
from barloom.operators import events, timejoins
from barloom.plans import catalog, feature_sql


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_forward_returns_read_each_day_once(spark):
    bars = spark.createDataFrame([("A", date(2024, 1, d), float(d)) for d in (2, 3, 5)], "ticker string, date date, close double")
    events = spark.createDataFrame([(1, "A", date(2024, 1, 1)), (2, "A", date(2024, 1, 4)), (3, "A", date(2024, 1, 4)), (4, "A", date(2024, 1, 6)), (5, "A", None), (6, "B", date(2024, 1, 2))], "n int, ticker string, date date")
    out = timejoins.forward_return(events, bars, 1)
    # a frame from the current row to the end is computed anew for each row
    assert "currentrow$(), unboundedfollowing" not in plan_of(out)
    assert "currentrow$(), unboundedfollowing" not in plan_of(timejoins.as_of_forward(events, bars, ["ticker"], "date", "close"))
    assert {r["n"]: r["forward_return"] for r in out.collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: None, 5: None, 6: None}


def sql_rows(name: str, base: str, tables: tuple[str, ...]) -> list[tuple]:
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    return sorted(con.execute(catalog.oracle_sql()[name]).fetchall(), key=repr)


def events_table(path, rows: list[tuple]) -> str:
    """Events (user, kind, value), a minute apart."""
    at = [datetime(2024, 1, 1) + timedelta(minutes=i) for i in range(len(rows))]
    user, kind, value = zip(*rows, strict=True)
    pq.write_table(pa.table({"event_id": list(range(len(rows))), "ts": at, "user_id": list(user), "event_type": list(kind), "value": list(value), "props": ["{}"] * len(rows)}), f"{path}/events.parquet")
    return str(path)


def test_run_without_equity_has_no_drawdown(spark, tmp_path):
    base = events_table(tmp_path, [(1, "view", 0.0), (1, "error", 0.0), (2, "view", 2.0), (2, "view", 1.0)])
    got = sorted((tuple(r) for r in catalog.queries()["latest_runs"](spark, base).collect()), key=repr)
    assert [r[:4] for r in got] == [r[:4] for r in sql_rows("latest_runs", base, ("events",))]
    drawdown = {r[1]: r[4] for r in got}
    assert math.isnan(drawdown[1]) and drawdown[2] == -0.5


def test_means_at_a_limit_do_not_depend_on_order(spark, tmp_path):
    # the mean is 45; added one by one, some orders end a bit above it
    values = [45.1, 44.9, 45.3, 44.7, 45.07, 44.93, 0.1, 89.9]
    orders = [o for o in itertools.islice(itertools.permutations(values), 0, None, 97) if functools.reduce(operator.add, o) / 8 > 45]
    assert orders
    rows = [(user, "view", v) for user, o in enumerate(orders[:40]) for v in o]
    base = events_table(tmp_path, rows)
    got = sorted((tuple(r) for r in catalog.queries()["approvals"](spark, base).collect()), key=repr)
    assert {r[1:] for r in got} == {("APPROVED", 1, 1)}
    assert got == sql_rows("approvals", base, ("events",))


def test_prices_are_shown_without_ties(spark):
    # 68310.73 / 32 = 2134.7103125
    places = feature_sql.PLACES["close"]
    x = 68310.73 / 32
    got = spark.range(1).select(F.round(F.lit(x), places)).first()[0]
    assert got == duckdb.execute(f"SELECT round({x!r}::DOUBLE, {places})").fetchall()[0][0] == 2134.7103125


def test_scenarios_of_a_value_of_nothing(spark, tmp_path):
    base = events_table(tmp_path, [(1, "view", 0.0), (1, "view", 50.0), (2, "view", 0.01)])
    got = sorted((tuple(r) for r in catalog.queries()["sizing_scenarios"](spark, base).collect()), key=repr)
    want = sorted(((*r[:2], *map(lambda x: float(x) if isinstance(x, (int, float, Decimal)) else x, r[2:])) for r in sql_rows("sizing_scenarios", base, ("events",))), key=repr)
    assert got == want
    assert {r[5] for r in got if r[0] == 0} == {0.0} and {r[5] for r in got if r[0] == 2} == {25.0, 6.5, -12.5}


def test_texts_reach_workers_in_small_pieces(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(name), spark.range(0, 3000, 1, 1)
    count = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    with small_batches(spark):
        assert {r["n"] for r in docs.mapInArrow(count, "n long").collect()} == {1000}
    assert spark.conf.get(name) == before
    assert max(len(data) for _, _, data, _ in blocks(pa.array(["x" * 1000] * 2000))) <= 1 << 18


def test_bootstrap_leaves_one_row_per_group(spark):
    m = spark.createDataFrame([(g, float(i % 7), 1.0 + i % 3) for g in (1, 2) for i in range(40 * g)], "group int, ret double, weight double")
    out = events.bootstrap_interval(m, draws=400)
    assert "Explode" not in plan_of(out) and "explode" not in plan_of(out)
    # as drawn one at a time
    for r in out.collect():
        one = m.filter(F.col("group") == r["group"])
        own = one.select(F.xxhash64("group", F.lit(7))).first()[0]
        x, w = map(np.array, zip(*sorted((y["ret"], y["weight"]) for y in one.collect()), strict=True))
        rng, hi = np.random.default_rng(own % (1 << 64)), np.cumsum(w)
        means = [x[np.minimum(np.searchsorted(hi, rng.random(len(x)) * hi[-1], side="right"), len(x) - 1)].mean() for _ in range(400)]
        assert (r["mean"], r["low"], r["high"]) == pytest.approx((np.mean(means), *np.quantile(means, (0.025, 0.975))), abs=1e-12)


def test_topics_lower_each_text_once(spark):
    texts = spark.createDataFrame([("A WAR and oil",), ("Nothing",), ("",), (None,)], "text string")
    got = texts.select(events.topics(F.col("text")).alias("t"), events.hits(F.col("text"), ("war", "oil", "x")).alias("n"))
    assert plan_of(texts.select(F.size(events.topics(F.col("text"))))).count("lower(") < len(events.TOPIC_KEYWORDS)
    assert [(r["t"], r["n"]) for r in got.collect()] == [(["war_conflict", "oil_energy"], 2), (["general"], 0), (["general"], 0), (["general"], 0)]
