"""The registered queries over the market panel and their SQL.

A query is registered with the SQL that gives the same rows; those without one fit models,
draw samples or run streams. Doubles are rounded on both sides, to fewer places the larger
the values.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Bars in SQL, the start of most oracles.
BARS_SQL = """
q AS (
  SELECT p_brand AS ticker, l_shipdate::DATE AS date, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS price, l_quantity
  FROM lineitem JOIN part ON p_partkey = l_partkey),
bars AS (
  SELECT ticker, date, first(price ORDER BY l_orderkey, l_linenumber, price) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY l_orderkey, l_linenumber, price) AS close, sum(l_quantity) AS volume FROM q GROUP BY ticker, date)"""


def query(sql: str | None = None, days: str = "") -> Callable[[Query], Query]:
    """``days`` names the date columns; both sides give them as text."""

    def add(run: Query) -> Query:
        @functools.wraps(run)
        def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = run(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

        QUERIES[run.__name__] = plain
        if sql is not None:
            text = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in days.split())
            whole = f"SELECT * REPLACE ({text}) FROM ({sql})" if days else sql
            SQL[run.__name__] = whole.replace("{BARS}", BARS_SQL)
        return plain

    return add


def rounded(df: DataFrame, places: dict[str, int] | int = 6) -> DataFrame:
    of = lambda c: places if isinstance(places, int) else places.get(c, 6)
    return df.select(*(F.round(c, of(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _load() -> None:
    from . import book_queries, gate_queries, panel_queries, portfolio_queries, regime_queries, research_queries, risk_queries, store_queries, stream_queries, text_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return QUERIES["recommendations"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
