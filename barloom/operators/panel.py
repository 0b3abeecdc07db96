"""The long panel of daily bars: (ticker, date, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume")
BARS = ["ticker", "date", *FIELDS]


def brand_bars(spark: SparkSession, sf_dir: str, ticker: str = "p_brand") -> DataFrame:
    """Bars of unit prices by brand (or another column of the part table) and ship date.

    Lines are ordered by order and line number, which are their key; as one number they keep
    the aggregation in hash tables. Only the columns used are read; the dimension is joined by whichever strategy its size
    allows, and bars are aggregated before any window shuffles them.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col(ticker).alias("ticker"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice")
    quoted = lines.join(part, "l_partkey").withColumns(
        {"price": F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double"), "date": F.to_date("l_shipdate")}
    ).withColumn("nth", F.shiftleft(F.col("l_orderkey").cast("long"), 20) + F.col("l_linenumber"))
    return quoted.groupBy("ticker", "date").agg(
        F.min_by("price", "nth").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "nth").alias("close"),
        F.sum(F.col("l_quantity").cast("double")).alias("volume"),
    )


def by_ticker(n: int | None = None) -> WindowSpec:
    """Bars of a ticker in order; with ``n``, the last n of them."""
    w = Window.partitionBy("ticker").orderBy("date")
    return w if n is None else w.rowsBetween(-(n - 1), 0)


def over_last(agg: F.Column, value: F.Column, n: int) -> F.Column:
    """A rolling aggregate, null until n values are there."""
    w = by_ticker(n)
    return F.when(F.count(value).over(w) >= n, agg.over(w))


def normalise(df: DataFrame) -> DataFrame:
    """Bars from any case of column names: numbers coerced, incomplete rows and bad prices dropped."""
    names = {c.lower(): c for c in df.columns}
    if missing := [c for c in BARS if c not in names]:
        raise ValueError(f"missing columns: {missing}")
    numbers = [F.col(names[c]).cast("string").try_cast("double").alias(c) for c in FIELDS]
    out = df.select(F.col(names["ticker"]).alias("ticker"), F.col(names["date"]).cast("date").alias("date"), *numbers)
    return out.dropna().filter("close > 0").withColumn("volume", F.greatest("volume", F.lit(0.0)))


def as_of(df: DataFrame, day, column: str = "date") -> DataFrame:
    return df.filter(F.col(column) <= F.lit(day))


def field(df: DataFrame, name: str) -> DataFrame:
    return df.select("ticker", "date", name)


def align_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given feature columns in order; missing ones and nulls are 0."""
    known = set(df.columns)
    return df.select("ticker", "date", *((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in known else F.lit(0.0)).alias(c) for c in columns))


def synthetic_bars(spark: SparkSession, tickers: int, days: int, seed: int = 7) -> DataFrame:
    """Seeded bars for tests: a hash gives each day's return."""
    rows = spark.range(tickers * days).selectExpr(f"concat('T', cast(id div {days} as string)) ticker", f"cast(id % {days} as int) k")
    noise = (F.pmod(F.xxhash64("ticker", "k", F.lit(seed)), F.lit(10_001)) / 10_000.0 - 0.5) * 0.04
    day = F.date_add(F.lit("2022-01-03").cast("date"), F.col("k") + 2 * F.floor(F.col("k") / 5).cast("int"))
    w = Window.partitionBy("ticker").orderBy("k")
    close = 100 * F.exp(F.sum(noise).over(w))
    out = rows.select("ticker", "k", day.alias("date"), close.alias("close")).withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    return out.select("ticker", "date", "open", (F.greatest("open", "close") * 1.005).alias("high"), (F.least("open", "close") * 0.995).alias("low"), "close", (1e5 + F.pmod(F.xxhash64("k", "ticker"), F.lit(50_000))).cast("double").alias("volume"))
