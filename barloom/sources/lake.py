"""Bitemporal Parquet lake of bars, universe snapshots and their readers and writers.

Every write appends rows stamped with their ingest time, partitioned by symbol and month;
a read as of a moment takes the newest version of each bar known by then. Symbol and month
predicates prune partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.panel import BARS, FIELDS

C = F.col

# Column names of the exchange's own feed.
PROVIDER_NAMES = {"시가": "open", "고가": "high", "저가": "low", "종가": "close", "거래량": "volume", "날짜": "date"}


class Lake:
    """``grain`` is the date format that names a period's folder: a month, or a year for sparse bars."""

    def __init__(self, spark: SparkSession, root: str, grain: str = "yyyy-MM"):
        self.spark, self.root, self.grain = spark, root.rstrip("/"), grain
        self.bars = f"{self.root}/bars"

    def write(self, bars: DataFrame, source: str, ingested_at: Column | None = None) -> None:
        stamped = bars.select(*BARS, C("ticker").alias("symbol"), F.date_format("date", self.grain).alias("month"), F.lit(source).alias("_source"), (F.current_timestamp() if ingested_at is None else ingested_at).alias("_ingested_at"))
        stamped.repartition("symbol", "month").write.mode("append").partitionBy("symbol", "month").parquet(self.bars)

    def exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.bars)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def versions(self, tolerant: bool = True) -> DataFrame:
        return self.spark.read.option("ignoreCorruptFiles", str(tolerant).lower()).parquet(self.bars)

    def read(self, tickers: Sequence[str] | None = None, start: date | None = None, end: date | None = None, as_of: datetime | None = None, tolerant: bool = True) -> DataFrame:
        """The newest version of each bar known at ``as_of``. Nothing known then is an error, not a fallback."""
        rows = self.versions(tolerant)
        if tickers is not None:
            rows = rows.filter(C("symbol").isin(*tickers))
        for bound, day in ((">=", start), ("<=", end)):
            if day is not None:
                period = F.date_format(F.lit(day).cast("date"), self.grain)
                rows = rows.filter((C("month").cast("string") >= period) & (C("date") >= day) if bound == ">=" else (C("month").cast("string") <= period) & (C("date") <= day))
        if as_of is not None:
            rows = rows.filter(C("_ingested_at") <= F.lit(as_of))
            if rows.isEmpty():
                raise LookupError(f"no bars known at {as_of}")
        return newest_version(rows)

    def tickers(self) -> DataFrame:
        return self.versions().select(C("symbol").cast("string").alias("ticker")).distinct()

    def has(self, ticker: str) -> bool:
        return not self.versions().filter(C("symbol") == ticker).isEmpty()


def newest_version(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker", "date").orderBy(F.desc("_ingested_at"), "_source")
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").select(*BARS, "_source", "_ingested_at")


def write_universe(members: DataFrame, root: str) -> None:
    """Distinct (universe, as_of, ticker), replacing the snapshots it holds."""
    members.select("universe", "as_of", "ticker").distinct().repartition("universe", "as_of").sortWithinPartitions("ticker").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("universe", "as_of").parquet(root)


def read_universe(spark: SparkSession, root: str, universe: str, as_of: str) -> DataFrame:
    return spark.read.parquet(root).filter((C("universe") == universe) & (C("as_of").cast("string") == as_of)).select("ticker")


def universe_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    joined = old.join(new, "ticker", "left_anti").select("ticker", F.lit("LEFT").alias("change"))
    return joined.unionByName(new.join(old, "ticker", "left_anti").select("ticker", F.lit("JOINED").alias("change")))


def from_wide_csv(spark: SparkSession, path: str, least_share: float = 0.6) -> DataFrame:
    """A CSV of dates by assets as long prices: coerced, filled forward then back; assets with few values go."""
    wide = spark.read.option("header", True).csv(path)
    day, *assets = wide.columns
    long = wide.unpivot([day], assets, "asset", "price").select(C(day).cast("date").alias("date"), "asset", C("price").try_cast("double").alias("price")).filter("date is not null")
    per, w = Window.partitionBy("asset"), Window.partitionBy("asset").orderBy("date")
    counted = long.withColumns({"known": F.count("price").over(per), "n": F.count(F.lit(1)).over(per)})
    kept = counted.filter(C("known") >= F.greatest(F.lit(10.0), least_share * C("n")))
    ahead = F.last("price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first("price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # taken before the first value alone
    return kept.select("date", "asset", F.coalesce(ahead, back).alias("price"))


def from_long_csv(spark: SparkSession, path: str, cost_bps: float = 5.0) -> DataFrame:
    """A long panel CSV; missing columns get their defaults."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    number = lambda c, d: (C(c).try_cast("double") if c in df.columns else F.lit(d)).alias(c)
    out = df.select(C("Date").cast("date").alias("date"), C("Asset").alias("ticker"), number("primary_score", 0.0), number("fwd_return", None), number("cost_return", cost_bps / 1e4))
    return out.filter("date is not null and ticker is not null")


def renamed(df: DataFrame, names: Mapping[str, str] = PROVIDER_NAMES) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def best_source(sources: Mapping[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """Of several providers' bars the first one's in ``order`` for each bar."""
    every = None
    for rank, name in enumerate(order):
        part = sources[name].select(*BARS, F.lit(name).alias("source"), F.lit(rank).alias("_rank"))
        every = part if every is None else every.unionByName(part)
    w = Window.partitionBy("ticker", "date").orderBy("_rank")
    return every.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth", "_rank")


def fresh(cache: DataFrame, now: Column, hours: float = 20.0) -> DataFrame:
    """The newest entry per key no older than ``hours``. Columns: key, stored_at, value."""
    young = cache.filter((now.cast("double") - C("stored_at").cast("double")) <= hours * 3600)
    return young.groupBy("key").agg(F.max("stored_at").alias("stored_at"), F.max_by("value", "stored_at").alias("value"))


def without(cache: DataFrame, key: str | None = None, now: Column | None = None, hours: float = 20.0) -> DataFrame:
    """What stays after invalidating a key or purging what has expired."""
    out = cache if key is None else cache.filter(C("key") != key)
    return out if now is None else out.filter((now.cast("double") - C("stored_at").cast("double")) <= hours * 3600)


def export_csv(bars: DataFrame, path: str) -> None:
    """One folder of CSV per ticker with plain dates."""
    out = bars.select("ticker", F.date_format("date", "yyyy-MM-dd").alias("date"), *FIELDS)
    out.repartition("ticker").sortWithinPartitions("date").write.mode("overwrite").partitionBy("ticker").option("header", True).csv(path)


def chart_records(bars: DataFrame, n: int, today: Column) -> DataFrame:
    """Per ticker the newest ``n`` bars, the last date and its age in days; fewer than 30 bars is an error row."""
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    top = bars.withColumn("k", F.row_number().over(w)).withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).filter(C("k") <= n)
    out = top.groupBy("ticker").agg(F.max("rows").alias("rows"), F.max("date").alias("last_date"), F.array_sort(F.collect_list(F.struct("date", *FIELDS))).alias("bars"))
    few = C("rows") < 30
    return out.select("ticker", "rows", "last_date", F.datediff(today, "last_date").alias("age_days"), F.when(~few, C("bars")).alias("bars"), F.when(few, "INSUFFICIENT_DATA").alias("error"))
