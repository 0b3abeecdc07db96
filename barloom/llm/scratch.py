"""Tables that cut lineage, written in the folder the cluster shares.

The folder is the session's ``spark.checkpoint.dir``. Only a local session, which
has no other machine, may go without it and then gets a temporary folder.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_WATCHING: list[list["Scratch"]] = []


def shared_root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-"))
    return _LOCAL[0]


@contextlib.contextmanager
def dropped_after() -> Iterator[None]:
    """What is scratched inside goes at the end; the caller has written what it wants to keep."""
    made: list[Scratch] = []
    _WATCHING.append(made)
    try:
        yield
    finally:
        _WATCHING.remove(made)
        for one in made:
            one._remove(one.root)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of whole texts written inside have fewer rows: both sides hold a batch or two at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Named Parquet tables under one fresh folder; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)
        for made in _WATCHING:
            made.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
