"""Exact deduplication of an incoming batch against an immutable snapshot.

The snapshot's digests are dealt into buckets, each with a static binary-fuse filter. The
batch's digests, already grouped among themselves, are screened by the filters: what a
filter rejects is new, what it admits joins the exact bucket, and texts of one digest are
compared byte by byte before the two groups become one.

Texts are equal when they are identical after removing ``[\\x20\\x09-\\x0D]``; null counts
as empty, and all empty texts are equal. In a group the row with the most code points in
its text stays, then the smallest id, null ids last. The id is a key: rows that repeat one
share its fate. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse_filter
from .scratch import Scratch

#: Digests in a filter at most, on average.
BUCKET = 200_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, digest, code points of the original text and the side of each row."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("sha"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
        F.coalesce(snapshot, F.lit(True)).alias("old"),
    )


def groups(rows: DataFrame) -> DataFrame:
    """Per digest: the best row, as (-code points, id is null, id), and the number of rows."""
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    return rows.groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).withColumn("key", F.xxhash64("sha"))


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket with its filter."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = fuse_filter.build(pdf["key"].to_numpy(np.int64))
        return pd.DataFrame([(int(pdf["bucket"].iloc[0]), f.seed, f.segment, f.segments, f.prints)], columns=["bucket", "seed", "segment", "segments", "prints"])

    keyed = snapshot.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key")
    return keyed.groupBy("bucket").applyInPandas(build, "bucket int, seed long, segment long, segments long, prints binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The incoming digests with ``maybe``: whether the bucket's filter admits them."""

    def ask(rows: pa.Table, filter_: pa.Table) -> pa.Table:
        if filter_.num_rows:
            one = filter_.to_pylist()[0]
            f = fuse_filter.FuseFilter(one["seed"], one["segment"], one["segments"], one["prints"])
            maybe = f.may_hold(rows["key"].to_numpy().astype(np.int64))
        else:
            maybe = np.zeros(rows.num_rows, bool)
        return pa.table({"sha": rows["sha"], "maybe": pa.array(maybe)})

    keyed = incoming.select("sha", "key", F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(ask, "sha string, maybe boolean")


def _same_bytes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (sha, old_id, new_id), the digests whose two texts are equal.

    Rows are found by id and digest, so that one of several texts of an id is the right one
    and a null id finds its own.
    """
    wanted = pairs.select(F.col("sha").alias("pair_sha"), F.explode(F.array("old_id", "new_id")).alias("pair_id")).distinct()
    texts = docs.select("doc_id", F.encode(normalised(F.col("text")), "UTF-8").alias("raw"))
    texts = texts.withColumn("sha", F.sha2("raw", 256))
    texts = texts.join(wanted.hint("shuffle_hash"), (F.col("sha") == F.col("pair_sha")) & F.col("doc_id").eqNullSafe(F.col("pair_id")), "left_semi")
    return texts.groupBy("sha").agg((F.min("raw") == F.max("raw")).alias("same")).filter("same").select("sha")


def dedup(docs: DataFrame, snapshot: Column | None = None, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``snapshot`` says which rows make up the snapshot (default: about half, by id); the
    others are the incoming batch. The result does not depend on that choice.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact-dedup")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    old = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if snapshot is None else snapshot
    rows = scratch.table(digests(docs, old), "rows")
    snap, batch = (scratch.table(groups(rows.filter(F.col("old") == side)), name) for side, name in ((True, "snapshot"), (False, "batch")))
    buckets = max(1, math.ceil(max(snap.count(), batch.count()) / BUCKET))
    filters = scratch.table(build_filters(snap, buckets), "filters")
    screened = batch.join(screen(batch, filters, buckets), "sha")
    old_side = snap.select("sha", F.col("best").alias("old_best"), F.col("n").alias("old_n"))
    met = scratch.table(screened.filter("maybe").join(old_side, "sha"), "met")
    checked = _same_bytes(docs, met.select("sha", F.col("old_best.doc_id").alias("old_id"), F.col("best.doc_id").alias("new_id")))
    both = scratch.table(
        met.join(checked, "sha").select("sha", F.least("best", "old_best").alias("best"), (F.col("n") + F.col("old_n")).alias("n")),
        "both",
    )
    parts = [
        part.join(both.select("sha"), "sha", "left_anti").select("sha", F.lit(side).alias("old"), "best", "n")
        for part, side in ((snap, True), (batch, False))
    ]
    merged = [both.select("sha", F.lit(side).alias("old"), "best", "n") for side in (True, False)]
    final = parts[0].unionByName(parts[1]).unionByName(merged[0]).unionByName(merged[1])
    return rows.join(final, ["sha", "old"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
