"""Labelled rows to fit a classifier on: a bounded sample, the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOLD_OUT = 1
FOLDS = 3


def fold(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents outside the held-out fold, by hash of the id.

    The ids are at most ``most`` numbers, so they are broadcast to the documents. Repeated
    labels of a document count as the larger one; null labels and ids do not count. Rows of
    one id are all taken, so there may be more than ``most``; callers keep distinct ones. Ties
    of the hash go by id. Columns other than doc_id, text and the label are not read.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(fold(F.col("doc_id")) != HOLD_OUT)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label")
