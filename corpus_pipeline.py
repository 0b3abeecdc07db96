"""The corpus pipeline: rules, exact dedup, near dedup, mixing, packing.

Each stage takes what the one before it kept. All but the last return the columns of
``documents``; the last returns one row per piece of a sequence, with its token ids.
Columns beyond those of ``documents`` are left out at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from barloom.llm.scratch import Scratch, dropped_after

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs.select(*COLUMNS))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays; rows are known by id and text, so ids may be null."""
    scratch = Scratch(spark, "pipeline-exact")
    found = scratch.table(exact_dedup.dedup(docs).select("doc_id", "text_sha256", "kept"), "found")
    kept = found.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    sha = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    out = docs.select(*COLUMNS).join(kept.hint("shuffle_hash"), (sha == F.col("kept_sha")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    repeated = found.filter("kept").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.isEmpty():
        return out
    return out.withColumn("kept_sha", sha).dropDuplicates(["kept_sha"]).drop("kept_sha")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays."""
    gone = near_dedup.near_duplicates(docs).filter("not kept").select("doc_id")
    return docs.select(*COLUMNS).join(gone.hint("shuffle_hash"), "doc_id", "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; a document taken in two passes is there twice.

    Rows without an id, or of one id, are documents of their own.
    """
    docs = docs.select(*COLUMNS)
    return mixing.mixed_documents(docs, mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens, piece by piece."""
    return packing.pack(docs)


STAGES = [("quality rules", rules), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: The mix draws from a seeded generator and packing tokenises, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with dropped_after():
            docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{i}")
        scratch.drop(f"stage-{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
