"""Token counts from an exact histogram of lengths.

Documents are aggregated by their number of tokens. Sums over the histogram from either
end then answer, for every context limit, how many documents and tokens fit, are cut or
remain, and where the quantiles lie, without another look at the texts.

Null text counts as empty, of length 0. Rows may repeat; each counts. An empty table gives
an empty histogram. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import WORD_TOKENIZER, encoder, token_counts

#: Lengths in a block of the two-level sums.
BLOCK = 256


def lengths(docs: DataFrame, text_col: str = "text", tokenizer: str = WORD_TOKENIZER) -> DataFrame:
    """One row per input row with its number of tokens, ``n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(token_counts(b.column(0), enc))], names=["n_tokens"])

    return docs.select(docs[text_col]).mapInArrow(run, "n_tokens long")


def histogram(n_tokens: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """n_tokens and n_docs, written once, as all answers read it more than once."""
    scratch = scratch or Scratch(n_tokens.sparkSession, "token-counts")
    return scratch.table(n_tokens.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "histogram")


def answers(hist: DataFrame) -> DataFrame:
    """Per length that occurs, taken as a context limit: documents and tokens of exactly, at
    least and more than that length, documents up to it, and the corpus's tokens when every
    document is cut to it (``truncated_total``).

    Sums run inside blocks of lengths and over the blocks' totals, so no task has to hold
    more than a block or one row per block.
    """
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    below = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, w, n in (("d", above, "docs_above"), ("t", above, "tokens_above"), ("d", below, "docs_below"), ("t", below, "tokens_below")))
    )
    inside = Window.partitionBy("block").orderBy("n_tokens")
    up, down = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing), inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = h.join(blocks, "block")
    docs_least = F.sum("n_docs").over(up) + F.col("docs_above")
    tokens_least = F.sum("tokens").over(up) + F.col("tokens_above")
    docs_most = F.sum("n_docs").over(down) + F.col("docs_below")
    tokens_most = F.sum("tokens").over(down) + F.col("tokens_below")
    return j.select(
        "n_tokens", "n_docs", "tokens", docs_least.alias("docs_at_least"), tokens_least.alias("tokens_at_least"), docs_most.alias("docs_at_most"),
        (tokens_most + (docs_least - F.col("n_docs")) * F.col("n_tokens")).alias("truncated_total"),
    )


def at_limits(answered: DataFrame, limits: Sequence[int]) -> DataFrame:
    """The truncated total at each of a few limits, whether or not a document has that length.

    Up to a limit between two lengths, the documents of more tokens than it add one token
    for each step beyond the shorter length.
    """
    rows = []
    for limit in limits:
        short = F.when(F.col("n_tokens") <= limit, F.struct("n_tokens", "truncated_total", (F.col("docs_at_least") - F.col("n_docs")).alias("longer")))
        best, total = F.max(short), F.max("docs_at_least")
        value = F.coalesce(best["truncated_total"] + best["longer"] * (limit - best["n_tokens"]), total * limit, F.lit(0))
        rows.append(F.struct(F.lit(int(limit)).cast("long").alias("context_limit"), value.cast("long").alias("truncated_total")))
    return answered.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def quantiles(answered: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The least length that holds at least each share of the documents."""
    total = F.max("docs_at_least").alias("n")
    n = answered.agg(total)
    points = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")
    need = n.select("n", points).select("share", F.ceil(F.col("share") * F.col("n")).alias("need"))
    return answered.join(F.broadcast(need), F.col("docs_at_most") >= F.col("need")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
