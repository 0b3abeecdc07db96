"""Packing by concatenating and cutting, with prefix sums in two passes.

The first pass tokenises and writes each partition's documents with the tokens before
them in the partition; the partitions' totals, summed in order, give every partition its
global offset. The second pass cuts each document at the multiples of the sequence
length; a document over such a boundary gives one record per piece.

Null text counts as empty and gives the separator alone. Rows may repeat and ids be null;
each row is a document of its own. Other columns are not read. Every sequence is full but
the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import WORD_TOKENIZER, encoded, encoder

LENGTH = 2048
SEPARATOR = 1


def tokenised(docs: DataFrame, tokenizer: str = WORD_TOKENIZER, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, its ids with the separator, the partition it came from and the tokens before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        wide = np.dtype(enc.width).itemsize
        for b in batches:
            row = 0
            for ids, ptr in encoded(b.column(1), enc):
                ids, size = np.insert(ids, ptr[1:], separator), np.diff(ptr) + 1
                first = before + np.cumsum(size) - size
                before += len(ids)
                n, ends = len(size), (np.concatenate([[0], np.cumsum(size)]) * wide).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, n), pa.array(np.full(n, part, np.int32)), pa.array(first), pa.array(size), pa.array(np.full(n, wide, np.int8)), packed],
                    names=["doc_id", "part", "first", "doc_tokens", "width", "ids"],
                )
                row += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, part int, first long, doc_tokens long, width tinyint, ids binary")


def offsets(tokens: DataFrame) -> DataFrame:
    """Each partition's global offset: as many rows as partitions, whatever the input."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = WORD_TOKENIZER, separator: int = SEPARATOR, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, and its ids."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tokens = scratch.table(tokenised(docs, tokenizer, separator), "tokens")
    base = scratch.table(offsets(tokens), "offsets")
    placed = tokens.join(base, "part").select("doc_id", (F.col("base") + F.col("first")).alias("at"), "doc_tokens", "width", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, size = (b.column(k).to_numpy() for k in (1, 2))
            pieces = (at + size - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(at)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[row] // length + nth
            lo = np.maximum(at[row], sequence * length)
            hi = np.minimum(at[row] + size[row], (sequence + 1) * length)
            start = lo - at[row]
            kinds = [np.frombuffer(x, np.uint16 if w == 2 else np.uint32).astype("<u4") for x, w in zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True)]
            ids = [kinds[r][s : s + n].tobytes() for r, s, n in zip(row, start, hi - lo, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), *map(pa.array, (start, hi - lo, size[row], sequence, lo - sequence * length)), pa.array(ids, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def with_crc(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and the ids of the whole sequence; a group is one sequence at most."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.transform(ordered, lambda x: x["ids"]).alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids")
    )
