"""Removal of repeated word sequences, by difference-cover anchors.

A window of ``WINDOW`` = 20 words is removed when the same words also start earlier (in a
document of smaller id, or earlier in its own). Positions modulo 13 in the perfect
difference set {0, 1, 3, 9} hold an anchor of 8 words. For any two positions some shift of
at most 12 brings both onto the cover, so two equal windows share an aligned anchor inside
them, while only 4 of 13 positions are hashed and shuffled.

An anchor is extended by up to 12 words to either side, its context, which holds all
windows that contain it. Occurrences of an anchor with equal contexts need no comparison:
all but the first lose every window around the anchor. Where an anchor has several
contexts, the first occurrence of each is extended window by window: those windows are
grouped by their own hashes, and all but the first are removed.

Each batch of documents settles repeats inside it before the shuffle, so a sequence that is
in a third of all documents reaches its group once per batch. An anchor that meets several
contexts in one batch (a common passage between other words) is spread by anchor and
context, and leaves one marker under the anchor itself; its first occurrences are extended
in any case, so equal contexts that do not meet in one group still meet window by window.

Anchors and windows are equal when two independent 64-bit hashes of their words are; an
anchor alone is one such hash and only proposes what to compare. Null text has no words.
Documents are ordered by id; rows without an id are neither searched nor changed. The id is
a key: rows that repeat one are the same document and do not remove each other's words.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkernel import Tokens, U64, blocks, mix64

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
REACH = WINDOW - ANCHOR

_ON = np.zeros(PERIOD, bool)
_ON[list(COVER)] = True
_HITS = "a long, b long, doc_id long, at int, starts binary, kind tinyint"
#: Kinds of rows: an occurrence under its anchor, one spread by its context too, the marker of the latter, settled windows.
_PLAIN, _SPREAD, _MARK, _DONE = range(4)
#: Text that settles its repeats together, in bytes.
SETTLE = 16 << 20


def _merge_runs(starts: np.ndarray) -> bytes:
    """Sorted distinct positions as packed (first, length) runs."""
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    first = starts[np.concatenate([[0], cut])]
    last = starts[np.concatenate([cut - 1, [len(starts) - 1]])]
    return np.stack([first, last - first + 1], axis=1).astype("<i4").tobytes()


def _settled(a: np.ndarray, b: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the first of their (a, b) in document order, ordered by (a, b), and those that come later."""
    order = np.lexsort((at, doc, b, a))
    opens = np.ones(len(order), bool)
    opens[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    lead = order[opens]
    of = lead[np.cumsum(opens) - 1]
    later = (doc[order] != doc[of]) | (at[order] != at[of])  # else the same place, of a repeated row
    return lead, order[later]


def _flush(a: np.ndarray, b: np.ndarray, doc: np.ndarray, at: np.ndarray, n_words: np.ndarray, reach: int, spread: bool) -> pa.RecordBatch:
    """Leaders as rows to group; for the rest one row per document with the windows they remove.

    The latter carry a hash of the document as key, which spreads them, and no position.
    """
    lead, rest = _settled(a, b, doc, at)
    key, kind, marks = a[lead], np.full(len(lead), _PLAIN, np.int8), np.zeros(0, U64)
    if spread and len(lead) > 1:
        same = key[1:] == key[:-1]
        several = np.append(same, False) | np.append(False, same)
        kind[several] = _SPREAD
        marks = np.unique(key[several])
        key = np.where(several, mix64(key ^ mix64(b[lead])), key)
    own, starts = np.zeros(0, np.int64), []
    if len(rest):
        lo = np.maximum(at[rest] - reach, 0)
        hi = np.minimum(at[rest], n_words[rest] - WINDOW)
        d = np.repeat(doc[rest], hi - lo + 1)
        s = np.repeat(lo, hi - lo + 1) + np.arange(len(d)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1)
        order = np.argsort(d, kind="stable")
        d, s = d[order], s[order]
        own, cut = np.unique(d, return_index=True)
        starts = [_merge_runs(x) for x in np.split(s, cut[1:])]
    m, n = len(marks), len(own)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([key, marks, mix64(own.view(U64))]).view(np.int64)),
            pa.array(np.concatenate([b[lead].view(np.int64), np.zeros(m + n, np.int64)])),
            pa.array(np.concatenate([doc[lead], np.zeros(m, np.int64), own])),
            pa.concat_arrays([pa.array(at[lead].astype(np.int32)), pa.nulls(m + n, pa.int32())]),
            pa.array([None] * (len(lead) + m) + starts, pa.binary()),
            pa.array(np.concatenate([kind, np.full(m, _MARK, np.int8), np.full(n, _DONE, np.int8)])),
        ],
        names=["a", "b", "doc_id", "at", "starts", "kind"],
    )


def _settling(found: Iterator[tuple[int, tuple[np.ndarray, ...]]], reach: int, spread: bool) -> Iterator[pa.RecordBatch]:
    """Flushes of the occurrences of (bytes of text, occurrences), about ``SETTLE`` bytes at a time."""
    held, size = [], 0
    for n, some in found:
        held.append(some)
        size += n
        if size >= SETTLE:
            yield _flush(*map(np.concatenate, zip(*held, strict=True)), reach, spread)
            held, size = [], 0
    if held:
        yield _flush(*map(np.concatenate, zip(*held, strict=True)), reach, spread)


def _anchors_of(words: Tokens, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    first = words.windows(ANCHOR)
    row = words.row[first]
    place = first - words.ptr[row]
    count = np.diff(words.ptr)[row]
    on = _ON[place % PERIOD] & (count >= WINDOW)
    first, row, place, count = first[on], row[on], place[on], count[on]
    left = np.minimum(place, REACH)
    right = np.minimum(count - place - ANCHOR, REACH)
    context = words.run_hash(first - left, first + ANCHOR + right, nth=1)
    context = mix64(context ^ (left.astype(U64) << U64(32)) ^ (right.astype(U64) << U64(40)))
    return words.run_hash(first, first + ANCHOR), context, ids[row], place, count


def anchors(docs: DataFrame) -> DataFrame:
    """Cover anchors (a: hash, b: hash of the context) that lead in their batch, and what the batch settled."""

    def found(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, at in blocks(batch.column(1)):
            yield len(data), _anchors_of(Tokens(data, at), ids[lo:hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _settling((x for batch in batches for x in found(batch)), REACH, True)

    return docs.mapInArrow(run, _HITS)


def edge_windows(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text, anchors): the windows around the anchors, keyed by both hashes of their words."""

    def found(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, at in blocks(batch.column(1)):
            words = Tokens(data, at)
            count = np.diff(words.ptr)
            lists = batch.column(2).slice(lo, hi - lo)
            row = np.repeat(np.arange(hi - lo), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            p = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            s = (p[:, None] - np.arange(REACH + 1)).ravel()
            row = np.repeat(row, REACH + 1)
            fits = (s >= 0) & (s + WINDOW <= count[row])
            f = np.unique(words.ptr[row[fits]] + s[fits])
            row = words.row[f] if len(f) else f
            yield len(data), (words.run_hash(f, f + WINDOW), words.run_hash(f, f + WINDOW, nth=1), ids[lo:hi][row], f - words.ptr[row], count[row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _settling((x for batch in batches for x in found(batch)), 0, False)

    return docs.mapInArrow(run, _HITS)


def _kept_text(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text, full: anchors that lose all windows, single: windows, packed: runs of windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in blocks(batch.column(1)):
                removed, texts = [], []
                words = Tokens(data, at)
                raw = data.tobytes()
                for i in range(hi - lo):
                    w0, w1 = int(words.ptr[i]), int(words.ptr[i + 1])
                    n = w1 - w0
                    edge = np.zeros(n + WINDOW + 1, np.int64)
                    for column, reach in ((2, REACH), (3, 0)):
                        got = batch.column(column)[lo + i]
                        if got.is_valid and len(got.values):
                            p = got.values.to_numpy(zero_copy_only=False).astype(np.int64)
                            first, last = np.maximum(p - reach, 0), np.minimum(p, n - WINDOW)
                            first, last = first[first <= last], last[first <= last]
                            np.add.at(edge, first, 1)
                            np.add.at(edge, last + WINDOW, -1)
                    packed = batch.column(4)[lo + i]
                    for x in packed.as_py() or ():
                        runs = np.frombuffer(x, "<i4").reshape(-1, 2).astype(np.int64)
                        runs = runs[runs.sum(axis=1) + WINDOW - 1 <= n]
                        np.add.at(edge, runs[:, 0], 1)
                        np.add.at(edge, runs[:, 0] + runs[:, 1] - 1 + WINDOW, -1)
                    keep = np.flatnonzero(np.cumsum(edge)[:n] == 0) + w0
                    removed.append(n - len(keep))
                    texts.append(b" ".join(raw[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(words.ptr)), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def _firsts(hits: DataFrame) -> DataFrame:
    """Rank of each row among the equal ones (a, b); rows of one place share it."""
    return hits.withColumn("nth", F.rank().over(Window.partitionBy("a", "b").orderBy("doc_id", "at")))


def remove_repeats(docs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text."""
    scratch = scratch or Scratch(docs.sparkSession, "substring-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = docs.filter("doc_id is not null")
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = anchors(named).repartition(int(n), "a")
    context = F.when(F.col("kind") == _MARK, 2).when((F.col("kind") == _PLAIN) & (F.col("nth") == 1), 1)
    hits = _firsts(spread).withColumn("contexts", F.when(F.col("kind") == _SPREAD, 2).otherwise(F.sum(context).over(Window.partitionBy("a"))))
    hits = hits.filter((F.col("kind") == _DONE) | (F.col("kind") != _MARK) & ((F.col("nth") > 1) | (F.col("contexts") > 1)))
    hits = scratch.table(hits.select("doc_id", "at", "starts", (F.col("nth") > 1).alias("full")), "hits")
    leads = hits.filter("starts is null and not full").groupBy("doc_id").agg(F.collect_list("at").alias("anchors"))
    edges = edge_windows(named.join(leads.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "anchors"))
    edges = scratch.table(_firsts(edges).filter("starts is not null or nth > 1").select("doc_id", "at", "starts"), "edges")

    none = F.lit(None).cast("int")
    parts = hits.filter("starts is not null or full").select("doc_id", F.col("at").alias("f"), none.alias("s"), "starts")
    parts = parts.unionByName(edges.select("doc_id", none.alias("f"), F.col("at").alias("s"), "starts"))
    marks = parts.groupBy("doc_id").agg(F.collect_list("f").alias("full"), F.collect_list("s").alias("single"), F.collect_list("starts").alias("packed"))
    return _kept_text(docs.join(marks, "doc_id", "left").select("doc_id", "text", "full", "single", "packed"))


def with_digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
