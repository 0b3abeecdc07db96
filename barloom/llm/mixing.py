"""Mixing sources to target weights.

Each source's documents, in an order fixed by a hash, form one stream of words, cut into
blocks of a fixed length. The mix is a number of slots, one block each, dealt over output
shards. A shard's counts by source are drawn by a tree of multinomial splits: the slots of
a range of shards are divided between its halves at random, so every shard can draw its
own counts from the seed alone and the counts of all shards add up to the target. A slot's
rank within its source goes through a pseudorandom permutation of the source's block
indices, another one in each pass over the source; slots join blocks by index. The last
slot of a source is cut so that the words taken are the target to within one.

Any number of sources will do. They are numbered, given targets and planned as a table; the
splits are drawn in two levels, between chunks of ``CHUNK`` sources and inside a chunk, so a
task holds one chunk and the driver one number for each chunk.

Sources are ordered by code point, null last. Null text has no words. Rows may repeat and
ids be null; each row is a document of its own, known by the hashes of its id, text and
source and its place among equal ones. Sources without words get the target 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkernel import Tokens, U64, blocks, mix64

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 1024
SHARD_SLOTS = 4096
#: Sources in a chunk, and slots that one row of the slots' table is made into, about.
CHUNK = 4096
SLOTS_AT_ONCE = 1 << 18
#: Documents of a source in one window, on average, and such runs whose totals are summed together.
RUN = 500
RUNS = 1024
#: Equal rows are numbered in so many parts.
PARTS = 256
SEED = 20240601


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_PASSES) -> list[float]:
    """Words to take from each of a few sources: ``share`` of all words by weight, none above ``most`` times its size."""
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weight[i] for i in open_)
        full = [i for i in open_ if left * weight[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def numbered(sources: DataFrame, scratch: Scratch, name: str = "numbered") -> DataFrame:
    """Sources with ``source_no``, their place in order: sorted in ranges, then counted range by range."""
    place = scratch.table(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = place.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.col("place") - F.shiftleft(F.col("part"), 33)
    return place.withColumn("part", part).join(counts, "part").withColumn("source_no", F.col("base") + inside).drop("part", "place", "base")


def with_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_PASSES) -> DataFrame:
    """``targets`` for a table of sources: the level of words per weight rises until no more sources are full."""
    every = F.array(*(F.lit(float(w)) for w in weights))
    sources = sources.withColumn("weight", F.element_at(every, (F.col("source_no") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * float(most)
    level, filled = -1.0, -1
    while True:
        full = F.col("weight") * level > cap if level >= 0 else F.lit(False)
        now = sources.agg(
            F.sum(F.when(full, 1).otherwise(0)).alias("n"), F.sum("source_size").alias("size"),
            F.sum(F.when(full, cap).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not now["open"] or now["n"] == filled:
            break
        filled, level = now["n"], (share * now["size"] - now["taken"]) / now["open"]
    whole = F.col("weight") * level > cap if now["open"] else F.lit(True)
    return sources.withColumn("target", F.when(whole, cap).otherwise(F.col("weight") * level)).drop("weight")


class Permutation:
    """A keyed permutation of range(n): a Feistel network on the next power of four, walked into range."""

    ROUNDS = 4

    def __init__(self, n: int, *key: int):
        self.n = n
        self.half = max(1, math.ceil(max(n - 1, 1).bit_length() / 2))
        self.mask = U64((1 << self.half) - 1)
        seed = np.zeros(1, U64)
        for k in key:
            seed = mix64(seed + U64(k & (2**64 - 1)) + U64(1))
        self.keys = [mix64(seed + U64(r + 1))[0] for r in range(self.ROUNDS)]

    def _step(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        left, right = x >> U64(self.half), x & self.mask
        for k in self.keys[::-1] if inverse else self.keys:
            if inverse:
                left, right = right ^ (mix64(left + k) & self.mask), left
            else:
                left, right = right, left ^ (mix64(right + k) & self.mask)
        return (left << U64(self.half)) | right

    def __call__(self, x: np.ndarray, inverse: bool = False) -> np.ndarray:
        out = self._step(np.asarray(x).astype(U64), inverse)
        while len(far := np.flatnonzero(out >= U64(self.n))):
            out[far] = self._step(out[far], inverse)
        return out.astype(np.int64)


@dataclass(frozen=True)
class Source:
    """``slots`` blocks are taken, in order of rank; of the last one only ``last`` words."""

    number: int
    words: int
    blocks: int
    slots: int
    last: int


def plan_source(number: int, words: int, target: float, block: int, seed: int) -> Source:
    want = min(int(target), MOST_PASSES * words)
    if not want:
        return Source(number, words, math.ceil(words / block), 0, 0)
    n = math.ceil(words / block)
    passes, rest = divmod(want, words)
    if not rest:
        passes, rest = passes - 1, words
    tail = words - (n - 1) * block
    short = int(Permutation(n, seed, number, passes)(np.array([n - 1]), inverse=True)[0])  # the rank of the tail block
    ranks = math.ceil(rest / block)
    if ranks > short:
        ranks = max(short + 1, math.ceil((rest + block - tail) / block))
    before = (ranks - 1) * block - (block - tail if ranks - 1 > short else 0)
    return Source(number, words, n, passes * n + ranks, rest - before)


def planned(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """source_no and the numbers of its ``Source``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plans = [plan_source(*x, block, seed) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            columns = [[getattr(p, k) for p in plans] for k in ("number", "words", "blocks", "slots", "last")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["source_no", "words", "blocks", "slots", "last"])

    return sources.select("source_no", "source_size", "target").mapInArrow(run, "source_no long, words long, blocks long, slots long, last long")


def _split(counts: np.ndarray, part: int, rng: np.random.Generator) -> np.ndarray:
    """``part`` of the slots, drawn by source as a multinomial; what exceeds a source is drawn again among the rest."""
    drawn = np.zeros_like(counts)
    while lack := part - int(drawn.sum()):
        room = counts - drawn
        drawn = np.minimum(drawn + rng.multinomial(lack, room / room.sum()), counts)
    return drawn


def shard_counts(lo: int, hi: int, shards: int, totals: np.ndarray, chunk: int, slots: np.ndarray, per_shard: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shards lo to hi - 1 with the first rank and count of each source of a chunk, from the splits on the way to them.

    ``totals`` are the slots of every chunk, ``slots`` those of the chunk's sources.
    """
    todo = [(0, shards, totals, slots, np.zeros_like(slots))]
    while todo:
        a, b, every, counts, first = todo.pop()
        if b <= lo or a >= hi:
            continue
        if b - a == 1:
            yield a, first, counts
            continue
        mid = (a + b) // 2
        left = _split(every, (mid - a) * per_shard, np.random.Generator(np.random.PCG64([seed, a, b])))
        own = _split(counts, int(left[chunk]), np.random.Generator(np.random.PCG64([seed, a, b, chunk])))
        todo += [(mid, b, every - left, counts - own, first + own), (a, mid, left, own, first)]


def slot_table(sources: DataFrame, block: int, per_shard: int, seed: int) -> DataFrame:
    """shard, source_no, pass_no, block_no, the words taken from the block's start and the slot's place in its shard and chunk.

    ``sources`` is a planned table. A row per chunk and range of shards, about ``SLOTS_AT_ONCE`` slots, is made first.
    """
    fields = ("source_no", "blocks", "slots", "last")
    chunks = sources.withColumn("chunk", F.floor(F.col("source_no") / CHUNK)).groupBy("chunk").agg(
        F.sum("slots").alias("total"), F.sort_array(F.collect_list(F.struct(*fields))).alias("own")
    )
    known = {r["chunk"]: r["total"] for r in chunks.select("chunk", "total").collect()}
    totals = np.array([known.get(c, 0) for c in range(max(known, default=-1) + 1)], np.int64)
    shards = max(1, math.ceil(int(totals.sum()) / per_shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, lo, hi, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                number, blocks_, slots, last = (np.array([x[k] for x in own], np.int64) for k in fields)
                for shard, first, counts in shard_counts(lo, hi, shards, totals, chunk, slots, per_shard, seed):
                    slot = 0
                    for s in np.flatnonzero(counts):
                        rank = np.arange(first[s], first[s] + counts[s])
                        turn, place = np.divmod(rank, blocks_[s])
                        where = np.empty(len(rank), np.int64)
                        for t in np.unique(turn):
                            now = turn == t
                            where[now] = Permutation(int(blocks_[s]), seed, int(number[s]), int(t))(place[now])
                        taken = np.where(rank == slots[s] - 1, last[s], block)
                        columns = (np.full(len(rank), shard), np.arange(slot, slot + len(rank)), np.full(len(rank), number[s]), turn, where, taken)
                        slot += len(rank)
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["shard", "slot", "source_no", "pass_no", "block_no", "limit"])

    wide = F.greatest(F.lit(1), F.ceil(shards * SLOTS_AT_ONCE / F.col("total"))).cast("long")  # shards of a row
    ranges = chunks.filter("total > 0").withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"), wide)))
    ranges = ranges.select("chunk", "lo", F.least(F.col("lo") + wide, F.lit(shards)).alias("hi"), "own")
    return ranges.repartition("chunk", "lo").mapInArrow(run, "shard long, slot long, source_no long, pass_no long, block_no long, limit long")


@dataclass
class Mix:
    """``rows``: every document with its place; ``pieces``: the parts of documents that the slots take."""

    rows: DataFrame
    pieces: DataFrame
    slots: DataFrame


def _key(id_col: str, text_col: str, source_col: str) -> list[Column]:
    own = [F.col(c) for c in (id_col, text_col, source_col)]
    return [F.xxhash64(F.lit(n), *own, *(c.isNull() for c in own)).alias(f"key_{n}") for n in (1, 2)]


def _copies(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with ``copy``, their number among rows of equal keys, whatever the order of the input."""
    key = ["key_1", "key_2"]
    own = scratch.table(rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "sizes")
    local = F.row_number().over(Window.partitionBy(*key, "part").orderBy("part")) - 1
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    base = parts.select(*key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).filter("base > 0")
    return own.withColumn("local", local).join(base, [*key, "part"], "left").withColumn("copy", F.coalesce("base", F.lit(0)) + F.col("local")).drop("part", "local", "base")


def mix(docs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, block: int = BLOCK_WORDS, per_shard: int = SHARD_SLOTS, seed: int = SEED) -> Mix:
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), *_key(id_col, text_col, source_col))
    rows = scratch.table(_copies(rows, scratch), "copies")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    spec = scratch.table(with_targets(numbered(totals, scratch), weights, share), "spec")
    plans = scratch.table(planned(spec, block, seed), "plans")

    spec = spec.select(F.col("source").alias("spec_source"), "source_no", "source_size", "target", F.ceil(F.col("n") / RUN).alias("runs"))
    placed = rows.join(spec, rows["source"].eqNullSafe(spec["spec_source"])).drop("spec_source")
    placed = scratch.table(placed.withColumn("run", F.pmod(F.xxhash64("key_1", "key_2", "copy", F.lit(seed)), "runs")).drop("runs"), "runs")
    order = Window.partitionBy("source_no", "run").orderBy("key_1", "key_2", "copy")
    numbers = placed.withColumn("nth", F.row_number().over(order)).withColumn("inside", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = scratch.table(numbers.join(_bases(placed), ["source_no", "run"]).withColumn("at", F.col("base") + F.col("inside")).drop("base", "inside"), "placed")

    slots = scratch.table(slot_table(plans, block, per_shard, seed), "slots")
    cut = placed.filter("size > 0").select(
        "source_no", "run", "nth", "key_1", "key_2", "copy", "doc_id", "at", "size",
        F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block_no"),
    )
    start = F.greatest("at", F.col("block_no") * block)
    cut = cut.withColumn("lo", start - F.col("at")).withColumn("hi", F.least(F.col("at") + F.col("size"), (F.col("block_no") + 1) * block) - F.col("at")).withColumn("in_block", start - F.col("block_no") * block)
    pieces = cut.join(slots, ["source_no", "block_no"]).withColumn("hi", F.least("hi", F.col("lo") + F.col("limit") - F.col("in_block"))).filter("hi > lo")
    return Mix(placed, pieces.select("source_no", "run", "nth", "key_1", "key_2", "copy", "size", "doc_id", "shard", "slot", "pass_no", "in_block", "lo", "hi"), slots)


def _bases(placed: DataFrame) -> DataFrame:
    """Words of a source before each of its runs: sums inside ``RUNS`` runs and over such groups of runs."""
    up_to = lambda *key: Window.partitionBy(*key[:-1]).orderBy(key[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("source_no", "run").agg(F.sum("size").alias("t")).withColumn("many", F.floor(F.col("run") / RUNS))
    many = runs.groupBy("source_no", "many").agg(F.sum("t").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(up_to("source_no", "many")), F.lit(0)))
    runs = runs.withColumn("base", F.coalesce(F.sum("t").over(up_to("source_no", "many", "run")), F.lit(0)))
    return runs.join(many.drop("t"), ["source_no", "many"]).select("source_no", "run", (F.col("base") + F.col("before")).alias("base"))


def taken(mixed: Mix) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    key = ["source_no", "run", "nth"]
    sums = mixed.pieces.groupBy(*key).agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    return mixed.rows.join(sums, key, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, mixed: Mix) -> DataFrame:
    """The mix as documents: per pass over its source, a document with the words taken from it.

    A document taken whole keeps its text as it is; of another, the stretches taken are
    joined by a new line. ``docs`` has the columns of ``documents``. Rows that agree in id,
    text and source are copies: each gives what the mix took from it, with the other columns
    of one of them.
    """
    key, own = ["key_1", "key_2"], ["mix_1", "mix_2"]
    names = docs.columns
    wanted = mixed.pieces.groupBy(*key, "copy").agg(F.sort_array(F.collect_list(F.struct("pass_no", "lo", "hi"))).alias("mix_ranges"), F.max("size").alias("mix_size"))
    wanted = wanted.withColumnsRenamed(dict(zip(key, own, strict=True))).drop("copy")
    repeated = mixed.rows.filter("copy > 0").select(*(F.col(k).alias(o) for k, o in zip(key, own, strict=True))).distinct()
    keyed = docs.select(*names, *(k.alias(o) for k, o in zip(_key("doc_id", "text", "source"), own, strict=True)))
    if repeated.isEmpty():
        joined = keyed.join(wanted, own)
    else:
        once = keyed.join(repeated, own, "left_anti").unionByName(keyed.join(repeated, own, "left_semi").dropDuplicates(own))
        joined = once.join(wanted, own)
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, ranges_ = b.column(b.num_columns - 1), b.column(b.num_columns - 2)
            if b.schema.names[-1] != "mix_size":
                size, ranges_ = ranges_, size
            row, texts = [], []
            for lo, hi, data, at in blocks(b.column(text_at)):
                words = Tokens(data, at)
                raw = data.tobytes()
                for i in range(hi - lo):
                    by_pass: dict[int, list[list[int]]] = {}
                    for r in ranges_[lo + i].as_py():
                        spans = by_pass.setdefault(r["pass_no"], [])
                        if spans and spans[-1][1] == r["lo"]:
                            spans[-1][1] = r["hi"]
                        else:
                            spans.append([r["lo"], r["hi"]])
                    n, first = size[lo + i].as_py(), words.ptr[i]
                    for spans in by_pass.values():
                        row.append(lo + i)
                        if spans == [[0, n]]:
                            texts.append(raw[at[i] : at[i + 1]].decode())
                        else:
                            texts.append(b"\n".join(raw[words.start[first + s] : words.end[first + e - 1]] for s, e in spans).decode())
            out = [b.column(k).take(pa.array(row, pa.int64())) for k in range(len(names))]
            out[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                out[chars_at] = pa.array([len(t) for t in texts], pa.int64()).cast(out[chars_at].type)
            yield pa.RecordBatch.from_arrays(out, names=names)

    return joined.select(*names, "mix_ranges", "mix_size").mapInArrow(run, schema)
