"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join.

Each document's set of five-word shingles gives ``SYMBOLS`` b-bit MinHash symbols. A
signature is split into chunks of ``CHUNK`` symbols. Signatures that differ in at most
``RADIUS`` = 2 * chunks - 1 symbols have, by the pigeonhole principle, a chunk with at most
one error; enumerating the one symbol that may differ (each in turn left out of the key)
finds every such pair by equality. Symbols agree with the probability of the Jaccard
similarity: a pair at 0.75 has no chunk with at most one error twice in a million. It
differs in more than ``FAR`` symbols, beyond which pairs are not confirmed, less than once
in a thousand million times. All others are confirmed on the full shingle sets.

Links are found without enumerating a bucket's pairs. Documents with equal sets are one
node. In each bucket the smallest node, its pivot, is compared with all others; components
of the links follow. What remains are pairs of one bucket in different components. They
lie in one group, a component of all pairs (pivot, node). A group has a consensus P, the
shingles of more than half its nodes, and a node differs from it by u extra and m missing
shingles. With W = 4 m + 3 u, two nodes that share s of their differences are similar by
0.75 exactly if W + W' <= |P| + 7 s. Without shared differences that is a star around the
node of least W; beyond it a pair needs an overlap that grows with W and with the size, so
it must share one of the rarest differences of one side, and those are joined by equality
(a prefix filter). A group without much in common has an empty consensus, and the filter is
then the usual one for the Jaccard similarity. A large group is split by node: what is known
of the group, one row, is there once for each ``SPLIT`` of its nodes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, small_batches
from .textkernel import SPACE, Tokens, U64, blocks, mix64

WORDS = 5
SIMILARITY = 75  # in hundredths
SYMBOLS = 65
CHUNK = 5
CHUNKS = SYMBOLS // CHUNK
RADIUS = 2 * CHUNKS - 1
FAR = 40
#: Nodes of a group that meet in one task, about.
SPLIT = 500

_A = mix64(np.arange(1, SYMBOLS + 1, dtype=U64)) | U64(1)
_B = mix64(np.arange(1001, SYMBOLS + 1001, dtype=U64))


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a block, and the offsets of its rows in them."""
    words = Tokens(data, at, SPACE, lower=True)
    count = np.diff(words.ptr)
    first = words.windows(WORDS)
    last = first + WORDS
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        first = np.concatenate([first, words.ptr[short]])
        last = np.concatenate([last, words.ptr[short + 1]])
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
    return words.run_hash(first, last), np.searchsorted(first, words.ptr)


def signatures(docs: DataFrame) -> DataFrame:
    """Id, size and digest of the shingle set, and the signature; null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in blocks(b.column(1)):
                h, ptr = shingles(data, at)
                full = np.flatnonzero(np.diff(ptr))
                sig = np.empty((len(full), SYMBOLS), np.uint16)
                if len(full):
                    for k in range(SYMBOLS):
                        sig[:, k] = mix64(np.minimum.reduceat(h * _A[k] + _B[k], ptr[full])).astype(np.uint16)
                size = np.zeros(hi - lo, np.int64)
                digest: list[bytes | None] = [None] * (hi - lo)
                sigs: list[bytes | None] = [None] * (hi - lo)
                for j, i in enumerate(full):
                    own = np.unique(h[ptr[i] : ptr[i + 1]])
                    size[i] = len(own)
                    digest[i] = xxhash.xxh3_128_digest(own)
                    sigs[i] = sig[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(size), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def chunk_keys(nodes: DataFrame) -> DataFrame:
    """(key, node) for each chunk of a signature and each symbol left out of it."""
    shifts = np.array([48, 32, 16, 0], U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(n, CHUNKS, CHUNK).astype(U64)
            keys = np.empty((n, CHUNKS, CHUNK), U64)
            for out in range(CHUNK):
                tag = mix64(np.arange(CHUNKS, dtype=U64) * U64(CHUNK) + U64(out))
                keys[:, :, out] = mix64((np.delete(sig, out, axis=2) << shifts).sum(axis=2, dtype=U64) ^ tag)
            node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def _distances(pairs: DataFrame) -> DataFrame:
    """Pairs (x, y, sig_x, sig_y, size_x, size_y) with their signature distance instead of the signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for k in (4, 5))
            far = (x != y).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(far)], names=["x", "y", "size_x", "size_y", "far"])

    return pairs.select("x", "y", "size_x", "size_y", "sig_x", "sig_y").mapInArrow(run, "x long, y long, size_x long, size_y long, far int")


def _with_distance(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    for side in ("x", "y"):
        own = nodes.select(F.col("node").alias(side), F.col("n").alias(f"size_{side}"), F.col("sig").alias(f"sig_{side}"))
        pairs = pairs.join(own, side)
    return _distances(pairs)


def _sizes_allow(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Id and sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in blocks(b.column(1)):
                h, ptr = shingles(data, at)
                own = [np.unique(h[p:q]).view(np.int64) for p, q in zip(ptr[:-1], ptr[1:], strict=True)]
                sets = pa.ListArray.from_arrays(np.cumsum([0, *map(len, own)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *own]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), sets], names=["node", "items"])

    return docs.mapInArrow(run, "node long, items array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with ``common``, the size of the intersection of their full sets."""
    x = sets.select(F.col("node").alias("x"), F.col("items").alias("items_x"))
    y = sets.select(F.col("node").alias("y"), F.col("items").alias("items_y"))
    return pairs.join(y, "y").join(x, "x").select(*pairs.columns, F.size(F.array_intersect("items_x", "items_y")).cast("long").alias("common"))


def _linked() -> Column:
    return 100 * F.col("common") >= SIMILARITY * (F.col("size_x") + F.col("size_y") - F.col("common"))


def _near(pairs: DataFrame) -> DataFrame:
    return pairs.filter((F.col("far") <= FAR) & _sizes_allow(F.col("size_x"), F.col("size_y")))


def _sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    return shingle_sets(docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def _links(confirmed: DataFrame) -> DataFrame:
    return confirmed.filter(_linked()).select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles and stay alone; so do rows without an id, whose
    component is null. The id is a key: rows that repeat one share its component. Columns
    other than the two named are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        rows = scratch.table(signatures(docs), "rows")
    same = ["digest", "n_shingles"]
    real = rows.filter("n_shingles > 0 and doc_id is not null")
    nodes = scratch.table(
        real.groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")).withColumnRenamed("n_shingles", "n"), "nodes"
    )
    keys = chunk_keys(nodes)
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    members = scratch.table(keys.join(shared, "key"), "members")

    stars = members.filter("node <> pivot").select(F.col("pivot").alias("x"), F.col("node").alias("y")).distinct()
    stars = scratch.table(_with_distance(stars, nodes), "stars")
    with small_batches(docs.sparkSession):
        sets = scratch.table(_sets_of(docs, stars), "sets")
    found = scratch.table(_confirm(_near(stars), sets), "found")
    links = _links(found)
    comp = scratch.table(components(links, scratch, "first"), "comp")

    more = [links]
    groups = scratch.table(_busy_groups(stars, comp, scratch), "groups")
    if not groups.isEmpty():
        shapes = scratch.table(_shapes(groups, sets), "shapes")
        centred = scratch.table(_centred(shapes), "centred")
        more.append(_consensus_star(centred))
        pairs = scratch.table(_sharing(centred), "sharing")
        more.append(_links(_confirm(pairs, sets)))
    every = scratch.table(functools.reduce(DataFrame.unionByName, more), "links")
    scratch.drop("members", "sets", "shapes", "centred")
    final = components(every, scratch, "final")

    of_node = nodes.select("digest", F.col("n").alias("n_shingles"), "node").join(final, "node", "left")
    of_node = of_node.select(*same, F.coalesce("component", "node").alias("component_id"))
    grouped = rows.select("doc_id", *same).join(of_node, same, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return grouped.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _component_of(rows: DataFrame, comp: DataFrame, node: str, to: str) -> DataFrame:
    of = comp.select(F.col("node").alias("of_node"), F.col("component").alias("of_component"))
    joined = rows.join(of, F.col(node) == F.col("of_node"), "left")
    return joined.withColumn(to, F.coalesce("of_component", node)).drop("of_node", "of_component")


def _busy_groups(stars: DataFrame, comp: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, node, comp, members, split): groups of candidate pairs that hold several components of links."""
    edges = stars.select(F.col("x").alias("a"), F.col("y").alias("b"))
    group = components(edges, scratch, "group")
    full = group.select("node", F.col("component").alias("grp")).unionByName(group.select(F.col("component").alias("node"), F.col("component").alias("grp")).distinct())
    full = scratch.table(_component_of(full, comp, "node", "comp"), "in-groups")
    sums = full.groupBy("grp").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("members"))
    busy = scratch.table(sums.filter("c0 <> c1").select("grp", "members"), "busy")
    split = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / SPLIT)).alias("split")
    return full.join(busy, "grp").select("grp", "node", "comp", "members", split)


def _for_each_split(groups: DataFrame) -> DataFrame:
    """One row per group and split of it, from one row per group with ``members``."""
    splits = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("members") / SPLIT) - 1)
    return groups.withColumn("split", F.explode(splits)).drop("members")


def _shapes(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Per node of a busy group: size, |P| (p), W (w) and the differences from the group's consensus."""
    own = groups.join(sets, "node")
    counts = own.select("grp", "members", F.explode("items").alias("item")).groupBy("grp", "members", "item").agg(F.count(F.lit(1)).alias("c"))
    # at most twice the mean size of the group's sets
    consensus = counts.filter(2 * F.col("c") > F.col("members")).groupBy("grp", "members").agg(F.collect_list("item").alias("agreed"))
    shaped = own.join(_for_each_split(consensus), ["grp", "split"], "left").withColumn("agreed", F.coalesce("agreed", F.array().cast("array<bigint>")))
    shaped = shaped.withColumns({"extra": F.array_except("items", "agreed"), "missing": F.array_except("agreed", "items")})
    w = (4 * F.size("missing") + 3 * F.size("extra")).alias("w")
    return shaped.select("grp", "split", "members", "node", "comp", F.size("items").alias("n"), F.size("agreed").alias("p"), w, F.concat("extra", "missing").alias("diff"))


def _centred(shapes: DataFrame) -> DataFrame:
    """Shapes with the group's node of least W (centre, least) and its largest W (most)."""
    best = shapes.groupBy("grp", "members").agg(F.min(F.struct("w", "node")).alias("c"), F.max("w").alias("most"))
    best = best.select("grp", "members", F.col("c.w").alias("least"), F.col("c.node").alias("centre"), "most")
    return shapes.drop("members").join(_for_each_split(best), ["grp", "split"])


def _consensus_star(centred: DataFrame) -> DataFrame:
    """Links to the group's node of least W that hold whatever the differences shared."""
    return centred.filter("w + least <= p and node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))


def _sharing(centred: DataFrame) -> DataFrame:
    """Pairs (x, y, size_x, size_y) of a group that may be similar by the differences they share.

    One of the two is odd: not linked to the centre by W alone. The other then needs an
    overlap of at least ``need``, so it shares one of its rarest |diff| - need + 1 differences.
    """
    every = centred.filter("most + least > p").withColumn("odd", F.col("w") + F.col("least") > F.col("p"))
    each = every.select("grp", "node", "comp", "n", "p", "w", "least", "odd", F.size("diff").alias("d"), F.explode("diff").alias("item"))
    often = each.groupBy("grp", "item").agg(F.count(F.lit(1)).alias("often"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    often = often.filter("c0 <> c1").select("grp", "item", "often")
    # what the other side's W is at least: that of an odd node, or of any node, and by the sizes
    by_size = F.ceil(2.25 * F.col("n") - 3 * F.col("p"))
    need = lambda w: F.greatest(F.lit(1), F.ceil((F.col("w") + F.greatest(w, by_size) - F.col("p")) / 7))
    beside_odd, beside_any = need(F.col("p") - F.col("least") + 1), need(F.col("least"))
    # differences of one component alone, which no pair looked for shares, rank first
    shared = each.join(often, ["grp", "item"]).withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("often", "item")))
    shared = shared.withColumn("rank", F.col("rank") + F.col("d") - F.count(F.lit(1)).over(Window.partitionBy("node")))
    index = shared.filter(F.col("rank") <= F.col("d") - beside_odd + 1)
    one = index.select("grp", "item", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("size_x"), F.col("w").alias("wx"), (F.col("d") - F.col("rank") + 1).alias("dx"))
    index = shared.filter(F.col("odd") & (F.col("rank") <= F.col("d") - beside_any + 1))
    two = index.select("grp", "item", F.col("node").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("size_y"), F.col("w").alias("wy"), (F.col("d") - F.col("rank") + 1).alias("dy"), "p")
    # from the first shared difference on, there must be enough left on both sides
    joined = one.join(two, ["grp", "item"]).filter(
        (F.col("cx") != F.col("cy")) & _sizes_allow(F.col("size_x"), F.col("size_y")) & (F.col("wx") + F.col("wy") <= F.col("p") + 7 * F.least("dx", "dy"))
    )
    swap = F.col("x") > F.col("y")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a)).cast("long")
    pairs = joined.groupBy("x", "y", "size_x", "size_y", "wx", "wy", "p").agg(F.lit(1))
    return pairs.select(pick("x", "y").alias("x"), pick("y", "x").alias("y"), pick("size_x", "size_y").alias("size_x"), pick("size_y", "size_x").alias("size_y")).distinct()
