"""Removal of byte strings that occur more than once, by suffix arrays of shards.

Every byte that a string of ``LENGTH`` = 200 bytes covers is removed when the same string
also starts anywhere else, in the same document or in another. A place where such a string
starts is called a window.

Windows are dealt to shards by content, so that equal ones meet: a window's key is the
least hash among its grams of ``GRAM`` bytes (the first of equal ones). Neighbouring
windows mostly share the gram, so a document falls into regions, one per gram, of some 70
windows each. Equal regions are one text with a weight. Regions whose key is in the corpus
once hold no repeated window and are dropped by a count of keys, before any text is moved.

The texts of the other regions go to the shard of their key. A shard is the regions of some
keys, put together to about ``SHARD`` bytes; its suffixes are sorted by induced sorting and
the permuted common prefixes follow (``suffix_array``). Windows next to each other in that
order with a common prefix of 200 bytes are one string; it is repeated when its regions
weigh two or more. The places go back to the documents by region.

A key with more than ``WIDE`` different regions (a common passage between other words each
time) is dealt again, window by window with the window's hash as its key, so that no shard
grows with the corpus. Each batch of documents joins its equal regions before the shuffle:
a passage of a third of all documents is one row per batch.

Regions are told apart by two independent hashes of 64 bits; windows in a shard by bytes.

Null text is empty. Ids may repeat or be null: each row is a document of its own, and rows
of equal text repeat each other. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .suffix_array import common_prefixes, suffix_array
from .textkernel import Rolling, U64, blocks, mix64, text_bytes

LENGTH = 200
GRAM = 64
SHARD = 2 << 20
WIDE = 8192
#: Text whose equal regions are joined together, in bytes.
SETTLE = 16 << 20
_SEGMENT = 1 << 20
_LOW = U64((1 << 20) - 1)
_SEPARATOR = 0xFF


def _segments(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Rows lo to hi with their bytes and offsets; a long row comes in parts of a segment that overlap by a window less one.

    The last item is the place of the part in its row.
    """
    for lo, hi, data, at in blocks(column, _SEGMENT):
        if len(data) <= _SEGMENT:
            yield lo, hi, data, at, 0
            continue
        step = _SEGMENT - LENGTH + 1
        for x in range(0, len(data) - LENGTH + 1, step):
            part = data[x : x + _SEGMENT]
            yield lo, hi, part, np.array([0, len(part)]), x


def _window_places(at: np.ndarray) -> np.ndarray:
    """Places of a segment where a window of one row starts."""
    n = np.maximum(np.diff(at) - LENGTH + 1, 0)
    return np.repeat(at[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    return key if span == width else np.minimum(key[: len(key) - (width - span)], key[width - span :])


def _regions(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key, digest, row, first window (in the row) and number of windows of each region."""
    s = _window_places(at)
    none = np.zeros(0, np.int64)
    if not len(s):
        return none.view(U64), none.view(U64), none, none, none
    grams = Rolling(data).grams(GRAM)
    key = grams & ~_LOW | np.arange(len(grams), dtype=U64)
    gram = (_least(key, LENGTH - GRAM + 1)[s] & _LOW).astype(np.int64)
    first = np.append(0, np.flatnonzero((np.diff(gram) != 0) | (np.diff(s) != 1)) + 1)
    count = np.diff(np.append(first, len(s)))
    begin = s[first]
    row = np.searchsorted(at, begin, side="right") - 1
    return grams[gram[first]], Rolling(data, 1).spans(begin, begin + count + LENGTH - 1), row, begin - at[row], count


def _hashed_windows(data: np.ndarray, row: np.ndarray, first: np.ndarray, count: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The windows of regions as regions of their own, with hashes of the whole window as key and digest."""
    w = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    row = np.repeat(row, count)
    begin = at[row] + w
    return mix64(Rolling(data).spans(begin, begin + LENGTH) + U64(1)), Rolling(data, 1).spans(begin, begin + LENGTH), row, w, np.ones(len(w), np.int64)


_PLACED = "m long, d long, n long, windows int, docs array<struct<doc_id:{kind},text_hash:long,at:long>>"


def _joined(parts: list[tuple]) -> pa.RecordBatch:
    """Equal regions of several segments as one row with their places."""
    m, d, count, at = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 4, 3))
    ids = pa.concat_arrays([p[5].take(pa.array(p[2])) for p in parts])
    hashes = np.concatenate([p[6][p[2]] for p in parts])
    order = np.lexsort((count, d, m))
    m, d, count, at = m[order], d[order], count[order], at[order]
    opens = np.append(True, (m[1:] != m[:-1]) | (d[1:] != d[:-1]) | (count[1:] != count[:-1]))[: len(m)]
    first = np.flatnonzero(opens)
    ends = np.append(first, len(m)).astype(np.int32)
    docs = pa.StructArray.from_arrays([ids.take(pa.array(order)), pa.array(hashes[order]), pa.array(at)], names=["doc_id", "text_hash", "at"])
    return pa.RecordBatch.from_arrays(
        [pa.array(m[first].view(np.int64)), pa.array(d[first].view(np.int64)), pa.array(np.diff(ends).astype(np.int64)), pa.array(count[first].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), docs)],
        names=["m", "d", "n", "windows", "docs"],
    )


def _settling(found: Iterator[tuple[int, tuple]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for n, part in found:
        if len(part[0]):
            held.append(part)
        size += n
        if size >= SETTLE and held:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def placed_regions(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text_hash, text): the regions (m: key, d: digest) with their places in documents."""

    def found(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
        hashes = batch.column(1).to_numpy()
        for lo, hi, data, at, base in _segments(batch.column(2)):
            m, d, row, first, count = _regions(data, at)
            yield len(data), (m, d, row, first + base, count, batch.column(0).slice(lo, hi - lo), hashes[lo:hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _settling(x for b in batches for x in found(b))

    return docs.mapInArrow(run, _PLACED.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def placed_windows(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text_hash, text, regions): the same for each window of the regions (at, windows)."""

    def found(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
        hashes = batch.column(1).to_numpy()
        for i in range(len(batch)):
            data, at = text_bytes(batch.column(2).slice(i, 1))
            own = batch.column(3)[i].values
            begin, count = (own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for x in range(0, len(begin), 4096):  # regions of one text, some hundred thousand windows at a time
                b, c = begin[x : x + 4096], count[x : x + 4096]
                lo, hi = int(b.min()), int((b + c).max()) + LENGTH - 1
                part = _hashed_windows(data[lo:hi], np.zeros(len(b), np.int64), b - lo, c, np.array([0, hi - lo]))
                yield int(c.sum()) * 32, (*part[:3], part[3] + lo, part[4], batch.column(0).slice(i, 1), hashes[i : i + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _settling(x for b in batches for x in found(b))

    return docs.mapInArrow(run, _PLACED.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def _texts(docs: DataFrame) -> DataFrame:
    """Of (text, regions: at, windows, m, d, n): the regions' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data, _ = text_bytes(batch.column(0).slice(i, 1))
                own = batch.column(1)[i].values
                at, windows = (own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                raw = [data[x : x + w + LENGTH - 1].tobytes() for x, w in zip(at.tolist(), windows.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.field(2), own.field(3), own.field(4), pa.array(raw, pa.binary())], names=["m", "d", "n", "region"])

    return docs.mapInArrow(run, "m long, d long, n long, region binary")


def _runs(places: np.ndarray) -> bytes:
    """Sorted places as packed (first, length)."""
    first = np.append(0, np.flatnonzero(np.diff(places) != 1) + 1)
    return np.stack([places[first], np.diff(np.append(first, len(places)))], axis=1).astype("<i4").tobytes()


def repeated_windows(regions: list[bytes], weights: np.ndarray) -> list[bytes | None]:
    """One shard: per region the runs of its windows whose string weighs two or more in the shard."""
    size = np.array([len(r) for r in regions], np.int64)
    begin = np.cumsum(size + 1) - (size + 1)
    t = np.frombuffer(b"".join(r + bytes([_SEPARATOR]) for r in regions), np.uint8)
    order = suffix_array(t)
    same = common_prefixes(t, order, LENGTH)[order] >= LENGTH
    count = size - LENGTH + 1
    weight = np.zeros(len(t), np.int64)
    window = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    weight[window] = np.repeat(weights, count)
    string = np.cumsum(~same)
    total = np.bincount(string, weights=weight[order])
    repeated = np.zeros(len(t), bool)
    repeated[order] = total[string] > 1
    repeated &= weight > 0
    found = np.flatnonzero(repeated)
    cut = np.searchsorted(found, np.append(begin, len(t)))
    return [_runs(found[x:y] - b) if y > x else None for x, y, b in zip(cut[:-1].tolist(), cut[1:].tolist(), begin.tolist(), strict=True)]


def searched(texts: DataFrame) -> DataFrame:
    """Of regions with their bytes, sorted by key inside partitions: those with repeated windows, by shards of whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def shard() -> pa.RecordBatch:
            m, d, n, raw = zip(*held, strict=True)
            found = repeated_windows(list(raw), np.array(n, np.int64))
            keep = [i for i, x in enumerate(found) if x is not None]
            return pa.RecordBatch.from_arrays([pa.array([m[i] for i in keep], pa.int64()), pa.array([d[i] for i in keep], pa.int64()), pa.array([found[i] for i in keep], pa.binary())], names=["m", "d", "runs"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD and row[0] != last:
                    yield shard()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[3]), row[0]
        if held:
            yield shard()

    return texts.mapInArrow(run, "m long, d long, runs binary")


def _kept(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text, marks: at, runs): what is left of the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in blocks(batch.column(1)):
                removed, spans, kept = [], [], []
                for i in range(hi - lo):
                    own, marks = data[at[i] : at[i + 1]], batch.column(2)[lo + i]
                    if not marks.is_valid or not len(marks.values):
                        removed.append(0)
                        spans.append(0)
                        kept.append(own.tobytes())
                        continue
                    place = marks.values.field(0).to_numpy(zero_copy_only=False)
                    packed = marks.values.field(1).to_pylist()
                    runs = np.frombuffer(b"".join(packed), "<i4").reshape(-1, 2).astype(np.int64)
                    start = np.repeat(place, [len(x) // 8 for x in packed]) + runs[:, 0]
                    end = start + runs[:, 1] - 1 + LENGTH
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate(end[order])
                    first = np.append(0, np.flatnonzero(start[1:] > end[:-1]) + 1)
                    s, e = start[first], end[np.append(first[1:] - 1, len(end) - 1)]
                    removed.append(int((e - s).sum()))
                    spans.append(len(s))
                    kept.append(b"".join(own[x:y].tobytes() for x, y in zip([0, *e.tolist()], [*s.tolist(), len(own)], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def _at_documents(docs: DataFrame, rows: DataFrame, name: str, *fields: str) -> DataFrame:
    """Documents with what ``rows`` (doc_id, text_hash, fields) say of them as an array, null where nothing."""
    own = rows.groupBy(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")).agg(F.collect_list(F.struct(*fields)).alias(name))
    same: Column = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))
    return docs.join(own.hint("shuffle_hash"), same, "left").select("doc_id", "text_hash", "text", name)


def remove_repeats(docs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left)."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix-dedup")
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))

    def candidates(placed: DataFrame) -> DataFrame:
        """The regions whose key is there twice."""
        keys = placed.groupBy("m").agg(F.sum("n").alias("total")).filter("total > 1").select("m")
        return placed.join(keys.hint("shuffle_hash"), "m", "left_semi")

    placed = scratch.table(placed_regions(docs), "placed")
    found = scratch.table(candidates(placed), "candidates")
    scratch.drop("placed")
    one = F.element_at("docs", 1)
    distinct = scratch.table(found.groupBy("m", "d", "windows").agg(F.sum("n").alias("n"), F.min(F.struct(one["text_hash"], one["doc_id"], one["at"])).alias("one")), "distinct")
    wide = scratch.table(distinct.groupBy("m").agg(F.count(F.lit(1)).alias("regions")).filter(F.col("regions") > WIDE).select("m"), "wide")
    if not wide.isEmpty():
        again = found.join(wide, "m", "left_semi").select("windows", F.explode("docs").alias("x")).select("x.*", "windows")
        again = _at_documents(docs, again, "regions", "at", "windows").filter("regions is not null")
        windows = scratch.table(placed_windows(again), "placed-windows")
        found = found.join(wide, "m", "left_anti").unionByName(candidates(windows))
        narrow = distinct.join(wide, "m", "left_anti")
        one = F.element_at("docs", 1)
        more = candidates(windows).groupBy("m", "d", "windows").agg(F.sum("n").alias("n"), F.min(F.struct(one["text_hash"], one["doc_id"], one["at"])).alias("one"))
        distinct = narrow.unionByName(more)

    leads = distinct.select("one.*", "windows", "m", "d", "n")
    texts = _texts(_at_documents(docs, leads, "regions", "at", "windows", "m", "d", "n").filter("regions is not null").select("text", "regions"))
    repeated = scratch.table(searched(texts.repartition("m").sortWithinPartitions("m")), "repeated")
    marks = found.join(repeated.hint("shuffle_hash"), ["m", "d"]).select(F.explode("docs").alias("x"), "runs").select("x.*", "runs")
    marks = scratch.table(marks, "marks")
    return _kept(_at_documents(docs, marks, "marks", "at", "runs").select("doc_id", "text", "marks"))


def with_digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
