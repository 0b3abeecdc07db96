"""Alignment of two tokenizers by merging the ends of their tokens.

Both token sequences of a text cover the same bytes, so the ends of A's tokens and those of
B's are two sorted lists. They are merged by merge path: binary searches on the diagonals
of the merge grid cut it into pieces of ``PIECE`` ends each, whatever the texts' lengths.
A piece is merged by itself and emits its overlaps (an A token and a B token with a byte in
common) and the places where both end. A common end on a diagonal is found when the pieces
are put together, and so is the group that runs over it. Common ends cut the tokens into
groups; all A-B pairs of a group are linked.

Spark's part: texts are tokenised in chunks of about ``CHUNK`` bytes. A chunk leaves one row
per document and one with its distinct pairs and in how many of its documents each is
linked. The pairs are summed over the corpus, and go back to each chunk that holds them, so
a pair of every document is moved once per chunk. Per-document sums follow by chunk.

Texts are cut before encoding at spaces where both tokenizers begin a token; the distinct
runs of a chunk are looked up in what the worker remembers. Inside a chunk runs are told
apart by 64 bits of hash and their length.

Null and empty texts, and texts that the joined tokens of A or of B do not give back, have
no tokens: zeros, and the empty word as digest. Rows may repeat and ids be null; each row
is a document of its own. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkernel import blocks, mix64, span_hash

BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
PIECE = 1 << 14
CHUNK = 1 << 20
#: Runs that a worker remembers: two generations of so many, and only those up to so many bytes.
REMEMBER = 250_000
REMEMBERED_BYTES = 64
#: Bytes of new runs that are encoded in one call.
TOGETHER = 1 << 16
#: Links of one group that are listed at once.
AT_ONCE = 1 << 22


def _place(name: str) -> str:
    import public_tokenizers

    return name if os.path.sep in name else public_tokenizers.path(name)


class ByteLevel:
    """A byte-level tokenizer: the bytes of its tokens, and ids of a text that begins with a space."""

    def __init__(self, name: str = BYTE_TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.one = Tokenizer.from_file(_place(name))
        self.one.encode_special_tokens = True
        printable = {*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
        named = (self.one.id_to_token(i) or "" for i in range(self.one.get_vocab_size()))
        self.tokens = [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in named]

    def ids(self, text: str) -> list[int]:
        return self.one.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces:
    """As ``ByteLevel``, for a tokenizer of pieces that itself puts a space before a text."""

    def __init__(self, name: str = PIECE_TOKENIZER):
        import sentencepiece

        self.one = sentencepiece.SentencePieceProcessor(model_file=_place(name))
        named = [self.one.id_to_piece(i) for i in range(self.one.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in named):
            raise ValueError(f"{name} has pieces over a space, so texts cannot be cut before them")
        self.tokens = [bytes([int(x[3:-1], 16)]) if self.one.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(named)]
        self.space = self.one.piece_to_id("▁")

    def ids(self, text: str) -> list[int]:
        return self.one.encode(text[1:]) or [self.space]  # a text of nothing gets no space before it


class Pair:
    """Both tokenizers, and what they gave for the runs seen lately: the number of A's ids, those, and B's ids."""

    def __init__(self, a: str, b: str):
        self.sides = ByteLevel(a), Pieces(b)
        self.sizes = tuple(np.array(list(map(len, x.tokens)), np.int64) for x in self.sides)
        self.size_b = len(self.sides[1].tokens)
        self.width = np.uint16 if max(map(len, self.sizes)) <= 1 << 16 else np.uint32
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def runs(self, keys: list[bytes]) -> list[bytes]:
        """Ids of distinct runs; nothing for a run that one of the tokenizers does not give back."""
        found = list(map(self.young.get, keys))
        new = []
        for i, x in enumerate(found):
            if x is None:
                found[i] = self.old.pop(keys[i], None)
                if found[i] is None:
                    new.append(i)
                elif len(keys[i]) <= REMEMBERED_BYTES:
                    self.young[keys[i]] = found[i]
        for i, x in zip(new, self._encoded([keys[i] for i in new]), strict=True):
            found[i] = x
            if len(keys[i]) <= REMEMBERED_BYTES:
                self.young[keys[i]] = x
        if len(self.young) > REMEMBER:
            self.young, self.old = {}, self.young
        return found

    def _encoded(self, keys: list[bytes]) -> list[bytes]:
        """Runs one after the other are a text whose runs they are, so many are encoded in one call."""
        out: list[bytes] = [b""] * len(keys)
        together, size = [], 0
        for i, key in enumerate(keys):
            if not _closed(key) or _BAR in key:
                out[i] = self._alone(key)
                continue
            together.append(i)
            size += len(key)
            if size >= TOGETHER:
                self._joined(keys, together, out)
                together, size = [], 0
        if together:
            self._joined(keys, together, out)
        return out

    def _joined(self, keys: list[bytes], which: list[int], out: list[bytes]) -> None:
        own = [keys[i] for i in which]
        raw = b"".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
        found, cuts = [], []
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = None
        for side, sizes in zip(self.sides, self.sizes, strict=True) if text is not None else ():
            ids = side.ids(text)
            if b"".join(map(side.tokens.__getitem__, ids)) == raw:
                ids = np.array(ids, self.width)
                at = np.cumsum(sizes[ids])
                last = np.searchsorted(at, ends)
                if (at[last] == ends).all():
                    found.append(ids)
                    cuts.append(np.diff(last + 1, prepend=0))
        if len(found) < 2:
            for i in which:
                out[i] = self._alone(keys[i])
            return
        (a, b), (in_a, in_b) = found, cuts
        head = 4 // np.dtype(self.width).itemsize
        size = head + in_a + in_b
        first = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), self.width)
        flat[_spread(first, np.full(len(own), head))] = in_a.astype("<u4").view(self.width)
        flat[_spread(first + head, in_a)] = a
        flat[_spread(first + head + in_a, in_b)] = b
        packed, wide = flat.tobytes(), flat.itemsize
        for i, x, y in zip(which, (first * wide).tolist(), ((first + size) * wide).tolist(), strict=True):
            out[i] = packed[x:y]

    def _alone(self, key: bytes) -> bytes:
        text = key.decode("utf-8", "replace")
        a, b = (side.ids(text) for side in self.sides)
        if any(b"".join(map(side.tokens.__getitem__, ids)) != key for side, ids in zip(self.sides, (a, b), strict=True)):
            return b""
        return np.array(len(a), np.uint32).tobytes() + np.array(a, self.width).tobytes() + np.array(b, self.width).tobytes()


_OPEN: dict[tuple[str, str], Pair] = {}


def pair(a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER) -> Pair:
    """One per worker process."""
    if (a, b) not in _OPEN:
        _OPEN[a, b] = Pair(a, b)
    return _OPEN[a, b]


#: What stands for a space in pieces; it is not given back.
_BAR = "▁".encode()


def _closed(run: bytes) -> bool:
    """Whether a run ends in what is surely no white space, so that another may follow (see ``_runs``)."""
    return 0x20 < run[-1] < 0x7F or (len(run) > 1 and run[-1] >= 0x80 and 0xC3 <= run[-2] <= 0xDF)


def _runs(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of the runs of a block: its texts' starts, and spaces after what is surely no white space."""
    before = data[:-1]
    graphic = (before > 0x20) & (before < 0x7F)
    pairs = np.zeros(len(before), bool)  # the second byte of a letter of two bytes; U+0085 and U+00A0 begin with C2
    pairs[1:] = (before[1:] >= 0x80) & (before[:-1] >= 0xC3) & (before[:-1] <= 0xDF)
    opens = np.zeros(len(data), bool)
    opens[1:] = (data[1:] == 0x20) & (graphic | pairs)
    opens[at[:-1]] = True
    return np.flatnonzero(opens)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices first[i] .. first[i] + size[i] - 1, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def encoded(data: np.ndarray, at: np.ndarray, both: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A's ids, ends and first tokens of the rows, the same of B, and the rows that are given back.

    Ends are byte places among the texts that have tokens. Every row starts with a space.
    """
    start = _runs(data, at)
    end = np.append(start[1:], len(data))
    key = mix64(span_hash(data, start, end) + (end - start).astype(np.uint64))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    raw = data.tobytes()
    found = both.runs([raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])
    row = np.searchsorted(at, start, side="right") - 1
    fine = np.ones(len(at) - 1, bool)
    fine[np.diff(at) <= 1] = False  # the space alone
    size = np.fromiter(map(len, found), np.int64, len(found))
    fine[row[(size == 0)[which]]] = False
    which, row = which[fine[row]], row[fine[row]]
    wide, head = np.dtype(both.width).itemsize, 4 // np.dtype(both.width).itemsize
    flat = np.frombuffer(b"".join(found), both.width)
    begin = (np.cumsum(size) - size) // wide
    in_a = np.zeros(len(found), np.int64)
    in_a[size > 0] = np.frombuffer(b"".join(x[:4] for x in found), "<u4")
    count = in_a, np.maximum(size // wide - head, 0) - in_a
    out = []
    for side, skip in ((0, 0), (1, in_a)):
        n = count[side][which]
        ids = flat[_spread((begin + head + skip)[which], n)].astype(np.int32)
        ptr = np.searchsorted(np.repeat(row, n), np.arange(len(at)))
        out += [ids, np.cumsum(both.sizes[side][ids]), ptr]
    return (*out, fine)


def diagonals(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of a and of b come before every ``step``-th place of their merge; of equal ends a's is first."""
    d = np.arange(0, len(a) + len(b) + step, step).clip(max=len(a) + len(b))
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (lo < hi).any():
        mid = (lo + hi) // 2
        open_ = lo < hi
        take = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.minimum(np.maximum(d - mid - 1, 0), len(b) - 1)])
        lo = np.where(take, mid + 1, lo)
        hi = np.where(open_ & ~take, mid, hi)
    return lo, d - lo


def merged_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray]:
    """The overlaps that end in one piece, in order of their ends, as rows (a token, b token), and which of them end both."""
    own_a, own_b = a[i0:i1], b[j0:j1]
    j = np.searchsorted(own_b, own_a)
    i = np.searchsorted(own_a, own_b)
    both = np.zeros(len(own_a), bool)
    inside = j < len(own_b)
    both[inside] = own_b[j[inside]] == own_a[inside]
    alone = np.ones(len(own_b), bool)
    alone[j[both]] = False
    if j0 < j1 and i0 and a[i0 - 1] == own_b[0]:
        alone[0] = False  # the piece before has this end, as an end of a
    links = np.concatenate([np.stack([np.arange(i0, i1), j0 + j]), np.stack([i0 + i[alone], (j0 + np.arange(len(own_b)))[alone]])], axis=1)
    order = np.argsort(np.concatenate([own_a, own_b[alone]]), kind="stable")
    return links[:, order], np.concatenate([both, np.zeros(int(alone.sum()), bool)])[order]


def groups(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a and of b before the end of each group, from the pieces' overlaps."""
    found_a, found_b = [], []
    i, j = diagonals(a, b, step)
    for i0, i1, j0, j1 in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist(), strict=True):
        links, ends = merged_piece(a, b, i0, i1, j0, j1)
        last = links[:, ends]
        found_a.append(last[0] + 1)
        found_b.append(last[1] + 1)
        if i1 > i0 and j1 < len(b) and a[i1 - 1] == b[j1]:  # both end on the diagonal: a's here, b's in the next piece
            found_a.append(np.array([i1]))
            found_b.append(np.array([j1 + 1]))
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a).astype(np.int64), np.concatenate(found_b).astype(np.int64)


def _listed(ids_a: np.ndarray, ids_b: np.ndarray, first: tuple[np.ndarray, np.ndarray], size: tuple[np.ndarray, np.ndarray], doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair) of the groups' links, in order, and how often each is there."""
    found = []

    def add(doc: np.ndarray, key: np.ndarray, times: np.ndarray) -> None:
        order = np.lexsort((key, doc))
        doc, key, times = doc[order], key[order], times[order]
        opens = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
        found.append((doc[opens], key[opens], np.add.reduceat(times, opens) if len(opens) else times))

    links = size[0] * size[1]
    large = links > AT_ONCE
    small = np.flatnonzero(~large)
    cut = np.searchsorted(np.cumsum(links[small]), np.arange(AT_ONCE, int(links[small].sum()) + AT_ONCE, AT_ONCE))
    for g in np.split(small, np.unique(cut)):
        n = links[g]
        nth = _spread(np.zeros(len(g), np.int64), n)
        of = np.repeat(g, n)
        a, b = ids_a[first[0][of] + nth // size[1][of]].astype(np.int64), ids_b[first[1][of] + nth % size[1][of]]
        add(doc[of], a * width + b, np.ones(len(of), np.int64))
    for g in np.flatnonzero(large).tolist():  # by the distinct ids of both sides
        a, na = np.unique(ids_a[first[0][g] : first[0][g] + size[0][g]], return_counts=True)
        b, nb = np.unique(ids_b[first[1][g] : first[1][g] + size[1][g]], return_counts=True)
        key = (a.astype(np.int64)[:, None] * width + b).ravel()
        add(np.full(len(key), doc[g]), key, (na[:, None] * nb).ravel())
    if len(found) > 1:
        doc, key, times = map(np.concatenate, zip(*found, strict=True))
        found.clear()
        add(doc, key, times)
    return found[0] if found else (np.zeros(0, np.int64),) * 3


_DIGITS = 10 ** np.arange(9, -1, -1)


def _decimals(top: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 .. top, ten places each, and how many of them count."""
    x = np.arange(top + 1)
    digits = (x[:, None] // _DIGITS % 10 + ord("0")).astype(np.uint8)
    return digits, np.maximum(10 - np.searchsorted(-_DIGITS, -np.maximum(x, 1)), 1)


def _written(ids_a: np.ndarray, ids_b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, decimals: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all groups, and where each group ends in it."""
    digits, places = decimals
    n_a, n_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
    last = np.cumsum(n_a + n_b)
    ids, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    first = last - n_a - n_b
    ids[_spread(first, n_a)] = ids_a
    ids[_spread(first + n_a, n_b)] = ids_b
    mark[first + n_a - 1], mark[last - 1] = ord("|"), ord(";")
    size = places[ids] + 1
    ends = np.cumsum(size)
    out = digits.ravel()[np.minimum(_spread(ids * 10 + 10 - places[ids], size), digits.size - 1)]
    out[ends - 1] = mark
    return out.tobytes(), ends[last - 1]


_ROWS = "chunk long, n_a long, n_b long, n_groups long, n_links long, groups string, pair binary, times binary, keys array<long>, held array<long>"


def aligned(docs: DataFrame, a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER, texts: bool = True) -> DataFrame:
    """Per document its counts, groups (as text, or the digest of it) and its distinct pairs by their place in the
    chunk's list, with how often each is linked; per chunk one row of that list (``keys``) with the documents that
    hold each (``held``)."""

    def chunk(ids: pa.Array, number: int, data: np.ndarray, at: np.ndarray, both: Pair, decimals: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = len(at) - 1
        spaced = np.insert(data, at[:-1], 0x20)
        ia, ea, pa_, ib, eb, pb, fine = encoded(spaced, at + np.arange(n + 1), both)
        ga, gb = groups(ea, eb)
        first = np.concatenate([[0], ga[:-1]]).astype(np.int64), np.concatenate([[0], gb[:-1]]).astype(np.int64)
        size = ga - first[0][: len(ga)], gb - first[1][: len(gb)]
        first = first[0][: len(ga)], first[1][: len(gb)]
        doc = np.searchsorted(pa_, first[0], side="right") - 1
        of, key, times = _listed(ia, ib, first, size, doc, both.size_b)
        keys, nth, held = np.unique(key, return_inverse=True, return_counts=True)
        ptr = np.searchsorted(of, np.arange(n + 1))
        gptr = np.searchsorted(doc, np.arange(n + 1))
        links = np.concatenate([[0], np.cumsum(size[0] * size[1])])
        nth, times = nth.astype("<i4"), times.astype("<i8")
        out, raw, ends = [], *_written(ia, ib, ga, gb, decimals)
        ends = np.append(0, ends)[gptr].tolist()
        for i, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            text = raw[x : max(x, y - 1)]
            out.append(text.decode() if texts or not fine[i] else hashlib.sha256(text).hexdigest())
        cuts = ptr.tolist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
                pa.array(np.full(n + 1, number)),
                *(pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(1, pa.int64())]) for x in (np.diff(pa_), np.diff(pb), np.diff(gptr), np.diff(links[gptr]))),
                pa.array([*out, None], pa.string()),
                pa.array([*(nth[s:e].tobytes() for s, e in zip(cuts, cuts[1:], strict=False)), None], pa.binary()),
                pa.array([*(times[s:e].tobytes() for s, e in zip(cuts, cuts[1:], strict=False)), None], pa.binary()),
                pa.array([*[None] * n, keys.tolist()], pa.list_(pa.int64())),
                pa.array([*[None] * n, held.tolist()], pa.list_(pa.int64())),
            ],
            names=["doc_id", *(x.split()[0] for x in _ROWS.split(", "))],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = pair(a, b), TaskContext.get().partitionId() << 32
        decimals = _decimals(max(map(len, both.sizes)))
        for batch in batches:
            for lo, hi, data, at in blocks(batch.column(1), CHUNK):
                yield from chunk(batch.column(0).slice(lo, hi - lo), number, data, at, both, decimals)
                number += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, {_ROWS}")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """key (A id times ``width`` plus B id), in how many documents it is linked, and whether no key of its A id is in more."""
    counts = rows.filter("keys is not null").select(F.explode(F.arrays_zip("keys", "held")).alias("x")).select("x.keys", "x.held")
    counts = counts.groupBy(F.col("keys").alias("key")).agg(F.sum("held").alias("count"))
    of = Window.partitionBy((F.col("key") - F.col("key") % width))  # at most B's vocabulary
    return counts.withColumn("best", F.col("count") == F.max("count").over(of))


def align(docs: DataFrame, a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``, or its SHA-256 where ``texts`` is false.
    """
    scratch = scratch or Scratch(docs.sparkSession, "alignment")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = scratch.table(aligned(docs, a, b, texts), "rows")
    again = docs.sparkSession.read.schema(rows.schema).parquet(f"{scratch.root}/rows")  # a group takes no two frames of one reading
    counts = scratch.table(pair_counts(rows, len(Pieces(b).tokens)), "counts")
    held = again.filter("keys is not null").select("chunk", F.posexplode("keys").alias("nth", "key"))
    looked = held.join(counts.hint("shuffle_hash"), "key").select("chunk", "nth", "count", "best")
    of = rows.filter("keys is null").drop("keys", "held")

    def summed(_key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        nth = found.column("nth").to_numpy()
        size = int(nth.max()) + 1 if len(nth) else 0
        count, best = np.zeros(size, np.int64), np.zeros(size, bool)
        count[nth], best[nth] = found.column("count").to_numpy(), found.column("best").to_numpy()
        n_best, sums = [], []
        for p, t in zip(own.column("pair").to_pylist(), own.column("times").to_pylist(), strict=True):
            p, t = np.frombuffer(p, "<i4"), np.frombuffer(t, "<i8")
            n_best.append(int(t[best[p]].sum()))
            sums.append(int((t * count[p]).sum()))
        own = own.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])
        return own.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    out = of.groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(summed, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def with_digest(found: DataFrame) -> DataFrame:
    """Of ``align(texts=False)``, whose groups are digests already."""
    return found.withColumnRenamed("groups", "groups_sha256")
