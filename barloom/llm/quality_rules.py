"""Quality rules by compression bands.

zstandard ratios (bytes of text over bytes compressed) of the whole text and of fixed
chunks must lie in a band that depends on their length: repetitive text compresses too
well, noise too badly. Counts of words, symbols, repeated lines and repeated five-word
windows come with them and have fixed limits of their own.

Null text counts as empty: no words, so it fails the base rule. Rows repeat in the output
as in the input; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import NEWLINE, SPACE, Tokens, U64, blocks, mix64, per_row

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """Limits by length in bytes: (length below which the row holds, least ratio, most ratio).

    Ratios grow with length, as a longer text repeats its own words more often. The limits
    come from the texts labelled quality 1 in testdata/sf0.1 and their chunks: the least
    ratio is about halfway (geometric mean) from the highest of random printable or base64
    noise to the lowest clean one, the most ratio 1.35 times the highest clean one. No clean
    text there is over 64 KiB, so the last row carries on the one before it. Below the first
    bound clean text and noise compress alike (mostly the compressor's header): no limits.

    Chunks of ``chunk_bytes`` and the rest after them have the limits of their own length. A
    text also fails if more than ``bad_share`` of its bytes, and more than one chunk, lie in
    chunks outside theirs: one odd chunk (a table, a listing) is let pass. None of the 3,330
    texts mentioned has such a chunk. ``fitted`` measures bands on another clean sample.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, float("inf")),
        (192, 1.06, 2.35),
        (256, 1.16, 2.35),
        (512, 1.27, 2.5),
        (1_024, 1.37, 2.65),
        (2_048, 1.51, 2.9),
        (4_096, 1.6, 3.0),
        (8_192, 1.67, 3.15),
        (65_536, 1.73, 3.35),
        (float("inf"), 1.78, 3.75),
    )
    chunk_bytes: int = 1_024
    bad_share: float = 0.1
    level: int = 3


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeats(tokens: Tokens, k: int) -> np.ndarray:
    """Per row, the words inside windows of k words that the row holds at least twice."""
    first = tokens.windows(k)
    row = tokens.row[first] if len(first) else first
    h = mix64(tokens.run_hash(first, first + k) + row.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, where, count = np.unique(h, return_inverse=True, return_counts=True)
    twice = first[count[where] > 1]
    edge = np.zeros(len(tokens.start) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + k, -1)
    return per_row(np.cumsum(edge[:-1]) > 0, tokens.ptr)


def repeated_lines(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    lines = Tokens(data, at, NEWLINE)
    wordy = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=wordy[1:])
    has_word = wordy[lines.end] > wordy[lines.start]
    row = lines.row
    h = mix64(lines.hash + row.astype(U64) * U64(0x9E3779B97F4A7C15))[has_word]
    row = row[has_word]
    _, first = np.unique(h, return_index=True)
    n = len(at) - 1
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


def in_bands(raw: bytes, bands: Bands, zip_: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Whole ratio, share of bytes in chunks outside their band, verdict."""

    def judged(part: bytes) -> tuple[float, bool]:
        least, most = next((lo, hi) for below, lo, hi in bands.whole if len(part) < below)
        ratio = len(part) / len(zip_.compress(part))
        return ratio, least <= ratio <= most

    n, size = len(raw), bands.chunk_bytes
    ratio, fine = judged(raw)
    chunks = [raw[i : i + size] for i in range(0, n, size)] if n > size else []
    bad = sum(len(c) for c in chunks if not judged(c)[1])
    return ratio, bad / n if chunks else 0.0, fine and bad <= max(size, bands.bad_share * n)


def measure(column: pa.Array, bands: Bands = Bands()) -> dict[str, np.ndarray]:
    """All measures and verdicts of a text column."""
    zip_ = zstandard.ZstdCompressor(level=bands.level)
    parts: dict[str, list] = {k: [] for k in (*MEASURES, "ratio", "bad_chunks", "in_bands")}
    for _, _, data, at in blocks(column):
        words = Tokens(data, at)
        lead = (data & 0xC0) != 0x80
        parts["n_words"].append(np.diff(words.ptr))
        parts["word_chars"].append(per_row(lead & ~SPACE[data], at))
        parts["n_symbols"].append(per_row(_SYMBOL[data], at))
        parts["n_dup_lines"].append(repeated_lines(data, at))
        parts["n_repeat_words"].append(repeats(words, 5))
        raw = data.tobytes()
        got = [in_bands(raw[a:b], bands, zip_) for a, b in zip(at[:-1], at[1:], strict=True)]
        for k, v in zip(("ratio", "bad_chunks", "in_bands"), zip(*got, strict=True), strict=True):
            parts[k].append(np.array(v))
    kinds = {"ratio": np.float64, "bad_chunks": np.float64, "in_bands": bool}
    out = {k: np.concatenate(v) if v else np.zeros(0, kinds.get(k, np.int64)) for k, v in parts.items()}
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    out["kept"] = ~out["base_failed"] & out["in_bands"]
    return out


def fitted(clean: DataFrame, noise: Bands = Bands(), below: float = 0.75, above: float = 1.35, text_col: str = "text") -> Bands:
    """Bands of a clean sample: per length class from ``below`` times its least ratio, of texts and of chunks, to ``above`` times its
    highest, counted over all of it. Classes and chunks are those of ``noise``, whose limits stay where the sample has nothing."""
    size, tops = noise.chunk_bytes, np.array([b for b, _, _ in noise.whole])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=noise.level)
        for b in batches:
            seen: dict[int, tuple[float, float]] = {}
            for text in b.column(0).to_pylist():
                raw = (text or "").encode()
                for part in [raw, *(raw[i : i + size] for i in range(0, len(raw), size) if len(raw) > size)]:
                    if part:
                        k, r = int(np.searchsorted(tops, len(part), side="right")), len(part) / len(zip_.compress(part))
                        lo, hi = seen.get(k, (r, r))
                        seen[k] = min(lo, r), max(hi, r)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), *(pa.array([v[i] for v in seen.values()], pa.float64()) for i in (0, 1))], names=["k", "lo", "hi"])

    found = clean.select(text_col).mapInArrow(run, "k int, lo double, hi double").groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    own = {r["k"]: (below * r["lo"], above * r["hi"]) for r in found.collect()}  # a row per class
    limits = [(b, lo, hi) if k not in own or hi == float("inf") else (b, *own[k]) for k, (b, lo, hi) in enumerate(noise.whole)]
    return replace(noise, whole=tuple(limits))


_OUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " ratio double, bad_chunks double, base_failed boolean, kept boolean"
)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per input row: its id, the measures and ``base_failed`` and ``kept``."""
    names = [x.split()[0] for x in _OUT.split(",")]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(b.column(1), bands)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[k]) for k in names)], names=["doc_id", *names])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"doc_id {kind}, {_OUT}")


def keep_good(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The input rows, all columns as they are, whose text the rules keep."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(measure(b.column(at), bands)["kept"]))

    return docs.mapInArrow(run, docs.schema)
