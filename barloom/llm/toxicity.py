"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms (runs of ASCII letters, digits and non-ASCII bytes,
A-Z lower-cased), hashed into ``2 ** BITS`` buckets. A factorization machine (Rendle, 2010)
learns a weight for each bucket and a vector for each whose products weigh pairs, so a pair
can mark a text though neither of its terms does.

All buckets that at least two training documents hold are fitted, none is screened. Weights
have normal priors whose variances come from the data (empirical Bayes): wide where a bucket
goes with the label beyond chance, narrow elsewhere. Vectors are fitted to what the weights
leave; those that the data do not tell from zero (Wald statistic of their information) are
set to zero, and weights and the vectors left are fitted together once more. A vector
without another one has no pair, so at least two must be left; and the machine with vectors
is taken only if, fitted to the other training documents, it foresees a third of them that
it has not seen better (by likelihood) than the weights alone, which it is therefore never
worse than by more than chance. ``Machine.living`` tells how many vectors there are.

The model is fitted on at most ``TRAIN_ROWS`` labelled documents; scoring reads every
whole text. Null and empty texts have no terms and get the score of the bias. Only
the text is an input of a score: other columns, whatever their names, are not read. Rows
repeat in the output as in the input, null ids included; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import HOLD_OUT, fold, training_rows
from .textkernel import NON_TERM, Tokens, U64, blocks

BITS = 20
TRAIN_ROWS = 20_000
FACTORS = 4
THRESHOLD = 0.7


def term_buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Tokens(data, at, NON_TERM, lower=True)
    return (words.hash >> U64(64 - BITS)).astype(np.int64), words.ptr


@dataclass(frozen=True)
class Machine:
    bias: float
    weight: np.ndarray  # per bucket
    slot: np.ndarray  # per bucket: its vector, or -1
    factor: np.ndarray

    @property
    def living(self) -> int:
        return len(self.factor)

    def logits(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi, data, at in blocks(column):
            bucket, ptr = term_buckets(data, at)
            row = np.repeat(np.arange(hi - lo), np.diff(ptr))
            row, bucket = np.divmod(np.unique((row << BITS) | bucket), 1 << BITS)
            out.append(self.of(row, bucket, hi - lo))
        return np.concatenate(out)

    def of(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        y = self.bias + np.bincount(row, self.weight[bucket], minlength=n)
        slot = self.slot[bucket]
        row, slot = row[slot >= 0], slot[slot >= 0]
        for v in self.factor.T:
            y += 0.5 * (np.bincount(row, v[slot], minlength=n) ** 2 - np.bincount(row, v[slot] ** 2, minlength=n))
        return y


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def distinct_buckets(train: DataFrame) -> DataFrame:
    """label and the distinct buckets of each training document, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for _, _, data, at in blocks(b.column(0)):
                bucket, ptr = term_buckets(data, at)
                packed += [np.unique(bucket[p:q]).astype("<i4").tobytes() for p, q in zip(ptr[:-1], ptr[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(packed, pa.binary())], names=["label", "buckets"])

    return train.mapInArrow(run, "label int, buckets binary").distinct()


@dataclass(frozen=True)
class Fitting:
    """Priors' variances (least and most of a weight, of a vector's numbers), steps and rates of
    both parts, documents in a step, and the Wald statistic that keeps a vector.

    ``still`` is the size of a gradient below which a vector's steps shrink with it, so that
    vectors stay put where the weights explain the labels.
    """

    least: float = 1e-4
    most: float = 30.0
    vectors: float = 0.03
    weight_steps: int = 500
    vector_steps: int = 200
    weight_rate: float = 0.1
    vector_rate: float = 0.05
    batch: int = 256
    still: float = 1e-3
    wald: float = 9.0
    seed: int = 7


class _Adam:
    """Adam with the prior as a decoupled shrinkage in the same metric."""

    def __init__(self, shape: int | tuple[int, ...], still: float = 1e-8):
        self.first, self.second = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
        self.still, self.step = still, 0

    def __call__(self, theta: np.ndarray, gradient: np.ndarray, rate: float, prior: np.ndarray | float) -> None:
        self.step += 1
        self.first += 0.1 * (gradient - self.first)
        self.second += 0.01 * (gradient * gradient - self.second)
        size = rate / (np.sqrt(self.second / (1 - 0.99**self.step)) + self.still)
        theta -= size * (self.first / (1 - 0.9**self.step))
        theta /= 1 + size * prior


@dataclass(frozen=True)
class _Batch:
    """Some training documents: their rows, features by document from ``ptr`` on, and by feature."""

    rows: np.ndarray
    feature: np.ndarray
    ptr: np.ndarray
    holder: np.ndarray  # document (place in rows) of each feature, ordered by feature
    own: np.ndarray  # the features held
    cut: np.ndarray

    def sums(self, theta: np.ndarray) -> np.ndarray:
        return np.add.reduceat(theta[self.feature], self.ptr)

    def by_feature(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.holder], self.cut)


def _batches(row: np.ndarray, feature: np.ndarray, n: int, size: int, rng: np.random.Generator) -> list[_Batch]:
    count = np.bincount(row, minlength=n)
    begin, out = np.cumsum(count) - count, []
    for part in np.array_split(rng.permutation(n), max(1, round(n / size))):
        rows = part[count[part] > 0]
        if len(rows):
            k = count[rows]
            f = feature[np.repeat(begin[rows] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            order = np.argsort(f, kind="stable")
            own, cut = np.unique(f[order], return_index=True)
            out.append(_Batch(rows, f, np.cumsum(k) - k, np.repeat(np.arange(len(rows)), k)[order], own, cut))
    return out


def _prior(row: np.ndarray, feature: np.ndarray, label: np.ndarray, how: Fitting) -> np.ndarray:
    """Variance of each weight: what its score has beyond chance, over its information.

    Chance is the label's rate among documents of about as many terms.
    """
    size = np.bincount(row, minlength=len(label))
    band = np.floor(2 * np.log2(size + 1)).astype(int)
    rate = ((np.bincount(band, label) + label.mean()) / (np.bincount(band) + 1))[band]
    score = np.abs(np.bincount(feature, (label - rate)[row]))
    information = np.bincount(feature, (rate * (1 - rate))[row]) + 1e-9
    beyond = np.maximum(score - 2 * np.sqrt(information) - 2, 0)
    return np.clip((beyond / information) ** 2, how.least, how.most)


def fit(label: np.ndarray, packed: list[bytes], how: Fitting = Fitting()) -> Machine:
    """The machine, with vectors if they pay on documents that a fit has not seen; else the weights alone."""
    label = np.asarray(label, float)
    made = _fitted(label, packed, how)
    if not made.living:
        return made
    alone = replace(how, wald=float("inf"))
    part = np.random.default_rng(how.seed).permutation(len(label)) % 3
    seen, rest = np.flatnonzero(part), np.flatnonzero(part == 0)
    known, unseen = [packed[i] for i in seen], [packed[i] for i in rest]
    with_vectors, without = (_likelihood(_fitted(label[seen], known, way), label[rest], unseen) for way in (how, alone))
    return made if with_vectors > without else _fitted(label, packed, alone)


def _likelihood(machine: Machine, label: np.ndarray, packed: list[bytes]) -> float:
    """Log likelihood of the labels."""
    row = np.repeat(np.arange(len(packed)), [len(x) // 4 for x in packed])
    y = machine.of(row, np.concatenate([np.zeros(0, "<i4"), *(np.frombuffer(x, "<i4") for x in packed)]).astype(np.int64), len(packed))
    return float((label * y - np.logaddexp(0, y)).sum())


def _fitted(label: np.ndarray, packed: list[bytes], how: Fitting) -> Machine:
    weight, slot = np.zeros(1 << BITS, np.float32), np.full(1 << BITS, -1, np.int32)
    n, rng = len(label), np.random.default_rng(how.seed)
    share = np.clip(label.mean(), 0.01, 0.99) if n else 0.5
    bias = np.array([np.log(share / (1 - share))], np.float32)
    nothing = Machine(float(bias[0]), weight, slot, np.zeros((0, FACTORS)))
    if not n:
        return nothing
    row = np.repeat(np.arange(n), [len(x) // 4 for x in packed])
    seen, feature, count = np.unique(np.concatenate([np.frombuffer(x, "<i4") for x in packed]), return_inverse=True, return_counts=True)
    twice = count > 1
    row, feature, seen = row[twice[feature]], (np.cumsum(twice) - 1)[feature[twice[feature]]], seen[twice]
    m = len(seen)
    if not m:
        return nothing
    variance = _prior(row, feature, label, how)
    batches = _batches(row, feature, n, how.batch, rng)

    def residuals(b: _Batch, y: np.ndarray) -> np.ndarray:
        return ((sigmoid(bias[0] + y) - label[b.rows]) / len(b.rows)).astype(np.float32)

    def passes(steps: int, rate: float, falling: bool) -> Iterator[tuple[_Batch, float]]:
        rounds = max(1, -(-steps // len(batches)))
        for k in range(rounds):
            for i in rng.permutation(len(batches)):
                yield batches[i], rate * (0.5 * (1 + np.cos(np.pi * k / rounds)) if falling else 1.0)

    theta = np.zeros((m, 1 + FACTORS), np.float32)
    w, narrow = np.zeros(m, np.float32), (1 / variance / n).astype(np.float32)
    move, move_bias = _Adam(m), _Adam(1)
    for b, rate in passes(how.weight_steps, how.weight_rate, True):
        g = residuals(b, b.sums(w))
        d = np.zeros(m, np.float32)
        d[b.own] = b.by_feature(g)
        move(w, d, rate, narrow)
        move_bias(bias, g.sum(keepdims=True), rate, 0.0)
    if how.wald == float("inf"):  # no vector would be left
        weight[seen] = w
        return Machine(float(bias[0]), weight, slot, np.zeros((0, FACTORS)))
    theta[:, 0] = w
    theta[:, 1:] = rng.normal(0, 0.02, (m, FACTORS))
    wide = np.full((m, FACTORS), 1 / how.vectors / n, np.float32)

    def pairs(b: _Batch) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the weights and vectors of each document, and the machine's value."""
        s = b.sums(theta)
        square = np.add.reduceat(theta[b.feature, 1:] ** 2, b.ptr)
        return s, s[:, 0] + 0.5 * (s[:, 1:] ** 2 - square).sum(axis=1)

    def gradient(b: _Batch) -> tuple[np.ndarray, np.ndarray]:
        s, y = pairs(b)
        g = residuals(b, y)
        own = b.by_feature(np.concatenate([g[:, None], g[:, None] * s[:, 1:]], axis=1))
        own[:, 1:] -= theta[b.own, 1:] * own[:, :1]
        d = np.zeros_like(theta)
        d[b.own] = own
        return g, d

    move, vectors = _Adam((m, FACTORS), how.still), theta[:, 1:]
    for b, rate in passes(how.vector_steps, how.vector_rate, False):
        move(vectors, gradient(b)[1][:, 1:], rate, wide)
    information = np.zeros((m, FACTORS))
    for b in batches:
        s, y = pairs(b)
        p = sigmoid(bias[0] + y)
        information[b.own] += b.by_feature((p * (1 - p))[:, None] * s[:, 1:] ** 2)
    kept = (vectors**2 * information).sum(axis=1) > how.wald
    kept &= kept.sum() > 1
    vectors[~kept] = 0
    if kept.any():
        narrow[kept] = 1 / how.most / n
        prior = np.concatenate([narrow[:, None], wide], axis=1)
        move, move_bias = _Adam(theta.shape), _Adam(1)
        for b, rate in passes(how.vector_steps, how.vector_rate, True):
            g, d = gradient(b)
            d[~kept, 1:] = 0
            move(theta, d, rate, prior)
            move_bias(bias, g.sum(keepdims=True), rate, 0.0)
    weight[seen], slot[seen[kept]] = theta[:, 0], np.arange(kept.sum())
    return Machine(float(bias[0]), weight, slot, theta[kept, 1:].astype(float))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, how: Fitting = Fitting()) -> Machine:
    """A machine fitted on the driver to the buckets of at most ``most`` labelled documents."""
    rows = distinct_buckets(training_rows(docs, labels, "toxic", most)).collect()
    rows.sort(key=lambda r: (r["buckets"], r["label"]))
    return fit(np.array([r["label"] for r in rows]), [bytes(r["buckets"]) for r in rows], how)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(shared.value.logits(b.column(1))))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == HOLD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
