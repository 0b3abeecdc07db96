"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from its own
bytes and words; a gated attention (Ilse et al., 2018), learned from the documents' labels
alone, weighs the passages, and the weighted sum of their encodings gives the score. A few
bad passages in a long document can so decide, without labels for passages.

The network is fitted on at most ``TRAIN_ROWS`` labelled documents; scoring reads every
passage of every text. Null and empty texts are one passage of zeros. Only the text is an
input of a score: other columns, whatever their names, are not read. Rows repeat in the
output as in the input, null ids included; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import HOLD_OUT, fold, training_rows
from .textkernel import SPACE, Tokens, U64, blocks, mix64
from .toxicity import sigmoid

PASSAGE = 48
TRAIN_ROWS = 8_000
HIDDEN = 24
GATE = 12
SIGNS = 12
THRESHOLD = 0.5


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_BYTES = np.stack(
    [
        _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789"), _class(b"#*$%&<>"), _class(b"|"), _class(b".,;:"),
        _class(b"!?"), _class(b"'\"()[]{}"), _class(b"\n"), _class(b"=_/\\@+"), np.arange(256) >= 128,
    ]
)
WIDTH = len(_BYTES) + 8 + SIGNS


def encode(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a block, and the offsets of its rows in them."""
    words = Tokens(data, at)
    count = np.diff(words.ptr)
    passages = np.maximum(-(-count // PASSAGE), 1)
    ptr = np.concatenate([[0], np.cumsum(passages)])
    x = np.zeros((ptr[-1], WIDTH))
    row = np.repeat(np.arange(len(count)), passages)
    nth = np.arange(ptr[-1]) - ptr[row]
    w0 = words.ptr[row] + nth * PASSAGE
    w1 = np.minimum(w0 + PASSAGE, words.ptr[row + 1])
    full = np.flatnonzero(w1 > w0)
    if not len(full):
        return x, ptr
    w0, w1 = w0[full], w1[full]
    b0, b1 = words.start[w0], words.end[w1 - 1]
    n, size = (w1 - w0).astype(float), (b1 - b0).astype(float)

    def summed(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1)
        np.cumsum(values, out=total[1:])
        return total[hi] - total[lo]

    for k, of in enumerate(_BYTES):
        x[full, k] = summed(of[data], b0, b1) / size
    k = len(_BYTES)
    length = (words.end - words.start).astype(float)
    mean = summed(length, w0, w1) / n
    x[full, k] = mean / 10
    x[full, k + 1] = np.sqrt(np.maximum(summed(length**2, w0, w1) / n - mean**2, 0)) / 10
    x[full, k + 2] = n / PASSAGE
    own = np.repeat(np.arange(len(full)), (w1 - w0))
    _, first = np.unique(mix64(words.hash + own.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
    x[full, k + 3] = np.bincount(own[first], minlength=len(full)) / n
    _, first = np.unique(mix64(words.hash + words.row.astype(U64) * U64(0xD6E8FEB86659FD93)), return_index=True)
    new = np.zeros(len(words.hash))
    new[first] = 1
    x[full, k + 4] = summed(new, w0, w1) / n
    ends = ~SPACE[data]
    letters = (_BYTES[0] | _BYTES[1] | _BYTES[10])[data]
    mixed = summed(letters, words.start, words.end) < length
    x[full, k + 5] = summed(mixed, w0, w1) / n
    x[full, k + 6] = summed(length == 1, w0, w1) / n
    x[full, k + 7] = summed(ends, b0, b1) / size
    k += 8
    for s in range(SIGNS):
        x[full, k + s] = summed(((words.hash >> U64(s)) & U64(1)).astype(float) - 0.5, w0, w1) / n
    return x, ptr


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        w, start = self.w, ptr[:-1]
        row = np.repeat(np.arange(len(start)), np.diff(ptr))
        h = np.tanh(x @ w["h"] + w["hb"])
        t, g = np.tanh(h @ w["v"]), sigmoid(h @ w["u"])
        e = (t * g) @ w["a"]
        e = np.exp(e - np.maximum.reduceat(e, start)[row])
        alpha = e / np.add.reduceat(e, start)[row]
        z = np.add.reduceat(alpha[:, None] * h, start)
        return z @ w["c"] + w["cb"][0], {"row": row, "h": h, "t": t, "g": g, "alpha": alpha, "z": z}

    def logits(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for _, _, data, at in blocks(column):
            x, ptr = encode(data, at)
            out.append(self.forward((x - self.mean) / self.scale, ptr)[0])
        return np.concatenate(out)


def _gradients(net: Network, x: np.ndarray, ptr: np.ndarray, label: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    y, s = net.forward(x, ptr)
    w, row = net.w, s["row"]
    d = (sigmoid(y) - label) / len(label)
    dz = d[:, None] * w["c"]
    dh = s["alpha"][:, None] * dz[row]
    dalpha = (s["h"] * dz[row]).sum(axis=1)
    mean = np.add.reduceat(s["alpha"] * dalpha, ptr[:-1])[row]
    de = s["alpha"] * (dalpha - mean)
    dtg = de[:, None] * w["a"]
    dt = dtg * s["g"] * (1 - s["t"] ** 2)
    dg = dtg * s["t"] * s["g"] * (1 - s["g"])
    dh = (dh + dt @ w["v"].T + dg @ w["u"].T) * (1 - s["h"] ** 2)
    out = {"c": s["z"].T @ d, "cb": np.array([d.sum()]), "a": (s["t"] * s["g"]).T @ de, "v": s["h"].T @ dt, "u": s["h"].T @ dg, "h": x.T @ dh, "hb": dh.sum(axis=0)}
    return {k: v + decay * w[k] for k, v in out.items()}


def fit(bags: list[np.ndarray], label: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Adam over shuffled batches of whole documents; the same in every run."""
    rng = np.random.default_rng(11)
    rows = np.concatenate(bags) if bags else np.zeros((1, WIDTH))
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-3
    shape = {"h": (WIDTH, HIDDEN), "hb": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "cb": (1,)}
    net = Network(mean, scale, {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "ac" else np.zeros(s) for k, s in shape.items()})
    if not bags:
        return net
    bags = [(b - mean) / scale for b in bags]
    first, second = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    step = 0
    batches = max(1, len(bags) // batch)
    epochs = max(epochs, -(-400 // batches))
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for part in np.array_split(order, batches):
            ptr = np.concatenate([[0], np.cumsum([len(bags[i]) for i in part])])
            step += 1
            for k, d in _gradients(net, np.concatenate([bags[i] for i in part]), ptr, label[part], decay).items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                net.w[k] = net.w[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def bags_of(train: DataFrame) -> DataFrame:
    """label and the packed features of each training document's passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for _, _, data, at in blocks(b.column(0)):
                x, ptr = encode(data, at)
                packed += [x[p:q].astype("<f4").tobytes() for p, q in zip(ptr[:-1], ptr[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(packed, pa.binary())], names=["label", "bag"])

    return train.mapInArrow(run, "label int, bag binary").distinct()


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Network:
    """A network fitted on the driver to the passages of at most ``most`` labelled documents."""
    rows = bags_of(training_rows(docs, labels, "quality", most)).collect()
    rows.sort(key=lambda r: (r["bag"], r["label"]))
    bags = [np.frombuffer(r["bag"], "<f4").reshape(-1, WIDTH).astype(np.float64) for r in rows]
    return fit(bags, np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(shared.value.logits(b.column(1))))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == HOLD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
