"""Direction models of each ticker and fold, fitted side by side.

Rows of a ticker are one group per ``spread``: a group holds the ticker's rows and fits every
``spread``-th of its fits, one per fold and one over all rows for the newest bar. With many
tickers one group each is parallel enough; with few, folds spread out too. A group is one
ticker's labelled history (some ten thousand bars in forty years), so it is bounded by time,
not by the number of tickers. Searches over parameters put (ticker, recipe) in one fan-out.

Everything that is learned (medians, scales, chosen features, the model) is learned from a
fold's training rows alone. A ticker with fewer than ``LEAST`` labelled rows or a single
label has no model and no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .learning import bounds
from .stats import average_rank_auc, overfitting

C = F.col
LEAST = 80
#: Rows that a fold holds at least before there is another one.
FOLD_ROWS = 120
#: Fold number of the fit over all labelled rows, which scores the newest bar.
FINAL = -1


@dataclass(frozen=True)
class Recipe:
    """``top``: only so many features, by their F statistic; ``contrarian``: the probability of the other side.

    ``penalty`` weighs the squared coefficients of the logistic model against the sum of
    losses. Forest and boosted trees have ``trees`` of ``depth``; the rest is for the latter.
    """

    kind: str = "logistic"
    top: int | None = None
    contrarian: bool = False
    penalty: float = 1.0
    trees: int = 200
    depth: int = 6
    rate: float = 0.04
    rows: float = 0.85
    columns: float = 0.85
    seed: int = 42


LOGISTIC = Recipe()
FOREST = Recipe("forest")
BOOSTED = Recipe("boosted", trees=160, depth=4)


def balance(y: np.ndarray) -> np.ndarray:
    """Weights that give both labels the same total and a mean of one."""
    share = np.array([(y == 0).sum(), (y == 1).sum()])
    return len(y) / (2 * share[y.astype(int)])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, tolerance: float = 1e-8) -> np.ndarray:
    """Intercept and coefficients at the optimum, by Newton steps that are halved until they pay."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 0.0
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return float((weight * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + 0.5 * (ridge * w * w).sum())

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        if np.abs(slope).max() < tolerance * len(x):
            break
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-12)
        step = np.linalg.solve(curve, slope)
        for _ in range(30):
            then = loss(w - step)
            if then <= now:
                break
            step /= 2
        else:
            break
        w, now = w - step, then
    return w


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)


class Tree:
    """A binary tree over binned features, grown level by level from sums of gradients, weights and counts per bin.

    ``columns`` are the features of the whole tree, or a function that draws a row of them for each node of a level.
    """

    def __init__(self, bins: np.ndarray, sums: Sequence[np.ndarray], depth: int, size: int, gain: Callable, allowed: Callable, columns: np.ndarray | Callable[[int], np.ndarray]):
        n, rows = 2**depth - 1, np.arange(len(bins))[:, None]
        self.feature, self.cut = np.zeros(n, int), np.full(n, size)
        node, fixed = np.zeros(len(bins), int), not callable(columns)
        k = len(columns) if fixed else columns(1).shape[1]
        weights, place = [np.repeat(v, k) for v in sums], np.arange(k) * size
        same = bins[:, columns] + place if fixed else None
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            drawn = np.broadcast_to(columns, (width, k)) if fixed else columns(width)
            own = same if fixed else bins[rows, drawn[node]] + place
            at = (own + (node * (k * size))[:, None]).ravel()
            found = [np.bincount(at, w, width * k * size).reshape(width, k, size) for w in weights]
            left = [np.cumsum(x, axis=2) for x in found]
            total = [x[:, :, -1:] for x in left]
            left = [x[:, :, :-1] for x in left]
            right = [t - x for t, x in zip(total, left, strict=True)]
            better = gain(*left[:2]) + gain(*right[:2]) - gain(*total[:2])
            better = np.where(allowed(*left[1:]) & allowed(*right[1:]), better, -np.inf).reshape(width, -1)
            best = better.argmax(axis=1)
            pays = better[np.arange(width), best] > 1e-12
            self.feature[first : first + width] = drawn[np.arange(width), best // (size - 1)]
            self.cut[first : first + width] = np.where(pays, best % (size - 1), size)
            node = 2 * node + self._right(bins, first + node)
        self.leaf, self.leaves = node, 2**depth

    def _right(self, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (bins[np.arange(len(bins)), self.feature[at]] > self.cut[at]).astype(int)

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        node, level = np.zeros(len(bins), int), 0
        while 2**level < self.leaves:
            node = 2 * node + self._right(bins, 2**level - 1 + node)
            level += 1
        return node


def forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, unseen: np.ndarray, r: Recipe, size: int = 64) -> np.ndarray:
    """Mean over trees of the label's weighted share in a leaf: bootstrap rows, the root of the features at each node, leaves of five rows."""
    rng = np.random.default_rng(r.seed)
    cuts = [np.unique(np.quantile(c, np.arange(1, size) / size)) for c in x.T]
    bins, ahead, k = _binned(x, cuts), _binned(unseen, cuts), max(1, int(x.shape[1] ** 0.5))
    out = np.zeros(len(unseen))
    for _ in range(r.trees):
        times = np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x)).astype(float)
        w = weight * times
        draw = lambda width: np.argsort(rng.random((width, x.shape[1])), axis=1)[:, :k]
        tree = Tree(bins, (w * y, w, times), r.depth, size, lambda g, h: np.where(h > 0, g * g / np.maximum(h, 1e-12), 0.0), lambda h, n: n >= 5, draw)
        share = np.bincount(tree.leaf, w * y, tree.leaves) / np.maximum(np.bincount(tree.leaf, w, tree.leaves), 1e-12)
        out += share[tree.leaf_of(ahead)]
    return out / r.trees


def boosted(x: np.ndarray, y: np.ndarray, unseen: np.ndarray, r: Recipe, size: int = 32, ridge: float = 1.5, lasso: float = 0.05, least: float = 3.0) -> np.ndarray:
    """Second-order boosting of the log loss with sampled rows and features per tree."""
    rng = np.random.default_rng(r.seed)
    cuts = [np.unique(np.quantile(c, np.arange(1, size) / size)) for c in x.T]
    bins, ahead = _binned(x, cuts), _binned(unseen, cuts)
    k = max(1, round(r.columns * x.shape[1]))
    shrunk = lambda g: np.sign(g) * np.maximum(np.abs(g) - lasso, 0.0)
    margin, out = np.zeros(len(x)), np.zeros(len(unseen))
    for _ in range(r.trees):
        p = 1 / (1 + np.exp(-margin))
        used = np.flatnonzero(rng.random(len(x)) < r.rows)
        g, h = (p - y)[used], (p * (1 - p))[used]
        own = np.sort(rng.permutation(x.shape[1])[:k])
        tree = Tree(bins[used], (g, h), r.depth, size, lambda g, h: shrunk(g) ** 2 / (h + ridge), lambda h: h >= least, own)
        leaf = -r.rate * shrunk(np.bincount(tree.leaf, g, tree.leaves)) / (np.bincount(tree.leaf, h, tree.leaves) + ridge)
        margin += leaf[tree.leaf_of(bins)]
        out += leaf[tree.leaf_of(ahead)]
    return 1 / (1 + np.exp(-out))


class Fit:
    """One fit on training rows; ``missing`` values count as the feature's median there."""

    def __init__(self, x: np.ndarray, y: np.ndarray, r: Recipe):
        x = np.where(np.isfinite(x), x, np.nan)
        known = ~np.isnan(x).all(axis=0)
        self.median = np.zeros(x.shape[1])
        self.median[known] = np.nanmedian(x[:, known], axis=0)
        self.r, self.y = r, y
        x = self._filled(x)
        self.mean, apart = x.mean(axis=0), x.std(axis=0)
        self.apart = np.where(apart > 0, apart, 1.0)
        self.columns = np.arange(x.shape[1]) if r.top is None else self._best(x, y, r.top)
        self.x = ((x - self.mean) / self.apart)[:, self.columns]
        self.w = logistic(self.x, y, balance(y), r.penalty) if r.kind == "logistic" and 0 < y.mean() < 1 else None

    def _filled(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(x), x, self.median)

    @staticmethod
    def _best(x: np.ndarray, y: np.ndarray, top: int) -> np.ndarray:
        """Columns of the highest F statistic between the labels, in the features' order."""
        a, b = x[y == 0], x[y == 1]
        if not len(a) or not len(b):
            return np.arange(min(top, x.shape[1]))
        between = (a.mean(axis=0) - b.mean(axis=0)) ** 2
        within = a.var(axis=0) * len(a) + b.var(axis=0) * len(b)
        score = np.where(within > 0, between / np.where(within > 0, within, 1.0), 0.0)
        return np.sort(np.argsort(-score, kind="stable")[:top])

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = ((self._filled(x) - self.mean) / self.apart)[:, self.columns]
        if not 0 < self.y.mean() < 1:
            p = np.full(len(x), self.y.mean())  # one label only
        elif self.w is not None:
            p = 1 / (1 + np.exp(-(self.w[0] + x @ self.w[1:])))
        elif self.r.kind == "forest":
            p = forest(self.x, self.y, balance(self.y), x, self.r)
        elif self.r.kind == "boosted":
            p = boosted(self.x, self.y, x, self.r)
        else:
            raise ValueError(f"unknown kind {self.r.kind}")
        return 1 - p if self.r.contrarian else p


def fold_roles(n: int, horizon: int, splits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training and test positions of each purged fold of n rows; labels end ``horizon`` rows later."""
    k = min(splits, max(2, n // FOLD_ROWS))
    embargo = int(n * min(max(horizon / max(n, 1), 0.01), 0.10))
    pos, out = np.arange(n), []
    end = np.minimum(pos + horizon, n - 1)
    for lo, hi in bounds(n, k):
        meets = (pos <= end[hi - 1]) & (end >= lo)
        out.append((pos[~meets & ~((pos >= hi) & (pos < hi + embargo))], pos[lo:hi]))
    return out


def _histories(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return rows.select("ticker", "date", C("label").cast("double").alias("label"), F.array(*(C(c).cast("double") for c in features)).alias("x"))


def _matrix(table: pa.Table, width: int) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray]:
    """Dates, labels and features of one group by date; null features are not a number."""
    table = table.sort_by("date").combine_chunks()
    x = table.column("x").combine_chunks() if isinstance(table.column("x"), pa.ChunkedArray) else table.column("x")
    return table.column("date"), table.column("label").to_numpy(), x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), width)


_SCORED = "recipe int, fold int, date {date}, label double, prob double"


def probabilities(rows: DataFrame, features: Sequence[str], horizon: int, splits: int = 5, recipes: Sequence[Recipe] = (LOGISTIC,), spread: int = 1, final: bool = True) -> DataFrame:
    """Of (ticker, date, label, features): ticker, recipe (its place in the list), fold, date, label, prob.

    Every labelled row is tested once per recipe, by the fit of its fold. Fold ``FINAL`` holds
    the newest row of the ticker, labelled or not, scored by the fit over all labelled rows.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(len(recipes) * spread - 1))).alias("part")
    kinds = {k: rows.schema[k].dataType.simpleString() for k in ("ticker", "date")}

    def fits(key: tuple, table: pa.Table) -> pa.Table:
        part = key[1].as_py()
        recipe = recipes[part // spread]
        dates, label, x = _matrix(table, len(features))
        known = np.flatnonzero(~np.isnan(label))
        y, own = label[known], x[known]
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(known) >= LEAST and 0 < y.mean() < 1:
            jobs = [(fold, train, known[test]) for fold, (train, test) in enumerate(fold_roles(len(known), horizon, splits))]
            if final:
                jobs.append((FINAL, np.arange(len(known)), np.array([len(label) - 1])))
            for fold, train, test in jobs[part % spread :: spread]:
                out.append((fold, test, Fit(own[train], y[train], recipe).probability(x[test])))
        at = np.concatenate([np.zeros(0, int), *(t for _, t, _ in out)])
        return pa.table(
            {
                "ticker": pa.array([key[0].as_py()] * len(at), table.schema.field("ticker").type),
                "recipe": pa.array(np.full(len(at), part // spread, np.int32)),
                "fold": pa.array(np.concatenate([np.zeros(0), *(np.full(len(t), f) for f, t, _ in out)]).astype(np.int32)),
                "date": dates.take(pa.array(at)),
                "label": pa.array(label[at], from_pandas=True),
                "prob": pa.array(np.concatenate([np.zeros(0), *(p for _, _, p in out)])),
            }
        )

    many = _histories(rows, features).select("*", parts)
    return many.groupBy("ticker", "part").applyInArrow(fits, f"ticker {kinds['ticker']}, {_SCORED.format(date=kinds['date'])}")


def fold_quality(scored: DataFrame) -> DataFrame:
    """Per ticker, recipe and fold: n, brier, accuracy and AUC, which is 0.5 where a fold has one label."""
    quality = average_rank_auc(scored.filter(C("fold") != FINAL), ["ticker", "recipe", "fold"])
    return quality.withColumn("auc", F.coalesce("auc", F.lit(0.5)))


def evidence(scored: DataFrame, rows: DataFrame) -> DataFrame:
    """Per ticker the means over folds of accuracy and AUC, the share of labelled rows tested, the share of folds below an AUC of one half
    as overfitting, and the newest probability."""
    folds = fold_quality(scored)
    quality = folds.groupBy("ticker").agg(F.avg("accuracy").alias("accuracy"), F.avg("auc").alias("auc"), F.sum("n").alias("n"))
    proxy = overfitting(folds.withColumn("edge", C("auc") - 0.5), ["ticker"], "edge").select("ticker", C("pbo").alias("proxy_pbo"))
    counts = rows.filter("label is not null").groupBy("ticker").agg(F.count(F.lit(1)).alias("labelled"))
    newest = scored.filter(C("fold") == FINAL).select("ticker", "prob")
    out = quality.join(counts, "ticker").join(proxy, "ticker", "left").join(newest, "ticker", "left")
    return out.select("ticker", "accuracy", "auc", (C("n") / C("labelled")).alias("oof_coverage"), "proxy_pbo", "prob")


def importances(rows: DataFrame, features: Sequence[str], top: int = 20, recipe: Recipe = LOGISTIC) -> DataFrame:
    """Per ticker the features of largest absolute coefficient in the logistic fit over all labelled rows; ties by the features' order."""
    kind, names = rows.schema["ticker"].dataType.simpleString(), list(features)

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        _, label, x = _matrix(table, len(names))
        known = ~np.isnan(label)
        best, size = np.zeros(0, int), np.zeros(0)
        if known.sum() >= LEAST and 0 < label[known].mean() < 1:
            made = Fit(x[known], label[known], recipe)
            size = np.abs(made.w[1:])
            best = np.argsort(-size, kind="stable")[:top]
            size, best = size[best], made.columns[best]
        return pa.table({"ticker": pa.array([key[0].as_py()] * len(best), table.schema.field("ticker").type), "feature": pa.array([names[i] for i in best], pa.string()), "value": pa.array(size), "nth": pa.array(np.arange(1, len(best) + 1, dtype=np.int32))})

    return _histories(rows, features).groupBy("ticker").applyInArrow(fit, f"ticker {kind}, feature string, value double, nth int")


def search(rows: DataFrame, features: Sequence[str], horizon: int, recipes: Sequence[Recipe], blend: float = 0.5, splits: int = 5) -> DataFrame:
    """Per recipe the mean over tickers and folds of Brier score and 1 - AUC, blended, and its place; every (ticker, recipe) is a fit group of its own."""
    folds = fold_quality(probabilities(rows, features, horizon, splits, recipes, final=False))
    score = folds.groupBy("recipe").agg(F.avg("brier").alias("brier"), F.avg(1 - C("auc")).alias("miss"), F.count(F.lit(1)).alias("folds"))
    score = score.withColumn("objective", blend * C("brier") + (1 - blend) * C("miss")).drop("miss")
    return score.withColumn("place", F.row_number().over(Window.orderBy("objective", "recipe")))  # one row per recipe


def penalties(values: Sequence[float], base: Recipe = LOGISTIC) -> Iterator[Recipe]:
    """The recipe with each of the penalties."""
    return (replace(base, penalty=v) for v in values)
