"""Isolation forest as a Spark job: bounded samples, trees per task, scores per slice.

Every tree samples all rows: a row is drawn for a tree by a hash, with a chance that
follows from the number of rows, so some one and a half times the sample leaves the tasks.
Nothing here holds more than one tree's sample, one model, or one slice of the scored rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.functions.skew import lookup_join
from opsweave.session import materialise

MAX_SAMPLES = 256
TREE_BATCHES = 8
TREE_SCHEMA = "tree int, sample int, feature array<int>, threshold array<double>, left array<int>, right array<int>, size array<int>"


def _path_correction(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    value = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, value))


def tree_samples(train: DataFrame, keys: Sequence[str], row_id: str, trees: int, seed: int, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """Rows for each tree: (keys, tree, _n, _draw, vector), ``max_samples`` rows per tree, or all there are.

    A tree takes the rows with the lowest hashes of (id, seed, tree).  Rows above a bound
    that leaves half as many again are dropped before the shuffle; that fewer than
    ``max_samples`` remain is next to impossible, and makes the tree's sample smaller.
    """
    sizes = materialise(train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    ident = F.col(row_id).cast("string")
    known = lookup_join(train.select(*keys, ident.alias("_id"), "vector"), sizes, keys, ["_id"])
    bound = F.lit(max_samples + 8.0 * math.sqrt(max_samples)) / F.col("_n")

    def drawn(tree: Column) -> Column:
        return F.pmod(F.xxhash64(F.col("_id"), F.lit(seed), tree), F.lit(1 << 40)) / float(1 << 40)

    spread = known.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: drawn(t) < bound)))
    lowest = Window.partitionBy(*keys, "tree").orderBy(drawn(F.col("tree")), "_id")
    return spread.withColumn("_rn", F.row_number().over(lowest)).where(F.col("_rn") <= max_samples).select(*keys, "tree", "_n", drawn(F.col("tree")).alias("_draw"), "vector")


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit words; equal input, equal output on every machine."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(seed: int, *parts: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the seed and the parts only."""
    with np.errstate(over="ignore"):
        h = _mixed(np.asarray(seed, "u8") + np.uint64(0x9E3779B97F4A7C15))
        for part in parts:
            h = _mixed(h * np.uint64(31) + np.asarray(part).astype("u8") + np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(11)) * 2.0**-53


@dataclass(frozen=True)
class ForestSettings:
    """``max_features`` is the share of features each tree may split on, at least one."""

    trees: int = 100
    max_samples: int = MAX_SAMPLES
    max_features: float = 1.0
    bootstrap: bool = False
    seed: int = 42

    def __post_init__(self) -> None:
        if self.trees < 1 or self.max_samples < 1 or not 0 < self.max_features <= 1:
            raise ValueError("trees and max_samples must be positive, max_features in (0, 1]")


@dataclass
class Heaps:
    """Trees as rows of heap arrays: the children of node i are 2i + 1 and 2i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    size: np.ndarray

    def depths(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows): steps to the leaf plus the mean depth that its rows would add."""
        node = np.zeros((len(self.feature), len(x)), "i8")
        depth = np.zeros(node.shape)
        column = np.arange(len(x))[None, :]
        while True:
            f = np.take_along_axis(self.feature, node, 1)
            inner = f >= 0
            if not inner.any():
                break
            right = x[column, np.where(inner, f, 0)] > np.take_along_axis(self.threshold, node, 1)
            node = np.where(inner, 2 * node + 1 + right, node)
            depth += inner
        return depth + _path_correction(np.take_along_axis(self.size, node, 1))

    def put(self, which: np.ndarray, other: Heaps) -> None:
        for name in ("feature", "threshold", "size"):
            getattr(self, name)[which] = getattr(other, name)


def grow_trees(x: np.ndarray, trees: np.ndarray, settings: ForestSettings) -> Heaps:
    """Trees over ``x`` (trees, sample, features), all of them a level at a time.

    The feature and the cut of a node come from (seed, tree, node), so a tree depends on
    its number and its sample only, in whatever order or company it is grown.
    """
    b, m, p = x.shape
    limit = max(1, math.ceil(math.log2(max(m, 2))))
    nodes = (1 << (limit + 1)) - 1
    feature, threshold, size = np.full((b, nodes), -1, "i4"), np.zeros((b, nodes)), np.zeros((b, nodes), "i4")
    allowed = np.ones((b, p), bool)
    use = max(1, int(settings.max_features * p))
    if use < p:
        draw = uniform(settings.seed, trees[:, None], -1 - np.arange(p)[None, :])
        allowed = draw.argsort(axis=1).argsort(axis=1) < use
    at = np.repeat(np.arange(b) * nodes, m)
    values = x.reshape(-1, p)
    for depth in range(limit + 1):
        order = np.argsort(at, kind="stable")
        at, values = at[order], values[order]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        counts = np.diff(np.append(starts, len(at)))
        group = at[starts]
        size.reshape(-1)[group] = counts
        if depth == limit:
            break
        low, high = np.minimum.reduceat(values, starts, axis=0), np.maximum.reduceat(values, starts, axis=0)
        usable = (high > low) & allowed[group // nodes]
        choices = usable.sum(axis=1)
        split = (counts > 1) & (choices > 0)
        if not split.any():
            break
        heap, tree = group % nodes, trees[group // nodes]
        pick = np.floor(uniform(settings.seed, tree, heap, 0) * choices)
        f = np.argmax(np.cumsum(usable, axis=1) > pick[:, None], axis=1)
        every = np.arange(len(group))
        a, z = low[every, f], high[every, f]
        cut = a + uniform(settings.seed, tree, heap, 1) * (z - a)
        cut = np.where(cut < z, cut, a)
        feature.reshape(-1)[group[split]] = f[split]
        threshold.reshape(-1)[group[split]] = cut[split]
        member = np.repeat(every, counts)
        right = values[np.arange(len(at)), f[member]] > cut[member]
        at = (group - heap + 2 * heap + 1)[member] + right
        at, values = at[split[member]], values[split[member]]
        if not len(at):
            break
    return Heaps(feature, threshold, size)


@dataclass
class Sample:
    """For each tree the rows of lowest hashes, in this order: (trees, k) and (trees, k, features)."""

    draw: np.ndarray
    x: np.ndarray
    most: int

    @classmethod
    def of(cls, settings: ForestSettings, at: np.ndarray, x: np.ndarray) -> Sample:
        draw = uniform(settings.seed, np.arange(settings.trees)[:, None], np.asarray(at, "i8")[None, :], 2)
        return cls(draw, np.broadcast_to(x[None], (settings.trees, *x.shape)), settings.max_samples).lowest()

    def lowest(self) -> Sample:
        k = min(self.most, self.draw.shape[1])
        draw, x = self.draw, self.x
        if k < draw.shape[1]:
            kept = np.argpartition(draw, k - 1, axis=1)[:, :k]
            draw, x = np.take_along_axis(draw, kept, 1), np.take_along_axis(x, kept[:, :, None], 1)
        order = np.argsort(draw, axis=1, kind="stable")
        return Sample(np.take_along_axis(draw, order, 1), np.take_along_axis(x, order[:, :, None], 1), self.most)

    def merged(self, other: Sample) -> Sample:
        return Sample(np.concatenate([self.draw, other.draw], axis=1), np.concatenate([self.x, other.x], axis=1), self.most).lowest()

    def dump(self) -> bytes:
        shape = np.array([*self.x.shape, self.most], "<i8")
        return shape.tobytes() + np.ascontiguousarray(self.draw, "<f8").tobytes() + np.ascontiguousarray(self.x, "<f8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> Sample:
        b, k, p, most = np.frombuffer(data, "<i8", 4).tolist()
        cells = np.frombuffer(data, "<f8", offset=32)
        return cls(cells[: b * k].reshape(b, k), cells[b * k :].reshape(b, k, p), most)


def drawn_slots(settings: ForestSettings, n: int) -> np.ndarray:
    """(trees, m): which of the rows in hash order fill the m places of each tree's sample.

    Without bootstrap each row fills one.  With it, place j repeats one of the d rows drawn so
    far with chance d / n and else takes the next one, which is m draws out of n with
    replacement.
    """
    m = min(settings.max_samples, n)
    if not settings.bootstrap:
        return np.broadcast_to(np.arange(m), (settings.trees, m))
    trees = np.arange(settings.trees)
    slots, distinct = np.zeros((settings.trees, m), "i8"), np.zeros(settings.trees, "i8")
    for j in range(m):
        again = uniform(settings.seed, trees, j, 3) * n < distinct
        slots[:, j] = np.where(again, np.floor(uniform(settings.seed, trees, j, 4) * distinct), distinct)
        distinct += ~again
    return slots


def forest_scores(depths: np.ndarray, sample: int) -> np.ndarray:
    """Raw scores in [-1, 0) from (trees, rows): lower is more anomalous."""
    return -np.power(2.0, -depths.mean(axis=0) / max(float(_path_correction(float(sample))), 1e-12))


class GrowingForest:
    """A forest over a prefix that grows row by row; trees with an unchanged sample stay."""

    def __init__(self, settings: ForestSettings, sample: Sample, n: int, rows: np.ndarray):
        self.settings, self.sample, self.n, self.rows = settings, sample, n, rows
        self.trees = np.arange(settings.trees)
        self.stale = np.ones(settings.trees, bool)
        self.slots = self.heaps = self.walked = None

    def add(self, at: int, x: np.ndarray) -> None:
        s = self.sample
        draw = uniform(self.settings.seed, self.trees, at, 2)
        self.n += 1
        if s.draw.shape[1] < s.most:
            changed = np.ones(len(draw), bool)
            self.sample = s.merged(Sample(draw[:, None], np.broadcast_to(x, (len(draw), 1, len(x))), s.most))
        else:
            changed = draw < s.draw[:, -1]
            if changed.any():
                part = Sample(s.draw[changed], s.x[changed], s.most).merged(Sample(draw[changed, None], np.broadcast_to(x, (int(changed.sum()), 1, len(x))), s.most))
                s.draw, s.x = s.draw.copy(), s.x.copy()
                s.draw[changed], s.x[changed] = part.draw, part.x
        self.stale |= changed

    def update(self) -> int:
        """Grow and walk the stale trees again; the size of a tree's sample."""
        slots = drawn_slots(self.settings, self.n)
        if self.slots is None or slots.shape != self.slots.shape:
            self.stale[:] = True
            self.heaps = None
        else:
            self.stale |= (slots != self.slots).any(axis=1)
        self.slots = slots
        which = np.flatnonzero(self.stale)
        if len(which):
            x = np.take_along_axis(self.sample.x[which], slots[which][:, :, None], 1)
            grown = grow_trees(x, self.trees[which], self.settings)
            walked = grown.depths(self.rows)
            if self.heaps is None:
                self.heaps, self.walked = grown, walked
            else:
                self.heaps.put(which, grown)
                self.walked[which] = walked
            self.stale[:] = False
        return slots.shape[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return forest_scores(self.heaps.depths(x), self.slots.shape[1])

    def row_scores(self, n: int) -> np.ndarray:
        """Of the first ``n`` rows."""
        return forest_scores(self.walked[:, :n], self.slots.shape[1])


def fit_forest(
    train: DataFrame,
    keys: Sequence[str],
    row_id: str,
    trees: int = 100,
    seed: int = 42,
    max_samples: int = MAX_SAMPLES,
    max_features: float = 1.0,
    bootstrap: bool = False,
) -> DataFrame:
    """One row per (keys, tree) with the node arrays; needs ``vector ARRAY<DOUBLE>``."""
    keys = list(keys)
    settings = ForestSettings(trees, max_samples, max_features, bootstrap, seed)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in train.schema.fields if f.name in keys)
    schema = f"{fields}, {TREE_SCHEMA}"

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grown = []
        for tree, part in pdf.groupby("tree"):
            # Order inside a group is not guaranteed; the draw and the row's cells fix it.
            drawn = sorted(zip(part["_draw"], map(tuple, part["vector"])))
            x = np.array([v for _, v in drawn], dtype=float)
            if bootstrap:
                x = x[np.minimum(drawn_slots(settings, int(part["_n"].iloc[0]))[int(tree)], len(x) - 1)]
            heap = grow_trees(x[None], np.array([int(tree)]), settings)
            inner = np.arange(heap.feature.shape[1])
            row = dict(zip(keys, key[:-1]))
            row.update(
                tree=int(tree), sample=len(x), feature=heap.feature[0].tolist(), threshold=heap.threshold[0].tolist(),
                left=(2 * inner + 1).tolist(), right=(2 * inner + 2).tolist(), size=heap.size[0].tolist(),
            )
            grown.append(row)
        return pd.DataFrame(grown)

    # A task grows a few trees at once: fewer Arrow groups, still a bounded number of rows.
    samples = tree_samples(train, keys, row_id, trees, seed, max_samples).withColumn("_batch", F.col("tree") % TREE_BATCHES)
    return samples.groupBy(*keys, "_batch").applyInPandas(build, schema)


def score_offset(scores: DataFrame, keys: Sequence[str], contamination: float | None = 0.05) -> DataFrame:
    """(keys, score_offset): raw scores of the training rows below it count as outliers.

    The offset is the ``contamination`` quantile of the raw scores; -0.5 without one.
    """
    if contamination is not None and not 0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    value = F.lit(-0.5) if contamination is None else F.percentile("raw_score", contamination)
    return scores.groupBy(*keys).agg(value.alias("score_offset"))


def _score_rows(x: np.ndarray, model: pd.DataFrame) -> np.ndarray:
    depth = np.zeros(len(x))
    for tree in model.itertuples(index=False):
        feature, threshold = np.asarray(tree.feature), np.asarray(tree.threshold)
        left, right, size = np.asarray(tree.left), np.asarray(tree.right), np.asarray(tree.size)
        at = np.zeros(len(x), dtype=int)
        active = feature[at] >= 0
        while active.any():
            rows = np.flatnonzero(active)
            node = at[rows]
            goes_left = x[rows, feature[node]] <= threshold[node]
            at[rows] = np.where(goes_left, left[node], right[node])
            depth[rows] += 1
            active[rows] = feature[at[rows]] >= 0
        depth += _path_correction(size[at])
    norm = float(_path_correction(float(model["sample"].max())))
    return -np.power(2.0, -(depth / len(model)) / max(norm, 1e-12))


def score_forest(rows: DataFrame, model: DataFrame, keys: Sequence[str], row_id: str, slices: int = 32) -> DataFrame:
    """Adds ``raw_score`` in [-1, 0): lower is more anomalous.

    Rows of a model are cut into ``slices`` by a hash of their id and each slice meets
    a copy of the (bounded) model, so a hot model spreads over many tasks.
    """
    keys = list(keys)
    cut = F.pmod(F.xxhash64(F.col(row_id).cast("string")), F.lit(slices)).cast("int")
    left = rows.withColumn("_slice", cut)
    right = model.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", raw_score double"
    names = rows.columns

    def score(pdf: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=[*names, "raw_score"])
        if trees.empty:
            return pdf[names].assign(raw_score=None)
        x = np.array(pdf["vector"].tolist(), dtype=float)
        return pdf[names].assign(raw_score=_score_rows(x, trees.sort_values("tree")))

    group = [*keys, "_slice"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(score, schema)
