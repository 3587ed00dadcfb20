"""Text quality by a generalised additive model with pairwise interactions.

``text_features`` measures each whole text once.  The model is fitted on labelled rows:
features are binned at quantiles, and one feature after the other, round by round, gets a
shallow tree on the gradient of the log loss; its steps are added to the feature's table.
Pairs of features that explain most of what is left get two-way tables in the same way.
A score is the logistic function of an intercept and one entry of each table.

Bounded: FIT_ROWS labelled rows at most take part in the fit (a documented parameter; the
rows with the lowest hashes of their ids), so one task can hold them.  Measuring and
scoring read all rows, independently of each other.

Defined cases: a null text counts as an empty one and gets a score; repeated documents get
a row each; a null doc_id counts as an empty text (remainder 0: held out) and is never
fitted; a document with several labels takes the largest; null labels are not fitted;
without labels of both kinds every score is the share of label 1 (0.5 without any).
Labels, language, source and id are no inputs.
"""

from __future__ import annotations

import itertools
import json
import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opsweave.llm.common import cut

FIT_ROWS = 60_000
ROUNDS = 150
RATE = 0.1
BINS = 48
PAIR_BINS = 12
PAIRS = 6
LEAVES = 4
MIN_LEAF = 8
FOLDS = 5
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "symbol_share", "upper_share", "digit_share", "letter_share", "mark_share",
    "same_as_last", "distinct_share", "pair_repeat_share", "top_share", "line_repeat_share", "log_line_words", "stop_share",
)

_SYMBOLS = b"#*$%&|<>~^=_{}[]\\/@+"
_MARKS = b".,;:!?"
_NOT = {
    "upper": bytes(set(range(256)) - set(range(0x41, 0x5B))),
    "digit": bytes(set(range(256)) - set(range(0x30, 0x3A))),
    "letter": bytes(set(range(256)) - set(range(0x41, 0x5B)) - set(range(0x61, 0x7B)) - set(range(0x80, 0x100))),
    "symbol": bytes(set(range(256)) - set(_SYMBOLS)),
    "mark": bytes(set(range(256)) - set(_MARKS)),
    "stop": bytes(set(range(256)) - set(b".!?")),
}


def measure(text: bytes) -> tuple[float, ...]:
    """The features of one text, by words between white space and by bytes."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    size = len(text)
    inside = sum(map(len, words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    last = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
    pairs = len(set(zip(words, itertools.islice(words, 1, None))))
    lines = [line for line in text.split(b"\n") if line.strip()]
    share = {k: len(text.translate(None, d)) / size for k, d in _NOT.items()}
    return (
        math.log1p(n), inside / n, share["symbol"], share["upper"], share["digit"], share["letter"], share["mark"],
        last / n, len(counts) / n, 1 - pairs / max(1, n - 1), max(counts.values()) / n,
        1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), share["stop"],
    )


def remainder(doc_id: Column | str = "doc_id", folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; rows with 0 are held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def text_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x ARRAY<DOUBLE>) for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.array([measure(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], float).ravel()
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype="i4") * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(flat))], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Gam:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Sum of one entry of each table, a whole batch at a time."""
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.pair_edges)]
        for (f, g), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[f], coarse[g]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))

    def dump(self) -> str:
        return json.dumps({k: [t.tolist() if isinstance(t, np.ndarray) else t for t in v] if isinstance(v, list) else v for k, v in vars(self).items()})

    @classmethod
    def load(cls, text: str) -> Gam:
        raw = json.loads(text)
        arrays = {k: [np.array(t, float) for t in raw[k]] for k in ("edges", "tables", "pair_edges", "pair_tables")}
        return cls(intercept=raw["intercept"], pairs=[tuple(p) for p in raw["pairs"]], **arrays)


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of consecutive bins; place 0 if no cut helps."""
    if len(g) < 2:
        return 0.0, 0
    lg, lh, ln = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gains = _gain(lg, lh) + _gain(g.sum() - lg, h.sum() - lh) - _gain(g.sum(), h.sum())
    gains = np.where((ln >= MIN_LEAF) & (n.sum() - ln >= MIN_LEAF), gains, 0.0)
    at = int(np.argmax(gains))
    return (float(gains[at]), at + 1) if gains[at] > 1e-12 else (0.0, 0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """Steps of a tree with up to ``leaves`` leaves over one feature's bins."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b], n[a:b]), a, b) for a, b in spans]
        gain, at, a, b = max(cuts, key=lambda c: (c[0], -c[2]))
        if not at:
            break
        spans.remove((a, b))
        spans += [(a, a + at), (a + at, b)]
    steps = np.zeros(len(g))
    for a, b in spans:
        steps[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return steps


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One cut on one axis, then one on the other axis in each half: up to four leaves."""
    best, best_gain = np.zeros_like(g), 0.0
    for flip in (False, True):
        a, b, c = (m.T if flip else m for m in (g, h, n))
        _, at = _best_cut(a.sum(1), b.sum(1), c.sum(1))
        steps, gain = np.zeros_like(a), 0.0
        for rows in (slice(0, at), slice(at, None)) if at else (slice(None),):
            u, v, w = a[rows].sum(0), b[rows].sum(0), c[rows].sum(0)
            _, cut_at = _best_cut(u, v, w)
            for cols in (slice(0, cut_at), slice(cut_at, None)) if cut_at else (slice(None),):
                sg, sh = u[cols].sum(), v[cols].sum()
                steps[rows, cols] = sg / (sh + 1.0)
                gain += _gain(sg, sh)
        if gain > best_gain:
            best, best_gain = (steps.T if flip else steps), gain
    return best


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, bins: int = BINS, pairs: int = PAIRS) -> Gam:
    """Cyclic boosting: every round visits every feature; pairs follow on what is left."""
    width = x.shape[1]
    share = float(y.mean()) if len(y) else 0.5
    blank = len(y) < 2 or share in (0.0, 1.0)
    edges = [_edges(x[:, f], bins) if len(x) else np.zeros(0) for f in range(width)]
    coarse = [_edges(x[:, f], PAIR_BINS) if len(x) else np.zeros(0) for f in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    start = math.log((share + 1e-6) / (1 - share + 1e-6))
    if blank:
        return Gam(start, edges, tables, [], coarse, [])
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    total = np.full(len(y), start)
    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(at, tables)]
    for _ in range(rounds):
        for f in range(width):
            if len(tables[f]) < 2:
                continue
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(at[f], y - p, len(tables[f]))
            h = np.bincount(at[f], p * (1 - p), len(tables[f]))
            steps = rate * _shallow_tree(g, h, sizes[f], LEAVES)
            tables[f] += steps
            total += steps[at[f]]
    low = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    side = [len(e) + 1 for e in coarse]
    cells = lambda f, k: low[f] * side[k] + low[k]
    sums = lambda f, k, w: np.bincount(cells(f, k), w, side[f] * side[k]).reshape(side[f], side[k])
    p = 1 / (1 + np.exp(-total))
    ranked = []
    for f, k in itertools.combinations([f for f in range(width) if side[f] > 1], 2):
        g, h = sums(f, k, y - p), sums(f, k, p * (1 - p))
        tree = _pair_tree(g, h, sums(f, k, None))
        ranked.append((float((2 * tree * g - tree * tree * h).sum()), -f, -k))
    chosen = [(-f, -k) for _, f, k in sorted(ranked, reverse=True)[:pairs]]
    pair_tables = [np.zeros((side[f], side[k])) for f, k in chosen]
    counts = [sums(f, k, None) for f, k in chosen]
    for _ in range(rounds // 3):
        for i, (f, k) in enumerate(chosen):
            p = 1 / (1 + np.exp(-total))
            steps = rate * _pair_tree(sums(f, k, y - p), sums(f, k, p * (1 - p)), counts[i])
            pair_tables[i] += steps
            total += steps[low[f], low[k]]
    return Gam(start, edges, tables, chosen, coarse, pair_tables)


def train(features: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **settings) -> str:
    """The model, fitted in one task on at most ``fit_rows`` labelled rows, as text of some 20 KB."""
    marked = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("_y"))
    known = cut(features.where(remainder() != 0).join(marked, "doc_id").select("doc_id", "x", "_y"))
    n = known.count()
    if n > fit_rows:
        # A hash bound that leaves nine tenths of fit_rows on average keeps the sample below it.
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * 0.9 * fit_rows / n)).limit(fit_rows)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["_y"].to_numpy(), pdf["doc_id"].to_numpy()))
        x = np.array(pdf["x"].tolist(), float).reshape(-1, len(FEATURES))[order]
        return pd.DataFrame({"model": [fit_gam(x, pdf["_y"].to_numpy()[order], **settings).dump()]})

    made = known.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, "model string").collect()
    return made[0]["model"] if made else fit_gam(np.zeros((0, len(FEATURES))), np.zeros(0)).dump()


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    features = cut(text_features(docs))
    model = features.sparkSession.sparkContext.broadcast(train(features, labels, fit_rows))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gam = Gam.load(model.value)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(gam.score(x))], schema=schema)

    inputs = features.select("doc_id", (remainder() == 0).alias("held_out"), "x")
    scored = inputs.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def held_out_report(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Accuracy, and the share of each label that is predicted right, over held-out rows."""
    marked = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_y"))
    hit = (F.col("predicted") == F.col("_y")).cast("double")
    by = [F.avg(F.when(F.col("_y") == k, hit)).alias(f"recall_{k}") for k in (0, 1)]
    return scored.where("held_out").join(marked, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), *by)

