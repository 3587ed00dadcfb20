"""One model per window: every window is scored by a model of all windows before it.

A series is packed into rows of PACK windows and scored in blocks of BLOCK windows.  A
group of the main step has one block and one pack that is not later than it, and learns
the block's models from what summarises all rows before the block:

* reconstruction: count, means and centred cross products, merged pack by pack and
  continued window by window, give each window's covariance; a batched eigenvalue
  decomposition gives its components;
* isolation forest: a tree draws the rows of lowest hashes, so its sample grows with
  the prefix and changes by a row with a chance of sample / prefix.  Only trees whose
  sample changed are grown and walked again.

The pack's rows are scored by each of the block's models and only (count, mean, centred
squares, minimum, lowest tail) leave the task, so no training row is written once per
later window; pieces of one window are merged in the end.  Work is windows x history,
which a fit per window means, spread over blocks and packs; a task holds one pack.

Defined cases: rows with a missing, NaN or infinite feature are no history and get a status
of their own; an empty table gives an empty result; window numbers are unique in a series
and not negative.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from opsweave.functions.numeric import is_finite
from opsweave.operators import forest
from opsweave.session import materialise

PACK = 32_768
BLOCK = 64


def _centred(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred cross products of the rows of ``x``."""
    if not len(x):
        return 0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
    mean = x.mean(axis=0)
    d = x - mean
    return len(x), mean, d.T @ d


def merge_moments(a: tuple, b: tuple) -> tuple:
    """Moments of both sets; exact up to rounding, also for far means."""
    (na, ma, ca), (nb, mb, cb) = a, b
    n = na + nb
    if not n:
        return a
    gap = mb - ma
    return n, ma + gap * (nb / n), ca + cb + np.outer(gap, gap) * (na * nb / n)


def running_moments(start: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moments before each row of ``x`` and after the last: (n), (n, p), (n, p, p)."""
    n0, m0, c0 = start
    base = m0 if n0 else (x[0] if len(x) else m0)
    d = x - base
    p = len(base)
    total = np.concatenate([np.zeros((1, p)), np.cumsum(d, axis=0)])
    cross = np.concatenate([np.zeros((1, p, p)), np.cumsum(d[:, :, None] * d[:, None, :], axis=0)])
    n = n0 + np.arange(len(x) + 1)
    safe = np.maximum(n, 1)[:, None]
    shift = total / safe
    return n, base + shift, c0 + cross - shift[:, :, None] * shift[:, None, :] * safe[:, :, None]


@dataclass(frozen=True)
class Prefix:
    """What is known of all complete rows before a pack."""

    moments: tuple
    low: np.ndarray
    high: np.ndarray
    sample: forest.Sample | None


@dataclass
class Piece:
    """One window's model applied to the rows of one pack."""

    index: int
    history: int = 0
    raw: float | None = None
    constant: bool = False
    sample: int | None = None
    scores: np.ndarray | None = None


class Reconstruction:
    """PCA with ``bottleneck`` components of the scaled prefix; error as mean of squares."""

    sign = 1.0

    def __init__(self, width: int, bottleneck: int = 1, scaling: str = "standard"):
        if not 1 <= bottleneck < width:
            raise ValueError("bottleneck must be at least 1 and smaller than the number of features")
        if scaling not in ("standard", "minmax", "none"):
            raise ValueError("a fit per window scales by 'standard', 'minmax' or 'none'")
        self.width, self.bottleneck, self.scaling = width, bottleneck, scaling

    def sample_of(self, at: np.ndarray, x: np.ndarray) -> None:
        return None

    def residual_maps(self, n: np.ndarray, cross: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each window the matrix that takes a centred row to its residual."""
        p = self.width
        variance = np.einsum("tii->ti", cross)
        if self.scaling == "standard":
            spread = np.sqrt(np.maximum(variance, 0) / np.maximum(n - 1, 1)[:, None])
        else:
            spread = high - low if self.scaling == "minmax" else np.ones((len(n), p))
        scale = np.where(spread >= 1e-8, spread, 1.0)
        scaled = cross / scale[:, :, None] / scale[:, None, :] / np.maximum(n, 1)[:, None, None]
        _, vectors = np.linalg.eigh((scaled + scaled.transpose(0, 2, 1)) / 2)
        rest = vectors[:, :, : p - self.bottleneck]  # eigenvalues ascend: what the bottleneck drops
        return rest @ rest.transpose(0, 2, 1) / scale[:, None, :]

    def pieces(self, prefix: Prefix, own: tuple, targets: list, rows: tuple, min_history: int) -> Iterator[Piece]:
        at, x = own
        numbers = [t for t, _ in targets]
        known = at < numbers[-1] + 1
        n, mean, cross = running_moments(prefix.moments, x[known])
        low = np.minimum.accumulate(np.concatenate([prefix.low[None], x[known]]))
        high = np.maximum.accumulate(np.concatenate([prefix.high[None], x[known]]))
        place = np.searchsorted(at[known], numbers)  # rows before each target
        low, high, n, mean, cross = low[place], high[place], n[place], mean[place], cross[place]
        fits = [k for k, (_, v) in enumerate(targets) if v is not None and n[k] >= min_history]
        maps = dict(zip(fits, self.residual_maps(n[fits], cross[fits], low[fits], high[fits]))) if fits else {}
        for k, (t, v) in enumerate(targets):
            piece = Piece(t, int(n[k]))
            if v is not None:
                piece.constant = bool(n[k] and (low[k] == high[k]).all() and (v == low[k]).all())
            if k in maps:
                error = lambda r: ((r - mean[k]) @ maps[k].T) ** 2
                piece.raw = float(error(v).mean())
                piece.scores = error(rows[1][: np.searchsorted(rows[0], t)]).mean(axis=1)
            yield piece


class IsolationForest:
    """Trees over bottom-k samples of the prefix.

    Scaling changes each feature by a linear map, which trees with uniform cuts do not
    notice, so the raw features are used for every scaling.
    """

    sign = -1.0

    def __init__(self, settings: forest.ForestSettings):
        self.settings = settings

    def sample_of(self, at: np.ndarray, x: np.ndarray) -> forest.Sample:
        return forest.Sample.of(self.settings, at, x)

    def pieces(self, prefix: Prefix, own: tuple, targets: list, rows: tuple, min_history: int) -> Iterator[Piece]:
        at, x = own
        first = int(np.searchsorted(at, targets[0][0]))
        sample = self.sample_of(at[:first], x[:first])
        if prefix.sample is not None:
            sample = sample.merged(prefix.sample)
        grown = forest.GrowingForest(self.settings, sample, prefix.moments[0] + first, rows[1])
        low = np.minimum.reduce(np.concatenate([prefix.low[None], x[:first]]))
        high = np.maximum.reduce(np.concatenate([prefix.high[None], x[:first]]))
        for t, v in targets:
            piece = Piece(t, grown.n)
            if v is not None and grown.n:
                piece.constant = bool((low == high).all() and (v == low).all())
            if v is not None and grown.n >= max(min_history, 1):
                piece.sample = grown.update()
                piece.raw = float(grown.score(v[None])[0])
                piece.scores = grown.row_scores(int(np.searchsorted(rows[0], t)))
            yield piece
            if v is not None:
                grown.add(t, v)
                low, high = np.minimum(low, v), np.maximum(high, v)


Model = Reconstruction | IsolationForest


def _packs(windows: DataFrame, columns: Sequence[str], keys: Sequence[str], pack: int) -> DataFrame:
    """(keys, pack_no, at, usable, x): the windows of a pack in order, features window by window."""
    usable = F.lit(True)
    for c in columns:
        usable = usable & F.col(c).isNotNull() & is_finite(F.col(c))
    cells = [F.when(usable, F.col(c).cast("double")).otherwise(F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(columns)]
    entry = F.struct(F.col("window_index").cast("long").alias("at"), F.coalesce(usable, F.lit(False)).alias("usable"), *cells)
    rows = windows.select(*keys, F.floor(F.col("window_index") / pack).cast("long").alias("pack_no"), entry.alias("_row"))
    # At most ``pack`` entries a group: window numbers are unique in a series.
    listed = rows.groupBy(*keys, "pack_no").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    flat = F.flatten(F.transform("_rows", lambda r: F.array(*[r[f"f{i}"] for i in range(len(columns))])))
    return listed.select(*keys, "pack_no", F.transform("_rows", lambda r: r["at"]).alias("at"), F.transform("_rows", lambda r: r["usable"]).alias("usable"), flat.alias("x"))


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in names)


def _arrays(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.asarray(row["at"], "i8"), np.asarray(row["usable"], bool), np.asarray(row["x"], float).reshape(-1, width)


def _prefixes(packs: DataFrame, keys: Sequence[str], width: int, model: Model) -> DataFrame:
    """(keys, pack_no, n, mean, cross, low, high, sample) of all complete rows before each pack."""
    inner = "n long, mean array<double>, cross array<double>, low array<double>, high array<double>, sample binary"
    schema = f"{_fields(packs, keys)}pack_no long, {inner}"
    names = [*keys, "pack_no"]

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                at, usable, x = _arrays(row, width)
                at, x = at[usable], x[usable]
                n, mean, cross = _centred(x)
                sample = model.sample_of(at, x)
                edge = [x.min(axis=0), x.max(axis=0)] if n else [np.full(width, np.inf), np.full(width, -np.inf)]
                out.append((*(row[c] for c in names), n, mean.tolist(), cross.ravel().tolist(), edge[0].tolist(), edge[1].tolist(), sample.dump() if sample else None))
            yield pd.DataFrame(out, columns=[*names, "n", "mean", "cross", "low", "high", "sample"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """A series' summaries, one row a pack, in order: each becomes what lies before it."""
        out = []
        moments = (0, np.zeros(width), np.zeros((width, width)))
        low, high, sample = np.full(width, np.inf), np.full(width, -np.inf), None
        for row in pdf.sort_values("pack_no").to_dict("records"):
            out.append((*(row[c] for c in names), moments[0], moments[1].tolist(), moments[2].ravel().tolist(), low.tolist(), high.tolist(), sample.dump() if sample else None))
            moments = merge_moments(moments, (row["n"], np.asarray(row["mean"], float), np.asarray(row["cross"], float).reshape(width, width)))
            low, high = np.minimum(low, row["low"]), np.maximum(high, row["high"])
            if row["sample"] is not None:
                own = forest.Sample.load(row["sample"])
                sample = own if sample is None else sample.merged(own)
        return pd.DataFrame(out, columns=[*names, "n", "mean", "cross", "low", "high", "sample"])

    return packs.mapInPandas(summarise, schema).groupBy(*keys).applyInPandas(fold, schema)


def _tail(scores: np.ndarray, total: int, contamination: float | None) -> list[float] | None:
    """The lowest raw scores that a quantile over ``total`` of them can need."""
    if contamination is None:
        return None
    need = min(len(scores), int(contamination * max(total - 1, 0)) + 2)
    return np.sort(np.partition(scores, need - 1)[:need]).tolist() if need else []


def score_prefixes(
    windows: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    model: Model,
    min_history: int = 10,
    contamination: float | None = None,
    pack: int = PACK,
    block: int = BLOCK,
) -> DataFrame:
    """One row per window: keys, window_index, history_windows, raw_score, sample_size,
    constant match, minimum, mean and deviation of the history's scores (in the direction
    of higher = more anomalous), and ``score_offset``, the contamination quantile of its raw scores."""
    keys, width = list(keys), len(columns)
    packs = materialise(_packs(windows, columns, keys, pack))
    before = _prefixes(packs, keys, width, model)
    numbered = F.transform("at", lambda i: F.floor(i / block).cast("long"))
    blocks = packs.join(before, [*keys, "pack_no"]).withColumn("_block", F.explode(F.array_distinct(numbered)))
    scored = packs.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("pack_no").alias("_other"), F.col("at").alias("_at"), F.col("usable").alias("_usable"), F.col("x").alias("_x"))
    same = F.col("_other") <= F.col("pack_no")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    cells = blocks.join(scored, same).repartition(*keys, "_block", "_other")
    fields = _fields(packs, keys)
    schema = f"{fields}window_index long, history long, raw double, same boolean, sample_size int, n long, mean double, m2 double, low double, tail array<double>"
    names = [c.split(" ")[0].strip("`") for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.to_dict("records"):
                at, usable, x = _arrays(row, width)
                targets = [(int(at[i]), x[i] if usable[i] else None) for i in np.flatnonzero(at // block == row["cell_block"])]
                o_at, o_usable, o_x = _arrays({c: row[f"cell_{c}"] for c in ("at", "usable", "x")}, width)
                earlier = o_usable & (o_at < targets[-1][0])
                rows = o_at[earlier], o_x[earlier]
                moments = (row["n"], np.asarray(row["mean"], float), np.asarray(row["cross"], float).reshape(width, width))
                sample = None if row["sample"] is None else forest.Sample.load(row["sample"])
                prefix = Prefix(moments, np.asarray(row["low"], float), np.asarray(row["high"], float), sample)
                key, own = [row[k] for k in keys], row["cell_own"]
                out = []
                for piece in model.pieces(prefix, (at[usable], x[usable]), targets, rows, min_history):
                    stats = (0, None, None, None, None)
                    if piece.scores is not None and len(piece.scores):
                        oriented = model.sign * piece.scores
                        stats = (len(oriented), float(oriented.mean()), float(((oriented - oriented.mean()) ** 2).sum()), float(oriented.min()), _tail(piece.scores, piece.history, contamination))
                    out.append((*key, piece.index, piece.history, piece.raw if own else None, piece.constant, piece.sample, *stats))
                yield pd.DataFrame(out, columns=names).astype({"raw": "Float64", "sample_size": "Int32", "mean": "Float64", "m2": "Float64", "low": "Float64"})

    renamed = cells.select(
        *keys, "at", "usable", "x", "n", "mean", "cross", "low", "high", "sample",
        F.col("_block").alias("cell_block"), F.col("_at").alias("cell_at"), F.col("_usable").alias("cell_usable"), F.col("_x").alias("cell_x"),
        (F.col("_other") == F.col("pack_no")).alias("cell_own"),
    )
    pieces = renamed.mapInPandas(run, schema)
    return _merge_pieces(pieces, keys, contamination)


def _merge_pieces(pieces: DataFrame, keys: Sequence[str], contamination: float | None) -> DataFrame:
    """One row per window from its pieces, as many as there are packs up to it."""
    part = F.struct("n", "mean", "m2", "low", "tail")
    merged = pieces.groupBy(*keys, "window_index").agg(
        F.max("history").alias("history_windows"),
        F.max("raw").alias("raw_score"),
        F.max("sample_size").alias("sample_size"),
        F.max("same").alias("_constant_match"),
        F.min("low").alias("_min"),
        F.array_sort(F.collect_list(F.when(F.col("n") > 0, part))).alias("_parts"),
    )
    total = F.aggregate("_parts", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    mean = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["n"] * p["mean"]) / total
    counted = merged.withColumn("_n", total).withColumn("_mean", F.when(total > 0, mean))
    squares = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["m2"] + p["n"] * (p["mean"] - F.col("_mean")) * (p["mean"] - F.col("_mean")))
    spread = F.when(F.col("_n") > 1, F.sqrt(squares / (F.col("_n") - 1))).when(F.col("_n") > 0, F.lit(0.0))
    done = counted.withColumn("_std", spread)
    if contamination is None:
        offset: Column = F.lit(-0.5)
    else:
        lowest = F.array_sort(F.flatten(F.transform("_parts", lambda p: p["tail"])))
        place = F.lit(contamination) * (F.col("_n") - 1)
        floor = F.floor(place).cast("int")
        value = lambda k: F.get(F.col("_tail"), k)
        done = done.withColumn("_tail", lowest)
        offset = value(floor) + (place - floor) * (F.coalesce(value(floor + 1), value(floor)) - value(floor))
    return done.withColumn("score_offset", F.when(F.col("_n") > 0, offset)).drop("_parts", "_n", "_tail")


def default_forest(trees: int, seed: int, **settings) -> IsolationForest:
    return IsolationForest(forest.ForestSettings(trees=trees, seed=seed, **settings))

