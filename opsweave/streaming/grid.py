"""Gap-free feature windows of a stream: empty windows, fills and statuses while it runs.

``feature_windows`` emits a window once the watermark has passed its end, so a series'
windows arrive in order.  Per series the state holds the first and the last window number
and one (count, value) pair per feature; when a later window arrives, the windows between
are certain to be empty and are written with it.  Fills that look ahead or need the whole
past (linear, median) stay batch operators and are refused here.

Defined cases: windows at or before the series' last one are dropped (append mode sends none);
a long gap leaves in pieces; trailing windows wait for the series' next non-empty one, as the
batch grid ends at the last non-empty one too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from opsweave.operators.features import FeatureConfig, fill_grid, impute, window_status

STREAM_FILLS = ("forward_fill", "zero_fill", "mean_fill", "none")
_PIECE = 4096
# Keyed state of several operators in one query needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _check(cfg: FeatureConfig) -> None:
    if cfg.imputation not in STREAM_FILLS:
        raise ValueError(f"{cfg.imputation} is no fill for streams; use one of {STREAM_FILLS}")


def fill_columns(measured: np.ndarray, strategy: str, counts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filled, counts, values) of windows x features; NaN is missing.

    ``values`` is the last measured value under forward_fill, the sum of all under mean_fill.
    """
    known = ~np.isnan(measured)
    upto = counts + np.cumsum(known, axis=0)
    if strategy == "mean_fill":
        total = values + np.cumsum(np.where(known, measured, 0.0), axis=0)
        with np.errstate(invalid="ignore"):
            mean = np.where(upto > 0, total / np.maximum(upto, 1), np.nan)
        return np.where(known, measured, mean), upto[-1], total[-1]
    place = np.maximum.accumulate(np.where(known, np.arange(len(measured))[:, None], -1), axis=0)
    last = np.where(place >= 0, np.take_along_axis(measured, np.maximum(place, 0), 0), values)
    fill = {"forward_fill": np.where(upto > 0, last, 0.0), "zero_fill": np.zeros_like(measured), "none": np.full_like(measured, np.nan)}[strategy]
    return np.where(known, measured, fill), upto[-1], last[-1]


class SeriesGrid(StatefulProcessor):
    """Keyed state of one series: first and last window, counts and values of its features."""

    def __init__(self, keys: list[str], columns: list[str], step_us: int, strategy: str):
        self.keys, self.columns, self.step_us, self.strategy = keys, columns, step_us, strategy

    def init(self, handle: StatefulProcessorHandle) -> None:
        pairs = "".join(f", n{i} long, v{i} double" for i in range(len(self.columns)))
        self.series = handle.getValueState("series", f"first long, last long{pairs}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        width, names = len(self.columns), np.array(self.columns, dtype=object)
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        pdf = pd.concat(frames)
        pdf = pdf.sort_values("at_us")
        at = pdf["at_us"].to_numpy() // self.step_us
        if self.series.exists():
            first, last, *pairs = self.series.get()
            counts, values = np.array(pairs[0::2], "i8"), np.array(pairs[1::2], float)
        else:
            first, last, counts, values = int(at[0]), int(at[0]) - 1, np.zeros(width, "i8"), np.zeros(width)
        pdf, at = pdf[at > last], at[at > last]
        if not len(at):
            return
        end = int(at[-1]) + 1
        for start in range(last + 1, end, _PIECE):
            stop = min(start + _PIECE, end)
            here = (at >= start) & (at < stop)
            measured, samples = np.full((stop - start, width), np.nan), np.zeros(stop - start, "i8")
            measured[at[here] - start] = pdf.loc[here, self.columns].to_numpy(float)
            samples[at[here] - start] = pdf.loc[here, "sample_count"].to_numpy()
            filled, counts, values = fill_columns(measured, self.strategy, counts, values)
            missing = np.isnan(measured)
            out = pd.DataFrame({k: [v] * (stop - start) for k, v in zip(self.keys, key)})
            out["window_index"] = np.arange(start, stop) - first
            out["at_us"] = np.arange(start, stop) * self.step_us
            out["sample_count"] = samples
            for i, c in enumerate(self.columns):
                out[c] = filled[:, i]
            out["_was_missing"] = missing.sum(axis=1).astype("i4")
            out["imputed_features"] = [names[m].tolist() for m in missing & ~np.isnan(filled)]
            out["missing_features"] = [names[m].tolist() for m in missing & np.isnan(filled)]
            yield out
        self.series.update((first, end - 1, *[x for n, v in zip(counts, values) for x in (int(n), float(v))]))

    def close(self) -> None:
        pass


def grid_stream(windows: DataFrame, cfg: FeatureConfig, keys: Sequence[str]) -> DataFrame:
    """Streaming grid, imputation and status over the output of ``feature_windows``.

    Adds the empty windows, ``window_index`` (0 is the series' first window), the imputed and
    the missing features, is_warmup, is_imputed and status.
    """
    _check(cfg)
    keys, columns = list(keys), list(cfg.columns)
    step_us = cfg.step_us
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in windows.schema.fields if f.name in keys)
    numbers = "".join(f", `{c}` double" for c in columns)
    schema = f"{kept}window_index long, at_us long, sample_count long{numbers}, _was_missing int, imputed_features array<string>, missing_features array<string>"
    windows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    source = windows.select(*keys, F.unix_micros("window_start").alias("at_us"), F.col("sample_count").cast("long").alias("sample_count"), *[F.col(c).cast("double").alias(c) for c in columns])
    grid = source.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=SeriesGrid(keys, columns, step_us, cfg.imputation), outputStructType=schema, outputMode="Append", timeMode="None"
    )
    return _finished(grid, cfg)


def _finished(grid: DataFrame, cfg: FeatureConfig) -> DataFrame:
    timed = grid.withColumn("window_start", F.timestamp_micros("at_us")).withColumn("window_end", F.timestamp_micros(F.col("at_us") + cfg.size_us))
    return window_status(timed, cfg).drop("at_us")


def grid_batch(windows: DataFrame, cfg: FeatureConfig, keys: Sequence[str]) -> DataFrame:
    """The same table from all windows at once."""
    _check(cfg)
    start = F.unix_micros("window_start")
    first = F.min(start).over(Window.partitionBy(*keys))
    numbered = windows.select(*keys, "sample_count", *cfg.columns, start.alias("_start"), first.alias("_first"))
    indexed = numbered.withColumn("window_index", F.floor((F.col("_start") - F.col("_first")) / cfg.step_us).cast("long"))
    filled = impute(fill_grid(indexed.drop("_start", "_first"), keys, cfg.columns), keys, cfg)
    firsts = numbered.groupBy(*keys).agg(F.min("_first").alias("_first"))
    return _finished(filled.join(firsts, list(keys)).withColumn("at_us", F.col("_first") + F.col("window_index") * cfg.step_us).drop("_first"), cfg)
