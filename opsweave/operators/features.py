"""Windowed feature extraction: dedupe, windows, aggregates, imputation, status, exports.

Input of this module is the long *observation* table: series key columns plus
``event_id``, ``event_time TIMESTAMP``, ``metric_name`` and ``value DOUBLE``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.functions.skew import lookup_join
from opsweave.operators.prefix_order import prefix_quantiles
from opsweave.operators.quantiles import HOT_ROWS, sliced_quantiles
from opsweave.session import materialise

SERIES_KEYS = ("tenant_id", "environment", "service", "run_id")

# Quantile behind each percentile aggregate.
QUANTILES = {"median": 0.50, "p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}
AGGREGATES = (*QUANTILES, "mean", "min", "max", "sum", "count", "rate", "std", "stddev", "first", "last")
FILLS = ("forward_fill", "zero_fill", "mean_fill", "median_fill", "linear_interpolate")

_GAP_CHUNK = 4096


@dataclass(frozen=True)
class FeatureConfig:
    """What to extract.  ``features`` are ``metric`` or ``metric:aggregate`` declarations."""

    features: tuple[str, ...]
    size_seconds: float
    step_seconds: float
    aggregation_methods: tuple[str, ...] = ("mean",)
    imputation: str = "forward_fill"
    warm_up_windows: int = 0
    min_samples: int = 1
    alignment: str = "end"
    approx: bool = False
    hot_rows: int = HOT_ROWS

    def __post_init__(self) -> None:
        if not 0 < self.step_seconds <= self.size_seconds:
            raise ValueError("step must be positive and not above the window size")
        if self.warm_up_windows < 0 or self.min_samples < 0:
            raise ValueError("warm_up_windows and min_samples must not be negative")
        if self.alignment not in ("end", "start", "center"):
            raise ValueError("alignment must be end, start or center")
        if self.imputation not in (*FILLS, "none"):
            raise ValueError(f"unknown imputation strategy {self.imputation!r}")
        self.parsed()

    @property
    def size_us(self) -> int:
        return round(self.size_seconds * 1_000_000)

    @property
    def step_us(self) -> int:
        return round(self.step_seconds * 1_000_000)

    def parsed(self) -> list[tuple[str, str, str]]:
        """(column name, metric, aggregate) per declaration; split on the first colon."""
        default = self.aggregation_methods[0] if self.aggregation_methods else "mean"
        result = []
        for decl in self.features:
            metric, colon, agg = (p.strip() for p in decl.strip().partition(":"))
            agg = agg if colon else default
            if not metric or not agg:
                raise ValueError(f"blank metric or aggregate in {decl!r}")
            agg = agg.lower()
            if agg not in AGGREGATES:
                raise ValueError(f"unsupported aggregate {agg!r}")
            result.append((feature_column(metric, agg), metric, agg))
        return result

    @property
    def columns(self) -> list[str]:
        return [name for name, _, _ in self.parsed()]


def feature_column(metric: str, agg: str) -> str:
    return f"{metric}__{agg}"


def dedupe_observations(obs: DataFrame) -> DataFrame:
    """Keep one row per (event_id, metric_name): the earliest, then the smallest value.

    Input order has no meaning in a distributed table, so time and value decide.
    ``row_number() = 1`` lets Spark drop the other copies before the shuffle.
    """
    w = Window.partitionBy("event_id", "metric_name").orderBy("event_time", "value")
    return obs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def series_profile(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per series: anchor (first event in epoch micros) and raw row count."""
    return obs.groupBy(*keys).agg(
        F.min(F.unix_micros("event_time")).alias("origin_us"), F.count(F.lit(1)).alias("series_rows")
    )


def assign_windows(
    obs: DataFrame, profile: DataFrame, keys: Sequence[str], size_us: int, step_us: int, series: int | None = None
) -> DataFrame:
    """One row per (observation, window it falls in), windows anchored at the series origin.

    Window i is [origin + i*step, origin + i*step + size).  The index range follows
    from integer arithmetic, so the cost is rows * size/step whatever the span.
    """
    placed = lookup_join(obs, profile.select(*keys, "origin_us"), keys, ["event_id", "metric_name"], rows=series)
    last = F.expr(f"(unix_micros(event_time) - origin_us) div {step_us}L")
    if size_us == step_us:
        return placed.withColumn("window_index", last)
    first = F.expr(
        f"if(unix_micros(event_time) - origin_us < {size_us}L, 0L, "
        f"((unix_micros(event_time) - origin_us - {size_us}L) div {step_us}L) + 1L)"
    )
    return placed.withColumn("window_index", F.explode(F.sequence(first, last)))


def _metric_aggregates(cfg: FeatureConfig, exact_inline: bool) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates for one groupBy, and how each feature is read from them afterwards."""
    aggs: dict[str, Column] = {}
    reads: dict[str, Column] = {}
    metrics = sorted({m for _, m, _ in cfg.parsed()})
    for pos, metric in enumerate(metrics):
        v = F.when(F.col("metric_name") == metric, F.col("value"))
        key = F.when(F.col("metric_name") == metric, F.struct("event_time", F.col("event_id").cast("string")))
        wanted = [(name, agg) for name, m, agg in cfg.parsed() if m == metric]
        aggs[f"_n{pos}"] = F.count(v)
        n = F.col(f"_n{pos}")
        qs = sorted({QUANTILES[a] for _, a in wanted if a in QUANTILES})
        if qs and (exact_inline or cfg.approx):
            builder = F.percentile_approx if cfg.approx else F.percentile
            aggs[f"_q{pos}"] = builder(v, qs)
        for name, agg in wanted:
            if agg in QUANTILES:
                reads[name] = F.col(f"_q{pos}")[qs.index(QUANTILES[agg])].cast("double")
            elif agg == "count":
                reads[name] = F.when(n > 0, n.cast("double"))
            elif agg == "rate":
                reads[name] = F.when(n > 0, n / F.lit(cfg.size_seconds))
            elif agg in ("std", "stddev"):
                aggs[f"_sd{pos}"] = F.stddev_samp(v)
                reads[name] = F.when(n > 0, F.coalesce(F.col(f"_sd{pos}"), F.lit(0.0)))
            else:
                build = {
                    "mean": F.avg,
                    "min": F.min,
                    "max": F.max,
                    "sum": F.sum,
                    "first": lambda c, k=key: F.min_by(c, k),
                    "last": lambda c, k=key: F.max_by(c, k),
                }[agg]
                aggs[f"_{agg}{pos}"] = build(v)
                reads[name] = F.col(f"_{agg}{pos}")
    return [c.alias(a) for a, c in aggs.items()], reads


def window_aggregates(assigned: DataFrame, keys: Sequence[str], cfg: FeatureConfig, sliced: bool = False) -> DataFrame:
    """All features in one groupBy (partial aggregation before the shuffle).

    With ``sliced`` the quantile features come from distributed ranking instead of
    one buffer per (window, metric).
    """
    group = [*keys, "window_index"]
    aggs, reads = _metric_aggregates(cfg, exact_inline=not sliced)
    wide = assigned.groupBy(*group).agg(F.count(F.lit(1)).alias("sample_count"), *aggs)
    if sliced and not cfg.approx:
        metrics = sorted({m for _, m, _ in cfg.parsed()})
        for pos, metric in enumerate(metrics):
            qs = sorted({QUANTILES[a] for _, m, a in cfg.parsed() if m == metric and a in QUANTILES})
            if qs:
                ranked = sliced_quantiles(assigned.where(F.col("metric_name") == metric), group, "value", qs, f"_q{pos}")
                wide = wide.join(ranked, group, "left")
    return wide.select(*group, "sample_count", *[reads[name].alias(name) for name in cfg.columns])


def fill_grid(windows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add the empty windows between the first and the last window of each series.

    The last window index of a series is the one its latest event falls in, so the
    gaps are exactly the holes between neighbouring rows.  Holes are expanded in two
    steps to keep every generated array small.
    """
    w = Window.partitionBy(*keys).orderBy("window_index")
    nxt = F.coalesce(F.lead("window_index").over(w) - 1, F.col("window_index"))
    chunked = windows.withColumn("_last", nxt).withColumn(
        "_chunk", F.explode(F.sequence(F.col("window_index"), F.col("_last"), F.lit(_GAP_CHUNK).cast("bigint")))
    )
    upto = F.least(F.col("_last"), F.col("_chunk") + (_GAP_CHUNK - 1))
    expanded = chunked.withColumn("_idx", F.explode(F.sequence(F.col("_chunk"), upto)))
    real = F.col("_idx") == F.col("window_index")
    return expanded.select(
        *keys,
        F.col("_idx").alias("window_index"),
        F.when(real, F.col("sample_count")).otherwise(F.lit(0)).cast("bigint").alias("sample_count"),
        *[F.when(real, F.col(c)).alias(c) for c in columns],
    )


def _fill_value(column: str, strategy: str, keys: Sequence[str]) -> Column:
    past = Window.partitionBy(*keys).orderBy("window_index").rowsBetween(Window.unboundedPreceding, 0)
    if strategy == "zero_fill":
        return F.lit(0.0)
    if strategy == "forward_fill":
        return F.coalesce(F.last(column, ignorenulls=True).over(past), F.lit(0.0))
    if strategy == "mean_fill":
        return F.avg(column).over(past)
    if strategy == "median_fill":
        return F.col(f"{column}__q0")
    ahead = Window.partitionBy(*keys).orderBy("window_index").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(column).isNotNull(), F.col("window_index"))
    v0, i0 = F.last(column, ignorenulls=True).over(past), F.last(at, ignorenulls=True).over(past)
    v1, i1 = F.first(column, ignorenulls=True).over(ahead), F.first(at, ignorenulls=True).over(ahead)
    return v0 + (v1 - v0) * (F.col("window_index") - i0) / (i1 - i0)


def impute(windows: DataFrame, keys: Sequence[str], cfg: FeatureConfig) -> DataFrame:
    """Fill missing features; adds ``imputed_features`` and ``missing_features``.

    forward_fill carries the previous window's value, imputed ones included, and
    falls back to 0.0; that equals the last measured value so far or 0.0.
    mean_fill, median_fill and linear_interpolate leave a feature missing when no
    measured value supports them.  ``none`` never writes a number.
    """
    cols = cfg.columns
    if cfg.imputation == "none":
        filled = windows.select("*", *[F.col(c).alias(f"_f_{c}") for c in cols])
    else:
        if cfg.imputation == "median_fill":
            windows = prefix_quantiles(windows, keys, {c: F.col(c) for c in cols}, (0.5,))
        fills = [F.coalesce(F.col(c), _fill_value(c, cfg.imputation, keys)).alias(f"_f_{c}") for c in cols]
        filled = windows.select("*", *fills)

    def names(test):
        picked = [F.when(test(c), F.lit(c)) for c in cols]
        return F.filter(F.array(*picked), lambda x: x.isNotNull())

    was_missing = names(lambda c: F.col(c).isNull())
    still = names(lambda c: F.col(f"_f_{c}").isNull())
    done = names(lambda c: F.col(c).isNull() & F.col(f"_f_{c}").isNotNull())
    kept = [c for c in windows.columns if c not in cols and c not in [f"{x}__q0" for x in cols]]
    return filled.select(
        *kept,
        *[F.col(f"_f_{c}").alias(c) for c in cols],
        F.size(was_missing).alias("_was_missing"),
        done.alias("imputed_features"),
        still.alias("missing_features"),
    )


def window_status(windows: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Adds is_warmup, is_imputed and status from sample_count and the missing lists."""
    warm = F.col("window_index") < cfg.warm_up_windows
    resolved = (F.col("_was_missing") > 0) & (F.size("missing_features") == 0)
    status = (
        F.when(resolved, F.when(warm, "warmup").otherwise("imputed"))
        .when(F.col("sample_count") == 0, "empty")
        .when((F.col("sample_count") < cfg.min_samples) | (F.col("_was_missing") > 0), "insufficient_data")
        .when(warm, "warmup")
        .otherwise("complete")
    )
    return (
        windows.withColumn("is_warmup", warm)
        .withColumn("is_imputed", F.size("imputed_features") > 0)
        .withColumn("status", status)
        .drop("_was_missing")
    )


def extract(obs: DataFrame, cfg: FeatureConfig, series_keys: Sequence[str] = SERIES_KEYS, dedupe: bool = True) -> DataFrame:
    """Feature windows of every series, gap-free, imputed and with a status.

    One shuffle dedupes, one aggregates, one orders the windows of a series.  The
    series profile (anchor and size) is materialised first: it decides whether the
    anchors can be broadcast and whether any series is large enough to need
    distributed quantiles; only those series take that path.
    """
    keys = list(series_keys)
    profile = materialise(series_profile(obs, keys))
    series, largest = profile.agg(F.count(F.lit(1)), F.max("series_rows")).first()
    clean = dedupe_observations(obs) if dedupe else obs
    assigned = assign_windows(clean, profile, keys, cfg.size_us, cfg.step_us, series)
    has_quantile = any(a in QUANTILES for _, _, a in cfg.parsed())
    if has_quantile and not cfg.approx and (largest or 0) > cfg.hot_rows:
        # At most total/hot_rows series are hot, so their list is tiny.
        small = F.broadcast(profile.where(F.col("series_rows") > cfg.hot_rows).select(*keys))
        windows = window_aggregates(assigned.join(small, keys, "left_anti"), keys, cfg).unionByName(
            window_aggregates(assigned.join(small, keys, "left_semi"), keys, cfg, sliced=True)
        )
    else:
        windows = window_aggregates(assigned, keys, cfg)
    grid = fill_grid(windows, keys, cfg.columns)
    graded = window_status(impute(grid, keys, cfg), cfg)
    return _with_times(lookup_join(graded, profile.select(*keys, "origin_us"), keys, ["window_index"], rows=series), cfg)


def _with_times(windows: DataFrame, cfg: FeatureConfig) -> DataFrame:
    start = F.col("origin_us") + F.col("window_index") * F.lit(cfg.step_us)
    shift = {"start": 0, "center": cfg.size_us // 2, "end": cfg.size_us}[cfg.alignment]
    return (
        windows.withColumn("window_start", F.timestamp_micros(start))
        .withColumn("window_end", F.timestamp_micros(start + cfg.size_us))
        .withColumn("observation_timestamp", F.timestamp_micros(start + shift))
        .drop("origin_us")
    )


def provenance(obs: DataFrame, cfg: FeatureConfig, series_keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Source events behind each window as a table: (series, window_index, event_id, metric_name).

    A table instead of an array column: the ids of a hot window never meet in one row.
    """
    keys = list(series_keys)
    profile = materialise(series_profile(obs, keys))
    assigned = assign_windows(dedupe_observations(obs), profile, keys, cfg.size_us, cfg.step_us)
    return assigned.select(*keys, "window_index", "event_id", "metric_name")


def sample_counts(members: DataFrame, series_keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Raw samples per (series, window, metric) from the provenance table."""
    return members.groupBy(*series_keys, "window_index", "metric_name").agg(F.count(F.lit(1)).alias("samples"))


def source_event_counts(members: DataFrame, series_keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Distinct source events per window.  Distinct first, so a hot window is spread by event id."""
    ids = members.select(*series_keys, "window_index", "event_id").distinct()
    return ids.groupBy(*series_keys, "window_index").agg(F.count(F.lit(1)).alias("source_event_count"))


def summarise(windows: DataFrame, series_keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Total, valid, warm-up, imputed and empty windows per series."""
    valid = F.col("status").isin("complete", "imputed", "warmup") & (F.size("missing_features") == 0)
    return windows.groupBy(*series_keys).agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.count_if(valid).alias("valid_windows"),
        F.count_if("is_warmup").alias("warmup_windows"),
        F.count_if("is_imputed").alias("imputed_windows"),
        F.count_if(F.col("status") == "empty").alias("empty_windows"),
    )


def to_series(windows: DataFrame, target: str, regressors: Sequence[str] = (), allow_incomplete: bool = False) -> DataFrame:
    """Forecast export: ds, y, is_missing and the regressors.

    A missing target fails the job unless ``allow_incomplete``; then y stays null.
    """
    missing = F.col(target).isNull()
    y = F.col(target)
    if not allow_incomplete:
        y = F.when(missing, F.raise_error(F.lit(f"missing target feature {target}")).cast("double")).otherwise(y)
    rest = [c for c in windows.columns if c not in (target, *regressors)]
    return windows.select(
        *rest, F.col("observation_timestamp").alias("ds"), y.alias("y"), missing.alias("is_missing"), *regressors
    )


def to_matrix(windows: DataFrame, columns: Sequence[str], allow_incomplete: bool = False) -> DataFrame:
    """Adds ``vector ARRAY<DOUBLE>`` in the order of ``columns``.

    A row with a missing feature fails the job, or is left out with ``allow_incomplete``.
    """
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    vector = F.array(*columns)
    if allow_incomplete:
        return windows.where(complete).withColumn("vector", vector)
    failed = F.raise_error(F.lit(f"incomplete feature vector {list(columns)}")).cast("array<double>")
    return windows.withColumn("vector", F.when(complete, vector).otherwise(failed))


def to_sequences(matrix: DataFrame, length: int, series_keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Rolling sequences of ``length`` vectors over the kept rows: n-length+1 per series."""
    if length <= 0:
        raise ValueError("sequence length must be positive")
    w = Window.partitionBy(*series_keys).orderBy("window_index").rowsBetween(-(length - 1), 0)
    rolled = matrix.withColumn("sequence", F.collect_list("vector").over(w)).withColumn(
        "first_window_index", F.min("window_index").over(w)
    )
    return rolled.where(F.size("sequence") == length)
