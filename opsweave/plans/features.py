"""Queries over windowed features."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.operators import features as W
from opsweave.plans.inputs import load
from opsweave.plans.registry import query, round6

H = 3600
FLAGSHIP = W.FeatureConfig(
    features=("latency_ms:mean", "latency_ms:p95", "latency_ms:std", "requests_total:rate"),
    size_seconds=6 * H,
    step_seconds=3 * H,
    warm_up_windows=2,
)
FULL = ("tenant_id", "environment", "service", "run_id")


def _agg_sql(metric: str, agg: str, size_s: float) -> str:
    f = f"FILTER (WHERE o.metric_name = '{metric}')"
    n = f"count(o.value) {f}"
    quant = W.QUANTILES.get(agg)
    if quant is not None:
        return f"quantile_cont(o.value, {quant}) {f}"
    return {
        "mean": f"avg(o.value) {f}",
        "min": f"min(o.value) {f}",
        "max": f"max(o.value) {f}",
        "sum": f"sum(o.value) {f}",
        "count": f"CASE WHEN {n} > 0 THEN CAST({n} AS DOUBLE) END",
        "rate": f"CASE WHEN {n} > 0 THEN CAST({n} AS DOUBLE) / {float(size_s)} END",
        "std": f"CASE WHEN {n} > 0 THEN coalesce(stddev_samp(o.value) {f}, 0.0) END",
        "first": f"arg_min(o.value, {{'t': o.event_time, 'e': CAST(o.event_id AS VARCHAR)}}) {f}",
        "last": f"arg_max(o.value, {{'t': o.event_time, 'e': CAST(o.event_id AS VARCHAR)}}) {f}",
    }[agg]


def windows_sql(cfg: W.FeatureConfig, keys, source: str = "observations") -> str:
    """CTEs ``prof``, ``grid`` and ``agg``: the gap-free windows with raw features."""
    k = ", ".join(keys)
    gk = ", ".join(f"g.{c}" for c in keys)
    on = " AND ".join(f"o.{c} = g.{c}" for c in keys)
    feats = ",\n  ".join(f"{_agg_sql(m, a, cfg.size_seconds)} AS {name}" for name, m, a in cfg.parsed())
    return f"""prof AS (SELECT {k}, min(epoch_us(event_time)) AS origin_us, max(epoch_us(event_time)) AS last_us
  FROM {source} GROUP BY {k}),
grid AS (SELECT {k}, origin_us, unnest(range(0, (last_us - origin_us) // {cfg.step_us} + 1)) AS window_index FROM prof),
agg AS (SELECT {gk}, g.window_index, g.origin_us, count(o.event_id) AS sample_count,
  {feats}
  FROM grid g LEFT JOIN {source} o ON {on}
   AND epoch_us(o.event_time) >= g.origin_us + g.window_index * {cfg.step_us}
   AND epoch_us(o.event_time) < g.origin_us + g.window_index * {cfg.step_us} + {cfg.size_us}
  GROUP BY {gk}, g.window_index, g.origin_us)"""


def _filled_sql(cfg, keys):
    k = ", ".join(keys)
    w = f"OVER (PARTITION BY {k} ORDER BY window_index ROWS UNBOUNDED PRECEDING)"
    fills = ",\n  ".join(
        f"coalesce({c}, coalesce(last_value({c} IGNORE NULLS) {w}, 0.0)) AS {c}, {c} IS NULL AS m_{c}" for c in cfg.columns
    )
    return f"filled AS (SELECT {k}, window_index, origin_us, sample_count, {fills} FROM agg)"


def _status_sql(cfg, resolved: bool = True) -> str:
    missing = " OR ".join(f"m_{c}" for c in cfg.columns)
    fill = f"WHEN ({missing}) THEN CASE WHEN window_index < {cfg.warm_up_windows} THEN 'warmup' ELSE 'imputed' END" if resolved else ""
    return f"""CASE {fill} WHEN sample_count = 0 THEN 'empty'
  WHEN sample_count < {cfg.min_samples} OR ({missing}) THEN 'insufficient_data'
  WHEN window_index < {cfg.warm_up_windows} THEN 'warmup' ELSE 'complete' END"""


def _rounded(cols) -> str:
    return ", ".join(f"r6({c}) AS {c}" for c in cols)


def _round(df, cols):
    return [round6(c).alias(c) for c in cols]


@query(
    "flagship_feature_windows",
    f"""WITH {windows_sql(FLAGSHIP, ("service",))},
{_filled_sql(FLAGSHIP, ("service",))}
SELECT service, window_index, origin_us + window_index * {FLAGSHIP.step_us} AS window_start_us, sample_count,
  {_rounded(FLAGSHIP.columns)}, window_index < 2 AS is_warmup, {_status_sql(FLAGSHIP)} AS status FROM filled""",
    ("observations",),
)
def flagship(spark, folder):
    windows = W.extract(load(spark, folder, "observations"), FLAGSHIP, ("service",))
    return windows.select(
        "service",
        "window_index",
        F.unix_micros("window_start").alias("window_start_us"),
        "sample_count",
        *_round(windows, FLAGSHIP.columns),
        "is_warmup",
        "status",
    )


COPIES = """copies AS (SELECT * FROM observations UNION ALL
  SELECT event_id, event_time + INTERVAL 1 HOUR AS event_time, tenant_id, environment, service, metric_name, value + 1 AS value, run_id, seed FROM observations)"""


def _copies(obs):
    later = obs.withColumn("event_time", F.expr("event_time + INTERVAL 1 HOUR")).withColumn("value", F.col("value") + 1)
    return obs.unionByName(later)


@query(
    "W1_dedupe_observations",
    f"""WITH {COPIES},
r AS (SELECT *, row_number() OVER (PARTITION BY event_id, metric_name ORDER BY event_time, value) AS rn FROM copies)
SELECT event_id, metric_name, epoch_us(event_time) AS event_us, r6(value) AS value FROM r WHERE rn = 1""",
    ("observations",),
)
def dedupe(spark, folder):
    kept = W.dedupe_observations(_copies(load(spark, folder, "observations")))
    return kept.select(
        "event_id", "metric_name", F.unix_micros("event_time").alias("event_us"), round6("value").alias("value")
    )


SLIDING = W.FeatureConfig(("latency_ms:mean",), 6 * H, 2 * H, imputation="none")


@query(
    "W2_assign_windows",
    f"""WITH {windows_sql(SLIDING, FULL)}
SELECT o.event_id, g.window_index FROM grid g JOIN observations o ON o.tenant_id = g.tenant_id
  AND o.environment = g.environment AND o.service = g.service AND o.run_id = g.run_id
  AND epoch_us(o.event_time) >= g.origin_us + g.window_index * {SLIDING.step_us}
  AND epoch_us(o.event_time) < g.origin_us + g.window_index * {SLIDING.step_us} + {SLIDING.size_us}""",
    ("observations",),
)
def assign(spark, folder):
    obs = load(spark, folder, "observations")
    profile = W.materialise(W.series_profile(obs, FULL))
    return W.assign_windows(obs, profile, FULL, SLIDING.size_us, SLIDING.step_us).select("event_id", "window_index")


@query(
    "W3_gap_free_grid",
    f"""WITH {windows_sql(SLIDING, FULL)}
SELECT {", ".join(FULL)}, window_index, sample_count FROM agg""",
    ("observations",),
)
def grid(spark, folder):
    return W.extract(load(spark, folder, "observations"), SLIDING, FULL).select(*FULL, "window_index", "sample_count")


PIVOT = W.FeatureConfig(
    ("latency_ms", "latency_ms:max", "requests_total:sum", "requests_total:count"),
    12 * H,
    12 * H,
    aggregation_methods=("mean", "p95"),
    imputation="none",
)


@query(
    "W4_feature_pivot",
    f"""WITH {windows_sql(PIVOT, FULL)}
SELECT {", ".join(FULL)}, window_index, {_rounded(PIVOT.columns)} FROM agg""",
    ("observations",),
)
def pivot(spark, folder):
    windows = W.extract(load(spark, folder, "observations"), PIVOT, FULL)
    return windows.select(*FULL, "window_index", *_round(windows, PIVOT.columns))


EVERY = W.FeatureConfig(
    tuple(f"latency_ms:{a}" for a in W.AGGREGATES if a not in ("median", "stddev")), 24 * H, 12 * H, imputation="none"
)


@query(
    "W5_window_aggregates",
    f"""WITH {windows_sql(EVERY, ("service", "environment"))}
SELECT service, environment, window_index, {_rounded(EVERY.columns)} FROM agg""",
    ("observations",),
)
def aggregates(spark, folder):
    windows = W.extract(load(spark, folder, "observations"), EVERY, ("service", "environment"))
    return windows.select("service", "environment", "window_index", *_round(windows, EVERY.columns))


@query(
    "W5_sliced_quantiles",
    """SELECT service, metric_name, r6(quantile_cont(value, 0.5)) AS p50, r6(quantile_cont(value, 0.9)) AS p90,
  r6(quantile_cont(value, 0.99)) AS p99 FROM observations GROUP BY service, metric_name""",
    ("observations",),
)
def sliced(spark, folder):
    q = W.sliced_quantiles(load(spark, folder, "observations"), ["service", "metric_name"], "value", [0.5, 0.9, 0.99])
    return q.select("service", "metric_name", *[round6(F.col("quantiles")[i]).alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


def _fill_cfg(strategy: str) -> W.FeatureConfig:
    return W.FeatureConfig(("latency_ms:mean", "requests_total:sum"), 6 * H, 6 * H, imputation=strategy, warm_up_windows=1, min_samples=2)


FILL_KEYS = ("environment", "service", "run_id")
_FILL_W = "OVER (PARTITION BY environment, service, run_id ORDER BY window_index ROWS UNBOUNDED PRECEDING)"
_FILL_A = "OVER (PARTITION BY environment, service, run_id ORDER BY window_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _fill_expr(strategy: str, c: str) -> str:
    if strategy == "forward_fill":
        return f"coalesce({c}, last_value({c} IGNORE NULLS) {_FILL_W}, 0.0)"
    if strategy == "zero_fill":
        return f"coalesce({c}, 0.0)"
    if strategy == "none":
        return c
    if strategy == "mean_fill":
        return f"coalesce({c}, avg({c}) {_FILL_W})"
    if strategy == "median_fill":
        return f"coalesce({c}, quantile_cont({c}, 0.5) {_FILL_W})"
    at = f"CASE WHEN {c} IS NOT NULL THEN window_index END"
    v0, i0 = f"last_value({c} IGNORE NULLS) {_FILL_W}", f"last_value({at} IGNORE NULLS) {_FILL_W}"
    v1, i1 = f"first_value({c} IGNORE NULLS) {_FILL_A}", f"first_value({at} IGNORE NULLS) {_FILL_A}"
    return f"coalesce({c}, {v0} + ({v1} - {v0}) * (window_index - {i0}) / ({i1} - {i0}))"


def _fill_query(strategy: str) -> str:
    cfg = _fill_cfg(strategy)
    cols = ",\n  ".join(f"r6({_fill_expr(strategy, c)}) AS {c}" for c in cfg.columns)
    return f"""WITH {windows_sql(cfg, FILL_KEYS)}
SELECT environment, service, run_id, window_index, {cols} FROM agg"""


def _register_fill(strategy: str, name: str) -> None:
    @query(name, _fill_query(strategy), ("observations",))
    def run(spark, folder):
        cfg = _fill_cfg(strategy)
        windows = W.extract(load(spark, folder, "observations"), cfg, FILL_KEYS)
        return windows.select(*FILL_KEYS, "window_index", *_round(windows, cfg.columns))


for _strategy, _name in (
    ("forward_fill", "W6_impute_forward_fill"),
    ("zero_fill", "W6_impute_zero_fill"),
    ("none", "W6_impute_none"),
    ("mean_fill", "W6b_impute_mean"),
    ("median_fill", "W6b_impute_median"),
    ("linear_interpolate", "W6b_impute_linear"),
):
    _register_fill(_strategy, _name)


def _status_query(strategy: str) -> str:
    cfg = _fill_cfg(strategy)
    missing = ", ".join(f"{c} IS NULL AS m_{c}" for c in cfg.columns)
    resolved = strategy == "forward_fill"
    return f"""WITH {windows_sql(cfg, FILL_KEYS)},
flags AS (SELECT environment, service, run_id, window_index, sample_count, {missing} FROM agg)
SELECT environment, service, run_id, window_index, {_status_sql(cfg, resolved)} AS status,
  window_index < 1 AS is_warmup,
  {"(" + " OR ".join(f"m_{c}" for c in cfg.columns) + ")" if resolved else "false"} AS is_imputed FROM flags"""


def _status_plan(strategy):
    def run(spark, folder):
        windows = W.extract(load(spark, folder, "observations"), _fill_cfg(strategy), FILL_KEYS)
        return windows.select(*FILL_KEYS, "window_index", "status", "is_warmup", "is_imputed")

    return run


query("W7_window_status_filled", _status_query("forward_fill"), ("observations",))(_status_plan("forward_fill"))
query("W7_window_status_unfilled", _status_query("none"), ("observations",))(_status_plan("none"))


@query(
    "W8_provenance_counts",
    f"""WITH {windows_sql(SLIDING, FULL)}
SELECT o.tenant_id, o.environment, o.service, o.run_id, g.window_index, o.metric_name, count(*) AS samples
FROM grid g JOIN observations o ON o.tenant_id = g.tenant_id
  AND o.environment = g.environment AND o.service = g.service AND o.run_id = g.run_id
  AND epoch_us(o.event_time) >= g.origin_us + g.window_index * {SLIDING.step_us}
  AND epoch_us(o.event_time) < g.origin_us + g.window_index * {SLIDING.step_us} + {SLIDING.size_us}
GROUP BY ALL""",
    ("observations",),
)
def provenance(spark, folder):
    return W.sample_counts(W.provenance(load(spark, folder, "observations"), SLIDING, FULL), FULL)


@query(
    "W8_source_events",
    f"""WITH {windows_sql(SLIDING, ("service",))}
SELECT g.service, g.window_index, count(DISTINCT o.event_id) AS source_event_count
FROM grid g JOIN observations o ON o.service = g.service
  AND epoch_us(o.event_time) >= g.origin_us + g.window_index * {SLIDING.step_us}
  AND epoch_us(o.event_time) < g.origin_us + g.window_index * {SLIDING.step_us} + {SLIDING.size_us}
GROUP BY ALL""",
    ("observations",),
)
def source_events(spark, folder):
    members = W.provenance(load(spark, folder, "observations"), SLIDING, ("service",))
    return W.source_event_counts(members, ("service",))


_SUMMARY = _fill_cfg("forward_fill")


@query(
    "W9_extraction_summary",
    f"""WITH {windows_sql(_SUMMARY, FILL_KEYS)},
flags AS (SELECT environment, service, run_id, window_index, sample_count,
  {", ".join(f"{c} IS NULL AS m_{c}" for c in _SUMMARY.columns)} FROM agg),
s AS (SELECT *, {_status_sql(_SUMMARY)} AS status FROM flags)
SELECT environment, service, run_id, count(*) AS total_windows,
  count(*) FILTER (WHERE status IN ('complete', 'imputed', 'warmup')) AS valid_windows,
  count(*) FILTER (WHERE window_index < 1) AS warmup_windows,
  count(*) FILTER (WHERE {" OR ".join(f"m_{c}" for c in _SUMMARY.columns)}) AS imputed_windows,
  count(*) FILTER (WHERE status = 'empty') AS empty_windows
FROM s GROUP BY environment, service, run_id""",
    ("observations",),
)
def summary(spark, folder):
    return W.summarise(W.extract(load(spark, folder, "observations"), _SUMMARY, FILL_KEYS), FILL_KEYS)


EXPORT = W.FeatureConfig(("latency_ms:mean", "requests_total:mean"), 6 * H, 6 * H, imputation="none")


@query(
    "W10_series_export",
    f"""WITH {windows_sql(EXPORT, FILL_KEYS)}
SELECT environment, service, run_id, window_index, origin_us + window_index * {EXPORT.step_us} + {EXPORT.size_us} AS ds_us,
  r6(latency_ms__mean) AS y, latency_ms__mean IS NULL AS is_missing,
  r6(requests_total__mean) AS requests_total__mean FROM agg""",
    ("observations",),
)
def series_export(spark, folder):
    windows = W.extract(load(spark, folder, "observations"), EXPORT, FILL_KEYS)
    out = W.to_series(windows, "latency_ms__mean", ["requests_total__mean"], allow_incomplete=True)
    return out.select(
        *FILL_KEYS,
        "window_index",
        F.unix_micros("ds").alias("ds_us"),
        round6("y").alias("y"),
        "is_missing",
        round6("requests_total__mean").alias("requests_total__mean"),
    )


_KEPT = f"""WITH {windows_sql(EXPORT, FILL_KEYS)},
kept AS (SELECT * FROM agg WHERE latency_ms__mean IS NOT NULL AND requests_total__mean IS NOT NULL)"""


@query(
    "W10_matrix_export",
    f"""{_KEPT}
SELECT environment, service, run_id, window_index, r6(latency_ms__mean) AS v0, r6(requests_total__mean) AS v1 FROM kept""",
    ("observations",),
)
def matrix_export(spark, folder):
    windows = W.extract(load(spark, folder, "observations"), EXPORT, FILL_KEYS)
    out = W.to_matrix(windows, EXPORT.columns, allow_incomplete=True)
    return out.select(*FILL_KEYS, "window_index", *[round6(F.col("vector")[i]).alias(f"v{i}") for i in (0, 1)])


@query(
    "W10_sequence_export",
    f"""{_KEPT},
r AS (SELECT *, count(*) OVER w AS n, min(window_index) OVER w AS first_window_index,
  sum(latency_ms__mean) OVER w AS s0, first_value(requests_total__mean) OVER w AS f1 FROM kept
  WINDOW w AS (PARTITION BY environment, service, run_id ORDER BY window_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT environment, service, run_id, first_window_index, window_index AS last_window_index,
  r6(s0) AS sum_v0, r6(f1) AS first_v1 FROM r WHERE n = 4""",
    ("observations",),
)
def sequence_export(spark, folder):
    windows = W.extract(load(spark, folder, "observations"), EXPORT, FILL_KEYS)
    seq = W.to_sequences(W.to_matrix(windows, EXPORT.columns, allow_incomplete=True), 4, FILL_KEYS)
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, v: acc + v[0])
    return seq.select(
        *FILL_KEYS,
        "first_window_index",
        F.col("window_index").alias("last_window_index"),
        round6(total).alias("sum_v0"),
        round6(F.col("sequence")[0][1]).alias("first_v1"),
    )


MERGED = W.FeatureConfig(("latency_ms:mean", "requests_total:p90"), 12 * H, 6 * H, imputation="zero_fill")


@query(
    "W11_merged_series",
    f"""WITH {windows_sql(MERGED, ("run_id",))}
SELECT run_id, window_index, sample_count, {", ".join(f"r6(coalesce({c}, 0.0)) AS {c}" for c in MERGED.columns)} FROM agg""",
    ("observations",),
)
def merged(spark, folder):
    windows = W.extract(load(spark, folder, "observations"), MERGED, ("run_id",))
    return windows.select("run_id", "window_index", "sample_count", *_round(windows, MERGED.columns))
