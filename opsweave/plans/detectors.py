"""Queries over the detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.functions.identity import SIGNAL_NAMESPACE
from opsweave.operators import causal, detectors as D, features as W, forest, reconstruct
from opsweave.plans.features import H, windows_sql
from opsweave.plans.inputs import load
from opsweave.plans.registry import query, round6

KEYS = ("environment", "service")
BASE = W.FeatureConfig(("latency_ms:mean", "requests_total:mean"), 6 * H, 6 * H, imputation="none")
TARGET, OTHER = BASE.columns
FRAME = "OVER (PARTITION BY environment, service ORDER BY window_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _windows(spark, folder):
    return W.extract(load(spark, folder, "observations"), BASE, KEYS)


def _forecast(spark, folder, **kw):
    return D.forecast_residual(_windows(spark, folder), D.ForecastConfig(TARGET, **kw), KEYS)


def forecast_sql(growth: str, min_history: int = 10, z: float = D.NORMAL_QUANTILE[0.95]) -> str:
    """CTEs up to ``scored``: the forecast detector in SQL."""
    linear = growth == "linear"
    fit = (
        """CASE WHEN sxx > 0 THEN my + sxy / sxx * (window_index - mx) ELSE my END AS expected,
  CASE WHEN n > 2 THEN sqrt(greatest(syy - CASE WHEN sxx > 0 THEN sxy * sxy / sxx ELSE 0 END, 0) / (n - 2)) ELSE 0 END AS sd"""
        if linear
        else "my AS expected, coalesce(hist, 0) AS sd"
    )
    return f"""{windows_sql(BASE, KEYS)},
h AS (SELECT environment, service, window_index, origin_us, {TARGET} AS y, {OTHER} AS y2,
  count({TARGET}) {FRAME} AS n, stddev_samp({TARGET}) {FRAME} AS hist, avg({TARGET}) {FRAME} AS my,
  avg(CASE WHEN {TARGET} IS NOT NULL THEN CAST(window_index AS DOUBLE) END) {FRAME} AS mx,
  regr_sxx({TARGET}, CAST(window_index AS DOUBLE)) {FRAME} AS sxx,
  regr_syy({TARGET}, CAST(window_index AS DOUBLE)) {FRAME} AS syy,
  regr_sxy({TARGET}, CAST(window_index AS DOUBLE)) {FRAME} AS sxy FROM agg),
f AS (SELECT *, {fit} FROM h),
b AS (SELECT *, expected - {z!r} * sd AS lower, expected + {z!r} * sd AS upper,
  CASE WHEN y IS NULL THEN 'missing_target_value' WHEN n < {min_history} THEN 'insufficient_history' ELSE 'success' END AS status FROM f),
scored AS (SELECT *, CASE WHEN status = 'success' THEN CASE WHEN y = expected THEN 0.0 ELSE
  1 - exp(-(abs(y - expected) / greatest(greatest(upper - expected, expected - lower, 0.0), coalesce(hist, 0), 0.01 * greatest(abs(expected), 1.0), 0.0001)) / 3.0) END END AS anomaly_score FROM b)"""


_FORECAST_OUT = """SELECT environment, service, window_index, n AS history_windows, status,
  CASE WHEN status = 'success' THEN r6(expected) END AS expected,
  CASE WHEN status = 'success' THEN r6(lower) END AS lower,
  CASE WHEN status = 'success' THEN r6(upper) END AS upper,
  CASE WHEN status = 'success' THEN r6(y - expected) END AS residual FROM scored"""


def _forecast_out(df):
    return df.select(
        *KEYS, "window_index", "history_windows", "status", *[round6(F.col(c)).alias(c) for c in ("expected", "lower", "upper", "residual")]
    )


@query("D1_forecast_linear", f"WITH {forecast_sql('linear')}\n{_FORECAST_OUT}", ("observations",))
def forecast_linear(spark, folder):
    return _forecast_out(_forecast(spark, folder))


@query("D1_forecast_flat", f"WITH {forecast_sql('flat')}\n{_FORECAST_OUT}", ("observations",))
def forecast_flat(spark, folder):
    return _forecast_out(_forecast(spark, folder, growth="flat"))


def _moment(fn: str, *cells: str) -> str:
    ready = f"{TARGET} IS NOT NULL AND {OTHER} IS NOT NULL"
    return f"{fn}({', '.join(f'CASE WHEN {ready} THEN {c} END' for c in cells)}) {FRAME}"


_T = "CAST(window_index AS DOUBLE)"
# Window number and one regressor: the two centred normal equations by Cramer's rule.
REGRESSOR_SQL = f"""WITH {windows_sql(BASE, KEYS)},
h AS (SELECT environment, service, window_index, {TARGET} AS y, {OTHER} AS r, {_moment("count", TARGET)} AS n, {_moment("avg", TARGET)} AS my, {_moment("avg", _T)} AS mt, {_moment("avg", OTHER)} AS mr,
  {_moment("covar_pop", _T, _T)} AS stt, {_moment("covar_pop", OTHER, OTHER)} AS srr, {_moment("covar_pop", _T, OTHER)} AS s_tr, {_moment("covar_pop", _T, TARGET)} AS sty,
  {_moment("covar_pop", OTHER, TARGET)} AS sry, {_moment("var_pop", TARGET)} AS syy FROM agg),
b AS (SELECT *, (srr * sty - s_tr * sry) / (stt * srr - s_tr * s_tr) AS bt, (stt * sry - s_tr * sty) / (stt * srr - s_tr * s_tr) AS br FROM h),
f AS (SELECT *, my + bt * (window_index - mt) + br * (r - mr) AS expected, sqrt(greatest(n * (syy - bt * sty - br * sry), 0) / (n - 3)) AS sd FROM b WHERE n > 3),
scored AS (SELECT h.environment, h.service, h.window_index, h.y, h.n, f.expected, f.expected - {D.NORMAL_QUANTILE[0.95]!r} * f.sd AS lower, f.expected + {D.NORMAL_QUANTILE[0.95]!r} * f.sd AS upper,
  CASE WHEN h.y IS NULL OR h.r IS NULL THEN 'missing_target_value' WHEN h.n < 10 THEN 'insufficient_history' ELSE 'success' END AS status
  FROM h LEFT JOIN f ON f.environment = h.environment AND f.service = h.service AND f.window_index = h.window_index)
{_FORECAST_OUT}"""


@query("D1_forecast_regressors", REGRESSOR_SQL, ("observations",))
def forecast_regressors(spark, folder):
    return _forecast_out(_forecast(spark, folder, regressors=(OTHER,)))


@query(
    "D2_residual_score",
    f"""WITH {forecast_sql('linear')}
SELECT environment, service, window_index, r6(anomaly_score) AS anomaly_score FROM scored""",
    ("observations",),
)
def residual_score(spark, folder):
    return _forecast(spark, folder).select(*KEYS, "window_index", round6(F.col("anomaly_score")).alias("anomaly_score"))


_COMPLETE = f"{TARGET} IS NOT NULL AND {OTHER} IS NOT NULL"


def scale_sql(method: str) -> str:
    def cell(c: str) -> str:
        v = f"CASE WHEN {_COMPLETE} THEN {c} END"
        center, spread = {
            "standard": (f"avg({v}) {FRAME}", f"stddev_samp({v}) {FRAME}"),
            "robust": (f"quantile_cont({v}, 0.5) {FRAME}", f"quantile_cont({v}, 0.75) {FRAME} - quantile_cont({v}, 0.25) {FRAME}"),
            "minmax": (f"min({v}) {FRAME}", f"max({v}) {FRAME} - min({v}) {FRAME}"),
            "none": ("CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)"),
        }[method]
        return f"{center} AS c_{c}, {spread} AS s0_{c}"

    def out(c: str) -> str:
        s = f"CASE WHEN s0_{c} >= 1e-8 THEN s0_{c} ELSE CAST(1 AS DOUBLE) END"
        return f"r6(c_{c}) AS {c}__center, r6({s}) AS {c}__scale, r6(({c} - c_{c}) / {s}) AS {c}__scaled"

    return f"""WITH {windows_sql(BASE, KEYS)},
h AS (SELECT environment, service, window_index, {TARGET}, {OTHER}, {cell(TARGET)}, {cell(OTHER)} FROM agg)
SELECT environment, service, window_index, {out(TARGET)}, {out(OTHER)} FROM h"""


def _register_scaling(method: str) -> None:
    @query(f"D3_scale_{method}", scale_sql(method), ("observations",))
    def run(spark, folder):
        scaled = D.scale_features(_windows(spark, folder), BASE.columns, KEYS, method)
        cols = [f"{c}__{p}" for c in BASE.columns for p in ("center", "scale", "scaled")]
        return scaled.select(*KEYS, "window_index", *[round6(F.col(c).cast("double")).alias(c) for c in cols])


for _method in ("standard", "robust", "minmax", "none"):
    _register_scaling(_method)


def _vectors(spark, folder):
    emb = load(spark, folder, "embeddings")
    return emb.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


@query("D4_isolation_forest")
def isolation_forest(spark, folder):
    rows = _vectors(spark, folder).withColumn("model", F.lit("all"))
    model = forest.fit_forest(rows, ["model"], "vec_id")
    return forest.score_forest(rows, model, ["model"], "vec_id").select("vec_id", round6(F.col("raw_score")).alias("raw_score"))


SERVICE_FRAME = "OVER (PARTITION BY service ORDER BY window_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _causal(spark, folder, model):
    """100 trees or one component, a fit per window."""
    windows = W.extract(load(spark, folder, "observations"), BASE, ("service",))
    return causal.score_causal(windows, BASE.columns, ("service",), model)


@query("D4_isolation_forest_causal")
def isolation_forest_causal(spark, folder):
    scored = _causal(spark, folder, "isolation_forest")
    return scored.select("service", "window_index", "status", round6(F.col("anomaly_score")).alias("anomaly_score"), "severity")


@query(
    "D4_forest_windows",
    f"""WITH {windows_sql(BASE, ("service",))},
h AS (SELECT service, window_index, {_COMPLETE} AS complete, count(CASE WHEN {_COMPLETE} THEN 1 END) {SERVICE_FRAME} AS n FROM agg)
SELECT service, window_index, n AS history_windows, CASE WHEN NOT complete THEN 'missing_features' WHEN n < 10 THEN 'insufficient_history' ELSE 'success' END AS status,
  CASE WHEN complete AND n >= 10 THEN CAST(least(n, 256) AS INTEGER) END AS sample_size, CASE WHEN complete AND n >= 10 THEN true END AS in_range,
  CASE WHEN complete AND n >= 10 THEN true END AS offset_in_range FROM h""",
    ("observations",),
)
def forest_windows(spark, folder):
    """Each window's history, status and sample size, and that score and offset are raw scores."""
    scored = _causal(spark, folder, "isolation_forest")
    fitted = F.col("sample_size").isNotNull()
    within = lambda c: F.when(fitted, (F.col(c) >= -1) & (F.col(c) < 0))
    return scored.select(
        "service", "window_index", "history_windows", "status", "sample_size", within("raw_score").alias("in_range"), within("score_offset").alias("offset_in_range")
    )


@query("D5_reconstruction_error")
def reconstruction(spark, folder):
    rows = _vectors(spark, folder)
    model = reconstruct.fit_reconstruction(rows, ["label"], 64, bottleneck=4)
    out = reconstruct.reconstruction_error(rows, model, ["label"], "vec_id")
    return out.select("vec_id", round6(F.col("raw_score")).alias("raw_score"), F.size("squared_errors").alias("width"))


# Two features: the direction that one component drops has a closed form in the covariance.
RECONSTRUCTION_SQL = f"""WITH {windows_sql(BASE, ("service",))},
c AS (SELECT service, window_index, {TARGET} AS x, {OTHER} AS y, {_COMPLETE} AS complete FROM agg),
h AS (SELECT *, count(CASE WHEN complete THEN 1 END) {SERVICE_FRAME} AS n,
  avg(CASE WHEN complete THEN x END) {SERVICE_FRAME} AS mx, avg(CASE WHEN complete THEN y END) {SERVICE_FRAME} AS my,
  stddev_samp(CASE WHEN complete THEN x END) {SERVICE_FRAME} AS dx, stddev_samp(CASE WHEN complete THEN y END) {SERVICE_FRAME} AS dy,
  covar_samp(CASE WHEN complete THEN x END, CASE WHEN complete THEN y END) {SERVICE_FRAME} AS cxy FROM c),
s AS (SELECT *, CASE WHEN dx >= 1e-8 THEN dx ELSE 1.0 END AS sx, CASE WHEN dy >= 1e-8 THEN dy ELSE 1.0 END AS sy FROM h WHERE complete AND n >= 10),
d AS (SELECT *, cxy / sx / sy AS v, ((dx / sx) ** 2 - (dy / sy) ** 2) / 2 AS g FROM s),
m AS (SELECT *, v / sqrt(g * g + v * v) AS turn_v, g / sqrt(g * g + v * v) AS turn_g FROM d),
e AS (SELECT m.service, m.window_index, t.window_index AS i, m.turn_v, m.turn_g, (t.x - mx) / sx AS p, (t.y - my) / sy AS q
  FROM m JOIN c t ON t.service = m.service AND t.window_index <= m.window_index AND t.complete),
r AS (SELECT service, window_index, i, greatest(p * p + q * q - turn_g * (p * p - q * q) - turn_v * 2 * p * q, 0) / 4 AS err FROM e),
k AS (SELECT service, window_index, max(CASE WHEN i = window_index THEN err END) AS raw, min(CASE WHEN i < window_index THEN err END) AS lo,
  avg(CASE WHEN i < window_index THEN err END) AS mean, coalesce(stddev_samp(CASE WHEN i < window_index THEN err END), 0) AS sd FROM r GROUP BY service, window_index),
z AS (SELECT *, CASE WHEN raw <= lo THEN 0.0 WHEN raw <= mean THEN least(0.3, greatest(0.0, 0.3 * (raw - lo) / greatest(mean - lo, {D.RECONSTRUCTION_TAIL["floor"]})))
  ELSE least(1.0, 0.3 + 0.7 * (1 - exp(-(raw - mean) / greatest(sd * {D.RECONSTRUCTION_TAIL["scale_factor"]}, {D.RECONSTRUCTION_TAIL["epsilon"]})))) END AS score FROM k)
SELECT h.service, h.window_index, CASE WHEN NOT complete THEN 'missing_features' WHEN n < 10 THEN 'insufficient_history' ELSE 'success' END AS status,
  r6(score) AS anomaly_score, CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.75 THEN 'error' WHEN score >= 0.5 THEN 'warning' WHEN score IS NOT NULL THEN 'info' END AS severity
FROM h LEFT JOIN z ON z.service = h.service AND z.window_index = h.window_index"""


@query("D5_reconstruction_causal", RECONSTRUCTION_SQL, ("observations",))
def reconstruction_causal(spark, folder):
    scored = _causal(spark, folder, "reconstruction")
    return scored.select("service", "window_index", "status", round6(F.col("anomaly_score")).alias("anomaly_score"), "severity")


def _tail_query(params) -> str:
    return f"""WITH {windows_sql(BASE, KEYS)},
h AS (SELECT environment, service, window_index, {TARGET} AS s, min({TARGET}) {FRAME} AS lo, max({TARGET}) {FRAME} AS hi,
  avg({TARGET}) {FRAME} AS m, coalesce(stddev_samp({TARGET}) {FRAME}, 0) AS sd FROM agg WHERE {TARGET} IS NOT NULL)
SELECT environment, service, window_index, r6(CASE WHEN lo = hi AND s = lo THEN 0.0 WHEN s <= lo THEN 0.0
  WHEN s <= m THEN least(0.3, greatest(0.0, 0.3 * (s - lo) / greatest(m - lo, {params['floor']})))
  ELSE least(1.0, 0.3 + 0.7 * (1 - exp(-(s - m) / greatest(sd * {params['scale_factor']}, {params['epsilon']})))) END) AS anomaly_score
FROM h WHERE lo IS NOT NULL"""


def _register_tail(name: str, params) -> None:
    @query(name, _tail_query(params), ("observations",))
    def run(spark, folder):
        w = _windows(spark, folder).where(F.col(TARGET).isNotNull())
        frame = D.history_frame(KEYS)
        s = F.col(TARGET)
        h = (
            w.withColumn("lo", F.min(s).over(frame))
            .withColumn("hi", F.max(s).over(frame))
            .withColumn("m", F.avg(s).over(frame))
            .withColumn("sd", F.coalesce(F.stddev_samp(s).over(frame), F.lit(0.0)))
            .where("lo IS NOT NULL")
        )
        same = (F.col("lo") == F.col("hi")) & (s == F.col("lo"))
        score = D.tail_score(s, F.col("lo"), F.col("m"), F.col("sd"), same, **params)
        return h.select(*KEYS, "window_index", round6(score).alias("anomaly_score"))


_register_tail("D6_tail_score_forest", D.FOREST_TAIL)
_register_tail("D6_tail_score_reconstruction", D.RECONSTRUCTION_TAIL)


@query(
    "D7_detector_severity",
    """SELECT event_id, CASE WHEN s >= 0.9 THEN 'critical' WHEN s >= 0.75 THEN 'error' WHEN s >= 0.5 THEN 'warning' ELSE 'info' END AS severity
FROM (SELECT event_id, least(value / 300.0, 1.0) AS s FROM telemetry) t""",
    ("telemetry",),
)
def severity(spark, folder):
    score = F.least(F.col("value") / F.lit(300.0), F.lit(1.0))
    return load(spark, folder, "telemetry").select("event_id", D.detector_severity(score).alias("severity"))


@query(
    "D8_status_counts",
    f"""WITH {forecast_sql('linear', min_history=20)}
SELECT environment, service, status, count(*) AS windows FROM scored GROUP BY ALL""",
    ("observations",),
)
def status_counts(spark, folder):
    out = _forecast(spark, folder, min_history=20)
    return out.groupBy(*KEYS, "status").agg(F.count(F.lit(1)).alias("windows"))


@query(
    "D9_signals",
    f"""WITH {forecast_sql('linear')},
d AS (SELECT *, sha1(unhex('{SIGNAL_NAMESPACE.hex}') || encode(concat_ws('|', 'forecast', '1.0.0', environment, service,
  CAST(window_index AS VARCHAR)))) AS h FROM scored WHERE status = 'success')
SELECT concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3),
  translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3), substr(h, 21, 12)) AS signal_id,
  origin_us + window_index * {BASE.step_us} + {BASE.size_us} AS event_us, environment, service, '{TARGET}' AS metric_or_feature,
  CASE WHEN anomaly_score >= 0.9 THEN 'critical' WHEN anomaly_score >= 0.75 THEN 'error' WHEN anomaly_score >= 0.5 THEN 'warning' ELSE 'info' END AS severity,
  r6(anomaly_score) AS anomaly_score, r6(y) AS observed, r6(expected) AS expected FROM d""",
    ("observations",),
)
def signals(spark, folder):
    out = D.to_signals(_forecast(spark, folder), TARGET, KEYS, "forecast_residual")
    ev = F.col("evidence")[0]
    return out.select(
        "signal_id",
        F.unix_micros("event_time").alias("event_us"),
        "environment",
        "service",
        "metric_or_feature",
        "severity",
        round6(F.col("anomaly_score")).alias("anomaly_score"),
        round6(ev["observed_value"]).alias("observed"),
        round6(ev["expected_value"]).alias("expected"),
    )


@query(
    "D9_signal_sources",
    f"""WITH {forecast_sql('linear')},
d AS (SELECT *, sha1(unhex('{SIGNAL_NAMESPACE.hex}') || encode(concat_ws('|', 'forecast', '1.0.0', environment, service,
  CAST(window_index AS VARCHAR)))) AS h FROM scored WHERE status = 'success')
SELECT concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3),
  translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3), substr(h, 21, 12)) AS signal_id, o.event_id, o.metric_name
FROM d JOIN observations o ON o.environment = d.environment AND o.service = d.service
  AND epoch_us(o.event_time) >= d.origin_us + d.window_index * {BASE.step_us} AND epoch_us(o.event_time) < d.origin_us + d.window_index * {BASE.step_us} + {BASE.size_us}""",
    ("observations",),
)
def signal_sources(spark, folder):
    members = W.provenance(load(spark, folder, "observations"), BASE, KEYS)
    return D.signal_sources(_forecast(spark, folder), members, KEYS)
