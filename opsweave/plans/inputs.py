"""Input views over the given tables, written once as SQL for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from opsweave.session import prepare
from opsweave.sources.tables import read_table

VIEWS: dict[str, str] = {
    "telemetry": """
SELECT event_id, ts AS event_time, user_id % 10 AS tenant_id,
  CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS environment,
  event_type AS service,
  CASE event_id % 4 WHEN 2 THEN 'log' WHEN 3 THEN 'system' ELSE 'metric' END AS kind,
  CASE event_id % 2 WHEN 0 THEN 'latency_ms' ELSE 'requests_total' END AS metric_name,
  CASE WHEN value < 20 THEN 'debug' WHEN value < 50 THEN 'info' WHEN value < 100 THEN 'warning'
       WHEN value < 200 THEN 'error' ELSE 'critical' END AS severity,
  value, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR(10)) AS run_id,
  user_id % 7 AS seed, props
FROM events""",
    "observations": """
SELECT event_id, event_time, tenant_id, environment, service, metric_name, value, run_id, seed
FROM telemetry""",
    "signals": """
SELECT lpad(CAST(event_id AS VARCHAR(12)), 12, '0') AS signal_id, event_time, tenant_id, environment, service,
  metric_name AS metric_or_feature, severity,
  CASE WHEN value >= 300 THEN CAST(1 AS DOUBLE) ELSE value / CAST(300 AS DOUBLE) END AS anomaly_score,
  run_id, concat('scenario-', CAST(seed % 3 AS VARCHAR(4))) AS scenario_id, '1.0.0' AS scenario_version,
  seed, concat('seed-', CAST(seed AS VARCHAR(4))) AS reproducibility_key
FROM telemetry""",
    "service_edges": """
SELECT 'view' AS up, 'click' AS down, 'sync' AS dep
UNION ALL SELECT 'click', 'signup', 'sync' UNION ALL SELECT 'click', 'purchase', 'async'
UNION ALL SELECT 'signup', 'error', 'data' UNION ALL SELECT 'purchase', 'error', 'data'""",
    "edges_tree": """
SELECT DISTINCT up, down, dep FROM (
  SELECT concat('r', CAST(r_regionkey AS VARCHAR(10))) AS up, concat('n', CAST(n_nationkey AS VARCHAR(10))) AS down,
    'control' AS dep FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT concat('n', CAST(s_nationkey AS VARCHAR(10))), concat('s', CAST(s_suppkey AS VARCHAR(10))), 'sync' FROM supplier
  UNION ALL SELECT concat('s', CAST(l_suppkey AS VARCHAR(10))), concat('p', CAST(l_partkey AS VARCHAR(10))), 'data'
    FROM lineitem) e""",
    "edges_trade": """
SELECT concat('n', CAST(s.s_nationkey AS VARCHAR(10))) AS up, concat('n', CAST(c.c_nationkey AS VARCHAR(10))) AS down,
  'trade' AS dep, count(*) AS n
FROM lineitem JOIN supplier s ON l_suppkey = s.s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c.c_custkey
WHERE s.s_nationkey <> c.c_nationkey GROUP BY s.s_nationkey, c.c_nationkey""",
    "labelled": """
SELECT l.doc_id AS unit_id, d.source AS scenario_id, l.toxic = 1 AS truth, m.model_name,
  CASE WHEN l.doc_id % 11 = 0 THEN 'insufficient_data' ELSE 'success' END AS status,
  CASE m.model_name WHEN 'a' THEN (d.n_chars % 1000) / CAST(1000 AS DOUBLE)
       ELSE ((l.doc_id * 7919) % 1000) / CAST(1000 AS DOUBLE) END AS score
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
CROSS JOIN (SELECT 'a' AS model_name UNION ALL SELECT 'b' AS model_name) m""",
}

# What each view reads: base tables and other views.
DEPENDS: dict[str, tuple[str, ...]] = {
    "telemetry": ("events",),
    "observations": ("telemetry",),
    "signals": ("telemetry",),
    "service_edges": (),
    "edges_tree": ("region", "nation", "supplier", "lineitem"),
    "edges_trade": ("lineitem", "supplier", "orders", "customer"),
    "labelled": ("labels", "documents"),
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A base table, or a view evaluated by Spark over the base tables."""
    if name not in VIEWS:
        return read_table(spark, folder, name)
    prepare(spark)
    text = VIEWS[name]
    parts = {}
    for dep in DEPENDS[name]:
        text = re.sub(rf"\b(FROM|JOIN)\s+{dep}\b", rf"\1 {{{dep}}}", text)
        parts[dep] = load(spark, folder, dep)
    return spark.sql(text, **parts)


def with_views(sql: str, *names: str) -> str:
    """Prefix a check query with the views it uses as common table expressions."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for dep in DEPENDS[name]:
                visit(dep)
            ordered.append(name)

    for name in names:
        visit(name)
    body = sql.strip()
    if not ordered:
        return body
    heads = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    match = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if match:
        return f"WITH {match.group(1) or ''}{heads},\n{body[match.end():]}"
    return f"WITH {heads}\n{body}"
