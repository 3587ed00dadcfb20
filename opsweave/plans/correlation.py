"""Queries over signal intake, correlation and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.operators import correlate as K, graph as G, grouping as GR
from opsweave.plans.inputs import load
from opsweave.plans.registry import query, round6
from opsweave.session import materialise

CFG = K.CorrelationConfig(window_seconds=6 * 3600, hop_limit=3, threshold=0.6)
WINDOW_US = CFG.window_seconds * 1_000_000
SIG = ("service_edges", "signals")
COPY_COLUMNS = "signal_id, event_time, tenant_id, environment, service, metric_or_feature, severity, anomaly_score, run_id, scenario_id, scenario_version, seed, reproducibility_key"


def signals_with_prints(spark, folder):
    sig = load(spark, folder, "signals")
    return sig.withColumn("semantic_fingerprint", F.sha2("signal_id", 256))


def topology(spark, folder, broken: bool = False):
    """(nodes, edges) of the service graph; ``broken`` drops one name and repeats another."""
    edges = load(spark, folder, "service_edges")
    ids = edges.select(F.col("up").alias("service_id")).unionByName(edges.select(F.col("down").alias("service_id"))).distinct()
    nodes = ids.select("service_id", F.col("service_id").alias("name"))
    if broken:
        again = nodes.where("name = 'signup'").select(F.concat(F.col("service_id"), F.lit("-2")).alias("service_id"), "name")
        nodes = nodes.where("name <> 'view'").unionByName(again)
    return nodes, edges


def relations(spark, folder, sig, broken: bool = False, hop_limit: int = CFG.hop_limit):
    nodes, edges = topology(spark, folder, broken)
    return K.service_relations(sig.select("service"), nodes, edges, hop_limit)


SCOPE = ("tenant_id", "environment")
RUN_SCOPE = (*SCOPE, *K.CONTEXT)


def evidence_of(spark, folder, sig, cfg=CFG, broken: bool = False, match=SCOPE):
    """Scored pairs of signals that agree on ``match``; with ``RUN_SCOPE`` only those that a group may hold."""
    resolution, linked = relations(spark, folder, sig, broken, cfg.hop_limit)
    return resolution, K.score_pairs(K.candidate_pairs(K.slim(sig, resolution, match), cfg.window_seconds, match), resolution, linked, cfg)


def pairs_sql(window_us: int = WINDOW_US) -> str:
    return f"""pairs AS (SELECT a.signal_id AS left_id, b.signal_id AS right_id, a AS l, b AS r FROM signals a JOIN signals b
  ON a.tenant_id = b.tenant_id AND a.environment = b.environment AND a.signal_id < b.signal_id
  AND abs(epoch_us(a.event_time) - epoch_us(b.event_time)) <= {window_us})"""


PAIRS = pairs_sql()
DIRECTED = """dwalk(s, t, d) AS (SELECT DISTINCT up, up, 0 FROM (SELECT up FROM service_edges UNION SELECT down FROM service_edges) n
  UNION SELECT w.s, e.down, w.d + 1 FROM dwalk w JOIN service_edges e ON e.up = w.t WHERE w.d < 3),
dist AS (SELECT s, t, min(d) AS d FROM dwalk WHERE d > 0 GROUP BY ALL)"""
UNDIRECTED = """und AS (SELECT up AS a, down AS b FROM service_edges UNION SELECT down, up FROM service_edges),
uwalk(s, t, d) AS (SELECT DISTINCT a, a, 0 FROM und UNION SELECT w.s, u.b, w.d + 1 FROM uwalk w JOIN und u ON u.a = w.t WHERE w.d < 5),
hops AS (SELECT s, t, min(d) AS d FROM uwalk GROUP BY ALL)"""


def _rank(side: str) -> str:
    return f"CASE {side}.severity WHEN 'debug' THEN 0 WHEN 'info' THEN 1 WHEN 'warning' THEN 2 WHEN 'error' THEN 3 WHEN 'critical' THEN 4 ELSE 2 END"


def scored_sql(broken: bool = False, cfg: K.CorrelationConfig = CFG) -> str:
    """CTEs up to ``scored``: every pair with its component scores and reason."""
    missing = "(l.service = 'view' OR r.service = 'view')" if broken else "false"
    ambiguous = "(l.service = 'signup' OR r.service = 'signup')" if broken else "false"
    context = " + ".join(f"CAST(l.{c} = r.{c} AS INTEGER)" for c in K.CONTEXT)
    window_us = cfg.window_seconds * 1_000_000
    return f"""{DIRECTED}, {pairs_sql(window_us)},
t AS (SELECT p.*, x.d AS ab, y.d AS ba, CASE WHEN {missing} THEN 'missing' WHEN {ambiguous} THEN 'ambiguous' WHEN l.service = r.service THEN 'same_service'
   WHEN x.d IS NOT NULL AND y.d IS NOT NULL THEN 'bidirectional' WHEN x.d IS NOT NULL THEN 'left_to_right' WHEN y.d IS NOT NULL THEN 'right_to_left' ELSE 'disconnected' END AS token
  FROM pairs p LEFT JOIN dist x ON x.s = l.service AND x.t = r.service LEFT JOIN dist y ON y.s = r.service AND y.t = l.service),
c AS (SELECT left_id, right_id, l, r, token, CASE WHEN token IN ('left_to_right', 'right_to_left', 'bidirectional') THEN least(coalesce(ab, 999), coalesce(ba, 999)) ELSE 0 END AS hops,
  1 - abs(epoch_us(l.event_time) - epoch_us(r.event_time)) / CAST({window_us} AS DOUBLE) AS temporal_score,
  CASE WHEN l.service = r.service THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS service_score,
  (CAST(l.metric_or_feature = r.metric_or_feature AS INTEGER) + 1 - abs({_rank('l')} - {_rank('r')}) / CAST(4 AS DOUBLE) + 1 - abs(l.anomaly_score - r.anomaly_score)) / CAST(3 AS DOUBLE) AS symptom_score,
  ({context}) / CAST(5 AS DOUBLE) AS context_score FROM t),
u AS (SELECT *, CASE WHEN token = 'same_service' THEN CAST(1 AS DOUBLE) WHEN token IN ('missing', 'ambiguous', 'disconnected') THEN CAST(0 AS DOUBLE) ELSE 1 / CAST(1 + hops AS DOUBLE) END AS topology_score FROM c),
v AS (SELECT *, temporal_score * {CFG.temporal} + service_score * {CFG.service} + topology_score * {CFG.topology:.2f} + symptom_score * {CFG.symptom} + context_score * {CFG.context} AS weighted_score FROM u),
scored AS (SELECT *, CASE WHEN token = 'missing' THEN 'topology_service_missing' WHEN token = 'ambiguous' THEN 'topology_service_ambiguous' WHEN token = 'disconnected' THEN 'disconnected_services'
  WHEN weighted_score < {cfg.threshold} - 1e-12 THEN 'below_acceptance_threshold' ELSE concat('accepted;topology=', token, ';hops=', CAST(hops AS VARCHAR)) END AS reason FROM v)"""


@query(
    "K1_fingerprints",
    "SELECT count(*) AS copies_hashed, count(DISTINCT signal_id) AS fingerprints, true AS well_formed FROM (SELECT * FROM signals UNION ALL SELECT * FROM signals) s",
    ("signals",),
)
def fingerprints(spark, folder):
    sig = load(spark, folder, "signals")
    hashed = K.fingerprint_signals(sig.unionByName(sig))
    per = hashed.groupBy("semantic_fingerprint").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.sum("n").alias("copies_hashed"), F.count(F.lit(1)).alias("fingerprints"),
        F.every(F.col("semantic_fingerprint").rlike("^[0-9a-f]{64}$")).alias("well_formed"),
    )


@query(
    "K2_dedupe_signals",
    """SELECT signal_id, CASE WHEN severity = 'critical' THEN 2 ELSE 1 END + CASE WHEN service = 'error' THEN 1 ELSE 0 END AS copies,
  CASE WHEN service = 'error' THEN 'conflict' ELSE 'accepted' END AS disposition FROM signals""",
    ("signals",),
)
def dedupe(spark, folder):
    sig = load(spark, folder, "signals")
    changed = sig.where("service = 'error'").withColumn("anomaly_score", F.col("anomaly_score") / 2)
    received = sig.unionByName(sig.where("severity = 'critical'")).unionByName(changed)
    return K.dedupe_signals(K.fingerprint_signals(received)).select("signal_id", "copies", "disposition")


@query(
    "K3_intake_bounds",
    """SELECT l_orderkey, CASE WHEN count(*) > 5 THEN 'source event count exceeds maximum' WHEN count(DISTINCT l_suppkey) <> count(*) THEN 'source event identities must be unique'
  WHEN count(*) > 4 THEN 'evidence count exceeds maximum' WHEN count(DISTINCT l_quantity) <> count(*) THEN 'evidence identities must be unique' END AS error
FROM lineitem GROUP BY l_orderkey""",
)
def intake(spark, folder):
    per = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("s"), F.collect_list("l_quantity").alias("e"))
    return per.select("l_orderkey", K.intake_error(F.col("s"), F.col("e"), 5, 4).alias("error"))


_PAIR_SQL = f"WITH {PAIRS} SELECT left_id, right_id FROM pairs"


@query("K4_candidate_pairs", _PAIR_SQL, ("signals",))
def candidates(spark, folder):
    return K.candidate_pairs(load(spark, folder, "signals"), CFG.window_seconds).select("left_id", "right_id")


@query("K4_candidate_pairs_dense", _PAIR_SQL, ("signals",))
def candidates_dense(spark, folder):
    return K.candidate_pairs(load(spark, folder, "signals"), CFG.window_seconds, block_rows=3).select("left_id", "right_id")


def _register_score(name: str, columns: tuple[str, ...], broken: bool = False) -> None:
    out = ", ".join(f"r6({c}) AS {c}" if c.endswith("_score") else f"token AS {c}" if c == "topology_token" else c for c in columns)

    @query(name, f"WITH RECURSIVE {scored_sql(broken)} SELECT left_id, right_id, {out} FROM scored", SIG)
    def run(spark, folder):
        evidence = evidence_of(spark, folder, load(spark, folder, "signals"), broken=broken)[1]
        return evidence.select("left_id", "right_id", *[round6(c).alias(c) if c.endswith("_score") else F.col(c) for c in columns])


_register_score("K5_temporal_score", ("temporal_score",))
_register_score("K6_service_score", ("service_score",))
_register_score("K7_topology_score", ("topology_score", "topology_token", "hops"))
_register_score("K7_topology_unresolved", ("topology_score", "topology_token", "hops"), broken=True)
_register_score("K8_symptom_score", ("symptom_score",))
_register_score("K9_context_score", ("context_score",))
_register_score("K10_weighted_score", ("weighted_score",))
_register_score("K11_decisions", ("reason",))
_register_score("K11_decisions_unresolved", ("reason",), broken=True)

WATERMARK = "2024-01-20 00:00:00"


def _register_disposition(name: str, late: str, duplicate: str) -> None:
    is_late = "epoch_us(event_time) < epoch_us(TIMESTAMP '2024-01-20 00:00:00') - 30000000"
    dropped = {"reject": "late_rejected", "delay": "late_delayed"}.get(late)
    dup = "severity = 'critical'"
    kept = f"CASE WHEN {dup} THEN 'duplicate_ignored' WHEN {is_late} THEN 'late_accepted' ELSE 'grouped' END"
    value = f"CASE WHEN {is_late} THEN '{dropped}' ELSE {kept} END" if dropped else kept
    if duplicate == "reject":
        value = f"CASE WHEN {dup} THEN 'duplicate_rejected' ELSE {value} END"

    @query(
        name,
        f"""WITH d AS (SELECT signal_id, CASE WHEN {dup} THEN 2 ELSE 1 END AS duplicate_count, {is_late} AS late, {value} AS disposition FROM signals)
SELECT *, disposition IN ('grouped', 'duplicate_ignored', 'late_accepted') AS included, false AS conflict FROM d""",
        ("signals",),
    )
    def run(spark, folder):
        sig = signals_with_prints(spark, folder)
        received = sig.unionByName(sig.where("severity = 'critical'"))
        cfg = K.CorrelationConfig(late=late, duplicate=duplicate)
        return K.dispositions(received, WATERMARK, cfg).drop("event_time", "semantic_fingerprint")


_register_disposition("K12_dispositions_accept", "accept", "ignore")
_register_disposition("K12_dispositions_delay", "delay", "ignore")
_register_disposition("K12_dispositions_reject", "reject", "reject")


@query(
    "K12_dispositions_conflict",
    """SELECT signal_id, CASE WHEN severity = 'critical' THEN 2 ELSE 1 END + CASE WHEN service = 'click' THEN 1 ELSE 0 END AS duplicate_count,
  CASE WHEN service = 'click' THEN 'conflict' WHEN severity = 'critical' THEN 'duplicate_ignored' ELSE 'grouped' END AS disposition,
  service <> 'click' AS included, service = 'click' AS conflict FROM signals""",
    ("signals",),
)
def conflicting_ids(spark, folder):
    sig = signals_with_prints(spark, folder)
    changed = sig.where("service = 'click'").withColumn("semantic_fingerprint", F.lit("other"))
    received = sig.unionByName(sig.where("severity = 'critical'")).unionByName(changed)
    out = K.dispositions(received, "2024-01-01 00:00:00", K.CorrelationConfig(late="accept", duplicate="ignore"))
    return out.select("signal_id", "duplicate_count", "disposition", "included", "conflict")


@query(
    "K13_validate_evidence",
    f"""WITH RECURSIVE {scored_sql()},
e AS (SELECT left_id, right_id, l, weighted_score, reason, starts_with(reason, 'accepted') AS accepted FROM scored)
SELECT 'duplicate_pair' AS problem, left_id, right_id FROM e WHERE l.service = 'click'
UNION ALL SELECT 'policy_mismatch', left_id, right_id FROM e WHERE l.service = 'view'
UNION ALL SELECT 'reason_mismatch', left_id, right_id FROM e WHERE l.service = 'error'
UNION ALL SELECT 'below_threshold', left_id, right_id FROM e WHERE l.service = 'error' AND NOT accepted AND weighted_score < {CFG.threshold} - 1e-12
UNION ALL SELECT 'self_reference', signal_id, signal_id FROM signals WHERE service = 'purchase'
UNION ALL SELECT 'unknown_endpoint', concat('x', signal_id), concat('y', signal_id) FROM signals WHERE service = 'signup'""",
    SIG,
)
def validate_evidence(spark, folder):
    sig = load(spark, folder, "signals")
    evidence = evidence_of(spark, folder, sig)[1]
    # Told once, in a step of their own: the checks below read them several times a pair.
    told = F.inline(F.array(F.struct("weighted_score", "reason", "accepted", "policy_version")))
    service = F.col("_service")
    base = evidence.select("left_id", "right_id", K.of_side(evidence, "service").alias("_service"), told).select(
        "left_id", "right_id", "weighted_score", "reason", service.alias("s"),
        F.when(service == "error", ~F.col("accepted")).otherwise(F.col("accepted")).alias("accepted"),
        F.when(service == "view", F.lit("0.9")).otherwise(F.col("policy_version")).alias("policy_version"),
    )
    swapped = base.where("s = 'click'").select(
        F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), "weighted_score", "reason", "s", "accepted", "policy_version"
    )

    def made_up(service_name: str, left, right):
        return sig.where(F.col("service") == service_name).select(
            left.alias("left_id"), right.alias("right_id"), F.lit(1.0).alias("weighted_score"), F.lit("accepted").alias("reason"),
            F.col("service").alias("s"), F.lit(True).alias("accepted"), F.lit(CFG.policy_version).alias("policy_version"),
        )

    sid = F.col("signal_id")
    selfs = made_up("purchase", sid, sid)
    ghosts = made_up("signup", F.concat(F.lit("x"), sid), F.concat(F.lit("y"), sid))
    return K.validate_evidence(base.unionByName(swapped).unionByName(selfs).unionByName(ghosts), sig, CFG)


def undirected(spark, folder):
    return materialise(G.distances(topology(spark, folder)[1], None, "both"))


@query(
    "K15_group_guards",
    f"""WITH RECURSIVE {scored_sql()}, {UNDIRECTED}
SELECT left_id, right_id FROM scored LEFT JOIN hops ON hops.s = l.service AND hops.t = r.service
WHERE starts_with(reason, 'accepted') AND {" AND ".join(f"l.{c} = r.{c}" for c in K.CONTEXT)} AND (l.service = r.service OR hops.d <= {CFG.hop_limit})""",
    SIG,
)
def guards(spark, folder):
    sig = load(spark, folder, "signals")
    resolution, evidence = evidence_of(spark, folder, sig, match=RUN_SCOPE)  # no guard passes other pairs
    return GR.joinable_edges(evidence, None, undirected(spark, folder), resolution, CFG)


# A wide window and a low threshold give connected groups on the sample data.
LOOSE = K.CorrelationConfig(window_seconds=86400, hop_limit=3, threshold=0.3, max_group_size=4)


def grouped(spark, folder, max_task_edges: int = GR.MAX_TASK_EDGES, slice_edges: int = GR.SLICE_EDGES):
    """(signals, resolution, distances, groups) of the whole signal table."""
    sig = signals_with_prints(spark, folder)
    # Ids are numbers, in the same order, while pairs are made; an edge stays in its run context.
    numbers = GR.numbered(sig)
    wide = sig.drop("semantic_fingerprint").join(numbers, "signal_id", "left").withColumn("part", F.xxhash64(*RUN_SCOPE))
    wide = materialise(wide.drop("signal_id").withColumnRenamed("number", "signal_id"))
    resolution, evidence = evidence_of(spark, folder, wide, LOOSE, match=RUN_SCOPE)
    far = undirected(spark, folder)
    edges = GR.joinable_edges(evidence, None, far, resolution, LOOSE, keep=("part",))
    groups = GR.complete_link_groups(wide, edges, LOOSE, max_task_edges, slice_edges)
    for column in ("signal_id", "group_id"):
        groups = groups.join(numbers.toDF("_id", column), column, "left").drop(column).withColumnRenamed("_id", column)
    return sig, resolution, far, materialise(groups.select("signal_id", "group_id"))


_PART = ", ".join(("tenant_id", "environment", *K.CONTEXT))
_SAME = " AND ".join(f"l.{c} = r.{c}" for c in K.CONTEXT)
# The sequential rule, one pick a step, side by side in all run contexts: edges never leave one.
SEQUENTIAL_SQL = f"""WITH RECURSIVE {scored_sql(cfg=LOOSE)}, {UNDIRECTED},
pairs_ok AS (SELECT left_id, right_id FROM scored LEFT JOIN hops ON hops.s = l.service AND hops.t = r.service
  WHERE starts_with(reason, 'accepted') AND {_SAME} AND (l.service = r.service OR hops.d <= {LOOSE.hop_limit})),
node AS (SELECT signal_id, dense_rank() OVER (ORDER BY {_PART}) AS part, CAST(row_number() OVER (PARTITION BY {_PART} ORDER BY signal_id) AS INTEGER) AS k FROM signals),
adj AS (SELECT a.part, a.k, list(b.k) AS near FROM (SELECT left_id AS x, right_id AS y FROM pairs_ok UNION SELECT right_id, left_id FROM pairs_ok) e
  JOIN node a ON a.signal_id = e.x JOIN node b ON b.signal_id = e.y GROUP BY a.part, a.k),
walk(part, free, members, pool, closed) AS (
  SELECT part, list(k ORDER BY k), CAST([] AS INTEGER[]), CAST([] AS INTEGER[]), CAST([] AS INTEGER[]) FROM node GROUP BY part
  UNION ALL SELECT s.part, list_filter(free, lambda x: x <> coalesce(pick, -1)), CASE WHEN pick IS NULL THEN [] WHEN len(pool) = 0 THEN [pick] ELSE list_append(members, pick) END,
    CASE WHEN pick IS NULL THEN [] WHEN len(pool) = 0 THEN list_intersect(list_filter(free, lambda x: x <> pick), coalesce(near, [])) ELSE list_intersect(pool, coalesce(near, [])) END,
    CASE WHEN pick IS NULL THEN members ELSE [] END
  FROM (SELECT *, CASE WHEN len(members) > 0 AND (len(pool) = 0 OR len(members) >= {LOOSE.max_group_size}) THEN NULL WHEN len(pool) > 0 THEN list_min(pool) ELSE free[1] END AS pick
    FROM walk WHERE len(free) > 0 OR len(members) > 0) s LEFT JOIN adj ON adj.part = s.part AND adj.k = pick),
g AS (SELECT part, closed[1] AS seed, unnest(closed) AS k FROM walk WHERE len(closed) > 0)
SELECT m.signal_id, h.signal_id AS group_id FROM g JOIN node m ON m.part = g.part AND m.k = g.k JOIN node h ON h.part = g.part AND h.k = g.seed"""


@query("K14_complete_link_groups", SEQUENTIAL_SQL, SIG)
def groups(spark, folder):
    return grouped(spark, folder)[3]


@query("K14_complete_link_rounds", SEQUENTIAL_SQL, SIG)
def groups_by_rounds(spark, folder):
    """The same groups with every component cut into slices."""
    return grouped(spark, folder, max_task_edges=0, slice_edges=2000)[3]


# A grouping that SQL can state: signals of one run context on one day.
DAY_GROUPS = """dg AS (SELECT signal_id, min(signal_id) OVER (PARTITION BY tenant_id, environment, run_id, seed, CAST(event_time AS DATE)) AS group_id FROM signals)"""


def day_groups(sig):
    keys = ["tenant_id", "environment", "run_id", "seed", "_day"]
    tagged = sig.withColumn("_day", F.to_date("event_time"))
    heads = tagged.groupBy(*keys).agg(F.min("signal_id").alias("group_id"))
    return tagged.join(heads, keys).select("signal_id", "group_id")


@query(
    "K16_group_summary",
    f"""WITH RECURSIVE {scored_sql()}, {UNDIRECTED}, {DAY_GROUPS},
m AS (SELECT dg.group_id, s.* FROM dg JOIN signals s USING (signal_id)),
b AS (SELECT group_id, count(*) AS size, min(epoch_us(event_time)) AS started_us, max(epoch_us(event_time)) AS last_us,
  string_agg(signal_id, ',' ORDER BY signal_id) AS members FROM m GROUP BY group_id),
e AS (SELECT x.group_id, count(*) AS n FROM scored JOIN dg x ON x.signal_id = left_id JOIN dg y ON y.signal_id = right_id
  WHERE starts_with(reason, 'accepted') AND x.group_id = y.group_id GROUP BY x.group_id),
d AS (SELECT x.group_id, max(hops.d) AS d FROM m x JOIN m y USING (group_id) JOIN hops ON hops.s = x.service AND hops.t = y.service GROUP BY x.group_id)
SELECT b.group_id, size, started_us, last_us, members, r6((last_us - started_us) / 1000000.0) AS time_span_seconds, coalesce(e.n, 0) AS evidence_pairs, d.d AS diameter_hops
FROM b LEFT JOIN e USING (group_id) LEFT JOIN d USING (group_id)""",
    SIG,
)
def summary(spark, folder):
    sig = materialise(signals_with_prints(spark, folder))
    # Evidence inside a group is all that is counted, and a day's groups agree on these.
    resolution, evidence = evidence_of(spark, folder, sig, match=(*SCOPE, "run_id", "seed"))
    out = GR.group_summary(day_groups(sig), sig, evidence, undirected(spark, folder), resolution, CFG)
    return out.select(
        "group_id", "size", F.unix_micros("started_at").alias("started_us"), F.unix_micros("last_seen_at").alias("last_us"),
        F.array_join(F.transform("members", lambda m: m["signal_id"]), ",").alias("members"), round6("time_span_seconds").alias("time_span_seconds"),
        "evidence_pairs", "diameter_hops",
    )


SPLIT = K.CorrelationConfig(window_seconds=CFG.window_seconds, hop_limit=1, threshold=0.3, max_group_size=4)
_SPLIT_SCORED = scored_sql().replace(f"weighted_score < {CFG.threshold} - 1e-12", f"weighted_score < {SPLIT.threshold} - 1e-12").replace("w.d < 3", "w.d < 1")


@query(
    "K17_rejected_edges",
    f"""WITH RECURSIVE {_SPLIT_SCORED}, {UNDIRECTED}, {DAY_GROUPS},
m AS (SELECT dg.group_id, s.* FROM dg JOIN signals s USING (signal_id)),
gi AS (SELECT group_id, count(*) AS n, min(epoch_us(event_time)) AS t0, max(epoch_us(event_time)) AS t1, min(run_id) AS run_id, min(seed) AS seed FROM m GROUP BY group_id),
heads AS (SELECT group_id, service, min(signal_id) AS id FROM m GROUP BY ALL),
x AS (SELECT left_id, right_id, starts_with(reason, 'accepted') AS accepted, l.severity = 'critical' OR r.severity = 'critical' AS excluded, a.group_id AS ga, b.group_id AS gb
  FROM scored JOIN dg a ON a.signal_id = left_id JOIN dg b ON b.signal_id = right_id),
gp AS (SELECT DISTINCT least(ga, gb) AS ga, greatest(ga, gb) AS gb FROM x WHERE accepted AND NOT excluded AND ga <> gb),
f AS (SELECT gp.ga, gp.gb, arg_min(CASE WHEN hops.d IS NULL THEN 'topology_disconnected' ELSE 'topology_diameter_exceeded' END,
   {{'i': least(p.id, q.id), 'j': greatest(p.id, q.id)}}) AS fault
  FROM gp JOIN heads p ON p.group_id = gp.ga JOIN heads q ON q.group_id = gp.gb AND p.service <> q.service
  LEFT JOIN hops ON hops.s = p.service AND hops.t = q.service WHERE hops.d IS NULL OR hops.d > 1 GROUP BY ALL),
rs AS (SELECT gp.ga, gp.gb, CASE WHEN a.n + b.n > 4 THEN 'maximum_group_size_exceeded' WHEN a.run_id <> b.run_id OR a.seed <> b.seed THEN 'run_context_mismatch'
   WHEN greatest(a.t1, b.t1) - least(a.t0, b.t0) > {WINDOW_US} THEN 'time_span_exceeded' ELSE coalesce(f.fault, 'bridge_chain_blocked') END AS reason
  FROM gp JOIN gi a ON a.group_id = gp.ga JOIN gi b ON b.group_id = gp.gb LEFT JOIN f ON f.ga = gp.ga AND f.gb = gp.gb)
SELECT left_id, right_id, 'ineligible_signal' AS reason FROM x WHERE excluded
UNION ALL SELECT left_id, right_id, 'source_pair_rejected' FROM x WHERE NOT excluded AND NOT accepted
UNION ALL SELECT left_id, right_id, rs.reason FROM x JOIN rs ON rs.ga = least(x.ga, x.gb) AND rs.gb = greatest(x.ga, x.gb) WHERE NOT excluded AND accepted AND x.ga <> x.gb""",
    SIG,
)
def rejected(spark, folder):
    sig = materialise(signals_with_prints(spark, folder))
    resolution, evidence = evidence_of(spark, folder, sig, SPLIT)
    records = sig.select("signal_id", (F.col("severity") != "critical").alias("included"))
    return GR.rejected_edges(day_groups(sig), sig, records, materialise(evidence.select("left_id", "right_id", "accepted")), undirected(spark, folder), resolution, SPLIT)


@query(
    "K17_missing_evidence",
    f"""WITH RECURSIVE {scored_sql()}
SELECT left_id, right_id, 'missing_pair_evidence' AS reason FROM scored WHERE NOT starts_with(reason, 'accepted')
UNION ALL SELECT left_id, right_id, 'bridge' FROM scored WHERE false""",
    SIG,
)
def missing_evidence(spark, folder):
    sig = materialise(signals_with_prints(spark, folder))
    resolution, evidence = evidence_of(spark, folder, sig)
    evidence = materialise(evidence.select("left_id", "right_id", "accepted"))
    records = sig.select("signal_id", F.lit(True).alias("included"))
    out = GR.rejected_edges(day_groups(sig), sig, records, evidence.where("accepted"), undirected(spark, folder), resolution, CFG, evidence)
    return out.where("reason = 'missing_pair_evidence'")


@query("K18_result_invariants", "SELECT '' AS problem, '' AS subject FROM signals WHERE false", ("signals",))
def invariants(spark, folder):
    sig, resolution, far, result = grouped(spark, folder)
    evidence = materialise(evidence_of(spark, folder, sig, LOOSE)[1].select("left_id", "right_id", "accepted"))
    records = sig.select("signal_id", F.lit(True).alias("included"))
    out = GR.rejected_edges(result, sig, records, evidence, far, resolution, LOOSE)
    return GR.check_groups(result, records, evidence, out, LOOSE)
