import itertools
import random

import pytest
from pyspark.sql import functions as F

from opsweave.operators import correlate as K
from opsweave.operators import graph as G
from opsweave.operators import grouping as GR

DIAMOND = [("gw", "ord"), ("ord", "pay"), ("ord", "inv"), ("pay", "db"), ("inv", "db"), ("db", "ord")]


def edges_df(spark, pairs):
    return spark.createDataFrame([(a, b, "sync") for a, b in pairs], "up string, down string, dep string")


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


def next_nodes(pairs, direction):
    out = {}
    for a, b in pairs:
        if direction in ("downstream", "both"):
            out.setdefault(a, set()).add(b)
        if direction in ("upstream", "both"):
            out.setdefault(b, set()).add(a)
    return out


def bfs(pairs, root, hops, direction):
    near, paths, queue = next_nodes(pairs, direction), {root: [root]}, [root]
    for cur in queue:
        if len(paths[cur]) - 1 < hops:
            for t in sorted(near.get(cur, ())):
                if t not in paths:
                    paths[t] = paths[cur] + [t]
                    queue.append(t)
    return paths


def random_graph(seed, n=9, m=18):
    rnd = random.Random(seed)
    return sorted({(f"v{a}", f"v{b}") for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(m)) if a != b})


@pytest.mark.parametrize("direction", G.DIRECTIONS)
def test_neighbourhood_equals_queue_order_bfs(spark, direction):
    pairs = random_graph(11)
    got = {}
    for r in G.neighborhood(edges_df(spark, pairs), roots(spark, "v0", "v3"), 3, direction).collect():
        got.setdefault(r.root, {})[r.node] = r.path
    assert got == {r: bfs(pairs, r, 3, direction) for r in ("v0", "v3")}


@pytest.mark.parametrize("direction", ["downstream", "both"])
def test_simple_paths_equal_enumeration(spark, direction):
    pairs = random_graph(12, n=7, m=14)
    near = next_nodes(pairs, direction)
    want = set()

    def walk(path, goal):
        if path[-1] == goal:
            want.add(tuple(path))
        elif len(path) <= 3:
            for t in near.get(path[-1], ()):
                if t not in path:
                    walk(path + [t], goal)

    asked = [("v0", "v1"), ("v2", "v5"), ("v4", "v4"), ("v6", "v0")]
    for s, t in asked:
        walk([s], t)
    out = G.find_paths(edges_df(spark, pairs), spark.createDataFrame(asked, "source string, target string"), 3, direction)
    assert {tuple(r.path) for r in out.collect()} == want


def test_parallel_edge_types_are_separate_paths(spark):
    df = spark.createDataFrame([("a", "b", "sync"), ("a", "b", "async")], "up string, down string, dep string")
    pair = spark.createDataFrame([("a", "b")], "source string, target string")
    assert sorted(r.deps for r in G.find_paths(df, pair, 2).collect()) == [["async"], ["sync"]]
    assert [r.deps for r in G.find_paths(df, pair, 2, "both").collect()] == [["async"]]


def test_truncation_and_hop_bounds(spark):
    df = edges_df(spark, DIAMOND)
    for hops, cut in ((1, True), (3, False), (32, False), (None, False)):
        reached = G.neighborhood(df, roots(spark, "gw"), hops)
        assert G.truncation(df, reached, hops, "downstream").first().truncated is cut
    assert G.neighborhood(df, roots(spark, "gw"), 33).count() == G.neighborhood(df, roots(spark, "gw"), None).count()
    with pytest.raises(ValueError):
        G.neighborhood(df, roots(spark, "gw"), -1)


def test_long_chain_is_walked_to_its_end(spark):
    df = edges_df(spark, [(f"n{i}", f"n{i + 1}") for i in range(40)])
    reached = G.neighborhood(df, roots(spark, "n0"), None)
    assert reached.count() == 41 and not G.truncation(df, reached, None, "downstream").first().truncated
    short = G.neighborhood(df, roots(spark, "n0"), 34)
    assert short.count() == 35 and G.truncation(df, short, 34, "downstream").first().truncated


def test_fingerprint_ignores_row_order(spark):
    nodes = spark.createDataFrame([(f"s{i}", f"n{i}", "api") for i in range(20)], "service_id string, name string, service_type string")
    edges = edges_df(spark, DIAMOND)
    a = G.topology_fingerprint(nodes, edges).first()
    assert a == G.topology_fingerprint(nodes.orderBy(F.desc("name")), edges.repartition(3)).first()
    assert a.fingerprint != G.topology_fingerprint(nodes, edges.where("up <> 'gw'")).first().fingerprint


def test_components(spark):
    pairs = random_graph(13, n=30, m=22)
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {r.node: r.component for r in G.connected_components(df, "a", "b").collect()}
    for n in got:
        reach = bfs(pairs, n, 99, "both")
        assert got[n] == min(reach)


def greedy(ids, edges, limit):
    linked = {frozenset(e) for e in edges}
    free, out = set(ids), {}
    for seed in sorted(ids):
        if seed not in free:
            continue
        members = [seed]
        free.discard(seed)
        for c in sorted(free):
            if len(members) < limit and all(frozenset((c, m)) in linked for m in members):
                members.append(c)
                free.discard(c)
        out.update({m: seed for m in members})
    return out


@pytest.mark.parametrize("seed,limit", [(1, 100), (2, 3), (3, 2)])
def test_complete_link_equals_the_sequential_rule(spark, seed, limit):
    rnd = random.Random(seed)
    ids = [f"s{i:02d}" for i in range(24)]
    edges = [p for p in itertools.combinations(ids, 2) if rnd.random() < 0.25]
    rnd.shuffle(edges)
    active = spark.createDataFrame([(i,) for i in ids], "signal_id string")
    links = spark.createDataFrame(edges, "left_id string, right_id string")
    cfg = K.CorrelationConfig(max_group_size=limit)
    want = greedy(ids, edges, limit)
    for task_edges in (10_000, 0):
        got = {r.signal_id: r.group_id for r in GR.complete_link_groups(active, links, cfg, task_edges).collect()}
        assert got == want


SIGNAL = "signal_id string, t long, tenant_id string, environment string, service string, metric_or_feature string, severity string, anomaly_score double, run_id string"


def signals(spark, rows):
    df = spark.createDataFrame([(i, t, "t1", "prod", s, "m", sev, sc, "r") for i, t, s, sev, sc in rows], SIGNAL)
    for c in ("scenario_id", "scenario_version", "seed", "reproducibility_key"):
        df = df.withColumn(c, F.lit("1"))
    return df.withColumn("event_time", F.timestamp_seconds("t")).drop("t").withColumn("semantic_fingerprint", F.sha2("signal_id", 256))


def test_pair_scores_by_hand(spark):
    sig = signals(spark, [("a", 0, "gw", "error", 0.9), ("b", 60, "pay", "critical", 0.8), ("c", 400, "gw", "error", 0.9)])
    cfg = K.CorrelationConfig(threshold=0.5)
    nodes = spark.createDataFrame([(n, n) for n in ("gw", "ord", "pay", "inv", "db")], "service_id string, name string")
    resolution, linked = K.service_relations(sig.select("service"), nodes, edges_df(spark, DIAMOND), 3)
    pairs = K.candidate_pairs(sig, 300)
    assert {(r.left_id, r.right_id) for r in pairs.collect()} == {("a", "b")}
    (r,) = K.score_pairs(pairs, resolution, linked, cfg).collect()
    assert r.temporal_score == pytest.approx(0.8) and r.service_score == 0.0
    assert r.topology_score == pytest.approx(1 / 3) and r.topology_token == "left_to_right" and r.hops == 2
    assert r.symptom_score == pytest.approx((1 + 0.75 + 0.9) / 3) and r.context_score == 1.0
    weighted = 0.25 * 0.8 + 0.2 / 3 + 0.15 * (1 + 0.75 + 0.9) / 3 + 0.15
    assert r.weighted_score == pytest.approx(weighted) and r.accepted == (weighted >= 0.5)


@pytest.mark.parametrize("block_rows", [2, 20_000])
def test_candidate_pairs_equal_brute_force(spark, block_rows):
    rnd = random.Random(9)
    rows = [(f"s{i:03d}", rnd.choice([rnd.randrange(900), 77]), "gw", "info", 0.5) for i in range(60)]
    got = [(r.left_id, r.right_id) for r in K.candidate_pairs(signals(spark, rows), 100, block_rows=block_rows).select("left_id", "right_id").collect()]
    want = {(a[0], b[0]) for a, b in itertools.combinations(sorted(rows), 2) if abs(a[1] - b[1]) <= 100}
    assert len(got) == len(set(got)) and set(got) == want


def test_bridge_chain_is_blocked(spark):
    sig = signals(spark, [("a", 0, "gw", "info", 0.5), ("b", 50, "gw", "info", 0.5), ("c", 100, "gw", "info", 0.5)])
    ev = K.candidate_pairs(sig, 300).withColumn("accepted", ~((F.col("left_id") == "a") & (F.col("right_id") == "c")))
    cfg = K.CorrelationConfig()
    nodes = spark.createDataFrame([("gw", "gw"), ("ord", "ord")], "service_id string, name string")
    graph_edges = edges_df(spark, [("gw", "ord")])
    resolution, _ = K.service_relations(sig.select("service"), nodes, graph_edges, 3)
    far = G.distances(graph_edges, 32, "both")
    groups = GR.complete_link_groups(sig, GR.joinable_edges(ev, sig, far, resolution, cfg), cfg)
    assert {r.signal_id: r.group_id for r in groups.collect()} == {"a": "a", "b": "a", "c": "c"}
    records = sig.select("signal_id", F.lit(True).alias("included"))
    out = GR.rejected_edges(groups, sig, records, ev, far, resolution, cfg)
    assert {(r.left_id, r.right_id): r.reason for r in out.collect()} == {("a", "c"): "source_pair_rejected", ("b", "c"): "bridge_chain_blocked"}
    assert GR.check_groups(groups, records, ev, out, cfg).count() == 0


def test_lateness_boundary_is_strict(spark):
    sig = signals(spark, [("a", 69, "gw", "info", 0.5), ("b", 70, "gw", "info", 0.5)])
    out = K.dispositions(sig, "1970-01-01 00:01:40", K.CorrelationConfig(late="reject"))
    assert {r.signal_id: r.disposition for r in out.collect()} == {"a": "late_rejected", "b": "grouped"}


@pytest.mark.parametrize("bad", [dict(temporal=0.5), dict(threshold=1.5), dict(window_seconds=0), dict(late="never")])
def test_correlation_config_is_checked(bad):
    with pytest.raises(ValueError):
        K.CorrelationConfig(**bad)
