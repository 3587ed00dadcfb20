"""Queries that read a costly input several times work it out once."""

import datetime as dt

from opsweave.plans import graph, ingest


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trade_edges_are_joined_once(spark, monkeypatch):
    one = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "a")], "k long, up string, down string")
    two = spark.createDataFrame([(1, "trade"), (2, "trade"), (3, "trade")], "k long, dep string")
    joined = one.join(two, "k").selectExpr("up", "down", "dep", "k AS n")
    seen, walk = [], graph.G.find_paths
    monkeypatch.setattr(graph, "load", lambda *_: joined)
    monkeypatch.setattr(graph.G, "find_paths", lambda edges, *rest: seen.append(logical(edges)) or walk(edges, *rest))
    paths = {r.path for r in graph.simple_paths(spark, "").collect()}
    assert paths == {"a", "b", "c", "a>b", "b>c", "c>a"}
    assert len(seen) == 1 and "Join" not in seen[0]


def test_evidence_is_parsed_once(spark, monkeypatch, tmp_path):
    rows = [(i, i, dt.datetime(2024, 1, 2, 0, 0, i), ("view", "click")[i % 2], 10.0 + i, "{}") for i in range(1, 60)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    seen, upsert = [], ingest.upsert_evidence
    monkeypatch.setattr(ingest, "upsert_evidence", lambda batch, path: seen.append(logical(batch)) or upsert(batch, path))
    out = ingest.committed_version(spark, str(tmp_path)).collect()
    assert out and all(r.bucket_ok for r in out) and any(r.moved for r in out) and not all(r.moved for r in out)
    assert len(seen) == 3 and not any("from_json" in plan.lower() or "jsontostructs" in plan.lower() for plan in seen)
