"""G7 returns every simple path within its hops, also between nodes that are not linked."""

from opsweave.plans import graph


def test_paths_to_nodes_that_are_not_linked(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", "trade", 1), ("b", "c", "trade", 1), ("c", "d", "trade", 1), ("b", "a", "trade", 1)], "up string, down string, dep string, n long")
    monkeypatch.setattr(graph, "load", lambda *_: edges)
    got = {(r.source, r.target, r.hop_count, r.path) for r in graph.simple_paths(spark, "").collect()}
    # as the check SQL: from each node with edges out, the path of no hop included
    assert got == {
        ("a", "a", 0, "a"), ("b", "b", 0, "b"), ("c", "c", 0, "c"), ("a", "b", 1, "a>b"), ("b", "c", 1, "b>c"), ("c", "d", 1, "c>d"), ("b", "a", 1, "b>a"),
        ("a", "c", 2, "a>b>c"), ("b", "d", 2, "b>c>d"),
    }
