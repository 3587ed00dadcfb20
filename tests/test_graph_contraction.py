"""Components by contraction inside tasks against a direct search, in one task and in many."""

import random

import pytest

from opsweave.operators import graph as G


def slow_components(edges):
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        one, two = root(a), root(b)
        above[max(one, two)] = min(one, two)
    return {x: root(x) for x in list(above)}


@pytest.mark.parametrize("bound", [250_000, 40])
def test_components_match_direct_search(spark, monkeypatch, bound):
    monkeypatch.setattr(G, "EDGES_PER_TASK", bound)
    rng = random.Random(bound)
    chain = [(i, i + 1) for i in range(1000, 1150)]
    rng.shuffle(chain)
    star = [(7, n) for n in range(2000, 2100)]
    edges = chain + star + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)] + [(5, 5), (7, 2000), (2000, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = G.connected_components(df, "a", "b").collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == slow_components(edges)
    named = spark.createDataFrame([(f"n{a:05}".encode(), f"n{b:05}".encode()) for a, b in edges], "a binary, b binary")
    want = {f"n{a:05}".encode(): f"n{b:05}".encode() for a, b in slow_components(edges).items()}
    assert {bytes(r.node): bytes(r.component) for r in G.connected_components(named, "a", "b").collect()} == want
    assert G.connected_components(df.limit(0), "a", "b").count() == 0
