"""Walks over a graph where one node has half of all edges."""

import pytest
from pyspark.sql import functions as F

from opsweave.operators import graph as G


def star(spark, n=240):
    """A hub that half of all edges leave, spokes in pairs, and a tail behind one spoke."""
    rows = [("hub", f"s{i:03d}") for i in range(n)] + [(f"s{i:03d}", f"s{i + 1:03d}") for i in range(0, n - 1)] + [("top", "hub")]
    return spark.createDataFrame(rows, "up string, down string").withColumn("dep", F.lit("sync"))


@pytest.mark.parametrize("direction", ["downstream", "upstream", "both"])
def test_hubs_change_no_result(spark, monkeypatch, direction):
    edges = star(spark, 40)
    roots = spark.createDataFrame([("top",), ("s005",)], "root string")
    plain = sorted(map(tuple, G.neighborhood(edges, roots, 3, direction).collect()))
    far = sorted(map(tuple, G.distances(edges, 2, direction).collect()))
    monkeypatch.setattr(G, "HUB_EDGES", 6)
    assert sorted(map(tuple, G.neighborhood(edges, roots, 3, direction).collect())) == plain
    assert sorted(map(tuple, G.distances(edges, 2, direction).collect())) == far


def test_no_part_of_a_hub_is_large(spark):
    step = G.neighbours(star(spark), "both").select("node", "neighbour").distinct()
    parted, hubs = G.split_hubs(step, 20)
    assert {r.node: r.parts for r in hubs.collect()} == {"hub": 13}
    sizes = [r["count"] for r in parted.where("node = 'hub'").groupBy("_part").count().collect()]
    assert sum(sizes) == 241 and max(sizes) <= 45 and parted.count() == step.count()
    assert parted.where("node <> 'hub'").agg(F.max("_part")).first()[0] == 0
    frontier = spark.createDataFrame([("hub", "hub"), ("s001", "s001")], "root string, node string")
    assert G.expand(frontier, parted, hubs).count() == G.expand(frontier, step, None).count()
