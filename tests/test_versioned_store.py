"""The evidence store: one version at a time for readers, whatever happens to a writer."""

import pytest
from pyspark.sql import functions as F

from opsweave.operators import graph as G
from opsweave.sources import stores


def docs(spark, ids, word, at):
    rows = [(f"d{i}", word, at) for i in ids]
    return spark.createDataFrame(rows, "document_id string, body string, at long").select(
        "document_id", "body", F.timestamp_seconds("at").alias("ingested_at"), F.lit(0).cast("long").alias("offset")
    )


def state(df):
    return {r.document_id: r.body for r in df.collect()}


def test_a_writer_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    stores.upsert_evidence(docs(spark, range(30), "old", 1), path, buckets=8)
    before = state(stores.read_evidence(spark, path))
    assert before == {f"d{i}": "old" for i in range(30)}

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(stores, "_commit", dies)
        with pytest.raises(OSError):
            stores.upsert_evidence(docs(spark, range(10, 40), "half", 2), path, buckets=8)
    assert state(stores.read_evidence(spark, path)) == before
    stores.upsert_evidence(docs(spark, range(20, 50), "new", 3), path, buckets=8)
    want = {f"d{i}": "old" if i < 20 else "new" for i in range(50)}
    assert state(stores.read_evidence(spark, path)) == want
    assert state(spark.read.parquet(path)) == want and spark.read.parquet(path).count() == 50
    stores.upsert_evidence(docs(spark, range(20, 50), "new", 3), path, buckets=8)
    stores.upsert_evidence(docs(spark, [1], "stale", 0), path, buckets=8)
    stores.upsert_evidence(docs(spark, [], "none", 9), path, buckets=8)
    assert state(stores.read_evidence(spark, path)) == want
    assert len(list((tmp_path / "store" / "_commits").glob("*.json"))) == 1


def test_a_second_writer_is_noticed(spark, tmp_path):
    path = str(tmp_path / "store")
    stores.upsert_evidence(docs(spark, range(3), "a", 1), path)
    number, versions = stores._committed(spark, path)
    stores._commit(spark, path, number + 1, versions)
    with pytest.raises(RuntimeError):
        stores._commit(spark, path, number + 1, versions)


def test_fingerprint_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(G, "LEAVES", 2)
    nodes = spark.range(700).select(F.concat(F.lit("s"), "id").alias("service_id"), F.col("id").cast("string").alias("name"), F.lit("api").alias("service_type"))
    edges = spark.range(699).select(F.concat(F.lit("s"), "id").alias("up"), F.concat(F.lit("s"), F.col("id") + 1).alias("down"), F.lit("sync").alias("dep"))
    one = G.topology_fingerprint(nodes, edges).first()
    assert one == G.topology_fingerprint(nodes.repartition(5), edges.orderBy(F.desc("up"))).first() and (one.nodes, one.edges) == (700, 699)
    seen = {one.fingerprint}
    for changed in (edges.where("up <> 's5'"), edges.unionByName(edges.limit(1)), edges.withColumn("dep", F.when(F.col("up") == "s9", "data").otherwise(F.col("dep")))):
        seen.add(G.topology_fingerprint(nodes, changed).first().fingerprint)
    seen.add(G.topology_fingerprint(nodes.limit(0), edges.limit(0)).first().fingerprint)
    assert len(seen) == 5
