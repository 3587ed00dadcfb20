"""The additive model: held-out accuracy, tables against a plain sum, defined cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from opsweave.llm import quality_gam as Q
from opsweave.plans.inputs import load

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    scored = Q.score_quality(docs, labels).cache()
    report = Q.held_out_report(scored, labels).first()
    assert report["n"] > 500 and report["accuracy"] >= 0.97 and min(report["recall_0"], report["recall_1"]) >= 0.95
    assert scored.count() == docs.count()
    for r in scored.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_labels_do_not_reach_the_model(spark):
    docs, labels = load(spark, "/root/testdata/sf0.01", "documents"), load(spark, "/root/testdata/sf0.01", "labels")
    turned = labels.withColumn("quality", F.when(Q.remainder() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, Q.score_quality(docs, m).collect())) for m in (labels, turned))
    assert a == b


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    alone, paired = Q.fit_gam(x, y, rounds=60, pairs=0), Q.fit_gam(x, y, rounds=60, pairs=2)
    hit = lambda m: float(((m.score(x) >= 0.5) == y).mean())
    assert hit(paired) > 0.9 > 0.75 > hit(alone)  # 12 bins a side: the one around 0 is mixed
    again = Q.Gam.load(paired.dump())
    for row in x[:40]:
        total = paired.intercept + sum(t[sum(e <= v for e in edges)] for v, edges, t in zip(row, paired.edges, paired.tables))
        low = [sum(e <= v for e in edges) for v, edges in zip(row, paired.pair_edges)]
        total += sum(t[low[f], low[g]] for (f, g), t in zip(paired.pairs, paired.pair_tables))
        assert abs(again.logit(row[None])[0] - total) < 1e-9


def test_bounded_sample_fits_alike(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    scored = Q.score_quality(docs, labels, fit_rows=1500)
    assert Q.held_out_report(scored, labels).first()["accuracy"] >= 0.95


def test_defined_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, 9), (2, "", 9), (3, " \n ", 9), (None, "some words here.", 9), (4, "a b c. " * 50_000, 9), (4, "a b c.", 9), (4, "a b c.", 9)], "doc_id long, text string, score int"
    )
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, 0), (None, 0, 0), (4, 0, 1)], "doc_id long, quality int, score int")
    for marks in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = Q.score_quality(docs, marks).collect()
        assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0.5 for r in Q.score_quality(docs, labels.limit(0)).collect())
    assert Q.score_quality(docs.limit(0), labels).count() == 0
    assert all(len(Q.measure(t)) == len(Q.FEATURES) and np.isfinite(Q.measure(t)).all() for t in (b"", b"\n", b"x", b"\xff\xfe a"))
