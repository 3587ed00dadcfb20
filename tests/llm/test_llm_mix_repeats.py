"""The mix meets its targets where rows repeat an id or have none."""

from collections import Counter

import pytest

from opsweave.llm import mixing


@pytest.mark.parametrize("doc_id", [5, None])
def test_one_id_for_a_whole_source(spark, doc_id):
    rows = [(doc_id, " ".join(["w"] * 10), "b") for _ in range(3000)] + [(i, "w " * 10, "a") for i in range(1, 1001)]
    rows += [(doc_id, "w " * (i % 7), "b") for i in range(40)] + [(9000, "one", None), (9000, "one", None), (9001, None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, fp string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rated = mixing.rate(mixing.sized(docs), labels)
    got = mixing.take(rated, mixing.plan_mix(rated)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 3 and (r.size or not r.copies)
    assert target["b"] < sizes["b"]  # part of one epoch
    assert all(abs(taken[s] - target[s]) <= 5 for s in target)
    again = mixing.take(rated.repartition(7), mixing.plan_mix(rated)).collect()
    shown = lambda rows: sorted((str(r.doc_id), str(r.source), r.size, r.fp, r.copies) for r in rows)
    assert shown(got) == shown(again)
    whole = mixing.mix(docs, labels)
    assert whole.columns == docs.columns and whole.count() == sum(r.copies for r in got)
