"""Pairs of texts: one alignment by shingles bounds the best one; groups that are settled bring no rare shingles."""

import random

from pyspark.sql import functions as F

from opsweave.llm import order_minhash
from tests.llm.test_llm_dedup_privacy import edit_distance, words


def test_one_alignment_is_never_better_than_the_best():
    rng = random.Random(21)
    for _ in range(300):
        a = [rng.choice("abcdefgh"[: rng.choice([1, 2, 8])]) for _ in range(rng.randint(5, 50))] if rng.random() < 0.5 else words(rng.randint(5, 90), rng.randint(0, 10**6))
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 3)] = rng.choice([[], ["x"], ["a", "b"], a[:6]])
        if len(b) < 5:
            continue
        x, y = (order_minhash.worded(" ".join(w)) for w in (a, b))
        in_order, edits = order_minhash.one_alignment(x, y)
        assert edits >= edit_distance(a, b) and in_order <= order_minhash.shared_in_order(x.grams, y.grams)


def test_scattered_changes_need_no_exact_alignment(monkeypatch):
    monkeypatch.setattr(order_minhash, "banded_distance", None)
    base = words(400, 5)
    other = [f"n{i}" if i % 10 == 3 else w for i, w in enumerate(base)]
    assert order_minhash.near(order_minhash.worded(" ".join(base)), order_minhash.worded(" ".join(other)), 0.8)


def test_settled_groups_bring_no_rare_shingles(spark):
    base, apart = words(60, 1), words(60, 2)

    def changed(w, i):
        return " ".join([*w[:i], f"n{i}", *w[i + 1 :]])

    rows = [(b"%03d" % i, changed(base, i), b"000") for i in range(40)] + [(b"9%02d" % i, changed(apart, i), b"900") for i in range(3)]
    # two texts with most of the group's words, in no component so far
    rows += [(b"800", changed(base, 50), None), (b"801", " ".join([*base[:20], *words(40, 3)]), None)]
    every = spark.createDataFrame(rows, "node binary, text string, component binary")
    found = order_minhash.rarest_shingles(every.select("node", "text"), every.where("component IS NOT NULL").select("node", "component"), order_minhash.SketchRules())
    met = {bytes(r.node) for r in found.select("node").distinct().collect()}
    assert b"800" in met and b"801" not in met and not any(n.startswith(b"9") for n in met)
    alone = every.where(F.col("component") == b"000").select("node", "text")
    assert order_minhash.rarest_shingles(alone, every.select("node", "component"), order_minhash.SketchRules()).isEmpty()
