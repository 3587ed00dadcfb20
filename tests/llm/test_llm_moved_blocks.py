"""Near copies with moved and replaced blocks against a direct count."""

import random

import pytest

from opsweave.llm import order_minhash


def slow_shared(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] + 1 if x == y else max(last[j], row[j - 1]))
    return row[-1]


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


BASE = [f"w{i}" for i in range(1000)]
FRESH = [f"n{i}" for i in range(150)]


@pytest.mark.parametrize("other", [
    BASE[110:] + BASE[:110],
    BASE[150:] + BASE[:150],
    BASE[108:] + FRESH[:108],
    BASE[:400] + BASE[500:900] + BASE[400:500] + BASE[900:],
    FRESH[:60] + BASE[60:940] + FRESH[60:120],
    BASE[210:] + BASE[:210],
    BASE[130:] + FRESH[:130] + BASE[:100],
])
def test_moved_and_replaced_blocks(other):
    ready = [order_minhash.prepared(" ".join(w)) for w in (BASE, other)]
    want = slow_shared(grams(BASE), grams(other)) / (max(len(BASE), len(other)) - 4)
    got = order_minhash.compare(*ready, 0.8)
    assert (got >= 0.8) == (want >= 0.8) and (got == 0 or abs(got - want) < 1e-12)


def test_shared_shingles_match_brute_force(monkeypatch):
    rng = random.Random(5)
    for dense in (8, 0):
        monkeypatch.setattr(order_minhash, "DENSE", dense)
        monkeypatch.setattr(order_minhash, "MASK_BITS", 200)
        for _ in range(200):
            a, b = ([rng.choice("abcde"[: rng.choice([1, 2, 5])]) for _ in range(rng.randint(5, 60))] for _ in range(2))
            b += a[rng.randint(0, len(a)) :]
            arrays = [order_minhash.shingles(order_minhash.word_hashes(w)) for w in (a, b)]
            assert order_minhash.shared_in_order(*arrays) == slow_shared(grams(a), grams(b))


def test_moved_blocks_are_one_class(spark):
    rows = [(1, " ".join(BASE)), (2, " ".join(BASE[150:] + BASE[:150])), (3, " ".join(BASE[500:] + FRESH + BASE[:350]))]
    found = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
