"""Near copies by edit similarity: the banded distance, and the recall of scattered changes."""

import random

import pytest

from opsweave.llm import order_minhash
from tests.llm.test_llm_dedup_privacy import edit_distance, words


def test_banded_distance_matches_brute_force():
    rng = random.Random(3)
    for _ in range(600):
        a = [rng.choice("abcdefgh"[: rng.choice([1, 2, 8])]) for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice([[], ["x"], ["a", "b"]])
        band, want = rng.randint(0, 12), edit_distance(a, b)
        got = order_minhash.banded_distance(order_minhash.word_hashes(a), order_minhash.word_hashes(b), band)
        assert got == (want if want <= band else None)


def test_compare_is_one_of_two_shares():
    rng = random.Random(9)
    for _ in range(150):
        a = words(rng.randint(5, 80), rng.randint(0, 10**6))
        b = [w if rng.random() > 0.12 else f"n{rng.randint(0, 99)}" for w in a]
        got = order_minhash.compare(*(order_minhash.prepared(" ".join(w)) for w in (a, b)), 0.8)
        grams = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (a, b)]
        shares = (1 - edit_distance(a, b) / len(a), sum(x == y for x, y in zip(*grams)) / len(grams[0]))
        assert (got >= 0.8) == (max(shares) >= 0.8 - 1e-9)
        assert order_minhash.near(*(order_minhash.worded(" ".join(w)) for w in (a, b)), 0.8) == (got >= 0.8)


def test_near_decides_as_compare_does():
    rng = random.Random(11)
    for _ in range(200):
        a = words(rng.randint(1, 300), rng.randint(0, 10**6))
        b = [w for w in a if rng.random() > rng.choice([0.02, 0.1, 0.2])]
        cut = rng.randint(0, len(b) // 4)
        b = rng.choice([b, b[cut:] + b[:cut], a[cut:] + a[:cut]])
        ready, value = ([f(" ".join(w)) for w in (a, b)] for f in (order_minhash.worded, order_minhash.prepared))
        assert order_minhash.near(*ready, 0.8) == (order_minhash.compare(*value, 0.8) >= 0.8)


def replaced(base, percent, seed):
    """``base`` with that share of its words replaced at random places."""
    rng, out = random.Random(seed), list(base)
    for at in rng.sample(range(len(out)), len(out) * percent // 100):
        out[at] = f"new{rng.randint(0, 10**9)}"
    return out


@pytest.mark.parametrize("n", [100, 400, 1000])
def test_recall_of_scattered_changes(spark, n):
    percents = (2, 5, 8, 10)
    rows = []
    for p in percents:
        for i in range(30):
            base = words(n, 1000 * p + i)
            rows += [(10_000 * p + 2 * i, " ".join(base)), (10_000 * p + 2 * i + 1, " ".join(replaced(base, p, i)))]
    evenly = [words(n, 90_000 + i) for i in range(30)]
    rows += [(2 * i, " ".join(w)) for i, w in enumerate(evenly)]
    rows += [(2 * i + 1, " ".join("other" + str(k) if k % 20 == 10 else x for k, x in enumerate(w))) for i, w in enumerate(evenly)]
    rows += [(900_000 + i, " ".join(replaced(evenly[i], 45, i))) for i in range(30)]
    found = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for p in (0, *percents):
        caught = sum(found[10_000 * p + 2 * i + 1] == 10_000 * p + 2 * i for i in range(30))
        assert caught >= 27
    assert all(found[900_000 + i] == 900_000 + i for i in range(30))
