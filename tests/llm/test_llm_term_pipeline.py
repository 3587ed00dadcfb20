"""The pipelined search against a plain ranking in Python."""

import math
import random
import re
from collections import Counter

import pytest

from opsweave.llm import term_pipeline as T

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, item_id long, rank int", "item_id long, text string, score double"


def split(text):
    return TERM.findall((text or "").translate(FOLD))


def ranking(docs, items, top):
    words = [(d, Counter(split(t))) for d, t in docs]
    words = [(d, c, sum(c.values())) for d, c in words if c]
    n_docs, n_terms = len(words), sum(n for _, _, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(split(text))
    out = []
    for item, terms in queries.items():
        scores = []
        for d, c, n in words:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items, top=50, **how):
    left = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(i, t, 0.5) for i, t in items], ITEMS)
    found = T.search(left, right, top=top, **how)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == ranking(docs, items, top)


@pytest.mark.parametrize("owners,slice_docs,top", [(1, 4096, 5), (4, 7, 3), (3, 50, 50)])
def test_ranks_like_all_pairs(spark, owners, slice_docs, top):
    rng = random.Random(owners)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 40 + ["Of", "ünï", "3"]
    text = lambda n: rng.choice([" ", "-", "\x7f", "."]).join(rng.choices(vocabulary, k=n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(180)]
    docs += [(1000 + i, docs[0][1]) for i in range(20)]  # ties
    items = [(i, text(rng.randint(1, 12))) for i in range(12)]
    check(spark, docs, items, top, owners=owners, slice_docs=slice_docs)


def test_defined_cases(spark):
    long = "alpha " * 60_000 + "beta"
    docs = [(1, None), (2, ""), (3, "..."), (None, "alpha beta"), (None, "alpha beta"), (5, "alpha beta"), (5, "alpha beta"), (7, long), (8, "ALPHA\x00É é Beta"), (9, "gamma")]
    items = [(1, "Alpha alpha"), (1, "beta"), (None, "gamma É"), (3, None), (4, "..."), (5, "nowhere")]
    check(spark, docs, items, 50, slice_docs=2)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_TERMS", 120)
    docs = [(i, f"a{i % 7} b{i % 5} c") for i in range(40)]
    check(spark, docs, [(i, f"a{i} b{i}") for i in range(9)], 4)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 0.0)], ITEMS)
    assert T.search(docs, items).count() == 0
    assert T.search(spark.createDataFrame([(1, "a", 0, 0)], DOCS), items.limit(0)).count() == 0
