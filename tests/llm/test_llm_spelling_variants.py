"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from opsweave.llm import spelling_variants as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, n long"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def grouped(docs, min_count=3):
    words = Counter()
    for doc_id, text in docs:
        for run in RUN.findall((text or "").translate(FOLD)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 5 and n >= min_count}
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and edits(v, w) == 1] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def check(spark, docs):
    frame = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA)
    found = S.group_variants(frame)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect()), key=repr) == grouped(docs)
    return found


def test_equals_all_pairs(spark):
    rng = random.Random(5)
    parts = ["th", "er", "on", "tion", "an", "re", "é", "st", "x"]
    base = ["".join(rng.choices(parts, k=rng.randint(2, 6))) for _ in range(120)]

    def bend(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeiouþ") + w[k:], w[:k] + rng.choice("xyzÿ") + w[k + 1 :]])

    pool = base * 6 + [v for w in base for v in [bend(w)] * 3 + [bend(bend(w))] * 3]
    rng.shuffle(pool)
    check(spark, [(i, " ".join(pool[i::40])) for i in range(40)])


def test_chain_of_forms_has_one_root(spark):
    sizes = {"abcdefgh": 96, "abcdefgx": 48, "abcdefyx": 24, "abcdezyx": 12, "abcdwzyx": 6, "abcvwzyx": 3}
    found = check(spark, [(1, " ".join(w for w, n in sizes.items() for _ in range(n)))])
    assert {r["root"] for r in found.collect() if r["form"]} <= {"abcdefgh", "abcdefgx"}


def test_defined_cases(spark):
    long = "lengthy lengthi " * 30_000
    docs = [(1, None), (2, ""), (None, "words words words wards"), (None, "wards WARDS Wards"), (3, "words words"), (3, "words words"), (4, long), (5, "Āabcdeāabcde-abcde_abcdé abcdé×abcdé"), (6, "aaaaa " * 4 + "aaaaaa " * 9)]
    check(spark, docs)


def test_empty_table(spark):
    assert S.group_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert S.group_variants(spark.createDataFrame([(1, "too few", "", 1)], SCHEMA)).count() == 0


letters = st.text(alphabet="abc", min_size=5, max_size=9)


@settings(max_examples=400, deadline=None)
@given(letters, st.integers(0, 9), st.sampled_from("abcd"), st.sampled_from("rid"), st.sets(st.text(alphabet="abc", min_size=3, max_size=5), max_size=25))
def test_near_words_share_a_key(word, place, letter, kind, grams):
    """Whatever the dictionary, one edit leaves both words a common key and the bound's number of grams."""
    known = {g[:k] for g in grams for k in range(3, len(g) + 1)}
    cutter = S.Grams(known)
    k = place % (len(word) + (kind == "i"))
    other = word[:k] + {"r": letter, "i": letter, "d": ""}[kind] + word[k + (kind != "i") :]
    if other == word or len(other) < 2:
        return
    short, long = sorted((word, other), key=len)
    a, b = set(cutter.keys(short)), set(cutter.keys(long))
    if len(short) == len(long):
        assert {key for gap, key in a if not gap} & {key for gap, key in b if not gap}
    else:
        assert {key for gap, key in a if gap} & {key for gap, key in b if not gap}
    pieces = lambda w: Counter(w[s:e] for s, e in zip(*cutter.cut(w)))
    common = sum((pieces(word) & pieces(other)).values())
    assert common >= sum(pieces(word).values()) - cutter.affected(word)


@pytest.mark.parametrize("text,runs", [("aÀz", [b"a\xc0z"]), ("Ab1c", [b"ab", b"c"]), ("Āx一y", [b"x", b"y"])])
def test_runs(text, runs):
    assert S.runs_of(text) == runs
