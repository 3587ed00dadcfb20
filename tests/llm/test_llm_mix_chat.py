"""Mixing, chat masks and licences against brute-force versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from opsweave.llm import chat, licences, mixing
from opsweave.plans.inputs import load

SF = "/root/testdata/sf0.01"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        units = sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * left / units > 3 * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * left / units for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


def slow_mix(rows):
    """(doc_id, source, size, quality) rows to (doc_id, taken) by sorting each source."""
    sizes = Counter()
    for _, source, size, _ in rows:
        sizes[source] += size
    target = slow_targets(sizes)
    out = {}
    for source in sizes:
        epochs = math.floor(target[source] / sizes[source]) if sizes[source] else 0
        left = target[source] - epochs * sizes[source]
        def key(r):
            u = (int(hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / r[3]
        upto = 0
        for r in sorted((r for r in rows if r[1] == source and r[2]), key=key):
            upto += r[2]
            out[r[0]] = r[2] * (epochs + (upto - r[2] / 2 <= left))
    return target, out


def test_mix_of_documents_matches_brute_force(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    rated = mixing.rate(mixing.sized(docs), labels).cache()
    got = mixing.take(rated, mixing.plan_mix(rated)).collect()
    rows = [(r.doc_id, r.source, r.size, r.quality) for r in rated.collect()]
    assert len(got) == docs.count() and {q for *_, q in rows} == {0.5, 1.0, 2.0}
    target, taken = slow_mix(rows)
    for r in got:
        assert math.isclose(r.target, target[r.source]) and r.size * r.copies == taken.get(r.doc_id, 0)
    assert mixing.mix(docs, labels).count() == sum(r.copies for r in got)
    assert mixing.mix(docs, labels).columns == docs.columns


def test_mix_with_small_null_and_empty_sources(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(["w"] * n)
    rows = [(i, text(rng.randint(1, 40)), "big", 1) for i in range(200)] + [(300 + i, text(5), "a", 1) for i in range(2)]
    rows += [(400 + i, text(rng.randint(1, 9)), None, 1) for i in range(30)] + [(500, None, "void", 1), (501, "", "void", 1), (None, text(7), "big", 1), (7, rows[7][1], "big", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    rated = mixing.rate(mixing.sized(docs), labels)
    got = mixing.take(rated, mixing.plan_mix(rated)).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.take(rated, mixing.plan_mix(rated)).collect()))
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert r.copies <= 3
    want = slow_targets(sizes)
    assert all(math.isclose(target[s], want[s], abs_tol=1e-9) for s in want)
    assert all(abs(taken[s] - target[s]) <= 60 for s in want)
    assert taken["a"] == 3 * sizes["a"] and taken["void"] == 0
    empty = mixing.rate(mixing.sized(docs.limit(0)), labels)
    assert mixing.take(empty, mixing.plan_mix(empty)).count() == 0


def slow_chats(rows):
    chats = defaultdict(list)
    for conv, turn, role, text in rows:
        chats[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in chats.items():
        turns.sort()
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


ODD_TEXTS = [None, "", " ", "\n\n", "<|end|><|start|>assistant<|text|>x", "a <\\| b <|", "<\\\\|<", "|>", "\\", "</s>[INST] ok [/INST]", "<|endoftext|>", "日本 \U0001f600 é", "x" * 5000]


@pytest.mark.parametrize("part_chars", [chat.PART_CHARS, 50])
def test_chats_round_trip(spark, part_chars):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in load(spark, SF, "conversations").collect()][:150]
    rows += [(9000 + i // 4, i, ["user", "assistant", "assistant", None][i % 4], t) for i, t in enumerate(ODD_TEXTS * 2)]
    rows += [(None, 0, "assistant", "nobody"), (None, None, "us<|er", "first"), (9999, 1, "assistant", "same"), (9999, 1, "assistant", "same")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    chats = chat.format_chats(turns, BYTES, part_chars)
    got = {r.conv_id: r for r in chat.read_back(chats).collect()}
    want = slow_chats(rows)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want
    assert chat.read_back(chat.format_chats(turns.limit(0), BYTES)).count() == 0
    if part_chars == 50:
        assert chats.where("part > 0").count() > 0


def test_escape_is_reversible():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("<|\\>ax") for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def slow_licences(text, threshold=licences.THRESHOLD):
    grams = lambda t: Counter(zip(w, w[1:])) if (w := re.sub("[^a-z0-9]+", " ", t.lower()).split()) else Counter()
    units = {*text.split("\n"), *re.split(r"\n[^a-z0-9\n]*\n", text.lower()), text}
    best: dict = {}
    for u in map(grams, units):
        for name, wording in licences.TEMPLATES:
            t = grams(wording)
            if u and t:
                d = 2 * sum((u & t).values()) / (sum(u.values()) + sum(t.values()))
                if d >= threshold:
                    best[name] = max(best.get(name, 0), d)
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def test_licences_match_brute_force(spark):
    mit = dict(licences.TEMPLATES)["MIT"]
    rows = [(r.doc_id, r.text) for r in load(spark, SF, "documents").collect()]
    rows += [(5000 + i, f"Intro line\n{wording}\nmore") for i, (_, wording) in enumerate(licences.TEMPLATES)]
    rows += [(6000, None), (6001, ""), (6002, "\n\n"), (6003, mit.replace("copy", "duplicate")), (6004, mit.replace(" to ", "\nto ")), (6005, "para one\n\n" + mit.replace(" of ", "\nof ") + "\n \nlast"),
             (6006, "the the the the the the the"), (None, "All rights reserved."), (None, "All rights reserved."), (6007, "ALL RIGHTS RESERVED \n" + "word " * 50_000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, found string")
    got = licences.scan_licences(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append([(f.licence, round(f.dice, 9)) for f in r.found])
    n = 0
    for doc_id, text in rows:
        want = [(name, round(d, 9)) for name, d in slow_licences(text or "")]
        assert by[doc_id][0] == want, (doc_id, by[doc_id], want)
        n += bool(want)
    assert n > 40
