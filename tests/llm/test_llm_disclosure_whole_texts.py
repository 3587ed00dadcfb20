"""Revealing terms of whole texts by direct counting, names of few letters among them."""

import math
import random
import re
from collections import Counter

from opsweave.llm import disclosure

MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def slow_whole_terms(texts, rules):
    """Revealing terms: words that stand with an address in whole, distinct texts."""
    n_e, n_et, n_t = Counter(), Counter(), Counter()
    for text in set(texts):
        held = {m.lower() for m in re.findall(MAIL, text)}
        terms = {w.lower() for w in re.findall(r"[^\W\d_]+", re.sub(MAIL, "@", text))}
        n_e.update(held)
        n_et.update((e, t) for e in held for t in terms)
        n_t.update({w.lower() for w in re.findall(r"[^\W\d_]+", text)})
    total, out = len(set(texts)), set()
    for (e, t), k in n_et.items():
        information = math.log2(total / n_e[e])
        if min(k, n_e[e]) >= rules.support and information > 0 and math.log2(total * k / (n_e[e] * n_t[t])) / information >= rules.generalise_at:
            out.add(t)
    return out


def test_short_names_match_direct_counting(spark):
    rng = random.Random(6)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, f"Kim Lee {some(40)} kim@x.example {some(30)} by K Lee") for i in range(9)]
    rows += [(20 + i, f"{some(30)} ask bo@y.example or Bo of {some(10)}") for i in range(5)]
    rows += [(100 + i, f"of {some(50)} or ask") for i in range(80)] + [(500, None), (501, ""), (502, "Kim alone"), (None, "Lee " + "x " * 30_000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, term string")
    rules = disclosure.DisclosureRules()
    want = slow_whole_terms([t or "" for _, t in rows], rules)
    assert {"kim", "lee", "k", "bo"} <= want and not want & {"of", "or", "ask"}
    found = disclosure.find_disclosures(docs, rules)
    texts, n = dict(rows), 0
    for r in found.collect():
        text = texts[r.doc_id] or ""
        inside = [m.span() for m in re.finditer(MAIL, text)]
        marked = [m.span() for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in want and not any(a <= m.start() < b for a, b in inside)]
        assert [(s.start, s.end) for s in r.term] == marked, r.doc_id
        n += len(marked)
    assert n >= 9 * 4
    assert disclosure.find_disclosures(docs.limit(0), rules).count() == 0
