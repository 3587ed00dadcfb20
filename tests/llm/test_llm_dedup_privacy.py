"""Near duplicates, disclosure and the pipeline against brute-force versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from opsweave.llm import disclosure, order_minhash
from opsweave.plans.inputs import load

SF = "/root/testdata/sf0.01"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_banded_alignment_finds_the_edit_distance():
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice([[], ["x"], ["a", "b"]])
        want = edit_distance(a, b)
        found = order_minhash.align(order_minhash.word_hashes(a), order_minhash.word_hashes(b), 8)
        assert (found is None) == (want > 8)
        if found:
            assert found[0] == want
            at_b = 0
            for start, length in found[1]:
                run = a[start : start + length]
                assert any(b[j : j + length] == run for j in range(at_b, len(b) - length + 1))
            assert sum(n for _, n in found[1]) >= max(len(a), len(b)) - want


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def changed(base, edits, seed):
    rng, out = random.Random(seed), list(base)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"new{rng.randint(0, 10**6)}"
    return out


def brute_links(texts, similarity=0.8):
    """Pairs of indices that share enough shingles, aligned."""
    from opsweave.llm.line_quality import words_of

    split = [words_of(t or "") for t in texts]
    index = defaultdict(set)
    for i, w in enumerate(split):
        for k in range(max(1, len(w) - 4)):
            index[tuple(w[k : k + 5])].add(i)
    met = Counter()
    for group in index.values():
        for i in group:
            for j in group:
                if i < j:
                    met[i, j] += 1
    ready = [order_minhash.prepared(t or "") for t in texts]
    return {(i, j) for (i, j), n in met.items() if n >= 3 and split[i] != split[j] and order_minhash.compare(ready[i], ready[j], similarity) >= similarity}


def classes(n, links, texts):
    head = list(range(n))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    same = defaultdict(list)
    for i, t in enumerate(texts):
        same[" ".join((t or "").split())].append(i)
    for i, j in [*links, *((g[0], x) for g in same.values() for x in g[1:])]:
        a, b = find(i), find(j)
        head[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_classes_of_documents_match_brute_force(spark):
    docs = load(spark, SF, "documents")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in order_minhash.near_duplicates(docs).collect()}
    texts = [r.text for r in rows]
    links = brute_links(texts)
    want = classes(len(rows), links, texts)
    wrong = [r.doc_id for r, c in zip(rows, want) if got[r.doc_id].class_id != rows[c].doc_id]
    assert len(got) == len(rows) and not wrong
    assert len(set(want)) < len(rows) - 50
    degree = Counter(i for pair in links for i in pair)
    exact = Counter(" ".join(t.split()) for t in texts)
    for i, r in enumerate(rows):
        if exact[" ".join(r.text.split())] == 1 and not any(exact[" ".join(texts[j].split())] > 1 for p in links if i in p for j in p):
            assert got[r.doc_id].n_links <= degree[i]
    kept = order_minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {rows[c].doc_id for c in set(want)}


def test_large_groups_chains_and_odd_rows(spark):
    base = words(200, 1)
    rows = [(i, " ".join(changed(base, 3, i))) for i in range(60)]
    chain = words(150, 2)
    for i in range(6):
        rows.append((100 + i, " ".join(chain)))
        chain = changed(chain, 4, 50 + i)
    passage = words(60, 3)
    rows += [(200 + i, " ".join(words(90, 300 + i) + passage)) for i in range(40)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "two words"), (304, "two  words"), (305, "two other"), (None, " ".join(base)), (None, "lonely null row here today ok"), (1, rows[1][1]), (1, rows[1][1]), (306, " ".join(words(30_000, 9)))]
    rows.append((307, rows[-1][1] + " tail"))
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, node string")
    found = order_minhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add(r.class_id)
    assert all(by[i] == {0} for i in range(60)) and by[None] == {0, None}
    assert all(by[i] == {100} for i in range(100, 106))
    assert all(by[i] == {i} for i in range(200, 240))
    assert by[300] == by[301] == by[302] == {300} and by[303] == by[304] == {303} and by[305] == {305} and by[306] == by[307] == {306}
    kept = order_minhash.without_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 100, *range(200, 240), 300, 303, 305, 306]
    assert sum(r.doc_id is None for r in kept) == 1
    assert order_minhash.near_duplicates(docs.limit(0)).count() == 0


def slow_base(text):
    def luhn(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            s += v - 9 * (v > 9)
        return s % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return found


ODD = [
    None, "", "a@b.cc_x@d.ee z", "..a@b.c.@d.e", "x@y", "a.b+c%d@e-f.g-h.i é \U0001f600 q@r.st", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "4111 1111-1111 1111 and 4111111111111112 and 12345678901234567890",
    "+1 (202) 555-0143. +12 +1((((( +49.30.1234567 x", "9" * 30_000, "1 " * 30_000, "a@" * 20_000, "+1(" * 10_000, "x" * 100_000 + "@y.zz", "5 4000-0000 0000 0002 7",
]


def test_base_spans_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in load(spark, SF, "documents").collect()] + [(-1 - i, t) for i, t in enumerate(ODD)] + [(None, ODD[5]), (None, ODD[5])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, email int")
    got = disclosure.disclosure_digest(disclosure.find_disclosures(docs)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    n = 0
    for doc_id, text in rows:
        want = slow_base(text or "")
        r = by[doc_id][0]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (doc_id, joined, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in ("email", "ip", "card", "phone")]
        assert r.spans.startswith(joined)
        n += len(want)
    assert n > 80


def slow_terms(texts, rules):
    """Revealing (entity, term) pairs by direct counting over distinct texts."""
    texts = set(texts)
    n_e, n_et, n_t = Counter(), Counter(), Counter()
    for text in texts:
        pairs, held = set(), set()
        for kind, a, b in slow_base(text):
            value = text[a:b]
            entity = f"{kind}:" + (re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower())
            held.add(entity)
            for part in (text[max(0, a - rules.reach) : a], text[b : b + rules.reach]):
                pairs.update((entity, m[0].lower()) for m in re.finditer(r"[^\W\d_]{%d,}" % rules.min_letters, part) if m.start() > 0 and m.end() < len(part))
        n_e.update(held)
        n_et.update(pairs)
        n_t.update({w for w in re.split(r"[\W\d_]+", text.lower()) if w})
    out = set()
    for (e, t), k in n_et.items():
        information = math.log2(len(texts) / n_e[e])
        if k >= rules.support and information > 0 and math.log2(len(texts) * k / (n_e[e] * n_t[t])) / information >= rules.generalise_at:
            out.add((e, t))
    return out


def test_revealing_terms(spark):
    rng = random.Random(3)
    filler = words(300, 5)
    rows = [(i, " ".join(rng.sample(filler, 30)) + f" as Zebulon wrote from old Quixworth to zeb@corp.example about it {i} " + " ".join(rng.sample(filler, 10))) for i in range(5)]
    rows += [(10 + i, " ".join(rng.sample(filler, 40)) + " wrote about it") for i in range(60)]
    rows += [(100 + i, f"call agent now please +1 202 555 010{i} or wait " + " ".join(rng.sample(filler, 20))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = disclosure.DisclosureRules()
    found = disclosure.find_disclosures(docs, rules)
    got = {r.doc_id: r for r in found.collect()}
    texts = dict(rows)
    want = slow_terms([t for _, t in rows], rules)
    assert {t for _, t in want} >= {"zebulon", "quixworth"} and "wrote" not in {t for _, t in want}
    for i in range(5):
        assert {texts[i][s.start : s.end].lower() for s in got[i].term} == {t for e, t in want if e == "email:zeb@corp.example"}
    assert all(not got[i].term for i in range(10, 70))
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs, found).collect()}
    assert "[email]" in clean[0] and "Zebulon" not in clean[0] and clean[10] == texts[10] and "[phone]" in clean[100]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_pipeline_stages(spark, folder):
    import corpus_pipeline
    from test_llm_lines_leaks import slow_leaks, slow_verdicts
    from test_llm_mix_chat import slow_mix

    from opsweave.llm import decontaminate, line_quality, mixing

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "benchmark decontamination", "source mix", "token output"]
    docs = load(spark, folder, "documents")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    steps = [f for _, f in corpus_pipeline.STAGES]
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    one = steps[0](spark, docs, folder).cache()
    assert ids(one) == sorted(r[0] for r in slow_verdicts(rows, line_quality.LineRules()) if r[4]) and one.columns == docs.columns
    kept = one.orderBy("doc_id").collect()
    two = steps[1](spark, one, folder).cache()
    texts = [r.text for r in kept]
    assert ids(two) == sorted({kept[c].doc_id for c in classes(len(kept), brute_links(texts), texts)})
    three = steps[2](spark, two, folder).cache()
    leaks = slow_leaks([(r.doc_id, r.text) for r in two.collect()], [(r.item_id, r.text) for r in load(spark, folder, "benchmark").collect()], decontaminate.TemplateRules())
    assert ids(three) == sorted(set(ids(two)) - {d for d, _ in leaks})
    four = steps[3](spark, three, folder).cache()
    rated = mixing.rate(mixing.sized(three), load(spark, folder, "labels")).collect()
    _, taken = slow_mix([(r.doc_id, r.source, r.size, r.quality) for r in rated])
    size = {r.doc_id: r["size"] for r in rated}
    assert Counter(ids(four)) == Counter({d: n // size[d] for d, n in taken.items() if n})
    five = steps[4](spark, four, folder)
    assert ids(five) == ids(four) and five.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert ids(corpus_pipeline.run(spark, folder)) == ids(four)
