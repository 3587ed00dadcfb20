"""Line rules and decontamination against brute-force versions."""

import re
from collections import Counter, defaultdict

from opsweave.llm import decontaminate, line_quality
from opsweave.plans.inputs import load

SF = "/root/testdata/sf0.01"
SPACE = r"[\x20\x09-\x0D]+"


def slow_repeats(words):
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    return len(hit)


def slow_verdicts(rows, rules):
    """(doc_id, text, source) rows to {index: (removed words, kept)}."""
    norm = lambda line: re.sub("[0-9]", "0", re.sub(SPACE, " ", line.lower()).strip(" "))
    texts, first, hosts = defaultdict(set), {}, defaultdict(set)
    for doc_id, text, host in rows:
        hosts[host].add(text)
        for line in (text or "").split("\n"):
            if norm(line):
                key = (host, norm(line))
                texts[key].add(text)
                if doc_id is not None:
                    first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text, host in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lost = 0
        for line in (text or "").split("\n"):
            key = (host, norm(line))
            if norm(line) and len(texts[key]) > max(rules.most_documents, rules.most_share * len(hosts[host])) and first.get(key) != doc_id:
                lost += len(re.findall(r"[^\x20\x09-\x0D]+", line))
        failed = len(words) < 10 or 100 * slow_repeats(words) > 20 * len(words)
        out.append((doc_id, len(words), lost, failed, not failed and not (lost and len(words) - lost < rules.keep_share * len(words))))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def test_repeated_windows_match_brute_force():
    import random

    rng = random.Random(1)
    for n in (0, 4, 5, 6, 40, 400):
        for vocabulary in (2, 4, 30, 5000):
            words = [str(rng.randrange(vocabulary)) for _ in range(n)]
            words += words[: rng.randint(0, n)]
            assert line_quality.repeated_window_words(words) == slow_repeats(words)
    many = [str(i) for i in range(9000)]
    assert line_quality.repeated_window_words(many + many[100:120]) == 40


def small_docs():
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"Shared  Menu {i} | line\nown {i} {body} {i}", "h") for i in range(14)]
    rows += [(100 + i, f"shared menu {i} | LINE\ntail{i}", "h") for i in range(3)]
    rows += [(None, None, None), (200, "", "h"), (201, "\n\n \n", None), (1, rows[1][1], "h"), (1, rows[1][1], "h"), (None, rows[2][1], "h"), (300, ("long words " * 20_000).strip(), "h")]
    rows += [(400 + i, f"shared menu 7 | line\nalso {i} one two three four five six seven eight", "other") for i in range(5)]
    return rows


def test_verdicts_match_brute_force(spark):
    rules = line_quality.LineRules()
    rows = small_docs()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, line int, fp string")
    verdicts, _ = line_quality.judge(docs, rules)
    got = [(r.doc_id, r.n_words, r.removed_words, r.base_failed, r.kept) for r in verdicts.collect()]
    assert order(got) == order(slow_verdicts(rows, rules))
    kept = line_quality.apply_rules(docs, rules)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect() if r.doc_id is not None}
    assert texts[0].startswith("Shared") and texts[5].startswith("own 5")
    assert kept.count() == sum(r[4] for r in slow_verdicts(rows, rules))
    assert line_quality.judge(docs.limit(0), rules)[0].count() == 0


def slow_leaks(docs, items, rules):
    words = lambda t: re.findall(r"[0-9]+(?:[.,][0-9]+)*|[^\W_]+", t or "")

    def plain(w):
        if w[0] in "0123456789" or w.lower() in decontaminate.NUMBER_WORDS:
            return "#"
        if w.lower() in decontaminate.UNIT_WORDS:
            return "@"
        return "$" if w.lower() != w else w

    w = rules.width
    index, per_item = defaultdict(list), Counter()
    for item, text in items:
        raw = words(text)
        for i in range(len(raw) - w + 1):
            part = tuple(map(plain, raw[i : i + w]))
            if sum(p not in "#@$" for p in part) >= rules.literals:
                index[part].append((item, i, raw[i : i + w]))
                per_item[item] += 1
    found = set()
    for doc, text in docs:
        raw = words(text)
        at = defaultdict(set)
        for i in range(len(raw) - w + 1):
            for item, j, _ in index.get(tuple(map(plain, raw[i : i + w])), ()):
                at[item, i - j].add(j)
        for (item, shift), windows in at.items():
            theirs = words(dict(items)[item])
            slots = set()
            for j in range(len(theirs) - w + 1):
                if j + shift >= 0 and [*map(plain, theirs[j : j + w])] == [*map(plain, raw[j + shift : j + shift + w])]:
                    slots.update((plain(b), b, d) for b, d in zip(theirs[j : j + w], raw[j + shift : j + shift + w]) if plain(b) in "#@$")
            if len({s[:2] for s in slots}) == len(slots) and len(windows) >= min(rules.windows, per_item[item]):
                found.add((doc, item))
    return found


def test_leaks_of_documents_match_brute_force(spark):
    docs, items = load(spark, SF, "documents"), load(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    want = slow_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], decontaminate.TemplateRules())
    assert got == want and len(got) > 20


def test_reparameterised_questions(spark):
    item = "if Alice walks 12 km in three hours and then Alice rests near the old river for 12 minutes how far is she from the market"
    asked = lambda a, b, c: f"Homework: if {a} walks {b} miles in two days and then {c} rests near the old river for {b} weeks how far is she from the market today"
    filler = "plain words about nothing in particular " * 3
    rows = [(1, f"{filler}{asked('Bob', 40, 'Bob')} {filler}"), (2, asked("Bob", 40, "Carol")), (3, filler), (4, None), (5, ""), (6, filler + item), (None, item), (6, filler + item), (7, ("x " * 50_000) + item)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(9, item, 1), (9, item, 1), (8, "too short", 1), (7, None, 1), (None, item, 1)], "item_id long, text string, doc_id int")
    rules = decontaminate.TemplateRules()
    found = decontaminate.find_leaks(docs, items, rules)
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert set(got) == {(1, 9), (6, 9), (None, 9), (7, 9)}
    assert got[1, 9].n_changed > 0 and got[6, 9].n_changed == 0 and got[6, 9].n_windows == got[6, 9].n_item
    left = decontaminate.without_leaks(docs, found)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5] and left.columns == docs.columns
    assert decontaminate.find_leaks(docs, items.limit(0), rules).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), items, rules).count() == 0
