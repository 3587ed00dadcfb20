"""Revealing terms far from their entity, at text edges and in texts without it."""

import itertools

from opsweave.llm import disclosure


def test_terms_of_whole_texts(spark):
    # every word stands in one text, so only the two names repeat
    fresh = ("".join("abcdefghij"[int(d)] for d in str(n)) for n in itertools.count(100_000))
    far = lambda n: " ".join(itertools.islice(fresh, n))
    rows = [(i, f"Quixworth {far(40)} zeb@corp.example {far(40)} Quixworth {far(20)} Zebulon") for i in range(9)]
    rows += [(50, f"{far(30)} by Zebulon {far(10)}"), (51, None), (52, ""), (None, f"Zebulon {far(5)}")]
    rows += [(100 + i, far(60)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = disclosure.find_disclosures(docs)
    texts, got = dict(rows), {r.doc_id: r for r in found.collect()}
    shown = lambda i: [texts[i][s.start : s.end] for s in got[i].term]
    assert all(shown(i) == ["Quixworth", "Quixworth", "Zebulon"] for i in range(9))
    assert shown(50) == ["Zebulon"] and shown(None) == ["Zebulon"] and not shown(52) and not shown(100)
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs, found).collect()}
    assert not any("Zebulon" in (t or "") or "Quixworth" in (t or "") for t in clean.values())
