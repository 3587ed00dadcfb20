"""Secret scan against a brute-force version."""

import hashlib
import math
import re
from collections import Counter

from opsweave.llm import secrets
from opsweave.plans.inputs import load

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def slow_windows(run, width, bits):
    high = set()
    for i in range(len(run) - width + 1):
        counts = Counter(run[i : i + width]).values()
        if -sum(c / width * math.log2(c / width) for c in counts) >= bits - 1e-9:
            high.update(range(i, i + width))
    return high


def test_entropy_windows_match_direct_entropy():
    import random

    rng = random.Random(3)
    for length in (10, 24, 25, 60, 300):
        run = "".join(rng.choice("abcdef0123456789"[: rng.choice([4, 16])]) for _ in range(length))
        for bits in (2.0, 3.1, 3.5):
            got = {i for a, b in secrets.high_windows(run, 24, bits) for i in range(a, b)}
            assert got == slow_windows(run, 24, bits)


def test_base_spans_match_brute_force(spark):
    docs = load(spark, SF, "documents")
    got = {r.doc_id: r for r in secrets.secret_digest(secrets.scan_secrets(docs)).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    found = 0
    for r in rows:
        want = base_spans(r.text or "")
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        row = got[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        found += len(want)
    assert found > 20


def test_entropy_and_allow_list(spark):
    key = "q7Zp0LxV9mTb4Rk2WcY8sHd1JfGa6NeU"
    texts = [
        (1, f"key {key} end"),
        (2, f"see https://example.org/{key} here"),
        (3, "id 123e4567-e89b-12d3-a456-426614174000 x"),
        (4, None),
        (5, ""),
        (None, f"PassWord = '{key}'"),
        (None, f"PassWord = '{key}'"),
        (6, "x" * 100_000 + " " + key),
    ]
    docs = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, spans string")
    rows = secrets.secret_digest(secrets.scan_secrets(docs)).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[1].spans == f"entropy:4:{4 + len(key)}"
    assert by[2].spans == by[3].spans == by[4].spans == by[5].spans == ""
    assert [r.n_assign for r in rows if r.doc_id is None] == [1, 1]
    assert by[6].spans.startswith("entropy:1000")
    assert secrets.scan_secrets(docs.limit(0)).count() == 0
