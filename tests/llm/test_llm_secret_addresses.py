"""Keys in addresses: found in user, password, query and fragment."""

import random

from opsweave.llm import secrets


def test_keys_in_addresses(spark):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = ("https://h.example/?api={}", "https://h.example/a/b?x=1&k={}#top", "see https://h.example/p#{} now", "git://user:{}@h.example/repo")
    rows = []
    for n in range(300):
        key = "".join(rng.choice(letters) for _ in range(32))
        rows.append((n, forms[n % 4].format(key), key))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(docs).collect()}
    hit = sum(any(text[s.start : s.end].find(key[4:28]) >= 0 for s in got[n]) for n, text, key in rows)
    assert hit >= 0.98 * len(rows)


def test_words_of_addresses_are_left_alone(spark):
    texts = ["https://h.example/configuration2024/aQ3xK9mZ2pL7vB4n/images?page=2&sort=name", "ftp://anna@h.example/aQ3xK9mZ2pL7vB4nW8sT1yU6/readme", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(not r.spans for r in secrets.scan_secrets(docs).collect())
