"""Token files and prefix counts against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from opsweave.llm import token_counts, token_files
from opsweave.plans.inputs import load

SF = "/root/testdata/sf0.01"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a  b\r\nc d e", "x<|endoftext|>y Ünïcödé é ﬁ ①", "don't WE'LL 3.14 ***&&&", "\x1c a\x1cb ́x", "日本語テキスト", "<s>x</s>", "▁x ▁ y", "   lead and trail  ", "aaaa" * 500, "\U0001f600퟿z"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(3, "\n", "clash"), (None, "no id", "x"), (None, None, "x"), (3, "other text", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    at, out = 0, []
    for doc_id, text in rows:
        ids = np.asarray(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_round_trip(spark, tmp_path, odd_docs):
    docs = load(spark, SF, "documents")
    folder = f"{tmp_path}/all"
    token_files.write_token_files(docs, folder, WORDS, partitions=5)
    got = sorted(map(tuple, token_files.read_token_files(spark, folder, WORDS).collect()))
    assert got == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()])


def test_token_files_odd_rows(spark, tmp_path, odd_docs):
    token_files.write_token_files(odd_docs, f"{tmp_path}/odd", WORDS, partitions=3)
    rows = token_files.read_token_files(spark, f"{tmp_path}/odd", WORDS).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids == [None, None, *sorted(i for i in ids if i is not None)] and len(ids) == odd_docs.count()
    assert [r.start for r in rows[1:]] == [r.start + r.n_tokens for r in rows[:-1]]
    single = {(r[0], r[2], r[3]) for r in expected([(r.doc_id, r.text) for r in odd_docs.collect()])}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows} == single
    token_files.write_token_files(odd_docs.limit(0), f"{tmp_path}/none", WORDS)
    assert token_files.read_token_files(spark, f"{tmp_path}/none", WORDS).count() == 0


def test_prefix_counts_match_library_at_every_prefix():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = token_counts.PrefixTable(open(PIECES, "rb").read())
    rng = random.Random(5)
    texts = [t for t in ODD if t] + ["".join(rng.choice("theonrisat  éß\n\t0.,①") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for text in texts:
        counts = table.prefix(text[:300])
        assert len(counts) == len(text[:300]) + 1
        assert counts.tolist() == [len(sp.encode(text[:i])) for i in range(len(text[:300]) + 1)]


def test_token_counts_of_documents(spark, odd_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = load(spark, SF, "documents").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    got = token_counts.prefix_token_counts(docs, PIECES).select("doc_id", "n_bytes", token_counts.n_tokens().alias("n")).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in docs.collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_budget_answers(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "")], "doc_id long, text string")
    counted = token_counts.prefix_token_counts(docs, PIECES)
    rows = {r.doc_id: r for r in counted.select("doc_id", "counts", token_counts.longest_prefix("counts", 2).alias("cut"), token_counts.tokens_between("counts", 0, F_size(counted)).alias("all")).collect()}
    assert rows[1].cut == max(i for i, c in enumerate(rows[1].counts) if c <= 2)
    assert rows[1]["all"] == rows[1].counts[-1] and rows[2].cut == 0


def F_size(_):
    from pyspark.sql import functions as F

    return F.size("counts") - 1


def test_frequent_words_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 40)
    monkeypatch.setattr(token_files, "CACHE_STEMS", 40)
    monkeypatch.setattr(token_files, "_WORDS", {})
    seen: list[str] = []
    letters = token_files.WordEncoder.letters(token_files_tokenizer())

    class Noted(dict):
        def __missing__(self, c):
            raise LookupError(c)

        def __getitem__(self, c):
            seen.append(chr(c))
            return super().__getitem__(c)

    monkeypatch.setattr(token_files.WordEncoder, "letters", staticmethod(lambda tokenizer: Noted(letters)))
    code = token_files.WordEncoder.load(WORDS)
    encode = code.encoder()
    rng = random.Random(5)
    for _ in range(30):
        # "zzzz" is in every text; the others are new and without that letter
        text = " ".join(["zzzz", *("".join(rng.choices("abcdefghij", k=9)) for _ in range(30))])
        ids = np.frombuffer(encode([text])[0], code.dtype)
        assert ids.tolist() == token_files_tokenizer().encode(text, add_special_tokens=False).ids
    assert seen.count("z") == 1  # looked up once for each time the word is encoded
    assert all(len(age) <= 40 + 32 for kept in token_files._WORDS[code.key] for age in (kept.young, kept.old))


def token_files_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)
