"""Spelling variants by a variable-length gram index.

1. Words and their numbers: counted inside the tasks, then summed per word.
2. Gram dictionary: all grams of QMIN letters, and longer ones (up to QMAX) only below a
   prefix that holds more than 1/SHARE of all gram places.  At most SHARE prefixes of one length
   can, so the dictionary has at most SHARE x letters x (QMAX - QMIN) longer grams however
   many words there are; that is what tasks are sent.
3. Each word is cut into its longest grams, none inside another.  For an edit at a given
   place of the word, the dictionary tells which grams it may change: those that cover the
   place, those left of it from the first start whose text up to the place could grow into
   a longer gram, and those right of it up to the last end that a longer gram from before
   could cover.  The grams outside these are the same in both words of a near pair, as a
   leading run and a trailing run.
4. List merging: the positional lists of all grams that must survive are merged at once,
   by joining on the text of the two runs, per place of the edit.  Where an edit may
   change every gram of a short word, the letters beside the place take the grams'
   part, so no pair is lost.
5. Every candidate is verified by edit distance.

Both words of a pair see the same text left and right of the edit, so they name the same
runs; the merge therefore loses nothing (tested against all pairs).  A word has at most
two keys per letter.

Defined cases: a null text has no words; a null doc_id counts as an empty one in the
hash; repeated rows count each; without words of the needed length and number the result
is empty.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opsweave.llm.common import cut

MIN_LETTERS = 5
MIN_COUNT = 3
NOISE = 97
QMIN = 2
QMAX = 4
SHARE = 300
HELD_WORDS = 300_000  # distinct words that a task counts before it hands them on

_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)}
_FOLD = bytes((c + 32 if c <= 0x5A else c) if c in _LETTERS else 32 for c in range(256))
BETWEEN = "\0"


def runs_of(text: str) -> list[bytes]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF, one byte a letter, A-Z lower-cased.

    Code points beyond U+00FF become a question mark, which ends a run like other signs.
    """
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def noisy(run: bytes, prefix: int, noise: int = NOISE) -> bytes:
    """The run without one letter if its hash says so; ``prefix`` is the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode("utf-8"), prefix)
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n) of the whole texts."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                prefix = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(runs_of(text.as_py())).items():
                    if len(run) >= min_letters:  # a letter less cannot make a run longer
                        word = noisy(run, prefix, noise)
                        if len(word) >= min_letters:
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    source = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = source.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def gram_dictionary(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, share: int = SHARE) -> set[str]:
    """The grams longer than ``qmin``; with every gram all its prefixes are in, too."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                held.update(word[p : p + q] for q in range(qmin, qmax + 1) for p in range(len(word) - q + 1))
            if len(held) >= HELD_WORDS:
                yield pa.RecordBatch.from_pydict({"gram": list(held), "places": list(held.values())}, schema=schema)
                held = Counter()
        yield pa.RecordBatch.from_pydict({"gram": list(held), "places": list(held.values())}, schema=schema)

    schema = pa.schema([("gram", pa.string()), ("places", pa.int64())])
    counted = cut(words.select("word").mapInArrow(grams, "gram string, places long").groupBy("gram").agg(F.sum("places").alias("places")))
    total = counted.where(F.length("gram") == qmin).agg(F.sum("places")).first()[0] or 0
    often = counted.where((F.length("gram") < qmax) & (F.col("places") > total / share)).select("gram")  # at most ``share`` a length
    longer = counted.where(F.length("gram") > qmin).withColumn("_prefix", F.expr("left(gram, length(gram) - 1)"))
    kept = longer.join(F.broadcast(often.withColumnRenamed("gram", "_prefix")), "_prefix", "left_semi")
    return {r["gram"] for r in kept.select("gram").collect()}


class Grams:
    """Cuts words into variable grams and names the runs that an edit leaves alone."""

    def __init__(self, dictionary: Iterable[str], qmin: int = QMIN):
        self.known, self.qmin = frozenset(dictionary), qmin
        self.longest = max(map(len, self.known), default=qmin)
        self.heads = frozenset(g[:k] for g in self.known for k in range(qmin, len(g)))
        self.tails = frozenset(g[-k:] for g in self.known for k in range(qmin, len(g)))

    def cut(self, word: str) -> tuple[list[int], list[int]]:
        """Starts and ends of the word's grams."""
        starts, ends, last, n = [], [], 0, len(word)
        for p in range(n - self.qmin + 1):
            e = p + self.qmin
            while e < n and word[p : e + 1] in self.known:
                e += 1
            if e > last:
                starts.append(p), ends.append(e)
                last = e
        return starts, ends

    def runs(self, word: str) -> tuple[list[str], list[str]]:
        """For each place i: the text of the grams that stay when an edit changes what follows
        ``word[:i]``, and of those that stay when it changes what precedes ``word[i:]``."""
        n, q, far = len(word), self.qmin, self.longest
        starts, ends = self.cut(word)
        left, right = [""] * (n + 1), [""] * (n + 1)
        for i in range(n + 1):
            first = i - q + 1  # from here on a gram covers the place
            for j in range(max(0, i - far + 1), i - q + 1):
                if word[j:i] in self.heads:
                    first = j
                    break
            kept = bisect_left(starts, first) if first > 0 else 0
            if kept:
                left[i] = word[: ends[kept - 1]]
            last = i + q - 1  # up to here a gram from before can end
            for e in range(min(n, i + far - 1), i + q - 1, -1):
                if word[i:e] in self.tails:
                    last = e
                    break
            kept = max(bisect_left(starts, i), bisect_right(ends, last))
            if kept < len(starts):
                right[i] = word[starts[kept] :]
        return left, right

    def affected(self, word: str) -> int:
        """The most grams that one edit may change."""
        starts, ends = self.cut(word)
        left, right = self.runs(word)
        n, m = len(word), len(starts)
        a = [bisect_right(ends, len(t)) if t else 0 for t in left]
        b = [m - bisect_left(starts, n - len(t)) if t else 0 for t in right]
        return m - min([a[i] + b[i] for i in range(n + 1)] + [a[i] + b[i + 1] for i in range(n)])

    def keys(self, word: str) -> list[tuple[bool, str]]:
        """(gap, key): for a letter replaced or taken out, and for one put in at a gap."""
        left, right = self.runs(word)
        found = set()
        for i in range(len(word) + 1):
            for gap in (False, True) if i < len(word) else (True,):
                x, y = left[i], right[i if gap else i + 1]
                if not x and not y:
                    x, y = word[:i], word[i if gap else i + 1 :]
                found.add((gap, x + BETWEEN + y))
        return sorted(found)


def near_pairs(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, share: int = SHARE) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words one edit apart, once."""
    dictionary = words.sparkSession.sparkContext.broadcast(Grams(gram_dictionary(words, qmin, qmax, share), qmin))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("gap", pa.bool_()), ("letters", pa.int32()), ("key", pa.string())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = dictionary.value.keys
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                # A word meets words of its own length by replacement, and by its gaps the longer ones.
                out.extend((word, n, gap, len(word) + gap, key) for gap, key in name(word))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)

    keyed = cut(words.select("word", "n").mapInArrow(keys, "word string, n long, gap boolean, letters int, key string"))
    a = keyed.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "gap", "letters", "key")
    b = keyed.where(~F.col("gap")).select(F.col("word").alias("b"), F.col("n").alias("b_n"), "letters", "key")
    met = a.join(b.hint("merge"), ["letters", "key"]).where((F.col("gap") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n, if that is twice the word's."""
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )
    both = pairs.select(F.explode(sides).alias("side")).select("side.*")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    grouped = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(grouped, "word", "left")
    most = -F.col("best.less")
    wins = F.coalesce(most >= 2 * F.col("n"), F.lit(False))
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(wins, F.col("best.near")).alias("form"), F.when(wins, most).alias("form_n")
    )


def with_roots(formed: DataFrame) -> DataFrame:
    """Adds ``root`` by pointer jumping: each round doubles the steps a word has gone.

    n doubles with every step, so 64-bit numbers allow at most 63 steps, six rounds.
    """
    at = cut(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    for _ in range(6):
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut(at.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    return formed.join(at.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of ``docs`` (doc_id, text)."""
    words = cut(count_words(docs, min_letters, min_count, noise))
    formed = cut(forms(words, near_pairs(words)))
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")


def oracle() -> str:
    """The same grouping in DuckDB's SQL: crc32 by its table, near words by deletions of each letter."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE bits(i, k, c) AS (SELECT range, 0, CAST(range AS UINTEGER) FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UINTEGER)) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r WHERE length(run) >= {MIN_LETTERS} GROUP BY doc_id, run),
h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UINTEGER), list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST(CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS UINTEGER))),
  lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS BIGINT) + 1])), CAST(4294967295 AS UINTEGER)) AS h FROM g, crc),
w AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
less AS (SELECT DISTINCT word, n, less FROM (SELECT word, n, unnest(list_prepend(word, list_transform(range(CAST(length(word) AS BIGINT)), lambda i: substr(word, 1, CAST(i AS BIGINT)) || substr(word, CAST(i + 2 AS BIGINT))))) AS less FROM words)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b USING (less) WHERE a.word <> b.word AND abs(length(a.word) - length(b.word)) <= 1
  AND (length(a.word) <> length(b.word) OR list_sum(list_transform(range(CAST(length(a.word) AS BIGINT)), lambda i: CAST(substr(a.word, CAST(i + 1 AS BIGINT), 1) <> substr(b.word, CAST(i + 1 AS BIGINT), 1) AS INTEGER))) = 1)),
best AS (SELECT word, count(*) AS n_near, min({{'less': -near_n, 'near': near}}) AS best FROM near GROUP BY word),
f AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * n THEN best.near END AS form, CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk(word, place, form) AS (SELECT word, word, form FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.form)
SELECT f.word, f.form, walk.place AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN walk ON walk.word = f.word AND walk.form IS NULL"""
