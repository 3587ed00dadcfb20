"""Quality rules from the frequency of lines across a host's documents.

Lines are normalised and hashed together with their host.  Lines in more distinct documents
than the host's limit are removed, except from the document with the lowest id that
has them, and documents of which too little is left are rejected.

Counting takes two passes.  The first counts rows per line, added up before the shuffle, so
a line on every page is one row per task; lines up to the limit leave here.  The second
counts distinct texts for the rest only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opsweave.llm.common import SPACE, WORD, cut, fingerprint, small_side

SYMBOLS = "#*$%&|<>"
WINDOW = 5
BLANKS = "\t\n\x0b\x0c\r"
STATS = "doc_id long, fp long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class LineRules:
    """A line is common in a host if more than max(most_documents, most_share of the host's
    distinct texts) have it; a document is depleted if less than keep_share of its words is left."""

    most_documents: int = 10
    most_share: float = 0.0005
    keep_share: float = 0.4
    min_words: int = 10
    repeat_percent: int = 20


def words_of(text: str) -> list[str]:
    for blank in BLANKS:
        if blank in text:
            text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def repeated_window_words(words: list[str], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that the text has at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), "i8", len(words))
    key, size = ids[:n], len(number)
    for k in range(1, width):
        if key is not ids and size > (1 << 62) // max(1, len(number)):
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max()) + 1
        key = key * len(number) + ids[k : n + k]
        size *= len(number)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.flatnonzero(np.isin(key, twice))
    edges = np.zeros(len(words) + 1, "i8")
    np.add.at(edges, found, 1)
    np.add.at(edges, found + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    words = words_of(text)
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line in seen:
            repeats += 1
        elif line.strip(" " + BLANKS):
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeats, repeated_window_words(words)


def base_stats(docs: DataFrame) -> DataFrame:
    """Word and line counts of every row of (doc_id, text); null texts are empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), *columns], names=[c.split()[0] for c in STATS.split(", ")])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), fingerprint().alias("fp"))
    return source.mapInArrow(count, STATS)


def host_id(host: Column) -> Column:
    return F.xxhash64(host, host.isNull())


def host_lines(docs: DataFrame) -> DataFrame:
    """doc_id, fp, host, position, words and line key of every line that is not blank."""
    exploded = docs.select("doc_id", fingerprint().alias("fp"), host_id(F.col("source")).alias("host"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "_line"))
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower("_line"), f"{SPACE}+", " ")), "[0-9]", "0")
    return exploded.select("doc_id", "fp", "host", "pos", "_line", plain.alias("_plain")).where("_plain <> ''").select("doc_id", "fp", "host", "pos", "_line", F.xxhash64("host", "_plain").alias("line"))


def common_lines(docs: DataFrame, rules: LineRules) -> DataFrame:
    """line, n_documents and the id of the document that keeps it."""
    lines = host_lines(docs)
    often = cut(lines.groupBy("line").count().where(F.col("count") > rules.most_documents).select("line"))
    texts = lines.join(small_side(often), "line").groupBy("host", "line", "fp").agg(F.min("doc_id").alias("doc_id"))
    counted = texts.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("keeper"))
    hosts = docs.select(host_id(F.col("source")).alias("host"), fingerprint().alias("fp")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    limited = counted.where(F.col("n_documents") > rules.most_documents).join(hosts, "host")
    return cut(limited.where(F.col("n_documents") > F.col("n_host") * rules.most_share).select("line", "n_documents", "keeper"))


def removed_lines(docs: DataFrame, rules: LineRules) -> DataFrame:
    """doc_id, fp, removed words and removed positions of the documents that lose lines."""
    common = common_lines(docs, rules).select("line", "keeper")
    lost = host_lines(docs).join(small_side(common), "line").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    each = lost.select("doc_id", "fp", "pos", F.regexp_count("_line", F.lit(WORD)).cast("long").alias("words")).distinct()
    return cut(each.groupBy("doc_id", "fp").agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("pos")).alias("removed")))


def judge(docs: DataFrame, rules: LineRules = LineRules()) -> tuple[DataFrame, DataFrame]:
    """(verdicts, removed lines) of rows (doc_id, text, source).

    A verdict per row: the counts, base_failed, removed_words and kept.  A null source is
    a host.  Distinct texts count as documents, so exact copies are one; repeated rows
    have equal verdicts.  A null text has no words and fails the base rules.
    """
    removed = removed_lines(docs, rules)
    stats = base_stats(docs)
    side = small_side(removed.select(F.col("doc_id").alias("_doc"), F.col("fp").alias("_fp"), "removed_words"))
    joined = stats.join(side, stats["doc_id"].eqNullSafe(F.col("_doc")) & (stats["fp"] == F.col("_fp")), "left").drop("_doc", "_fp")
    lost = F.coalesce("removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    depleted = (lost > 0) & (F.col("n_words") - lost < F.col("n_words") * rules.keep_share)
    verdicts = joined.select(*[c.split()[0] for c in STATS.split(", ")], failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), lost.alias("removed_words"))
    return verdicts, removed


def apply_rules(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` without rejected documents, their common lines taken out and n_chars set anew."""
    verdicts, removed = judge(docs, rules)
    rejected = verdicts.where(~F.col("kept")).select("doc_id", "fp").distinct()
    changes = cut(
        removed.select("doc_id", "fp", "removed", F.lit(False).alias("reject"))
        .unionByName(rejected.select("doc_id", "fp", F.lit(None).cast("array<int>").alias("removed"), F.lit(True).alias("reject")))
        .groupBy("doc_id", "fp").agg(F.max("reject").alias("reject"), F.max("removed").alias("removed"))
    )
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("doc_id"), fingerprint(docs["text"]).alias("fp"))
    side = small_side(changes.select(F.col("doc_id").alias("_doc"), F.col("fp").alias("_fp"), "reject", "removed"))
    kept = rows.join(side, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("fp") == F.col("_fp")), "left").where(~F.coalesce("reject", F.lit(False)))
    left = F.array_join(F.filter(F.split(F.col("_row.text"), "\n"), lambda _, i: ~F.array_contains(F.col("removed"), i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("_row.text")).otherwise(left)
    columns = {"text": text} | ({"n_chars": F.when(F.col("removed").isNull(), F.col("_row.n_chars")).otherwise(F.char_length(left))} if "n_chars" in docs.columns else {})
    return kept.select(*[columns.get(c, F.col("_row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def oracle(rules: LineRules = LineRules()) -> str:
    """The verdicts in SQL over the whole table ``documents``."""
    space, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS w FROM d),
pos AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
win AS (SELECT doc_id, i, [x, lead(x, 1) OVER p, lead(x, 2) OVER p, lead(x, 3) OVER p, lead(x, 4) OVER p] AS g, lead(i, 4) OVER p AS last
  FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win WHERE last IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 5) r(k) WHERE n > 1 GROUP BY doc_id),
raw_lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (
  SELECT doc_id, line, count(*) AS n FROM raw_lines WHERE regexp_matches(line, '{word}') GROUP BY doc_id, line) GROUP BY doc_id),
lines AS (SELECT d.doc_id, d.text, l.source, l.line, regexp_replace(trim(regexp_replace(lower(l.line), '{space}', ' ', 'g'), ' '), '[0-9]', '0', 'g') AS p
  FROM raw_lines l JOIN d ON d.doc_id = l.doc_id),
hosts AS (SELECT source, count(DISTINCT text) AS n_host FROM d GROUP BY source),
often AS (SELECT l.source, p, min(doc_id) AS keeper FROM lines l JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source WHERE p <> ''
  GROUP BY l.source, p, n_host HAVING count(DISTINCT text) > greatest({rules.most_documents}, n_host * {rules.most_share!r})),
lost AS (SELECT doc_id, sum(len(regexp_extract_all(line, '{word}'))) AS lost FROM lines l
  JOIN often o ON o.p = l.p AND o.source IS NOT DISTINCT FROM l.source AND o.keeper <> l.doc_id GROUP BY doc_id),
counts AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)),
failed AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (removed_words > 0 AND n_words - removed_words < n_words * {rules.keep_share!r}) AS kept, removed_words
FROM failed
"""
