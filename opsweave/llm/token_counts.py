"""Exact token counts of every prefix by dynamic programming.

A byte-pair vocabulary merges the best-ranked neighbours first.  Two facts make its counts
a recurrence over prefixes.  The coding of a prefix ends in one token t, and without t it
is the coding of the shorter prefix; and a row of tokens is a coding exactly if every
neighbouring pair is the coding of its own characters.  So the last token of prefix i is
the one whose start j has a last token that it may follow, and count[i] = count[j] + 1.
Pieces never join across the start of a blank-led word, so the table is built per word,
kept while the worker lives, and shifted by what came before in the text.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLANK = "▁"
CACHE_WORDS = 600_000
LONG_WORD = 64
CHUNK_CHARS = 4_000_000
CACHE_PAIRS = 2_000_000
_TABLES: dict[int, PrefixTable] = {}


class PrefixTable:
    """Counts for one sentencepiece model with byte fallback and no normalisation.

    Texts are taken as the model takes them: one blank in front of a text that is not
    empty, and blanks written as a mark.  ``prefix(text)[i]`` is the number of tokens of
    the first i characters, for i from 0 to the length.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size()) if not odd(i)}
        if any(BLANK in p.lstrip(BLANK) for p in self.rank):
            raise ValueError("pieces reach across words")
        if sp.normalize("a  b ﬁ ") != f"{BLANK}a{BLANK}{BLANK}b ﬁ{BLANK}":
            raise ValueError("the model rewrites texts, so prefixes of a text are not prefixes of what it codes")
        self.longest = max(map(len, self.rank))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        # line ends that no piece holds stand alone too
        lone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.rank))
        self.split = re.compile(f"{BLANK}+[^{BLANK}{lone}]*|[^{BLANK}{lone}]+" + f"|[{lone}]" * bool(lone))

    def merge(self, text: str) -> list[str]:
        """The coding of a short string by its definition: best merge first, leftmost on ties."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def learn(self, words: list[str]) -> None:
        """Adds the counts after each character of new words.

        In sorted order a word begins as the one before it did, so only the recurrence's
        steps behind the common beginning are taken.
        """
        rank, pairs, longest, cache = self.rank, self.pairs, self.longest, self.words
        last, count, before = [""], [0], ""
        for word in sorted(words):
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :]
            before = word
            for i in range(same + 1, len(word) + 1):
                for j in range(max(0, i - longest), i):
                    t = word[j:i]
                    if t in rank:
                        left = last[j]
                        known = pairs.get((left, t))
                        if known or known is None and self.follows(left, t):
                            last.append(t)
                            count.append(count[j] + 1)
                            break
                else:  # a character without a piece: one token for each of its bytes
                    last.append(word[i - 1])
                    count.append(count[i - 1] + len(word[i - 1].encode("utf-8", "surrogatepass")))
            cache[word] = array("i", count[1:]).tobytes()

    def prefixes(self, texts: list[str]) -> list[np.ndarray]:
        """Token counts of all prefixes of each text, the empty one first."""
        cache = self.words
        if len(cache) > CACHE_WORDS:
            cache.clear()
        parts = [self.split.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        self.learn({w for p in parts for w in p if w not in cache})
        out = []
        for part in parts:
            if not part:
                out.append(np.zeros(1, "<i4"))
                continue
            tables = [cache[w] for w in part]
            counts = np.frombuffer(b"".join(tables), "<i4")
            ends = np.cumsum(np.fromiter(map(len, part), "i8", len(part)))
            totals = counts[ends - 1]
            before = np.cumsum(totals) - totals
            counts = counts + np.repeat(before, np.diff(ends, prepend=0)).astype("<i4")
            counts[0] = 0  # the blank in front belongs to no prefix
            out.append(counts)
        for word in [w for w in self.words if len(w) > LONG_WORD] if any(len(w) > LONG_WORD for p in parts for w in p) else ():
            del cache[word]
        return out

    def prefix(self, text: str) -> np.ndarray:
        return self.prefixes([text])[0]

    @classmethod
    def of(cls, model: bytes) -> PrefixTable:
        key = zlib.crc32(model)
        if key not in _TABLES:
            _TABLES[key] = cls(model)
        return _TABLES[key]


def prefix_token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes and ``counts``: tokens of each prefix of the text, from the empty one on.

    A null text is an empty one: counts is [0].  Rows are independent of each other;
    repeated rows and null ids give a row each.  The model's file is read by the driver and
    sent to the tasks (half a megabyte), so it need not lie on every machine.
    """
    with open(model, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("counts", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PrefixTable.of(shipped.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and size < CHUNK_CHARS:
                    size += len(texts[stop])
                    stop += 1
                rows = table.prefixes(texts[start:stop])
                offsets = np.concatenate([np.zeros(1, "i4"), np.cumsum([len(r) for r in rows], dtype="i4")])
                counts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))
                ids, sizes = (batch.column(c).slice(start, stop - start) for c in ("doc_id", "n_bytes"))
                yield pa.RecordBatch.from_arrays([ids, sizes, counts], schema=schema)
                start = stop

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
    )
    return source.mapInArrow(count, "doc_id long, n_bytes long, counts array<int>")


def n_tokens(counts: Column | str = "counts") -> Column:
    """Tokens of the whole text."""
    return F.element_at(counts, -1).cast("long")


def longest_prefix(counts: Column | str, budget: Column | int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens, without coding again."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    column = F.col(counts) if isinstance(counts, str) else counts
    fits = F.filter(F.sequence(F.lit(0), F.size(column) - 1), lambda i: F.get(column, i) <= limit)
    return F.array_max(fits).cast("long")


def tokens_between(counts: Column | str, start: Column | int, end: Column | int) -> Column:
    """Tokens by which the prefix grows from ``start`` to ``end`` characters."""
    column = F.col(counts) if isinstance(counts, str) else counts
    at = lambda i: F.get(column, F.lit(i) if isinstance(i, int) else i)
    return (at(end) - at(start)).cast("long")
