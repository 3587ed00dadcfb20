"""Secret scan: fixed patterns, and sliding-window entropy per character class.

A candidate is a run of one class's characters.  A window slides over it, of fixed width or as
long as a shorter run; its Shannon entropy follows from the counts of its characters, of which each step changes
two.  Windows above the thresholds of class and width merge into spans; spans that the allow-list
covers are suppressed.  Everything is decided within a text, so rows never meet and the
scan is one pass without a shuffle.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The patterns of the contract, kinds in order.
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
MIN_ASSIGNED = 6


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``pattern`` are candidates; keys drawn from ``alphabet`` are to be found."""

    pattern: str
    alphabet: str


LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
SHORTEST, WINDOW = 16, 24
CLASSES = (
    CharacterClass(r"[0-9A-Fa-f]{16,}", DIGITS + "abcdef"),
    CharacterClass(r"[A-Z0-9]{16,}", UPPER + "234567"),
    CharacterClass(r"[a-z0-9]{16,}", LOWER + DIGITS),
    CharacterClass(r"[A-Za-z]{16,}", UPPER + LOWER),
    CharacterClass(r"[A-Za-z0-9]{16,}", UPPER + LOWER + DIGITS),
    CharacterClass(r"[A-Za-z0-9+/_=-]{16,}", UPPER + LOWER + DIGITS + "+/"),
)
# Shares of random keys of an alphabet and length that may fall below each threshold: recall is
# at least 98.5 % for keys as long as the window, and higher for longer ones.
MISSED_BITS, MISSED_TURNS = 0.01, 0.005


def kind_of(ch: str) -> int:
    return 0 if ch in LOWER else 1 if ch in UPPER else 2 if ch in DIGITS else 3


@functools.cache
def thresholds(alphabet: str, width: int) -> tuple[float, int]:
    """Bits of entropy, and changes between lower case, upper case, digits and signs, of random keys.

    Drawn once for each alphabet and width; words and counters have fewer of one or the other.
    """
    draws, size = 10_000, len(alphabet)
    keys = np.random.default_rng(20_240_601).integers(0, size, (draws, width))
    counts = np.bincount((keys + np.arange(draws)[:, None] * size).ravel(), minlength=draws * size).reshape(draws, size)
    bits = math.log2(width) - (counts * np.log2(np.maximum(counts, 1))).sum(axis=1) / width
    kinds = np.array([kind_of(ch) for ch in alphabet])[keys]
    turns = (kinds[:, 1:] != kinds[:, :-1]).sum(axis=1)
    return float(np.quantile(bits, MISSED_BITS, method="lower")), int(np.quantile(turns, MISSED_TURNS, method="lower"))


# What is known to be no secret, though it looks random.  Of an address, host and path are known;
# user, password, query and fragment are not.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?:sha(?:1|256|384|512)|md5)[:=-][A-Za-z0-9+/=]+",
    r"(?<![A-Za-z])[A-Za-z]++://(?![^\x20\x09-\x0D/?#@]*+@)[^\x20\x09-\x0D?#]+",
    r"(?<=@)[A-Za-z0-9.-]++(?::[0-9]++)?/[^\x20\x09-\x0D?#]*",
    r"(?<![A-Za-z])[A-Za-z]++(?:[-_/][A-Za-z]++)++",
)

SPAN = "array<struct<kind:string,start:long,end:long>>"


def assigned(text: str) -> list[tuple[int, int]]:
    if "=" not in text and ":" not in text:
        return []
    return [m.span() for m in ASSIGN.finditer(text) if len(m.group(1)) >= MIN_ASSIGNED]


def high_windows(run: str, width: int, bits: float, turns: int = 0) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``run`` with at least ``bits`` of entropy and ``turns`` changes of kind."""
    if len(run) < width:
        return []
    changes = [0]  # up to each character
    if turns:
        kinds = [kind_of(ch) for ch in run]
        changes += itertools.accumulate(map(operator.ne, kinds, kinds[1:]))
    terms = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    for ch in run[:width]:
        counts[ch] = counts.get(ch, 0) + 1
    total, most = sum(terms[c] for c in counts.values()), width * (math.log2(width) - bits)
    found: list[tuple[int, int]] = []
    for start in range(len(run) - width + 1):
        if start:
            old, new = run[start - 1], run[start + width - 1]
            if old != new:
                c = counts[old]
                total += terms[c - 1] - terms[c]
                counts[old] = c - 1
                c = counts.get(new, 0)
                total += terms[c + 1] - terms[c]
                counts[new] = c + 1
        if total <= most + 1e-9 and (not turns or changes[start + width - 1] - changes[start] >= turns):
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], start + width)
            else:
                found.append((start, start + width))
    return found


def entropy_spans(text: str, classes, width: int, allow) -> list[tuple[int, int]]:
    """Spans of high entropy outside the allow-list, merged over the classes."""
    spans: list[tuple[int, int]] = []
    for pattern, alphabet in classes:
        for m in pattern.finditer(text):
            run = m.group()
            # words in lower case, capitalised or not, and numbers are no keys
            if run.isdigit() or run.isalpha() and run[1:].islower():
                continue
            fit = min(width, len(run))
            spans += [(m.start() + a, m.start() + b) for a, b in high_windows(run, fit, *thresholds(alphabet, fit))]
    if not spans:
        return []
    spans.sort()
    merged = [spans[0]]
    for a, b in spans[1:]:
        if a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    if allow is not None:
        known = [m.span() for m in allow.finditer(text)]
        merged = [s for s in merged if not any(a <= s[0] and s[1] <= b for a, b in known)]
    return merged


def scan_text(text: str, classes, width: int, allow) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of all spans, by start, then kind."""
    spans = [(a, 0, b) for a, b in assigned(text)]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(a, 3, b) for a, b in entropy_spans(text, classes, width, allow)]
    return sorted(spans)


def scan_secrets(docs: DataFrame, classes=CLASSES, width: int = WINDOW, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end; code points) of each row of (doc_id, text).

    A null text is scanned as an empty one.  Rows are independent: repeated rows and
    null ids give a row each, other columns are not read.  Long texts are scanned whole.
    """

    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(re.compile(c.pattern), c.alphabet) for c in classes]
        allowed = re.compile("|".join(f"(?:{a})" for a in allow)) if allow else None
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan_text(t, compiled, width, allowed)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, span)], names=["doc_id", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(scan, f"doc_id long, spans {SPAN}")


def secret_digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of a scan."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return scanned.select(
        "doc_id",
        *[n(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
