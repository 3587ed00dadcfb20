"""Deterministic identities: name-based UUIDs and SHA-256 fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

# Default namespaces; pass another namespace to reproduce ids minted elsewhere.
EVALUATION_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "opsweave.evaluation")
INCIDENT_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "opsweave.incident")
TIMELINE_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "opsweave.timeline-event")
HANDOFF_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "opsweave.handoff")
SIGNAL_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "opsweave.signal")

# Hyphenated, also in braces or as a URN, or 32 digits alone.
_HYPHENATED = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
UUID_PATTERN = f"^(?:{_HYPHENATED}|\\{{{_HYPHENATED}\\}}|urn:uuid:{_HYPHENATED}|[0-9a-fA-F]{{32}})$"


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 version-5 UUID of a string column, equal to Python's ``uuid.uuid5``."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def joined(*parts: Column | str, sep: str = "|") -> Column:
    """Join parts as text; a null part becomes the empty string (``concat_ws`` would skip it)."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat_ws(sep, *cols)


def fingerprint(*cols: Column | str) -> Column:
    """SHA-256 of the columns as compact JSON with sorted keys; nulls are kept as keys."""
    named = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


def is_fingerprint(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID_PATTERN)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with a UTC offset; fractional seconds only when present."""
    micros = F.unix_micros(ts)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.when(F.pmod(micros, F.lit(1_000_000)) == 0, F.lit("")).otherwise(F.date_format(ts, ".SSSSSS"))
    return F.concat(whole, frac, F.lit("+00:00"))


def canonical_uuid(c: Column) -> Column:
    """A text that ``is_uuid`` accepts in lower case with hyphens."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(c), "^urn:uuid:", ""), "[^0-9a-f]", "")
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
