"""Text hygiene: failure messages, secret scans, metric names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

METRIC_NAME = "^[a-zA-Z_:][a-zA-Z0-9_:]*$"

# A message matching any of these is replaced as a whole.
UNSAFE_PATTERNS = (
    r"(?i)\btraceback\b",
    r"(?i)\b(?:password|secret|token|api[_-]?key|credential)s?\b",
    r"\b[A-Za-z]:[\\/][^\s]*",
    r"\\\\[^\\/\s]+[\\/][^\s]+",
    r"(?<![\w:])/(?:[^/\s]+/)*[^/\s]+",
    r"(?i)<[^>]*(?:object|instance)[^>]*>",
    r"\b0x[0-9A-Fa-f]+\b",
    r"^[\[{].*[\]}]$",
)
# The replacement of an unsafe message, and the longest one kept.
SAFE_MESSAGE = "Operation failed"
MAX_MESSAGE = 500

# Words that betray a secret in a key or a text value.
SECRET_WORDS = (
    "password",
    "secret",
    "api_key",
    "apikey",
    "access_token",
    "bearer ",
    "private_key",
    "client_secret",
)
# Keys that hold measured results.
MEASURED_KEYS = (
    "measured_results",
    "measured_metrics",
    "predictions",
    "predicted_labels",
    "anomaly_scores",
    "anomaly_score",
    "detected_anomalies",
    "true_positives",
    "false_positives",
    "evaluation_scores",
    "evaluation_results",
    "f1_score_value",
    "accuracy_score",
)


def sanitise_message(message: Column) -> Column:
    """Collapse white space; hide unsafe text entirely; cut at 500 characters with dots."""
    text = F.trim(F.regexp_replace(message, r"(?U)\s+", " "))
    unsafe = F.lit(False)
    for pattern in UNSAFE_PATTERNS:
        unsafe = unsafe | text.rlike(pattern)
    cut = F.concat(F.substring(text, 1, MAX_MESSAGE - 3), F.lit("..."))
    return F.when(text == "", F.lit("")).when(unsafe, F.lit(SAFE_MESSAGE)).when(F.length(text) > MAX_MESSAGE, cut).otherwise(text)


def truncate_failure(message: Column, limit: int = 500) -> Column:
    """Line breaks to blanks, trimmed, cut with a marker; an empty message has a fixed text."""
    flat = F.trim(F.translate(message, "\r\n", "  "))
    return (
        F.when(F.coalesce(message, F.lit("")) == "", F.lit("Unknown error"))
        .when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit(" [truncated]")))
        .otherwise(flat)
    )


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in text)


def secret_in_json(json_text: Column) -> Column:
    """True if any key or text value of the document contains a secret word."""
    # Re-serialising resolves escapes, so a word cannot hide behind \\u sequences.
    plain = F.lower(F.to_json(F.try_parse_json(json_text)))
    words = "|".join(_quoted(w) for w in SECRET_WORDS)
    return F.coalesce(plain.rlike(f'"(?:[^"\\\\]|\\\\.)*?(?:{words})'), F.lit(False))


def measured_key_in_json(json_text: Column) -> Column:
    """True if any key of the document contains the name of a measured result."""
    plain = F.lower(F.to_json(F.try_parse_json(json_text)))
    words = "|".join(_quoted(w) for w in MEASURED_KEYS)
    return F.coalesce(plain.rlike(f'"(?:[^"\\\\]|\\\\.)*?(?:{words})(?:[^"\\\\]|\\\\.)*"\\s*:'), F.lit(False))
