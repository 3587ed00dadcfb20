"""Score arithmetic shared by the detectors, calibration and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Severity names in rising order, with their rank.
SEVERITIES = ("debug", "info", "warning", "error", "critical")

# Lower edges of the bands; a score on an edge is in the upper band.
DETECTOR_BANDS = (("warning", 0.50), ("error", 0.75), ("critical", 0.90))
CALIBRATED_BANDS = (("info", 0.20), ("warning", 0.50), ("error", 0.75), ("critical", 0.90))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def is_finite(c: Column) -> Column:
    """True for a real number: not null, not NaN, not infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def severity_rank(c: Column) -> Column:
    rank = F.lit(None).cast("int")
    expr = None
    for i, name in enumerate(SEVERITIES):
        expr = F.when(c == name, F.lit(i)) if expr is None else expr.when(c == name, F.lit(i))
    return expr.otherwise(rank)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (rank + 1).cast("int"))


def severity_from_score(score: Column, bands: Sequence[tuple[str, float]], floor: str) -> Column:
    """Highest band whose lower edge is not above the score; ``floor`` below every edge."""
    edges = [e for _, e in bands]
    if any(b <= a for a, b in zip(edges, edges[1:])) or not (0.0 < edges[0] and edges[-1] <= 1.0):
        raise ValueError(f"severity edges must rise strictly within (0, 1], got {edges}")
    expr = None
    for name, edge in reversed(list(bands)):
        expr = F.when(score >= edge, name) if expr is None else expr.when(score >= edge, name)
    return F.when(score.isNotNull(), expr.otherwise(F.lit(floor)))
