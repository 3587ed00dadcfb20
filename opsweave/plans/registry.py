"""Query registry."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opsweave.plans.inputs import with_views
from opsweave.session import prepare

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


# Values are compared at six decimals.  Averages of two-decimal data often end in an
# exact 5 there, where the last bit of a sum would decide; the nudge moves off the tie.
_NUDGE = 1e-9


def round6(value: Column | str) -> Column:
    """``round(value + nudge, 6)``; decimals, which take most of the time, only decide near a tie."""
    moved = (F.col(value) if isinstance(value, str) else value) + F.lit(_NUDGE)
    scaled = moved * F.lit(1e6)
    whole = F.rint(scaled)
    plain = (F.abs(scaled - whole) < 0.499) & (F.abs(moved) < 1e6)
    return F.when(plain, whole / F.lit(1e6) + F.lit(0.0)).otherwise(F.round(moved, 6))


def _expand_r6(sql: str) -> str:
    """Rewrite ``r6(expr)`` in a check query to the same rounding."""
    while match := re.search(r"\br6\(", sql):
        depth, end = 1, match.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[match.end() : end - 1]
        sql = f"{sql[:match.start()]}round(({inner}) + {_NUDGE!r}, 6){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a plan; ``sql`` is the check query over ``views`` and the base tables."""

    def register(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        PLANS[name] = run
        if sql is not None:
            ORACLES[name] = _expand_r6(with_views(sql, *views))
        return fn

    return register
