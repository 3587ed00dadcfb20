"""Plan steps that must not be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns in a step of their own.

    A one-element ``inline`` keeps the optimizer from copying the expressions into every
    later use and every pushed-down filter, which for long validation chains would make
    both planning and execution explode.  It works on batches and streams alike.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))
