"""Linear reconstruction error: PCA from Spark aggregates, error by array arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from opsweave.functions.skew import lookup_join
from opsweave.session import materialise


def fit_reconstruction(train: DataFrame, keys: Sequence[str], width: int, bottleneck: int = 1) -> DataFrame:
    """One row per key: ``center``, ``components`` (bottleneck unit vectors) and ``n``.

    The best linear bottleneck of size k spans the k leading eigenvectors of the
    covariance matrix.  Means and cross products are plain aggregates with a partial
    step; only the width*width matrix of a key reaches Python.
    """
    if not 1 <= bottleneck < width:
        raise ValueError("bottleneck must be at least 1 and smaller than the number of features")
    keys = list(keys)
    # One row per matrix cell would shuffle width^2 rows per input; the sums of a whole
    # partition are folded in Arrow batches first and merged by a tiny second aggregate.
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in train.schema.fields if f.name in keys)
    partial_schema = (f"{fields}, " if fields else "") + "n bigint, total array<double>, cross array<double>"

    def fold(batches):
        sums: dict[tuple, list] = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                x = np.array(part["vector"].tolist(), dtype=float)
                acc = sums.setdefault(key, [0, np.zeros(width), np.zeros((width, width))])
                acc[0] += len(x)
                acc[1] += x.sum(axis=0)
                acc[2] += x.T @ x
            if len(sums) >= 1024:
                yield flush(sums)
                sums = {}
        if sums:
            yield flush(sums)

    def flush(sums) -> pd.DataFrame:
        rows = [(*k, a[0], a[1].tolist(), a[2].ravel().tolist()) for k, a in sums.items()]
        return pd.DataFrame(rows, columns=[*keys, "n", "total", "cross"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = dict(zip([*keys, "_part"], key))
        row.update(
            n=int(pdf["n"].sum()),
            total=np.sum(np.array(pdf["total"].tolist()), axis=0).tolist(),
            cross=np.sum(np.array(pdf["cross"].tolist()), axis=0).tolist(),
        )
        return pd.DataFrame([row])

    # Two merge levels: no task reads the matrices of more than 1/64 of the partitions.
    partial = (
        train.select(*keys, "vector")
        .mapInPandas(fold, partial_schema)
        .withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)).cast("int"))
        .groupBy(*keys, "_part")
        .applyInPandas(merge, f"{partial_schema}, _part int")
        .drop("_part")
    )
    merged_schema = (f"{fields}, " if fields else "") + "n bigint, center array<double>, components array<array<double>>"

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        total = np.sum(np.array(pdf["total"].tolist()), axis=0)
        cross = np.sum(np.array(pdf["cross"].tolist()), axis=0).reshape(width, width)
        mean = total / n
        cov = cross / n - np.outer(mean, mean)
        _, vectors = np.linalg.eigh((cov + cov.T) / 2)
        top = vectors[:, ::-1][:, :bottleneck].T
        # Fix the sign so that equal data give equal components.
        flip = np.sign(top[np.arange(bottleneck), np.abs(top).argmax(axis=1)])
        row = dict(zip(keys, key))
        row.update(n=n, center=mean.tolist(), components=(top * flip[:, None]).tolist())
        return pd.DataFrame([row])

    if not keys:
        partial, keys_used = partial.withColumn("_all", F.lit(0)), ["_all"]
        schema = "_all int, " + merged_schema

        def solve_all(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return solve((), pdf).assign(_all=0)[["_all", "n", "center", "components"]]

        return partial.groupBy(*keys_used).applyInPandas(solve_all, schema).drop("_all")
    return partial.groupBy(*keys).applyInPandas(solve, merged_schema)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def reconstruction_error(rows: DataFrame, model: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Adds ``squared_errors ARRAY`` per feature and ``raw_score`` (their mean), all in the JVM."""
    keys = list(keys)
    fit = materialise(model)
    if keys:
        joined = lookup_join(rows, fit, keys, [row_id])
    else:
        joined = rows.crossJoin(F.broadcast(fit))  # one row: the single model
    centred = F.zip_with("vector", "center", lambda v, c: v - c)
    step = joined.withColumn("_d", centred).withColumn(
        "_codes", F.transform("components", lambda comp: _dot(comp, F.col("_d")))
    )
    # d - sum_k code_k * component_k, feature by feature
    back = F.aggregate(
        F.arrays_zip(F.col("_codes").alias("code"), F.col("components").alias("comp")),
        F.col("_d"),
        lambda acc, kc: F.zip_with(acc, F.transform(kc["comp"], lambda w: w * kc["code"]), lambda p, q: p - q),
    )
    return (
        step.withColumn("squared_errors", F.transform(back, lambda e: e * e))
        .withColumn("raw_score", F.aggregate("squared_errors", F.lit(0.0), lambda a, v: a + v) / F.size("squared_errors"))
        .drop("_d", "_codes", "center", "components", "n")
    )
