"""Causal blocks: refit a multivariate model every few windows and score ahead of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.functions.numeric import is_finite
from opsweave.functions.skew import lookup_join
from opsweave.operators import detectors, forest, prefix_models, reconstruct
from opsweave.session import materialise


def _complete(columns: Sequence[str]):
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


def training_blocks(windows: DataFrame, columns: Sequence[str], keys: Sequence[str], refit_every: int) -> tuple[DataFrame, DataFrame]:
    """(targets, training): target block b holds windows [b*refit, (b+1)*refit), its
    training set all complete windows before the block.  ``refit_every=1`` is the exact
    one-model-per-window form; larger blocks trade freshness for fewer fits.
    """
    numbered = windows.withColumn("block", F.floor(F.col("window_index") / F.lit(refit_every)).cast("bigint"))
    last = Window.partitionBy(*keys)
    wide = numbered.withColumn("_last", F.max("block").over(last))
    train = (
        wide.where(_complete(columns) & (F.col("block") < F.col("_last")))
        .withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("_last"))))
        .drop("_last")
    )
    return numbered, train


def _scaled(targets: DataFrame, train: DataFrame, columns: Sequence[str], group: Sequence[str], method: str):
    """Scale both sides with centre and spread of the block's training rows."""
    aggs = [F.count(F.lit(1)).alias("history_windows")]
    for c in columns:
        if method == "standard":
            center, spread = F.avg(c), F.stddev_samp(c)
        elif method == "robust":
            q = F.percentile(c, [0.25, 0.5, 0.75])
            center, spread = q[1], q[2] - q[0]
        elif method == "minmax":
            center, spread = F.min(c), F.max(c) - F.min(c)
        else:
            center, spread = F.lit(0.0), F.lit(1.0)
        aggs += [center.alias(f"_c_{c}"), spread.alias(f"_s_{c}"), F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
    fit = materialise(train.groupBy(*group).agg(*aggs))

    def apply(df: DataFrame, how: str) -> DataFrame:
        joined = lookup_join(df, fit, group, ["window_index"], how)
        cells = []
        for c in columns:
            s = F.when(F.col(f"_s_{c}") >= 1e-8, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
            cells.append((F.col(c) - F.col(f"_c_{c}")) / s)
        constant = F.lit(True)
        for c in columns:
            constant = constant & (F.col(f"_lo_{c}") == F.col(f"_hi_{c}")) & (F.col(c) == F.col(f"_lo_{c}"))
        scratch = [f"_{p}_{c}" for c in columns for p in ("c", "s", "lo", "hi")]
        return (
            joined.withColumn("vector", F.array(*cells))
            .withColumn("_constant_match", F.coalesce(constant, F.lit(False)))
            .withColumn("history_windows", F.coalesce(F.col("history_windows"), F.lit(0)))
            .drop(*scratch)
        )

    return apply(targets, "left"), apply(train, "inner")


def score_causal(
    windows: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    model: str,
    refit_every: int = 1,
    min_history: int = 10,
    scaling: str = "standard",
    trees: int = 100,
    bottleneck: int = 1,
    seed: int = 42,
    max_samples: int = forest.MAX_SAMPLES,
    max_features: float = 1.0,
    bootstrap: bool = False,
    contamination: float | None = 0.05,
) -> DataFrame:
    """Scores every window with ``model`` in ('isolation_forest', 'reconstruction').

    With ``refit_every=1``, the rule, each window gets a model of all complete windows
    before it (``prefix_models``), but for robust scaling of reconstructions, which goes
    by blocks.  A forest then also gives ``sample_size``, ``score_offset`` and ``decision``
    (raw score less the contamination quantile of the history's raw scores).

    The training rows are scored by their own model as well; their minimum, mean and
    deviation anchor the tail score.  Statuses follow ``multivariate_status``.
    """
    if model not in ("isolation_forest", "reconstruction"):
        raise ValueError(f"unknown model {model!r}")
    if refit_every == 1 and not (model == "reconstruction" and scaling == "robust"):
        if model == "isolation_forest":
            fitted = prefix_models.default_forest(trees, seed, max_samples=max_samples, max_features=max_features, bootstrap=bootstrap)
        else:
            fitted, contamination = prefix_models.Reconstruction(len(columns), bottleneck, scaling), None
        results = materialise(prefix_models.score_prefixes(windows, columns, keys, fitted, min_history, contamination))
        scored = windows.join(results, [*keys, "window_index"], "left")
        if model == "isolation_forest":
            scored = scored.withColumn("decision", F.col("raw_score") - F.col("score_offset"))
            return _judged(scored, columns, min_history, model, F.lit(-1.0), detectors.FOREST_TAIL)
        return _judged(scored.drop("sample_size", "score_offset"), columns, min_history, model, F.lit(1.0), detectors.RECONSTRUCTION_TAIL)
    group = [*keys, "block"]
    targets, train = training_blocks(windows, columns, keys, refit_every)
    targets, train = _scaled(targets, train, columns, group, scaling)
    usable = _complete(columns) & (F.col("history_windows") >= min_history)
    ready = targets.where(usable).select(*group, "window_index", "vector", F.lit(True).alias("_target"))
    fitted = train.where(F.col("history_windows") >= min_history)
    learn = fitted.select(*group, "window_index", "vector", F.lit(False).alias("_target"))
    both = materialise(ready.unionByName(learn))
    learn = both.where(~F.col("_target"))
    if model == "isolation_forest":
        trees_df = forest.fit_forest(learn, group, "window_index", trees, seed, max_samples, max_features, bootstrap)
        raw = forest.score_forest(both, trees_df, group, "window_index", slices=1)
        sign, tail = F.lit(-1.0), detectors.FOREST_TAIL
    else:
        fit = reconstruct.fit_reconstruction(learn, group, len(columns), bottleneck)
        raw = reconstruct.reconstruction_error(both, fit, group, "window_index")
        sign, tail = F.lit(1.0), detectors.RECONSTRUCTION_TAIL
    raw = materialise(raw.select(*group, "window_index", "_target", "raw_score"))
    oriented = sign * F.col("raw_score")
    reference = raw.where(~F.col("_target")).groupBy(*group).agg(
        F.min(oriented).alias("_min"),
        F.avg(oriented).alias("_mean"),
        F.coalesce(F.stddev_samp(oriented), F.lit(0.0)).alias("_std"),
    )
    hits = raw.where(F.col("_target")).select(*group, "window_index", "raw_score")
    scored = targets.join(hits, [*group, "window_index"], "left").join(reference, group, "left")
    return _judged(scored, columns, min_history, model, sign, tail)


def _judged(scored: DataFrame, columns: Sequence[str], min_history: int, model: str, sign: Column, tail: dict) -> DataFrame:
    """Status, tail score and severity from the raw score and the history's scores."""
    finite = F.lit(True)
    for c in columns:
        finite = finite & is_finite(F.col(c))
    status = detectors.multivariate_status(
        ~_complete(columns), finite, F.col("history_windows"), F.col("raw_score"), min_history
    )
    score = detectors.tail_score(
        sign * F.col("raw_score"), F.col("_min"), F.col("_mean"), F.col("_std"), F.col("_constant_match"), **tail
    )
    return (
        scored.withColumn("status", status)
        .withColumn("anomaly_score", F.when(F.col("status") == "success", score))
        .withColumn("severity", detectors.detector_severity(F.col("anomaly_score")))
        .withColumn("model_name", F.lit(model))
        .withColumn("model_version", F.lit("1.0.0"))
        .drop("vector", "_min", "_mean", "_std", "_constant_match")
    )
