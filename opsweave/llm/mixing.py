"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) / quality; in ascending key order the
documents of a source are a weighted sample without replacement of any length.  A source
is taken in complete epochs first; what is left of its target is filled from the front of
that order, found by prefix sums of sizes.  The sums run over range-partitioned slices of
(source, key), so a source that holds a third of all rows is spread like the others, and
what comes out is one cut key per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opsweave.functions.skew import running_total, slice_by_order
from opsweave.llm.common import WORD, cut, fingerprint, small_side

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix-1"


def n_words(text: Column | str = "text") -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def exponential_key(doc_id: Column, quality: Column, seed: str = SEED) -> Column:
    """-ln(u) / quality with u in (0, 1) from the document's id, the same in every run.

    Rows that repeat an id share a key; ``take`` tells them apart where the budget ends among them.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / quality


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size).

    Sources in code point order, null last, get the weights in turn and share the sum of
    all sizes.  No target exceeds ``most_epochs`` times its source; the excess goes to the
    others by weight.  That is a common level per unit of weight; each round caps the
    sources below the level and raises it, until none is above its cap.
    """
    named = sources.withColumn("_last", F.col("source").isNull())
    ranked = running_total(slice_by_order(named, [], ["_last", "source"]), [], ["_last", "source"], F.lit(1), "_position")
    turn = (F.col("_position") - 1) % len(weights) + 1
    weighed = cut(ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).alias("_weight")))
    cap = F.col("source_size") * most_epochs
    total, units = weighed.agg(F.sum("source_size"), F.sum("_weight")).first()
    level = (total or 0) / (units or 1)
    while True:
        below = cap <= F.col("_weight") * F.lit(level)
        capped, open_units = weighed.agg(F.sum(F.when(below, cap)), F.sum(F.when(~below, F.col("_weight")))).first()
        if not open_units:
            break
        raised = (total - (capped or 0)) / open_units
        if raised <= level:
            break
        level = raised
    return weighed.select("source", "source_size", F.least(cap.cast("double"), F.col("_weight") * F.lit(float(level))).alias("target"))


def sized(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id, source, size in words and fp of rows (doc_id, text, source), and ``more``.

    Null and empty texts have no words.
    """
    return docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), n_words(docs["text"]).alias("size"), fingerprint(docs["text"]).alias("fp"), *more)


def rate(sizes: DataFrame, labels: DataFrame, good: float = 2.0, poor: float = 0.5) -> DataFrame:
    """Adds ``quality``: ``good`` or ``poor`` where (doc_id, quality) is labelled 1 or 0, else 1.

    A document with several labels has its best one.
    """
    best = cut(labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_doc")).agg(F.max("quality").alias("_label")))
    joined = sizes.join(small_side(best), F.col("doc_id") == F.col("_doc"), "left")
    return joined.withColumn("quality", F.when(F.col("_label") == 1, good).when(F.col("_label") == 0, poor).otherwise(1.0)).drop("_doc", "_label")


def plan_mix(rated: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """Per source: source_size, target, epochs, and where the last, partial epoch ends.

    All keys up to ``whole_key`` are in it.  Of the rows with ``cut_key``, ``cut_rows`` in number, it
    holds what ``cut_left`` words have room for.  ``rated`` has doc_id, source, size and a positive
    quality.  Documents without words are never taken.  A null source is a source.
    """
    source_id = F.xxhash64("source", F.col("source").isNull()).alias("_id")
    drawn = cut(rated.select("source", "size", exponential_key(F.col("doc_id"), F.col("quality"), seed).alias("key")))
    targets = source_targets(cut(drawn.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    planned = cut(targets.select("source", "source_size", "target", epochs.alias("epochs"), source_id))
    # rows of one key are one step of the sums, so that a repeated id stays small
    steps = drawn.where("size > 0").select(source_id, "key", "size").groupBy("_id", "key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    summed = running_total(slice_by_order(steps, ["_id"], ["key"]), ["_id"], ["key"], F.col("words"), "_upto")
    left = planned.select("_id", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("_left"))
    placed = summed.join(small_side(left), "_id").withColumn("fits", F.col("_upto") <= F.col("_left"))
    first = F.min(F.when(~F.col("fits"), F.struct("key", (F.col("_left") - F.col("_upto") + F.col("words")).alias("left"), "n")))
    ends = placed.groupBy("_id").agg(F.max(F.when(F.col("fits"), F.col("key"))).alias("whole_key"), first.alias("first"))
    last = ends.select("_id", "whole_key", F.col("first.key").alias("cut_key"), F.col("first.left").alias("cut_left"), F.col("first.n").alias("cut_rows"))
    return cut(planned.join(last, "_id", "left").drop("_id"))


def take(rated: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds source_size, target and ``copies``, the times the mix takes a row, to ``rated``.

    The budget ends inside a document: that one is taken if more than half of it fits.  Where it ends
    among rows that repeat an id (or have none), these are taken in the order of size and
    text, each by the same rule, so a source misses its target by half a document at most.
    """
    side = plan.withColumnRenamed("source", "_source")
    joined = rated.join(small_side(side), F.col("source").eqNullSafe(F.col("_source")), "left")
    keyed = joined.withColumn("_key", exponential_key(F.col("doc_id"), F.col("quality"), seed))
    at_cut, half = F.coalesce(F.col("_key") == F.col("cut_key"), F.lit(False)), F.col("size") / 2
    tied = at_cut & (F.col("size") > 0) & (F.col("cut_rows") > 1)
    chosen = F.when(at_cut, half <= F.col("cut_left")).otherwise(F.coalesce(F.col("_key") <= F.col("whole_key"), F.lit(False)))

    def copies(last: Column) -> Column:
        return F.when(F.col("size") > 0, F.col("epochs") + last.cast("int")).otherwise(0).alias("copies")

    out = [*rated.columns, "source_size", "target"]
    if plan.where("cut_rows > 1").isEmpty():
        return keyed.select(*out, copies(chosen))
    # the salt only spreads equal rows over slices; which of them is taken makes no difference
    order = ["size", "fp", "_salt"]
    source_id = F.xxhash64("source", F.col("source").isNull())
    ties = slice_by_order(keyed.where(tied).withColumns({"_id": source_id, "_salt": F.xxhash64(F.monotonically_increasing_id())}), ["_id"], order)
    summed = running_total(ties, ["_id"], order, F.col("size"), "_upto")
    return keyed.where(~tied).select(*out, copies(chosen)).unionByName(summed.select(*out, copies(F.col("_upto") - half <= F.col("cut_left"))))


def mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    rated = rate(sized(docs, F.struct(*[docs[c] for c in docs.columns]).alias("_row")), labels)
    taken = take(rated, plan_mix(rated))
    return taken.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
