"""Quantiles of everything before each window, without sorting any past anew.

Two levels, both of bounded size, so that one long series spreads over tasks:

1. The values of a series get their ranks by a distributed sort and are dealt to buckets
   of SLICE consecutive ranks; windows are dealt to slices of SLICE window numbers.  The
   counts per (slice, bucket) are summed up over slices; a slice's task adds its own
   rows and so finds, for each window and wanted rank, the bucket and the rank in it.
2. A task with one slice's questions to one bucket answers them on the bucket's values in
   order of time by a wavelet matrix: ranks are split bit by bit, and each bit answers for
   all questions at once how many of a prefix lie in the lower half.

Defined cases: missing values and NaN are no history; a window
without history has null quantiles; ties are told apart by time; an empty table gives an
empty result.  Window numbers are unique in a series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from opsweave.functions.skew import running_total, slice_by_order
from opsweave.session import materialise

SLICE = 16_384
_CHUNK = 1024


def kth_of_prefixes(ranks: np.ndarray, length: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each question the ``k``-th smallest (from 0) of the first ``length`` entries of ``ranks``,
    a permutation of 0 .. n-1.  All questions go down one bit at a time."""
    rest, found = k.astype("i8"), np.zeros(len(k), "i8")
    low, high = np.zeros(len(k), "i8"), length.astype("i8")
    row = ranks.astype("i8")
    for bit in reversed(range(max(1, int(len(ranks) - 1).bit_length()))):
        upper = (row >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - upper)])
        inside = zeros[high] - zeros[low]
        right = rest >= inside
        rest = np.where(right, rest - inside, rest)
        found |= right.astype("i8") << bit
        low = np.where(right, zeros[-1] + low - zeros[low], zeros[low])
        high = np.where(right, zeros[-1] + high - zeros[high], zeros[high])
        row = np.concatenate([row[upper == 0], row[upper == 1]])
    return found


def _questions(before: np.ndarray, buckets: np.ndarray, quantiles: Sequence[float]) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, slot, bucket, rank in it, history) of a slice's windows; bucket -1 is a missing value."""
    counts = before.astype("i8")
    for start in range(0, len(buckets), _CHUNK):
        own = buckets[start : start + _CHUNK]
        here = np.flatnonzero(own >= 0)
        added = np.zeros((len(own) + 1, len(counts)), "i8")
        added[here + 1, own[here]] = 1
        upto = counts + np.cumsum(added, axis=0)
        counts = upto[-1]
        cumulative = np.cumsum(upto[:-1], axis=1)
        n = cumulative[:, -1]
        known = np.flatnonzero(n)
        for i, q in enumerate(quantiles):
            first = np.floor(q * (n[known] - 1)).astype("i8")
            for side in (0, 1):
                k = np.minimum(first + side, n[known] - 1)
                bucket = (cumulative[known] <= k[:, None]).sum(axis=1)
                below = np.where(bucket > 0, cumulative[known, bucket - 1], 0)
                yield start + known, np.full(len(known), 2 * i + side), bucket, k - below, n[known]


def prefix_quantiles(windows: DataFrame, keys: Sequence[str], values: dict[str, Column], quantiles: Sequence[float], slice_size: int = SLICE) -> DataFrame:
    """Adds ``<name>__q<i>`` for each of ``values`` (null: no history) and each quantile, interpolated
    linearly between ranks, over the windows before each one."""
    names = list(values)
    series = F.to_json(F.struct(*keys)) if keys else F.lit("")
    marked = windows.withColumn("_s", series)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.nanvl(values[c].cast("double"), F.lit(None).cast("double")).alias("_v")) for i, c in enumerate(names)]))
    long = marked.select("_s", F.col("window_index").cast("long").alias("_at"), cells.alias("_cell")).select("_s", "_at", "_cell.*")
    group, order = ["_s", "_c"], ["_v", "_at"]
    there = F.when(F.col("_v").isNotNull(), 1).otherwise(0)
    ranked = running_total(slice_by_order(long, group, order), group, order, there, "_rank")
    bucket = F.floor(F.greatest(F.col("_rank") - 1, F.lit(0)) / slice_size).cast("int")
    ranked = materialise(ranked.select(*group, "_at", "_v", F.floor(F.col("_at") / slice_size).cast("long").alias("_t"), bucket.alias("_b")))

    counts = ranked.groupBy(*group, "_t", "_b").agg(F.sum(there).alias("_n"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """A series' counts, (windows / slice)^2 at most: per slice those of all slices before."""
        total, out = np.zeros(int(pdf["_b"].max()) + 1, "i8"), []
        for t, part in pdf.sort_values("_t").groupby("_t"):
            out.append((pdf["_s"].iloc[0], int(pdf["_c"].iloc[0]), int(t), total.tolist()))
            np.add.at(total, part["_b"].to_numpy(), part["_n"].to_numpy())
        return pd.DataFrame(out, columns=[*group, "_t", "before"])

    before = counts.groupBy(*group).applyInPandas(fold, "_s string, _c int, _t long, before array<long>")
    entry = F.struct("_at", F.when(F.col("_v").isNotNull(), F.col("_b")).otherwise(-1).alias("_b"))
    slices = ranked.groupBy(*group, "_t").agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    packed = slices.select(*group, "_t", F.transform("_rows", lambda r: r["_at"]).alias("at"), F.transform("_rows", lambda r: r["_b"]).alias("b"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.to_dict("records"):
                at, own = np.asarray(row["at"], "i8"), np.asarray(row["b"], "i8")
                parts = list(_questions(np.asarray(row["before"], "i8"), own, quantiles))
                if not parts:
                    continue
                place, slot, where, rank, n = (np.concatenate(c) for c in zip(*parts))
                rows = []
                for b in np.unique(where):
                    own_b = where == b
                    rows.append((row["_s"], row["_c"], int(b), at[place[own_b]], slot[own_b], rank[own_b], n[own_b]))
                yield pd.DataFrame(rows, columns=[*group, "_b", "at", "slot", "rank", "n"])

    asked = packed.join(before, [*group, "_t"]).mapInPandas(ask, "_s string, _c int, _b int, at array<long>, slot array<int>, rank array<long>, n array<long>")
    kept = ranked.where(F.col("_v").isNotNull()).groupBy(*group, "_b").agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_rows"))
    buckets = kept.select(*group, "_b", F.transform("_rows", lambda r: r["_at"]).alias("_times"), F.transform("_rows", lambda r: r["_v"]).alias("_values"))

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.to_dict("records"):
                times, found = np.asarray(row["_times"], "i8"), np.asarray(row["_values"], float)
                sorted_places = np.lexsort((times, found))
                ranks = np.empty(len(found), "i8")
                ranks[sorted_places] = np.arange(len(found))
                at = np.asarray(row["at"], "i8")
                kth = kth_of_prefixes(ranks, np.searchsorted(times, at), np.asarray(row["rank"], "i8"))
                yield pd.DataFrame({"_s": row["_s"], "_c": row["_c"], "_at": at, "slot": np.asarray(row["slot"], "i4"), "n": np.asarray(row["n"], "i8"), "v": found[sorted_places[kth]]})

    answers = asked.join(buckets, [*group, "_b"]).mapInPandas(answer, "_s string, _c int, _at long, slot int, n long, v double")
    cell = lambda c, slot: F.max(F.when((F.col("_c") == c) & (F.col("slot") == slot), F.col("v")))
    aggs = [F.max(F.when(F.col("_c") == c, F.col("n"))).alias(f"_n{c}") for c in range(len(names))]
    aggs += [cell(c, s).alias(f"_v{c}_{s}") for c in range(len(names)) for s in range(2 * len(quantiles))]
    wide = answers.groupBy("_s", "_at").agg(*aggs)
    out = [F.col("_s").alias("_s2"), F.col("_at").alias("_at2")]
    for c, name in enumerate(names):
        for i, q in enumerate(quantiles):
            place = F.lit(q) * (F.col(f"_n{c}") - 1)
            a, z = F.col(f"_v{c}_{2 * i}"), F.col(f"_v{c}_{2 * i + 1}")
            out.append((a + (place - F.floor(place)) * (z - a)).alias(f"{name}__q{i}"))
    joined = marked.join(wide.select(*out), (F.col("_s") == F.col("_s2")) & (F.col("window_index") == F.col("_at2")), "left")
    return joined.drop("_s", "_s2", "_at2")
