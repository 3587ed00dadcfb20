"""Signal intake, candidate pairs and pair scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.functions.identity import fingerprint
from opsweave.functions.numeric import clamp, severity_rank
from opsweave.functions.skew import MAX_BROADCAST_ROWS, lookup_join
from opsweave.operators import graph
from opsweave.session import materialise

CONTEXT = ("run_id", "scenario_id", "scenario_version", "seed", "reproducibility_key")
# Bounds on the grid of a block of candidate pairs: cells a side, and rows a cell from which on more are worth their copies.
MAX_CELLS = 8
MIN_CELL_ROWS = 1024
SLACK = 1e-12  # weighted sums differ in the last bit by order of addition
# Up to this many services, what holds for each two of them is kept in arrays.
MAX_CODED_SERVICES = 64
# Types whose equal values are the same value, with a value of each.
_BLANK = {"string": "", "bigint": 0, "int": 0, "smallint": 0, "tinyint": 0}


@dataclass(frozen=True)
class CorrelationConfig:
    window_seconds: int = 300
    allowed_lateness_seconds: int = 30
    quiet_period_seconds: int = 60
    hop_limit: int = 3
    temporal: float = 0.25
    service: float = 0.25
    topology: float = 0.20
    symptom: float = 0.15
    context: float = 0.15
    threshold: float = 0.6
    max_group_size: int = 100
    late: str = "accept"
    duplicate: str = "ignore"
    policy_version: str = "1.0.0"

    def __post_init__(self) -> None:
        weights = (self.temporal, self.service, self.topology, self.symptom, self.context)
        if any(not 0.0 <= w <= 1.0 for w in weights) or abs(math.fsum(weights) - 1.0) > SLACK:
            raise ValueError("weights must be in [0, 1] and sum to 1")
        if not 0.0 <= self.threshold <= 1.0 or self.hop_limit < 0:
            raise ValueError("threshold must be in [0, 1] and hop_limit at least 0")
        if not 1 <= self.window_seconds <= 86400 or self.max_group_size < 1:
            raise ValueError("window_seconds must be in 1..86400 and max_group_size positive")
        if self.late not in ("accept", "reject", "delay") or self.duplicate not in ("ignore", "reject"):
            raise ValueError("late is accept, reject or delay; duplicate is ignore or reject")


def fingerprint_signals(signals: DataFrame) -> DataFrame:
    """Adds semantic_fingerprint: SHA-256 of all columns as JSON with sorted keys."""
    return signals.withColumn("semantic_fingerprint", fingerprint(*sorted(signals.columns)))


def dedupe_signals(signals: DataFrame) -> DataFrame:
    """One row per signal_id: copies, disposition accepted or conflict.

    Same id and fingerprint is a duplicate; the same id with another fingerprint is a
    conflict, and then no copy may be used.  ``signals`` has semantic_fingerprint.
    """
    return signals.groupBy("signal_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("semantic_fingerprint").alias("semantic_fingerprint"),
        F.when(F.min("semantic_fingerprint") == F.max("semantic_fingerprint"), "accepted").otherwise("conflict").alias("disposition"),
    )


def intake_error(source_ids: Column, evidence_ids: Column, max_sources: int = 1024, max_evidence: int = 4096) -> Column:
    """Null for a valid signal, else the first broken bound on its reference lists."""
    return (
        F.when(F.size(source_ids) > max_sources, "source event count exceeds maximum")
        .when(F.size(F.array_distinct(source_ids)) != F.size(source_ids), "source event identities must be unique")
        .when(F.size(evidence_ids) > max_evidence, "evidence count exceeds maximum")
        .when(F.size(F.array_distinct(evidence_ids)) != F.size(evidence_ids), "evidence identities must be unique")
    )


def coded_services(resolution: DataFrame) -> list[str] | None:
    """The service names in order, or None if they are more than ``MAX_CODED_SERVICES``."""
    names = resolution.select("service").where("service IS NOT NULL").distinct().limit(MAX_CODED_SERVICES + 1).collect()
    return sorted(r.service for r in names) if len(names) <= MAX_CODED_SERVICES else None


def slim(signals: DataFrame, resolution: DataFrame, match: Sequence[str] = ()) -> DataFrame:
    """The signals with numbers in place of texts that pairs only compare.

    Run context (unless in ``match``) and metric become codes, equal for equal texts, while a column has few of them.
    Adds severity_rank and, for few services, service_code: the place among ``coded_services``.
    ``resolution`` has all services of the signals.
    """
    texts = [c for c, kind in signals.dtypes if c in (*CONTEXT, "metric_or_feature") and c not in match and kind == "string"]
    out, columns = signals, [F.col(c) for c in signals.columns]
    if texts:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("_of"), F.col(c).alias("_text")) for i, c in enumerate(texts)]))
        values = signals.select(each.alias("_v")).select("_v.*").where("_text IS NOT NULL").distinct()
        values = materialise(values.withColumn("_code", F.monotonically_increasing_id()))
        counts = dict(map(tuple, values.groupBy("_of").count().collect()))
        few = {c: i for i, c in enumerate(texts) if counts.get(i, 0) <= MAX_BROADCAST_ROWS}
        for c, i in few.items():
            out = out.join(F.broadcast(values.where(F.col("_of") == i).select(F.col("_text").alias(c), F.col("_code").alias(f"_code{i}"))), c, "left")
        columns = [F.col(f"_code{few[c]}").alias(c) if c in few else F.col(c) for c in signals.columns]
    columns.append(F.coalesce(severity_rank(F.col("severity")), F.lit(2)).alias("severity_rank"))
    names = coded_services(resolution)
    if names:
        place = F.array_position(F.array(*map(F.lit, names)), F.col("service"))
        columns.append(F.when(place > 0, (place - 1).cast("int")).alias("service_code"))
    return out.select(*columns)


def cells_a_side(rows: Column, block_rows: int) -> Column:
    """Cells a side of the grid of a block with so many leading rows."""
    bound = F.greatest(F.lit(MAX_CELLS).cast("long"), F.ceil(rows / F.lit(MIN_CELL_ROWS)))
    return F.least(F.ceil(rows / F.lit(block_rows)), bound).cast("int")


def candidate_pairs(signals: DataFrame, window_seconds: int, match: Sequence[str] = ("tenant_id", "environment"),
                    block_rows: int = 20_000) -> DataFrame:
    """Unordered pairs at most ``window_seconds`` apart that agree on ``match``.

    Columns left_id < right_id with the two rows as structs ``l`` and ``r``, and again by time as ``early``
    and ``late``; ``ahead`` says that l is the early one.  Time is cut
    into buckets of one window; a signal meets the later ones of its own bucket and of the next, each pair once.
    A block's leading rows come from these two buckets; blocks of more than ``block_rows`` of them are laid out on a grid of
    sub-blocks, so a task compares about block_rows * block_rows rows at most.  A grid has at
    most ``MAX_CELLS`` cells a side unless cells would hold over ``MIN_CELL_ROWS`` rows, as every
    cell costs a copy of each row.  The sides of the join are the two rows as they are, so only
    fields that are read later travel; the values of ``match`` are one number while they are few.
    Adding run-context columns to ``match`` narrows the blocks when only groupable pairs
    are needed.
    """
    width = window_seconds * 1_000_000
    types = dict(signals.dtypes)
    agreed = {c: f"_k{i}" for i, c in enumerate(match)}
    fields = {c: f"_f{i}" for i, c in enumerate(signals.columns) if c not in ("signal_id", "event_time") and not (c in agreed and types[c] in _BLANK)}
    base = signals.select(
        *[F.col(c).alias(k) for c, k in agreed.items()], F.col("signal_id").alias("_id"), F.col("event_time").alias("_at"),
        *[F.col(c).alias(f) for c, f in fields.items()],
    ).withColumn("_bucket", F.expr(f"unix_micros(_at) div {width}L"))
    keys = list(agreed.values())
    blocks = materialise(base.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_own")).dropna(subset=[*keys, "_bucket"]))
    block = keys
    if keys:
        known = materialise(blocks.select(*keys).distinct().withColumn("_k", F.monotonically_increasing_id()))
        if known.count() <= MAX_BROADCAST_ROWS:
            base, blocks, block = base.join(F.broadcast(known), keys), blocks.join(F.broadcast(known), keys), ["_k"]
    after = F.array(F.col("_bucket"), F.col("_bucket") + 1)
    sizes = materialise(
        blocks.select(*block, F.explode(after).alias("_bucket"), "_own").groupBy(*block, "_bucket").agg(F.sum("_own").alias("_n"))
        .where(F.col("_n") > block_rows).select(*block, "_bucket", cells_a_side(F.col("_n"), block_rows).alias("_cells"))
    )
    early, late = base.withColumn("_meet", F.explode(after)), base
    grid: list[str] = []
    if not sizes.isEmpty():
        grid = ["_cell"]

        def cells(df: DataFrame, on: str, across: bool) -> DataFrame:
            sized = lookup_join(df, sizes.withColumnRenamed("_bucket", on), [*block, on], ["_id"], "left")
            sized = sized.withColumn("_cells", F.coalesce("_cells", F.lit(1)))
            spread = sized.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))
            own = F.pmod(F.xxhash64("_id"), F.col("_cells")).cast("int")
            row, column = (F.col("_other"), own) if across else (own, F.col("_other"))
            return spread.withColumn("_cell", row * F.col("_cells") + column).drop("_cells", "_other")

        early, late = cells(early, "_meet", False), cells(late, "_bucket", True)

    def side(df: DataFrame, bucket: str, end: str) -> DataFrame:
        return df.select(
            *block, F.col(bucket).alias("_b"), *grid, F.col("_at").alias(f"_t{end}"), F.col("_id").alias(f"_i{end}"),
            *[F.coalesce(F.col(k), F.lit(_BLANK[types[c]]).cast(types[c])).alias(f"_v{k}{end}") for c, k in agreed.items() if c not in fields], *[F.col(f).alias(f"{f}{end}") for f in fields.values()],
        )

    # The smaller id leads; rows that share an id, or have none, are led by the later one.
    gap = F.unix_micros("_tb") - F.unix_micros("_ta")
    met = side(early, "_meet", "a").join(side(late, "_bucket", "b"), [*block, "_b", *grid]).where(
        (gap <= width) & ((gap > 0) | ((gap == 0) & (F.col("_ia") < F.col("_ib"))))
    ).withColumn("ahead", F.coalesce(F.col("_ia") < F.col("_ib"), F.lit(False)))

    def row(end: str) -> dict[str, Column]:
        value = {"signal_id": F.col(f"_i{end}"), "event_time": F.col(f"_t{end}")} | {c: F.col(f"{f}{end}") for c, f in fields.items()}
        # Both rows agree on it and it is never null, so one row's stands for both.
        return value | {c: F.col(f"_v{k}a") for c, k in agreed.items() if c not in fields}

    def struct(value: Callable[[str], Column]) -> Column:
        return F.struct(*[value(c).alias(c) for c in signals.columns])

    one, two, ahead = row("a"), row("b"), F.col("ahead")
    return met.select(
        F.when(ahead, F.col("_ia")).otherwise(F.coalesce("_ib", "_ia")).alias("left_id"),
        F.when(ahead, F.col("_ib")).otherwise(F.coalesce("_ia", "_ib")).alias("right_id"),
        struct(lambda c: F.when(ahead, one[c]).otherwise(two[c])).alias("l"), struct(lambda c: F.when(ahead, two[c]).otherwise(one[c])).alias("r"),
        struct(one.get).alias("early"), struct(two.get).alias("late"), "ahead",
    )


def ends(pairs: DataFrame) -> tuple[str, str]:
    """The two structs to compare where order is of no matter; the rows by time cost no choice for each field."""
    return ("early", "late") if "ahead" in pairs.columns else ("l", "r")


def of_side(pairs: DataFrame, field: str, left: bool = True) -> Column:
    """A field of the left (or right) row."""
    if "ahead" not in pairs.columns:
        return F.col(f"{'l' if left else 'r'}.{field}")
    one, two = ("early", "late") if left else ("late", "early")
    return F.when(F.col("ahead"), F.col(f"{one}.{field}")).otherwise(F.col(f"{two}.{field}"))


def service_relations(names: DataFrame, nodes: DataFrame, edges: DataFrame, hop_limit: int) -> tuple[DataFrame, DataFrame]:
    """(resolution, relations) at service level, to be joined to any number of pairs.

    resolution: (service, resolution).  relations: (left_service, right_service,
    topology_token, topology_hops) for ordered name pairs linked by a directed path of at
    most ``hop_limit`` edges in either direction.
    """
    resolved = materialise(graph.resolve_services(names, nodes))
    ids = resolved.where("resolution = 'resolved'")
    reach = graph.distances(edges, hop_limit, "downstream", ids.select(F.col("service_id").alias("root"))).where("hops > 0")
    l2r = reach.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("hops").alias("ab"))
    r2l = reach.select(F.col("target").alias("a"), F.col("source").alias("b"), F.col("hops").alias("ba"))
    both = l2r.join(r2l, ["a", "b"], "full_outer")
    token = F.when(F.col("ba").isNull(), "left_to_right").when(F.col("ab").isNull(), "right_to_left").otherwise("bidirectional")
    named = (
        both.join(ids.select(F.col("service_id").alias("a"), F.col("service").alias("left_service")), "a")
        .join(ids.select(F.col("service_id").alias("b"), F.col("service").alias("right_service")), "b")
        .select("left_service", "right_service", token.alias("topology_token"), F.least("ab", "ba").alias("topology_hops"))
    )
    return resolved, materialise(named)


def temporal_score(window_seconds: int, sides: Sequence[str] = ("l", "r")) -> Column:
    delta = F.abs(F.unix_micros(f"{sides[0]}.event_time") - F.unix_micros(f"{sides[1]}.event_time")) / F.lit(1_000_000.0)
    return clamp(1 - delta / F.lit(float(window_seconds)))


def symptom_score(ranked: bool = False, sides: Sequence[str] = ("l", "r")) -> Column:
    """Mean of metric equality, severity proximity and score agreement.

    An unknown severity counts as the middle rank.  ``ranked``: the rows bring their severity_rank.
    """
    ranks = [F.col(f"{s}.severity_rank") if ranked else F.coalesce(severity_rank(F.col(f"{s}.severity")), F.lit(2)) for s in sides]
    same = (F.col(f"{sides[0]}.metric_or_feature") == F.col(f"{sides[1]}.metric_or_feature")).cast("double")
    near = 1 - F.abs(ranks[0] - ranks[1]) / F.lit(4.0)
    agree = 1 - F.abs(F.col(f"{sides[0]}.anomaly_score") - F.col(f"{sides[1]}.anomaly_score"))
    return clamp((same + near + agree) / F.lit(3.0))


def context_score(sides: Sequence[str] = ("l", "r")) -> Column:
    hits = F.lit(0)
    for c in CONTEXT:
        hits = hits + (F.col(f"{sides[0]}.{c}") == F.col(f"{sides[1]}.{c}")).cast("int")
    return hits / F.lit(float(len(CONTEXT)))


def _with_tokens(wide: DataFrame, resolution: DataFrame, relations: DataFrame) -> DataFrame:
    """Adds _token and topology_hops of (left_service, right_service).

    Few services: what holds for each two of them is worked out once, and a pair takes one lookup.
    """
    names = ["left_service", "right_service"]
    state = materialise(resolution.select("service", "resolution"))

    def judged(df: DataFrame, salt_by: list[str]) -> DataFrame:
        df = lookup_join(df, state.toDF("left_service", "_ls"), ["left_service"], salt_by, "left")
        df = lookup_join(df, state.toDF("right_service", "_rs"), ["right_service"], salt_by, "left")
        df = lookup_join(df, relations, names, salt_by, "left")
        ls, rs = (F.coalesce(F.col(c), F.lit("missing")) for c in ("_ls", "_rs"))
        token = (
            F.when((ls == "missing") | (rs == "missing"), "missing").when((ls == "ambiguous") | (rs == "ambiguous"), "ambiguous")
            .when(F.col("left_service") == F.col("right_service"), "same_service").otherwise(F.coalesce("topology_token", F.lit("disconnected")))
        )
        return df.withColumn("_token", token)

    services = state.select("service").distinct()
    if services.count() ** 2 > MAX_BROADCAST_ROWS:
        return judged(wide, ["left_id", "right_id"])
    every = judged(services.toDF("left_service").crossJoin(services.toDF("right_service")), names)
    known = materialise(every.select(*names, "_token", "topology_hops"))
    return lookup_join(wide, known, names, ["left_id", "right_id"], "left").withColumn("_token", F.coalesce("_token", F.lit("missing")))


HARD = {"missing": "topology_service_missing", "ambiguous": "topology_service_ambiguous", "disconnected": "disconnected_services"}
LINKED = ("left_to_right", "right_to_left", "bidirectional")


def by_service_pair(pairs: DataFrame, names: list[str], value: Callable[[str, str], object], kind: str) -> Column:
    """``value`` of the two rows' services, read by their service_code; null if a row has none."""
    every = F.split(F.lit("|".join(str(value(a, b)) for a in names for b in names)), r"\|")
    return F.get(every.cast(f"array<{kind}>"), of_side(pairs, "service_code") * len(names) + of_side(pairs, "service_code", left=False))


def _by_code(pairs: DataFrame, names: list[str], resolution: DataFrame, relations: DataFrame) -> dict[str, Column]:
    """What the services of a pair decide, from arrays over all two services."""
    state = {r.service: r.resolution for r in resolution.select("service", "resolution").collect()}
    path = {(r.left_service, r.right_service): (r.topology_token, r.topology_hops) for r in relations.collect()}

    def token(a: str, b: str) -> str:
        for lacking in ("missing", "ambiguous"):
            if lacking in (state[a], state[b]):
                return lacking
        return "same_service" if a == b else path.get((a, b), ("disconnected", 0))[0]

    def hops(a: str, b: str) -> int:
        return path[a, b][1] if token(a, b) in LINKED else 0

    def score(a: str, b: str) -> float:
        return 1.0 if token(a, b) == "same_service" else 1 / (1 + float(hops(a, b))) if token(a, b) in LINKED else 0.0

    one, two = ends(pairs)

    def text(a: str, b: str) -> str:
        return f"accepted;topology={token(a, b)};hops={hops(a, b)}"

    return {
        "same": F.col(f"{one}.service_code") == F.col(f"{two}.service_code"),
        "token": F.coalesce(by_service_pair(pairs, names, token, "string"), F.lit("missing")),
        "hops": F.coalesce(by_service_pair(pairs, names, hops, "int"), F.lit(0)),
        "score": F.coalesce(by_service_pair(pairs, names, score, "double"), F.lit(0.0)),
        "hard": F.coalesce(by_service_pair(pairs, names, lambda a, b: HARD.get(token(a, b), ""), "string"), F.lit(HARD["missing"])),
        "text": by_service_pair(pairs, names, text, "string"),
    }


def score_pairs(pairs: DataFrame, resolution: DataFrame, relations: DataFrame, cfg: CorrelationConfig) -> DataFrame:
    """Component scores, weighted score, decision and reason for every pair.

    Topology: 0 for a missing or ambiguous service, 1 for the same service, 1/(1+hops)
    along a directed path either way, else 0.  Hard rejections in order: same identity,
    tenant, environment, outside window, service missing, ambiguous, disconnected; then
    the threshold.  Rows that went through ``slim`` take no lookup a pair.
    """
    sides = one, two = ends(pairs)
    fields = pairs.schema["l"].dataType.fieldNames()
    names = coded_services(resolution) if "service_code" in fields else None
    if names:
        wide, by = pairs, _by_code(pairs, names, resolution, relations)
    else:
        wide = pairs.withColumn("left_service", F.col("l.service")).withColumn("right_service", F.col("r.service"))
        wide = _with_tokens(wide, resolution, relations)
        token, hops = F.col("_token"), F.col("hops")
        linked = token.isin(*LINKED)
        wide = wide.withColumn("hops", F.when(linked, F.col("topology_hops")).otherwise(F.lit(0)))
        by = {
            "same": F.col("left_service") == F.col("right_service"), "token": token, "hops": hops,
            "score": F.when(token == "same_service", F.lit(1.0)).when(linked, 1 / (1 + hops.cast("double"))).otherwise(F.lit(0.0)),
            "hard": reduce(lambda chain, x: chain.when(token == x[0], x[1]), HARD.items(), F.when(F.lit(False), "")).otherwise(F.lit("")),
            "text": F.concat(F.lit("accepted;topology="), token, F.lit(";hops="), hops.cast("string")),
        }
    scored = (
        wide.withColumn("hops", by["hops"])
        .withColumn("temporal_score", temporal_score(cfg.window_seconds, sides))
        .withColumn("service_score", by["same"].cast("double"))
        .withColumn("topology_score", by["score"])
        .withColumn("symptom_score", symptom_score("severity_rank" in fields, sides))
        .withColumn("context_score", context_score(sides))
    )
    parts = ("temporal", "service", "topology", "symptom", "context")
    weighted = F.lit(0.0)
    for p in parts:
        weighted = weighted + F.col(f"{p}_score") * F.lit(getattr(cfg, p))
    delta = F.abs(F.unix_micros(f"{one}.event_time") - F.unix_micros(f"{two}.event_time"))
    same_id = F.col("left_id") == F.col("right_id")
    if "ahead" in pairs.columns:  # the same, told by the rows: an id that is read twice would keep the optimizer from pruning them
        ids = [F.col(f"{s}.signal_id") for s in sides]
        same_id = F.coalesce(ids[0] == ids[1], ids[0].isNotNull() | ids[1].isNotNull())
    refused = [
        (same_id, F.lit("same_signal_identity")),
        (F.col(f"{one}.tenant_id") != F.col(f"{two}.tenant_id"), F.lit("tenant_mismatch")),
        (F.col(f"{one}.environment") != F.col(f"{two}.environment"), F.lit("environment_mismatch")),
        (delta > cfg.window_seconds * 1_000_000, F.lit("outside_correlation_window")),
        (by["hard"] != "", by["hard"]),
        (F.col("weighted_score") < F.lit(cfg.threshold - SLACK), F.lit("below_acceptance_threshold")),
    ]
    reason, accepted = (reduce(lambda chain, x: chain.when(*x), rest, F.when(*first)) for first, *rest in (refused, [(test, F.lit(False)) for test, _ in refused]))
    return (
        scored.withColumn("weighted_score", clamp(weighted))
        .withColumn("reason", reason.otherwise(by["text"]))
        .withColumn("accepted", accepted.otherwise(F.lit(True)))
        .withColumn("policy_version", F.lit(cfg.policy_version))
        .select(
            "left_id", "right_id", "l", "r", *[c for c in ("early", "late", "ahead") if c in pairs.columns],
            *[f"{p}_score" for p in parts], "weighted_score", "accepted",
            by["token"].alias("topology_token"), "hops", "reason", "policy_version",
        )
    )


def dispositions(signals: DataFrame, watermark, cfg: CorrelationConfig) -> DataFrame:
    """One row per signal: duplicate_count, late, disposition, included, conflict.

    Late means event_time < watermark - allowed lateness.  An id with more than one
    fingerprint is a conflict: none of its rows may be used.  A duplicate under the reject
    policy drops all its copies; otherwise lateness decides (reject and delay exclude).
    """
    rows = signals.groupBy("signal_id").agg(
        F.count(F.lit(1)).alias("duplicate_count"),
        F.min("event_time").alias("event_time"),
        F.min("semantic_fingerprint").alias("semantic_fingerprint"),
        (F.min("semantic_fingerprint") != F.max("semantic_fingerprint")).alias("conflict"),
    )
    mark = watermark if isinstance(watermark, Column) else F.lit(watermark).cast("timestamp")
    late = F.unix_micros("event_time") < F.unix_micros(mark) - cfg.allowed_lateness_seconds * 1_000_000
    dup = F.col("duplicate_count") > 1
    dropped = {"reject": "late_rejected", "delay": "late_delayed"}.get(cfg.late)
    kept = F.when(dup, "duplicate_ignored").when(F.col("late"), "late_accepted").otherwise("grouped")
    disposition = F.when(F.col("late"), F.lit(dropped)).otherwise(kept) if dropped else kept
    if cfg.duplicate == "reject":
        disposition = F.when(dup, "duplicate_rejected").otherwise(disposition)
    disposition = F.when(F.col("conflict"), "conflict").otherwise(disposition)
    return (
        rows.withColumn("late", late)
        .withColumn("disposition", disposition)
        .withColumn("included", F.col("disposition").isin("grouped", "duplicate_ignored", "late_accepted"))
    )


def validate_evidence(evidence: DataFrame, known: DataFrame, cfg: CorrelationConfig) -> DataFrame:
    """Problems of an evidence table as rows (problem, left_id, right_id); empty means valid."""
    ids = known.select("signal_id").distinct()
    pair = [F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")]

    def rows(df: DataFrame, problem: str) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), *pair)

    ends = evidence.select(*pair, F.explode(F.array("left_id", "right_id")).alias("signal_id"))
    unknown = ends.join(ids, "signal_id", "left_anti").select("left_id", "right_id").distinct()
    repeated = evidence.select(*pair).groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    said_yes = F.col("reason").startswith("accepted")
    broken = {
        "self_reference": F.col("left_id") == F.col("right_id"),
        "policy_mismatch": F.col("policy_version") != cfg.policy_version,
        "reason_mismatch": F.col("accepted") != said_yes,
        "below_threshold": F.col("accepted") & (F.col("weighted_score") < cfg.threshold - SLACK),
    }
    # All that a row shows by itself is read off in one pass.
    alone = evidence.where(reduce(or_, broken.values())).select(
        F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in broken.items()]))).alias("problem"), *pair
    )
    return alone.unionByName(rows(unknown, "unknown_endpoint")).unionByName(rows(repeated, "duplicate_pair"))
