"""Dependency-graph operators: validation, neighbourhoods, simple paths, distances.

Edges are (up, down, dep): ``down`` depends on nothing here but order; "downstream"
walks from up to down.  Traversals run level by level, many roots at once; each level
is materialised, so the plan never grows with depth.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.functions.skew import lookup_join
from opsweave.session import materialise

DIRECTIONS = ("downstream", "upstream", "both")
EDGES_PER_TASK = 250_000  # some 80 MB of nodes in a Python worker


def _check(hops: int | None, direction: str) -> None:
    if hops is not None and (isinstance(hops, bool) or hops < 0):
        raise ValueError("hops must be None or at least 0")
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")


def validate_topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Problems as rows (problem, subject): duplicate node or edge, self edge, unknown endpoint."""
    known = nodes.select(F.col("service_id").alias("id")).distinct()

    def rows(df: DataFrame, problem: str, subject: Column) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), subject.alias("subject"))

    edge_text = F.concat_ws(">", "up", "down", "dep")
    duplicated_nodes = nodes.groupBy("service_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    duplicated_edges = edges.groupBy("up", "down", "dep").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    no_up = edges.join(known, edges.up == known.id, "left_anti")
    no_down = edges.join(known, edges.down == known.id, "left_anti")
    return (
        rows(duplicated_nodes, "duplicate_node", F.col("service_id"))
        .unionByName(rows(duplicated_edges, "duplicate_edge", edge_text))
        .unionByName(rows(edges.where("up = down"), "self_edge", edge_text))
        .unionByName(rows(no_up, "unknown_upstream", edge_text))
        .unionByName(rows(no_down, "unknown_downstream", edge_text))
    )


LEAVES = 64


def topology_fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: SHA-256 over nodes and edges, independent of row order, as a Merkle tree.

    Leaves are the hashes of the rows (kind and JSON with sorted keys).  With n leaves they
    are grouped by their first d hex digits, d the smallest with LEAVES x 16^d >= n, so a
    group has some LEAVES whatever the graph's size (copies of one row count too); each
    further level joins at most 16 digests, down to the one of the empty prefix.
    """
    node = F.concat(F.lit("node:"), F.to_json(F.struct("name", "service_id", "service_type")))
    edge = F.concat(F.lit("edge:"), F.to_json(F.struct(F.col("dep").alias("dependency_type"), F.col("down").alias("downstream_service_id"), F.col("up").alias("upstream_service_id"))))
    leaves = nodes.select(F.lit("node").alias("kind"), F.sha2(node, 256).alias("h")).unionByName(edges.select(F.lit("edge").alias("kind"), F.sha2(edge, 256).alias("h")))
    distinct = materialise(leaves.groupBy("kind", "h").agg(F.count(F.lit(1)).alias("n")))
    sizes = distinct.agg(
        F.count(F.lit(1)).alias("leaves"),
        F.coalesce(F.sum(F.when(F.col("kind") == "node", F.col("n"))), F.lit(0)).alias("nodes"),
        F.coalesce(F.sum(F.when(F.col("kind") == "edge", F.col("n"))), F.lit(0)).alias("edges"),
    )
    total = sizes.first()["leaves"]
    depth = next(d for d in range(17) if LEAVES * 16**d >= total)
    entry = F.concat_ws("*", "h", F.col("n").cast("string"))
    level = distinct.select(F.expr(f"left(h, {depth})").alias("prefix"), entry.alias("part"))
    for d in range(depth, -1, -1):
        joined_parts = F.concat_ws("", F.array_sort(F.collect_list("part")))
        folded = level.groupBy("prefix").agg(F.sha2(joined_parts, 256).alias("digest"))
        level = folded.select(F.expr(f"left(prefix, {max(d - 1, 0)})").alias("prefix"), F.concat("prefix", F.lit("="), "digest").alias("part"))
    root = level.select(F.substring_index("part", "=", -1).alias("fingerprint"))
    empty = F.sha2(F.lit(""), 256)
    return sizes.join(root, how="left").select(F.coalesce("fingerprint", empty).alias("fingerprint"), "nodes", "edges")


def neighbours(edges: DataFrame, direction: str) -> DataFrame:
    """(node, neighbour, dep) pairs to walk along.

    One-way modes keep parallel typed edges apart.  ``both`` keeps one edge per
    neighbour: the downstream one if there is one, then the smallest type.
    """
    _check(0, direction)
    down = edges.select(F.col("up").alias("node"), F.col("down").alias("neighbour"), "dep")
    up = edges.select(F.col("down").alias("node"), F.col("up").alias("neighbour"), "dep")
    if direction == "downstream":
        return down
    if direction == "upstream":
        return up
    both = down.withColumn("_rank", F.lit(0)).unionByName(up.withColumn("_rank", F.lit(1)))
    best = both.groupBy("node", "neighbour").agg(F.min(F.struct("_rank", "dep")).alias("_best"))
    return best.select("node", "neighbour", F.col("_best.dep").alias("dep"))


# A node with more edges than this has them dealt over sub-nodes of about so many.
HUB_EDGES = 100_000


def split_hubs(step: DataFrame, hub_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """(adjacency with ``_part``, hubs): a hub's edges lie in parts by a hash of the neighbour.

    ``hubs`` (node, parts) has at most edges / hub_edges rows; None if there are none.
    """
    degree = step.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub_edges)
    hubs = materialise(degree.select("node", F.ceil(F.col("n") / hub_edges).cast("int").alias("parts")))
    if hubs.isEmpty():
        return step, None
    placed = lookup_join(step, hubs, ["node"], ["neighbour"], "left")
    part = F.pmod(F.xxhash64("neighbour"), F.coalesce("parts", F.lit(1))).cast("int")
    return materialise(placed.select("node", "neighbour", part.alias("_part"))), hubs


def expand(frontier: DataFrame, step: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Frontier rows joined to the neighbours of their node; a row at a hub visits all its parts."""
    if hubs is None:
        return frontier.join(step, "node")
    tagged = lookup_join(frontier, hubs, ["node"], ["root"], "left")
    spread = tagged.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return spread.join(step, ["node", "_part"]).drop("_part")


def _walk(edges: DataFrame, roots: DataFrame, hops: int | None, direction: str, with_path: bool) -> DataFrame:
    """Breadth-first levels from every root: (root, node, depth[, path]).

    Without ``hops`` the walk ends when a level finds no new node.  Every few levels
    what was seen is materialised anew, so a long chain does not grow the plan.
    Of the shortest paths to a node the lexicographically smallest is kept; that is the
    first discoverer when every level is expanded in path order.
    """
    _check(hops, direction)
    step, hubs = split_hubs(materialise(neighbours(edges, direction).select("node", "neighbour").distinct()), HUB_EDGES)
    path = [F.array("root").alias("path")] if with_path else []
    level = materialise(
        roots.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), *path)
    )
    seen = level
    for depth in itertools.count(1) if hops is None else range(1, hops + 1):
        found = expand(level, step, hubs).select(
            "root", F.col("neighbour").alias("node"),
            *([F.concat("path", F.array("neighbour")).alias("path")] if with_path else []),
        )
        if with_path:
            reached = found.groupBy("root", "node").agg(F.min("path").alias("path"))
        else:
            reached = found.distinct()
        fresh = reached.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        level = materialise(fresh.withColumn("depth", F.lit(depth)).select(*level.columns))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        if depth % 16 == 0:
            seen = materialise(seen)
    return seen


def neighborhood(edges: DataFrame, roots: DataFrame, hops: int | None, direction: str = "downstream") -> DataFrame:
    """Nodes within ``hops`` of each root with depth and breadth-first tree path."""
    return _walk(edges, roots, hops, direction, with_path=True)


def distances(edges: DataFrame, hops: int | None = None, direction: str = "downstream", sources: DataFrame | None = None) -> DataFrame:
    """(source, target, hops) of every pair within ``hops``, or of every connected pair.

    A shortest walk is simple, so this equals the minimum over all simple paths.
    ``sources`` (column root) limits the start nodes.
    """
    if sources is None:
        sources = edges.select(F.col("up").alias("root")).unionByName(edges.select(F.col("down").alias("root"))).distinct()
    found = _walk(edges, sources, hops, direction, with_path=False)
    return found.select(F.col("root").alias("source"), F.col("node").alias("target"), F.col("depth").alias("hops"))


def induced_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges of each root's neighbourhood: both ends reached."""
    ends = reached.select("root", "node")
    first = edges.join(ends.withColumnRenamed("node", "up"), "up")
    return first.join(ends.withColumnRenamed("node", "down"), ["root", "down"], "left_semi").select("root", "up", "down", "dep")


def truncation(edges: DataFrame, reached: DataFrame, hops: int | None, direction: str) -> DataFrame:
    """(root, truncated): does an unvisited neighbour lie just beyond ``hops``; never without a bound."""
    roots = reached.select("root").distinct()
    if hops is None:
        return roots.withColumn("truncated", F.lit(False))
    rim = reached.where(F.col("depth") == hops).select("root", "node")
    beyond = rim.join(neighbours(edges, direction).select("node", "neighbour").distinct(), "node").select(
        "root", F.col("neighbour").alias("node")
    )
    open_roots = beyond.join(reached.select("root", "node"), ["root", "node"], "left_anti").select("root").distinct()
    return roots.join(open_roots.withColumn("truncated", F.lit(True)), "root", "left").select(
        "root", F.coalesce("truncated", F.lit(False)).alias("truncated")
    )


def find_paths(edges: DataFrame, pairs: DataFrame, hops: int, direction: str = "downstream") -> DataFrame:
    """All simple paths of at most ``hops`` edges for each (source, target) pair.

    Columns: source, target, hop_count, path (node ids), deps (edge types).  A path ends
    at its target.  A partial path is dropped as soon as its end is farther from the
    target than the hops left.
    """
    _check(hops, direction)
    if hops is None:
        raise ValueError("paths need a bound on their hops")
    wanted = pairs.select("source", "target").distinct()
    zero = wanted.where("source = target").select(
        "source", "target", F.lit(0).alias("hop_count"), F.array("source").alias("path"), F.array().cast("array<string>").alias("deps")
    )
    reverse = {"downstream": "upstream", "upstream": "downstream", "both": "both"}[direction]
    targets = wanted.where("source <> target").select(F.col("target").alias("root")).distinct()
    left = materialise(
        _walk(edges, targets, hops, reverse, with_path=False).select(F.col("root").alias("target"), "node", F.col("depth").alias("to_go"))
    )
    step = materialise(neighbours(edges, direction))
    open_paths = materialise(
        wanted.where("source <> target").select(
            "source", "target", F.col("source").alias("node"), F.array("source").alias("path"), F.array().cast("array<string>").alias("deps")
        )
    )
    done = [zero]
    for used in range(1, hops + 1):
        grown = open_paths.join(step, "node").where(~F.array_contains("path", F.col("neighbour")))
        grown = grown.select(
            "source", "target", F.col("neighbour").alias("node"),
            F.concat("path", F.array("neighbour")).alias("path"), F.concat("deps", F.array("dep")).alias("deps"),
        )
        grown = materialise(grown.join(left, ["target", "node"]).where(F.col("to_go") <= hops - used).drop("to_go"))
        done.append(
            grown.where("node = target").select("source", "target", F.lit(used).alias("hop_count"), "path", "deps")
        )
        open_paths = grown.where("node <> target")
        if open_paths.isEmpty():
            break
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def resolve_services(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(service, service_id, resolution): resolved, missing or ambiguous per service name."""
    by_name = nodes.groupBy(F.col("name").alias("service")).agg(F.count(F.lit(1)).alias("_n"), F.min("service_id").alias("service_id"))
    joined = names.select("service").distinct().join(by_name, "service", "left")
    resolution = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("resolved")
    return joined.select("service", F.when(F.col("_n") == 1, F.col("service_id")).alias("service_id"), resolution.alias("resolution"))


def group_diameter(members: DataFrame, undirected: DataFrame) -> DataFrame:
    """(group_id, diameter_hops): the largest undirected distance between services of a group.

    ``members`` has group_id and service_id; pairs are built from the distinct services
    of a group, whose number the group size limit bounds.  Null if a pair is not connected.
    """
    services = members.select("group_id", "service_id").distinct()
    pairs = services.join(services.withColumnRenamed("service_id", "other"), "group_id").where("service_id < other")
    known = pairs.join(
        undirected.select(F.col("source").alias("service_id"), F.col("target").alias("other"), "hops"), ["service_id", "other"], "left"
    )
    widest = known.groupBy("group_id").agg(F.max("hops").alias("_max"), F.count_if(F.col("hops").isNull()).alias("_open"))
    return services.select("group_id").distinct().join(widest, "group_id", "left").select(
        "group_id", F.when(F.coalesce("_open", F.lit(0)) == 0, F.coalesce("_max", F.lit(0))).alias("diameter_hops")
    )


def blast_radius(edges: DataFrame, primaries: DataFrame, hops: int | None, direction: str = "downstream") -> tuple[DataFrame, DataFrame]:
    """(affected, summary) for each primary service (column root).

    ``affected`` has a row per service reached, the primary included, with its depth and
    path text; ``summary`` counts them per primary and says whether the walk was cut.
    """
    reached = neighborhood(edges, primaries, hops, direction)
    affected = reached.select(
        F.col("root").alias("primary_service"), F.col("node").alias("affected_service"), "depth", F.concat_ws(" > ", "path").alias("path_summary")
    )
    counts = affected.groupBy("primary_service").agg(F.count(F.lit(1)).alias("affected_count"), F.max("depth").alias("deepest"))
    cut = truncation(edges, reached, hops, direction).withColumnRenamed("root", "primary_service")
    return affected, counts.join(cut, "primary_service").withColumn("max_hops", F.lit(hops))


def snapshot_sizes(nodes: DataFrame, edges: DataFrame, max_nodes: int | None = None, max_edges: int | None = None) -> DataFrame:
    """(topology_version, nodes, edges, within_limits) of all snapshots in one aggregate; both frames have topology_version."""
    marked = nodes.select("topology_version", F.lit(1).alias("_n"), F.lit(0).alias("_e")).unionByName(
        edges.select("topology_version", F.lit(0).alias("_n"), F.lit(1).alias("_e"))
    )
    counted = marked.groupBy("topology_version").agg(F.sum("_n").alias("nodes"), F.sum("_e").alias("edges"))
    fits = F.lit(True)
    for name, limit in (("nodes", max_nodes), ("edges", max_edges)):
        if limit is not None:
            fits = fits & (F.col(name) <= limit)
    return counted.withColumn("within_limits", fits)


def check_snapshot(nodes: DataFrame, edges: DataFrame, expected_version: str | None = None,
                   max_nodes: int | None = None, max_edges: int | None = None) -> None:
    """Optional assertions on one snapshot: a single known version, size limits if given."""
    versions = [r[0] for r in nodes.select("topology_version").distinct().take(2)]
    if len(versions) != 1:
        raise ValueError("a snapshot must have exactly one topology_version")
    if expected_version is not None and versions[0] != expected_version:
        raise ValueError(f"topology version is {versions[0]}, expected {expected_version}")
    for df, limit, what in ((nodes, max_nodes, "nodes"), (edges, max_edges, "edges")):
        if limit is not None and df.count() > limit:
            raise ValueError(f"snapshot has more than {limit} {what}")


def local_forest(pairs: DataFrame) -> DataFrame:
    """Edges (a, b) replaced, within each partition, by one edge from every node to the lowest node it reaches there.

    A partition keeps the nodes of at most ``EDGES_PER_TASK`` edges; a larger one is worked off in
    runs of that many, which connect the same nodes.
    """
    schema = pairs.schema

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        taken = 0

        def root(node):
            top = node
            while above[top] != top:
                top = above[top]
            while above[node] != top:
                above[node], node = top, above[node]
            return top

        def drained() -> Iterator[pa.RecordBatch]:
            nodes = [node for node in above if above[node] != node]
            for start in range(0, len(nodes), 50_000):
                some = nodes[start : start + 50_000]
                columns = [pa.array(some, types[0]), pa.array([root(node) for node in some], types[1])]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        types = None
        for batch in batches:
            types = [batch.column(c).type for c in ("a", "b")]
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                one, two = root(above.setdefault(a, a) and a), root(above.setdefault(b, b) and b)
                if one != two:
                    above[max(one, two)] = min(one, two)
            taken += batch.num_rows
            if taken >= EDGES_PER_TASK:
                yield from drained()
                above.clear()
                taken = 0
        if above:
            yield from drained()

    return pairs.select("a", "b").mapInArrow(stars, schema)


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node id of each component.

    Edges are first contracted inside tasks of a bounded number of edges, as many tasks as their
    count asks for.  Where one task is enough, that is the result.  Otherwise large-star and small-star
    steps, which halve long chains, alternate with the contraction, so the number of rounds grows
    with the logarithm of the size.  Each round is materialised.
    """
    state = materialise(edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b").distinct())
    nodes = edges.select(F.explode(F.array(left, right)).alias("node"))
    signature = None
    while True:
        tasks = -(-state.count() // EDGES_PER_TASK)
        forest = local_forest(state.coalesce(max(1, tasks)))
        if tasks <= 1:
            state = forest
            break
        forest = materialise(forest.distinct())
        both = forest.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(forest.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low2, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b")))
        state = materialise(small.where("a <> b").distinct())
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if signature == tuple(now):
            break
        signature = tuple(now)
    found = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    every = found.unionByName(nodes.select("node", F.col("node").alias("component")))
    return every.groupBy("node").agg(F.min("component").alias("component"))
