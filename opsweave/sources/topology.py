"""Topology tables: one snapshot out of versioned node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def read_topology(nodes: DataFrame, edges: DataFrame, topology_id: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one (topology_id, topology_version).

    An edge counts only if it and both its end nodes carry that identity.  A null field
    or an empty snapshot is an error.
    """

    def mine(df: DataFrame) -> DataFrame:
        return df.where((F.col("topology_id") == topology_id) & (F.col("topology_version") == version))

    def strict(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        checks = [
            F.coalesce(F.col(c), F.raise_error(F.lit(f"malformed topology row: {c} is null")).cast("string")).alias(c) for c in columns
        ]
        return df.select(*checks)

    kept = strict(mine(nodes), ("service_id", "name", "service_type", "topology_id", "topology_version"))
    if kept.isEmpty():
        raise ValueError(f"topology {topology_id} version {version} not found")
    ids = kept.select("service_id").distinct()
    links = strict(mine(edges), ("up", "down", "dep", "topology_id", "topology_version"))
    links = links.join(ids.withColumnRenamed("service_id", "up"), "up", "left_semi")
    links = links.join(ids.withColumnRenamed("service_id", "down"), "down", "left_semi")
    return kept, links
