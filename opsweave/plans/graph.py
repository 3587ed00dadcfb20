"""Queries over dependency graphs."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from opsweave.operators import graph as G
from opsweave.plans.inputs import load
from opsweave.plans.registry import query
from opsweave.session import materialise
from opsweave.sources import topology as T

# Nodes of the supply tree: every id that occurs in it, suppliers named by nation.
TREE_NODES = """SELECT up AS service_id FROM edges_tree UNION SELECT down FROM edges_tree"""


def _nodes(edges):
    ids = edges.select(F.col("up").alias("service_id")).unionByName(edges.select(F.col("down").alias("service_id"))).distinct()
    return ids.select("service_id", F.col("service_id").alias("name"), F.substring("service_id", 1, 1).alias("service_type"))


@query(
    "G1_validate_topology",
    """WITH bad AS (SELECT up, down, dep FROM edges_tree UNION ALL SELECT up, down, dep FROM edges_tree WHERE dep = 'control'
  UNION ALL SELECT down, down, 'self' FROM edges_tree WHERE dep = 'sync' UNION ALL SELECT down, concat('ghost-', up), 'lost' FROM edges_tree WHERE dep = 'sync'),
nodes AS (SELECT up AS id FROM edges_tree UNION SELECT down FROM edges_tree)
SELECT 'duplicate_edge' AS problem, concat_ws('>', up, down, dep) AS subject FROM bad GROUP BY up, down, dep HAVING count(*) > 1
UNION ALL SELECT 'self_edge', concat_ws('>', up, down, dep) FROM bad WHERE up = down
UNION ALL SELECT 'unknown_downstream', concat_ws('>', up, down, dep) FROM bad WHERE down NOT IN (SELECT id FROM nodes)""",
    ("edges_tree",),
)
def validate(spark, folder):
    edges = load(spark, folder, "edges_tree")
    sync = edges.where("dep = 'sync'")
    bad = (
        edges.unionByName(edges.where("dep = 'control'"))
        .unionByName(sync.select(F.col("down").alias("up"), "down", F.lit("self").alias("dep")))
        .unionByName(sync.select(F.col("down").alias("up"), F.concat(F.lit("ghost-"), "up").alias("down"), F.lit("lost").alias("dep")))
    )
    return G.validate_topology(_nodes(edges), bad)


_NODE_JSON = """'{"name":"' || service_id || '","service_id":"' || service_id || '","service_type":"' || left(service_id, 1) || '"}'"""
FINGERPRINT_SQL = f"""WITH RECURSIVE leaves AS (
  SELECT 'node' AS kind, sha256('node:' || {_NODE_JSON}) AS h FROM ({TREE_NODES}) n
  UNION ALL SELECT 'edge', sha256('edge:' || '{{"dependency_type":"' || dep || '","downstream_service_id":"' || down || '","upstream_service_id":"' || up || '"}}') FROM edges_tree),
uniq AS (SELECT kind, h, count(*) AS n FROM leaves GROUP BY kind, h),
deep AS (SELECT min(d) AS depth FROM range(17) t(d), (SELECT count(*) AS total FROM uniq) c WHERE {G.LEAVES} * 16 ** d >= total),
tree(level, prefix, digest) AS (
  SELECT depth, left(h, depth), sha256(string_agg(h || '*' || n, '' ORDER BY h || '*' || n)) FROM uniq, deep GROUP BY depth, left(h, depth)
  UNION ALL SELECT level - 1, left(prefix, level - 1), sha256(string_agg(prefix || '=' || digest, '' ORDER BY prefix || '=' || digest)) FROM tree WHERE level > 0 GROUP BY level, left(prefix, level - 1))
SELECT (SELECT count(*) FROM leaves WHERE kind = 'node') AS nodes, (SELECT count(*) FROM leaves WHERE kind = 'edge') AS edges, digest AS fingerprint FROM tree WHERE level = 0"""


@query("G2_topology_fingerprint", FINGERPRINT_SQL, ("edges_tree",))
def topology_fingerprint(spark, folder):
    edges = load(spark, folder, "edges_tree")
    return G.topology_fingerprint(_nodes(edges), edges).select("nodes", "edges", "fingerprint")


@query(
    "G3_neighbours_both",
    """WITH b AS (SELECT up AS node, down AS neighbour, dep, 0 AS rk FROM edges_trade UNION ALL SELECT down, up, concat('back-', dep), 1 FROM edges_trade),
r AS (SELECT *, row_number() OVER (PARTITION BY node, neighbour ORDER BY rk, dep) AS rn FROM b)
SELECT node, neighbour, replace(dep, 'back-', '') AS dep FROM r WHERE rn = 1
UNION ALL SELECT up, down, dep FROM edges_tree UNION ALL SELECT down, up, dep FROM edges_tree""",
    ("edges_trade", "edges_tree"),
)
def neighbours(spark, folder):
    trade = G.neighbours(load(spark, folder, "edges_trade"), "both")
    return trade.unionByName(G.neighbours(load(spark, folder, "edges_tree"), "both"))


@query(
    "G3_neighbours_one_way",
    """SELECT up AS node, down AS neighbour, dep, 'downstream' AS direction FROM edges_tree
UNION ALL SELECT down, up, dep, 'upstream' FROM edges_tree""",
    ("edges_tree",),
)
def one_way(spark, folder):
    edges = load(spark, folder, "edges_tree")
    return G.neighbours(edges, "downstream").withColumn("direction", F.lit("downstream")).unionByName(
        G.neighbours(edges, "upstream").withColumn("direction", F.lit("upstream"))
    )


_BFS = """WITH RECURSIVE walk(root, node, depth, path) AS (
  SELECT DISTINCT up, up, 0, [up] FROM edges_tree WHERE dep = 'control'
  UNION ALL SELECT w.root, e.down, w.depth + 1, list_append(w.path, e.down) FROM walk w JOIN edges_tree e ON e.up = w.node WHERE w.depth < 3),
best AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY ALL)"""


def _regions(edges):
    return edges.where("dep = 'control'").select(F.col("up").alias("root")).distinct()


@query("G4_neighborhood_depth", f"{_BFS} SELECT root, node, depth FROM best", ("edges_tree",))
def neighborhood(spark, folder):
    edges = load(spark, folder, "edges_tree")
    return G.neighborhood(edges, _regions(edges), 3).select("root", "node", "depth")


@query(
    "G5_bfs_tree_paths",
    f"""{_BFS} SELECT w.root, w.node, array_to_string(min(w.path), '>') AS path FROM walk w JOIN best b
  ON b.root = w.root AND b.node = w.node AND b.depth = w.depth GROUP BY w.root, w.node""",
    ("edges_tree",),
)
def tree_paths(spark, folder):
    edges = load(spark, folder, "edges_tree")
    return G.neighborhood(edges, _regions(edges), 3).select("root", "node", F.concat_ws(">", "path").alias("path"))


_BFS2 = _BFS.replace("w.depth < 3", "w.depth < 2")


@query(
    "G6_induced_edges",
    f"""{_BFS2} SELECT b.root, e.up, e.down, e.dep FROM best b JOIN edges_tree e ON e.up = b.node
  JOIN best c ON c.root = b.root AND c.node = e.down""",
    ("edges_tree",),
)
def induced(spark, folder):
    edges = load(spark, folder, "edges_tree")
    return G.induced_edges(edges, G.neighborhood(edges, _regions(edges), 2))


@query(
    "G6_truncated",
    f"""{_BFS2} SELECT b.root, bool_or(b.depth = 2 AND e.down IS NOT NULL AND NOT EXISTS (SELECT 1 FROM best c WHERE c.root = b.root AND c.node = e.down)) AS truncated
  FROM best b LEFT JOIN edges_tree e ON e.up = b.node GROUP BY b.root""",
    ("edges_tree",),
)
def truncated(spark, folder):
    edges = load(spark, folder, "edges_tree")
    return G.truncation(edges, G.neighborhood(edges, _regions(edges), 2), 2, "downstream")


@query(
    "G7_simple_paths",
    """WITH RECURSIVE p(source, node, path, hops) AS (
  SELECT DISTINCT up, up, [up], 0 FROM edges_trade
  UNION ALL SELECT p.source, e.down, list_append(p.path, e.down), p.hops + 1 FROM p JOIN edges_trade e ON e.up = p.node
   WHERE p.hops < 2 AND NOT list_contains(p.path, e.down))
SELECT source, node AS target, hops AS hop_count, array_to_string(path, '>') AS path FROM p""",
    ("edges_trade",),
)
def simple_paths(spark, folder):
    edges = materialise(load(spark, folder, "edges_trade"))  # four tables joined, once for all that reads it
    # Every target within the hops of a node that has edges out, linked to it or not.
    pairs = G.distances(edges, 2, "downstream", edges.select(F.col("up").alias("root"))).select("source", "target")
    return G.find_paths(edges, pairs, 2).select("source", "target", "hop_count", F.concat_ws(">", "path").alias("path"))


# The two-month periods of all orders, each followed by the next one: a chain of some 40.
CHAIN = """periods AS (SELECT DISTINCT (year(o_orderdate) * 12 + month(o_orderdate) - 1) // 2 AS p FROM orders),
chain AS (SELECT row_number() OVER (ORDER BY p) AS i FROM periods)"""


def _chain(spark, folder):
    period = F.floor((F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1) / 2)
    ranked = load(spark, folder, "orders").select(period.alias("p")).distinct().withColumn("i", F.row_number().over(Window.orderBy("p")))
    linked = ranked.withColumn("last", F.max("i").over(Window.orderBy("p").rowsBetween(0, Window.unboundedFollowing)))
    name = lambda i: F.concat(F.lit("p"), i.cast("string"))
    return linked.where("i < last").select(name(F.col("i")).alias("up"), name(F.col("i") + 1).alias("down"), F.lit("sync").alias("dep"))


def _first(spark, folder):
    return _chain(spark, folder).where("up = 'p1'").select(F.col("up").alias("root"))


@query("G8_long_chain", f"""WITH {CHAIN} SELECT 'p1' AS source, 'p' || i AS target, CAST(i - 1 AS INTEGER) AS hops FROM chain""")
def long_chain(spark, folder):
    return G.distances(_chain(spark, folder), sources=_first(spark, folder))


@query(
    "G6_truncated_long_chain",
    f"""WITH {CHAIN} SELECT h AS hops, 'p1' AS root, h < (SELECT max(i) - 1 FROM chain) AS truncated FROM (VALUES (32), (36), (60)) t(h)""",
)
def truncated_long_chain(spark, folder):
    edges, root = _chain(spark, folder), _first(spark, folder)
    out = [G.truncation(edges, G.neighborhood(edges, root, h), h, "downstream").select(F.lit(h).alias("hops"), "root", "truncated") for h in (32, 36, 60)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "G8_hop_distances",
    """WITH RECURSIVE walk(source, node, depth) AS (
  SELECT DISTINCT down, down, 0 FROM edges_tree WHERE dep = 'control'
  UNION SELECT w.source, CASE WHEN e.up = w.node THEN e.down ELSE e.up END, w.depth + 1 FROM walk w JOIN edges_tree e ON e.up = w.node OR e.down = w.node WHERE w.depth < 2)
SELECT source, node AS target, min(depth) AS hops FROM walk GROUP BY ALL""",
    ("edges_tree",),
)
def hop_distances(spark, folder):
    edges = load(spark, folder, "edges_tree")
    nations = edges.where("dep = 'control'").select(F.col("down").alias("root")).distinct()
    return G.distances(edges, 2, "both", nations)


@query(
    "G9_group_diameter",
    """WITH RECURSIVE und AS (SELECT up AS a, down AS b FROM service_edges UNION SELECT down, up FROM service_edges),
walk(s, t, d) AS (SELECT DISTINCT a, a, 0 FROM und UNION SELECT w.s, u.b, w.d + 1 FROM walk w JOIN und u ON u.a = w.t WHERE w.d < 5),
dist AS (SELECT s, t, min(d) AS d FROM walk GROUP BY ALL),
m AS (SELECT DISTINCT concat(CAST(tenant_id AS VARCHAR), '/', CAST(CAST(event_time AS DATE) AS VARCHAR)) AS group_id, service FROM signals)
SELECT x.group_id, coalesce(max(CASE WHEN x.service < y.service THEN dist.d END), 0) AS diameter_hops
FROM m x JOIN m y USING (group_id) JOIN dist ON dist.s = x.service AND dist.t = y.service GROUP BY x.group_id""",
    ("service_edges", "signals"),
)
def diameter(spark, folder):
    sig = load(spark, folder, "signals")
    members = sig.select(
        F.concat_ws("/", F.col("tenant_id").cast("string"), F.to_date("event_time").cast("string")).alias("group_id"),
        F.col("service").alias("service_id"),
    )
    return G.group_diameter(members, G.distances(load(spark, folder, "service_edges"), None, "both"))


@query(
    "G10_resolve_services",
    """WITH names AS (SELECT DISTINCT c_mktsegment AS service FROM customer UNION SELECT s_name FROM supplier UNION SELECT p_brand FROM part),
nodes AS (SELECT s_name AS name, concat('s', CAST(s_suppkey AS VARCHAR)) AS service_id FROM supplier
  UNION ALL SELECT p_brand, concat('p', CAST(p_partkey AS VARCHAR)) FROM part)
SELECT n.service, CASE WHEN count(d.name) = 1 THEN min(d.service_id) END AS service_id,
  CASE count(d.name) WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution
FROM names n LEFT JOIN nodes d ON d.name = n.service GROUP BY n.service""",
)
def resolve(spark, folder):
    sup, part, cust = (load(spark, folder, t) for t in ("supplier", "part", "customer"))
    names = cust.select(F.col("c_mktsegment").alias("service")).unionByName(sup.select(F.col("s_name").alias("service"))).unionByName(
        part.select(F.col("p_brand").alias("service"))
    )
    nodes = sup.select(F.col("s_name").alias("name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("service_id")).unionByName(
        part.select(F.col("p_brand").alias("name"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("service_id"))
    )
    return G.resolve_services(names, nodes)


@query(
    "G11_snapshot_version",
    """WITH v AS (SELECT o_orderpriority AS topology_version, count(DISTINCT o_custkey) AS nodes, count(*) AS edges FROM orders GROUP BY o_orderpriority)
SELECT *, edges <= (SELECT count(*) FROM orders) / 5 AS within_limits FROM v""",
)
def snapshot_version(spark, folder):
    orders = load(spark, folder, "orders")
    nodes = orders.select("o_custkey", F.col("o_orderpriority").alias("topology_version")).distinct()
    edges = orders.select(F.col("o_custkey").alias("up"), F.col("o_orderkey").alias("down"), F.col("o_orderpriority").alias("topology_version"))
    return G.snapshot_sizes(nodes, edges, max_edges=orders.count() // 5)


@query(
    "G12_blast_radius",
    """WITH RECURSIVE walk(root, node, depth, path) AS (
  SELECT DISTINCT down, down, 0, [down] FROM edges_tree WHERE dep = 'control'
  UNION ALL SELECT w.root, e.down, w.depth + 1, list_append(w.path, e.down) FROM walk w JOIN edges_tree e ON e.up = w.node WHERE w.depth < 2),
b AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY ALL)
SELECT w.root AS primary_service, w.node AS affected_service, w.depth, array_to_string(min(w.path), ' > ') AS path_summary
FROM walk w JOIN b ON b.root = w.root AND b.node = w.node AND b.depth = w.depth GROUP BY ALL""",
    ("edges_tree",),
)
def blast(spark, folder):
    edges = load(spark, folder, "edges_tree")
    nations = edges.where("dep = 'control'").select(F.col("down").alias("root")).distinct()
    return G.blast_radius(edges, nations, 2)[0]


@query(
    "G12_blast_summary",
    """WITH RECURSIVE walk(root, node, depth) AS (
  SELECT DISTINCT up, up, 0 FROM edges_tree WHERE dep = 'control'
  UNION SELECT w.root, e.down, w.depth + 1 FROM walk w JOIN edges_tree e ON e.up = w.node WHERE w.depth < 2)
SELECT root AS primary_service, count(DISTINCT node) AS affected_count, max(depth) AS deepest, true AS truncated, 2 AS max_hops FROM walk GROUP BY root""",
    ("edges_tree",),
)
def blast_summary(spark, folder):
    edges = load(spark, folder, "edges_tree")
    return G.blast_radius(edges, _regions(edges), 2)[1]


@query(
    "S16_read_topology",
    """WITH n AS (SELECT concat('s', CAST(s_suppkey AS VARCHAR)) AS id, n_name AS version FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT DISTINCT concat('c', CAST(c_custkey AS VARCHAR)), n_name FROM customer JOIN nation ON n_nationkey = c_nationkey),
e AS (SELECT DISTINCT concat('s', CAST(l_suppkey AS VARCHAR)) AS up, concat('c', CAST(o_custkey AS VARCHAR)) AS down FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT e.up, e.down, a.version AS topology_version FROM e JOIN n a ON a.id = e.up JOIN n b ON b.id = e.down
WHERE a.version = b.version AND a.version = (SELECT min(n_name) FROM nation)""",
)
def read_topology(spark, folder):
    nation, sup, cust = (load(spark, folder, t) for t in ("nation", "supplier", "customer"))
    wanted = nation.agg(F.min("n_name")).first()[0]
    named = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("topology_version"))
    one = sup.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("service_id"), F.col("s_nationkey").alias("k"))
    two = cust.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("service_id"), F.col("c_nationkey").alias("k"))
    nodes = one.unionByName(two).join(named, "k").select(
        "service_id", F.col("service_id").alias("name"), F.lit("compute").alias("service_type"), F.lit("trade").alias("topology_id"), "topology_version"
    )
    sold = load(spark, folder, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("o_orderkey")).join(
        load(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"
    )
    links = sold.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("up"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("down")
    ).distinct()
    edges = links.join(nodes.select(F.col("service_id").alias("up"), "topology_version"), "up").select(
        "up", "down", F.lit("sync").alias("dep"), F.lit("trade").alias("topology_id"), "topology_version"
    )
    return T.read_topology(nodes, edges, "trade", wanted)[1].select("up", "down", "topology_version")
