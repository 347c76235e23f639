"""Registered graph queries and their SQL. The graph: suppliers call parts, customers hold orders, nations contain both."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import graph as G
from corvane.plans.roles import FILES_SQL, supplier_paths, table
from corvane.session import checkpointed

LAYERS = [("Data", ["asia", "nation_1"]), ("Service", ["europe", "nation_2"]), ("Edge", ["africa"])]
CATEGORIES = {"A": "flow", "R": "back"}


def edges(spark, sf):
    """region contains nation contains supplier and customer; customer calls order; order is similar to the supplier of each of its lines."""
    t = lambda n: table(spark, sf, n)
    e = lambda df, s, d, k: df.select(F.concat(*s).alias("source"), F.concat(*d).alias("target"), F.lit(k).alias("type"))
    c = lambda x: F.col(x).cast("string")
    li = F.lit
    return (
        e(t("nation"), [li("r"), c("n_regionkey")], [li("n"), c("n_nationkey")], "contains")
        .union(e(t("supplier"), [li("n"), c("s_nationkey")], [li("s"), c("s_suppkey")], "contains"))
        .union(e(t("customer"), [li("n"), c("c_nationkey")], [li("c"), c("c_custkey")], "contains"))
        .union(e(t("orders"), [li("c"), c("o_custkey")], [li("o"), c("o_orderkey")], "calls"))
        .union(e(t("lineitem"), [li("o"), c("l_orderkey")], [li("s"), c("l_suppkey")], "similar"))
    )


EDGES_SQL = """SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 'contains' AS type FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'contains' FROM supplier
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains' FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'calls' FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey, 'similar' FROM lineitem"""


def sparse(spark, sf):
    """A directed graph of suppliers: the supplier of each order line calls that of the order's next line."""
    li = table(spark, sf, "lineitem")
    a = li.select("l_orderkey", F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("i"))
    b = li.select("l_orderkey", F.col("l_suppkey").alias("target"), F.col("l_linenumber").alias("j"))
    return a.join(b, "l_orderkey").where("j = i + 1").select("source", "target", F.lit("calls").alias("type")).distinct()


SPARSE_SQL = "SELECT DISTINCT a.l_suppkey AS source, b.l_suppkey AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"


def halves(spark, sf):
    """Parts as functions: each calls its half and its third."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("source"), F.explode(F.array(F.floor(k / 2), F.floor(k / 3))).alias("target")).where("target > 0")


HALVES_SQL = "SELECT DISTINCT p_partkey AS source, unnest([p_partkey // 2, p_partkey // 3]) AS target FROM part"


def part_nodes(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node"))


def all_nodes(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))


def _seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def _kinds(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.split("p_type", " ")[0].alias("type"), F.when(F.col("p_size") > 40, "complex").when(F.col("p_size") > 20, "moderate").when(F.col("p_size") > 5, "simple").alias("complexity"), F.col("p_brand").alias("layer"))


KINDS_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS id, string_split(p_type, ' ')[1] AS type, CASE WHEN p_size > 40 THEN 'complex' WHEN p_size > 20 THEN 'moderate' WHEN p_size > 5 THEN 'simple' END AS complexity, p_brand AS layer FROM part"


def _supply(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.col("l_returnflag").alias("type"))


SUPPLY_SQL = "SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_returnflag AS type FROM lineitem"


def queries() -> dict:
    g = lambda s, d: G.file_graph(_placed(s, d), _supply(s, d))
    return {
        "one_hop": lambda s, d: G.one_hop(edges(s, d), _seeds(s, "n1", "s3")),
        "bounded_bfs": lambda s, d: G.levels(edges(s, d), _seeds(s, "r1"), 2, types=G.FOLLOWED),
        "distances": lambda s, d: G.levels(edges(s, d), _seeds(s, "o7"), types=None),
        "reachable": lambda s, d: G.reachable(sparse(s, d), all_nodes(s, d).where("node % 50 = 1")),
        "unreachable": lambda s, d: all_nodes(s, d).join(G.reachable(sparse(s, d), all_nodes(s, d).where("node % 50 = 1")), "node", "left_anti"),
        "reachable_parts": lambda s, d: G.reachable(halves(s, d), part_nodes(s, d).where("node % 50 = 1")),
        "unreachable_parts": lambda s, d: part_nodes(s, d).join(G.reachable(halves(s, d), part_nodes(s, d).where("node % 50 = 1")), "node", "left_anti"),
        "weak_components": lambda s, d: G.weak_components(all_nodes(s, d), sparse(s, d)),
        "strong_components": lambda s, d: G.strong_components(all_nodes(s, d), sparse(s, d)),
        "shortest_path_length": lambda s, d: G.shortest_path(edges(s, d), ["r0"], ["r3"], 8).agg((F.count("*") - 1).alias("hops")),
        "traverse_boundary": lambda s, d: s.createDataFrame([(k, str(v)) for k, v in G.traverse(edges(s, d), ["r1"], 2, budgets={"max_nodes": 40}, types=None)[2].items()], "name string, value string"),
        "file_graph": lambda s, d: g(s, d)[0],
        "file_graph_ignored": lambda s, d: g(s, d)[1],
        "fan_in_out": lambda s, d: G.fan(g(s, d)[0]),
        "reading_order": lambda s, d: G.reading_order(sparse(s, d).select("source", "target"), s.createDataFrame([(1,)], "node long"), 3),
        "detect_layers": lambda s, d: G.detect_layers(supplier_paths(s, d), LAYERS),
        "layer_stats": lambda s, d: G.layer_stats(_kinds(s, d).select("id", "layer"), _kinds(s, d).select("id", "complexity")),
        "first_layer": lambda s, d: G.first_layer(table(s, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("layer"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("position"))),
        "filter_nodes": lambda s, d: G.filter_nodes(_kinds(s, d), ["STANDARD", "PROMO", "SMALL"], ["complex", "moderate"], _kinds(s, d).select("id", "layer"), ["Brand#11", "Brand#12", "Brand#34"]),
        "filter_edges": lambda s, d: G.filter_edges(_supply(s, d), table(s, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")).union(table(s, d, "part").where("p_size < 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")))), CATEGORIES, ["back"]),
        "affected_nodes": lambda s, d: G.affected(_placed(s, d), _supply(s, d), s.createDataFrame([("ASIA",), ("f3",)], "path string")).groupBy("state").agg(F.count("*").alias("nodes")),
        "induced_edges": lambda s, d: G.induced(edges(s, d), G.one_hop(edges(s, d), _seeds(s, "n1", "s3"))),
        "neighbours_outside": lambda s, d: G.neighbours_outside(table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.col("s_nationkey").cast("string").alias("batch")), _supply(s, d)),
        "propagate_confidence": lambda s, d: G.propagate_least(all_nodes(s, d).withColumn("level", F.when(F.col("node") % 40 == 0, 0).when(F.col("node") % 9 == 0, 1).otherwise(2)), sparse(s, d).select("source", "target")),
        "communities_cover": lambda s, d: _cover(s, d),
        "pooled_batches": lambda s, d: G.chunk_groups(table(s, d, "customer").select(F.col("c_custkey").alias("member"), F.floor(F.sqrt(F.col("c_custkey") * 20)).alias("grp"))),
    }


def _placed(spark, sf):
    """Suppliers by region and parts by size, some without a place."""
    s = supplier_paths(spark, sf).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.split("path", "/")[0].alias("path"))
    p = table(spark, sf, "part").where("p_partkey % 10 > 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("path"))
    return s.unionByName(p)


PLACED_SQL = f"SELECT 's' || s_suppkey AS id, string_split(path, '/')[1] AS path FROM ({FILES_SQL}) UNION ALL SELECT 'p' || p_partkey, 'f' || p_size FROM part WHERE p_partkey % 10 > 0"


def _cover(spark, sf):
    """Whether each node with an edge has one community, inside its weak component."""
    e = checkpointed(sparse(spark, sf))
    w = G.weak_components(all_nodes(spark, sf), e)
    found = checkpointed(G.communities(e, w))
    named = found.join(w, "node").join(w.select(F.col("node").alias("community"), F.col("component").alias("home")), "community")
    return named.agg(F.count("*").alias("nodes"), F.count_distinct("node").alias("distinct_nodes"), F.bool_and(F.col("component") == F.col("home")).alias("inside"))


def oracle_sql() -> dict[str, str]:
    both = f"b AS (SELECT source AS x, target AS y FROM e UNION SELECT target, source FROM e)"
    followed = f"e AS (SELECT * FROM ({EDGES_SQL}) WHERE type <> 'similar'), {both}"
    hop = lambda pre, seed, limit: f"WITH RECURSIVE {pre}, r AS (SELECT '{seed}' AS node, 0 AS hop UNION SELECT b.y, r.hop + 1 FROM r JOIN b ON b.x = r.node WHERE r.hop < {limit}) SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY node"
    reach = f"WITH RECURSIVE e AS ({SPARSE_SQL}), r AS (SELECT s_suppkey AS node FROM supplier WHERE s_suppkey % 50 = 1 UNION SELECT e.target FROM r JOIN e ON e.source = r.node)"
    below = f"WITH RECURSIVE e AS (SELECT * FROM ({HALVES_SQL}) WHERE target > 0), r AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 50 = 1 UNION SELECT e.target FROM r JOIN e ON e.source = r.node)"
    closure = f"WITH RECURSIVE e AS ({SPARSE_SQL}), {both}, r AS (SELECT s_suppkey AS node, s_suppkey AS reached FROM supplier UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.reached)"
    forward = f"WITH RECURSIVE e AS ({SPARSE_SQL}), r AS (SELECT s_suppkey AS node, s_suppkey AS reached FROM supplier UNION SELECT r.node, e.target FROM r JOIN e ON e.source = r.reached)"
    lifted = f"l AS (SELECT a.path AS f, b.path AS t FROM ({SUPPLY_SQL}) e LEFT JOIN ({PLACED_SQL}) a ON a.id = e.source LEFT JOIN ({PLACED_SQL}) b ON b.id = e.target)"
    near = f"e AS (SELECT * FROM ({EDGES_SQL}) WHERE type <> 'similar'), h AS (SELECT 'n1' AS node UNION SELECT 's3' UNION SELECT CASE WHEN source IN ('n1', 's3') THEN target ELSE source END FROM e WHERE source IN ('n1', 's3') OR target IN ('n1', 's3'))"
    layer_rows = ", ".join(f"({i}, '{n}', '{p}')" for i, (n, ws) in enumerate(LAYERS) for w in ws for p in (w, w + "s"))
    return {
        "one_hop": f"WITH {near} SELECT node FROM h",
        "bounded_bfs": hop(followed, "r1", 2),
        "distances": hop(f"e AS ({EDGES_SQL}), {both}", "o7", 16),
        "shortest_path_length": f"SELECT coalesce(min(hop), -1)::BIGINT AS hops FROM ({hop(f'e AS ({EDGES_SQL}), {both}', 'r0', 8)}) WHERE node = 'r3'",
        "reachable": f"{reach} SELECT node FROM r",
        "unreachable": f"{reach} SELECT s_suppkey AS node FROM supplier WHERE s_suppkey NOT IN (SELECT node FROM r)",
        "reachable_parts": f"{below} SELECT node FROM r",
        "unreachable_parts": f"{below} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM r)",
        "weak_components": f"{closure} SELECT node, min(reached) AS component FROM r GROUP BY node",
        "strong_components": f"{forward} SELECT a.node, min(a.reached) AS component FROM r a JOIN r b ON a.node = b.reached AND a.reached = b.node GROUP BY a.node",
        "file_graph": f"WITH {lifted} SELECT DISTINCT f AS source, t AS target FROM l WHERE f <> t",
        "file_graph_ignored": f"WITH {lifted} SELECT CASE WHEN f IS NULL OR t IS NULL THEN 'unresolved' WHEN f = t THEN 'same-file' ELSE 'kept' END AS reason, count(*) AS edges FROM l GROUP BY 1",
        "fan_in_out": f"WITH {lifted}, p AS (SELECT DISTINCT f, t FROM l WHERE f <> t) SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT f AS node, 0 AS i, 1 AS o FROM p UNION ALL SELECT t, 1, 0 FROM p) GROUP BY node",
        "reading_order": f"WITH RECURSIVE e AS ({SPARSE_SQL}), r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hop UNION SELECT e.target, hop + 1 FROM r JOIN e ON e.source = r.node WHERE hop < 3), m AS (SELECT node, min(hop) AS hop FROM r GROUP BY 1), i AS (SELECT target AS node, count(*) AS n FROM e GROUP BY 1) SELECT node, CAST(hop AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY hop ORDER BY coalesce(n, 0) DESC, node) AS INTEGER) AS place FROM m LEFT JOIN i USING (node)",
        "detect_layers": f"WITH p(priority, layer, segment) AS (VALUES {layer_rows}), s AS (SELECT path, unnest(string_split(lower(path), '/')) AS segment FROM ({FILES_SQL})), h AS (SELECT path, arg_min(layer, priority) AS layer FROM s JOIN p USING (segment) GROUP BY 1) SELECT f.path, coalesce(layer, 'Core') AS layer FROM ({FILES_SQL}) f LEFT JOIN h USING (path)",
        "layer_stats": f"SELECT layer, count(*) AS nodes, CASE WHEN count(*) FILTER (complexity = 'complex') > 0.3 * count(*) THEN 'complex' WHEN count(*) FILTER (complexity = 'moderate') > 0.3 * count(*) THEN 'moderate' ELSE 'simple' END AS complexity FROM ({KINDS_SQL}) GROUP BY 1",
        "first_layer": "SELECT l_partkey AS id, arg_min(l_suppkey, l_orderkey * 100 + l_linenumber) AS layer FROM lineitem GROUP BY 1",
        "filter_nodes": f"SELECT * FROM ({KINDS_SQL}) WHERE type IN ('STANDARD', 'PROMO', 'SMALL') AND (complexity IS NULL OR complexity IN ('complex', 'moderate')) AND layer IN ('Brand#11', 'Brand#12', 'Brand#34')",
        "filter_edges": f"SELECT * FROM ({SUPPLY_SQL}) WHERE source IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0) AND target IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 25) AND type IN ('R', 'N')",
        "affected_nodes": f"WITH n AS ({PLACED_SQL}), c AS (SELECT id FROM n WHERE path IN ('ASIA', 'f3')), e AS ({SUPPLY_SQL}), a AS (SELECT target AS id FROM e WHERE source IN (SELECT id FROM c) UNION SELECT source FROM e WHERE target IN (SELECT id FROM c)) SELECT 'changed' AS state, count(*) AS nodes FROM c UNION ALL SELECT 'affected', count(*) FROM a WHERE id NOT IN (SELECT id FROM c) AND id IN (SELECT id FROM n)",
        "induced_edges": f"WITH {near} SELECT source, target, type FROM ({EDGES_SQL}) WHERE source IN (SELECT node FROM h) AND target IN (SELECT node FROM h)",
        "neighbours_outside": f"WITH d AS (SELECT CAST(s_nationkey AS VARCHAR) AS batch, 'p' || l_partkey AS neighbour, count(*) AS degree FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) SELECT batch, neighbour, degree FROM d QUALIFY row_number() OVER (PARTITION BY batch ORDER BY degree DESC, neighbour) <= 50",
        "pooled_batches": "WITH g AS (SELECT c_custkey AS member, CAST(floor(sqrt(c_custkey * 20)) AS BIGINT) AS grp FROM customer), n AS (SELECT member, grp, count(*) OVER (PARTITION BY grp) AS n FROM g) SELECT member, 'g:' || grp AS batch FROM n WHERE n >= 3 UNION ALL SELECT member, 'pool:' || CAST(floor((row_number() OVER (ORDER BY member) - 1) / 25) AS BIGINT) FROM n WHERE n < 3",
        "propagate_confidence": f"{forward}, l AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 40 = 0 THEN 0 WHEN s_suppkey % 9 = 0 THEN 1 ELSE 2 END AS level FROM supplier) SELECT r.reached AS node, CAST(min(level) AS INTEGER) AS level FROM r JOIN l ON l.node = r.node GROUP BY 1",
    }
