"""Registered queries on differences, digests and merges, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.numbers import cut_rank
from corvane.operators import changes as C
from corvane.plans.roles import table


def manifest(spark, sf):
    """Documents as files of a snapshot."""
    return table(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


def older(spark, sf):
    """An earlier snapshot: every tenth file differs, every eleventh is missing, and every thirteenth of now wasn't there."""
    n = F.substring("path", 3, 20).cast("long")
    m = manifest(spark, sf)
    then = m.where(n % 13 != 0).withColumn("content_hash", F.when(n % 10 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))
    return then.unionByName(m.where(n % 11 == 0).select(F.concat("path", F.lit(".old")).alias("path"), "content_hash"))


MANIFEST_SQL = "SELECT 'd/' || doc_id AS path, sha256(coalesce(text, '')) AS content_hash, doc_id FROM documents"
OLDER_SQL = f"SELECT path, CASE WHEN doc_id % 10 = 0 THEN sha256(content_hash) ELSE content_hash END AS content_hash FROM ({MANIFEST_SQL}) WHERE doc_id % 13 <> 0 UNION ALL SELECT path || '.old', content_hash FROM ({MANIFEST_SQL}) WHERE doc_id % 11 = 0"
DIFF_SQL = f"SELECT path, change FROM (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.content_hash <> n.content_hash THEN 'modified' END AS change FROM ({OLDER_SQL}) o FULL OUTER JOIN ({MANIFEST_SQL}) n ON o.path = n.path) WHERE change IS NOT NULL"


def prints(spark, sf, then: bool):
    """Orders as files with symbols: their parts; an earlier state has other sizes and symbols for some."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_set("l_partkey")).alias("symbols"), F.sum("l_quantity").cast("long").alias("total_lines"))
    k = F.col("k")
    if then:
        lines = lines.where(k % 19 != 0).withColumn("symbols", F.when(k % 7 == 0, F.slice("symbols", 1, F.greatest(F.size("symbols") - 1, F.lit(0)))).otherwise(F.col("symbols"))).withColumn("total_lines", F.when(k % 5 == 0, F.col("total_lines") * 2).otherwise(F.col("total_lines")))
        digest = F.when(k % 3 == 0, F.concat(F.lit("old"), k.cast("string"))).otherwise(k.cast("string"))
    else:
        lines, digest = lines.where(k % 23 != 0), k.cast("string")
    return lines.select(k.cast("string").alias("path"), digest.alias("content_hash"), "symbols", "total_lines")


_LINES = "SELECT l_orderkey AS k, list_sort(list_distinct(list(l_partkey))) AS symbols, CAST(sum(l_quantity) AS BIGINT) AS total_lines FROM lineitem GROUP BY 1"
PRINTS_SQL = f"""l AS ({_LINES}), old AS (SELECT CAST(k AS VARCHAR) AS path, CASE WHEN k % 3 = 0 THEN 'old' || k ELSE CAST(k AS VARCHAR) END AS content_hash, CASE WHEN k % 7 = 0 THEN symbols[1:len(symbols) - 1] ELSE symbols END AS symbols, CASE WHEN k % 5 = 0 THEN total_lines * 2 ELSE total_lines END AS total_lines FROM l WHERE k % 19 <> 0),
  now AS (SELECT CAST(k AS VARCHAR) AS path, CAST(k AS VARCHAR) AS content_hash, symbols, total_lines FROM l WHERE k % 23 <> 0),
  cmp AS (SELECT path, CASE WHEN n.content_hash = o.content_hash THEN 'none' WHEN n.symbols <> o.symbols THEN 'structural' WHEN o.total_lines > 0 AND (n.total_lines / o.total_lines > 1.5 OR n.total_lines / o.total_lines < 0.5) THEN 'structural' ELSE 'cosmetic' END AS level FROM old o JOIN now n USING (path)),
  levels AS (SELECT level, count(*) AS files FROM (SELECT level FROM cmp UNION ALL SELECT 'new' FROM now WHERE path NOT IN (SELECT path FROM old) UNION ALL SELECT 'deleted' FROM old WHERE path NOT IN (SELECT path FROM now)) GROUP BY 1)"""


def cache(spark, sf):
    """Cached texts of labelled documents; of some the source has changed since."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rows.select(F.col("doc_id").alias("node_id"), F.when(F.col("quality") == 0, F.lit("changed")).otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("source_hash"))


def plan(spark, sf):
    nodes = table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"))
    return C.reuse_plan(nodes, manifest(spark, sf).where(~F.col("path").endswith("7")), cache(spark, sf))


PLAN_SQL = f"SELECT d.doc_id AS node_id, CASE WHEN m.content_hash IS NULL THEN 'unavailable' WHEN l.quality = 1 THEN 'reuse' ELSE 'generate' END AS plan FROM documents d LEFT JOIN ({MANIFEST_SQL}) m ON m.doc_id = d.doc_id AND NOT ends_with(m.path, '7') LEFT JOIN labels l ON l.doc_id = d.doc_id"


def _merge(spark, sf):
    nodes = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("batch"), F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("state"))
    li = table(spark, sf, "lineitem")
    edges = li.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("direction"), F.col("l_extendedprice").alias("weight"), F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("position"))
    return C.merge_nodes_and_edges(nodes, edges)


_EDGES = "edges AS (SELECT * FROM (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS type, l_linestatus AS direction, l_extendedprice AS weight, l_orderkey AS batch, l_linenumber AS position, row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1), ids AS (SELECT DISTINCT o_custkey AS id FROM orders), whole AS (SELECT * EXCLUDE (n) FROM edges WHERE source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids))"


def nodes_with_state(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    state = F.when(F.col("toxic") == 1, "contradicted").when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "unverified")
    return rows.select("doc_id", F.col("source").alias("path"), state.alias("verification"))


def queries() -> dict:
    return {
        "manifest_diff": lambda s, d: C.diff_entries(older(s, d), manifest(s, d)),
        "changed_in_inventory": lambda s, d: C.restrict_to_inventory(C.diff_entries(older(s, d), manifest(s, d)), manifest(s, d).where(~F.col("path").endswith("3"))),
        "manifest_digest": lambda s, d: C.digest(manifest(s, d), "path", "content_hash"),
        "duplicate_contents": lambda s, d: C.duplicate_contents(manifest(s, d)),
        "fingerprint_levels": lambda s, d: C.compare_fingerprints(prints(s, d, True), prints(s, d, False)),
        "change_analysis": lambda s, d: C.analyze_changes(prints(s, d, True), prints(s, d, False)),
        "classify_update": lambda s, d: C.classify_update(C.analyze_changes(prints(s, d, True), prints(s, d, False)), prints(s, d, True).agg(F.count("*").alias("total_files"))),
        "reuse_plan": plan,
        "reuse_counts": lambda s, d: plan(s, d).groupBy("plan").agg(F.count("*").alias("nodes")),
        "cache_freshness": lambda s, d: manifest(s, d).select(F.substring("path", 3, 20).cast("long").alias("node_id"), "content_hash").join(cache(s, d), "node_id", "left").select("node_id", C.freshness(F.col("source_hash"), F.col("content_hash"), F.col("node_id") % 6 != 0).alias("state")),
        "stale_files": lambda s, d: C.stale_files(nodes_with_state(s, d), F.coalesce(F.col("verification") == "verified", F.lit(False))),
        "mark_dirty": lambda s, d: C.mark_dirty(nodes_with_state(s, d), table(s, d, "documents").where("doc_id % 5 = 0").select(F.col("source").alias("path"))).groupBy("path", "verification").agg(F.count("*").alias("nodes")),
        "merge_verification": lambda s, d: nodes_with_state(s, d).select("doc_id", C.merge_verification(F.col("verification"), F.when(F.col("doc_id") % 2 == 0, "dirty")).alias("state")),
        "merged_nodes": lambda s, d: _merge(s, d)[0],
        "merged_edges": lambda s, d: _merge(s, d)[1],
        "merge_totals": lambda s, d: _merge(s, d)[2],
        "verdict_overlay": lambda s, d: C.overlay(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("summary")), table(s, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "contradicted").otherwise("verified").alias("verdict"), F.col("quality").alias("position"))),
        "verdict_bars": lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").groupBy(F.when(F.col("toxic") == 1, "does not").when(F.col("quality") == 1, "does").when(F.col("quality") == 0, "none").otherwise("not checked").alias("verdict")).agg(F.count("*").alias("n")),
        "rank_cuts": lambda s, d: _cuts(s, d),
    }


def _cuts(spark, sf):
    """Fan-out of suppliers: the top tenth's and the bottom quarter's cut values."""
    fan = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("fan"))
    per_value = fan.groupBy("fan").agg(F.count("*").alias("k"))  # the ranks follow from counts by value, so no task sorts all rows
    values = per_value.agg(F.sort_array(F.collect_list(F.struct("fan", "k"))).alias("v"), F.sum("k").alias("n"))
    at = lambda rank: F.aggregate("v", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value")), lambda s, x: F.struct((s["seen"] + x["k"]).alias("seen"), F.when(s["value"].isNull() & (s["seen"] + x["k"] >= rank), x["fan"]).otherwise(s["value"]).alias("value")))["value"]
    return values.select(at(F.col("n") - cut_rank(F.col("n"), 0.1) + 1).alias("top_cut"), at(cut_rank(F.col("n"), 0.25)).alias("bottom_cut"))


def oracle_sql() -> dict[str, str]:
    states = "SELECT d.doc_id, source AS path, CASE WHEN toxic = 1 THEN 'contradicted' WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'unverified' END AS verification FROM documents d LEFT JOIN labels l USING (doc_id)"
    return {
        "manifest_diff": DIFF_SQL,
        "changed_in_inventory": f"SELECT * FROM ({DIFF_SQL}) WHERE change = 'removed' OR (path IN (SELECT path FROM ({MANIFEST_SQL})) AND NOT ends_with(path, '3'))",
        "manifest_digest": f"WITH l AS (SELECT sha256(path || chr(9) || content_hash) AS d FROM ({MANIFEST_SQL})), q AS (SELECT d[1:5] AS p, sha256(string_agg(d, chr(10) ORDER BY d)) AS d, count(*) AS n FROM l GROUP BY 1), p AS (SELECT p[1:2] AS p, sha256(string_agg(d, chr(10) ORDER BY q.p)) AS d, sum(n) AS n FROM q GROUP BY 1) SELECT sha256(string_agg(d, chr(10) ORDER BY p)) AS digest, CAST(sum(n) AS BIGINT) AS entries FROM p",
        "duplicate_contents": f"SELECT content_hash, min(path) AS first_path, count(*) AS copies FROM ({MANIFEST_SQL}) GROUP BY 1 HAVING count(*) > 1",
        "fingerprint_levels": f"WITH {PRINTS_SQL} SELECT path, level FROM cmp",
        "change_analysis": f"WITH {PRINTS_SQL} SELECT level, files FROM levels",
        "classify_update": f"WITH {PRINTS_SQL}, c AS (SELECT CAST(coalesce(sum(files) FILTER (level IN ('new', 'deleted', 'structural')), 0) AS BIGINT) AS structural_count FROM levels) SELECT structural_count, CASE WHEN structural_count = 0 THEN 'SKIP' WHEN structural_count > 30 OR structural_count / (SELECT count(*) FROM old) > 0.5 THEN 'FULL_UPDATE' WHEN structural_count > 10 THEN 'ARCHITECTURE_UPDATE' ELSE 'PARTIAL_UPDATE' END AS action FROM c",
        "reuse_plan": PLAN_SQL,
        "reuse_counts": f"SELECT plan, count(*) AS nodes FROM ({PLAN_SQL}) GROUP BY 1",
        "cache_freshness": "SELECT d.doc_id AS node_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id % 6 = 0 THEN 'noncanonical-language' WHEN quality <> 0 THEN 'fresh' ELSE 'stale' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)",
        "stale_files": f"SELECT path, bool_or(verification IS DISTINCT FROM 'verified') AS stale FROM ({states}) GROUP BY 1",
        "mark_dirty": f"SELECT path, CASE WHEN path IN (SELECT source FROM documents WHERE doc_id % 5 = 0) AND verification IS DISTINCT FROM 'contradicted' THEN 'dirty' ELSE verification END AS verification, count(*) AS nodes FROM ({states}) GROUP BY 1, 2",
        "merge_verification": f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND verification IS DISTINCT FROM 'contradicted' THEN 'dirty' ELSE verification END AS state FROM ({states})",
        "merged_nodes": "SELECT id, batch, position, state FROM (SELECT o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS batch, o_orderkey AS position, o_orderstatus AS state, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
        "merged_edges": f"WITH {_EDGES} SELECT * FROM whole",
        "merge_totals": f"WITH {_EDGES} SELECT (SELECT count(*) FROM orders) AS nodes_in, (SELECT count(*) FROM ids) AS nodes_out, (SELECT count(*) FROM lineitem) AS edges_in, (SELECT count(*) FROM edges) AS edges_distinct, (SELECT count(*) FROM whole) AS edges_out",
        "verdict_overlay": "SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'unchecked' WHEN toxic = 1 THEN 'contradicted' ELSE 'verified' END AS verdict, CASE WHEN toxic IS DISTINCT FROM 1 THEN text END AS summary FROM documents d LEFT JOIN labels l USING (doc_id)",
        "verdict_bars": "SELECT CASE WHEN toxic = 1 THEN 'does not' WHEN quality = 1 THEN 'does' WHEN quality = 0 THEN 'none' ELSE 'not checked' END AS verdict, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
        "rank_cuts": "WITH f AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS fan FROM lineitem GROUP BY 1), r AS (SELECT fan, row_number() OVER (ORDER BY fan DESC) AS d, row_number() OVER (ORDER BY fan) AS a, count(*) OVER () AS n FROM f) SELECT max(fan) FILTER (d = least(n, greatest(1, ceil(n * 0.1)))) AS top_cut, max(fan) FILTER (a = least(n, greatest(1, ceil(n * 0.25)))) AS bottom_cut FROM r",
    }
