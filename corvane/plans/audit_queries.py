"""Registered validation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import audit as A
from corvane.plans.roles import table

CATALOGUE = [("route", "pipes", r" \| "), ("page", "marks", r"###"), ("job", "money", r"\$\$\$"), ("main", "plain", r"^The ")]


def _lines(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")


LINES = "SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line FROM documents"


def _parts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), "p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "Fn ").when(F.col("p_size") % 3 == 1, "CLASS").when(F.col("p_size") % 7 > 2, "odd").alias("type"), (F.col("p_size") / 40).alias("weight"))


PARTS = "SELECT p_partkey AS id, ' ' || p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'Fn ' WHEN p_size % 3 = 1 THEN 'CLASS' WHEN p_size % 7 > 2 THEN 'odd' END AS type, p_size / 40 AS weight FROM part"


def _graph(spark, sf):
    nodes = table(spark, sf, "orders").select((F.col("o_custkey") % 400).alias("id"))
    edges = table(spark, sf, "lineitem").select((F.col("l_partkey") % 450).alias("source"), (F.col("l_suppkey") * 4).alias("target"), F.col("l_returnflag").alias("type"))
    return nodes, edges


EDGES = "SELECT l_partkey % 450 AS source, l_suppkey * 4 AS target, l_returnflag AS type FROM lineitem"
IDS = "SELECT o_custkey % 400 AS id FROM orders"


def _cited(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("feature"), F.col("l_orderkey").alias("path"), (F.col("l_partkey") % 60).alias("start"), (F.col("l_partkey") % 60 + F.col("l_quantity").cast("long")).alias("end"))


CITED = 'SELECT l_suppkey AS feature, l_orderkey AS path, l_partkey % 60 AS start, l_partkey % 60 + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem'


def _claims(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 == 0, F.lit(-1)).otherwise(F.col("doc_id")).alias("path"), (F.col("doc_id") % 6 + 1).cast("int").alias("line"), F.lit("tion the").alias("token"))


def _verdicts(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "N", "contradicted").otherwise("odd").alias("verdict"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("position")).where("id % 3 > 0")


_V = "SELECT l_suppkey AS id, CASE l_returnflag WHEN 'A' THEN 'verified' WHEN 'N' THEN 'contradicted' ELSE 'odd' END AS verdict, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS position FROM lineitem WHERE l_suppkey % 3 > 0"


def queries() -> dict:
    ap = lambda s, d: A.apply_verdicts(table(s, d, "supplier").where("s_suppkey % 5 > 0").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "dirty").alias("state")), _verdicts(s, d), ["verified", "contradicted"])
    return {
        "repair_nodes": lambda s, d: A.repair_nodes(_parts(s, d), ["function", "class", "concept"]),
        "shape_issues": lambda s, d: A.issues(_parts(s, d), {"no-type": F.col("type").isNull(), "over-weight": F.col("weight") > 1, "untrimmed": F.col("name") != F.trim("name")}).groupBy("issue").agg(F.count("*").alias("n")),
        "integrity": lambda s, d: A.integrity(*_graph(s, d)),
        "valid_edges": lambda s, d: A.drop_invalid(*_graph(s, d), F.col("id") % 3 > 0)[1],
        "verify_anchors": lambda s, d: A.verify_anchors(_claims(s, d), _lines(s, d)),
        "stride_sample": lambda s, d: A.sample_stride(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 30),
        "verdict_states": lambda s, d: ap(s, d)[0],
        "verdict_counts": lambda s, d: ap(s, d)[1],
        "quote_checks": lambda s, d: A.check_quotes(table(s, d, "documents").select(F.col("doc_id").alias("unit"), (F.col("doc_id") * 2).alias("doc"), F.when(F.col("doc_id") % 2 == 0, F.lit(". The ")).otherwise(F.lit("(a|b) ")).alias("quote")), table(s, d, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("body"))),
        "entry_points": lambda s, d: A.entry_points(_lines(s, d), CATALOGUE),
        "shared_ranges": lambda s, d: A.shared_ranges(_cited(s, d)),
        "dictionary_mismatches": lambda s, d: A.mismatches(table(s, d, "customer").select(F.col("c_nationkey").alias("app"), F.col("c_mktsegment").alias("name"), (F.col("c_custkey") % 50).alias("value"))),
        "verification_batches": lambda s, d: A.batches(table(s, d, "documents").select("doc_id", "source"), "source", "doc_id", 30),
    }


def oracle_sql() -> dict[str, str]:
    kind = "CASE lower(trim(type)) WHEN 'fn' THEN 'function' WHEN 'class' THEN 'class' ELSE 'concept' END"
    return {
        "repair_nodes": f"SELECT id, trim(name) AS name, {kind} AS type, greatest(0.0, least(1.0, coalesce(weight, 0.5)))::DOUBLE AS weight, concat_ws(',', CASE WHEN type IS DISTINCT FROM {kind} THEN 'type' END, CASE WHEN weight > 1 THEN 'weight' END, 'name') AS fixed FROM ({PARTS})",
        "shape_issues": f"SELECT issue, count(*) AS n FROM (SELECT 'no-type' AS issue FROM ({PARTS}) WHERE type IS NULL UNION ALL SELECT 'over-weight' FROM ({PARTS}) WHERE weight > 1 UNION ALL SELECT 'untrimmed' FROM ({PARTS})) GROUP BY 1",
        "integrity": f"SELECT 'duplicate-id' AS issue, count(*) AS n FROM (SELECT id FROM ({IDS}) GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'dangling-source', count(*) FROM ({EDGES}) WHERE source NOT IN ({IDS}) UNION ALL SELECT 'dangling-target', count(*) FROM ({EDGES}) WHERE target NOT IN ({IDS}) UNION ALL SELECT 'self-edge', count(*) FROM ({EDGES}) WHERE source = target",
        "valid_edges": f"SELECT DISTINCT source, target, type FROM ({EDGES}) WHERE source <> target AND source IN (SELECT id FROM ({IDS}) WHERE id % 3 > 0) AND target IN (SELECT id FROM ({IDS}) WHERE id % 3 > 0)",
        "verify_anchors": f"WITH l AS ({LINES}), c AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN -1 ELSE doc_id END AS path, doc_id % 6 + 1 AS line FROM documents) SELECT id, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.path = c.path AND abs(l.line - c.line) <= 1 AND contains(l.text, 'tion the')) THEN 'verified' WHEN path >= 0 THEN 'contradicted' ELSE 'unverified' END AS state FROM c",
        "stride_sample": "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE r IN (SELECT i * n // 30 FROM range(30) t(i))",
        "verdict_states": f"WITH f AS (SELECT id, verdict FROM ({_V}) WHERE verdict <> 'odd' QUALIFY row_number() OVER (PARTITION BY id ORDER BY position) = 1) SELECT s_suppkey AS id, CASE WHEN verdict IS NULL THEN st WHEN verdict = 'contradicted' OR st IS NULL THEN verdict ELSE st END AS state FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'dirty' END AS st FROM supplier WHERE s_suppkey % 5 > 0) LEFT JOIN f ON f.id = s_suppkey",
        "verdict_counts": f"WITH v AS ({_V}), k AS (SELECT * FROM v WHERE verdict <> 'odd' AND id % 5 > 0) SELECT (SELECT count(DISTINCT id) FROM k) AS applied, (SELECT count(*) FROM v WHERE verdict = 'odd') AS invalid, (SELECT count(*) FROM v WHERE verdict <> 'odd' AND id % 5 = 0) AS unknown, (SELECT count(*) - count(DISTINCT id) FROM k) AS duplicate",
        "quote_checks": "WITH u AS (SELECT doc_id AS unit, doc_id * 2 AS doc, CASE WHEN doc_id % 2 = 0 THEN '. The ' ELSE '(a|b) ' END AS quote FROM documents), j AS (SELECT unit, text, (length(text) - length(replace(text, quote, ''))) / length(quote) AS n FROM u LEFT JOIN documents d ON d.doc_id = u.doc) SELECT unit, CASE WHEN text IS NULL THEN 'missing-document' WHEN n = 0 THEN 'absent' WHEN n > 1 THEN 'repeated' ELSE 'once' END AS state FROM j",
        "entry_points": f"SELECT path, line, CASE WHEN contains(text, ' | ') THEN 'route' WHEN contains(text, '###') THEN 'page' WHEN contains(text, '$$$') THEN 'job' ELSE 'main' END AS kind, CASE WHEN contains(text, ' | ') THEN 'pipes' WHEN contains(text, '###') THEN 'marks' WHEN contains(text, '$$$') THEN 'money' ELSE 'plain' END AS framework FROM ({LINES}) WHERE NOT regexp_matches(trim(text), '^(//|#|\\*|/\\*|--)') AND (contains(text, ' | ') OR contains(text, '###') OR contains(text, '$$$') OR starts_with(text, 'The '))",
        "shared_ranges": f"WITH c AS ({CITED}), few AS (SELECT path FROM c GROUP BY 1 HAVING count(DISTINCT feature) BETWEEN 2 AND 3), x AS (SELECT DISTINCT a.path, a.feature AS a, b.feature AS b, greatest(a.start, b.start) AS start, least(a.\"end\", b.\"end\") AS \"end\" FROM c a JOIN c b ON a.path = b.path AND a.feature < b.feature AND a.start <= b.\"end\" AND b.start <= a.\"end\" WHERE a.path IN (SELECT path FROM few)), m AS (SELECT *, CASE WHEN start > coalesce(max(\"end\") OVER (PARTITION BY path, a, b ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) + 1 THEN 1 ELSE 0 END AS new FROM x), i AS (SELECT *, sum(new) OVER (PARTITION BY path, a, b ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT path, a, b, min(start) AS start, max(\"end\") AS \"end\" FROM i GROUP BY path, a, b, island",
        "dictionary_mismatches": "WITH l AS (SELECT c_nationkey AS app, replace(lower(c_mktsegment), '_', '') AS name, list(DISTINCT c_custkey % 50) AS v FROM customer GROUP BY 1, 2) SELECT x.name, x.app AS \"left\", y.app AS \"right\", CAST(len(list_filter(x.v, lambda i: NOT list_contains(y.v, i))) AS INTEGER) AS only_left, CAST(len(list_filter(y.v, lambda i: NOT list_contains(x.v, i))) AS INTEGER) AS only_right, CAST(len(list_filter(x.v, lambda i: list_contains(y.v, i))) AS INTEGER) AS both FROM l x JOIN l y ON x.name = y.name AND x.app < y.app",
        "verification_batches": "SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 30) AS BIGINT) AS batch FROM documents",
    }
