"""Registered queries on facts and resolution, and their SQL. Orders are files, their lines declarations and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import paths as P
from corvane.functions import text as T
from corvane.operators import facts as K
from corvane.operators import resolve as R
from corvane.plans.roles import FILES_SQL, ancestors_sql, supplier_paths, table


def _s(c):
    return F.col(c).cast("string")


def decls(spark, sf):
    start = F.col("l_linenumber") * 10
    return table(spark, sf, "lineitem").select(F.concat(F.lit("o"), _s("l_orderkey")).alias("path"), F.col("l_returnflag").alias("owner"), F.when(F.col("l_linestatus") == "O", "function").otherwise("class").alias("kind"), F.when(F.col("l_partkey") % 11 > 0, F.concat(F.lit("f"), (F.col("l_partkey") % 40).cast("string"))).alias("name"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"))


DECLS = "SELECT 'o' || l_orderkey AS path, l_returnflag AS owner, CASE WHEN l_linestatus = 'O' THEN 'function' ELSE 'class' END AS kind, CASE WHEN l_partkey % 11 > 0 THEN 'f' || (l_partkey % 40) END AS name, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS pos, l_linenumber * 10 AS start, l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS \"end\" FROM lineitem"
ORDS = f"SELECT *, CAST(row_number() OVER (PARTITION BY path, owner, kind ORDER BY pos) - 1 AS INTEGER) AS ordinal FROM ({DECLS})"
IDS = f"SELECT *, kind || ':' || path || ':' || owner || '#' || coalesce(name, '@' || ordinal) AS id FROM ({ORDS})"
NODES = f"SELECT id, path, kind, name, start, \"end\", CASE WHEN \"end\" - start + 1 < 50 THEN 'simple' WHEN \"end\" - start + 1 <= 200 THEN 'moderate' ELSE 'complex' END AS complexity FROM ({IDS}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1"


def files(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey % 31 <> 0").select(F.concat(F.lit("o"), _s("o_orderkey")).alias("path"), F.col("o_orderpriority").alias("language"), F.when(F.col("o_orderstatus") == "O", "parsed").when(F.col("o_orderstatus") == "F", "zero-symbol").when(F.col("o_orderkey") % 2 == 0, "parse-failed").otherwise("binary").alias("status"))


FILES = "SELECT 'o' || o_orderkey AS path, o_orderpriority AS language, CASE WHEN o_orderstatus = 'O' THEN 'parsed' WHEN o_orderstatus = 'F' THEN 'zero-symbol' WHEN o_orderkey % 2 = 0 THEN 'parse-failed' ELSE 'binary' END AS status FROM orders WHERE o_orderkey % 31 <> 0"


def imports(spark, sf):
    return table(spark, sf, "orders").select(F.concat(F.lit("o"), _s("o_orderkey")).alias("path"), F.concat(F.lit("o"), (F.col("o_orderkey") + F.col("o_custkey") % 5 + 1).cast("string")).alias("target"))


IMPORTS = "SELECT 'o' || o_orderkey AS path, 'o' || (o_orderkey + o_custkey % 5 + 1) AS target FROM orders"


def calls(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat(F.lit("o"), _s("l_orderkey")).alias("path"), F.concat(F.lit("f"), (F.col("l_suppkey") % 40).cast("string")).alias("caller"), F.concat(F.lit("f"), (F.col("l_suppkey") % 45).cast("string")).alias("callee"), (F.col("l_linenumber") * 10 + 5).alias("line"))


CALLS = "SELECT 'o' || l_orderkey AS path, 'f' || (l_suppkey % 40) AS caller, 'f' || (l_suppkey % 45) AS callee, l_linenumber * 10 + 5 AS line FROM lineitem"
RESOLVED = f"""WITH n AS (SELECT path AS scope, name AS callee, count(*) AS n, min(id) AS id FROM ({NODES}) GROUP BY 1, 2), sc AS (SELECT DISTINCT path, scope FROM (SELECT path, path AS scope FROM ({CALLS}) UNION SELECT path, target FROM ({IMPORTS}))),
  f AS (SELECT c.path, c.callee, sum(n) AS n, min(id) AS id FROM (SELECT DISTINCT path, callee FROM ({CALLS})) c JOIN sc USING (path) JOIN n USING (scope, callee) GROUP BY 1, 2),
  r AS (SELECT path, callee, caller, line, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN id END AS target FROM ({CALLS}) LEFT JOIN f USING (path, callee))"""


def classes(spark, sf):
    return decls(spark, sf).where("kind = 'class' and name is not null").select("path", F.col("owner").alias("class"), F.array("name", F.concat("name", F.lit("x"))).alias("methods")).distinct()


def functions(spark, sf):
    return decls(spark, sf).where("kind = 'function' and name is not null")


_CLASSES = f"SELECT DISTINCT path, owner AS class, [name, name || 'x'] AS methods FROM ({DECLS}) WHERE kind = 'class' AND name IS NOT NULL"
_FUNCS = f"SELECT path, owner AS class, name AS method FROM ({DECLS}) WHERE kind = 'function' AND name IS NOT NULL"


def exports(spark, sf):
    return calls(spark, sf).select("path", F.col("caller").alias("name")).distinct()


def gaps(spark, sf):
    return K.resolve_calls(calls(spark, sf), decls(spark, sf), imports(spark, sf)).where("outcome <> 'resolved'").select(F.concat(F.lit("call-"), "outcome").alias("kind"), F.substring("path", 2, 1).alias("scope"), F.concat_ws(">", "path", "callee").alias("sample"))


def chain(spark, sf):
    """A class hierarchy over parts: each part below its half and its third."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    return p.select(F.col("k").alias("sub"), F.explode(F.array(F.floor(F.col("k") / 2), F.floor(F.col("k") / 3))).alias("super")).where("super > 0")


CHAIN = "SELECT DISTINCT p_partkey AS sub, CAST(unnest([floor(p_partkey / 2), floor(p_partkey / 3)]) AS BIGINT) AS super FROM part"
CLOSURE = f"WITH RECURSIVE d AS (SELECT sub, super FROM ({CHAIN}) WHERE super > 0 AND sub <> super), c AS (SELECT sub, super, 1 AS depth FROM d UNION SELECT c.sub, d.super, depth + 1 FROM c JOIN d ON d.sub = c.super)"


def queries() -> dict:
    graph = lambda s, d: K.union_edges(K.contains_edges(decls(s, d), files(s, d)), K.import_edges(imports(s, d), files(s, d))[0], K.resolve_calls(calls(s, d), decls(s, d), imports(s, d)).where("target is not null").select(F.concat(F.lit("file:"), "path").alias("source"), "target", F.lit("calls").alias("type")))
    return {
        "ordinals": lambda s, d: K.assign_ordinals(decls(s, d)),
        "declaration_nodes": lambda s, d: K.declaration_nodes(decls(s, d)),
        "id_collisions": lambda s, d: K.id_collisions(decls(s, d).where("name is not null")),
        "contains_edges": lambda s, d: K.contains_edges(decls(s, d), files(s, d)),
        "class_contains": lambda s, d: K.class_contains(classes(s, d).select("path", "class").distinct(), functions(s, d)),
        "methods_name_only": lambda s, d: K.methods_name_only(classes(s, d), functions(s, d)),
        "import_edges": lambda s, d: K.import_edges(imports(s, d), files(s, d))[0],
        "import_gaps": lambda s, d: K.import_edges(imports(s, d), files(s, d))[1],
        "export_outcomes": lambda s, d: K.match_exports(exports(s, d), decls(s, d)),
        "call_outcomes": lambda s, d: K.resolve_calls(calls(s, d), decls(s, d), imports(s, d)),
        "caller_by_containment": lambda s, d: K.caller_by_containment(calls(s, d), decls(s, d)),
        "gap_counts": lambda s, d: K.collect_gaps(gaps(s, d)).select("kind", "scope", "count", F.array_join("samples", ";").alias("samples")),
        "coverage_ledger": lambda s, d: K.coverage_ledger(files(s, d)),
        "coverage_violations": lambda s, d: K.conservation_violations(K.coverage_ledger(files(s, d))),
        "call_conservation": lambda s, d: K.conserves(K.resolve_calls(calls(s, d), decls(s, d), imports(s, d)), "outcome", calls(s, d)),
        "fact_edges": graph,
        "fact_edge_counts": lambda s, d: graph(s, d).groupBy("type", "stage").agg(F.count("*").alias("edges")),
        "overlapping_steps": lambda s, d: K.overlap_join(calls(s, d).select(F.concat_ws(":", "path", "line", "callee").alias("step"), "path", F.col("line").alias("start"), (F.col("line") + 8).alias("end")).distinct(), K.declaration_nodes(decls(s, d))),
        "path_probe": lambda s, d: R.probe(table(s, d, "orders").select(F.col("o_orderkey").alias("ref"), F.concat(F.lit("o"), F.floor(F.col("o_orderkey") / 10).cast("string")).alias("base")), files(s, d), ["1", "2", "3"], ["index"]),
        "suffix_index": lambda s, d: R.suffix_index(supplier_paths(s, d)),
        "resolve_suffix": lambda s, d: R.resolve_suffix(table(s, d, "supplier").select(F.col("s_suppkey").alias("ref"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("NATION_1/"), "s_name")).otherwise(F.lit("nowhere")).alias("suffix")), supplier_paths(s, d)),
        "longest_prefix": lambda s, d: R.longest_prefix(supplier_paths(s, d).select(F.col("path").alias("name")), table(s, d, "region").select(F.col("r_name").alias("prefix")).union(supplier_paths(s, d).where("s_suppkey % 2 = 0").select(F.substring_index("path", "/", 2))).distinct()),
        "unit_of_file": lambda s, d: R.unit_of(supplier_paths(s, d), supplier_paths(s, d).where("s_suppkey % 5 = 0").select("path")),
        "subtype_closure": lambda s, d: R.subtype_closure(chain(s, d)),
        "nearest_declaring": lambda s, d: R.nearest_declaring(R.subtype_closure(chain(s, d)), table(s, d, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("owner"), F.col("p_size").alias("method"))),
        "ancestor_directories": lambda s, d: supplier_paths(s, d).select("path", F.explode(P.ancestor_dirs(F.col("path"))).alias("dir")),
        "complexity_words": lambda s, d: table(s, d, "part").select("p_partkey", T.normalize_complexity(F.when(F.col("p_partkey") % 4 == 0, F.lit(" High ")).when(F.col("p_partkey") % 4 == 1, (F.col("p_size") % 9).cast("string")).when(F.col("p_partkey") % 4 == 2, F.lit("odd")).otherwise(F.lit("easy"))).alias("complexity")),
        "routes": lambda s, d: table(s, d, "supplier").select("s_suppkey", T.format_route(F.lit("get"), F.concat(F.lit("/n"), F.col("s_nationkey").cast("string"), F.lit("/")), F.lit(""), F.col("s_name")).alias("route")),
        "line_counts": lambda s, d: table(s, d, "documents").select("doc_id", T.count_lines(F.col("text")).cast("long").alias("lines")),
        "since_millis": lambda s, d: table(s, d, "orders").select("o_orderkey", T.since_millis(F.when(F.col("o_orderkey") % 5 == 0, F.lit("2001-02-30")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("millis")),
        "json_props": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
        "event_rollup": lambda s, d: table(s, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users")),
    }


def oracle_sql() -> dict[str, str]:
    contains = f"SELECT 'file:' || path AS source, id AS target, 'contains' AS type FROM ({NODES}) WHERE path IN (SELECT path FROM ({FILES}))"
    imp = f"SELECT DISTINCT 'file:' || path AS source, 'file:' || target AS target, 'imports' AS type FROM ({IMPORTS}) WHERE target IN (SELECT path FROM ({FILES}))"
    ledger = f"SELECT language, count(*) AS files, count(*) FILTER (status = 'parsed') AS parsed, count(*) FILTER (status = 'zero-symbol') AS zero_symbol, count(*) FILTER (status = 'no-extractor') AS skipped_no_extractor, count(*) FILTER (status = 'parse-failed') AS skipped_parse_failed, count(*) FILTER (status = 'binary') AS skipped_other FROM ({FILES}) GROUP BY 1"
    edges = f"{RESOLVED}, e AS (SELECT type, source, target, 0 AS stage FROM ({contains}) UNION ALL SELECT type, source, target, 1 FROM ({imp}) UNION ALL SELECT 'calls', 'file:' || path, target, 2 FROM r WHERE target IS NOT NULL), g AS (SELECT type, source, target, min(stage) AS stage FROM e GROUP BY 1, 2, 3)"
    probes = f"WITH t AS (SELECT o_orderkey AS ref, 'o' || CAST(floor(o_orderkey / 10) AS BIGINT) AS base FROM orders), c AS (SELECT ref, base || x AS path, i FROM t, (VALUES (0, ''), (1, '1'), (2, '2'), (3, '3'), (4, '/index')) v(i, x)) SELECT ref, arg_min(path, i) AS path FROM c WHERE path IN (SELECT path FROM ({FILES})) GROUP BY 1"
    suffixes = f"SELECT path, array_to_string(string_split(path, '/')[i:], '/') AS suffix FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM ({FILES_SQL}))"
    prefixes = "SELECT path, array_to_string(string_split(path, '/')[1:i], '/') AS prefix, i FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM ({f}))".format(f=FILES_SQL)
    steps = f"SELECT DISTINCT path || ':' || line || ':' || callee AS step, path, line AS start, line + 8 AS \"end\" FROM ({CALLS})"
    return {
        "ordinals": ORDS,
        "declaration_nodes": NODES,
        "id_collisions": f"SELECT kind || ':' || path || ':' || owner || '#' || name AS id, count(DISTINCT start * 100000 + \"end\") AS ranges FROM ({DECLS}) WHERE name IS NOT NULL GROUP BY 1 HAVING ranges > 1",
        "contains_edges": contains,
        "class_contains": f"SELECT DISTINCT path, class, method FROM ({_CLASSES}) JOIN ({_FUNCS}) USING (path, class)",
        "methods_name_only": f"SELECT path, class, method FROM (SELECT path, class, unnest(methods) AS method FROM ({_CLASSES})) c WHERE NOT EXISTS (SELECT 1 FROM ({_FUNCS}) f WHERE f.path = c.path AND f.class = c.class AND f.method = c.method)",
        "import_edges": imp,
        "import_gaps": f"SELECT path, target FROM ({IMPORTS}) WHERE target NOT IN (SELECT path FROM ({FILES}))",
        "export_outcomes": f"WITH n AS (SELECT path, name, count(*) AS n, min(id) AS id FROM ({NODES}) GROUP BY 1, 2) SELECT path, name, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN id END AS target FROM (SELECT DISTINCT path, caller AS name FROM ({CALLS})) LEFT JOIN n USING (path, name)",
        "call_outcomes": f"{RESOLVED} SELECT * FROM r",
        "caller_by_containment": f"SELECT c.path, c.caller, c.line, min(pos) AS source FROM (SELECT DISTINCT path, caller, line FROM ({CALLS})) c JOIN ({DECLS}) d ON d.path = c.path AND d.name = c.caller AND c.line BETWEEN d.start AND d.\"end\" GROUP BY 1, 2, 3 HAVING count(*) = 1",
        "gap_counts": f"{RESOLVED}, g AS (SELECT 'call-' || outcome AS kind, path[2:2] AS scope, path || '>' || callee AS sample FROM r WHERE outcome <> 'resolved') SELECT kind, scope, count(*) AS count, array_to_string(list_sort(list(DISTINCT sample))[1:5], ';') AS samples FROM g GROUP BY 1, 2",
        "coverage_ledger": ledger,
        "coverage_violations": f"SELECT * FROM ({ledger}) WHERE files <> parsed + zero_symbol + skipped_no_extractor + skipped_parse_failed + skipped_other",
        "call_conservation": "SELECT count(*) AS records, count(*) AS outcomes, true AS adds_up FROM lineitem",
        "fact_edges": f"{edges} SELECT * FROM g",
        "fact_edge_counts": f"{edges} SELECT type, stage, count(*) AS edges FROM g GROUP BY 1, 2",
        "overlapping_steps": f"WITH s AS ({steps}), n AS ({NODES}), h AS (SELECT step, id FROM s JOIN n ON n.path = s.path AND s.start <= n.\"end\" AND n.start <= s.\"end\") SELECT step, id FROM h UNION ALL SELECT step, 'file:' || path FROM s WHERE step NOT IN (SELECT step FROM h)",
        "path_probe": probes,
        "suffix_index": suffixes,
        "resolve_suffix": f"WITH x AS ({suffixes}), r AS (SELECT s_suppkey AS ref, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'NATION_1/' || s_name ELSE 'nowhere' END AS suffix FROM supplier) SELECT ref, CASE count(path) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN count(path) = 1 THEN min(path) END AS path FROM r LEFT JOIN x USING (suffix) GROUP BY 1",
        "longest_prefix": f"WITH k AS (SELECT r_name AS prefix FROM region UNION SELECT array_to_string(string_split(path, '/')[1:2], '/') FROM ({FILES_SQL}) WHERE s_suppkey % 2 = 0) SELECT p.path AS name, arg_max(k.prefix, i) AS prefix FROM ({prefixes}) p LEFT JOIN k USING (prefix) GROUP BY 1",
        "unit_of_file": f"WITH k AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') AS prefix FROM ({FILES_SQL}) WHERE s_suppkey % 5 = 0) SELECT p.path, arg_max(k.prefix, i) AS unit FROM ({prefixes}) p LEFT JOIN k USING (prefix) GROUP BY 1",
        "subtype_closure": f"{CLOSURE} SELECT sub, super, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY 1, 2",
        "nearest_declaring": f"{CLOSURE}, d2 AS (SELECT p_partkey AS owner, p_size AS method FROM part WHERE p_partkey % 7 = 0), a AS (SELECT owner AS sub, method, owner, 0 AS depth FROM d2 UNION ALL SELECT sub, method, super, depth FROM (SELECT sub, super, min(depth) AS depth FROM c GROUP BY 1, 2) JOIN d2 ON d2.owner = super) SELECT sub, method, owner FROM a QUALIFY row_number() OVER (PARTITION BY sub, method ORDER BY depth, owner) = 1",
        "ancestor_directories": f"SELECT path, unnest({ancestors_sql('path')}) AS dir FROM ({FILES_SQL})",
        "complexity_words": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'complex' WHEN 2 THEN 'moderate' WHEN 3 THEN 'simple' ELSE CASE WHEN p_size % 9 <= 3 THEN 'simple' WHEN p_size % 9 <= 6 THEN 'moderate' ELSE 'complex' END END AS complexity FROM part",
        "routes": "SELECT s_suppkey, 'GET /n' || s_nationkey || '/' || s_name AS route FROM supplier",
        "line_counts": "SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS lines FROM documents",
        "since_millis": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN epoch_ms(date_trunc('day', o_orderdate)) END AS millis FROM orders",
        "json_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
        "event_rollup": "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    }
