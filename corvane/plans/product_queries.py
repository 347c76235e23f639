"""Registered queries on lineage, unused functions, product tables, chunks, tours and merge rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import chunks as H
from corvane.operators import history
from corvane.operators import lineage as N
from corvane.operators import liveness as L
from corvane.operators import merging as M
from corvane.operators import tables as T
from corvane.operators import tour as U
from corvane.plans.roles import CHANGES_SQL, FILES_SQL, changes, supplier_paths, table
from corvane.session import tasks_for

_s = lambda c: F.col(c).cast("string")
_cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])


def renames(spark, sf):
    """A history: orders, newest first, change 60 paths; lines of certain quantities are renames, additions and deletions."""
    lines = table(spark, sf, "lineitem")
    rows = lines.repartition(tasks_for(lines), "l_orderkey").groupBy("l_orderkey", (F.col("l_suppkey") % 60).alias("k")).agg(F.min(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("f")).select("l_orderkey", "k", F.col("f.l_quantity").alias("q"), F.col("f.l_partkey").alias("p"))
    path, old = _cat("f", _s("k")), _cat("f", (F.col("p") % 60).cast("string"))
    moved = (F.col("q") == 50) & (path != old)
    return rows.select((-F.col("l_orderkey")).alias("commit_seq"), F.when(moved, "R").when(F.col("q") == 1, "A").when(F.col("q") == 2, "D").otherwise("M").alias("status"), path.alias("path"), F.when(moved, old).alias("old_path"))


RENAMES = "SELECT -l_orderkey AS commit_seq, CASE WHEN moved THEN 'R' WHEN q = 1 THEN 'A' WHEN q = 2 THEN 'D' ELSE 'M' END AS status, path, CASE WHEN moved THEN old END AS old_path FROM (SELECT l_orderkey, q, 'f' || k AS path, 'f' || (p % 60) AS old, q = 50 AND k <> p % 60 AS moved FROM (SELECT l_orderkey, l_suppkey % 60 AS k, arg_min(l_quantity, (l_linenumber, l_partkey, l_quantity)) AS q, arg_min(l_partkey, (l_linenumber, l_partkey, l_quantity)) AS p FROM lineitem GROUP BY 1, 2))"

WORDS = ["the", "and", "of", "in"]


def functions(spark, sf):
    """Parts as functions whose names are words of the documents, each in the first lines of one."""
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select(_cat("p", _s("p_partkey")).alias("id"), F.when(k % 31 == 0, "no-name").otherwise(name).alias("name"), _cat("d", (k % 200).cast("string")).alias("path"), F.lit(1).alias("start"), (F.col("p_size") % 3 + 1).cast("int").alias("end"))


FUNCTIONS = "SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 31 = 0 THEN 'no-name' ELSE ['the', 'and', 'of', 'in'][p_size % 4 + 1] END AS name, 'd' || (p_partkey % 200) AS path, 1 AS start, p_size % 3 + 1 AS \"end\" FROM part"


def uses(spark, sf):
    """Which parts refer to which, and the roots."""
    p, k, n = table(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    e = lambda rows, to, kind: rows.select(_cat("p", _s("p_partkey")).alias("source"), _cat("p", to.cast("string")).alias("target"), F.lit(kind).alias("type"))
    return (
        e(p, (k * 7 + n) % 1999 + 1, "calls").union(e(p.where(n % 10 == 0), F.floor(k / 2) + 1, "implements")).union(e(p.where(n % 14 == 0), k * 3 % 1999 + 1, "overrides"))
        .union(e(p.where(k % 100 == 7), k, "routes")).union(e(p.where((n == 50) & (k % 3 == 0)), k, "invokes"))
    )


USES = "SELECT 'p' || p_partkey AS source, 'p' || ((p_partkey * 7 + p_size) % 1999 + 1) AS target, 'calls' AS type FROM part UNION ALL SELECT 'p' || p_partkey, 'p' || (p_partkey // 2 + 1), 'implements' FROM part WHERE p_size % 10 = 0 UNION ALL SELECT 'p' || p_partkey, 'p' || (p_partkey * 3 % 1999 + 1), 'overrides' FROM part WHERE p_size % 14 = 0 UNION ALL SELECT 'p' || p_partkey, 'p' || p_partkey, 'routes' FROM part WHERE p_partkey % 100 = 7 UNION ALL SELECT 'p' || p_partkey, 'p' || p_partkey, 'invokes' FROM part WHERE p_size = 50 AND p_partkey % 3 = 0"
LEFT = f"""f AS ({FUNCTIONS}), u AS (SELECT * FROM ({USES}) WHERE source IN (SELECT id FROM f) AND target IN (SELECT id FROM f)),
  refs AS (SELECT source, target, type AS edge, false AS reverse FROM u WHERE type IN ('calls', 'implements', 'overrides') UNION SELECT target, source, type, true FROM u WHERE type IN ('implements', 'overrides')),
  live AS (SELECT target AS id FROM u WHERE type IN ('routes', 'invokes') UNION SELECT refs.target FROM live JOIN refs ON refs.source = live.id),
  cand AS (SELECT id FROM f WHERE id NOT IN (SELECT id FROM live)), inn AS (SELECT * FROM refs WHERE source IN (SELECT id FROM cand) AND target IN (SELECT id FROM cand)),
  ahead AS (SELECT id, id AS reached FROM cand UNION SELECT ahead.id, inn.target FROM ahead JOIN inn ON inn.source = ahead.reached),
  comp AS (SELECT a.id, min(a.reached) AS component FROM ahead a JOIN ahead b ON b.id = a.reached AND b.reached = a.id GROUP BY 1),
  entered AS (SELECT DISTINCT y.component FROM inn JOIN comp x ON x.id = inn.source JOIN comp y ON y.id = inn.target WHERE x.component <> y.component),
  found AS (SELECT id, component, component NOT IN (SELECT component FROM entered) AS entry FROM comp)"""


def texts(spark, sf):
    return table(spark, sf, "documents").select(_cat("d", _s("doc_id")).alias("path"), "text")


def decisions(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(_cat("p", _s("p_partkey")).alias("id"), F.when(k % 50 == 1, "entry").when(k % 77 == 0, "test-entry").alias("kind")).where("kind is not null")


DECISIONS = "SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 50 = 1 THEN 'entry' WHEN p_partkey % 77 = 0 THEN 'test-entry' END AS kind FROM part WHERE p_partkey % 50 = 1 OR p_partkey % 77 = 0"
STATUS = f"""{LEFT}, d AS ({DECISIONS}), byd AS (SELECT ahead.reached AS id, bool_or(kind = 'entry') AS e FROM ahead JOIN d ON d.id = ahead.id GROUP BY 1),
  st AS (SELECT cand.id, CASE WHEN e THEN 'removed' WHEN e IS NOT NULL THEN 'test-only' ELSE 'unused' END AS status FROM cand LEFT JOIN byd USING (id))"""


def levels(spark, sf):
    return table(spark, sf, "part").select(_cat("p", _s("p_partkey")).alias("id"), F.when(F.col("p_partkey") % 40 == 0, 0).when(F.col("p_partkey") % 9 == 0, 1).otherwise(2).alias("level"))


def tour_files(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    tail = F.when(k % 97 == 0, _cat("x", _s("p_partkey"), "/main.py")).when(k % 89 == 0, _cat("x", _s("p_partkey"), "/Server.go")).when(k % 2 == 0, _cat("deep/er/p", _s("p_partkey"), ".py")).otherwise(_cat("p", _s("p_partkey"), ".py"))
    member = F.when(n % 4 > 0, _cat("m", (n % 4).cast("string"))).otherwise("")
    return table(spark, sf, "part").select(k.alias("k"), F.when(member != "", F.concat(member, F.lit("/"), tail)).otherwise(tail).alias("path"), member.alias("member"), F.col("p_brand").alias("layer"))


TOUR_FILES = "SELECT k, CASE WHEN member <> '' THEN member || '/' || tail ELSE tail END AS path, member, layer FROM (SELECT p_partkey AS k, p_brand AS layer, CASE WHEN p_size % 4 > 0 THEN 'm' || (p_size % 4) ELSE '' END AS member, CASE WHEN p_partkey % 97 = 0 THEN 'x' || p_partkey || '/main.py' WHEN p_partkey % 89 = 0 THEN 'x' || p_partkey || '/Server.go' WHEN p_partkey % 2 = 0 THEN 'deep/er/p' || p_partkey || '.py' ELSE 'p' || p_partkey || '.py' END AS tail FROM part)"


def tour_pairs(spark, sf):
    """The part of a line leads to that of the order's next line."""
    li, f = table(spark, sf, "lineitem"), tour_files(spark, sf)
    a = li.select("l_orderkey", F.col("l_partkey").alias("a"), F.col("l_linenumber").alias("i"))
    b = li.select("l_orderkey", F.col("l_partkey").alias("b"), (F.col("l_linenumber") - 1).alias("i"))
    ends = a.join(b, ["l_orderkey", "i"]).where("a <> b").select("a", "b").distinct()
    return ends.join(f.select(F.col("k").alias("a"), F.col("path").alias("source")), "a").join(f.select(F.col("k").alias("b"), F.col("path").alias("target")), "b").select("source", "target")


TOUR = f"""fl AS ({TOUR_FILES}), pr AS (SELECT DISTINCT x.path AS source, y.path AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey JOIN fl x ON x.k = a.l_partkey JOIN fl y ON y.k = b.l_partkey),
  fo AS (SELECT source AS path, count(*) AS n FROM pr GROUP BY 1), fi AS (SELECT target AS path, count(*) AS n FROM pr GROUP BY 1),
  fa AS (SELECT fl.*, coalesce(fi.n, 0) AS fan_in, coalesce(fo.n, 0) AS fan_out, len(string_split(fl.path, '/')) - 1 - CASE WHEN member <> '' THEN 1 ELSE 0 END AS depth FROM fl LEFT JOIN fi ON fi.path = fl.path LEFT JOIN fo ON fo.path = fl.path),
  cut AS (SELECT max(fan_out) FILTER (d = least(n, greatest(1, ceil(n * 0.1)))) AS oc, max(fan_in) FILTER (a = least(n, greatest(1, ceil(n * 0.25)))) AS ic FROM (SELECT fan_out, fan_in, row_number() OVER (ORDER BY fan_out DESC) AS d, row_number() OVER (ORDER BY fan_in) AS a, count(*) OVER () AS n FROM fa)),
  en AS (SELECT path, member, concat_ws('+', CASE WHEN regexp_matches(path, '(^|/)(main\\.py|Server\\.go)$') THEN 'entry-name' END, CASE WHEN depth <= 2 AND fan_out > 0 AND fan_out >= oc AND fan_in <= ic THEN 'entry-shape' END) AS reasons, fan_out - fan_in AS score, fan_in, fan_out, CAST(depth AS INTEGER) AS depth FROM fa, cut),
  st AS (SELECT member, arg_min(path, (CASE WHEN ends_with(path, '/main.py') THEN 0 WHEN ends_with(path, '/Server.go') THEN 1 ELSE 4 END, depth, -fan_out, path)) AS path FROM en WHERE reasons <> '' AND fan_out >= 1 GROUP BY 1)"""
WALKS = f"""{TOUR}, r AS (SELECT member, path, 0 AS depth FROM st UNION SELECT r.member, pr.target, r.depth + 1 FROM r JOIN pr ON pr.source = r.path WHERE r.depth < 3),
  w AS (SELECT member, path, min(depth) AS depth FROM r GROUP BY 1, 2), ws AS (SELECT w.member, w.path, CAST(w.depth AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY w.member ORDER BY w.depth, coalesce(fi.n, 0) DESC, w.path) - 1 AS INTEGER) AS step FROM w LEFT JOIN fi ON fi.path = w.path)"""


def test_graph(spark, sf):
    """Suppliers as modules and their tests, with edges between them that point either way."""
    k = F.col("s_suppkey")
    path = F.when(k % 3 == 0, _cat("pkg/a", _s("s_suppkey"), ".py")).when(k % 3 == 1, _cat("pkg/test_a", (k - 1).cast("string"), ".py")).otherwise(_cat("pkg/b", _s("s_suppkey"), ".go"))
    files = table(spark, sf, "supplier").select(k.alias("k"), F.concat(F.lit("file:"), path).alias("id"), F.lit("file").alias("type"), path.alias("name"), path.alias("path"))
    li = table(spark, sf, "lineitem").where("l_quantity = 7").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100 + 1).alias("b"), F.when(F.col("l_returnflag") == "R", "calls").otherwise("tested_by").alias("type"), F.col("l_discount").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    edges = li.join(files.select(F.col("k").alias("a"), F.col("id").alias("source")), "a").join(files.select(F.col("k").alias("b"), F.col("id").alias("target")), "b").select("source", "target", "type", "weight", "position")
    return files.drop("k"), edges


_TF = "SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'pkg/a' || s_suppkey || '.py' WHEN 1 THEN 'pkg/test_a' || (s_suppkey - 1) || '.py' ELSE 'pkg/b' || s_suppkey || '.go' END AS path, s_suppkey % 3 = 1 AS test FROM supplier"
TESTED = f"""tf AS ({_TF}), te AS (SELECT x.path AS s, y.path AS t, x.test AS st, y.test AS tt, l_discount AS weight, l_orderkey * 10 + l_linenumber AS position FROM lineitem JOIN tf x ON x.k = l_suppkey JOIN tf y ON y.k = l_partkey % 100 + 1 WHERE l_quantity = 7 AND l_returnflag <> 'R'),
  kp AS (SELECT 'file:' || CASE WHEN st THEN t ELSE s END AS source, 'file:' || CASE WHEN st THEN s ELSE t END AS target, weight, CASE WHEN st THEN 'swapped' ELSE 'kept' END AS origin FROM te WHERE st <> tt QUALIFY row_number() OVER (PARTITION BY 1 + 0, CASE WHEN st THEN t ELSE s END, CASE WHEN st THEN s ELSE t END ORDER BY weight DESC, position) = 1),
  ad AS (SELECT 'file:' || p.path AS source, 'file:' || q.path AS target FROM tf q JOIN tf p ON p.path = replace(q.path, 'test_', '') WHERE q.test AND 'file:' || q.path NOT IN (SELECT target FROM kp)),
  al AS (SELECT source, target, weight, origin FROM kp UNION ALL SELECT source, target, NULL, 'added' FROM ad)"""


def _ids(spark, sf):
    k = F.col("p_partkey")
    node = F.when(k % 6 == 0, _cat("file:file:", F.col("p_name"))).when(k % 6 == 1, _cat("proj:file:", F.col("p_name"))).when(k % 6 == 2, _cat("func:", F.col("p_brand"), ":f")).when(k % 6 == 3, F.col("p_name")).when(k % 6 == 4, _cat("table:", F.col("p_name"))).otherwise(F.col("p_brand"))
    kind = F.when(k % 6 == 3, "function").when(k % 6 == 5, F.when(k % 4 == 1, "odd").otherwise("class")).otherwise("file")
    return table(spark, sf, "part").select("p_partkey", M.normalize_node_id(node, kind, F.when(k % 9 > 0, F.col("p_type")), F.col("p_name")).alias("id"))


def evidence(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit"), _cat("f", (F.col("l_suppkey") % 7).cast("string")).alias("file"), F.col("l_linenumber").alias("line"))


def checks(spark, sf):
    """Checks of order lines; of those with one position the earlier row of the table comes first, as its SQL takes them in a scan in order."""
    li = table(spark, sf, "lineitem").where("l_quantity < 40")
    verdict = F.when(F.col("l_returnflag") == "A", "does").when(F.col("l_returnflag") == "R", "not").when(F.col("l_tax") > 0.05, "none").otherwise("maybe")
    return li.select(F.col("l_orderkey").alias("unit"), _cat("f", (F.col("l_suppkey") % 7).cast("string")).alias("file"), F.least("l_linenumber", F.lit(5)).alias("line"), verdict.alias("verdict"), F.struct("l_linenumber", "_metadata.file_name", "_metadata.row_index").alias("position"))


CHECKED = """ev AS (SELECT l_orderkey AS unit, 'f' || (l_suppkey % 7) AS file, l_linenumber AS line FROM lineitem), ck AS (SELECT l_orderkey AS unit, 'f' || (l_suppkey % 7) AS file, least(l_linenumber, 5) AS line, CASE l_returnflag WHEN 'A' THEN 'does' WHEN 'R' THEN 'not' ELSE CASE WHEN l_tax > 0.05 THEN 'none' ELSE 'maybe' END END AS verdict, l_linenumber AS position FROM lineitem WHERE l_quantity < 40),
  fc AS (SELECT unit, file, line, verdict FROM ck QUALIFY row_number() OVER (PARTITION BY unit, file, line ORDER BY position) = 1),
  jn AS (SELECT unit, count(*) FILTER (verdict = 'does') AS does, count(*) FILTER (verdict = 'not') AS "not", count(*) FILTER (verdict = 'none') AS "none", count(*) FILTER (verdict IS NULL) AS unchecked, count(*) FILTER (verdict = 'maybe') AS other, count(*) AS n FROM ev LEFT JOIN fc USING (unit, file, line) GROUP BY 1),
  un AS (SELECT unit, does, "not", "none", unchecked, other, CASE WHEN unchecked = n THEN 'not checked' ELSE 'does ' || does || ' / not ' || "not" || ' / none ' || "none" || CASE WHEN unchecked > 0 THEN ' / not checked ' || unchecked ELSE '' END || CASE WHEN other > 0 THEN ' / other ' || other ELSE '' END END AS text FROM jn)"""
EDGES_OF_PRICE = [1000.0, 50000.0, 100000.0, 200000.0, 300000.0]
PRIORITIES = ["5-LOW", "1-URGENT", "0-NEVER", "3-MEDIUM"]


def queries() -> dict:
    cand = lambda s, d: L.candidates(functions(s, d), uses(s, d))

    def totals(s, d):
        f = functions(s, d)
        return L.candidate_totals(f, *L.candidates(f, uses(s, d)))

    def census(s, d):
        f = functions(s, d)
        return L.census(*[(c := L.candidates(f, uses(s, d)))[0], f, c[1]], texts(s, d))

    def report(s, d):
        found, inner = cand(s, d)
        return L.report(found, inner, decisions(s, d).join(found.select("id"), "id", "left_semi"), levels(s, d))

    entries = lambda s, d: U.entry_candidates(tour_files(s, d).select("path", "member"), tour_pairs(s, d))
    walks = lambda s, d: U.reading_walks(tour_pairs(s, d), U.walk_starts(entries(s, d)))
    fans = lambda s, d: tour_files(s, d).join(U.fan(tour_pairs(s, d)).withColumnRenamed("node", "path"), "path")
    parts = lambda s, d: table(s, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 5, F.col("p_type")).alias("kind"), "p_brand", (F.col("p_partkey") % 10).alias("grp"))
    cut = lambda s, d: table(s, d, "documents").select("doc_id", H.comments_and_strings(F.col("text")).alias("f"))
    return {
        "current_files": lambda s, d: N.follow_renames(renames(s, d), table(s, d, "supplier").where("s_suppkey % 60 < 40").select(_cat("f", (F.col("s_suppkey") % 60).cast("string")).alias("path"))),
        "unused_candidates": lambda s, d: cand(s, d)[0],
        "unused_referrers": lambda s, d: cand(s, d)[1],
        "unused_totals": totals,
        "unused_roots": lambda s, d: L.root_counts(functions(s, d), uses(s, d)),
        "unused_census": census,
        "unused_statuses": lambda s, d: L.statuses(*cand(s, d), decisions(s, d)),
        "unused_report": report,
        "decision_problems": lambda s, d: L.check_decisions(cand(s, d)[0], decisions(s, d).union(decisions(s, d).where("kind = 'test-entry'"))),
        "filtered_rows": lambda s, d: T.filter_rows(parts(s, d), {"p_brand": ["Brand#11", "Brand#12", "Brand#23", "Brand#34"], "kind": []}, " A", ["p_name", "kind"], group=("grp", 3)),
        "unknown_rows": lambda s, d: T.filter_rows(parts(s, d), {"kind": ["unknown"]}, unknown={"kind": "unknown"}),
        "sorted_page": lambda s, d: T.page_of(T.sort_rows(supplier_paths(s, d).select("path", "lines", "s_suppkey"), "lines", "s_suppkey", False), 100, 99, 30)[0],
        "price_bins": lambda s, d: T.histogram_bins(table(s, d, "orders"), "o_totalprice", EDGES_OF_PRICE),
        "score_shares": lambda s, d: T.score_shares(supplier_paths(s, d), "path", "lines"),
        "priority_bars": lambda s, d: T.bars(table(s, d, "orders"), "o_orderpriority", PRIORITIES),
        "diff_layer_counts": lambda s, d: T.diff_layer_counts(table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderpriority").alias("layer"), F.col("o_orderkey").alias("id")), table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 5 > 0, _s("o_custkey")).alias("path")), table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "changed").otherwise("affected").alias("state"))),
        "checked_units": lambda s, d: T.join_checks(evidence(s, d), checks(s, d))[0],
        "check_totals": lambda s, d: T.join_checks(evidence(s, d), checks(s, d))[1],
        "units_by_verdict": lambda s, d: T.filter_units(T.join_checks(evidence(s, d), checks(s, d))[0], ["not", "not checked"]).select("unit"),
        "selection_ledger": lambda s, d: T.selection_ledger(table(s, d, "documents").select("source", F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 11 == 0, "sensitive").when(F.col("doc_id") % 5 == 0, "filtered-by-ignore").when(F.col("doc_id") % 7 == 0, "filtered-by-defaults").otherwise("selected").alias("kind"))),
        "operation_counts": lambda s, d: T.operation_counts(table(s, d, "events"), "event_type", ["click", "view", "purchase", "none"]),
        "cross_region_pairs": lambda s, d: T.across_roots(history.co_change(changes(s, d)), table(s, d, "region").select(F.col("r_name").alias("prefix")), 25),
        "comments_and_strings": lambda s, d: cut(s, d).select("doc_id", F.array_join("f.comments", "|").alias("comments"), F.array_join("f.strings", "|").alias("strings")),
        "chunk_words": lambda s, d: cut(s, d).select("doc_id", F.size(H.token_bag(F.array(F.lit("doc")), F.col("f.comments"), F.col("f.strings"))).alias("words")),
        "declaration_types": lambda s, d: table(s, d, "part").select("p_partkey", H.declaration_type(F.element_at(F.array(*[F.lit(x) for x in ("view", "enum", "target", "mutation", "output", "thing")]), (F.col("p_size") % 6 + 1).cast("int"))).alias("type")),
        "tour_entries": entries,
        "tour_starts": lambda s, d: U.walk_starts(entries(s, d)),
        "tour_walks": walks,
        "tour_reading_list": lambda s, d: U.interleave(walks(s, d)),
        "tour_hubs": lambda s, d: U.top_by(fans(s, d), "fan_in", U.QUOTAS["fan_in"]),
        "tour_layers": lambda s, d: U.top_by(fans(s, d), "fan_in", U.QUOTAS["layer"], "layer"),
        "tested_files": lambda s, d: M.link_tests(*test_graph(s, d))[0],
        "tested_totals": lambda s, d: M.link_tests(*test_graph(s, d))[1],
        "node_ids": _ids,
        "whole_file_nodes": lambda s, d: M.whole_file_nodes(_whole(s, d)),
        "recovered_imports": lambda s, d: M.recover_imports(_whole(s, d), table(s, d, "lineitem").where("l_returnflag = 'A'").select(_cat("file:q", _s("l_partkey")).alias("source"), _cat("file:q", _s("l_suppkey")).alias("target"), F.lit("imports").alias("type")), table(s, d, "lineitem").select(_cat("q", _s("l_partkey")).alias("path"), _cat("q", _s("l_suppkey")).alias("target")))[0],
    }


def _whole(spark, sf):
    k = F.col("p_partkey")
    path = _cat("q", _s("p_partkey"))
    rows = table(spark, sf, "part").where("p_size > 10").select(k.alias("position"), F.when(k % 4 == 0, "config").when(k % 4 == 1, "table").otherwise("file").alias("type"), path.alias("path"))
    more = table(spark, sf, "part").where("p_partkey % 8 = 0").select((k + 1000000).alias("position"), F.lit("file").alias("type"), path.alias("path"))
    return rows.union(more).select(F.concat("type", F.lit(":"), "path").alias("id"), "type", F.col("path").alias("name"), "path", "position")


_WHOLE = "SELECT type || ':' || path AS id, type, path, position FROM (SELECT p_partkey AS position, CASE p_partkey % 4 WHEN 0 THEN 'config' WHEN 1 THEN 'table' ELSE 'file' END AS type, 'q' || p_partkey AS path FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey + 1000000, 'file', 'q' || p_partkey FROM part WHERE p_partkey % 8 = 0)"
WHOLE = f"SELECT path, arg_min(id, (CASE WHEN type = 'file' THEN 0 ELSE 1 END, position)) AS id, count(*) AS choices FROM ({_WHOLE}) WHERE type <> 'table' GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    parts = "SELECT p_partkey, p_name, CASE WHEN p_size > 5 THEN p_type END AS kind, p_brand, p_partkey % 10 AS grp FROM part"
    rec = "WITH RECURSIVE "
    newest = "SELECT h.commit_seq, h.status, h.path, h.old_path, e.commit_seq AS es, e.\"to\" AS et FROM h ASOF LEFT JOIN ev e ON e.path = h.path AND h.commit_seq > e.commit_seq"
    bins = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(EDGES_OF_PRICE, EDGES_OF_PRICE[1:], strict=False)))
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(PRIORITIES))
    trim = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    string = "'\"(?:[^\"\\\\]|\\\\[^\\n])*\"|''(?:[^''\\\\]|\\\\[^\\n])*''|`(?:[^`\\\\]|\\\\[^\\n])*`'"
    doc = "'\"\"\"[\\s\\S]*?\"\"\"|''''''[\\s\\S]*?'''''''"
    block = "'/\\*[\\s\\S]*?\\*/'"
    full = lambda xs: f"list_filter({xs}, lambda x: regexp_replace(x, '\\s+', '', 'g') <> '')"
    cut = f"""c1 AS (SELECT doc_id, list_transform(regexp_extract_all(text, {doc}), lambda x: {trim('x[4:length(x) - 3]')}) AS docs, regexp_replace(text, {doc}, ' ', 'g') AS t FROM documents),
      c2 AS (SELECT doc_id, docs, list_transform(regexp_extract_all(t, {block}), lambda x: {trim('x[3:length(x) - 2]')}) AS blocks, regexp_replace(t, {block}, ' ', 'g') AS t FROM c1),
      c3 AS (SELECT doc_id, docs, blocks, list_transform(regexp_extract_all(t, {string}), lambda x: x[2:length(x) - 1]) AS strings, regexp_replace(t, {string}, ' ', 'g') AS t FROM c2),
      c4 AS (SELECT doc_id, list_concat(list_concat({full('docs')}, {full('blocks')}), {full("list_transform(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '//|#')), lambda y: " + trim("regexp_replace(y, '^[\\s\\S]*?(?://|#)', '')") + ")")}) AS comments, {full('strings')} AS strings FROM c3)"""
    words = "list_transform({x}, lambda s: len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(s, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+'), lambda w: w <> '')))"
    occ = "toks AS (SELECT path, line, unnest(regexp_extract_all(t, '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM (SELECT 'd' || doc_id AS path, unnest(string_split(text, chr(10))) AS t, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line FROM documents WHERE text IS NOT NULL)), occ AS (SELECT name, path, line, count(*) AS n FROM toks WHERE name IN ('the', 'and', 'of', 'in') GROUP BY 1, 2, 3)"
    return {
        "current_files": f"{rec} h AS ({RENAMES}), ev AS (SELECT path, commit_seq, max(\"to\") AS \"to\" FROM (SELECT path, commit_seq, NULL AS \"to\" FROM h WHERE status IN ('A', 'C', 'R') UNION ALL SELECT old_path, commit_seq, path FROM h WHERE status = 'R') GROUP BY 1, 2), m AS ({newest}), sel AS (SELECT DISTINCT 'f' || (s_suppkey % 60) AS path FROM supplier WHERE s_suppkey % 60 < 40), w AS (SELECT commit_seq AS s0, path AS p0, path AS p, es, et FROM m UNION ALL SELECT w.s0, w.p0, m.path, m.es, m.et FROM w JOIN m ON m.commit_seq = w.es AND m.path = w.et), z AS (SELECT s0, p0, max(CASE WHEN es IS NULL AND p IN (SELECT path FROM sel) THEN p END) AS current FROM w GROUP BY 1, 2) SELECT h.commit_seq, h.status, h.path, h.old_path, z.current FROM h JOIN z ON z.s0 = h.commit_seq AND z.p0 = h.path",
        "unused_candidates": f"{rec} {LEFT} SELECT * FROM found",
        "unused_referrers": f"{rec} {LEFT} SELECT * FROM inn",
        "unused_totals": f"{rec} {LEFT}, bt AS (SELECT source AS x, target AS y FROM inn UNION SELECT target, source FROM inn), weak AS (SELECT id, id AS reached FROM cand UNION SELECT weak.id, bt.y FROM weak JOIN bt ON bt.x = weak.reached) SELECT (SELECT count(*) FROM f) AS functions, (SELECT count(*) FROM f) - (SELECT count(*) FROM cand) AS reachable, (SELECT count(*) FROM cand) AS candidates, (SELECT count(DISTINCT component) FROM found WHERE entry) AS entry_components, (SELECT count(DISTINCT m) FROM (SELECT id, min(reached) AS m FROM weak GROUP BY 1)) AS clusters",
        "unused_roots": f"SELECT count(DISTINCT target) FILTER (type = 'routes') AS routes, count(DISTINCT target) FILTER (type = 'invokes') AS invokes FROM ({USES}) WHERE target IN (SELECT id FROM ({FUNCTIONS}))",
        "unused_census": f"{rec} {LEFT}, {occ}, own AS (SELECT f.* FROM f JOIN cand USING (id)), sp AS (SELECT DISTINCT i.target AS id, g.path, g.start, g.\"end\" FROM inn i JOIN f g ON g.id = i.source), ins AS (SELECT DISTINCT own.id, occ.path, occ.line, occ.n FROM own JOIN sp USING (id) JOIN occ ON occ.name = own.name AND occ.path = sp.path AND occ.line BETWEEN sp.start AND sp.\"end\"), fst AS (SELECT own.id, own.path, min(occ.line) AS line FROM own JOIN occ ON occ.name = own.name AND occ.path = own.path AND occ.line BETWEEN own.start AND own.\"end\" GROUP BY 1, 2), ex AS (SELECT id, sum(n) AS n FROM (SELECT id, n FROM ins UNION ALL SELECT id, 1 FROM fst WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.id = fst.id AND ins.path = fst.path AND ins.line = fst.line)) GROUP BY 1), tot AS (SELECT name, sum(n) AS n FROM occ GROUP BY 1) SELECT own.id, CASE WHEN own.name <> 'no-name' THEN CAST(coalesce(tot.n, 0) - coalesce(ex.n, 0) AS BIGINT) END AS elsewhere FROM own LEFT JOIN tot USING (name) LEFT JOIN ex USING (id)",
        "unused_statuses": f"{rec} {STATUS} SELECT id, status FROM st",
        "unused_report": f"{rec} {STATUS}, un AS (SELECT id FROM st WHERE status = 'unused'), k AS (SELECT DISTINCT source AS x, target AS y FROM inn WHERE source IN (SELECT id FROM un) AND target IN (SELECT id FROM un)), bt AS (SELECT x, y FROM k UNION SELECT y, x FROM k), weak AS (SELECT id, id AS reached FROM un UNION SELECT weak.id, bt.y FROM weak JOIN bt ON bt.x = weak.reached), fw AS (SELECT id, id AS reached FROM un UNION SELECT fw.id, k.y FROM fw JOIN k ON k.x = fw.reached), lv AS (SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 40 = 0 THEN 0 WHEN p_partkey % 9 = 0 THEN 1 ELSE 2 END AS level FROM part) SELECT id, \"group\", entry, ['low', 'medium', 'high'][level + 1] AS confidence FROM (SELECT id, min(reached) AS \"group\" FROM weak GROUP BY 1) JOIN (SELECT reached AS id, min(level) AS level FROM fw JOIN lv USING (id) GROUP BY 1) USING (id) JOIN found USING (id)",
        "decision_problems": f"{rec} {LEFT}, d AS ({DECISIONS}) SELECT id, 'not-a-candidate' AS problem FROM d WHERE id NOT IN (SELECT id FROM cand) UNION ALL SELECT id, 'repeated' FROM d WHERE kind = 'test-entry'",
        "filtered_rows": f"SELECT * FROM ({parts}) WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34') AND grp = 3 AND contains(lower(p_name || chr(10) || coalesce(kind, '')), 'a')",
        "unknown_rows": f"SELECT * FROM ({parts}) WHERE kind IS NULL",
        "sorted_page": f"SELECT path, lines, s_suppkey FROM ({FILES_SQL}) ORDER BY lines DESC NULLS LAST, s_suppkey LIMIT 30 OFFSET 90",
        "price_bins": f"WITH b(bin, low, high) AS (VALUES {bins}, (-1, NULL, NULL)), c AS (SELECT CASE WHEN o_totalprice < {EDGES_OF_PRICE[0]} OR o_totalprice > {EDGES_OF_PRICE[-1]} THEN -1 ELSE least({len(EDGES_OF_PRICE) - 2}, {' + '.join(f'(o_totalprice >= {e})::INT' for e in EDGES_OF_PRICE[1:])}) END AS bin, count(*) AS n FROM orders GROUP BY 1) SELECT b.bin, b.low::DOUBLE AS low, b.high::DOUBLE AS high, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)",
        "score_shares": f"SELECT path, CASE WHEN lines IS NOT NULL THEN greatest(0.0, least(100.0, lines / (max(lines) OVER ()) * 100)) END::DOUBLE AS share FROM ({FILES_SQL})",
        "priority_bars": f"WITH n(place, label) AS (VALUES {names}) SELECT place, label, value FROM n LEFT JOIN (SELECT o_orderpriority AS label, count(*) AS value FROM orders GROUP BY 1) USING (label)",
        "diff_layer_counts": "WITH l AS (SELECT o_orderpriority AS layer, o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 > 0 THEN o_custkey END AS path, CASE WHEN o_orderstatus = 'F' THEN 'changed' ELSE 'affected' END AS state FROM orders), p AS (SELECT DISTINCT layer, path FROM l JOIN n USING (id) WHERE path IS NOT NULL), x AS (SELECT DISTINCT id, state, layer FROM n JOIN l USING (id) UNION SELECT id, state, layer FROM n JOIN p USING (path) WHERE id NOT IN (SELECT id FROM l)) SELECT layer, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'affected') AS affected FROM x GROUP BY 1",
        "checked_units": f"WITH {CHECKED} SELECT * FROM un",
        "check_totals": f"WITH {CHECKED} SELECT (SELECT count(*) FROM fc WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.unit = fc.unit AND ev.file = fc.file AND ev.line = fc.line)) AS unmatched, (SELECT count(*) FROM ck) - (SELECT count(*) FROM fc) AS duplicates",
        "units_by_verdict": f"WITH {CHECKED} SELECT unit FROM un WHERE \"not\" > 0 OR unchecked > 0",
        "selection_ledger": "SELECT count(*) AS candidates, count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0) AS selected, count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 = 0) AS filtered_by_defaults, count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 5 = 0) AS filtered_by_ignore, count(*) FILTER (doc_id % 11 = 0) AS sensitive, count(*) - count(DISTINCT doc_id) AS repeated, true AS adds_up FROM documents",
        "operation_counts": "SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS \"view\", count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'none') AS \"none\" FROM events",
        "cross_region_pairs": f"WITH p AS (SELECT DISTINCT path, commit FROM ({CHANGES_SQL})), ok AS (SELECT commit FROM p GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30), q AS (SELECT * FROM p WHERE commit IN (SELECT commit FROM ok)) SELECT a.path AS a, b.path AS b, count(*) AS commits FROM q a JOIN q b ON a.commit = b.commit AND a.path < b.path WHERE string_split(a.path, '/')[1] <> string_split(b.path, '/')[1] GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY commits DESC, a, b LIMIT 25",
        "comments_and_strings": f"WITH {cut} SELECT doc_id, coalesce(array_to_string(comments, '|'), '') AS comments, coalesce(array_to_string(strings, '|'), '') AS strings FROM c4",
        "chunk_words": f"WITH {cut} SELECT doc_id, CAST(1 + coalesce(list_sum({words.format(x='comments')}), 0) + coalesce(list_sum({words.format(x='strings')}), 0) AS INTEGER) AS words FROM c4",
        "declaration_types": "SELECT p_partkey, ['table', 'schema', 'pipeline', 'endpoint', 'config', 'concept'][p_size % 6 + 1] AS type FROM part",
        "tour_entries": f"WITH {TOUR} SELECT * FROM en WHERE reasons <> ''",
        "tour_starts": f"WITH {TOUR} SELECT * FROM st",
        "tour_walks": f"{rec} {WALKS} SELECT * FROM ws",
        "tour_reading_list": f"{rec} {WALKS} SELECT path, member, depth, step FROM ws QUALIFY row_number() OVER (PARTITION BY path ORDER BY step, member, depth) = 1 ORDER BY step, member LIMIT 60",
        "tour_hubs": f"WITH {TOUR} SELECT path, CAST(row_number() OVER (ORDER BY fan_in DESC, path) AS INTEGER) AS rank, fan_in AS value FROM fa WHERE fan_in > 0 ORDER BY rank LIMIT 20",
        "tour_layers": f"WITH {TOUR} SELECT path, CAST(row_number() OVER (PARTITION BY layer ORDER BY fan_in DESC, path) AS INTEGER) AS rank, fan_in AS value, layer FROM fa WHERE fan_in + fan_out > 0 QUALIFY rank <= 5",
        "tested_files": f"WITH {TESTED} SELECT * FROM al",
        "tested_totals": f"WITH {TESTED} SELECT (SELECT count(*) FROM ad) AS added, (SELECT count(*) FROM lineitem JOIN tf x ON x.k = l_suppkey JOIN tf y ON y.k = l_partkey % 100 + 1 WHERE l_quantity = 7 AND l_returnflag <> 'R') - (SELECT count(*) FROM kp) AS dropped, (SELECT count(DISTINCT source) FROM al) AS tested, (SELECT count(*) FROM kp WHERE origin = 'swapped') AS swapped",
        "node_ids": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'file:' || p_name WHEN 1 THEN 'file:' || p_name WHEN 2 THEN 'function:' || p_brand || ':f' WHEN 3 THEN 'function:' || CASE WHEN p_partkey % 9 > 0 THEN p_type ELSE '__nofilepath__' END || ':' || p_name WHEN 4 THEN 'table:' || p_name ELSE CASE WHEN p_partkey % 4 = 1 THEN 'file:' || p_brand ELSE 'class:' || CASE WHEN p_partkey % 9 > 0 THEN p_type ELSE '__nofilepath__' END || ':' || p_name END END AS id FROM part",
        "whole_file_nodes": WHOLE,
        "recovered_imports": f"WITH w AS ({WHOLE}), g AS (SELECT DISTINCT a.id AS source, b.id AS target FROM lineitem JOIN w a ON a.path = 'q' || l_partkey JOIN w b ON b.path = 'q' || l_suppkey WHERE a.id <> b.id) SELECT source, target, 'imports' AS type, 0.7::DOUBLE AS weight FROM g WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'A' AND g.source = 'file:q' || l_partkey AND g.target = 'file:q' || l_suppkey)",
    }
