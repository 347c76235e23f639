"""Registered queries on readers, paths, names, texts and resolution rules, over strings built from the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import paths as P
from corvane.functions import text as T
from corvane.operators import changes as C
from corvane.operators import facts as K
from corvane.operators import graph as G
from corvane.operators import liveness as L
from corvane.operators import resolve as R
from corvane.operators import retrieval as V
from corvane.operators import tables as B
from corvane.plans.roles import FILES_SQL, supplier_paths, table
from corvane.sources import readers

_s = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
_cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])


def _pick(key, options):
    """One of the options by the key."""
    return F.element_at(F.array(*[F.lit(x) for x in options]), (key % len(options) + 1).cast("int"))


def _list(options) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in options) + "]"


def _choose(key: str, options) -> str:
    return f"{_list(options)}[{key} % {len(options)} + 1]"


NAMES = ["main.py", "a.py", "server.GO", "Index.ts", "b_test.go", "foo.test.ts", "Dockerfile", "key.pem", "x.tar.gz", "README.md", "app.rs", "Main.java", "T.unknown", "noext", "test_q.py", "KTests.cs"]
LANGUAGES = ["python", "python", "go", "typescript", "go", "typescript", "dockerfile", "unknown", "unknown", "markdown", "rust", "java", "unknown", "unknown", "python", "csharp"]
CATEGORIES = ["code", "code", "code", "code", "code", "code", "infra", "other", "other", "docs", "code", "code", "other", "other", "code", "code"]
ENTRY = ["1", "0", "0", "1", "0", "0", "0", "0", "0", "0", "1", "1", "0", "0", "0", "0"]
TESTS = ["0", "0", "0", "0", "1", "1", "0", "0", "0", "0", "0", "0", "0", "0", "1", "1"]
DIRS = ["src", "node_modules", "build", "lib/x", "docs"]
IGNORED = ["0", "1", "1", "0", "0"]


def named_files(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", _cat(_pick(F.floor(k / 16), DIRS), "/", _pick(k, NAMES)).alias("path"))


#: By language: a source with % for a key, and (what, name, line) of its declarations.
SOURCES = {
    "python": ("import os\nclass K%(object):\n    def m%(self):\n        return f%(self)\n\ndef f%(x):\n    return x", [("import", "os", 1), ("class", "K%", 2), ("function", "m%", 3), ("function", "f%", 6)]),
    "typescript": ("import x from './m%'\nexport interface I% {}\nfunction g%() {}", [("import", "./m%", 1), ("class", "I%", 2), ("function", "g%", 3)]),
    "go": ("package p\nimport \"a/b%\"\ntype T% struct {}\nfunc (t T%) Do%() {}", [("import", "a/b%", 2), ("class", "T%", 3), ("function", "Do%", 4)]),
    "java": ("package a;\nimport java.util.L%;\npublic class J% {\n  public int size%(int x) {\n  }\n}", [("import", "java.util.L%", 2), ("class", "J%", 3), ("function", "size%", 4)]),
    "rust": ("use a::b%;\nstruct S%;\nfn run%() {}", [("import", "a::b%", 1), ("class", "S%", 2), ("function", "run%", 3)]),
    "ruby": ("require 'lib%'\nclass R%\n  def go%\n  end\nend", [("import", "lib%", 1), ("class", "R%", 2), ("function", "go%", 3)]),
    "php": ("<?php\nuse A\\B%;\nclass P% {\n  function h%() {}\n}", [("import", "A\\B%", 2), ("class", "P%", 3), ("function", "h%", 4)]),
    "kotlin": ("import a.b%\nclass Q%\nfun s%() {}", [("import", "a.b%", 1), ("class", "Q%", 2), ("function", "s%", 3)]),
    "scala": ("import a.c%\nobject O%\ndef t%() = 1", [("import", "a.c%", 1), ("class", "O%", 2), ("function", "t%", 3)]),
    "swift": ("import F%\nstruct W%\nfunc u%() {}", [("import", "F%", 1), ("class", "W%", 2), ("function", "u%", 3)]),
    "sql": ("CREATE TABLE t% (a int REFERENCES z);\nCREATE FUNCTION f%() AS 1", [("class", "t%", 1), ("function", "f%", 2)]),
    "terraform": ("resource \"aws_x\" \"r%\" {}\noutput \"o%\" {}\nmodule \"m%\" {}", [("class", "r%", 1), ("function", "o%", 2), ("import", "m%", 3)]),
    "protobuf": ("import \"p%.proto\";\nmessage M% {}\n  rpc Call%(M) returns (M);", [("import", "p%.proto", 1), ("class", "M%", 2), ("function", "Call%", 3)]),
    "graphql": ("type G% {}\nquery q% {}", [("class", "G%", 1), ("function", "q%", 2)]),
    "makefile": ("include inc%\nall%: x", [("import", "inc%", 1), ("function", "all%", 2)]),
    "shell": ("source lib%.sh\nrun%() {\n}", [("import", "lib%.sh", 1), ("function", "run%", 2)]),
    "dockerfile": ("FROM base%\nCMD run%", [("import", "base%", 1), ("function", "run%", 2)]),
    "gherkin": ("Feature: Thing %\n  Given a %", [("class", "Thing %", 1), ("function", "a %", 2)]),
    "markdown": ("# Title %\n[x](link%)", [("class", "Title %", 1), ("import", "link%", 2)]),
    "yaml": ("key%:\n  inner: 1", [("class", "key%", 1)]),
    "toml": ("[table%]\na = 1", [("class", "table%", 1)]),
    "env": ("export VAR%=1\n# c", [("class", "VAR%", 1)]),
}


def structures(spark, sf):
    """Customers as source files of all languages in turn."""
    names = list(SOURCES)
    k = F.col("c_custkey")
    files = table(spark, sf, "customer").select(_s("c_custkey").alias("path"), _pick(k, names).alias("language"), F.replace(_pick(k, [SOURCES[n][0] for n in names]), F.lit("%"), _s("c_custkey")).alias("text"))
    return readers.extract_structure(files)


def declared(spark, sf):
    found = structures(spark, sf)
    part = lambda c, what, name, line: found.select("path", F.explode(c).alias("x")).select("path", F.lit(what).alias("what"), F.col(f"x.{name}").alias("name"), F.col(f"x.{line}").cast("int").alias("line"))
    return part("functions", "function", "name", "start").unionByName(part("classes", "class", "name", "start")).unionByName(part("imports", "import", "source", "line"))


def evidence_edges(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("type"), (F.col("l_suppkey") % 40).alias("source"), (F.col("l_partkey") % 60).alias("target"), _cat("f", _s(F.col("l_suppkey") % 3)).alias("file"), F.col("l_linenumber").alias("line"))


def articles(spark, sf):
    return supplier_paths(spark, sf).select(F.lower("path").alias("key"))


def links(spark, sf):
    k = F.col("s_suppkey")
    full = F.col("path")
    link = F.when(k % 5 == 0, full).when(k % 5 == 1, F.expr("substring(path, instr(path, '/') + 1)")).when(k % 5 == 2, F.substring_index("path", "/", -1)).when(k % 5 == 3, F.upper(full)).otherwise(_cat("none/", full))
    return supplier_paths(spark, sf).select("s_suppkey", "path", link.alias("link"))


LINKS = "SELECT s_suppkey, path, CASE s_suppkey % 5 WHEN 0 THEN path WHEN 1 THEN substring(path, strpos(path, '/') + 1) WHEN 2 THEN string_split(path, '/')[-1] WHEN 3 THEN upper(path) ELSE 'none/' || path END AS link FROM ({f})".format(f=FILES_SQL)


def marked(spark, sf):
    """Texts with front matter, headings and links."""
    k = _s("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", _cat("---\ntitle: T", k, "\nkind-x : y\n---\n\n# Head ", k, "\n> quote\nFirst line ", k, "\nsecond\n\n## Sub\nsee [[page", k, "|shown]] and [[ other ]]\n").alias("text"))


def bindings(spark, sf):
    """Each part's name comes from its half's, every ninth is declared, and some turn in a circle."""
    k = F.col("p_partkey")
    to = F.when(k % 50 == 3, k + 1).when(k % 50 == 4, k - 1).otherwise(F.floor(k / 2))
    rows = table(spark, sf, "part").where("p_partkey % 9 > 0").select(_cat("m", _s(k)).alias("path"), F.lit("X").alias("name"), _cat("m", _s(to)).alias("from_path"), F.lit("X").alias("from_name"))
    return rows, table(spark, sf, "part").where("p_partkey % 9 = 0").select(_cat("m", _s(k)).alias("path"), F.lit("X").alias("name"))


def signals(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "public").otherwise("private")
    maybe = lambda c, m: F.when(k % m > 0, c)
    have = dict(visibility=kind, elsewhere=maybe(F.when(n % 3 == 0, 1).otherwise(0), 5), annotations=maybe(F.when(n % 7 == 0, 1).otherwise(0), 6), owner_uses=F.when(n % 11 == 0, 2).otherwise(0), outside=F.when(n % 13 == 0, 1).otherwise(0), below=F.lit(0), static=(k % 2 == 0))
    return table(spark, sf, "part").select("p_partkey", G.own_confidence(L.confidence_signals(**have)).alias("confidence"))


def old_and_new(spark, sf):
    c = table(spark, sf, "customer").select(_cat("n", _s("c_custkey")).alias("id"), _cat("f", _s(F.col("c_nationkey"))).alias("path"))
    e = table(spark, sf, "orders").select(_cat("n", _s("o_custkey")).alias("source"), _cat("n", _s(F.col("o_custkey") % 97 + 1)).alias("target"), F.col("o_orderstatus").alias("type")).distinct()
    changed = spark.createDataFrame([(f"f{i}",) for i in (1, 4, 9)], "path string")
    new = table(spark, sf, "nation").where("n_nationkey in (1, 4)").select(_cat("new", _s("n_nationkey")).alias("id"), _cat("f", _s("n_nationkey")).alias("path"))
    return C.replace_files(c, e, new, new.select(F.col("id").alias("source"), F.lit("n2").alias("target"), F.lit("made").alias("type")), changed)


def queries() -> dict:
    part = lambda s, d: table(s, d, "part")
    k = lambda: F.col("p_partkey")
    return {
        "file_languages": lambda s, d: named_files(s, d).select("p_partkey", readers.language(F.col("path")).alias("language"), readers.category(readers.language(F.col("path"))).alias("category")),
        "entry_names": lambda s, d: named_files(s, d).where(P.is_entry_name(F.col("path"))).select("p_partkey", "path"),
        "test_names": lambda s, d: named_files(s, d).where(P.is_test_path(F.col("path"))).select("p_partkey", "path"),
        "selected_files": lambda s, d: named_files(s, d).select("p_partkey", readers.selection(F.col("path"), F.when(k() % 29 == 0, "-----BEGIN RSA PRIVATE KEY-----"), readers.ignore_filter(["node_modules/", "/build"])(F.col("path"))).alias("decision")),
        "declared_names": declared,
        "structure_statuses": lambda s, d: structures(s, d).select("path", "status", "total_lines", "non_empty_lines"),
        "binary_texts": lambda s, d: table(s, d, "documents").where(T.looks_binary(F.encode(F.concat(F.when(F.col("doc_id") % 7 == 0, F.lit("a\u0000b")).otherwise(""), F.coalesce("text", F.lit(""))), "UTF-8"))).select("doc_id"),
        "content_hashes": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash")),
        "derived_statuses": lambda s, d: part(s, d).select("p_partkey", K.derive_status(k() % 5 == 0, k() % 7 > 0, F.col("p_size") % 4).alias("status")),
        "scoped_files": lambda s, d: supplier_paths(s, d).where(P.in_scope(F.col("path"), F.lit("ASIA")) | P.in_scope(F.col("path"), F.lit("EUROPE/NATION"))).select("path"),
        "merged_evidence": lambda s, d: K.merge_evidence(evidence_edges(s, d)).select("type", "source", "target", F.array_join(F.transform("evidence", lambda x: F.concat(x["file"], F.lit(":"), x["line"])), ",").alias("evidence")),
        "chunk_ids": lambda s, d: V.unique_chunk_ids(part(s, d).select(_cat("c", _s("p_size")).alias("id"), "p_partkey"), "id", "p_partkey"),
        "supersets": lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("w"), F.collect_set(F.col("l_quantity").cast("int") % 8).alias("p")).where(C.is_superset(F.col("w"), F.col("p"))).select("l_orderkey"),
        "normal_paths": lambda s, d: part(s, d).select("p_partkey", P.normalize_path(_cat(_pick(k(), ["./", "/", "a\\\\b/", ""]), "x//", _s(k())), _pick(F.floor(k() / 4), ["", "/m/"])).alias("path")),
        "signatures": lambda s, d: part(s, d).select("p_partkey", T.normalize_signature(F.when(k() % 3 > 0, F.array(_cat("  a  : ", _s("p_size")), F.lit("b"))), F.when(k() % 2 == 0, _cat(" T <  ", _s("p_size"), "> "))).alias("signature")),
        "type_names": lambda s, d: part(s, d).select("p_partkey", T.simple_type_name(_cat(_pick(k(), ["java.util.Map<K, List<V>>", "a.B[]", "C", "x.y.Z<A<B<C>>> []"]), "")).alias("name")),
        "document_headings": lambda s, d: marked(s, d).select("s_suppkey", F.explode(T.headings(F.col("text"))).alias("h")).select("s_suppkey", "h.level", "h.title"),
        "front_matter": lambda s, d: marked(s, d).select("s_suppkey", F.explode(T.frontmatter(F.col("text")))),
        "page_links": lambda s, d: marked(s, d).select("s_suppkey", F.explode(T.wikilinks(F.col("text"))).alias("l")).select("s_suppkey", "l.target", "l.display"),
        "first_paragraphs": lambda s, d: marked(s, d).select("s_suppkey", T.first_paragraph(F.col("text")).alias("paragraph")),
        "display_names": lambda s, d: part(s, d).select("p_partkey", T.check_display_name(_pick(k(), ["", "one", "two words", "a b c d e f g h i", "two\nlines x", "x" * 30 + " " + "y" * 40])).alias("problem")),
        "merge_complexities": lambda s, d: part(s, d).select("p_partkey", T.merge_complexity(_pick(k(), [" Low", "HARD ", "trivial", "3", "complex", "medium"])).alias("complexity")),
        "xml_texts": lambda s, d: part(s, d).select("p_partkey", T.decode_xml(_cat(_pick(k(), ["&lt;&amp;lt;", "&#233;&#xE9;", "&nope; &", "plain"]), _s(k()))).alias("text")),
        "token_hits": lambda s, d: table(s, d, "documents").where(T.has_token(F.col("text"), F.lit("the"))).select("doc_id"),
        "java_packages": lambda s, d: part(s, d).select("p_partkey", T.java_package(_cat(_pick(k(), ["/* c */ package a.b", "// x\n@A package  c", "import z; package d", "package e . f"]), _s("p_size"), ";")).alias("package")),
        "import_lines": lambda s, d: part(s, d).select("p_partkey", T.import_line(F.array(F.struct(_cat("./p", _s(k() % 5)).alias("source"), F.lit(4).alias("line")), F.struct(F.lit("lib/util/").alias("source"), F.lit(9).alias("line"))), _pick(k(), ["src/p1.ts", "lib/util/x.ts", "q.ts", "src/p3.py"])).alias("line")),
        "usable_ranges": lambda s, d: part(s, d).where(T.usable_range(F.col("p_size") - 3, F.when(k() % 7 > 0, k() % 40))).select("p_partkey"),
        "architecture_actions": lambda s, d: part(s, d).select("p_partkey", T.architecture_action(F.when(k() % 9 > 0, k() % 8 > 0), F.when(k() % 7 > 0, "en"), k() % 5 > 0, F.when(k() % 3 > 0, _s(k() % 4)), F.lit("1")).alias("a")).select("p_partkey", "a.action", "a.status"),
        "own_confidences": signals,
        "mentions": lambda s, d: R.mentions(part(s, d).select(_cat("f", _s("p_size")).alias("file"), _cat("com.", F.col("p_brand"), ".T", _s(k() % 90), ".run").alias("token")), part(s, d).where("p_partkey % 3 = 0").select(_cat("com.", F.col("p_brand"), ".T", _s(k() % 90)).alias("name"), _s(k()).alias("id"))),
        "mention_conservation": lambda s, d: B.operation_counts(queries()["mentions"](s, d), "outcome", ["resolved", "ambiguous", "unresolved"]),
        "route_conservation": lambda s, d: B.operation_counts(part(s, d).select(F.when(F.col("p_size") % 3 == 0, "handler").when(F.col("p_size") % 3 == 1, "no-handler").otherwise("ambiguous").alias("outcome")), "outcome", ["handler", "no-handler", "ambiguous"]),
        "article_links": lambda s, d: R.resolve_links(links(s, d).select("link"), articles(s, d)),
        "aliased_imports": lambda s, d: R.match_alias(part(s, d).select(_cat(_pick(k(), ["@app/", "@app/ui/", "#", "lib/"]), _s("p_size")).alias("specifier")), s.createDataFrame([("@app/*", "src/*"), ("@app/ui/*", "ui/*.ts"), ("#*", "types/*/index")], "pattern string, replacement string")),
        "dotted_suffixes": lambda s, d: R.resolve_suffix(part(s, d).select(k().alias("ref"), _cat("com.", F.replace("p_brand", F.lit("#"), F.lit(".")), ".P", _s("p_size")).alias("name")).select("ref", R.dotted_to_suffix("name", ".java").alias("suffix")), part(s, d).where("p_partkey % 4 = 0").select(_cat(_pick(F.floor(k() / 4), ["src/", "gen/"]), "com/", F.replace("p_brand", F.lit("#"), F.lit("/")), "/P", _s("p_size"), ".java").alias("path")).distinct()),
        "followed_bindings": lambda s, d: R.follow_bindings(*bindings(s, d)),
        "replaced_nodes": lambda s, d: old_and_new(s, d)[0],
        "replaced_edges": lambda s, d: old_and_new(s, d)[1],
    }


def oracle_sql() -> dict[str, str]:
    files = f"SELECT p_partkey, {_choose('(p_partkey // 16)', DIRS)} || '/' || {_choose('p_partkey', NAMES)} AS path, {_choose('p_partkey', LANGUAGES)} AS language, {_choose('p_partkey', CATEGORIES)} AS category, {_choose('p_partkey', ENTRY)} AS entry, {_choose('p_partkey', TESTS)} AS test, {_choose('(p_partkey // 16)', IGNORED)} AS ignored, {_choose('p_partkey', NAMES)} AS name FROM part"
    decl = ", ".join(f"({i}, '{what}', '{name}', {line})" for i, (_, found) in enumerate(SOURCES.values()) for what, name, line in found)
    sources = ", ".join(f"({i}, {text.count(chr(10)) + 1}, {sum(1 for x in text.split(chr(10)) if x.strip())})" for i, (text, _) in enumerate(SOURCES.values()))
    mention = "WITH t AS (SELECT 'f' || p_size AS file, 'com.' || p_brand || '.T' || (p_partkey % 90) AS name FROM part), k AS (SELECT 'com.' || p_brand || '.T' || (p_partkey % 90) AS name, count(*) AS n, min(CAST(p_partkey AS VARCHAR)) AS id FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), m AS (SELECT file, t.name || '.run' AS token, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN id END AS target FROM t LEFT JOIN k USING (name))"
    suffix = "SELECT 'com/' || replace(p_brand, '#', '/') || '/P' || p_size || '.java' AS suffix, ['src/', 'gen/'][p_partkey // 4 % 2 + 1] || 'com/' || replace(p_brand, '#', '/') || '/P' || p_size || '.java' AS path FROM part WHERE p_partkey % 4 = 0"
    binding = "b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 3 THEN p_partkey + 1 WHEN p_partkey % 50 = 4 THEN p_partkey - 1 ELSE p_partkey // 2 END AS t FROM part WHERE p_partkey % 9 > 0)"
    customers = "SELECT 'n' || c_custkey AS id, 'f' || c_nationkey AS path FROM customer"
    changed = "('f1', 'f4', 'f9')"
    return {
        "file_languages": f"SELECT p_partkey, language, category FROM ({files})",
        "entry_names": f"SELECT p_partkey, path FROM ({files}) WHERE entry = '1'",
        "test_names": f"SELECT p_partkey, path FROM ({files}) WHERE test = '1'",
        "selected_files": f"SELECT p_partkey, CASE WHEN name = 'key.pem' THEN 'sensitive' WHEN p_partkey % 29 = 0 THEN 'private-key' WHEN name = 'x.tar.gz' THEN 'archive' WHEN ignored = '1' THEN 'ignored' ELSE 'selected' END AS decision FROM ({files})",
        "declared_names": f"WITH d(i, what, name, line) AS (VALUES {decl}) SELECT CAST(c_custkey AS VARCHAR) AS path, what, replace(name, '%', CAST(c_custkey AS VARCHAR)) AS name, line FROM customer JOIN d ON i = c_custkey % {len(SOURCES)}",
        "structure_statuses": f"WITH s(i, total_lines, non_empty_lines) AS (VALUES {sources}) SELECT CAST(c_custkey AS VARCHAR) AS path, 'parsed' AS status, total_lines, non_empty_lines FROM customer JOIN s ON i = c_custkey % {len(SOURCES)}",
        "binary_texts": "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR contains(substring(coalesce(text, ''), 1, 8192), chr(0))",
        "content_hashes": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents",
        "derived_statuses": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'no-extractor' WHEN p_partkey % 5 = 0 THEN 'parse-failed' WHEN p_size % 4 = 0 THEN 'zero-symbol' ELSE 'parsed' END AS status FROM part",
        "scoped_files": f"SELECT path FROM ({FILES_SQL}) WHERE starts_with(path, 'ASIA/') OR starts_with(path, 'EUROPE/NATION/')",
        "merged_evidence": "SELECT type, source, target, array_to_string(list_transform(list_sort(list_distinct(list({'f': file, 'l': line}))), lambda x: x.f || ':' || x.l), ',') AS evidence FROM (SELECT l_returnflag AS type, l_suppkey % 40 AS source, l_partkey % 60 AS target, 'f' || (l_suppkey % 3) AS file, l_linenumber AS line FROM lineitem) GROUP BY 1, 2, 3",
        "chunk_ids": "SELECT 'c' || p_size AS id, p_partkey, 'c' || p_size || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part)",
        "supersets": "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING list_has_all(list(l_linenumber), list(CAST(l_quantity AS INTEGER) % 8))",
        "normal_paths": "SELECT p_partkey, CASE WHEN p_partkey // 4 % 2 = 1 THEN 'm/' ELSE '' END || CASE WHEN p_partkey % 4 = 2 THEN 'a/b/' ELSE '' END || 'x/' || p_partkey AS path FROM part",
        "signatures": "SELECT p_partkey, '(' || CASE WHEN p_partkey % 3 > 0 THEN 'a : ' || p_size || ',b' ELSE '' END || ')' || CASE WHEN p_partkey % 2 = 0 THEN ':T < ' || p_size || '>' ELSE '' END AS signature FROM part",
        "type_names": f"SELECT p_partkey, {_choose('p_partkey', ['Map', 'B', 'C', 'Z'])} AS name FROM part",
        "document_headings": "SELECT s_suppkey, 1 AS level, 'Head ' || s_suppkey AS title FROM supplier UNION ALL SELECT s_suppkey, 2, 'Sub' FROM supplier",
        "front_matter": "SELECT s_suppkey, 'title' AS key, 'T' || s_suppkey AS value FROM supplier UNION ALL SELECT s_suppkey, 'kind-x', 'y' FROM supplier",
        "page_links": "SELECT s_suppkey, 'page' || s_suppkey AS target, 'shown' AS display FROM supplier UNION ALL SELECT s_suppkey, 'other', NULL FROM supplier",
        "first_paragraphs": "SELECT s_suppkey, 'First line ' || s_suppkey || ' second' AS paragraph FROM supplier",
        "display_names": "SELECT p_partkey, ['empty', 'word-count', NULL, 'word-count', 'multi-line', 'too-long'][p_partkey % 6 + 1] AS problem FROM part",
        "merge_complexities": "SELECT p_partkey, ['simple', 'complex', NULL, NULL, 'complex', 'moderate'][p_partkey % 6 + 1] AS complexity FROM part",
        "xml_texts": f"SELECT p_partkey, {_choose('p_partkey', ['<&lt;', 'éé', '&nope; &', 'plain'])} || p_partkey AS text FROM part",
        "token_hits": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\p{L}\p{N}])the($|[^\p{L}\p{N}])')",
        "java_packages": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a.b' || p_size WHEN 1 THEN 'c' || p_size WHEN 3 THEN 'e.f' || p_size END AS package FROM part",
        "import_lines": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 5 = 1 THEN 4 END WHEN 1 THEN 9 WHEN 3 THEN CASE WHEN p_partkey % 5 = 3 THEN 4 END END AS line FROM part",
        "usable_ranges": "SELECT p_partkey FROM part WHERE p_size - 3 >= 1 AND p_partkey % 7 > 0 AND p_partkey % 40 >= p_size - 3",
        "architecture_actions": "SELECT p_partkey, CASE WHEN status = 'fresh' THEN 'reuse' ELSE 'rebuild' END AS action, status FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'missing' WHEN p_partkey % 8 = 0 OR p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN 'noncanonical-language' WHEN p_partkey % 3 = 0 THEN 'missing' WHEN p_partkey % 4 = 1 THEN 'fresh' ELSE 'stale' END AS status FROM part)",
        "own_confidences": "SELECT p_partkey, CASE WHEN (p_partkey % 5 > 0 AND p_size % 3 = 0) OR p_size % 11 = 0 OR (p_partkey % 4 < 2 AND p_partkey % 2 = 1 AND p_size % 13 = 0) THEN 'low' WHEN p_partkey % 5 = 0 OR p_partkey % 4 < 2 OR p_partkey % 6 = 0 OR p_size % 7 = 0 OR p_size % 13 = 0 THEN 'medium' ELSE 'high' END AS confidence FROM part",
        "mentions": f"{mention} SELECT * FROM m",
        "mention_conservation": f"{mention} SELECT count(*) AS total, count(*) FILTER (outcome = 'resolved') AS resolved, count(*) FILTER (outcome = 'ambiguous') AS ambiguous, count(*) FILTER (outcome = 'unresolved') AS unresolved FROM m",
        "route_conservation": "SELECT count(*) AS total, count(*) FILTER (p_size % 3 = 0) AS handler, count(*) FILTER (p_size % 3 = 1) AS no_handler, count(*) FILTER (p_size % 3 = 2) AS ambiguous FROM part",
        "article_links": f"SELECT DISTINCT link, CASE WHEN s_suppkey % 5 < 4 THEN lower(path) END AS article FROM ({LINKS})",
        "aliased_imports": "SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN '@app/' WHEN 1 THEN '@app/ui/' ELSE '#' END || p_size AS specifier, CASE p_partkey % 4 WHEN 0 THEN 'src/' || p_size WHEN 1 THEN 'ui/' || p_size || '.ts' ELSE 'types/' || p_size || '/index' END AS target FROM part WHERE p_partkey % 4 < 3",
        "dotted_suffixes": f"WITH f AS (SELECT suffix, count(DISTINCT path) AS n, min(path) AS path FROM ({suffix}) GROUP BY 1) SELECT p_partkey AS ref, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN path END AS path FROM part LEFT JOIN f ON suffix = 'com/' || replace(p_brand, '#', '/') || '/P' || p_size || '.java'",
        "followed_bindings": f"WITH RECURSIVE {binding}, w AS (SELECT k AS o, t AS p, [t] AS seen, false AS again FROM b UNION ALL SELECT w.o, b.t, list_append(w.seen, b.t), list_contains(w.seen, b.t) FROM w JOIN b ON b.k = w.p WHERE NOT w.again) SELECT 'm' || o AS path, 'X' AS name, CASE WHEN again THEN 'cyclic' WHEN p % 9 = 0 AND p IN (SELECT p_partkey FROM part) THEN 'declared' ELSE 'external' END AS outcome, 'm' || p AS at FROM w WHERE again OR p NOT IN (SELECT k FROM b)",
        "replaced_nodes": f"SELECT id, path FROM ({customers}) WHERE path NOT IN {changed} UNION ALL SELECT 'new' || n_nationkey, 'f' || n_nationkey FROM nation WHERE n_nationkey IN (1, 4)",
        "replaced_edges": f"WITH g AS (SELECT id FROM ({customers}) WHERE path IN {changed}) SELECT DISTINCT source, target, type FROM (SELECT 'n' || o_custkey AS source, 'n' || (o_custkey % 97 + 1) AS target, o_orderstatus AS type FROM orders) WHERE source NOT IN (SELECT id FROM g) AND target NOT IN (SELECT id FROM g) UNION ALL SELECT 'new' || n_nationkey, 'n2', 'made' FROM nation WHERE n_nationkey IN (1, 4)",
    }
