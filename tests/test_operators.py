"""Operators on literal rows: traversal reasons, null rules, resolution, order."""

import random

from pyspark.sql import functions as F

from corvane.functions import paths, text
from corvane.operators import changes, facts, graph, history, resolve, retrieval

CHAIN = [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("a", "x", "related")]


def edges(spark, rows=CHAIN):
    return spark.createDataFrame(rows, "source string, target string, type string")


def test_traversal_reasons(spark):
    e = edges(spark)
    reason = lambda *a, **k: graph.traverse(e, *a, **k)[2]["reason"]
    assert reason(["a"], 4) == "exhausted"
    assert reason(["a"], 2) == "max-hops"
    assert reason(["a"], 6, targets=["d"]) == "found"
    assert reason(["a"], 6, targets=["x"]) == "unreachable"
    assert reason(["a"], 6, budgets={"max_edges": 1}) == "edge-budget"
    assert reason(["a"], 6, budgets={"max_nodes": 2}) == "node-budget"
    assert reason(["a", "b"], 6, budgets={"max_seeds": 1}) == "seed-budget"
    nodes, kept, boundary = graph.traverse(e, ["a"], 4)
    assert nodes == ["a", "b", "c", "d"] and len(kept) == 3 and boundary["hops"] == 3


def test_shortest_path(spark):
    rows = graph.shortest_path(edges(spark, [*CHAIN, ("a", "c", "calls")]), ["a"], ["d"]).orderBy("pos").collect()
    assert [r["node"] for r in rows] == ["a", "c", "d"]
    assert graph.shortest_path(edges(spark), ["a"], ["zz"]).count() == 0


def test_components_against_search(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]
    e = spark.createDataFrame(pairs, "source long, target long")
    n = spark.range(40).withColumnRenamed("id", "node")
    ahead = {i: {b for a, b in pairs if a == i} for i in range(40)}

    def reach(start, step):
        seen, todo = {start}, [start]
        while todo:
            for m in step[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    both = {i: ahead[i] | {a for a, b in pairs if b == i} for i in range(40)}
    forward = {i: reach(i, ahead) for i in range(40)}
    assert dict(map(tuple, graph.weak_components(n, e).collect())) == {i: min(reach(i, both)) for i in range(40)}
    assert dict(map(tuple, graph.strong_components(n, e).collect())) == {i: min(j for j in forward[i] if i in forward[j]) for i in range(40)}


def test_file_rows_keep_unknown(spark):
    files = spark.createDataFrame([("a/x", 10, True), ("a/y", None, True), ("b/z", 5, False), ("c", 7, True)], "path string, lines long, covered boolean")
    rows = [("a/x", 1, "p", 3, 1), ("a/x", 2, "q", None, None), ("a/y", 1, "p", 4, 0)]
    ch = spark.createDataFrame(rows, "path string, commit long, author string, added long, removed long").withColumn("changed_at", F.lit("2020-01-01").cast("timestamp"))
    got = {r["path"]: r for r in history.file_rows(files, ch).collect()}
    assert (got["a/x"]["commits"], got["a/x"]["added"], got["a/x"]["score"]) == (2, None, 20)
    assert got["a/y"]["score"] is None and got["a/y"]["added"] == 4
    assert got["b/z"]["commits"] is None and got["b/z"]["last_changed"] is None
    assert (got["c"]["commits"], got["c"]["added"], got["c"]["score"]) == (0, 0, 0)
    dirs = {r["path"]: r for r in history.directory_rows(files, ch).collect()}
    assert (dirs["."]["files"], dirs["."]["commits"], dirs["."]["added"]) == (4, 2, 4)
    assert dirs["b"]["commits"] is None and dirs["b"]["added"] is None


def test_fusion_prefers_exact(spark):
    rows = [("exact", None, "c1", None, None, None), ("bm25", None, "c2", None, None, 30.0), ("bm25", None, "c1", None, None, 2.0), ("source-search", "n", None, "p", None, None)]
    got = retrieval.merge_candidates(spark.createDataFrame(rows, "source string, node_id string, chunk_id string, path string, symbol string, score double")).orderBy(F.desc("score")).collect()
    assert [(r["key"], r["score"], r["sources"]) for r in got] == [("chunk:c1", 1002.0, "bm25,exact"), ("node:n", 50.0, "source-search"), ("chunk:c2", 30.0, "bm25")]


def test_bm25_ties_and_misses(spark):
    chunks = spark.createDataFrame([(f"c{i:02d}", "readFile value") for i in range(25)], "chunk_id string, text string")
    p, s = retrieval.postings(chunks), retrieval.chunk_stats(chunks)
    assert [r["chunk_id"] for r in retrieval.bm25(p, s, ["ReadFile"], 20).collect()] == [f"c{i:02d}" for i in range(20)]
    assert retrieval.bm25(p, s, ["constructor"]).count() == 0


def test_index_update_is_rebuild(spark):
    now = spark.createDataFrame([("a", "one two"), ("b", "two three"), ("c", "four")], "chunk_id string, text string")
    old = spark.createDataFrame([("a", "one two"), ("b", "old words"), ("d", "gone")], "chunk_id string, text string")
    touched = spark.createDataFrame([("b",), ("c",), ("d",)], "chunk_id string")
    got = retrieval.update_index(retrieval.postings(old), now, touched)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.postings(now).collect()))


def test_digest_ignores_order(spark):
    rows = spark.createDataFrame([(f"p{i}", str(i * 7)) for i in range(300)], "path string, content_hash string")
    one, other = changes.digest(rows.repartition(1), "path", "content_hash").first(), changes.digest(rows.repartition(7), "path", "content_hash").first()
    assert one == other and one["entries"] == 300


def test_strings(spark):
    row = spark.range(1).select(
        text.split_identifier(F.lit("parseHTTPResponse_v2 Größe")).alias("words"), text.simple_type_name(F.lit("java.util.Map<String, List<Foo>>[]")).alias("type"),
        paths.normalize_path(F.lit(".\\a\\\\b//c"), F.lit("m")).alias("path"), text.format_route(F.lit("post"), F.lit("/a/"), F.lit("b/")).alias("route"),
        text.headings(F.lit("# A\ntext\n## B c")).alias("heads"), text.wikilinks(F.lit("x [[t|d]] [[u]]")).alias("links"), text.frontmatter(F.lit("---\na: 1\nb-c: x y\n---\nrest")).alias("front"),
        text.normalize_complexity(F.lit("0.5")).alias("low"), text.normalize_complexity(F.lit("0.5"), "moderate").alias("low_twin"), text.check_display_name(F.lit("one")).alias("name"),
        paths.is_entry_name(F.lit("src/index.ts")).alias("entry"), paths.is_test_path(F.lit("a/foo_test.go")).alias("test"),
    ).first()
    assert row["words"] == ["parse", "http", "response", "v2", "gr", "e"]
    assert (row["type"], row["path"], row["route"]) == ("Map", "m/a/b/c", "POST /a/b")
    assert [tuple(h) for h in row["heads"]] == [(1, "A"), (2, "B c")] and [tuple(x) for x in row["links"]] == [("t", "d"), ("u", None)]
    assert row["front"] == {"a": "1", "b-c": "x y"} and (row["low"], row["low_twin"], row["name"]) == ("simple", "moderate", "word-count")
    assert row["entry"] and row["test"]


def test_resolution(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",), ("lib/a.ts",)], "path string")
    got = resolve.probe(spark.createDataFrame([(1, "src/a"), (2, "src/b"), (3, "src/c")], "ref int, base string"), files, [".ts"], ["index.ts"])
    assert dict(map(tuple, got.collect())) == {1: "src/a.ts", 2: "src/b/index.ts"}
    alias = resolve.match_alias(spark.createDataFrame([("@app/x/y",), ("other",)], "specifier string"), spark.createDataFrame([("@app/*", "src/*"), ("*", "any/*")], "pattern string, replacement string"))
    assert dict(map(tuple, alias.collect())) == {"@app/x/y": "src/x/y", "other": "any/other"}
    bindings = spark.createDataFrame([("m", "X", "n", "X"), ("n", "X", "o", "Y"), ("p", "Z", "q", "Z"), ("q", "Z", "p", "Z"), ("r", "E", "ext", "E")], "path string, name string, from_path string, from_name string")
    found = {(r["path"], r["name"]): r["outcome"] for r in resolve.follow_bindings(bindings, spark.createDataFrame([("o", "Y")], "path string, name string")).collect()}
    assert found == {("m", "X"): "declared", ("n", "X"): "declared", ("p", "Z"): "cyclic", ("q", "Z"): "cyclic", ("r", "E"): "external"}
    m = resolve.mentions(spark.createDataFrame([("f", "com.a.Foo.bar"), ("f", "com.b"), ("g", "com.c.Two")], "file string, token string"), spark.createDataFrame([("com.a.Foo", "1"), ("com.c.Two", "2"), ("com.c.Two", "3")], "name string, id string"))
    assert sorted((r["token"], r["outcome"], r["target"]) for r in m.collect()) == [("com.a.Foo.bar", "resolved", "1"), ("com.b", "unresolved", None), ("com.c.Two", "ambiguous", None)]


def test_overlap_takes_file_node_without_a_hit(spark):
    steps = spark.createDataFrame([(1, "p", 5, 200), (2, "p", 300, 310)], "step int, path string, start int, end int")
    nodes = spark.createDataFrame([("x", "p", 1, 10), ("y", "p", 190, 260), ("z", "q", 1, 9)], "id string, path string, start int, end int")
    assert sorted(map(tuple, facts.overlap_join(steps, nodes).collect())) == [(1, "x"), (1, "y"), (2, "file:p")]
