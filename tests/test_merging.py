"""Merge rules on cases by hand."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import merging


@pytest.mark.parametrize(
    ("test", "first", "also"),
    [
        ("src/a/foo.test.ts", "src/a/foo.ts", ["src/a/foo.tsx"]),
        ("pkg/__tests__/x.spec.js", "pkg/__tests__/x.js", ["pkg/x.js", "pkg/x.ts"]),
        ("tests/u/foo.test.ts", "tests/u/foo.ts", ["src/u/foo.ts", "app/u/foo.ts", "u/foo.ts"]),
        ("a/b_test.go", "a/b.go", []),
        ("pkg/tests/test_bar.py", "pkg/tests/bar.py", ["pkg/bar.py"]),
        ("tests/foo/test_bar.py", "tests/foo/bar.py", ["src/foo/bar.py", "foo/bar.py"]),
        ("src/test/java/c/ATest.java", "src/main/java/c/A.java", ["src/test/java/c/A.java"]),
        ("m/core/src/test/scala/p/QSuite.scala", "m/core/src/main/scala/p/Q.scala", []),
        ("svc/tests/CartTests.cs", "svc/tests/Cart.cs", ["svc/Cart.cs", "svc/src/Cart.cs"]),
        ("My.App.Tests/x/FooTest.cs", "My.App.Tests/x/Foo.cs", ["My.App/x/Foo.cs"]),
        ("lib/test_q.cpp", "lib/q.cpp", []),
    ],
)
def test_tested_paths(test, first, also):
    found = merging.tested_paths(test)
    assert found[0] == first and all(p in found for p in also) and len(found) == len(set(found))


def test_no_test_has_no_candidates():
    assert merging.tested_paths("src/main.py") == merging.tested_paths("tests/helpers.ts") == merging.tested_paths("README") == []


def test_links(spark):
    paths = ["src/a.py", "src/test_a.py", "src/b.go", "src/b_test.go", "c.ts", "c.test.ts", "d.test.ts", "lone.py"]
    nodes = spark.createDataFrame([(f"file:{p}", "file", p, p) for p in paths] + [("function:src/a.py:f", "function", "f", "src/a.py")], "id string, type string, name string, path string")
    edge = lambda s, t, w, n: (f"file:{s}", f"file:{t}", "tested_by", w, n)
    edges = [edge("src/test_a.py", "src/a.py", 0.3, 1), edge("src/a.py", "src/test_a.py", 0.9, 2), edge("src/b_test.go", "src/b.go", 0.5, 3), edge("src/a.py", "src/b.go", 1.0, 4), edge("src/a.py", "nowhere", 1.0, 5), ("x", "y", "calls", 1.0, 6)]
    found, counts = merging.link_tests(nodes, spark.createDataFrame(edges, "source string, target string, type string, weight double, position int"))
    assert sorted((r["source"], r["target"], r["origin"]) for r in found.collect()) == [("file:c.ts", "file:c.test.ts", "added"), ("file:src/a.py", "file:src/test_a.py", "kept"), ("file:src/b.go", "file:src/b_test.go", "swapped")]
    assert counts.first().asDict() == {"added": 1, "dropped": 3, "tested": 3, "swapped": 1}


def test_ids(spark):
    rows = [("file:file:a.py", "file", "a.py", "a.py"), ("proj:file:a.py", "file", "a.py", "a.py"), ("func:a.py:f", "function", "f", "a.py"), ("a.py", "file", "a.py", "a.py"), ("f", "function", "f", "a.py"), ("g", "class", "g", None), ("docs", "odd", None, None), ("table:x", "table", "x", None), ("file:class:x", "class", "x", None)]
    df = spark.createDataFrame(rows, "id string, type string, name string, path string")
    got = [r[0] for r in df.select(merging.normalize_node_id(*[F.col(c) for c in ("id", "type", "path", "name")])).collect()]
    assert got == ["file:a.py", "file:a.py", "function:a.py:f", "file:a.py", "function:a.py:f", "class:__nofilepath__:g", "file:docs", "table:x", "file:class:x"]


def test_recovered_imports(spark):
    nodes = spark.createDataFrame([("document:a", "document", "a", "a", 1), ("file:a", "file", "a", "a", 2), ("config:b", "config", "b", "b", 3), ("file:c", "file", "c", "c", 4), ("table:b", "table", "b", "b", 5)], "id string, type string, name string, path string, position int")
    edges = spark.createDataFrame([("file:a", "file:c", "imports")], "source string, target string, type string")
    given = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a"), ("a", "z"), ("q", "a"), ("c", "a"), ("c", "a")], "path string, target string")
    new, counts = merging.recover_imports(nodes, edges, given)
    assert sorted((r["source"], r["target"]) for r in new.collect()) == [("file:a", "config:b"), ("file:c", "file:a")]
    assert counts.first().asDict() == {"recovered": 2, "without_source": 1, "without_target": 1}
    assert {r["path"]: (r["id"], r["choices"]) for r in merging.whole_file_nodes(nodes).collect()} == {"a": ("file:a", 2), "b": ("config:b", 1), "c": ("file:c", 1)}
