"""Text functions on cases by hand."""

from pyspark.sql import functions as F

from corvane.functions import text as T


def values(spark, f, *rows):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    return [r[0] for r in df.orderBy("i").select(f(*[F.col(c) for c in df.columns[1:]])).collect()]


def test_xml_references(spark):
    got = values(spark, T.decode_xml, "a &lt; b &amp;amp; &#233;&#xE9;&#x1F600; &nope; & &#0; &#xD800; &#99999999;", "", None, "&quot;&apos;&gt;")
    assert got == ["a < b &amp; éé😀 &nope; & � � �", "", None, "\"'>"]


def test_tokens(spark):
    assert values(spark, T.has_token, ("a foo.b", "foo"), ("foobar", "foo"), ("é1foo", "foo"), ("x foo_ y", "foo"), ("a\\Eb c", "\\E"), ("(a|b)", "a|b")) == [True, False, False, True, False, True]


def test_packages(spark):
    got = values(spark, T.java_package, "/* c * / */\n// x\n@Ann(\"q\") package a . b\n.c ;\nclass X {}", "class X { package a; }", "package a.b.c;", "// package a.b;\nimport x;", None)
    assert got == ["a.b.c", None, "a.b.c", None, None]


def test_first_paragraphs(spark):
    got = values(spark, T.first_paragraph, "---\na: 1\n---\n# Title\n\n> quote\nOne line\ngoes on\n---\nhere\n\nTwo", "# Only", "plain\n# Next\nmore", "")
    assert got == ["One line goes on here", "", "plain", ""]


def test_import_lines(spark):
    df = spark.createDataFrame([([("./b", 3), ("x/util/", 5), ("b", 2)], "src/b.ts"), ([("./q", 3), ("x/util", 5)], "src/util/index.ts"), ([("./q", 3)], "src/z.ts"), ([("./q", 3), ("./r", 4)], "src/z.ts"), ([], "z")], "imports array<struct<source string, line int>>, target string")
    assert [r[0] for r in df.select(T.import_line(F.col("imports"), F.col("target"))).collect()] == [2, 5, 3, None, None]


def test_architecture(spark):
    rows = [(None, None, None, None, "d"), (True, "de", True, "d", "d"), (True, "en", True, None, "d"), (True, "en", True, "d", "d"), (True, "en", True, "e", "d"), (False, "en", True, "d", "d")]
    df = spark.createDataFrame(rows, "v boolean, l string, a boolean, d string, c string")
    got = [tuple(r[0]) for r in df.select(T.architecture_action(*[F.col(c) for c in df.columns])).collect()]
    assert got == [("rebuild", "missing"), ("rebuild", "noncanonical-language"), ("rebuild", "missing"), ("reuse", "fresh"), ("rebuild", "stale"), ("rebuild", "noncanonical-language")]
