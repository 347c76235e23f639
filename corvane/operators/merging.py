"""Rules of merging analysed batches: node ids, tested_by edges, imports that the batches lost.

``nodes`` has (id, type, name, path), ``edges`` (source, target, type, weight, position).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corvane.functions.paths import base_name
from corvane.operators.changes import first_by

# Prefixes of node ids, types whose prefix differs, and types of nodes that stand for a whole file.
PREFIXES = ["file", "func", "function", "class", "module", "concept", "config", "document", "service", "table", "endpoint", "pipeline", "schema", "resource", "domain", "flow", "step", "article", "entity", "topic", "claim", "source"]
WHOLE_FILE = ["file", "config", "document", "service", "pipeline", "schema", "resource"]
# How test files are called, by extension: prefixes and suffixes of the stem, in the order they are tried.
SCRIPT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue"]
TEST_NAMES = {".go": ([], ["_test"]), ".py": (["test_"], ["_test"]), ".java": ([], ["Tests", "Test", "IT"]), ".kt": ([], ["Tests", "Test"]), ".scala": ([], ["Spec", "Suite", "Tests", "Test"]), ".cs": ([], ["Tests", "Test"]), ".c": (["test_"], ["_test"]), ".cpp": (["test_"], ["_test"]), ".cc": (["test_"], ["_test"])} | {e: ([], [".test", ".spec"]) for e in SCRIPT_EXTENSIONS}
# Directories that set tests apart, and the roots that they mirror.
TEST_DIRS = {".py": ["tests", "test"]} | {e: ["__tests__", "test", "spec", "tests"] for e in SCRIPT_EXTENSIONS}
MIRROR_DIRS = {".py": ["tests", "test"]} | {e: ["tests", "test", "__tests__"] for e in SCRIPT_EXTENSIONS}
MIRRORED = ["src", "app", "lib", ""]
RECOVERED_WEIGHT = 0.7


def normalize_node_id(node_id: Column, kind: Column, path: Column, name: Column) -> Column:
    """An id with one known prefix: doubled prefixes and a project's name before one go, func becomes function, and bare ids get the prefix of their type, functions and classes with their file."""
    known = "|".join(PREFIXES)
    once = F.regexp_replace(node_id, f"^({known}):\\1:", "$1:")
    plain = F.when(~F.split(once, ":")[0].isin(*PREFIXES), F.regexp_replace(once, f"^[^:]+:({known}):(?=.)", "$1:")).otherwise(once)
    named = F.regexp_replace(plain, "^func:", "function:")
    prefix = F.when(kind == "func", "function").when(kind.isin(*PREFIXES), kind).otherwise("file")
    label = F.coalesce(name, named)
    scoped = F.when(F.coalesce(path, F.lit("")) != "", F.concat(prefix, F.lit(":"), path, F.lit(":"), label)).otherwise(F.concat(prefix, F.lit(":__nofilepath__:"), label))
    bare = F.when(kind.isin("function", "class"), scoped).otherwise(F.concat(prefix, F.lit(":"), named))
    return F.when(named.rlike(f"^({known}):"), named).otherwise(bare)


def is_test_name(path: Column) -> Column:
    """Whether the file's name, whatever its directory, is that of a test."""
    hit = F.lit(False)
    for ext, (heads, tails) in TEST_NAMES.items():
        end = ext.replace(".", r"\.")
        for pattern in [f"^{h}.*{end}$" for h in heads] + [t.replace(".", r"\.") + end + "$" for t in tails]:
            hit |= base_name(path).rlike(pattern)
    return hit


def _directories(ext: str, dirs: list[str]) -> Iterator[list[str]]:
    """The directories in which the tested file may lie, likeliest first."""
    language = {".java": "java", ".kt": "kotlin"}.get(ext)
    if language and dirs[:3] == ["src", "test", language]:
        yield ["src", "main", *dirs[2:]]
    if ext == ".scala":
        at = next((i for i in range(len(dirs) - 2) if dirs[i : i + 3] == ["src", "test", "scala"]), None)
        if at is not None:
            yield [*dirs[: at + 1], "main", *dirs[at + 2 :]]
    yield dirs
    if dirs and dirs[-1] in TEST_DIRS.get(ext, ()):
        yield dirs[:-1]
    if dirs and dirs[0] in MIRROR_DIRS.get(ext, ()):
        yield from ([root, *dirs[1:]] if root else dirs[1:] for root in MIRRORED)
    if ext == ".cs":
        at = next((i for i in reversed(range(len(dirs))) if dirs[i].lower() in ("tests", "test")), None)
        if at is not None:
            yield dirs[:at]
            yield [*dirs[:at], "src", *dirs[at + 1 :]]
        for tail in (".Tests", ".Test"):
            if dirs and dirs[0].endswith(tail) and dirs[0] != tail:
                yield [dirs[0].removesuffix(tail), *dirs[1:]]
                break


def tested_paths(path: str) -> list[str]:
    """The files that a test may be of, likeliest first; none for a file that isn't a test."""
    *dirs, name = [s for s in path.split("/") if s] or [""]
    ext = next((e for e in TEST_NAMES if name.endswith(e)), "")
    heads, tails = TEST_NAMES.get(ext, ([], []))
    stem = name.removesuffix(ext) if ext else name
    base = next((stem.removeprefix(h) for h in heads if stem.startswith(h)), None)
    if base is None:
        base = next((stem.removesuffix(t) for t in tails if stem.endswith(t)), None)
    if base is None:
        return []
    ends = [ext, *SCRIPT_EXTENSIONS] if ext in SCRIPT_EXTENSIONS else [ext]
    return list(dict.fromkeys("/".join([*d, base + e]) for d in _directories(ext, dirs) for e in ends))


@F.pandas_udf(ArrayType(StringType()))
def _tested_paths(paths: pd.Series) -> pd.Series:
    return paths.map(tested_paths)


def link_tests(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tested_by edges (source, target, weight, origin) from the tested file to its test, and one row of counts.

    Edges between a file and a test are turned the right way, other tested_by edges go; of a pair's the heaviest, then the first
    stays. A test without one is linked with the first of its likely files that exists. Origin is kept, swapped or added.
    """
    files = nodes.where(F.col("id").startswith("file:")).select("id", F.coalesce(F.when(F.col("path") != "", F.col("path")), F.expr("substring(id, 6)")).alias("path")).withColumn("test", is_test_name(F.col("path")))
    kinds = files.select("id", "test")
    given = edges.where("type = 'tested_by'")
    ends = given.join(kinds.toDF("source", "st"), "source").join(kinds.toDF("target", "tt"), "target").where("st <> tt")
    turned = ends.select(F.when(F.col("st"), F.col("target")).otherwise(F.col("source")).alias("source"), F.when(F.col("st"), F.col("source")).otherwise(F.col("target")).alias("target"), "weight", "position", F.when(F.col("st"), "swapped").otherwise("kept").alias("origin"))
    kept = first_by(turned, ["source", "target"], F.desc_nulls_last(F.coalesce("weight", F.lit(0.0))), F.col("position")).drop("position")
    alone = files.where("test").join(kept.select(F.col("target").alias("id")).distinct(), "id", "left_anti")
    likely = alone.select(F.col("id").alias("target"), F.posexplode(_tested_paths("path")).alias("place", "path"))
    found = likely.join(files.where("not test").select(F.col("id").alias("source"), "path"), "path").groupBy("target").agg(F.min_by("source", "place").alias("source"))
    out = kept.unionByName(found.select("source", "target", F.lit(None).cast("double").alias("weight"), F.lit("added").alias("origin")))
    counts = out.agg(F.count_if(F.col("origin") == "added").alias("added"), F.count_if(F.col("origin") == "swapped").alias("swapped"), F.count_distinct("source").alias("tested"), F.count_if(F.col("origin") != "added").alias("kept")).crossJoin(given.agg(F.count("*").alias("given")))  # one row each
    return out, counts.select("added", (F.col("given") - F.col("kept")).alias("dropped"), "tested", "swapped")


def whole_file_nodes(nodes: DataFrame) -> DataFrame:
    """(path, id, choices): the node that stands for a file, whose id is its type and path: the file node if there is one, else the first by ``position``."""
    own = nodes.where(F.col("type").isin(*WHOLE_FILE) & (F.coalesce("path", F.lit("")) != "") & (F.col("id") == F.concat("type", F.lit(":"), "path")))
    return own.groupBy("path").agg(F.min_by("id", F.struct(F.when(F.col("type") == "file", 0).otherwise(1), "position")).alias("id"), F.count("*").alias("choices"))


def recover_imports(nodes: DataFrame, edges: DataFrame, import_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports (source, target, type, weight) of the map (path, target) that the edges lack, and one row: recovered, without_source (files), without_target (imports)."""
    index = whole_file_nodes(nodes).select("path", "id")
    given = import_map.where(F.coalesce("target", F.lit("")) != "")
    placed = given.join(index.toDF("path", "source_id"), "path", "left").join(index.toDF("target", "target_id"), "target", "left")
    both = placed.where("source_id is not null and target_id is not null and source_id <> target_id").select(F.col("source_id").alias("source"), F.col("target_id").alias("target")).distinct()
    new = both.join(edges.where("type = 'imports'").select("source", "target").distinct(), ["source", "target"], "left_anti")
    lost = placed.agg(F.count_distinct(F.when(F.col("source_id").isNull(), F.col("path"))).alias("without_source"), F.count_if(F.col("source_id").isNotNull() & F.col("target_id").isNull()).alias("without_target"))
    counts = new.agg(F.count("*").alias("recovered")).crossJoin(lost)  # one row each
    return new.select("source", "target", F.lit("imports").alias("type"), F.lit(RECOVERED_WEIGHT).alias("weight")), counts
