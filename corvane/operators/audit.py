"""Validation: repair, rules, integrity, verification, samples, quotes, entry points, domain ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.changes import first_by, severity
from corvane.session import ranked

# Other names of node types that a repair maps to the type.
TYPE_ALIASES = {"func": "function", "fn": "function", "method": "function", "interface": "class", "struct": "class", "mod": "module", "pkg": "module", "doc": "document", "docs": "document", "cfg": "config"}


def repair_nodes(nodes: DataFrame, types: Sequence[str], default: str = "concept") -> DataFrame:
    """Nodes with trimmed names, types in lower case mapped from aliases, unknown ones to a default, and weights clamped to 0..1; ``fixed`` says what changed."""
    low = F.lower(F.trim("type"))
    mapped = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv]), low), low)
    kind = F.when(mapped.isin(*types), mapped).otherwise(default)
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("weight", F.lit(0.5))))
    fixed = F.array_compact(F.array(F.when(~F.col("type").eqNullSafe(kind), F.lit("type")), F.when(~F.col("weight").eqNullSafe(weight), F.lit("weight")), F.when(~F.col("name").eqNullSafe(F.trim("name")), F.lit("name"))))
    return nodes.select("id", F.trim("name").alias("name"), kind.alias("type"), weight.alias("weight"), F.array_join(fixed, ",").alias("fixed"))


def issues(rows: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """(key, issue): one row for each rule that a row breaks, all rules in one scan."""
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))).alias("issue"))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(issue, n): duplicate ids, dangling sources and targets, self edges."""
    ids = nodes.select("id").distinct()
    parts = [
        ("duplicate-id", nodes.groupBy("id").count().where("count > 1")),
        ("dangling-source", edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")),
        ("dangling-target", edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti")),
        ("self-edge", edges.where("source = target")),
    ]
    out = None
    for name, bad in parts:
        row = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def drop_invalid(nodes: DataFrame, edges: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid nodes, and the edges between them that aren't loops, each once."""
    kept = nodes.where(valid)
    ids = kept.select("id").distinct()
    good = edges.where("source <> target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, good.dropDuplicates(["source", "target", "type"])


def verify_anchors(claims: DataFrame, lines: DataFrame, slack: int = 1) -> DataFrame:
    """Claims (id, path, line, token) against lines (path, line, text): verified if the token is on the line or next to it, contradicted if not, unverified without the file.

    The slack is exploded on the claims' side, so the join is on (path, line).
    """
    near = claims.select("id", "path", "token", F.explode(F.sequence(F.col("line") - slack, F.col("line") + slack)).alias("line"))
    hit = near.join(lines, ["path", "line"]).groupBy("id").agg(F.bool_or(F.contains("text", "token")).alias("ok"))
    known = lines.select("path").distinct().withColumn("known", F.lit(True))
    joined = claims.join(hit, "id", "left").join(known, "path", "left")
    return joined.select("id", F.when(F.col("ok"), "verified").when(F.col("known"), "contradicted").otherwise("unverified").alias("state"))


def sample_stride(rows: DataFrame, key: str, k: int) -> DataFrame:
    """k rows at equal strides of the order by key, whose values are distinct: the rows at floor(i n / k)."""
    placed = ranked(rows, key)
    n = placed.agg(F.count("*").alias("n")).first()["n"]
    wanted = sorted({i * n // min(k, n) for i in range(min(k, n))})
    return placed.where(F.col("__rank").isin(*wanted)).drop("__rank")


def batches(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """With ``batch``: groups of ``size`` rows of each value of ``by`` in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size))


def apply_verdicts(nodes: DataFrame, verdicts: DataFrame, valid: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes with the first valid verdict each, never lowering severity, and one row of counts: applied, invalid, unknown, duplicate."""
    good = verdicts.where(F.col("verdict").isin(*valid))
    known = good.join(nodes.select("id"), "id", "left_semi")
    first = first_by(known, ["id"], F.col("position")).select("id", "verdict")
    joined = nodes.join(first, "id", "left")
    state = F.when(F.col("verdict").isNull(), F.col("state")).when(severity(F.col("verdict")) >= F.coalesce(severity(F.col("state")), F.lit(-1)), F.col("verdict")).otherwise(F.col("state"))
    counts = verdicts.agg(F.count_if(~F.coalesce(F.col("verdict").isin(*valid), F.lit(False))).alias("invalid"), F.count("*").alias("all"))
    for name, df in (("unknown", good.join(nodes.select("id"), "id", "left_anti")), ("applied", first), ("known", known)):
        counts = counts.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    return joined.select("id", state.alias("state")), counts.select("applied", "invalid", "unknown", (F.col("known") - F.col("applied")).alias("duplicate"))


def check_quotes(units: DataFrame, documents: DataFrame) -> DataFrame:
    """(unit, state) of units (unit, doc, quote): missing-document, absent, repeated or once, by occurrences in the document."""
    joined = units.join(documents, "doc", "left")
    n = F.size(F.split("body", F.concat(F.lit("\\Q"), F.replace("quote", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))) - 1
    return joined.select("unit", F.when(F.col("body").isNull(), "missing-document").when(n == 0, "absent").when(n > 1, "repeated").otherwise("once").alias("state"))


def entry_points(lines: DataFrame, catalogue: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(path, line, kind, framework): one candidate for each line, by the first pattern (kind, framework, regex) of the catalogue in order."""
    hit = F.coalesce(*[F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(f).alias("framework"))) for k, f, p in catalogue])
    comment = F.trim("text").rlike(r"^(//|#|\*|/\*|--)")
    return lines.where(~comment).select("path", "line", hit.alias("h")).where("h is not null").select("path", "line", "h.kind", "h.framework")


def _islands(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, start, end): ranges of one key that overlap or touch, merged."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def shared_ranges(cited: DataFrame, most_features: int = 3, bin_size: int = 64) -> DataFrame:
    """(path, a, b, start, end) of cited ranges (feature, path, start, end) of two features that overlap, merged; files that over ``most_features`` features cite are left out.

    A feature's own ranges are merged first, so that those of one file and feature are apart. Ranges are dealt to
    bins, and a pair meets in the first bin that both have, so a file with very many ranges is split.
    """
    few = cited.groupBy("path").agg(F.count_distinct("feature").alias("n")).where(F.col("n").between(2, most_features)).select("path")
    c = _islands(cited.join(few, "path", "left_semi").select("path", "feature", "start", "end").distinct(), ["path", "feature"])
    binned = c.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))))
    x, y = (binned.select("path", "bin", F.col("feature").alias(n), F.col("start").alias(f"s{n}"), F.col("end").alias(f"e{n}")) for n in "ab")
    first = F.greatest(F.floor(F.col("sa") / bin_size), F.floor(F.col("sb") / bin_size))
    both = x.join(y, ["path", "bin"]).where("a < b and sa <= eb and sb <= ea").where(F.col("bin") == first).select("path", "a", "b", F.greatest("sa", "sb").alias("start"), F.least("ea", "eb").alias("end"))
    return _islands(both, ["path", "a", "b"])


def mismatches(members: DataFrame) -> DataFrame:
    """(name, left, right, only_left, only_right, both) of same-named value lists of two applications; ``members`` has (app, name, value)."""
    lists = members.groupBy("app", F.lower(F.replace("name", F.lit("_"), F.lit(""))).alias("name")).agg(F.array_sort(F.collect_set("value")).alias("values"))
    x, y = lists.select("name", F.col("app").alias("left"), F.col("values").alias("l")), lists.select("name", F.col("app").alias("right"), F.col("values").alias("r"))
    joined = x.join(y, "name").where("`left` < `right`")
    return joined.select("name", "left", "right", F.size(F.array_except("l", "r")).alias("only_left"), F.size(F.array_except("r", "l")).alias("only_right"), F.size(F.array_intersect("l", "r")).alias("both"))
