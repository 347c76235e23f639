"""Unused functions: what no root reaches, where its names still occur, and the report after decisions.

``functions`` has (id, name, path, start, end), ``edges`` (source, target, type). A reference goes from the function
that refers to the one that is referred to: along a call, and along implements and overrides in either
direction. Roots are the targets of routes and invokes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import graph as G
from corvane.session import checkpointed

# Edge types of roots, and of references by whether they hold in reverse too.
ROOTS = ["routes", "invokes"]
REFERENCES = {"calls": False, "implements": True, "overrides": True}
LEVELS = ["low", "medium", "high"]
IDENTIFIER = "[A-Za-z_$][A-Za-z0-9_$]*"


def references(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, edge, reverse), each once, between functions."""
    ids = functions.select("id").distinct()
    own = edges.where(F.col("type").isin(*REFERENCES)).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    ahead = own.select("source", "target", F.col("type").alias("edge"), F.lit(False).alias("reverse"))
    both = [k for k, reverse in REFERENCES.items() if reverse]
    back = own.where(F.col("type").isin(*both)).select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("type").alias("edge"), F.lit(True).alias("reverse"))
    return ahead.unionByName(back).distinct()


def roots(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) of the functions that routes and invokes lead to."""
    return edges.where(F.col("type").isin(*ROOTS)).select(F.col("target").alias("node")).distinct().join(functions.select(F.col("id").alias("node")), "node", "left_semi")


def root_counts(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (routes, invokes): distinct functions that either kind leads to; one of both kinds counts in both."""
    hit = edges.where(F.col("type").isin(*ROOTS)).join(functions.select(F.col("id").alias("target")), "target", "left_semi")
    return hit.agg(*[F.count_distinct(F.when(F.col("type") == k, F.col("target"))).alias(k) for k in ROOTS])


def candidates(functions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, component, entry) of the functions that no root reaches, and the references (source, target, edge, reverse) among them.

    A component is strongly connected and named by its least id; it is an entry if nothing outside refers into it.
    """
    refs = checkpointed(references(functions, edges))
    live = G.reachable(refs, roots(functions, edges))
    left = checkpointed(functions.select(F.col("id").alias("node")).distinct().join(live, "node", "left_anti"))
    inner = checkpointed(refs.join(left.withColumnRenamed("node", "source"), "source", "left_semi").join(left.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target", "edge", "reverse"))
    component = checkpointed(G.strong_components(left, inner))
    ends = inner.select("source", "target").join(component.toDF("source", "a"), "source").join(component.toDF("target", "b"), "target")
    entered = ends.where("a <> b").select(F.col("b").alias("component"), F.lit(True).alias("entered")).distinct()
    found = component.join(entered, "component", "left").select(F.col("node").alias("id"), "component", F.col("entered").isNull().alias("entry"))
    return checkpointed(found), inner


def candidate_totals(functions: DataFrame, found: DataFrame, inner: DataFrame) -> DataFrame:
    """One row: functions, reachable, candidates, entry_components and clusters (weakly connected), and whether the first is the sum of the next two."""
    nodes = found.select(F.col("id").alias("node"))
    clusters = G.weak_components(nodes, inner).agg(F.count_distinct("component").alias("clusters"))
    n = functions.agg(F.count_distinct("id").alias("functions"))
    c = found.agg(F.count("*").alias("candidates"), F.count_distinct(F.when(F.col("entry"), F.col("component"))).alias("entry_components"))
    return n.crossJoin(c).crossJoin(clusters).select("functions", (F.col("functions") - F.col("candidates")).alias("reachable"), "candidates", "entry_components", "clusters")  # one row each


def occurrences(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, path, line, n): whole-token occurrences of the names in texts (path, text), by line from 1."""
    lines = texts.where("text is not null").select("path", F.posexplode(F.split("text", "\n")).alias("at", "line_text"))
    tokens = lines.select("path", (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all("line_text", F.lit(IDENTIFIER), 0)).alias("name"))
    wanted = checkpointed(names.select("name").distinct())
    wanted = F.broadcast(wanted) if wanted.count() < G.FEW_NODES else wanted  # few by the count; then other tokens aren't shuffled
    return tokens.join(wanted, "name", "left_semi").groupBy("name", "path", "line").agg(F.count("*").alias("n"))


def census(found: DataFrame, functions: DataFrame, inner: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, elsewhere): how often the name of a candidate occurs outside what explains it; null for a name that is no identifier.

    Explained are occurrences within the lines of a direct referrer, itself included, in that one's file, and one on the
    candidate's own declaration line, the first of its lines with the name. Occurrences are counted by line before
    they meet candidates, and totals by name, so a frequent name is never joined with itself.
    """
    own = found.select("id").join(functions.select("id", "name", "path", "start", "end").dropDuplicates(["id"]), "id")
    named = own.where(F.col("name").rlike(f"^{IDENTIFIER}$"))
    seen = checkpointed(occurrences(texts, named))
    totals = seen.groupBy("name").agg(F.sum("n").alias("total"))
    spans = inner.select(F.col("source").alias("by"), F.col("target").alias("id")).distinct().join(functions.select(F.col("id").alias("by"), "path", "start", "end"), "by").select("id", "path", "start", "end")
    inside = spans.join(named.select("id", "name"), "id").join(seen, ["name", "path"]).where(F.col("line").between(F.col("start"), F.col("end"))).select("id", "path", "line", "n").distinct()
    inside = checkpointed(inside)
    first = named.join(seen, ["name", "path"]).where(F.col("line").between(F.col("start"), F.col("end"))).groupBy("id", "path").agg(F.min("line").alias("line"))
    declared = first.join(inside.select("id", "path", "line"), ["id", "path", "line"], "left_anti").select("id", F.lit(1).cast("long").alias("n"))
    explained = inside.select("id", "n").unionByName(declared).groupBy("id").agg(F.sum("n").alias("explained"))
    counted = named.join(totals, "name", "left").join(explained, "id", "left").select("id", (F.coalesce("total", F.lit(0)) - F.coalesce("explained", F.lit(0))).cast("long").alias("elsewhere"))
    return own.select("id").join(counted, "id", "left")


def statuses(found: DataFrame, inner: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, status) of candidates under decisions (id, kind): removed if an entry reaches it, test-only if only a test-entry does, else unused."""
    reach = lambda kind: G.reachable(inner, decisions.where(F.col("kind") == kind).select(F.col("id").alias("node")).distinct().join(found.select(F.col("id").alias("node")), "node", "left_semi")).select(F.col("node").alias("id"), F.lit(True).alias(kind))
    marked = found.select("id").join(reach("entry"), "id", "left").join(reach("test-entry"), "id", "left")
    return marked.select("id", F.when(F.col("entry"), "removed").when(F.col("test-entry"), "test-only").otherwise("unused").alias("status"))


def check_decisions(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, problem): ids of decisions that aren't candidates, or that appear more than once."""
    strange = decisions.select("id").distinct().join(found.select("id"), "id", "left_anti").select("id", F.lit("not-a-candidate").alias("problem"))
    return strange.unionByName(decisions.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("problem")))


def confidence_signals(**have: Column) -> Column:
    """The levels, 0 low to 2 high, of the signals that hold, by what is known of a candidate and its owner.

    ``elsewhere``, ``visibility``, ``annotations``, ``owner_uses``, ``outside`` (supertypes outside of the owner or its ancestors),
    ``below`` (of its descendants), ``static``: columns; null is unknown.
    """
    visible = have["visibility"] != "private"
    outside = F.coalesce(have["outside"] > 0, F.lit(False))
    return F.array_compact(F.array(
        F.when(have["elsewhere"] > 0, 0), F.when(have["owner_uses"] > 0, 0), F.when(F.coalesce(visible, F.lit(True)) & ~F.coalesce(have["static"], F.lit(False)) & (outside | F.coalesce(have["below"] > 0, F.lit(False))), 0),
        F.when(have["elsewhere"].isNull(), 1), F.when(have["visibility"].isNull(), 1), F.when(visible, 1), F.when(have["annotations"].isNull(), 1), F.when(have["annotations"] > 0, 1), F.when(outside, 1),
    ))


def report(found: DataFrame, inner: DataFrame, decisions: DataFrame, levels: DataFrame) -> DataFrame:
    """(id, group, entry, confidence) of unused candidates: the weak component, named by its least id, and the confidence of ``levels`` (id, level), never above that of a node that refers to it."""
    unused = checkpointed(statuses(found, inner, decisions).where("status = 'unused'").select("id").join(found, "id"))
    nodes = unused.select(F.col("id").alias("node"))
    kept = checkpointed(inner.select("source", "target").distinct().join(nodes.withColumnRenamed("node", "source"), "source", "left_semi").join(nodes.withColumnRenamed("node", "target"), "target", "left_semi"))
    group = G.weak_components(nodes, kept).toDF("id", "group")
    capped = G.propagate_least(unused.join(levels, "id", "left").select(F.col("id").alias("node"), F.coalesce("level", F.lit(2)).alias("level")), kept).toDF("id", "level")
    names = F.array(*[F.lit(x) for x in LEVELS])
    return unused.join(group, "id").join(capped, "id").select("id", "group", "entry", F.element_at(names, F.col("level") + 1).alias("confidence"))
