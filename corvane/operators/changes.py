"""Differences, digests, fingerprints and reuse: the batch side of incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Verification states by severity.
SEVERITY = {"verified": 0, "unverified": 1, "dirty": 2, "contradicted": 3}


def diff_entries(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, modified or removed between two manifests (path, content_hash)."""
    joined = before.select("path", F.col("content_hash").alias("old")).join(after.select("path", F.col("content_hash").alias("new")), "path", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return joined.select("path", kind.alias("change")).where("change is not null")


def restrict_to_inventory(diff: DataFrame, inventory: DataFrame) -> DataFrame:
    """The part of a difference that the inventory still has, and what was removed."""
    return diff.join(inventory.select("path"), "path", "left_semi").unionByName(diff.where("change = 'removed'").join(inventory.select("path"), "path", "left_anti"))


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: the SHA-256 over all rows, whatever their order.

    Rows are digested first, then by the first five hexadecimal digits of that in sorted order, and those
    digests by the first two digits; the digest of those 256 is the result. So a task gathers a
    millionth of the rows, or at most 4096 digests.
    """
    line = F.sha2(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    leaves = rows.select(line.alias("d")).groupBy(F.substring("d", 1, 5).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), "\n"), 256).alias("d"), F.count("*").alias("n"))
    joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), "\n"), 256)
    branches = leaves.groupBy(F.substring("p", 1, 2).alias("b")).agg(joined.alias("d"), F.sum("n").alias("n")).select(F.col("b").alias("p"), "d", "n")
    return branches.agg(joined.alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"))


def duplicate_contents(manifest: DataFrame) -> DataFrame:
    """(content_hash, first_path, copies) of contents that several paths have."""
    return manifest.groupBy("content_hash").agg(F.min("path").alias("first_path"), F.count("*").alias("copies")).where("copies > 1")


def compare_fingerprints(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, level) of files in both: none, cosmetic or structural.

    Fingerprints are (path, content_hash, symbols, total_lines): equal contents are none; other symbols,
    or a size beyond half to one and a half of what it was, are structural; else cosmetic.
    """
    b = before.select("path", *[F.col(c).alias(f"old_{c}") for c in ("content_hash", "symbols", "total_lines")])
    ratio = F.col("total_lines") / F.col("old_total_lines")
    level = F.when(F.col("content_hash") == F.col("old_content_hash"), "none").when(F.sort_array("symbols") != F.sort_array("old_symbols"), "structural").when((F.col("old_total_lines") > 0) & ((ratio > 1.5) | (ratio < 0.5)), "structural").otherwise("cosmetic")
    return b.join(after, "path").select("path", level.alias("level"))


def analyze_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(level, files): new, deleted, structural, cosmetic and none."""
    both = compare_fingerprints(before, after)
    new = after.join(before, "path", "left_anti").select("path", F.lit("new").alias("level"))
    gone = before.join(after, "path", "left_anti").select("path", F.lit("deleted").alias("level"))
    return both.unionByName(new).unionByName(gone).groupBy("level").agg(F.count("*").alias("files"))


def classify_update(levels: DataFrame, total_files: DataFrame, directory_changed: Column | bool = False) -> DataFrame:
    """One row (structural_count, action): SKIP, FULL_UPDATE over 30 files or half of all, ARCHITECTURE_UPDATE over 10 or with a new or lost top directory, else PARTIAL_UPDATE."""
    n = levels.agg(F.coalesce(F.sum(F.when(F.col("level").isin("new", "deleted", "structural"), F.col("files"))), F.lit(0)).alias("structural_count")).crossJoin(total_files)  # one row each
    c, total = F.col("structural_count"), F.col("total_files")
    changed = F.lit(directory_changed) if isinstance(directory_changed, bool) else directory_changed
    action = F.when(c == 0, "SKIP").when((c > 30) | ((total > 0) & (c / total > 0.5)), "FULL_UPDATE").when(changed | (c > 10), "ARCHITECTURE_UPDATE").otherwise("PARTIAL_UPDATE")
    return n.select("structural_count", action.alias("action"))


def reuse_plan(nodes: DataFrame, manifest: DataFrame, cache: DataFrame) -> DataFrame:
    """(node_id, plan): reuse a cached entry of the same source hash, generate otherwise, unavailable without a source file."""
    joined = nodes.join(manifest, "path", "left").join(cache.select("node_id", "source_hash"), "node_id", "left")
    plan = F.when(F.col("content_hash").isNull(), "unavailable").when(F.col("source_hash") == F.col("content_hash"), "reuse").otherwise("generate")
    return joined.select("node_id", plan.alias("plan"))


def freshness(source_hash: Column, content_hash: Column, language_ok: Column) -> Column:
    """missing, noncanonical-language, fresh or stale, in this order."""
    return F.when(source_hash.isNull(), "missing").when(~language_ok, "noncanonical-language").when(source_hash == content_hash, "fresh").otherwise("stale")


def stale_files(nodes: DataFrame, fresh: Column) -> DataFrame:
    """(path, stale): whether any node of the file needs a new text."""
    return nodes.groupBy("path").agg(F.bool_or(~fresh).alias("stale"))


def severity(state: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), state)


def merge_verification(a: Column, b: Column) -> Column:
    """The more severe of two states; a known one over null."""
    names = F.array(*[F.lit(k) for k in SEVERITY])
    return F.try_element_at(names, F.greatest(severity(a), severity(b)) + 1)


def mark_dirty(nodes: DataFrame, cosmetic: DataFrame) -> DataFrame:
    """Nodes with ``verification`` raised to dirty in cosmetically changed files, never lowered."""
    hit = cosmetic.select("path", F.lit("dirty").alias("raised")).distinct()
    joined = nodes.join(hit, "path", "left")
    return joined.withColumn("verification", F.when(F.col("raised").isNotNull(), merge_verification(F.col("verification"), F.col("raised"))).otherwise(F.col("verification"))).drop("raised")


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_nodes_and_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batches merged: the last node of an id wins, the heaviest edge of (source, target, type, direction), edges without both ends go.

    Nodes have (id, batch, position, ...) and edges (source, target, type, direction, weight,
    batch, position); the third result counts what was dropped.
    """
    last = first_by(nodes, ["id"], F.desc("batch"), F.desc("position"))
    heavy = first_by(edges, ["source", "target", "type", "direction"], F.desc("weight"), F.col("batch"), F.col("position"))
    ids = last.select("id")
    whole = heavy.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    counts = [nodes.agg(F.count("*").alias("nodes_in")), last.agg(F.count("*").alias("nodes_out")), edges.agg(F.count("*").alias("edges_in")), heavy.agg(F.count("*").alias("edges_distinct")), whole.agg(F.count("*").alias("edges_out"))]
    totals = counts[0]
    for c in counts[1:]:
        totals = totals.crossJoin(c)  # one row each
    return last, whole, totals


def replace_files(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with the nodes of changed files, and edges that touch them, replaced by new ones."""
    kept = old_nodes.join(changed, "path", "left_anti")
    gone = old_nodes.join(changed, "path", "left_semi").select("id")
    edges = old_edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return kept.unionByName(new_nodes), edges.unionByName(new_edges).dropDuplicates(["source", "target", "type"])


def is_superset(whole: Column, part: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def overlay(summaries: DataFrame, checks: DataFrame) -> DataFrame:
    """Per summary its verdict, unchecked without one; contradicted texts are blanked."""
    joined = summaries.join(first_by(checks, ["id"], F.col("position")), "id", "left")
    verdict = F.coalesce("verdict", F.lit("unchecked"))
    return joined.select("id", verdict.alias("verdict"), F.when(verdict != "contradicted", F.col("summary")).alias("summary"))
