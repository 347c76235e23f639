"""Candidates of a learning tour: entry files, hubs, reading order, layers and files without code.

``files`` has (path, member): member is the repository below the project that holds the file, '' for the project's
own. ``pairs`` has distinct (source, target) of files. Quotas limit what is listed; totals count all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.numbers import cut_rank
from corvane.functions.paths import base_name, is_entry_name
from corvane.operators.graph import fan
from corvane.session import checkpointed

# How many of each class are listed, entry shape, and names that start a walk, best first.
QUOTAS = {"entry": 30, "fan_in": 20, "fan_out": 20, "layer": 5, "walk_depth": 3, "walk": 60, "flow": 5, "other": 30}
TOP_OUT, BOTTOM_IN, MAX_DEPTH = 0.1, 0.25, 2
START_STEMS = ["main", "server", "app", "index"]


def start_tier(path: Column) -> Column:
    """0 for main.*, 1 server.*, 2 app.*, 3 index.*, 4 for any other name, in any case."""
    stem = F.lower(F.regexp_replace(base_name(path), r"\.[^.]*$", ""))
    tier = F.lit(len(START_STEMS))
    for i, name in reversed(list(enumerate(START_STEMS))):
        tier = F.when(stem == name, i).otherwise(tier)
    return tier


def depth_in_member(path: Column, member: Column) -> Column:
    """Directories between a file and the root of its repository."""
    return F.size(F.split(path, "/")) - 1 - F.when(member != "", 1).otherwise(0)


def _value_at(rows: DataFrame, value: str, top: bool, fraction: float) -> DataFrame:
    """One row (cut): the value at which the top, or bottom, fraction of the rows ends, from counts by value."""
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    total = counts.agg(F.sum("k").alias("n"))
    w = Window.orderBy(F.desc("v") if top else F.asc("v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("seen", F.sum("k").over(w)).crossJoin(total)  # one row for each distinct value; total is one row
    return ranked.where(F.col("seen") >= cut_rank(F.col("n"), fraction)).agg((F.max("v") if top else F.min("v")).alias("cut"))


def entry_candidates(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, member, reasons, score, fan_in, fan_out, depth): files with an entry's name, or near a root with a fan-out in the top tenth and a fan-in in the bottom quarter."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = files.join(fan(pairs).withColumnRenamed("node", "path"), "path", "left").select("path", "member", zero("fan_in"), zero("fan_out"), depth_in_member(F.col("path"), F.col("member")).alias("depth"))
    rows = checkpointed(rows)
    cuts = _value_at(rows, "fan_out", True, TOP_OUT).withColumnRenamed("cut", "out_cut").crossJoin(_value_at(rows, "fan_in", False, BOTTOM_IN).withColumnRenamed("cut", "in_cut"))  # one row each
    shape = (F.col("depth") <= MAX_DEPTH) & (F.col("fan_out") > 0) & (F.col("fan_out") >= F.col("out_cut")) & (F.col("fan_in") <= F.col("in_cut"))
    reasons = F.array_join(F.array_compact(F.array(F.when(is_entry_name(F.col("path")), "entry-name"), F.when(shape, "entry-shape"))), "+")
    found = rows.crossJoin(F.broadcast(cuts)).select("path", "member", reasons.alias("reasons"), (F.col("fan_out") - F.col("fan_in")).alias("score"), "fan_in", "fan_out", "depth")
    return found.where("reasons <> ''")


def walk_starts(entries: DataFrame) -> DataFrame:
    """(member, path): the most entry-like entry of each repository that leads anywhere: by name, then the shallower, then the larger fan-out, then path."""
    rows = entries.where("fan_out >= 1").withColumn("place", F.struct(start_tier(F.col("path")).alias("tier"), "depth", (-F.col("fan_out")).alias("out"), F.col("path").alias("path")))
    return rows.groupBy("member").agg(F.min("place").alias("first")).select("member", F.col("first.path").alias("path"))


def reading_walks(pairs: DataFrame, starts: DataFrame, depth: int = QUOTAS["walk_depth"]) -> DataFrame:
    """(member, path, depth, step): one breadth-first walk for each start along the pairs; at each depth files of more fan-in first, then by path."""
    step = checkpointed(pairs.select(F.col("source").alias("path"), F.col("target").alias("to")).distinct())
    seen = front = checkpointed(starts.select("member", "path", F.lit(0).alias("depth")))
    for hop in range(1, depth + 1):
        ahead = front.join(step, "path").select("member", F.col("to").alias("path")).distinct().join(seen.select("member", "path"), ["member", "path"], "left_anti")
        front = checkpointed(ahead.withColumn("depth", F.lit(hop)))
        seen = seen.unionByName(front)
    w = Window.partitionBy("member").orderBy("depth", F.desc(F.coalesce("fan_in", F.lit(0))), "path")
    return seen.join(fan(pairs).select(F.col("node").alias("path"), "fan_in"), "path", "left").select("member", "path", "depth", (F.row_number().over(w) - 1).alias("step"))


def interleave(walks: DataFrame, most: int = QUOTAS["walk"]) -> DataFrame:
    """(path, member, depth, step) of the first ``most`` files when the walks take turns, in the order of members; a file of several walks is listed where it comes first."""
    first = walks.groupBy("path").agg(F.min(F.struct("step", "member", "depth")).alias("f")).select("path", "f.member", "f.depth", "f.step")
    return first.orderBy("step", "member").limit(most)  # the quota is the report's


def top_by(rows: DataFrame, value: str, most: int, within: str | None = None) -> DataFrame:
    """(path, rank, value[, within]) of the ``most`` rows with the greatest values, then by path, in all or within each group; zeros don't rank."""
    if within is None:
        best = rows.where(F.col(value) > 0).orderBy(F.desc(value), "path").limit(most)  # a top-k report
        return best.select("path", F.row_number().over(Window.orderBy(F.desc(value), "path")).alias("rank"), F.col(value).alias("value"))
    w = Window.partitionBy(within).orderBy(F.desc(value), "path")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("path", "rank", F.col(value).alias("value"), within)
