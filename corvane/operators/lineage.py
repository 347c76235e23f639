"""The current file that each change of a history belongs to, through renames, deletions and new files of old names.

``changes`` has (commit_seq, status, path, old_path): larger numbers are older commits, a path has one change in a
commit, and statuses are Git's A, C, D, M and R. What a change of a path belongs to is decided by the newest event on
that path among newer commits: where a file was added, copied or renamed to the path, older changes are
of another file, outside the selection; where a file was renamed away from it, they belong to whatever that rename's change
belongs to; without an event, to the path itself if it is selected. So changes and renames form a forest of
pointers, which is walked by doubling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import checkpointed, tasks_for


def _eras(rows: DataFrame, column: str, n: int, of: DataFrame | None = None) -> DataFrame:
    """With ``era``: n stretches of the column's values, in order, that have about as many of the rows, or of those of ``of``."""
    from pyspark.ml.feature import Bucketizer

    at = F.coalesce(F.col(column).cast("double"), F.lit(-1e300))
    own = rows.withColumn("__at", at)
    cuts = sorted(set((rows if of is None else of).select(at.alias("at")).approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    if not cuts:
        return own.withColumn("era", F.lit(0)).drop("__at")
    return Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__at", outputCol="era").transform(own).withColumn("era", F.col("era").cast("int")).drop("__at")


def _newest(rows: DataFrame, events: DataFrame, eras: int | None = None) -> DataFrame:
    """``rows`` (path, commit_seq, ...) with ``event``, the newest one of the path among newer commits; events have (path, commit_seq, event), one for each path and commit.

    Commits are cut into eras of about as many rows, so a path that most commits change is split: a row looks for an event in
    its own era first, and else takes the last one of an earlier era, of which a path has one row each.
    """
    n = eras or tasks_for(rows)
    both = rows.withColumn("asks", F.lit(True)).withColumn("own", F.lit(None).cast(events.schema["event"].dataType)).unionByName(events.withColumnRenamed("event", "own"), allowMissingColumns=True)
    both = _eras(both, "commit_seq", n, rows).repartition(n, "path", "era")
    newer = Window.partitionBy("path", "era").orderBy("commit_seq").rangeBetween(Window.unboundedPreceding, -1)
    placed = both.withColumn("event", F.last("own", ignorenulls=True).over(newer)).where("asks").drop("asks", "own")
    seq = F.when(F.col("own").isNotNull(), F.struct(F.col("commit_seq").isNotNull(), "commit_seq"))
    ends = both.groupBy("path", "era").agg(F.max_by("own", seq).alias("held"))  # null in an era without an event, which is handed one too
    handed = ends.withColumn("handed", F.last("held", ignorenulls=True).over(Window.partitionBy("path").orderBy("era").rowsBetween(Window.unboundedPreceding, -1))).where("handed is not null").select("path", "era", "handed")
    return placed.join(handed.repartition(n, "path", "era").hint("merge"), ["path", "era"], "left").withColumn("event", F.coalesce("event", "handed")).drop("era", "handed")


def path_events(changes: DataFrame, tasks: int | None = None) -> DataFrame:
    """(path, commit_seq, event): where a path begins, and where it was renamed away, to ``event.to``; in one commit the rename counts, and of several the one to the greatest path."""
    begins = changes.where(F.col("status").isin("A", "C", "R")).select("path", "commit_seq", F.lit(None).cast("string").alias("to"))
    away = changes.where("status = 'R' and old_path is not null").select(F.col("old_path").alias("path"), "commit_seq", F.col("path").alias("to"))
    return begins.unionByName(away).repartition(tasks or tasks_for(changes), "path", "commit_seq").groupBy("path", "commit_seq").agg(F.max("to").alias("to")).select("path", "commit_seq", F.struct("commit_seq", "to").alias("event"))


def follow_renames(changes: DataFrame, selected: DataFrame) -> DataFrame:
    """``changes`` with ``current``: the selected path (path) that a change belongs to now, null outside the selection."""
    n = tasks_for(changes)
    kept = checkpointed(changes.select("commit_seq", "status", "path", "old_path"))
    asked = _newest(kept, path_events(kept, n), n)
    chosen = selected.select("path", F.col("path").alias("own")).distinct()
    start = asked.join(chosen, "path", "left").select("commit_seq", "status", "path", "old_path", F.when(F.col("event").isNull(), F.col("own")).alias("value"), F.when(F.col("event.to").isNotNull(), F.col("event")).alias("next"))
    nodes = checkpointed(start)
    links = checkpointed(nodes.where("status = 'R'").select(F.struct("commit_seq", F.col("path").alias("to")).alias("node"), "value", "next"))
    # what has no next stays out of the joins, where all of it would meet in one task
    while not links.where("next is not null").isEmpty():
        ahead = links.select(F.col("node").alias("next"), F.col("value").alias("v2"), F.col("next").alias("n2"))
        further = links.where("next is not null").join(ahead, "next", "left").select("node", F.col("v2").alias("value"), F.col("n2").alias("next"))
        links = checkpointed(links.where("next is null").unionByName(further))
    ends = links.select(F.col("node").alias("next"), F.col("value").alias("handed"))
    led = nodes.where("next is not null").join(ends, "next", "left").select("commit_seq", "status", "path", "old_path", F.coalesce("handed", "value").alias("current"))
    return nodes.where("next is null").select("commit_seq", "status", "path", "old_path", F.col("value").alias("current")).unionByName(led)


def lineage_conflicts(changes: DataFrame, selected: DataFrame) -> DataFrame:
    """(current, conflicts): where one path map over a branched history can be wrong, counted on the files concerned.

    Two lineages claim a path (a rename from a path that belongs to another file: both), a rename cuts one (the new path has none), or an
    older change that is no deletion follows where a lineage began on its path, with no rename giving it one again since.
    """
    found = checkpointed(follow_renames(changes, selected))
    begun = found.where(F.col("status").isin("A", "C", "R"))
    # what the old path of each rename belongs to at that commit: as any change there would, unless the path begins there too
    old = found.where("status = 'R' and old_path is not null").select("commit_seq", F.col("old_path").alias("path"), F.col("current").alias("target"))
    asked = follow_renames(changes.select("commit_seq", "status", "path", "old_path").unionByName(old.join(changes, ["commit_seq", "path"], "left_anti").select("commit_seq", F.lit("M").alias("status"), "path", F.lit(None).cast("string").alias("old_path")).distinct()), selected)
    held = old.join(asked.select("commit_seq", "path", F.col("current").alias("held")), ["commit_seq", "path"]).join(begun.select("commit_seq", "path"), ["commit_seq", "path"], "left_anti").where("held is not null")
    claims = held.where("target is null").select(F.col("held").alias("current")).unionByName(held.where("target <> held").select(F.explode(F.array("held", "target")).alias("current")))
    sets = begun.where("current is not null").select("path", "commit_seq", F.col("current").alias("file"), F.lit(0).alias("order"))
    clears = found.where("status = 'D' and current is null").select("path", "commit_seq", F.lit(None).cast("string").alias("file"), F.lit(1).alias("order")).unionByName(old.where("target is not null").select("path", "commit_seq", F.lit(None).cast("string").alias("file"), F.lit(1).alias("order")))
    events = sets.unionByName(clears).groupBy("path", "commit_seq").agg(F.max_by("file", "order").alias("file")).select("path", "commit_seq", F.struct("file").alias("event"))
    late = _newest(found.where("current is null and status <> 'D'").select("commit_seq", "path"), events).where("event.file is not null").select(F.col("event.file").alias("current"))
    return claims.unionByName(late).groupBy("current").agg(F.count("*").alias("conflicts"))
