"""The session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "corvane", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df):
    """The rows, computed once and kept in the cluster's checkpoint folder; on a single machine where it is unset, in a folder of one's own."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


# Bytes of the sources behind the rows of one task, and the most tasks of one shuffle.
TASK_BYTES, MOST_TASKS = 4 << 20, 20_000


def tasks_for(df) -> int:
    """How many tasks a shuffle of these rows needs so that a task's share stays the same as tables grow: by the bytes of the files that they come from, without running anything; the session's number where that is unknown.

    Adaptive execution joins partitions by their compressed bytes, until few hold very many rows; a number that is given stays.
    """
    size, leaves = 0, df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        size += int(leaves.apply(i).stats().sizeInBytes())
    if size >= 1 << 60:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_TASKS, size // TASK_BYTES + 1)


def ranked(df, *keys: str):
    """With ``__rank``, from 0 by the keys, whose values are distinct: rows are range-partitioned and kept, and a partition starts at the number of rows before it, so no task sorts everything and one number for each partition comes to the driver."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranged = checkpointed(df.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("n"), F.min(F.struct(*keys)).alias("least")).orderBy("least").collect()
    start, firsts = 0, []
    for r in sizes:
        firsts += [F.lit(r["__p"]), F.lit(start)]
        start += r["n"]
    if not firsts:
        return ranged.withColumn("__rank", F.lit(0).cast("long")).drop("__p")
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*keys))
    return ranged.withColumn("__rank", F.element_at(F.create_map(*firsts), F.col("__p")).cast("long") + place - 1).drop("__p")
