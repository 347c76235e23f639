"""Roles that the driver's tables play for the operators, in DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_paths(spark: SparkSession, sf: str) -> DataFrame:
    """(path, s_suppkey, lines, covered): suppliers as files below region and nation; a negative balance is a binary file."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    s = table(spark, sf, "supplier")
    placed = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return placed.select(F.concat_ws("/", "r_name", "n_name", "s_name").alias("path"), "s_suppkey", F.when(F.col("s_acctbal") >= 0, F.floor("s_acctbal")).alias("lines"), (F.col("s_suppkey") % 17 != 0).alias("covered"))


FILES_SQL = "SELECT r_name || '/' || n_name || '/' || s_name AS path, s_suppkey, CASE WHEN s_acctbal >= 0 THEN CAST(floor(s_acctbal) AS BIGINT) END AS lines, s_suppkey % 17 <> 0 AS covered FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """(path, commit, author, changed_at, added, removed, bot): order lines as changes, orders as commits; lines with a 0 discount are binary changes."""
    lines, orders, customers = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "customer")
    files = supplier_paths(spark, sf)
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(files, lines.l_suppkey == files.s_suppkey).join(customers, orders.o_custkey == customers.c_custkey)
    text = F.col("l_discount") > 0
    return rows.select(
        "path", F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("changed_at"),
        F.when(text, F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("long")).otherwise(0)).alias("added"), F.when(text, F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).otherwise(0)).alias("removed"),
        (F.col("c_mktsegment") == "MACHINERY").alias("bot"),
    )


CHANGES_SQL = f"""SELECT path, o_orderkey AS commit, o_custkey AS author, o_orderdate AS changed_at,
  CASE WHEN l_discount > 0 THEN CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END END AS added,
  CASE WHEN l_discount > 0 THEN CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END END AS removed, c_mktsegment = 'MACHINERY' AS bot
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN ({FILES_SQL}) f ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey"""


def ancestors_sql(path: str) -> str:
    """SQL of the list of a path's ancestor directories, '.' first."""
    return f"list_concat(['.'], list_transform(range(1, len(string_split({path}, '/'))), lambda i: array_to_string(string_split({path}, '/')[1:i], '/')))"
