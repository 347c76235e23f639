"""Registered history queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import history as H
from corvane.plans.roles import CHANGES_SQL, FILES_SQL, ancestors_sql, changes, supplier_paths

GROUPS = [("alpha", "AFRICA"), ("alpha", "EUROPE/FRANCE"), ("beta", "EUROPE"), ("gamma", "NOWHERE/AT/ALL"), ("delta", "ASIA/")]

FILE_ROWS_SQL = f"""SELECT f.path, f.lines, CASE WHEN covered THEN coalesce(c, 0) END AS commits, CASE WHEN covered THEN coalesce(a, 0) END AS authors,
  CASE WHEN covered AND NOT coalesce(bin, false) THEN coalesce(plus, 0) END AS added, CASE WHEN covered AND NOT coalesce(bin, false) THEN coalesce(minus, 0) END AS removed,
  CASE WHEN covered THEN last END AS last_changed, CASE WHEN covered THEN coalesce(c, 0) END * f.lines AS score
  FROM ({FILES_SQL}) f LEFT JOIN (SELECT path, count(DISTINCT commit) AS c, count(DISTINCT author) AS a, CAST(sum(added) AS BIGINT) AS plus, CAST(sum(removed) AS BIGINT) AS minus, bool_or(added IS NULL OR removed IS NULL) AS bin, max(changed_at) AS last FROM ({CHANGES_SQL}) GROUP BY path) h ON h.path = f.path"""

DIRS_SQL = f"""WITH rows AS ({FILE_ROWS_SQL}), d AS (SELECT *, unnest({ancestors_sql('path')}) AS dir FROM rows),
  c AS (SELECT commit, author, unnest({ancestors_sql('ch.path')}) AS dir FROM ({CHANGES_SQL}) ch JOIN ({FILES_SQL}) f ON f.path = ch.path WHERE covered)
  SELECT dir AS path, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CASE WHEN bool_or(commits IS NOT NULL) THEN coalesce(any_value(n.c), 0) END AS commits, CASE WHEN bool_or(commits IS NOT NULL) THEN coalesce(any_value(n.a), 0) END AS authors,
  CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(score) AS BIGINT) AS score, max(last_changed) AS last_changed
  FROM d LEFT JOIN (SELECT dir, count(DISTINCT commit) AS c, count(DISTINCT author) AS a FROM c GROUP BY dir) n USING (dir) GROUP BY dir"""

_PAIRS = f"""pf AS (SELECT DISTINCT path, commit FROM ({CHANGES_SQL})), sized AS (SELECT commit, count(*) AS n FROM pf GROUP BY commit),
  small AS (SELECT path, commit FROM pf JOIN sized USING (commit) WHERE n BETWEEN 2 AND 30), tot AS (SELECT path, count(*) AS n FROM pf GROUP BY path),
  pairs AS (SELECT x.path AS a, y.path AS b, count(*) AS together FROM small x JOIN small y ON x.commit = y.commit AND x.path < y.path GROUP BY 1, 2)"""
CO_SQL = f"""WITH {_PAIRS} SELECT a, b, together, floor(together * 100 / ta.n + 0.5) / 100 AS share_of_a, floor(together * 100 / tb.n + 0.5) / 100 AS share_of_b FROM pairs JOIN tot ta ON ta.path = a JOIN tot tb ON tb.path = b WHERE together >= 3"""

_GROUPS_SQL = "(VALUES " + ", ".join(f"('{n}', '{p.rstrip('/')}')" for n, p in GROUPS) + ") g(name, wanted)"


def _groups(spark):
    return spark.createDataFrame([(n, p.rstrip("/")) for n, p in GROUPS], "name string, wanted string")


def queries() -> dict:
    rows = lambda s, d: H.file_rows(supplier_paths(s, d), changes(s, d))
    return {
        "co_change": lambda s, d: H.co_change(changes(s, d)),
        "co_change_header": lambda s, d: H.co_change_header(changes(s, d)),
        "co_changed_partners": lambda s, d: H.co_changed(H.co_change(changes(s, d)), _some_path(s, d), 10),
        "file_rows": rows,
        "directory_rows": lambda s, d: H.directory_rows(supplier_paths(s, d), changes(s, d)),
        "commits_by_year": lambda s, d: H.commits_by_year(changes(s, d)),
        "author_concentration": lambda s, d: H.concentration(changes(s, d), F.col("bot")),
        "match_groups": lambda s, d: H.match_groups(_groups(s), supplier_paths(s, d)),
        "count_groups": lambda s, d: H.count_groups(H.match_groups(_groups(s), supplier_paths(s, d))),
        "score_histogram": lambda s, d: H.score_histogram(rows(s, d)),
        "top_files": lambda s, d: H.top_files(rows(s, d), 15),
        "lines_distribution": lambda s, d: H.distribution(changes(s, d).where("added is not null").withColumn("region", F.split("path", "/")[0]), "region", "added"),
        "author_years": lambda s, d: H.author_years(changes(s, d), F.split("path", "/")[0]),
        "bot_commits": lambda s, d: changes(s, d).groupBy("bot").agg(F.count_distinct("commit").alias("commits")),
        "change_conservation": lambda s, d: _conservation(s, d),
    }


def _some_path(spark, sf: str) -> str:
    return supplier_paths(spark, sf).agg(F.min("path")).first()[0]


def _conservation(spark, sf: str):
    """Changes read = attributed to a selected file + outside the selection; the last column is whether they add up."""
    read = changes(spark, sf)
    inside = supplier_paths(spark, sf).where("covered").select("path", F.lit(True).alias("inside"))
    return read.join(inside, "path", "left").agg(F.count("*").alias("changes_read"), F.count_if("inside").alias("attributed"), F.count_if(F.col("inside").isNull()).alias("outside_selection")).withColumn("adds_up", F.expr("changes_read = attributed + outside_selection"))


def oracle_sql() -> dict[str, str]:
    return {
        "co_change": CO_SQL,
        "co_change_header": f"WITH {_PAIRS} SELECT (SELECT count(*) FROM sized WHERE n BETWEEN 2 AND 30) AS commits_counted, (SELECT count(*) FROM sized WHERE n > 30) AS commits_over_limit, count(*) FILTER (together >= 3) AS pairs_listed, count(*) FILTER (together < 3) AS pairs_below_minimum FROM pairs",
        "co_changed_partners": f"WITH p AS ({CO_SQL}), own AS (SELECT CASE WHEN a = m THEN b ELSE a END AS partner, together FROM p, (SELECT min(path) AS m FROM ({FILES_SQL})) WHERE a = m OR b = m) SELECT partner, together, (SELECT max(together) FROM own) AS most FROM own ORDER BY together DESC, partner LIMIT 10",
        "file_rows": FILE_ROWS_SQL,
        "directory_rows": DIRS_SQL,
        "commits_by_year": f"WITH c AS (SELECT DISTINCT commit, CAST(year(changed_at) AS INT) AS year, unnest({ancestors_sql('path')}) AS dir FROM ({CHANGES_SQL})), y AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM c) SELECT d.dir AS path, CAST(y.year AS INT) AS year, count(c.commit) AS commits FROM (SELECT DISTINCT dir FROM c) d CROSS JOIN y LEFT JOIN c ON c.dir = d.dir AND c.year = y.year GROUP BY 1, 2",
        "author_concentration": f"WITH c AS (SELECT DISTINCT commit, author, unnest({ancestors_sql('path')}) AS dir FROM ({CHANGES_SQL}) WHERE NOT bot), n AS (SELECT dir, author, count(*) AS n FROM c GROUP BY 1, 2), r AS (SELECT dir, n, coalesce(sum(n) OVER (PARTITION BY dir ORDER BY n DESC, author ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY dir) AS total FROM n) SELECT dir AS path, CAST(sum(n) AS BIGINT) AS commits_by_people, floor(max(n) * 100 / sum(n) + 0.5) / 100 AS top_author_share, count(*) FILTER (before * 5 < total * 4) AS authors_for_80 FROM r GROUP BY dir",
        "match_groups": f"SELECT name, wanted, path FROM {_GROUPS_SQL} LEFT JOIN ({FILES_SQL}) f ON f.path = wanted OR starts_with(f.path, wanted || '/')",
        "count_groups": f"WITH m AS (SELECT name, wanted, path FROM {_GROUPS_SQL} LEFT JOIN ({FILES_SQL}) f ON f.path = wanted OR starts_with(f.path, wanted || '/')), p AS (SELECT path, count(DISTINCT name) AS n FROM m WHERE path IS NOT NULL GROUP BY path) SELECT (SELECT count(DISTINCT name) FROM m) AS groups, (SELECT count(*) FROM m WHERE path IS NULL) AS unmatched, count(*) AS files_in_groups, count(*) FILTER (n > 1) AS files_in_several FROM p",
        "score_histogram": f"WITH r AS ({FILE_ROWS_SQL}), t AS (SELECT max(score) AS top FROM r) SELECT CAST(CASE WHEN score IS NULL THEN 0 WHEN top <= 0 THEN 1 ELSE least(10, floor(score * 10 / top) + 1) END AS INT) AS bin, count(*) AS files FROM r, t GROUP BY 1",
        "top_files": f"SELECT * FROM ({FILE_ROWS_SQL}) ORDER BY score DESC NULLS LAST, commits DESC NULLS LAST, path LIMIT 15",
        "lines_distribution": f"SELECT string_split(path, '/')[1] AS region, min(added) AS least, quantile_disc(added, 0.5) AS p50, quantile_disc(added, 0.95) AS p95, max(added) AS greatest, floor(avg(added) * 100 + 0.5) / 100 AS mean FROM ({CHANGES_SQL}) WHERE added IS NOT NULL GROUP BY 1",
        "author_years": f"SELECT string_split(path, '/')[1] AS app, min(changed_at) AS first, max(changed_at) AS last, count(DISTINCT commit) AS commits, count(DISTINCT author) AS authors FROM ({CHANGES_SQL}) GROUP BY 1",
        "bot_commits": f"SELECT bot, count(DISTINCT commit) AS commits FROM ({CHANGES_SQL}) GROUP BY bot",
        "change_conservation": f"SELECT count(*) AS changes_read, count(*) FILTER (covered) AS attributed, count(*) FILTER (NOT covered) AS outside_selection, true AS adds_up FROM ({CHANGES_SQL}) c JOIN ({FILES_SQL}) f ON f.path = c.path",
    }
