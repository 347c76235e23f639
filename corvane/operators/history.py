"""Change history: file rows, directory rollups, years, concentration, co-change, groups.

``changes`` has (path, commit, author, changed_at, added, removed), one row for each change of a file;
``added`` and ``removed`` are null for binary changes. ``files`` has (path, lines, covered): lines
are null for binary files, and ``covered`` says whether some history covers the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.numbers import share
from corvane.functions.paths import ancestor_dirs
from corvane.session import checkpointed, tasks_for

MAX_FILES, MIN_TOGETHER = 30, 3


def file_rows(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Per file: commits, authors, added, removed (null if any change is binary), last_changed, lines and score = commits x lines.

    All are null for files that no history covers; a covered file without changes has zeros. Commits and authors
    are made distinct in shuffles of their own, so a task holds its share of one pair only and a hot file is split.
    """
    n = tasks_for(changes)
    rows = changes.withColumn("binary", F.col("added").isNull() | F.col("removed").isNull())
    by_commit = rows.repartition(n, "path", "commit").groupBy("path", "commit").agg(F.sum("added").alias("plus"), F.sum("removed").alias("minus"), F.bool_or("binary").alias("binary"), F.max("changed_at").alias("last"))
    seen = by_commit.groupBy("path").agg(F.count("commit").alias("c"), F.sum("plus").alias("plus"), F.sum("minus").alias("minus"), F.bool_or("binary").alias("binary"), F.max("last").alias("last"))
    authors = changes.select("path", "author").repartition(n, "path", "author").distinct().groupBy("path").agg(F.count("author").alias("a"))
    covered = F.col("covered")
    known = lambda c: F.when(covered, F.coalesce(c, F.lit(0)))
    rows = files.join(seen, "path", "left").join(authors, "path", "left")
    commits = known(F.col("c"))
    return rows.select(
        "path", commits.alias("commits"), known(F.col("a")).alias("authors"), F.when(~F.coalesce("binary", F.lit(False)), known(F.col("plus"))).alias("added"),
        F.when(~F.coalesce("binary", F.lit(False)), known(F.col("minus"))).alias("removed"), F.when(covered, F.col("last")).alias("last_changed"), "lines", (commits * F.col("lines")).alias("score"),
    )


def directory_rows(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Per ancestor directory: additive counts summed over files, commits and authors distinct over changes.

    Sums skip unknown terms and are null only if every term is. The two aggregates meet on the
    directory; what is exploded before the distinct counts is one row for each (directory,
    commit, author), so hot directories such as the root are reduced map-side.
    """
    rows = file_rows(files, changes).withColumn("covered", F.col("commits").isNotNull())
    sums = rows.select("*", F.explode(ancestor_dirs(F.col("path"))).alias("dir")).groupBy("dir").agg(
        F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.sum("score").alias("score"), F.max("last_changed").alias("last_changed"), F.bool_or("covered").alias("has"),
    )
    own = changes.join(files.where("covered").select("path"), "path", "left_semi").select("commit", "author", F.explode(ancestor_dirs(F.col("path"))).alias("dir")).distinct()
    counts = own.groupBy("dir").agg(F.count_distinct("commit").alias("c"), F.count_distinct("author").alias("a"))
    known = lambda c: F.when(F.col("has"), F.coalesce(F.col(c), F.lit(0)))
    return sums.join(counts, "dir", "left").select(F.col("dir").alias("path"), "files", "lines", known("c").alias("commits"), known("a").alias("authors"), "added", "removed", "score", "last_changed")


def _directories(changes: DataFrame, *columns: str) -> DataFrame:
    """(columns, dir), each once, for all directories above the changed paths; ``columns`` begin with commit.

    Rows are dealt by commit once, made distinct by the innermost directory, then by each, all in the same task.
    """
    own = changes.select(*columns, F.element_at(ancestor_dirs(F.col("path")), -1).alias("inner")).repartition(tasks_for(changes), columns[0]).distinct()
    above = F.when(F.col("inner") == ".", F.array(F.lit("."))).otherwise(ancestor_dirs(F.concat("inner", F.lit("/"))))
    return own.select(*columns, F.explode(above).alias("dir")).distinct()


def commits_by_year(changes: DataFrame) -> DataFrame:
    """(path, year, commits) for each directory and every year between the first and the last commit, zeros included."""
    own = _directories(changes.select("commit", F.year("changed_at").alias("year"), "path"), "commit", "year")
    counts = checkpointed(own.groupBy("dir", "year").agg(F.count("commit").alias("commits")))  # a row for each directory and year
    years = counts.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("year"))
    grid = counts.select("dir").distinct().join(years)  # a row for each year of the range, few for any history
    return grid.join(counts, ["dir", "year"], "left").select(F.col("dir").alias("path"), "year", F.coalesce("commits", F.lit(0)).alias("commits"))


def concentration(changes: DataFrame, is_bot: Column) -> DataFrame:
    """Per directory: commits by people, the top author's share, and the fewest authors of 80 % of them.

    Only how many authors have how many commits counts, so directories sort these numbers instead of all authors.
    """
    own = _directories(changes.where(~is_bot), "commit", "author")
    counts = own.repartition(tasks_for(changes), "dir", "author").groupBy("dir", "author").agg(F.count("*").alias("n")).groupBy("dir", "n").agg(F.count("*").alias("k"))
    w = Window.partitionBy("dir").orderBy(F.desc("n"))
    own = F.col("n") * F.col("k")
    ranked = counts.select("dir", "n", "k", F.coalesce(F.sum(own).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum(own).over(Window.partitionBy("dir")).alias("total"))
    # of k authors with n commits each, those before whom there are less than 80 % of all
    few = ranked.withColumn("needed", F.expr("case when before * 5 < total * 4 then least(k, (total * 4 - before * 5 - 1) div (5 * n) + 1) else 0 end"))
    return few.groupBy("dir").agg(F.max("total").alias("commits_by_people"), F.max("n").alias("top"), F.sum("needed").alias("authors_for_80")).select(F.col("dir").alias("path"), "commits_by_people", share(F.col("top"), F.col("commits_by_people")).alias("top_author_share"), "authors_for_80")


def commit_files(changes: DataFrame) -> DataFrame:
    return changes.select("path", "commit").repartition(tasks_for(changes), "path", "commit").distinct()


def co_change(changes: DataFrame, max_files: int = MAX_FILES, min_together: int = MIN_TOGETHER) -> DataFrame:
    """Pairs a < b that change together in at least ``min_together`` commits of 2 to ``max_files`` files, with both shares.

    The size rule bounds the pairs of a commit, so the self-join on the commit can't explode. Shuffles have as many tasks as
    the changes need, as pairs are several times as many.
    """
    pairs, n = commit_files(changes), tasks_for(changes)
    sized = pairs.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n").between(2, max_files)).select("commit")
    small = pairs.repartition(n, "commit").join(sized.repartition(n, "commit").hint("merge"), "commit", "left_semi")
    both = small.select("commit", F.col("path").alias("a")).join(small.select("commit", F.col("path").alias("b")).hint("merge"), "commit").where("a < b").select("a", "b")
    together = both.repartition(n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= min_together)
    totals = pairs.groupBy("path").agg(F.count("*").alias("n"))
    out = together.join(totals.select(F.col("path").alias("a"), F.col("n").alias("na")), "a").join(totals.select(F.col("path").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "together", share(F.col("together"), F.col("na")).alias("share_of_a"), share(F.col("together"), F.col("nb")).alias("share_of_b"))


def co_change_header(changes: DataFrame, max_files: int = MAX_FILES, min_together: int = MIN_TOGETHER) -> DataFrame:
    """One row: commits counted and over the limit, pairs listed and below the minimum."""
    sizes = commit_files(changes).groupBy("commit").agg(F.count("*").alias("n"))
    commits = sizes.agg(F.count_if(F.col("n").between(2, max_files)).alias("commits_counted"), F.count_if(F.col("n") > max_files).alias("commits_over_limit"))
    pairs = co_change(changes, max_files, 1).agg(F.count_if(F.col("together") >= min_together).alias("pairs_listed"), F.count_if(F.col("together") < min_together).alias("pairs_below_minimum"))
    return commits.crossJoin(pairs)  # one row each


def match_groups(groups: DataFrame, files: DataFrame) -> DataFrame:
    """(name, wanted, path): files of each group path, by the exact path or a directory above; path is null if nothing matches.

    The directory test is an equi-join on the files' ancestors instead of a theta join.
    """
    below = files.select("path", F.explode(F.array_distinct(F.concat(ancestor_dirs(F.col("path")), F.array("path")))).alias("wanted"))
    return groups.join(below, "wanted", "left").select("name", "wanted", "path")


def count_groups(matched: DataFrame) -> DataFrame:
    """One row: groups, files in some group, files in several groups, unmatched paths."""
    per_file = matched.where("path is not null").groupBy("path").agg(F.count_distinct("name").alias("n")).agg(F.count("*").alias("files_in_groups"), F.count_if(F.col("n") > 1).alias("files_in_several"))
    rest = matched.agg(F.count_distinct("name").alias("groups"), F.count_if(F.col("path").isNull()).alias("unmatched"))
    return rest.crossJoin(per_file)  # one row each


def score_histogram(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, files): equal widths from 0 to the maximum, the last bin closed; bin 0 counts unknown scores."""
    top = rows.agg(F.max("score").alias("top"))
    place = F.when(F.col("score").isNull(), 0).when(F.col("top") <= 0, 1).otherwise(F.least(F.lit(bins), F.floor(F.col("score") * bins / F.col("top")) + 1))
    return rows.crossJoin(top).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("files"))  # top is one row


def top_files(rows: DataFrame, n: int) -> DataFrame:
    """The n highest scores, then most commits, then path; unknown scores last."""
    return rows.orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("commits"), "path").limit(n)


def co_changed(pairs: DataFrame, path: str, n: int) -> DataFrame:
    """The n most frequent partners of one path, and their share of the most frequent."""
    own = pairs.where((F.col("a") == path) | (F.col("b") == path)).select(F.when(F.col("a") == path, F.col("b")).otherwise(F.col("a")).alias("partner"), "together")
    top = own.agg(F.max("together").alias("most"))
    return own.crossJoin(top).orderBy(F.desc("together"), "partner").limit(n)  # most is one row


def distribution(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Least, nearest-rank median and 95th percentile, greatest, and mean to two places, by group."""
    exact = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})").cast(rows.schema[value].dataType)
    return rows.groupBy(by).agg(F.min(value).alias("least"), exact(0.5).alias("p50"), exact(0.95).alias("p95"), F.max(value).alias("greatest"), (F.floor(F.avg(value) * 100 + 0.5) / 100).alias("mean"))


def author_years(changes: DataFrame, group: Column) -> DataFrame:
    """Per group: first and last change, commits, authors."""
    return changes.groupBy(group.alias("app")).agg(F.min("changed_at").alias("first"), F.max("changed_at").alias("last"), F.count_distinct("commit").alias("commits"), F.count_distinct("author").alias("authors"))
