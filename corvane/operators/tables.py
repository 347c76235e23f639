"""Filters, order, bins and joins behind product tables and charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.changes import first_by

# Verdicts of a check.
VERDICTS = ["does", "not", "none"]


def filter_rows(rows: DataFrame, lists: dict[str, Sequence[str]] | None = None, text: str = "", search: Sequence[str] = (), unknown: dict[str, str] | None = None, group: tuple[str, object] | None = None) -> DataFrame:
    """Rows whose columns are among the lists (an empty list passes all), whose group is the given one, and one of whose ``search`` columns contains the text in any case. ``unknown`` names nulls."""
    keep = F.lit(True)
    for column, values in (lists or {}).items():
        if values:
            value = F.coalesce(F.col(column), F.lit((unknown or {}).get(column))) if (unknown or {}).get(column) else F.col(column)
            keep &= F.coalesce(value.isin(*values), F.lit(False))
    if group and group[1] is not None:
        keep &= F.coalesce(F.col(group[0]) == F.lit(group[1]), F.lit(False))
    if wanted := text.strip().lower():
        keep &= F.contains(F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in search])), F.lit(wanted))
    return rows.where(keep)


def sort_rows(rows: DataFrame, key: str, position: str, ascending: bool = True) -> DataFrame:
    """Rows by key, rows without a key last in both directions, equal ones as they came."""
    return rows.orderBy(F.asc_nulls_last(key) if ascending else F.desc_nulls_last(key), position)


def page_of(rows: DataFrame, total: int, page: int, size: int) -> tuple[DataFrame, dict[str, int]]:
    """The rows of a page (1-based, clamped into range) of a sorted table, and its bounds (page, pages, from, to, total)."""
    pages = max(1, -(-total // size))
    at = min(max(1, page), pages)
    bounds = {"page": at, "pages": pages, "from": (at - 1) * size + 1 if total else 0, "to": min(total, at * size), "total": total}
    return rows.offset((at - 1) * size).limit(size), bounds


def histogram_bins(rows: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """(bin, low, high, n) for each of the bins between ascending edges, the last one closed; bin -1 counts what is outside or no number."""
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("a histogram needs two edges at least, strictly ascending")
    v, last = F.col(value).cast("double"), len(edges) - 2
    place = F.least(F.lit(last), sum((F.when(v >= e, 1).otherwise(0) for e in edges[1:]), F.lit(0)))
    inside = v.isNotNull() & ~F.isnan(v) & v.between(edges[0], edges[-1])
    counts = rows.groupBy(F.when(inside, place).otherwise(-1).alias("bin")).agg(F.count("*").alias("k"))
    bins = rows.sparkSession.createDataFrame([(-1, None, None), *[(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]], "bin int, low double, high double")
    return bins.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("k", F.lit(0)).alias("n"))


def score_shares(rows: DataFrame, key: str, score: str) -> DataFrame:
    """(key, share): each score as a percentage of the greatest, 0 to 100; null without a score or a positive greatest one."""
    top = rows.agg(F.max(score).alias("top"))
    return rows.crossJoin(top).select(key, F.when((F.col("top") > 0) & F.col(score).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(score) / F.col("top") * 100))).alias("share"))  # top is one row


def bars(rows: DataFrame, by: str, names: Sequence[str]) -> DataFrame:
    """(place, label, value) in the order of names; value is null where the rows have none."""
    order = rows.sparkSession.createDataFrame(list(enumerate(names)), "place int, label string")
    counts = rows.groupBy(F.col(by).alias("label")).agg(F.count("*").alias("value"))
    return order.join(counts, "label", "left").select("place", "label", "value")


def diff_layer_counts(layers: DataFrame, nodes: DataFrame, states: DataFrame) -> DataFrame:
    """(layer, changed, affected) of nodes with a state (id, state): a node is in the layers that name it, or else in those that name a node of its file; each counts once in a layer."""
    named = layers.select("layer", "id").distinct()
    files = named.join(nodes, "id").where("path is not null").select("layer", "path").distinct()
    direct = states.join(named, "id")
    rest = states.join(named.select("id").distinct(), "id", "left_anti").join(nodes, "id").join(files, "path").select("id", "state", "layer")
    counts = direct.select("id", "state", "layer").unionByName(rest).distinct().groupBy("layer").agg(F.count_if(F.col("state") == "changed").alias("changed"), F.count_if(F.col("state") == "affected").alias("affected"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return layers.select("layer").distinct().join(counts, "layer", "left").select("layer", zero("changed"), zero("affected"))


def verdict_text(does: Column, negative: Column, none: Column, unchecked: Column, other: Column) -> Column:
    """'does 3 / not 0 / none 0' with further pieces where there are some; null without evidence, 'not checked' without any check."""
    total = does + negative + none + unchecked + other
    text = F.concat(F.lit("does "), does, F.lit(" / not "), negative, F.lit(" / none "), none)
    text = F.concat(text, F.when(unchecked > 0, F.concat(F.lit(" / not checked "), unchecked)).otherwise(""), F.when(other > 0, F.concat(F.lit(" / other "), other)).otherwise(""))
    return F.when(total == 0, F.lit(None)).when(unchecked == total, "not checked").otherwise(text)


def join_checks(evidence: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per unit of evidence (unit, file, line): counts by verdict and their text; and one row (unmatched, duplicates) of checks (unit, file, line, verdict, position). The first check of a place counts."""
    place = ["unit", "file", "line"]
    first = first_by(checks, place, F.col("position"))
    joined = evidence.join(first.select(*place, F.coalesce("verdict", F.lit("")).alias("verdict")), place, "left")
    v = F.col("verdict")
    counts = joined.groupBy("unit").agg(F.count_if(v == "does").alias("does"), F.count_if(v == "not").alias("not"), F.count_if(v == "none").alias("none"), F.count_if(v.isNull()).alias("unchecked"), F.count_if(v.isNotNull() & ~v.isin(*VERDICTS)).alias("other"))
    units = counts.withColumn("text", verdict_text(*[F.col(c) for c in ("does", "not", "none", "unchecked", "other")]))
    unmatched = first.join(evidence.select(*place), place, "left_anti").agg(F.count("*").alias("unmatched"))
    repeated = checks.agg(F.count("*").alias("all")).crossJoin(first.agg(F.count("*").alias("first"))).select((F.col("all") - F.col("first")).alias("duplicates"))  # one row each
    return units, unmatched.crossJoin(repeated)


def filter_units(units: DataFrame, verdicts: Sequence[str]) -> DataFrame:
    """Units any of whose evidence has one of the verdicts; 'not checked' is evidence without a check."""
    keep = F.lit(False)
    for v in verdicts:
        keep |= F.col("unchecked" if v == "not checked" else v) > 0
    return units.where(keep) if verdicts else units


def selection_ledger(decisions: DataFrame) -> DataFrame:
    """One row: candidates, and how many of each kind of decision (path, kind), repeated paths, and whether the kinds add up."""
    kinds = {"selected": "selected", "filtered_by_defaults": "filtered-by-defaults", "filtered_by_ignore": "filtered-by-ignore", "sensitive": "sensitive"}
    row = decisions.agg(F.count("*").alias("candidates"), *[F.count_if(F.col("kind") == k).alias(c) for c, k in kinds.items()], (F.count("*") - F.count_distinct("path")).alias("repeated"))
    return row.withColumn("adds_up", F.expr(f"candidates = {' + '.join(kinds)}"))


def operation_counts(rows: DataFrame, by: str, buckets: Sequence[str]) -> DataFrame:
    """One row: the total, and the count of each bucket."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(by) == b).alias(b.replace("-", "_")) for b in buckets])


def across_roots(pairs: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """The n pairs (a, b, together) changed together most often whose files lie below different roots (prefix); a file below several belongs to the longest."""
    from corvane.operators.resolve import longest_prefix

    names = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    app = longest_prefix(names, roots)
    joined = pairs.join(app.toDF("a", "app_a"), "a").join(app.toDF("b", "app_b"), "b").where("app_a <> app_b")
    return joined.orderBy(F.desc("together"), "a", "b").limit(n).select("a", "b", F.col("together").alias("commits"))  # a top-n report
