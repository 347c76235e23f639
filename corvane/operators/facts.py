"""Fact projection: declarations, imports, exports and calls become nodes, edges and gaps.

Inputs: ``decls`` (path, owner, kind, name, pos, start, end), ``imports`` (path, target), ``calls``
(path, caller, callee, line), ``exports`` (path, name), ``files`` (path, language, status). Every record
of an input ends in exactly one outcome, and ``conservation`` proves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import complexity_of_lines, node_id
from corvane.operators.changes import first_by


def assign_ordinals(decls: DataFrame) -> DataFrame:
    """With ``ordinal``: the place, from 0, among the declarations of one path, owner and kind."""
    return decls.withColumn("ordinal", F.row_number().over(Window.partitionBy("path", "owner", "kind").orderBy("pos")) - 1)


def declaration_nodes(decls: DataFrame) -> DataFrame:
    """(id, path, kind, name, start, end, complexity): nodes; the first declaration of an id claims it."""
    ided = assign_ordinals(decls).withColumn("id", node_id(F.col("kind"), F.col("path"), F.col("owner"), F.col("name"), F.lit(None).cast("string"), F.col("ordinal")))
    return first_by(ided, ["id"], F.col("pos")).select("id", "path", "kind", "name", "start", "end", complexity_of_lines(F.col("end") - F.col("start") + 1).alias("complexity"))


def id_collisions(decls: DataFrame) -> DataFrame:
    """(id, ranges): ids of declarations whose line ranges differ."""
    ided = decls.withColumn("id", node_id(F.col("kind"), F.col("path"), F.col("owner"), F.col("name"), F.lit(None).cast("string"), F.lit(0)))
    return ided.groupBy("id").agg(F.count_distinct("start", "end").alias("ranges")).where("ranges > 1")


def contains_edges(decls: DataFrame, files: DataFrame) -> DataFrame:
    """file contains declaration."""
    return declaration_nodes(decls).join(files.select("path"), "path", "left_semi").select(F.concat(F.lit("file:"), "path").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"))


def class_contains(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, class, method) where a function of the file has the class as its owner."""
    return classes.join(functions.select("path", F.col("owner").alias("class"), F.col("name").alias("method")), ["path", "class"]).distinct()


def methods_name_only(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, class, method): method names of classes, in ``methods``, with no projected function."""
    named = classes.select("path", "class", F.explode("methods").alias("method"))
    return named.join(functions.select("path", F.col("owner").alias("class"), F.col("name").alias("method")), ["path", "class", "method"], "left_anti")


def import_edges(imports: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges to files that exist, and the imports of others as gaps."""
    known = files.select(F.col("path").alias("target"))
    edges = imports.join(known, "target", "left_semi").select(F.concat(F.lit("file:"), "path").alias("source"), F.concat(F.lit("file:"), "target").alias("target"), F.lit("imports").alias("type")).distinct()
    return edges, imports.join(known, "target", "left_anti")


def match_exports(exports: DataFrame, decls: DataFrame) -> DataFrame:
    """(path, name, outcome, target): resolved with exactly one declaration of the name in the file, else unresolved or ambiguous."""
    nodes = declaration_nodes(decls).groupBy("path", "name").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    joined = exports.join(nodes, ["path", "name"], "left")
    outcome = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return joined.select("path", "name", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("id")).alias("target"))


def call_scope(paths: DataFrame, imports: DataFrame, re_export_only: DataFrame | None = None) -> DataFrame:
    """(path, scope): the file itself and what it imports, without files that are only exported again."""
    ahead = imports.select("path", F.col("target").alias("scope"))
    if re_export_only is not None:
        ahead = ahead.join(re_export_only.toDF("path", "scope"), ["path", "scope"], "left_anti")
    return paths.select("path", F.col("path").alias("scope")).unionByName(ahead).distinct()


def resolve_calls(calls: DataFrame, decls: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls with ``outcome`` and ``target``: the callee's name is looked up in the file and its imports; exactly one declaration makes an edge.

    Names are counted by file first, so a call meets at most one row for each file in its scope.
    """
    scope = call_scope(calls.select("path").distinct(), imports)
    names = declaration_nodes(decls).groupBy(F.col("path").alias("scope"), F.col("name").alias("callee")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    wanted = calls.select("path", "callee").distinct()
    found = wanted.join(scope, "path").join(names, ["scope", "callee"]).groupBy("path", "callee").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    outcome = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return calls.join(found, ["path", "callee"], "left").withColumn("outcome", outcome).withColumn("target", F.when(F.col("n") == 1, F.col("id"))).drop("n", "id")


def caller_by_containment(calls: DataFrame, decls: DataFrame) -> DataFrame:
    """(path, caller, line, source): the caller among declarations of its name whose lines contain the call, if it is one only."""
    d = decls.select("path", F.col("name").alias("caller"), "start", "end", "owner", "kind", "pos")
    joined = calls.select("path", "caller", "line").distinct().join(d, ["path", "caller"]).where(F.col("line").between(F.col("start"), F.col("end")))
    return joined.groupBy("path", "caller", "line").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).where("n = 1").select("path", "caller", "line", F.col("pos").alias("source"))


def collect_gaps(gaps: DataFrame, samples: int = 5) -> DataFrame:
    """(kind, scope, count, samples): how many, and the least five samples, of each kind and scope.

    Samples are cut to five inside buckets by hash before they meet, so a hot kind is never gathered.
    """
    part = F.pmod(F.xxhash64("sample"), F.lit(64))
    small = gaps.groupBy("kind", "scope", part.alias("p"), "sample").agg(F.count("*").alias("n"))
    ranked = small.withColumn("r", F.row_number().over(Window.partitionBy("kind", "scope", "p").orderBy("sample")))
    cut = ranked.groupBy("kind", "scope", "p").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("r") <= samples, F.col("sample"))).alias("s"))
    return cut.groupBy("kind", "scope").agg(F.sum("n").alias("count"), F.slice(F.array_sort(F.flatten(F.collect_list("s"))), 1, samples).alias("samples"))


def coverage_ledger(files: DataFrame) -> DataFrame:
    """Per language: files, parsed, zero_symbol, skipped by reason, all from (language, status)."""
    s = F.col("status")
    return files.groupBy("language").agg(
        F.count("*").alias("files"), F.count_if(s == "parsed").alias("parsed"), F.count_if(s == "zero-symbol").alias("zero_symbol"),
        F.count_if(s == "no-extractor").alias("skipped_no_extractor"), F.count_if(s == "parse-failed").alias("skipped_parse_failed"), F.count_if(~s.isin("parsed", "zero-symbol", "no-extractor", "parse-failed")).alias("skipped_other"),
    )


def conservation_violations(ledger: DataFrame) -> DataFrame:
    """Languages whose files are not parsed + zero_symbol + all skipped."""
    return ledger.where("files <> parsed + zero_symbol + skipped_no_extractor + skipped_parse_failed + skipped_other")


def conserves(rows: DataFrame, outcome: str, total: DataFrame) -> DataFrame:
    """One row: how many records, how many outcomes, and whether they are as many."""
    n = rows.agg(F.count_if(F.col(outcome).isNotNull()).alias("outcomes"))
    return total.agg(F.count("*").alias("records")).crossJoin(n).withColumn("adds_up", F.expr("records = outcomes"))  # one row each


def union_edges(*stages: DataFrame) -> DataFrame:
    """Edges of all stages; the first stage with an edge (type, source, target) keeps it."""
    rows = None
    for i, e in enumerate(stages):
        part = e.select("source", "target", "type").withColumn("stage", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("type", "source", "target").agg(F.min("stage").alias("stage"))


def merge_evidence(edges: DataFrame) -> DataFrame:
    """One edge for each (type, source, target) with its evidence, each piece once, in order."""
    return edges.groupBy("type", "source", "target").agg(F.array_sort(F.collect_set(F.struct("file", "line"))).alias("evidence"))


def derive_status(failed: Column, has_reader: Column, symbols: Column) -> Column:
    """no-extractor, parse-failed, zero-symbol or parsed, in this order."""
    return F.when(~has_reader, "no-extractor").when(failed, "parse-failed").when(symbols == 0, "zero-symbol").otherwise("parsed")


def overlap_join(steps: DataFrame, nodes: DataFrame, bin_size: int = 64) -> DataFrame:
    """(step, id) of ranges in one file that overlap; steps that meet nothing take the file's own node.

    Ranges are dealt to bins of ``bin_size`` lines, so the join is on (path, bin) and a file with very
    many ranges is split; a pair is taken in the first bin that both have.
    """
    binned = lambda d: d.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))))
    a, b = binned(steps.select("step", "path", "start", "end")), binned(nodes.select("id", "path", F.col("start").alias("s"), F.col("end").alias("e")).withColumnsRenamed({"s": "start", "e": "end"})).withColumnsRenamed({"start": "s", "end": "e"})
    hit = a.join(b, ["path", "bin"]).where((F.col("start") <= F.col("e")) & (F.col("s") <= F.col("end")) & (F.col("bin") == F.greatest(F.floor(F.col("start") / bin_size), F.floor(F.col("s") / bin_size)))).select("step", "id")
    rest = steps.join(hit.select("step").distinct(), "step", "left_anti").select("step", F.concat(F.lit("file:"), "path").alias("id"))
    return hit.unionByName(rest)
