"""Steps whose memory, rows in one task or rows through the driver must not grow with the tables."""

import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import graph, history, lineage, liveness, resolve, tables
from corvane.plans import product_queries
from corvane.session import tasks_for
from tests.oracle import differences

SMALLEST = "/root/testdata/sf0.001"


def shown(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_checks_are_those_of_the_table_in_any_order_of_rows(spark):
    checks = product_queries.checks(spark, SMALLEST)
    assert checks.count() == checks.select("unit", "file", "line", "position").distinct().count()
    for seed in (1, 2):
        dealt = checks.orderBy(F.rand(seed))
        units = tables.join_checks(product_queries.evidence(spark, SMALLEST), dealt)[0]
        assert not differences(units, product_queries.oracle_sql()["checked_units"], SMALLEST)


@pytest.mark.parametrize("eras", [1, 2, 7, 40])
def test_newest_event_of_earlier_eras(spark, eras):
    paths = {"hot": range(0, 120, 2), "cold": [5, 77], "new": [3], "never": [8, 9]}
    asked = [(p, s) for p, seqs in paths.items() for s in seqs]
    events = [("hot", 10), ("hot", 11), ("hot", 100), ("cold", 5), ("new", 50)]
    rows = spark.createDataFrame(asked, "path string, commit_seq long")
    given = spark.createDataFrame([(p, s, (s, f"{p}{s}")) for p, s in events], "path string, commit_seq long, event struct<commit_seq: long, to: string>")
    want = [(p, s, max((e for q, e in events if q == p and e < s), default=None)) for p, s in asked]
    got = [(r["path"], r["commit_seq"], r["event"] and r["event"]["commit_seq"]) for r in lineage._newest(rows, given, eras).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_path_is_split_over_eras(spark):
    rows = spark.range(2000).select(F.lit("hot").alias("path"), F.col("id").alias("commit_seq"))
    none = rows.limit(0).withColumn("event", F.struct("commit_seq", F.lit("").alias("to")))
    spread = lineage._eras(rows, "commit_seq", 8).groupBy("era").count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 400
    assert lineage._newest(rows, none, 8).where("event is null").count() == 2000


def test_changes_without_a_next_file_stay_out_of_joins(spark):
    rows = [(i, "M", f"p{i % 9}", None) for i in range(100)] + [(200, "R", "p3", "p1"), (150, "R", "p1", "p0")]
    found = lineage.follow_renames(spark.createDataFrame(rows, "commit_seq long, status string, path string, old_path string"), spark.createDataFrame([(f"p{i}",) for i in range(9)], "path string"))
    assert "isnull(next" in shown(found).replace("#", "").lower() and "Union" in shown(found)
    assert found.count() == 102


CHANGES = [("a/b/x", 1, 7, "2001-01-01", 1, 2), ("a/b/x", 1, 7, "2001-01-01", 3, 4), ("a/b/y", 1, 7, "2001-01-01", None, 2), ("a/z", 2, 7, "2003-05-01", 1, 1), ("top", 3, 8, "2003-05-01", 1, 0), ("a/b/x", 4, 9, "2003-06-01", 0, 0), ("a/b/x", 5, 9, "2003-06-01", 0, 0), ("a/b/y", 6, 6, "2003-06-01", 0, 0)]


@pytest.fixture(scope="module")
def changes(spark):
    rows = spark.createDataFrame(CHANGES, "path string, commit long, author long, at string, added long, removed long")
    return rows.withColumn("changed_at", F.to_timestamp("at")).drop("at")


def given_numbers(df) -> list[int]:
    return [int(n) for n in re.findall(r"(\d+)\), REPARTITION_BY_NUM", shown(df))]


def test_shuffles_of_changes_have_tasks_by_size(spark, changes):
    files = changes.select("path", F.lit(3).alias("lines"), F.lit(True).alias("covered")).distinct()
    n = tasks_for(changes)
    assert given_numbers(history.co_change(changes)) and set(given_numbers(history.co_change(changes))) == {n}
    assert set(given_numbers(history.file_rows(files, changes))) == {n}
    assert set(given_numbers(history.concentration(changes, F.lit(False)))) == {n}
    large = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    assert tasks_for(large) > tasks_for(spark.read.parquet(f"{SMALLEST}/lineitem.parquet")) == 1
    assert "Expand" not in shown(history.file_rows(files, changes))


def test_concentration_needs_no_order_of_all_authors(changes):
    commits = defaultdict(lambda: defaultdict(set))
    for path, commit, author, *_ in CHANGES:
        parts = path.split("/")[:-1]
        for d in [".", *["/".join(parts[: i + 1]) for i in range(len(parts))]]:
            commits[d][author].add(commit)
    want = []
    for d, by in commits.items():
        sizes, before, few = sorted((len(c) for c in by.values()), reverse=True), 0, 0
        for n in sizes:
            few += before * 5 < sum(sizes) * 4
            before += n
        want.append((d, sum(sizes), int(sizes[0] * 100 / sum(sizes) + 0.5) / 100, few))
    df = history.concentration(changes, F.lit(False))
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert "author" not in "".join(x for x in shown(df).splitlines() if "Window" in x)


def test_years_come_from_the_counts(changes):
    df = history.commits_by_year(changes)
    got = {(r["path"], r["year"]): r["commits"] for r in df.collect()}
    assert got[".", 2001] == 1 and got[".", 2002] == 0 and got[".", 2003] == 5 and got["a/b", 2003] == 3 and len(got) == 9
    assert "changed_at" not in shown(df)  # the changes are read once, for what is kept


def test_closures_broadcast_nothing(spark):
    pairs = spark.createDataFrame([(k, k // 2) for k in range(2, 40)], "sub long, super long")
    declared = pairs.select(F.col("super").alias("owner"), F.lit("m").alias("method")).distinct()
    seen = []
    real = resolve.checkpointed

    def kept(df):
        seen.append(shown(df))
        return real(df)

    resolve.checkpointed = kept
    try:
        closure = resolve.subtype_closure(pairs)
        seen.append(shown(resolve.nearest_declaring(closure, declared)))
        bindings = pairs.select(F.col("sub").cast("string").alias("path"), F.lit("X").alias("name"), F.col("super").cast("string").alias("from_path"), F.lit("X").alias("from_name"))
        assert resolve.follow_bindings(bindings, spark.createDataFrame([("1", "X")], "path string, name string")).count() == 38
    finally:
        resolve.checkpointed = real
    assert closure.count() == sum(k.bit_length() - 1 for k in range(2, 40))
    assert any("SortMergeJoin" in x for x in seen) and not any("BroadcastHashJoin" in x for x in seen)


def test_identifier_words_in_one_pass(spark):
    cut = lambda t: re.sub("([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub("([a-z0-9])([A-Z])", r"\1_\2", t))
    texts = ["", "  ", "a", "aB", "ABc", "HTTPServer", "ABC123def", "A1B", "a1Bc2D", "éAb", "aÉB", "__a__B", "İstanbulK", "ABcDEFgh12IJ", "ſK", "x-Y", "Aé", "A\u0000b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.split_identifier(F.col("t")).alias("w"))
    assert {r["t"]: r["w"] for r in df.collect()} == {t: [w.lower() for w in re.split("[^A-Za-z0-9]+", cut(t)) if w] for t in texts}
    began = time.monotonic()
    long = spark.range(1).select(F.repeat(F.lit("X"), 400_000).alias("t"), F.lit(None).cast("string").alias("none"))
    r = long.select(F.size(text.split_identifier(F.col("t"))).alias("n"), text.split_identifier(F.col("none")).alias("none")).first()
    assert (r["n"], r["none"]) == (1, None) and time.monotonic() - began < 20


def test_levels_move_edges_for_large_frontiers_only(spark, monkeypatch):
    rows = [(i, i + 1, "t") for i in range(12)] + [(0, 3, "t"), (0, 3, "t")]
    edges, seeds = spark.createDataFrame(rows, "source long, target long, type string"), spark.createDataFrame([(0,)], "node long")
    plans, real = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: plans.append(shown(df)) or real(df))
    want = sorted([(0, 0), (1, 1), (3, 1), (2, 2), (4, 2), (5, 3)])
    assert sorted(map(tuple, graph.levels(edges, seeds, 3).collect())) == want
    assert all(x.count("BroadcastHashJoin") == 2 for x in plans[2:])
    monkeypatch.setattr(graph, "FEW_NODES", 0)
    plans.clear()
    assert sorted(map(tuple, graph.levels(edges, seeds, 3).collect())) == want
    assert not any("BroadcastHashJoin" in x for x in plans)
    plans.clear()
    assert graph.shortest_path(edges, [0], [2], 8).count() == 3
    assert len(plans) == 4  # edges, seeds and two levels: nothing beyond the target
    assert graph.shortest_path(edges, [0], [0, 2], 8).count() == 1


def test_communities_of_many_neighbours_as_by_single_steps(spark, monkeypatch):
    pairs = [(i, j) for i in range(70) for j in range(70) if i != j and (i * 31 + j * 17) % 5 < (4 if i % 3 == j % 3 else 1)]
    edges, components = spark.createDataFrame(pairs, "source long, target long"), spark.range(70).select(F.col("id").alias("node"), F.lit(0).alias("component"))
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    total, group, weight = 2 * len(pairs), {n: n for n in near}, {n: len(v) for n, v in near.items()}
    for _ in range(20):
        before = dict(group)
        for n in sorted(near):
            links: dict = {}
            for m in near[n]:
                links[group[m]] = links.get(group[m], 0) + 1
            weight[own := group[n]] -= len(near[n])
            group[n] = min({*links, own}, key=lambda g: (weight[g] * len(near[n]) / total - links.get(g, 0), g != own, g))
            weight[group[n]] += len(near[n])
        if group == before:
            break
    want = sorted((n, min(m for m in group if group[m] == g)) for n, g in group.items())
    assert len({c for _, c in want}) > 1 and max(map(len, near.values())) > graph.FEW_NEIGHBOURS
    assert sorted(map(tuple, graph.communities(edges, components).collect())) == want
    monkeypatch.setattr(graph, "FEW_NEIGHBOURS", 10**9)
    assert sorted(map(tuple, graph.communities(edges, components).collect())) == want


@pytest.mark.parametrize("few", [0, 40, 1 << 17])
def test_strong_components_of_few_edges_in_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    pairs = [(f"n{i}", f"n{(i * 7 + 3) % 60}") for i in range(60)] + [(f"n{i}", f"n{i // 2}") for i in range(60)] + [("t1", "t2"), ("t2", "t3")]
    nodes = sorted({n for p in pairs for n in p} | {"alone"})
    ahead = defaultdict(set)
    for a, b in pairs:
        ahead[a].add(b)

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            for m in ahead[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    reached = {n: reach(n) for n in nodes}
    want = [(n, min(m for m in reached[n] if n in reached[m])) for n in nodes]
    rounds, real = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: rounds.append(1) or real(df))
    got = graph.strong_components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(pairs, "source string, target string"))
    assert sorted(map(tuple, got.collect())) == want
    assert (len(rounds) == 4) == (few > 1000)


def test_only_wanted_tokens_are_shuffled(spark):
    texts = spark.createDataFrame([("f", "the cat\nof the the cat"), ("g", None)], "path string, text string")
    df = liveness.occurrences(texts, spark.createDataFrame([("the",), ("the",), ("x",)], "name string"))
    assert sorted(map(tuple, df.collect())) == [("the", "f", 1, 1), ("the", "f", 2, 2)]
    plan = shown(df)
    assert plan.index("HashAggregate") < plan.index("BroadcastHashJoin")  # the join is below the counts
