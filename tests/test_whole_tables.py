"""Queries over whole tables against brute force in Python, where the SQL covers a part of the rows only."""

from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from corvane.operators import facts
from corvane.plans import fact_queries, graph_queries

ORDERS = [(1, 3), (2, 3), (7, 4), (14, 5), (15, 4)]
LINES = [(1, 1, 1), (1, 2, 2), (1, 3, 1), (2, 1, 2), (2, 2, 3), (7, 1, 4), (7, 2, 5), (14, 1, 5), (15, 1, 6), (15, 2, 4), (97, 1, 7), (97, 3, 8)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A few orders, of which the seventh ones are a part, with several lines each; suppliers 7 to 12 are apart."""
    at = tmp_path_factory.mktemp("tables")
    tables = {
        "nation": ([(0, 0), (1, 1), (2, 3)], "n_nationkey long, n_regionkey long"),
        "supplier": ([(i, i % 3) for i in range(1, 13)], "s_suppkey long, s_nationkey long"),
        "customer": ([(3, 0), (4, 1), (5, 2)], "c_custkey long, c_nationkey long"),
        "orders": (ORDERS, "o_orderkey long, o_custkey long"),
        "lineitem": (LINES, "l_orderkey long, l_linenumber int, l_suppkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def read(folder, name, *columns):
    t = pq.read_table(f"{folder}/{name}.parquet", columns=list(columns))
    return list(zip(*(t[c].to_pylist() for c in columns), strict=True))


def links(folder):
    """(source, target, type) of the containment graph."""
    e = [(f"r{r}", f"n{n}", "contains") for n, r in read(folder, "nation", "n_nationkey", "n_regionkey")]
    e += [(f"n{n}", f"s{s}", "contains") for s, n in read(folder, "supplier", "s_suppkey", "s_nationkey")]
    e += [(f"n{n}", f"c{c}", "contains") for c, n in read(folder, "customer", "c_custkey", "c_nationkey")]
    e += [(f"c{c}", f"o{o}", "calls") for o, c in read(folder, "orders", "o_orderkey", "o_custkey")]
    return e + [(f"o{o}", f"s{s}", "similar") for o, s in read(folder, "lineitem", "l_orderkey", "l_suppkey")]


def follows(folder):
    """Pairs of suppliers of lines next to each other in an order."""
    at = {(o, i): s for o, i, s in read(folder, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey")}
    return {(s, at[o, i + 1]) for (o, i), s in at.items() if (o, i + 1) in at}


def steps(pairs, both=False):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
        if both:
            out[b].add(a)
    return out


def hops(step, seeds, limit=99):
    seen = dict.fromkeys(seeds, 0)
    todo = list(seeds)
    for n in todo:
        for m in step[n] if seen[n] < limit else ():
            if m not in seen:
                seen[m] = seen[n] + 1
                todo.append(m)
    return seen


SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("tables", ["fixture", SMALLEST])
def test_containment_graph(spark, folder, tables):
    where = folder if tables == "fixture" else tables
    q = graph_queries.queries()
    got = lambda name: sorted(map(tuple, q[name](spark, where).collect()))
    e = links(where)
    everything, followed = steps([x[:2] for x in e], True), steps([x[:2] for x in e if x[2] != "similar"], True)
    assert sorted(map(tuple, graph_queries.edges(spark, where).collect())) == sorted(e)
    assert got("distances") == sorted(hops(everything, ["o7"]).items())
    assert got("bounded_bfs") == sorted(hops(followed, ["r1"], 2).items())
    near = hops(followed, ["n1", "s3"], 1)
    assert got("one_hop") == sorted((n,) for n in near)
    assert sorted(map(tuple, q["induced_edges"](spark, where).select("source", "target", "type").collect())) == sorted(x for x in e if x[0] in near and x[1] in near)
    assert got("shortest_path_length") == [(hops(everything, ["r0"])["r3"],)]
    boundary = dict(got("traverse_boundary"))
    ball = hops(everything, ["r1"], 2)
    if len(ball) <= 40:
        assert boundary["nodes"] == str(len(ball))
    else:
        assert (boundary["reason"], boundary["nodes"]) == ("node-budget", "40")


@pytest.mark.parametrize("tables", ["fixture", SMALLEST])
def test_supplier_graph(spark, folder, tables):
    where = folder if tables == "fixture" else tables
    q = graph_queries.queries()
    got = lambda name: sorted(map(tuple, q[name](spark, where).collect()))
    pairs, nodes = follows(where), [s for (s,) in read(where, "supplier", "s_suppkey")]
    ahead, around = steps(pairs), steps(pairs, True)
    reach = {n: hops(ahead, [n]) for n in nodes}
    weak = {n: min(hops(around, [n])) for n in nodes}
    from_roots = hops(ahead, [n for n in nodes if n % 50 == 1])
    assert sorted((r["source"], r["target"]) for r in graph_queries.sparse(spark, where).collect()) == sorted(pairs)
    assert got("weak_components") == sorted(weak.items())
    assert got("strong_components") == sorted((n, min(m for m in reach[n] if n in reach[m])) for n in nodes)
    assert got("reachable") == sorted((n,) for n in from_roots)
    assert got("unreachable") == sorted((n,) for n in nodes if n not in from_roots)
    level = {n: 0 if n % 40 == 0 else 1 if n % 9 == 0 else 2 for n in nodes}
    assert got("propagate_confidence") == sorted((n, min(level[m] for m in nodes if n in reach[m])) for n in nodes)
    depth = hops(ahead, [1], 3)
    want, place = [], defaultdict(int)
    for n in sorted(depth, key=lambda n: (depth[n], -len({a for a, b in pairs if b == n}), n)):
        place[depth[n]] += 1
        want.append((n, depth[n], place[depth[n]]))
    assert got("reading_order") == sorted(want)
    loose = {n for n in nodes if around[n] - {n}}
    assert got("communities_cover") == [(len(loose), len(loose), True)]


def test_overlapping_steps(spark):
    nodes = defaultdict(list)
    for r in facts.declaration_nodes(fact_queries.decls(spark, SMALLEST)).collect():
        nodes[r["path"]].append((r["id"], r["start"], r["end"]))
    calls = {(f"o{o}", i * 10 + 5, f"f{s % 45}") for o, i, s in read(SMALLEST, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey")}
    want = []
    for path, line, callee in calls:
        hit = [n for n, start, end in nodes[path] if line <= end and start <= line + 8]
        want += [(f"{path}:{line}:{callee}", n) for n in hit or [f"file:{path}"]]
    got = fact_queries.queries()["overlapping_steps"](spark, SMALLEST).select("step", "id").collect()
    assert sorted(map(tuple, got)) == sorted(want)
