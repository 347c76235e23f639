"""Validation, closure and verdict queries over whole tables against brute force in Python."""

from collections import defaultdict
from itertools import combinations

from corvane.plans import audit_queries, change_queries, fact_queries
from tests.test_whole_tables import SMALLEST, hops, read, steps


def rows(spark, module, name, *columns):
    return sorted(map(tuple, module.queries()[name](spark, SMALLEST).select(*columns).collect()), key=repr)


def test_shared_ranges(spark):
    cited = defaultdict(set)
    for path, feature, part, quantity in read(SMALLEST, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_quantity"):
        cited[path].add((feature, part % 60, part % 60 + int(quantity)))
    want = []
    for path, ranges in cited.items():
        if len({f for f, _, _ in ranges}) > 3:
            continue
        shared = defaultdict(set)
        for x in ranges:
            for y in ranges:
                if x[0] < y[0] and x[1] <= y[2] and y[1] <= x[2]:
                    shared[x[0], y[0]].update(range(max(x[1], y[1]), min(x[2], y[2]) + 1))
        for (a, b), lines in shared.items():
            want += [(path, a, b, n, next(m for m in range(n, 999) if m + 1 not in lines)) for n in lines if n - 1 not in lines]
    assert rows(spark, audit_queries, "shared_ranges", "path", "a", "b", "start", "end") == sorted(want, key=repr)


def test_dictionary_mismatches(spark):
    values = defaultdict(set)
    for app, name, key in read(SMALLEST, "customer", "c_nationkey", "c_mktsegment", "c_custkey"):
        values[name.replace("_", "").lower(), app].add(key % 50)
    want = [(n, a, b, len(x - y), len(y - x), len(x & y)) for ((n, a), x), ((m, b), y) in combinations(sorted(values.items()), 2) if n == m]
    assert rows(spark, audit_queries, "dictionary_mismatches", "name", "left", "right", "only_left", "only_right", "both") == sorted(want, key=repr)


def test_closure_and_nearest(spark):
    parts = read(SMALLEST, "part", "p_partkey", "p_size")
    up = steps({(k, k // n) for k, _ in parts for n in (2, 3) if k // n > 0})
    above = {k: hops(up, [k]) for k, _ in parts}
    assert rows(spark, fact_queries, "subtype_closure", "sub", "super", "depth") == sorted(((k, s, d) for k, v in above.items() for s, d in v.items() if d), key=repr)
    declares = {k: size for k, size in parts if k % 7 == 0}
    best = {}
    for k, v in above.items():
        for s, d in v.items():
            if s in declares:
                best[k, declares[s]] = min(best.get((k, declares[s]), (d, s)), (d, s))
    assert rows(spark, fact_queries, "nearest_declaring", "sub", "method", "owner") == sorted(((k, m, s) for (k, m), (_, s) in best.items()), key=repr)


def test_verdict_overlay_keeps_whole_texts(spark):
    texts = dict(read(SMALLEST, "documents", "doc_id", "text"))
    toxic = dict(read(SMALLEST, "labels", "doc_id", "toxic"))
    got = dict(rows(spark, change_queries, "verdict_overlay", "id", "summary"))
    assert got == {i: None if toxic.get(i) == 1 else t for i, t in texts.items()}
