"""Unused functions against plain graph walks in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import liveness

FUNCTIONS = "id string, name string, path string, start int, end int"
EDGES = "source string, target string, type string"


def reach(links, seeds):
    seen, queue = set(seeds), list(seeds)
    for x in queue:
        for y in links.get(x, ()):
            if y not in seen:
                seen.add(y)
                queue.append(y)
    return seen


def case(seed, n=40, m=60):
    rng = random.Random(seed)
    ids = [f"f{i:02}" for i in range(n)]
    functions = [(i, rng.choice(["run", "go", "get-it", "Top"]) if k % 3 else f"n{k}", f"p{k % 4}", 1 + 3 * (k // 4), 3 + 3 * (k // 4)) for k, i in enumerate(ids)]
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice(["calls", "calls", "calls", "implements", "overrides", "imports"])) for _ in range(m)]
    edges += [("r", rng.choice(ids), "routes"), ("r", rng.choice(ids), "invokes"), ("r", "elsewhere", "routes"), ("x", ids[0], "calls")]
    return ids, functions, edges


def expected(ids, edges):
    links, roots = {}, set()
    for s, t, k in edges:
        if k in ("routes", "invokes") and t in ids:
            roots.add(t)
        if k in ("calls", "implements", "overrides") and s in ids and t in ids:
            links.setdefault(s, set()).add(t)
            if k != "calls":
                links.setdefault(t, set()).add(s)
    left = set(ids) - reach(links, roots)
    inner = {s: t & left for s, t in links.items() if s in left}
    ahead = {i: reach(inner, [i]) for i in left}
    component = {i: min(j for j in ahead[i] if i in ahead[j]) for i in left}
    entered = {component[t] for s, ts in inner.items() for t in ts if component[s] != component[t]}
    return left, inner, component, {i: component[i] not in entered for i in left}


@pytest.mark.parametrize("seed", range(2))
def test_candidates_and_report(spark, seed):
    ids, functions, edges = case(seed)
    left, inner, component, entry = expected(ids, edges)
    f, e = spark.createDataFrame(functions, FUNCTIONS), spark.createDataFrame(edges, EDGES)
    found, refs = liveness.candidates(f, e)
    assert {r["id"]: (r["component"], r["entry"]) for r in found.collect()} == {i: (component[i], entry[i]) for i in left}
    totals = liveness.candidate_totals(f, found, refs).first()
    assert (totals["functions"], totals["reachable"], totals["candidates"], totals["entry_components"]) == (len(ids), len(ids) - len(left), len(left), len({component[i] for i in left if entry[i]}))
    some = sorted(left)
    decisions = [(some[0], "entry"), (some[-1], "test-entry")]
    d = spark.createDataFrame(decisions, "id string, kind string")
    by_entry, by_test = reach(inner, [some[0]]), reach(inner, [some[-1]])
    status = {i: "removed" if i in by_entry else "test-only" if i in by_test else "unused" for i in left}
    assert dict(map(tuple, liveness.statuses(found, refs, d).collect())) == status
    level = {i: k % 3 for k, i in enumerate(some)}
    unused = {i for i in left if status[i] == "unused"}
    capped = {i: min(level[j] for j in unused if i in reach({s: t & unused for s, t in inner.items()}, [j])) for i in unused}
    got = {r["id"]: r for r in liveness.report(found, refs, d, spark.createDataFrame(list(level.items()), "id string, level int")).collect()}
    assert {i: r["confidence"] for i, r in got.items()} == {i: ["low", "medium", "high"][c] for i, c in capped.items()}
    assert all(r["group"] <= i and r["entry"] == entry[i] for i, r in got.items())
    problems = liveness.check_decisions(found, d.union(d.limit(1)).union(spark.createDataFrame([("nobody", "entry")], "id string, kind string")))
    assert sorted(map(tuple, problems.collect())) == sorted([("nobody", "not-a-candidate"), (d.first()["id"], "repeated")])


def test_census(spark):
    ids, functions, edges = case(7)
    rng = random.Random(3)
    texts = [(f"p{k}", "\n".join(" ".join(rng.choices(["run", "go", "n3", "n6", "x.run()", "$run", "9go", "Top;"], k=rng.randrange(0, 5))) for _ in range(34))) for k in range(4)] + [("bin", None), ("other", "run\nrun go\n\nn3 n3")]
    left, inner, _, _ = expected(ids, edges)
    place = {i: (name, path, a, b) for i, name, path, a, b in functions}
    want = {}
    for i in left:
        name, path, a, b = place[i]
        if not re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", name):
            want[i] = None
            continue
        spans = [place[s][1:] for s, ts in inner.items() if i in ts]
        n = 0
        for p, t in texts:
            own = False
            for k, line in enumerate((t or "").split("\n"), 1):
                for token in re.findall(r"[A-Za-z_$][A-Za-z0-9_$]*", line):
                    if token != name:
                        continue
                    first = p == path and a <= k <= b and not own
                    own = own or first
                    if any(p == q and x <= k <= y for q, x, y in spans) or first:
                        continue
                    n += 1
        want[i] = n
    f, e = spark.createDataFrame(functions, FUNCTIONS), spark.createDataFrame(edges, EDGES)
    found, refs = liveness.candidates(f, e)
    assert {r["id"]: r["elsewhere"] for r in liveness.census(found, f, refs, spark.createDataFrame(texts, "path string, text string")).collect()} == want


def test_confidence_signals(spark):
    rows = [("private", 0, 0, 0, 0, 0, False), ("public", 0, 0, 0, 0, 0, False), ("private", 2, 0, 0, 0, 0, False), ("public", 0, 0, 0, 1, 0, True), ("public", 0, 0, 0, 1, 0, False), (None, None, None, 0, 0, 0, False), ("private", 0, 0, 3, 0, 0, False)]
    df = spark.createDataFrame(rows, "visibility string, elsewhere int, annotations int, owner_uses int, outside int, below int, static boolean")
    from corvane.operators.graph import own_confidence

    have = {c: F.col(c) for c in df.columns}
    assert [r[0] for r in df.select(own_confidence(liveness.confidence_signals(**have))).collect()] == ["high", "medium", "low", "medium", "low", "medium", "low"]
