"""Rename lineage against a walk over the commits, one by one."""

import random
from collections import Counter

import pytest

from corvane.operators import lineage

SCHEMA = "commit_seq long, status string, path string, old_path string"


def walk(history, selected):
    """Current file of each change, and conflicts by file, newest commit first."""
    now, cut, found, bad = {p: p for p in selected}, {}, {}, Counter()
    for seq in sorted({c[0] for c in history}):
        rows = [c for c in history if c[0] == seq]
        for _, status, path, _ in rows:
            found[seq, path] = now.get(path)
        for _, status, path, _ in rows:
            if found[seq, path] is None and path in cut:
                if status == "D":
                    del cut[path]
                else:
                    bad[cut[path]] += 1
        for _, status, path, _ in rows:
            if status in "ACR" and path in now:
                cut[path] = now.pop(path)
        for _, status, path, old in rows:
            if status == "R":
                target, held = found[seq, path], now.get(old)
                if target is None:
                    if held is not None:
                        bad[held] += 1
                        del now[old]
                    continue
                if held not in (None, target):
                    bad[held] += 1
                    bad[target] += 1
                now[old] = target
                cut.pop(old, None)
    return found, dict(bad)


def check(spark, history, selected):
    df, chosen = spark.createDataFrame(history, SCHEMA), spark.createDataFrame([(p,) for p in selected], "path string")
    want, conflicts = walk(history, selected)
    assert {(r["commit_seq"], r["path"]): r["current"] for r in lineage.follow_renames(df, chosen).collect()} == want
    assert dict(map(tuple, lineage.lineage_conflicts(df, chosen).collect())) == conflicts


def test_rename_chain_and_new_file_of_an_old_name(spark):
    check(spark, [(0, "M", "c", None), (1, "R", "c", "b"), (2, "A", "a", None), (3, "M", "b", None), (4, "R", "b", "a"), (5, "M", "a", None), (6, "A", "a", None)], ["c", "a"])


def test_swap_and_cut(spark):
    check(spark, [(0, "R", "x", "y"), (0, "R", "y", "x"), (1, "M", "x", None), (1, "M", "y", None), (2, "R", "gone", "x"), (3, "M", "x", None)], ["x", "y"])


@pytest.mark.parametrize("seed", range(3))
def test_random_histories(spark, seed):
    rng, names, history = random.Random(seed), [f"p{i}" for i in range(9)], []
    for seq in range(60):
        paths = rng.sample(names, rng.randrange(1, 4))
        olds = rng.sample([n for n in names], len(paths))
        for p, o in zip(paths, olds, strict=True):
            status = rng.choice("MMMADRR")
            history.append((seq, status, p, o if status == "R" and o != p else None) if status != "R" or o != p else (seq, "M", p, None))
    check(spark, history, names[:6])


def test_long_chain_of_renames(spark):
    history = [(i, "R", f"n{i}", f"n{i + 1}") for i in range(40)] + [(40, "A", "n40", None)]
    df = spark.createDataFrame(history, SCHEMA)
    assert {r["current"] for r in lineage.follow_renames(df, spark.createDataFrame([("n0",)], "path string")).collect()} == {"n0"}
