"""Packed pairs of buckets and nodes (operator 8): the members of shared buckets, and common buckets that aren't gathered."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import line_dedup, set_pairs


def batches(rows, size=50):
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.int64()), pa.array([np.array(b, np.int64).tobytes() for _, b in part], pa.binary())], ["node", "buckets"])


def merged(tasks, slots, most):
    """What the workers pack, by slot as Spark hands it on."""
    rows = [r for rows in tasks for batch in line_dedup.packed_buckets(slots, most)(batches(rows)) for r in batch.to_pylist()]
    return sorted(rows, key=lambda r: r["slot"])


def members(rows):
    whole = [pa.RecordBatch.from_pylist(rows[i : i + 3], pa.schema([("slot", pa.int32()), ("pairs", pa.binary())])) for i in range(0, len(rows), 3)]
    return {(r["bucket"], r["node"]) for batch in line_dedup.shared_buckets(iter(whole)) for r in batch.to_pylist()}


@pytest.mark.parametrize(("slots", "most"), [(2, 1 << 20), (64, 1 << 20), (8, 100)])
def test_members_of_shared_buckets(slots, most):
    rng = random.Random(slots + most)
    values = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(900)]
    nodes = {rng.randrange(-(1 << 63), 1 << 63): rng.sample(values, 3) for _ in range(300)}
    tasks = [rng.choices(list(nodes.items()), k=150) for _ in range(4)]  # equal nodes in several tasks
    seen = {}
    for n, buckets in (r for rows in tasks for r in rows):
        for b in buckets:
            seen.setdefault(b, set()).add(n)
    assert members(merged(tasks, slots, most)) == {(b, n) for b, own in seen.items() if len(own) > 1 for n in own}
    assert members(merged([[]], slots, most)) == set()


def test_common_buckets_are_not_gathered():
    tasks = [[(1000 * t + i, [7, 10**6 * t + i]) for i in range(1000)] for t in range(1, 5)]
    rows = merged(tasks, 64, 1 << 20)
    common = [np.frombuffer(r["pairs"], np.int64).reshape(2, -1) for r in rows if r["slot"] >= 0]
    assert sum(int((p[0] == 7).sum()) for p in common) == 8
    assert members(rows) == {(7, n) for own in tasks for n, _ in own}


@pytest.mark.parametrize("kind", [np.int64, np.uint64])
def test_distinct_elements_of_wide_keys(kind):
    rng = np.random.default_rng(8)
    row, key = rng.integers(0, 1 << 14, 5000), rng.integers(0, 1 << 62, 40).astype(kind)[rng.integers(0, 40, 5000)]
    got = set_pairs.distinct_elements(row, key)
    assert got[1].dtype == kind and list(zip(*(c.tolist() for c in got), strict=True)) == sorted(set(zip(row.tolist(), key.tolist(), strict=True)))
    assert all(len(c) == 0 for c in set_pairs.distinct_elements(row[:0], key[:0]))
