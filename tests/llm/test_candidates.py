"""Candidate search: bitmaps and their bound, cells, hubs, recall of the bands, rows without an id."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import components, line_dedup, minhash, set_pairs


def sets_and_members(rng, n=120, low=1, high=400):
    base = [rng.sample(range(10**9), rng.randrange(low, high)) for _ in range(6)]
    out = []
    for _ in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, len(own) // 20, len(own) // 8, len(own) // 4])):
            own[rng.randrange(len(own))] = rng.randrange(10**9)
        out.append(sorted(set(own)))
    return out


def bitmaps(sets):
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.array([x for s in sets for x in s], np.uint64)
    return set_pairs.parity_bitmaps(rows, set_pairs_hash(values), len(sets))


def set_pairs_hash(values):
    from corvane.llm.arrays import mix64

    return mix64(values)


def similar(s, t, per_cent=80):
    return 100 * len(set(s) & set(t)) >= per_cent * len(set(s) | set(t))


def test_bound_never_rejects_a_similar_pair():
    sets = sets_and_members(random.Random(1))
    members = set_pairs.Members(np.array([len(s) for s in sets]), bitmaps(sets))
    x, y = map(np.array, zip(*itertools.combinations(range(len(sets)), 2), strict=True))
    keep, bound = members.possible(x, y, 80)
    allowed = set(zip(x[keep].tolist(), y[keep].tolist(), strict=True))
    true = {(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True) if similar(sets[a], sets[b])}
    assert true <= allowed and len(allowed) <= len(true) + 0.1 * len(x)
    for a, b, d in zip(x[keep], y[keep], bound, strict=True):
        assert d <= len(set(sets[a]) ^ set(sets[b]))


@pytest.mark.parametrize(("block", "each"), [(4096, 4), (7, 1), (40, 1)])
def test_links_of_buckets_connect_what_is_similar(spark, block, each):
    rng = random.Random(block + each)
    sets = sets_and_members(rng, 90, 5, 60)
    buckets = [(b, i) for b in range(4) for i in range(len(sets)) if b == 0 or rng.random() < 0.3]
    members = spark.createDataFrame(buckets, "bucket long, node long")
    traits = spark.createDataFrame([(i, len(s), bytes(m)) for i, (s, m) in enumerate(zip(sets, bitmaps(sets).to_pylist(), strict=True))], "node long, n long, bits binary")
    asked = []

    def confirm(pairs):
        own = [tuple(r) for r in pairs.collect()]
        assert len(own) == len(set(own)) and all(a < b for a, b in own) and not set(own) & set(asked)
        asked.extend(own)
        return spark.createDataFrame([p for p in own if similar(sets[p[0]], sets[p[1]])], "a long, b long")

    links = components.link_buckets(members, traits, confirm, 80, block=block, pairs_each=each)
    got = dict(map(tuple, components.components(links, "a", "b").collect()))
    want = {i: i for i in range(len(sets))}
    for _ in sets:
        for a, b in itertools.combinations(range(len(sets)), 2):
            if similar(sets[a], sets[b]):
                want[a] = want[b] = min(want[a], want[b])
    assert {i: got.get(i, i) for i in want} == want


def test_hubs_are_handled_apart(spark):
    pairs = [(0, i) for i in range(1, 60)] + [(i, i + 100) for i in range(1, 60)] + [(300, 301)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    got = dict(map(tuple, components.components(edges, hub=10).collect()))
    assert got == {i: 0 for i in range(60)} | {i + 100: 0 for i in range(1, 60)} | {300: 300, 301: 300}


def test_lines_that_differ_in_a_character(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choices("abcdefghij klmnop", k=90)) for _ in range(30)]
    docs = [(0, "\n".join(lines)), (1, "\n".join(x[:30] + "Z" + x[31:] for x in lines))]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == 0 and got[1]["n_removed"] >= 29


def test_recall_of_the_bands():
    """Pairs between 0.80 and 0.85 share a band, of lines and of documents."""
    rng, n = random.Random(4), 800
    for bands, rows in ((line_dedup.BANDS, line_dedup.ROWS), (minhash.BANDS, minhash.ROWS)):
        sets, found = [], 0
        for _ in range(n):
            m = rng.randrange(20, 300)
            s = rng.sample(range(10**12), m)
            changed = int(m * rng.uniform(0.085, 0.11))
            sets += [s, s[changed:] + rng.sample(range(10**12), changed)]
        r = np.repeat(np.arange(2 * n), [len(s) for s in sets])
        b = minhash.band_hashes(minhash.one_permutation(r, set_pairs_hash(np.array([x for s in sets for x in s], np.uint64)), 2 * n, bands * rows), bands)
        found = int((b[::2] == b[1::2]).any(axis=1).sum())
        assert found >= 0.99 * n


def test_exact_windows_do_not_overflow():
    code = np.array([5, 3, 5, 3, 5, 3, 1] * 3)
    for kinds, k in ((6, 3), (1 << 31, 5), (1 << 40, 7)):
        key = set_pairs.exact_windows(code, kinds, k)
        runs = [tuple(code[i : i + k]) for i in range(len(code) - k + 1)]
        assert len(key) == len(runs)
        assert all((key[i] == key[j]) == (runs[i] == runs[j]) for i in range(len(runs)) for j in range(len(runs)))
    assert len(set_pairs.exact_windows(code[:1], 6, 3)) == 0


def test_rows_without_an_id(spark, odd_docs):
    more = odd_docs.union(odd_docs.withColumn("doc_id", F.lit(None).cast("long")))
    near = minhash.near_duplicates(more, k=2)
    assert near.count() == more.count()
    assert all(r["kept"] and r["component_id"] is None for r in near.where("doc_id is null").collect())
    lines = line_dedup.dedup_lines(more)
    assert lines.where("doc_id is null and n_removed > 0").count() == 0 and lines.count() == more.count()


def test_stages_keep_clashing_columns(spark):
    schema = "doc_id long, text string, n_removed long, n_lines string, gone double, kept boolean, node long, h1 int"
    rows = [(1, "a line of words that is long enough\nanother line of words here", 7, "x", 0.5, False, 9, 3), (2, "a line of words that is long enough\nnew line altogether, with words", 8, "y", 1.5, True, 8, 4)]
    docs = spark.createDataFrame(rows, schema)
    got = {r["doc_id"]: tuple(r) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got == {1: rows[0], 2: (2, "new line altogether, with words", *rows[1][2:])}
    assert sorted(map(tuple, minhash.drop_near_duplicates(docs).collect())) == rows


def test_members_of_batches_that_were_sliced():
    sets = [[1, 2, 3], [1, 2, 3], [4], list(range(100))]
    bits = pa.array([b"junk", *bitmaps(sets).to_pylist()], pa.binary()).slice(1)
    assert set_pairs.Members(np.array([3, 3, 1, 100]), bits).differing(np.array([0, 0, 3]), np.array([1, 2, 2])).tolist() == [0, 4, bin(0).count("1") + set_pairs.Members(np.array([3, 3, 1, 100]), bits).differing(np.array([3]), np.array([2])).tolist()[0]]


def test_only_crowded_buckets_are_searched_again(spark, monkeypatch):
    """A bucket that gave all its pairs isn't dealt out again, whatever the others do."""
    sets = [list(range(100 * i, 100 * i + 40)) for i in (0, 0, 0, 0, 0, 0, 1, 2, 3)]
    for i, s in enumerate(sets[:6]):
        s[i] = 10**6 + i
    members = spark.createDataFrame([(0, i) for i in range(6)] + [(1, i) for i in (6, 7, 8)] + [(0, 8)], "bucket long, node long")
    traits = spark.createDataFrame([(i, len(s), bytes(m)) for i, (s, m) in enumerate(zip(sets, bitmaps(sets).to_pylist(), strict=True))], "node long, n long, bits binary")
    dealt, deal = [], components._cells
    monkeypatch.setattr(components, "_cells", lambda labelled, block: dealt.append({r["bucket"] for r in labelled.collect()}) or deal(labelled, block))
    confirm = lambda pairs: spark.createDataFrame([tuple(r) for r in pairs.collect() if r["a"] and similar(sets[r["a"]], sets[r["b"]])], "a long, b long")
    links = components.link_buckets(members, traits, confirm, 80, pairs_each=1)
    got = dict(map(tuple, components.components(links, "a", "b").collect()))
    assert got == {i: 1 for i in range(1, 6)}
    assert dealt[0] == {0, 1} and len(dealt) > 1 and all(d == {0} for d in dealt[1:])
