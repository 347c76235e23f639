"""Benchmark decontamination by winnowing (operator 6).

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became lower case. A window
is ``window`` consecutive words of a benchmark item; a shorter item is one window. Of the
hashes of all k-grams, the least of each sliding stretch of ``window - k + 1`` is kept, on both
sides; any shared window holds a kept k-gram at the same place on both sides, so the join of
the fingerprints misses none. Each joined pair is then extended to the whole shared span,
word by word, and spans of a window or more are hits.

Words are compared through the benchmark's vocabulary: a document word outside it can't be in
a hit, and the others have exact numbers, so no hash decides a result.

The benchmark side is cut into blocks of ``BLOCK_BYTES`` of text at most, one at a time of which is
indexed on the driver and broadcast. One block is the rule, and then a single map does everything. With
several, each block's pass over the documents gives only the documents that it hits, and
those are joined with the documents in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.arrays import from_utf8, lengths_to_rows, mix64, pieces, space_words, sums, utf8_buffer, with_own_names
from corvane.llm.recovery import join_small, small_batches, stored, trimmed

WINDOW, GRAM = 10, 5
#: Benchmark text in one broadcast index.
BLOCK_BYTES = 16 << 20

_WORD_BYTES = np.full(256, 32, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _WORD_BYTES[_b] = _b
_WORD_BYTES[65:91] = np.arange(97, 123)


def item_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words, and all words."""
    data, offsets = utf8_buffer(texts)
    return space_words(from_utf8(_WORD_BYTES[data], offsets))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k codes."""
    h = np.zeros(max(0, len(codes) - k + 1), np.uint64)
    for i in range(k):
        h = mix64(h + codes[i : len(codes) - k + 1 + i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return h


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least hash, the last one of equals, in some stretch of ``width`` hashes."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    stretches = np.lib.stride_tricks.sliding_window_view(hashes, width)
    return np.unique(np.arange(len(stretches)) + width - 1 - np.argmin(stretches[:, ::-1], axis=1))


class BenchmarkIndex:
    """Fingerprints and words of one block of benchmark items."""

    def __init__(self, items: Sequence[tuple[str, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, min(gram, window)
        self.ids = [i for i, _ in items]
        offsets, words = item_words(pa.array([t for _, t in items], pa.string()))
        encoded = words.dictionary_encode()
        self.vocabulary = encoded.dictionary
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.item_of = lengths_to_rows(offsets)
        width = window - self.gram + 1
        found: list[tuple[np.uint64, int]] = []
        self.short: dict[int, dict[tuple, list[int]]] = {}
        for item, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            if b - a >= window:
                h = gram_hashes(self.codes[a:b], self.gram)
                found += [(h[p], int(a + p)) for p in winnow(h, width)]
            elif b > a:
                self.short.setdefault(int(b - a), {}).setdefault(tuple(self.codes[a:b].tolist()), []).append(item)
        found.sort()
        self.hashes = np.array([h for h, _ in found], np.uint64)
        self.places = np.array([p for _, p in found], np.int64)
        self.short_hashes = {m: np.unique(gram_hashes(np.array([c for k in keys for c in k], np.int64), m)[::m]) for m, keys in self.short.items()}

    def find(self, offsets: np.ndarray, words: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(first word, word behind, item) of each hit span in the documents' words."""
        found = pc.index_in(words, self.vocabulary)
        codes = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = lengths_to_rows(offsets)
        known = np.concatenate([[0], np.cumsum(codes >= 0)])
        yield from self._long(codes, row, known)
        for m, keys in self.short.items():
            inside = self._whole(codes, row, known, m)
            h = gram_hashes(codes, m)
            for p in np.flatnonzero(inside & np.isin(h, self.short_hashes[m])):
                for item in keys.get(tuple(codes[p : p + m].tolist()), ()):
                    yield int(p), int(p + m), item

    @staticmethod
    def _whole(codes: np.ndarray, row: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
        """Where k known words of one document begin."""
        n = len(codes) - k + 1
        return (known[k:] - known[:n] == k) & (row[k - 1 :] == row[:n]) if n > 0 else np.zeros(0, bool)

    def _long(self, codes: np.ndarray, row: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, int, int]]:
        if not len(self.hashes):
            return
        # only stretches of known words as long as a window can hold a hit: winnow those
        starts = np.flatnonzero(self._whole(codes, row, known, self.window))
        if not len(starts):
            return
        h = gram_hashes(codes, self.gram)
        stretches = np.lib.stride_tricks.sliding_window_view(h, self.window - self.gram + 1)
        picks: list[np.ndarray] = []
        for at in range(0, len(starts), 1 << 18):
            s = starts[at : at + (1 << 18)]
            picks.append(np.unique(s + self.window - self.gram - np.argmin(stretches[s][:, ::-1], axis=1)))
        picks_all = np.unique(np.concatenate(picks))
        low, high = np.searchsorted(self.hashes, h[picks_all], "left"), np.searchsorted(self.hashes, h[picks_all], "right")
        reached: dict[tuple[int, int], int] = {}
        for p, a, b in zip(picks_all[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            for q in self.places[a:b].tolist():
                key = (int(row[p]), p - q)
                if p < reached.get(key, -1):
                    continue
                begin, end = self._extend(codes, row, p, q)
                reached[key] = end
                if end - begin >= self.window:
                    yield begin, end, int(self.item_of[q])

    def _extend(self, codes: np.ndarray, row: np.ndarray, p: int, q: int) -> tuple[int, int]:
        mine, item_of, item, doc = self.codes, self.item_of, self.item_of[q], row[p]
        begin, i = p, q
        while begin > 0 and i > 0 and codes[begin - 1] == mine[i - 1] and row[begin - 1] == doc and item_of[i - 1] == item:
            begin, i = begin - 1, i - 1
        end, i = p, q
        while end < len(codes) and i < len(mine) and codes[end] == mine[i] and row[end] == doc and item_of[i] == item:
            end, i = end + 1, i + 1
        return begin, end


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct()


def _n_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> int:
    total = _items(benchmark, item_col, text_col).agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    return max(1, -(-total // limit))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> Iterator[list[tuple[str, str]]]:
    """The distinct items in n parts, of which one at a time is on the driver."""
    items = _items(benchmark, item_col, text_col)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        yield sorted((r["i"], r["t"]) for r in part.collect())


def mark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: Sequence[str] = (),
    window: int = WINDOW,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
    spans: bool = False,
) -> DataFrame:
    """Per document: id, ``keep``, n_words, n_hit, n_items, items_sha256, contaminated; with ``spans`` also the hit word spans and item ids.

    Null texts and texts without words have 0 of all; items that are null or without words are
    never hit, nor are items with a null id. Repeated items count by their distinct ids;
    repeated documents each get a row. With no items, or no documents, nothing is hit. A kept
    column that is called like a result gives way to it. With one block no shuffle, one map; with
    several a pass over the documents for each, and a join with the rows that were hit.
    """
    if block_bytes < 1:
        raise ValueError("block_bytes must be positive")
    spark = docs.sparkSession
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"]
    kept = [c for c in dict.fromkeys(keep) if c not in names and c != id_col]
    head = [f"__{i}" for i in range(len(kept) + 1)]  # own names inside, whatever the input's are
    fixed = ["__text", *head]
    small_batches(spark)
    df = docs.select(F.col(text_col).cast("string"), F.col(id_col), *map(F.col, kept), F.lit(None).cast("array<int>"), F.lit(None).cast("array<string>")).toDF(*fixed, "__at", "__items")
    found = "__at array<int>, __items array<string>"

    def search(index, out: list[str], all_rows: bool):
        def run(batches):
            for batch, texts in pieces(batches, "__text", 1 << 20):
                offsets, words = item_words(texts)
                row = lengths_to_rows(offsets)
                at: list = [None] * batch.num_rows
                items: list = [None] * batch.num_rows
                for a, b, item in index.value.find(offsets, words):
                    d = int(row[a])
                    at[d] = [*(at[d] or ()), a - int(offsets[d]), b - int(offsets[d])]
                    items[d] = [*(items[d] or ()), index.value.ids[item]]
                got = pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], pa.array(at, pa.list_(pa.int32())), pa.array([x and sorted(set(x)) for x in items], pa.list_(pa.string()))], [*out, "__at", "__items"])
                yield got if all_rows else got.filter(pa.array([x is not None for x in at], pa.bool_()))

        return lambda batches: trimmed(run(batches))

    ddl = lambda columns, frame: ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in columns)
    n_blocks = _n_blocks(benchmark, item_col, item_text_col, block_bytes)
    blocks = (spark.sparkContext.broadcast(BenchmarkIndex(block, window, gram)) for block in _blocks(benchmark, item_col, item_text_col, n_blocks))
    if n_blocks == 1:
        df = df.mapInArrow(search(next(blocks), fixed, True), f"{ddl(fixed, df)}, {found}")
    else:
        # a row's name: two hashes of its id and text, so that rows without an id or with a repeated one have theirs
        named = df.select(*fixed, F.xxhash64("__0", "__text").alias("__n1"), F.xxhash64("__text", F.lit(1), "__0").alias("__n2"))
        parts = None
        for index in blocks:
            hits = stored(named.mapInArrow(search(index, ["__n1", "__n2"], False), f"__n1 long, __n2 long, {found}").dropDuplicates(["__n1", "__n2"]))
            index.unpersist()
            parts = hits if parts is None else parts.union(hits)
        together = stored(parts.groupBy("__n1", "__n2").agg(F.flatten(F.collect_list("__at")).alias("__at"), F.flatten(F.collect_list("__items")).alias("__items")))
        df = join_small(named, together, ["__n1", "__n2"], "left", row_bytes=48 + 4 * F.size("__at") + 24 * F.size("__items")).select(*fixed, "__at", "__items")

    def finish(batches):
        for batch, texts in pieces(batches, "__text", 1 << 20):
            data, offsets = utf8_buffer(texts)
            solid = _WORD_BYTES[data] != 32
            first = solid.copy()
            first[1:] &= ~solid[:-1]
            inner = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
            first[inner] = solid[inner]
            n_hit, n_items, digest, merged, all_items = [], [], [], [], []
            for at, items in zip(batch.column("__at").to_pylist(), batch.column("__items").to_pylist(), strict=True):
                union: list[list[int]] = []
                for a, b in sorted(zip(at[::2], at[1::2], strict=True)) if at else ():
                    if union and a <= union[-1][1]:
                        union[-1][1] = max(union[-1][1], b)
                    else:
                        union.append([a, b])
                found = sorted(set(items or ()))
                n_hit.append(sum(b - a for a, b in union))
                n_items.append(len(found))
                digest.append(hashlib.sha256(",".join(found).encode()).hexdigest())
                merged.append([x for ab in union for x in ab])
                all_items.append(found)
            out = [pa.array(sums(first, offsets)), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())]
            out += [pa.array(merged, pa.list_(pa.int32())), pa.array(all_items, pa.list_(pa.string()))] if spans else []
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in head], *out], [*head, *names[: len(out)]])

    types = ["long", "long", "long", "string", "boolean", "array<int>", "array<string>"]
    results = [f"{n} {t}" for n, t in zip(names, types, strict=True)][: 7 if spans else 5]
    out = df.mapInArrow(lambda batches: trimmed(finish(batches)), ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in head] + results))
    return out.toDF(id_col, *kept, *names[: len(results)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without any hit, with their own columns, whatever those are called.

    Null and empty texts, and rows without an id, are kept unless they are hit; repeated rows are treated alike; an
    empty table, or one against no items, stays as it is.
    """
    plain, (i, text) = with_own_names(docs, id_col, text_col)
    return mark_hits(plain, benchmark, i, text, keep=plain.columns, **options).where("not contaminated").select(*plain.columns).toDF(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return mark_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM windows),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), doc_windows AS (
  SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM doc_words, sizes WHERE len(w) >= m)
), hits AS (SELECT d.doc_id, d.s, d.m, i.item_id FROM doc_windows d JOIN windows i USING (m, win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""
