"""Exact removal of repeated byte strings by sharded suffix arrays (operator 5).

Every window of ``window`` bytes is dealt to a shard by its content: of the hashes of its
``GRAM``-byte strings the least one is its anchor, the last of equal ones. Windows in a row with
one anchor are a context. Equal windows have equal anchors at equal offsets, so they meet in
one shard, and a suffix array of the shard's contexts finds them all, byte by byte.

Before that, equal contexts (two hashes, 128 bits) become one with its first occurrence, in
map-side aggregates: all windows of the other occurrences start earlier elsewhere. Anchors
with one context left have nothing to compare and need no bytes. The rest of the contexts, in
practice the edges of repeated passages, is read from the documents, and shards of about
SHARD_BYTES are sorted by induction (induced_sorting.py); windows whose suffixes share a
prefix of ``window`` bytes form runs of the array, and all but the first of a run go.

An anchor with over HOT contexts (a very common passage in many surroundings) doesn't fit one
shard; its windows are compared one by one, by 128 bits, in an aggregate.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.arrays import mix64, pieces, utf8_buffer
from corvane.llm.induced_sorting import permuted_common_prefixes, suffix_array
from corvane.llm.recovery import discard, release, stored, trimmed

WINDOW, GRAM = 100, 32
SHARD_BYTES, HOT = 1 << 20, 20_000
#: Over the windows of a context, so that a context's first window and their number share one number.
SPAN = 4096
#: Not a byte of UTF-8.
SEPARATOR = 254

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LOW = np.uint64((1 << 28) - 1)


@functools.lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


class RollingHash:
    """Hashes of any stretches of a buffer, equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        size = max(1 << 20, 1 << (len(data) + 1).bit_length())
        power, self.inverse = _powers(size)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_HASH[data] * power[: len(data)], dtype=np.uint64, out=self.total[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[begin]) * self.inverse[begin])

    def all(self, size: int) -> np.ndarray:
        n = len(self.total) - size
        return mix64((self.total[size:] - self.total[:n]) * self.inverse[:n])


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each stretch, by doubling."""
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _runs(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple | None:
    """The rolling hashes, the gram hashes, and by context: row, anchor, first and last window start; None without any."""
    if len(data) < window:
        return None
    rolling = RollingHash(data)
    h = rolling.all(gram)
    keys = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    anchor = (_LOW - (sliding_least(keys, window - gram + 1) & _LOW)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = np.arange(len(anchor)) + window <= offsets[row + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    lo = np.flatnonzero(new & inside)
    if not len(lo):
        return None
    return rolling, h, row[lo], anchor[lo], lo, np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """The anchor hashes, and how many contexts each has."""
    found = _runs(data, offsets, window, gram)
    h, n = np.unique(found[1][found[3]].view(np.int64), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
    return {"h": h, "n": n}


def contexts(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Row, anchor hash, context hash, and place (SPAN x the first window start in the row + the windows behind it) of each context."""
    found = _runs(data, offsets, window, gram)
    if not found:
        return {k: np.zeros(0, np.int64) for k in ("row", "h", "c", "place")}
    rolling, h, row, anchor, lo, ends = found
    shift = (anchor - lo).astype(np.uint64) << np.uint64(32) | (ends - lo).astype(np.uint64)
    c = mix64(rolling.of(lo, ends + window) + mix64(shift + np.uint64(1)))
    return {"row": row, "h": h[anchor].view(np.int64), "c": c.view(np.int64), "place": SPAN * (lo - offsets[row]) + ends - lo}


def _emit_anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "__text", (1 << 20) - 8):
            found = anchors(*utf8_buffer(texts), window, gram)
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in found.values()], [*found])

    return lambda batches: trimmed(run(batches))


def _emit_contexts(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "__text", (1 << 20) - 8):
            data, offsets = utf8_buffer(texts)
            found = contexts(data, offsets, window, gram)
            ids = batch.column("__id").to_numpy(zero_copy_only=False)[found.pop("row")]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(v.astype(np.int64)) for v in found.values()]], ["__id", *found])

    return lambda batches: trimmed(run(batches))


def _cut_contexts(window: int):
    """Rows (id, text, wanted) -> one row with its bytes for each wanted context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                out: dict[str, list] = {"h": [], "__id": [], "lo": [], "hi": [], "hot": [], "bytes": []}
                for i, text, wanted in zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                    raw = text.encode()
                    for w in wanted:
                        for k in ("h", "lo", "hi", "hot"):
                            out[k].append(w[k])
                        out["__id"].append(i)
                        out["bytes"].append(raw[w["lo"] : w["hi"] + window])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), [pa.int64()] * 4 + [pa.bool_(), pa.binary()], strict=True)], list(out))

    return run


def repeated_windows(ids: np.ndarray, lows: np.ndarray, highs: np.ndarray, texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, window start in it) of the windows of a shard that are equal to one that starts earlier, by (id, start)."""
    sizes = np.array([len(t) + 1 for t in texts])
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    joined = np.frombuffer(bytes([SEPARATOR]).join(texts), np.uint8)
    order = suffix_array(joined)
    shared = permuted_common_prefixes(joined, order, window)
    run = np.cumsum(shared[order] < window)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(joined)]
    offset = np.arange(len(joined)) - at[owner]
    valid = (offset <= (highs - lows)[owner])[order]
    places, run = order[valid], run[valid]
    if not len(places):
        return places, places
    rank = np.empty(len(ids), np.int64)  # of the contexts, by document and place: with the offset, the order of windows
    rank[np.lexsort((lows, ids))] = np.arange(len(ids))
    key = rank[owner[places]] << 32 | offset[places]
    new = np.concatenate([[True], run[1:] != run[:-1]])
    first = np.minimum.reduceat(key, np.flatnonzero(new))
    later = key != first[np.cumsum(new) - 1]
    return owner[places[later]], offset[places[later]]


def _ranges(owner: np.ndarray, offset: np.ndarray, ids: np.ndarray, lows: np.ndarray) -> pa.RecordBatch:
    both = np.sort(owner << 32 | offset)
    owner, offset = both >> 32, both & 0xFFFFFFFF
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(owner)]]) - 1 if len(first) else first
    base = lows[owner[first]]
    return pa.RecordBatch.from_arrays([pa.array(ids[owner[first]], pa.int64()), pa.array(base + offset[first], pa.int64()), pa.array(base + offset[last], pa.int64())], ["__id", "lo", "hi"])


def _sort_shards(window: int):
    """Contexts sorted by anchor -> ranges of window starts that go; an anchor's contexts are never parted."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        ids, lows, highs = (np.array([r[k] for r in rows], np.int64) for k in ("__id", "lo", "hi"))
        return _ranges(*repeated_windows(ids, lows, highs, [r["bytes"] for r in rows], window), ids, lows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size, last = 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if size >= SHARD_BYTES and r["h"] != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size, last = size + len(r["bytes"]), r["h"]
        if rows:
            yield solve(rows)

    return lambda batches: trimmed(run(batches))


def _each_window(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                w1, w2, ids, begins = [], [], [], []
                for i, lo, raw in zip(batch.column("__id").to_pylist(), batch.column("lo").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                    for s in range(len(raw) - window + 1):
                        d = hashlib.blake2b(raw[s : s + window], digest_size=16).digest()
                        w1.append(int.from_bytes(d[:8], "little", signed=True))
                        w2.append(int.from_bytes(d[8:], "little", signed=True))
                        ids.append(i)
                        begins.append(lo + s)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (w1, w2, ids, begins)], ["w1", "w2", "__id", "lo"])

    return run


def _first(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """keys -> the first (id, place) of each, and how many; in two aggregates of plain numbers."""
    per_doc = df.groupBy(*keys, "__id").agg(F.min(place).alias("at"), F.count("*").alias("n"))
    return per_doc.groupBy(*keys).agg(F.min("__id").alias("first_id"), F.min_by("at", "__id").alias("first_at"), F.sum("n").alias("n"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(__id, lo, hi): window starts, from lo to hi, whose window starts earlier too; ``docs`` has (__id, __text)."""
    if not 0 <= window - gram < SPAN:
        raise ValueError(f"gram must be at most window, and over window - {SPAN}")
    spark = docs.sparkSession
    long_ones = docs.where(F.octet_length("__text") >= window)
    again = stored(long_ones.select("__text").mapInArrow(_emit_anchors(window, gram), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    release(spark)
    found = long_ones.mapInArrow(_emit_contexts(window, gram), "__id long, h long, c long, place long")
    candidates = stored(found.join(again.hint("merge"), "h"))
    discard(again)
    del found
    release(spark)
    firsts = stored(_first(candidates, ["h", "c"], "place"))
    release(spark)
    several = firsts.where("n > 1").select("h", "c", "first_id", "first_at")
    lo, hi = F.expr(f"place div {SPAN}").alias("lo"), F.expr(f"place div {SPAN} + place % {SPAN}").alias("hi")
    copies = stored(candidates.join(several.hint("merge"), ["h", "c"]).where("__id <> first_id or place <> first_at").select("__id", lo, hi))
    discard(candidates)
    release(spark)
    groups = stored(firsts.groupBy("h").count().where("count > 1").select("h", (F.col("count") > hot).alias("hot")))
    open_ones = firsts.join(groups, "h").select("h", "hot", F.col("first_id").alias("__id"), F.col("first_at").alias("place"))
    wanted = stored(open_ones.groupBy("__id").agg(F.collect_list(F.struct("h", lo, hi, "hot")).alias("wanted")))
    discard(firsts, groups)
    release(spark)
    shards = stored(docs.join(wanted.hint("merge"), "__id").select("__id", "__text", "wanted").mapInArrow(_cut_contexts(window), "h long, __id long, lo long, hi long, hot boolean, bytes binary"))
    discard(wanted)
    release(spark)
    sorted_out = shards.where("not hot").select("h", "__id", "lo", "hi", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(_sort_shards(window), "__id long, lo long, hi long")
    single = shards.where("hot").select("__id", "lo", "bytes").mapInArrow(_each_window(window), "w1 long, w2 long, __id long, lo long")
    repeated = single.join(_first(single, ["w1", "w2"], "lo").where("n > 1"), ["w1", "w2"]).where("__id <> first_id or lo <> first_at").select("__id", "lo", F.col("lo").alias("hi"))
    return copies.union(sorted_out).union(repeated)


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in pieces(batches, "__text", 2 << 20):
            n_bytes, n_removed, n_spans, digests, kept_texts = [], [], [], [], []
            for text, ranges in zip(batch.column("__text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                raw = (text or "").encode()
                kept, at, removed, spans = [], 0, 0, 0
                merged: list[list[int]] = []
                for r in sorted((r["lo"], min(r["hi"] + window, len(raw))) for r in ranges or () if r["lo"] < len(raw)):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                for a, b in merged:
                    kept.append(raw[at:a])
                    at, removed, spans = b, removed + b - a, spans + 1
                rest = b"".join([*kept, raw[at:]])
                n_bytes.append(len(raw))
                n_removed.append(removed)
                n_spans.append(spans)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept_texts.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary())], ["__id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return lambda batches: trimmed(run(batches))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the remaining bytes).

    Removed is each byte in a string of ``window`` bytes of the text's UTF-8 that also starts earlier:
    in a document of a smaller id, or in the same one. Strings are judged on the input, and
    never cross documents. Null is the empty text; texts under ``window`` bytes keep all.
    Ids are distinct integers: rows that repeat an id count as one document's, and each loses
    what any of them has, as far as it reaches. A row without an id is compared with nothing and keeps all.
    An empty table gives an empty result; long texts are read whole, in memory in proportion to their length.

    The documents are shuffled twice, for the contexts that are compared and for the result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    ranges = repeated_ranges(base.where("__id is not null"), window, gram, hot)
    by_doc = stored(ranges.groupBy("__id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))
    release(docs.sparkSession)
    out = base.join(by_doc.hint("merge"), "__id", "left").select("__id", "__text", "ranges").mapInArrow(_remove(window), "__id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("__id", id_col)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 100 bytes."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
