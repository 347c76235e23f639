"""Fuzzy line deduplication by MinHash (operator 8).

Lines are cut at line feeds. Equal lines are one node, named by the first of two 64-bit hashes
of the text. A node's character shingles make a MinHash signature whose bands are buckets; at
the least similarity of 0.8, BANDS bands of ROWS values find a pair with probability
1 - (1 - 0.8^5)^14 > 0.996, at 0.85 > 0.9997. Links are confirmed by the exact Jaccard
similarity of the shingle sets, and of each component of linked lines the first one, by
document id and line number, stays. One changed character inside a line of 80 characters
or more leaves it linked; shorter shingles, which would do so for shorter lines, make several times
as many candidates.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.arrays import codes_of, lengths_to_rows, mix64, pieces, utf8_buffer
from corvane.llm.components import components, link_buckets
from corvane.llm.minhash import NONE, SPREAD, band_hashes, densified
from corvane.llm.recovery import discard, join_small, release, stored, trimmed
from corvane.llm.set_pairs import distinct_elements, distinct_hashes, exact_windows, linked, parity_bitmaps, possible_pairs

SHINGLE, BANDS, ROWS, SIMILARITY = 8, 14, 5, 80
#: An odd number whose powers modulo 2^64 tell places apart.
BASE = 0x9E3779B97F4A7C15
#: Passes in which the bands are searched, each over its part of them.
PASSES = 2
#: Pairs of bucket and node that a worker packs at a time, and that a slot of buckets has on average at most.
PACKED, SLOT_PAIRS = 1 << 20, 1 << 17


def polynomial(points: np.ndarray, size: int) -> np.ndarray:
    """The value of each run of ``size`` numbers as a polynomial modulo 2^64, from runs of half the size."""
    if size == 1:
        return points
    half = size // 2
    left = polynomial(points, half)
    right = left if size == 2 * half else polynomial(points, size - half)
    n = max(0, len(points) - size + 1)
    return left[:n] * np.uint64(pow(BASE, size - half, 1 << 64)) + right[half : half + n]


def char_shingles(lines: Sequence[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The row and hash of every shingle of ``size`` characters, repeated ones too; of the whole line if it is shorter, but not empty."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    at = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(points) - size + 1)
    h = polynomial(points, size)
    row = lengths_to_rows(at)
    inside = row[:n] == row[size - 1 :] if n else np.zeros(0, bool)
    rows, hashes = row[:n][inside], h[inside]
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        own = np.fromiter((xxhash.xxh3_64_intdigest(lines[i].encode("utf-8", "surrogatepass"), seed=1) for i in short), np.uint64, len(short))
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, own])
    return rows, mix64(hashes)


def line_minima(lines: Sequence[str], size: int, bins: int) -> np.ndarray:
    """The least value in each bin of each line's shingles (one_permutation without densification), straight from the characters."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    at = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = polynomial(points, size)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    place = np.repeat(np.arange(len(lines)) * bins, lengths)[: len(h)]
    place += ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    for k in range(1, size):  # windows that begin in the last characters of a line reach into the next one
        cut = at[1:] - k
        cut = cut[(cut >= at[:-1]) & (cut < len(h))]
        place[cut] = len(lines) * bins
    sig = np.full(len(lines) * bins + 1, NONE, np.uint64)
    np.minimum.at(sig, place, h * SPREAD)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    sig = sig[:-1].reshape(len(lines), bins)
    if len(short):
        sig[short, 0] = np.fromiter((xxhash.xxh3_64_intdigest(lines[i].encode("utf-8", "surrogatepass"), seed=1) for i in short), np.uint64, len(short))
    return sig


def _lines(size: int, bands: int, rows: int):
    """Rows (id, text) -> one row for each line with a word; ``times`` is how often the document has the line, at its first place, or else 0; buckets, as plain numbers, are with the first of equal lines in a piece only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "__text", 1 << 20):
            lists = pc.split_pattern(texts, "\n")
            at = np.asarray(lists.offsets).astype(np.int64)
            flat = lists.values.slice(at[0], at[-1] - at[0])
            at = at - at[0]
            code, known = codes_of(flat)
            strings = known.to_pylist()
            raw = known.cast(pa.binary()).to_pylist()
            worth = np.fromiter(map(bool, map(bytes.strip, raw)), bool, len(raw))
            h1 = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw)).view(np.int64)
            h2 = np.fromiter((xxhash.xxh64_intdigest(s, 5) for s in raw), np.uint64, len(raw)).view(np.int64)
            buckets = band_hashes(densified(line_minima(strings, size, bands * rows)), bands)
            first = np.zeros(len(flat), bool)
            first[np.unique(code, return_index=True)[1]] = True
            keep = np.flatnonzero(worth[code])
            owner = lengths_to_rows(at)
            code_kept, first = code[keep], first[keep]
            ends = np.concatenate([[0], np.cumsum(np.where(first, 8 * bands, 0))]).astype(np.int32)
            _, own, n = np.unique(owner[keep] << 32 | code_kept, return_index=True, return_counts=True)
            times = np.zeros(len(keep), np.int32)
            times[own] = n
            raw = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(buckets[code_kept[first]].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id").take(pa.array(owner[keep])), pa.array((keep - at[owner[keep]]).astype(np.int32)), pa.array(h1[code_kept]), pa.array(h2[code_kept]), pa.array(times), raw],
                ["__id", "line", "h1", "h2", "times", "buckets"],
            )

    return lambda batches: trimmed(run(batches))


def _bounds(bucket: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pairs in the order of buckets, where each bucket starts, how often it is there, and its least and greatest node."""
    order = np.argsort(bucket)
    bucket, node = bucket[order], node[order]
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return bucket, node, start, np.diff(np.append(start, len(bucket))), np.minimum.reduceat(node, start), np.maximum.reduceat(node, start)


def packed_buckets(slots: int, most: int = PACKED):
    """Rows (node, buckets as plain numbers) -> (slot, pairs): buckets and then nodes as plain numbers, for slots of buckets (a power of two of them, 2 at least) from 0.

    What a worker holds of a bucket goes to its slot by the least and greatest node only, so a common bucket is never gathered there. If
    these differ, all its pairs are members already; they are rows with a negative slot.
    """

    def pack(bucket: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        bucket, node, start, count, lo, hi = _bounds(bucket, node)
        several = lo < hi
        slot, pairs = [], []
        if several.any():
            own = np.repeat(several, count)
            slot.append(-1 - int(bucket[0] & 0xFFFF))  # any number will do
            pairs.append(bucket[own].tobytes() + node[own].tobytes())
        least = np.repeat(bucket[start], 1 + several)
        ends = np.repeat(lo, 1 + several)
        ends[np.cumsum(1 + several) - 1] = hi
        where = (least >> (65 - slots.bit_length())) + slots // 2  # by its first bits, so in order
        at = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])).tolist()
        for a, b in zip(at, [*at[1:], len(where)], strict=True):
            slot.append(int(where[a]))
            pairs.append(least[a:b].tobytes() + ends[a:b].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(pairs, pa.binary())], ["slot", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            raw, at = utf8_buffer(batch.column("buckets"))
            held.append((np.frombuffer(raw.tobytes(), np.int64), np.repeat(batch.column("node").to_numpy(zero_copy_only=False), np.diff(at) // 8)))
            n += len(held[-1][0])
            if n >= most:
                yield pack(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield pack(*map(np.concatenate, zip(*held, strict=True)))

    return lambda batches: trimmed(run(batches))


def shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, pairs), sorted by slot -> (bucket, node), repeated ones too, of buckets with several nodes."""

    def members(slot: int, parts: list[bytes]) -> pa.RecordBatch:
        bucket, node = np.concatenate([np.frombuffer(p, np.int64).reshape(2, -1) for p in parts], axis=1)
        if slot >= 0:
            bucket, node, _, count, lo, hi = _bounds(bucket, node)
            own = np.repeat(lo < hi, count)
            bucket, node = bucket[own], node[own]
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node)], ["bucket", "node"])

    def run() -> Iterator[pa.RecordBatch]:
        of, held = -1, []
        for batch in batches:
            for slot, pairs in zip(batch.column("slot").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                if held and (slot != of or slot < 0):
                    yield members(of, held)
                    held = []
                of = slot
                held.append(pairs)
        if held:
            yield members(of, held)

    return trimmed(run())


def _texts_of_lines(size: int):
    """Rows (text, wanted structs of line and node) -> (node, text of the line, size and bitmap of its set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in pieces([whole], "__text", 1 << 20):
                nodes, found = [], []
                for text, wanted in zip(texts.to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                    lines = text.split("\n")
                    nodes += [w["node"] for w in wanted]
                    found += [lines[w["line"]] for w in wanted]
                row, h = distinct_hashes(*char_shingles(found, size))
                columns = [pa.array(nodes, pa.int64()), pa.array(found, pa.string()), pa.array(np.bincount(row, minlength=len(found)).astype(np.int64)), parity_bitmaps(row, h, len(found))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "line_text", "n", "bits"])

    return lambda batches: trimmed(run(batches))


def char_sets(lines: Sequence[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and elements of each line's set of shingles, by numbers that are equal exactly where the characters are; a shorter line has one of its own."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, code = np.unique(points, return_inverse=True)
    key, row = exact_windows(code, len(known), size), lengths_to_rows(np.concatenate([[0], np.cumsum(lengths)]))
    inside = row[: len(key)] == row[size - 1 :]
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    row, key = distinct_elements(np.concatenate([row[: len(key)][inside], short]), np.concatenate([key[inside], -1 - short]))
    return np.searchsorted(row, np.arange(len(lines) + 1)), key


def _confirm(size: int, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for half, _ in pieces([whole], "text_a", 1 << 20):
                for pairs, _ in pieces([half], "text_b", 1 << 20):
                    batch = pairs.take(pa.array(possible_pairs(pairs, similarity)))
                    code, known = codes_of(pa.concat_arrays([batch.column("text_a"), batch.column("text_b")]))
                    at, elements = char_sets(known.to_pylist(), size)
                    n = batch.num_rows
                    yield batch.select(["a", "b"]).filter(pa.array(linked(code[:n], code[n:], at, elements, similarity)))

    return lambda batches: trimmed(run(batches))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, similarity: int = SIMILARITY) -> DataFrame:
    """(id, gone): for each document with lines that go, their numbers from 0.

    Only lines with a word take part. Ids name documents; rows that repeat an id and its text
    are told apart neither here nor below.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).where("__id is not null and __text is not null")
    lines = stored(base.mapInArrow(_lines(size, bands, rows), "__id long, line int, h1 long, h2 long, times int, buckets binary"))
    # the first place of each text: plain numbers, so that equal lines are put together by hash
    places = lines.where("times > 0").groupBy("h1", "h2").agg(F.min("__id").alias("i"), F.min_by("line", "__id").alias("l"), F.sum("times").alias("n"))
    kinds = stored(places.select("h1", "h2", F.struct(F.col("i").alias("__id"), F.col("l").alias("line")).alias("at"), "n"))
    clash = stored(kinds.groupBy("h1").count().where("count > 1").select("h1"))
    some = not clash.isEmpty()

    def named(df: DataFrame) -> DataFrame:
        """With a node for each text: its first hash, or a hash of both for the few (n^2 / 2^65) that share the first one."""
        if not some:
            return df.withColumn("node", F.col("h1"))
        return df.join(F.broadcast(clash.withColumn("shared", F.lit(True))), "h1", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("h1", "h2")).otherwise(F.col("h1"))).drop("shared")

    parts, step = [], -(-bands // PASSES)
    slots = 1 << max(6, (lines.count() * step // SLOT_PAIRS).bit_length())
    for start in range(1, bands + 1, step):  # some bands at a time, so that only their pairs are in shuffle files together
        spread = named(lines.where(F.octet_length("buckets") > 0)).select("node", F.substring("buckets", 8 * start - 7, 8 * step).alias("buckets"))
        packed = spread.mapInArrow(packed_buckets(slots), "slot int, pairs binary")
        parts.append(stored(packed.repartition("slot").sortWithinPartitions("slot").mapInArrow(shared_buckets, "bucket long, node long").distinct()))
        del spread, packed
        release(spark)
    members = functools.reduce(DataFrame.union, parts)

    first = named(kinds).join(members.select("node").distinct(), "node")
    wanted = stored(first.groupBy(F.col("at.__id").alias("__id")).agg(F.collect_list(F.struct(F.col("at.line").alias("line"), "node")).alias("wanted")))
    chosen = join_small(base, wanted, "__id", row_bytes=32 + 12 * F.size("wanted")).select("__text", "wanted").mapInArrow(_texts_of_lines(size), "node long, line_text string, n long, bits binary")
    texts = stored(chosen.dropDuplicates(["node"]))
    discard(wanted)
    release(spark)

    def confirm(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("line_text").alias("text_a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a")
        with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("line_text").alias("text_b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")
        return with_b.select("a", "b", "text_a", "text_b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_confirm(size, similarity), "a long, b long")

    group = components(link_buckets(members, texts.select("node", "n", "bits"), confirm, similarity), "a", "b")
    discard(*parts, texts)
    linked_lines = named(kinds).join(group, "node")
    heads = linked_lines.groupBy("component").agg(F.min("at").alias("stays"))
    fuzzy = linked_lines.join(heads, "component").select("h1", "h2", "stays")
    exact = named(kinds.where("n > 1")).join(group, "node", "left_anti").select("h1", "h2", F.col("at").alias("stays"))
    stays = stored(fuzzy.union(exact))
    gone = lines.select("__id", "line", "h1", "h2").join(stays, ["h1", "h2"]).where("__id <> stays.__id or line <> stays.line")
    out = stored(gone.groupBy(F.col("__id").alias(id_col)).agg(F.sort_array(F.collect_set("line")).alias("gone")))
    discard(stays, kinds, clash, lines)
    release(spark)
    return out


def _rebuild(names: list[str], text_at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in pieces(batches, "__text", 1 << 20):
            texts, n_lines, n_removed, digests = [], [], [], []
            for text, gone in zip(batch.column("__text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                n = text.count("\n") + 1 if text else 0
                away = {i for i in gone or () if i < n}
                kept = text if not away else "\n".join([x for i, x in enumerate(text.split("\n")) if i not in away])
                texts.append(kept)
                n_lines.append(n)
                n_removed.append(len(away))
                digests.append(hashlib.sha256((kept or "").encode()).hexdigest())
            own = {"__kept": pa.array(texts, pa.string()), "__n_lines": pa.array(n_lines, pa.int64()), "__n_removed": pa.array(n_removed, pa.int64()), "__sha": pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in names], names)

    return lambda batches: trimmed(run(batches))


def _rebuilt(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str], **options) -> DataFrame:
    """``keep`` as __0, __1 ..., and __kept, __n_lines, __n_removed and __sha."""
    gone = repeated_lines(docs, id_col, text_col, **options).withColumnRenamed(id_col, "__id")
    head = [f"__{i}" for i in range(len(keep))]
    base = docs.select(F.col(text_col).cast("string"), F.col(id_col).cast("long"), *map(F.col, keep)).toDF("__text", "__id", *head)
    with_gone = join_small(base, gone, "__id", "left", row_bytes=32 + 4 * F.size("gone")).select("__text", *head, "gone")
    kinds = {c: base.schema[c].dataType.simpleString() for c in head} | {"__kept": "string", "__n_lines": "long", "__n_removed": "long", "__sha": "string"}
    return with_gone.mapInArrow(_rebuild(list(kinds), text_col), ", ".join(f"`{c}` {t}" for c, t in kinds.items()))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), **options) -> DataFrame:
    """Per document: id, ``keep``, text (of the lines that stay), n_lines, n_removed and kept_sha256 (of that text).

    Of equal or linked lines, in one document or several, the first by (id, line number)
    stays. Lines without a word always stay. A null text stays null with 0 lines, its digest
    is that of ''; an empty one has no lines. Repeated rows are one document and are treated
    alike. An empty table gives an empty result. Very long lines are shingled whole. A kept
    column that is called like a result gives way to it. Ids are integers.

    A row without an id is not compared and keeps all its lines. The documents are shuffled only for
    rows that a check of their size finds too large to broadcast, twice at most; hot lines are counted before they are shuffled.
    """
    results = [text_col, "n_lines", "n_removed", "kept_sha256"]
    kept = [c for c in dict.fromkeys(keep) if c not in results and c != id_col]
    out = _rebuilt(docs, id_col, text_col, [id_col, *kept], **options)
    return out.toDF(id_col, *kept, *results)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", **options) -> DataFrame:
    """The documents with the lines that stay and their own columns, whatever those are called.

    ``count_col``, if there is one, is counted anew where lines went. Documents that lose their last
    word go; null and empty texts, and rows without an id, stay as they are. Repeated rows are treated alike, of ties
    the line of the least id and number stays, an empty table stays empty.
    """
    columns = docs.columns
    out = _rebuilt(docs, id_col, text_col, columns, **options)
    out = out.where((F.col("__n_removed") == 0) | F.col("__kept").rlike(r"[^\x09-\x0D\x20]"))
    own = [F.col(f"__{i}") for i in range(len(columns))]
    own[columns.index(text_col)] = F.col("__kept")
    if count_col in columns:
        at = columns.index(count_col)
        own[at] = F.when(F.col("__n_removed") > 0, F.char_length("__kept")).otherwise(own[at]).cast(docs.schema[count_col].dataType)
    return out.select(*own).toDF(*columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_removed", "kept_sha256")
