"""Near-duplicate documents by one-permutation hashing (operator 9).

One hash of each word shingle gives both its bin and its value; a bin keeps its least value,
and an empty bin takes that of a bin drawn by a hash of the bin and the attempt until it is
not empty (optimal densification). ``BANDS`` bands of ``ROWS`` bins make the buckets: a pair
at similarity 0.8 shares one with probability 1 - (1 - 0.8^6)^40 > 0.99999. Documents with
equal sets (128 bits of hashes) are one node from the start; candidates are the stars of
buckets, and what those leave apart is compared by an exact bound (see components.py). Each
link is confirmed on the words of the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.arrays import codes_of, lengths_to_rows, lower_ascii, map_texts, mix64, pieces, space_words
from corvane.llm.components import components, link_buckets
from corvane.llm.recovery import discard, release, stored, trimmed
from corvane.llm.set_pairs import distinct_elements, exact_windows, linked, parity_bitmaps

BANDS, ROWS = 40, 6
#: Per cent of the union that two sets share at least.
SIMILARITY = 80

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd, so a product by it tells values apart, and its first bits depend on all of the factor.
SPREAD = np.uint64(0x9E3779B97F4A7C15) << np.uint64(32) | np.uint64(1)


def one_permutation(rows: np.ndarray, hashes: np.ndarray, n: int, bins: int) -> np.ndarray:
    """The densified signatures (n x bins) of the sets whose elements' hashes and rows are given; the first half of a hash makes the bin, the second one leads the value."""
    sig = np.full(n * bins, NONE, np.uint64)
    np.minimum.at(sig, rows * bins + ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64), hashes * SPREAD)
    return densified(sig.reshape(n, bins))


def densified(sig: np.ndarray) -> np.ndarray:
    """The signatures with each empty bin filled from the first full one that a hash of the bin and the attempt draws; rows without any stay empty."""
    bins = sig.shape[1]
    full = sig != NONE
    some = full.any(axis=1)
    r, b = np.nonzero(~full & some[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        donor = (mix64(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)[b]
        ok = full[r, donor]
        sig[r[ok], b[ok]] = sig[r[ok], donor[ok]]
        r, b = r[~ok], b[~ok]
    return sig


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    """One bucket for each band (n x bands), different for the same values in different bands."""
    n, rows = len(sig), sig.shape[1] // bands
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for k in range(rows):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::rows][:, :bands])
    return h.view(np.int64)


def shingle_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of each text's distinct shingles of k words, sorted; of all its words if it has fewer, but some."""
    offsets, words = space_words(lower_ascii(texts))
    code, known = codes_of(words)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known.cast(pa.binary()).to_pylist()), np.uint64, len(known))
    h = own[code]
    counts = np.diff(offsets)
    size = np.minimum(counts, k)
    full = np.zeros(0, np.uint64)
    if len(h) >= k:
        full = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            full = mix64(full * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    sets = []
    for a, n, m in zip(offsets[:-1].tolist(), counts.tolist(), size.tolist(), strict=True):
        if n >= k:
            sets.append(np.unique(full[a : a + n - k + 1]))
        elif n:
            x = np.full(1, m, np.uint64)
            for i in range(m):
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[a + i])
            sets.append(x)
        else:
            sets.append(full[:0])
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return at, np.concatenate(sets) if sets else full[:0]


def word_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and elements of each text's set of shingles, by numbers that are equal exactly where the words are; a text of fewer words than ``k`` has one of its own."""
    offsets, words = space_words(lower_ascii(texts))
    code, known = codes_of(words)
    key, row = exact_windows(code, len(known), k), lengths_to_rows(offsets)
    inside = row[: len(key)] == row[k - 1 :]
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < k))
    row, key = distinct_elements(np.concatenate([row[: len(key)][inside], short]), np.concatenate([key[inside], -1 - short]))
    return np.searchsorted(row, np.arange(len(texts) + 1)), key


def _signatures(k: int, bands: int, rows: int):
    def work(texts: pa.Array) -> dict:
        at, h = shingle_hashes(texts, k)
        n, row = len(texts), lengths_to_rows(at)
        sizes = np.diff(at)
        keys = []
        for salt in (1, 2):  # a set's name: sums of two hashes of its elements
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h * np.uint64(2 * salt + 1) + np.uint64(salt)), dtype=np.uint64)])
            keys.append(pa.array(mix64(total[at[1:]] - total[at[:-1]]).view(np.int64), mask=sizes == 0))
        buckets = band_hashes(one_permutation(row, h, n, bands * rows), bands)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(buckets.ravel()))
        return {"n_shingles": pa.array(sizes.astype(np.int64)), "set_1": keys[0], "set_2": keys[1], "buckets": flat, "bits": parity_bitmaps(row, h, n)}

    return work


def _confirm(k: int, similarity: int):
    """Rows (a, b, text_a, text_b) -> the linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for half, _ in pieces(batches, "text_a", 1 << 20):
            for batch, _ in pieces([half], "text_b", 1 << 20):
                n = batch.num_rows
                both = pa.concat_arrays([batch.column("a"), batch.column("b")]).to_numpy(zero_copy_only=False)
                _, first, which = np.unique(both, return_index=True, return_inverse=True)
                at, elements = word_sets(pa.concat_arrays([batch.column("text_a"), batch.column("text_b")]).take(pa.array(first)), k)
                yield batch.select(["a", "b"]).filter(pa.array(linked(which[:n], which[n:], at, elements, similarity)))

    return lambda batches: trimmed(run(batches))


def near_duplicates(
    docs: DataFrame, k: int = 5, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per document: id, n_shingles, component_id (the least id reachable over links) and kept (its id is that one).

    A document's set: its distinct shingles of ``k`` words, A-Z in lower case; with fewer words
    all of them as one; null texts and texts without words have none and are linked with
    nothing. Documents with equal sets, thousands of copies too, are one node and no pairs.
    Ids name documents: repeated rows each get a result row, and if texts differ under one id,
    links are confirmed on the greatest of them. A row without an id is linked with nothing, has no component and is kept.
    An empty table gives an empty result. Ids are integers.

    Shuffled are: a set's name and buckets for each document, texts only of documents that
    share a bucket with another one, and pairs. Nothing is collected or broadcast by hint.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    signed = stored(map_texts(base, _signatures(k, bands, rows), "n_shingles long, set_1 long, set_2 long, buckets array<long>, bits binary", "__id", "__text", limit=1 << 20))
    first = signed.where("n_shingles > 0 and __id is not null").groupBy("set_1", "set_2").agg(F.min("__id").alias("node"), F.count("*").alias("n"))
    first = stored(first)
    # a set of one document is that document's; of the others the first one's row is taken
    named = signed.where("n_shingles > 0 and __id is not null").join(first.where("n > 1").select("set_1", "set_2", "node"), ["set_1", "set_2"], "left")
    nodes = stored(named.where("node is null or node = __id").select(F.col("__id").alias("node"), F.col("n_shingles").alias("n"), "buckets", "bits"))
    spread = nodes.select(F.explode("buckets").alias("bucket"), "node")
    shared = stored(spread.groupBy("bucket").count().where("count > 1").select("bucket"))
    members = stored(spread.join(shared, "bucket").distinct())
    del spread
    release(spark)
    own = members.select("node").distinct()
    traits = stored(nodes.select("node", "n", "bits").join(own, "node").dropDuplicates(["node"]))
    discard(nodes, shared)
    texts = stored(base.join(own.withColumnRenamed("node", "__id"), "__id").groupBy(F.col("__id").alias("node")).agg(F.max("__text").alias("text")))
    release(spark)

    def confirm(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return with_b.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(k, similarity), "a long, b long")

    found = components(link_buckets(members, traits, confirm, similarity), "a", "b")
    discard(members, traits, texts)
    of_set = first.join(found, "node", "left").select("set_1", "set_2", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("__id", "n_shingles", "set_1", "set_2").join(of_set, ["set_1", "set_2"], "left")
    component = F.when(F.col("__id").isNotNull(), F.coalesce("component_id", "__id"))
    return out.select(F.col("__id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("__id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, one of each group, with their own columns."""
    id_col = options.get("id_col", "doc_id")
    gone = near_duplicates(docs, **options).where("not kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by shingles of two words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(c AS BIGINT) AS component_id, d.doc_id = c AS kept
FROM documents d JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
