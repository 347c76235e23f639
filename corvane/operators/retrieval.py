"""Retrieval: postings, BM25, literal search, fusion, paging, vectors, section search.

``chunks`` has (chunk_id, text). ``postings`` has (term, chunk_id, tf); ``stats`` has (chunk_id, length).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import cosine, split_identifier

K1, B = 1.5, 0.75
# What a hit of each source weighs in the fused score.
SOURCE_WEIGHTS = {"exact": 1000.0, "source-search": 50.0, "bm25": 1.0, "semantic-cache": 10.0}


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf): how often each term occurs in each chunk; counted map-side before the shuffle."""
    return chunks.select("chunk_id", F.explode(split_identifier(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """(chunk_id, length) in terms."""
    return chunks.select("chunk_id", F.size(split_identifier(F.coalesce("text", F.lit("")))).cast("long").alias("length"))


def index_stats(stats: DataFrame) -> DataFrame:
    """One row: how many chunks, and their mean length."""
    return stats.agg(F.count("*").alias("n"), F.coalesce(F.sum("length") / F.count("*"), F.lit(0.0)).alias("mean_length"))


def query_terms(spark, terms: Sequence[str]) -> list[str]:
    """The distinct words of the query's terms, by the rule of the index."""
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select(F.explode(split_identifier(F.col("t"))).alias("w")).distinct().collect()
    return sorted(r["w"] for r in rows)


def bm25(posting_rows: DataFrame, stats: DataFrame, terms: Sequence[str], k: int = 20, k1: float = K1, b: float = B) -> DataFrame:
    """The k best chunks by BM25, ties by chunk id. Only the query's postings are read and joined."""
    wanted = query_terms(posting_rows.sparkSession, terms)
    totals = index_stats(stats)
    hits = posting_rows.where(F.col("term").isin(*wanted))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(df, "term").join(stats, "chunk_id").crossJoin(totals)  # totals is one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.when(F.col("mean_length") > 0, F.col("length") / F.col("mean_length")).otherwise(0.0)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * norm))
    return rows.groupBy("chunk_id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)


def literal_search(chunks: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(chunk_id, line, term): lines, from 1, that contain a term as it is written."""
    lines = chunks.select("chunk_id", F.posexplode(F.split("text", "\n")).alias("at", "body"))
    hit = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col("body"), t))
    return lines.select("chunk_id", (F.col("at") + 1).cast("long").alias("line"), F.explode(hit).alias("term"))


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """(key, score, sources) from rows (source, node_id, chunk_id, path, symbol, score): weighted scores summed by identity.

    The identity is the node, else the chunk, else path and symbol, else the path. A missing
    score counts 1, and an exact hit always its weight.
    """
    c = F.col
    key = F.when(c("node_id").isNotNull(), F.concat(F.lit("node:"), c("node_id"))).when(c("chunk_id").isNotNull(), F.concat(F.lit("chunk:"), c("chunk_id"))).when(c("path").isNotNull() & c("symbol").isNotNull(), F.concat(F.lit("pathsym:"), c("path"), F.lit("#"), c("symbol"))).otherwise(F.concat(F.lit("path:"), c("path")))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv]), c("source"))
    own = weight * F.when(c("source") == "exact", 1.0).otherwise(F.coalesce("score", F.lit(1.0)))
    return candidates.groupBy(key.alias("key")).agg(F.round(F.sum(own), 6).alias("score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def page(rows: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of at most 50 rows from an offset of at most 500, with the total and the next offset (null at the end)."""
    limit, offset = max(1, min(limit, 50)), max(0, min(offset, 500))
    total = rows.agg(F.count("*").alias("total"))
    out = rows.orderBy(*order).offset(offset).limit(limit).crossJoin(total)  # total is one row
    return out.withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("long")))


def vector_search(vectors: DataFrame, query: Sequence[float], k: int = 10, threshold: float = 0.0, types: Sequence | None = None) -> DataFrame:
    """(vec_id, label, score): the k nearest by cosine at or above a threshold; score is 1 - similarity, ties by id.

    The query is a literal in the scan's projection, so only a top-k crosses the network.
    """
    rows = vectors if types is None else vectors.where(F.col("label").isin(*types))
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select("vec_id", "label", cosine(F.col("embedding"), q).alias("similarity")).where(F.col("similarity") >= threshold)
    return scored.orderBy(F.desc("similarity"), "vec_id").limit(k).select("vec_id", "label", F.round(1 - F.col("similarity"), 5).alias("score"))


def _distances(words: Column, query: str) -> Column:
    return F.transform(words, lambda x: F.levenshtein(x, F.lit(query)) / F.lit(float(len(query))))


def fuzzy_search(rows: DataFrame, query: str, fields: dict[str, float], id_col: str, threshold: float = 0.4, limit: int = 50) -> DataFrame:
    """(id, score): weighted fuzzy OR search. A field's distance is the least edit distance of a query word to one of its words, per character; 0 is exact.

    The score is the weighted product of matched fields' distances, so its scale is its own.
    """
    words = [w for w in query.lower().split() if w]
    total = sum(fields.values())
    score, hit = F.lit(1.0), F.lit(False)
    for field, weight in fields.items():
        own = F.split(F.lower(F.coalesce(F.col(field), F.lit(""))), r"\W+")
        near = F.array_min(F.flatten(F.array(*[_distances(own, w) for w in words])))
        matched = near <= threshold
        hit = hit | matched
        score = score * F.when(matched, F.pow(F.greatest(near, F.lit(0.001)), F.lit(weight / total))).otherwise(1.0)
    return rows.where(hit).select(F.col(id_col), F.round(score, 6).alias("score")).orderBy("score", id_col).limit(limit)


def section_search(sections: DataFrame, terms: Sequence[str], limit: int = 40) -> DataFrame:
    """(section, best_line, n_terms, total): sections in which every term occurs, with the first line of most terms."""
    low = [t.lower() for t in terms]
    lines = sections.select("section", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    hits = [F.contains(F.lower("body"), F.lit(t)).cast("int") for t in low]
    marked = lines.select("section", "line", *[h.alias(f"t{i}") for i, h in enumerate(hits)], sum(hits, F.lit(0)).alias("n"))
    found = marked.groupBy("section").agg(F.min_by("line", F.struct(-F.col("n"), "line")).alias("best_line"), F.max("n").alias("n_terms"), *[F.max(f"t{i}").alias(f"t{i}") for i in range(len(low))])
    found = found.where(" and ".join(f"t{i} = 1" for i in range(len(low)))).select("section", "best_line", "n_terms")
    return found.crossJoin(found.agg(F.count("*").alias("total"))).orderBy(F.desc("n_terms"), "section").limit(limit)  # total is one row


def read_evidence(files: DataFrame, first: int, max_lines: int = 200, max_chars: int = 20_000) -> DataFrame:
    """(path, text, from_line, to_line, next_line): at most max_lines whole lines and max_chars characters from a line on."""
    lines = F.slice(F.split("text", "\n"), first, max_lines)
    sizes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("cut"), F.lit(1))), lambda i: F.aggregate(F.slice("cut", 1, i), F.lit(-1), lambda s, x: s + F.char_length(x) + 1))
    fit = F.greatest(F.lit(1), F.size(F.filter(sizes, lambda s: s <= max_chars)))
    n = F.size(F.split("text", "\n"))
    rows = files.where(n >= first).select("path", lines.alias("cut"), n.alias("n"), F.col("text")).withColumn("fit", F.least(F.size("cut"), fit))
    last = F.lit(first) + F.col("fit") - 1
    return rows.select("path", F.substring(F.array_join(F.slice("cut", 1, F.col("fit")), "\n"), 1, max_chars).alias("text"), F.lit(first).cast("long").alias("from_line"), last.cast("long").alias("to_line"), F.when(last < F.col("n"), (last + 1).cast("long")).alias("next_line"))


def update_index(old_postings: DataFrame, chunks_now: DataFrame, touched: DataFrame) -> DataFrame:
    """Postings after the chunks of touched files changed: theirs are taken out and computed anew, the rest is kept."""
    kept = old_postings.join(touched, "chunk_id", "left_anti")
    return kept.select("term", "chunk_id", "tf").unionByName(postings(chunks_now.join(touched, "chunk_id", "left_semi")))


def unique_chunk_ids(rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """Ids that come again get #2, #3 and so on, in order."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    return rows.withColumn("chunk_id", F.when(n > 1, F.concat(F.col(id_col), F.lit("#"), n.cast("string"))).otherwise(F.col(id_col)))


def probability_weight(n: int, df: int) -> float:
    """The idf of one term, for callers that score by hand."""
    return math.log((n - df + 0.5) / (df + 0.5) + 1)
