"""Registered retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.text import split_identifier
from corvane.operators import retrieval as R
from corvane.plans.roles import table

TERMS = ["thereTion", "ouan", "Reading"]
LITERALS = ["###", "the ", "ation"]
VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]

WORDS_SQL = r"list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: lower(w))"
CHUNKS_SQL = "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents"
POSTINGS_SQL = f"SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({WORDS_SQL.format(c='text')}) AS term FROM ({CHUNKS_SQL})) GROUP BY 1, 2"
STATS_SQL = f"SELECT chunk_id, CAST(len({WORDS_SQL.format(c='text')}) AS BIGINT) AS length FROM ({CHUNKS_SQL})"
BM25_SQL = f"""WITH p AS ({POSTINGS_SQL}), s AS ({STATS_SQL}), t AS (SELECT count(*) AS n, sum(length) / count(*) AS mean FROM s), q AS (SELECT DISTINCT unnest({WORDS_SQL.format(c='x')}) AS term FROM (VALUES {', '.join(f"('{t}')" for t in TERMS)}) v(x)),
  h AS (SELECT p.* FROM p JOIN q USING (term)), d AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
  SELECT chunk_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM h JOIN d USING (term) JOIN s USING (chunk_id), t GROUP BY 1 ORDER BY score DESC, chunk_id LIMIT {{k}}"""
_DOT = "list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * q[i]))"
COSINE_SQL = f"WITH q AS (SELECT {VECTOR!r}::DOUBLE[] AS q), s AS (SELECT vec_id, label, {_DOT} / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))) AS similarity FROM embeddings, q)"


def chunks(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")


def _bm25(spark, sf, k=20):
    c = chunks(spark, sf)
    return R.bm25(R.postings(c), R.chunk_stats(c), TERMS, k)


def _candidates(spark, sf):
    c = chunks(spark, sf)
    exact = table(spark, sf, "documents").where("doc_id < 5").select(F.lit("exact").alias("source"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit(None).cast("double").alias("score"))
    literal = R.literal_search(c, ["###"]).select("chunk_id").distinct().select(F.lit("source-search").alias("source"), "chunk_id", F.lit(None).cast("double").alias("score"))
    ranked = _bm25(spark, sf).select(F.lit("bm25").alias("source"), "chunk_id", "score")
    cached = table(spark, sf, "labels").where("quality = 1").select(F.lit("semantic-cache").alias("source"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit(0.5).alias("score"))
    rows = exact.unionByName(literal).unionByName(ranked).unionByName(cached)
    return rows.select("source", F.lit(None).cast("string").alias("node_id"), "chunk_id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("symbol"), "score")


CANDIDATES_SQL = f"""SELECT 'exact' AS source, CAST(doc_id AS VARCHAR) AS chunk_id, CAST(NULL AS DOUBLE) AS score FROM documents WHERE doc_id < 5
  UNION ALL SELECT DISTINCT 'source-search', CAST(doc_id AS VARCHAR), NULL FROM documents WHERE contains(text, '###')
  UNION ALL SELECT 'bm25', chunk_id, score FROM ({BM25_SQL.format(k=20)}) UNION ALL SELECT 'semantic-cache', CAST(doc_id AS VARCHAR), 0.5 FROM labels WHERE quality = 1"""
MERGED_SQL = f"SELECT 'chunk:' || chunk_id AS key, round(sum(CASE source WHEN 'exact' THEN 1000.0 WHEN 'source-search' THEN 50.0 * coalesce(score, 1) WHEN 'bm25' THEN coalesce(score, 1) ELSE 10.0 * coalesce(score, 1) END), 6) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM ({CANDIDATES_SQL}) GROUP BY 1"


def queries() -> dict:
    return {
        "postings": lambda s, d: R.postings(chunks(s, d)),
        "chunk_stats": lambda s, d: R.chunk_stats(chunks(s, d)),
        "index_stats": lambda s, d: R.index_stats(R.chunk_stats(chunks(s, d))),
        "bm25_top20": _bm25,
        "literal_search": lambda s, d: R.literal_search(chunks(s, d), LITERALS),
        "merge_candidates": lambda s, d: R.merge_candidates(_candidates(s, d)),
        "recall_page": lambda s, d: R.page(R.merge_candidates(_candidates(s, d)), [F.desc("score"), F.col("key")], 50, 50),
        "vector_top10": lambda s, d: R.vector_search(table(s, d, "embeddings"), VECTOR, 10, 0.05),
        "vector_top10_by_type": lambda s, d: R.vector_search(table(s, d, "embeddings"), VECTOR, 10, 0.0, [1, 3]),
        "fuzzy_search": lambda s, d: R.fuzzy_search(table(s, d, "part"), "smal widgit", {"p_name": 0.4, "p_type": 0.3, "p_brand": 0.2}, "p_partkey"),
        "section_search": lambda s, d: R.section_search(table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("section"), "text"), ["the", "tion"]),
        "read_evidence": lambda s, d: R.read_evidence(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), 2, 3, 500),
        "index_update": lambda s, d: _updated(s, d),
        "identifier_words": lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(split_identifier(F.concat("p_type", "p_brand")), " ").alias("words")),
    }


def _updated(spark, sf):
    now = chunks(spark, sf)
    touched = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("chunk_id")).distinct()
    before = now.join(touched, "chunk_id", "left_anti").unionByName(touched.withColumn("text", F.lit("stale words")))
    return R.update_index(R.postings(before), now, touched)


def oracle_sql() -> dict[str, str]:
    lits = ", ".join(f"('{t}')" for t in LITERALS)
    def near(c):
        words = f"regexp_split_to_array(lower({c}), '[^A-Za-z0-9_]+')"
        return f"list_min(list_concat(list_transform({words}, lambda x: levenshtein(x, 'smal') / 4.0), list_transform({words}, lambda x: levenshtein(x, 'widgit') / 6.0)))"

    weights = {"p_name": 0.4, "p_type": 0.3, "p_brand": 0.2}
    product = " * ".join(f"CASE WHEN {c}_d <= 0.4 THEN pow(greatest({c}_d, 0.001), {w / sum(weights.values())!r}) ELSE 1.0 END" for c, w in weights.items())
    distances = ", ".join(f"{near(c)} AS {c}_d" for c in weights)
    fuzzy = f"SELECT p_partkey, round({product}, 6)::DOUBLE AS score FROM (SELECT p_partkey, {distances} FROM part) WHERE {' OR '.join(f'{c}_d <= 0.4' for c in weights)} ORDER BY score, p_partkey LIMIT 50"
    return {
        "fuzzy_search": fuzzy,
        "postings": POSTINGS_SQL,
        "index_update": POSTINGS_SQL,
        "chunk_stats": STATS_SQL,
        "index_stats": f"SELECT count(*) AS n, sum(length) / count(*) AS mean_length FROM ({STATS_SQL})",
        "bm25_top20": BM25_SQL.format(k=20),
        "literal_search": f"WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT chunk_id, line, term FROM l JOIN (VALUES {lits}) t(term) ON contains(body, term)",
        "merge_candidates": MERGED_SQL,
        "recall_page": f"WITH m AS ({MERGED_SQL}) SELECT *, (SELECT count(*) FROM m) AS total, CASE WHEN (SELECT count(*) FROM m) > 100 THEN CAST(100 AS BIGINT) END AS next_offset FROM m ORDER BY score DESC, key LIMIT 50 OFFSET 50",
        "vector_top10": f"{COSINE_SQL} SELECT vec_id, label, round(1 - similarity, 5) AS score FROM (SELECT * FROM s WHERE similarity >= 0.05 ORDER BY similarity DESC, vec_id LIMIT 10)",
        "vector_top10_by_type": f"{COSINE_SQL} SELECT vec_id, label, round(1 - similarity, 5) AS score FROM (SELECT * FROM s WHERE similarity >= 0 AND label IN (1, 3) ORDER BY similarity DESC, vec_id LIMIT 10)",
        "section_search": "WITH l AS (SELECT conv_id || '-' || turn AS section, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM conversations), m AS (SELECT section, line, CAST(contains(lower(body), 'the') AS INT) AS a, CAST(contains(lower(body), 'tion') AS INT) AS b FROM l), f AS (SELECT section, CAST(arg_min(line, -(a + b) * 1000000 + line) AS INT) AS best_line, CAST(max(a + b) AS INT) AS n_terms FROM m GROUP BY 1 HAVING max(a) = 1 AND max(b) = 1) SELECT section, best_line, n_terms, (SELECT count(*) FROM f) AS total FROM f ORDER BY n_terms DESC, section LIMIT 40",
        "read_evidence": "WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS path, string_split(text, chr(10)) AS l FROM documents), c AS (SELECT path, l, l[2:4] AS cut FROM s WHERE len(l) >= 2), f AS (SELECT path, l, cut, greatest(1, len(list_filter(range(1, len(cut) + 1), lambda i: length(array_to_string(cut[1:i], chr(10))) <= 500))) AS fit FROM c) SELECT path, substring(array_to_string(cut[1:least(fit, len(cut))], chr(10)), 1, 500) AS text, CAST(2 AS BIGINT) AS from_line, CAST(1 + least(fit, len(cut)) AS BIGINT) AS to_line, CASE WHEN 1 + least(fit, len(cut)) < len(l) THEN CAST(2 + least(fit, len(cut)) AS BIGINT) END AS next_line FROM f",
        "identifier_words": f"SELECT p_partkey, array_to_string({WORDS_SQL.format(c='p_type || p_brand')}, ' ') AS words FROM part",
    }
