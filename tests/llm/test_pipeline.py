"""The pipeline over a small folder, against its stages by brute force."""

import corpus_pipeline
from corvane.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_run(spark, tmp_path):
    one = "the river runs past an old mill where nobody has ground any corn for many years now"
    two = "a completely different sentence about mountains snow and the long way down to warmer valleys"
    item = "seven hidden benchmark words that no training text should ever hold at all"
    rows = [(0, one, "en"), (1, one, "en"), (2, one + "\n" + two, "en"), (3, "12 3 !", "en"), (4, None, "en"), (5, "intro\n" + item + " and more", "en"), (6, "short clean note", None)]
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    # 3 and 4 have no language; 1 loses its only line to 0 and 2 its first one; 5 holds an item
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == [(0, one), (2, two), (6, "short clean note")]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 6] and all(r["n_tokens"] == len(r["ids"]) for r in out.collect())


def test_near_copies_of_five_word_shingles(spark):
    words = [f"w{i}" for i in range(120)]
    near = [*words[:60], "other", *words[61:]]
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, " ".join(words[:50]), "en", "s", 1)]
    kept = corpus_pipeline.near_deduplication(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
