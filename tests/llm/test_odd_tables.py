"""Cases by hand: certified cutoffs, rows without an id, clashing columns, unknown code points, blocks, odd pipelines."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import bpe_automaton, cross_parsing, risk_rules, suffix_dedup, winnowing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def labelled(tmp_path_factory, spark):
    """Enough labels in two strata for certified cutoffs, in good texts and in bad ones full of symbols; with odd texts."""
    rng, folder = random.Random(3), tmp_path_factory.mktemp("labelled")
    words = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(4600):
        bad = i % 4 == 0
        text = " ".join(rng.choices(words, k=55)) + (" ### $$$" * rng.randrange(10, 20) if bad else "")
        docs.append((i, text, "en" if i // 4 % 2 else None, "s", len(text)))
        if i < 4500:
            labels.append((i, 0 if bad else 1, 0))
    docs += [(9000, None, "en", "s", 0), (9001, "", None, "s", 0), (9002, "one", "en", "s", 3), (9003, " \n ", "", "s", 3), (9004, "word " * 60, "", "s", 300)]
    docs[2] = (2, docs[2][1], "", "s", 0)
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_certified_cutoffs_meet_texts_without_words(spark, labelled):
    got = risk_rules.op3(spark, labelled)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert all(not rows[i]["kept"] and rows[i]["base_failed"] for i in (9000, 9001, 9002, 9003))
    assert not any(rows[i]["kept"] for i in range(4, 4600, 4)) and all(rows[i]["kept"] for i in range(4600) if i % 4)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{labelled}/{name}.parquet/*.parquet'")
    found = con.execute(risk_rules.OP3_SQL)
    names = [d[0] for d in found.description]
    want = {dict(zip(names, r, strict=True))["doc_id"]: dict(zip(names, r, strict=True)) for r in found.fetchall()}
    assert {i: r.asDict() for i, r in rows.items()} == want


def test_null_stratum_is_not_the_empty_one(spark, labelled):
    docs, labels = spark.read.parquet(f"{labelled}/documents.parquet"), spark.read.parquet(f"{labelled}/labels.parquet")
    measured = risk_rules.signals(docs.withColumn("odd name", F.col("lang")), ["odd name"], "doc_id", "text").withColumnRenamed("odd name", "st")
    assert {s for s, _ in risk_rules.learn_cutoffs(measured, labels, "st")} == {"", "=en"}


def test_repeats_of_rows_without_or_with_one_id(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=150))
    rows = [(1, text), (2, "x" + text), (None, text), (None, None), (3, text), (3, "short"), (3, text[:120])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r["n_removed"] <= r["n_bytes"] for r in got)
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] in (None, 1)) and [r["n_removed"] for r in got if r["doc_id"] == 2] == [150]
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=5000)


def test_one_passage_in_very_many_surroundings(spark):
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefgh ", k=140))
    rows = [(i, "".join(rng.choices("ijklmno", k=90)) + passage + "".join(rng.choices("ijklmno", k=90))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen, want = set(), {}
    for i, text in rows:
        gone = {k for a in range(len(text) - 99) if text[a : a + 100] in seen for k in range(a, a + 100)}
        seen |= {text[a : a + 100] for a in range(len(text) - 99)}
        want[i] = len(gone)
    for hot in (20_000, 10):
        assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(df, hot=hot).collect()} == want
    assert min(want[i] for i in range(1, 60)) == 140


def test_stages_give_back_clashing_columns(spark):
    schema = "doc_id long, text string, score double, contaminated boolean, n_words long, held_out int, lang_pred string, lang string"
    rows = [(i, f"some words of the text number {i} that are like others of the kind", 99.0, True, 77, 5, "zz", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, cross_parsing.keep_identified(docs).collect())) == rows
    bench = spark.createDataFrame([(1, "nothing of this is there")], "item_id long, text string")
    assert sorted(map(tuple, winnowing.decontaminate(docs, bench).collect())) == rows


def test_blocks_of_the_benchmark(spark):
    items = [(i, " ".join(f"b{i}w{j}" for j in range(12))) for i in range(9)]
    docs = [(i, f"intro {items[i % 9][1]} outro") for i in range(12)] + [(None, items[3][1]), (None, None), (5, "other text")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: repr(tuple(r))
    one = sorted(winnowing.mark_hits(df, bench).collect(), key=key)
    assert one == sorted(winnowing.mark_hits(df, bench, block_bytes=200).collect(), key=key) and sum(r["contaminated"] for r in one) == 13
    with pytest.raises(ValueError):
        winnowing.mark_hits(df, bench, block_bytes=0)


def test_code_points_that_python_does_not_know():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe_automaton.default_path()), bpe_automaton.WordBpe(bpe_automaton.default_path())
    library.no_truncation()
    rng = random.Random(4)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for c in [0x558, 0x88F, 0xA7DC, 0x1C89, 0x10940, 0x11382, *rng.sample(points, 4000)]:
        text = f"a{chr(c)}b1 {chr(c)}{chr(c)}x"
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(c)


@pytest.mark.parametrize("case", ["empty", "odd", "more columns"])
def test_pipeline_on_odd_tables(spark, tmp_path, odd_docs, case):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.limit(0) if case == "empty" else docs.union(docs.withColumn("doc_id", F.lit(None).cast("long"))) if case == "odd" else odd_docs
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "some words that are in none of these texts at all, really")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    assert "ids_sha256" in out.columns and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    ids = {r["doc_id"] for r in rows}
    assert (not rows) if case == "empty" else {5, 9, 10, 12} <= ids and not ids & {0, 1, 2, 3}


HAND_WRITTEN = [
    (
        '<html><body><nav><a href=x>menu</a></nav><article><h1>Title here</h1><p>A first long paragraph with several words, and more of them to read.</p><p hidden>secret words are not shown to anybody here</p><p style="display:none">other unseen text of some length is here</p><p style="border:none">A second paragraph which is seen, with plenty of words in it.</p><p aria-label="hidden x">Third paragraph, seen as well by all who read it.</p></article><footer>foot</footer></body></html>',
        "Title here\nA first long paragraph with several words, and more of them to read.\nA second paragraph which is seen, with plenty of words in it.\nThird paragraph, seen as well by all who read it.",
    ),
    (
        '<!doctype html><body><header><h2>The Daily</h2></header><ul class="menu"><li><a href="/a">Home</a><li><a href="/b">News</a></ul><div id="content"><h1>Rain &amp; wind</h1><p>It rained all day in the valley, and the river rose by a foot before night.<p>Nobody was hurt, the mayor said, and the bridge will be open again on Friday.<blockquote><p>We have seen worse than this in other years, she added.</p></blockquote></div><div class="sidebar"><h3>Related</h3><ul><li><a href="/c">More rain</a></li><li><a href="/d">More wind</a></li></ul></div><div class="comments"><div class="comment"><p>First!</p></div></div></body>',
        "Rain & wind\nIt rained all day in the valley, and the river rose by a foot before night.\nNobody was hurt, the mayor said, and the bridge will be open again on Friday.\nWe have seen worse than this in other years, she added.",
    ),
]


@pytest.mark.parametrize(("page", "text"), HAND_WRITTEN)
def test_pages_by_hand(page, text):
    from corvane.llm import html_main_text

    assert html_main_text.default_model().extract([page]) == [text]
