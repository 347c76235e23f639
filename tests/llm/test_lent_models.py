"""Models of the pipeline's stages leave a worker's memory when its task ends."""

import os

import pyarrow as pa
from pyspark import Broadcast

import corpus_pipeline
from corvane.llm import bpe_automaton, cross_parsing
from corvane.llm.arrays import map_texts
from corvane.llm.recovery import trimmed

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(0, "the river runs past an old mill", "en", "s", 31), (2, "el viejo molino junto al largo camino", "es", "s", 37), (3, None, None, None, None)]


def test_value_goes_at_the_end_and_is_read_again(tmp_path):
    path = f"{tmp_path}/model"
    Broadcast.dump(Broadcast(path=path), {"a": 1}, open(path, "wb"))
    lent = Broadcast(path=path)
    batch = pa.RecordBatch.from_pydict({"x": [1]})

    def run():
        assert lent.value == {"a": 1}
        yield batch
        assert "_value" in vars(lent)

    for _ in range(2):
        assert list(trimmed(run(), lent)) == [batch]
        assert "_value" not in vars(lent)
    assert list(trimmed(run())) == [batch] and "_value" in vars(lent)


def test_value_without_a_file_stays(tmp_path):
    path = f"{tmp_path}/model"
    Broadcast.dump(Broadcast(path=path), [1], open(path, "wb"))
    with open(path, "rb") as sock:
        lent = Broadcast(sock_file=sock)
    list(trimmed([], lent))
    assert lent.value == [1]


def test_workers_drop_it_between_tasks(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").repartition(20)
    for kept in (True, False):
        shared = spark.sparkContext.broadcast(list(range(1000)))

        def work(texts, shared=shared):
            fresh = "_value" not in vars(shared)
            return {"n": pa.array([len(shared.value)] * len(texts), pa.int64()), "fresh": pa.array([fresh] * len(texts)), "pid": pa.array([os.getpid()] * len(texts), pa.int64())}

        out = map_texts(docs, work, "n long, fresh boolean, pid long", lent=None if kept else shared).collect()
        assert len(out) == 40 and {r["n"] for r in out} == {1000}
        assert all(r["fresh"] for r in out) != kept


def test_stages_of_the_pipeline_lend_their_models(spark, monkeypatch):
    seen = []
    for module in (cross_parsing, bpe_automaton):
        monkeypatch.setattr(module, "map_texts", lambda *a, f=module.map_texts, **k: seen.append(k.get("lent")) or f(*a, **k))
    docs = spark.createDataFrame(ROWS, COLUMNS)
    found = corpus_pipeline.language_id(spark, docs, "")
    assert [r["doc_id"] for r in found.orderBy("doc_id").collect()] == [0, 2]
    tokens = corpus_pipeline.tokenization(spark, docs, "").orderBy("doc_id").collect()
    held = bpe_automaton.encode_documents(spark, docs, ids=True).drop("decoded").orderBy("doc_id").collect()
    assert tokens == held and len(tokens) == 3
    assert [x is not None for x in seen] == [True, True, False]
