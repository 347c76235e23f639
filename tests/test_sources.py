"""Sources and sinks on a small repository made for the test."""

import subprocess

import pytest
from pyspark.sql import functions as F

from corvane.operators import retrieval
from corvane.sources import readers, snapshot


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.email=A@x.org", "-c", "user.name=a", *a], check=True, capture_output=True)
    git("init", "-q")
    (root / "pkg").mkdir()
    (root / "pkg/a.py").write_text("import os\n\nclass K:\n    def m(self, x):\n        return helper(x)\n\n\ndef helper(x):\n    return os.path.join(x)\n")
    (root / "bin.dat").write_bytes(b"\0\1\2")
    git("add", ".")
    git("commit", "-qm", "one")
    git("mv", "pkg/a.py", "pkg/b.py")
    (root / "n.go").write_text("package n\nfunc Run() {}\n")
    git("add", ".")
    git("commit", "-qm", "two")
    return str(root)


def test_git_and_directory_agree(spark, repo):
    tree = {r["path"]: r["content_hash"] for r in snapshot.git_snapshot(spark, repo).collect()}
    disk = {r["path"]: r["content_hash"] for r in snapshot.directory_snapshot(spark, repo).where("path not like '.git/%'").collect()}
    assert tree == disk and set(tree) == {"pkg/b.py", "bin.dat", "n.go"}
    lines = {r["path"]: r["lines"] for r in snapshot.line_counts(snapshot.git_snapshot(spark, repo)).collect()}
    assert lines == {"pkg/b.py": 9, "bin.dat": None, "n.go": 2}


def test_history(spark, repo):
    rows = sorted((r["commit_seq"], r["status"], r["path"], r["old_path"], r["added"]) for r in snapshot.git_history(spark, repo).collect())
    assert rows == [(0, "A", "n.go", None, 2), (0, "R", "pkg/b.py", "pkg/a.py", 0), (1, "A", "bin.dat", None, None), (1, "A", "pkg/a.py", None, 9)]


def test_structure(spark, repo):
    files = snapshot.git_snapshot(spark, repo).select("path", F.decode("content", "UTF-8").alias("text"), readers.language(F.col("path")).alias("language"))
    got = {r["path"]: r for r in readers.extract_structure(files).collect()}
    assert [(f["name"], f["owner"], f["start"]) for f in got["pkg/b.py"]["functions"]] == [("m", "K", 4), ("helper", None, 8)]
    assert [(c["caller"], c["callee"]) for c in got["pkg/b.py"]["calls"]] == [("m", "helper"), ("helper", "join")]
    assert (got["n.go"]["status"], got["bin.dat"]["status"]) == ("parsed", "no-extractor")
    broken = spark.createDataFrame([("x.py", "python", "def ("), ("y.py", "python", "# nothing"), ("z.py", "python", None)], "path string, language string, text string")
    assert {r["path"]: r["status"] for r in readers.extract_structure(broken).collect()} == {"x.py": "parse-failed", "y.py": "zero-symbol", "z.py": "zero-symbol"}


def test_selection_and_ignore(spark):
    paths = ["a/key.pem", "x.zip", "node_modules/a.js", "src/keep.log", "src/a.log", "build/out/x", "src/a.py"]
    rows = spark.createDataFrame([(p, None) for p in paths], "path string, head string")
    ignored = readers.ignore_filter(["node_modules/", "*.log", "!keep.log", "/build"])
    got = {r["path"]: r["s"] for r in rows.select("path", readers.selection(F.col("path"), F.col("head"), ignored(F.col("path"))).alias("s")).collect()}
    assert got == dict(zip(paths, ["sensitive", "archive", "ignored", "selected", "ignored", "ignored", "selected"], strict=True))


def test_products(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    snapshot.write_jsonl({"version": 1}, {"nodes": nodes}, f"{tmp_path}/g")
    header, streams = snapshot.read_jsonl(spark, f"{tmp_path}/g", {"nodes": "id string, n int"})
    assert header["version"] == 1 and sorted(map(tuple, streams["nodes"].collect())) == [("a", 1), ("b", None)]
    chunks = spark.createDataFrame([("c", "one two two")], "chunk_id string, text string")
    snapshot.write_index(retrieval.postings(chunks), retrieval.chunk_stats(chunks), f"{tmp_path}/i")
    p, s = snapshot.read_index(spark, f"{tmp_path}/i")
    assert retrieval.bm25(p, s, ["two"]).count() == 1
    snapshot.publish({"nodes": nodes}, f"{tmp_path}/p", [nodes.where("id = 'z'")])
    with pytest.raises(ValueError):
        snapshot.publish({"nodes": nodes.limit(0)}, f"{tmp_path}/p", [nodes])
    assert snapshot.current(spark, f"{tmp_path}/p", "nodes").count() == 2
