"""Sources and sinks: directory and Git snapshots, history, JSON-lines products, index tables."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.functions.text import count_lines, looks_binary

FILE_SCHEMA = "path string, content binary, content_hash string, size long"


def directory_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, content_hash, size) of all files below a directory, read by executors."""
    base = str(root).rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return rows.select(F.substring_index("path", base, -1).alias("path"), "content", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"))


class GitSnapshot(DataSource):
    """The files of a commit, read from the object store in batches of blobs; options ``path`` and ``revision``."""

    #: Files and bytes of a task; a larger file is a task of its own.
    BATCH, BYTES = 512, 64 << 20

    @classmethod
    def name(cls) -> str:
        return "git_snapshot"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options["path"], self.options.get("revision", "HEAD"), self.BATCH, self.BYTES)


class _Blobs(InputPartition):
    def __init__(self, entries: list[tuple[str, str]]):
        super().__init__(None)
        self.entries = entries


class _GitReader(DataSourceReader):
    def __init__(self, path: str, revision: str, batch: int, most_bytes: int):
        self.path, self.revision, self.batch, self.most_bytes = path, revision, batch, most_bytes

    def partitions(self) -> Sequence[InputPartition]:
        listing = subprocess.run(["git", "-C", self.path, "ls-tree", "-r", "-l", "-z", self.revision], capture_output=True, check=True).stdout.decode("utf-8", "replace")
        tasks, held, size = [], [], 0
        for head, _, name in (x.partition("\t") for x in listing.split("\0") if x):
            _, kind, oid, length = head.split()
            if kind != "blob":
                continue
            if held and (len(held) >= self.batch or size + int(length) > self.most_bytes):
                tasks.append(_Blobs(held))
                held, size = [], 0
            held.append((name, oid))
            size += int(length)
        return tasks + [_Blobs(held)] * bool(held)

    def read(self, partition: _Blobs) -> Iterator[tuple]:
        import hashlib

        given = "".join(f"{oid}\n" for _, oid in partition.entries).encode()
        out = subprocess.run(["git", "-C", self.path, "cat-file", "--batch"], input=given, capture_output=True, check=True).stdout
        at = 0
        for name, _ in partition.entries:
            end = out.index(b"\n", at)
            size = int(out[at:end].split()[2])
            body = out[end + 1 : end + 1 + size]
            at = end + size + 2
            yield name, body, hashlib.sha256(body).hexdigest(), size


class GitHistory(DataSource):
    """File changes of a repository's commits without merges, newest first; options ``path`` and ``since``."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return "commit_seq long, commit string, author_email string, committed_at timestamp, status string, path string, old_path string, added long, removed long"

    def reader(self, schema) -> DataSourceReader:
        return _HistoryReader(self.options["path"], self.options.get("since"))


def _commits(stream, size: int = 1 << 20) -> Iterator[str]:
    """The commits of a log in which each begins with a 1 byte, one at a time."""
    held = b""
    while chunk := stream.read(size):
        *whole, held = (held + chunk).split(b"\x01")
        yield from (x.decode("utf-8", "replace") for x in whole if x.strip(b"\0\n"))
    if held.strip(b"\0\n"):
        yield held.decode("utf-8", "replace")


class _HistoryReader(DataSourceReader):
    def __init__(self, path: str, since: str | None):
        self.path, self.since = path, since

    def read(self, partition) -> Iterator[tuple]:
        import datetime

        command = ["git", "-C", self.path, "log", "--no-merges", "-M", "--raw", "--numstat", "-z", "--format=%x01%H%x02%ae%x02%ct"]
        with subprocess.Popen(command + ([f"--since={self.since}"] if self.since else []), stdout=subprocess.PIPE) as run:
            for seq, commit in enumerate(_commits(run.stdout)):
                yield from self._changes(seq, commit, datetime)
        if run.returncode:
            raise OSError(f"git log failed with {run.returncode}")

    def _changes(self, seq: int, commit: str, datetime) -> Iterator[tuple]:
        head, _, rest = commit.partition("\0") if "\0" in commit else (commit, "", "")
        sha, email, seconds = head.strip().split("\x02")
        when = datetime.datetime.fromtimestamp(int(seconds), datetime.UTC)
        fields, i = [f.lstrip("\n") for f in rest.split("\0")], 0
        raw, counts = [], {}
        while i < len(fields):
            f = fields[i]
            if f.startswith(":"):
                status = f.split()[-1]
                moved = status[0] in "RC"
                raw.append((status[0], fields[i + 2] if moved else fields[i + 1], fields[i + 1] if moved else None))
                i += 3 if moved else 2
            elif f.count("\t") == 2:
                plus, minus, name = f.split("\t")
                moved = name == ""
                counts[fields[i + 2] if moved else name] = tuple(None if x == "-" else int(x) for x in (plus, minus))
                i += 3 if moved else 1
            else:
                i += 1
        for status, path, old in raw:
            yield (seq, sha, email.lower(), when, status, path, old, *counts.get(path, (None, None)))


def git_snapshot(spark: SparkSession, path: str, revision: str = "HEAD") -> DataFrame:
    spark.dataSource.register(GitSnapshot)
    return spark.read.format("git_snapshot").option("path", path).option("revision", revision).load()


def git_history(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    spark.dataSource.register(GitHistory)
    reader = spark.read.format("git_history").option("path", path)
    return (reader.option("since", since) if since else reader).load()


def multi_snapshot(members: dict[str, DataFrame]) -> DataFrame:
    """Several snapshots as one, with paths below their member's id."""
    parts = [df.withColumn("path", F.concat(F.lit(f"{m}/"), "path")).withColumn("member_id", F.lit(m)) for m, df in members.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefixes(files: DataFrame, n: int) -> DataFrame:
    return files.select("path", F.substring("content", 1, n).alias("head"))


def line_counts(files: DataFrame) -> DataFrame:
    """(path, lines): null for binary files, those with a NUL in the first 8000 bytes."""
    return files.select("path", F.when(~looks_binary(F.col("content"), 8000), count_lines(F.decode("content", "UTF-8"))).alias("lines"))


def write_jsonl(header: dict, streams: dict[str, DataFrame], path: str) -> None:
    """A JSON-lines product: one part per stream and a header with the counts of all."""
    import json

    counts = {}
    for kind, df in streams.items():
        df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/{kind}")
        counts[kind] = df.sparkSession.read.text(f"{path}/{kind}").count()  # of what was written, not of a second evaluation
    spark = next(iter(streams.values())).sparkSession
    spark.createDataFrame([(json.dumps(header | {"counts": counts}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def read_jsonl(spark: SparkSession, path: str, schemas: dict[str, str]) -> tuple[dict, dict[str, DataFrame]]:
    """The header and streams of a product; fails if a count differs from the header's or a record can't be read."""
    import json

    header = json.loads(spark.read.text(f"{path}/header").first()[0])
    out = {}
    for kind, schema in schemas.items():
        rows = spark.read.text(f"{path}/{kind}").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        if rows.count() != header["counts"].get(kind):
            raise ValueError(f"{kind}: the header has {header['counts'].get(kind)} records")
        out[kind] = rows
    return header, out


def guarded_json(rows: DataFrame, most_bytes: int) -> DataFrame:
    """Rows as JSON text; fails on one that is larger than the ceiling."""
    text = F.to_json(F.struct("*"))
    return rows.select(F.when(F.octet_length(text) <= most_bytes, text).otherwise(F.raise_error(F.lit("a record is over the ceiling"))).alias("value"))


def write_index(postings: DataFrame, stats: DataFrame, path: str) -> None:
    """Postings sorted by term, so that a query's terms prune row groups, and chunk statistics."""
    postings.repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")


def publish(staged: dict[str, DataFrame], path: str, checks: Sequence[DataFrame] = ()) -> str:
    """Writes products to a new version folder, checks that no check has a row, and then makes it the current one; a failed check publishes nothing.

    The version becomes current by one rename, of a marker named after the time, so there is always a whole
    current version, also while another one is published; readers take the newest marker.
    """
    import uuid

    version = uuid.uuid4().hex
    for name, df in staged.items():
        df.write.parquet(f"{path}/{version}/{name}")
    for c in checks:
        if (bad := c.first()) is not None:
            raise ValueError(f"not published: {bad}")
    spark = next(iter(staged.values())).sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{version}/.published")
    fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current"))
    fs.create(marker, True).close()
    if not fs.rename(marker, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current/{time.time_ns():020d}-{version}")):
        raise OSError("the version could not be made current")
    return version


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    version = max(names).partition("-")[2]
    return spark.read.parquet(f"{path}/{version}/{name}")


def local_files(root: str) -> list[str]:
    """Member repositories below a parent directory."""
    return sorted(str(p.parent) for p in Path(root).glob("*/.git"))
