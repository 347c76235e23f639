"""The streaming extension on files that are there from the start."""

from pyspark.sql import functions as F

from corvane.operators import retrieval
from corvane.streaming import index


def test_newest_version_counts(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "chunk_id string, text string, changed_at long"
    first, second = [("a", "one two", 5), ("a", "old", 4), ("b", "two", 1)], [("b", "three three", 2)]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        index.maintain_index(spark.readStream.schema(schema).parquet(source), out, f"{tmp_path}/c").awaitTermination()
    want = retrieval.postings(spark.createDataFrame([first[0], second[0]], schema).drop("changed_at"))
    assert sorted(map(tuple, index.newest_postings(spark, out).collect())) == sorted(map(tuple, want.collect()))


def test_event_counts_are_windowed(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = index.event_counts(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    assert got.agg(F.sum("events")).first()[0] == rows.count()
