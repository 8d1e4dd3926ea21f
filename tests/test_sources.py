"""Files go out and come back; streams agree with batches."""

from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from narrata import sources, streaming
from narrata.catalog.base import table
from narrata.plans import jobs
from narrata.sources.shared import BATCHES


def test_plan_lines_round_trip(spark, tmp_path):
    rows = [("b", k, "c", "narrator", f"text {k}", "tts", f"k{k}") for k in range(20)]
    plan = spark.createDataFrame(rows, sources.PLAN)
    sources.write_plan(plan, f"{tmp_path}/plan")
    assert sorted(map(tuple, sources.read_plan(spark, f"{tmp_path}/plan").collect())) == sorted(rows)


def test_unreadable_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "name": "x", "schema_version": 1, "updated_at": "2024", "created_at": "2024"}\n{broken\n')
    assert [r.id for r in sources.read_jobs(spark, f"{tmp_path}/a.json").collect()] == ["1"]
    assert [(r.id, r.unreadable) for r in sources.library(spark, f"{tmp_path}/a.json").collect()] == [("1", False), (None, True)]
    lines = spark.createDataFrame([("a", '{"id": "1", "name": "x", "schema_version": 1}'), ("b", "{"), ("c", '{"id": "1", "name": "x", "schema_version": 9}'), ("d", "{}")], "path string, value string")
    assert {r.path: r.reason for r in sources.validate_manifests(lines).collect()} == {"a": None, "b": "not_json", "c": "schema_too_new", "d": "missing_field"}


def test_chunk_index_replaces_one_book(spark, tmp_path):
    path = f"{tmp_path}/index"
    sources.write_chunk_index(spark.createDataFrame([("k1", "a"), ("k2", "b")], "render_key string, book_id string"), path)
    sources.write_chunk_index(spark.createDataFrame([("k3", "a")], "render_key string, book_id string"), path)
    assert {(r.book_id, r.render_key) for r in spark.read.parquet(path).collect()} == {("a", "k3"), ("b", "k2")}


def test_streams_equal_batches(spark, tmp_path):
    names = ["start", "pause", "resume", "rendered", "muxed", "nonsense", "fail"]
    rows = [(k % 3, k, datetime(2024, 1, 1) + timedelta(seconds=k), "prep" if k % 3 else "record", names[k // 3 % 7], float(k)) for k in range(60)]
    schema = "job_id long, seq long, ts timestamp, kind string, event string, value double"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20] + rows[part * 20 : part * 20 + 3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    once = streaming.deduplicate(stream).writeStream.format("memory").queryName("once").outputMode("append").start()
    once.processAllAvailable()
    once.stop()
    assert sorted(r.seq for r in spark.table("once").collect()) == list(range(60))
    clean = spark.createDataFrame(rows, schema)
    clean.coalesce(1).write.parquet(f"{tmp_path}/clean")
    folded = streaming.fold_states(spark.readStream.schema(schema).parquet(f"{tmp_path}/clean")).writeStream.format("memory").queryName("folded").outputMode("update").start()
    folded.processAllAvailable()
    folded.stop()
    expected = {(r.job_id, r.state, r.illegal, r.events, r.last_seq) for r in jobs.fold_states(clean).collect()}
    assert {tuple(r) for r in spark.table("folded").collect()} == expected


def test_batches_of_queries_are_bounded(spark, tmp_path):
    """A worker gets long blocks in batches of a few megabytes, however many rows there are."""
    spark.range(400).select(F.repeat(F.lit("x"), 50_000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    held = {name: spark.conf.get(name) for name in BATCHES}
    try:
        size = F.arrow_udf(lambda texts: pa.array([texts.nbytes] * len(texts), pa.int64()), "long")
        assert table(spark, str(tmp_path), "documents").select(size("text").alias("n")).agg(F.max("n")).first()[0] <= 5_000_000
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
