"""Reading and writing: plans, event logs, job records, manifests, chunk indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN = "book_id string, ordinal long, chapter_id string, voice_slot string, spoken_text string, kind string, render_key string"
EVENT = "v int, seq long, ts string, type string, job_id string, payload map<string,string>"
JOB = "id string, project_id string, kind string, state string, created_at string, last_seq long, _corrupt_record string"
MANIFEST = "id string, name string, schema_version int, updated_at string, _corrupt_record string"


def write_plan(plan: DataFrame, path: str) -> None:
    """Plan lines as JSON, in the order of their ordinals within range-partitioned files."""
    plan.repartitionByRange("book_id", "ordinal").sortWithinPartitions("book_id", "ordinal").write.mode("overwrite").json(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLAN).json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event lines; those that are not JSON have no sequence number and are dropped."""
    return spark.read.schema(EVENT).json(path).filter("seq IS NOT NULL")


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path).filter("seq IS NOT NULL")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job records, newest first; unreadable ones are left out."""
    rows = spark.read.schema(JOB).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.filter("_corrupt_record IS NULL AND id IS NOT NULL").drop("_corrupt_record").orderBy(F.desc("created_at"), "id")


def library(spark: SparkSession, path: str) -> DataFrame:
    """Every manifest by time of change; unreadable ones stay, flagged."""
    rows = spark.read.schema(MANIFEST).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.withColumn("unreadable", F.col("_corrupt_record").isNotNull() | F.col("id").isNull()).drop("_corrupt_record").orderBy(F.desc_nulls_last("updated_at"))


def validate_manifests(lines: DataFrame, newest: int = 1) -> DataFrame:
    """Why a manifest's text (path, value) cannot be used, or null."""
    parsed = F.from_json("value", "id string, name string, schema_version int")
    rows = lines.withColumn("m", parsed)
    reason = F.when(F.get_json_object("value", "$").isNull(), "not_json").when(F.col("m.schema_version").isNull() | F.col("m.id").isNull() | F.col("m.name").isNull(), "missing_field").when(F.col("m.schema_version") > newest, "schema_too_new")
    return rows.select("path", reason.alias("reason"))


def write_chunk_index(chunks: DataFrame, path: str) -> None:
    """Replace the index of the books in ``chunks``; other books' partitions stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)
