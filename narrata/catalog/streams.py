"""Queries that run over the events as streams, in micro-batches whose order is not that of the events."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from narrata.catalog.jobs import SQL as JOBS_SQL
from narrata.catalog.jobs import STATES_SQL, events, thinned
from narrata.sources.shared import new_path
from narrata.streaming import stateful

#: Parts of the stream, each a micro-batch.
PARTS = 4


def _arriving(spark: SparkSession, rows: DataFrame, order=None) -> DataFrame:
    """Rows as a stream of PARTS micro-batches: dealt at random, or by ``order``.

    A part has a file for each core, and a job's rows of a part are in one of
    them, so they come in the order of the parts however files fall to batches.
    """
    path, dealt, files = new_path(spark, "arriving"), new_path(spark, "dealt"), spark.sparkContext.defaultParallelism
    rows.withColumn("__n", F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)) if order is None else order).write.partitionBy("__n").parquet(dealt)
    shape = StructType([*rows.schema.fields, StructField("__n", IntegerType())])
    for k in range(PARTS):
        spark.read.schema(shape).parquet(dealt).filter(F.col("__n") == k).drop("__n").repartition(files, "job_id").write.mode("append").parquet(path)
    return stateful.with_state_store(spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _all(spark: SparkSession, stream: DataFrame, rows: int) -> DataFrame:
    """What a stream makes of so many rows, with the number of the micro-batch."""
    path, at = new_path(spark, "streamed"), new_path(spark, "progress")

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that runs again replaces its own rows.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/{number}")

    # Processors with timers run on without data, so the stream is ended once it has read all rows.
    query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", at).trigger(processingTime="500 milliseconds").start()
    read_rows(query, rows)
    return spark.read.option("recursiveFileLookup", "true").schema(stream.schema.add("batch", "integer")).parquet(path)


def read_rows(query: StreamingQuery, rows: int, seconds: float = math.inf) -> None:
    """Wait until a query has read so many rows, however long that takes unless ``seconds`` are given, and stop it."""
    seen, until = {}, time.monotonic() + seconds
    try:
        while sum(seen.values()) < rows:
            if not query.isActive or time.monotonic() > until:
                raise TimeoutError(f"the stream has read {sum(seen.values())} of {rows} rows: {query.exception()}")
            query.awaitTermination(0.2)
            seen |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
    finally:
        query.stop()


def _numbered(spark, sf_dir):
    """Events whose numbers have no gaps within a job."""
    return events(spark, sf_dir).select("job_id", F.row_number().over(Window.partitionBy("job_id").orderBy("seq")).cast("long").alias("seq"), "kind", "event")


def fold_job_state_stream(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    last = _all(spark, stateful.fold_in_order(_arriving(spark, rows)), rows.count())
    return last.groupBy("job_id").agg(F.max_by(F.struct("state", "illegal", "events", "last_seq", "waiting"), "batch").alias("r")).select("job_id", "r.*")


def missing_seq_stream(spark, sf_dir):
    rows = thinned(spark, sf_dir).select("job_id", "seq")
    told = _all(spark, stateful.gaps(_arriving(spark, rows)), rows.count())
    still = told.groupBy("job_id", "after", "before", "lost").agg(F.max_by("open", "batch").alias("open"))
    return still.filter("open").drop("open")


def hysteresis_pause_stream(spark, sf_dir):
    rows = events(spark, sf_dir).select("job_id", "seq", "value")
    order = F.ntile(PARTS).over(Window.partitionBy("job_id").orderBy("seq")) - 1
    return _all(spark, stateful.pauses(_arriving(spark, rows, order), 5.0, every_ms=3_600_000), rows.count()).drop("batch")


def latest_job_record_stream(spark, sf_dir):
    table = stateful.latest_table(new_path(spark, "latest"), 16)
    stream = _arriving(spark, events(spark, sf_dir).select("job_id", "seq", "event", "value"))
    stateful.upsert_latest(stream, table).option("checkpointLocation", new_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return table.read(spark)


QUERIES = {
    "fold_job_state_stream": fold_job_state_stream,
    "missing_seq_stream": missing_seq_stream,
    "hysteresis_pause_stream": hysteresis_pause_stream,
    "latest_job_record_stream": latest_job_record_stream,
}

SQL = {
    "fold_job_state_stream": f"SELECT job_id, state, illegal, events, events AS last_seq, 0::BIGINT AS waiting FROM ({STATES_SQL})",
    "missing_seq_stream": JOBS_SQL["missing_seq"],
    "hysteresis_pause_stream": JOBS_SQL["hysteresis_pause"],
    "latest_job_record_stream": JOBS_SQL["latest_job_record"],
}
