"""Review of suggestions: queues, bulk decisions, what applies by itself, and what is hard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = ["book_id", "chapter_id", "block_index"]


def queue(suggestions: DataFrame, kinds: tuple[str, ...] = (), least: float = 0.0, contains: str | None = None, status: str | None = None, chapter: object = None, after: tuple | None = None, page: int = 100) -> DataFrame:
    """A page of suggestions in reading order, behind the key ``after``; empty filters let everything pass."""
    rows = suggestions.filter(F.col("confidence") >= least)
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    if contains:
        rows = rows.filter(F.lower("original").contains(contains.lower()))
    if status:
        rows = rows.filter(F.col("status") == status)
    if chapter is not None:
        rows = rows.filter(F.col("chapter_id") == chapter)
    key = ["book_id", "chapter_id", "block_index", "start"]
    if after is not None:
        rows = rows.filter(F.struct(*key) > F.struct(*[F.lit(a).cast(dict(rows.dtypes)[k]).alias(k) for k, a in zip(key, after, strict=True)]))
    return rows.orderBy(*key, "end", "kind").limit(page)


def stats(suggestions: DataFrame) -> DataFrame:
    """Counts by kind, reason and band of confidence."""
    band = F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.7, "medium").otherwise("low")
    return suggestions.groupBy("kind", "reason", band.alias("band")).agg(F.count("*").alias("n"))


def bulk(suggestions: DataFrame, condition: str, status: str, batch: str) -> DataFrame:
    """Set the status of open suggestions under a condition, remembering the batch."""
    hit = F.expr(condition) & (F.col("status") == "open")
    return suggestions.withColumn("batch_id", F.when(hit, batch).otherwise(F.col("batch_id"))).withColumn("status", F.when(hit, status).otherwise(F.col("status")))


def undo(suggestions: DataFrame, batch: str) -> DataFrame:
    hit = F.coalesce(F.col("batch_id") == batch, F.lit(False))
    return suggestions.withColumn("status", F.when(hit, "open").otherwise(F.col("status"))).withColumn("batch_id", F.when(~hit, F.col("batch_id")))


def hard_cases(suggestions: DataFrame, blocks: DataFrame, hard: Column, chars: int = 1200) -> DataFrame:
    """Suggestions under a condition with the text before and after their block."""
    order = Window.partitionBy("book_id", "chapter_id").orderBy("block_index")
    around = blocks.select(*BLOCK, F.right(F.lag("text").over(order), F.lit(chars)).alias("before"), F.left(F.lead("text").over(order), F.lit(chars)).alias("after"))
    return suggestions.filter(hard).join(around, BLOCK)


def without_overlaps(suggestions: DataFrame, taken: DataFrame) -> DataFrame:
    """Suggestions that overlap none of ``taken`` in their block; empty spans overlap nothing.

    A sweep over each block's spans in order: of the taken ones that begin up
    to a suggestion's start, the furthest end decides, and of those that begin
    behind it, the nearest start.  Both are running values of a sort, so time
    grows with the spans of a block, not with its pairs.
    """
    spans = taken.filter("start < end").select(*BLOCK, "start", "end").withColumn("__taken", F.lit(True))
    rows = suggestions.withColumn("__taken", F.lit(False)).unionByName(spans, allowMissingColumns=True)
    block = Window.partitionBy(*BLOCK)
    furthest = F.max(F.when(F.col("__taken"), F.col("end"))).over(block.orderBy("start", F.desc("__taken")).rowsBetween(Window.unboundedPreceding, 0))
    nearest = F.min(F.when(F.col("__taken"), F.col("start"))).over(block.orderBy(F.desc("start"), "__taken").rowsBetween(Window.unboundedPreceding, 0))
    met = (F.col("start") < F.col("end")) & (F.coalesce(F.col("__furthest") > F.col("start"), F.lit(False)) | F.coalesce(F.col("__nearest") < F.col("end"), F.lit(False)))
    return rows.withColumn("__furthest", furthest).withColumn("__nearest", nearest).filter(~F.col("__taken") & ~met).select(*suggestions.columns)


def paint(spans: DataFrame, readings: DataFrame) -> DataFrame:
    """Gender of a reading onto the span with the same offsets, of several the one that stands first (``position``)."""
    key = [*BLOCK, "start", "end"]
    first = readings.groupBy(*key).agg(F.min(F.struct("position", "gender", "confidence")).alias("r")).select(*key, "r.gender", F.col("r.confidence").alias("gender_confidence"))
    return spans.join(first, key, "left")
