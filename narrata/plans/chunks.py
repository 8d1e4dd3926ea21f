"""Plan items by content: keys, reuse of rendered chunks, differences of plans."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHARS_PER_SECOND = 14.0


def _composed(texts: pa.Array) -> pa.Array:
    if pc.all(pc.string_is_ascii(texts)).as_py():
        return texts
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def text_key(text: Column) -> Column:
    """Hash of the text, composed (NFC) and stripped."""
    return F.sha2(F.regexp_replace(F.arrow_udf(_composed, "string")(text), r"(?U)^\s+|\s+$", "").cast("binary"), 256)


def content_key(text: Column, **parts: Column) -> Column:
    """A 32-digit key of the text and of what else decides its sound.

    The parts stand by name in JSON, nulls included, so that neither a
    separator nor a missing part makes two sounds one key.
    """
    named = [F.lit("2").alias("version"), text_key(text).alias("text"), *(c.cast("string").alias(n) for n, c in sorted(parts.items()))]
    return F.substring(F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}).cast("binary"), 256), 1, 32)


def estimate_seconds(text: Column) -> Column:
    return F.length(text) / F.lit(CHARS_PER_SECOND)


def number_items(items: DataFrame) -> DataFrame:
    """Ordinals from 0 over a book by (chapter_id, run, piece), counted per chapter first.

    The window over a book sees one row per chapter, the one over a chapter
    its items, so no task holds a whole book's text.
    """
    before = F.sum("n").over(Window.partitionBy("book_id").orderBy("chapter_id").rowsBetween(Window.unboundedPreceding, -1))
    chapters = items.groupBy("book_id", "chapter_id").agg(F.count("*").alias("n")).select("book_id", "chapter_id", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("book_id", "chapter_id").orderBy("run", "piece")) - 1
    return items.withColumn("inside", inside).join(chapters, ["book_id", "chapter_id"]).withColumn("ordinal", F.col("before") + F.col("inside")).drop("before", "inside")


def dedupe_renders(items: DataFrame) -> DataFrame:
    """Which items are rendered: the first of each key by ordinal; later ones count as reused.

    The first items are joined by their place, so a key that very many items
    share, such as that of silence, is dealt out like any other.
    """
    first = items.groupBy("render_key").agg(F.min(F.struct("book_id", "ordinal")).alias("first")).select("render_key", "first.*", F.lit(False).alias("reused"))
    return items.join(first, ["render_key", "book_id", "ordinal"], "left").withColumn("reused", F.coalesce("reused", F.lit(True)))


def reuse_split(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Speech items with whether a chunk of equal size and duration exists (render_key, size, duration_s)."""
    have = chunks.filter("file_size = size AND file_duration_s = duration_s").select("render_key").distinct().withColumn("found", F.lit(True))
    return items.filter("kind <> 'silence'").join(have, "render_key", "left").withColumn("reusable", F.coalesce("found", F.lit(False))).drop("found")


def reconcile(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Every key of either side: reusable if both are there and agree, else quarantined with a reason."""
    both = files.join(sidecars, "render_key", "full_outer")
    reason = F.when(F.col("file_size").isNull(), "no_file").when(F.col("size").isNull(), "no_sidecar").when((F.col("file_size") != F.col("size")) | (F.col("file_duration_s") != F.col("duration_s")), "mismatch")
    return both.select("render_key", reason.isNull().alias("reusable"), reason.alias("reason"))


def listed_chunks(spark: SparkSession, path: str, rate: int, header: int = 44) -> DataFrame:
    """(render_key, file_size, file_duration_s) of the ``.wav`` files under a folder, from their names and sizes alone.

    A file still being written (``.part``) is none.  ``rate`` is the bytes of
    a second of sound behind a header.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return found.select(_stem(F.col("path")).alias("render_key"), F.col("length").alias("file_size"), (F.greatest(F.col("length") - header, F.lit(0)) / rate).alias("file_duration_s"))


def listed_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(render_key, size, duration_s) of the ``.json`` files under a folder; of one that cannot be read both are null."""
    rows = spark.read.schema("size long, duration_s double").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    return rows.select(_stem(F.col("_metadata.file_path")).alias("render_key"), "size", "duration_s")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)


def reconcile_folder(spark: SparkSession, path: str, rate: int) -> DataFrame:
    """``reconcile`` of the files and sidecars under a folder; no sound is read."""
    return reconcile(listed_chunks(spark, path, rate), listed_sidecars(spark, path))


def plan_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of two plans: reused, new or dropped."""
    a, b = old.select("render_key").distinct().withColumn("o", F.lit(True)), new.select("render_key").distinct().withColumn("n", F.lit(True))
    state = F.when(F.col("o") & F.col("n"), "reused").when(F.col("n"), "new").otherwise("dropped")
    return a.join(b, "render_key", "full_outer").select("render_key", state.alias("state"))


def resume_cursor(items: DataFrame) -> DataFrame:
    """Per book, the first speech ordinal that is not present, else one behind the last, else 0."""
    open_ = F.min(F.when((F.col("kind") != "silence") & ~F.col("present"), F.col("ordinal")))
    return items.groupBy("book_id").agg(F.coalesce(open_, F.max("ordinal") + 1, F.lit(0)).cast("long").alias("next_ordinal"))


def job_counts(items: DataFrame) -> DataFrame:
    """Per book: speech items, those done, those whose sound another item has (if ``reused`` says so), and whether all are done."""
    speech = F.col("kind") != "silence"
    reused = F.col("reused") if "reused" in items.columns else F.lit(False)
    return items.groupBy("book_id").agg(F.count(F.when(speech, 1)).alias("total"), F.count(F.when(speech & F.col("present"), 1)).alias("done"), F.count(F.when(speech & reused, 1)).alias("reused"), F.coalesce(F.bool_and(F.when(speech, F.col("present"))), F.lit(True)).alias("finished"))
