"""Export of finished books: complete chapters, marks, file lists and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER = ("number", "ordinal")


def select_chapters(items: DataFrame) -> DataFrame:
    """Per chapter (book_id, number): speech items, and whether all are present; silence is not asked for."""
    speech = F.col("kind") != "silence"
    done = F.coalesce(F.bool_and(F.when(speech, F.col("present"))), F.lit(True))
    return items.groupBy("book_id", "number").agg(F.count(F.when(speech, 1)).alias("speech"), done.alias("included"))


def partial_report(chapters: DataFrame) -> DataFrame:
    """Per book, the JSON list of the chapters left out."""
    row = F.when(~F.col("included"), F.struct("number", F.lit("incomplete").alias("reason")))
    return chapters.groupBy("book_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("omitted"))


def marks(chapters: DataFrame) -> DataFrame:
    """Cumulative start and end of chapters in milliseconds, halves rounded to even; numbers stay."""
    length = F.bround(F.col("duration_s") * 1000).cast("long")
    order = Window.partitionBy("book_id").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    rows = chapters.withColumn("length", length).withColumn("end_ms", F.sum("length").over(order))
    return rows.select("book_id", "number", "title", (F.col("end_ms") - F.col("length")).alias("start_ms"), "end_ms")


def gaps(items: DataFrame) -> DataFrame:
    """Items (book_id, number, ordinal, kind) with whether a gap comes before: between two speech items."""
    order = Window.partitionBy("book_id", "number").orderBy("ordinal")
    before = F.lag("kind").over(order)
    return items.withColumn("gap_before", F.coalesce((F.col("kind") != "silence") & (before != "silence"), F.lit(False)))


def file_line(path: Column) -> Column:
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def concat_lists(items: DataFrame, gap_file: str, gap_ms: int) -> DataFrame:
    """Per chapter, the list of files to join, with the gap's file between speech items."""
    lines = F.when(F.col("gap_before") & F.lit(gap_ms > 0), F.array(file_line(F.lit(gap_file)), file_line(F.col("path")))).otherwise(F.array(file_line(F.col("path"))))
    rows = gaps(items).withColumn("lines", lines)
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "lines"))), lambda x: x["lines"]))
    return rows.groupBy("book_id", "number").agg(F.concat(F.array_join(listed, "\n"), F.lit("\n")).alias("text"))


def escape(value: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("=", "\\="), (";", "\\;"), ("#", "\\#")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def metadata(books: DataFrame, chapter_marks: DataFrame) -> DataFrame:
    """Per book, the tag and chapter document: title, author, isbn, and the marks in order."""
    chapter = F.concat_ws(
        "\n", F.lit(""), F.lit("[CHAPTER]"), F.lit("TIMEBASE=1/1000"), F.concat(F.lit("START="), F.col("start_ms").cast("string")), F.concat(F.lit("END="), F.col("end_ms").cast("string")),
        F.concat(F.lit("title="), escape(F.col("title"))),
    )
    listed = chapter_marks.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", chapter.alias("t")))), lambda x: x["t"]), "\n").alias("chapters"))
    said = F.trim(F.concat(F.col("description"), F.when(F.coalesce("isbn", F.lit("")) != "", F.concat(F.lit("\nISBN "), F.col("isbn"))).otherwise("")))
    tags = [
        F.lit(";FFMETADATA1"), F.concat(F.lit("title="), escape(F.col("title"))), F.concat(F.lit("artist="), escape(F.col("author"))), F.concat(F.lit("album_artist="), escape(F.col("author"))),
        F.lit("genre=Audiobook"), F.concat(F.lit("description="), escape(said)), F.concat(F.lit("comment="), escape(said)),
    ]
    return books.join(listed, "book_id", "left").select("book_id", F.concat(F.concat_ws("\n", *tags, "chapters"), F.lit("\n")).alias("text"))
