"""Front matter: blocks that should not be read aloud."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions import word_lists as W
from narrata.functions.offsets import let

# Fixed values. What an ISBN and an editorial line look like.
ISBN = r"(?i)\bISBN(?:-1[03])?\b\s*:?\s*[0-9][0-9Xx \t-]{8,24}[0-9Xx]"
EDITORIAL = r"(?iU)\b(?:" + "|".join(W.EDITORIAL) + r")\b"


#: White space of all scripts.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def line_reason(text: Column) -> Column:
    """Why a line alone is skipped, or null; only lines of 400 characters or fewer are, but for page numbers."""

    def told(s: Column) -> Column:
        low = F.lower(s)
        any_of = lambda phrases: F.greatest(*[low.contains(p) for p in phrases])
        return (
            F.when((s == "") | (F.length(s) > 400), None)
            .when((F.length(s) <= 4) & s.rlike(r"(?U)^\d{1,4}$"), "page_number")
            .when(low.contains("isbn") & s.rlike(ISBN), "isbn")
            .when((low.contains("copyright") & s.rlike(r"(?iU)\bcopyright\b")) | any_of(W.RIGHTS), "copyright")
            .when(any_of(W.ORIGINAL_TITLE), "original_title")
            # The pattern takes letters of any case, also those that only upper case makes equal.
            .when(F.greatest(*[F.lower(F.upper(s)).contains(p) for p in W.EDITORIAL]) & s.rlike(EDITORIAL), "editorial")
        )

    return let(strip(text), told)


def line_skips(blocks: DataFrame) -> DataFrame:
    """Whole-block spans of lines that are skipped for themselves."""
    found = blocks.withColumn("reason", line_reason(F.col("text"))).filter("reason IS NOT NULL")
    return found.select("book_id", "chapter_id", "block_index", F.lit(0).alias("start"), F.length("text").alias("end"), "reason")


def skips(blocks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Blocks of front matter with their reason, in one pass: a line's own reason, or its place in the contents."""
    rows = _with_contents(blocks, titles).filter("reason IS NOT NULL OR contents")
    return rows.select("book_id", "chapter_id", "block_index", F.lit(0).alias("start"), F.length("text").alias("end"), F.coalesce("reason", F.lit("toc")).alias("reason"))


def contents_skips(blocks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """A contents heading and the run of five or more entries behind it.

    An entry is one of the chapter titles (book_id, title) if those are given,
    else a short line without closing punctuation.  Blocks that are skipped
    for themselves are neither.  With titles a heading is no entry, unless it
    is a title, so it ends the run before it; without, a heading inside a run
    is an entry of it.  Windows per chapter.
    """
    found = _with_contents(blocks, titles).filter("contents")
    return found.select("book_id", "chapter_id", "block_index", F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("toc").alias("reason"))


def contents_places(blocks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Keys of the blocks of ``contents_skips``; texts are not shuffled for them."""
    return _with_contents(blocks, titles).filter("contents").select("book_id", "chapter_id", "block_index")


def _with_contents(blocks: DataFrame, titles: DataFrame | None) -> DataFrame:
    """Blocks with the reason of their own and whether they are part of the contents."""
    norm = F.lower(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))
    # Only texts that are short once their white space is single can be entries or headings.
    norm = F.when((F.length("text") <= 120) | F.col("text").rlike(r"(?U)\s{2}"), norm)
    rows = blocks.select("book_id", "chapter_id", "block_index", "text", norm.alias("norm"), line_reason(F.col("text")).alias("reason")).withColumn("free", F.col("reason").isNull())
    short = F.col("free") & F.coalesce((F.col("norm") != "") & (F.length("norm") <= 120), F.lit(False))
    heading = F.col("free") & F.coalesce(F.col("norm").isin(*W.TOC_HEADINGS), F.lit(False))
    if titles is None:
        rows = rows.withColumn("entry", short & ~F.coalesce(F.col("norm").rlike("[.!?…]$"), F.lit(False)))
    else:
        known = titles.select("book_id", F.lower(F.trim(F.regexp_replace("title", r"(?U)\s+", " "))).alias("norm")).distinct().withColumn("known", F.lit(True))
        rows = rows.join(known, ["book_id", "norm"], "left").withColumn("entry", short & F.coalesce("known", F.lit(False)))
    chapter = Window.partitionBy("book_id", "chapter_id").orderBy("block_index")
    rows = rows.withColumn("heading", heading)
    # An entry belongs to the last heading before it that is no entry of a run itself, if nothing else stands between.
    opens = F.col("heading") & ~(F.col("entry") & F.coalesce(F.lag("entry").over(chapter) | F.lag("heading").over(chapter), F.lit(False)))
    rows = rows.withColumn("opens", opens).withColumn("island", F.sum(F.when(F.col("opens") | ~F.col("entry"), 1).otherwise(0)).over(chapter))
    run = Window.partitionBy("book_id", "chapter_id", "island")
    rows = rows.withColumn("head", F.min(F.when(F.col("heading"), F.col("block_index"))).over(run)).withColumn("last", F.max("block_index").over(run))
    return rows.withColumn("contents", F.coalesce((F.col("block_index") >= F.col("head")) & (F.col("last") - F.col("head") >= 5), F.lit(False)))
