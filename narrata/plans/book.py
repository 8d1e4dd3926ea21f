"""Plans of whole books: from blocks and spans to plan items, from pages to chapters, and what an export needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions.sentences import Segment, pieces, sentences
from narrata.operators.html_blocks import html_blocks
from narrata.plans import chunks, export, voices
from narrata.sources.shared import cut

BLOCK = ["book_id", "chapter_id", "block_index"]


def segments(blocks: DataFrame) -> DataFrame:
    """Spoken segments of (BLOCK, text, spans): tiles with the overlays inside them applied; empty ones go, pauses stay silent."""
    said = blocks.select(*BLOCK, F.explode(voices.spoken_tiles(F.col("text"), F.col("spans"))).alias("t"))
    return said.select(*BLOCK, "t.tile", "t.start", F.when(F.col("t.kind") == "pause", "silence").otherwise(F.col("t.kind")).alias("kind"), "t.gender", "t.spoken")


def spoken_runs(blocks: DataFrame, filled: DataFrame, mode: str = "gendered") -> DataFrame:
    """Runs of one voice slot in a chapter: book_id, chapter_id, run, slot, kind, text."""
    # Without a narrator a book has no runs, so its blocks are not read.
    told = blocks.join(filled.filter("slot = 'narrator'").select("book_id").distinct(), "book_id", "left_semi")
    said = voices.assign_slots(segments(told), filled, mode).filter("slot IS NOT NULL")
    order = Window.partitionBy("book_id", "chapter_id").orderBy("block_index", "tile")
    rows = said.select("book_id", "chapter_id", F.row_number().over(order).alias("position"), "slot", F.when(F.col("kind") == "silence", "silence").otherwise("tts").alias("kind"), F.col("spoken").alias("text"))
    return voices.merge_runs(rows)


def run_pieces(runs: DataFrame, limit: int, segment: Segment = sentences) -> DataFrame:
    """One row per piece of a run: sentences up to ``limit`` characters, a silence as one empty piece."""
    parts = F.when(F.col("kind") == "silence", F.array(F.lit(""))).otherwise(pieces(F.col("text"), limit, F.col("kind") == "dialogue", segment))
    return runs.select("book_id", "chapter_id", "run", "slot", "kind", F.posexplode(parts).alias("piece", "spoken"))


def plan_items(runs: DataFrame, limit: int, segment: Segment = sentences) -> DataFrame:
    """The pieces of runs with ordinals that count over the book."""
    return chunks.number_items(run_pieces(runs, limit, segment))


def plan_book(blocks: DataFrame, filled: DataFrame, profiles: DataFrame, limit: int, settings: dict[str, str], mode: str = "gendered", segment: Segment = sentences) -> DataFrame:
    """The plan of each book: items with their voice profile and render key, and whether an earlier item has the same sound.

    The pieces are made once, with their keys, and written to the shared
    folder: numbers of chapters and first items of keys are read from there.
    """
    items = voices.lookup_profiles(run_pieces(spoken_runs(blocks, filled, mode), limit, segment), profiles)
    sound = {"slot": F.col("slot"), "profile": F.col("profile_id"), "profile_hash": F.col("content_hash"), **{k: F.lit(v) for k, v in sorted(settings.items())}}
    keyed = cut(items.withColumn("render_key", chunks.content_key(F.col("spoken"), **sound)), "plan")
    return chunks.dedupe_renders(chunks.number_items(keyed))


def ingest(pages: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chapters and blocks at revision 0 of (book_id, chapter_id, href, html).

    A chapter's title is its first heading, else the file name of its href.
    Fails if ``stored`` blocks have been edited.
    """
    if stored is not None and not stored.filter("valid_from > 0").isEmpty():
        raise ValueError("the book has been edited since it was read")
    found = html_blocks(pages, "href", "html")
    blocks = pages.select("book_id", "chapter_id", "href").join(found, "href").select(*BLOCK, "kind", "heading_level", "href", "path", "text", F.lit(0).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"))
    order = Window.partitionBy("book_id").orderBy("chapter_id")
    chapters = pages.select("book_id", "chapter_id", "href", (F.row_number().over(order) - 1).alias("ordinal"))
    return chapters.join(chapter_titles(chapters, blocks), ["book_id", "chapter_id"]), blocks


def stem(href: Column) -> Column:
    return F.regexp_extract(href, r"([^/]*?)(?:\.[^./]*)?$", 1)


def chapter_titles(chapters: DataFrame, blocks: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Title of each chapter: its label in the contents (href, position, label; the last one of an href), else its first heading, else its file's stem."""
    heading = F.min_by(F.trim("text"), F.when((F.col("kind") == "heading") & (F.trim("text") != ""), F.col("block_index")))
    first = blocks.groupBy("book_id", "chapter_id").agg(heading.alias("heading"))
    rows = chapters.select("book_id", "chapter_id", "href").join(first, ["book_id", "chapter_id"], "left")
    label = F.lit(None).cast("string")
    if contents is not None:
        named = contents.filter(F.trim("label") != "").groupBy("href").agg(F.max_by("label", "position").alias("label"))
        rows, label = rows.join(named, "href", "left"), F.col("label")
    return rows.select("book_id", "chapter_id", F.coalesce(label, F.col("heading"), stem(F.col("href"))).alias("title"))


def book_metadata(entries: DataFrame) -> DataFrame:
    """Per book of (book_id, position, name, value, id_ref, unique): title, language, description, authors, identifier.

    The first value that is not blank counts, of identifiers the one that is
    marked as unique; without any, a hash of the book's key stands for it.
    """
    rows = entries.withColumn("value", F.trim("value")).filter("value <> ''")
    first = lambda name: F.min_by("value", F.when(F.col("name") == name, F.col("position")))
    authors = F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == "creator", F.struct("position", "value")))), lambda a: a["value"])
    unique = F.min_by("value", F.when((F.col("name") == "identifier") & F.coalesce("unique", F.lit(False)), F.col("position")))
    told = rows.groupBy("book_id").agg(first("title").alias("title"), first("language").alias("language"), first("description").alias("description"), authors.alias("authors"), F.coalesce(unique, first("identifier")).alias("identifier"))
    books = entries.select("book_id").distinct().join(told, "book_id", "left")
    return books.select("book_id", "title", "language", "description", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.coalesce("identifier", F.sha2(F.col("book_id").cast("string"), 256)).alias("identifier"))


def select_for_mux(items: DataFrame, full: bool = False) -> DataFrame:
    """Per chapter: speech items, how many are there, the ordinals that are missing, and whether the chapter is exported.

    A chapter is whole if all its speech is there.  With ``full`` a book is
    exported only if every chapter is; a book of which nothing would be has
    the error ``nothing_included``, one refused as a whole ``missing_items``.
    """
    speech = F.col("kind") != "silence"
    per = items.groupBy("book_id", "chapter_id").agg(F.count(F.when(speech, 1)).alias("total"), F.count(F.when(speech & F.col("present"), 1)).alias("done"), F.sort_array(F.collect_list(F.when(speech & ~F.col("present"), F.col("ordinal")))).alias("missing"))
    book = Window.partitionBy("book_id")
    per = per.withColumn("whole", F.col("total") == F.col("done"))
    refused = ~F.min("whole").over(book) if full else F.lit(False)
    error = F.when(refused, "missing_items").when(~F.max("whole").over(book), "nothing_included")
    return per.withColumn("error", error).withColumn("included", F.col("whole") & F.col("error").isNull())


def export_plan(items: DataFrame, durations: DataFrame, titles: DataFrame, full: bool = False) -> DataFrame:
    """Per exported chapter: its place in the audio book (start and end in milliseconds), title, and items.

    ``items`` has book_id, chapter_id, ordinal, kind and present, ``durations``
    (book_id, chapter_id, seconds); a chapter without a duration takes none,
    and a negative one is an error.
    """
    kept = select_for_mux(items, full).filter("included").select("book_id", "chapter_id", "total")
    rows = kept.join(durations, ["book_id", "chapter_id"], "left").join(titles, ["book_id", "chapter_id"], "left")
    seconds = F.when(F.col("seconds") < 0, F.raise_error("a chapter's duration is negative")).otherwise(F.coalesce("seconds", F.lit(0.0))).cast("double")
    rows = rows.select("book_id", F.col("chapter_id").alias("number"), F.coalesce("title", F.lit("")).alias("title"), "total", seconds.alias("duration_s"))
    places = export.marks(rows).join(rows.select("book_id", "number", "total"), ["book_id", "number"])
    return places.select("book_id", F.col("number").alias("chapter_id"), "title", "total", "start_ms", "end_ms")


def export_books(items: DataFrame, durations: DataFrame, titles: DataFrame, books: DataFrame, full: bool = False) -> DataFrame:
    """All that an export needs, one row per book: chapters, error, file list, metadata with marks, and report.

    ``durations`` also has the path of each chapter's sound, ``books``
    (book_id, title, author, description, isbn).  The list has the sounds of
    the exported chapters in order, the report those that are not whole.  A
    book of which nothing is exported has an error, and no list or metadata.
    """
    one = ["book_id", "chapter_id"]
    chosen = select_for_mux(items, full).join(titles, one, "left").join(durations.select(*one, "path"), one, "left")
    omitted = F.when(~F.col("whole"), F.struct(F.col("chapter_id").alias("number"), F.coalesce("title", F.lit("")).alias("title"), F.lit("incomplete").alias("reason")))
    line = F.when(F.col("included"), F.struct("chapter_id", export.file_line(F.col("path")).alias("line")))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    per = chosen.groupBy("book_id").agg(
        F.count(F.when(F.col("included"), 1)).alias("chapters"), F.max("error").alias("error"), F.when(F.count(line) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).alias("list"),
        F.to_json(F.struct(F.array_sort(F.collect_list(omitted)).alias("omitted"))).alias("report"),
    )
    marks = export_plan(items, durations.select(*one, "seconds"), titles, full).withColumnRenamed("chapter_id", "number")
    told = export.metadata(books, marks).withColumnRenamed("text", "metadata")
    return per.join(told, "book_id", "left").select("book_id", "chapters", "error", "list", F.when(F.col("error").isNull(), F.col("metadata")).alias("metadata"), "report")


def chapter_text(blocks: DataFrame, spoken: bool = False) -> DataFrame:
    """Each chapter's blocks with blank lines between, as printed or as spoken (then with their ``spans``)."""
    text = voices.spoken_form(F.col("text"), F.col("spans")) if spoken else F.col("text")
    rows = blocks.groupBy("book_id", "chapter_id").agg(F.array_sort(F.collect_list(F.struct("block_index", text.alias("said")))).alias("b"))
    return rows.select("book_id", "chapter_id", F.array_join(F.transform("b", lambda x: x["said"]), "\n\n").alias("text"))
