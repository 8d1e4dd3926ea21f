"""Versioned blocks and chapters: commits, snapshots, and edits of a book's chapters.

A block row holds for the revisions from ``valid_from`` up to, not including,
``valid_to``; a null ``valid_to`` means it is current.  A chapter with a
negative ordinal has been removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions.offsets import replaced

BLOCK = ["book_id", "chapter_id", "block_index"]


def current(blocks: DataFrame) -> DataFrame:
    return blocks.filter("valid_to IS NULL")


def as_of(blocks: DataFrame, revision: int) -> DataFrame:
    """Blocks as they were at a revision."""
    return blocks.filter((F.col("valid_from") <= revision) & (F.col("valid_to").isNull() | (F.col("valid_to") > revision)))


def commit(blocks: DataFrame, changes: DataFrame, revision: int, base: int | None = None) -> DataFrame:
    """Close current rows that ``changes`` (key, text) alters and add the new ones.

    Equal texts change nothing, unknown keys are new blocks.  With ``base``,
    rows newer than it fail the commit, as someone else has written since.
    """
    new = changes.select(*BLOCK, F.col("text").alias("new_text"))
    return written(blocks, current(blocks).join(new, BLOCK, "full_outer"), revision, base)


def written(blocks: DataFrame, joined: DataFrame, revision: int, base: int | None = None) -> DataFrame:
    """``commit`` of current rows that stand beside their changes (key, text, valid_from, new_text); each is read once."""
    if base is not None and not blocks.filter(F.col("valid_from") > base).isEmpty():
        raise ValueError(f"the table has revisions after {base}")
    altered = F.col("new_text").isNotNull() & ~F.col("text").eqNullSafe(F.col("new_text"))
    row = lambda *values: F.struct(*(v.alias(c) for v, c in zip(values, ("text", "valid_from", "valid_to"), strict=True)))
    closed = F.when(F.col("valid_from").isNotNull(), row(F.col("text"), F.col("valid_from"), F.when(altered, revision).cast("int")))
    added = F.when(altered, row(F.col("new_text"), F.lit(revision), F.lit(None).cast("int")))
    return blocks.filter("valid_to IS NOT NULL").unionByName(joined.select(*BLOCK, F.inline(F.array_compact(F.array(closed, added)))))


def apply_rewrites(text: Column, suggestions: Column) -> Column:
    """Text with conversion artefacts replaced, from right to left."""
    marks = F.filter(suggestions, lambda s: s["kind"] == "conversion_artifact")
    return replaced(text, F.transform(marks, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("new"))))


def conflicts(suggestions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Suggestions whose original is no longer at their offsets.

    A null text has none.  It is left out behind the join: a condition that
    its nulls fail would be asked of the blocks too, which makes their texts
    once for that and once for the join.  Texts are too large to be sent to
    every task, whatever their size is taken for.
    """
    joined = suggestions.join(blocks.select(*BLOCK, "text").hint("merge"), BLOCK)
    there = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("original")
    return joined.filter(~F.coalesce(there, F.lit(True))).drop("text")


def chapter_tree(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks and characters of each live chapter, 0 for empty ones."""
    per = blocks.groupBy("book_id", "chapter_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    live = chapters.filter("ordinal >= 0").join(per, ["book_id", "chapter_id"], "left")
    return live.select("book_id", "chapter_id", "ordinal", "title", F.coalesce("n", F.lit(0)).alias("blocks"), F.coalesce("c", F.lit(0)).cast("long").alias("chars"))


def rename(chapters: DataFrame, edits: DataFrame) -> DataFrame:
    """New titles, trimmed, and include flags (book_id, chapter_id, new_title, new_included); a blank title or null changes nothing."""
    joined = chapters.join(edits, ["book_id", "chapter_id"], "left")
    title = F.when(F.trim(F.coalesce("new_title", F.lit(""))) != "", F.trim("new_title")).otherwise(F.col("title"))
    return joined.withColumn("title", title).withColumn("included", F.coalesce("new_included", "included")).drop("new_title", "new_included")


def reorder(chapters: DataFrame, order: DataFrame) -> DataFrame:
    """New ordinals (book_id, chapter_id, place); books whose order is no permutation of their live chapters stay as they are."""
    live = chapters.filter("ordinal >= 0")
    both = live.select("book_id", "chapter_id", F.lit(1).alias("has")).join(order.groupBy("book_id", "chapter_id").agg(F.count("*").alias("asked")), ["book_id", "chapter_id"], "full_outer")
    good = both.groupBy("book_id").agg(F.bool_and((F.coalesce("has", F.lit(0)) == 1) & (F.coalesce("asked", F.lit(0)) == 1)).alias("good")).filter("good").drop("good")
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("place")) - 1
    asked = order.join(good, "book_id", "left_semi").withColumn("place", place)
    return chapters.join(asked, ["book_id", "chapter_id"], "left").withColumn("ordinal", F.when(F.col("ordinal") >= 0, F.coalesce("place", "ordinal")).otherwise(F.col("ordinal"))).drop("place")


def merge(chapters: DataFrame, blocks: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append each book's ``second`` chapter to its ``first``, which comes just before it.

    The first keeps its place, later ones move up, the second gets a tombstone
    below all ordinals; its blocks go on where the first one's end.  One pair
    (book_id, first, second) per book; pairs not side by side change nothing.
    """
    a = chapters.select("book_id", F.col("chapter_id").alias("first"), F.col("ordinal").alias("first_at"))
    b = chapters.select("book_id", F.col("chapter_id").alias("second"), F.col("ordinal").alias("second_at"))
    good = pairs.join(a, ["book_id", "first"]).join(b, ["book_id", "second"]).filter("first_at >= 0 AND second_at = first_at + 1")
    low = chapters.groupBy("book_id").agg(F.least(F.min("ordinal"), F.lit(0)).alias("low"))
    joined = chapters.join(good.join(low, "book_id"), "book_id", "left")
    ordinal = F.when(F.col("chapter_id") == F.col("second"), F.col("low") - 1).when(F.col("ordinal") > F.col("second_at"), F.col("ordinal") - 1).otherwise(F.col("ordinal"))
    kept = joined.withColumn("ordinal", ordinal).select(*chapters.columns)
    ends = blocks.groupBy("book_id", F.col("chapter_id").alias("first")).agg((F.max("block_index") + 1).alias("end"))
    moves = good.select("book_id", "first", F.col("second").alias("chapter_id")).join(ends, ["book_id", "first"], "left")
    moved = blocks.join(moves, ["book_id", "chapter_id"], "left")
    moved = moved.withColumn("block_index", (F.col("block_index") + F.when(F.col("first").isNotNull(), F.coalesce("end", F.lit(0))).otherwise(0)).cast("int")).withColumn("chapter_id", F.coalesce("first", "chapter_id"))
    return kept, moved.select(*blocks.columns)


def split(blocks: DataFrame, cuts: DataFrame) -> DataFrame:
    """Blocks behind each chapter's cut (book_id, chapter_id, at_block, at_offset, new_chapter_id) move to a new chapter.

    An offset inside a block divides its text; at 0 the block moves whole.
    """
    rows = blocks.join(cuts, ["book_id", "chapter_id"], "left")
    here = F.col("block_index") == F.col("at_block")
    tail = F.col("new_chapter_id").isNotNull() & ((F.col("block_index") > F.col("at_block")) | (here & (F.col("at_offset") < F.length("text"))))
    head = F.col("new_chapter_id").isNull() | (F.col("block_index") < F.col("at_block")) | (here & (F.col("at_offset") > 0))
    first = rows.filter(head).withColumn("text", F.when(here, F.substring("text", F.lit(1), F.col("at_offset"))).otherwise(F.col("text")))
    second = rows.filter(tail).withColumn("text", F.when(here, F.substring("text", F.col("at_offset") + 1, F.length("text"))).otherwise(F.col("text")))
    shift = F.when(F.col("at_offset") >= F.coalesce(F.col("cut_length"), F.lit(1 << 30)), 1).otherwise(0)
    lengths = blocks.select("book_id", "chapter_id", F.col("block_index").alias("at_block"), F.length("text").alias("cut_length"))
    second = second.join(lengths, ["book_id", "chapter_id", "at_block"], "left").withColumn("block_index", (F.col("block_index") - F.col("at_block") - shift).cast("int")).withColumn("chapter_id", F.col("new_chapter_id"))
    return first.select(*blocks.columns).unionByName(second.select(*blocks.columns))


def split_chapters(chapters: DataFrame, blocks: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chapters and blocks after cuts (book_id, chapter_id, at_block, at_offset, new_chapter_id), one a chapter at most.

    The new chapter stands behind the one that is cut, and later ones move
    down.  Its title is its first heading, if that is one and another than the
    old title, else the old title with `` (2)``.  A cut of a removed chapter,
    outside its block, or with nothing on one side of it, changes nothing.
    ``kind`` of the blocks tells headings; without it there are none.
    """
    one = ["book_id", "chapter_id"]
    kind = F.col("kind") if "kind" in blocks.columns else F.lit("paragraph")
    rows = blocks.select(*one, "block_index", "text", kind.alias("kind")).join(cuts, one)
    behind, here = F.col("block_index") > F.col("at_block"), F.col("block_index") == F.col("at_block")
    divided = (F.col("at_offset") > 0) & (F.col("at_offset") < F.col("size"))
    # The block that begins the new chapter: the rest of the one that is cut, or a whole one.
    found = rows.groupBy(*one, "at_block", "at_offset", "new_chapter_id").agg(
        F.max(F.when(here, F.length("text"))).alias("size"), F.count(F.when(F.col("block_index") < F.col("at_block"), 1)).alias("ahead"), F.count(F.when(behind, 1)).alias("behind"),
        F.max(F.when(here, F.struct("kind", "text"))).alias("at"), F.min(F.when(behind, F.struct("block_index", "kind", "text"))).alias("next"),
    )
    first, last = F.col("at_offset") == 0, F.col("at_offset") == F.col("size")
    good = found.filter(F.col("at_offset").between(0, F.col("size"))).filter(divided | (first & (F.col("ahead") > 0)) | (~first & last & (F.col("behind") > 0)))
    rest = F.when((F.col("at.kind") == "heading") & (divided | first), F.trim(F.expr("substring(at.text, at_offset + 1)")))
    following = F.when((F.col("next.kind") == "heading") & ~first, F.trim("next.text"))
    good = good.select(*one, "at_block", "at_offset", "new_chapter_id", rest.alias("rest"), following.alias("following"))
    good = good.join(chapters.filter("ordinal >= 0").select(*one), one, "left_semi")
    order = Window.partitionBy("book_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    joined = chapters.join(good.select(*one, "new_chapter_id", "rest", "following"), one, "left")
    moved = F.coalesce(F.sum(F.when(F.col("new_chapter_id").isNotNull(), 1)).over(order), F.lit(0)).cast("int")
    joined = joined.withColumn("ordinal", F.when(F.col("ordinal") >= 0, F.col("ordinal") + moved).otherwise(F.col("ordinal")))
    other = lambda c: F.when((F.col(c) != "") & (F.col(c) != F.col("title")), F.col(c))
    title = F.coalesce(other("rest"), other("following"), F.concat("title", F.lit(" (2)")))
    added = joined.filter("new_chapter_id IS NOT NULL").withColumn("title", title).withColumn("ordinal", F.col("ordinal") + 1).withColumn("chapter_id", F.col("new_chapter_id"))
    return joined.select(*chapters.columns).unionByName(added.select(*chapters.columns)), split(blocks, good.select(*one, "at_block", "at_offset", "new_chapter_id"))


def permutation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by which two tables differ as multisets; none if one is a permutation of the other."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
