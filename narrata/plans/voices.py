"""From blocks and spans to spoken runs: tiles, overlays, voice slots, merged runs."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions.offsets import list_tuples, put, replaced, struct_lists

TILE = "array<struct<kind:string,gender:string,start:int,end:int>>"
BLOCK = ("book_id", "chapter_id", "block_index")
TILED = ("narration", "dialogue", "pause")
#: A tile with its place among those of its block, and what is spoken there.
SPOKEN = "array<struct<tile:int,start:int,kind:string,gender:string,spoken:string>>"


def _by_place(span: tuple) -> list[tuple]:
    """Nulls first, as Spark sorts structs."""
    return [(v is not None, v) if v is not None else (False,) for v in span]


def tiles(length: int | None, spans: list[tuple]) -> list[tuple]:
    """(kind, gender, start, end) of the tiles of a block of that length, of its spans (start, end, kind, gender, ...); see ``tile``."""
    kept = [s[:4] for s in spans if s[2] in TILED]
    if len(kept) > 1:
        try:
            kept.sort()
        except TypeError:
            kept.sort(key=_by_place)
    at, out = 0, []
    for start, end, kind, gender in kept:
        if start is not None and start > at:
            out.append(("narration", None, at, start))
        if end is not None and end > at:
            out.append((kind, gender, at if start is None else max(start, at), end))
            at = end
    if length is not None and at < length:
        out.append(("narration", None, at, length))
    return out


def tile(text: Column, spans: Column) -> Column:
    """Narration, dialogue and pause spans that cover a block from end to end.

    Spans go by start and end; one that begins before the cursor is trimmed to
    it, one that ends there is dropped, and gaps become narration.
    """

    def job(lengths: pa.Array, lists: pa.Array) -> pa.Array:
        listed = list_tuples(lists, ("start", "end", "kind", "gender"))
        found = struct_lists([[] if s is None else tiles(n, s) for n, s in zip(lengths.to_pylist(), listed, strict=True)], ("kind", "gender", "start", "end"), (pa.string(), pa.string(), pa.int32(), pa.int32()))
        return pc.if_else(lists.is_valid(), found, None) if lists.null_count else found

    return F.arrow_udf(job, TILE)(F.length(text), spans)


def _spoken(text: str | None, spans: list[tuple] | None) -> list[tuple]:
    """Rows of SPOKEN of a block; a span is (start, end, kind, gender, spoken)."""
    if spans is None:
        return []
    over = [(a, b, "" if kind == "skip" else said or "") for a, b, kind, _, said in spans if kind in ("pronunciation", "skip") and a is not None and b is not None and a <= b]
    out = []
    for k, (kind, gender, start, end) in enumerate(tiles(None if text is None else len(text), spans)):
        said = ""
        if kind != "pause" and text is not None and start < end:
            said = text[start:end]
            if inside := [(a - start, b - start, new) for a, b, new in over if a >= start and b <= end and b - start <= len(said)]:
                said = put(said, inside)
            said = said.strip(" ")
        if said or kind == "pause":
            out.append((k, start, kind, gender, said))
    return out


def spoken_tiles(text: Column, spans: Column) -> Column:
    """The tiles of a block with what is spoken there, overlays inside them applied; empty ones go, pauses stay silent."""

    def job(texts: pa.Array, lists: pa.Array) -> pa.Array:
        listed = list_tuples(lists, ("start", "end", "kind", "gender", "spoken"))
        return struct_lists([_spoken(t, s) for t, s in zip(texts.to_pylist(), listed, strict=True)], ("tile", "start", "kind", "gender", "spoken"), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()))

    return F.arrow_udf(job, SPOKEN)(text, spans)


def spoken_form(text: Column, spans: Column) -> Column:
    """Text with pronunciation spans replaced and skip spans dropped, from right to left; spans out of range are ignored."""
    good = F.filter(spans, lambda s: s["kind"].isin("pronunciation", "skip") & (s["start"] >= 0) & (s["end"] <= F.length(text)) & (s["start"] <= s["end"]))
    return replaced(text, F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["kind"] == "skip", "").otherwise(F.coalesce(s["spoken"], F.lit(""))).alias("new"))))


def overlays(tiles: DataFrame, marks: DataFrame) -> DataFrame:
    """Pronunciation and skip spans that lie in a tile, with offsets in it.

    Empty spans lie in none.  The tiles of a block do not overlap, so a span can only lie in the last
    one that begins up to its start: a sweep over the block in order, without
    a row for each pair.
    """
    t = tiles.select(*BLOCK, "start", "end", F.struct("start", "end").alias("tile"), F.lit(None).cast("string").alias("kind")).filter("start < end")
    m = marks.filter(F.col("kind").isin("pronunciation", "skip") & (F.col("start") < F.col("end"))).select(*BLOCK, "start", "end", F.lit(None).cast(t.schema["tile"].dataType).alias("tile"), "kind")
    order = Window.partitionBy(*BLOCK).orderBy("start", F.col("tile").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = t.unionByName(m).withColumn("tile", F.last("tile", ignorenulls=True).over(order)).filter("kind IS NOT NULL AND end <= tile.end")
    return rows.select(*BLOCK, F.col("tile.start").alias("tile_start"), (F.col("start") - F.col("tile.start")).alias("start"), (F.col("end") - F.col("tile.start")).alias("end"), "kind")


def assign_slots(spans: DataFrame, filled: DataFrame, mode: str = "gendered") -> DataFrame:
    """Wanted slot by mode, kind and gender; the narrator with a warning where it is not filled.

    ``filled`` (book_id, slot) has the slots with a voice; a book without a
    narrator has a null slot and the warning ``slot_missing_narrator``.
    """
    speech = F.col("kind") == "dialogue"
    wanted = {
        "single": F.lit("narrator"),
        "dialogue": F.when(speech, "dialogue").otherwise("narrator"),
        "gendered": F.when(speech & (F.col("gender") == "male"), "male").when(speech & (F.col("gender") == "female"), "female").otherwise("narrator"),
    }[mode]
    slots = filled.groupBy("book_id").agg(F.collect_set("slot").alias("slots"))
    rows = spans.join(slots, "book_id", "left").withColumn("wanted", wanted)
    has = lambda s: F.coalesce(F.array_contains("slots", s), F.lit(False))
    slot = F.when(~has(F.lit("narrator")), None).when(has(F.col("wanted")), F.col("wanted")).otherwise("narrator")
    warning = F.when(~has(F.lit("narrator")), "slot_missing_narrator").when(~has(F.col("wanted")), F.concat(F.lit("slot_missing_"), F.col("wanted")))
    return rows.withColumn("slot", slot).withColumn("warning", warning).drop("slots", "wanted")


def lookup_profiles(runs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile of each slot (book_id, slot, profile_id, content_hash); empty where there is none."""
    joined = runs.join(profiles, ["book_id", "slot"], "left")
    return joined.withColumn("profile_id", F.coalesce("profile_id", F.lit(""))).withColumn("content_hash", F.coalesce("content_hash", F.lit("")))


def slot_conflicts(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("book_id", "slot").agg(F.count("*").alias("profiles")).filter("profiles > 1")


def merge_runs(runs: DataFrame) -> DataFrame:
    """Neighbours in a chapter with one slot become one run, their texts joined by spaces; silence stands alone.

    ``runs`` has book_id, chapter_id, position, slot, kind, text.
    """
    order = Window.partitionBy("book_id", "chapter_id").orderBy("position")
    fresh = F.coalesce((F.lag("slot").over(order) != F.col("slot")) | (F.lag("kind").over(order) == "silence") | (F.col("kind") == "silence"), F.lit(True))
    rows = runs.withColumn("fresh", fresh.cast("int")).withColumn("run", (F.sum("fresh").over(order) - 1).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("book_id", "chapter_id", "run").agg(F.first("slot").alias("slot"), F.first("kind").alias("kind"), text.alias("text"), F.count("*").alias("parts"))
