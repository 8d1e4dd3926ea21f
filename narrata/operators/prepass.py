"""The pre-pass of a book: all detectors over its blocks, resolved against each other."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions.offsets import Claims, struct_lists
from narrata.operators import detectors, dialogue, gender, lexicon, numerals, plugins, skip
from narrata.operators.apply import MARK

KEY = ["book_id", "chapter_id", "block_index"]
#: How sure a skipped block is, and from which confidence on a dialogue applies by itself.
SKIPPED, STRUCTURE = 0.92, 0.75


_SEGMENTS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_FIELDS = ("start", "end", "kind", "original", "replacement", "reason", "confidence", "segments")
_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), _SEGMENTS)
READ = f"array<struct<start:int,end:int,kind:string,original:string,replacement:string,reason:string,confidence:double,segments:array<{MARK}>>>"
#: What a lexicon of too many rules says about a block, found outside.
HITS = "array<struct<start:int,end:int,original:string,replacement:string,auto:boolean>>"


def _heard(text: str, heading: bool, said: list[tuple], own: plugins.Registry | None) -> list[tuple]:
    """Numbers, words and one's own suggestions by priority, as far as lexicon hits do not replace them, and the hits."""
    groups = [(plugins.NUMBERS, numerals.find(text, heading)), (plugins.WORDS, detectors.lexical_rows(text))]
    if own:
        rows = own.rows(text)
        groups += [(priority, [r[1:] for r in rows if r[0] == priority]) for priority in dict.fromkeys(r[0] for r in rows)]
        groups.sort(key=lambda g: g[0])
    first, last = Claims(), Claims()
    kept = [s for _, found in groups for s in first.take_all(found)]
    if said:
        last.take_all(said)
        kept = [s for s in kept if last.free(s[0], s[1])]
    return [(start, end, "dict_hit", original, spoken, "dict_auto" if auto else "dict", 0.99) for start, end, original, spoken, auto in said] + kept


def _block(text: str, heading: bool, skipped: str | None, said: list[tuple], own: plugins.Registry | None) -> list[tuple]:
    """All suggestions of a block but those for its speakers, as rows of READ."""
    found = detectors.normal_rows(text)
    if skipped is not None:
        return [(*s, None) for s in [*found, (0, len(text), "skip", text, "", skipped, SKIPPED)]]
    _, reason, confidence, proposed = dialogue.read(text)
    rows = [(*s, None) for s in found + _heard(text, heading, said, own)]
    if reason is not None:
        rows.append((0, len(text), "dialogue_split", text, "", reason, confidence, [{"kind": k, "start": a, "end": b} for k, a, b, _ in proposed]))
    return rows


def _reading(rules, own: plugins.Registry | None):
    """A job for blocks: text, whether it is a heading, why it is skipped, and the lexicon's hits unless ``rules`` finds them here."""
    mine = tuple(own) if own else ()

    def job(texts: pa.Array, headings: pa.Array, skips: pa.Array, hits: pa.Array) -> pa.Array:
        registry, say = plugins.Registry(*mine) if mine else None, rules.value.said if rules is not None else None
        rows = []
        for text, heading, skipped, there in zip(texts.to_pylist(), headings.to_pylist(), skips.to_pylist(), hits.to_pylist(), strict=True):
            said = [] if not text or skipped is not None else say(text) if say else [tuple(h.values()) for h in there or ()]
            rows.append(_block(text, bool(heading), skipped, said, registry) if text else [])
        return struct_lists(rows, _FIELDS, _TYPES)

    return F.arrow_udf(job, READ)


def prepass(blocks: DataFrame, titles: DataFrame | None = None, rules: DataFrame | None = None, own: plugins.Registry | None = None) -> DataFrame:
    """All suggestions of (book_id, chapter_id, block_index, text, heading), one row each, in the order of ``in_order``."""
    return in_order(united(blocks, titles, rules, own))


def united(blocks: DataFrame, titles: DataFrame | None = None, rules: DataFrame | None = None, own: plugins.Registry | None = None) -> DataFrame:
    """The suggestions of ``prepass`` in no order, for what counts or sorts them itself.

    A skipped block has no dialogue, numbers, names or lexicon hits.  Numbers
    come before names and words that overlap them, detectors of one's ``own``
    by their priorities between them, and lexicon hits replace all of these.
    One function reads each block once for all detectors and gives its rows;
    the places of contents, which need no text, a lexicon too large for
    a task, and the lines of dialogue of neighbouring blocks are joined to it.
    """
    base = blocks.select(*KEY, "text", F.col("heading") if "heading" in blocks.columns else F.lit(False).alias("heading"))
    contents = skip.contents_places(base.select(*KEY, "text"), titles).withColumn("toc", F.lit("toc"))
    rows = _beside(base, contents).withColumn("skipped", F.coalesce(skip.line_reason(F.col("text")), F.col("toc")))
    hits, few = F.lit(None).cast(HITS), None
    if rules is not None:
        ranked = lexicon.effective_rules(rules)
        few = lexicon.matcher(ranked)
        if few is None:
            said = lexicon.lexicon_suggestions(base.select(*KEY, "text"), rules)
            one = F.struct("start", "end", "original", "replacement", "auto")
            rows = _beside(rows, said.groupBy(*KEY).agg(F.array_sort(F.collect_list(one)).cast(HITS).alias("hits")))
            hits = F.col("hits")
    found = rows.select(*KEY, F.explode(_reading(few, own)("text", "heading", "skipped", hits)).alias("s"))
    found = found.select(*KEY, *[F.col(f"s.{c}").alias(c) for c in _FIELDS[:-1]], F.lit(None).cast("string").alias("speaker_id"), F.col("s.segments").alias("segments"))
    lines = gender.gender_suggestions(base.select(*KEY, "text"))
    speakers = lines.select(*KEY, "start", "end", F.lit("speaker_gender").alias("kind"), "original", F.col("gender").alias("replacement"), "reason", F.col("confidence").cast("double").alias("confidence"), "speaker_id", F.lit(None).cast(f"array<{MARK}>").alias("segments"))
    return found.unionByName(speakers)


def _beside(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Rows with what is told of their block, if anything; blocks of a book without a key are told apart as others are."""
    there = told.withColumnsRenamed({c: f"__{c}" for c in KEY})
    same = F.lit(True)
    for c in KEY:
        same = same & rows[c].eqNullSafe(there[f"__{c}"])
    return rows.join(there, same, "left").drop(*[f"__{c}" for c in KEY])


def in_order(suggestions: DataFrame) -> DataFrame:
    """Chapters apart, since books may be few, and suggestions by book, chapter, block, start, end, kind and reason within a partition."""
    return suggestions.repartition("book_id", "chapter_id").sortWithinPartitions(*KEY, "start", "end", "kind", "reason")


def structural(suggestions: DataFrame, least: float = STRUCTURE) -> DataFrame:
    """What applies by itself: dialogues that are sure enough."""
    return suggestions.filter((F.col("kind") == "dialogue_split") & (F.col("confidence") >= least))


def is_hard() -> Column:
    """Whether a suggestion needs a second look: a doubtful dialogue or speaker."""
    return ((F.col("kind") == "dialogue_split") & (F.col("confidence") < STRUCTURE)) | ((F.col("kind") == "speaker_gender") & (F.col("confidence") < 0.7))
