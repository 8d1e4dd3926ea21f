"""Accepted suggestions applied to blocks: rewrites of the print, spans beside it, and what no longer fits."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions.offsets import struct_lists
from narrata.operators import revisions

MARK = "struct<kind:string,start:int,end:int>"
SUGGESTION = f"struct<kind:string,start:int,end:int,original:string,replacement:string,confidence:double,speaker_id:string,segments:array<{MARK}>>"
SPAN = "struct<start:int,end:int,kind:string,spoken:string,gender:string,gender_confidence:double,speaker_id:string>"
APPLIED = f"struct<text:string,spans:array<{SPAN}>,conflicts:array<struct<kind:string,start:int,end:int,original:string>>>"

# Fixed values. What rewrites the print, and what becomes a pronunciation.
REWRITE = "conversion_artifact"
PRONOUNCED = frozenset("foreign_word acronym toponym numeral ordinal_heading dict_hit".split())


class Shift:
    """Where offsets go when disjoint rewrites (start, end, replacement), sorted by start, are applied."""

    def __init__(self, rewrites: list[tuple[int, int, str]]) -> None:
        self.rewrites = rewrites
        self.starts, self.ends = [r[0] for r in rewrites], [r[1] for r in rewrites]
        self.moved = [0, *accumulate(len(r[2]) - (r[1] - r[0]) for r in rewrites)]

    def inside(self, start: int, end: int) -> tuple[int, int] | None:
        """Numbers of the first rewrite in a span and of the first behind it; None if one crosses its ends."""
        first = bisect_left(self.ends, start + 1)
        last = bisect_left(self.starts, end)
        crossed = first < last and (self.starts[first] < start or self.ends[last - 1] > end)
        return None if crossed else (first, max(first, last))

    def span(self, start: int, end: int) -> tuple[int, int] | None:
        """The span after the rewrites."""
        found = self.inside(start, end)
        return None if found is None else (start + self.moved[found[0]], end + self.moved[found[1]])

    def text(self, text: str, start: int = 0, end: int | None = None) -> str:
        """A part of the text with the rewrites inside it."""
        end = len(text) if end is None else end
        out, at = [], start
        first, last = self.inside(start, end)
        for a, b, new in self.rewrites[first:last]:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:end]])


def apply(text: str, suggestions: list[dict]) -> tuple[str, list[tuple], list[tuple]]:
    """The text after the rewrites, its spans, and the suggestions that do not fit it.

    Rewrites go from the last to the first; one that overlaps one behind it
    is a conflict, and so is a suggestion that a rewrite cuts, or a dialogue
    of which a rewrite touches a segment.
    """
    rewrites, conflicts, behind = [], [], len(text) + 1
    for s in sorted((s for s in suggestions if s["kind"] == REWRITE), key=lambda s: -s["start"]):
        if s["end"] <= behind and text[s["start"] : s["end"]] == s["original"]:
            rewrites.append((s["start"], s["end"], s["replacement"] or ""))
            behind = s["start"]
        else:
            conflicts.append(s)
    shift = Shift(rewrites[::-1])
    spans, genders = [], {}
    for s in (s for s in suggestions if s["kind"] != REWRITE):
        place = shift.span(s["start"], s["end"])
        if place is None or text[s["start"] : s["end"]] != s["original"]:
            conflicts.append(s)
            continue
        if s["kind"] in PRONOUNCED:
            spans.append((*place, "pronunciation", s["replacement"]))
        elif s["kind"] == "skip":
            spans.append((*place, "skip", None))
        elif s["kind"] == "speaker_gender":
            genders.setdefault(place, s)
        elif s["kind"] == "dialogue_split" and s["segments"]:
            marks = [(m["kind"], shift.inside(m["start"], m["end"]), shift.span(m["start"], m["end"])) for m in s["segments"]]
            if any(found is None or found[0] < found[1] for _, found, _ in marks):
                conflicts.append(s)
            else:
                spans += [(*at, kind, None) for kind, _, at in marks if kind in ("narration", "dialogue")]
        else:
            conflicts.append(s)
    painted = []
    for start, end, kind, spoken in sorted(spans, key=lambda s: s[:3]):
        g = genders.get((start, end)) if kind == "dialogue" else None
        painted.append((start, end, kind, spoken, *((g["replacement"], g["confidence"], g["speaker_id"]) if g else (None, None, None))))
    return shift.text(text), painted, [(s["kind"], s["start"], s["end"], s["original"]) for s in conflicts]


def _job(texts: pa.Array, lists: pa.Array) -> pa.Array:
    rows = [apply(t, s or []) if t is not None else (None, [], []) for t, s in zip(texts.to_pylist(), lists.to_pylist(), strict=True)]
    spans = struct_lists([r[1] for r in rows], ("start", "end", "kind", "spoken", "gender", "gender_confidence", "speaker_id"), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()))
    conflicts = struct_lists([r[2] for r in rows], ("kind", "start", "end", "original"), (pa.string(), pa.int32(), pa.int32(), pa.string()))
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), spans, conflicts], names=["text", "spans", "conflicts"])


def apply_block(text: Column, suggestions: Column) -> Column:
    """struct<text, spans, conflicts> of a block and its accepted suggestions (an array of SUGGESTION)."""
    return F.arrow_udf(_job, APPLIED)(text, suggestions)


def gathered(suggestions: DataFrame) -> DataFrame:
    """Rows of suggestions as one array per block; columns that are missing are null."""
    have = set(suggestions.columns)
    types = {"speaker_id": "string", "segments": f"array<{MARK}>"}
    fields = [F.col(c) if c in have else F.lit(None).cast(types[c]).alias(c) for c in ("kind", "start", "end", "original", "replacement", "confidence", "speaker_id", "segments")]
    return suggestions.groupBy(*revisions.BLOCK).agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("at"), F.struct(*fields).alias("s")))).alias("listed")).select(*revisions.BLOCK, F.transform("listed", lambda x: x["s"]).cast(f"array<{SUGGESTION}>").alias("suggestions"))


def apply_and_commit(blocks: DataFrame, suggestions: DataFrame, revision: int, base: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply suggestions to the current blocks of a versioned table.

    Returns the versioned blocks, the spans of the new revision and the
    conflicts.  Blocks whose text stays keep their row; with ``base`` the
    commit fails if the table is newer.
    """
    now = revisions.current(blocks).join(gathered(suggestions), revisions.BLOCK, "left")
    done = now.select(*revisions.BLOCK, "text", "valid_from", apply_block(F.col("text"), F.col("suggestions")).alias("r"))
    joined = done.select(*revisions.BLOCK, "text", "valid_from", F.col("r.text").alias("new_text"))
    spans = done.select(*revisions.BLOCK, F.explode("r.spans").alias("s")).select(*revisions.BLOCK, "s.*", F.lit(revision).alias("valid_from"))
    conflicts = done.select(*revisions.BLOCK, F.explode("r.conflicts").alias("s")).select(*revisions.BLOCK, "s.*")
    return revisions.written(blocks, joined, revision, base), spans, conflicts


def annotate(text: str, spans: list[dict]) -> str:
    """Escaped text with its spans as nested elements; pauses are empty ones.  Spans that cross another are left out."""

    def escaped(s: str) -> str:
        clean = "".join(c for c in s if c >= " " or c in "\t\n\r").replace("\r\n", "\n").replace("\r", "\n")
        return clean.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def opened(s: dict) -> str:
        told = [("kind", s["kind"])] + [("spoken", s.get("spoken"))] * (s["kind"] == "pronunciation") + [("gender", s.get("gender")), ("speaker", s.get("speaker_id"))] * (s["kind"] == "dialogue")
        return "<span " + " ".join(f'data-prl-{k}="{escaped(v).replace(chr(34), "&quot;")}"' for k, v in told if v) + ">"

    good = [s for s in spans if 0 <= s["start"] and s["end"] <= len(text) and (s["kind"] == "pause" or (s["kind"] in ("pronunciation", "dialogue", "skip") and s["start"] < s["end"]))]
    good.sort(key=lambda s: (s["start"], s["start"] - s["end"], s["kind"]))
    out, at = [], 0
    open_: list[dict] = []

    def move(to: int) -> None:
        nonlocal at
        out.append(escaped(text[at:to]))
        at = to

    for s in good:
        while open_ and open_[-1]["end"] <= s["start"]:
            move(open_.pop()["end"])
            out.append("</span>")
        # Only what lies in the innermost open span, and is not the same stretch, nests in it.
        if open_ and (s["end"] > open_[-1]["end"] or (s["start"], s["end"]) == (open_[-1]["start"], open_[-1]["end"])):
            continue
        move(s["start"])
        if s["kind"] == "pause":
            out.append(f'<span data-prl-pause="{s.get("pause_ms") or 0}"></span>')
        else:
            out.append(opened(s))
            open_.append(s)
    while open_:
        move(open_.pop()["end"])
        out.append("</span>")
    move(len(text))
    return "".join(out)


def annotate_text(text: Column, spans: Column) -> Column:
    """Blocks as escaped markup with their spans (kind, start, end, spoken, gender, speaker_id, pause_ms)."""
    return F.arrow_udf(lambda texts, lists: pa.array([None if t is None else annotate(t, s or []) for t, s in zip(texts.to_pylist(), lists.to_pylist(), strict=True)], pa.string()), "string")(text, spans)


def span_sidecar(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Spans by the place their block came from (href, path), empty values as null."""
    empty = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    joined = spans.join(blocks.select(*revisions.BLOCK, "href", "path"), revisions.BLOCK)
    return joined.select("href", "path", "block_index", "start", "end", "kind", empty("spoken"), empty("gender"), empty("speaker_id"))
