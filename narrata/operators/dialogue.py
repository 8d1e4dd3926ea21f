"""Dialogue: which parts of a block are spoken, told by dashes, quotes and verbs of saying."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions.offsets import struct_lists
from narrata.functions.sentences import SPACE, sentences

# Fixed values. Verbs of saying, pronouns that may stand before them, dashes, quotation marks and confidences.
SAYING = (
    "powiedział powiedziała rzekł rzekła mówił mówiła odparł odparła odrzekł odrzekła odpowiedział odpowiedziała zapytał zapytała spytał spytała "
    "krzyknął krzyknęła szepnął szepnęła mruknął mruknęła warknął warknęła dodał dodała wtrącił wtrąciła ciągnął ciągnęła zauważył zauważyła "
    "stwierdził stwierdziła westchnął westchnęła syknął syknęła jęknął jęknęła zaczął zaczęła skończył skończyła przerwał przerwała"
).split()
PRONOUNS = "ja ty on ona ono my wy oni one mu jej go ją im ich".split()
DASHES = "-–—"
QUOTES = {"„": "”", "«": "»", "“": "”", '"': '"', "”": "”"}
SURE, ASIDE, QUOTED, UNBALANCED = 0.9, 0.45, 0.4, 0.35

VERBS, BEFORE_VERB = frozenset(SAYING), frozenset(PRONOUNS)
DASH = re.compile(rf"[{DASHES}](?=\s|\Z)")
OPENING = re.compile("[" + "".join(QUOTES) + "]")
TOKEN = re.compile(r"[^\W_](?:[^\W_]|[-'’])*")
SEGMENTS = "array<struct<kind:string,start:int,end:int,confidence:double>>"
READING = f"struct<segments:{SEGMENTS},reason:string,confidence:double,proposed:{SEGMENTS}>"
Span = tuple[str, int, int, float]


def trim(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without white space and dashes at its ends."""
    part = text[max(0, start) : end]
    start = max(0, start) + len(part) - len(part.lstrip().lstrip(DASHES + " \t\r\n\f\v "))
    return start, max(start, start + len(text[start:end].rstrip(DASHES + " \t\r\n\f\v ")))


def _span(text: str, kind: str, start: int, end: int, confidence: float) -> list[Span]:
    start, end = trim(text, start, end)
    return [(kind, start, end, confidence)] if start < end else []


def find_dashes(text: str) -> list[tuple[int, int, str]]:
    """(place, start of what follows, kind) of the dashes before white space: first in the block, behind a colon, or behind white space."""
    first, out = len(text) - len(text.lstrip()), []
    for m in DASH.finditer(text):
        at = m.start()
        after = SPACE.match(text, at + 1).end()
        if at <= first:
            kind = "initial"
        elif re.search(r":\s*\Z", text[max(0, at - 50) : at]):
            kind = "colon"
        elif text[at - 1].isspace():
            kind = "flanked"
        else:
            continue
        out.append((at, after, kind))
    return out


def says(text: str, at: int) -> bool:
    """Whether a verb of saying is among the next three words, with only names and pronouns before it."""
    words, end = [], at
    for m in TOKEN.finditer(text, at):
        if any(c in DASHES for c in text[end : m.start()]) or len(words) == 3:
            break
        words.append(m[0])
        end = m.end()
        if m[0].casefold() in VERBS:
            return all(w.casefold() in BEFORE_VERB or w[0].isupper() for w in words[:-1])
    return False


def confirmed_dashes(text: str, dashes: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(place, start of what follows, kind of what follows) of the dashes that begin speech or end it.

    A dash first in the block or behind a colon begins speech.  One before a
    verb of saying ends it; the next one begins it again.  Any other begins
    speech only if the next dash tells who says it.
    """
    flanked = [kind == "flanked" and says(text, after) for _, after, kind in dashes]
    speaking = tagged = False
    out = []
    for k, (at, after, kind) in enumerate(dashes):
        if kind == "flanked" and flanked[k]:
            speaking, tagged = False, True
        elif kind != "flanked" or (not speaking and (tagged or any(flanked[k + 1 : k + 2]))):
            speaking, tagged = True, False
        else:
            continue
        out.append((at, after, "dialogue" if speaking else "narration"))
    return out


def find_quotes(text: str) -> tuple[list[tuple[int, int]], bool]:
    """Insides of the quotes, and whether one is not closed."""
    out, at = [], 0
    while m := OPENING.search(text, at):
        end = text.find(QUOTES[m[0]], m.end())
        if end < 0:
            return out, True
        out.append((m.end(), end))
        at = end + 1
    return out, False


def _by_dashes(text: str, chosen: list[tuple[int, int, str]]) -> list[Span]:
    out, at, kind = [], 0, "narration"
    for place, after, follows in chosen:
        out += _span(text, kind, at, place, SURE)
        at, kind = after, follows
    return out + _span(text, kind, at, len(text), SURE)


def _by_quotes(text: str, quotes: list[tuple[int, int]], confidence: float) -> list[Span]:
    bounds = [("narration", a, b, 1.0) for a, b in zip([0, *(e + 1 for _, e in quotes)], [*(s - 1 for s, _ in quotes), len(text)], strict=True)]
    bounds += [("dialogue", a, b, confidence) for a, b in quotes]
    spans = [s for kind, a, b, c in sorted(bounds, key=lambda s: (s[1], s[2])) if a < b for s in _span(text, kind, a, b, c)]
    return [s for s in spans if text[s[1] : s[2]].strip(" \t.?!,;:…\"'”»")]


def _alternating(text: str, places: list[int]) -> list[Span]:
    return [s for k, (a, b) in enumerate(zip([0, *places], [*places, len(text)], strict=True)) for s in _span(text, "dialogue" if k % 2 else "narration", a, b, ASIDE)]


def _told(text: str, quotes: list[tuple[int, int]]) -> bool:
    """Whether a verb of saying stands outside a quote, in a sentence of it or next to it."""
    spans = sentences(text)
    verbs = [m.start() for m in TOKEN.finditer(text) if m[0].casefold() in VERBS]
    for start, end in quotes if verbs else ():
        touched = [k for k, (a, b) in enumerate(spans) if b > start and a < end] or ([0] if spans else [])
        for k in range(max(0, touched[0] - 1), min(len(spans), touched[-1] + 2)) if touched else ():
            if any(spans[k][0] <= v < spans[k][1] and not start <= v < end for v in verbs):
                return True
    return False


def read(text: str | None) -> tuple[list[Span], str | None, float | None, list[Span]]:
    """(segments, reason, confidence, proposed): the tiling that is sure, and what a reviewer is shown, if anything."""
    if not text or not text.strip():
        return [], None, None, []
    dashes = find_dashes(text)
    if chosen := confirmed_dashes(text, dashes):
        tiling = _by_dashes(text, chosen)
        spoken = any(s[0] == "dialogue" for s in tiling)
        return tiling, "dialogue" if spoken else None, SURE if spoken else None, tiling if spoken else []
    quotes, unclosed = find_quotes(text)
    plain = _span(text, "narration", 0, len(text), 1.0)
    loose = _by_quotes(text, quotes, QUOTED) if quotes and not dashes else _alternating(text, [d[0] for d in dashes])
    if unclosed or len(dashes) % 2:
        return plain, "unbalanced_quote" if unclosed else "odd_dash", UNBALANCED, loose
    if dashes:
        return plain, "unconfirmed_dash", ASIDE, loose
    if quotes and _told(text, quotes):
        tiling = _by_quotes(text, quotes, SURE)
        spoken = any(s[0] == "dialogue" for s in tiling)
        return tiling, "dialogue" if spoken else None, SURE if spoken else None, tiling if spoken else []
    return plain, *(("quote_without_verb", QUOTED, loose) if quotes else (None, None, []))


def _job(texts: pa.Array) -> pa.Array:
    rows = [read(t) for t in texts.to_pylist()]
    names, types = ("kind", "start", "end", "confidence"), (pa.string(), pa.int32(), pa.int32(), pa.float64())
    columns = [struct_lists([r[0] for r in rows], names, types), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), struct_lists([r[3] for r in rows], names, types)]
    return pa.StructArray.from_arrays(columns, names=["segments", "reason", "confidence", "proposed"])


def dialogue(text: Column) -> Column:
    """The reading of a block: segments, and reason, confidence and proposed segments of the suggestion if there is one."""
    return F.arrow_udf(_job, READING)(text)


def dialogue_segments(blocks: DataFrame, text: str = "text") -> DataFrame:
    """One row per segment of the sure tiling: the other columns, position, segment, start, end, confidence, part."""
    rest = [c for c in blocks.columns if c != text]
    rows = blocks.select(*rest, text, F.posexplode(dialogue(F.col(text))["segments"]).alias("position", "s"))
    return rows.select(*rest, "position", F.col("s.kind").alias("segment"), "s.start", "s.end", "s.confidence", F.expr(f"substring({text}, s.start + 1, s.end - s.start)").alias("part"))


def dialogue_suggestions(blocks: DataFrame, text: str = "text") -> DataFrame:
    """One row per block with dialogue, or with marks that a reviewer should see."""
    rest = [c for c in blocks.columns if c != text]
    rows = blocks.select(*rest, text, dialogue(F.col(text)).alias("r")).filter("r.reason IS NOT NULL")
    return rows.select(*rest, F.lit(0).alias("start"), F.length(text).alias("end"), F.lit("dialogue_split").alias("kind"), F.col(text).alias("original"), F.lit("").alias("replacement"), "r.reason", "r.confidence", F.col("r.proposed").alias("segments"))
