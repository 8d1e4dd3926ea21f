"""Sentences of a block, and pieces of sentences that fit a limit."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions.offsets import HIT, struct_lists

# Fixed values. Abbreviations whose dot ends no sentence, what may close and open one, and what a clause ends with.
ABBREVIATIONS = "np. tzn. itd. itp. m.in. ok. godz. ul. dr. prof. r. w. św.".split()
CLOSERS, OPENERS = "\"'”»)]}", "\"'„«“(["
CLAUSES = (";", ",", " — ", " – ", " - ")

#: What cuts a text into sentences: start and end of each, in order, with nothing but white space between them.
Segment = Callable[[str], list[tuple[int, int]]]

SHORT = re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + r")(?![^\W_])")
BEFORE_DOT = {a[k - 1] for a in ABBREVIATIONS for k in range(1, len(a)) if a[k] == "."}
LONGEST = max(map(len, ABBREVIATIONS))
END = re.compile(rf"([.!?…]+)[{re.escape(CLOSERS)}]*\s+(?=[{re.escape(OPENERS)}]*(.))", re.S)
SPACE = re.compile(r"\s*")


def _shortened(text: str, at: int) -> bool:
    """Whether a stop is in an abbreviation; none begins inside another, so what stands around the stop tells."""
    if text[at] != "." or text[at - 1 : at].lower() not in BEFORE_DOT:
        return False
    low = max(0, at - LONGEST - 1)
    return any(m.start() <= at - low < m.end() for m in SHORT.finditer(text[low : at + LONGEST + 2]))


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, without the white space between them.

    One ends at a full stop, mark or ellipsis before white space and a capital,
    a digit or a dash, unless the stop belongs to an abbreviation.
    """
    begins = [SPACE.match(text).end()]
    for m in END.finditer(text):
        if (m[2].isupper() or m[2].isdigit() or m[2] in "—–-") and not all(_shortened(text, at) for at in range(m.start(), m.end(1))):
            begins.append(m.end())
    ends = [*begins[1:], len(text)]
    spans = [(a, a + len(text[a:b].rstrip())) for a, b in zip(begins, ends, strict=True)]
    return [s for s in spans if s[0] < s[1]]


def guarded(segment: Segment) -> Segment:
    """A segmenter whose cuts behind an abbreviation's dot do not count."""

    def job(text: str) -> list[tuple[int, int]]:
        ends = {m.end() for m in SHORT.finditer(text)}
        out: list[tuple[int, int]] = []
        for start, end in segment(text):
            if out and out[-1][1] in ends:
                start = out.pop()[0]
            out.append((start, end))
        return out

    return job


def sentence_spans(text: Column, segment: Segment = sentences) -> Column:
    """``array<struct<start, end, match>>`` of the sentences; null and blank blocks have none."""

    def job(texts: pa.Array) -> pa.Array:
        rows = [[(a, b, t[a:b]) for a, b in segment(t)] if t else [] for t in texts.to_pylist()]
        return struct_lists(rows, ("start", "end", "match"), (pa.int32(), pa.int32(), pa.string()))

    return F.arrow_udf(job, HIT)(text)


def fit(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters: cut at clauses, else at white space; a longer word stays whole."""
    out, todo = [], [text.strip()]
    while todo:
        piece = todo.pop()
        if len(piece) <= limit:
            out += [piece] if piece else []
            continue
        parts = next((p for p in ([x.strip() for x in piece.split(c) if x.strip()] for c in CLAUSES if c in piece) if len(p) > 1), None)
        if parts is None:
            space = piece.rfind(" ", 0, limit + 1)
            space = space if space > 0 else piece.find(" ")
            if space <= 0:
                out.append(piece)
                continue
            parts = [piece[space + 1 :].strip()]
            out += [piece[:space].strip()] if piece[:space].strip() else []
        todo += reversed(parts)
    return out


def pack(text: str, limit: int, whole: bool = False, segment: Segment = sentences) -> list[str]:
    """Sentences joined by spaces up to ``limit`` characters; with ``whole`` a text that fits stays one piece."""
    text = text.strip()
    if whole and 0 < len(text) <= limit:
        return [text]
    packed: list[str] = []
    for a, b in segment(text):
        for piece in fit(text[a:b], limit):
            if packed and len(packed[-1]) + 1 + len(piece) <= limit:
                packed[-1] += " " + piece
            else:
                packed.append(piece)
    return packed


def pieces(text: Column, limit: int, whole: Column | None = None, segment: Segment = sentences) -> Column:
    """``array<string>`` of a run's pieces; see ``pack``."""

    def job(texts: pa.Array, wholes: pa.Array) -> pa.Array:
        return pa.array([pack(t, limit, bool(w), segment) if t else [] for t, w in zip(texts.to_pylist(), wholes.to_pylist(), strict=True)], pa.list_(pa.string()))

    return F.arrow_udf(job, "array<string>")(text, F.lit(False) if whole is None else whole)


def split_oversized(text: Column, limit: int) -> Column:
    """``array<string>`` of one sentence's pieces; see ``fit``."""
    return F.arrow_udf(lambda texts: pa.array([fit(t, limit) if t else [] for t in texts.to_pylist()], pa.list_(pa.string())), "array<string>")(text)
