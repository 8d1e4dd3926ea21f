"""Offsets of regular-expression matches, and claims of intervals, as columns.

Offsets are code points into one block, half-open.  Matches come from small
Arrow functions: one pass over a block finds all of them, in time in
proportion to its length, and nothing is shuffled.  Patterns are Python's.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = "array<struct<start:int,end:int,match:string>>"
CLAIMED = "array<struct<step:int,start:int,end:int,match:string,said:string>>"
#: A pattern, or what finds its matches, and whether a match counts.
Pass = tuple[object, Callable[[str], bool] | None]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where lambdas would repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def struct_lists(rows: list[list[tuple]], names: Sequence[str], types: Sequence[pa.DataType]) -> pa.Array:
    """A list-of-structs column; a row is a list of tuples."""
    offsets, flat = [0], []
    for row in rows:
        flat += row
        offsets.append(len(flat))
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(names)
    fields = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=list(names)))


def list_tuples(lists: pa.Array, names: Sequence[str]) -> list[list[tuple] | None]:
    """Rows of a list-of-structs column as lists of tuples, field by field, which is much faster than ``to_pylist``; a null list stays null.  A null struct is a tuple of nulls."""
    flat = lists.flatten()
    found = list(zip(*(pc.struct_field(flat, n).to_pylist() for n in names), strict=True))
    rows, at = [], 0
    for n in pc.list_value_length(lists).to_pylist():
        rows.append(None if n is None else found[at : at + n])
        at += n or 0
    return rows


def find_all(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, match>>`` of the leftmost non-overlapping matches.

    Null text has no matches; empty matches do not count.
    """
    compiled = re.compile(pattern)

    def job(texts: pa.Array) -> pa.Array:
        rows = [[(m.start(), m.end(), m[0]) for m in compiled.finditer(t) if m.end() > m.start()] if t else [] for t in texts.to_pylist()]
        return struct_lists(rows, ("start", "end", "match"), (pa.int32(), pa.int32(), pa.string()))

    return F.arrow_udf(job, HIT)(text)


class Claims:
    """Disjoint intervals in order; adding one finds its neighbours by bisection."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        """Add the interval unless it is empty or overlaps one that is there."""
        k = bisect_left(self.ends, start + 1)
        if end <= start or (k < len(self.starts) and self.starts[k] < end):
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True

    def free(self, start: int, end: int) -> bool:
        """Whether an interval that is not empty overlaps none that is there."""
        k = bisect_left(self.ends, start + 1)
        return k == len(self.starts) or self.starts[k] >= end

    def take_all(self, spans: list[tuple]) -> list[tuple]:
        """Those of disjoint spans (start, end, ...), none empty, that overlap none that is there; they are added together."""
        spans = self.apart(spans)
        if spans:
            self.starts = sorted(self.starts + [s[0] for s in spans])
            self.ends = sorted(self.ends + [s[1] for s in spans])
        return spans

    def apart(self, spans: list[tuple]) -> list[tuple]:
        """Those of spans (start, end, ...), none empty, that overlap none that is there."""
        if not self.starts:
            return spans
        starts, ends, n = self.starts, self.ends, len(self.starts)
        return [s for s in spans if (k := bisect_left(ends, s[0] + 1)) == n or starts[k] >= s[1]]


def claimed(text: str, passes: Iterable[tuple[object, Callable[[str], bool] | None]], kept: Claims | None = None) -> list[tuple[int, int, int, str]]:
    """(step, start, end, match) of all passes, a match of an earlier pass before those that overlap it.

    What has ``needed`` is not searched for in a text without it, in any case.
    """
    kept, out, low = Claims() if kept is None else kept, [], None
    for step, (pattern, good) in enumerate(passes):
        if needed := getattr(pattern, "needed", None):
            low = text.casefold() if low is None else low
            if needed not in low:
                continue
        if spans := getattr(pattern, "spans", None):
            found = spans(text)
        else:
            found = [(m.start(), m.end(), w) for m in pattern.finditer(text) if (w := m[0]) and (good is None or good(w))]
        if found:
            out += [(step, *s) for s in kept.take_all(found)]
    return out


def find_claimed(text: Column, passes: Sequence[Pass], say: Callable[[int, str], str | None] | None = None) -> Column:
    """``array<struct<step, start, end, match, said>>``: matches of several patterns under one claim, by pass and place.

    ``say`` gives what is said for a step's match, where columns cannot tell.
    """
    compiled = [(re.compile(p) if isinstance(p, str) else p, good) for p, good in passes]

    def job(texts: pa.Array) -> pa.Array:
        rows = [[(*c, say(c[0], c[3]) if say else None) for c in claimed(t, compiled)] if t else [] for t in texts.to_pylist()]
        return struct_lists(rows, ("step", "start", "end", "match", "said"), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()))

    return F.arrow_udf(job, CLAIMED)(text)


def put(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with spans (start, end, new) replaced from right to left; disjoint ones in one pass."""
    spans = sorted(spans)
    if all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)):
        out, at = [], 0
        for start, end, new in spans:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]])
    for start, end, new in reversed(spans):
        text = text[:start] + new + text[end:]
    return text


def _put_all(texts: pa.Array, lists: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), list_tuples(lists, ("start", "end", "new")), strict=True)
    return pa.array([t if t is None or not spans else put(t, [(a, b, new or "") for a, b, new in spans]) for t, spans in rows], pa.string())


def replaced(text: Column, spans: Column) -> Column:
    """Text with ``array<struct<start, end, new>>`` replaced, in time in proportion to its length; see ``put``."""
    return F.arrow_udf(_put_all, "string")(text, spans)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two structs with start and end share a character."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _claim_flags(lists: pa.Array) -> pa.Array:
    out = []
    for spans in lists.to_pylist():
        kept = Claims()
        out.append(None if spans is None else [kept.take(s["start"], s["end"]) for s in spans])
    return pa.array(out, pa.list_(pa.bool_()))


def claim(candidates: Column) -> Column:
    """Greedy claim: in array order, keep what overlaps nothing kept before.

    Sort by pass, then start, beforehand.  Empty intervals are dropped.
    """
    spans = F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    flags = F.arrow_udf(_claim_flags, "array<boolean>")(spans)
    kept = F.filter(F.arrays_zip(candidates.alias("c"), flags.alias("kept")), lambda z: z["kept"])
    return F.transform(kept, lambda z: z["c"])
