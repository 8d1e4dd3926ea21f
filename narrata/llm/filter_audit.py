"""How filters interact: what each removes, after others, alone, and on the whole.

A text is read once by a table-driven byte transducer: a table tells the class
of each byte (space, capital, symbol, inside a UTF-8 character, other), and a
second one, indexed by the states before and after the byte, what to count (a
word's begin, a capital, a code point, a symbol).  The state is whether the
last byte was white space, so a whole block of bytes is looked up at once with
numpy.  The words' spans go into an open-addressing hash table, many at a time:
a span that finds its slot taken is compared with the span there, byte by byte,
and goes on to the next slot unless they are equal, so distinct counts do not
rest on hashes.

Spark counts each text's failures; copies are told by SHA-256 and the smallest
key, with partial sums, so neither copies nor a hot part meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm import words

SYMBOLS = b"#$%&*|"
FILTERS = "ABCDE"
#: Fewest words, least share of distinct words and greatest share of capitals, in hundredths.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3

# Byte classes: what a byte is.
_SPACE, _OTHER, _CAPITAL, _SYMBOL, _INNER = range(5)
# Fields of the transducer's output, 20 bits each; a block has fewer bytes than a field can count.
_FIELD = 20
_WORD, _CODE_POINT, _UPPER = (1 << (_FIELD * k) for k in range(3))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(class of a byte, output at a byte's class after a space or not)."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[list(words.SPACES)] = _SPACE
    kind[65:91] = _CAPITAL
    kind[list(SYMBOLS)] = _SYMBOL
    kind[0x80:0xC0] = _INNER
    out = np.zeros((2, 5), np.int64)
    for after_space in (0, 1):
        for k in range(5):
            begins = after_space == 1 and k != _SPACE
            out[after_space, k] = begins * _WORD + (k != _INNER) * _CODE_POINT + (k == _CAPITAL) * _UPPER
    return kind, out


_KIND, _OUT = _tables()


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each span of ``data``, the number of the first span put into the table that has the same bytes.

    All spans look for a slot at once, round by round.  In a free slot one of
    those that meet there stays; the others are compared with it, and those
    that differ move on by one slot.
    """
    n = len(starts)
    size = 1 << max(4, (2 * n - 1).bit_length())
    slots = np.full(size, -1, np.int64)
    same = np.full(n, -1, np.int64)
    lengths = ends - starts
    waiting, at = np.arange(n), (hashes & np.uint64(size - 1)).astype(np.int64)
    while len(waiting):
        free = slots[at] < 0
        # Of several spans for one free slot, the last one written is in.
        slots[at[free]] = waiting[free]
        there = slots[at]
        equal = hashes[there] == hashes[waiting]
        equal &= lengths[there] == lengths[waiting]
        check = np.flatnonzero(equal & (there != waiting))
        equal[check] = _same_bytes(data, starts[there[check]], starts[waiting[check]], lengths[waiting[check]])
        same[waiting[equal]] = there[equal]
        waiting, at = waiting[~equal], (at[~equal] + 1) & (size - 1)
    return same


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans of equal length at ``a`` and ``b`` have the same bytes; long spans one by one."""
    same = np.ones(len(a), bool)
    going = np.arange(len(a))
    for at in range(min(64, int(lengths.max(initial=0)))):
        going = going[(lengths[going] > at) & same[going]]
        same[going] = data[a[going] + at] == data[b[going] + at]
    for k in np.flatnonzero(same & (lengths > 64)):
        same[k] = np.array_equal(data[a[k] : a[k] + lengths[k]], data[b[k] : b[k] + lengths[k]])
    return same


def _hashes(data: np.ndarray, starts: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Case-sensitive hashes of the words that begin at ``starts``; white space counts nothing."""
    size = 1 << max(16, (len(data) - 1).bit_length())
    powers = words._table(("powers", size), lambda: words._powers(words._BASE, size))
    inverse = words._table(("inverse", size), lambda: words._powers(words._INVERSE, size))
    values = words._table("exact values", lambda: words.mix(np.arange(1, 257, dtype=np.uint64) * words._BASE))[data]
    values[~inner] = 0
    values *= powers[: len(data)]
    return words.mix(np.add.reduceat(values, starts) * inverse[starts])


class _Counts:
    """Sums over the rows of a batch."""

    def __init__(self, rows: int) -> None:
        self.words, self.distinct, self.points, self.capitals = (np.zeros(rows, np.int64) for _ in range(4))
        self.symbols = np.zeros(rows, bool)


def read(column: pa.Array) -> _Counts:
    """Words, distinct words, code points, capitals and whether a symbol is there, for each text of a column."""
    data, offsets = words.buffers(column)
    counts = _Counts(len(offsets) - 1)
    for i, j in words.groups(offsets, words.PIECE):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a > words.PIECE:
            _read_long(data[a:b], i, counts)
        elif b > a:
            _read_rows(data[a:b], offsets[i : j + 1] - a, i, counts)
    return counts


def _step(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(output, inside a word, symbol) at each byte; a row begins as if after a space."""
    kind = _KIND[data]
    space = kind == _SPACE
    before = np.empty(len(data), np.uint8)
    before[0] = 1
    before[1:] = space[:-1]
    before[offsets[offsets < len(data)]] = 1
    return _OUT[before, kind], ~space, kind == _SYMBOL


def _read_rows(data: np.ndarray, offsets: np.ndarray, first: int, counts: _Counts) -> Iterator[tuple[int, int]]:
    """Rows that lie whole in one block; returns the spans of their distinct words."""
    out, inner, symbol = _step(data, offsets)
    rows = np.flatnonzero(np.diff(offsets))
    at = offsets[rows]
    packed = np.add.reduceat(out, at)
    mask = (1 << _FIELD) - 1
    counts.words[first + rows] = packed & mask
    counts.points[first + rows] = (packed >> _FIELD) & mask
    counts.capitals[first + rows] = packed >> (2 * _FIELD)
    counts.symbols[first + rows] = np.logical_or.reduceat(symbol, at)
    starts = np.flatnonzero(out & mask)
    if len(starts):
        # A span ends where the first byte outside lies, at its row's end at the latest.
        row = np.searchsorted(offsets, starts, "right") - 1
        ends = _ends(inner, starts, offsets[row + 1])
        # The row is part of what is hashed, so that words of different rows have other slots and never count as the same.
        same = distinct_spans_by_row(data, starts, ends, _hashes(data, starts, inner), row)
        fresh = np.flatnonzero(same == np.arange(len(starts)))
        counts.distinct[first : first + len(offsets) - 1] += np.bincount(row[fresh], minlength=len(offsets) - 1)
        return zip(starts[fresh], ends[fresh], strict=True)
    return zip((), ())


def _ends(inner: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> np.ndarray:
    outside = np.append(np.flatnonzero(~inner), len(inner))
    return np.minimum(outside[np.searchsorted(outside, starts)], limits)


def distinct_spans_by_row(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """As ``distinct_spans``, where spans of different rows are never the same."""
    salted = words.mix(hashes + row.astype(np.uint64) * words._BASE)
    same = distinct_spans(data, starts, ends, salted)
    crossed = np.flatnonzero(row[same] != row)
    if len(crossed):
        # Two rows' hashes met by chance: settle those rows one by one.
        for r in np.unique(np.concatenate([row[crossed], row[same[crossed]]])):
            mine = np.flatnonzero(row == r)
            same[mine] = mine[distinct_spans(data, starts[mine], ends[mine], hashes[mine])]
    return same


def _read_long(data: np.ndarray, row: int, counts: _Counts) -> None:
    """One text longer than a block: its blocks one after the other, each with a table of its own; what they hold is joined."""
    seen: set[bytes] = set()
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + words.PIECE)
        while to < n and _KIND[data[to]] != _SPACE:
            # A word across the border belongs to this block.
            spaces = np.flatnonzero(_KIND[data[to : to + words.PIECE]] == _SPACE)
            to = to + int(spaces[0]) if len(spaces) else min(n, to + words.PIECE)
        part = data[at:to]
        if len(part) <= 2 * words.PIECE:
            one = _Counts(1)
            firsts = _read_rows(part, np.array([0, len(part)]), 0, one)
            seen.update(part[s:e].tobytes() for s, e in firsts)
            counts.words[row] += one.words[0]
            counts.points[row] += one.points[0]
            counts.capitals[row] += one.capitals[0]
            counts.symbols[row] |= one.symbols[0]
        else:
            # A word of several blocks: nothing to look up side by side.
            whole = part.tobytes().split()
            seen.update(whole)
            counts.words[row] += len(whole)
            for a in range(0, len(part), words.PIECE):
                kind = _KIND[part[a : a + words.PIECE]]
                counts.points[row] += int((kind != _INNER).sum())
                counts.capitals[row] += int((kind == _CAPITAL).sum())
                counts.symbols[row] |= bool((kind == _SYMBOL).any())
        at = to
    counts.distinct[row] = len(seen)


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(key, part, digest, fails): which of filters A to D each text fails, as bits 0 to 3."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = read(batch.column(3))
            fails = c.words < LEAST_WORDS
            fails = fails + 2 * (100 * c.distinct < LEAST_DISTINCT * c.words) + 4 * (100 * c.capitals > MOST_CAPITALS * c.points) + 8 * c.symbols
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fails.astype(np.int32))], names=["key", "part", "digest", "fails"])

    text_ = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text_.cast("binary"), 256)).alias("digest"), text_.alias("text"))
    return rows.mapInArrow(job, f"key {rows.schema['key'].dataType.simpleString()}, part string, digest binary, fails int")


def _orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, bit of the filter)."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out.append((order, step, before, bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What each filter does at each step of every order, per part.

    Filters: A fewer than 200 words; B under half of the words distinct; C over
    3 % capitals A-Z; D a symbol of ``#$%&*|``; E the text of a row with a
    smaller key.  Columns: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    Edge cases: a null text is empty, a null part the empty string.  A row with
    a null key never fails E and is nobody's smaller key; rows that share a key
    are rows of their own, equal in E.  Labels that come twice for a key count
    by their greatest values; other columns are not read.  Without rows there
    are no parts.
    """
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    rows = failures(docs, key, text, part).join(marks, "key", "left")
    rows = rows.select("key", "part", "digest", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # With the key in the group, copies are dealt evenly; then the copies of a text in a part come down to one row, by partial minimums.
    same = ["digest", "part", "fails", "good", "toxic"]
    per_key = rows.groupBy(*same, "key").agg(F.count("*").alias("rows"))
    known = F.when(F.col("key").isNotNull(), F.struct("key", "rows"))
    lists = per_key.groupBy(*same).agg(F.sum("rows").alias("rows"), F.min(known).alias("first"), F.sum(F.when(F.col("key").isNull(), F.col("rows"))).alias("keyless"))
    least = F.min("first.key").over(Window.partitionBy("digest"))
    originals = F.when(F.col("first.key") == least, F.col("first.rows")).otherwise(0) + F.coalesce("keyless", F.lit(0))
    first, later = F.struct(F.col("fails").alias("bits"), F.col("originals").alias("count")), F.struct((F.col("fails") + 16).alias("bits"), (F.col("rows") - F.col("originals")).alias("count"))
    counted = lists.withColumn("originals", originals).withColumn("split", F.explode(F.array(first, later))).groupBy("part", "split.bits", "good", "toxic").agg(F.sum("split.count").alias("count")).filter("count > 0")
    return _report(counted)


def _report(counted: DataFrame) -> DataFrame:
    """All orders and steps of (part, bits, good, toxic, count), of which a part has at most 128 rows."""
    steps = ", ".join(f"named_struct('o', '{o}', 's', {s}, 'm', {m}, 'b', {b})" for o, s, m, b in _orders())
    rows = counted.withColumn("at", F.expr(f"explode(array({steps}))"))
    fails, gone = F.col("bits").bitwiseAND(F.col("at.b")) != 0, F.col("bits").bitwiseAND(F.col("at.m")) != 0

    def total(when, amount="count"):
        return F.sum(F.when(when, F.col(amount) if isinstance(amount, str) else amount).otherwise(0)).cast("long")

    removed = fails & ~gone
    # Of k filters that a row fails, each is the first in one k-th of all orders.
    share = F.col("count") * (F.lit(120) / F.bit_count("bits")).cast("long")
    out = rows.groupBy("part", F.col("at.o").alias("filter_order"), F.col("at.s").alias("step"))
    return out.agg(
        total(~fails & ~gone).alias("kept"),
        total(removed).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("bits") == F.col("at.b")).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )
