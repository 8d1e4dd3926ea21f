"""Substring deduplication by MinHash banding of paragraphs.

Paragraphs are the lines of a text, and besides them windows of ``WINDOW``
words that begin at anchors.  Of every ``REACH`` consecutive windows the one
with the smallest hash is an anchor, so anchors depend on the words around
them alone, and every unedited passage of ``WINDOW + REACH - 1`` words (34)
holds one, wherever it stands, in the middle of a line too; in a longer one
windows overlap from end to end.

Lines have bands of two MinHashes, as many as the recall asks for; those
that collide are compared by exact Jaccard similarity of their shingles.  A
window is so short that an edit leaves it under the threshold, so its one band
has all rows: equal sets collide.  Links are clustered into components; of
each the first occurrence stays and the others are marked as repeats.  At both
ends a repeat is then compared with the occurrence that stays, word by word,
and goes on to where the texts part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.llm import words
from narrata.llm.graph import small
from narrata.llm.ngram_join import Rule, contract, listed, set_schema
from narrata.llm.scratch import cut

WINDOW = 20
REACH = 15
#: Lines of fewer words are no paragraphs: stock phrases and headings repeat in texts that repeat nothing else.
LINE = 20
RULE = Rule(size=5, num=80, den=100)
#: Words beside a span that it can go on for; were there more, they would hold a window of their own.
BESIDE = WINDOW + REACH - 1


def bands(similarity: float, recall: float, rows: int) -> int:
    """Bands of so many rows each that find a pair of this similarity with this recall."""
    return ceil(log(1 - recall) / log(1 - similarity**rows))


#: Two rows a band: one is often a run of words that many lines share.
ROWS = 2
LINE_BANDS = bands(0.8, 0.99, ROWS)


def _windows(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start word of the window behind every anchor, and a fingerprint of the window's shingles.

    ``tokens`` has a shingle at each word but a row's last ones.
    """
    size = WINDOW - RULE.size + 1
    mixed = words.mix(tokens ^ np.uint64(0x2545F491))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prints = words.mix(sums[size:] - sums[:-size])[:n]
    # Windows that cross a row's end are no windows.
    length = np.diff(first)
    row = np.repeat(np.arange(len(length)), length)[:n]
    inside = np.arange(n) + WINDOW <= first[row + 1]
    prints[~inside] = np.uint64(2**64 - 1)
    # The smallest of every REACH consecutive ones; a row with fewer has its smallest.
    padded = np.concatenate([np.full(REACH - 1, 2**64 - 1, np.uint64), prints, np.full(REACH - 1, 2**64 - 1, np.uint64)])
    least, width = padded, 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    span = len(padded) - REACH + 1
    least = np.minimum(least[:span], least[REACH - width : REACH - width + span])
    # A window is an anchor if it is the smallest of one of the runs that hold it and lie in its row.
    chosen = np.zeros(n, bool)
    begins = np.arange(span) - (REACH - 1)
    whole = (begins >= 0) & (begins + REACH <= n)
    whole[whole] &= (row[begins[whole]] == row[begins[whole] + REACH - 1]) & inside[begins[whole] + REACH - 1]
    for k in range(REACH):
        at = begins[whole] + k
        chosen[at[prints[at] == least[whole]]] = True
    count = np.maximum(length - WINDOW + 1, 0)
    for r in np.flatnonzero((count > 0) & (count < REACH)):
        some = np.arange(first[r], first[r] + count[r])
        some = some[some < n]
        if len(some):
            chosen[some[np.argmin(prints[some])]] = True
    anchors = np.flatnonzero(chosen & inside)
    return anchors, prints[anchors]


def _apart(begin: np.ndarray, node: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without windows that overlap an equal one before them in the same row: a run of repeated words is one passage."""
    order = np.lexsort((begin, node, row))
    b, n, r = begin[order], node[order], row[order]
    close = np.append(False, (n[1:] == n[:-1]) & (r[1:] == r[:-1]) & (b[1:] < b[:-1] + WINDOW))
    kept = np.sort(order[~close])
    return begin[kept], node[kept]


def _lines(data: np.ndarray, starts: np.ndarray, first: np.ndarray, origin: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end word of the lines with LINE words or more."""
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(data == 10) + origin
    begin = np.unique(np.concatenate([first[:-1], np.searchsorted(starts, breaks)]))
    begin = begin[begin < len(starts)]
    end = np.append(begin[1:], len(starts))
    keep = end - begin >= LINE
    return begin[keep], end[keep]


def _sets(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each span of words, sorted, and where each span's begin."""
    length = np.maximum(end - begin, 0)
    at = np.concatenate([[0], np.cumsum(length)])
    take = np.repeat(begin - at[:-1], length) + np.arange(at[-1])
    return words.distinct_sorted(*words.shingle_hashes(hashes[take], at, RULE.size))


def _job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs: node (a fingerprint), doc_id, begin, end, n_words; of lines also n (their distinct shingles) and bands; offsets are code points."""
    for batch in batches:
        data, offsets = words.buffers(batch.column("text"))
        ids = batch.column("doc_id")
        for i, j in words.groups(offsets):
            some = offsets[i : j + 1]
            hashes, starts, first = words.word_hashes(data, some)
            if len(hashes) < WINDOW:
                continue
            part = data[some[0] : some[-1]]
            points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int32)])
            sep = np.append(np.flatnonzero(words._is_separator(words.SPACES)[part]) + some[0], some[-1])

            def placed(begin: np.ndarray, end: np.ndarray) -> list[pa.Array]:
                row = np.searchsorted(first, begin, "right") - 1
                stop = np.minimum(sep[np.searchsorted(sep, starts[end - 1])], some[row + 1])
                base = points[some[row] - some[0]]
                return [ids.take(pa.array(row + i)), pa.array((points[starts[begin] - some[0]] - base).astype(np.int32)), pa.array((points[stop - some[0]] - base).astype(np.int32)), pa.array((end - begin).astype(np.int32))]

            names = ["node", "doc_id", "begin", "end", "n_words", "n", "bands"]
            begin, end = _lines(part, starts, first, some[0])
            if len(begin):
                tokens, at = _sets(hashes, begin, end)
                minima = [np.minimum.reduceat(words.mix(tokens ^ np.uint64((k + 1) * 0x9E3779B9)), at[:-1]) for k in range(LINE_BANDS * ROWS)]
                banded = np.stack([words.mix(a * np.uint64(3) + b) + np.uint64(k) for k, (a, b) in enumerate(zip(minima[::ROWS], minima[1::ROWS], strict=True))], axis=1)
                node = words.mix(words.fold(words.mix(tokens ^ np.uint64(0x2545F491)), at) + np.diff(at).astype(np.uint64))
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(begin) + 1) * LINE_BANDS).astype(np.int32)), pa.array(banded.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *placed(begin, end), pa.array(np.diff(at).astype(np.int32)), lists], names=names)
            shingles, _ = words.shingle_hashes(hashes, np.array([0, len(hashes)]), RULE.size)
            begin, node = _windows(shingles, first)
            begin, node = _apart(begin, node, np.searchsorted(first, begin, "right"))
            if len(begin):
                # Another hash than that of a line with the same words.
                yield pa.RecordBatch.from_arrays([pa.array(words.mix(node + np.uint64(1)).view(np.int64)), *placed(begin, begin + WINDOW), pa.nulls(len(begin), pa.int32()), pa.nulls(len(begin), pa.list_(pa.int64()))], names=names)


def _texts(sketched: bool):
    """A job for the sets, or sketches, of the paragraphs that each row's list of (node, begin, end) asks for."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                data, offsets = words.buffers(pa.array([text[w["begin"] : w["end"]] for w in wanted], pa.string()))
                hashes, _, first = words.word_hashes(data, offsets)
                yield listed(pa.array([w["node"] for w in wanted], pa.int64()), *_sets(hashes, first[:-1], first[1:]), sketched)

    return job


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _beside(text: str, begin: int, end: int) -> tuple[str, str]:
    """The last BESIDE words before a span and the first ones behind it, with the white space between."""
    size, found = 16 * BESIDE, []
    for ahead in (False, True):
        width = size
        while True:
            part = text[end : end + width] if ahead else text[max(0, begin - width) : begin]
            whole = end + width >= len(text) if ahead else begin <= width
            places = [m.span() for m in _WORD.finditer(part)]
            # A word at the border may be cut.
            if whole or len(places) > BESIDE:
                break
            width *= 2
        if len(places) > BESIDE:
            part = part[: places[BESIDE - 1][1]] if ahead else part[places[-BESIDE][0] :]
        found.append(part)
    return found[0], found[1]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, begin, end, left, right) of the spans that each row's list asks for."""
    for batch in batches:
        for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k in range(0, len(wanted), 1000):
                some = wanted[k : k + 1000]
                left, right = zip(*(_beside(text, w["begin"], w["end"]) for w in some), strict=True)
                columns = [pa.array([doc] * len(some), pa.int64()), pa.array([w["begin"] for w in some], pa.int32()), pa.array([w["end"] for w in some], pa.int32()), pa.array(left), pa.array(right)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "begin", "end", "left", "right"])


def _common(a: str, b: str, ahead: bool) -> tuple[int, int]:
    """Characters of two contexts, from the span on, up to where their words part; letters A-Z in either case."""
    places = [[m.span() for m in _WORD.finditer(t)] for t in (a, b)]
    x, y = places if ahead else (places[0][::-1], places[1][::-1])
    n = 0
    while n < min(len(x), len(y)) and a[slice(*x[n])].encode("utf-8", "surrogatepass").lower() == b[slice(*y[n])].encode("utf-8", "surrogatepass").lower():
        n += 1
    if n == 0:
        return 0, 0
    return (x[n - 1][1], y[n - 1][1]) if ahead else (len(a) - x[n - 1][0], len(b) - y[n - 1][0])


def _extents(*sides: pa.Array) -> pa.Array:
    """How far a span and the one it repeats go on, to the left and to the right."""
    rows = zip(*(s.to_pylist() for s in sides), strict=True)
    found = [(*_common(a, b, False), *_common(c, d, True)) if a is not None and b is not None else (0, 0, 0, 0) for a, c, b, d in rows]
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in (zip(*found, strict=True) if found else ((),) * 4)], names=["left", "first_left", "right", "first_right"])


def extended(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans (doc_id, first_doc_id, begin, end, first_begin, first_end) that go on to where both texts part.

    The texts are read once more, for the words beside each place; a place
    that many spans repeat is read once.
    """
    sides = (("doc_id", "begin", "end"), ("first_doc_id", "first_begin", "first_end"))
    places = [spans.select(F.col(d).alias("doc"), F.col(b).alias("begin"), F.col(e).alias("end")) for d, b, e in sides]
    wanted = places[0].unionByName(places[1]).distinct().groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("wanted"))
    wanted = cut(wanted, "places")
    held = docs.join(small(wanted.select("doc")), F.col("doc_id") == F.col("doc"), "left_semi").dropDuplicates(["doc_id"])
    beside = held.join(wanted, F.col("doc_id") == F.col("doc")).select("doc", "text", "wanted").mapInArrow(_contexts, "doc long, begin int, end int, left string, right string")
    beside = cut(beside, "beside")
    rows = spans
    for (d, b, e), side in zip(sides, "ab", strict=True):
        one = beside.select(F.col("doc").alias(d), F.col("begin").alias(b), F.col("end").alias(e), F.col("left").alias(f"{side}_left"), F.col("right").alias(f"{side}_right"))
        rows = rows.join(one, [d, b, e], "left")
    grown = F.arrow_udf(_extents, "struct<left:int,first_left:int,right:int,first_right:int>")("a_left", "a_right", "b_left", "b_right")
    rows = rows.withColumn("grown", grown)
    moved = {"begin": F.col("begin") - F.col("grown.left"), "end": F.col("end") + F.col("grown.right"), "first_begin": F.col("first_begin") - F.col("grown.first_left"), "first_end": F.col("first_end") + F.col("grown.first_right")}
    return rows.withColumns(moved).select(*spans.columns)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages that occur more than once, one row per document and span.

    doc_id, begin and end (code points), n_words (of the longest paragraph in
    the span), component_id and first_doc_id (the document whose occurrence
    stays; a component's id is the smallest fingerprint in it), removed (false
    for the occurrence that stays).  Overlapping paragraphs with the same
    fate and first document are one span, which goes on to where its text and
    that of the first occurrence part.

    Edge cases: null and empty texts and those of few words have no
    paragraphs; a null key takes part in nothing; a row repeated in full
    repeats nothing, other rows that share a key are parts of one document; a text may repeat
    a passage of its own, of which the first occurrence stays; a line of any
    length is one paragraph; an empty table gives an empty one; further
    columns are dropped.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "text"])
    rows = cut(docs.mapInArrow(_job, "node long, doc_id long, begin int, end int, n_words int, n int, bands array<long>"), "paragraphs")
    lines, windows = rows.filter("n IS NOT NULL"), rows.filter("n IS NULL").select("node", "doc_id", "begin", "end", "n_words")
    nodes = lines.groupBy("node").agg(F.min(F.struct("doc_id", "begin", "end")).alias("p"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = cut(nodes, "line-nodes")
    buckets = nodes.select("node", "n", F.explode("bands").alias("token")).withColumns({"matches": F.lit(1), "likely": F.lit(1), "rest": F.col("n")})

    def sets_of(some: DataFrame, sketched: bool) -> DataFrame:
        place = nodes.select("node", "p").join(small(some), "node", "left_semi")
        wanted = place.groupBy(F.col("p.doc_id").alias("of")).agg(F.collect_list(F.struct("node", F.col("p.begin").alias("begin"), F.col("p.end").alias("end"))).alias("wanted"))
        wanted = cut(wanted, "wanted")
        held = docs.join(small(wanted.select("of")), F.col("doc_id") == F.col("of"), "left_semi").dropDuplicates(["doc_id"])
        return held.join(wanted, F.col("doc_id") == F.col("of")).select("text", "wanted").mapInArrow(_texts(sketched), set_schema(sketched))

    labels = contract(buckets, RULE, sets_of)
    placed = lines.select("node", "doc_id", "begin", "end", "n_words")
    placed = placed.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node") if labels is not None else placed.withColumnRenamed("node", "component")
    placed = placed.unionByName(windows.withColumnRenamed("node", "component"))
    # What occurs once repeats nothing.  A hot passage is counted in parts, and its rows are joined in as many tasks as they need.
    firsts = placed.groupBy("component").agg(F.min(F.struct("doc_id", "begin", "end")).alias("first"), F.count("*").alias("times")).filter("times > 1").select("component", "first")
    found = placed.join(firsts, "component").withColumn("removed", (F.col("doc_id") != F.col("first.doc_id")) | (F.col("begin") != F.col("first.begin")))
    found = found.select("doc_id", F.col("first.doc_id").alias("first_doc_id"), "removed", "begin", "end", "n_words", "component", "first")
    # What a span repeats lies where its first paragraph's first occurrence begins and its last one's ends.
    first = [F.min_by("first.begin", F.struct("begin", "end")).alias("first_begin"), F.max_by("first.end", F.struct("end", "begin")).alias("first_end")]
    spans = cut(_joined(found, first), "spans")
    grown = cut(extended(spans.filter("removed"), docs), "grown")
    # The occurrences that stay reach as far as the furthest repeat of them.
    stay = grown.select(F.col("first_doc_id").alias("doc_id"), "first_doc_id", F.lit(False).alias("removed"), F.col("first_begin").alias("begin"), F.col("first_end").alias("end"), "n_words", F.col("component_id").alias("component")).distinct()
    same = ["doc_id", "first_doc_id", "removed", "begin", "end", "n_words", F.col("component_id").alias("component")]
    return _joined(grown.select(*same).unionByName(stay).unionByName(spans.filter("NOT removed").select(*same)), [])


def _joined(found: DataFrame, more: list[Column]) -> DataFrame:
    """Spans of overlapping rows of a document with the same fate and first document."""
    order = Window.partitionBy("doc_id", "first_doc_id", "removed").orderBy("begin", "end")
    spans = found.withColumn("new", F.when(F.col("begin") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)).withColumn("span", F.sum("new").over(order))
    return spans.groupBy("doc_id", "first_doc_id", "removed", "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.max("n_words").alias("n_words"), F.min("component").alias("component_id"), *more).drop("span")
