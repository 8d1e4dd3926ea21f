"""Spelling variants: words one edit apart, grouped under their commonest form.

Pairs are found by asymmetric q-chunks.  The shorter word of a pair (either
one, if both are as long) contributes disjoint chunks, the other one its grams
at the places where those chunks can lie: one edit moves what follows it by one
place at most and spares every chunk that it does not touch.  So of two chunks
one is preserved, and pairs meet on it, then are verified.

A chunk that many words share is no use as a key by itself.  The edit then lies
in the other chunk, which is cut in two again, and one of its halves is
preserved as well.  The keys here begin with that second cut: a word in four
blocks, of which the edit touches one and the other three are preserved.  Only
keys that more than ``MANY`` words share are cut further, block by block, down
to single letters, where no more words can share a key than letters allow.  No
list of words with a common key is ever paired while it is long, and no pair is
lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.graph import small
from narrata.llm.scratch import cut

#: Blocks of a word before any is cut again.
BLOCKS = 4
#: Most rows of a key that are paired; keys with more are cut again.
MANY = 48
#: Words a task counts before it hands them on.
KEEP = 100_000
#: Bytes of text read at once.
PIECE = 1 << 20

#: Runs of A-Z, a-z and U+00C0 to U+00FF, in UTF-8 lower-cased for ASCII.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 7, least: int = 2, slip: int | None = None) -> DataFrame:
    """(word, n): words of at least ``length`` letters that occur at least ``least`` times in all texts.

    A word is a maximal run of the letters A-Z, a-z and U+00C0 to U+00FF with
    A-Z in lower case.  With ``slip``, words lose a letter as typists do: let h
    be the crc32 of ``<key>:<word>``; if ``slip`` divides h, the letter at
    h % length goes (from 0).  That plants variants whose origin is known.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                if not t.is_valid:
                    continue
                prefix = zlib.crc32(b"%s:" % (str(k.as_py()).encode() if k.is_valid else b""))
                for piece in _pieces(t.as_buffer()):
                    _count(piece, seen, prefix, length, slip)
                    if len(seen) >= KEEP:
                        yield _counted(seen)
                        seen = Counter()
        if seen:
            yield _counted(seen)

    counted = docs.select(key, text).mapInArrow(job, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _pieces(text: pa.Buffer) -> Iterator[bytes]:
    """A text's bytes in pieces that end between words."""
    view, at, n = memoryview(text), 0, len(text)
    while at < n:
        to = min(n, at + PIECE)
        while to < n and (97 <= (view[to] | 32) <= 122 or view[to] >= 128):
            to += 1
        yield bytes(view[at:to]).lower()
        at = to


def _count(data: bytes, seen: Counter[bytes], prefix: int, length: int, slip: int | None) -> None:
    # A word of so many letters has as many bytes at least.
    for run, n in Counter(r for r in _RUN.findall(data) if len(r) >= length).items():
        if slip:
            h = zlib.crc32(run, prefix)
            if h % slip == 0:
                word = run.decode()
                at = h % len(word)
                run = (word[:at] + word[at + 1 :]).encode()
        if len(run) >= length and (run.isascii() or len(run.decode()) >= length):
            seen[run] += n


def _counted(seen: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def _cut(longer: Column, blocks: int, block: Column) -> tuple[Column, Column]:
    """Where a block begins, and how many letters follow it, in the shorter word of a pair."""
    length = F.length("word") - longer.cast("int")
    start = F.floor(length * block / blocks).cast("int")
    return start, length - F.floor(length * (block + 1) / blocks).cast("int")


def _keyed(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows (word, n, longer, block) with the key of all that the block leaves over.

    ``longer`` rows are the grams that a word has in common with words one letter shorter.
    """
    start, after = _cut(F.col("longer"), blocks, F.col("block"))
    length = F.length("word")
    rest = F.concat_ws("|", F.substring("word", F.lit(1), start), F.substring("word", length - after + 1, after))
    key = F.xxhash64(length - F.col("longer").cast("int"), F.lit(blocks), F.col("block"), start, rest)
    return rows.withColumn("key", key)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): all pairs of words one edit apart, each pair once.

    ``words`` has (word, n), every word once; an edit inserts, deletes or
    replaces one code point.
    """
    roles = F.explode(F.array(F.lit(False), F.lit(True)))
    rows = words.select("word", "n", roles.alias("longer")).withColumn("block", F.explode(F.array(*[F.lit(k) for k in range(BLOCKS)])))
    blocks, found = BLOCKS, None
    while True:
        rows = cut(_keyed(rows, blocks), "chunks")
        # A key is cut again while its block has several letters.
        splits = rows.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.length("word")).alias("length")).filter((F.col("rows") > MANY) & (F.col("length") > blocks))
        crowded = cut(splits.select("key"), "crowded")
        paired = cut(_verified(rows.join(small(crowded), "key", "left_anti")), "pairs")
        found = paired if found is None else found.unionByName(paired)
        if crowded.isEmpty():
            # A pair whose edit lies between two blocks meets in both.
            return found.dropDuplicates(["a", "b"])
        halves = F.explode(F.array(2 * F.col("block"), 2 * F.col("block") + 1))
        rows = rows.join(small(crowded), "key").select("word", "n", "longer", halves.alias("block"))
        blocks *= 2


def _verified(rows: DataFrame) -> DataFrame:
    """Pairs of rows with one key that are one edit apart; the first is the shorter word, or the smaller one."""
    x = rows.filter("NOT longer").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    y = rows.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("nb"))
    once = (F.col("longer") & (F.length("b") == F.length("a") + 1)) | (~F.col("longer") & (F.length("b") == F.length("a")) & (F.col("a") < F.col("b")))
    return x.join(y, "key").filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of (word, n).

    ``n_near`` counts the words one edit apart.  ``form`` is the commonest of
    them (of equally common ones the smallest in code-point order), if it is at
    least ``ratio`` times as common as the word; else null, and so is
    ``form_n``.  ``root`` is where the forms lead to in the end, the word
    itself without one.  An empty table gives an empty one.
    """
    words = cut(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n"))
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    common = -F.col("best.less") >= ratio * F.col("n")
    near = cut(near.select("word", "n_near", F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")), "near")
    out = words.join(near, "word", "left").join(_roots(near.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """Follow (word, root) to the end; the steps double, and counts that grow tenfold a step keep chains short."""
    links = cut(links, "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        longer = cut(links.join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")), "forms")
        links = longer.drop("__moved")
        if longer.filter("__moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 7, least: int = 2, ratio: int = 10, slip: int | None = None) -> DataFrame:
    """The variants of all words of ``docs``; see ``count_words`` and ``variants``.

    Edge cases: null and empty texts have no words; a null key is the empty
    string where keys matter (``slip``); rows that come again count again;
    texts of any length are read in pieces; words in other scripts end where
    their letters are not those of the runs; other columns are not read; an
    empty table, or one without words, gives an empty one.
    """
    return variants(count_words(docs, key, text, length, least, slip), ratio)
