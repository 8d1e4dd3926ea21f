"""Pronunciation lexicons: which rules hold, and what they say about blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions.offsets import Claims, claim, find_all, struct_lists

#: Most rules that go along with every task; more are joined by a shuffle of the words.
BROADCAST_RULES = 200_000
#: Words of a block that are held together: a word, and the characters behind it that a literal can need.
WORD = r"\w+"


def effective_rules(rules: DataFrame) -> DataFrame:
    """Rules that hold, with their rank.

    A project's rule hides the global one with the same pattern and kind;
    otherwise the one seen first (``place``) holds.  They go by priority, then
    longer patterns first, then place.
    """
    same = Window.partitionBy("pattern", "is_regex").orderBy(F.when(F.col("scope") == "project", 0).otherwise(1), "place")
    first = Window.partitionBy("pattern", "is_regex")
    kept = rules.withColumn("n", F.row_number().over(same)).withColumn("place", F.min("place").over(first)).filter("n = 1").drop("n")
    return kept.withColumn("rank", F.row_number().over(Window.orderBy("priority", -F.length("pattern"), "place")))


#: rank, pattern, whether it is a regular expression, whether case counts, what is said, whether it applies by itself.
Rule = tuple[int, str, bool, bool, str, bool]
SAID = "array<struct<start:int,end:int,original:string,replacement:string,auto:boolean>>"
_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_())


def _low(text: str) -> str:
    """Lower case, letter by letter, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _inside(text: str, at: int) -> bool:
    """Whether a character of a word stands at a place."""
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


class Matcher:
    """All rules of a lexicon: literals in one automaton, which reads a text once however many they are, and regular expressions."""

    def __init__(self, rules: list[Rule]) -> None:
        self.automaton, self.regexes, self.rules = ahocorasick.Automaton(), [], {r[0]: r for r in rules}
        literals: dict[str, list[int]] = {}
        for rank, pattern, is_regex, case, _, _ in rules:
            if is_regex:
                try:
                    self.regexes.append((rank, re.compile(pattern, 0 if case else re.IGNORECASE)))
                except re.error:
                    continue
            elif pattern:
                literals.setdefault(_low(pattern), []).append(rank)
        for low, ranks in literals.items():
            self.automaton.add_word(low, (len(low), sorted(ranks)))
        if literals:
            self.automaton.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(rank, start, end) of whole words that literals name, and of what regular expressions find."""
        if len(self.automaton):
            for last, (length, ranks) in self.automaton.iter(_low(text)):
                start, end = last + 1 - length, last + 1
                if not _inside(text, start - 1) and not _inside(text, end):
                    yield from ((r, start, end) for r in ranks if not self.rules[r][3] or text[start:end] == self.rules[r][1])
        for rank, pattern in self.regexes:
            yield from ((rank, m.start(), m.end()) for m in pattern.finditer(text) if m.end() > m.start())

    def said(self, text: str) -> list[tuple]:
        """Hits that overlap none of a rule before, as rows of SAID."""
        kept = Claims()
        return [(start, end, text[start:end], *self.rules[rank][4:]) for rank, start, end in sorted(self.hits(text)) if kept.take(start, end)]


def matcher(ranked: DataFrame) -> Broadcast[Matcher] | None:
    """The rules (with their rank) as one automaton that goes along with every task; None if they are too many."""
    few = ranked.select("rank", "pattern", "is_regex", "case_sensitive", "spoken", "auto").limit(BROADCAST_RULES + 1).collect()
    return ranked.sparkSession.sparkContext.broadcast(Matcher([tuple(r) for r in few])) if len(few) <= BROADCAST_RULES else None


def _few(blocks: DataFrame, matcher: Broadcast[Matcher], text: str) -> DataFrame:
    """Suggestions of rules that go along with every task: one pass over each block, and no shuffle."""
    rest = [c for c in blocks.columns if c != text]

    def job(texts: pa.Array) -> pa.Array:
        said = matcher.value.said
        return struct_lists([said(t) if t else [] for t in texts.to_pylist()], ("start", "end", "original", "replacement", "auto"), _TYPES)

    return blocks.select(*rest, F.explode(F.arrow_udf(job, SAID)(F.col(text))).alias("s")).select(*rest, "s.*")


def _regex_hits(rules: list[tuple[int, str, bool]]):
    """A job for the hits of regular expressions; those that do not compile are left out."""
    compiled = []
    for rank, pattern, case in rules:
        try:
            compiled.append((rank, re.compile(pattern, 0 if case else re.IGNORECASE)))
        except re.error:
            continue

    def job(texts: pa.Array) -> pa.Array:
        rows = [[(rank, m.start(), m.end(), m[0]) for rank, p in compiled for m in p.finditer(t) if m.end() > m.start()] if t else [] for t in texts.to_pylist()]
        return struct_lists(rows, ("rank", "start", "end", "original"), (pa.int32(), pa.int32(), pa.int32(), pa.string()))

    return F.arrow_udf(job, "array<struct<rank:int,start:int,end:int,original:string>>")


def lexicon_suggestions(blocks: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """Non-overlapping hits of the rules, the first rule claiming its span.

    Literal rules match whole words; regular expressions are taken as they
    are.  Up to BROADCAST_RULES rules are one automaton that every task has;
    a larger lexicon is joined with the words of the blocks.  The block's
    other columns must tell blocks apart.
    """
    ranked = effective_rules(rules)
    few = matcher(ranked)
    return _many(blocks, ranked, text) if few is None else _few(blocks, few, text)


def _many(blocks: DataFrame, ranked: DataFrame, text: str) -> DataFrame:
    """Suggestions of a lexicon that is a table: the words of a block are joined with the first words of the literals, and what stands there is compared.

    Literals that begin with no word, and regular expressions, are looked for
    one by one.
    """
    rest = [c for c in blocks.columns if c != text]
    ranked = ranked.withColumn("first", F.when(~F.col("is_regex"), F.lower(F.regexp_extract("pattern", r"(?U)^\w+", 0))))
    literal = ranked.filter("first <> ''").select("rank", "pattern", "case_sensitive", "first")
    # What stands at a word is cut as long as the longest literal with that first word.
    longest = literal.groupBy("first").agg(F.max(F.length("pattern")).alias("longest"))
    escaped = F.concat(F.lit(r"(?<!\w)"), F.regexp_replace("pattern", r"([^\w\s])", r"\\$1"), F.lit(r"(?!\w)"))
    scanned = ranked.filter("first IS NULL OR first = ''").select("rank", F.when(F.col("is_regex"), F.col("pattern")).otherwise(escaped).alias("pattern"), "case_sensitive").orderBy("rank")
    words = blocks.select(*rest, F.col(text).alias("__text"), F.explode(find_all(F.col(text), WORD)).alias("__word"))
    words = words.select(*rest, "__text", F.col("__word.start").alias("start"), F.lower("__word.match").alias("first")).join(longest, "first")
    words = words.select(*rest, "start", "first", F.expr("substring(__text, start + 1, longest + 1)").alias("there"))
    met = words.join(literal, "first")
    found, behind = F.expr("substring(there, 1, length(pattern))"), F.expr("substring(there, length(pattern) + 1, 1)")
    equal = F.when(F.col("case_sensitive"), found == F.col("pattern")).otherwise(F.lower(found) == F.lower("pattern")) & ~behind.rlike(r"(?U)\w")
    hits = met.filter(equal).select(*rest, F.struct("rank", "start", (F.col("start") + F.length("pattern")).alias("end"), found.alias("original")).alias("hit"))
    if slow := [tuple(r) for r in scanned.collect()]:  # regular expressions are written by hand
        hits = hits.unionByName(blocks.select(*rest, F.explode(_regex_hits(slow)(F.col(text))).alias("hit")))
    listed = hits.groupBy(*rest).agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    kept = listed.select(*rest, F.explode(claim(F.col("hits"))).alias("hit"))
    said = ranked.select("rank", F.col("spoken").alias("replacement"), "auto")
    rows = kept.select(*rest, "hit.rank", "hit.start", "hit.end", "hit.original").join(said, "rank")
    return rows.select(*rest, "start", "end", "original", "replacement", "auto")
