"""Detectors: block text in, suggestions out; the text itself never changes.

Each detector is a column, an array of suggestions of one block, so any
number of them read a block in one scan without a shuffle.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import word_lists as W
from narrata.functions.offsets import Claims, Pass, claimed, find_all, find_claimed, let, struct_lists

SUGGESTION = "struct<step:int,start:int,end:int,kind:string,original:string,replacement:string,reason:string,confidence:double>"
SUGGESTIONS = f"array<{SUGGESTION}>"
FIELDS = ("step", "start", "end", "kind", "original", "replacement", "reason", "confidence")
TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())

LETTER = r"[^\W\d_]"
# Fixed values. What conversion artefacts, acronyms, words and English spelling look like.
HYPHEN_BREAK = rf"(?<!{LETTER}){LETTER}+{W.SOFT}?(?:-|{W.SOFT})\r?\n{LETTER}+"
SOFT_WORD = rf"(?<!{LETTER}){LETTER}*(?:{W.SOFT}{LETTER}*)+"
SPACE_RUN = f"[{W.SPACES}]{{2,}}"
DASH = f"[{W.TO_DASH}{W.TO_HYPHEN}]"
ACRONYM = r"(?<![A-Za-z])[A-Z]{2,5}(?![A-Za-z])"
WORD = r"[A-Za-zÀ-ž]+(?:['’-][A-Za-zÀ-ž]+)*"
ENGLISH = r"th|wh|qu|ck|oo|ee|(?:ing|tion|ness)$"


def toponym_pattern(surface: str) -> str:
    return r"(?i)(?<!\w)" + r"\s+".join(re.escape(p) for p in surface.split()) + r"(?!\w)"


def suggest(hits: Column, step: int, kind: str, reason: Column | str, replacement, confidence) -> Column:
    """Suggestions from matches; ``replacement`` and ``confidence`` may depend on the match."""
    value = lambda x, h: x(h["match"]) if callable(x) else F.lit(x)
    return F.transform(
        hits,
        lambda h: F.struct(
            F.lit(step).alias("step"), h["start"].alias("start"), h["end"].alias("end"), F.lit(kind).alias("kind"), h["match"].alias("original"),
            value(replacement, h).alias("replacement"), value(reason, h).alias("reason"), value(confidence, h).cast("double").alias("confidence"),
        ),
    ).cast(SUGGESTIONS)


def _joined(match: Column) -> Column:
    return F.regexp_replace(match, f"[-{W.SOFT}\r\n]", "")


def _unhyphened(match: Column) -> Column:
    return F.replace(match, F.lit(W.SOFT), F.lit(""))


def _folded(match: Column) -> Column:
    return F.translate(match, W.TO_DASH + W.TO_HYPHEN, W.EM_DASH * len(W.TO_DASH) + "-" * len(W.TO_HYPHEN))


class Needing:
    """Matches of a pattern; a text without what each of them holds, in any case, is not searched."""

    def __init__(self, pattern: str, needed: str) -> None:
        self.pattern, self.needed = re.compile(pattern), needed.casefold()

    def finditer(self, text: str) -> Iterator[re.Match]:
        """Of a text that holds what is needed; ``claimed`` looks for that."""
        return self.pattern.finditer(text)


#: Pattern, reason, replacement and confidence of the normalising passes, in their order.
NORMAL = (
    (Needing(HYPHEN_BREAK, "\n"), "hyphenation", _joined, 0.95),
    (Needing(SOFT_WORD, W.SOFT), "soft_hyphen", _unhyphened, 0.99),
    (SPACE_RUN, "whitespace", lambda m: F.lit(" "), 0.99),
    (DASH, "dash", _folded, 0.9),
)


def _normal(k: int):
    pattern, reason, replacement, confidence = NORMAL[k]
    return lambda text: suggest(find_claimed(text, [(pattern, None)]), k, "conversion_artifact", reason, replacement, confidence)


hyphen_breaks, soft_hyphens, space_runs, dashes = map(_normal, range(len(NORMAL)))


def _ranges(codes: list[int]) -> str:
    """A character class of code points."""
    edges = [c for k, c in enumerate(codes) if k == 0 or codes[k - 1] != c - 1], [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(*edges, strict=True)) + "]"


class Unnormal:
    """Finds runs of characters that composition may change; a text that is composed, as most are, is not searched."""

    def finditer(self, text: str) -> Iterator[re.Match]:
        return iter(()) if unicodedata.is_normalized("NFC", text) else _unnormal().finditer(text)


@cache
def _unnormal() -> re.Pattern:
    """Characters with marks behind them, and those that stand for others."""
    every = [c for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4]
    marks = _ranges([c for c in every if unicodedata.combining(chr(c)) or 0x1161 <= c < 0x1176 or 0x11A8 <= c < 0x11C3])
    other = _ranges([c for c in every if not unicodedata.is_normalized("NFC", chr(c))])
    return re.compile(f"(?:.?{marks}+|{other})+")


def _nfc(match: str) -> str:
    return unicodedata.normalize("NFC", match)


def _changes(match: str) -> bool:
    return _nfc(match) != match


def decomposed(text: Column) -> Column:
    """Characters that are not composed (NFC), in runs."""
    hits = find_claimed(text, [(Unnormal(), _changes)], lambda _, m: _nfc(m))
    return F.transform(
        hits,
        lambda h: F.struct(
            F.lit(4).alias("step"), h["start"].alias("start"), h["end"].alias("end"), F.lit("conversion_artifact").alias("kind"), h["match"].alias("original"), h["said"].alias("replacement"),
            F.lit("nfc").alias("reason"), F.lit(0.99).alias("confidence"),
        ),
    ).cast(SUGGESTIONS)


def _column(text: Column, find: Callable[[str], list[tuple]]) -> Column:
    """SUGGESTIONS of a text from a function that gives their rows with the step in front; nothing is left for expressions to do."""

    def job(texts: pa.Array) -> pa.Array:
        return struct_lists([find(t) if t else [] for t in texts.to_pylist()], FIELDS, TYPES)

    return F.arrow_udf(job, SUGGESTIONS)(text)


def normalization(text: Column) -> Column:
    """Breaks, soft hyphens, space runs, dashes and decomposed characters under one claim, in that order."""
    return _column(text, lambda t: [(step, start, end, "conversion_artifact", match, _NORMAL[step][0](match), *_NORMAL[step][1:]) for step, start, end, match in claimed(t, _PASSES)])


def spell(token: Column) -> Column:
    """Letter names of a token of ASCII capitals."""
    names = F.create_map(*[F.lit(x) for pair in W.LETTER_NAMES.items() for x in pair])
    return F.array_join(F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.try_element_at(names, c)), " ")


def respell(token: Column) -> Column:
    """An English word in Polish spelling; a capital initial stays."""
    spoken = F.lower(token)
    for source, target in W.RESPELLINGS:
        spoken = F.replace(spoken, F.lit(source), F.lit(target))
    first = F.substring(token, 1, 1)
    capital = (first != F.lower(first)) & (first == F.upper(first))
    own = F.try_element_at(F.create_map(*[F.lit(x) for pair in W.SPOKEN_WORDS.items() for x in pair]), F.lower(token))
    return let(spoken, lambda s: F.coalesce(own, F.when(capital, F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))).otherwise(s)))


@lru_cache(1 << 16)
def said_foreign(token: str) -> str:
    """As ``respell`` says it, for words found in Arrow functions."""
    low = token.lower()
    spoken = low
    for source, target in W.RESPELLINGS:
        spoken = spoken.replace(source, target)
    first = token[:1]
    return W.SPOKEN_WORDS.get(low) or (spoken[:1].upper() + spoken[1:] if first != first.lower() and first == first.upper() else spoken)


@lru_cache(1 << 16)
def said_acronym(token: str) -> str:
    return " ".join(W.LETTER_NAMES[c] for c in token)


@lru_cache(1 << 16)
def is_acronym(word: str) -> bool:
    return word not in W.NOT_ACRONYMS and word.lower() not in W.ENGLISH_WORDS


def is_foreign(word: str) -> bool:
    """Listed English words and words of English spelling, without Polish letters, of 3 letters or more."""
    low = word.lower()
    return len(word) >= 3 and not any(c in W.POLISH_LETTERS for c in word) and (low in W.ENGLISH_WORDS or re.search(ENGLISH, low) is not None)


_WORD = re.compile(WORD)
#: Place names and acronyms, in the order in which they claim.
_NAMES = [(Needing(toponym_pattern(s), s.split()[0]), None) for s, _ in W.TOPONYMS] + [(re.compile(ACRONYM), is_acronym)]


@lru_cache(1 << 18)
def _foreign(word: str) -> tuple[str, str, str, str, float] | None:
    """Kind, original, replacement, reason and confidence of a foreign word."""
    if not is_foreign(word):
        return None
    said, low = said_foreign(word), word.lower()
    return "foreign_word", word, said, "english_word" if low in W.ENGLISH_WORDS else "english_orthography", 0.8 if said.lower() != low else 0.62


def _foreign_rows(text: str) -> list[tuple]:
    out, at, find = [], 0, text.find
    for word in _WORD.findall(text):
        start = find(word, at)
        at = start + len(word)
        if told := _foreign(word):
            out.append((start, at, *told))
    return out


def lexical_rows(text: str) -> list[tuple]:
    """(start, end, kind, original, replacement, reason, confidence) of what ``lexical`` finds in a text."""
    return [r[1:] for r in _lexical_rows(text, _NAMES, len(W.TOPONYMS), True)]


def _lexical_rows(text: str, passes: list[Pass], places: int, foreign: bool) -> list[tuple]:
    """Rows of SUGGESTIONS: place names, which are the first passes, acronyms, and foreign words that overlap none of them."""
    kept = Claims()
    names = claimed(text, passes, kept)
    rows = [(step, a, b, "toponym", m, W.TOPONYMS[step][1], "toponym", 0.92) if step < places else (10, a, b, "acronym", m, said_acronym(m), "acronym", 0.86) for step, a, b, m in names]
    return rows + [(20, *r) for r in kept.apart(_foreign_rows(text))] if foreign else rows


_PASSES = [*((re.compile(p) if isinstance(p, str) else p, None) for p, *_ in NORMAL), (Unnormal(), _changes)]
_FOLDS = str.maketrans(W.TO_DASH + W.TO_HYPHEN, W.EM_DASH * len(W.TO_DASH) + "-" * len(W.TO_HYPHEN))
_JOINTS = re.compile(f"[-{W.SOFT}\r\n]")
#: What each pass of ``normalization`` puts in place of a match, its reason and its confidence.
_NORMAL = tuple(
    (put, reason, confidence)
    for put, (reason, confidence) in zip(
        (lambda m: _JOINTS.sub("", m), lambda m: m.replace(W.SOFT, ""), lambda m: " ", lambda m: m.translate(_FOLDS), _nfc),
        [*((reason, confidence) for _, reason, _, confidence in NORMAL), ("nfc", 0.99)],
        strict=True,
    )
)


def normal_rows(text: str) -> list[tuple]:
    """(start, end, kind, original, replacement, reason, confidence) of what ``normalization`` finds in a text."""
    return [(start, end, "conversion_artifact", match, _NORMAL[step][0](match), *_NORMAL[step][1:]) for step, start, end, match in claimed(text, _PASSES)]


def _lexical(text: Column, toponyms: bool = False, acronyms: bool = False, foreign: bool = False) -> Column:
    """Place names, longer ones first, before acronyms before foreign words, under one claim."""
    places = len(W.TOPONYMS) if toponyms else 0
    passes = _NAMES[:places] + _NAMES[len(W.TOPONYMS) :] * acronyms
    return _column(text, lambda t: _lexical_rows(t, passes, places, foreign))


def toponyms(text: Column) -> Column:
    """Place names, longer ones first, in any case, with any white space between their words."""
    return _lexical(text, toponyms=True)


def acronyms(text: Column) -> Column:
    """Two to five capitals that are no known word."""
    return _lexical(text, acronyms=True)


def foreign_words(text: Column) -> Column:
    return _lexical(text, foreign=True)


def names(text: Column) -> Column:
    """Place names before acronyms, under one claim."""
    return _lexical(text, toponyms=True, acronyms=True)


def lexical(text: Column) -> Column:
    """Place names before acronyms before foreign words, under one claim."""
    return _lexical(text, toponyms=True, acronyms=True, foreign=True)


def suggestions(blocks: DataFrame, detector, text: str = "text") -> DataFrame:
    """One row per suggestion: the block's other columns and the suggestion's fields.

    Null and empty blocks have none; nothing is shuffled.
    """
    rest = [c for c in blocks.columns if c != text]
    found = blocks.select(*rest, F.explode(detector(F.col(text))).alias("s"))
    return found.select(*rest, *[F.col(f"s.{c}").alias(c) for c in ("start", "end", "kind", "original", "replacement", "reason", "confidence")])
