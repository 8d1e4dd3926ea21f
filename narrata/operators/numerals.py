"""Numbers in text: where they stand and how a Polish narrator says them.

One Arrow function per block finds the numbers of six kinds under one claim,
and says them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions import number_words as N
from narrata.functions.offsets import Claims, struct_lists

# Fixed values. Words that make a number behind them a heading, inflected nouns that tell a gender, and words behind a quantity.
HEADINGS = {
    "m": "rozdział rozdzial tom akt wiek punkt wstęp wstep chapter".split(),
    "f": "część czesc księga ksiega scena klasa grupa".split(),
}
NOUNS = {
    "m": "rozdziału rozdziale rozdziałem tomu tomie wieku punktu punkcie wstępu wstępie".split(),
    "f": "części czesci księgi ksiegi księdze księgę sceny scenie scenę klasy klasie grupy grupie godzina godziny godzinie godzinę sekcja sekcji".split(),
    "n": "piętro pietro piętra pietra piętrze pietrze piętrem piętr".split(),
}
QUANTITIES = frozenset(
    "zł zl pln km cm mm kg szt osób osoby razy procent metrów metr m stron strony egzemplarzy egzemplarze dolarów euro lat lata dni godzin".split()
)
GENDERS = {word: g for table in (HEADINGS, NOUNS) for g, listed in table.items() for word in listed}
# Fixed values. What the numbers look like, and what may stand between a number and its neighbouring word.
# They begin with their first character and look behind it then, so that a search goes from one such character to the next.
BEHIND = r"(?:(?=[\s.:;,_„«\"'“(\-—–]*([^\W\d_]+))|)"
BEFORE = re.compile(r"([^\W\d_]+)[\s.:;,_»\"'”)\-—–]*\Z")
HEADING = re.compile(r"(?i)(?<!\w)(" + "|".join(sorted((w for t in HEADINGS.values() for w in t), key=len, reverse=True)) + r")[ \t]+(\d{1,4}|[IVXLCDM]{1,12})(?!\w)")
LONGEST = max(map(len, (w for t in HEADINGS.values() for w in t)))
CLOCK = re.compile(r"(\d(?<!\w\d)\d?):(\d{2})(?![:\w])")
DECIMAL = re.compile(r"(\d(?<!\w\d)\d*),(\d+)(?!\w)")
ROMAN = re.compile(r"([IVXLCDM](?<!\w[IVXLCDM])[IVXLCDM]{0,14})(?!\w)" + BEHIND)
DOTTED = re.compile(r"(\d(?<!\w\d)\d{0,5})\.(?!\d)" + BEHIND)
INTEGER = re.compile(r"(\d(?<!\w\d)(?:\d{0,2}(?:[ \u00a0]\d{3})+|\d{0,11}))(?!\w)" + BEHIND)
CANONICAL = re.compile(r"(?=.)M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})")
DIGITS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
#: What every number holds: a digit, or a word of Roman digits; and what every heading ends with.
DIGIT = re.compile(r"\d")
ROMAN_WORD = re.compile(r"[IVXLCDM](?<!\w[IVXLCDM])[IVXLCDM]{0,14}(?!\w)")
BEHIND_HEADING = re.compile(r"[ \t](?:\d{1,4}|[IVXLCDM]{1,12})(?!\w)")
#: Characters looked at for the word before a number.
NEAR = 200

FOUND = "array<struct<start:int,end:int,kind:string,original:string,replacement:string,reason:string,confidence:double>>"
FIELDS = ("start", "end", "kind", "original", "replacement", "reason", "confidence")
TYPES = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())
Read = tuple[str, str, str, float]


def roman(token: str) -> int | None:
    """Value of a canonical Roman numeral."""
    if not CANONICAL.fullmatch(token):
        return None
    values = [DIGITS[c] for c in token]
    return sum(-v if v < max(values[k:]) else v for k, v in enumerate(values))


def _gender(word: str | None) -> str | None:
    return GENDERS.get(word.casefold()) if word else None


def _alone(text: str, token: str) -> bool:
    return text.strip() in (token, f"{token}.")


# A reader gives (words, kind, reason, confidence) of a match, or None if it is no such number.
def _heading(m: re.Match, text: str, heading: bool) -> Read | None:
    number = int(m[2]) if m[2].isdigit() else roman(m[2])
    if number is None:
        return None
    first = not text[: m.start()].strip()
    return f"{m[1]} {N.ordinal(number, GENDERS[m[1].casefold()])}", "ordinal_heading" if heading or first else "numeral", "heading_ordinal", 0.93


def _clock(m: re.Match, text: str, heading: bool) -> Read | None:
    hour, minute = int(m[1]), int(m[2])
    return (N.clock(hour, minute), "numeral", "clock", 0.96) if hour < 24 and minute < 60 else None


def _decimal(m: re.Match, text: str, heading: bool) -> Read | None:
    return (N.decimal(int(m[1]), m[2]), "numeral", "decimal", 0.95) if len(m[1].lstrip("0")) <= 12 else None


def _roman(m: re.Match, text: str, heading: bool) -> Read | None:
    number = roman(m[1])
    if number is None:
        return None
    before = BEFORE.search(text, max(0, m.start() - NEAR), m.start())
    gender = _gender(m[2]) or _gender(before and before[1])
    alone, first = _alone(text, m[1]), not text[: m.start()].strip()
    said = N.ordinal(number, gender or "m")
    if (heading and (alone or first)) or (alone and len(m[1]) > 1):
        return said, "ordinal_heading", "heading_ordinal", 0.9
    # One or two letters may be a word; a noun tells that they are a number.
    return (said, "numeral", "roman", 0.86) if gender or len(m[1]) > 2 else None


def _dotted(m: re.Match, text: str, heading: bool) -> Read | None:
    last = not text[m.end() :].strip()
    gender = _gender(m[2])
    # The dot ends a sentence if nothing follows a number inside a text, or a capital does.
    if (last and text[: m.start()].strip()) or (not last and m[2] and not gender and m[2][0].isupper()):
        return None
    named = heading and _alone(text, m[0])
    return N.ordinal(int(m[1]), "m" if last else gender or "m"), *(("ordinal_heading", "heading_ordinal", 0.9) if named else ("numeral", "ordinal", 0.88))


def _integer(m: re.Match, text: str, heading: bool) -> Read | None:
    number, single = int(re.sub("[ \u00a0]", "", m[1])), m[1].isdigit()
    if number >= 10**12:
        return None
    if single and heading and number < 10**6 and _alone(text, m[1]):
        return N.ordinal(number), "ordinal_heading", "heading_ordinal", 0.93
    if single and 1000 <= number <= 2099 and (m[2] or "").casefold() not in QUANTITIES:
        return N.ordinal(number), "numeral", "year", 0.9
    return N.cardinal(number), "numeral", "cardinal", 0.95


class Headings:
    """Matches of HEADING, each looked for from its number: the word before that must begin it."""

    def finditer(self, text: str) -> Iterator[re.Match]:
        for m in BEHIND_HEADING.finditer(text):
            end = m.start()
            while end > 0 and text[end - 1] in " \t":
                end -= 1
            start = end
            while start > 0 and end - start <= LONGEST and (text[start - 1].isalnum() or text[start - 1] == "_"):
                start -= 1
            if start < end and (found := HEADING.match(text, start)):
                yield found


Reader = tuple[object, Callable[[re.Match, str, bool], Read | None]]
#: The kinds, in the order in which they claim.
PASSES: dict[str, Reader] = {
    "headings": (Headings(), _heading), "clocks": (CLOCK, _clock), "decimals": (DECIMAL, _decimal),
    "romans": (ROMAN, _roman), "dotted": (DOTTED, _dotted), "integers": (INTEGER, _integer),
}


def find(text: str | None, heading: bool | None = False, passes: Iterable[str] = tuple(PASSES)) -> list[tuple]:
    """(start, end, kind, original, words, reason, confidence) of a block's numbers: an earlier pass before those that overlap it."""
    kept, out = Claims(), []
    if not text:
        return out
    digits, romans = DIGIT.search(text) is not None, ROMAN_WORD.search(text) is not None
    if not digits and not romans:
        return out
    for pattern, read in (PASSES[p] for p in passes if p == "headings" or (romans if p == "romans" else digits)):
        for m in pattern.finditer(text):
            if (found := read(m, text, bool(heading))) and kept.take(m.start(), m.end()):
                words, kind, reason, confidence = found
                out.append((m.start(), m.end(), kind, m[0], words, reason, confidence))
    return sorted(out, key=lambda s: (s[0], s[1], s[5]))


def numbers(passes: Iterable[str] = tuple(PASSES)):
    """A function of the columns (text, is it a heading): the numbers of each block."""

    def job(texts: pa.Array, headings: pa.Array) -> pa.Array:
        return struct_lists([find(t, h, passes) for t, h in zip(texts.to_pylist(), headings.to_pylist(), strict=True)], FIELDS, TYPES)

    return F.arrow_udf(job, FOUND)


def numeral_suggestions(blocks: DataFrame, passes: Iterable[str] = tuple(PASSES), text: str = "text", heading: str | None = None) -> DataFrame:
    """One row per number: the block's other columns, start, end, kind, original, replacement, reason, confidence.

    ``heading`` names a boolean column that tells headings.  Null and empty
    blocks have none; nothing is shuffled.
    """
    rest = [c for c in blocks.columns if c != text]
    found = blocks.select(*rest, F.explode(numbers(passes)(F.col(text), F.col(heading) if heading else F.lit(False))).alias("s"))
    return found.select(*rest, "s.*")
