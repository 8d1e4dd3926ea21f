"""Polish number words as columns: cardinals, ordinals, clock times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Words for 0 to 19, tens and hundreds; masculine ordinals of the same; forms of the scales.
UNITS = (
    "zero jeden dwa trzy cztery pięć sześć siedem osiem dziewięć dziesięć jedenaście dwanaście trzynaście czternaście piętnaście szesnaście "
    "siedemnaście osiemnaście dziewiętnaście"
).split()
TENS = "dwadzieścia trzydzieści czterdzieści pięćdziesiąt sześćdziesiąt siedemdziesiąt osiemdziesiąt dziewięćdziesiąt".split()
HUNDREDS = "sto dwieście trzysta czterysta pięćset sześćset siedemset osiemset dziewięćset".split()
ORDINAL_UNITS = (
    "zerowy pierwszy drugi trzeci czwarty piąty szósty siódmy ósmy dziewiąty dziesiąty jedenasty dwunasty trzynasty czternasty piętnasty szesnasty "
    "siedemnasty osiemnasty dziewiętnasty"
).split()
ORDINAL_TENS = "dwudziesty trzydziesty czterdziesty pięćdziesiąty sześćdziesiąty siedemdziesiąty osiemdziesiąty dziewięćdziesiąty".split()
ORDINAL_HUNDREDS = "setny dwusetny trzechsetny czterechsetny pięćsetny sześćsetny siedemsetny osiemsetny dziewięćsetny".split()
# Fixed values. Stems before "tysięczny", of units from 0, tens and hundreds from 1, and the fractions of one to three places.
UNIT_STEMS = (
    " jedno dwu trzy cztero pięcio sześcio siedmio ośmio dziewięcio dziesięcio jedenasto dwunasto trzynasto czternasto piętnasto szesnasto "
    "siedemnasto osiemnasto dziewiętnasto"
).split(" ")
TENS_STEMS = "dziesięcio dwudziesto trzydziesto czterdziesto pięćdziesięcio sześćdziesięcio siedemdziesięcio osiemdziesięcio dziewięćdziesięcio".split()
HUNDREDS_STEMS = "stu dwustu trzystu czterystu pięćset sześćset siedemset osiemset dziewięćset".split()
FRACTIONS = (("dziesiąta", "dziesiąte", "dziesiątych"), ("setna", "setne", "setnych"), ("tysięczna", "tysięczne", "tysięcznych"))
SCALES = ((10**9, "miliard", "miliardy", "miliardów"), (10**6, "milion", "miliony", "milionów"), (10**3, "tysiąc", "tysiące", "tysięcy"))


def _pick(words: list[str], place: Column) -> Column:
    """Word number ``place`` from 1 on; null outside."""
    return F.when((place >= 1) & (place <= len(words)), F.element_at(F.array(*map(F.lit, words)), F.greatest(place, F.lit(1)).cast("int")))


def _whole(n: Column, by: int) -> Column:
    return F.floor(n / by)


def _below_thousand(n: Column) -> Column:
    """Words of 1 to 999 as an array with nulls for absent parts."""
    rest = n % 100
    unit = F.when(rest < 20, rest).otherwise(rest % 10)
    return F.array(_pick(HUNDREDS, _whole(n, 100)), _pick(TENS, F.when(rest >= 20, _whole(rest, 10) - 1).otherwise(0)), _pick(UNITS, F.when(unit > 0, unit + 1).otherwise(0)))


def _said(*parts: Column) -> Column:
    return F.array_join(F.filter(F.concat(*parts), lambda w: w.isNotNull()), " ")


def _noun(n: Column, one: str, few: str, many: str) -> Column:
    regular = ~(n % 100).between(10, 20)
    return F.when(regular & (n % 10 == 1), one).when(regular & (n % 10).isin(2, 3, 4), few).otherwise(many)


def _scaled(n: Column) -> list[Column]:
    parts = []
    for scale, one, few, many in SCALES:
        count = _whole(n, scale) % 1000
        words = F.when(count > 1, _below_thousand(count)).otherwise(F.array().cast("array<string>"))
        parts.append(F.concat(words, F.array(F.when(count == 1, one).when(count > 1, _noun(count, one, few, many)))))
    return parts


def cardinal(n: Column) -> Column:
    """Nominative cardinal of 0 to 10**12 - 1, else null."""
    n = n.cast("long")
    return F.when((n >= 0) & (n < 10**12), F.when(n == 0, UNITS[0]).otherwise(_said(*_scaled(n), _below_thousand(n % 1000))))


def cardinal_feminine(n: Column) -> Column:
    """Cardinal with the feminine forms of one and two at its end."""
    said = cardinal(n)
    return F.when((n % 10 == 1) & (n % 100 != 11), F.regexp_replace(said, "jeden$", "jedna")).when((n % 10 == 2) & (n % 100 != 12), F.regexp_replace(said, "(^| )dwa$", "$1dwie")).otherwise(said)


def inflect(word: Column, gender: str) -> Column:
    """A masculine ordinal in gender m, f or n."""
    if gender == "m":
        return word
    end = {"f": "a", "n": "e"}[gender]
    if gender == "f":
        return F.when(word == "drugi", "druga").when(word == "trzeci", "trzecia").otherwise(F.regexp_replace(word, "y$", end))
    return F.when(word.rlike("i$"), F.concat(word, F.lit(end))).otherwise(F.regexp_replace(word, "y$", end))


def _stem(n: Column) -> Column:
    """What stands before "tysięczny" for 1 to 999 thousands; nothing for one."""
    low = n % 100
    unit = F.when(low < 20, low).otherwise(low % 10)
    parts = (_pick(HUNDREDS_STEMS, _whole(n, 100)), _pick(TENS_STEMS, F.when(low >= 20, _whole(low, 10)).otherwise(0)), _pick(UNIT_STEMS, unit + 1))
    return F.when(n == 1, "").otherwise(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))


def ordinal(n: Column, gender: str = "m") -> Column:
    """Nominative ordinal of 0 to 999,999, else null; only tens and units inflect, or the last part."""
    n = n.cast("long")
    rest, low = n % 1000, n % 100
    unit = F.when(low < 20, low).otherwise(low % 10)
    hundreds = F.when(low == 0, inflect(_pick(ORDINAL_HUNDREDS, _whole(rest, 100)), gender)).otherwise(_pick(HUNDREDS, _whole(rest, 100)))
    tens = inflect(_pick(ORDINAL_TENS, F.when(low >= 20, _whole(low, 10) - 1).otherwise(0)), gender)
    units = inflect(_pick(ORDINAL_UNITS, F.when(unit > 0, unit + 1).otherwise(0)), gender)
    exact = F.concat(_stem(_whole(n, 1000)), inflect(F.lit("tysięczny"), gender))
    known = (n >= 0) & (n < 10**6)
    return F.when(n == 0, inflect(F.lit(ORDINAL_UNITS[0]), gender)).when(known & (rest == 0), exact).when(known, _said(*_scaled(n), F.array(hundreds, tens, units)))


def ordinal_of(n: Column, gender: Column) -> Column:
    """Ordinal in the gender that a column names; masculine if it names none."""
    return F.when(gender == "f", ordinal(n, "f")).when(gender == "n", ordinal(n, "n")).otherwise(ordinal(n))


def decimal(whole: Column, digits: Column) -> Column:
    """A decimal fraction: up to three places by their name, more of them digit by digit; null without digits."""
    places, part = F.length(digits), F.expr("0") + F.when(F.length(digits) <= 3, digits).otherwise("0").cast("long")
    form = F.when((part % 10 == 1) & (part % 100 != 11), 0).when((part % 10).isin(2, 3, 4) & ~(part % 100).isin(12, 13, 14), 1).otherwise(2)
    unit = F.get(F.get(F.array(*[F.array(*map(F.lit, f)) for f in FRACTIONS]), places - 1), form)
    spelled = F.array_join(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: F.get(F.array(*map(F.lit, UNITS)), F.ascii(c) - 48)), " ")
    return F.when(digits.rlike("^[0-9]+$"), F.when(places <= 3, F.concat_ws(" ", cardinal(whole), F.lit("i"), cardinal_feminine(part), unit)).otherwise(F.concat_ws(" ", cardinal(whole), F.lit("przecinek"), spelled)))


def clock(hour: Column, minute: Column) -> Column:
    """Hour as a feminine locative ordinal and minutes as a cardinal, none for the full hour; null out of range."""
    locative = lambda w: F.regexp_replace(F.regexp_replace(w, "([gk])a$", "$1iej"), "a$", "ej")
    said = F.array_join(F.transform(F.split(ordinal(hour, "f"), " "), locative), " ")
    return F.when(hour.between(0, 23) & minute.between(0, 59), F.when(minute == 0, said).otherwise(F.concat_ws(" ", said, cardinal(minute))))
