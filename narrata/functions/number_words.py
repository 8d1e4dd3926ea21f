"""Polish number words in Python, for functions that read a block at a time; ``numbers_pl`` has the same as columns."""

from __future__ import annotations

from narrata.functions import numbers_pl as N


def _below_thousand(n: int) -> list[str]:
    """Words of 1 to 999."""
    words = [N.HUNDREDS[n // 100 - 1]] if n >= 100 else []
    n %= 100
    words += [N.TENS[n // 10 - 2]] if n >= 20 else []
    n = n % 10 if n >= 20 else n
    return words + ([N.UNITS[n]] if n else [])


def plural(n: int, one: str, few: str, many: str) -> str:
    """The form of a noun behind a number; one to four do not count in the teens."""
    last = 0 if 10 <= n % 100 <= 20 else n % 10
    return one if last == 1 else few if 2 <= last <= 4 else many


def _scales(n: int) -> list[str]:
    words = []
    for scale, one, few, many in N.SCALES:
        count = n // scale % 1000
        words += [one] if count == 1 else [*_below_thousand(count), plural(count, one, few, many)] if count else []
    return words


def cardinal(n: int) -> str:
    """Nominative cardinal of 0 to 10**12 - 1."""
    return " ".join(_scales(n) + _below_thousand(n % 1000)) or N.UNITS[0]


def cardinal_feminine(n: int) -> str:
    words = cardinal(n).split(" ")
    words[-1] = {"jeden": "jedna", "dwa": "dwie"}.get(words[-1], words[-1])
    return " ".join(words)


def inflect(word: str, gender: str) -> str:
    """A masculine ordinal in gender m, f or n."""
    if gender == "m":
        return word
    if word.endswith("i"):
        return word + "e" if gender == "n" else {"drugi": "druga", "trzeci": "trzecia"}[word]
    return word[:-1] + {"f": "a", "n": "e"}[gender]


def _thousandth(n: int) -> str:
    """The ordinal of n exact thousands."""
    low = n % 100
    tens, unit = (N.TENS_STEMS[low // 10 - 1], low % 10) if low >= 20 else ("", low)
    hundreds = N.HUNDREDS_STEMS[n // 100 - 1] if n >= 100 else ""
    return ("" if n == 1 else hundreds + tens + N.UNIT_STEMS[unit]) + "tysięczny"


def ordinal(n: int, gender: str = "m") -> str:
    """Nominative ordinal of 0 to 999,999; tens and units inflect, or else the last part."""
    if n and n % 1000 == 0:
        return inflect(_thousandth(n // 1000), gender)
    low, before = n % 100, n % 1000 // 100
    words = _scales(n)
    if before:
        words.append(N.HUNDREDS[before - 1] if low else inflect(N.ORDINAL_HUNDREDS[before - 1], gender))
    words += [inflect(N.ORDINAL_TENS[low // 10 - 2], gender)] if low >= 20 else []
    unit = low % 10 if low >= 20 else low
    words += [inflect(N.ORDINAL_UNITS[unit], gender)] if unit or not n else []
    return " ".join(words)


def clock(hour: int, minute: int) -> str:
    """A full hour as a feminine locative ordinal, then minutes as a cardinal."""
    said = " ".join(w[:-1] + ("iej" if w[-2] in "gk" else "ej") for w in ordinal(hour, "f").split(" "))
    return f"{said} {cardinal(minute)}" if minute else said


def decimal(whole: int, digits: str) -> str:
    """A decimal fraction: up to three places by their name, more of them digit by digit."""
    if len(digits) > 3:
        return f"{cardinal(whole)} przecinek {' '.join(N.UNITS[int(d)] for d in digits)}"
    n = int(digits)
    one, few, many = N.FRACTIONS[len(digits) - 1]
    form = one if n % 10 == 1 and n % 100 != 11 else few if n % 10 in (2, 3, 4) and n % 100 not in (12, 13, 14) else many
    return f"{cardinal(whole)} i {cardinal_feminine(n)} {form}"
