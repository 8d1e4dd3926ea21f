"""Word lists, letter names and characters of the narration rules."""

from __future__ import annotations

# Fixed values. How a Polish narrator says the English letters.
LETTER_NAMES = {
    "A": "ej", "B": "bi", "C": "si", "D": "di", "E": "i", "F": "ef", "G": "dżi", "H": "ejcz", "I": "aj", "J": "dżej", "K": "kej", "L": "el", "M": "em",
    "N": "en", "O": "oł", "P": "pi", "Q": "kju", "R": "ar", "S": "es", "T": "ti", "U": "ju", "V": "vi", "W": "dablju", "X": "eks", "Y": "łaj", "Z": "zet",
}

# Fixed values. Capitals that are words or Roman numerals.
NOT_ACRONYMS = (
    "NA OD DO PO WE ZE TO TU ON JA JE CO TAK NIE PAN ALE LUB JAK TEN TAM DWA STO RAZ ROK LAT DOM LAS NOC SYN MA MY WY ICH POD NAD DLA BEZ CZY OK "
    "THE AND FOR II III IV VI VII VIII IX XI XII XIII XIV XV XVI XVII XVIII XIX XX XXI XXX"
).split()

# Fixed values. Place names, longest first, and how they are said.
TOPONYMS = (
    ("Washington D.C.", "Łoszynkton di si"),
    ("Washington DC", "Łoszynkton di si"),
    ("Los Angeles", "Los Andżeles"),
    ("Washington", "Łoszynkton"),
    ("Nowy Jork", "Nowy Jork"),
    ("Warszawa", "Warszawa"),
)

# Fixed values. Words that are taken for English, and two that have their own respelling.
ENGLISH_WORDS = (
    "deadline walker briefing meeting manager office email laptop software weekend design marketing feedback business online update workshop please "
    "thanks sorry hello clock"
).split()
SPOKEN_WORDS = {"walker": "Łoker", "deadline": "dedlajn"}

# Fixed values. Respelling of English letter groups, in this order.
RESPELLINGS = (("tion", "szyn"), ("ness", "nes"), ("ee", "i"), ("oo", "u"), ("th", "t"), ("wh", "ł"), ("qu", "kw"), ("ck", "k"), ("ing", "ing"))
POLISH_LETTERS = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"

# Fixed values. Soft hyphen, horizontal spaces, and dashes by what they fold to.
SOFT = "\u00ad"
SPACES = " \t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
TO_DASH = "\u2012\u2013\u2015\u2e3a\u2e3b\ufe58"
TO_HYPHEN = "\u2010\u2011\u2212\ufe63\uff0d"
EM_DASH = "\u2014"

# Fixed values. Lines that are skipped.
TOC_HEADINGS = ("spis treści", "spis tresci", "table of contents")
ORIGINAL_TITLE = ("tytuł oryginału", "tytul oryginalu")
RIGHTS = ("all rights reserved", "wszelkie prawa zastrzeżone")
EDITORIAL = ("redakcja", "korekta", "skład", "sklad", "projekt okładki", "projekt okladki")
