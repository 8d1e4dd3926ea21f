"""Numbers, sentences, dialogue and gender against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from narrata.functions import number_words as P
from narrata.functions import numbers_pl as N
from narrata.functions.sentences import fit, pack, sentences
from narrata.operators import dialogue as D
from narrata.operators import gender as G
from narrata.operators import numerals as M


CASES = [
    ("Było ich 7.", False, [("7", "siedem", "numeral", "cardinal")]),
    ("11.", False, [("11.", "jedenasty", "numeral", "ordinal")]),
    ("masa 4,05 kg", False, [("4,05", "cztery i pięć setnych", "numeral", "decimal")]),
    ("pi to 3,1415", False, [("3,1415", "trzy przecinek jeden cztery jeden pięć", "numeral", "decimal")]),
    ("o 21:15 i o 24:00", False, [("21:15", "dwudziestej pierwszej piętnaście", "numeral", "clock"), ("24", "dwadzieścia cztery", "numeral", "cardinal"), ("00", "zero", "numeral", "cardinal")]),
    ("w 1945 roku", False, [("1945", "tysiąc dziewięćset czterdziesty piąty", "numeral", "year")]),
    ("przeszedł 1945 km", False, [("1945", "tysiąc dziewięćset czterdzieści pięć", "numeral", "cardinal")]),
    ("Tom 3", False, [("Tom 3", "Tom trzeci", "ordinal_heading", "heading_ordinal")]),
    ("Jest scena XII tu", False, [("scena XII", "scena dwunasta", "numeral", "heading_ordinal")]),
    ("VI", True, [("VI", "szósty", "ordinal_heading", "heading_ordinal")]),
    ("na IX piętro", False, [("IX", "dziewiąte", "numeral", "roman")]),
    ("to 3. część", False, [("3.", "trzecia", "numeral", "ordinal")]),
    ("Miał 3. Potem 2 345 szt", False, [("3", "trzy", "numeral", "cardinal"), ("2 345", "dwa tysiące trzysta czterdzieści pięć", "numeral", "cardinal")]),
    ("IT i IIII oraz A4", False, []),
    ("9", True, [("9", "dziewiąty", "ordinal_heading", "heading_ordinal")]),
]


@pytest.mark.parametrize(("text", "heading", "expected"), CASES)
def test_numbers(text, heading, expected):
    assert [(s[3], s[4], s[2], s[5]) for s in M.find(text, heading)] == expected


def test_number_words_are_those_of_the_columns(spark):
    rows = spark.range(4000).select((F.col("id") * F.col("id") * 7919 % 10**6).alias("n"), (F.col("id") * F.col("id") * 7_777_777 % 10**12).alias("c"))
    said = [N.cardinal(F.col("c")).alias("cardinal"), N.cardinal_feminine(F.col("c")).alias("feminine"), *[N.ordinal(F.col("n"), g).alias(g) for g in "mfn"]]
    for r in rows.select("n", "c", *said).collect():
        assert [r[2], r[3], r[4], r[5], r[6]] == [P.cardinal(r.c), P.cardinal_feminine(r.c), *(P.ordinal(r[0], g) for g in "mfn")]
    clocks = spark.range(24 * 60).select(F.floor(F.col("id") / 60).cast("int").alias("h"), (F.col("id") % 60).cast("int").alias("m"))
    assert all(r.said == P.clock(r.h, r.m) for r in clocks.select("h", "m", N.clock(F.col("h"), F.col("m")).alias("said")).collect())
    parts = spark.createDataFrame([(3, "5"), (1, "1"), (2, "22"), (7, "05"), (0, "012"), (4, "1234")], "w int, d string")
    assert all(r.said == P.decimal(r.w, r.d) for r in parts.select("w", "d", N.decimal(F.col("w"), F.col("d")).alias("said")).collect())


def test_ordinals_of_thousands(spark):
    row = spark.range(1).select(
        N.ordinal(F.lit(1000)).alias("a"), N.ordinal(F.lit(3000), "f").alias("b"), N.ordinal(F.lit(31000), "n").alias("c"), N.ordinal(F.lit(215000)).alias("d"), N.ordinal(F.lit(10**6)).alias("e")
    ).first()
    assert tuple(row) == ("tysięczny", "trzytysięczna", "trzydziestojednotysięczne", "dwustupiętnastotysięczny", None)


def texts(text):
    return [text[a:b] for a, b in sentences(text)]


def test_sentences():
    assert texts(" Pies śpi.  Kot je! ") == ["Pies śpi.", "Kot je!"]
    assert texts("Weź np. Młotek. Idź.") == ["Weź np. Młotek.", "Idź."]
    assert texts("Tak… „No to” idź. potem") == ["Tak…", "„No to” idź. potem"]
    assert texts("Dość.” — Nie. 3 razy") == ["Dość.”", "— Nie.", "3 razy"]
    assert texts("") == [] and texts("  \n") == []


def test_pieces_fit_and_lose_nothing():
    text = "Pierwsza część, druga część; trzecia część bez przecinka ale długa. Krótkie. Bardzodługiesłowobezspacji tu."
    for limit in (5, 12, 20, 40, 200):
        found = pack(text, limit)
        assert all(len(p) <= limit or " " not in p for p in found)
        assert "".join(" ".join(found).replace(",", "").replace(";", "").split()) == "".join(text.replace(",", "").replace(";", "").split())
    assert fit("a, b", 2) == ["a", "b"]
    assert pack("Jeden. Dwa. Trzy.", 11) == ["Jeden. Dwa.", "Trzy."]
    assert pack("Jeden. Dwa.", 100, whole=True) == ["Jeden. Dwa."]


def spoken(text):
    return [(k[0], text[a:b]) for k, a, b, _ in D.read(text)[0]]


@pytest.mark.parametrize("dash", ["—", "–", "-"])
def test_dialogue_by_dashes(dash):
    text = f"{dash} Idę już {dash} rzekła Ewa. {dash} Do jutra."
    assert spoken(text) == [("d", "Idę już"), ("n", "rzekła Ewa."), ("d", "Do jutra.")]
    assert spoken(f"Ktoś spytał: {dash} Kto tam?") == [("n", "Ktoś spytał:"), ("d", "Kto tam?")]


def test_dialogue_that_needs_review():
    for text, reason, confidence in (
        ("Oni — i my — czekali.", "unconfirmed_dash", 0.45),
        ("Czekał — i nic.", "odd_dash", 0.35),
        ("Rzekł „Stój", "unbalanced_quote", 0.35),
        ("Napis: „Stój”.", "quote_without_verb", 0.4),
    ):
        segments, why, sure, proposed = D.read(text)
        assert [(s[0], text[s[1] : s[2]]) for s in segments] == [("narration", text)]
        assert (why, sure) == (reason, confidence) and proposed


def test_dialogue_by_quotes():
    assert spoken("Adam dodał: «Stój!»") == [("n", "Adam dodał:"), ("d", "Stój!")]
    assert spoken("Ewa syknęła. „Stój”.") == [("n", "Ewa syknęła."), ("d", "Stój")]
    assert D.read("Zwykłe zdanie.") == ([("narration", 0, 14, 1.0)], None, None, [])
    assert D.read(None) == D.read(" ") == ([], None, None, [])


def test_gender(spark):
    blocks = ["— Jestem — mruknął Nowak.", "Ona stała przy drzwiach.", "— Już wiem.", "— Idę — Nowak.", "— Cześć — powiedziała Jan.", "— Hej — Ewa.", "Nic.", "— Może nie."]
    rows = spark.createDataFrame([("b", 1, k, t) for k, t in enumerate(blocks)], "book_id string, chapter_id int, block_index int, text string")
    found = {r.block_index: (r.gender, r.reason, r.confidence, r.speaker_id) for r in G.gender_suggestions(rows).collect()}
    assert found == {
        0: ("male", "verb_suffix", 0.95, "Nowak"), 2: ("female", "pronoun", 0.65, ""), 3: ("male", "speaker_map", 0.6, "Nowak"), 4: ("female", "contested", 0.69, "Jan"),
        5: ("female", "given_name", 0.85, "Ewa"), 7: ("unknown", "unresolved", 0.4, ""),
    }
