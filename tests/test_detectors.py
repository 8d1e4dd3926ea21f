"""Detectors against exact values, and offsets as a property."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from narrata.functions.offsets import claim, find_all
from narrata.operators import detectors as D
from narrata.operators import lexicon, skip, text

CASES = [
    (D.acronyms, "W IT nikt NIE", [(2, 4, "aj ti")]),
    (D.toponyms, "do Washington  DC i washington", [(3, 17, "Łoszynkton di si"), (20, 30, "Łoszynkton")]),
    (D.foreign_words, "Deadline, thé Walker", [(0, 8, "dedlajn"), (10, 13, "té"), (14, 20, "Łoker")]),
    (D.soft_hyphens, "egzem­plarzy", [(0, 12, "egzemplarzy")]),
    (D.hyphen_breaks, "prze-\nsunięty", [(0, 13, "przesunięty")]),
    (D.space_runs, "a  b  c", [(1, 3, " "), (4, 6, " ")]),
    (D.dashes, "a – b ‐ c", [(2, 3, "—"), (6, 7, "-")]),
]


@pytest.mark.parametrize(("detector", "block", "expected"), CASES)
def test_detector(spark, detector, block, expected):
    rows = D.suggestions(spark.createDataFrame([(1, block), (2, None), (3, "")], "id int, text string"), detector).collect()
    assert [(r.start, r.end, r.replacement) for r in sorted(rows, key=lambda r: r.start)] == expected
    assert all(block[r.start : r.end] == r.original for r in rows)


def test_names_claim_before_words(spark):
    rows = D.suggestions(spark.createDataFrame([(1, "Washington DC, IT i THE meeting")], "id int, text string"), D.lexical).collect()
    kept = sorted((r.start, r.end) for r in rows)
    assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:], strict=False))
    assert kept[0] == (0, 13)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab żé😀\n-12", max_size=40), min_size=1, max_size=8))
def test_offsets_are_code_points(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", find_all(F.col("t"), "[a-z]+").alias("a")).collect()
    for r in rows:
        expected = [(m.start(), m.end(), m[0]) for m in re.finditer("[a-z]+", r.t)]
        assert [tuple(x) for x in r.a] == expected


def test_claims_are_greedy(spark):
    spans = [(4, 9), (0, 4), (8, 10), (2, 3), (9, 9), (9, 12), (20, 30), (19, 21), (12, 20)]
    kept = []
    for a, b in spans:
        if a < b and all(b <= c or d <= a for c, d in kept):
            kept.append((a, b))
    row = spark.createDataFrame([(spans,)], "s array<struct<start:int,end:int>>").select(claim(F.col("s")).alias("s")).first()
    assert [tuple(x) for x in row.s] == kept


def test_many_matches_take_time_in_proportion(spark):
    blocks = spark.createDataFrame([(1, "a – b  NATO " * 50_000)], "id int, text string")
    began = time.time()
    assert D.suggestions(blocks, D.dashes).count() == 50_000
    assert D.suggestions(blocks, D.normalization).count() == 100_000
    assert D.suggestions(blocks, D.acronyms).count() == 50_000
    assert time.time() - began < 60


def test_decomposed_letters(spark):
    row = D.suggestions(spark.createDataFrame([(1, "caf\u0065\u0301 \u212b x\u0301 \u00e9")], "id int, text string"), D.normalization).orderBy("start").collect()
    assert [(r.start, r.end, r.replacement, r.reason) for r in row] == [(3, 5, "\u00e9", "nfc"), (6, 7, "\u00c5", "nfc")]


def test_lexicon_rules(spark):
    rules = [("of the", "ow de", False, False, True, 50, "global", 0), ("the", "de", False, False, False, 100, "global", 1), ("NATO", "nato", False, True, False, 10, "global", 2), ("[0-9]+", "liczba", True, True, False, 5, "global", 3), ("[", "x", True, True, False, 1, "global", 4), ("- x", "y", False, False, False, 1, "global", 5)]
    table = spark.createDataFrame([(p, s, x, c, a, n, g, k) for p, s, x, c, a, n, g, k in rules], "pattern string, spoken string, is_regex boolean, case_sensitive boolean, auto boolean, priority int, scope string, place int")
    blocks = spark.createDataFrame([(1, "The end of the NATO, nato 12 - x"), (2, None), (3, "other")], "id int, text string")
    rows = lexicon.lexicon_suggestions(blocks, table).orderBy("start").collect()
    assert [(r.id, r.start, r.original, r.replacement) for r in rows] == [(1, 0, "The", "de"), (1, 8, "of the", "ow de"), (1, 15, "NATO", "nato"), (1, 26, "12", "liczba"), (1, 29, "- x", "y")]


def test_contents_with_titles(spark):
    texts = ["Spis treści", "Alfa", "Beta", "Gamma", "Spis treści", "Alfa", "Beta", "Gamma", "Delta", "Epsilon", "Koniec."]
    blocks = spark.createDataFrame([("b", 1, k, t) for k, t in enumerate(texts)], "book_id string, chapter_id int, block_index int, text string")
    titles = spark.createDataFrame([("b", t) for t in ("alfa", "BETA", "Gamma", "Delta", "Epsilon")], "book_id string, title string")
    assert sorted(r.block_index for r in skip.contents_skips(blocks, titles).collect()) == list(range(4, 10))


def test_skip_reasons(spark):
    lines = {"12": "page_number", "ISBN 978-83-000000-0-0": "isbn", "Copyright X": "copyright", "Tytuł oryginału: X": "original_title", "Korekta: Y": "editorial", "Anna": None, "": None}
    rows = spark.createDataFrame([(t,) for t in lines], "t string").select("t", skip.line_reason(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == lines


def test_contents_run_needs_five_entries(spark):
    def book(n):
        return [("b", n, 0, "Spis treści"), *[("b", n, k, f"Title {k}") for k in range(1, n + 1)], ("b", n, n + 1, "The end.")]

    rows = skip.contents_skips(spark.createDataFrame(book(4) + book(5), "book_id string, chapter_id int, block_index int, text string")).collect()
    assert {(r.chapter_id, r.block_index) for r in rows} == {(5, k) for k in range(6)}


def test_project_rules_hide_global_ones(spark):
    rules = spark.createDataFrame([("a", "x", False, False, False, 100, "global", 0), ("a", "y", False, True, False, 100, "project", 1), ("bb", "z", False, False, False, 100, "global", 2)], "pattern string, spoken string, is_regex boolean, auto boolean, case_sensitive boolean, priority int, scope string, place int")
    assert [(r.pattern, r.spoken) for r in lexicon.effective_rules(rules).orderBy("rank").collect()] == [("bb", "z"), ("a", "y")]


def test_redaction(spark):
    said = 'token: "abc" Bearer abcdefgh1 sk-12345678'
    row = spark.createDataFrame([(said,)], "t string").select(text.redact(F.col("t")).alias("t")).first()
    assert row.t == 'token: "[REDACTED]" Bearer [REDACTED] [REDACTED]'


def test_roman(spark):
    rows = spark.createDataFrame([("XIV",), ("MMMCMXCIX",), ("IIII",), ("",), ("IC",)], "t string").select("t", text.roman_value(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == {"XIV": 14, "MMMCMXCIX": 3999, "IIII": None, "": None, "IC": None}


def test_columns_are_the_rows_of_their_functions(spark):
    texts = ["IT w  Washington DC ‒ NATO, Deadline i NIE los  angeles the", "prze-\nsunięty a\u00adb  ‐ e\u0301", "", None]
    blocks = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for column, find in ((D.lexical, D.lexical_rows), (D.normalization, D.normal_rows)):
        found = D.suggestions(blocks, column)
        rows = [tuple(r)[1:] for k in range(len(texts)) for r in found.collect() if r.k == k]
        assert rows == [r for t in texts if t for r in find(t)] and len(rows) >= 5
        # What a text's function has found is not walked through again by expressions, which are slower than it.
        assert "lambdafunction" not in found._jdf.queryExecution().toString()
