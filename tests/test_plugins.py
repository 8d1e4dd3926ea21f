"""Detectors and segmenters of one's own."""

import re

import pytest
from pyspark.sql import functions as F

from narrata.functions.sentences import guarded, pack, sentences
from narrata.operators import prepass
from narrata.operators.plugins import Detector, Registry, create_sentences
from narrata.plans import book

BLOCKS = "book_id string, chapter_id long, block_index int, text string"


def finder(pattern, say="said", reason="mine", confidence=0.7):
    return lambda text: [(m.start(), m.end(), say, reason, confidence) for m in re.finditer(pattern, text)]


def places(frame, kinds):
    return sorted((r["block_index"], r["start"], r["end"], r["kind"]) for r in frame.filter(F.col("kind").isin(*kinds)).collect())


def test_own_detectors_claim_by_priority(spark):
    blocks = spark.createDataFrame([("b", 1, 0, "W IT było 21 osób."), ("b", 1, 1, "ISBN 978-83-000000-0-0"), ("b", 1, 2, None), ("b", 1, 3, "W IT było nic.")], BLOCKS)
    rules = spark.createDataFrame([("nic", "nyc", False, False, 1, "global", False, 0)], "pattern string, spoken string, is_regex boolean, case_sensitive boolean, priority int, scope string, auto boolean, place int")
    kinds = ("first", "last", "between", "acronym", "numeral", "dict_hit")
    before = places(prepass.prepass(blocks, rules=rules), kinds)
    assert before == [(0, 2, 4, "acronym"), (0, 10, 12, "numeral"), (3, 2, 4, "acronym"), (3, 10, 13, "dict_hit")]
    # The skipped block 1 has none; a lexicon hit replaces all; between numbers and words one loses to numbers alone.
    own = Registry(Detector("last", 90, finder("W IT")), Detector("first", 1, finder("było 21")))
    assert places(prepass.prepass(blocks, rules=rules, own=own), kinds) == [(0, 2, 4, "acronym"), (0, 5, 12, "first"), (3, 2, 4, "acronym"), (3, 10, 13, "dict_hit")]
    own = Registry(Detector("between", 25, finder("W IT|21 osób|o nic")))
    assert places(prepass.prepass(blocks, rules=rules, own=own), kinds) == [(0, 0, 4, "between"), (0, 10, 12, "numeral"), (3, 0, 4, "between"), (3, 10, 13, "dict_hit")]
    one = prepass.prepass(blocks, own=own).filter("kind = 'between' AND block_index = 0").first()
    assert (one["original"], one["replacement"], one["reason"], one["confidence"]) == ("W IT", "said", "mine", 0.7)


def test_registry_rejects_what_cannot_be(spark):
    own = Registry(Detector("a", 1, finder("x")))
    with pytest.raises(ValueError, match="already"):
        own.register(Detector("a", 2, finder("y")))
    for bad in ([(0, 0, "", "r", 0.5)], [(2, 9, "", "r", 0.5)], [(-1, 2, "", "r", 0.5)], [(0, 1, "", "", 0.5)], [(0, 1, "", "r", 1.5)]):
        with pytest.raises(ValueError, match="detector b"):
            Registry(Detector("b", 1, lambda text, bad=bad: bad)).rows("text")
    assert Registry().rows("text") == [] and not Registry()


def test_table_functions_in_sql(spark):
    spark.createDataFrame([("b", 1, 0, "Ala ma 2 koty. Kot ma Alę."), ("b", 1, 1, ""), ("b", 1, 2, None)], BLOCKS).createOrReplaceTempView("some_blocks")
    Registry(Detector("cat", 1, finder("[Kk]ot"))).create_function(spark, "cats")
    got = spark.sql("SELECT block_index, c.start, c.original, c.kind FROM some_blocks, LATERAL cats(text) c ORDER BY start").collect()
    assert [tuple(r) for r in got] == [(0, 9, "kot", "cat"), (0, 15, "Kot", "cat")]
    create_sentences(spark, "halves", lambda text: [(0, 3), (4, len(text))])
    got = spark.sql("SELECT h.position, h.sentence FROM some_blocks, LATERAL halves(text) h ORDER BY position").collect()
    assert [tuple(r) for r in got] == [(0, "Ala"), (1, "ma 2 koty. Kot ma Alę.")]


def test_segmenters_are_exchanged(spark):
    def at_stops(text):
        """Another segmenter: every full stop ends a sentence."""
        return [(m.start(), m.end()) for m in re.finditer(r"\S[^.]*\.?", text)]

    text = "Było np. tak. potem nie. Koniec."
    assert [text[a:b] for a, b in sentences(text)] == ["Było np. tak. potem nie.", "Koniec."]
    assert [text[a:b] for a, b in at_stops(text)] == ["Było np.", "tak.", "potem nie.", "Koniec."]
    assert [text[a:b] for a, b in guarded(at_stops)(text)] == ["Było np. tak.", "potem nie.", "Koniec."]
    assert pack(text, 15, segment=guarded(at_stops)) == ["Było np. tak.", "potem nie.", "Koniec."]
    runs = spark.createDataFrame([("b", 1, 0, "narrator", "tts", text), ("b", 1, 1, "narrator", "silence", "")], "book_id string, chapter_id long, run int, slot string, kind string, text string")
    assert [r["spoken"] for r in book.plan_items(runs, 15, guarded(at_stops)).orderBy("ordinal").collect()] == ["Było np. tak.", "potem nie.", "Koniec.", ""]
