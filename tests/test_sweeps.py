"""Sweeps over a block's spans, and the automaton of a lexicon, against brute force."""

import random
import re

import pytest

from narrata.operators import lexicon, review
from narrata.plans import voices

KEY = "book_id string, chapter_id long, block_index int"


def spans(rnd, n, width):
    return sorted((a, a + rnd.randint(0, width)) for a in (rnd.randrange(200) for _ in range(n)))


def test_without_overlaps_is_a_sweep(spark):
    rnd = random.Random(1)
    ours, theirs = [], []
    for block in range(40):
        ours += [("b", block % 3, block, a, b, f"s{k}") for k, (a, b) in enumerate(spans(rnd, 30, 9))]
        theirs += [("b", block % 3, block, a, b, 0.5) for a, b in spans(rnd, rnd.choice((0, 1, 12)), 30)]
    got = review.without_overlaps(spark.createDataFrame(ours, f"{KEY}, start int, end int, original string"), spark.createDataFrame(theirs, f"{KEY}, start int, end int, confidence double"))
    expected = [s for s in ours if s[3] == s[4] or not any(t[:3] == s[:3] and t[3] < t[4] and t[3] < s[4] and s[3] < t[4] for t in theirs)]
    assert got.columns == ["book_id", "chapter_id", "block_index", "start", "end", "original"]
    assert sorted(map(tuple, got.collect())) == sorted(expected) and 0 < len(expected) < len(ours)


def test_overlays_are_a_sweep(spark):
    rnd = random.Random(2)
    tiles, marks = [], []
    for block in range(30):
        cuts = sorted(rnd.sample(range(200), 12))
        tiles += [("b", 1, block, a, b) for a, b in zip(cuts, cuts[1:], strict=False) if rnd.random() < 0.8]
        marks += [("b", 1, block, a, b, rnd.choice(("pronunciation", "skip", "dialogue"))) for a, b in spans(rnd, 40, 12)]
    got = voices.overlays(spark.createDataFrame(tiles, f"{KEY}, start int, end int"), spark.createDataFrame(marks, f"{KEY}, start int, end int, kind string"))
    expected = [(*m[:3], t[3], m[3] - t[3], m[4] - t[3], m[5]) for m in marks for t in tiles if m[:3] == t[:3] and m[5] != "dialogue" and t[3] <= m[3] < m[4] <= t[4]]
    assert sorted(map(tuple, got.collect())) == sorted(expected) and expected


def test_one_block_with_many_spans(spark):
    """20,000 spans on either side: 400 million pairs, were they joined."""
    n = 20_000
    ours = spark.range(n).selectExpr("'b' AS book_id", "1L AS chapter_id", "0 AS block_index", "CAST(id * 10 AS int) AS start", "CAST(id * 10 + 3 AS int) AS end")
    theirs = ours.selectExpr("book_id", "chapter_id", "block_index", "start + 5 + CAST(start % 20 = 0 AS int) * -3 AS start", "start + 7 AS end")
    assert review.without_overlaps(ours, theirs).count() == n // 2


RULES = "pattern string, spoken string, is_regex boolean, case_sensitive boolean, priority int, scope string, auto boolean, place int"


def brute(text, rules):
    """Rules in their order, each claiming what no rule before has."""
    taken, out = [], []
    for pattern, spoken, is_regex, case, *_, auto, _ in sorted(rules, key=lambda r: (r[4], -len(r[0]), r[7])):
        found = re.finditer(pattern if is_regex else rf"(?<!\w){re.escape(pattern)}(?!\w)", text, 0 if case else re.IGNORECASE)
        for m in found:
            if m.end() > m.start() and not any(a < m.end() and m.start() < b for a, b in taken):
                taken.append(m.span())
                out.append((*m.span(), m[0], spoken, auto))
    return sorted(out)


@pytest.mark.parametrize("most", [lexicon.BROADCAST_RULES, 0])
def test_lexicon_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(lexicon, "BROADCAST_RULES", most)
    rnd = random.Random(7)
    rules = [("the", "de", False, False, 5, "global", True, 0), ("the cat", "kot", False, False, 5, "global", False, 1), ("Cat", "Kat", False, True, 1, "global", False, 2), ("...", "dots", False, False, 9, "global", False, 3),
             ("c[ao]+t", "rx", True, False, 7, "global", True, 4), ("ma mo", "mm", False, False, 5, "global", False, 5), ("(", "broken", True, False, 1, "global", False, 6), ("żółw", "turtle", False, False, 2, "global", False, 7)]
    texts = ["".join(rnd.choice(["the ", "The", "cat", "Cat ", " ", "...", "coat", "ma mo", "mo ", "ŻÓŁW ", "_", "İ ", ", "]) for _ in range(rnd.randint(0, 25))) for _ in range(60)]
    blocks = spark.createDataFrame([("b", 1, k, t) for k, t in enumerate([*texts, None])], f"{KEY}, text string")
    got = lexicon.lexicon_suggestions(blocks, spark.createDataFrame(rules, RULES))
    found = {}
    for r in got.collect():
        found.setdefault(r.block_index, []).append((r.start, r.end, r.original, r.replacement, r.auto))
    valid = [r for r in rules if r[0] != "("]
    assert {k: sorted(v) for k, v in found.items()} == {k: b for k, t in enumerate(texts) if (b := brute(t, valid))}


def test_many_hits_in_one_block(spark):
    """50,000 hits cost time in proportion."""
    blocks = spark.createDataFrame([("b", 1, 0, "the cat sat " * 50_000)], f"{KEY}, text string")
    rules = spark.createDataFrame([("cat", "kot", False, False, 5, "global", True, 0)], RULES)
    assert lexicon.lexicon_suggestions(blocks, rules).count() == 50_000
