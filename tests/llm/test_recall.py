"""Large groups, paths for large tables, and measured recall and precision."""

import random
import re

import pytest
from pyspark.sql import functions as F

from narrata.llm import decontam, graph, html_extract, ngram_join, passages, secrets
from test_operators import VOCABULARY, components_of, prose


def shingles(words, size):
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def near(a, b, num, den):
    return den * len(a & b) >= num * len(a | b)


def test_large_lists_are_compared_in_blocks(spark, monkeypatch):
    rnd = random.Random(21)
    base, rows = prose(rnd, 150).split(" "), []
    for k in range(140):
        w = list(base)
        for _ in range(rnd.choice((0, 1, 2, 4, 6, 8, 12))):
            w[rnd.randrange(len(w))] = rnd.choice(VOCABULARY)
        rows.append((k, " ".join(w[: rnd.choice((150, 150, 140, 120))])))
    rows += [(1000 + k, prose(rnd, 80)) for k in range(20)]
    sets = {k: shingles(t.split(" "), 5) for k, t in rows}
    expected = components_of(list(sets), [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b], 80, 100)])
    # Small blocks, and every shingle of the group common, so that pairs meet across blocks and squares.
    for name, value in (("HEAVY", 2), ("BLOCK", 50), ("SQUARE", 16), ("ROUNDS", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r.doc_id: r.component_id for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected
    assert len(set(expected.values())) > 30


def test_large_unlike_groups_make_few_rows(spark, monkeypatch):
    """Two groups of near copies with half their text in common: two components, but 90,000 pairs a list."""
    rnd, rows = random.Random(22), []
    common = prose(rnd, 60).split(" ")
    for g in range(2):
        base = common + prose(rnd, 60).split(" ")
        for k in range(300):
            w = list(base)
            w[rnd.randrange(len(w))] = rnd.choice(VOCABULARY)
            rows.append((1000 * g + k, " ".join(w)))
    made, joined = [], ngram_join._all_pairs

    def counted(buckets, rule):
        a, b = (buckets.select("token", F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        made.append(a.join(b, "token").filter("a < b AND ca <> cb").count())
        return joined(buckets, rule)

    monkeypatch.setattr(ngram_join, "_all_pairs", counted)
    prefixes = ngram_join.choose_matches
    sizes = []
    monkeypatch.setattr(ngram_join, "choose_matches", lambda shared, rule: sizes.append(shared.count()) or prefixes(shared, rule))
    sets = {k: shingles(t.split(" "), 5) for k, t in rows}
    expected = components_of(list(sets), [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b], 80, 100)])
    got = {r.doc_id: r.component_id for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected
    assert sum(made) <= 20 * sizes[0]


@pytest.mark.parametrize("tokens", [1 << 21, 20_000])
def test_a_group_of_near_copies_makes_no_rows_of_pairs(spark, monkeypatch, tokens):
    """300 near copies, most of which do not link: 44,850 pairs, few of which a bound rules out."""
    rnd, rows = random.Random(23), []
    base = prose(rnd, 150).split(" ")
    for k in range(300):
        w = list(base)
        for _ in range(rnd.choice((2, 3, 3))):
            w[rnd.randrange(len(w))] = rnd.choice(VOCABULARY)
        rows.append((k, " ".join(w)))
    sets = {k: shingles(t.split(" "), 5) for k, t in rows}
    expected = components_of(list(sets), [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b], 80, 100)])
    made, cut = {}, ngram_join.cut

    def counted(df, name):
        out = cut(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    for name, value in (("cut", counted), ("TOKENS", tokens), ("SQUARE", 64), ("ROUNDS", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r.doc_id: r.component_id for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected
    assert len(set(expected.values())) > 30
    assert made.pop("prefixes") > 0 and made.pop("buckets") > 0
    assert max(made.values()) <= 2 * len(rows), made


def test_many_links_are_contracted_by_joins(spark, monkeypatch):
    rnd = random.Random(5)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1040)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    monkeypatch.setattr(graph, "TASK_LINKS", 0)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == components_of(nodes, [x for x in links if x[0] != x[1]])


def test_lines_are_linked_as_by_brute_force(spark):
    rnd = random.Random(31)
    lines = [prose(rnd, rnd.randint(20, 60)).split(" ") for _ in range(40)]
    docs = []
    for k in range(60):
        w = list(lines[rnd.randrange(40)])
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 5))):
            w[rnd.randrange(len(w))] = rnd.choice(VOCABULARY)
        docs.append((k, " ".join(w)))
    phrase = prose(rnd, 5)
    docs += [(100, " ".join([phrase] * 6)), (101, " ".join([phrase] * 4)), (102, prose(rnd, 19)), (103, docs[3][1]), (104, ""), (105, None), (None, docs[3][1])]
    sets = {k: shingles(t.split(" "), 5) for k, t in docs if t and k is not None and len(t.split(" ")) >= 20}
    component = components_of(list(sets), [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b], 80, 100)])
    linked = {k for k in sets if sum(c == component[k] for c in component.values()) > 1}
    found = passages.repeats(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, node string")).collect()
    whole = {r.doc_id for r in found}
    # Equal windows of lines that are less alike are found besides.
    windows = {k: {tuple(docs_words[j : j + 20]) for j in range(len(docs_words) - 19)} for k, docs_words in ((k, t.split(" ")) for k, t in docs if t and k is not None)}
    shared = {k for k in windows if any(j != k and windows[j] & windows[k] for j in windows)}
    assert linked <= whole <= linked | shared
    assert {100, 101} <= whole
    kept = {r.doc_id for r in found if not r.removed}
    assert all(min(d for d in sets if component[d] == component[k]) in kept for k in linked)


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_of_fifty_words_always_hold_an_anchor(spark, seed):
    rnd = random.Random(seed)
    shared = [prose(rnd, 50) for _ in range(60)]
    docs = [(2 * k + s, f"{prose(rnd, rnd.randint(0, 90))} {p} {prose(rnd, rnd.randint(0, 90))}".strip()) for k, p in enumerate(shared) for s in (0, 1)]
    found = {r.doc_id for r in passages.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {d for d, _ in docs}


def test_markov_spans_in_running_text(spark):
    """Models trained from the corpus alone: tokens that no rule knows are found, long ordinary names are not."""
    rnd = random.Random(41)
    key = lambda n: "".join(rnd.choice(secrets.ALPHABET[:62]) for _ in range(n))
    docs, random_at, plain_at = [], set(), set()
    for k in range(600):
        w = prose(rnd, 60).split(" ")
        if k % 3 == 0:
            w[20:20] = [f"password={key(24)}"]
        elif k % 3 == 1:
            w[30] = key(rnd.randint(22, 40))
            random_at.add(k)
        else:
            w[30] = "_".join(rnd.choice(VOCABULARY) for _ in range(5)) + "_configuration"
            plain_at.add(k)
        docs.append((k, " ".join(w)))
    found = {r.doc_id for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect() if "markov" in r.spans}
    assert len(found & random_at) >= 0.95 * len(random_at)
    assert len(found & plain_at) <= 0.02 * len(plain_at)


def test_candidates_hold_what_passes_the_word_check(spark):
    """Of paraphrases that pass the final check, retrieval brings nine tenths or more."""
    rnd = random.Random(51)
    items = [(k, prose(rnd, rnd.randint(14, 70))) for k in range(150)]
    docs, sure = [], set()
    for k in range(300):
        w = prose(rnd, 400).split(" ")
        if k < 150:
            said = [x if rnd.random() > 0.27 else rnd.choice(VOCABULARY) for x in items[k][1].split(" ")]
            common = sum(a == b for a, b in zip(said, items[k][1].split(" "), strict=True))
            if common >= 0.7 * len(said):
                sure.add((k, k))
            w[150:150] = said
        docs.append((k, " ".join(w)))
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(sure) > 60
    assert len(found & sure) >= 0.95 * len(sure)
    assert all(d == i for d, i in found)


def test_deep_markup_is_walked_in_proportion():
    page = "<html><body><article>" + "<div><p>word " * 20_000
    assert len(re.findall("word", html_extract.main_text(page, set(), set()))) == 20_000


def test_repeats_reach_from_end_to_end(spark):
    """Of passages inside lines nearly all is marked, in the first text and in the others; short repeats from 34 words on."""
    rnd = random.Random(31)
    texts, places = [prose(rnd, 300).split(" ") for _ in range(60)], {}
    for k in range(20):
        length = (34, 60, 120, 200)[k % 4]
        said = prose(rnd, length).split(" ")
        for d in (k, k + 20, k + 40):
            at = rnd.randrange(10, 280)
            texts[d][at:at] = [w.upper() if d >= 40 else w for w in said]
            before = " ".join(texts[d][:at])
            places[d] = (len(before) + 1, len(before) + 1 + len(" ".join(said)))
    rows = passages.repeats(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")).collect()
    marked = {}
    for r in rows:
        # A window at an edge may be one of the later texts alone.
        if r.first_doc_id < 20:
            marked.setdefault(r.doc_id, []).append((r.begin, r.end))
            assert r.removed == (r.doc_id >= 20) and r.first_doc_id == r.doc_id % 20
    assert set(marked) == set(places)
    for d, (begin, end) in places.items():
        assert len(marked[d]) == 1
        # Words before and behind may be equal by chance.
        assert marked[d][0][0] <= begin and marked[d][0][1] >= end and marked[d][0][1] - marked[d][0][0] <= end - begin + 60


def test_contexts_end_where_texts_part():
    assert passages._common("x a  B", "y A b", False) == (4, 3)
    assert passages._common(" c d e", " C\nd f", True) == (4, 4)
    assert passages._common("a", "b", True) == (0, 0) and passages._common("", "", False) == (0, 0)
    text = " ".join(f"w{k}" for k in range(500)) + "x" * 5000
    left, right = passages._beside(text, 1000, 1010)
    assert text[:1000].endswith(left) and text[1010:].startswith(right) and len(left.split()) == len(right.split()) == passages.BESIDE
    assert passages._beside("a b c", 2, 3) == ("a ", " c") and passages._beside("abc", 0, 3) == ("", "")
