"""Spelling variants, filter audit and toxicity against brute force, and on their edge cases."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from narrata.llm import filter_audit, spelling, toxicity, words

LETTERS = "abcdeäöé×"


# ---- spelling variants -------------------------------------------------------------------------------------------------------------------


def brute_words(rows, slip, length=7, least=2):
    seen = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= length and n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts, ratio=10):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def got_variants(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def misspelt(rnd, word):
    at, letter = rnd.randrange(len(word)), rnd.choice(LETTERS)
    return rnd.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])


@pytest.fixture(scope="module")
def misspelt_texts():
    rnd, rows = random.Random(4), []
    base = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(6, 12))) for _ in range(25)] + ["abcdabcd" * 3, "aaaaaaaa", "aaaaaaaaa"]
    for k in range(150):
        said = [rnd.choice(base[:3] if rnd.random() < 0.6 else base) for _ in range(40)]
        said = [misspelt(rnd, w) if rnd.random() < 0.3 else w for w in said]
        rows.append((k, " ".join(w.upper() if rnd.random() < 0.1 and "ß" not in w else w for w in said)))
    return [*rows, (None, rows[0][1]), (3, None), (4, ""), rows[5], rows[5], (7, "жжжжжжжж abcdeab­cde 1234567 ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ")]


def test_spelling_variants_equal_brute_force(spark, misspelt_texts):
    frame = spark.createDataFrame([(d, t, "clash", 1) for d, t in misspelt_texts], "doc_id long, text string, word string, n int")
    expected = brute_variants(brute_words(misspelt_texts, 31))
    assert got_variants(spelling.spelling_variants(frame, slip=31)) == expected
    assert sum(form is not None for form, *_ in expected.values()) > 20
    assert spelling.spelling_variants(frame.limit(0)).count() == 0


def test_crowded_chunks_are_cut_to_single_letters(spark, monkeypatch):
    """Thousands of words that share a beginning, an end, or both."""
    rnd = random.Random(9)
    counts = {"vorsilbe" + "".join(rnd.choice("abc") for _ in range(6)): rnd.choice((2, 3, 40, 500)) for _ in range(300)}
    counts |= {"".join(rnd.choice("abc") for _ in range(4)) + "nachsilben": rnd.choice((2, 30, 400)) for _ in range(60)}
    counts |= {"mitte" + "".join(rnd.choice("ab") for _ in range(k)) + "mitte": 2 for k in range(1, 9) for _ in range(20)}
    monkeypatch.setattr(spelling, "MANY", 5)
    got = got_variants(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute_variants(counts)


def test_chains_of_forms_end_at_the_commonest(spark):
    counts = {"aaaaaaa" + "b" * k: 10**k for k in range(9)}
    got = got_variants(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute_variants(counts) and got["aaaaaaa"][1] == "aaaaaaabbbbbbbb"


def test_words_of_long_texts_are_counted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 16)
    rows = [(1, "Wörterbuch, wörterbuch wörterbuchverlag " * 50 + "x" * 100)]
    got = {r["word"]: r["n"] for r in spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string"), least=1).collect()}
    assert got == brute_words(rows, None, least=1)


# ---- filter audit ------------------------------------------------------------------------------------------------------------------------


def brute_counts(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(found), len(set(found)), len(text), len(re.findall("[A-Z]", text)), bool(re.search(r"[#$%&*|]", text))


ODD_TEXTS = ["", " ", "a", "a A a", "é É é\té", "x" * 900, "ab " * 700, "\x0b\x0c\r\n\t ", "日本 日本 語", "A&B", "a b a b", "#" * 5, "wörter " * 200 + "w" * 600 + " wörter"]


@pytest.mark.parametrize("piece", [1 << 18, 64, 7])
def test_transducer_counts_as_regular_expressions_do(monkeypatch, piece):
    monkeypatch.setattr(words, "PIECE", piece)
    rnd = random.Random(1)
    texts = ODD_TEXTS + ["".join(rnd.choice("ab \tÄß#Z日") for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    c = filter_audit.read(pa.array([*texts, None], pa.string()))
    got = list(zip(c.words, c.distinct, c.points, c.capitals, c.symbols, strict=True))
    assert got == [brute_counts(t) for t in [*texts, ""]]


def test_distinct_spans_do_not_rest_on_hashes():
    data = np.frombuffer(b"aa ab aa ba ab " + b"z" * 100 + b" " + b"z" * 99 + b"y", np.uint8)
    starts = np.array([0, 3, 6, 9, 12, 15, 116])
    ends = np.array([2, 5, 8, 11, 14, 115, 216])
    same = filter_audit.distinct_spans(data, starts, ends, np.full(7, 5, np.uint64))
    assert same[0] == same[2] and same[1] == same[4] and len(set(same.tolist())) == 5
    crossed = filter_audit.distinct_spans_by_row(data, starts, ends, np.arange(7, dtype=np.uint64), np.arange(7))
    assert crossed.tolist() == list(range(7))


def brute_audit(rows, labels):
    least, good, toxic = {}, {}, {}
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    for key, q, x in labels:
        good[key], toxic[key] = good.get(key, False) or q == 1, toxic.get(key, False) or x == 1
    out = {}
    for key, text, lang in rows:
        n, distinct, points, capitals, symbol = brute_counts(text or "")
        fails = {f for f, bad in zip("ABCDE", [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * points, symbol, key is not None and key > least[text or ""]], strict=True) if bad}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                at = out.setdefault((lang or "", order, step), Counter())
                at["redundant"] += gone and f in fails
                at["unique_fails"] += fails == {f}
                if f in fails and not gone:
                    gone = True
                    at["removed"] += 1
                    at["good_lost"] += key is not None and good.get(key, False)
                    at["toxic_lost"] += key is not None and toxic.get(key, False)
                at["kept"] += not gone
    total = Counter()
    for (lang, order, step), at in out.items():
        total[lang, order[step - 1]] += at["removed"]
    return {k: (*(at[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), total[k[0], k[1][k[2] - 1]]) for k, at in out.items()}


def test_audit_equals_brute_force(spark):
    rnd = random.Random(2)
    texts = [*ODD_TEXTS, None, *(" ".join(rnd.choice(["Ab", "cd", "é", "#x", "q%d" % rnd.randint(0, 400)]) for _ in range(rnd.choice((150, 250)))) for _ in range(12))]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(texts), rnd.choice(["de", "en", "", None])) for _ in range(150)]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for k in range(0, 40, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, lang string, part string, fails int")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in got.collect()} == brute_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


# ---- toxicity ----------------------------------------------------------------------------------------------------------------------------

BAD = ["grumbled", "snorkels", "wimpish", "blockhead", "dimwitted", "pestilent"]
SIGNS = {"o": "0", "i": "1", "e": "3", "s": "$", "a": "@", "t": "7"}


def disguised(rnd, word):
    kind = rnd.randrange(4)
    if kind == 0:
        return "".join(SIGNS.get(c, c) for c in word)
    if kind == 1:
        return rnd.choice(" .-_").join(word)
    if kind == 2:
        at = rnd.randrange(1, len(word) - 1)
        return word[:at] + word[at] * 4 + word[at + 1 :]
    at = rnd.randrange(1, len(word) - 1)
    return "​".join([word[:at], word[at:]])


@pytest.fixture(scope="module")
def said():
    """(key, text, toxic): plain words alone in texts to learn from; disguised ones too in the others."""
    rnd = random.Random(6)
    clean = ["".join(rnd.choice("etaoinshrdlucm") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    rows = []
    for k in range(900):
        text = [rnd.choice(clean) for _ in range(rnd.choice((5, 60, 300)))]
        if rnd.random() < 0.1:
            text[rnd.randrange(len(text))] = rnd.choice(["1,000.50", "v2.0", "a1b2c3d4e5f60718", "x@y.example", "well-known", "no!!!", "108.51.216.133"])
        toxic = k % 8 == 0
        if toxic:
            for _ in range(rnd.choice((1, 2))):
                word = rnd.choice(BAD)
                text.insert(rnd.randrange(len(text)), disguised(rnd, word) if zlib.crc32(str(k).encode()) % 5 == 0 else rnd.choice([word, word.title() + ","]))
        rows.append((k, " ".join(text), int(toxic)))
    # Copies and near copies of one toxic text, whose other words are not to blame.
    base = rows[8][1].split(" ") + [f"innocent{chr(97 + k)}" for k in range(20)]
    for k in range(900, 960):
        copy = list(base)
        at = rnd.randrange(len(copy) - 20)
        if copy[at].strip(",").lower() not in BAD:
            copy[at] = rnd.choice(clean)
        rows.append((k, " ".join(copy), 1))
    return rows


def test_disguised_words_are_found_and_clean_texts_left_alone(spark, said):
    docs = spark.createDataFrame([(k, t, "clash", 0.0) for k, t, _ in said], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in said], "doc_id long, toxic int").filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0")
    model = toxicity.fit(docs, labels)
    assert set(BAD) <= set(model.lexicon) and not any(e.startswith("innoc") for e in model.lexicon)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs, model).collect()}
    unseen = [(k, y) for k, _, y in said if zlib.crc32(str(k).encode()) % 5 == 0]
    found = [got[k][1] for k, y in unseen if y]
    assert sum(found) >= 0.9 * len(found) and len(found) > 20
    assert not any(got[k][1] for k, y in unseen if not y)
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p in got.values())


def test_toxicity_edges(spark, said, monkeypatch):
    frame = spark.createDataFrame([(k, t) for k, t, _ in said], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in said] + [(None, 1), (0, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    odd = [(None, "grumbled"), (1, None), (2, ""), (3, " \n"), (4, "x" * 5000), (5, "a b c d " * 900 + "words s n o r k e l s"), (6, "1" * 3000), (7, "grumbled"), (7, "grumbled"), (8, "日本語 \U0001f600 ﬁne")]
    rows = [(*r, 9) for r in odd]
    for piece in (1 << 20, 50):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, predicted int"), model)
        assert got.columns == ["doc_id", "text", "score", "predicted"]
        assert [r["predicted"] for r in got.collect()] == [1, 0, 0, 0, 0, 1, 0, 1, 1, 0]
    assert toxicity.score(frame.limit(0), model).count() == 0
    none = toxicity.fit(frame, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(frame, none).collect()} <= {0, 1} and none.lexicon == {}
    assert toxicity.fit(frame.limit(0), labels).lexicon == {} and toxicity.fit(frame, labels.filter("toxic = 0")).lexicon == {}


def test_letters_are_counted_over_all_texts(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(["ab  ab!", None, "Äb", "", "ab cd" * 40])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def total():
        return {r["gram"]: r["n"] for r in toxicity.letter_counts(frame).collect()}

    whole, expected = total(), Counter()
    for _, t in rows:
        for w in re.findall("[a-zäA-ZÄ]+", t or ""):
            s = [0, 0, *(27 + 4 if c in "äÄ" else ord(c.lower()) - 96 for c in w), 0]
            expected.update((s[k] * 60 + s[k + 1]) * 60 + s[k + 2] for k in range(len(s) - 2))
    assert {g: n for g, n in whole.items() if g % 60 or g // 60 % 60} == dict(expected)


# ---- embeddings: keys ----------------------------------------------------------------------------------------------------------------------


def test_vectors_without_keys_or_with_shared_ones(spark):
    from narrata.llm import embedding_forest

    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(6, 16))
    near = lambda k, noise=0.02: [float(x) for x in base[k] + rnd.normal(size=16) * noise]
    rows = [(5, near(0)), (None, near(0)), (7, near(0)), (3, near(1)), (3, near(2)), (8, near(1)), (9, near(2)), (None, near(3)), (None, near(3)), (1, near(4)), (2, None), (4, [0.0] * 16)]
    rows.append((6, rows[0][1]))
    frame = spark.createDataFrame([(k, v, "clash", 1) for k, v in rows], "vec_id long, embedding array<double>, node string, weight int")
    unit = [None if v is None or not any(v) else np.array(v) / np.linalg.norm(v) for _, v in rows]
    expected = []
    for i, (k, _) in enumerate(rows):
        links = [j for j, u in enumerate(unit) if j != i and u is not None and unit[i] is not None and float(u @ unit[i]) >= 0.95]
        keys = [x for x in [k, *(rows[j][0] for j in links)] if x is not None]
        component = None if k is None else min(keys)
        expected.append((k, len(links), component, k is not None and k == component))
    got = [tuple(r) for r in embedding_forest.near_duplicates(frame).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
