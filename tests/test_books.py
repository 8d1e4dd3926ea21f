"""Page blocks, applied suggestions, matching of edited blocks, the pre-pass and whole plans."""

import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from narrata import streaming
from narrata.operators import apply as A
from narrata.operators import associate
from narrata.operators import prepass as P
from narrata.operators import revisions as V
from narrata.operators.associate import associate_blocks, nearest
from narrata.operators.html_blocks import blocks_of, detect_format, resolve_href
from narrata.plans import book as B
from narrata.plans import chunks, jobs

BLOCK = "book_id string, chapter_id long, block_index int, text string"


def suggestion(kind, start, end, original, replacement="", **more):
    return {"kind": kind, "start": start, "end": end, "original": original, "replacement": replacement, "confidence": 0.9, "speaker_id": None, "segments": None, **more}


def test_blocks_of_pages():
    page = """<html><head><title>no</title></head><body><nav><p>menu</p></nav><h2>Head &amp; more</h2><p>one<br>two<p>three <b>four</b>
    <ul><li>a<li><p>b</p></ul><blockquote><p>said</p><ul><li>listed</li></ul></blockquote><blockquote>alone</blockquote><script>x<p>y</p></script>
    <img alt="pic"><img alt="none" role="presentation"><p>text<img alt="inside"></p><table><tr><td>cell<td><div>deep</div></table></body></html>"""
    assert [(k, level, path, t) for k, level, path, t in blocks_of(page)] == [
        ("heading", 2, "/html/body/h2[1]", "Head & more"), ("paragraph", None, "/html/body/p[1]", "one\ntwo"), ("paragraph", None, "/html/body/p[2]", "three four"),
        ("list_item", None, "/html/body/ul[1]/li[1]", "a"), ("paragraph", None, "/html/body/ul[1]/li[2]/p[1]", "b"), ("blockquote", None, "/html/body/blockquote[1]/p[1]", "said"),
        ("list_item", None, "/html/body/blockquote[1]/ul[1]/li[1]", "listed"), ("blockquote", None, "/html/body/blockquote[2]", "alone"), ("caption", None, "/html/body/img[1]", "pic"),
        ("paragraph", None, "/html/body/p[3]", "text"), ("paragraph", None, "/html/body/table[1]/tr[1]/td[1]", "cell"), ("paragraph", None, "/html/body/table[1]/tr[1]/td[2]", "deep"),
    ]
    assert blocks_of(None) == blocks_of("") == blocks_of("<!DOCTYPE x [<!ENTITY a 'b'>]><p>&a;</p>") == []
    assert len(blocks_of("<div><p>word" * 3000)) == 3000


def test_hrefs_and_formats(spark):
    cases = {("a/b", "../c.html#x"): "a/c.html", ("a", "../../c"): None, ("", "x?y"): "x", ("a", "/b/./c"): "b/c", ("a", "#x"): None, ("a", "b%20c"): "a/b c"}
    rows = spark.createDataFrame(list(cases), "base string, href string")
    assert {(r.base, r.href): r.p for r in rows.select("base", "href", resolve_href(F.col("base"), F.col("href")).alias("p")).collect()} == cases
    files = [("a.pdf", b"%PDF-1", "pdf", None), ("a.txt", b"\xef\xbb\xbf %PDF", "pdf", None), ("a.epub", b"PK\x03\x04", "epub", None), ("a.zip", b"PK\x03\x04....mimetypeapplication/epub+zip", "epub", None), ("a.zip", b"PK\x03\x04", None, "unknown"), ("a.epub", b"%PDF", None, "conflict"), ("b.AZW3", b"\0" * 60 + b"BOOKMOBI", "azw3", None), ("b", b"\0" * 60 + b"BOOKMOBI", "mobi", None)]
    table = spark.createDataFrame([(k, p, c) for k, (p, c, _, _) in enumerate(files)], "k int, path string, content binary")
    found = {r.k: tuple(r.f) for r in table.select("k", detect_format(F.col("path"), F.col("content")).alias("f")).collect()}
    assert found == {k: (f, e) for k, (_, _, f, e) in enumerate(files)}


def test_rewrites_shift_spans():
    text = "Zegar.  Było  18:00 i — Cześć — rzekł."
    marks = [{"kind": "narration", "start": 0, "end": 19}, {"kind": "dialogue", "start": 24, "end": 29}]
    asked = [
        suggestion("conversion_artifact", 6, 8, "  ", " "), suggestion("conversion_artifact", 12, 14, "  ", " "), suggestion("numeral", 14, 19, "18:00", "osiemnastej"),
        suggestion("acronym", 0, 5, "Zegar", "Z"), suggestion("skip", 5, 7, ". "), suggestion("dialogue_split", 0, len(text), text, segments=marks), suggestion("numeral", 1, 3, "xx"),
        suggestion("speaker_gender", 24, 29, "Cześć", "male", speaker_id="Jan"),
    ]
    done, spans, conflicts = A.apply(text, asked)
    assert done == "Zegar. Było 18:00 i — Cześć — rzekł."
    assert [(s[0], s[1], s[2], s[3]) for s in spans] == [(0, 5, "pronunciation", "Z"), (12, 17, "pronunciation", "osiemnastej")]
    assert sorted(c[0] for c in conflicts) == ["dialogue_split", "numeral", "skip"]
    marks[0] = {"kind": "narration", "start": 14, "end": 19}
    _, spans, _ = A.apply(text, asked)
    assert [s for s in spans if s[2] == "dialogue"] == [(22, 27, "dialogue", None, "male", 0.9, "Jan")]
    assert all(done[s[0] : s[1]] == "Cześć" for s in spans if s[2] == "dialogue")


def test_annotated_text():
    spans = [{"kind": "dialogue", "start": 0, "end": 5, "gender": "male"}, {"kind": "pronunciation", "start": 2, "end": 3, "spoken": 'x"'}, {"kind": "pause", "start": 5, "end": 5, "pause_ms": 3}, {"kind": "skip", "start": 3, "end": 9}]
    assert A.annotate("a<b c", spans) == '<span data-prl-kind="dialogue" data-prl-gender="male">a&lt;<span data-prl-kind="pronunciation" data-prl-spoken="x&quot;">b</span> c</span><span data-prl-pause="3"></span>'
    assert A.annotate("x\x01&y", []) == "x&amp;y"


def test_commit_of_suggestions(spark):
    blocks = spark.createDataFrame([("b", 1, 0, "a  b IT", 0, None), ("b", 1, 1, "c", 0, None)], BLOCK + ", valid_from int, valid_to int")
    asked = spark.createDataFrame([("b", 1, 0, "conversion_artifact", 1, 3, "  ", " ", 0.99), ("b", 1, 0, "acronym", 5, 7, "IT", "aj ti", 0.9), ("b", 1, 1, "acronym", 0, 1, "x", "y", 0.9)], "book_id string, chapter_id long, block_index int, kind string, start int, end int, original string, replacement string, confidence double")
    after, spans, conflicts = A.apply_and_commit(blocks, asked, 1, 0)
    assert sorted((r.text, r.valid_from, r.valid_to) for r in after.collect()) == [("a  b IT", 0, 1), ("a b IT", 1, None), ("c", 0, None)]
    assert [(r.start, r.end, r.spoken) for r in spans.collect()] == [(4, 6, "aj ti")]
    assert [(r.block_index, r.original) for r in conflicts.collect()] == [(1, "x")]


def test_blocks_are_read_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def job(texts):
        calls.add(len(texts))
        return texts

    rows = [("b", 1, k, "a  b IT", 0, None) for k in range(20)]
    blocks = spark.createDataFrame(rows, BLOCK + ", valid_from int, valid_to int")
    asked = spark.createDataFrame([("b", 1, k, "conversion_artifact", 1, 3, "  ", " ", 0.99) for k in range(20)], "book_id string, chapter_id long, block_index int, kind string, start int, end int, original string, replacement string, confidence double")
    read = lambda f, c: f.withColumn(c, F.arrow_udf(job, "string")(F.col(c)))
    after = A.apply_and_commit(read(blocks, "text"), asked, 1, 0)[0].collect()
    assert sorted((r.text, r.valid_from, r.valid_to) for r in after) == [("a  b IT", 0, 1)] * 20 + [("a b IT", 1, None)] * 20
    assert calls.value == 20
    found = V.conflicts(asked, read(blocks.withColumn("text", F.when(F.col("block_index") > 1, F.concat(F.lit("x"), "text")).when(F.col("block_index") == 1, F.col("text"))), "text")).collect()
    assert sorted(r.block_index for r in found) == list(range(2, 20))
    assert calls.value == 40


def brute(old, new):
    scored = sorted(((SequenceMatcher(None, o, n, autojunk=False).ratio(), -abs(i - j), -j, i, j) for i, n in enumerate(new) for j, o in enumerate(old)), reverse=True)
    place = {}
    for ratio, _, _, i, j in scored:
        if ratio >= 0.6 and i not in place and j not in place.values():
            place[i] = j
    return [place.get(i) for i in range(len(new))]


def test_edited_blocks_keep_their_place(spark):
    old = ["the first block", "second one here", "same", "same", "a long block that is split later", "gone"]
    new = ["the first blocks", "same", "a quite new text", "second one there", "same", "a long block that is"]
    rows = lambda texts: spark.createDataFrame([("b", 1, k, t) for k, t in enumerate(texts)], BLOCK)
    found = {r.block_index: r.old_index for r in associate_blocks(rows(old), rows(new)).collect()}
    assert [found[k] for k in range(len(new))] == brute(old, new)


def test_prepass_resolves_detectors(spark):
    texts = ["Copyright IT 2001", "— Nie  teraz — powiedziała IT o 18:00.", "Walker ma 3 koty", "the end"]
    blocks = spark.createDataFrame([("b", 1, k, t) for k, t in enumerate(texts)], BLOCK)
    rules = spark.createDataFrame([("3 koty", "trzy koty", False, False, True, 1, "global", 0)], "pattern string, spoken string, is_regex boolean, case_sensitive boolean, auto boolean, priority int, scope string, place int")
    found = sorted((r.block_index, r.kind, r.original, r.reason) for r in P.prepass(blocks, rules=rules).collect())
    assert found == [
        (0, "skip", texts[0], "copyright"), (1, "acronym", "IT", "acronym"), (1, "conversion_artifact", "  ", "whitespace"), (1, "dialogue_split", texts[1], "dialogue"),
        (1, "numeral", "18:00", "clock"), (1, "speaker_gender", "Nie  teraz", "verb_suffix"), (2, "dict_hit", "3 koty", "dict_auto"), (2, "foreign_word", "Walker", "english_word"), (3, "foreign_word", "the", "english_orthography"),
    ]


def test_prepass_reads_a_block_once(spark):
    """One function gives a block's rows from its text; a block of a book without a key is skipped and has lexicon hits as any other."""
    texts = ["Copyright 2001", "Spis treści", *"abcdef", "the 3 koty"]
    blocks = spark.createDataFrame([(None, 1, k, t) for k, t in enumerate(texts)], BLOCK)
    rules = spark.createDataFrame([("3 koty", "trzy koty", False, False, True, 1, "global", 0)], "pattern string, spoken string, is_regex boolean, case_sensitive boolean, auto boolean, priority int, scope string, place int")
    found = P.prepass(blocks, rules=rules)
    assert sorted((r.block_index, r.kind, r.reason) for r in found.collect()) == [(0, "skip", "copyright"), *((k, "skip", "toc") for k in range(1, 9)), (8, "skip", "toc")][:9]
    # One pass for the detectors, one for the speakers.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2


def test_prepass_with_a_lexicon_that_is_joined(spark, monkeypatch):
    """A lexicon too large for a task says the same, also to a book without a key."""
    blocks = spark.createDataFrame([(b, 1, k, t) for b in ("b", None) for k, t in enumerate(["the 3 koty i IT", "Copyright 3 koty", "the end", None])], BLOCK)
    rules = spark.createDataFrame([("3 koty", "trzy koty", False, False, True, 1, "global", 0), ("it", "aj ti", False, False, False, 2, "global", 1)], "pattern string, spoken string, is_regex boolean, case_sensitive boolean, auto boolean, priority int, scope string, place int")
    rows = lambda: sorted(map(repr, P.prepass(blocks, rules=rules).collect()))
    few = rows()
    monkeypatch.setattr(P.lexicon, "BROADCAST_RULES", 0)
    assert sum("dict_hit" in r for r in few) == 4
    many = rows()
    # The join of the lexicon itself groups by the block's key, and an unknown one is a key too.
    assert many == few


def test_suggestions_in_order_are_dealt_by_chapter(spark):
    """A book's suggestions do not all go to one task."""
    rows = spark.range(4000).select(F.lit("b").alias("book_id"), (F.col("id") % 40).alias("chapter_id"), (F.col("id") % 7).cast("int").alias("block_index"), F.col("id").cast("int").alias("start"), F.col("id").cast("int").alias("end"), F.lit("k").alias("kind"), F.lit("r").alias("reason"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = P.in_order(rows).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in found}) == 4 and len({(r.part, r.chapter_id) for r in found}) == 40
    by_part = {p: [(r.chapter_id, r.block_index, r.start) for r in found if r.part == p] for p in range(4)}
    assert all(rows == sorted(rows) for rows in by_part.values())


def test_prepass_gives_its_suggestions_in_order(spark):
    """The last step of the pre-pass: by block, start, end, kind and reason within a chapter, as they come from its partition."""
    texts = ["— Nie  teraz — powiedziała IT o 18:00.", "Walker ma 3 koty", "Copyright IT 2001", "the  NATO end"]
    blocks = spark.createDataFrame([("b", c, k, t) for c in range(6) for k, t in enumerate(texts)], BLOCK)
    rules = spark.createDataFrame([("3 koty", "trzy koty", False, False, True, 1, "global", 0)], "pattern string, spoken string, is_regex boolean, case_sensitive boolean, auto boolean, priority int, scope string, place int")
    found = P.prepass(blocks, rules=rules).withColumn("part", F.spark_partition_id()).collect()
    assert len({(r.part, r.chapter_id) for r in found}) == 6
    for c in range(6):
        rows = [(r.block_index, r.start, r.end, r.kind, r.reason) for r in found if r.chapter_id == c]
        assert rows == sorted(rows) and {r[3] for r in rows} >= {"dialogue_split", "speaker_gender", "numeral", "acronym", "skip", "dict_hit", "foreign_word", "conversion_artifact"}


def test_plan_of_a_book(spark):
    spans = "array<struct<kind:string,gender:string,spoken:string,start:int,end:int>>"
    rows = [("b", 1, 0, "Raz. Dwa. Trzy.", []), ("b", 1, 1, "A rzekł IT", [("dialogue", "male", None, 0, 1), ("pronunciation", None, "aj ti", 8, 10)]), ("b", 2, 0, "Raz. Dwa. Trzy.", [])]
    blocks = spark.createDataFrame(rows, BLOCK + f", spans {spans}")
    filled = spark.createDataFrame([("b", "narrator"), ("b", "male")], "book_id string, slot string")
    profiles = spark.createDataFrame([("b", "narrator", "p", "h")], "book_id string, slot string, profile_id string, content_hash string")
    plan = B.plan_book(blocks, filled, profiles, 10, {"model": "1"}).orderBy("ordinal").collect()
    assert [(r.ordinal, r.slot, r.spoken, r.reused) for r in plan] == [(0, "narrator", "Raz. Dwa.", False), (1, "narrator", "Trzy.", False), (2, "male", "A", False), (3, "narrator", "rzekł aj", False), (4, "narrator", "ti", False), (5, "narrator", "Raz. Dwa.", True), (6, "narrator", "Trzy.", True)]


def test_plan_makes_pieces_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def segment(text):
        calls.add(1)
        return [(0, len(text))]

    rows = [("b", c, k, f"{c} {k}", [(4, 4, "pause")]) for c in range(4) for k in range(5)] + [("none", 1, 0, "x", [])]
    blocks = spark.createDataFrame(rows, BLOCK + ", spans array<struct<start:int,end:int,kind:string>>")
    blocks = blocks.withColumn("spans", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), F.lit(None).cast("string").alias("gender"), F.lit(None).cast("string").alias("spoken"), s["start"].alias("start"), (s["end"] + 1).alias("end"))))
    filled = spark.createDataFrame([("b", "narrator"), ("none", "male")], "book_id string, slot string")
    profiles = spark.createDataFrame([], "book_id string, slot string, profile_id string, content_hash string")
    plan = B.plan_book(blocks, filled, profiles, 10, {"model": "1"}, segment=segment).orderBy("ordinal").collect()
    assert [(r.ordinal, r.kind, r.spoken, r.reused) for r in plan] == [(2 * (5 * c + k) + silent, "silence" if silent else "tts", "" if silent else f"{c} {k}", bool(silent) and (c, k) != (0, 0)) for c in range(4) for k in range(5) for silent in (0, 1)]
    assert calls.value == 20


def test_keys_do_not_collide(spark):
    rows = spark.createDataFrame([("t", None, "a"), ("t", "a", None), ("t", "a|b", "c"), ("t", "a", "b|c"), (" t\n", None, "a")], "t string, a string, b string")
    keys = [r.k for r in rows.select(chunks.content_key(F.col("t"), a=F.col("a"), b=F.col("b")).alias("k")).collect()]
    assert keys[0] == keys[4] and len(set(keys)) == 4


def test_ingest_refuses_edited_books(spark):
    pages = spark.createDataFrame([("b", 1, "text/one.xhtml", "<h1>One</h1><p>x</p>"), ("b", 2, "text/two.xhtml", "<p>y</p>")], "book_id string, chapter_id long, href string, html string")
    chapters, blocks = B.ingest(pages)
    assert sorted((r.ordinal, r.title) for r in chapters.collect()) == [(0, "One"), (1, "two")]
    assert sorted((r.chapter_id, r.text, r.valid_from) for r in blocks.collect()) == [(1, "One", 0), (1, "x", 0), (2, "y", 0)]
    with pytest.raises(ValueError, match="edited"):
        B.ingest(pages, blocks.withColumn("valid_from", F.lit(1)))


def test_progress_stream_is_the_batch(spark, tmp_path):
    schema = "job_id long, seq long, chars int, duration_s double, wall_s double"
    rows = [(k % 2, k, 10 + k, 1.0 + k % 5 if k % 7 else 0.0, 2.0 + k % 3) for k in range(40)]
    for part in (rows[:17], rows[17:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streaming.progress(stream).writeStream.format("memory").queryName("averages").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    last = {r.job_id: r for r in spark.table("averages").orderBy("samples").collect()}
    for r in jobs.progress(spark.createDataFrame(rows, schema), 100).collect():
        assert last[r.job_id].samples == r.samples
        assert abs(last[r.job_id].throughput - r.throughput) < 1e-9
        assert abs(last[r.job_id].chars_per_audio_s - r.chars_per_audio_s) < 1e-9


def test_equal_blocks_are_paired_nearest_first():
    rnd = random.Random(12)
    for _ in range(300):
        olds, news = sorted(rnd.sample(range(40), rnd.randint(0, 9))), sorted(rnd.sample(range(40), rnd.randint(0, 9)))
        # An equal text at the same place was paired before.
        news = [n for n in news if n not in olds]
        expected, done = {}, set()
        for _, o, n in sorted((abs(n - o), o, -n) for n in news for o in olds):
            if -n not in expected and o not in done:
                expected[-n] = o
                done.add(o)
        assert dict(nearest(olds, news)) == expected
    assert len(nearest(list(range(0, 40_000, 2)), list(range(1, 40_000, 2)))) == 20_000


def _all_compared(old, new):
    """The pairs by the likeness of each old with each new block."""
    scored = []
    for n, wanted in new:
        for o, text in old:
            ratio = SequenceMatcher(None, text, wanted, autojunk=False).ratio()
            if ratio >= associate.LEAST:
                scored.append((ratio, -abs(n - o), -o, n, o))
    news, olds, out = set(), set(), []
    for *_, n, o in sorted(scored, reverse=True):
        if n not in news and o not in olds:
            news.add(n)
            olds.add(o)
            out.append((n, o))
    return out


def test_edited_blocks_pair_as_if_all_were_compared(monkeypatch):
    rnd = random.Random(11)
    text = lambda: "".join(rnd.choice("ab cé") for _ in range(rnd.randrange(14)))
    for wide in (0, 20, associate.WIDE):
        monkeypatch.setattr(associate, "WIDE", wide)
        for _ in range(150):
            a, b = text() * rnd.randrange(1, 3), text() * rnd.randrange(1, 3)
            assert associate.likeness(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio()
            old, new = ([(k, text()) for k in rnd.sample(range(30), rnd.randrange(9))] for _ in range(2))
            assert associate._pairs(old, new) == _all_compared(old, new)


def test_what_an_edited_block_is_not_like_is_not_compared(monkeypatch):
    """60 edited blocks among 60: one likeness for each, not 3,600, and long blocks in time that does not grow with the square."""
    rnd, seen, words = random.Random(12), [], [f"{a}{b}{c}" for a in "bdkl" for b in "aeio" for c in "mnrst"]
    ours = associate.likeness
    monkeypatch.setattr(associate, "likeness", lambda a, b: seen.append(1) or ours(a, b))
    old = [(k, " ".join(rnd.choice(words) for _ in range(60))) for k in range(60)]
    assert sorted(associate._pairs(old, [(k, t[:90] + "zz" + t[100:]) for k, t in old])) == [(k, k) for k in range(60)]
    assert len(seen) < 200
    long = " ".join(rnd.choice(words) for _ in range(6_000))
    began = time.monotonic()
    assert associate._pairs([(0, long)], [(0, long[:9_000] + "zz" + long[9_000:])]) == [(0, 0)] and time.monotonic() - began < 5


def test_long_common_parts_are_found_as_strings(monkeypatch):
    """Blocks of one edit are compared by a few searches, not letter by letter; periodic texts, and those with nothing long in common, as before."""
    rnd = random.Random(13)
    for part in (1, 2, associate.PART):
        monkeypatch.setattr(associate, "PART", part)
        for _ in range(400):
            letters = rnd.choice(["a", "ab", "abcdefgh é"])
            text = lambda n: "".join(rnd.choice(letters) for _ in range(rnd.randrange(n)))  # noqa: B023, E731
            a, k = text(60), rnd.randrange(60)
            b = rnd.choice([text(60), a[:k] + text(5) + a[k + rnd.randrange(4) :]])
            assert associate.likeness(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio()
    # Neither the longest part, nor what is left beside it, is looked for letter by letter.
    monkeypatch.setattr(associate, "_longest", None)
    monkeypatch.setattr(associate, "SequenceMatcher", None)
    words = [f"{a}{b}{c}" for a in "bdkl" for b in "aeio" for c in "mnrst"]
    old = [(k, " ".join(rnd.choice(words) for _ in range(120))) for k in range(20)]
    assert sorted(associate._pairs(old, [(k, f"{t[:90]}z{t[91:300]}z{t[301:]}") for k, t in old])) == [(k, k) for k in range(20)]


def test_blocks_of_both_sides_are_dealt_together(spark):
    """No join of the texts; a book without a key, a block without a text and repeated blocks are as they were."""
    rows = [("b", 1, 0, "same"), ("b", 1, 1, "a block that is edited"), (None, 1, 0, "no key"), ("b", 2, 0, None), ("b", 3, 0, "twice"), ("b", 3, 0, "twice")]
    old = spark.createDataFrame(rows, BLOCK)
    new = spark.createDataFrame([(*r[:3], r[3] and r[3].replace("edited", "changed")) for r in rows[:5]], BLOCK)
    found = associate_blocks(old, new)
    assert sorted(map(str, ((r.book_id, r.chapter_id, r.block_index, r.old_index) for r in found.collect()))) == sorted(
        map(str, [("b", 1, 0, 0), ("b", 1, 1, 1), (None, 1, 0, 0), ("b", 2, 0, 0), ("b", 3, 0, 0), ("b", 3, 0, 0)])
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 2
