"""Exports, splits of chapters, listings of files, keys, against cases worked out by hand."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from narrata.functions.offsets import put
from narrata.operators import revisions
from narrata.plans import book, chunks

ITEM = "book_id string, chapter_id long, ordinal long, kind string, present boolean"


def test_marks_of_an_export_round_halves_to_even(spark):
    items = spark.createDataFrame([("b", c, c * 10 + k, kind, c != 3 or k != 0) for c in (1, 2, 3, 4) for k, kind in enumerate(("tts", "silence", "tts"))] + [("none", 1, 0, "tts", False)], ITEM)
    durations = spark.createDataFrame([("b", 1, 0.0005, "a'1.wav"), ("b", 2, 0.0025, "a2.wav"), ("b", 3, 9.0, "a3.wav"), ("b", 4, 1.0, "a4.wav")], "book_id string, chapter_id long, seconds double, path string")
    titles = spark.createDataFrame([("b", 1, "One"), ("b", 2, "a=b"), ("b", 3, 'Left "out"'), ("none", 1, "x")], "book_id string, chapter_id long, title string")
    books = spark.createDataFrame([("b", "T;", "A", "d", "83"), ("none", "N", "A", "d", None)], "book_id string, title string, author string, description string, isbn string")
    places = [(r.chapter_id, r.title, r.total, r.start_ms, r.end_ms) for r in book.export_plan(items, durations, titles).orderBy("chapter_id").collect()]
    assert places == [(1, "One", 2, 0, 0), (2, "a=b", 2, 0, 2), (4, "", 2, 2, 1002)]
    got = {r.book_id: r for r in book.export_books(items, durations, titles, books).collect()}
    assert (got["b"].chapters, got["b"].error, got["b"].list) == (3, None, "file 'a'\\''1.wav'\nfile 'a2.wav'\nfile 'a4.wav'\n")
    assert json.loads(got["b"].report) == {"omitted": [{"number": 3, "title": 'Left "out"', "reason": "incomplete"}]}
    assert got["b"].metadata.startswith(";FFMETADATA1\ntitle=T\\;\nartist=A\n") and got["b"].metadata.endswith("START=2\nEND=1002\ntitle=\n") and "ISBN 83" in got["b"].metadata
    assert (got["none"].chapters, got["none"].error, got["none"].list, got["none"].metadata) == (0, "nothing_included", None, None)
    refused = {r.book_id: r for r in book.export_books(items, durations, titles, books, full=True).collect()}
    assert refused["b"].error == "missing_items" and refused["b"].list is None and len(json.loads(refused["b"].report)["omitted"]) == 1
    with pytest.raises(Exception, match="negative"):
        book.export_plan(items, durations.withColumn("seconds", -F.col("seconds")), titles).collect()


def test_chapters_are_split_with_their_rows(spark):
    chapters = spark.createDataFrame([("b", k, f"t{k}", o, k != 2, "x") for k, o in ((1, 0), (2, 1), (3, 2), (4, 3), (5, -1), (6, 4))], "book_id string, chapter_id long, title string, ordinal int, included boolean, href string")
    texts = {1: [("paragraph", "abcdef"), ("heading", " Head ")], 2: [("heading", "t2"), ("heading", "t2 rest"), ("paragraph", "p")], 3: [("paragraph", "p"), ("heading", "t3"), ("paragraph", "q")], 4: [("paragraph", "only")], 5: [("paragraph", "p"), ("paragraph", "q")], 6: [("paragraph", "p")]}
    blocks = spark.createDataFrame([("b", c, i, k, t) for c, rows in texts.items() for i, (k, t) in enumerate(rows)], "book_id string, chapter_id long, block_index int, kind string, text string")
    # Inside a paragraph, inside a heading, before a heading of the old title; with an empty side, of a removed chapter, outside the block.
    cuts = spark.createDataFrame([("b", 1, 0, 2, 11), ("b", 2, 1, 3, 12), ("b", 3, 1, 0, 13), ("b", 4, 0, 4, 14), ("b", 5, 1, 0, 15), ("b", 6, 0, 9, 16)], "book_id string, chapter_id long, at_block int, at_offset int, new_chapter_id long")
    rows, moved = revisions.split_chapters(chapters, blocks, cuts)
    got = sorted((r.ordinal, r.chapter_id, r.title, r.included) for r in rows.collect())
    assert got == [(-1, 5, "t5", True), (0, 1, "t1", True), (1, 11, "Head", True), (2, 2, "t2", False), (3, 12, "rest", False), (4, 3, "t3", True), (5, 13, "t3 (2)", True), (6, 4, "t4", True), (7, 6, "t6", True)]
    text = {}
    for r in sorted(moved.collect(), key=lambda r: (r.chapter_id, r.block_index)):
        text.setdefault(r.chapter_id, []).append((r.block_index, r.text))
    assert text[1] == [(0, "ab")] and text[11] == [(0, "cdef"), (1, " Head ")] and text[12] == [(0, "rest"), (1, "p")] and text[13] == [(0, "t3"), (1, "q")]
    assert text[4] == [(0, "only")] and text[5] == [(0, "p"), (1, "q")] and not {14, 15, 16} & set(text)


def test_chunks_are_reconciled_from_their_listing(spark, tmp_path):
    def put_file(name, size, sidecar):
        folder = tmp_path / name[:2]
        folder.mkdir(exist_ok=True)
        if size is not None:
            (folder / name).write_bytes(b"\0" * size)
        if sidecar is not None:
            (folder / f"{name.split('.')[0]}.json").write_text(sidecar if isinstance(sidecar, str) else json.dumps(sidecar))

    put_file("k1.wav", 144, {"size": 144, "duration_s": 1.0, "more": "x"})
    put_file("k2.wav", 144, {"size": 145, "duration_s": 1.0})
    put_file("k3.wav", 144, {"size": 144, "duration_s": 2.0})
    put_file("k4.wav", 144, None)
    put_file("k5.wav", None, {"size": 144, "duration_s": 1.0})
    put_file("k6.wav.part", 144, {"size": 144, "duration_s": 1.0})
    put_file("k7.wav", 144, "{broken")
    found = {r.render_key: (r.reusable, r.reason) for r in chunks.reconcile_folder(spark, str(tmp_path), 100).collect()}
    assert found == {"k1": (True, None), "k2": (False, "mismatch"), "k3": (False, "mismatch"), "k4": (False, "no_sidecar"), "k5": (False, "no_file"), "k6": (False, "no_file"), "k7": (False, "no_sidecar")}
    plan = chunks.listed_chunks(spark, str(tmp_path), 100)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_keys_do_not_depend_on_composition(spark):
    text = "Zażółć ś"
    rows = spark.createDataFrame([(unicodedata.normalize(f, text),) for f in ("NFC", "NFD")] + [(" \n" + text + " ",)], "text string")
    assert len({r[0] for r in rows.select(chunks.content_key(F.col("text"), slot=F.lit("x"))).collect()}) == 1


def test_put_replaces_as_from_right_to_left():
    rnd = random.Random(4)
    for _ in range(500):
        text = "".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, 20)))
        spans = sorted({(a, rnd.randint(a, len(text)), rnd.choice(["", "X", "YZ"])) for a in (rnd.randint(0, len(text)) for _ in range(rnd.randint(0, 4)))})
        expected = text
        for a, b, new in reversed(spans):
            expected = expected[:a] + new + expected[b:]
        assert put(text, spans) == expected
    many = [(3 * k, 3 * k + 1, "XX") for k in range(100_000)]
    assert put("abc" * 100_000, many) == "XXbc" * 100_000
