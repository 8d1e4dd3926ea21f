"""Plans, jobs and revisions on small tables."""

from pyspark.sql import functions as F

from narrata.catalog.jobs import QUERIES
from narrata.operators import revisions as V
from narrata.plans import chunks, export, jobs, voices

SPANS = "array<struct<kind:string,gender:string,spoken:string,start:int,end:int>>"


def test_tiles_cover_the_block(spark):
    rows = [("abcdefghij", [("dialogue", "male", None, 2, 6), ("pause", None, None, 4, 8)]), ("abc", []), ("", [])]
    out = spark.createDataFrame(rows, f"text string, spans {SPANS}").select(voices.tile(F.col("text"), F.col("spans")).alias("t")).collect()
    assert [(t.kind, t.start, t.end) for t in out[0].t] == [("narration", 0, 2), ("dialogue", 2, 6), ("pause", 6, 8), ("narration", 8, 10)]
    assert [(t.kind, t.start, t.end) for t in out[1].t] == [("narration", 0, 3)]
    assert out[2].t == []


def test_spoken_form(spark):
    rows = [("abcdefghij", [("pronunciation", None, "XX", 1, 3), ("skip", None, None, 5, 7), ("pronunciation", None, "!", 9, 99)])]
    out = spark.createDataFrame(rows, f"text string, spans {SPANS}").select(voices.spoken_form(F.col("text"), F.col("spans")).alias("t")).first()
    assert out.t == "aXXdehij"


def test_jobs_follow_the_diagram(spark):
    log = [(1, 1, "record", "start"), (1, 2, "record", "pause"), (1, 3, "record", "rendered"), (1, 2000, "record", "resume"), (1, 2001, "record", "rendered"), (2, 1, "prep", "start"), (2, 2, "prep", "rendered"), (2, 3, "prep", "start"), (3, 1, "prep", "nonsense")]
    rows = {r.job_id: r for r in jobs.fold_states(spark.createDataFrame(log, "job_id int, seq long, kind string, event string")).collect()}
    assert (rows[1].state, rows[1].illegal) == ("muxing", 1)
    assert (rows[2].state, rows[2].illegal) == ("done", 1)
    assert (rows[3].state, rows[3].illegal) == ("queued", 1)


def test_progress_is_the_recurrence(spark):
    data = [(1, k * 700, 10 * k, float(k), 2.0) for k in range(1, 6)] + [(1, 5000, 1, 0.0, 1.0)]
    row = jobs.progress(spark.createDataFrame(data, "job_id int, seq long, chars int, duration_s double, wall_s double"), 100).first()
    rate, chars = None, 14.0
    for _, _, c, d, w in data[:-1]:
        rate = d / w if rate is None else 0.2 * d / w + 0.8 * rate
        chars = 0.2 * c / d + 0.8 * chars
    assert abs(row.throughput - rate) < 1e-9
    assert abs(row.chars_per_audio_s - chars) < 1e-9
    assert abs(row.eta_s - 100 / chars / rate) < 1e-9


def test_pause_and_resume(spark):
    values = [9.0, 1.0, 9.0, 9.0, None, 9.0, 1.0]
    rows = jobs.pauses(spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "job_id int, seq int, value double"), 5.0).orderBy("seq").collect()
    assert [r.paused for r in rows] == [False, True, True, True, False, False, True]
    assert [r.resumed_now for r in rows] == [False, False, False, False, True, False, False]


def test_marks_round_half_to_even(spark):
    rows = export.marks(spark.createDataFrame([("b", 1, "x", 0.0005), ("b", 2, "y", 0.0015), ("b", 3, "z", 1.0)], "book_id string, number int, title string, duration_s double")).orderBy("number").collect()
    assert [(r.start_ms, r.end_ms) for r in rows] == [(0, 0), (0, 2), (2, 1002)]


def test_commit_and_snapshot(spark):
    blocks = spark.createDataFrame([("b", 1, 0, "old", 0, None), ("b", 1, 1, "same", 0, None)], "book_id string, chapter_id int, block_index int, text string, valid_from int, valid_to int")
    changes = spark.createDataFrame([("b", 1, 0, "new"), ("b", 1, 1, "same"), ("b", 1, 2, "more")], "book_id string, chapter_id int, block_index int, text string")
    after = V.commit(blocks, changes, 1, 0)
    assert sorted(r.text for r in V.as_of(after, 0).collect()) == ["old", "same"]
    assert sorted(r.text for r in V.current(after).collect()) == ["more", "new", "same"]


def test_ordinals_run_over_chapters(spark):
    rows = chunks.number_items(spark.createDataFrame([("b", c, r, 0) for c in (1, 2) for r in range(3)], "book_id string, chapter_id int, run int, piece int")).collect()
    assert sorted((r.ordinal, r.chapter_id, r.run) for r in rows) == [(c * 3 + r - 3, c, r) for c in (1, 2) for r in range(3)]


def test_conflicts_count_every_event_of_a_job(spark, tmp_path):
    """A job that starts is active whatever the number of its event."""
    rows = [(seq, "2026-01-01 00:00:00", job, "view", 1.0, "{}") for seq, job in ((5, 10), (6, 20), (7, 31))]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["active_job_conflicts"](spark, str(tmp_path)).collect()] == [(0, 2)]
