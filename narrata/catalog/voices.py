"""Queries over conversations as spoken runs, and over plan items and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.catalog.base import KEY, LINES, lines, table
from narrata.catalog.jobs import ITEMS, items
from narrata.plans import chunks as C
from narrata.plans import voices as V

SPANS = "array<struct<kind:string,gender:string,spoken:string,start:int,end:int>>"


def spanned(spark, sf_dir):
    """Lines of 20 characters or more with spans planted by their length n."""
    n = "length(text)"
    spans = f"""array(
      named_struct('kind', 'dialogue', 'gender', if({n} % 2 = 0, 'male', 'female'), 'spoken', null, 'start', 5, 'end', {n} div 2),
      named_struct('kind', 'pause', 'gender', null, 'spoken', null, 'start', {n} div 2 - 2, 'end', {n} div 2 + 3),
      named_struct('kind', 'pronunciation', 'gender', null, 'spoken', 'X', 'start', 6, 'end', 8),
      named_struct('kind', 'skip', 'gender', null, 'spoken', null, 'start', {n} - 4, 'end', {n} - 1))"""
    return lines(spark, sf_dir).filter(f"{n} >= 20").withColumn("spans", F.expr(spans).cast(SPANS))


SPANNED = f"SELECT *, length(text) AS n, length(text) // 2 AS h FROM ({LINES}) WHERE length(text) >= 20"
TILES_SQL = f"""
SELECT {KEY}, kind, gender, s::INTEGER AS start, e::INTEGER AS "end" FROM (
  SELECT {KEY}, 'narration' AS kind, NULL AS gender, 0 AS s, 5 AS e FROM ({SPANNED})
  UNION ALL SELECT {KEY}, 'dialogue', CASE WHEN n % 2 = 0 THEN 'male' ELSE 'female' END, 5, h FROM ({SPANNED})
  UNION ALL SELECT {KEY}, 'pause', NULL, h, h + 3 FROM ({SPANNED})
  UNION ALL SELECT {KEY}, 'narration', NULL, h + 3, n FROM ({SPANNED}) WHERE h + 3 < n)
"""


def tiles(spark, sf_dir):
    rows = spanned(spark, sf_dir)
    return rows.select("book_id", "chapter_id", "block_index", F.explode(V.tile(F.col("text"), F.col("spans"))).alias("t")).select("book_id", "chapter_id", "block_index", "t.kind", "t.gender", "t.start", "t.end")


def overlay(spark, sf_dir):
    marks = spanned(spark, sf_dir).select("book_id", "chapter_id", "block_index", F.explode("spans").alias("s")).select("book_id", "chapter_id", "block_index", "s.kind", "s.start", "s.end")
    return V.overlays(tiles(spark, sf_dir), marks)


def segments(spark, sf_dir):
    """Spoken text of each tile: the overlays inside it applied, stripped, empty ones dropped."""
    t = spanned(spark, sf_dir)
    rows = t.select("book_id", "chapter_id", "block_index", "text", "spans", F.explode(V.tile(F.col("text"), F.col("spans"))).alias("t"))
    inside = F.expr("transform(filter(spans, s -> s.kind IN ('pronunciation', 'skip') AND s.start >= t.start AND s.end <= t.end), s -> named_struct('kind', s.kind, 'gender', s.gender, 'spoken', s.spoken, 'start', s.start - t.start, 'end', s.end - t.start))")
    rows = rows.withColumn("part", F.expr("substring(text, t.start + 1, t.end - t.start)")).withColumn("inside", inside)
    said = rows.filter("t.kind <> 'pause'").withColumn("spoken", F.trim(V.spoken_form(F.col("part"), F.col("inside"))))
    return said.filter("spoken <> ''").select("book_id", "chapter_id", "block_index", F.col("t.start").alias("start"), "spoken")


def _segment(condition: str, a: str, b: str) -> str:
    inner = f"""CASE WHEN {a} <= 6 AND 8 <= {b} THEN substring(text, {a} + 1, 6 - {a}) || 'X' || substring(text, 9, {b} - 8)
      WHEN {a} <= n - 4 AND n - 1 <= {b} THEN substring(text, {a} + 1, n - 4 - {a}) || substring(text, n, {b} - n + 1) ELSE substring(text, {a} + 1, {b} - {a}) END"""
    return f"SELECT {KEY}, ({a})::INTEGER AS start, trim({inner}) AS spoken FROM ({SPANNED}) WHERE {condition}"


SEGMENTS_SQL = f"SELECT * FROM ({_segment('true', '0', '5')} UNION ALL {_segment('true', '5', 'h')} UNION ALL {_segment('h + 3 < n', '(h + 3)', 'n')}) WHERE spoken <> ''"


def turns(spark, sf_dir):
    """Turns of conversations: the user speaks as a woman or a man by the conversation's number."""
    rows = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "narration").otherwise("dialogue")
    return rows.select(
        (F.col("conv_id") % 7).alias("book_id"), F.col("conv_id").alias("chapter_id"), F.col("turn").alias("position"), kind.alias("kind"),
        F.when(F.col("conv_id") % 2 == 0, "male").otherwise("female").alias("gender"), "text",
    )


TURNS = "SELECT conv_id % 7 AS book_id, conv_id AS chapter_id, turn AS position, CASE role WHEN 'assistant' THEN 'narration' ELSE 'dialogue' END AS kind, CASE WHEN conv_id % 2 = 0 THEN 'male' ELSE 'female' END AS gender, text FROM conversations"


def filled(spark, sf_dir):
    """Voices: suppliers give book s the slots of its number."""
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7).alias("book_id"), F.element_at(F.array(*map(F.lit, ("narrator", "male", "female"))), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("slot"), F.col("s_name").alias("profile_id"))
    return rows.filter("NOT (book_id = 3 AND slot = 'male') AND NOT (book_id = 4 AND slot = 'narrator')")


FILLED = "SELECT * FROM (SELECT s_suppkey % 7 AS book_id, ['narrator', 'male', 'female'][s_suppkey % 3 + 1] AS slot, s_name AS profile_id FROM supplier) WHERE NOT (book_id = 3 AND slot = 'male') AND NOT (book_id = 4 AND slot = 'narrator')"
ASSIGN_SQL = f"""
WITH f AS (SELECT DISTINCT book_id, slot FROM ({FILLED})), w AS (SELECT *, CASE WHEN kind = 'dialogue' THEN gender ELSE 'narrator' END AS wanted FROM ({TURNS}))
SELECT book_id, chapter_id, position, kind, gender, text, CASE WHEN n.slot IS NULL THEN NULL WHEN x.slot IS NOT NULL THEN wanted ELSE 'narrator' END AS slot,
  CASE WHEN n.slot IS NULL THEN 'slot_missing_narrator' WHEN x.slot IS NULL THEN 'slot_missing_' || wanted END AS warning
FROM w LEFT JOIN f n USING (book_id) LEFT JOIN f x ON x.book_id = w.book_id AND x.slot = wanted WHERE n.slot = 'narrator' OR NOT EXISTS (SELECT 1 FROM f WHERE f.book_id = w.book_id AND f.slot = 'narrator')
"""
ASSIGN_SQL = ASSIGN_SQL.replace("LEFT JOIN f n USING (book_id)", "LEFT JOIN f n ON n.book_id = w.book_id AND n.slot = 'narrator'").replace("SELECT book_id, chapter_id, position", "SELECT w.book_id, chapter_id, position").split("WHERE n.slot = 'narrator'")[0]


def assigned(spark, sf_dir):
    return V.assign_slots(turns(spark, sf_dir), filled(spark, sf_dir))


def best_profiles(spark, sf_dir):
    return filled(spark, sf_dir).groupBy("book_id", "slot").agg(F.min("profile_id").alias("profile_id")).withColumn("content_hash", F.sha2("profile_id", 256))


RUNS_SQL = f"""
WITH a AS ({ASSIGN_SQL}), f AS (SELECT *, CASE WHEN slot IS NOT DISTINCT FROM lag(slot) OVER w AND lag(position) OVER w IS NOT NULL AND slot IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM a WHERE slot IS NOT NULL WINDOW w AS (PARTITION BY book_id, chapter_id ORDER BY position)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY book_id, chapter_id ORDER BY position) - 1 AS run FROM f)
SELECT book_id, chapter_id, run::INTEGER AS run, any_value(slot) AS slot, 'tts' AS kind, string_agg(text, ' ' ORDER BY position) AS text, count(*) AS parts FROM r GROUP BY book_id, chapter_id, run
"""


def runs(spark, sf_dir):
    return V.merge_runs(assigned(spark, sf_dir).filter("slot IS NOT NULL").withColumn("kind", F.lit("tts")))


def keyed(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("render_key", C.content_key(F.col("part").cast("string"), slot=F.lit("narrator"), profile=F.col("number") % 4))
    return rows.withColumn("position", F.col("ordinal")).withColumn("ordinal", F.col("number") * 10 + F.col("ordinal")).select("book_id", "number", "ordinal", "kind", "present", "render_key", "part", "q")


KEYED = f"""SELECT book_id, number, number * 10 + ordinal AS ordinal, kind, present, substring(sha256('{{"version":"2","text":"' || sha256(part::VARCHAR) || '","profile":"' || number % 4 || '","slot":"narrator"}}'), 1, 32) AS render_key, part, q FROM ({ITEMS})"""


def files(spark, sf_dir):
    return keyed(spark, sf_dir).filter("part % 5 <> 0").groupBy("render_key").agg(F.min("part").alias("file_size"), (F.min("part") / 7).alias("file_duration_s"))


def sidecars(spark, sf_dir):
    return keyed(spark, sf_dir).filter("part % 4 <> 0").groupBy("render_key").agg((F.min("part") + F.when(F.min("part") % 9 == 0, 1).otherwise(0)).alias("size"), (F.min("part") / 7).alias("duration_s"))


FILES = f"SELECT render_key, min(part) AS file_size, min(part) / 7.0::DOUBLE AS file_duration_s FROM ({KEYED}) WHERE part % 5 <> 0 GROUP BY render_key"
SIDECARS = f"SELECT render_key, min(part) + CASE WHEN min(part) % 9 = 0 THEN 1 ELSE 0 END AS size, min(part) / 7.0::DOUBLE AS duration_s FROM ({KEYED}) WHERE part % 4 <> 0 GROUP BY render_key"
RECONCILE_SQL = f"""SELECT render_key, r IS NULL AS reusable, r AS reason FROM (SELECT render_key, CASE WHEN file_size IS NULL THEN 'no_file' WHEN size IS NULL THEN 'no_sidecar'
  WHEN file_size <> size OR file_duration_s <> duration_s THEN 'mismatch' END AS r FROM ({FILES}) FULL JOIN ({SIDECARS}) USING (render_key))"""


def numbered(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumn("piece", F.lit(0))
    return C.number_items(rows).select("book_id", "chapter_id", "run", "ordinal")


QUERIES = {
    "tile_block": tiles,
    "overlay_in_segment": overlay,
    "spoken_segments": segments,
    "spoken_form": lambda s, d: spanned(s, d).select("book_id", "chapter_id", "block_index", V.spoken_form(F.col("text"), F.col("spans")).alias("text")),
    "assign_voice_slot": assigned,
    "slot_warnings": lambda s, d: assigned(s, d).filter("warning IS NOT NULL").select("book_id", "warning").distinct(),
    "voice_profile_lookup": lambda s, d: V.lookup_profiles(assigned(s, d).filter("slot IS NOT NULL").select("book_id", "chapter_id", "position", "slot"), best_profiles(s, d)),
    "slot_conflicts": lambda s, d: V.slot_conflicts(filled(s, d)),
    "merge_runs": runs,
    "plan_ordinals": numbered,
    "estimate_seconds": lambda s, d: runs(s, d).select("book_id", "chapter_id", "run", F.round(C.estimate_seconds(F.col("text")), 6).alias("seconds")),
    "render_key": lambda s, d: keyed(s, d).select("book_id", "ordinal", "render_key"),
    "dedupe_renders": lambda s, d: C.dedupe_renders(keyed(s, d)).select("book_id", "ordinal", "render_key", "reused"),
    "reuse_split": lambda s, d: C.reuse_split(keyed(s, d), files(s, d).join(sidecars(s, d), "render_key")).select("book_id", "ordinal", "render_key", "reusable"),
    "reconcile_chunks": lambda s, d: C.reconcile(files(s, d), sidecars(s, d)),
    "plan_diff": lambda s, d: C.plan_diff(keyed(s, d).filter("number % 3 <> 0"), keyed(s, d).filter("number % 3 <> 1")),
    "resume_cursor": lambda s, d: C.resume_cursor(keyed(s, d)),
    "job_counts": lambda s, d: C.job_counts(C.dedupe_renders(keyed(s, d))),
}

SQL = {
    "tile_block": TILES_SQL,
    "overlay_in_segment": f"""SELECT t.book_id, t.chapter_id, t.block_index, t.start AS tile_start, (m.s - t.start)::INTEGER AS start, (m.e - t.start)::INTEGER AS "end", m.kind FROM ({TILES_SQL}) t JOIN
      (SELECT {KEY}, 'pronunciation' AS kind, 6 AS s, 8 AS e FROM ({SPANNED}) UNION ALL SELECT {KEY}, 'skip', n - 4, n - 1 FROM ({SPANNED})) m
      ON t.book_id = m.book_id AND t.chapter_id = m.chapter_id AND t.block_index = m.block_index AND m.s >= t.start AND m.e <= t."end" """,
    "spoken_segments": SEGMENTS_SQL,
    "spoken_form": f"SELECT {KEY}, substring(text, 1, 6) || 'X' || substring(text, 9, n - 12) || substring(text, n) AS text FROM ({SPANNED})",
    "assign_voice_slot": ASSIGN_SQL,
    "slot_warnings": f"SELECT DISTINCT book_id, warning FROM ({ASSIGN_SQL}) WHERE warning IS NOT NULL",
    "voice_profile_lookup": f"SELECT a.book_id, chapter_id, position, a.slot, coalesce(p.profile_id, '') AS profile_id, coalesce(sha256(p.profile_id), '') AS content_hash FROM ({ASSIGN_SQL}) a LEFT JOIN (SELECT book_id, slot, min(profile_id) AS profile_id FROM ({FILLED}) GROUP BY ALL) p ON a.book_id = p.book_id AND a.slot = p.slot WHERE a.slot IS NOT NULL",
    "slot_conflicts": f"SELECT book_id, slot, count(*) AS profiles FROM ({FILLED}) GROUP BY ALL HAVING count(*) > 1",
    "merge_runs": RUNS_SQL,
    "plan_ordinals": f"SELECT book_id, chapter_id, run, row_number() OVER (PARTITION BY book_id ORDER BY chapter_id, run) - 1 AS ordinal FROM ({RUNS_SQL})",
    "estimate_seconds": f"SELECT book_id, chapter_id, run, round(length(text) / 14.0::DOUBLE, 6) AS seconds FROM ({RUNS_SQL})",
    "render_key": f"SELECT book_id, ordinal, render_key FROM ({KEYED})",
    "dedupe_renders": f"SELECT book_id, ordinal, render_key, row_number() OVER (PARTITION BY render_key ORDER BY book_id, ordinal) > 1 AS reused FROM ({KEYED})",
    "reuse_split": f"SELECT book_id, ordinal, render_key, EXISTS (SELECT 1 FROM ({RECONCILE_SQL}) r WHERE r.render_key = k.render_key AND reusable) AS reusable FROM ({KEYED}) k WHERE kind <> 'silence'",
    "reconcile_chunks": RECONCILE_SQL,
    "plan_diff": f"""WITH o AS (SELECT DISTINCT render_key FROM ({KEYED}) WHERE number % 3 <> 0), n AS (SELECT DISTINCT render_key FROM ({KEYED}) WHERE number % 3 <> 1)
      SELECT coalesce(o.render_key, n.render_key) AS render_key, CASE WHEN n.render_key IS NULL THEN 'dropped' WHEN o.render_key IS NULL THEN 'new' ELSE 'reused' END AS state FROM o FULL JOIN n ON o.render_key = n.render_key""",
    "resume_cursor": f"SELECT book_id, coalesce(min(ordinal) FILTER (kind <> 'silence' AND NOT present), max(ordinal) + 1, 0)::BIGINT AS next_ordinal FROM ({KEYED}) GROUP BY book_id",
    "job_counts": f"SELECT book_id, count(*) FILTER (kind <> 'silence' AND again) AS reused, count(*) FILTER (kind <> 'silence') AS total, count(*) FILTER (kind <> 'silence' AND present) AS done, coalesce(bool_and(present) FILTER (kind <> 'silence'), true) AS finished FROM (SELECT *, row_number() OVER (PARTITION BY render_key ORDER BY book_id, ordinal) > 1 AS again FROM ({KEYED})) GROUP BY book_id",
}
