"""Queries over job events, and over orders read as books with lines as chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.catalog.base import table
from narrata.plans import export as X
from narrata.plans import jobs as J

EVENT = "CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'pause' WHEN 'signup' THEN 'resume' WHEN 'purchase' THEN 'rendered' ELSE CASE WHEN value > 100 THEN 'fail' ELSE 'muxed' END END"
KIND = "CASE WHEN user_id % 2 = 0 THEN 'prep' ELSE 'record' END"


def events(spark, sf_dir):
    """Jobs are users; event_id rises with time, so it is the sequence number."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", "value", F.expr(EVENT).alias("event"), F.expr(KIND).alias("kind"), F.length("props").alias("chars"))


EVENTS = f"SELECT user_id AS job_id, event_id AS seq, ts, value, {EVENT} AS event, {KIND} AS kind, length(props) AS chars FROM events"
_EDGES = "(VALUES " + ", ".join(f"('{s}', '{e}', '{k}', '{t}')" for (s, e), t in J.EDGES.items() for k in ("prep", "record")) + ", ('running', 'rendered', 'prep', 'done'), ('running', 'rendered', 'record', 'muxing')) x(s, e, k, t)"
STATES_SQL = f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM ({EVENTS})),
f AS (SELECT job_id, 0::BIGINT AS n, 'queued' AS state, 0::BIGINT AS illegal, NULL::BIGINT AS last_seq FROM (SELECT DISTINCT job_id FROM e)
  UNION ALL SELECT f.job_id, e.n, coalesce(x.t, f.state), f.illegal + CASE WHEN x.t IS NULL THEN 1 ELSE 0 END, e.seq
  FROM f JOIN e ON e.job_id = f.job_id AND e.n = f.n + 1 LEFT JOIN {_EDGES} ON x.s = f.state AND x.e = e.event AND x.k = e.kind)
SELECT job_id, arg_max(state, n) AS state, max(illegal) AS illegal, max(n) AS events, max(last_seq) AS last_seq FROM f GROUP BY job_id
"""


def samples(spark, sf_dir):
    return events(spark, sf_dir).select("job_id", "seq", "chars", F.when(F.col("seq") % 11 == 0, 0.0).otherwise(F.col("value")).alias("duration_s"), (F.lit(1.0) + F.col("seq") % 7).alias("wall_s"))


EMA_SQL = f"""
WITH s AS (SELECT job_id, seq, value / (1.0::DOUBLE + seq % 7) AS x, chars / value AS y FROM ({EVENTS}) WHERE seq % 11 <> 0 AND value > 0),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY job_id) AS c, first_value(x) OVER w AS x1 FROM s WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
r AS (SELECT job_id, count(*) AS samples, arg_max(x, i) AS rtf_instant, sum(0.2 * pow(0.8, c - i) * x) + any_value(x1 * pow(0.8, c)) AS throughput,
  sum(0.2 * pow(0.8, c - i) * y) + any_value(14 * pow(0.8, c)) AS chars_per_audio_s FROM n GROUP BY job_id)
SELECT job_id, samples, round(rtf_instant, 6) AS rtf_instant, round(throughput, 6) AS throughput, round(chars_per_audio_s, 6) AS chars_per_audio_s,
  round(1000 / chars_per_audio_s / throughput, 4) AS eta_s FROM r
"""


def ema(spark, sf_dir):
    r = J.progress(samples(spark, sf_dir), 1000)
    return r.select("job_id", "samples", *[F.round(c, 6).alias(c) for c in ("rtf_instant", "throughput", "chars_per_audio_s")], F.round("eta_s", 4).alias("eta_s"))


def thinned(spark, sf_dir):
    return events(spark, sf_dir).filter("pmod(seq * 7 + job_id, 9) <> 0")


def items(spark, sf_dir):
    """Lines of orders as plan items: book (customer), chapter (order), item (line)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("part"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "silence").otherwise("tts")
    return rows.select(
        F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("number"), F.col("l_linenumber").alias("ordinal"), kind.alias("kind"), (F.col("flag") != "R").alias("present"), "q",
        F.concat(F.lit("it's/"), F.col("part").cast("string"), F.lit(".wav")).alias("path"), "part",
    )


ITEMS = """
SELECT o_custkey AS book_id, o_orderkey AS number, l_linenumber AS ordinal, CASE WHEN l_linenumber % 3 = 0 THEN 'silence' ELSE 'tts' END AS kind, flag <> 'R' AS present, q,
  'it''s/' || part || '.wav' AS path, part
FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_returnflag) AS flag, min(l_partkey) AS part FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey
"""


def chapters(spark, sf_dir):
    per = items(spark, sf_dir).groupBy("book_id", "number").agg(F.sum("q").alias("q"))
    return per.select("book_id", "number", F.concat(F.lit("Part #"), F.col("number").cast("string")).alias("title"), (F.col("q") / 16.0 + 0.0005).alias("duration_s"))


CHAPTERS = f"SELECT book_id, number, 'Part #' || number AS title, sum(q) / 16.0::DOUBLE + 0.0005::DOUBLE AS duration_s FROM ({ITEMS}) GROUP BY book_id, number"
MARKS_SQL = f"""
SELECT book_id, number, title, (sum(ms) OVER w - ms)::BIGINT AS start_ms, (sum(ms) OVER w)::BIGINT AS end_ms
FROM (SELECT *, round_even(duration_s * 1000, 0)::BIGINT AS ms FROM ({CHAPTERS})) WINDOW w AS (PARTITION BY book_id ORDER BY number)
"""
MUX_SQL = f"SELECT book_id, number, count(*) FILTER (kind <> 'silence') AS speech, coalesce(bool_and(present) FILTER (kind <> 'silence'), true) AS included FROM ({ITEMS}) GROUP BY book_id, number"
GAPS_SQL = f"""SELECT book_id, number, ordinal, kind, coalesce(kind <> 'silence' AND lag(kind) OVER (PARTITION BY book_id, number ORDER BY ordinal) <> 'silence', false) AS gap_before, path FROM ({ITEMS})"""


def metadata(spark, sf_dir):
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), F.concat("c_name", F.lit("; a=b")).alias("title"), F.col("c_name").alias("author"), F.lit("d").alias("description"), F.when(F.col("c_custkey") % 2 == 0, "83").alias("isbn"))
    return X.metadata(books, X.marks(chapters(spark, sf_dir)))


def _esc(e: str) -> str:
    for a, b in (("\\", "\\\\"), ("=", "\\="), (";", "\\;"), ("#", "\\#")):
        e = f"replace({e}, '{a}', '{b}')"
    return e


_DESC = "CASE WHEN c_custkey % 2 = 0 THEN 'd\\nISBN 83' ELSE 'd' END"
METADATA_SQL = f"""
WITH m AS ({MARKS_SQL}), c AS (SELECT book_id, string_agg(chr(10) || '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || start_ms || chr(10) || 'END=' || end_ms || chr(10) || 'title=' || {_esc('title')}, chr(10) ORDER BY number) AS t FROM m GROUP BY book_id)
SELECT c_custkey AS book_id, concat_ws(chr(10), ';FFMETADATA1', 'title=' || {_esc("c_name || '; a=b'")}, 'artist=' || {_esc('c_name')}, 'album_artist=' || {_esc('c_name')}, 'genre=Audiobook', 'description=' || {_DESC}, 'comment=' || {_DESC}, t) || chr(10) AS text
FROM customer LEFT JOIN c ON c.book_id = c_custkey
"""

QUERIES = {
    "fold_job_state": lambda s, d: J.fold_states(events(s, d)),
    "crash_recover": lambda s, d: J.recover(J.fold_states(events(s, d))),
    "stage_for": lambda s, d: J.fold_states(events(s, d)).select("job_id", J.stage(F.col("state"), F.expr("CASE WHEN job_id % 2 = 0 THEN 'prep' ELSE 'record' END")).alias("stage")),
    "active_job_conflicts": lambda s, d: J.active_conflicts(J.fold_states(events(s, d)).withColumn("project_id", F.col("job_id") % 10)),
    "ema_progress": ema,
    "missing_seq": lambda s, d: J.missing(thinned(s, d)),
    "events_since": lambda s, d: J.since(events(s, d), 100).select("job_id", "seq", "event"),
    "topic_filter": lambda s, d: events(s, d).filter(F.col("event").isin("start", "fail")).select("job_id", "seq", "event"),
    "latest_job_record": lambda s, d: J.latest(events(s, d)),
    "last_seq": lambda s, d: events(s, d).groupBy("job_id").agg(F.max("seq").alias("last_seq")),
    "throttle_progress": lambda s, d: J.throttle(events(s, d), "1 hour"),
    "hysteresis_pause": lambda s, d: J.pauses(events(s, d), 5.0),
    "newest_jobs": lambda s, d: events(s, d).groupBy("job_id").agg(F.min("ts").alias("created_at")).orderBy(F.desc("created_at"), "job_id").limit(20),
    "select_for_mux": lambda s, d: X.select_chapters(items(s, d)),
    "write_partial_report": lambda s, d: X.partial_report(X.select_chapters(items(s, d))),
    "chapter_marks": lambda s, d: X.marks(chapters(s, d)),
    "gap_insertion": lambda s, d: X.gaps(items(s, d)).select("book_id", "number", "ordinal", "kind", "gap_before", "path"),
    "concat_list_text": lambda s, d: X.concat_lists(items(s, d), "gap.wav", 200),
    "ffmetadata_text": metadata,
}

SQL = {
    "fold_job_state": STATES_SQL,
    "crash_recover": f"SELECT job_id, CASE WHEN state IN ('running', 'muxing') THEN 'paused' ELSE state END AS state, CASE WHEN state IN ('running', 'muxing') THEN 'crash_recovery' END AS paused_reason, last_seq + CASE WHEN state IN ('running', 'muxing') THEN 1 ELSE 0 END AS last_seq FROM ({STATES_SQL})",
    "stage_for": f"SELECT job_id, CASE WHEN state = 'queued' THEN 'plan' WHEN state = 'muxing' OR (state = 'done' AND job_id % 2 = 1) THEN 'mux' ELSE 'synth' END AS stage FROM ({STATES_SQL})",
    "active_job_conflicts": f"SELECT job_id % 10 AS project_id, count(*) AS active FROM ({STATES_SQL}) WHERE state NOT IN ('done', 'failed', 'cancelled') GROUP BY 1 HAVING count(*) > 1",
    "ema_progress": EMA_SQL,
    "missing_seq": f"SELECT job_id, seq AS after, b AS before, b - seq - 1 AS lost FROM (SELECT job_id, seq, lead(seq) OVER (PARTITION BY job_id ORDER BY seq) AS b FROM ({EVENTS}) WHERE (seq * 7 + job_id) % 9 <> 0) WHERE b - seq > 1",
    "events_since": f"SELECT job_id, seq, event FROM ({EVENTS}) WHERE seq > 100 ORDER BY seq LIMIT 1000",
    "topic_filter": f"SELECT job_id, seq, event FROM ({EVENTS}) WHERE event IN ('start', 'fail')",
    "latest_job_record": f"SELECT job_id, max(seq) AS last_seq, arg_max(event, seq) AS event, arg_max(value, seq) AS value FROM ({EVENTS}) GROUP BY job_id",
    "last_seq": f"SELECT job_id, max(seq) AS last_seq FROM ({EVENTS}) GROUP BY job_id",
    "throttle_progress": f"SELECT job_id, date_trunc('hour', ts) AS start, arg_max(seq, (ts, seq)) AS seq, arg_max(value, (ts, seq)) AS value, count(*) AS n FROM ({EVENTS}) GROUP BY job_id, date_trunc('hour', ts)",
    "hysteresis_pause": f"""WITH r AS (SELECT job_id, seq, row_number() OVER w AS n, value < 5 AS low FROM ({EVENTS}) WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
      p AS (SELECT *, coalesce(n - max(CASE WHEN low THEN n END) OVER (PARTITION BY job_id ORDER BY seq) < 3, false) AS paused FROM r), b AS (SELECT *, coalesce(lag(paused) OVER (PARTITION BY job_id ORDER BY seq), false) AS was FROM p)
      SELECT job_id, seq, paused, paused AND NOT was AS paused_now, was AND NOT paused AS resumed_now FROM b""",
    "newest_jobs": f"SELECT job_id, min(ts) AS created_at FROM ({EVENTS}) GROUP BY job_id ORDER BY created_at DESC, job_id LIMIT 20",
    "select_for_mux": MUX_SQL,
    "write_partial_report": f"""SELECT book_id, '[' || coalesce(string_agg('{{"number":' || number || ',"reason":"incomplete"}}', ',' ORDER BY number) FILTER (NOT included), '') || ']' AS omitted FROM ({MUX_SQL}) GROUP BY book_id""",
    "chapter_marks": MARKS_SQL,
    "gap_insertion": GAPS_SQL,
    "concat_list_text": f"""SELECT book_id, number, string_agg(CASE WHEN gap_before THEN 'file ''gap.wav''' || chr(10) ELSE '' END || 'file ''' || replace(path, '''', '''\\''''') || '''', chr(10) ORDER BY ordinal) || chr(10) AS text FROM ({GAPS_SQL}) GROUP BY book_id, number""",
    "ffmetadata_text": METADATA_SQL,
}
