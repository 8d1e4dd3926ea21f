"""Queries over versioned books: documents as chapters, their sources as books."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.catalog.base import KEY, LINES, MARKED, SOFT, lines, marked, table
from narrata.catalog.text import ACRONYM_SQL, FRONT_SQL, LEXICAL_SQL, SKIP_SQL, TOPONYM_PARTS, _chain, _lexicon_sql, _rules, _without, front_matter
from narrata.functions import word_lists as W
from narrata.operators import detectors as D
from narrata.operators import lexicon as L
from narrata.operators import review as R
from narrata.operators import revisions as V
from narrata.operators import skip
from narrata.operators import text as T


def versions(s, d):
    return lines(s, d).withColumn("valid_from", F.lit(0)).withColumn("valid_to", F.lit(None).cast("int"))


def changes(s, d):
    return T.replace_text(lines(s, d), "thin", "thick").drop("hits")


def committed(s, d):
    return V.commit(V.commit(versions(s, d), changes(s, d), 1, 0), T.replace_text(lines(s, d), "er", "ER").drop("hits").filter("block_index = 0"), 2)


_REV1 = "CASE WHEN contains(text, 'thin') THEN replace(text, 'thin', 'thick') ELSE text END"
COMMIT_SQL = f"""
WITH b AS ({LINES}), c AS (SELECT *, contains(text, 'thin') AS one, {_REV1} AS t1, block_index = 0 AND contains(text, 'er') AND replace(text, 'er', 'ER') <> {_REV1} AS two FROM b)
SELECT {KEY}, text, 0 AS valid_from, CASE WHEN one THEN 1 WHEN two THEN 2 END AS valid_to FROM c
UNION ALL SELECT {KEY}, t1, 1, CASE WHEN two THEN 2 END FROM c WHERE one
UNION ALL SELECT {KEY}, replace(text, 'er', 'ER'), 2, NULL FROM c WHERE two
"""


def chapters(s, d):
    """Chapters in the order of their keys, every ninth removed."""
    docs = table(s, d, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_id"), F.substring_index("text", "\n", 1).alias("title"))
    from pyspark.sql.window import Window

    live = F.col("chapter_id") % 9 != 8
    n = F.row_number().over(Window.partitionBy("book_id", live).orderBy("chapter_id"))
    return docs.withColumn("ordinal", F.when(live, n - 1).otherwise(-n)).withColumn("included", F.lit(True))


CHAPTERS = "SELECT source AS book_id, doc_id AS chapter_id, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 9 <> 8 THEN n - 1 ELSE -n END AS ordinal, true AS included FROM (SELECT *, row_number() OVER (PARTITION BY source, doc_id % 9 <> 8 ORDER BY doc_id) AS n FROM documents)"


def first_two(s, d):
    c = chapters(s, d)
    return c.filter("ordinal = 0").select("book_id", F.col("chapter_id").alias("first")).join(c.filter("ordinal = 1").select("book_id", F.col("chapter_id").alias("second")), "book_id")


PAIRS = f"SELECT a.book_id, a.chapter_id AS first, b.chapter_id AS second FROM ({CHAPTERS}) a JOIN ({CHAPTERS}) b ON a.book_id = b.book_id AND a.ordinal = 0 AND b.ordinal = 1"


def cuts(s, d):
    return lines(s, d).filter("block_index = 1 AND length(text) > 6 AND chapter_id % 2 = 0").select("book_id", "chapter_id", F.lit(1).alias("at_block"), F.when(F.col("chapter_id") % 4 == 0, 0).otherwise(5).alias("at_offset"), (F.col("chapter_id") + 1000000).alias("new_chapter_id"))


SPLIT_SQL = f"""
WITH b AS ({LINES}), c AS (SELECT book_id, chapter_id, CASE WHEN chapter_id % 4 = 0 THEN 0 ELSE 5 END AS o FROM b WHERE block_index = 1 AND length(text) > 6 AND chapter_id % 2 = 0),
j AS (SELECT b.*, c.o FROM b LEFT JOIN c ON b.book_id = c.book_id AND b.chapter_id = c.chapter_id)
SELECT {KEY}, CASE WHEN o IS NOT NULL AND block_index = 1 THEN substring(text, 1, o) ELSE text END AS text FROM j WHERE o IS NULL OR block_index < 1 OR (block_index = 1 AND o > 0)
UNION ALL SELECT book_id, chapter_id + 1000000, block_index - 1, CASE WHEN block_index = 1 THEN substring(text, o + 1) ELSE text END FROM j WHERE o IS NOT NULL AND block_index >= 1
"""


def split_rows(s, d):
    """Chapter rows after the cuts, where every third line is a heading."""
    blocks = lines(s, d).withColumn("kind", F.when((F.col("block_index") % 3 == 2) | (F.col("chapter_id") % 3 == 0), "heading").otherwise("paragraph"))
    return V.split_chapters(chapters(s, d), blocks, cuts(s, d))[0]


SPLIT_ROWS_SQL = f"""
WITH b AS ({LINES}), c AS (SELECT b.book_id, b.chapter_id, text, CASE WHEN b.chapter_id % 4 = 0 THEN 0 ELSE 5 END AS o FROM b WHERE block_index = 1 AND length(text) > 6 AND chapter_id % 2 = 0),
n AS (SELECT c.*, b.text AS following FROM c LEFT JOIN b ON b.book_id = c.book_id AND b.chapter_id = c.chapter_id AND b.block_index = 2),
j AS (SELECT h.*, n.o, n.chapter_id IS NOT NULL AND ordinal >= 0 AS cut, CASE WHEN h.chapter_id % 3 = 0 THEN trim(substring(n.text, o + 1)) END AS rest, CASE WHEN o > 0 THEN trim(n.following) END AS following
  FROM ({CHAPTERS}) h LEFT JOIN n ON n.book_id = h.book_id AND n.chapter_id = h.chapter_id),
s AS (SELECT *, CASE WHEN ordinal >= 0 THEN ordinal + coalesce(sum(cut::INT) OVER (PARTITION BY book_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE ordinal END AS moved FROM j)
SELECT book_id, chapter_id, title, moved::INTEGER AS ordinal, included FROM s
UNION ALL SELECT book_id, chapter_id + 1000000, CASE WHEN rest <> '' AND rest <> title THEN rest WHEN following <> '' AND following <> title THEN following ELSE title || ' (2)' END, (moved + 1)::INTEGER, included FROM s WHERE cut
"""


def reordered(s, d):
    c = chapters(s, d).filter("ordinal >= 0")
    asked = c.filter("NOT (book_id = 'src3' AND ordinal = 0)").select("book_id", "chapter_id", (-F.col("ordinal")).alias("place"))
    return V.reorder(chapters(s, d), asked)


def acronyms(s, d):
    return D.suggestions(marked(s, d), D.names)


ACRONYMS = _chain([*TOPONYM_PARTS, ("acronyms", ACRONYM_SQL)], "SELECT * FROM {}")


def review_base(s, d):
    return acronyms(s, d).withColumn("status", F.lit("open")).withColumn("batch_id", F.lit(None).cast("string"))


def painted(s, d):
    spans = acronyms(s, d).select(*V.BLOCK, "start", "end")
    readings = acronyms(s, d).filter("kind = 'acronym'").select(*V.BLOCK, "start", "end", "confidence", F.when(F.col("chapter_id") % 2 == 0, "male").otherwise("female").alias("gender"), F.lit(0).alias("position"))
    # A later reading is surer, but the first one counts.
    readings = readings.unionByName(readings.withColumns({"position": F.lit(1), "confidence": F.lit(0.99), "gender": F.lit("unknown")}))
    return R.paint(spans, readings)


def apply_rewrites(s, d):
    return marked(s, d).select(*V.BLOCK, V.apply_rewrites(F.col("text"), D.normalization(F.col("text"))).alias("text"))


_NORMAL = f"regexp_replace(text, '(\\p{{L}}+){SOFT}?(?:-|{SOFT})\\r?\\n(\\p{{L}}+)', '\\1\\2', 'g')"
_NORMAL = f"translate(regexp_replace(replace({_NORMAL}, '{SOFT}', ''), '{D.SPACE_RUN}', ' ', 'g'), '{W.TO_DASH}{W.TO_HYPHEN}', '{W.EM_DASH * len(W.TO_DASH)}{'-' * len(W.TO_HYPHEN)}')"

QUERIES = {
    "scd2_commit": committed,
    "current_rows": lambda s, d: V.current(committed(s, d)),
    "as_of_revision": lambda s, d: V.as_of(committed(s, d), 1),
    "chapter_tree": lambda s, d: V.chapter_tree(chapters(s, d), lines(s, d)),
    "rename_include": lambda s, d: V.rename(chapters(s, d), chapters(s, d).filter("chapter_id % 3 = 0").select("book_id", "chapter_id", F.when(F.col("chapter_id") % 2 == 0, F.concat(F.lit("  New "), "title")).otherwise(" ").alias("new_title"), (F.col("chapter_id") % 2 == 0).alias("new_included"))),
    "included_chapters": lambda s, d: chapters(s, d).filter("ordinal >= 0 AND included"),
    "merge_chapters": lambda s, d: V.merge(chapters(s, d), lines(s, d), first_two(s, d))[0],
    "merge_chapters_blocks": lambda s, d: V.merge(chapters(s, d), lines(s, d), first_two(s, d))[1],
    "split_chapter": lambda s, d: V.split(lines(s, d), cuts(s, d)),
    "split_chapter_rows": split_rows,
    "reorder_chapters": reordered,
    "permutation_check": lambda s, d: V.permutation(lines(s, d).select("book_id", "text"), V.split(lines(s, d), cuts(s, d)).select("book_id", "text")),
    "apply_rewrites": apply_rewrites,
    "suggestion_conflicts": lambda s, d: V.conflicts(acronyms(s, d), apply_rewrites(s, d)),
    "review_queue": lambda s, d: R.queue(acronyms(s, d), ("acronym",), 0.5, "it"),
    "suggestion_stats": lambda s, d: R.stats(D.suggestions(marked(s, d), D.lexical)),
    "bulk_review": lambda s, d: R.bulk(review_base(s, d), "kind = 'acronym'", "accepted", "b1"),
    "undo_batch": lambda s, d: R.undo(R.bulk(R.bulk(review_base(s, d), "kind = 'acronym'", "accepted", "b1"), "true", "rejected", "b2"), "b1"),
    "auto_apply": lambda s, d: acronyms(s, d).filter("confidence >= 0.9"),
    "hard_cases": lambda s, d: R.hard_cases(acronyms(s, d), marked(s, d), F.col("confidence") < 0.9, 40),
    "not_overlapping_skip": lambda s, d: R.without_overlaps(D.suggestions(front_matter(s, d), D.acronyms), skip.line_skips(front_matter(s, d))),
    "lexicon_wins": lambda s, d: R.without_overlaps(acronyms(s, d), L.lexicon_suggestions(marked(s, d), _rules(s))),
    "paint_gender": painted,
    "preview_hits": lambda s, d: T.preview_hits(lines(s, d), "thin"),
}

_BASE = f"SELECT *, 'open' AS status, NULL::VARCHAR AS batch_id FROM ({ACRONYMS})"
SQL = {
    "scd2_commit": COMMIT_SQL,
    "current_rows": f"SELECT * FROM ({COMMIT_SQL}) WHERE valid_to IS NULL",
    "as_of_revision": f"SELECT * FROM ({COMMIT_SQL}) WHERE valid_from <= 1 AND (valid_to IS NULL OR valid_to > 1)",
    "chapter_tree": f"SELECT c.book_id, c.chapter_id, ordinal, title, count(l.text) AS blocks, coalesce(sum(length(l.text)), 0)::BIGINT AS chars FROM ({CHAPTERS}) c LEFT JOIN ({LINES}) l ON c.book_id = l.book_id AND c.chapter_id = l.chapter_id WHERE ordinal >= 0 GROUP BY ALL",
    "rename_include": f"SELECT book_id, chapter_id, CASE WHEN chapter_id % 6 = 0 THEN trim('  New ' || title) ELSE title END AS title, ordinal, CASE WHEN chapter_id % 3 = 0 THEN chapter_id % 2 = 0 ELSE included END AS included FROM ({CHAPTERS})",
    "included_chapters": f"SELECT * FROM ({CHAPTERS}) WHERE ordinal >= 0",
    "merge_chapters": f"SELECT c.book_id, chapter_id, title, CASE WHEN chapter_id = second THEN (SELECT least(min(ordinal), 0) FROM ({CHAPTERS}) x WHERE x.book_id = c.book_id) - 1 WHEN second IS NOT NULL AND ordinal > 1 THEN ordinal - 1 ELSE ordinal END AS ordinal, included FROM ({CHAPTERS}) c LEFT JOIN ({PAIRS}) p ON c.book_id = p.book_id",
    "merge_chapters_blocks": f"WITH l AS ({LINES}), e AS (SELECT book_id, chapter_id, max(block_index) + 1 AS n FROM l GROUP BY ALL) SELECT l.book_id, coalesce(first, l.chapter_id) AS chapter_id, (block_index + CASE WHEN first IS NULL THEN 0 ELSE n END)::INTEGER AS block_index, text FROM l LEFT JOIN ({PAIRS}) p ON l.book_id = p.book_id AND l.chapter_id = second LEFT JOIN e ON e.book_id = p.book_id AND e.chapter_id = first",
    "split_chapter": SPLIT_SQL,
    "split_chapter_rows": SPLIT_ROWS_SQL,
    "reorder_chapters": f"SELECT book_id, chapter_id, title, CASE WHEN ordinal >= 0 AND book_id <> 'src3' THEN max(ordinal) OVER (PARTITION BY book_id) - ordinal ELSE ordinal END AS ordinal, included FROM ({CHAPTERS})",
    "permutation_check": f"WITH a AS (SELECT book_id, text FROM ({LINES})), b AS (SELECT book_id, text FROM ({SPLIT_SQL})) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "apply_rewrites": f"SELECT {KEY}, {_NORMAL} AS text FROM ({MARKED})",
    "suggestion_conflicts": f"""SELECT a.* FROM ({ACRONYMS}) a JOIN (SELECT {KEY}, {_NORMAL} AS t FROM ({MARKED})) b ON a.book_id = b.book_id AND a.chapter_id = b.chapter_id AND a.block_index = b.block_index WHERE substring(t, start + 1, "end" - start) <> original""",
    "review_queue": f"""SELECT * FROM ({ACRONYM_SQL}) WHERE contains(lower(original), 'it') ORDER BY book_id, chapter_id, block_index, start, "end", kind LIMIT 100""",
    "suggestion_stats": f"SELECT kind, reason, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM ({LEXICAL_SQL}) GROUP BY ALL",
    "bulk_review": f"SELECT * REPLACE (CASE WHEN kind = 'acronym' THEN 'accepted' ELSE status END AS status, CASE WHEN kind = 'acronym' THEN 'b1' END AS batch_id) FROM ({_BASE})",
    "undo_batch": f"SELECT * REPLACE (CASE WHEN kind = 'acronym' THEN 'open' ELSE 'rejected' END AS status, CASE WHEN kind = 'acronym' THEN NULL ELSE 'b2' END AS batch_id) FROM ({_BASE})",
    "auto_apply": f"SELECT * FROM ({ACRONYMS}) WHERE confidence >= 0.9",
    "hard_cases": f"SELECT a.*, b.before, b.after FROM ({ACRONYMS}) a JOIN (SELECT {KEY}, right(lag(text) OVER w, 40) AS before, left(lead(text) OVER w, 40) AS after FROM ({MARKED}) WINDOW w AS (PARTITION BY book_id, chapter_id ORDER BY block_index)) b ON a.book_id = b.book_id AND a.chapter_id = b.chapter_id AND a.block_index = b.block_index WHERE confidence < 0.9",
    "not_overlapping_skip": _without(ACRONYM_SQL.replace(MARKED, FRONT_SQL), SKIP_SQL),
    "lexicon_wins": _without(ACRONYMS, _lexicon_sql()),
    "paint_gender": f"""SELECT {KEY}, start, "end", CASE WHEN kind = 'acronym' THEN CASE WHEN chapter_id % 2 = 0 THEN 'male' ELSE 'female' END END AS gender, CASE WHEN kind = 'acronym' THEN 0.86::DOUBLE END AS gender_confidence FROM ({ACRONYMS})""",
    "preview_hits": f"SELECT {KEY}, ((length(text) - length(replace(text, 'thin', ''))) / 4)::BIGINT AS hits FROM ({LINES}) WHERE contains(text, 'thin') ORDER BY book_id, chapter_id, block_index LIMIT 50",
}
