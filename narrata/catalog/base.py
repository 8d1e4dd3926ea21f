"""Tables as the queries read them, in Spark and in SQL.

``documents`` are chapters (source: the book, doc_id: the chapter) and their
lines are blocks.  The texts have no dashes, soft hyphens or clock times, so
each line gets a mark by a rule from its key, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.sources.shared import bounded_batches

SOFT = "­"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, chapter_id, block_index, text: the lines as they are."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_id"), F.posexplode(F.split("text", "\n", -1)).alias("block_index", "text"))


LINES = """
SELECT source AS book_id, doc_id AS chapter_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS block_index,
  unnest(string_split(text, chr(10))) AS text FROM documents
"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, each with a mark for the detectors to find."""
    t, first = F.col("text"), F.substring_index("text", " ", 1)
    k = F.pmod(F.col("chapter_id") + F.col("block_index"), F.lit(5))
    text = (
        F.when(k == 0, F.concat(t, F.lit("  o 18:00 – ISBN 83")))
        .when(k == 1, F.concat(first, F.lit(SOFT), F.expr("substring(text, length(substring_index(text, ' ', 1)) + 2)")))
        .when(k == 2, F.concat(F.lit("Rozdział "), (F.pmod("chapter_id", F.lit(20)) + 1).cast("string"), F.lit(" "), t))
        .when(k == 3, F.concat(t, F.lit(" — IT w  Washington DC ‒ NATO, Deadline i NIE los  angeles")))
        .otherwise(F.concat(t, F.lit(" prze-\nsunięty "), first))
    )
    return lines(spark, sf_dir).withColumn("text", text)


MARKED = f"""
SELECT book_id, chapter_id, block_index, CASE (chapter_id + block_index) % 5
  WHEN 0 THEN text || '  o 18:00 – ISBN 83'
  WHEN 1 THEN split_part(text, ' ', 1) || '{SOFT}' || substring(text, length(split_part(text, ' ', 1)) + 2)
  WHEN 2 THEN 'Rozdział ' || (chapter_id % 20 + 1)::VARCHAR || ' ' || text
  WHEN 3 THEN text || ' — IT w  Washington DC ‒ NATO, Deadline i NIE los  angeles'
  ELSE text || ' prze-' || chr(10) || 'sunięty ' || split_part(text, ' ', 1) END AS text
FROM ({LINES})
"""

KEY = "book_id, chapter_id, block_index"


def sql_hits(source: str, pattern: str, keys: str = KEY, flags: str = "") -> str:
    """SQL rows (keys, text, start, end, original) of all matches of a pattern without look-around."""
    p = (flags + pattern).replace("'", "''")
    return f"""
SELECT {keys}, text, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
    'start': (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INTEGER,
    'original': m[i]}}), recursive := true)
FROM (SELECT {keys}, text, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m FROM ({source}) WHERE regexp_matches(text, '{p}'))
"""
