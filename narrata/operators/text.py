"""Plain operations on block text: search, replacement, redaction, joining and splitting."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import word_lists as W
from narrata.functions.offsets import find_all
from narrata.operators.skip import strip

REDACTED = "[REDACTED]"
# Fixed values. Shapes of secrets: assignments, bearer tokens, and keys of five services.
ASSIGNED = r"(?i)\b(api[_-]?key|apikey|access[_-]?token|refresh[_-]?token|secret|passwd|password|token)(['\"]?\s*[:=]\s*['\"]?)([^\s'\",;}\]]+)"
BEARER = r"(?i)\b(bearer\s+)[A-Za-z0-9._~+/=-]{8,}"
OPAQUE = (r"\bsk-[A-Za-z0-9_-]{8,}", r"\bghp_[A-Za-z0-9]{20,}", r"\bgithub_pat_[A-Za-z0-9_]{20,}", r"\bxox[baprs]-[A-Za-z0-9-]{10,}", r"\bAIza[0-9A-Za-z_-]{20,}")


def redact(text: Column, secrets: list[str] = ()) -> Column:
    """Replace known secrets (8 characters or more, longest first) and whatever is shaped like one."""
    for secret in sorted({s for s in secrets if len(s) >= 8}, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    text = F.regexp_replace(text, ASSIGNED, "$1$2" + REDACTED)
    text = F.regexp_replace(text, BEARER, "$1" + REDACTED)
    for pattern in OPAQUE:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def search(blocks: DataFrame, pattern: str) -> DataFrame:
    """One row per match of a regular expression, with its offsets."""
    rows = blocks.select("book_id", "chapter_id", "block_index", F.explode(find_all(F.col("text"), pattern)).alias("h"))
    return rows.select("book_id", "chapter_id", "block_index", "h.start", "h.end", F.col("h.match").alias("original"))


def count_literal(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences, case-sensitive."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def replace_text(blocks: DataFrame, old: str, new: str) -> DataFrame:
    """Blocks that a literal replacement changes, with the number of hits."""
    hit = blocks.filter(F.col("text").contains(old))
    return hit.select("book_id", "chapter_id", "block_index", count_literal(F.col("text"), old).alias("hits"), F.replace("text", F.lit(old), F.lit(new)).alias("text"))


def preview_hits(blocks: DataFrame, old: str, most: int = 50) -> DataFrame:
    """The first ``most`` changed blocks in reading order."""
    return replace_text(blocks, old, old).orderBy("book_id", "chapter_id", "block_index").limit(most).select("book_id", "chapter_id", "block_index", "hits")


def extractable_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s", "")).cast("long")


def refuse_empty(blocks: DataFrame, chapters: int = 3, least: int = 200) -> DataFrame:
    """Per book: chapters, extractable characters, and whether it has too few for its size."""
    per = blocks.groupBy("book_id").agg(F.countDistinct("chapter_id").alias("chapters"), F.sum(extractable_chars(F.col("text"))).alias("chars"))
    return per.withColumn("refused", (F.col("chapters") > chapters) & (F.col("chars") < least))


def join_blocks(blocks: DataFrame) -> DataFrame:
    """A chapter's blocks in order, with blank lines between."""
    listed = F.array_sort(F.collect_list(F.struct("block_index", "text")))
    return blocks.groupBy("book_id", "chapter_id").agg(F.concat_ws("\n\n", F.transform(listed, lambda b: b["text"])).alias("text"))


def split_blocks(chapters: DataFrame) -> DataFrame:
    """Blocks between blank lines, stripped, without empty ones."""
    parts = F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"\n[ \t]*\n", -1)
    kept = F.filter(F.transform(parts, strip), lambda b: b != "")
    return chapters.select("book_id", "chapter_id", F.posexplode(kept).alias("block_index", "text"))


def _matched(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else " ".join(unicodedata.normalize("NFC", t).replace(W.SOFT, "").split()) for t in texts.to_pylist()], pa.string())


def match_text(text: Column) -> Column:
    """Text for matching blocks: composed (NFC), without soft hyphens, with single spaces."""
    return F.arrow_udf(_matched, "string")(text)


def roman_value(token: Column) -> Column:
    """Value of a canonical Roman numeral of 1 to 3999, else null."""
    good = token.rlike(r"^(?=.)M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")
    value = F.aggregate(
        F.transform(F.split(token, ""), lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in p]), c), F.lit(0))),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, v: F.struct((acc["sum"] + v - F.when(acc["last"] < v, 2 * acc["last"]).otherwise(0)).alias("sum"), v.alias("last")),
    )["sum"]
    return F.when(good, value)


def roman_numbers(blocks: DataFrame) -> DataFrame:
    """Words of Roman digits and their values; null for those that are no canonical numeral."""
    words = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.upper(w).rlike("^[IVXLCDM]+$"))
    return blocks.select("book_id", "chapter_id", "block_index", F.explode(F.transform(words, F.upper)).alias("token")).withColumn("value", roman_value(F.col("token")))


