"""Queries over numbers, sentences, dialogue, gender, page blocks, applied suggestions and whole plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.catalog.base import KEY, LINES, lines, marked, table
from narrata.catalog.numbers import _cardinal, _decimal, _ordinal
from narrata.catalog.text import _rules
from narrata.functions import sentences as S
from narrata.operators import apply as A
from narrata.operators import detectors as D
from narrata.operators import dialogue as G
from narrata.operators import html_blocks as H
from narrata.operators import numerals as M
from narrata.operators import prepass as P
from narrata.operators.associate import associate_blocks
from narrata.operators.gender import gender_suggestions
from narrata.plans import book as B

BLOCK = ["book_id", "chapter_id", "block_index"]


# Numbers are planted by key, so that each kind has its rows and SQL can say what is found.
def numbered(s, d):
    """Lines with a number of each kind in front of their letters; the key tells which."""
    c, b = F.col("chapter_id"), F.col("block_index")
    word = F.concat(F.lit("x"), F.regexp_extract("text", "[a-z]+", 0))
    k = F.pmod(c + b, F.lit(6))
    digits = F.substring(F.lpad((c % 1000).cast("string"), 3, "0"), F.lit(1), (b % 3 + 1).cast("int"))
    text = (
        F.when(k == 0, F.concat(F.lit("Rozdział "), (c % 900 + 1).cast("string"), F.lit(" "), word))
        .when(k == 1, F.concat(word, F.lit(" o "), (b % 24).cast("string"), F.lit(":"), F.lpad((c % 60).cast("string"), 2, "0"), F.lit(" "), word))
        .when(k == 2, F.concat(word, F.lit(" "), (b % 90).cast("string"), F.lit(","), digits, F.lit(" kg")))
        .when(k == 3, F.concat(word, F.lit(" XIV piętro "), word))
        .when(k == 4, F.concat(word, F.lit(" "), (c % 700).cast("string"), F.lit(". część")))
        .otherwise(F.concat(word, F.lit(" "), (c * 37 + 2100).cast("string"), F.lit(" "), word))
    )
    return lines(s, d).select(*BLOCK, text.alias("text"))


NUMBERED = f"""
SELECT book_id, chapter_id, block_index, chapter_id AS c, block_index AS b, 'x' || regexp_extract(text, '[a-z]+') AS word, (chapter_id + block_index) % 6 AS k,
  substring(lpad((chapter_id % 1000)::VARCHAR, 3, '0'), 1, (block_index % 3 + 1)::INTEGER) AS digits FROM ({LINES})
"""
_AT = "length(word) + 1"
_FOUND = {
    "headings": (0, "0", "'Rozdział ' || (c % 900 + 1)", f"'Rozdział ' || {_ordinal('(c % 900 + 1)', 'm')}", "'ordinal_heading'", "'heading_ordinal'", "0.93"),
    "clocks": (1, "length(word) + 3", "(b % 24) || ':' || lpad((c % 60)::VARCHAR, 2, '0')", None, "'numeral'", "'clock'", "0.96"),
    "decimals": (2, _AT, "(b % 90) || ',' || digits", _decimal("(b % 90)", "digits"), "'numeral'", "'decimal'", "0.95"),
    "romans": (3, _AT, "'XIV'", "'czternaste'", "'numeral'", "'roman'", "0.86"),
    "dotted": (4, _AT, "(c % 700) || '.'", _ordinal("(c % 700)", "f"), "'numeral'", "'ordinal'", "0.88"),
    "integers": (5, _AT, "(c * 37 + 2100)::VARCHAR", _cardinal("(c * 37 + 2100)"), "'numeral'", "'cardinal'", "0.95"),
}
_LOCATIVE = "[" + ", ".join("'" + " ".join(w[:-1] + "iej" if w.endswith(("ga", "ka")) else w[:-1] + "ej" for w in said.split()) + "'" for said in (
    *("zerowa pierwsza druga trzecia czwarta piąta szósta siódma ósma dziewiąta dziesiąta jedenasta dwunasta trzynasta czternasta piętnasta szesnasta siedemnasta osiemnasta dziewiętnasta".split()),
    "dwudziesta", "dwudziesta pierwsza", "dwudziesta druga", "dwudziesta trzecia")) + "]"
_CLOCK = f"{_LOCATIVE}[b % 24 + 1] || CASE WHEN c % 60 > 0 THEN ' ' || {_cardinal('(c % 60)')} ELSE '' END"


def _number_sql(name: str) -> str:
    k, start, original, said, kind, reason, confidence = _FOUND[name]
    return f"""SELECT {KEY}, ({start})::INTEGER AS start, ({start} + length({original}))::INTEGER AS "end", {kind} AS kind, {original} AS original, {said or _CLOCK} AS replacement, {reason} AS reason, {confidence}::DOUBLE AS confidence FROM ({NUMBERED}) WHERE k = {k}"""


def _numbers(*passes):
    return lambda s, d: M.numeral_suggestions(numbered(s, d), passes or tuple(M.PASSES))


# Scenes: what is said is planted around a line's first small word.
def scenes(s, d):
    word = F.concat(F.lit("x"), F.regexp_extract("text", "[a-z]+", 0))
    k = F.pmod(F.col("chapter_id") + F.col("block_index"), F.lit(6))
    text = (
        F.when(k == 0, F.concat(F.lit("— "), word, F.lit(" — powiedziała cicho.")))
        .when(k == 1, F.concat(word, F.lit(": — Kto tam?")))
        .when(k == 2, word)
        .when(k == 3, F.concat(F.lit("Znak „"), word))
        .when(k == 4, F.concat(F.lit("Marek dodał: „"), word, F.lit("”.")))
        .otherwise(F.concat(F.lit("To — "), word, F.lit(" — jest.")))
    )
    return lines(s, d).select(*BLOCK, text.alias("text"))


SCENES = f"""
SELECT *, CASE k WHEN 0 THEN '— ' || word || ' — powiedziała cicho.' WHEN 1 THEN word || ': — Kto tam?' WHEN 2 THEN word WHEN 3 THEN 'Znak „' || word
  WHEN 4 THEN 'Marek dodał: „' || word || '”.' ELSE 'To — ' || word || ' — jest.' END AS text
FROM (SELECT {KEY}, 'x' || regexp_extract(text, '[a-z]+') AS word, (chapter_id + block_index) % 6 AS k FROM ({LINES}))
"""


def _segment(where: str, position: int, kind: str, start: str, part: str, confidence: float) -> str:
    return f"""SELECT {KEY}, {position} AS position, '{kind}' AS segment, ({start})::INTEGER AS start, ({start} + length({part}))::INTEGER AS "end", {confidence}::DOUBLE AS confidence, {part} AS part FROM ({SCENES}) WHERE {where}"""


SEGMENTS_SQL = " UNION ALL ".join((
    _segment("k = 0", 0, "dialogue", "2", "word", 0.9), _segment("k = 0", 1, "narration", "length(word) + 5", "'powiedziała cicho.'", 0.9),
    _segment("k = 1", 0, "narration", "0", "(word || ':')", 0.9), _segment("k = 1", 1, "dialogue", "length(word) + 4", "'Kto tam?'", 0.9),
    _segment("k IN (2, 3, 5)", 0, "narration", "0", "text", 1.0),
    _segment("k = 4", 0, "narration", "0", "'Marek dodał:'", 1.0), _segment("k = 4", 1, "dialogue", "14", "word", 0.9),
))
SPLITS_SQL = f"""SELECT {KEY}, 0 AS start, length(text)::INTEGER AS "end", 'dialogue_split' AS kind, text AS original, '' AS replacement,
  CASE k WHEN 3 THEN 'unbalanced_quote' WHEN 5 THEN 'unconfirmed_dash' ELSE 'dialogue' END AS reason, CASE k WHEN 3 THEN 0.35 WHEN 5 THEN 0.45 ELSE 0.9 END::DOUBLE AS confidence,
  CASE k WHEN 0 THEN 2 WHEN 3 THEN 1 WHEN 5 THEN 3 ELSE 2 END AS parts FROM ({SCENES}) WHERE k <> 2"""
# A question has no verb of its own: it is a woman's if only women speak in the blocks beside it, and so for men.
GENDER_SQL = f"""
WITH t AS (SELECT *, lag(k) OVER w AS a, lead(k) OVER w AS z FROM ({SCENES}) WINDOW w AS (PARTITION BY book_id, chapter_id ORDER BY block_index)),
g AS (SELECT *, coalesce(a = 0, false) OR coalesce(z = 0, false) AS female, coalesce(a = 4, false) OR coalesce(z = 4, false) AS male FROM t)
SELECT {KEY}, 2 AS start, 'female' AS gender, 'verb_suffix' AS reason, 0.95::DOUBLE AS confidence, '' AS speaker_id FROM g WHERE k = 0
UNION ALL SELECT {KEY}, (length(word) + 4)::INTEGER, CASE WHEN female AND NOT male THEN 'female' WHEN male AND NOT female THEN 'male' ELSE 'unknown' END,
  CASE WHEN female <> male THEN 'pronoun' ELSE 'unresolved' END, CASE WHEN female <> male THEN 0.65 ELSE 0.4 END::DOUBLE, '' FROM g WHERE k = 1
UNION ALL SELECT {KEY}, 14, 'male', 'verb_suffix', 0.95, 'Marek' FROM g WHERE k = 4
"""


def gender(s, d):
    return gender_suggestions(scenes(s, d)).select(*BLOCK, "start", "gender", "reason", "confidence", "speaker_id")


def decomposed_lines(s, d):
    return lines(s, d).withColumn("text", F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ñ"), F.lit("ñ")))


_NFD = f"SELECT book_id, chapter_id, block_index, replace(replace(text, 'é', 'e' || chr(769)), 'ñ', 'n' || chr(771)) AS text FROM ({LINES})"
NFC_SQL = f"""
SELECT {KEY}, start, (start + length(original))::INTEGER AS "end", 'conversion_artifact' AS kind, original, nfc_normalize(original) AS replacement, 'nfc' AS reason, 0.99::DOUBLE AS confidence FROM (
  SELECT {KEY}, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start': (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INTEGER, 'original': m[i]}}), recursive := true)
  FROM (SELECT *, string_split_regex(text, '(?:[en][\\x{{0301}}\\x{{0303}}])+') AS g, regexp_extract_all(text, '(?:[en][\\x{{0301}}\\x{{0303}}])+') AS m FROM ({_NFD}) WHERE regexp_matches(text, '[\\x{{0301}}\\x{{0303}}]')))
"""

_CUT = r"regexp_replace(text, '([.!?…]+[\"''”»)\]}]*)\s+([\"''„«“(\[]*[\p{Lu}\p{Nd}—–-])', '\1' || chr(1) || '\2', 'g')"
SENTENCES_SQL = f"""
SELECT {KEY}, (row_number() OVER (PARTITION BY {KEY} ORDER BY n) - 1)::INTEGER AS position, sentence FROM (
  SELECT {KEY}, generate_subscripts(p, 1) AS n, trim(unnest(p)) AS sentence FROM (SELECT {KEY}, string_split({_CUT}, chr(1)) AS p FROM ({LINES}))) WHERE sentence <> ''
"""


def sentence_rows(s, d):
    return lines(s, d).select(*BLOCK, F.posexplode(S.sentence_spans(F.col("text"))).alias("position", "x")).select(*BLOCK, "position", F.trim("x.match").alias("sentence"))


def pages_as_book(s, d):
    """Pages by host as books, in the order of their keys."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return table(s, d, "pages").select(host.alias("book_id"), F.col("page_id").alias("chapter_id"), F.col("url").alias("href"), "html")


def hrefs(s, d):
    n = F.col("page_id")
    href = F.when(n % 5 == 0, F.concat(F.lit("../x/"), n.cast("string"), F.lit(".html#top"))).when(n % 5 == 1, F.lit("../../../y")).when(n % 5 == 2, F.concat(F.lit("/z/./"), n.cast("string"))).when(n % 5 == 3, F.lit("#only")).otherwise(F.concat(F.lit("a%20b/../c"), n.cast("string"), F.lit("?q=1")))
    return table(s, d, "pages").select("page_id", F.lit("text/part").alias("base"), href.alias("href"))


HREF_SQL = """SELECT page_id, 'text/part' AS base, CASE page_id % 5 WHEN 0 THEN '../x/' || page_id || '.html#top' WHEN 1 THEN '../../../y' WHEN 2 THEN '/z/./' || page_id WHEN 3 THEN '#only' ELSE 'a%20b/../c' || page_id || '?q=1' END AS href,
  CASE page_id % 5 WHEN 0 THEN 'text/x/' || page_id || '.html' WHEN 2 THEN 'z/' || page_id WHEN 4 THEN 'text/part/c' || page_id END AS path FROM pages"""


def formats(s, d):
    n = F.col("page_id")
    head = F.when(n % 4 == 0, F.lit("%PDF-1.7 ")).when(n % 4 == 1, F.lit("PK\x03\x04 ")).when(n % 4 == 2, F.lit("\n %PDF-1.4")).otherwise(F.lit("<html>"))
    suffix = F.element_at(F.array(*map(F.lit, (".pdf", ".epub", ".txt", ".azw3", ".EPUB"))), (n % 5 + 1).cast("int"))
    files = table(s, d, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), suffix).alias("path"), F.concat(head, "html").cast("binary").alias("content"))
    return files.select("page_id", "path", H.detect_format(F.col("path"), F.col("content")).alias("f")).select("page_id", "path", "f.format", "f.error")


FORMAT_SQL = """
WITH a AS (SELECT page_id, page_id || ['.pdf', '.epub', '.txt', '.azw3', '.EPUB'][page_id % 5 + 1] AS path, ['pdf', 'epub', NULL, 'azw3', 'epub'][page_id % 5 + 1] AS s, page_id % 4 AS k FROM pages),
m AS (SELECT *, CASE WHEN k IN (0, 2) THEN 'pdf' WHEN k = 1 AND s = 'epub' THEN 'epub' END AS m FROM a)
SELECT page_id, path, CASE WHEN m = s OR m IS NULL OR s IS NULL THEN coalesce(m, s) END AS format, CASE WHEN m <> s THEN 'conflict' WHEN m IS NULL AND s IS NULL THEN 'unknown' END AS error FROM m
"""


def with_entities(s, d):
    return lines(s, d).select(*BLOCK, H.expand_entities(F.concat("text", F.lit("&nbsp;&eacute;&amp;&lt;&nosuch;"))).alias("text"))


def accepted(s, d):
    """Normalising suggestions and acronyms of the marked lines without place names, as accepted."""
    return D.suggestions(marked(s, d), lambda t: F.when(F.size(D.toponyms(t)) == 0, F.concat(D.normalization(t), D.acronyms(t))))


def versioned(s, d):
    return marked(s, d).withColumn("valid_from", F.lit(0)).withColumn("valid_to", F.lit(None).cast("int"))


def spans_of_lines(s, d):
    from narrata.catalog.voices import spanned

    return spanned(s, d)


def _voices(s, d):
    from narrata.catalog.voices import best_profiles, filled

    book = lambda f: f.withColumn("book_id", F.concat(F.lit("src"), F.col("book_id").cast("string")))
    return book(filled(s, d)), book(best_profiles(s, d))


def book_plan(s, d):
    filled, profiles = _voices(s, d)
    return B.plan_book(spans_of_lines(s, d), filled, profiles, 120, {"backend": "none", "model": "1"}).select("book_id", "chapter_id", "ordinal", "slot", "kind", "spoken", "profile_id", "render_key", "reused")


def edited(s, d):
    """Lines after an edit: a word replaced, and every ninth line gone."""
    rows = lines(s, d).filter("block_index % 9 <> 8")
    return rows.withColumn("block_index", (F.col("block_index") - F.floor(F.col("block_index") / 9)).cast("int")).withColumn("text", F.replace("text", F.lit("thin"), F.lit("thick")))


def items_of_books(s, d):
    from narrata.catalog.jobs import items

    return items(s, d).withColumnRenamed("number", "chapter_id")


def _export(s, d):
    durations = items_of_books(s, d).groupBy("book_id", "chapter_id").agg((F.sum("part") % 100 / 7 + 0.0005).alias("seconds"))
    titles = items_of_books(s, d).select("book_id", "chapter_id").distinct().withColumn("title", F.concat(F.lit("c"), F.col("chapter_id").cast("string"))).filter("chapter_id % 3 <> 0")
    return B.export_plan(items_of_books(s, d), durations, titles)


def _export_books(s, d):
    rows = items_of_books(s, d)
    durations = rows.groupBy("book_id", "chapter_id").agg((F.sum("part") % 100 / 7 + 0.0005).alias("seconds")).withColumn("path", F.concat(F.lit("it's/"), F.col("chapter_id").cast("string"), F.lit(".wav")))
    titles = rows.select("book_id", "chapter_id").distinct().withColumn("title", F.concat(F.lit("c#"), F.col("chapter_id").cast("string"))).filter("chapter_id % 3 <> 0")
    books = table(s, d, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_name").alias("title"), F.col("c_name").alias("author"), F.lit("d").alias("description"), F.lit(None).cast("string").alias("isbn"))
    return B.export_books(rows, durations, titles, books)


def _items_sql() -> str:
    from narrata.catalog.jobs import ITEMS

    return ITEMS


ITEMS = _items_sql()
MUX_FULL_SQL = f"""
WITH p AS (SELECT book_id, number AS chapter_id, count(*) FILTER (kind <> 'silence') AS total, count(*) FILTER (kind <> 'silence' AND present) AS done,
  coalesce(list_sort(list(ordinal) FILTER (kind <> 'silence' AND NOT present)), []) AS missing FROM ({ITEMS}) GROUP BY ALL),
e AS (SELECT *, total = done AS whole, CASE WHEN NOT bool_and(total = done) OVER b THEN 'missing_items' WHEN NOT bool_or(total = done) OVER b THEN 'nothing_included' END AS error FROM p WINDOW b AS (PARTITION BY book_id))
SELECT book_id, chapter_id, total, done, len(missing)::INTEGER AS missing, whole, error, whole AND error IS NULL AS included FROM e
"""
EXPORT_SQL = f"""
WITH p AS (SELECT book_id, number AS chapter_id, count(*) FILTER (kind <> 'silence') AS total, bool_and(present) FILTER (kind <> 'silence') AS whole, round_even((sum(part) % 100 / 7.0::DOUBLE + 0.0005::DOUBLE) * 1000, 0)::BIGINT AS ms FROM ({ITEMS}) GROUP BY ALL)
SELECT book_id, chapter_id, CASE WHEN chapter_id % 3 <> 0 THEN 'c' || chapter_id ELSE '' END AS title, total,
  (sum(ms) OVER w - ms)::BIGINT AS start_ms, (sum(ms) OVER w)::BIGINT AS end_ms FROM p WHERE coalesce(whole, true) WINDOW w AS (PARTITION BY book_id ORDER BY chapter_id)
"""


_TAG = "replace(c_name, '#', chr(92) || '#')"
EXPORT_BOOKS_SQL = f"""
WITH p AS (SELECT book_id, number, count(*) FILTER (kind <> 'silence') AS total, coalesce(bool_and(present) FILTER (kind <> 'silence'), true) AS whole,
  round_even((sum(part) % 100 / 7.0::DOUBLE + 0.0005::DOUBLE) * 1000, 0)::BIGINT AS ms, CASE WHEN number % 3 <> 0 THEN 'c#' || number ELSE '' END AS title FROM ({ITEMS}) GROUP BY ALL),
m AS (SELECT *, (sum(ms) OVER w)::BIGINT AS stop FROM p WHERE whole WINDOW w AS (PARTITION BY book_id ORDER BY number)),
t AS (SELECT book_id, string_agg('file ' || chr(39) || 'it' || chr(39) || chr(92) || chr(39) || chr(39) || 's/' || number || '.wav' || chr(39), chr(10) ORDER BY number) || chr(10) AS list,
  string_agg(chr(10) || '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (stop - ms) || chr(10) || 'END=' || stop || chr(10) || 'title=' || replace(title, '#', chr(92) || '#'), chr(10) ORDER BY number) AS marks FROM m GROUP BY book_id),
r AS (SELECT book_id, count(*) FILTER (whole) AS chapters, '{{"omitted":[' || coalesce(string_agg('{{"number":' || number || ',"title":"' || title || '","reason":"incomplete"}}', ',' ORDER BY number) FILTER (NOT whole), '') || ']}}' AS report FROM p GROUP BY book_id)
SELECT r.book_id, chapters, CASE WHEN chapters = 0 THEN 'nothing_included' END AS error, list, report,
  CASE WHEN chapters > 0 THEN concat_ws(chr(10), ';FFMETADATA1', 'title=' || {_TAG}, 'artist=' || {_TAG}, 'album_artist=' || {_TAG}, 'genre=Audiobook', 'description=d', 'comment=d', marks) || chr(10) END AS metadata
FROM r LEFT JOIN t ON t.book_id = r.book_id JOIN customer ON c_custkey = r.book_id
"""


def titled(s, d):
    """Lines whose text is a title of a chapter of their book: the first line of every fifth document."""
    titles = lines(s, d).filter("block_index = 0 AND chapter_id % 5 = 0").select("book_id", F.col("text").alias("title"))
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    known = titles.select("book_id", norm("title").alias("norm")).filter("norm <> ''")
    return lines(s, d).withColumn("norm", norm("text")).join(known, ["book_id", "norm"], "left_semi").select(*BLOCK, "text")


TITLED_SQL = f"""WITH l AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM ({LINES}))
SELECT {KEY}, text FROM l WHERE norm <> '' AND EXISTS (SELECT 1 FROM l t WHERE t.book_id = l.book_id AND t.norm = l.norm AND t.block_index = 0 AND t.chapter_id % 5 = 0)"""


def _prepass(s, d):
    return P.prepass(marked(s, d), rules=_rules(s)).drop("segments")


def _united(s, d):
    return P.united(marked(s, d), rules=_rules(s)).drop("segments")


def metadata_entries(s, d):
    docs = table(s, d, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("position"), "lang", F.substring_index("text", "\n", 1).alias("line"))
    name = F.element_at(F.array(*map(F.lit, ("title", "language", "creator", "identifier"))), (F.col("position") % 4 + 1).cast("int"))
    value = F.when(name == "language", F.col("lang")).when(name == "identifier", F.concat(F.lit("id"), F.col("position").cast("string"))).when(F.col("position") % 8 == 0, F.lit(" ")).otherwise(F.col("line"))
    return docs.select("book_id", "position", name.alias("name"), value.alias("value"), (F.col("position") % 12 == 7).alias("unique"))


METADATA_SQL = """
WITH e AS (SELECT source AS book_id, doc_id AS position, ['title', 'language', 'creator', 'identifier'][doc_id % 4 + 1] AS name, doc_id % 12 = 7 AS u,
  CASE doc_id % 4 WHEN 1 THEN lang WHEN 3 THEN 'id' || doc_id ELSE CASE WHEN doc_id % 8 = 0 THEN ' ' ELSE split_part(text, chr(10), 1) END END AS raw FROM documents),
v AS (SELECT *, trim(raw) AS value FROM e WHERE trim(raw) <> '')
SELECT b.book_id, arg_min(value, position) FILTER (name = 'title') AS title, arg_min(value, position) FILTER (name = 'language') AS language, NULL::VARCHAR AS description,
  coalesce(list(value ORDER BY position) FILTER (name = 'creator'), []) AS authors,
  coalesce(arg_min(value, position) FILTER (name = 'identifier' AND u), arg_min(value, position) FILTER (name = 'identifier'), sha256(b.book_id)) AS identifier
FROM (SELECT DISTINCT book_id FROM e) b LEFT JOIN v ON v.book_id = b.book_id GROUP BY b.book_id
"""


def titles_of_chapters(s, d):
    docs = table(s, d, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_id"), F.concat(F.lit("text/ch"), F.col("doc_id").cast("string"), F.lit(".xhtml")).alias("href"))
    blocks = lines(s, d).withColumn("kind", F.when((F.length("text") < 40) & (F.col("chapter_id") % 2 == 0), "heading").otherwise("paragraph"))
    contents = docs.filter("chapter_id % 3 = 0").select("href", F.explode(F.array(F.lit(1), F.lit(2))).alias("position")).withColumn("label", F.concat(F.lit("Chapter "), F.regexp_extract("href", "[0-9]+", 0), F.lit("."), F.col("position").cast("string")))
    return B.chapter_titles(docs, blocks, contents)


TITLES_SQL = f"""
WITH h AS (SELECT book_id, chapter_id, arg_min(trim(text), block_index) AS heading FROM ({LINES}) WHERE length(text) < 40 AND chapter_id % 2 = 0 AND trim(text) <> '' GROUP BY ALL)
SELECT source AS book_id, doc_id AS chapter_id, CASE WHEN doc_id % 3 = 0 THEN 'Chapter ' || doc_id || '.2' ELSE coalesce(heading, 'ch' || doc_id) END AS title FROM documents LEFT JOIN h ON h.book_id = source AND h.chapter_id = doc_id
"""

QUERIES = {
    **{f"detect_{n}": _numbers(n) for n in M.PASSES},
    # Integers are what no other kind of number has taken.
    "detect_integers": lambda s, d: _numbers()(s, d).filter("reason IN ('cardinal', 'year')"),
    "numeral_suggestions": _numbers(),
    "sentence_spans": sentence_rows,
    "split_oversized": lambda s, d: lines(s, d).select(*BLOCK, F.posexplode(S.split_oversized(F.col("text"), 60)).alias("piece", "text")),
    "pack_sentences": lambda s, d: lines(s, d).select(*BLOCK, F.posexplode(S.pieces(F.col("text"), 120)).alias("piece", "text")),
    "dialogue_segments": lambda s, d: G.dialogue_segments(scenes(s, d)),
    "dialogue_suggestions": lambda s, d: G.dialogue_suggestions(scenes(s, d)).withColumn("parts", F.size("segments")).drop("segments"),
    "gender_suggestions": gender,
    "detect_nfc": lambda s, d: D.suggestions(decomposed_lines(s, d), D.decomposed),
    "html_to_blocks": lambda s, d: H.html_blocks(table(s, d, "pages")),
    "expand_entities": with_entities,
    "resolve_href": lambda s, d: hrefs(s, d).withColumn("path", H.resolve_href(F.col("base"), F.col("href"))),
    "detect_format": formats,
    "apply_and_commit": lambda s, d: A.apply_and_commit(versioned(s, d), accepted(s, d), 1, 0)[0].select(*BLOCK, "text", "valid_from", "valid_to"),
    "apply_spans": lambda s, d: A.apply_and_commit(versioned(s, d), accepted(s, d), 1, 0)[1].select(*BLOCK, "start", "end", "kind", "spoken"),
    "annotate_text": lambda s, d: spans_of_lines(s, d).select(*BLOCK, A.annotate_text(F.col("text"), F.col("spans")).alias("text")),
    "chapter_text": lambda s, d: B.chapter_text(lines(s, d)),
    "chapter_text_spoken": lambda s, d: B.chapter_text(spans_of_lines(s, d), spoken=True),
    "associate_block_ids": lambda s, d: associate_blocks(lines(s, d), edited(s, d)),
    "title_match": titled,
    "prepass": _prepass,
    "union_detectors": lambda s, d: _united(s, d).groupBy("kind", "reason").agg(F.count("*").alias("n")),
    "suggestion_order": lambda s, d: P.in_order(_united(s, d)),
    "auto_apply_structure": lambda s, d: P.structural(G.dialogue_suggestions(scenes(s, d))).select(*BLOCK, "reason", "confidence"),
    "plan_book": book_plan,
    "ingest": lambda s, d: B.ingest(pages_as_book(s, d))[0].select("book_id", "chapter_id", "href", "ordinal", "title"),
    "ingest_blocks": lambda s, d: B.ingest(pages_as_book(s, d))[1].select(*BLOCK, "kind", "path", "text"),
    "export_plan": _export,
    "export_books": _export_books,
    "select_for_mux_full": lambda s, d: B.select_for_mux(items_of_books(s, d), full=True).withColumn("missing", F.size("missing")),
    "book_metadata": lambda s, d: B.book_metadata(metadata_entries(s, d)),
    "chapter_titles": titles_of_chapters,
    "export_span_sidecar": lambda s, d: A.span_sidecar(
        spans_of_lines(s, d).select(*BLOCK, F.explode("spans").alias("x")).select(*BLOCK, "x.start", "x.end", "x.kind", F.coalesce("x.spoken", F.lit("")).alias("spoken"), F.coalesce("x.gender", F.lit("")).alias("gender"), F.lit("").alias("speaker_id")),
        lines(s, d).select(*BLOCK, F.concat(F.lit("ch"), F.col("chapter_id").cast("string")).alias("href"), F.concat(F.lit("/html/body/p["), (F.col("block_index") + 1).cast("string"), F.lit("]")).alias("path")),
    ),
}

_SPANNED = f"SELECT *, length(text) AS n, length(text) // 2 AS h FROM ({LINES}) WHERE length(text) >= 20"
_ESC = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_PART = lambda a, b: _ESC(f"substring(text, ({a}) + 1, ({b}) - ({a}))")
_SPANS = [("dialogue", "5", "h", "NULL", "CASE WHEN n % 2 = 0 THEN 'male' ELSE 'female' END"), ("pause", "h - 2", "h + 3", "NULL", "NULL"), ("pronunciation", "6", "8", "'X'", "NULL"), ("skip", "n - 4", "n - 1", "NULL", "NULL")]
SQL = {
    **{f"detect_{n}": _number_sql(n) for n in M.PASSES},
    "numeral_suggestions": " UNION ALL ".join(_number_sql(n) for n in M.PASSES),
    "sentence_spans": SENTENCES_SQL,
    "dialogue_segments": SEGMENTS_SQL,
    "dialogue_suggestions": SPLITS_SQL,
    "gender_suggestions": GENDER_SQL,
    "detect_nfc": NFC_SQL,
    "expand_entities": f"SELECT {KEY}, text || chr(160) || 'é&amp;&lt;&nosuch;' AS text FROM ({LINES})",
    "resolve_href": HREF_SQL,
    "detect_format": FORMAT_SQL,
    "annotate_text": f"""SELECT {KEY}, {_PART('0', '5')} || '<span data-prl-kind="dialogue" data-prl-gender="' || CASE WHEN n % 2 = 0 THEN 'male' ELSE 'female' END || '">' || {_PART('5', '6')} || '<span data-prl-kind="pronunciation" data-prl-spoken="X">'
      || {_PART('6', '8')} || '</span>' || {_PART('8', 'h')} || '</span>' || {_PART('h', 'n - 4')} || '<span data-prl-kind="skip">' || {_PART('n - 4', 'n - 1')} || '</span>' || {_PART('n - 1', 'n')} AS text FROM ({_SPANNED})""",
    "chapter_text": f"SELECT book_id, chapter_id, string_agg(text, chr(10) || chr(10) ORDER BY block_index) AS text FROM ({LINES}) GROUP BY ALL",
    "chapter_text_spoken": f"SELECT book_id, chapter_id, string_agg(substring(text, 1, 6) || 'X' || substring(text, 9, n - 12) || substring(text, n), chr(10) || chr(10) ORDER BY block_index) AS text FROM ({_SPANNED}) GROUP BY ALL",
    "title_match": TITLED_SQL,
    "auto_apply_structure": f"SELECT {KEY}, 'dialogue' AS reason, 0.9::DOUBLE AS confidence FROM ({SCENES}) WHERE k IN (0, 1, 4)",
    "export_plan": EXPORT_SQL,
    "export_books": EXPORT_BOOKS_SQL,
    "select_for_mux_full": MUX_FULL_SQL,
    "book_metadata": METADATA_SQL,
    "chapter_titles": TITLES_SQL,
    "export_span_sidecar": " UNION ALL ".join(f"""SELECT 'ch' || chapter_id AS href, '/html/body/p[' || (block_index + 1) || ']' AS path, block_index, ({a})::INTEGER AS start, ({b})::INTEGER AS "end", '{kind}' AS kind, {spoken} AS spoken, {g} AS gender, NULL::VARCHAR AS speaker_id FROM ({_SPANNED})""" for kind, a, b, spoken, g in _SPANS),
}
