"""Queries over blocks of text: detectors, lexicon, front matter, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from narrata.catalog.base import KEY, LINES, MARKED, lines, marked, sql_hits
from narrata.functions import word_lists as W
from narrata.operators import detectors as D
from narrata.operators import lexicon as L
from narrata.operators import skip as S
from narrata.operators import text as T

OUT = f'{KEY}, start, (start + length(original))::INTEGER AS "end", original'


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _suggestion_sql(hits: str, kind: str, reason: str, replacement: str, confidence: str, where: str = "true") -> str:
    return f"""SELECT {OUT}, {_q(kind)} AS kind, {reason} AS reason, {replacement} AS replacement, ({confidence})::DOUBLE AS confidence FROM ({hits}) WHERE {where}"""


def _nested(expr: str, pairs) -> str:
    return reduce(lambda e, p: f"replace({e}, {_q(p[0])}, {_q(p[1])})", pairs, expr)


BREAKS_SQL = _suggestion_sql(sql_hits(MARKED, rf"\p{{L}}+{W.SOFT}?(?:-|{W.SOFT})\r?\n\p{{L}}+"), "conversion_artifact", "'hyphenation'", f"regexp_replace(original, '[-{W.SOFT}\\r\\n]', '', 'g')", "0.95")
SOFT_SQL = _suggestion_sql(sql_hits(MARKED, rf"\p{{L}}*(?:{W.SOFT}\p{{L}}*)+"), "conversion_artifact", "'soft_hyphen'", f"replace(original, '{W.SOFT}', '')", "0.99")
SPACES_SQL = _suggestion_sql(sql_hits(MARKED, D.SPACE_RUN), "conversion_artifact", "'whitespace'", "' '", "0.99")
DASHES_SQL = _suggestion_sql(sql_hits(MARKED, D.DASH), "conversion_artifact", "'dash'", f"translate(original, '{W.TO_DASH}{W.TO_HYPHEN}', '{W.EM_DASH * len(W.TO_DASH)}{'-' * len(W.TO_HYPHEN)}')", "0.9")


def _without(rows: str, taken: str) -> str:
    """Rows that overlap none of ``taken`` in their block."""
    return f"""SELECT * FROM ({rows}) a WHERE NOT EXISTS (SELECT 1 FROM ({taken}) b WHERE a.book_id = b.book_id AND a.chapter_id = b.chapter_id
  AND a.block_index = b.block_index AND a.start < b."end" AND b.start < a."end")"""


NORMAL_SQL = f"""
WITH h AS ({BREAKS_SQL}), s AS ({_without(SOFT_SQL, 'SELECT * FROM h')}), hs AS (SELECT * FROM h UNION ALL SELECT * FROM s),
w AS ({_without(SPACES_SQL, 'SELECT * FROM hs')}), hsw AS (SELECT * FROM hs UNION ALL SELECT * FROM w), d AS ({_without(DASHES_SQL, 'SELECT * FROM hsw')})
SELECT * FROM hsw UNION ALL SELECT * FROM d
"""


def _toponym_sql(surface: str, spoken: str) -> str:
    pattern = r"\s+".join(p.replace(".", r"\.") for p in surface.split())
    edge = r"regexp_matches({}, '[\p{{L}}\p{{N}}_]')"
    apart = f"NOT (start > 0 AND {edge.format('substring(text, start, 1)')}) AND NOT {edge.format('substring(text, start + length(original) + 1, 1)')}"
    return _suggestion_sql(sql_hits(MARKED, pattern, flags="(?i)"), "toponym", "'toponym'", _q(spoken), "0.92", apart)


def _chain(parts: list[tuple[str, str]], then: str) -> str:
    """WITH clauses in which each part is kept where it overlaps no earlier one."""
    clauses, before = [], None
    for name, rows in parts:
        clauses.append(f"{name} AS ({rows if before is None else _without(rows, f'SELECT * FROM {before}')})")
        if before is not None:
            clauses.append(f"all_{name} AS (SELECT * FROM {before} UNION ALL SELECT * FROM {name})")
            before = f"all_{name}"
        else:
            before = name
    return f"WITH {', '.join(clauses)} {then.format(before)}"


TOPONYM_PARTS = [(f"t{k}", _toponym_sql(s, spoken)) for k, (s, spoken) in enumerate(W.TOPONYMS)]
SPELL_SQL = "list_aggregate(list_transform(string_split(original, ''), lambda c: map {" + ", ".join(f"'{a}': {_q(b)}" for a, b in W.LETTER_NAMES.items()) + "}[c]), 'string_agg', ' ')"
ACRONYM_SQL = _suggestion_sql(
    sql_hits(MARKED, "[A-Za-z]+"), "acronym", "'acronym'", SPELL_SQL, "0.86",
    f"regexp_full_match(original, '[A-Z]{{2,5}}') AND original NOT IN {_list(W.NOT_ACRONYMS)} AND lower(original) NOT IN {_list(W.ENGLISH_WORDS)}",
)
_RAW = _nested("lower(original)", W.RESPELLINGS)
_CAPITAL = "substring(original, 1, 1) <> lower(substring(original, 1, 1)) AND substring(original, 1, 1) = upper(substring(original, 1, 1))"
RESPELL_SQL = f"CASE lower(original) {' '.join(f'WHEN {_q(a)} THEN {_q(b)}' for a, b in W.SPOKEN_WORDS.items())} ELSE CASE WHEN {_CAPITAL} THEN upper(substring({_RAW}, 1, 1)) || substring({_RAW}, 2) ELSE {_RAW} END END"
FOREIGN_SQL = _suggestion_sql(
    sql_hits(MARKED, D.WORD), "foreign_word", f"CASE WHEN lower(original) IN {_list(W.ENGLISH_WORDS)} THEN 'english_word' ELSE 'english_orthography' END", RESPELL_SQL,
    f"CASE WHEN lower({RESPELL_SQL}) <> lower(original) THEN 0.8 ELSE 0.62 END",
    f"length(original) >= 3 AND NOT regexp_matches(original, '[{W.POLISH_LETTERS}]') AND (lower(original) IN {_list(W.ENGLISH_WORDS)} OR regexp_matches(lower(original), '{D.ENGLISH}'))",
)
LEXICAL_SQL = _chain([*TOPONYM_PARTS, ("acronyms", ACRONYM_SQL), ("foreign_words", FOREIGN_SQL)], "SELECT * FROM {}")

# pattern, spoken, case_sensitive, priority, scope, auto
RULES = [
    ("the", "de", False, 100, "global", False),
    ("the", "ze", False, 100, "project", True),
    ("of the", "ow de", False, 50, "global", False),
    ("IT", "aj ti", True, 100, "global", True),
    ("Washington DC", "Łoszynkton", False, 10, "global", False),
    ("le", "ly", True, 100, "global", False),
]
RULES_SQL = "(VALUES " + ", ".join(f"({_q(p)}, {_q(s)}, {str(c).lower()}, {n}, {_q(sc)}, {str(a).lower()}, {k})" for k, (p, s, c, n, sc, a) in enumerate(RULES)) + ") r(pattern, spoken, case_sensitive, priority, scope, auto, place)"


def _effective_sql() -> str:
    return f"""SELECT pattern, spoken, case_sensitive, priority, scope, auto, row_number() OVER (ORDER BY priority, -length(pattern), place)::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY CASE scope WHEN 'project' THEN 0 ELSE 1 END, place) AS n FROM {RULES_SQL}) WHERE n = 1"""


def _rules(spark):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(RULES)], "pattern string, spoken string, case_sensitive boolean, priority int, scope string, auto boolean, place int").withColumn("is_regex", F.lit(False))


def _lexicon_sql() -> str:
    effective = sorted({(p): r for r in sorted(RULES, key=lambda r: r[4] == "project") for p in [r[0]]}.values(), key=lambda r: (r[3], -len(r[0]), next(k for k, x in enumerate(RULES) if x[0] == r[0])))
    edge = r"regexp_matches({}, '[\p{{L}}\p{{N}}_]')"
    apart = f"NOT (start > 0 AND {edge.format('substring(text, start, 1)')}) AND NOT {edge.format('substring(text, start + length(original) + 1, 1)')}"
    parts = []
    for k, (pattern, spoken, case, _, _, auto) in enumerate(effective):
        hits = sql_hits(MARKED, rf"\b{pattern}\b", flags="" if case else "(?i)")
        parts.append((f"r{k}", f"""SELECT {OUT}, {_q(spoken)} AS replacement, {str(auto).lower()} AS auto FROM ({hits}) WHERE {apart}"""))
    return _chain(parts, "SELECT * FROM {}")


STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
REASON_SQL = f"""CASE WHEN s = '' THEN NULL WHEN regexp_full_match(s, '[0-9]{{1,4}}') THEN 'page_number' WHEN length(s) > 400 THEN NULL
  WHEN regexp_matches(s, '(?i)\\bISBN(?:-1[03])?\\b\\s*:?\\s*[0-9][0-9Xx \\t-]{{8,24}}[0-9Xx]') THEN 'isbn'
  WHEN regexp_matches(s, '(?i)\\bcopyright\\b') OR contains(lower(s), 'all rights reserved') OR contains(lower(s), 'wszelkie prawa zastrzeżone') THEN 'copyright'
  WHEN contains(lower(s), 'tytuł oryginału') OR contains(lower(s), 'tytul oryginalu') THEN 'original_title'
  WHEN regexp_matches(s, '(?i)\\b(?:redakcja|korekta|sklad|projekt okladki)\\b') OR regexp_matches(s, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:skład|projekt okładki)($|[^\\p{{L}}\\p{{N}}_])') THEN 'editorial' END"""

# Front matter is planted by key: a page number, an ISBN line and so on, and contents of seven entries.
FRONT = ["12", "ISBN 978-83-000000-0-0", "Copyright by Nobody", "Tytuł oryginału: X", "Redakcja: Y", "Spis treści", "one", "two", "three", "four", "five", "six", "The end."]


def front_matter(spark, sf_dir):
    planted = F.element_at(F.array(*map(F.lit, FRONT)), (F.col("block_index") - 1 + 0 * F.col("chapter_id")).cast("int"))
    return lines(spark, sf_dir).withColumn("text", F.when((F.col("chapter_id") % 3 == 0) & F.col("block_index").between(2, 1 + len(FRONT)), planted).otherwise(F.col("text")))


FRONT_SQL = f"SELECT book_id, chapter_id, block_index, CASE WHEN chapter_id % 3 = 0 AND block_index BETWEEN 2 AND {1 + len(FRONT)} THEN ([{', '.join(map(_q, FRONT))}])[block_index - 1] ELSE text END AS text FROM ({LINES})"
SKIP_SQL = f"""SELECT {KEY}, 0 AS start, length(text)::INTEGER AS "end", reason FROM (SELECT *, {REASON_SQL} AS reason FROM (SELECT *, {STRIPPED} AS s FROM ({FRONT_SQL}))) WHERE reason IS NOT NULL"""
TOC_SQL = f"""
WITH b AS (SELECT *, {REASON_SQL} AS claimed, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM (SELECT *, {STRIPPED} AS s FROM ({FRONT_SQL}))),
k AS (SELECT *, claimed IS NULL AND norm IN {_list(W.TOC_HEADINGS)} AS heading,
  claimed IS NULL AND norm <> '' AND length(norm) <= 120 AND NOT regexp_matches(norm, '[.!?…]$') AS entry FROM b),
i AS (SELECT *, sum(CASE WHEN entry THEN 0 ELSE 1 END) OVER (PARTITION BY book_id, chapter_id ORDER BY block_index) AS island FROM k),
f AS (SELECT *, min(CASE WHEN heading THEN block_index END) OVER (PARTITION BY book_id, chapter_id, island, entry) AS head,
  max(block_index) OVER (PARTITION BY book_id, chapter_id, island, entry) AS last FROM i)
SELECT {KEY}, 0 AS start, length(text)::INTEGER AS "end", 'toc' AS reason FROM f WHERE entry AND block_index >= head AND last - head >= 5
"""

REDACT_SQL = """
SELECT doc_id, {} AS text FROM (SELECT doc_id, text || ' Bearer abcDEF12345. sk-abcdefgh1234 password: "hunter22" ghp_abcdefghijklmnopqrstuv' AS text FROM documents)
"""
_red = "replace(text, 'erthand ', '[REDACTED]')"
_red = f"regexp_replace({_red}, '(?i)\\b(api[_-]?key|apikey|access[_-]?token|refresh[_-]?token|secret|passwd|password|token)([''\"]?\\s*[:=]\\s*[''\"]?)([^\\s''\",;}}\\]]+)', '\\1\\2[REDACTED]', 'g')"
_red = f"regexp_replace({_red}, '(?i)\\b(bearer\\s+)[A-Za-z0-9._~+/=-]{{8,}}', '\\1[REDACTED]', 'g')"
for _p in T.OPAQUE:
    _red = f"regexp_replace({_red}, '{_p}', '[REDACTED]', 'g')"


def redact_secrets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat("text", F.lit(' Bearer abcDEF12345. sk-abcdefgh1234 password: "hunter22" ghp_abcdefghijklmnopqrstuv'))
    return docs.select("doc_id", T.redact(text, ["erthand ", "rthand"]).alias("text"))


def _detector(detector):
    return lambda spark, sf_dir: D.suggestions(marked(spark, sf_dir), detector)


def _search(spark, sf_dir):
    return T.search(lines(spark, sf_dir), "thin")


def _replace(spark, sf_dir):
    return T.replace_text(lines(spark, sf_dir), "thin", "thick")


QUERIES = {
    "detect_hyphen_breaks": _detector(D.hyphen_breaks),
    "detect_soft_hyphens": _detector(D.soft_hyphens),
    "detect_space_runs": _detector(D.space_runs),
    "detect_dashes": _detector(D.dashes),
    "normalization_suggestions": _detector(D.normalization),
    "detect_toponyms": _detector(D.toponyms),
    "detect_acronyms": _detector(D.acronyms),
    "detect_foreign_words": _detector(D.foreign_words),
    "lexical_suggestions": _detector(D.lexical),
    "effective_rules": lambda spark, sf_dir: L.effective_rules(_rules(spark)).select("pattern", "spoken", "case_sensitive", "priority", "scope", "auto", "rank"),
    "lexicon_suggestions": lambda spark, sf_dir: L.lexicon_suggestions(marked(spark, sf_dir), _rules(spark)),
    "skip_candidates_line": lambda spark, sf_dir: S.line_skips(front_matter(spark, sf_dir)),
    "skip_candidates_toc": lambda spark, sf_dir: S.contents_skips(front_matter(spark, sf_dir)),
    "redact_secrets": redact_secrets,
    "search_blocks": _search,
    "replace_text": _replace,
    "extractable_chars": lambda spark, sf_dir: marked(spark, sf_dir).select("book_id", "chapter_id", "block_index", T.extractable_chars(F.col("text")).alias("chars")),
    "refuse_empty_text": lambda spark, sf_dir: T.refuse_empty(lines(spark, sf_dir)),
    "join_blocks": lambda spark, sf_dir: T.join_blocks(lines(spark, sf_dir)),
    "split_blocks": lambda spark, sf_dir: T.split_blocks(T.join_blocks(lines(spark, sf_dir))),
    "normalise_match_text": lambda spark, sf_dir: marked(spark, sf_dir).select("book_id", "chapter_id", "block_index", T.match_text(F.col("text")).alias("text")),
    "parse_roman": lambda spark, sf_dir: T.roman_numbers(lines(spark, sf_dir)),
}
# The rules alone are fixed input; they run against the blocks in lexicon_suggestions.
del QUERIES["effective_rules"]

SQL = {
    "detect_hyphen_breaks": BREAKS_SQL,
    "detect_soft_hyphens": SOFT_SQL,
    "detect_space_runs": SPACES_SQL,
    "detect_dashes": DASHES_SQL,
    "normalization_suggestions": NORMAL_SQL,
    "detect_toponyms": _chain(TOPONYM_PARTS, "SELECT * FROM {}"),
    "detect_acronyms": ACRONYM_SQL,
    "detect_foreign_words": FOREIGN_SQL,
    "lexical_suggestions": LEXICAL_SQL,
    "lexicon_suggestions": _lexicon_sql(),
    "skip_candidates_line": SKIP_SQL,
    "skip_candidates_toc": TOC_SQL,
    "redact_secrets": REDACT_SQL.format(_red),
    "search_blocks": f"""SELECT {OUT} FROM ({sql_hits(LINES, "thin")})""",
    "replace_text": f"""SELECT {KEY}, ((length(text) - length(replace(text, 'thin', ''))) / 4)::BIGINT AS hits, replace(text, 'thin', 'thick') AS text FROM ({LINES}) WHERE contains(text, 'thin')""",
    "extractable_chars": f"SELECT {KEY}, length(regexp_replace(text, '\\s', '', 'g'))::BIGINT AS chars FROM ({MARKED})",
    "refuse_empty_text": f"SELECT book_id, count(DISTINCT chapter_id) AS chapters, sum(length(regexp_replace(text, '\\s', '', 'g')))::BIGINT AS chars, count(DISTINCT chapter_id) > 3 AND sum(length(regexp_replace(text, '\\s', '', 'g'))) < 200 AS refused FROM ({LINES}) GROUP BY book_id",
    "join_blocks": f"SELECT book_id, chapter_id, string_agg(text, chr(10) || chr(10) ORDER BY block_index) AS text FROM ({LINES}) GROUP BY book_id, chapter_id",
    "split_blocks": f"""SELECT book_id, chapter_id, (row_number() OVER (PARTITION BY book_id, chapter_id ORDER BY block_index) - 1)::INTEGER AS block_index, {STRIPPED} AS text FROM ({LINES}) WHERE {STRIPPED} <> ''""",
    "normalise_match_text": f"SELECT {KEY}, trim(regexp_replace(replace(text, '{W.SOFT}', ''), '\\s+', ' ', 'g')) AS text FROM ({MARKED})",
    "parse_roman": f"""WITH r AS (SELECT n::INTEGER AS n, list_aggregate([['', 'M', 'MM', 'MMM'][n // 1000 + 1], ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n % 1000 // 100 + 1],
  ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n % 100 // 10 + 1], ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1]], 'string_agg', '') AS token FROM range(1, 4000) t(n))
SELECT {KEY}, upper(original) AS token, n AS value FROM ({sql_hits(LINES, "[A-Za-z]+")}) LEFT JOIN r ON upper(original) = token WHERE regexp_full_match(upper(original), '[IVXLCDM]+')""",
}
