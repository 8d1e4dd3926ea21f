"""Queries that call detectors and segmenters of one's own from SQL."""

from __future__ import annotations

import re

from narrata.catalog.base import KEY, MARKED, lines, marked, sql_hits
from narrata.catalog.narration import SENTENCES_SQL
from narrata.catalog.text import _without
from narrata.operators.plugins import Detector, Registry, create_sentences


def _matches(pattern: str, say, reason: str, confidence: float):
    compiled = re.compile(pattern)
    return lambda text: [(m.start(), m.end(), say(m[0]), reason, confidence) for m in compiled.finditer(text)]


#: Two detectors that meet: of a time of day, and of any digits, which has what the first one leaves.
OWN = Registry(
    Detector("digits", 40, _matches("[0-9]+", lambda m: " ".join(m), "digits", 0.5)),
    Detector("hour", 10, _matches("[0-9]{1,2}:[0-9]{2}", lambda m: m.replace(":", " "), "hour", 0.9)),
)


def detector_plugin(spark, sf_dir):
    OWN.create_function(spark, "narrata_own_detectors")
    marked(spark, sf_dir).createOrReplaceTempView("narrata_marked")
    return spark.sql(f"SELECT {KEY}, d.* FROM narrata_marked, LATERAL narrata_own_detectors(text) d")


def segmenter_plugin(spark, sf_dir):
    create_sentences(spark, "narrata_sentences")
    lines(spark, sf_dir).createOrReplaceTempView("narrata_lines")
    return spark.sql(f"SELECT {KEY}, s.position, trim(s.sentence) AS sentence FROM narrata_lines, LATERAL narrata_sentences(text) s")


def _own_sql(pattern: str, kind: str, replacement: str, confidence: float) -> str:
    return f"""SELECT {KEY}, start, (start + length(original))::INTEGER AS "end", '{kind}' AS kind, original, {replacement} AS replacement, '{kind}' AS reason, {confidence}::DOUBLE AS confidence FROM ({sql_hits(MARKED, pattern)})"""


_HOUR = _own_sql("[0-9]{1,2}:[0-9]{2}", "hour", "replace(original, ':', ' ')", 0.9)
_DIGITS = _own_sql("[0-9]+", "digits", "list_aggregate(string_split(original, ''), 'string_agg', ' ')", 0.5)

QUERIES = {"detector_plugin": detector_plugin, "segmenter_plugin": segmenter_plugin}
SQL = {"detector_plugin": f"SELECT * FROM ({_HOUR}) UNION ALL {_without(_DIGITS, _HOUR)}", "segmenter_plugin": SENTENCES_SQL}
