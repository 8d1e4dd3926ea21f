"""Queries over numbers of parts, said in Polish."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.catalog.base import table
from narrata.functions import numbers_pl as N


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _small(n: str, units=N.UNITS, tens=N.TENS, hundreds=N.HUNDREDS, end=None) -> str:
    last = hundreds if end is None else f"(CASE WHEN {n} % 100 = 0 THEN {_list(end)} ELSE {_list(hundreds)} END)"
    h = f"{_list(last) if end is None else last}[{n} % 1000 // 100]"
    return f"concat_ws(' ', {h}, CASE WHEN {n} % 100 >= 20 THEN {_list(tens)}[{n} % 100 // 10 - 1] END, CASE WHEN {n} % 100 BETWEEN 1 AND 19 THEN {_list(units)}[{n} % 100 + 1] WHEN {n} % 100 >= 20 AND {n} % 10 > 0 THEN {_list(units)}[{n} % 10 + 1] END)"


def _scaled(n: str) -> str:
    parts = []
    for scale, one, few, many in N.SCALES:
        c = f"({n} // {scale} % 1000)"
        ok = f"{c} % 100 NOT BETWEEN 10 AND 20"
        noun = f"CASE WHEN {ok} AND {c} % 10 = 1 THEN '{one}' WHEN {ok} AND {c} % 10 IN (2, 3, 4) THEN '{few}' ELSE '{many}' END"
        parts.append(f"CASE WHEN {c} = 1 THEN '{one}' WHEN {c} > 1 THEN {_small(c)} || ' ' || {noun} END")
    return ", ".join(parts)


def _cardinal(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 'zero' ELSE concat_ws(' ', {_scaled(n)}, CASE WHEN {n} % 1000 > 0 THEN {_small(n)} END) END"


def _gender(words, g):
    special = {"f": {"drugi": "druga", "trzeci": "trzecia"}, "n": {"drugi": "drugie", "trzeci": "trzecie"}}
    return list(words) if g == "m" else [special[g].get(w, w[:-1] + {"f": "a", "n": "e"}[g]) for w in words]


def _stem(n: str) -> str:
    low = f"({n} % 100)"
    units = f"CASE WHEN {low} < 20 THEN {_list(N.UNIT_STEMS)}[{low} + 1] ELSE {_list(N.UNIT_STEMS)}[{low} % 10 + 1] END"
    return f"CASE WHEN {n} = 1 THEN '' ELSE coalesce({_list(N.HUNDREDS_STEMS)}[{n} // 100], '') || CASE WHEN {low} >= 20 THEN {_list(N.TENS_STEMS)}[{low} // 10] ELSE '' END || {units} END"


def _ordinal(n: str, g: str) -> str:
    last = _small(n, _gender(N.ORDINAL_UNITS, g), _gender(N.ORDINAL_TENS, g), N.HUNDREDS, _gender(N.ORDINAL_HUNDREDS, g))
    return f"CASE WHEN {n} = 0 THEN '{_gender(N.ORDINAL_UNITS, g)[0]}' WHEN {n} % 1000 = 0 THEN {_stem(f"({n} // 1000)")} || 'tysięczn{dict(m="y", f="a", n="e")[g]}' ELSE concat_ws(' ', {_scaled(n)}, {last}) END"


def _locative(word: str) -> str:
    return word[:-1] + "iej" if word.endswith(("ga", "ka")) else word[:-1] + "ej"


def numbers(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * F.col("p_partkey") * F.col("p_size") * 977 % 10**12).alias("n"), (F.col("p_partkey") * 37 % 10**6).alias("o"), (F.col("p_size") % 24).alias("h"), (F.col("p_partkey") % 60).alias("m"))


NUMBERS = "SELECT p_partkey AS k, p_partkey * p_partkey * p_size * 977 % 1000000000000 AS n, p_partkey * 37 % 1000000 AS o, p_size % 24 AS h, p_partkey % 60 AS m FROM part"
_HOURS = [" ".join(map(_locative, ([_gender(N.ORDINAL_UNITS, "f")[h]] if h < 20 else [_gender(N.ORDINAL_TENS, "f")[0], *([_gender(N.ORDINAL_UNITS, "f")[h % 10]] if h % 10 else [])]))) for h in range(24)]


def _feminine(n: str, said: str) -> str:
    return f"CASE WHEN {n} % 10 = 1 AND {n} % 100 <> 11 THEN regexp_replace({said}, 'jeden$', 'jedna') WHEN {n} % 10 = 2 AND {n} % 100 <> 12 THEN regexp_replace({said}, '(^| )dwa$', '\\1dwie') ELSE {said} END"




def fractions(s, d):
    """Whole parts, and one to four digits behind the comma."""
    part, places = F.col("p_partkey"), (F.col("p_size") % 4 + 1).cast("int")
    return table(s, d, "part").select(part.alias("k"), (part % 50).alias("w"), F.expr("lpad(cast(p_partkey * 7 % 10000 as string), 4, '0')").substr(F.lit(1), places).alias("digits"))


FRACTIONS = "SELECT p_partkey AS k, p_partkey % 50 AS w, substring(lpad((p_partkey * 7 % 10000)::VARCHAR, 4, '0'), 1, (p_size % 4 + 1)::INTEGER) AS digits FROM part"


def _decimal(w: str, digits: str) -> str:
    n = f"({digits})::BIGINT"
    form = f"CASE WHEN {n} % 10 = 1 AND {n} % 100 <> 11 THEN 1 WHEN {n} % 10 IN (2, 3, 4) AND {n} % 100 NOT IN (12, 13, 14) THEN 2 ELSE 3 END"
    unit = f"[{', '.join(map(_list, N.FRACTIONS))}][length({digits})][{form}]"
    spelled = f"list_aggregate(list_transform(string_split({digits}, ''), lambda x: {_list(N.UNITS)}[x::INTEGER + 1]), 'string_agg', ' ')"
    return f"{_cardinal(w)} || CASE WHEN length({digits}) <= 3 THEN ' i ' || {_feminine(n, _cardinal(n))} || ' ' || {unit} ELSE ' przecinek ' || {spelled} END"


QUERIES = {
    "cardinal_pl": lambda s, d: numbers(s, d).select("k", "n", N.cardinal(F.col("n")).alias("said")),
    "cardinal_feminine_pl": lambda s, d: numbers(s, d).select("k", "n", N.cardinal_feminine(F.col("n")).alias("said")),
    "ordinal_pl": lambda s, d: numbers(s, d).select("k", "o", *[N.ordinal(F.col("o"), g).alias(g) for g in ("m", "f", "n")]),
    "clock_pl": lambda s, d: numbers(s, d).select("k", "h", "m", N.clock(F.col("h"), F.col("m")).alias("said")),
    "decimal_pl": lambda s, d: fractions(s, d).select("k", "w", "digits", N.decimal(F.col("w"), F.col("digits")).alias("said")),
}
SQL = {
    "cardinal_pl": f"SELECT k, n, {_cardinal('n')} AS said FROM ({NUMBERS})",
    "cardinal_feminine_pl": f"SELECT k, n, {_feminine('n', 'c')} AS said FROM (SELECT k, n, {_cardinal('n')} AS c FROM ({NUMBERS}))",
    "ordinal_pl": f"SELECT k, o, {', '.join(f'{_ordinal("o", g)} AS {g}' for g in 'mfn')} FROM ({NUMBERS})",
    "decimal_pl": f"SELECT k, w, digits, {_decimal('w', 'digits')} AS said FROM ({FRACTIONS})",
    "clock_pl": f"SELECT k, h, m, {_list(_HOURS)}[h + 1] || CASE WHEN m > 0 THEN ' ' || {_cardinal('m')} ELSE '' END AS said FROM ({NUMBERS})",
}
