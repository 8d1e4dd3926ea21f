"""Gender of the speakers: read from the verb of saying, a name, pronouns nearby, or an earlier line of the same speaker."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.functions.offsets import struct_lists
from narrata.operators.dialogue import VERBS, Span, read

# Fixed values. Given names, words that tell a gender, and confidences.
NAMES = {
    "male": (
        "barnaba kuba bonawentura kosma jarema jan piotr andrzej tomasz paweł marek michał adam łukasz wojciech jakub antoni john james william michael david"
    ).split(),
    "female": (
        "anna maria ewa zofia katarzyna joanna magdalena agnieszka marta natalia helena hanna julia mary elizabeth sarah emily emma"
    ).split(),
}
WORDS = {"female": "ona jej nią sama zrobiła".split(), "male": "on jego niego sam zrobił".split()}
SUBJECTS = frozenset("on ona ono oni one".split())
BY_VERB, BY_NAME, CONTESTED, BY_PRONOUN, BY_MAP, UNKNOWN = 0.95, 0.85, 0.69, 0.65, 0.6, 0.4

GENDER_OF_NAME = {n: g for g, listed in NAMES.items() for n in listed}
GENDER_OF_WORD = {w: g for g, listed in WORDS.items() for w in listed}
WORD = re.compile(r"[^\W_]+")
READINGS = "array<struct<start:int,end:int,gender:string,reason:string,confidence:double,speaker_id:string>>"


@dataclass(frozen=True)
class Reading:
    gender: str
    reason: str
    confidence: float
    speaker: str = ""


def _by_suffix(verb: str | None) -> str | None:
    low = (verb or "").casefold()
    return "female" if low.endswith("ła") else "male" if low.endswith("ł") else None


def _verb(tag: str) -> str | None:
    """The verb of saying among the first three words, with only names and subjects before it."""
    for k, w in enumerate(words := WORD.findall(tag)[:3]):
        if w.casefold() in VERBS and all(x.casefold() in SUBJECTS or (x[0].isupper() and x.casefold() not in VERBS) for x in words[:k]):
            return w
    return None


def _is_name(word: str) -> bool:
    return len(word) > 1 and word[0].isupper() and not word.isupper() and word.casefold() not in VERBS


def _name(tag: str) -> str:
    return next(filter(_is_name, WORD.findall(tag)), "")


def _of_tag(tag: str, beside: str = "") -> Reading | None:
    """What a tag says: its verb first, then the name in it or beside it."""
    speaker = _name(tag) or beside
    verb, name = _by_suffix(_verb(tag)), GENDER_OF_NAME.get(speaker.casefold())
    if verb:
        return Reading(verb, "contested", CONTESTED, speaker) if name and name != verb else Reading(verb, "verb_suffix", BY_VERB, speaker)
    if speaker:
        return Reading(name, "given_name", BY_NAME, speaker) if name else Reading("unknown", "unresolved", UNKNOWN, speaker)
    return None


def _name_at_end(part: str) -> str:
    """The single word behind the last dash of a line, if it is a name."""
    word = re.split("—|–| - ", part)[-1].strip(" \t.")
    return word if word and " " not in word and _is_name(word) else ""


def _of_pronouns(nearby: str) -> Reading:
    told = set()
    for w in WORD.findall(nearby):
        low = w.casefold()
        told.add(GENDER_OF_WORD.get(low) or (_by_suffix(low) if low in VERBS else None))
    told.discard(None)
    return Reading(told.pop(), "pronoun", BY_PRONOUN) if len(told) == 1 else Reading("unknown", "unresolved", UNKNOWN)


def readings(text: str, before: str | None, after: str | None) -> list[tuple]:
    """(start, end, gender, reason, confidence, speaker_id) of each line of dialogue in a block between its neighbours."""
    segments: list[Span] = read(text)[0]
    part = lambda k: text[segments[k][1] : segments[k][2]] if 0 <= k < len(segments) and segments[k][0] == "narration" else ""
    carried, out = None, []
    for k, (kind, start, end, _) in enumerate(segments):
        if kind != "dialogue":
            continue
        behind, ahead = part(k + 1), part(k - 1)
        tag = behind if _verb(behind) or _name(behind) else ahead if _verb(ahead) or _name(ahead) or ahead.rstrip().endswith(":") else ""
        beside = "" if not tag or _name(tag) else next((n for n in (_name(x) for x in (behind, ahead) if x and x != tag) if n), "")
        found = _of_tag(tag, beside) if tag else None
        if found is None and (last := _name_at_end(text[start:end])):
            found = _of_tag(last)
        if found is None and carried:
            found = Reading(carried.gender, "continuation", BY_MAP, carried.speaker)
        if found is None:
            found = _of_pronouns(" ".join(x for x in (before, text, after) if x))
        out.append((start, end, found.gender, found.reason, found.confidence, found.speaker))
        carried = found if found.confidence >= BY_NAME else carried
    return out


def _job(texts: pa.Array, befores: pa.Array, afters: pa.Array) -> pa.Array:
    rows = [readings(t, b, a) if t else [] for t, b, a in zip(texts.to_pylist(), befores.to_pylist(), afters.to_pylist(), strict=True)]
    return struct_lists(rows, ("start", "end", "gender", "reason", "confidence", "speaker_id"), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string()))


def gender_readings(blocks: DataFrame) -> DataFrame:
    """One row per line of dialogue of (book_id, chapter_id, block_index, text), from its block and the two beside it."""
    order = Window.partitionBy("book_id", "chapter_id").orderBy("block_index")
    rows = blocks.select("book_id", "chapter_id", "block_index", "text", F.lag("text").over(order).alias("before"), F.lead("text").over(order).alias("after"))
    rows = rows.select("book_id", "chapter_id", "block_index", "text", F.posexplode(F.arrow_udf(_job, READINGS)("text", "before", "after")).alias("position", "r"))
    return rows.select("book_id", "chapter_id", "block_index", "position", "r.*", F.expr("substring(text, r.start + 1, r.end - r.start)").alias("original"))


def speaker_map(found: DataFrame) -> DataFrame:
    """Lines without a gender whose speaker had one in an earlier block of the chapter take the last such one."""
    earlier = Window.partitionBy("book_id", "chapter_id", F.lower("speaker_id")).orderBy("block_index").rangeBetween(Window.unboundedPreceding, -1)
    sure = F.when((F.col("confidence") >= BY_NAME) & (F.col("speaker_id") != ""), F.struct("block_index", "position", "gender"))
    rows = found.withColumn("known", F.max(sure).over(earlier)["gender"])
    takes = (F.col("reason") == "unresolved") & (F.col("speaker_id") != "") & F.col("known").isNotNull()
    return rows.select(
        "book_id", "chapter_id", "block_index", "position", "start", "end", "original", F.when(takes, F.col("known")).otherwise(F.col("gender")).alias("gender"),
        F.when(takes, "speaker_map").otherwise(F.col("reason")).alias("reason"), F.when(takes, BY_MAP).otherwise(F.col("confidence")).alias("confidence"), "speaker_id",
    )


def gender_suggestions(blocks: DataFrame) -> DataFrame:
    """The readings of all lines of dialogue, with earlier lines of the same speaker taken into account."""
    return speaker_map(gender_readings(blocks))
