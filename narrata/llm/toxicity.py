"""Toxicity behind disguises: a noisy channel restores words, then a lexicon learned from labels scores them.

Writers hide words with digits and signs for letters, with letters spaced out
or joined by signs, and with letters repeated.  Every such odd token is read as
a lattice: a sign is one of the letters it stands for, or a break; a joint is
left out, or a break; a repeated letter may have been written once.  A Viterbi
search over the lattice finds the likeliest word under a language model of
letters, counted over all texts.

The lexicon holds words and beginnings of words that labelled toxic texts have
significantly more often than others.  Copies of one text tell no more than one
of them, so near copies among the labelled texts are set aside first.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm import words
from narrata.llm.graph import roots
from narrata.llm.scratch import cut

#: Most labelled documents to learn from.
SAMPLE = 8000
#: Letters a model tells apart: none, a to z, U+00E0 to U+00FF, all others.
LETTERS = 60
#: Lengths of beginnings of words that count besides whole words.
BEGINNINGS = (5, 6)
#: Least share of toxic texts among the texts of a lexicon entry.
LEAST_SHARE = 0.8
#: Minimum hashes of a labelled text, in bands of so many.
HASHES, BAND = 24, 3
#: Hypotheses kept at each place of a lattice.
BEAM = 8
#: Odd tokens a worker remembers.
REMEMBERED = 20_000
#: Characters of text read at once.
PIECE = 1 << 20

# What signs stand for, and what joins spaced-out letters.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "€": "e", "£": "l", "§": "s",
}
JOINTS = " .-_~'·,/\\"
#: Log-odds of the channel: a letter written as a sign, a sign that parts words after all, a joint that does, a joint left out, a letter written again.
SIGN, PART, BREAK, JOINED, AGAIN = math.log(0.1), math.log(0.02), math.log(0.3), math.log(0.1), math.log(0.2)

_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[0-9@$!|+(<*€£§]|(\w)\1\1|\w[.\-_~'·,/\\]\w")
_SPACED = re.compile(r"(?<!\S)(?:\S\s{1,3}){3,}\S(?!\S)")
_EDGES = ".,;:!?\"'()[]{}…„”“«»"
_UNSEEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def _code(c: str) -> int:
    k = ord(c)
    if 97 <= k <= 122:
        return k - 96
    if 0xE0 <= k <= 0xFF and k != 0xF7:
        return k - 0xE0 + 27
    return LETTERS - 1 if c.isalpha() else 0


_CODES = np.array([_code(chr(k)) if not 0xD800 <= k < 0xE000 else 0 for k in range(1 << 16)], np.int64)


def letter_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): how often each run of three letters occurs in all texts; a word has two blanks before and after it."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for at in range(0, len(t or ""), PIECE):
                    # Two letters more, so that grams across the border are counted once.
                    _add_grams(t[max(at - 2, 0) : at + PIECE], total)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])

    return docs.select(text).mapInArrow(job, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _add_grams(text: str, total: np.ndarray) -> None:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[0], np.where(points < 1 << 16, _CODES[np.minimum(points, (1 << 16) - 1)], 0), [0]])
    blank = c == 0
    # One blank of many stays, and stands for two.
    stays = ~blank | np.append(True, ~blank[:-1])
    c = np.repeat(c[stays], np.where(blank[stays], 2, 1))
    grams = (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]
    ids, n = np.unique(grams, return_counts=True)
    total[ids] += n


@dataclass(frozen=True)
class Model:
    """Log-probability of each letter after two others, and the lexicon with the log of what each entry leaves to chance."""

    letters: np.ndarray
    lexicon: dict[str, float]
    base: float


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities from counts of three letters, smoothed by those of two and one."""
    n = counts.reshape(LETTERS, LETTERS, LETTERS).astype(np.float64)
    one = n.sum((0, 1)) + 0.5
    one /= one.sum()
    two = n.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    three = (n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5)
    return np.log(three).astype(np.float32).ravel()


def with_words(letters: np.ndarray, lexicon: Iterable[str], share: float = 0.5) -> np.ndarray:
    """The model for texts in which words of the lexicon are so much likelier wherever one may go on."""
    counts = np.zeros(LETTERS**3, np.int64)
    for word in sorted(lexicon):
        _add_grams(word, counts)
    n = counts.reshape(LETTERS**2, LETTERS).astype(np.float64)
    there = n.sum(1, keepdims=True)
    p = np.exp(letters.reshape(LETTERS**2, LETTERS).astype(np.float64))
    p = np.where(there > 0, (1 - share) * p + share * n / np.maximum(there, 1), p)
    return np.log(p).astype(np.float32).ravel()


class Channel:
    """Restores odd tokens; one per worker and model."""

    def __init__(self, letters: np.ndarray) -> None:
        self.logp: list[float] = letters.tolist()
        self.known: dict[str, tuple[str, ...]] = {}

    def restore(self, token: str) -> tuple[str, ...]:
        """The likeliest words behind a token."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = tuple("".join(self._best(token)).split())
            if len(token) < 256:
                self.known[token] = found
        return found

    def _best(self, token: str) -> list[str]:
        logp = self.logp
        # State: codes of the last two letters.  Value: score and the letters so far, linked backwards.
        front: dict[tuple[int, int], tuple[float, object]] = {(0, 0): (0.0, None)}
        for c in token:
            ahead: dict[tuple[int, int], tuple[float, object]] = {}

            def offer(state: tuple[int, int], score: float, path: object, ahead=ahead) -> None:
                old = ahead.get(state)
                if old is None or score > old[0]:
                    ahead[state] = (score, path)

            code = _code(c)
            choices = [(c, code, 0.0)] if code else [(x, _code(x), SIGN) for x in SIGNS.get(c, "")]
            joint, parts = c in JOINTS, PART if c in SIGNS else BREAK
            for (a, b), (score, path) in front.items():
                at = (a * LETTERS + b) * LETTERS
                for letter, k, cost in choices:
                    offer((b, k), score + cost + logp[at + k], (letter, path))
                    if k == b:
                        offer((a, b), score + cost + AGAIN, path)
                if not code:
                    offer((0, 0), score + parts + (logp[at] if b else 0.0), (" ", path))
                    if joint:
                        offer((a, b), score + JOINED, path)
            if len(ahead) > BEAM:
                ahead = dict(sorted(ahead.items(), key=lambda x: -x[1][0])[:BEAM])
            front = ahead
        path = max((s + (self.logp[(a * LETTERS + b) * LETTERS] if b else 0.0), i, p) for i, ((a, b), (s, p)) in enumerate(front.items()))[2]
        out = []
        while path is not None:
            letter, path = path
            out.append(letter)
        return out[::-1]


def restored_words(text: str, channel: Channel) -> set[str]:
    """The distinct words of a text, lower-cased, with those behind its odd tokens."""
    found: set[str] = set()
    for piece in _pieces(text):
        if not piece.isascii():
            piece = unicodedata.normalize("NFKC", piece.translate(_UNSEEN))
        piece = piece.lower()
        found.update(_WORD.findall(piece))
        for token in set(piece.split()):
            token = token.strip(_EDGES) if len(token) > 1 else ""
            if len(token) > 2 and _ODD.search(token):
                found.update(channel.restore(token))
        for run in _SPACED.findall(piece):
            found.update(channel.restore(" ".join(run.split())))
    return found


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces that end after a token of two characters or more."""
    at, n = 0, len(text)
    while at < n:
        to = min(n, at + PIECE)
        while to < n and not (text[to].isspace() and not text[to - 1].isspace() and not text[to - 2].isspace()):
            to += 1
        yield text[at:to]
        at = to


def entries(found: Iterable[str]) -> set[str]:
    """What a lexicon can hold of some words: themselves, and their beginnings, marked by a caret behind."""
    found = {w for w in found if len(w) > 2}
    return found.union(*({w[:k] + "^" for w in found if len(w) > k} for k in BEGINNINGS))


_CHANNELS: list[tuple[int, Channel]] = []


def _channel(letters: np.ndarray) -> Channel:
    if not _CHANNELS or _CHANNELS[0][0] != id(letters):
        _CHANNELS[:] = [(id(letters), Channel(letters))]
    return _CHANNELS[0][1]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> Model:
    """Count letters over all documents, and learn the lexicon from at most ``most`` labelled ones.

    Those are the ones with the smallest hashes of their keys.  Tasks sketch
    and read them; the driver gets sketches, and the lexicon.
    """
    spark = docs.sparkSession
    counts = np.zeros(LETTERS**3, np.int64)
    for r in letter_counts(docs, text).collect():  # as many as runs of three letters there are, 216,000 at most
        counts[r["gram"]] = r["n"]
    letters = letter_model(counts)

    marks = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key)).agg(F.max(label).cast("int").alias("__label"))
    chosen = marks.orderBy(F.xxhash64(key), key).limit(most)
    sample = docs.select(F.col(key), F.col(text).alias("__text")).join(F.broadcast(chosen), key)  # `most` rows at most
    sample = cut(sample.groupBy(F.sha2("__text", 256).alias("id")).agg(F.first("__text").alias("text"), F.max("__label").alias("label")).filter("text IS NOT NULL"), "labelled")
    kept = _one_of_each(sample)
    toxic = sum(y for _, y in kept)
    base = (toxic + 1) / (len(kept) + 2)
    if not 0 < toxic < len(kept):
        return Model(letters, {}, base)

    ids, given = spark.sparkContext.broadcast({i for i, _ in kept}), spark.sparkContext.broadcast(letters)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = _channel(given.value)
        for batch in batches:
            for i, t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i in ids.value:
                    e = list(entries(restored_words(t, channel)))
                    yield pa.RecordBatch.from_arrays([pa.array(e, pa.string()), pa.array(np.full(len(e), y, np.int64))], names=["entry", "toxic"])

    seen = sample.mapInArrow(job, "entry string, toxic long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("texts"))
    seen = cut(seen.filter("toxic > 0"), "entries")
    beat = _beat({r["texts"]: r["count"] for r in seen.groupBy("texts").count().collect()}, base)  # a row for each number of texts of the sample
    gain = F.col("toxic") * F.log(F.col("toxic") / F.col("texts") / base) + F.when(F.col("texts") > F.col("toxic"), (F.col("texts") - F.col("toxic")) * F.log((1 - F.col("toxic") / F.col("texts")) / (1 - base))).otherwise(0)
    strong = seen.filter(F.col("toxic") >= LEAST_SHARE * F.col("texts")).filter(gain >= beat)
    lexicon = {r["entry"]: math.log((r["texts"] - r["toxic"] + 0.5) / (r["texts"] + 1)) for r in strong.collect()}  # words of the sample
    return Model(with_words(letters, [e for e in lexicon if not e.endswith("^")]), lexicon, _left_over(base, len(kept)))


def _beat(entries: dict[int, int], base: float) -> float:
    """Log-likelihood by which an entry must beat chance, as so many are tried; those in too few texts to ever do so do not count.

    ``entries`` has the number of entries that occur in so many texts; without
    any effect each text is toxic with a chance of ``base``.
    """
    tried = 0
    for texts in sorted(entries, reverse=True):
        if tried and texts * -math.log(base) < math.log(tried) + 1:
            break
        tried += entries[texts]
    return math.log(max(tried, 1)) + 1


def _left_over(base: float, texts: int) -> float:
    """Chance of a text without any lexicon entry: far below the share of toxic texts, and never certain."""
    return base / (1 + math.log1p(texts))


def _one_of_each(sample: DataFrame) -> list[tuple[str, int]]:
    """(id, label) of one text of each group of near copies, told by minimum hashes of runs of four words."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = words.mix(np.arange(1, HASHES + 1, dtype=np.uint64))
        for batch in batches:
            data, offsets = words.buffers(batch.column(1))
            out = np.zeros((len(batch), HASHES), np.int64)
            for r in range(len(batch)):
                a, b = int(offsets[r]), int(offsets[r + 1])
                hashes, _, first = words.word_hashes(data[a:b], np.array([0, b - a]))
                shingles, _ = words.shingle_hashes(hashes, first, 4)
                if len(shingles):
                    out[r] = [int(np.min(words.mix(shingles ^ s)) >> np.uint64(1)) for s in steps]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), HASHES).cast(pa.list_(pa.int64()))], names=["id", "label", "hashes"])

    rows = sample.select("id", "text", "label").mapInArrow(job, "id string, label int, hashes array<long>").orderBy("id").collect()  # of the sample, without texts
    if not rows:
        return []
    h = np.array([r["hashes"] for r in rows])
    links = []
    for band in range(0, HASHES, BAND):
        keys = words.fold(words.mix(h[:, band : band + BAND].astype(np.uint64) + np.arange(BAND, dtype=np.uint64)).ravel(), np.arange(0, len(rows) * BAND + 1, BAND))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        links.append((order[:-1][same], order[1:][same]))
    root = roots(len(rows), *(np.concatenate(x) for x in zip(*links, strict=True)))
    # A group is toxic if one of its texts is; that one stays then.
    best = {}
    for k, r in enumerate(rows):
        if root[k] not in best or r["label"] > rows[best[root[k]]]["label"]:
            best[root[k]] = k
    return [(rows[k]["id"], rows[k]["label"]) for k in best.values()]


def chance(text: str | None, model: Model, channel: Channel) -> float:
    """Chance that a text is toxic: that not all of its lexicon entries are there by chance."""
    hits = entries(restored_words(text, channel)) & model.lexicon.keys() if text else ()
    rest = math.log1p(-model.base) + sum(sorted(model.lexicon[e] for e in hits))
    return min(max(1 - math.exp(max(rest, -30.0)), 0.0), 1.0)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score (chance of being toxic) and predicted to every row.

    Edge cases: a null or empty text has no words and gets the chance of a
    text without lexicon entries; long texts are read in pieces; repeated rows,
    null keys and empty tables are as they come.  Without labels, or of one
    class alone, all texts get the share of toxic ones.  Other columns pass
    through; columns named score or predicted are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    kept = docs.sparkSession.sparkContext.broadcast(model)  # the letters' table, a megabyte, and the lexicon

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept.value
        channel = _channel(model.letters)
        for batch in batches:
            p = [chance(t.as_py(), model, channel) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields]).add("score", "double").add("predicted", "integer")
    return docs.mapInArrow(job, schema)
