"""Quality by supervised subword embeddings.

A document is the mean of learned vectors of its words, its word pairs and the
character n-grams of its words, all hashed into one table; a softmax over that mean
gives the two classes.  Table and output weights are trained together by
stochastic gradient descent in numpy.

The output is linear in the mean, so once trained, each table row has one
number, the difference of the two classes' scores; a document's logit is the
mean of its features' numbers.  Scoring therefore is a few array operations
over the bytes of a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm import words

BUCKETS = 1 << 17
NGRAMS = (3, 4)
DIM = 8
#: Features without a vector that every text has besides its own, so that a text of one word does not swing.
NEUTRAL = 32
#: Most labelled documents to train on.
SAMPLE = 4000


@dataclass(frozen=True)
class Model:
    """One number per feature bucket, and the bias; plain arrays that tasks can take along."""

    weights: np.ndarray
    bias: float


def features(data: np.ndarray) -> np.ndarray:
    """Bucket of every word, word pair and character n-gram of one text's bytes, case kept.

    Character n-grams run within a word with the white space around it.
    """
    if len(data) == 0:
        return np.zeros(0, np.int64)
    sep = words._is_separator(words.SPACES)[data]
    text = np.concatenate([np.full(1, 32, np.uint8), np.where(sep, np.uint8(32), data), np.full(1, 32, np.uint8)])
    inner = text == 32
    out = []
    u = text.astype(np.uint32)
    for n in NGRAMS:
        m = len(u) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint32(n * 2654435761 % 2**32), np.uint32)
        space = np.zeros(m, bool)
        for k in range(n):
            h = (h ^ u[k : k + m]) * np.uint32(16777619)
            if 0 < k < n - 1:
                space |= inner[k : k + m]
        h ^= h >> np.uint32(15)
        out.append(h[~space])
    starts = np.flatnonzero(~inner[1:] & inner[:-1]) + 1
    if len(starts):
        powers = words._table(("p32", 1 << max(16, len(u).bit_length())), lambda: words._powers(words._BASE, 1 << max(16, len(u).bit_length())))
        values = np.where(inner, 0, u).astype(np.uint64) * powers[: len(u)]
        inverse = words._table(("i32", len(powers)), lambda: words._powers(words._INVERSE, len(powers)))
        word = (words.mix(np.add.reduceat(values, starts) * inverse[starts]) >> np.uint64(32)).astype(np.uint32)
        out += [word, _word_pairs(word)]
    return (np.concatenate(out) & np.uint32(BUCKETS - 1)).astype(np.int64) if out else np.zeros(0, np.int64)


def _word_pairs(word: np.ndarray) -> np.ndarray:
    """Hashed pairs of neighbouring words; a word with itself is one pair, whichever word it is."""
    a, b = word[:-1], word[1:]
    return np.where(a == b, np.uint32(100_000), (a * np.uint32(2246822519)) ^ (b * np.uint32(3266489917)))


def pieces(data: np.ndarray, size: int = words.PIECE) -> Iterator[np.ndarray]:
    """A text in pieces that end between words, so that features add up."""
    at = 0
    while at < len(data):
        to = min(len(data), at + size)
        if to < len(data):
            back = np.flatnonzero(words._is_separator(words.SPACES)[data[at:to]])
            to = at + int(back[-1]) + 1 if len(back) else to
        yield data[at:to]
        at = to


def train(texts: list[str], labels: list[int], epochs: int = 6, rate: float = 0.3, seed: int = 1) -> Model:
    """Fit by stochastic gradient descent, one document at a time.

    Without any document, or of one class alone, the model has the smoothed
    share of label 1 as bias and no weights.
    """
    y = np.array(labels, np.int64)
    ones = int(y.sum())
    prior = float(np.log((ones + 1) / (len(y) - ones + 1)))
    if ones in (0, len(y)):
        return Model(np.zeros(BUCKETS, np.float32), prior)
    rng = np.random.default_rng(seed)
    bags = []
    for t in texts:
        ids, n = np.unique(features(np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8)), return_counts=True)
        bags.append((ids, (n / (n.sum() + NEUTRAL)).astype(np.float32)))
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.array([0.0, prior], np.float32)
    steps, step = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            lr = rate * (1 - step / steps)
            step += 1
            mean = share @ table[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p).astype(np.float32)
            bias -= np.float32(lr) * p.astype(np.float32)
            # Each row's gradient has its share; the square root speeds up the rare ones.
            table[ids] -= (lr * 10) * np.outer(share, back).astype(np.float32)
    weights = table @ (out[:, 1] - out[:, 0])
    return Model(weights.astype(np.float32), float(bias[1] - bias[0]))


def logits(column: pa.Array, model: Model) -> np.ndarray:
    """Logit of label 1 for each text of a column."""
    data, offsets = words.buffers(column)
    out = np.full(len(offsets) - 1, model.bias)
    for r in range(len(out)):
        total, n = 0.0, 0
        for piece in pieces(data[offsets[r] : offsets[r + 1]]):
            ids = features(piece)
            total += float(model.weights[ids].sum(dtype=np.float64))
            n += len(ids)
        if n:
            out[r] += total / (n + NEUTRAL)
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE) -> Model:
    """Train on at most ``most`` labelled documents, those with the smallest key hashes.

    One task trains, so neither the texts nor what is learned from them come to
    the driver, which gets the numbers of the buckets alone.
    """
    rows = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key)).agg(F.max(label).cast("int").alias("__label"))
    chosen = rows.orderBy(F.xxhash64(key), key).limit(most)
    sample = docs.select(key, text).join(F.broadcast(chosen), key).dropDuplicates([key]).select(key, text, "__label")  # `most` rows at most

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        model = train([r[1] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    learned = sample.repartition(1).mapInArrow(job, "weights binary, bias double").first()
    return Model(np.frombuffer(bytes(learned.weights), np.float32), learned.bias) if learned else train([], [])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score (chance of label 1) and predicted to every row.

    Edge cases: a null or empty text has no features, and its score is the
    share of label 1 that the model learned as bias; long texts are read in
    pieces; a null key, repeated rows and an empty table are as they come.
    Other columns pass through; columns named score or predicted are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    kept = docs.sparkSession.sparkContext.broadcast(model)  # half a megabyte, fixed

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = logits(batch.column(text), kept.value)
            p = np.clip(1 / (1 + np.exp(-np.clip(z, -700, 700))), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields]).add("score", "double").add("predicted", "integer")
    return docs.mapInArrow(job, schema)
