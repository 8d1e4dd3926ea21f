"""Benchmark decontamination by latent semantic retrieval.

Documents are read in passages of one and a half to three times an item's
words, which overlap by two thirds.  A distributed randomised SVD of the
TF-IDF vectors of all documents' blocks gives a latent space of low rank.
Passages near an item there are candidates, and so are passages that share a
run of ``RUN`` words with it, whatever stands around them.  Of the candidates,
the longest common subsequence of words, with a check of the answer, decides.

Three scans of the texts, whatever the number of items: word counts, the SVD,
and the search.  None of them writes anything about a passage that is no hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm import words
from narrata.llm.scratch import cut

#: Words of an item that are compared at once; longer items are cut into pieces.
PIECE = 256
#: Words of a third of a passage; an item takes the smallest that is half its words or more.  Vectors are added up by GRAIN words.
SIZES = (8, 12, 16, 24, 32, 48, 64, 96, PIECE // 2)
GRAIN = 4
SHORTEST = 5
#: Items that are looked for together in one pass over a text.
ITEMS = 512
#: Hashed words, the rank of the space and what is added to it while it is sought, and words of a block of the SVD.
TERMS, RANK, MORE, BLOCK = 1 << 14, 48, 8, 64
#: Pieces in which the tasks' parts of a matrix are added up.
CHUNKS = 128
#: Share of all words that the commonest terms make up, which weigh nothing.
STOP = 0.5
#: Least latent cosine of a candidate, and the run of words that makes one without it.
NEAR, RUN = 0.5, 5
#: Share of an item's words in common order: enough alone, or enough with the answer.
FULL, PART, ANSWER = 0.7, 0.5, 0.5
TABLE = 1 << 22
#: Bytes of text searched at once.
TOGETHER = 1 << 20


@dataclass(frozen=True)
class Items:
    """Benchmark items of one size as term numbers; ``answers`` are where each one's answer begins."""

    ids: list
    terms: list[np.ndarray]
    answers: np.ndarray
    vocabulary: np.ndarray
    runs: np.ndarray
    run_of: list[np.ndarray]
    size: int

    def member(self) -> np.ndarray:
        out = np.zeros((len(self.ids), len(self.vocabulary)), bool)
        for k, t in enumerate(self.terms):
            out[k, t] = True
        return out


def run_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of the RUN words from each word on; of the last ones, fewer."""
    out = h.copy()
    for k in range(1, RUN):
        out[:-k] += words.mix_light(h[k:], k) * np.uint64(2 * k + 1)
    return words.mix(out)


def read_items(rows: list[tuple[object, str, str | None]]) -> list[Items]:
    """Items from (id, text, answer), by size and in blocks; without an answer, the last third of the text is it."""
    groups: dict[int, list[tuple]] = {}
    for item, text, answer in rows:
        whole = f"{text or ''} {answer}" if answer else text or ""
        h, _, first = words.word_hashes(*words.buffers(pa.array([text or "", whole], pa.string())), words.PUNCTUATED)
        at, h = first[1], h[first[1] : first[2]]
        begins = int(at) if answer else len(h) - len(h) // 3
        for a in range(0, len(h), PIECE):
            piece = h[a : a + PIECE]
            if len(piece) >= SHORTEST:
                size = next(s for s in SIZES if 2 * s >= len(piece))
                groups.setdefault(size, []).append((item, piece, min(max(begins - a, 0), len(piece))))
    out = []
    for size, group in sorted(groups.items()):
        for a in range(0, len(group), ITEMS):
            ids, hashed, answers = map(list, zip(*group[a : a + ITEMS], strict=True))
            vocabulary = np.unique(np.concatenate(hashed))
            runs, of = np.unique(np.concatenate([run_hashes(h)[: len(h) - RUN + 1] for h in hashed]), return_inverse=True)
            owner = np.repeat(np.arange(len(ids)), [len(h) - RUN + 1 for h in hashed])
            order = np.argsort(of, kind="stable")
            run_of = np.split(owner[order], np.searchsorted(of[order], np.arange(1, len(runs))))
            out.append(Items(ids, [np.searchsorted(vocabulary, h) for h in hashed], np.array(answers), vocabulary, runs, run_of, size))
    return out


def _known(values: np.ndarray, table: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that are listed, and their numbers in the sorted list."""
    at = np.flatnonzero(table[values & np.uint64(TABLE - 1)])
    found = np.minimum(np.searchsorted(listed, values[at]), len(listed) - 1)
    good = listed[found] == values[at]
    return at[good], found[good]


def _united(lists: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All values, sorted, and for each list which of its numbers each value has, or -1."""
    every = np.unique(np.concatenate(lists))
    own = [np.full(len(every), -1) for _ in lists]
    for places, values in zip(own, lists, strict=True):
        places[np.searchsorted(every, values)] = np.arange(len(values))
    return every, own


def _table(values: np.ndarray) -> np.ndarray:
    out = np.zeros(TABLE, bool)
    out[values & np.uint64(TABLE - 1)] = True
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Groups of rows: their batch, the first one's number, their word hashes and where each one's begin."""
    for batch in batches:
        data, offsets = words.buffers(batch.column("text"))
        for i, j in words.groups(offsets, TOGETHER):
            h, _, first = words.word_hashes(data, offsets[i : j + 1], words.PUNCTUATED)
            yield batch, i, h, first


def _terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - (TERMS - 1).bit_length())).astype(np.int64)


def _sum(table: pa.Table) -> pa.Table:
    """Parts of one piece of a matrix, added up."""
    total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in table.column("part").to_pylist())
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of all tasks' matrices of TERMS rows: a few megabytes, whatever the number of documents."""
    rows = parts.groupBy("chunk").applyInArrow(_sum, "chunk int, part binary").collect()
    out = np.zeros((CHUNKS, TERMS // CHUNKS, width), np.float32)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["part"], np.float32).reshape(-1, width)
    return out.reshape(TERMS, width)


def _chunks(matrix: np.ndarray) -> pa.RecordBatch:
    parts = matrix.astype(np.float32).reshape(CHUNKS, -1)
    some = np.flatnonzero(parts.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["chunk", "part"])


def term_weights(docs: DataFrame) -> np.ndarray:
    """Inverse frequency of each hashed word over all documents; 0 for the commonest."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TERMS, np.int64)
        for _, _, h, _ in _texts(batches):
            counts += np.bincount(_terms(h), minlength=TERMS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(job, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # TERMS at most
    counts = np.zeros(TERMS, np.int64)
    for r in rows:
        counts[r["term"]] = r["n"]
    total = counts.sum()
    weights = np.log((total + 1) / (counts + 1)).astype(np.float32)
    order = np.argsort(-counts, kind="stable")
    weights[order[np.cumsum(counts[order]) < STOP * total]] = 0
    return weights


@dataclass(frozen=True)
class Grains:
    """Each row's words in grains of GRAIN: ``term`` of every word, the ``owner`` row and ``grain`` of it, and where each row's grains ``begin``."""

    term: np.ndarray
    owner: np.ndarray
    grain: np.ndarray
    begin: np.ndarray

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        """Sum of the vectors of each grain's words; ``vectors`` has a last row of zeros for the places of a row's last grain that no word has."""
        place = np.full((int(self.begin[-1]), GRAIN), TERMS)
        # The first word of a grain is the one whose grain is not that of the word before.
        fresh = np.flatnonzero(np.append(True, self.grain[1:] != self.grain[:-1])) if len(self.grain) else np.zeros(0, np.int64)
        place[self.grain, np.arange(len(self.grain)) - fresh[self.grain]] = self.term
        out = vectors[place[:, 0]]
        for k in range(1, GRAIN):
            out += vectors[place[:, k]]
        return out


def _grains(h: np.ndarray, first: np.ndarray) -> Grains:
    length = np.diff(first)
    begin = np.concatenate([[0], np.cumsum(-(-length // GRAIN))])
    owner = np.repeat(np.arange(len(length)), length)
    return Grains(_terms(h), owner, begin[owner] + (np.arange(len(h)) - first[owner]) // GRAIN, begin)


def _padded(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])


def latent_space(docs: DataFrame, weights: np.ndarray, seed: int = 0) -> np.ndarray:
    """A vector for each hashed word, its weight included: leading right singular vectors by randomised range finding.

    A has the TF-IDF vectors of all documents' blocks as rows.  One scan takes
    a random matrix through A and back; what it is mapped to spans the space.
    """
    start = np.random.default_rng(seed).standard_normal((TERMS, RANK + MORE)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((weights, _padded(start * weights[:, None])))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start = shared.value
        out = np.zeros((TERMS, start.shape[1]))
        for _, _, h, first in _texts(batches):
            if len(h) == 0:
                continue
            g = _grains(h, first)
            of = np.diff(g.begin)
            blocks = np.concatenate([[0], np.cumsum(-(-of // (BLOCK // GRAIN)))])
            begins, row = _ranges(np.zeros(len(of), np.int64), np.diff(blocks))
            z = np.add.reduceat(g.sums(start), g.begin[row] + begins * (BLOCK // GRAIN))
            block = blocks[g.owner] + (g.grain - g.begin[g.owner]) // (BLOCK // GRAIN)
            keep = weights[g.term] > 0
            term, block = g.term[keep], block[keep]
            own = weights[term]
            z /= np.maximum(np.bincount(block, own * own, int(blocks[-1])), 1e-9)[:, None].astype(np.float32)
            for k in range(z.shape[1]):
                out[:, k] += np.bincount(term, own * z[block, k], TERMS)
        yield _chunks(out)

    spread = _summed(docs.select("text").mapInArrow(job, "chunk int, part binary"), RANK + MORE)
    basis, values, _ = np.linalg.svd(spread.astype(np.float64), full_matrices=False)
    keep = values[:RANK] > values[0] * 1e-9 if values[0] > 0 else values[:RANK] > 1
    return (basis[:, :RANK][:, keep] * weights[:, None]).astype(np.float32)


def common_lengths(masks: np.ndarray, pair: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each pair, bit by bit over the items, for all pairs together.

    ``masks`` says where in its item each word of a passage stands, as bits,
    one row a word; ``pair`` has each row's pair, in order; ``whole`` has the
    bits of each pair's item that count.
    """
    n = np.bincount(pair, minlength=len(whole))
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    v = whole.copy()
    for t in range(int(n.max(initial=0))):
        some = np.flatnonzero(n > t)
        m = masks[first[some] + t] & whole[some]
        u, carry = v[some] & m, np.zeros(len(some), np.uint64)
        for w in range(v.shape[1]):
            old = v[some, w]
            total = old + u[:, w]
            over = total < old
            total += carry
            over |= total < carry
            v[some, w] = total | (old & ~m[:, w])
            carry = over.astype(np.uint64)
    return np.bitwise_count(whole & ~v).sum(axis=1).astype(np.int64)


def _bits(begin: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` 64-bit words with the bits from ``begin`` to ``end`` set."""
    place = np.arange(64 * width)
    on = (place >= begin[:, None]) & (place < end[:, None])
    return np.packbits(on.reshape(len(begin), width, 64), axis=2, bitorder="little").view("<u8").reshape(len(begin), width).astype(np.uint64)


@dataclass(frozen=True)
class Query:
    """What a task needs to look for a block of items: their vectors, and tables of their words and runs."""

    items: Items
    vectors: np.ndarray
    member: np.ndarray
    needed: np.ndarray
    keys: np.ndarray
    masks: np.ndarray
    lengths: np.ndarray


def query(items: Items, space: np.ndarray) -> Query:
    vectors = np.stack([space[_terms(items.vocabulary[t])].sum(axis=0) for t in items.terms])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    lengths = np.array([len(t) for t in items.terms])
    width = -(-int(lengths.max()) // 64)
    key = np.concatenate([t + k * len(items.vocabulary) for k, t in enumerate(items.terms)])
    place = np.concatenate([np.arange(n) for n in lengths])
    keys, at = np.unique(key, return_inverse=True)
    masks = np.zeros((len(keys), width), np.uint64)
    np.bitwise_or.at(masks, (at, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return Query(items, vectors.astype(np.float32), items.member(), np.ceil(PART * lengths), keys, masks, lengths)


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from each ``first`` on, ``n`` of them, and whose each is."""
    ends = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(ends[-1]) - ends[owner] + first[owner], owner


def _candidates(q: Query, sums: np.ndarray, start: np.ndarray, stop: np.ndarray, run_at: np.ndarray, run: np.ndarray, grain_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (passage, item) near each other or with a run in common, and their cosine."""
    passage, item, cosine = [], [], []
    for a in range(0, len(start), 4096):
        z = (sums[stop[a : a + 4096]] - sums[start[a : a + 4096]]).astype(np.float32)
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        near = z @ q.vectors.T
        p, k = np.nonzero(near >= NEAR)
        passage.append(p + a)
        item.append(k)
        cosine.append(near[p, k])
    if len(run_at):
        # Passages that begin in the last three steps before a run hold it.
        of = np.repeat(np.arange(len(run)), [len(q.items.run_of[r]) for r in run])
        whose = np.concatenate([q.items.run_of[r] for r in run])
        grain = grain_at[run_at[of]]
        last = np.searchsorted(start, grain, "right") - 1
        for back in range(4):
            p = last - back
            good = (p >= 0) & (stop[np.maximum(p, 0)] > grain)
            passage.append(p[good])
            item.append(whose[good])
            z = sums[stop[p[good]]] - sums[start[p[good]]]
            cosine.append((z * q.vectors[whose[good]]).sum(axis=1) / np.maximum(np.linalg.norm(z, axis=1), 1e-12))
    passage, item, cosine = map(np.concatenate, (passage, item, cosine))
    _, one = np.unique(passage * len(q.lengths) + item, return_index=True)
    return passage[one], item[one], cosine[one]


def _verified(q: Query, passage: np.ndarray, item: np.ndarray, at: np.ndarray, term: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the pairs that pass, and their shares of the item's and of the answer's words."""
    low, high = np.searchsorted(at, start[passage]), np.searchsorted(at, stop[passage])
    keep = np.flatnonzero(high - low >= q.needed[item])
    place, pair = _ranges(low[keep], (high - low)[keep])
    held = q.member[item[keep][pair], term[place]]
    enough = np.bincount(pair, held, len(keep)) >= q.needed[item[keep]]
    some = held & enough[pair]
    place, pair = place[some], (np.cumsum(enough) - 1)[pair[some]]
    keep = keep[enough]
    if len(keep) == 0:
        return keep, np.zeros(0), np.zeros(0)
    own = item[keep]
    masks = q.masks[np.searchsorted(q.keys, own[pair] * len(q.items.vocabulary) + term[place])]
    n, begins, width = q.lengths[own], q.items.answers[own], q.masks.shape[1]
    share = common_lengths(masks, pair, _bits(np.zeros(len(own), np.int64), n, width)) / n
    told = np.where(n > begins, common_lengths(masks, pair, _bits(begins, n, width)) / np.maximum(n - begins, 1), 1.0)
    good = (share >= FULL) | ((share >= PART) & (told >= ANSWER))
    return keep[good], share[good], told[good]


def _search(docs: DataFrame, queries: list[Query], space: np.ndarray) -> DataFrame:
    """One row per document, item and passage that passes."""
    shared = docs.sparkSession.sparkContext.broadcast((queries, _padded(space)))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, space = shared.value
        vocabulary, words_of = _united([q.items.vocabulary for q in queries])
        listed, runs_of = _united([q.items.runs for q in queries])
        table, run_table = _table(vocabulary), _table(listed)
        before = 0
        numbers = []
        for q in queries:
            numbers.append(before)
            before += len(q.lengths)
        for batch, i, h, first in _texts(batches):
            if len(h) == 0:
                continue
            g, runs = _grains(h, first), run_hashes(h)
            owner, grain, begin = g.owner, g.grain, g.begin
            n = np.diff(begin)
            # Sums of the words before each grain.
            sums = np.zeros((int(begin[-1]) + 1, space.shape[1]))
            np.cumsum(g.sums(space), axis=0, out=sums[1:], dtype=np.float64)
            at, known = _known(h, table, vocabulary)
            run_at, run = _known(runs, run_table, listed)
            inside = run_at + RUN <= first[owner[run_at] + 1]
            run_at, run = run_at[inside], run[inside]
            for q, own, own_runs, number in zip(queries, words_of, runs_of, numbers, strict=True):
                step = q.items.size // GRAIN
                # The last passage of a row begins two steps before its end; a shorter row is one passage.
                count = np.where(n > 0, np.maximum(-(-n // step) - 2, 1), 0)
                start, row = _ranges(np.zeros(len(n), np.int64), count)
                start = begin[row] + start * step
                stop = np.minimum(start + 3 * step, begin[row + 1])
                some = own_runs[run] >= 0
                passage, item, cosine = _candidates(q, sums, start, stop, run_at[some], own_runs[run[some]], grain)
                if len(passage) == 0:
                    continue
                some = own[known] >= 0
                begins = first[row] + (start - begin[row]) * GRAIN
                ends = np.minimum(first[row] + (stop - begin[row]) * GRAIN, first[row + 1])
                good, share, told = _verified(q, passage, item, at[some], own[known[some]], begins, ends)
                which = passage[good]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row[which] + i)), pa.array((begins - first[row])[which]), pa.array((item[good] + number).astype(np.int32)), pa.array(share), pa.array(told), pa.array(cosine[good].astype(np.float64))],
                    names=["doc_id", "begin", "piece", "lcs", "answer", "cosine"],
                )

    return docs.select("doc_id", "text").mapInArrow(job, "doc_id long, begin long, piece int, lcs double, answer double, cosine double")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """Documents that hold benchmark items: doc_id, item_id, lcs, answer, cosine, begin.

    One row per document and item, with the passage that shares the longest
    common subsequence: the shares of the item's and of its answer's words in
    it, the latent cosine, and the number of words before the passage.

    Edge cases: null and empty texts hold nothing; items that are null or have
    fewer than ``SHORTEST`` words are no evidence and match nothing; a null
    key is no document, a null item id is reported as null; rows that share a
    key are one document; repeated items are found once each; texts of any
    length are read whole; empty tables give an empty result; further columns
    are dropped.  The benchmark is the query set: its items are collected and
    broadcast, some kilobytes each.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    told = F.col(answer) if answer else F.lit(None).cast("string")
    listed = benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("text"), told.alias("answer")).distinct()
    kind = dict(listed.dtypes)["item_id"]
    blocks = read_items(sorted((tuple(r) for r in listed.collect()), key=str))
    if not blocks:
        return docs.sparkSession.createDataFrame([], f"doc_id long, item_id {kind}, lcs double, answer double, cosine double, begin long")
    space = latent_space(docs, term_weights(docs))
    hits = cut(_search(docs, [query(b, space) for b in blocks], space), "bench-hits")
    ids = [(k, i) for k, i in enumerate(i for b in blocks for i in b.ids)]
    names = docs.sparkSession.createDataFrame(ids, f"piece int, item_id {kind}")
    hits = hits.join(F.broadcast(names), "piece")
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "answer", "cosine", (-F.col("begin")).alias("begin"))).alias("best"))
    return best.select("doc_id", "item_id", "best.lcs", "best.answer", "best.cosine", (-F.col("best.begin")).alias("begin"))
