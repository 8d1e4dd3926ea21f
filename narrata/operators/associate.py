"""Edited blocks matched with the blocks they came from."""

from __future__ import annotations

from difflib import SequenceMatcher
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.operators.text import match_text

LEAST = 0.6
#: Texts whose lengths have a larger product are compared by an automaton, if they have no long part in common.
WIDE = 250_000
#: Letters of the shortest parts that are looked for, as one string in the other.
PART = 8
ID = ["book_id", "chapter_id"]


def _ahead(a: str, i: int, b: str, j: int) -> int:
    """How many letters from i in a on are those from j in b on."""
    n, most, step, grows = 0, min(len(a) - i, len(b) - j), 32, True
    while n < most and step:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 1 + grows
        else:
            step, grows = step // 2, False
    return n


def _behind(a: str, i: int, b: str, j: int) -> int:
    """How many letters before i in a are those before j in b."""
    n, most, step, grows = 0, min(i, j), 32, True
    while n < most and step:
        step = min(step, most - n)
        if a[i - n - step : i - n] == b[j - n - step : j - n]:
            n += step
            step *= 1 + grows
        else:
            step, grows = step // 2, False
    return n


def _common(a: str, b: str) -> int:
    """Letters of the longest common subsequence, by the bits of one number: no likeness counts more."""
    # What both begin and end with is part of one.
    start = _ahead(a, 0, b, 0)
    a, b = a[start:], b[start:]
    end = _behind(a, len(a), b, len(b))
    a, b = a[: len(a) - end], b[: len(b) - end]
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        both = row & places.get(c, 0)
        row = (row + both | row - both) & every
    return start + end + len(a) - row.bit_count()


def _longest_part(a: str, b: str, most: int) -> tuple[int, int, int] | None:
    """As ``_longest``, by parts of b that stand side by side; None if nothing long is common or parts are too often in a.

    Nothing common has more than ``most`` letters.  Of g letters each, one part
    at least lies in any common part of 2 g - 1 letters; so once such a one is
    found, all as long have been found.
    """
    g, left = (most + 1) // 2, 256 + len(b) // 16
    while g >= PART:
        best, known = (0, 0, 0), {}
        for j in range(0, len(b) - g + 1, g):
            part = b[j : j + g]
            i = a.find(part)
            while i >= 0:
                left -= 1
                if left < 0:
                    return None
                if known.get(i - j, 0) < j + g:
                    back = _behind(a, i, b, j)
                    n = back + g + _ahead(a, i + g, b, j + g)
                    known[i - j] = j - back + n
                    best = min(best, (-n, i - back, j - back))
                i = a.find(part, i + 1)
        n = -best[0]
        if n >= 2 * g - 1:
            return best[1], best[2], n
        g = (n + 1) // 2 if n else g // 2
    return None


def _first(a: str, b: str, n: int, places: int = 16) -> tuple[int, int, int] | None:
    """As ``_longest``, where nothing common has more than n letters and such a part begins within some places of a."""
    for i in range(min(places, len(a) - n + 1)):
        j = b.find(a[i : i + n])
        if j >= 0:
            return i, j, n
    return None


def _longest_short(a: str, b: str, most: int) -> tuple[int, int, int]:
    """As ``_longest``, where nothing common has more than ``most`` letters, and these are few."""
    for n in range(most, 0, -1):
        there = {b[j : j + n] for j in range(len(b) - n + 1)}
        for i in range(len(a) - n + 1):
            if a[i : i + n] in there:
                return i, b.find(a[i : i + n]), n
    return 0, 0, 0


def _longest(a: str, b: str) -> tuple[int, int, int]:
    """Longest common part as (start in a, start in b, length), the earliest in a, then in b, by an automaton of the parts of b."""
    to, up, size, first, last = [{}], [-1], [0], [-1], 0
    for k, c in enumerate(b):
        new = len(to)
        to.append({})
        size.append(size[last] + 1)
        first.append(k)
        up.append(0)
        at, last = last, new
        while at >= 0 and c not in to[at]:
            to[at][c] = new
            at = up[at]
        if at >= 0:
            known = to[at][c]
            if size[known] == size[at] + 1:
                up[new] = known
            else:
                copy = len(to)
                to.append(to[known].copy())
                size.append(size[at] + 1)
                first.append(first[known])
                up.append(up[known])
                up[known] = up[new] = copy
                while at >= 0 and to[at].get(c) == known:
                    to[at][c] = copy
                    at = up[at]
    at, n, best = 0, 0, (0, 0, 0)
    for k, c in enumerate(a):
        while at and c not in to[at]:
            at = up[at]
            n = size[at]
        if c in to[at]:
            at, n = to[at][c], n + 1
            if n > best[2]:
                best = (k + 1 - n, first[at] + 1 - n, n)
    return best


def likeness(a: str, b: str) -> float:
    """``SequenceMatcher(None, a, b, autojunk=False).ratio()``; parts that are long on both sides do not take time with their product."""
    equal, parts = 0, [(a, b, len(a))]
    while parts:
        x, y, most = parts.pop()
        most = min(most, len(x), len(y))
        if most == 0:
            continue
        if len(x) == 1 or len(y) == 1:
            equal += x in y or y in x
            continue
        # Beside the longest common part there is none that is longer, so often the next one is found at once.
        found = _first(x, y, most) or _longest_part(x, y, most)
        if found is None and len(x) * len(y) <= WIDE:
            equal += sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
            continue
        i, j, n = found or (_longest_short(x, y, most) if most < 2 * PART else _longest(x, y))
        if n:
            equal += n
            parts += [(x[:i], y[:j], n), (x[i + n :], y[j + n :], n)]
    return 2.0 * equal / (len(a) + len(b)) if a or b else 1.0


def _letters(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) & 127, minlength=128)


def _pairs(old: list[tuple[int, str]], new: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """(new, old) places of the most similar pairs, each block in one pair at most.

    Pairs go by likeness, then by distance, then by the earlier old and the
    later new block.  They wait in a heap by what bounds their likeness: common
    letters, then common letters in order, then the likeness itself.  The next
    of these is found only once a pair is first and both of its blocks are
    free, so what an edited block is not like is mostly never compared.
    """
    if not old or not new:
        return []
    letters, lengths, heap = np.array([_letters(t) for _, t in old]), np.array([len(t) for _, t in old]), []
    for j, (n, wanted) in enumerate(new):
        both = np.maximum(lengths + len(wanted), 1)
        bounds = np.where(lengths + len(wanted) > 0, 2.0 * np.minimum(letters, _letters(wanted)).sum(axis=1) / both, 1.0)
        heap += [(-float(bounds[i]), 0, abs(n - old[i][0]), old[i][0], -n, i, j) for i in np.flatnonzero(bounds >= LEAST).tolist()]
    heapify(heap)
    taken_new, taken_old, out = set(), set(), []
    while heap and len(taken_new) < len(new) and len(taken_old) < len(old):
        _, step, far, o, n, i, j = heappop(heap)
        if j in taken_new or i in taken_old:
            continue
        if step == 2:
            taken_new.add(j)
            taken_old.add(i)
            out.append((-n, o))
            continue
        a, b = old[i][1], new[j][1]
        like = likeness(a, b) if step else (2.0 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0)
        if like >= LEAST:
            # Of equal values, bounds come first: what they bound may be as much and nearer.
            heappush(heap, (-like, step + 1, far, o, n, i, j))
    return out


def nearest(olds: list[int], news: list[int]) -> list[tuple[int, int]]:
    """(new, old) places of equal texts, the nearest pair first, then that of the earlier old and the later new one.

    The nearest pair are neighbours in order of place, so only neighbours wait
    in a heap; when a pair goes, those beside it become neighbours.
    """
    order = sorted([(o, False) for o in olds] + [(n, True) for n in news])
    ahead, behind = list(range(-1, len(order) - 1)), list(range(1, len(order) + 1))
    gone, heap, out = [False] * len(order), [], []

    def offer(i: int, j: int) -> None:
        if 0 <= i and j < len(order) and order[i][1] != order[j][1]:
            (o, _), (n, _) = (order[i], order[j]) if order[j][1] else (order[j], order[i])
            heappush(heap, (abs(n - o), o, -n, i, j))

    for i in range(len(order) - 1):
        offer(i, i + 1)
    while heap:
        _, o, n, i, j = heappop(heap)
        if gone[i] or gone[j]:
            continue
        gone[i] = gone[j] = True
        out.append((-n, o))
        left, right = ahead[i], behind[j]
        if left >= 0:
            behind[left] = right
        if right < len(order):
            ahead[right] = left
        offer(left, right)
    return out


def _job(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    equal, place = {}, {}
    for r in rows:
        equal.setdefault(r["norm"], ([], []))[r["new"]].append(r["block_index"])
    # Equal texts are most alike: they are paired before others, the nearest first.
    for olds, news in equal.values():
        place |= nearest(olds, news)
    done = set(place.values())
    left = [[(r["block_index"], r["norm"]) for r in rows if r["new"] == side and (r["block_index"] not in place if side else r["block_index"] not in done)] for side in (False, True)]
    place |= dict(_pairs(*left))
    news = [r for r in rows if r["new"]]
    ids = [r["block_index"] for r in news]
    old = [place.get(k) for k in ids]
    return pa.table({"book_id": pa.array([r["book_id"] for r in news], pa.string()), "chapter_id": pa.array([r["chapter_id"] for r in news], pa.int64()), "block_index": pa.array(ids, pa.int32()), "old_index": pa.array(old, pa.int32())})


def associate_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(book_id, chapter_id, block_index, old_index): for each new block the old one it stands for, or null.

    Both sides have book_id, chapter_id, block_index and text.  Blocks of one
    text at one place are told by their counts; only what is left of a chapter,
    which is what was edited in it, is compared by likeness, one chapter at a
    time.  Both sides are shuffled together by chapter, with no join, for each of
    the two; chapters are not gathered in fewer tasks for being short, since
    their work is in Python.
    """
    sides = [
        d.select(F.col("book_id").cast("string"), F.col("chapter_id").cast("long"), F.col("block_index").cast("int"), match_text(F.col("text")).alias("norm"), F.lit(1 - k).alias("olds"), F.lit(k).alias("news"))
        for k, d in enumerate((old, new))
    ]
    tasks = int(old.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = sides[0].unionByName(sides[1]).repartition(tasks, *ID).groupBy(*ID, "block_index", "norm").agg(F.sum("olds").alias("olds"), F.sum("news").alias("news"))
    # What has no key or no text is no one's equal here, and stays with its chapter.
    same = (F.col("olds") > 0) & (F.col("news") > 0) & F.concat("book_id", "norm").isNotNull() & F.col("chapter_id").isNotNull() & F.col("block_index").isNotNull()
    kept = told.filter(same).select(*ID, "block_index", F.explode(F.sequence(F.lit(1), F.col("olds") * F.col("news"))).alias("times")).drop("times")
    sided = F.concat(F.array_repeat(F.lit(False), F.col("olds").cast("int")), F.array_repeat(F.lit(True), F.col("news").cast("int")))
    left = told.filter(~same).select(*ID, "block_index", "norm", F.explode(sided).alias("new"))
    edited = left.groupBy(*ID).applyInArrow(_job, "book_id string, chapter_id long, block_index int, old_index int")
    return kept.withColumn("old_index", F.col("block_index")).unionByName(edited)
