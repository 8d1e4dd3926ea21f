"""Jaccard join on word shingles with adaptive multi-match prefixes.

All shingles have one order: those that very many documents share come last,
hashes decide otherwise.  Of a set of ``n`` shingles, a partner must share
``a = ceil(t n)``; so two partners share at least ``l`` among the first
``n - a + l`` of each.  Each document chooses its own ``l``: a longer prefix
reads more lists, but lets fewer candidates through.  A pair is verified if it
shares as many prefix shingles as the smaller of its two choices.

Groups of copies do not produce their pairs.  Equal sets are one node.  While
more pairs are left than a small multiple of the prefix rows, nodes that share
a prefix shingle are compared with one pivot each, the links found are
contracted, and only pairs of different components go on.  What is left in
large lists is compared block by block inside tasks: by bounds first, which
leave the nodes that may have a partner, then these by their whole sets.  A
task returns which components its links join, so never more rows than it has
read; small lists are joined.  So all components come out exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.llm import words
from narrata.llm.graph import components, roots, small
from narrata.llm.scratch import cut

#: A shingle is common if it makes up this share of all; so at most so many are.
COMMON = 200_000
#: Shingles looked at together when common ones are counted.
CHUNK = 1 << 20
#: Numbers of matches that a document can choose from.
MATCHES = (1, 2, 4, 8, 16)
ROUNDS = 6
#: Components of a list, and pairs for each of its rows, from which on its pairs are looked for inside tasks.
HEAVY = 16
#: Rows of a block of a heavy list, and of the squares that a task looks at together.
BLOCK, SQUARE = 8192, 512
#: Shingles of a block of whole sets.
TOKENS = 1 << 21
#: Pairs from which on they are verified in portions.
PAIRS = 200_000
#: Bins of a sketch.
BINS = 256
TOP = np.uint64(1 << 63)


@dataclass(frozen=True)
class Rule:
    """What a set is made of, and when two link: den * intersection >= num * union."""

    size: int = 5
    num: int = 80
    den: int = 100

    def overlap(self, n: Column) -> Column:
        """Least overlap of a set of n with any partner."""
        return F.ceil(n * self.num / F.lit(self.den)).cast("int")


def _sets(batch: pa.RecordBatch, rule: Rule, common: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of rows (from, to) with their sets in the common order, and where each begins."""
    data, offsets = words.buffers(batch.column("text"))
    for i, j in words.groups(offsets):
        hashes, _, first = words.word_hashes(data, offsets[i : j + 1])
        tokens, at = words.shingle_hashes(hashes, first, rule.size)
        tokens = tokens >> np.uint64(1)
        if len(common):
            where = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
            tokens = np.where(common[where] == tokens, tokens | TOP, tokens)
        yield i, j, *words.distinct_sorted(tokens, at)


def common_shingles(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Shingles that many documents share, sorted.

    Counted over all texts.  Tasks report what occurs often in a chunk, so a
    common one is missed only where it hardly occurs; the set decides about
    the order of shingles, never about a result.  A shingle's documents are
    at least 64 and one in COMMON of all shingles, so there are at most COMMON.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held, total = 0, 0

        def out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([*waiting, np.zeros(0, np.uint64)]), return_counts=True)
            often = n >= 4
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

        none = np.zeros(0, np.uint64)
        for batch in batches:
            for _, _, tokens, _ in _sets(batch, rule, none):
                waiting.append(tokens)
                held, total = held + len(tokens), total + len(tokens)
                if held >= CHUNK:
                    held = 0
                    yield out()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([total], pa.int64())], names=["token", "n"])

    counted = cut(docs.select("text").mapInArrow(job, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 64 OR token = -1"), "common")
    total = counted.filter("token = -1").agg(F.sum("n")).first()[0] or 0
    rows = counted.filter((F.col("token") >= 0) & (F.col("n") >= total / COMMON)).select("token").collect()  # COMMON at most
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def signatures(docs: DataFrame, rule: Rule, common: np.ndarray) -> DataFrame:
    """Per document: doc_id, n, a fingerprint (fa, fb) of its set, and its longest prefix."""
    kept = docs.sparkSession.sparkContext.broadcast(common)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, tokens, at in _sets(batch, rule, kept.value):
                n = np.diff(at)
                least = -(-n * rule.num // rule.den)
                length = np.minimum(n, n - least + np.minimum(MATCHES[-1], least))
                ends = np.concatenate([[0], np.cumsum(length)])
                take = np.repeat(at[:-1] - ends[:-1], length) + np.arange(ends[-1])
                prefix = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens[take].view(np.int64)))
                folds = [pa.array(words.fold(words.mix(tokens ^ np.uint64(salt)), at).view(np.int64)) for salt in (0x5BD1E995, 0x1B873593)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int32)), *folds, prefix], names=["doc_id", "n", "fa", "fb", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(job, "doc_id long, n int, fa long, fb long, prefix array<long>")


def listed(node: pa.Array, tokens: np.ndarray, at: np.ndarray, sketched: bool) -> pa.RecordBatch:
    """Sets, or their sketches: how many shingles fall into each of BINS bins.  The sum of the minima of two sketches bounds the overlap."""
    if not sketched:
        return pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.view(np.int64)))], names=["node", "shingles"])
    row = np.repeat(np.arange(len(node)), np.diff(at))
    counts = np.bincount(row * BINS + (words.mix(tokens) >> np.uint64(56)).astype(np.int64), minlength=len(node) * BINS)
    sketches = np.minimum(counts, 255).astype(np.uint8).reshape(len(node), BINS)
    return pa.RecordBatch.from_arrays([node, pa.array([s.tobytes() for s in sketches], pa.binary())], names=["node", "sketch"])


def set_schema(sketched: bool) -> str:
    return "node long, sketch binary" if sketched else "node long, shingles array<long>"


def whole_sets(docs: DataFrame, nodes: DataFrame, rule: Rule, sketched: bool = False) -> DataFrame:
    """(node, shingles), or (node, sketch), of the documents that ``nodes`` lists."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for i, j, tokens, at in _sets(batch, rule, none):
                yield listed(batch.column("doc_id").slice(i, j - i), tokens, at, sketched)

    some = docs.select("doc_id", "text").join(small(nodes), F.col("doc_id") == F.col("node"), "left_semi")
    return some.mapInArrow(job, set_schema(sketched))


def verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b) that link, compared by their whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return pairs.join(left, "a").join(right, "b").filter(both * rule.den >= union * rule.num).select("a", "b")


def choose_matches(shared: DataFrame, rule: Rule) -> DataFrame:
    """(node, matches): the prefix with the least estimated cost.

    With ``l`` matches a node reads the lists of its first ``n - a + l``
    shingles; at most one in ``l`` of the entries is a candidate, each of
    which costs about a comparison of two sets.
    """
    base = F.col("n") - rule.overlap(F.col("n"))
    read = [F.sum(F.when(F.col("pos") < base + k, F.col("df") - 1).otherwise(0)) for k in MATCHES]
    cost = [r * (1 + (8 + F.first("n") / 32) / k) for k, r in zip(MATCHES, read, strict=True)]
    best = F.least(*[F.struct(c.alias("cost"), F.least(F.lit(k), rule.overlap(F.first("n"))).alias("matches")) for k, c in zip(MATCHES, cost, strict=True)])
    return shared.groupBy("node").agg(best.alias("best")).select(F.col("node").alias("chooser"), F.col("best.matches").alias("matches"))


def link(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    A set holds the distinct runs of ``rule.size`` words; with fewer words, the
    whole sequence as one.  The component is the smallest key reachable.

    Edge cases: a null text and one without words have the empty set, which
    links with nothing, so they are their own component; a row with a null key
    gets the component of the documents with an equal set, else null, and
    links nothing itself; rows that share a key count as one document; texts
    of any length are read whole; an empty table gives an empty one; further
    columns are dropped.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    signed = cut(signatures(docs, rule, common_shingles(docs, rule)), "signatures")
    classes = cut(signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("fa", "fb").agg(F.min("doc_id").alias("node")), "classes")
    tokens = signed.filter("n > 0").join(small(classes.select("node").distinct()), F.col("doc_id") == F.col("node"), "left_semi")
    tokens = tokens.select(F.col("doc_id").alias("node"), "n", F.posexplode("prefix").alias("pos", "token"))
    shared = cut(with_frequency(tokens).filter("df > 1").dropDuplicates(["token", "node"]), "prefixes")
    chosen = choose_matches(shared, rule)
    prefix = F.col("n") - rule.overlap(F.col("n")) + F.col("matches")
    buckets = shared.join(chosen, shared["node"] == chosen["chooser"]).filter(F.col("pos") < prefix).select("token", "node", "n", "matches", F.ceil(prefix / 4).cast("int").alias("likely"), (F.col("n") - prefix).alias("rest"))
    labels = contract(cut(buckets, "buckets"), rule, lambda nodes, sketched: whole_sets(docs, nodes, rule, sketched))
    named = signed.select("doc_id", "n", "fa", "fb").join(classes, ["fa", "fb"], "left")
    named = named.join(labels, "node", "left") if labels is not None else named.withColumn("component", F.lit(None).cast("long"))
    component = F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def with_frequency(tokens: DataFrame) -> DataFrame:
    """Add how many rows have each token (df).

    Common shingles, which are marked by their sign and at most COMMON, are
    counted in parts and joined back; each other one has a small share of the rows.
    """
    rare = tokens.filter("token >= 0").withColumn("df", F.count("*").over(Window.partitionBy("token")))
    common = cut(tokens.filter("token < 0").groupBy("token").agg(F.count("*").alias("df")), "common-df")
    return rare.unionByName(tokens.filter("token < 0").join(small(common), "token").select(rare.columns))


def contract(buckets: DataFrame, rule: Rule, sets_of: Callable[[DataFrame, bool], DataFrame]) -> DataFrame | None:
    """(node, component) of all linked nodes; None if there are none.

    ``buckets`` (token, node, n, matches, likely, rest) says which nodes share
    a token, with how many shared ones a pair must be compared, with how many
    it is worth a comparison before that, and how much of the set lies behind
    its prefix.  ``sets_of`` gives (node, shingles) of a table of nodes, or (node, sketch).
    """
    buckets = buckets.withColumn("component", F.col("node"))
    labels, before = None, None

    def settle(pairs: DataFrame, portions: tuple[tuple[int, int], ...] = ((0, 64),)) -> None:
        """Verify pairs, in portions of 64ths; what the first ones join need not be compared again."""
        nonlocal labels
        for low, high in portions:
            some = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(64)).between(low, high - 1))
            if low > 0 and labels is not None:
                some = cut(_apart(some, labels), "pairs")
            nodes = cut(some.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
            join(cut(verify(some, cut(sets_of(nodes, False), "sets"), rule), "found"))

    def join(found: DataFrame) -> None:
        """Contract by new links; those of components that are known stand for the ones found before."""
        nonlocal labels
        if not found.isEmpty():
            known = labels.select(F.col("node").alias("a"), F.col("component").alias("b")) if labels is not None else None
            labels = components(found if known is None else known.unionByName(found))

    def still_open() -> DataFrame:
        """Rows of lists with several components; smallest and largest ones are found in parts, so no list is gathered."""
        now = buckets
        if labels is not None:
            now = now.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        apart = now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
        return cut(now.join(apart, "token"), "buckets")

    for k in range(ROUNDS):
        buckets = still_open()
        per = buckets.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count("*").alias("of"))
        pairs = F.when(~_heavy("of", "s", "q"), (F.col("s") * F.col("s") - F.col("q")) / 2)
        left, rows = per.agg(F.coalesce(F.sum(pairs), F.lit(0.0)), F.sum("s")).first()
        if not rows:
            return labels
        # Pivots go on while small lists have many pairs and a tenth of the rows is settled; what they leave are lists of unlike nodes.
        if left <= 2 * rows + 100_000 or (before is not None and rows > 0.9 * before):
            break
        before = rows
        settle(cut(_pivot_pairs(buckets, k), "pairs"))
    sizes = buckets.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token").agg(F.count("*").alias("of"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    heavy = cut(sizes.filter(_heavy("of", "s", "q")).select("token"), "heavy")
    if not heavy.isEmpty():
        join(_block_links(buckets, heavy, rule, sets_of))
    # Pairs of a heavy list have all been compared, so it does not come back, whatever is joined by now.
    buckets = still_open()
    pairs = cut(_all_pairs(buckets.join(small(heavy), "token", "left_anti"), rule), "pairs")
    settle(pairs, ((0, 64),) if pairs.count() <= PAIRS else ((0, 1), (1, 8), (8, 64)))
    return labels


def _heavy(of: str, rows: str, squares: str) -> Column:
    """Whether a list has too many pairs to join: of many components, or of a few large ones."""
    s = F.col(rows)
    return (F.col(of) > HEAVY) | (s * s - F.col(squares) > 2 * HEAVY * s)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose nodes are in different components."""
    a, b = (labels.select(F.col("node").alias(f"{x}_node"), F.col("component").alias(f"{x}_in")) for x in "ab")
    joined = pairs.join(a, F.col("a") == F.col("a_node"), "left").join(b, F.col("b") == F.col("b_node"), "left")
    return joined.filter(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b")


def _pivot_pairs(buckets: DataFrame, k: int) -> DataFrame:
    """Each node with one pivot of its list and size class; a different one each round."""
    rows = buckets.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.2))))
    pivot = F.min(F.struct(F.xxhash64("component", F.lit(k)), F.xxhash64("node", F.lit(k)), F.col("node").alias("node"), F.col("component").alias("component")))
    rows = rows.join(rows.groupBy("token", "band").agg(pivot.alias("pivot")), ["token", "band"]).filter("pivot.component <> component")
    pairs = rows.groupBy(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b"))
    return pairs.agg(F.count("*").alias("shared"), F.min("likely").alias("likely")).filter("shared >= likely").select("a", "b")


def _all_pairs(buckets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of different components with as many common prefix shingles as they need.

    Of the one whose prefix ends first, all prefix shingles that the other set
    has are common prefix shingles; so the overlap is theirs and at most the
    rest of that set.  Pairs that cannot reach the overlap they need go too.
    """
    a = buckets.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("matches").alias("ma"), F.col("component").alias("ca"), F.col("rest").alias("ra"))
    b = buckets.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("matches").alias("mb"), F.col("component").alias("cb"), F.col("rest").alias("rb"))
    sized = F.least("na", "nb") * rule.den >= F.greatest("na", "nb") * rule.num
    pairs = a.join(b, (a["token"] == b["token"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sized)
    overlap = F.ceil((F.col("na") + F.col("nb")) * rule.num / F.lit(rule.num + rule.den) - 1e-9)
    needed = F.greatest(F.least("ma", "mb"), overlap - F.greatest("ra", "rb"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first(needed).alias("needed")).filter("shared >= needed").select("a", "b")


def _block_links(buckets: DataFrame, heavy: DataFrame, rule: Rule, sets_of: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """Pairs (a, b) of components that links between nodes of heavy lists join.

    Near copies have many heavy lists in common, so lists of mostly the same
    nodes have one home: the smallest heavy token of most of their nodes.  A
    node goes once to each home of its lists, with the tokens of its prefix.  A
    home is cut into blocks, and each pair of blocks is a task's work.  A pair
    counts in the first home of the lists that both nodes have.  Tasks tell
    which nodes have a partner that no bound rules out; these meet again in
    the same home with their whole sets.
    """
    in_heavy = buckets.select("token", "node").join(small(heavy), "token")
    first = in_heavy.groupBy("node").agg(F.min("token").alias("first"))
    counts = in_heavy.join(first, "node").groupBy("token", "first").agg(F.count("*").alias("times"))
    homes = cut(counts.groupBy("token").agg(F.max_by("first", F.struct("times", "first")).alias("home")), "homes")
    marked = buckets.select("token", "node").join(small(homes), "token", "left")
    held = F.sort_array(F.collect_set(F.when(F.col("home").isNotNull(), F.struct("token", "home"))))
    lists = marked.groupBy("node").agg(held.alias("held"), F.collect_set(F.when(F.col("home").isNull(), F.col("token"))).alias("lights"))
    nodes = lists.filter(F.size("held") > 0).select("node", F.col("held.token").alias("heavies"), F.col("held.home").alias("homes"), "lights")
    told = buckets.select("node", "n", "matches", "rest", "component").dropDuplicates(["node"])
    sketches = sets_of(cut(in_heavy.select("node").distinct(), "nodes"), True).dropDuplicates(["node"])
    nodes = cut(nodes.join(sketches, "node").join(told, "node"), "heavy-nodes")
    rows = _dealt(nodes.withColumn("home", F.explode(F.array_distinct("homes"))), F.ceil(F.count("*") / BLOCK))
    met = rows.groupBy("home", "one", "two").applyInArrow(_compare(rule), "home long, node long, n long, component long").distinct()
    met = cut(met, "met")
    sets = cut(sets_of(cut(met.select("node").distinct(), "nodes"), False), "sets")
    rows = _dealt(met, F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / TOKENS))).join(sets, "node")
    return cut(rows.groupBy("home", "one", "two").applyInArrow(_links(rule), "a long, b long"), "found")


def _dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows of homes for each pair of blocks (one, two) that holds their own."""
    sizes = cut(rows.groupBy("home").agg(blocks.cast("int").alias("blocks")), "home-blocks")
    rows = rows.join(small(sizes), "home").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other")).drop("blocks", "other")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(whole)), np.diff(whole.offsets.to_numpy()))


def _shared(codes: np.ndarray, ends: np.ndarray, i: slice, j: slice) -> np.ndarray:
    """How many tokens each row of one range shares with each of another."""
    parts = [codes[ends[s.start] : ends[s.stop]] for s in (i, j)]
    rows = [np.repeat(np.arange(s.stop - s.start), np.diff(ends[s.start : s.stop + 1])) for s in (i, j)]
    both = np.intersect1d(*parts)
    out = np.zeros((i.stop - i.start, j.stop - j.start), np.float32)
    for c in range(0, len(both), 4096):
        some = both[c : c + 4096]
        has = []
        for values, row, s in zip(parts, rows, (i, j), strict=True):
            at = np.minimum(np.searchsorted(some, values), len(some) - 1)
            good = some[at] == values
            m = np.zeros((s.stop - s.start, len(some)), np.float32)
            m[row[good], at[good]] = 1
            has.append(m)
        out += has[0] @ has[1].T
    return out


def _squares(own: np.ndarray, side: int) -> Iterator[tuple[slice, slice]]:
    """Ranges of rows to compare, of two blocks that stand one behind the other, or of one block with itself."""
    middle = int(np.searchsorted(own, own[-1]))
    for a in range(0, middle or len(own), side):
        for b in range(middle or a, len(own), side):
            yield slice(a, min(a + side, middle or len(own))), slice(b, min(b + side, len(own)))


def _compare(rule: Rule):
    """A job for a pair of blocks of one home of heavy lists: the nodes that may link with one of another component."""

    def job(table: pa.Table) -> pa.Table:
        home = table.column("home")[0].as_py()
        heavies, owner = _flat(table.column("heavies"))
        first = np.full(table.num_rows, np.iinfo(np.int64).max)
        np.minimum.at(first, owner, heavies)
        # Rows with the same first heavy list stand together, so many squares are known from it.
        table = table.take(pa.array(np.lexsort([first, table.column("own").to_numpy()])))
        node, n, matches, rest, component, own = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "matches", "rest", "component", "own"))
        heavies, owner = _flat(table.column("heavies"))
        homes, _ = _flat(table.column("homes"))
        lights, under = _flat(table.column("lights"))
        codes, row = np.concatenate([heavies, lights]), np.concatenate([owner, under])
        codes = codes[np.argsort(row, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(node)))])
        before, at, here, here_at = *_part(heavies, owner, homes < home, len(node)), *_part(heavies, owner, homes == home, len(node))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), BINS)
        met = np.zeros(len(node), bool)
        every, last = np.zeros(0, np.int64), None
        for i, j in _squares(own, SQUARE):
            if i != last:
                every, last = _held_by_all(before, at, i), i
            # A node that has a partner needs no other one.
            good = (component[i][:, None] != component[j][None, :]) & ~(met[i][:, None] & met[j][None, :])
            low, high = np.minimum(n[i][:, None], n[j][None, :]), np.maximum(n[i][:, None], n[j][None, :])
            good &= low * rule.den >= high * rule.num
            if i == j:
                good = np.triu(good, 1)
            if not good.any() or len(np.intersect1d(every, _held_by_all(before, at, j))):
                continue
            overlap = -(-(low + high) * rule.num // (rule.num + rule.den))
            needed = np.maximum(np.minimum(matches[i][:, None], matches[j][None, :]), overlap - np.maximum(rest[i][:, None], rest[j][None, :]))
            good &= (_shared(codes, ends, i, j) >= needed) & (_shared(before, at, i, j) == 0)
            if good.any():
                good &= _shared(here, here_at, i, j) > 0
            p, q = np.nonzero(good)
            for c in range(0, len(p), 4096):
                u, v = p[c : c + 4096], q[c : c + 4096]
                new = ~(met[u + i.start] & met[v + j.start])
                u, v = u[new], v[new]
                bound = np.minimum(sketch[u + i.start], sketch[v + j.start]).sum(axis=1, dtype=np.int64)
                # A full bin says less than there is; only very long texts have one.
                full = (sketch[u + i.start] == 255).any(axis=1) | (sketch[v + j.start] == 255).any(axis=1)
                enough = full | (bound >= overlap[u, v])
                met[u[enough] + i.start] = met[v[enough] + j.start] = True
        return pa.table({"home": pa.array(np.full(met.sum(), home), pa.int64()), "node": node[met], "n": n[met], "component": component[met]})

    return job


def _links(rule: Rule):
    """A job for a pair of blocks of whole sets: the components that their links join, each with the smallest it leads to."""

    def job(table: pa.Table) -> pa.Table:
        # Of rows in the order of their size many squares are known not to link.
        size = pc.list_value_length(table.column("shingles")).to_numpy()
        table = table.take(pa.array(np.lexsort([size, table.column("own").to_numpy()])))
        names, part = np.unique(table.column("component").to_numpy(), return_inverse=True)
        codes, row = _flat(table.column("shingles"))
        n = np.bincount(row, minlength=table.num_rows)
        ends = np.concatenate([[0], np.cumsum(n)])
        root = np.arange(len(names))
        for i, j in _squares(table.column("own").to_numpy(), SQUARE):
            good = root[part[i]][:, None] != root[part[j]][None, :]
            good &= np.minimum(n[i][:, None], n[j][None, :]) * rule.den >= np.maximum(n[i][:, None], n[j][None, :]) * rule.num
            u, v = np.flatnonzero(good.any(axis=1)), np.flatnonzero(good.any(axis=0))
            if not len(u):
                continue
            both = _shared(*_rows(codes, ends, np.concatenate([u + i.start, v + j.start])), slice(0, len(u)), slice(len(u), len(u) + len(v))).astype(np.int64)
            u, v = u + i.start, v + j.start
            p, q = np.nonzero((both > 0) & (both * rule.den >= (n[u][:, None] + n[v][None, :] - both) * rule.num))
            root = roots(len(names), root[part[u[p]]], root[part[v[q]]])[root]
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": names[moved], "b": names[root[moved]]})

    return job


def _rows(codes: np.ndarray, ends: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of some rows, and where each row's begin."""
    length = ends[some + 1] - ends[some]
    at = np.concatenate([[0], np.cumsum(length)])
    return codes[np.repeat(ends[some] - at[:-1], length) + np.arange(at[-1])], at


def _part(codes: np.ndarray, owner: np.ndarray, some: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Some of the codes, which stand by row, and where each row's begin."""
    return codes[some], np.concatenate([[0], np.cumsum(np.bincount(owner[some], minlength=rows))])


def _held_by_all(codes: np.ndarray, ends: np.ndarray, i: slice) -> np.ndarray:
    """Tokens that every row of a range has."""
    some, times = np.unique(codes[ends[i.start] : ends[i.stop]], return_counts=True)
    return some[times == i.stop - i.start]
