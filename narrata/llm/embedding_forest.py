"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits the vectors again and again at the median of a random
direction; those within ``SPILL`` of the median, by rank, go to both sides, so
that near vectors are seldom parted.  Vectors are compared within leaves, in
double precision, and what the trees find is united.

A split lies where it parts few linked pairs of a sample of the rows.  Rows
that link so densely that every split goes through a group are not split any
more: such a leaf is compared whole, as pairs of blocks in many tasks.

Upper splits are fitted on a bounded sample; leaves that turn out too large
are split on by Spark with a sample of each one's rows, until they are small
or dense.  Equal vectors are one node with a weight.  A pair
that meets in several leaves counts in the first of them only, which both
rows can tell from the list of their leaves; so no pair ever leaves a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm import words
from narrata.llm.graph import components, roots, small
from narrata.llm.scratch import cut

TREES = 12
SPILL = 0.05
#: Rows that a leaf is fitted to, and from how many on it is split further.
LEAF, LEAF_MOST = 1500, 6000
#: Most vectors that the upper splits are fitted on.
SAMPLE = 20_000
BLOCK = 1024
#: Rows whose linked pairs judge a split, the share of them that it may part, and the share of all pairs from which on a leaf is dense.
JUDGES, PARTED, DENSE = 1000, 0.01, 0.01
#: Where a split is tried, by rank, in how many directions.
RANKS, DIRECTIONS = (0.5, 0.4, 0.6, 0.35, 0.65), 4


def direction(tree: int, node: int, dim: int, k: int = 0) -> np.ndarray:
    return np.random.default_rng((tree, node, dim, k) if k else (tree, node, dim)).standard_normal(dim)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, all of length ``dim``, scaled to length 1 in double precision."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the vectors; those that cannot be compared have length 0."""
    for batch in batches:
        dims, fa, fb = [], [], []
        for v in batch.column("embedding"):
            x = None if not v.is_valid or v.values is None or v.values.null_count or len(v.values) == 0 else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
            good = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
            dims.append(len(x) if good else 0)
            bits = words.mix(x.view(np.uint64) + np.arange(1, len(x) + 1, dtype=np.uint64)) if good else np.zeros(1, np.uint64)
            fa.append(int(bits.sum(dtype=np.uint64).view(np.int64)))
            fb.append(int(words.mix(bits ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), batch.column("embedding")], names=["vec_id", "dim", "fa", "fb", "embedding"])


def choose(x: np.ndarray, tree: int, node: int, threshold: float) -> tuple[float, float, int] | None:
    """The (low, high, k) of a split of these rows that parts few links, k being its direction; None if they are too dense."""
    some = x[:: -(-len(x) // JUDGES)]
    i, j = np.nonzero(np.triu(some @ some.T >= threshold, 1))
    least, best = len(i) + 1, None
    for k in range(DIRECTIONS):
        d = direction(tree, node, x.shape[1], k)
        p, judged = x @ d, some @ d
        near, far = np.minimum(judged[i], judged[j]), np.maximum(judged[i], judged[j])
        for rank in RANKS:
            low, high = np.quantile(p, [rank - SPILL, rank + SPILL])
            parted = int(((near < low) & (far > high)).sum())
            if low < high and parted < least:
                least, best = parted, (float(low), float(high), k)
            if least <= PARTED * len(i):
                return best
    return None if 2 * len(i) >= DENSE * len(some) * (len(some) - 1) else best


def fit(sample: pa.Table, total: int, threshold: float) -> dict[tuple[int, int], dict[int, tuple[float, float, int]]]:
    """Splits of all trees: (dim, tree) -> node -> (low, high) of the projection, and its direction."""
    model = {}
    for dim in sorted(set(sample.column("dim").to_pylist())):
        rows = sample.filter(pa.compute.equal(sample.column("dim"), dim)).column("embedding").combine_chunks()
        x = matrix(rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows, dim)
        for tree in range(TREES):
            splits, todo = {}, [(1, np.arange(len(x)))]
            while todo:
                node, at = todo.pop()
                if len(at) * total <= LEAF * sample.num_rows or len(at) < 64:
                    continue
                if found := choose(x[at], tree, node, threshold):
                    splits[node] = low, high, k = found
                    p = x[at] @ direction(tree, node, dim, k)
                    todo += [(2 * node, at[p <= high]), (2 * node + 1, at[p >= low])]
            model[dim, tree] = splits
    return model


def _route(model) -> object:
    """A job that gives every vector its leaf, or leaves, in each tree."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, dims = batch.column("node").to_numpy(), batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = matrix(batch.column("embedding").take(pa.array(at)), int(dim))
                for tree in range(TREES):
                    splits, todo, rows, leaves = model.value.get((int(dim), tree), {}), [(1, np.arange(len(at)))], [], []
                    while todo:
                        node, some = todo.pop()
                        if node not in splits or len(some) == 0:
                            rows.append(some)
                            leaves.append(np.full(len(some), node))
                            continue
                        low, high, k = splits[node]
                        p = x[some] @ direction(tree, node, int(dim), k)
                        todo += [(2 * node, some[p <= high]), (2 * node + 1, some[p >= low])]
                    who = np.concatenate(rows)
                    n = len(who)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[at][who]), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, tree, np.int32)), pa.array(np.concatenate(leaves).astype(np.int64))], names=["node", "dim", "tree", "leaf"])

    return job


def _chosen(threshold: float):
    """A job for the sample of one leaf's rows: its split, or no row if it is dense."""

    def job(table: pa.Table) -> pa.Table:
        dim, tree, leaf = (table.column(c)[0].as_py() for c in ("dim", "tree", "leaf"))
        found = choose(matrix(_one(table.column("embedding")), dim), tree, leaf, threshold)
        rows = [{"dim": dim, "tree": tree, "leaf": leaf, "low": found[0], "high": found[1], "k": found[2]}] if found else []
        return pa.Table.from_pylist(rows, pa.schema([("dim", pa.int32()), ("tree", pa.int32()), ("leaf", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("k", pa.int32())]))

    return job


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dim, tree, leaf, low, high, k = (batch.column(c).to_numpy() for c in ("dim", "tree", "leaf", "low", "high", "k"))
        p = np.zeros(batch.num_rows)
        keys, where = np.unique(np.stack([dim, tree, leaf, k]), axis=1, return_inverse=True)
        for n, (d, t, node, which) in enumerate(keys.T):
            at = np.flatnonzero(where.ravel() == n)
            p[at] = matrix(batch.column("embedding").take(pa.array(at)), int(d)) @ direction(int(t), int(node), int(d), int(which))
        left, right = np.flatnonzero(p <= high), np.flatnonzero(p >= low)
        at = pa.array(np.concatenate([left, right]))
        child = np.concatenate([2 * leaf[left], 2 * leaf[right] + 1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("node", "dim", "tree")), pa.array(child)], names=["node", "dim", "tree", "leaf"])


def split_large(leaves: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Split every leaf of more than LEAF_MOST rows, until there is none or only dense ones."""
    key = ["dim", "tree", "leaf"]
    done = None
    while True:
        large = cut(leaves.groupBy(*key).count().filter(F.col("count") > LEAF_MOST), "large-leaves")
        if large.isEmpty():
            return leaves if done is None else done.unionByName(leaves)
        judges = leaves.join(small(large), key).filter(F.pmod(F.xxhash64("node", "leaf", "tree"), F.col("count")) < JUDGES)
        judges = judges.join(vectors.select("node", "embedding"), "node").select(*key, "embedding")
        splits = cut(judges.groupBy(*key).applyInArrow(_chosen(threshold), "dim int, tree int, leaf long, low double, high double, k int"), "splits")
        if splits.isEmpty():
            return leaves if done is None else done.unionByName(leaves)
        kept = leaves.join(small(splits.select(*key)), key, "left_anti")
        done = kept if done is None else done.unionByName(kept)
        rows = leaves.join(small(splits), key).join(vectors.select("node", "embedding"), "node")
        leaves = cut(rows.select("node", *key, "low", "high", "k", "embedding").mapInArrow(_split, "node long, dim int, tree int, leaf long"), "leaves")


def in_blocks(full: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks to compare: ``one`` and ``two`` are their numbers, ``own`` the row's."""
    sizes = full.groupBy("code", "dim").count().filter(F.col("count") > LEAF_MOST)
    sizes = cut(sizes.select("code", "dim", F.ceil(F.col("count") / LEAF_MOST).cast("int").alias("blocks")), "leaf-blocks")
    full = full.join(small(sizes), ["code", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    full = full.withColumn("own", F.pmod(F.xxhash64("node", "code"), F.col("blocks")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return full.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other")).drop("other", "blocks")


def _compare(threshold: float):
    """A job for a pair of blocks of one leaf: each node's new links by weight, and the node its links lead to."""

    def job(table: pa.Table) -> pa.Table:
        # Rows of the same leaves in other trees stand together, so many of their pairs are known at once.
        lists = _one(table.column("codes"))
        first = lists.flatten().to_numpy()[lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]]
        table = table.take(pa.array(np.lexsort([first, table.column("own").to_numpy()])))
        node, weight, code, dim, own = (table.column(c).to_numpy() for c in ("node", "weight", "code", "dim", "own"))
        x = matrix(_one(table.column("embedding")), int(dim[0]))
        lists = _one(table.column("codes"))
        owner = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
        codes = lists.flatten().to_numpy()
        earlier = codes < code[0]
        # Leaves of one row tell nothing about pairs; only the others become columns.
        _, column, rows = np.unique(codes[earlier], return_inverse=True, return_counts=True)
        shared = rows > 1
        before = np.zeros((len(node), int(shared.sum())), np.float32)
        several = shared[column]
        before[owner[earlier][several], (np.cumsum(shared) - 1)[column[several]]] = 1
        same = table.column("one")[0].as_py() == table.column("two")[0].as_py()
        middle = 0 if same else int(np.searchsorted(own, own[-1]))
        links, left, right = np.zeros(len(node)), [], []
        for a in range(0, len(node) if same else middle, BLOCK):
            i = slice(a, a + BLOCK if same else min(a + BLOCK, middle))
            for b in range(a if same else middle, len(node), BLOCK):
                j = slice(b, b + BLOCK)
                if (before[i].all(axis=0) & before[j].all(axis=0)).any():
                    continue
                near = x[i] @ x[j].T >= threshold
                if same and a == b:
                    near = np.triu(near, 1)
                p, q = np.nonzero(near)
                if 16 * len(p) > near.size:
                    near &= before[i] @ before[j].T == 0
                else:
                    for c in range(0, len(p), 1 << 14):
                        u, v = p[c : c + (1 << 14)], q[c : c + (1 << 14)]
                        near[u, v] = np.einsum("ij,ij->i", before[i][u], before[j][v]) == 0
                p, q = np.nonzero(near)
                if len(p) == 0:
                    continue
                links[i] += near @ weight[j].astype(np.float64)
                links[j] += weight[i].astype(np.float64) @ near
                # Of the links only what they lead to is kept.
                at, which = np.unique(np.concatenate([p + a, q + b]), return_inverse=True)
                root = roots(len(at), which[: len(p)], which[len(p) :])
                left.append(at)
                right.append(at[root])
        p, q = (np.concatenate([*s, np.zeros(0, np.int64)]).astype(np.int64) for s in (left, right))
        root = roots(len(node), p, q)
        some = links > 0
        return pa.table({"node": node[some], "links": links[some].astype(np.int64), "root": node[root[some]]})

    return job


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other vectors with a cosine of ``threshold`` or
    more that the forest finds; the component is the smallest key reachable by
    them, and its own vector is kept.

    Edge cases: vectors that are null, empty, zero, or hold nulls or
    non-finite numbers link with nothing; vectors of different lengths do not
    link; a row with a null key counts as another vector and has the links of
    its own, but no component, and is not kept; repeated rows are copies; rows
    that share a key but not a vector have the links and component of their
    own vector each; an empty table gives an empty
    one; further columns are dropped.
    """
    kind = dict(vectors.dtypes)[embedding]
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = cut(rows.mapInArrow(_usable, f"vec_id long, dim int, fa long, fb long, embedding {kind}"), "vectors")
    named = rows.filter("dim > 0").groupBy("fa", "fb", "dim").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    # Classes of equal vectors have numbers of their own, as keys may be null or shared.
    named = cut(named.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    first = rows.filter("dim > 0").dropDuplicates(["fa", "fb", "dim"]).select("fa", "fb", "embedding")
    held = cut(named.join(first, ["fa", "fb"]).select("node", "dim", "weight", "embedding", "fa", "fb"), "vector-nodes")
    nodes = held.drop("fa", "fb")
    total = nodes.count()
    out = rows.select("vec_id", "fa", "fb", "dim").join(named.drop("dim"), ["fa", "fb"], "left")
    if total < 2:
        links = component = F.lit(None).cast("long")
    else:
        sample = held.orderBy("fa", "fb").limit(SAMPLE).select("node", "dim", "embedding").toArrow()
        model = vectors.sparkSession.sparkContext.broadcast(fit(sample, total, threshold))  # at most TREES * SAMPLE / 32 pairs of numbers
        leaves = cut(nodes.mapInArrow(_route(model), "node long, dim int, tree int, leaf long"), "leaves")
        leaves = split_large(leaves, nodes, threshold)
        code = F.col("tree").cast("long") * F.lit(1 << 48) + F.col("leaf")
        codes = leaves.groupBy("node").agg(F.sort_array(F.collect_set(code)).alias("codes"))
        full = nodes.join(codes, "node").withColumn("code", F.explode("codes"))
        found = cut(in_blocks(full).groupBy("dim", "code", "one", "two").applyInArrow(_compare(threshold), "node long, links long, root long"), "leaf-links")
        counts = found.groupBy(F.col("node").alias("linked")).agg(F.sum("links").alias("links"))
        out = out.join(counts, F.col("node") == F.col("linked"), "left")
        edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b")
        links, component = F.col("links"), F.lit(None).cast("long")
        if not edges.isEmpty():
            labels = components(edges).select(F.col("node").alias("labelled"), F.col("component").alias("of"))
            labels = cut(labels.join(named.select("node", "least"), F.col("node") == F.col("labelled")).select("labelled", "of", "least"), "vector-labels")
            smallest = labels.groupBy("of").agg(F.min("least").alias("component"))
            labels = labels.select("labelled", "of").join(smallest, "of").select("labelled", "component")
            out, component = out.join(labels, F.col("node") == F.col("labelled"), "left"), F.col("component")
    alone = F.coalesce("dim", F.lit(0)) == 0
    n_links = F.when(alone, 0).otherwise(F.coalesce(links, F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0)))
    component = F.when(F.col("vec_id").isNull(), None).when(alone, F.col("vec_id")).otherwise(F.coalesce(component, F.col("least")))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
