"""Connected components of a link table, and joins against sides of checked size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.scratch import cut

#: Most rows of one or two long columns that are broadcast (16 MB).
BROADCAST_ROWS = 1_000_000
#: Most links (16 bytes each) that one task contracts by itself; more are contracted in rounds of joins.
TASK_LINKS = 250_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; count it after a cut."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b); the component is its smallest node.

    Every node hooks onto its smallest neighbour if that is smaller, chains of
    hooks are shortened by jumping, the graph is contracted, and so on until no
    link is left; that takes a number of rounds logarithmic in the longest
    chain.  Hubs are never gathered: hooking is a minimum, with partial sums.
    """
    edges = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if edges.count() <= TASK_LINKS:
        return cut(edges.coalesce(1).mapInArrow(_contracted, "node long, component long"), "labels")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to"))
        hooks = cut(hooks, "hooks")
        hooks = cut(_follow(_follow(hooks, "to", hooks), "to", hooks), "hooks")
        labels = hooks.withColumnRenamed("to", "component") if labels is None else cut(_follow(labels, "component", hooks), "labels")
        moved = _follow(_follow(edges, "a", hooks), "b", hooks).filter("a <> b")
        edges = cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels


def roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest of n nodes that the links (p, q) lead to from each."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, least)
        np.minimum.at(new, q, least)
        # Where the old roots lead follows their nodes.
        np.minimum.at(new, root, new.copy())
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The component of every node of at most TASK_LINKS links."""
    rows = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if rows:
        a, b = (np.concatenate(x) for x in zip(*rows, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        found = nodes[roots(len(nodes), at[: len(a)], at[len(a) :])]
        for k in range(0, len(nodes), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 10_000]), pa.array(found[k : k + 10_000])], names=["node", "component"])


def _follow(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """Replace ``column`` by where its value is hooked."""
    to = hooks.select(F.col("node").alias("__from"), F.col("to").alias("__to"))
    return df.join(to, df[column] == F.col("__from"), "left").withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")
