"""Mixing sources to target weights by Pareto order sampling.

Everything here is DataFrame functions; no row ever leaves the JVM.

Per source the target ``T`` and the size ``S`` give ``T / S`` expected copies
of each document.  The whole part of that is certain.  For the rest of the
target each document has an inclusion probability ``p``; with ``u`` uniform
from a hash of the key, documents are ranked by the odds ratio
``(u / (1 - u)) / (p / (1 - p))`` and taken in that order until their sizes
reach the rest, so the size of the sample is fixed up to half a document.

No source is ever sorted: ranks map monotonically into (0, 1), are counted in
``BUCKETS`` equal intervals, and only the one interval per source in which the
rest is reached is put in order row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.llm.scratch import cut

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
OWN = ["source_size", "target", "copies", "taken"]


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int = 0) -> Column:
    """A double in (0, 1) from the MD5 of the key; the same in every run."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def shorter_first(size: Column) -> Column:
    """A whole-numbered weight from 1000 for empty texts to 0 for those of a million words: more documents for the same words."""
    return F.floor(F.lit(1_000_000) / (size + 1000)).cast("long")


def source_targets(docs: DataFrame, size: str, source: str, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """One row per source: source, source_size, target.

    ``weights`` repeat over the sources in code point order, null last.
    ``budget`` is the share of all sizes to give out.  A source takes the
    common level times its weight, but ``most`` times its size at most; what
    full sources leave is shared by weight among the others until none is
    above.  In order of size by weight the full ones come first, so the level
    is that of the first source that it fits.  The windows see one row per
    source.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "position")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    given = F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.lit(budget) * F.sum("source_size").over(everything) - given) / left
    cap = F.lit(most) * F.col("source_size")
    first = F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct("place", "level"))).over(everything)
    return (
        sizes.withColumn("position", position)
        .withColumn("weight", weight)
        .withColumn("place", F.row_number().over(order))
        .withColumn("level", level)
        .withColumn("first", first)
        .select("source", "source_size", F.least(cap, F.coalesce(F.col("first.level") * F.col("weight"), cap)).cast("double").alias("target"))
    )


def pareto_mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5,
    most: float = 2.0,
    weight: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """Add source_size, target, copies and taken to every row of ``docs``.

    ``weight`` names a positive column for unequal chances within a source;
    without it they differ between sources only.  A null weight counts 1.

    Edge cases: a null source is a source of its own; all null keys hash
    alike; empty texts (size 0) get the certain copies alone; rows repeated in
    full tie in rank, and which of them is taken does not change the result;
    an empty table gives an empty one.  Other columns pass through; columns
    named as this operator's own are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OWN])
    chance = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    narrow = cut(docs.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(size).cast("long").alias("n"), chance.alias("w")), "mix-sizes")
    plan = _plan(narrow, weights, budget, most, seed)
    wide = docs.withColumns({"__k": F.col(key), "__s": F.col(source), "__n": F.col(size).cast("long"), "__w": chance})
    ranked = _ranked(wide, plan, "__", seed)
    at_edge = F.coalesce((F.col("__bucket") == F.col("edge")) & (F.col("__n") > 0), F.lit(False))
    running = F.sum("__n").over(Window.partitionBy("__s", "__bucket").orderBy("__rank", "__k", "__n").rowsBetween(Window.unboundedPreceding, -1))
    fits = F.col("before") + F.coalesce(running, F.lit(0)) + F.col("__n") / 2.0 <= F.col("rest")
    below = (F.col("rest") > 0) & (F.col("__n") > 0) & (F.col("edge").isNull() | (F.col("__bucket") < F.col("edge")))
    settled = ranked.filter(~at_edge).withColumn("__drawn", F.coalesce(below, F.lit(False)))
    drawn = settled.unionByName(ranked.filter(at_edge).withColumn("__drawn", fits))
    copies = (F.col("whole") + F.when(F.col("__drawn"), 1).otherwise(0)).cast("long")
    return drawn.select(*docs.columns, "source_size", "target", copies.alias("copies"), (copies * F.col("__n")).cast("long").alias("taken"))


def _plan(narrow: DataFrame, weights: tuple[float, ...], budget: float, most: float, seed: int) -> DataFrame:
    """Per source: certain copies, the rest, and the interval of ranks in which the rest is reached."""
    targets = source_targets(narrow, "n", "s", weights, budget, most)
    mean = narrow.groupBy("s").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("mean"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.join(mean, targets["source"].eqNullSafe(mean["s"])).select(
        targets["source"].alias("plan_of"),
        "source_size",
        "target",
        "mean",
        F.floor(ratio).cast("long").alias("whole"),
        (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("rest"),
        (ratio - F.floor(ratio)).alias("share"),
    )
    counts = _ranked(narrow.filter(F.col("n") > 0), plan, "", seed).groupBy("s", "bucket").agg(F.sum("n").alias("words"), F.first("rest").alias("rest"))
    running = F.sum("words").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    edge = (
        counts.withColumn("before", F.coalesce(running, F.lit(0)))
        .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        .select(F.col("s").alias("edge_of"), F.col("bucket").alias("edge"), "before")
    )
    return cut(plan.join(edge, plan["plan_of"].eqNullSafe(edge["edge_of"]), "left").drop("edge_of"), "mix-plan")


def _ranked(rows: DataFrame, plan: DataFrame, mark: str, seed: int) -> DataFrame:
    """Join the plan to (k, s, n, w), each name behind ``mark``; add rank and bucket."""
    joined = rows.join(plan, F.col(f"{mark}s").eqNullSafe(F.col("plan_of")))
    chance = F.least(F.greatest(F.col("share") * F.col(f"{mark}w") / F.coalesce(F.col("mean"), F.lit(1.0)), F.lit(1e-12)), F.lit(1 - 1e-12))
    u = uniform(F.col(f"{mark}k"), seed)
    odds = (u / (1 - u)) / (chance / (1 - chance))
    return joined.withColumn(f"{mark}rank", odds / (1 + odds)).withColumn(f"{mark}bucket", F.floor(F.col(f"{mark}rank") * BUCKETS))
