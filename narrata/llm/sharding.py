"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys are texts: equal texts hash to the same place of the ring, so they stay
together unless they outweigh what a shard may hold.  A key goes to the next
virtual node clockwise; one that would overfill its shard continues clockwise
to the first shard with room, which bounds every shard's load.

The ring has ``CELLS`` equal arcs.  Spark adds the sizes up per arc, and apart
from them for each heavy text (over ``1 / HEAVY`` of a shard, so their number
is bounded by ``HEAVY`` times the shards).  Only that bounded table reaches
the driver, which walks it once; rows are placed by joining it back.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS = 1 << 14
HEAVY = 256
VNODES = 64
OWN = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def ring_point(name: str) -> int:
    """Place of a name on the ring of ``CELLS`` arcs."""
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big") % CELLS


def place(loads: list[tuple[int, int, int, int]], shards: int, slack: float, vnodes: int = VNODES) -> dict[tuple[int, int, int], int]:
    """Shard of each unit (cell, key, piece, load) under the bounded-load rule.

    Units are taken heaviest first, then by place, so the order does not
    depend on the input's; each goes to the first shard clockwise that has
    room for it.  The bound is ``(1 + slack)`` times the mean load; a unit for
    which none has room takes the emptiest shard.
    """
    nodes = sorted((ring_point(f"shard-{s}-{v}"), s) for s in range(shards) for v in range(vnodes))
    points = [p for p, _ in nodes]
    bound = (1 + slack) * sum(x[3] for x in loads) / shards
    held, out = [0] * shards, {}
    for cell, key, piece, load in sorted(loads, key=lambda x: (-x[3], *x[:3])):
        at, seen = bisect.bisect_left(points, cell), set()
        chosen = None
        for i in range(len(nodes)):
            s = nodes[(at + i) % len(nodes)][1]
            if s in seen:
                continue
            seen.add(s)
            if held[s] + load <= bound:
                chosen = s
                break
            if len(seen) == shards:
                break
        chosen = min(range(shards), key=lambda s: (held[s], s)) if chosen is None else chosen
        held[chosen] += load
        out[cell, key, piece] = chosen
    return out


def ring_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", slack: float = 0.002) -> DataFrame:
    """Place every row; add size, text_crc32, law, shard, slot and grown_shard.

    ``law`` is ``bytes``: no shard holds more than ``1 + slack`` times the mean
    of the sizes (UTF-8 bytes plus 1), up to the load of one arc.  ``slot``
    numbers a shard's rows from 0 without gaps.

    Edge cases: a null text has no bytes, size 1 and the checksum 0, and counts
    as equal to other null texts; a null key sorts first; a text that weighs
    more than half a shard is cut into pieces by key, so a third of all rows
    may be one text; rows repeated in full are placed one by one and may share
    pieces; an empty table gives an empty one.  Other columns pass through;
    columns named as this operator's own are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OWN])
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    hashed = docs.withColumns({"size": size, "text_crc32": F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long"), "__t": F.xxhash64(text)})
    groups = hashed.groupBy("__t").agg(F.sum("size").alias("load"), F.count("*").alias("rows"))
    total, rows = groups.agg(F.sum("load"), F.sum("rows")).first()
    if not total:
        return hashed.select(*docs.columns, "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    per_shard = total / shards
    piece_rows = max(1, rows // CELLS)
    # At most HEAVY * shards texts hold that share of the bytes, and CELLS that share of the rows: short texts may be many.
    heavy = {r["__t"]: (r["load"], r["rows"]) for r in groups.filter((F.col("load") >= per_shard / HEAVY) | ((F.col("rows") > 1) & (F.col("rows") >= piece_rows))).collect()}
    pieces = [(t, load > per_shard / 2, max(1, min(CELLS, n // piece_rows))) for t, (load, n) in heavy.items()]
    table = F.broadcast(spark.createDataFrame(pieces, "__h long, spread boolean, pieces long"))
    cell = F.pmod(F.xxhash64("__t", F.lit("ring")), F.lit(CELLS))
    piece = F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(key), F.lit("piece")), F.coalesce("pieces", F.lit(1))))
    placed = hashed.join(table, hashed["__t"] == table["__h"], "left").withColumns({"__cell": cell.cast("long"), "__key": F.coalesce("__h", F.lit(0)), "__piece": piece.cast("long")})
    loads = placed.groupBy("__cell", "__key", "__piece").agg(F.sum("size").alias("load"), F.count("*").alias("rows"), F.first("spread").alias("spread")).collect()
    units: dict[tuple[int, int, int], int] = {}
    for r in loads:
        units[_unit(r)] = units.get(_unit(r), 0) + r["load"]
    shard_of = place([(*u, load) for u, load in units.items()], shards, slack)
    start, placing = [0] * shards, []
    for r in sorted(loads, key=lambda r: (r["__cell"], r["__key"], r["__piece"])):
        s = shard_of[_unit(r)]
        placing.append((r["__cell"], r["__key"], r["__piece"], s, start[s]))
        start[s] += r["rows"]
    # One row per arc and per piece of a heavy text: at most 2 * CELLS + HEAVY * shards.
    places = F.broadcast(spark.createDataFrame(placing, "__cell long, __key long, __piece long, shard int, start long"))
    number = F.row_number().over(Window.partitionBy("__cell", "__key", "__piece").orderBy(key, "text_crc32", "size")) - 1
    return (
        placed.join(places, ["__cell", "__key", "__piece"])
        .withColumn("slot", (F.col("start") + number).cast("long"))
        .select(*docs.columns, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )


def _unit(r) -> tuple[int, int, int]:
    """What moves as one: an arc, a heavy text, or a piece of one that no shard should take whole.

    Pieces lie apart on the ring, as far as a multiplicative hash takes them.
    """
    return ((r["__cell"] + r["__piece"] * 40503) % CELLS, r["__key"], r["__piece"]) if r["spread"] else (r["__cell"], r["__key"], -1)
