"""Consistent-hash ring with virtual nodes and bounded loads, law ``rows``.

Every shard owns ``VNODES`` points of a ring; a key (the document id) belongs to the arc that ends
at the next point clockwise. Loads are bounded by the smallest capacities that hold all rows, so
counts are at most one apart. Within an arc keys have priorities by hash; a key that finds its
shard full continues clockwise to the next point whose shard has room. Keys of earlier priority
classes are placed first on all arcs, so what overflows is spread along the ring instead of
pushing on the neighbours of one hot arc.

The driver sees only counts by (arc, priority class), a number fixed by parameters, and gives back
runs of ranks for each such cell; ranks are row numbers within a cell. Repeated ids share an arc but
not a priority class, which comes from id, text checksum and size together.

Defined cases: a null text has no bytes (size 8, checksum 0); a null id is a key of its own; equal rows are
placed each and are interchangeable; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

SHARDS, VNODES, CLASSES, SEED = 24, 128, 16, 20240229


def ring(shards: int, vnodes: int = VNODES, seed: int = SEED) -> list[tuple[int, int]]:
    """Points (position, shard) in clockwise order; the points of a shard don't depend on the number of shards."""
    points = []
    for s in range(shards):
        points += [(int(p), s) for p in np.random.Generator(np.random.Philox(key=[seed, s])).integers(0, 1 << 31, vnodes)]
    return sorted(points)


def place(cells: dict[tuple[int, int], int], points: list[tuple[int, int]], shards: int) -> dict[tuple[int, int], list[tuple[int, int, int, int]]]:
    """For each cell (arc, class) its runs (first rank, rows, shard, first slot).

    Capacities are the row count divided by the shards, rounded up for as many as have to be; which
    those are follows the ring's order of first points, so that it doesn't depend on the loads.
    """
    total = sum(cells.values())
    order = list(dict.fromkeys(s for _, s in points))
    capacity = {s: total // shards + (k < total % shards) for k, s in enumerate(order)}
    filled = dict.fromkeys(order, 0)
    arcs = len(points)
    following = list(range(1, arcs)) + [0]  # the next point whose shard may have room; paths are shortened as shards fill up
    plan: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}

    def vacant(arc: int) -> int:
        seen = []
        while filled[points[arc][1]] >= capacity[points[arc][1]]:
            seen.append(arc)
            arc = following[arc]
        for k in seen:
            following[k] = arc
        return arc

    for arc, level in sorted(cells, key=lambda c: (c[1], c[0])):
        left, rank, at = cells[arc, level], 0, arc
        runs = plan.setdefault((arc, level), [])
        while left:
            at = vacant(at)
            s = points[at][1]
            k = min(left, capacity[s] - filled[s])
            runs.append((rank, k, s, filled[s]))
            filled[s] += k
            rank, left = rank + k, left - k
    return plan


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with its shard and its slot there; counts of shards are at most one apart."""
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    starts = [p for p, _ in points]

    @F.pandas_udf("int")
    def arc_of(position):
        import pandas as pd

        return pd.Series(np.searchsorted(starts, position.to_numpy()) % len(starts)).astype("int32")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("position", F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(1 << 31)))
    rows = rows.withColumn("level", F.pmod(F.xxhash64("text_crc32", "doc_id", "size"), F.lit(CLASSES)).cast("int"))
    rows = cut(rows.withColumn("arc", arc_of("position")).drop("position"), "shard-keys")
    counts = rows.groupBy("arc", "level").count().collect()  # at most shards * vnodes * CLASSES rows
    plan = place({(r["arc"], r["level"]): r["count"] for r in counts}, points, shards)
    runs = [(a, c, r) for (a, c), cell in plan.items() for r in cell]
    table = pa.table({"arc": pa.array([a for a, _, _ in runs], pa.int32()), "level": pa.array([c for _, c, _ in runs], pa.int32()), **{n: pa.array([r[k] for _, _, r in runs], pa.int64()) for k, n in enumerate(("rank", "k", "shard", "start"))}})
    # Dealt by the columns that the ranks are dealt by, so that only these rows move; Spark sees their size.
    runs_df = spark.createDataFrame(table).groupBy("arc", "level").agg(F.collect_list(F.struct("rank", "k", F.col("shard").cast("int").alias("shard"), F.col("start").alias("slot"))).alias("runs"))
    within = Window.partitionBy("arc", "level").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("n", F.row_number().over(within) - 1).join(runs_df, ["arc", "level"])
    ranked = ranked.withColumn("run", F.filter("runs", lambda x: (x["rank"] <= F.col("n")) & (F.col("n") < x["rank"] + x["k"]))[0])
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("run.shard").alias("shard"),
        (F.col("run.slot") + F.col("n") - F.col("run.rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
