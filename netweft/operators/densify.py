"""Densifying snapshot series: missing frames, launch pads, and the order in which frames are made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, spread
from .graph import numbered

Keys = Sequence[str]


def stride(steps: DataFrame, keys: Keys, factor: float) -> DataFrame:
    """Per run the last step and the denser stride: last / (frames - 1), over the factor, truncated, at least 1."""
    g = steps.groupBy(*keys).agg(F.max("step").alias("last"), F.countDistinct("step").alias("n"))
    mean = F.col("last") / F.greatest(F.col("n") - 1, F.lit(1))
    return g.select(*keys, "last", F.greatest(F.floor(mean / factor), F.lit(1)).cast("long").alias("stride"))


def missing_frames(steps: DataFrame, keys: Keys, factor: float, start: float = 0.0, end: float = 100.0) -> DataFrame:
    """Multiples of the denser stride within a window (percent of the last step) that have no frame yet."""
    s = stride(steps, keys, factor)
    first, last = F.floor(F.col("last") * start / 100), F.floor(F.col("last") * end / 100)
    s = s.withColumn("first", (F.ceil(first / F.col("stride")) * F.col("stride")).cast("long")).withColumn("end", last.cast("long")).where("first <= end")
    grid = s.select(*keys, F.explode(F.sequence("first", "end", "stride")).alias("step"))
    return grid.join(steps.select(*keys, "step"), [*keys, "step"], "left_anti")


def launch_pads(wanted: DataFrame, existing: DataFrame, keys: Keys) -> DataFrame:
    """For each wanted step the greatest existing one at or before it, else 0: a union and one window, no range join."""
    rows = wanted.select(*keys, "step", F.lit(None).cast("long").alias("pad"), F.lit(1).alias("is_wanted")).unionByName(existing.select(*keys, "step", F.col("step").cast("long").alias("pad"), F.lit(0).alias("is_wanted")))
    w = Window.partitionBy(*keys).orderBy("step", "is_wanted").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("pad", F.coalesce(F.last("pad", ignorenulls=True).over(w), F.lit(0).cast("long"))).where("is_wanted = 1").select(*keys, "step", "pad")


def valid_pads(nodes: DataFrame, n: int, keys: Keys) -> DataFrame:
    """Snapshots that hold as many nodes as they should."""
    return nodes.groupBy(*keys, "step").agg(F.count("*").alias("found")).where(F.col("found") == n).select(*keys, "step")


def _descent(k: Column, n: Column) -> Column:
    """The way of index k down the halvings of 0..n-1 until it is a midpoint: ``level``, ``path`` (its place among the level's intervals) and the interval ``a, b``."""
    start = F.struct(F.lit(0).cast("long").alias("a"), (n - 1).cast("long").alias("b"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("path"))

    def halve(s: Column, _: Column) -> Column:
        m = F.floor((s["a"] + s["b"]) / 2).cast("long")
        right = k > m
        inner = F.struct(
            F.when(right, m).otherwise(s["a"]).alias("a"), F.when(right, s["b"]).otherwise(m).alias("b"),
            (s["level"] + 1).alias("level"), (2 * s["path"] + right.cast("long")).alias("path"),
        )
        return F.when(k == m, s).otherwise(inner)

    return F.aggregate(_halvings(n), start, halve)


def _halvings(n: Column) -> Column:
    """1, 2, .. up to the binary digits of n: no way down 0..n-1 is longer, so a row's work goes by its own series."""
    return F.sequence(F.lit(1), F.length(F.bin(F.greatest(n.cast("long"), F.lit(1).cast("long")))))


def _midpoints(width: Column, depth: Column) -> Column:
    """Midpoints that an interval of ``width`` has ``depth`` levels below it: a part has one if it is 2 wide or more, and parts differ by 1 at most."""
    parts = F.pow(F.lit(2.0), depth).cast("long")
    each = F.floor(width / parts)
    return F.when(each >= 2, parts).when(each == 1, width % parts).otherwise(0).cast("long")


def bisection_place(k: Column, n: Column) -> Column:
    """The place of index k among n in the order first, last, then midpoints level by level.

    Levels are full but for the last; a midpoint's place in the last is what lies left of its way down.
    """
    start = F.struct(F.lit(0).cast("long").alias("a"), (n - 1).cast("long").alias("b"), F.lit(0).cast("long").alias("left"))

    def place(level: Column) -> Column:
        def walk(s: Column, j: Column) -> Column:
            m = F.floor((s["a"] + s["b"]) / 2).cast("long")
            right = k > m
            skipped = F.when(right, _midpoints(m - s["a"], level - j)).otherwise(0).cast("long")
            inner = F.struct(F.when(right, m).otherwise(s["a"]).alias("a"), F.when(right, s["b"]).otherwise(m).alias("b"), (s["left"] + skipped).alias("left"))
            return F.when(j <= level, inner).otherwise(s)

        left = F.aggregate(_halvings(n), start, walk)["left"]
        full = F.pow(F.lit(2.0), level).cast("long") - 1  # midpoints of the levels above
        return F.when(k == 0, 0).when(k == n - 1, 1).otherwise(2 + full + left).cast("long")

    # An array of one binds the level: as an expression it would be worked out anew in every round of the walk.
    return F.get(F.transform(F.array(_descent(k, n)["level"]), place), F.lit(0))


def frame_order(frames: DataFrame, keys: Keys = ()) -> DataFrame:
    """``[keys], step, index, place`` of each series' frames in bisection order, as column expressions; frames are numbered by ranges."""
    keys = list(keys)
    # Stored first: dealing by ranges reads its rows twice.
    ranked = checkpointed(numbered(checkpointed(frames.select(*keys, F.col("step").alias("node_id")).distinct()), keys).withColumnRenamed("node_id", "step"))
    sizes = ranked.groupBy(*keys).agg((F.max("index") + 1).alias("n"))
    rows = ranked.join(sizes, keys) if keys else ranked.crossJoin(F.broadcast(sizes))  # one row
    return spread(rows).select(*keys, "step", "index", bisection_place(F.col("index"), F.col("n")).alias("place"))
