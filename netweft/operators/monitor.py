"""Run monitoring: speeds, models, forecasts, activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amplitude as A
from .metrics import power_law

Keys = Sequence[str]


def run_speed(log: DataFrame, keys: Keys) -> DataFrame:
    """Seconds per step between first and last row (from zero where they are one), last row's values, and the last update interval."""
    w = Window.partitionBy(*keys).orderBy("step")
    x = log.withColumn("interval", F.col("elapsed_sec") - F.lag("elapsed_sec", 1).over(w))
    g = x.groupBy(*keys).agg(
        F.min("step").alias("s0"), F.max("step").alias("last_step"), F.min_by("elapsed_sec", "step").alias("t0"), F.max_by("elapsed_sec", "step").alias("t1"),
        F.max_by("interval", "step").alias("interval"), *[F.max_by(c, "step").alias(c) for c in ("k_min", "k_avg", "k_max", "triangles")],
    )
    steps = F.when(F.col("last_step") > F.col("s0"), F.col("last_step") - F.col("s0")).otherwise(F.col("last_step"))
    time = F.when(F.col("last_step") > F.col("s0"), F.col("t1") - F.col("t0")).otherwise(F.col("t1"))
    return g.select(*keys, "last_step", F.try_divide(time, steps).alias("sec_per_step"), "interval", "k_min", "k_avg", "k_max", "triangles")


def merge_stats(files: DataFrame, logs: DataFrame, keys: Keys, columns: Sequence[str]) -> DataFrame:
    """Full outer merge in which a log's row replaces that of the files."""
    a, b = files.select(*keys, *columns).alias("a"), logs.select(*keys, *columns, F.lit(True).alias("logged")).alias("b")
    j = a.join(b, list(keys), "full")
    return j.select(*keys, *[F.when(F.col("logged"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in columns], F.when(F.col("logged"), "log").otherwise("files").alias("origin"))


def by_size(runs: DataFrame, by: Keys = ("n",)) -> DataFrame:
    """Per size: runs, completed, Hz = 1 / mean seconds per step, mean degrees, triangles with population deviation, and efficiency."""
    g = runs.groupBy(*by).agg(
        F.count("*").alias("seeds"), F.count_if(F.col("done_step").isNotNull()).alias("completed"), F.try_divide(F.lit(1.0), F.avg("sec_per_step")).alias("hz"),
        F.min("k_min").alias("k_min"), F.avg("k_avg").alias("k_avg"), F.max("k_max").alias("k_max"), F.avg("triangles").alias("tri_mean"), F.stddev_pop("triangles").alias("tri_std"),
        F.avg("done_step").alias("goal"),
    )
    return g.withColumn("efficiency", A.efficiency(F.col("tri_mean"), F.col("goal")))


def speed_model(runs: DataFrame) -> DataFrame:
    """One row: seconds per step = a N ** b over all runs; b = 2 and a from the mean where fewer than two sizes are known."""
    slope, factor, _ = power_law(F.col("sec_per_step"), F.col("n"))
    g = runs.agg(slope.alias("b"), factor.alias("a"), F.avg("sec_per_step").alias("mean"), F.max("n").alias("top"))
    return g.select(F.coalesce("a", F.col("mean") / (F.col("top") * F.col("top"))).alias("a"), F.coalesce("b", F.lit(2.0)).alias("b"))


def steps_model(runs: DataFrame) -> DataFrame:
    """One row: steps to completion = c N ** d over the sizes' means; nulls below two sizes."""
    means = runs.where("done_step IS NOT NULL").groupBy("n").agg(F.avg("done_step").alias("steps"))
    slope, factor, _ = power_law(F.col("steps"), F.col("n"))
    return means.agg(factor.alias("c"), slope.alias("d"))


def forecast(runs: DataFrame, targets: Sequence[int]) -> DataFrame:
    """Seconds to completion for sizes the given multiples above the largest seen, ranked by time."""
    one = runs.agg(F.max("n").alias("top")).crossJoin(speed_model(runs)).crossJoin(steps_model(runs))  # one row each
    t = one.select("a", "b", "c", "d", F.explode(F.array(*[F.col("top") * k for k in targets])).alias("n"))
    t = t.withColumns({"sec_per_step": F.col("a") * F.pow("n", "b"), "steps": F.col("c") * F.pow("n", "d")})
    t = t.withColumn("seconds", F.col("sec_per_step") * F.col("steps"))
    # As many rows as targets are given.
    return t.select("n", "sec_per_step", "steps", "seconds", F.rank().over(Window.orderBy(F.asc_nulls_last("seconds"))).cast("long").alias("place"))


def eta(log: DataFrame, keys: Keys, target: float, points: int = 20, least: int = 5) -> DataFrame:
    """Remaining seconds by a regression over the last points; null with fewer than ``least`` or without growth."""
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(1 - points, 0)
    x, y = F.col("elapsed_sec"), F.col("k_avg")
    fit = log.select(*keys, "step", "elapsed_sec", "k_avg", F.count("*").over(w).alias("seen"), F.regr_slope(y, x).over(w).alias("m"), F.regr_intercept(y, x).over(w).alias("c"))
    ok = (F.col("seen") >= least) & (F.col("m") > 1e-6)
    return fit.select(*keys, "step", "seen", F.when(ok, 2 * (target - F.col("c")) / F.col("m") - F.col("elapsed_sec")).alias("eta"))


def sessions(log: DataFrame, keys: Keys, ts: str = "ts", gap_seconds: int = 300) -> DataFrame:
    """Stretches of activity: rows of a run less than the gap apart."""
    s = F.session_window(F.col(ts).cast("timestamp"), f"{gap_seconds} seconds").alias("s")
    return log.groupBy(*keys, s).agg(F.count("*").alias("n_rows")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_rows")


def active(runs: DataFrame, now, gap_seconds: int = 300) -> DataFrame:
    """Runs neither completed nor silent for the gap."""
    return runs.where((~F.col("completed")) & (F.unix_timestamp(now) - F.unix_timestamp("last_seen") < gap_seconds))


def acceptance(moves: DataFrame, keys: Keys) -> DataFrame:
    return moves.groupBy(*keys).agg((F.sum(F.col("accepted").cast("int")) / F.greatest(F.lit(1), F.count("*"))).alias("ratio"))
