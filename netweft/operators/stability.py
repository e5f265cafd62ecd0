"""Run-level analytics over ordered logs: streaks, stability, progress slices, reports, trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amplitude as A

Keys = Sequence[str]

# Fractions of a run's progress at which reports look.
SLICES = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.99, 1.00)


def kinematics(log: DataFrame, keys: Keys, value: str = "triangles") -> DataFrame:
    """First and second differences of a series (the first of each 0) and its running maximum."""
    w = Window.partitionBy(*keys).orderBy("step")
    x = log.withColumn("velocity", F.col(value) - F.lag(value, 1).over(w)).withColumn("velocity", F.coalesce("velocity", F.lit(0).cast("long")))
    x = x.withColumn("acceleration", F.col("velocity") - F.coalesce(F.lag("velocity", 1).over(w), F.lit(0).cast("long")))
    return x.select(*keys, "step", value, "velocity", "acceleration", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))


def streaks(log: DataFrame, keys: Keys, k: str = "k_avg") -> DataFrame:
    """Length, up to each row, of the run of equal quantised degrees."""
    w = Window.partitionBy(*keys).orderBy("step")
    x = log.withColumn("level", A.quantised(F.col(k)))
    changed = F.when(F.col("level") == F.lag("level", 1).over(w), 0).otherwise(1)
    x = x.withColumn("changed", changed).withColumn("island", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.row_number().over(Window.partitionBy(*keys, "island").orderBy("step"))
    return x.withColumn("streak", streak.cast("long")).drop("changed", "island")


def completion(log: DataFrame, keys: Keys, goal: int = 10, min_degree: int = 2, mean_degree: float = 2.8) -> DataFrame:
    """Per run the longest streak and the first step at which streak and degrees reach their goals (null: never)."""
    done = (F.col("streak") >= goal) & (F.col("k_min") >= min_degree) & (F.col("k_avg") >= mean_degree)
    return streaks(log, keys).groupBy(*keys).agg(F.max("streak").alias("longest"), F.min(F.when(done, F.col("step"))).alias("done_step"))


def stable_on_disk(log: DataFrame, keys: Keys, interval: int, last: int = 10, min_degree: int = 2) -> DataFrame:
    """Whether the last snapshots exist at exact intervals, the latest has the least degree, and quantised degrees are all equal."""
    w = Window.partitionBy(*keys)
    x = log.withColumn("latest", F.max("step").over(w)).where((F.col("step") > F.col("latest") - last * interval) & ((F.col("latest") - F.col("step")) % interval == 0))
    g = x.groupBy(*keys).agg(
        F.max("latest").alias("latest"), F.countDistinct("step").alias("found"), F.countDistinct(A.quantised(F.col("k_avg"))).alias("levels"), F.max_by("k_min", "step").alias("k_min"),
    )
    return g.select(*keys, "latest", "found", ((F.col("found") == last) & (F.col("levels") == 1) & (F.col("k_min") >= min_degree)).alias("stable"))


def stable_by_metrics(log: DataFrame, keys: Keys, share: float = 0.01, least: int = 3) -> DataFrame:
    """Whether the triangle count is constant over the last share of steps (at least some rows) and no node is isolated at the end."""
    w = Window.partitionBy(*keys)
    x = log.withColumn("latest", F.max("step").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("step"))))
    x = x.withColumn("recent", F.col("step") >= F.col("latest") - share * F.col("latest")).withColumn("n_recent", F.sum(F.col("recent").cast("int")).over(w))
    used = x.where(F.when(F.col("n_recent") >= least, F.col("recent")).otherwise(F.col("rank") <= least))
    g = used.groupBy(*keys).agg(F.count("*").alias("rows_used"), F.countDistinct("triangles").alias("values"), F.max_by("k_min", "step").alias("last_min"))
    return g.select(*keys, "rows_used", ((F.col("values") == 1) & (F.col("last_min") > 0)).alias("stable"))


def nearest(rows: DataFrame, targets: DataFrame, keys: Keys, step: str = "step", target: str = "target") -> DataFrame:
    """For each target of a run its closest row; ties go to the smaller step. Rows meet only their own run's targets."""
    pairs = rows.join(targets, list(keys))
    best = F.min_by(F.struct(*[F.col(c) for c in rows.columns if c not in keys]), F.struct(F.abs(F.col(step) - F.col(target)), F.col(step)))
    return pairs.groupBy(*keys, *[c for c in targets.columns if c not in keys]).agg(best.alias("row")).select(*keys, *[c for c in targets.columns if c not in keys], "row.*")


def progress_slices(log: DataFrame, keys: Keys, fractions: Sequence[float] = SLICES, tolerance: float = 0.15) -> DataFrame:
    """Rows nearest to given fractions of each run's last step, if within max(1, tolerance * last)."""
    # Fractions of one run: an array exploded from its summary row, so no join grows with the square of anything.
    ends = log.groupBy(*keys).agg(F.max("step").alias("last"))
    t = ends.withColumn("slice", F.explode(F.array(*[F.lit(int(round(f * 100))) for f in fractions]))).withColumn("target", F.floor(F.col("last") * F.col("slice") / 100))
    found = nearest(log, t, keys)
    return found.where(F.abs(F.col("step") - F.col("target")) <= F.greatest(F.lit(1.0), tolerance * F.col("last"))).drop("last")


def slice_report(slices: DataFrame, by: Keys, seed: str, values: Sequence[str]) -> DataFrame:
    return slices.groupBy(*by, "slice").agg(F.countDistinct(seed).alias("seeds"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def config_summary(runs: DataFrame, by: Keys, values: Sequence[str], largest: Sequence[str] = ()) -> DataFrame:
    """Count, means and sample deviations (null for single rows), and maxima."""
    out: list[Column] = [F.count("*").alias("runs")]
    out += [f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return runs.groupBy(*by).agg(*out, *[F.max(v).alias(f"max_{v}") for v in largest])


def mean_trajectory(log: DataFrame, by: Keys, values: Sequence[str]) -> DataFrame:
    return log.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def trajectories(log: DataFrame, by: Keys, values: Sequence[str] = ("k_min", "k_avg", "k_max")) -> DataFrame:
    """One ordered array of (step, values) per run."""
    return log.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("step", *values))).alias("points"))


def evolution(runs: DataFrame, series: str = "points") -> DataFrame:
    """Nested series as a long table, ordered."""
    return runs.select(*[c for c in runs.columns if c != series], F.explode(series).alias("p")).select(*[c for c in runs.columns if c != series], "p.*").orderBy(*[c for c in runs.columns if c != series], "step")


def found_counts(runs: DataFrame, by: Keys, files: str = "files", least: int = 200) -> DataFrame:
    """Runs found and valid (enough files) per group, with a status."""
    g = runs.groupBy(*by).agg(F.count("*").alias("found"), F.count_if(F.col(files) >= least).alias("valid"))
    return g.withColumn("status", F.when(F.col("valid") == 0, "EMPTY").when(F.col("valid") < F.col("found"), "PARTIAL").otherwise("OK"))


def integrity(metrics: DataFrame, counts: DataFrame, keys: Keys, last: int = 10) -> DataFrame:
    """Of each run's last rows those before the first whose edge count differs from the stored edges: what may be kept."""
    w = Window.partitionBy(*keys)
    x = metrics.join(counts.withColumnRenamed("edges", "stored"), [*keys, "step"], "left")
    x = x.withColumn("rank", F.row_number().over(w.orderBy(F.desc("step"))))
    checked = F.when(F.col("rank") <= last, F.coalesce((F.col("edges") != F.col("stored")), F.lit(True)).cast("int")).otherwise(0)
    x = x.withColumn("bad", checked)
    x = x.withColumn("broken", F.max("bad").over(w.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    return x.select(*keys, "step", "edges", "stored", (F.col("bad") == 1).alias("mismatch"), (F.col("broken") == 0).alias("keep"))


def incremental(metrics: DataFrame, wanted: DataFrame, keys: Keys) -> DataFrame:
    """Steps still to be computed: those wanted that kept metrics lack."""
    return wanted.join(metrics.select(*keys, "step"), [*keys, "step"], "left_anti")
