"""Parameter sweeps: grid, end states, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import linspace


def grid(spark: SparkSession, p1: tuple[str, float, float, int], p2: tuple[str, float, float, int], seeds: list[int] | None = None) -> DataFrame:
    """Every pair of values of two parameters (and every seed): fixed small sizes."""
    one, two = linspace(spark, *p1[1:], p1[0]).drop("k"), linspace(spark, *p2[1:], p2[0]).drop("k")
    out = one.crossJoin(two)
    return out if seeds is None else out.crossJoin(spark.createDataFrame([(s,) for s in seeds], "seed long"))


def status(valid: Column, streak: Column, k_avg: Column, k_min: Column, goal: int = 100, mean_degree: float = 1.999, min_degree: int = 4) -> Column:
    """End state of a run: a lasting mean degree is stable, crystallized if no node has a small one, collapsed if it is too low."""
    useful = F.when(k_min >= min_degree, "CRYSTALLIZED").otherwise("STABLE")
    return F.when(~valid, "NAN_PSI").when(streak < goal, "TIMEOUT").when(k_avg >= mean_degree, useful).otherwise("COLLAPSED")


def ranked(results: DataFrame) -> DataFrame:
    """Converged points first, then by steps."""
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("converged"), "steps", *[c for c in results.columns if c not in ("converged", "steps", "status")])
    # A sweep has as many rows as grid points.
    return results.withColumn("converged", F.col("status").isin("STABLE", "CRYSTALLIZED")).withColumn("place", F.row_number().over(order).cast("long"))


def best(results: DataFrame) -> DataFrame:
    return ranked(results).where("place = 1")
