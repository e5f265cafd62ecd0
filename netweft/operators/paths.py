"""The k shortest simple paths between given sources and targets, exact, by the few partial paths that come first.

A walk that is at most one hop longer than its pair's distance repeats no node: what it goes round has two hops or more, and without
that it would be shorter than the distance. So whether a walk of a given length is left to each target (a bit a target, whatever the
degrees) tells which partial paths arrive; each of them has a path at least, so of a pair and length the first k
are enough. Pairs without k paths by then are searched on by partial paths of growing length, as far as they can still arrive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .graph import arcs
from .landmarks import bits, distances, holds, words


def _arrives(hops: Column, limits: Column, length: int) -> Column:
    """Whether some target that is ``hops`` away is reached within its limit (null: closed or unreachable)."""
    return F.exists(F.zip_with(hops, limits, lambda h, l: h + length <= l), lambda x: F.coalesce(x, F.lit(False)))


def _up_to(both: DataFrame, hops: DataFrame, limits: DataFrame, marks: DataFrame, longest: int) -> DataFrame:
    """``source, node_id, place, path, phase``: all simple paths to targets within their pairs' limits."""
    paths = limits.select("source", F.col("source").alias("node_id"), F.array("source").alias("path"), F.lit(0.0).alias("phase"), "limits")
    found = None
    for length in range(1, longest + 1):
        step = paths.select("source", F.col("node_id").alias("src"), "path", "phase", "limits").join(both, "src").where(~F.array_contains("path", F.col("dst")))
        step = step.join(hops.withColumnRenamed("node_id", "dst"), "dst").where(_arrives(F.col("hops"), F.col("limits"), length))
        paths = checkpointed(step.select("source", F.col("dst").alias("node_id"), F.concat("path", F.array("dst")).alias("path"), (F.col("phase") + F.col("theta")).alias("phase"), "limits"))
        hit = paths.join(marks, "node_id").where(F.get("limits", F.col("place")) >= length).drop("limits")
        found = hit if found is None else found.unionByName(hit)
    return checkpointed(found)


def _first(both: DataFrame, left: list[DataFrame], pairs: DataFrame, length: int, names: list[str]) -> DataFrame:
    """``source, place, path, phase``: of each pair the first walks of ``length`` hops by their nodes, as many as it ``need``s.

    A partial walk goes on to nodes from which a walk of just the hops left leads to the target, so none is in vain.
    """
    paths = pairs.select("source", "place", "need", F.col("source").alias("src"), F.array("source").alias("path"), F.lit(0.0).alias("phase"))
    order = Window.partitionBy("source", "place").orderBy("path")
    for step in range(1, length + 1):
        there = left[length - step].select(F.col("node_id").alias("dst"), F.array(*names).alias("ends"))
        on = paths.join(both, "src").join(there, "dst").where(holds(F.col("ends"))(F.col("place")))
        on = on.select("source", "place", "need", F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path"), (F.col("phase") + F.col("theta")).alias("phase"))
        paths = checkpointed(on.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("need")).drop("rank"))
    return paths.drop("need", "src")


def _longer(edges: DataFrame, both: DataFrame, marks: DataFrame, n: int, rest: DataFrame, k: int, max_depth: int) -> DataFrame | None:
    """The k shortest paths of the pairs of ``rest`` (source, place, limit), whose walks may repeat nodes: all paths up to a limit, until there are k."""
    turned = lambda df: df.select("source", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.col("next")[p]).alias("limits"))
    grouped = lambda df, limit: turned(df.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("place", limit))).alias("next")))
    hops = checkpointed(distances(edges, marks, n, ()))
    limits = grouped(rest, F.col("limit"))
    order = Window.partitionBy("source", "node_id").orderBy(F.size("path"), "path")
    out = None
    while True:
        limits = checkpointed(limits.where(F.exists("limits", lambda l: l.isNotNull())))
        longest = limits.agg(F.max(F.array_max("limits"))).first()[0]
        if longest is None:
            return out
        found = _up_to(both, hops, limits, marks, longest)
        counts = found.groupBy("source", "place").agg(F.count("*").alias("n"))
        pairs = limits.select("source", F.posexplode("limits").alias("place", "limit")).where("limit IS NOT NULL").join(counts, ["source", "place"], "left")
        state = checkpointed(pairs.withColumn("closed", (F.coalesce("n", F.lit(0)) >= k) | (F.col("limit") >= max_depth)))
        done = found.join(state.where("closed").select("source", "place"), ["source", "place"], "left_semi")
        ranked = done.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = checkpointed(ranked.select("source", "node_id", "rank", (F.size("path") - 1).alias("d"), "phase"))
        out = ranked if out is None else out.unionByName(ranked)
        limits = grouped(state.where("NOT closed"), F.col("limit") + 1)


def k_shortest(edges: DataFrame, sources: DataFrame, targets: DataFrame, k: int, max_depth: int) -> DataFrame:
    """``source, node_id, rank, d, phase``: the k shortest simple paths of at most ``max_depth`` hops (order: hops, then nodes).

    ``sources`` and ``targets`` are stated sets of some hundred nodes: a pair is a row. A source that is a target has no path to itself.
    """
    marks = checkpointed(targets.select("node_id").distinct().withColumn("place", (F.row_number().over(Window.orderBy("node_id")) - 1).cast("int")))
    n = max(marks.count(), 1)
    names = words(n)
    both = checkpointed(arcs(edges.select("src", "dst", "theta")))
    left = [checkpointed(bits(marks, n))]
    starts = sources.select(F.col("node_id").alias("source")).distinct()
    pairs = starts.crossJoin(F.broadcast(marks)).where("source != node_id")  # some hundred targets
    state = checkpointed(pairs.select("source", "place", F.lit(None).cast("int").alias("d"), F.lit(0).cast("long").alias("n")))
    found = []
    for length in range(1, max_depth + 1):
        got = left[-1].withColumnRenamed("node_id", "src").join(both.select("src", "dst"), "src").groupBy(F.col("dst").alias("node_id"))
        left.append(checkpointed(got.agg(*[F.bit_or(w).alias(w) for w in names])))
        ends = left[-1].select(F.col("node_id").alias("source"), F.array(*names).alias("ends"))
        arrives = F.coalesce(holds(F.col("ends"))(F.col("place")), F.lit(False))
        met = state.join(ends, "source", "left").withColumn("arrives", arrives).withColumn("d", F.when(F.col("d").isNull() & F.col("arrives"), F.lit(length)).otherwise(F.col("d")))
        met = checkpointed(met.select("source", "place", "d", "n", ((F.col("n") < k) & F.col("arrives") & (F.col("d") >= length - 1)).alias("turn")))
        paths = _first(both, left, met.where("turn").withColumn("need", k - F.col("n")), length, names)
        found.append(paths)
        more = paths.groupBy("source", "place").agg(F.count("*").alias("more"))
        state = met.join(more, ["source", "place"], "left").select("source", "place", "d", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        state = checkpointed(state)
        if state.where((F.col("d").isNull()) | ((F.col("n") < k) & (F.col("d") == length))).isEmpty():
            break
    rest = checkpointed(state.where((F.col("n") < k) & (F.col("d") + 1 < max_depth)).select("source", "place", (F.col("d") + 2).alias("limit")))
    if not found:
        found = [state.select("source", "place", F.array("source").alias("path"), F.lit(0.0).alias("phase")).limit(0)]
    order = Window.partitionBy("source", "place").orderBy(F.size("path"), "path")
    ranked = reduce(DataFrame.unionByName, found).join(rest.select("source", "place"), ["source", "place"], "left_anti").withColumn("rank", F.row_number().over(order))
    out = ranked.join(F.broadcast(marks), "place").select("source", "node_id", "rank", (F.size("path") - 1).alias("d"), "phase")
    longer = None if rest.isEmpty() else _longer(edges, both, marks, n, rest, k, max_depth)
    return out if longer is None else out.unionByName(longer)
