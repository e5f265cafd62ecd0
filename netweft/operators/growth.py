"""Growing networks: each edge has a birth, and what holds at a step is a running sum over births.

A series of snapshots that only gains edges needs neither a copy of its edges nor a search for its triangles at
each step: an edge belongs to the first step at or after its birth, a triangle is born with the
youngest of its edges, and triangles are found once, in the last graph. Counts and energies are summed by
(key, born) first and added up over steps then; rows at every step, where they are the result, come from
one explode by the birth.

Edges are ``src, dst, birth[, theta]`` with src < dst; ``steps`` is the rising list of a series' steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amplitude as A
from . import graph as G
from . import metrics as M
from . import observables as O


def _since(steps: Sequence[int], born: Column) -> Column:
    return F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s >= born)


def born(edges: DataFrame, steps: Sequence[int]) -> DataFrame:
    """Edges with ``born``, the first step that has them, instead of their birth; those that no step has are left out."""
    return edges.withColumn("born", F.array_min(_since(steps, F.col("birth")))).where("born IS NOT NULL").drop("birth")


def at_steps(rows: DataFrame, steps: Sequence[int]) -> DataFrame:
    """Rows with a birth step, once for every ``step`` from it on."""
    return rows.withColumn("step", F.explode(_since(steps, F.col("born")))).drop("born")


def added_up(sums: DataFrame, steps: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """``step, [keys], ...``: numbers by (``born``, keys) added up over the births until each step."""
    rest = [c for c in sums.columns if c not in (*keys, "born")]
    return at_steps(sums, steps).groupBy("step", *keys).agg(*[F.sum(c).alias(c) for c in rest])


def triangles(edges: DataFrame) -> DataFrame:
    """``a, b, c, born[, t_ab, t_bc, t_ac]`` with a < b < c, each once, from edges with ``born``."""
    phases = "theta" in edges.columns
    found = G.closed(edges, (), ["born", *(["theta"] if phases else [])])
    return found.select(*[e.alias(n) for n, e in G.ordered(phases).items()], F.greatest("born_w", "born_ux", "born_wx").alias("born"))


def degrees(edges: DataFrame, steps: Sequence[int]) -> DataFrame:
    """``step, node_id, d`` of nodes with an edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"), "born").groupBy("node_id", "born").agg(F.count("*").alias("d"))
    return added_up(ends, steps, ["node_id"])


def node_curvature(nodes: DataFrame, edges: DataFrame, steps: Sequence[int]) -> DataFrame:
    """``step, node_id, curvature``: the mean Forman curvature of a node's edges at every step, 0 without any; ``nodes`` are those of all steps.

    An edge is met once for all steps: a node holds its degrees at all of them, and its neighbours' sums give the mean.
    """
    each = range(len(steps))
    there = lambda k: F.col("born") <= steps[k]
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node_id"), F.col("src").alias("other")))).alias("e"), "born").select("e.*", "born")
    degree = ends.groupBy("node_id").agg(F.array(*[F.count_if(there(k)) for k in each]).alias("d"))
    met = ends.join(degree.select(F.col("node_id").alias("other"), "d").hint("merge"), "other")
    sums = met.groupBy("node_id").agg(*[F.sum(F.when(there(k), F.col("d")[k])).alias(f"s{k}") for k in each])
    own = nodes.select("node_id").join(degree, "node_id", "left").join(sums, "node_id", "left")
    d = lambda k: F.col("d")[k]
    mean = lambda k: F.when(d(k) > 0, (4 * d(k) - d(k) * d(k) - F.col(f"s{k}")).cast("double") / d(k))
    at = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.coalesce(mean(k), F.lit(0.0)).alias("curvature")) for k, s in enumerate(steps)])).alias("x")
    return own.select("node_id", at).select("x.step", "node_id", "x.curvature")


def triangle_counts(edges: DataFrame, frames: DataFrame, steps: Sequence[int]) -> DataFrame:
    """``step, triangles`` of every step of ``frames``, 0 included."""
    n = triangles(edges.select("src", "dst", "born")).groupBy("born").agg(F.count("*").alias("triangles"))
    return frames.select("step").distinct().join(added_up(n, steps), "step", "left").na.fill(0, ["triangles"])


def node_triangles(edges: DataFrame, steps: Sequence[int]) -> DataFrame:
    """``step, node_id, triangles`` of nodes in one."""
    each = triangles(edges.select("src", "dst", "born")).select(F.explode(F.array("a", "b", "c")).alias("node_id"), "born")
    return added_up(each.groupBy("node_id", "born").agg(F.count("*").alias("triangles")), steps, ["node_id"])


def snapshot_metrics(nodes: DataFrame, edges: DataFrame, steps: Sequence[int]) -> DataFrame:
    """Degree statistics, five-bin histogram and triangles of every step; ``nodes``: step, node_id."""
    d = nodes.select("step", "node_id").join(degrees(edges, steps), ["step", "node_id"], "left").na.fill(0, ["d"])
    stats = M.degree_summary(d, ["step"])
    return stats.join(M.histogram5(d, ["step"]), "step").join(triangle_counts(edges, stats, steps), "step")


def total_action(nodes: DataFrame, edges: DataFrame, p: dict[str, float], steps: Sequence[int]) -> DataFrame:
    """Self, edge, triangle and degree parts of the action at every step, and their sum; ``nodes`` are those of all steps."""
    selfs = M.node_energies(nodes, p).agg(F.sum("self_energy").alias("self_part"))
    energies = M.edge_energies(nodes, edges, p, ["born"], node_keys=())
    edge = added_up(energies.groupBy("born").agg(F.sum(F.col("hop") + F.col("stress") + F.col("bias")).alias("edge_part")), steps)
    tri = triangles(edges).groupBy("born").agg(F.sum(A.triangle_energy(F.col("t_ab"), F.col("t_bc"), F.col("t_ac"), p)).alias("triangle_part"))
    deg = degrees(edges, steps).groupBy("step").agg(F.sum(A.degree_energy(F.col("d"), p)).alias("degree_part"))
    frame = edges.sparkSession.createDataFrame([(s,) for s in steps], "step int")
    out = frame.crossJoin(F.broadcast(selfs)).join(edge, "step", "left").join(added_up(tri, steps), "step", "left").join(deg, "step", "left").na.fill(0.0)  # one row of selfs
    return out.withColumn("action", F.col("self_part") + F.col("edge_part") + F.col("triangle_part") + F.col("degree_part"))


def mean_loops(edges: DataFrame, steps: Sequence[int]) -> DataFrame:
    """``step, loops, mean_loop`` of steps with triangles."""
    loop = F.cos(F.col("t_ab") + F.col("t_bc") - F.col("t_ac"))
    sums = added_up(triangles(edges).groupBy("born").agg(F.count("*").alias("loops"), F.sum(loop).alias("total")), steps)
    return sums.select("step", "loops", (F.col("total") / F.col("loops")).alias("mean_loop"))


def edge_loop_energy(nodes: DataFrame, edges: DataFrame, p: dict[str, float], steps: Sequence[int]) -> DataFrame:
    """``step, src, dst, local_energy``: an edge's hop energy and that of the step's triangles on it."""
    energy = A.triangle_energy(F.col("t_ab"), F.col("t_bc"), F.col("t_ac"), p).alias("energy")
    sides = F.explode(F.array(*[F.struct(F.col(i).alias("src"), F.col(j).alias("dst")) for i, j in ("ab", "bc", "ac")])).alias("e")
    tri = triangles(edges).select(sides, "born", energy).groupBy("e.src", "e.dst", "born").agg(F.sum("energy").alias("x"))
    own = M.edge_energies(nodes, edges, p, ["born"], node_keys=()).select("src", "dst", "born", F.col("hop").alias("x"))
    # An edge's own birth is the first of its rows, so the sum over births starts with its hop energy.
    return added_up(own.unionByName(tri).groupBy("src", "dst", "born").agg(F.sum("x").alias("local_energy")), steps, ["src", "dst"])


def gauge_check(nodes: DataFrame, edges: DataFrame, steps: Sequence[int], seed: int = 1) -> DataFrame:
    """The largest change of loops and of edge correlations of every step under a gauge transform; ``nodes`` are those of all steps."""
    one = O.loop_errors(triangles(edges), ["born"], seed)
    two = O.pair_errors(nodes, edges, ["born"], seed, node_keys=())
    largest = lambda df, n: at_steps(df, steps).groupBy("step").agg(F.sum(f"{n}s").alias(f"{n}s"), F.max(f"{n}_error").alias(f"{n}_error"))
    return largest(two, "pair").join(largest(one, "loop"), "step", "left")
