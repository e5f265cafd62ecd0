"""Snapshot metrics, histograms, energies and fits, as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amplitude as A
from . import blocks as B
from . import graph as G
from . import landmarks as L

Keys = Sequence[str]


def grouped(df: DataFrame, keys: Keys):
    return df.groupBy(*keys) if keys else df.groupBy()


def degree_stats(nodes: DataFrame, edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """Nodes, edges, and minimum, mean, population deviation and maximum of the degrees, isolated nodes included."""
    return degree_summary(G.all_degrees(nodes.select(*keys, "node_id"), edges, keys), keys)


def degree_summary(d: DataFrame, keys: Keys = ()) -> DataFrame:
    """The same of a table of degrees."""
    return grouped(d, keys).agg(
        F.count("*").alias("n_nodes"), (F.coalesce(F.sum("d"), F.lit(0)) / 2).cast("long").alias("edges"), F.coalesce(F.min("d"), F.lit(0)).alias("min_degree"),
        F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean_degree"), F.coalesce(F.stddev_pop("d"), F.lit(0.0)).alias("std_degree"), F.coalesce(F.max("d"), F.lit(0)).alias("max_degree"),
    )


def histogram5(degrees: DataFrame, keys: Keys = (), bins: int = 5) -> DataFrame:
    """Equal-width bins between the smallest and largest degree, the last closed; all in the first if they are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min("d").over(w), F.max("d").over(w)
    b = degrees.select(*keys, "d", low.alias("low"), high.alias("high"))
    b = b.withColumn("bin", F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.col("d") - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1))))
    return grouped(b, keys).agg(*[F.count_if(F.col("bin") == k).alias(f"bin_{k + 1}") for k in range(bins)])


def degree_density(nodes: DataFrame, edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """Per degree the number of nodes and their mean density."""
    d = G.all_degrees(nodes, edges, keys)
    return d.groupBy(*keys, "d").agg(F.count("*").alias("nodes"), F.avg(A.density(F.col("psi_re"), F.col("psi_im"))).alias("mean_rho"))


def triangle_counts(edges: DataFrame, frames: DataFrame, keys: Keys) -> DataFrame:
    """Triangles per graph; 0 for graphs of ``frames`` that have none."""
    n = G.triangles(edges.select(*keys, "src", "dst"), keys).groupBy(*keys).agg(F.count("*").alias("triangles"))
    return frames.select(*keys).distinct().join(n, list(keys), "left").withColumn("triangles", F.coalesce("triangles", F.lit(0).cast("long")))


def snapshot_metrics(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """Degree statistics, five-bin histogram and triangles of every graph."""
    d = G.all_degrees(nodes.select(*keys, "node_id"), edges, keys)
    stats = degree_stats(nodes, edges, keys)
    return stats.join(histogram5(d, keys), list(keys)).join(triangle_counts(edges, stats, keys), list(keys))


# -- energies -------------------------------------------------------------------------------------


def edge_energies(nodes: DataFrame, edges: DataFrame, p: dict[str, float], keys: Keys = (), node_keys: Keys | None = None) -> DataFrame:
    """``hop``, ``stress`` and ``bias`` of each edge; ``node_keys``: the keys that nodes have, if not all."""
    x = G.endpoints(nodes, edges, keys if node_keys is None else node_keys)
    c = F.col
    rho_i, rho_j = A.density(c("psi_re_i"), c("psi_im_i")), A.density(c("psi_re_j"), c("psi_im_j"))
    return x.select(
        *keys, "src", "dst", A.hop_energy(c("psi_re_i"), c("psi_im_i"), c("psi_re_j"), c("psi_im_j"), c("theta"), p).alias("hop"),
        A.stress_energy(rho_i, rho_j, p).alias("stress"), F.lit(p["lam_e"]).alias("bias"),
    )


def node_energies(nodes: DataFrame, p: dict[str, float], keys: Keys = ()) -> DataFrame:
    rho = A.density(F.col("psi_re"), F.col("psi_im"))
    return nodes.select(*keys, "node_id", rho.alias("rho"), A.self_energy(rho, p).alias("self_energy"))


def triangle_energies(edges: DataFrame, p: dict[str, float], keys: Keys = ()) -> DataFrame:
    return G.triangles(edges, keys).select(*keys, "a", "b", "c", A.triangle_energy(F.col("t_ab"), F.col("t_bc"), F.col("t_ac"), p).alias("energy"))


def total_action(nodes: DataFrame, edges: DataFrame, p: dict[str, float], keys: Keys) -> DataFrame:
    """Self, edge, triangle and degree parts of the action, and their sum."""
    keys = list(keys)
    selfs = node_energies(nodes, p, keys).groupBy(*keys).agg(F.sum("self_energy").alias("self_part"))
    edge = edge_energies(nodes, edges, p, keys).groupBy(*keys).agg(F.sum(F.col("hop") + F.col("stress") + F.col("bias")).alias("edge_part"))
    tri = triangle_energies(edges, p, keys).groupBy(*keys).agg(F.sum("energy").alias("triangle_part"))
    deg = G.degrees(edges, keys).groupBy(*keys).agg(F.sum(A.degree_energy(F.col("d"), p)).alias("degree_part"))
    out = selfs.join(edge, keys, "left").join(tri, keys, "left").join(deg, keys, "left").na.fill(0.0)
    return out.withColumn("action", F.col("self_part") + F.col("edge_part") + F.col("triangle_part") + F.col("degree_part"))


def local_psi_energy(nodes: DataFrame, edges: DataFrame, p: dict[str, float], keys: Keys = ()) -> DataFrame:
    """A node's self energy and the hop and stress energies of its edges."""
    own = edge_energies(nodes, edges, p, keys).select(*keys, F.explode(F.array("src", "dst")).alias("node_id"), (F.col("hop") + F.col("stress")).alias("x"))
    summed = own.groupBy(*keys, "node_id").agg(F.sum("x").alias("x"))
    return node_energies(nodes, p, keys).join(summed, [*keys, "node_id"], "left").select(*keys, "node_id", (F.col("self_energy") + F.coalesce("x", F.lit(0.0))).alias("local_energy"))


def local_theta_energy(nodes: DataFrame, edges: DataFrame, p: dict[str, float], keys: Keys = ()) -> DataFrame:
    """An edge's hop energy and that of the triangles on it."""
    tri = triangle_energies(edges, p, keys).select(*keys, F.explode(F.array(*[F.struct(F.col(i).alias("src"), F.col(j).alias("dst")) for i, j in ("ab", "bc", "ac")])).alias("e"), "energy")
    summed = tri.select(*keys, "e.src", "e.dst", "energy").groupBy(*keys, "src", "dst").agg(F.sum("energy").alias("x"))
    return edge_energies(nodes, edges, p, keys).join(summed, [*keys, "src", "dst"], "left").select(*keys, "src", "dst", (F.col("hop") + F.coalesce("x", F.lit(0.0))).alias("local_energy"))


def local_toggle_energy(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, p: dict[str, float], keys: Keys = ()) -> DataFrame:
    """``[keys], src, dst, local_energy`` of pairs: degree energies of both ends, the bias of all edges, and if the pair is an edge its own energies and those of its triangles."""
    keys = list(keys)
    d = G.degrees(edges, keys)
    at = lambda end, name: d.select(*keys, F.col("node_id").alias(end), F.col("d").alias(name))
    x = pairs.select(*keys, "src", "dst").join(at("src", "d_i"), [*keys, "src"], "left").join(at("dst", "d_j"), [*keys, "dst"], "left").na.fill(0, ["d_i", "d_j"])
    own = edge_energies(nodes, edges, p, keys).select(*keys, "src", "dst", (F.col("hop") + F.col("stress")).alias("own"))
    tri = triangle_energies(edges, p, keys).select(*keys, F.explode(F.array(*[F.struct(F.col(i).alias("src"), F.col(j).alias("dst")) for i, j in ("ab", "bc", "ac")])).alias("e"), "energy")
    tri = tri.select(*keys, "e.src", "e.dst", "energy").groupBy(*keys, "src", "dst").agg(F.sum("energy").alias("tri"))
    x = x.join(own, [*keys, "src", "dst"], "left").join(tri, [*keys, "src", "dst"], "left")
    count = grouped(edges, keys).agg(F.count("*").alias("n_edges"))
    x = x.join(F.broadcast(count), keys, "left") if keys else x.crossJoin(F.broadcast(count))  # a row per graph
    present = F.when(F.col("own").isNotNull(), F.col("own") + F.coalesce("tri", F.lit(0.0))).otherwise(0.0)
    energy = p["mu_deg2"] * (F.col("d_i") * F.col("d_i") + F.col("d_j") * F.col("d_j")) + p["lam_e"] * F.coalesce("n_edges", F.lit(0)) + present
    return x.select(*keys, "src", "dst", energy.alias("local_energy"))


def _toggled(nodes: DataFrame, edges: DataFrame, p: dict[str, float], keys: Keys) -> DataFrame:
    """Pairs of nodes with a common neighbour: ``exists``, both ends' degrees, the numbers of nodes and edges, and the energies ``own`` of an edge and ``tri`` of the triangles on it (theta 0 if new)."""
    c = F.col
    ends = nodes.select(*keys, "node_id", "psi_re", "psi_im").join(G.degrees(edges, keys), [*keys, "node_id"])
    x = B.common_pairs(ends, edges.select(*keys, "src", "dst", "theta"), keys)
    hop = A.hop_energy(c("psi_re_i"), c("psi_im_i"), c("psi_re_j"), c("psi_im_j"), c("theta"), p)
    stress = A.stress_energy(A.density(c("psi_re_i"), c("psi_im_i")), A.density(c("psi_re_j"), c("psi_im_j")), p)
    count = grouped(edges, keys).agg(F.count("*").alias("n_edges"))
    sizes = grouped(nodes, keys).agg(F.count("*").alias("n_nodes"))
    small = F.broadcast(count.join(sizes, keys) if keys else count.crossJoin(sizes))  # a row a graph
    x = x.join(small, keys) if keys else x.crossJoin(small)
    return x.select(*keys, "src", "dst", "centres", "exists", "d_i", "d_j", "n_nodes", "n_edges", (hop + stress).alias("own"), (p["beta"] * c("loops")).alias("tri"))


def toggle_energies(nodes: DataFrame, edges: DataFrame, p: dict[str, float], keys: Keys = ()) -> DataFrame:
    """``local_toggle_energy`` of every pair of nodes with a common neighbour."""
    c = F.col
    energy = p["mu_deg2"] * (c("d_i") * c("d_i") + c("d_j") * c("d_j")) + p["lam_e"] * c("n_edges") + F.when(c("exists"), c("own") + c("tri")).otherwise(0.0)
    return _toggled(nodes, edges, p, list(keys)).select(*keys, "src", "dst", energy.alias("local_energy"))


def toggle_candidates(nodes: DataFrame, edges: DataFrame, p: dict[str, float], keys: Keys = ()) -> DataFrame:
    """For every pair with a common neighbour: whether an edge exists, dE of toggling it (theta 0 if new), proposal ratio and acceptance.

    Removing an edge also removes, and adding one also adds, the triangles on it.
    """
    c = F.col
    x = _toggled(nodes, edges, p, list(keys)).withColumn("delta", A.toggle_delta(c("exists"), c("own") + c("tri"), c("d_i"), c("d_j"), p))
    x = x.withColumn("log_q", A.proposal_log_ratio(c("exists"), c("n_edges"), A.pair_count(c("n_nodes"))))
    return x.select(*keys, "src", "dst", "centres", "exists", "delta", "log_q", A.accept_probability(c("delta"), p["temp"], c("log_q")).alias("acceptance"))


# -- fits -------------------------------------------------------------------------------------------


def linear_fit(y: Column, x: Column) -> tuple[Column, Column]:
    return F.regr_slope(y, x), F.regr_intercept(y, x)


def power_law(y: Column, x: Column) -> tuple[Column, Column, Column]:
    """Exponent, factor and number of points of y = factor * x ** exponent; nulls below two sizes."""
    ok = (x > 0) & (y > 0)
    ly, lx = F.when(ok, F.ln(y)), F.when(ok, F.ln(x))
    return F.regr_slope(ly, lx), F.exp(F.regr_intercept(ly, lx)), F.regr_count(ly, lx)


def pearson(y: Column, x: Column) -> Column:
    """Null below 3 points; 0 where either is constant."""
    n = F.regr_count(y, x)
    # Sums of squares decide what is constant: a correlation of constants is undefined.
    flat = (F.coalesce(F.regr_sxx(y, x), F.lit(0.0)) <= 1e-24) | (F.coalesce(F.regr_syy(y, x), F.lit(0.0)) <= 1e-24)
    safe = F.regr_sxy(y, x) / F.sqrt(F.when(flat, F.lit(1.0)).otherwise(F.regr_sxx(y, x) * F.regr_syy(y, x)))
    return F.when(n >= 3, F.when(flat, F.lit(0.0)).otherwise(safe))


def spectral_fit(returns: DataFrame, keys: Keys = ()) -> DataFrame:
    """-2 times the slope of ln P against ln t for 0.5 < t < 5."""
    inside = returns.where("t > 0.5 AND t < 5 AND p > 0")
    return grouped(inside, keys).agg((-2 * F.regr_slope(F.ln("p"), F.ln("t"))).alias("spectral_dim"))


def hausdorff(edges: DataFrame, sources: DataFrame, keys: Keys = (), low: int = 2, high: int = 7, min_points: int = 5, fallback: bool = True) -> DataFrame:
    """Growth dimension: slope of ln N(r) against ln r pooled over sources, N counting nodes within r hops, the source included.

    Sources of eccentricity below 2 are left out. Below ``min_points`` points in all: 0. Below 3 with ``low``..``high`` hops: a fit over
    all r if ``fallback``, else 0.
    """
    shells = L.shells(edges, sources, None, keys).withColumnRenamed("nodes", "n")
    w = Window.partitionBy(*keys, "source").orderBy("d")
    points = shells.withColumn("total", F.sum("n").over(w)).withColumn("ecc", F.max("d").over(Window.partitionBy(*keys, "source"))).where("d >= 1 AND ecc >= 2")
    ln_r, ln_n = F.ln("d"), F.ln("total")
    masked = F.col("d").between(low, high)
    fit = grouped(points, keys).agg(
        F.count("*").alias("points"), F.count_if(masked).alias("masked"),
        F.regr_slope(F.when(masked, ln_n), F.when(masked, ln_r)).alias("inner"), F.regr_slope(ln_n, ln_r).alias("outer"),
    )
    value = F.when(F.col("points") < min_points, 0.0).when(F.col("masked") >= 3, F.coalesce("inner", F.lit(0.0))).otherwise(F.coalesce("outer", F.lit(0.0)) if fallback else F.lit(0.0))
    return fit.select(*keys, "points", value.alias("hausdorff"))
