"""Graph, metric and energy operators on closed forms and by invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweft.functions import amplitude as A
from netweft.operators import curvature as C
from netweft.operators import geometry as E
from netweft.operators import graph as G
from netweft.operators import landmarks as L
from netweft.operators import metrics as M
from netweft.operators import observables as O
from netweft.sources.schema import PARAMS as P
from netweft.sources.schema import params


def shapes():
    """Closed-form graphs by key: edges."""
    n = 6
    return {
        0: [(i, i + 1) for i in range(n - 1)],  # path
        1: [(i, i + 1) for i in range(n - 1)] + [(0, n - 1)],  # cycle
        2: [(0, i) for i in range(1, n)],  # star
        3: [(i, j) for i in range(n) for j in range(i + 1, n)],  # complete
        4: [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)],  # two triangles
    }


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    rows = [(k, i, j, float(rng.uniform(-3, 3))) for k, es in shapes().items() for i, j in es]
    nodes = [(k, i, float(rng.normal()), float(rng.normal())) for k in range(6) for i in range(6)]  # graph 5 is empty
    return spark.createDataFrame(nodes, "g int, node_id long, psi_re double, psi_im double"), spark.createDataFrame(rows, "g int, src long, dst long, theta double")


def rows(df, key="g"):
    return {r[key]: r for r in df.collect()}


def test_degree_statistics(series):
    got = rows(M.degree_stats(*series, ["g"]))
    assert {k: (r["edges"], r["min_degree"], r["max_degree"]) for k, r in got.items()} == {0: (5, 1, 2), 1: (6, 2, 2), 2: (5, 1, 5), 3: (15, 5, 5), 4: (6, 2, 2), 5: (0, 0, 0)}
    for r in got.values():
        assert r["mean_degree"] == pytest.approx(2 * r["edges"] / r["n_nodes"])  # handshake


def test_histogram_sums_to_the_nodes(series):
    v, e = series
    got = rows(M.histogram5(G.all_degrees(v, e, ["g"]), ["g"]))
    assert all(sum(r[f"bin_{k}"] for k in range(1, 6)) == 6 for r in got.values())
    assert [got[2][f"bin_{k}"] for k in range(1, 6)] == [5, 0, 0, 0, 1] and got[3]["bin_1"] == 6


def test_triangles(series):
    v, e = series
    got = rows(M.triangle_counts(e, v, ["g"]))
    assert {k: r["triangles"] for k, r in got.items()} == {0: 0, 1: 0, 2: 0, 3: 20, 4: 2, 5: 0}
    per_node = G.node_triangles(e, ["g"]).groupBy("g").agg(F.sum("triangles").alias("t")).collect()
    assert {r["g"]: r["t"] for r in per_node} == {3: 60, 4: 6}


def test_bfs_components_khop(spark, series):
    v, e = series
    comp = G.components(v.select("g", "node_id"), e, ["g"])
    assert {r["g"]: r["n"] for r in comp.groupBy("g").agg(F.countDistinct("component").alias("n")).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 6}
    assert {r["node_id"] for r in G.largest_component(comp, ["g"]).where("g = 4").collect()} == {0, 1, 2}
    dist = G.bfs(e, v.where("node_id = 0").select("g", "node_id"), None, ["g"])
    assert {r["node_id"]: r["d"] for r in dist.where("g = 0").collect()} == {k: k for k in range(6)}
    assert {r["node_id"]: r["d"] for r in dist.where("g = 1").collect()} == {k: min(k, 6 - k) for k in range(6)}
    near = G.khop(e.where("g = 0"), spark.createDataFrame([(2,)], "node_id long"), 2)
    assert {r["node_id"]: r["d"] for r in near.collect()} == {0: 2, 1: 1, 2: 0, 3: 1, 4: 2}
    assert [r["node_id"] for r in G.bfs_cluster(e.where("g = 0").drop("g"), 0, 3).collect()] == [0, 1, 2]


def test_local_distances_are_hops(series):
    _, e = series
    e = e.where("g = 1").drop("g")
    got = {(r["x"], r["y"]): r["cost"] for r in G.local_distances(e).collect()}
    assert all(c == min(abs(x - y), 6 - abs(x - y)) for (x, y), c in got.items())


def test_total_action_by_hand(series):
    v, e = series
    got = rows(M.total_action(v, e, P, ["g"]))
    psi = {(r["g"], r["node_id"]): complex(r["psi_re"], r["psi_im"]) for r in v.collect()}
    theta = {(r["g"], r["src"], r["dst"]): r["theta"] for r in e.collect()}
    for g, es in {**shapes(), 5: []}.items():
        s = 0.0
        for i in range(6):
            rho = abs(psi[g, i]) ** 2
            s += P["mass2"] * rho + P["lam_psi"] * rho**2 + P["lam_pauli"] * math.exp(rho / P["rho0"])
            s += P["mu_deg2"] * sum(i in x for x in es) ** 2
        for i, j in es:
            u = np.exp(1j * theta[g, i, j])
            s += -P["kappa"] * (psi[g, i].conjugate() * u * psi[g, j]).real + P["lam_g"] * (abs(psi[g, i]) ** 2 + abs(psi[g, j]) ** 2) + P["lam_e"]
        for i, j in es:
            for k in range(j + 1, 6):
                if (j, k) in es and (i, k) in es:
                    s += P["beta"] * (1 - math.cos(theta[g, i, j] + theta[g, j, k] - theta[g, i, k]))
        assert got[g]["action"] == pytest.approx(s)


def test_toggle_delta_is_the_change_of_the_action(spark, series):
    v, e = series
    v, e = v.where("g = 3").drop("g").withColumn("k", F.lit(0)), e.where("g = 3").drop("g").withColumn("k", F.lit(0))
    delta = {(r["src"], r["dst"]): r["delta"] for r in M.toggle_candidates(v, e, P, ["k"]).collect()}
    before = M.total_action(v, e, P, ["k"]).first()["action"]
    after = M.total_action(v, e.where("NOT (src = 1 AND dst = 4)"), P, ["k"]).first()["action"]
    assert delta[1, 4] == pytest.approx(after - before)


def test_gauge_invariance(series):
    for r in O.gauge_check(*series, ["g"]).collect():
        assert r["pair_error"] < 1e-9 and (r["loop_error"] or 0) < 1e-9


def test_curvatures(spark, series):
    _, e = series
    kappa = {}
    for r in C.ollivier(e, ["g"]).collect():
        kappa.setdefault(r["g"], set()).add(round(r["kappa"], 9))
    assert kappa[3] == {round(6 / 10, 9)} and kappa[1] == {0.0} and kappa[2] == {round(1 / 5, 9)} and kappa[4] == {0.75}
    forman = {r["g"]: r["f"] for r in O.forman_edges(e, ["g"]).groupBy("g").agg(F.avg("forman").alias("f")).collect()}
    assert forman[1] == 0 and forman[3] == -6
    v = series[0].select("g", "node_id")
    assert O.node_curvature(v, O.forman_edges(e, ["g"]), "forman", ["g"]).where("g = 5").agg(F.max("curvature")).first()[0] == 0.0


def test_spectra_and_embeddings(spark, series):
    _, e = series
    got = [r["eigenvalue"] for r in E.laplacian_spectrum(e.where("g = 1"), ["g"]).orderBy("k").collect()]
    assert got == pytest.approx(sorted(2 - 2 * math.cos(2 * math.pi * k / 6) for k in range(6)), abs=1e-9)
    side = 9
    grid = [(i * side + j, i * side + j + 1) for i in range(side) for j in range(side - 1)] + [(i * side + j, (i + 1) * side + j) for i in range(side - 1) for j in range(side)]
    g = spark.createDataFrame(grid, "src long, dst long")
    x = L.lmds_embedding(g, k=40).collect()
    assert len(x) == 81 and x[0]["explained"] > 0.7
    turn = np.array([[0.0, -1.0], [1.0, 0.0]])
    frames = [(0, s, r["node_id"], [float(c) for c in (np.array(r["x"]) @ turn if s else np.array(r["x"]))]) for s in (0, 1) for r in x]
    aligned = E.align(spark.createDataFrame(frames, "run int, step int, node_id long, x array<double>"), ["run"], inertia=0.0).collect()
    at = {(r["step"], r["node_id"]): np.array(r["x"]) for r in aligned}
    assert max(np.abs(at[0, k] - at[1, k]).max() for k in range(81)) < 1e-6
    assert E.spectral_layout(g).count() == 81 and E.spring_layout(g, iterations=5).count() == 81


def test_hausdorff_of_a_grid_tends_to_two(spark):
    side = 15
    grid = [(i * side + j, i * side + j + 1) for i in range(side) for j in range(side - 1)] + [(i * side + j, (i + 1) * side + j) for i in range(side - 1) for j in range(side)]
    e = spark.createDataFrame(grid, "src long, dst long")
    d = M.hausdorff(e, spark.createDataFrame([(side * 7 + 7,)], "node_id long")).first()["hausdorff"]
    assert 1.6 < d < 2.1


def test_paths_and_correlators(spark, series):
    v, e = series
    v, e = v.where("g = 1").drop("g"), e.where("g = 1").drop("g")
    source = spark.createDataFrame([(0,)], "node_id long")
    paths = {r["node_id"]: (r["d"], r["phase"]) for r in G.shortest_path_phases(e, source, 5).collect()}
    theta = {(r["src"], r["dst"]): r["theta"] for r in e.collect()}
    assert paths[2] == (2, pytest.approx(theta[0, 1] + theta[1, 2])) and paths[5] == (1, pytest.approx(theta[0, 5]))
    assert paths[3][1] == pytest.approx(theta[0, 1] + theta[1, 2] + theta[2, 3])  # smaller predecessor
    two = G.simple_paths(e, source, spark.createDataFrame([(2,)], "node_id long"), 2, 5).orderBy("rank").collect()
    assert [r["d"] for r in two] == [2, 4]
    assert O.correlator(v, e, source, 3, min_shell=1).count() == 3


def test_small_functions(spark):
    df = spark.createDataFrame([(-4.0,), (3.5,), (10.0,)], "t double")
    assert [r[0] for r in df.select(A.wrap(F.col("t"))).collect()] == pytest.approx([(t + math.pi) % (2 * math.pi) - math.pi for t in (-4.0, 3.5, 10.0)])
    with pytest.raises(KeyError):
        params(nothing=1.0)
    from netweft.functions.text import register

    register(spark)
    assert spark.sql("SELECT forman(2, 3), quantised(1.7999D)").first() == (-1, 1799)


def test_transport_cost_matches_enumeration():
    from itertools import permutations

    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(1, 6))
        c = rng.integers(0, 4, (n, n))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        ones = np.ones((1, n), np.int64)
        assert C.transport(ones, ones, c[None]).tolist() == [best]
