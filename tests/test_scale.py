"""Operators that hold no graph, series or file in a row, against dense and brute-force versions."""

import gzip
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweft.functions import text as T
from netweft.operators import curvature as C
from netweft.operators import densify as D
from netweft.operators import geometry as E
from netweft.operators import graph as G
from netweft.operators import growth as W
from netweft.operators import landmarks as L
from netweft.operators import metrics as M
from netweft.operators import observables as O
from netweft.operators import paths as K
from netweft.operators import spectra as S
from netweft.sources import snapshots as R
from netweft.sources.schema import PARAMS as P


def random_edges(n, m, seed):
    rng = np.random.default_rng(seed)
    return sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (m, 2)) if a != b})


def frame(spark, edges, schema="src long, dst long"):
    return spark.createDataFrame(edges, schema).repartition(3)


def dense(nodes, edges):
    at = {v: k for k, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        m[at[a], at[b]] = m[at[b], at[a]] = -1
    return m - np.diag(m.sum(1))


def hops(nodes, edges):
    d = np.full((len(nodes), len(nodes)), np.inf)
    at = {v: k for k, v in enumerate(nodes)}
    np.fill_diagonal(d, 0)
    for a, b in edges:
        d[at[a], at[b]] = d[at[b], at[a]] = 1
    for k in range(len(nodes)):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    return d


# -- spectra ------------------------------------------------------------------------------------------


def test_heat_trace_is_near_the_dense_one(spark):
    one, two = random_edges(400, 1600, 1), [(a + 1000, b + 1000) for a, b in random_edges(150, 300, 2)]  # the second has several components
    edges = frame(spark, [(0, a, b) for a, b in one + two] + [(1, a, b) for a, b in two], "g int, src long, dst long")
    times = T.logspace(spark, -1.0, 2.0, 16)
    got = {}
    for r in S.return_probability(edges, times, ["g"], steps=10).collect():
        got.setdefault(r["g"], []).append((r["t"], r["p"], r["error"]))
    for g, es in ((0, one + two), (1, two)):
        nodes = sorted({v for e in es for v in e})
        values = np.linalg.eigvalsh(dense(nodes, es))
        assert len(got[g]) == 16
        for t, p, error in got[g]:
            want = np.exp(-values * t).mean()
            assert abs(p - want) <= max(0.02 * want, 4 * error) and error < 0.06 * want
    returns = spark.createDataFrame([(g, t, p) for g, rows in got.items() for t, p, _ in rows], "g int, t double, p double")
    exact = spark.createDataFrame([(g, t, float(np.exp(-np.linalg.eigvalsh(dense(sorted({v for e in es for v in e}), es)) * t).mean())) for g, es in ((0, one + two), (1, two)) for t, _, _ in got[g]], "g int, t double, p double")
    dimension = {r["g"]: r["spectral_dim"] for r in M.spectral_fit(returns, ["g"]).collect()}
    for r in M.spectral_fit(exact, ["g"]).collect():
        assert dimension[r["g"]] == pytest.approx(r["spectral_dim"], rel=0.06, abs=0.03)


def test_spectrum_beyond_the_dense_limit(spark):
    n = 4096  # a ring, whose eigenvalues are 2 - 2 cos
    ring = spark.range(n).select(F.least("id", (F.col("id") + 1) % n).alias("src"), F.greatest("id", (F.col("id") + 1) % n).alias("dst"))
    values = 2 - 2 * np.cos(2 * np.pi * np.arange(n) / n)
    assert n > E.DENSE
    times = spark.createDataFrame([(0.5,), (2.0,), (5.0,)], "t double")
    for r in S.return_probability(ring, times, probes=12, steps=12).collect():
        want = np.exp(-values * r["t"]).mean()
        assert abs(r["p"] - want) <= max(0.02 * want, 4 * r["error"])
    share = {r["level"]: r["share"] for r in S.eigenvalue_share(ring, spark.createDataFrame([(1.0,), (4.1,)], "level double"), probes=8, steps=10).collect()}
    assert share[4.1] == pytest.approx(1.0) and abs(share[1.0] - (values <= 1).mean()) < 0.08


def test_trivial_spectra(spark):
    times = spark.createDataFrame([(1.0,)], "t double")
    edges = frame(spark, [(0, 1)])
    nodes = spark.createDataFrame([(0,), (1,), (7,)], "node_id long")  # an edge and an isolated node: 0, 0 and 2
    r = S.return_probability(edges, times, nodes=nodes, probes=12, steps=2).first()
    assert r["p"] == pytest.approx((2 + math.exp(-2)) / 3) and r["error"] < 1e-9


# -- landmarks ----------------------------------------------------------------------------------------


def test_bit_sets_give_all_distances(spark):
    es = random_edges(120, 160, 3)
    nodes = sorted({v for e in es for v in e})
    edges = frame(spark, es)
    marks = L.pick(G.graph_nodes(edges), 70)
    assert marks.count() == 70
    at = {r["node_id"]: r["place"] for r in marks.collect()}
    assert sorted(at, key=lambda v: ((v * 7919) % 1000003, v)) == sorted(nodes, key=lambda v: ((v * 7919) % 1000003, v))[:70] and [v for v, _ in sorted(at.items(), key=lambda x: x[1])] == sorted(at)
    d = hops(nodes, es)
    seen = set()
    for r in L.distances(edges, marks, 70).collect():
        want = [d[nodes.index(r["node_id"]), nodes.index(v)] for v in sorted(at)]
        assert [math.inf if h is None else h for h in r["hops"]] == want
        seen.add(r["node_id"])
    assert seen == {v for k, v in enumerate(nodes) if np.isfinite(d[k, [nodes.index(x) for x in at]]).any()}


def dense_places(nodes, es, k, dimensions):
    """The embedding from all distances at once."""
    d = hops(nodes, es)
    at = sorted(sorted(range(len(nodes)), key=lambda i: ((nodes[i] * 7919) % 1000003, nodes[i]))[:k])
    d = d[at]
    d = np.where(np.isfinite(d), d, 1.5 * d[np.isfinite(d)].max())
    own = d[:, at] ** 2
    j = np.eye(len(at)) - 1 / len(at)
    values, vectors = np.linalg.eigh(-0.5 * j @ own @ j)
    values, vectors = values[::-1], vectors[:, ::-1]
    scaled = vectors[:, :dimensions] * np.sqrt(np.maximum(values[:dimensions], 1e-9))
    return (-0.5 * np.linalg.pinv(scaled) @ (d**2 - own.mean(1)[:, None])).T, values


def test_landmark_scaling_equals_the_dense_one(spark):
    one, two = random_edges(90, 200, 4), random_edges(40, 50, 5)
    edges = frame(spark, [(0, a, b) for a, b in one] + [(1, a, b) for a, b in two] + [(2, 0, 1)], "g int, src long, dst long")
    got = {}
    for r in L.lmds_embedding(edges, ["g"], k=30).collect():
        got.setdefault(r["g"], {})[r["node_id"]] = (r["x"], r["explained"])
    spectrum = {}
    for r in L.lmds_spectrum(edges, ["g"], k=30).collect():
        spectrum.setdefault(r["g"], {})[r["k"]] = r["eigenvalue"]
    for g, es in ((0, one), (1, two)):
        nodes = sorted({v for e in es for v in e})
        want, values = dense_places(nodes, es, 30, 2)
        x = np.array([got[g][v][0] for v in nodes])
        for c in range(2):
            assert min(np.abs(x[:, c] - want[:, c]).max(), np.abs(x[:, c] + want[:, c]).max()) < 1e-8
        positive = values[values > 1e-12]
        assert got[g][nodes[0]][1] == pytest.approx(positive[:2].sum() / positive.sum())
        assert len(spectrum[g]) == min(30, len(nodes)) and spectrum[g][0] >= spectrum[g][1]
    assert [got[2][v][0] for v in (0, 1)] == [[0.0, 0.0]] * 2  # no more landmarks than dimensions


# -- alignment ----------------------------------------------------------------------------------------


def aligned_one_by_one(frames, inertia, least):
    def proper(m):
        u, _, v = np.linalg.svd(m)
        return u @ np.diag([1, np.sign(np.linalg.det(u @ v))]) @ v

    out, before, turn = {}, None, None
    for step, points in sorted(frames.items()):
        nodes = sorted(points)
        x = np.array([points[v] for v in nodes])
        x = x - x.mean(0)
        if before is not None:
            shared = [v for v in nodes if v in before]
            if len(shared) >= least:
                a, b = x[[nodes.index(v) for v in shared]], np.array([before[v] for v in shared])
                new = proper((a - a.mean(0)).T @ (b - b.mean(0)))
                turn = new if turn is None else proper(inertia * turn + (1 - inertia) * new)
                x = x @ turn
        before = dict(zip(nodes, x, strict=True))
        out[step] = before
    return out


def test_alignment_equals_frame_by_frame(spark):
    rng = np.random.default_rng(6)
    base = {v: rng.normal(size=2) * [3, 1] for v in range(60)}
    series = {}
    for run in range(2):
        for step in range(6):
            a = rng.uniform(0, 6)
            turn = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
            some = [v for v in base if step != 3 or v < 10][: 60 - 3 * step if step != 4 else 60]  # step 3 shares too few
            series.setdefault(run, {})[10 * step] = {v: base[v] @ turn + rng.normal(size=2) * 0.2 + [step, run] for v in some}
    rows = [(r, s, v, [float(c) for c in x]) for r, fs in series.items() for s, ps in fs.items() for v, x in ps.items()]
    got = E.align(spark.createDataFrame(rows, "run int, step int, node_id long, x array<double>").repartition(3), ["run"]).collect()
    want = {r: aligned_one_by_one(fs, 0.8, 20) for r, fs in series.items()}
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose(r["x"], want[r["run"]][r["step"]][r["node_id"]], atol=1e-9)
    assert {(r["step"], r["shared"]) for r in got if r["run"] == 0} >= {(0, 0), (10, 57), (30, 10)}


# -- paths --------------------------------------------------------------------------------------------


def test_k_shortest_paths_equal_enumeration(spark):
    es = random_edges(30, 55, 7)
    theta = {e: round(0.01 * k - 0.3, 6) for k, e in enumerate(es)}
    near = {}
    for (a, b), t in theta.items():
        near.setdefault(a, []).append((b, t))
        near.setdefault(b, []).append((a, -t))
    sources, targets, k, depth = [0, 1, 2, 3, 4], [1, 7, 9, 20, 21, 29], 4, 5
    want = set()
    for s in sources:
        found, walks = {}, [([s], 0.0)] if s in near else []
        for _ in range(depth):
            walks = [([*p, y], f + t) for p, f in walks for y, t in near[p[-1]] if y not in p]
            for p, f in walks:
                found.setdefault(p[-1], []).append((len(p) - 1, p, f))
        for t in targets:
            for rank, (d, _, f) in enumerate(sorted(found.get(t, []))[:k], 1):
                want.add((s, t, rank, d, round(f, 6)))
    edges = frame(spark, [(a, b, t) for (a, b), t in theta.items()], "src long, dst long, theta double")
    ids = lambda x: spark.createDataFrame([(v,) for v in x], "node_id long")
    got = {(r["source"], r["node_id"], r["rank"], r["d"], round(r["phase"], 6)) for r in K.k_shortest(edges, ids(sources), ids(targets), k, depth).collect()}
    assert got == want and len(want) > 60
    assert K.k_shortest(edges, ids([99]), ids(targets), k, depth).count() == 0


def test_a_pair_keeps_as_many_partial_paths_as_it_needs(spark):
    from netweft import session

    es = random_edges(60, 700, 5)
    near = {}
    for a, b in es:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    edges = frame(spark, [(a, b, 0.01 * a - 0.02 * b) for a, b in es], "src long, dst long, theta double")
    ids = lambda x: spark.createDataFrame([(v,) for v in x], "node_id long")
    sources, targets, k = [0, 1, 2, 3], [1, 7, 9, 20], 3
    before = len(session.stored)
    got = {(r["source"], r["node_id"], r["rank"], r["d"]) for r in K.k_shortest(edges, ids(sources), ids(targets), k, 6).collect()}
    tables = [spark.read.parquet(t) for t in session.stored[before:]]
    assert max(t.count() for t in tables if "path" in t.columns) <= len(sources) * len(targets) * k
    want = set()
    for s in sources:
        for t in targets:
            if s != t:
                paths = [[s, t]] * (t in near[s]) + [[s, x, t] for x in near[s] if t in near[x]] + [[s, x, y, t] for x in near[s] if x != t for y in near[x] if y != s and t in near[y] and y != t]
                want |= {(s, t, rank, len(p) - 1) for rank, p in enumerate(sorted(paths, key=lambda p: (len(p), p))[:k], 1)}
    assert got == want


# -- bisection order ----------------------------------------------------------------------------------


def bisection(n):
    """Indices first, last, then midpoints level by level."""
    order = [0, n - 1] if n > 1 else [0]
    level = [(0, n - 1)]
    while level:
        order += [(a + b) // 2 for a, b in level if b - a > 1]
        level = [x for a, b in level if b - a > 1 for x in ((a, (a + b) // 2), ((a + b) // 2, b))]
    return order


def test_places_of_any_series(spark):
    rows = [(n, 10 * k + 3) for n in [*range(1, 70), 127, 128, 129, 1000] for k in range(n)]
    got = {}
    for r in D.frame_order(spark.createDataFrame(rows, "run long, step long").repartition(4), ["run"]).collect():
        assert r["step"] == 10 * r["index"] + 3
        got.setdefault(r["run"], {})[r["place"]] = r["index"]
    for n, places in got.items():
        assert [places[p] for p in range(n)] == bisection(n)


# -- growth -------------------------------------------------------------------------------------------


def test_growth_equals_every_step_alone(spark):
    rng = np.random.default_rng(8)
    steps = (0, 3, 4, 9)
    es = [(a, b, int(rng.integers(-1, 12)), float(rng.uniform(-3, 3))) for a, b in random_edges(40, 260, 9)]
    edges = spark.createDataFrame(es, "src long, dst long, birth int, theta double").repartition(3)
    nodes = spark.createDataFrame([(v, float(rng.normal()), float(rng.normal())) for v in range(42)], "node_id long, psi_re double, psi_im double")
    grown = W.born(edges, steps)
    at = spark.createDataFrame([(s,) for s in steps], "step int")
    every_v = nodes.crossJoin(at)
    every_e = edges.join(at, edges["birth"] <= at["step"]).select("step", "src", "dst", "theta")
    keys = ["step"]
    same = lambda a, b, *order: [pytest.approx(tuple(x)) for x in a.select(*b.columns).orderBy(*order).collect()] == [tuple(x) for x in b.orderBy(*order).collect()]
    assert same(W.triangle_counts(grown, at, steps), M.triangle_counts(every_e, at, keys), "step")
    assert same(W.node_triangles(grown, steps), G.node_triangles(every_e, keys), "step", "node_id")
    assert same(W.snapshot_metrics(every_v, grown, steps), M.snapshot_metrics(every_v, every_e, keys), "step")
    assert same(W.total_action(nodes, grown, P, steps), M.total_action(every_v, every_e, P, keys), "step")
    assert same(W.edge_loop_energy(nodes, grown, P, steps), M.local_theta_energy(every_v, every_e, P, keys), "step", "src", "dst")
    assert same(W.at_steps(W.triangles(grown), steps), G.triangles(every_e, keys), "step", "a", "b", "c")
    loops = O.wilson_loops(every_e, keys).groupBy("step").agg(F.count("*").alias("loops"), F.avg("loop").alias("mean_loop"))
    assert same(W.mean_loops(grown, steps), loops, "step")


# -- files --------------------------------------------------------------------------------------------


def test_faulty_files_are_told_and_passed_over(spark, tmp_path):
    data = tmp_path / "E3" / "N100" / "S7" / "data"
    data.mkdir(parents=True)
    name = lambda step, end="csv": data / f"E3_N100_S7_iter_000_000_{step:03d}_edges.{end}"
    name(0).write_text("source,target,theta\n1,2,0.5\n3,2,0.25\n")
    name(1).write_text("source,target,theta\n1,2,0.5\nx,y,z\n4,5\n6,7,0.1,9\n")
    name(2).write_text("source,target,theta\n")
    name(3).write_bytes(b"")
    packed = gzip.compress(b"source,target,theta\n" + b"".join(b"%d,%d,0.5\n" % (k, k + 1) for k in range(50)))
    name(4, "csv.gz").write_bytes(packed)
    name(5, "csv.gz").write_bytes(b"this is no gzip")
    got = {r["step"]: (r["lines"], r["faulty"], r["status"]) for r in R.faults(spark, str(tmp_path)).collect()}
    assert got == {0: (2, 0, "good"), 1: (4, 3, "faulty"), 2: (0, 0, "empty"), 3: (0, 0, "empty"), 4: (50, 0, "good"), 5: (0, 0, "unreadable")}
    rows = {(r["step"], r["src"], r["dst"], r["theta"]) for r in R.read_edges(spark, str(tmp_path), tolerant=True).where("step < 4").collect()}
    assert rows == {(0, 1, 2, 0.5), (0, 2, 3, -0.25), (1, 1, 2, 0.5)}
    with pytest.raises(Exception, match="MALFORMED|not in gzip|Malformed"):
        R.read_edges(spark, str(tmp_path)).collect()


def test_logs_in_many_blocks(spark, tmp_path):
    """Lines keep their file's metadata and completion wherever the file is split."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    runs = {1: (500, True), 2: (700, False), 3: (0, True), 4: (3, True)}
    for seed, (n, done) in runs.items():
        logs = tmp_path / "E1" / "N50" / f"S{seed}" / "logs"
        logs.mkdir(parents=True)
        lines = [f"# metadata_version=1,N=50,seed={seed},start_step={10 * seed}", "timestamp_iso,step,sps,elapsed_sec,k_min,k_avg,k_max,triangles,temp"]
        lines += [f"t,{k},1.5,{k}.0,1,2.5,{k % 7},{k * seed},0.2" for k in range(n)] + ["", "not a row"]
        end = ["# COMPLETED at noon", "", "t,900,1.5,1.0,1,2.5,1,1,0.2"] if done else ["# COMPLETED long ago", "t,901,,,,,,,", "t,902,,,,,,,", "t,903,,,,,,,"]
        (logs / "0.csv").write_bytes(("\r\n" if seed == 1 else "\n").join(lines + end).encode())
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        rows = R.read_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for seed, (n, done) in runs.items():
        mine = [r for r in rows if r["seed"] == seed]
        assert len(mine) == n + (1 if done else 3)
        assert {(r["engine"], r["n"], r["start_step"], r["completed"]) for r in mine} == {(1, 50, 10 * seed, done)}
        assert sum(r["triangles"] or 0 for r in mine) == seed * n * (n - 1) // 2 + (1 if done else 0)


def test_snapshots_of_many_steps_are_one_job_a_kind(spark, tmp_path):
    nodes = spark.range(20).select(F.col("id").alias("node_id"), F.lit(0.5).alias("psi_re"), F.lit(0.25).alias("psi_im"), F.explode(F.array(F.lit(0), F.lit(1200), F.lit(1234567))).alias("step"))
    edges = nodes.where("node_id > 0").select("step", F.lit(0).alias("src"), F.col("node_id").alias("dst"), F.lit(0.125).alias("theta"))
    R.write_snapshots(nodes, edges, str(tmp_path), 3, 50, 9)
    names = sorted(x.name for x in (tmp_path / "E3" / "N50" / "S9" / "data").iterdir() if x.suffix == ".csv" and not x.name.startswith("."))
    assert names == sorted(f"E3_N50_S9_iter_{s}_{k}.csv" for s in ("000_000_000", "000_001_200", "001_234_567") for k in ("edges", "nodes"))
    assert {(r["step"], r["n"]) for r in R.read_edges(spark, str(tmp_path)).groupBy("step").agg(F.count("*").alias("n")).collect()} == {(0, 19), (1200, 19), (1234567, 19)}
    assert R.paired(R.listing(spark, str(tmp_path))).count() == 3


# -- curvature ----------------------------------------------------------------------------------------


def test_batched_transport_equals_enumeration():
    rng = np.random.default_rng(10)
    shapes = [(4, 4), (3, 5), (5, 2), (1, 1), (4, 4)]
    high, wide = max(m for m, _ in shapes), max(n for _, n in shapes)
    supply, need, cost, want = np.zeros((len(shapes), high), np.int64), np.zeros((len(shapes), wide), np.int64), np.full((len(shapes), high, wide), 4), []
    for k, (m, n) in enumerate(shapes):
        units = 6
        a, b = (np.bincount(rng.integers(0, x, units), minlength=x) for x in (m, n))
        c = rng.integers(0, 4, (m, n))
        supply[k, :m], need[k, :n], cost[k, :m, :n] = a, b, c
        left, right = np.repeat(np.arange(m), a), np.repeat(np.arange(n), b)
        want.append(min(int(c[left, list(p)].sum()) for p in set(itertools.permutations(right.tolist()))))
    assert C.transport(supply, need, cost).tolist() == want


def test_curvature_of_known_graphs_and_brute_force(spark):
    es = random_edges(14, 34, 11)
    nodes = sorted({v for e in es for v in e})
    d = hops(nodes, es)
    at = {v: k for k, v in enumerate(nodes)}
    near = {v: [b if a == v else a for a, b in es if v in (a, b)] for v in nodes}
    for r in C.ollivier(frame(spark, es)).collect():
        u, v = r["src"], r["dst"]
        unit = 2 * math.lcm(len(near[u]), len(near[v]))
        mass = lambda w: {w: unit // 2} | {x: unit // (2 * len(near[w])) for x in near[w]}
        one, two = mass(u), mass(v)
        # Least cost by duality: the largest difference of means of a function that changes by at most the distance.
        places = sorted(set(one) | set(two))
        cost = sum_of_flow(one, two, lambda x, y: int(d[at[x], at[y]]))
        assert r["kappa"] == pytest.approx(1 - cost / unit, abs=1e-12) and len(places) > 1
    ring = C.ollivier(frame(spark, [(k, k + 1) for k in range(6)] + [(0, 6)])).collect()
    assert {round(r["kappa"], 9) for r in ring} == {0.0}
    assert C.mean_curvature(frame(spark, [(0, 1), (0, 2), (1, 2)])).first()["mean_kappa"] == pytest.approx(0.75)


def sum_of_flow(one, two, cost):
    """Least cost by single units along shortest residual ways."""
    left, need, flow, total = dict(one), dict(two), {}, 0
    while any(left.values()):
        best, came = {("s", x): 0 for x, m in left.items() if m}, {}
        changed = True
        while changed:
            changed = False
            for x in one:
                if ("s", x) in best:
                    for y in two:
                        c = best["s", x] + cost(x, y)
                        if c < best.get(("t", y), 1 << 30):
                            best["t", y], came["t", y], changed = c, ("s", x), True
            for (x, y), f in flow.items():
                if f and ("t", y) in best and best["t", y] - cost(x, y) < best.get(("s", x), 1 << 30):
                    best["s", x], came["s", x], changed = best["t", y] - cost(x, y), ("t", y), True
        end = min((y for y in two if need[y]), key=lambda y: best["t", y])
        total += best["t", end]
        place = ("t", end)
        need[end] -= 1
        while place in came:
            before = came[place]
            if place[0] == "t":
                flow[before[1], place[1]] = flow.get((before[1], place[1]), 0) + 1
            else:
                flow[place[1], before[1]] -= 1
            place = before
        left[place[1]] -= 1
    return total
