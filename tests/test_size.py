"""What keeps moved bytes and memory in proportion to the input."""

from pyspark.sql import functions as F

from netweft import session
from netweft.operators import densify as D
from netweft.operators import graph as G
from netweft.operators import growth as W
from netweft.operators import landmarks as L
from netweft.operators import observables as O
from netweft.operators import spectra as S
from netweft.plans import catalog
from netweft.sources import fixtures as X
from netweft.sources import snapshots as R


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def complete(spark, n, first=0):
    return spark.createDataFrame([(first + i, first + j, (i + j) % 3, 0.1 * i - 0.2 * j) for i in range(n) for j in range(i + 1, n)], "src long, dst long, born int, theta double")


def test_triangles_look_up_one_edge_by_a_join(spark):
    for first in (0, 1 << 40):  # ids that fit four bytes, and some that don't
        e = complete(spark, 7, first)
        got = W.triangles(e)
        assert plan(got).count("Join ") <= 8  # of 14 with both of the third node's edges
        of = {(r["src"], r["dst"]): r for r in e.collect()}
        rows = got.collect()
        assert len({(r["a"], r["b"], r["c"]) for r in rows}) == len(rows) == 35
        for r in rows:
            ab, bc, ac = of[r["a"], r["b"]], of[r["b"], r["c"]], of[r["a"], r["c"]]
            assert (r["t_ab"], r["t_bc"], r["t_ac"]) == (ab["theta"], bc["theta"], ac["theta"])
            assert r["born"] == max(x["born"] for x in (ab, bc, ac))


def test_gauge_check_finds_triangles_once(spark):
    e = complete(spark, 6).withColumn("step", F.lit(0))
    v = spark.range(6).select(F.lit(0).alias("step"), F.col("id").alias("node_id"), F.lit(0.5).alias("psi_re"), (F.col("id") * 0.1).alias("psi_im"))
    whole = O.gauge_check(v, e.drop("born"), ["step"])
    assert plan(whole).count("array_intersect") == 1
    grown = W.gauge_check(v.drop("step"), e.drop("step"), (0, 1, 2))
    assert plan(grown).count("array_intersect") == 1
    assert {r["step"]: (r["pairs"], r["loops"]) for r in grown.collect()} == {
        s: (e.where(f"born <= {s}").count(), G.triangles(e.where(f"born <= {s}").select("src", "dst")).count() or None) for s in (0, 1, 2)
    }
    assert all(r["pair_error"] < 1e-9 and (r["loop_error"] or 0) < 1e-9 for r in [*whole.collect(), *grown.collect()])


def test_shells_keep_a_row_a_node(spark):
    e = spark.createDataFrame([(i, (i * 7 + k) % 90) for i in range(90) for k in range(2) if i < (i * 7 + k) % 90], "src long, dst long")
    sources = G.sample(G.graph_nodes(e), 70)  # more than a word of bits
    for depth in (2, None):
        want = G.bfs(e, sources, depth).groupBy("source", "d").agg(F.count("*").alias("nodes"))
        assert sorted(L.shells(e, sources, depth).select("source", "d", "nodes").collect()) == sorted(want.select("source", "d", "nodes").collect())
    assert L.reached(e, sources.withColumn("place", F.lit(0)), 1).select("node_id").distinct().count() <= 90


def test_a_node_carries_all_probes(spark):
    e = complete(spark, 9).select("src", "dst")
    before = len(session.stored)
    found, _ = S.lanczos(G.graph_nodes(e), e, (), 5, 3)
    assert found.select("probe", "step").distinct().count() == 15
    tables = [spark.read.parquet(t) for t in session.stored[before:]]
    assert {t.count() for t in tables if {"d", "v", "w"} <= set(t.columns)} == {9}


def test_nodes_beyond_a_folders_label_are_read(spark, tmp_path):
    v = spark.createDataFrame([(3, 0.5, 0.5), (200, 0.25, 0.5)], "node_id long, psi_re double, psi_im double")
    e = spark.createDataFrame([(3, 200, 0.5)], "src long, dst long, theta double")
    R.write_snapshot(v, e, str(tmp_path), 3, 100, 7, 0)
    assert R.read_nodes(spark, str(tmp_path)).count() == 1
    assert R.read_nodes(spark, str(tmp_path), within=False).count() == 2


def test_tasks_of_the_part_graph_grow_with_its_lines(spark, sf, monkeypatch):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    want = sorted(X.part_edges(spark, sf).collect())
    monkeypatch.setattr(X, "LINES", 100)
    more = X.part_edges(spark, sf)
    assert more.rdd.getNumPartitions() == 2 * -(-lines // 100)
    assert sorted(more.collect()) == want == sorted(spark.sql(X.part_edges_sql()).collect())


def test_edge_diff_looks_nothing_up(spark, sf):
    assert "LeftAnti" not in plan(catalog.QUERIES["edge_diff"](spark, sf))


def test_correlator_paths_are_rows_of_nodes_not_of_arcs(spark):
    e = spark.createDataFrame([(i, (i * 7 + k) % 90, 0.01 * i - 0.02 * k) for i in range(90) for k in range(5) if i < (i * 7 + k) % 90], "src long, dst long, theta double")
    sources = G.sample(G.graph_nodes(e), 70)  # more than a word of bits
    before = len(session.stored)
    got = {(r["source"], r["node_id"]): (r["d"], r["phase"]) for r in G.shortest_path_phases(e, sources, 6).collect()}
    assert any({"src", "theta", "f_w0", "f_w1"} <= set(spark.read.parquet(t).columns) for t in session.stored[before:])  # arcs meet bits
    arcs = {}
    for r in e.collect():
        arcs.setdefault(r["src"], []).append((r["dst"], r["theta"]))
        arcs.setdefault(r["dst"], []).append((r["src"], -r["theta"]))
    want = {}
    for s in [r[0] for r in sources.collect()]:
        seen = front = {s: (0, 0.0)}
        for d in range(1, 7):
            new = {}
            for u in sorted(front):
                for v, t in arcs[u]:
                    if v not in seen:
                        new.setdefault(v, (d, front[u][1] + t))
            seen, front = {**seen, **new}, new
        want |= {(s, v): x for v, x in seen.items()}
    assert got == want


def test_snapshots_of_many_rows_are_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "ROWS", 10)
    nodes = spark.range(60).select(F.col("id").alias("node_id"), F.lit(0.5).alias("psi_re"), F.lit(0.25).alias("psi_im"), F.explode(F.array(F.lit(0), F.lit(5))).alias("step"))
    edges = nodes.where("node_id > 0").select("step", F.lit(0).alias("src"), F.col("node_id").alias("dst"), F.lit(0.125).alias("theta"))
    for _ in range(2):  # the second time files are replaced
        R.write_snapshots(nodes, edges, str(tmp_path), 3, 100, 9)
    files = [x for x in (tmp_path / "E3" / "N100" / "S9" / "data").iterdir() if x.suffix == ".csv" and not x.name.startswith(".")]
    assert len([x for x in files if "_005_edges" in x.name]) > 3 and max(len(x.read_text().splitlines()) for x in files) < 30
    assert {(r["step"], r["n"]) for r in R.read_edges(spark, str(tmp_path)).groupBy("step").agg(F.count_distinct("dst").alias("n")).collect()} == {(0, 59), (5, 59)}
    assert R.read_edges(spark, str(tmp_path)).count() == 118 and R.read_nodes(spark, str(tmp_path)).count() == 120
    listing = R.listing(spark, str(tmp_path))
    assert R.paired(listing).count() == 2 and R.final_snapshots(listing).first()["path"].endswith("_005_edges.csv")
    one = next(x for x in files if "_005_edges" in x.name)
    one.with_name(f".{one.name}.crc").unlink()
    one.write_text("source,target,theta\nx,y,z\n")
    got = R.snapshot_faults(R.faults(spark, str(tmp_path)))
    assert {(r["step"], r["status"]) for r in got.collect()} == {(0, "good"), (5, "faulty")}


def test_curvature_of_all_steps_meets_an_edge_once(spark, sf):
    v, e = X.part_nodes(spark, sf), W.born(X.part_edges(spark, sf), X.STEPS)
    got = W.node_curvature(v, e, X.STEPS)
    nodes, edges = X.snapshots(spark, sf)
    want = O.node_curvature(nodes, O.forman_edges(edges, ["step"]), "forman", ["step"]).select("step", "node_id", "curvature")
    assert sorted(got.collect()) == sorted(want.collect())
    assert plan(got).count("BroadcastNestedLoop") == 0 and "step" not in e.columns


def test_halvings_go_by_the_series(spark):
    n = F.lit(70).cast("long")
    assert spark.range(1).select(F.size(D._halvings(n))).first()[0] == 7
    places = [r[0] for r in spark.range(70).select(D.bisection_place(F.col("id"), n)).collect()]
    assert sorted(places) == list(range(70))


def test_a_bound_on_the_hash_changes_no_sample(spark, monkeypatch):
    e = complete(spark, 30).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("step"), "src", "dst").where("step = 0 OR dst < 7")
    rows = lambda most, keys: sorted(G.sampled_triangles(e if keys else e.where("step = 0").drop("step"), keys, 12, 6, most).collect())
    found = {}
    for shares in ((62, 63, 64), (64,)):
        monkeypatch.setattr(G, "SHARES", shares)
        found[shares] = [rows(most, keys) for most, keys in ((100, ["step"]), (9999, ["step"]), (50, ()))]
    assert found[62, 63, 64] == found[64,]
    assert [len(x) for x in found[64,]][2] == 50


def test_forman_curvature_of_nodes_joins_one_end(spark):
    e = complete(spark, 9).where("(src * 5 + dst) % 3 != 0").select(F.lit(0).alias("step"), "src", "dst")
    v = spark.range(12).select(F.lit(0).alias("step"), F.col("id").alias("node_id"))
    got, want = O.node_forman(v, e, ["step"]), O.node_curvature(v, O.forman_edges(e, ["step"]), "forman", ["step"])
    assert sorted(got.select("step", "node_id", "curvature").collect()) == sorted(want.select("step", "node_id", "curvature").collect())
    assert plan(got).count("Join ") < plan(want).count("Join ")


def test_stored_edges_are_searched_as_they_are(spark):
    e = session.checkpointed(complete(spark, 6).select("src", "dst"))
    before = len(session.stored)
    got = G.bfs(e, spark.range(1).withColumnRenamed("id", "node_id"), 3, stored=True)
    assert {(r["node_id"], r["d"]) for r in got.collect()} == {(0, 0), *((k, 1) for k in range(1, 6))}
    assert not any("dst" in spark.read.parquet(t).columns for t in session.stored[before:])


def test_layout_of_a_graph_beyond_the_dense_bound(spark, monkeypatch):
    import numpy as np

    from netweft.operators import geometry as E
    from netweft.operators import lowest as Z

    rng = np.random.default_rng(5)
    rows = [(g, 3 * i, 3 * j) for g, n in ((1, 70), (2, 12)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.2 or j == i + 1]
    e = spark.createDataFrame(rows, "g int, src long, dst long")
    want = {(r["g"], r["node_id"]): r["x"] for r in E.spectral_layout(e, ["g"]).collect()}
    monkeypatch.setattr(E, "DENSE", 20)
    monkeypatch.setattr(Z, "SIZE", 16)
    monkeypatch.setattr(Z, "WIDTH", 6)
    got = E.spectral_layout(e, ["g"]).collect()
    assert len(got) == 82 and max(np.abs(np.array(r["x"]) - want[r["g"], r["node_id"]]).max() for r in got) < 1e-8


def test_landmarks_search_packed_blocks(spark, sf, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 200)
    near = X.vec_edges(spark, sf, 0.25, keep=True)
    cells = X.vec_cells(spark, sf, (0.3, 0.25))
    for step, e in enumerate((near.where("cos > 0.3"), near)):
        one = cells.where(F.col("step") == step)
        assert sorted(L.linked(one).collect()) == sorted(G.graph_nodes(e).collect())
        marks = L.pick(G.graph_nodes(e), 70)  # more than a word of bits
        want = {r["node_id"]: r["hops"] for r in L.distances(e, marks, 70).collect()}
        assert {r["node_id"]: r["hops"] for r in L.cell_distances(one, marks, 70).collect()} == want
    assert "src" not in cells.columns and cells.where("a = b").count() == 2 * cells.select("a").distinct().count()
