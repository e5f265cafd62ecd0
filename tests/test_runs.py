"""Run analytics, planning, simulation, files and streams."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from netweft.functions import text as T
from netweft.operators import densify as D
from netweft.operators import monitor as N
from netweft.operators import simulate as M
from netweft.operators import stability as S
from netweft.operators import sweep as W
from netweft.sources import snapshots as X
from netweft.sources.schema import PARAMS, params
from netweft.streaming import live


def log(spark, ks, run=0, interval=100):
    return spark.createDataFrame([(run, interval * (i + 1), 2, k, 4, int(k * 10), float(i)) for i, k in enumerate(ks)], "run_id long, step long, k_min long, k_avg double, k_max long, triangles long, elapsed_sec double")


def test_streaks_and_completion(spark):
    x = log(spark, [1.0, 1.0, 2.0, 2.0, 2.0, 1.0] + [3.0] * 12)
    assert [r["streak"] for r in S.streaks(x, ["run_id"]).orderBy("step").collect()] == [1, 2, 1, 2, 3, 1, *range(1, 13)]
    assert S.completion(x, ["run_id"]).first()[1:] == (12, 1600)


def test_stability_needs_every_snapshot(spark):
    x = log(spark, [3.0] * 12)
    assert S.stable_on_disk(x, ["run_id"], 100).first()["stable"]
    assert not S.stable_on_disk(x.where("step != 700"), ["run_id"], 100).first()["stable"]  # a gap in the middle
    assert not S.stable_on_disk(x.withColumn("k_min", F.lit(1)), ["run_id"], 100).first()["stable"]
    assert S.stable_by_metrics(x, ["run_id"]).first()["stable"]


def test_integrity_keeps_rows_before_the_first_mismatch(spark):
    m = spark.createDataFrame([(0, s, 10) for s in range(1, 16)], "run_id long, step long, edges long")
    c = m.withColumn("edges", F.when(F.col("step") == 9, 11).otherwise(F.col("edges"))).where("step != 12")
    got = {r["step"]: (r["mismatch"], r["keep"]) for r in S.integrity(m, c, ["run_id"]).collect()}
    assert got[8] == (False, True) and got[9] == (True, False) and got[12] == (True, False) and got[15] == (False, False)


def test_launch_pads_and_missing_frames(spark):
    have = spark.createDataFrame([(0, s) for s in (100, 200, 400, 500)], "run_id long, step long")
    want = spark.createDataFrame([(0, s) for s in (50, 100, 399, 450, 900)], "run_id long, step long")
    assert {r["step"]: r["pad"] for r in D.launch_pads(want, have, ["run_id"]).collect()} == {50: 0, 100: 100, 399: 200, 450: 400, 900: 500}
    assert sorted(r["step"] for r in D.missing_frames(have, ["run_id"], 2.0).collect()) == [s for s in range(0, 501, 83) if s not in (100, 200, 400, 500)]


def test_forecast_recovers_a_power_law(spark):
    rows = [(k, n, 2e-6 * n**1.5, 30.0 * n**1.2) for k, n in enumerate((100, 200, 400, 800))]
    runs = spark.createDataFrame(rows, "run_id long, n long, sec_per_step double, done_step double")
    for r in N.forecast(runs, [4, 16]).collect():
        assert r["seconds"] == pytest.approx(2e-6 * r["n"] ** 1.5 * 30.0 * r["n"] ** 1.2, rel=1e-6)
    alone = N.speed_model(runs.where("n = 800")).first()
    assert alone["b"] == 2.0 and alone["a"] == pytest.approx(2e-6 * 800**1.5 / 800**2)


def test_sweep_states(spark):
    df = spark.createDataFrame([(True, 100, 2.5, 4), (True, 100, 2.5, 1), (True, 100, 0.5, 9), (True, 9, 3.0, 9), (False, 100, 3.0, 9)], "v boolean, s int, k double, m int")
    got = [r[0] for r in df.select(W.status(*(F.col(c) for c in "vskm"))).collect()]
    assert got == ["CRYSTALLIZED", "STABLE", "COLLAPSED", "TIMEOUT", "NAN_PSI"]


# -- simulation -------------------------------------------------------------------------------------


def test_chain_energies_are_differences_of_the_action():
    c = M.Chain(25, 3, params(p_triadic=0.3, temp=1.0))
    for _ in range(4000):
        c.move()
    assert len(c.edges) > 10 and c.triangles() > 0
    base = c.action()
    i, j = c.edges[3]
    d = c.toggle_delta(i, j, c.near[i][j])
    t = c.near[i].pop(j)
    c.near[j].pop(i)
    c.edges.remove((i, j))
    assert c.action() - base == pytest.approx(d)
    assert -c.toggle_delta(i, j, t) == pytest.approx(d)
    low = c.action()
    e0, old = c.psi_energy(5), c.re[5]
    c.re[5] += 0.4
    assert c.psi_energy(5) - e0 == pytest.approx(c.action() - low)
    c.re[5] = old


def test_replay_from_a_snapshot_is_exact():
    p = params(p_triadic=0.4, temp=0.5)
    a = M.Chain(30, 9, p)
    for _ in range(1000):
        a.move()
    s = a.snapshot()
    b = M.Chain(30, 9, p, step=1000).load(zip(range(30), s["psi_re"], s["psi_im"]), zip(s["src"], s["dst"], s["theta"]))
    for _ in range(777):
        a.move()
        b.move()
    assert a.snapshot() == b.snapshot() and a.metrics() == b.metrics()


def test_detailed_balance_on_three_nodes():
    """Edge-count frequencies at psi = 0, beta = 0 against exp(-S / T), with the exact boundary ratio."""
    p = params(p_psi=0.0, p_theta=0.0, p_triadic=0.0, beta=0.0, temp=0.5, mu_deg2=0.2)
    weight = Counter()
    for mask in range(8):
        es = [e for k, e in enumerate([(0, 1), (0, 2), (1, 2)]) if mask >> k & 1]
        s = p["lam_e"] * len(es) + p["mu_deg2"] * sum(sum(v in e for e in es) ** 2 for v in range(3))
        weight[len(es)] += math.exp(-s / p["temp"])
    c, seen, steps = M.Chain(3, 1, p, exact_boundary=True), Counter(), 60_000
    for _ in range(steps):
        c.move()
        seen[len(c.edges)] += 1
    for k, w in weight.items():
        assert seen[k] / steps == pytest.approx(w / sum(weight.values()), abs=0.015)


def test_simulate_resume_and_verify(spark):
    runs = spark.createDataFrame([(0, 20, 5), (1, 20, 6)], "run_id long, n long, seed long").withColumn("p_triadic", F.lit(PARAMS["p_triadic"]))
    out = M.simulate(runs, ["run_id"], 600, 200, keep_state=True).cache()
    assert out.count() == 6 and out.where("temp = 0.2").count() == 6
    starts = out.where("step = 200").join(runs.select("run_id", "seed"), "run_id").withColumn("pad", F.col("step")).drop("step", "triangles", "k_avg")
    end = out.where("step = 600").select("run_id", F.col("triangles").alias("expected_triangles"), F.col("k_avg").alias("expected_k_avg"))
    states = starts.withColumn("targets", F.array(F.lit(600))).join(end, "run_id")
    assert {r["matches"] for r in M.verify(states, ["run_id"], 20).collect()} == {True}
    assert {r["matches"] for r in M.verify(states.withColumn("expected_triangles", F.lit(10**6)), ["run_id"], 20).collect()} == {False}


def test_heal_removes_and_regrows(spark):
    runs = spark.createDataFrame([(0, 40, 5)], "run_id long, n long, seed long").withColumn("p_triadic", F.lit(0.3))
    got = {r["phase"]: r for r in M.heal(runs, ["run_id"], 6000, 6, 1500, 1500).collect()}
    assert got["void"]["victim_edges"] == 0 and got["void"]["n_edges"] < got["baseline"]["n_edges"] and got["integrated"]["new_edges"] > 0


# -- files --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("runs")
    base = top / "E3" / "N4" / "S1000"
    (base / "data").mkdir(parents=True)
    (base / "logs").mkdir()
    for step, edges in ((0, ""), (100_000, "0,1,0.5\n2,1,0.25\n1,1,9\n"), (1_234_567_890, "0,3,1.0\n")):
        name = f"{step:013,d}".replace(",", "_") if step >= 10**9 else f"{step:011,d}".replace(",", "_")
        (base / "data" / f"E3_N4_S1000_iter_{name}_nodes.csv").write_text("node_id,psi_real,psi_imag\n" + "".join(f"{k},0.{k},-0.5\n" for k in range(5)))
        if step != 10:
            (base / "data" / f"E3_N4_S1000_iter_{name}_edges.csv").write_text("source,target,theta\n" + edges)
    (base / "data" / "E3_N4_S1000_iter_000_300_000_nodes.csv").write_text("node_id,psi_real,psi_imag\n")
    rows = "".join(f"2025-01-01T00:00:0{k},{100 * k},10.5,{k}.5,0,1.5,3,{k},0.2\n" for k in range(1, 4))
    (base / "logs" / "2025-01-01_00-00-00.csv").write_text("# metadata_version=1,N=4,seed=1000,start_step=0\ntimestamp_iso,step,sps,elapsed_sec,k_min,k_avg,k_max,triangles,temp\n" + rows + "# COMPLETED at x\n")
    (base / "logs" / "2025-01-02_00-00-00.csv").write_text("# metadata_version=1,N=4,seed=1000,start_step=300\ntimestamp_iso,step,sps,elapsed_sec,k_min,k_avg,k_max,triangles,temp\n")
    return top


def test_snapshot_readers(spark, folder):
    nodes = X.read_nodes(spark, str(folder))
    assert nodes.where("step = 100000").count() == 4  # an id of N is dropped
    edges = {(r["step"], r["src"], r["dst"], r["theta"]) for r in X.read_edges(spark, str(folder)).collect()}
    assert edges == {(100_000, 0, 1, 0.5), (100_000, 1, 2, -0.25), (1_234_567_890, 0, 3, 1.0)}
    files = X.listing(spark, str(folder))
    assert sorted(r["step"] for r in X.paired(files).collect()) == [0, 100_000, 1_234_567_890]
    assert X.final_snapshots(files).first()["step"] == 1_234_567_890
    runs = spark.createDataFrame([(3, 4, 1000), (3, 4, 7)], "engine long, n long, seed long")
    assert {r["seed"]: r["step"] for r in X.latest(files, runs).collect()} == {1000: 1_234_567_890, 7: -1}
    assert [r["engine"] for r in X.engines(files).collect()] == [3]


def test_log_reader(spark, folder):
    got = X.read_logs(spark, str(folder / "E3" / "N4" / "S1000" / "logs")).orderBy("step").collect()
    assert [(r["step"], r["elapsed_sec"], r["completed"], r["start_step"]) for r in got] == [(100, 1.5, True, 0), (200, 2.5, True, 0), (300, 3.5, True, 0)]


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([(0, 1, 5), (0, 2, 6)], "run_id long, step long, edges long")
    path = str(tmp_path / "metrics")
    X.append_metrics(m, path, ["run_id", "step"])
    X.append_metrics(m.unionByName(spark.createDataFrame([(0, 3, 7)], m.schema)), path, ["run_id", "step"])
    assert spark.read.parquet(path).count() == 3
    X.append_metrics(spark.createDataFrame([(0, 4, 7, 1.5)], "run_id long, step long, edges long, extra double"), path, ["run_id", "step"])
    assert spark.read.parquet(path).where("extra IS NULL").count() == 3
    X.write_table(m.withColumn("engine", F.lit(1)), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("step = 2").count() == 1
    assert X.engine_diff("a\nb", "a\nc\nd")[1:] == (2, 1)
    assert X.engine_version(b"x", {1: b"y", 4: b"x"}) == (4, False) and X.engine_version(b"z", {1: b"y"}) == (2, True)
    X.write_report(X.report_lines(m, {"step": 8, "edges": 8}), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 2


def test_labels(spark):
    df = spark.createDataFrame([(100_000, "runs/E2/N100/S7/data/E2_N100_S7_iter_000_100_000_nodes.csv", 90061.0), (1_234_567_890, "bad/path.csv", -1.0)], "s long, p string, sec double")
    got = df.select(T.step_label(F.col("s")), T.path_metadata(F.col("p")), T.step_of(F.col("p")), T.duration(F.col("sec"))).collect()
    assert tuple(got[0]) == ("000_100_000", (2, 100, 7), 100_000, "1 day, 1:01:01") and tuple(got[1]) == ("1_234_567_890", (0, 0, 0), None, "---")
    old = spark.createDataFrame([("x_N50_seed_3",), ("x_N50_s4/a",), ("x_N60",)], "p string").select(T.legacy_metadata(F.col("p"))).collect()
    assert [tuple(r[0]) for r in old] == [(50, 3), (50, 4), (60, 0)]


# -- streams ------------------------------------------------------------------------------------------


def test_streamed_streaks_equal_the_batch(spark, tmp_path):
    x = log(spark, [1.0, 1.0, 2.0] + [3.0] * 11).unionByName(log(spark, [3.0] * 5, 1))
    path = str(tmp_path / "log")
    x.where("step <= 500").coalesce(1).write.parquet(path)
    x.where("step > 500").coalesce(1).write.mode("append").parquet(path)
    out = live.latest_state(live.drain(live.streaks(live.tail(spark, path, x.schema)), "update"), ["run_id"])
    assert {r["run_id"]: (r["streak"], r["done_step"]) for r in out.collect()} == {0: (11, 1300), 1: (5, None)}
    trend = live.latest_state(live.drain(live.trends(live.tail(spark, path, x.schema)), "update"), ["run_id"])
    batch = {r["run_id"]: r["eta"] for r in N.eta(x, ["run_id"], 3.0).where("(run_id = 0 AND step = 1400) OR (run_id = 1 AND step = 500)").collect()}
    got = {r["run_id"]: r["eta"] for r in trend.collect()}
    assert got[0] == pytest.approx(batch[0]) and got[1] is None and batch[1] is None
