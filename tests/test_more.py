"""Numbering, capped loops, live triangles, live logs, stitches, the alignment cache and blocked cosines."""

import os

import numpy as np
from pyspark.sql import functions as F

from netweft.operators import graph as G
from netweft.operators import observables as O
from netweft.operators import simulate as M
from netweft.session import checkpointed, scratch
from netweft.sources import fixtures as X
from netweft.sources import snapshots as S


def complete(spark, n, step=0):
    return spark.createDataFrame([(step, a, b, 0.1 * (a + b)) for a in range(n) for b in range(a + 1, n)], "step int, src long, dst long, theta double")


def test_numbering_within_each_graph(spark):
    rows = [(k % 3, (k * 7919) % 1009) for k in range(600)]
    got = G.numbered(spark.createDataFrame(rows, "step int, node_id long").distinct(), ["step"]).collect()
    for step in range(3):
        mine = sorted((r["node_id"], r["index"]) for r in got if r["step"] == step)
        assert [i for _, i in mine] == list(range(len({n for s, n in rows if s == step})))
    assert G.numbered(spark.createDataFrame([], "node_id long")).count() == 0


def test_sampled_triangles_keep_their_caps(spark):
    e = complete(spark, 20).unionByName(complete(spark, 4, 1))
    every = {(r["step"], r["a"], r["b"], r["c"]) for r in G.triangles(e, ["step"]).collect()}
    assert len(every) == 20 * 19 * 18 // 6 + 4
    some = [(r["step"], r["a"], r["b"], r["c"]) for r in G.sampled_triangles(e, ["step"], 12, 6, 100).collect()]
    assert len(some) == len(set(some)) == 104 and set(some) <= every
    loose = {(r["step"], r["a"], r["b"], r["c"]) for r in G.sampled_triangles(e, ["step"], 99, 99, 9999).collect()}
    assert loose == every
    assert G.sampled_triangles(e.where("step = 0").drop("step"), (), 12, 6, 50).count() == 50
    loops = {(r["step"], r["a"], r["b"], r["c"]): r["loop"] for r in O.wilson_loops(e, ["step"]).collect()}
    of = O.wilson_loops_of(G.sampled_triangles(e, ["step"]), e, ["step"]).collect()
    assert of and all(abs(loops[r["step"], r["a"], r["b"], r["c"]] - r["loop"]) < 1e-12 for r in of)


def test_triangles_alive(spark):
    e = complete(spark, 5).drop("step")
    left = G.alive(G.triangles(e.select("src", "dst")), e.where("NOT (src = 0 AND dst = 1)"))
    assert left.count() == 10 - 3


def test_live_log_grows_and_ends(spark, tmp_path):
    folder = f"file://{tmp_path}/E1/N50/S7/logs"
    rows = spark.createDataFrame([("t", 100 * k, 1.5, float(k), 0, 0.5 * k, k, k * k, 0.2) for k in range(1, 9)], S.S.RUN_LOG)
    S.append_log(rows.where("step <= 300"), folder, {"N": 50, "seed": 7, "start_step": 0})
    assert {r["completed"] for r in S.read_logs(spark, folder).collect()} == {False}
    for _ in range(2):  # an append that is repeated replaces itself
        S.append_log(rows.where("step > 300"), folder, completed="now")
    got = S.read_logs(spark, folder).orderBy("step").collect()
    assert [r["step"] for r in got] == [100 * k for k in range(1, 9)] and (got[0]["engine"], got[0]["n"], got[0]["seed"]) == (1, 50, 7)
    assert [r["triangles"] for r in got] == [k * k for k in range(1, 9)] and got[-1]["completed"]
    files = sorted(f for f in os.listdir(tmp_path / "E1/N50/S7/logs") if f.endswith(".csv"))
    assert len(files) == 2 and (tmp_path / "E1/N50/S7/logs" / files[1]).read_text().rstrip().split("\n")[-1] == "# COMPLETED at now"


def test_snapshot_files_round_trip(spark, tmp_path):
    v, e = X.snapshots(spark, "/root/testdata/sf0.001", (2,))
    S.write_snapshot(v, e, f"file://{tmp_path}", 2, 1000, 5, 1_234_567_890)
    back = S.read_edges(spark, f"file://{tmp_path}")
    assert {(r["engine"], r["n"], r["seed"], r["step"]) for r in back.collect()} == {(2, 1000, 5, 1_234_567_890)}
    assert {(r["src"], r["dst"], r["theta"]) for r in back.collect()} == {(r["src"], r["dst"], r["theta"]) for r in e.collect()}
    assert S.paired(S.listing(spark, f"file://{tmp_path}")).count() == 1
    assert S.earliest(S.steps(S.listing(spark, f"file://{tmp_path}"))).count() == 1


def test_stitch_falls_back_to_what_replays(spark):
    runs = spark.range(2).select(F.col("id").alias("run_id"), F.lit(20).alias("n"), (F.col("id") + 1000).alias("seed"))
    stored = checkpointed(M.simulate(runs, ["run_id"], 4_000, 1_000, keep_state=True))
    states = stored.withColumn("seed", F.col("run_id") + 1000)
    log = stored.select("run_id", "step", "triangles", "k_avg")
    good = {r["run_id"]: r["step"] for r in M.stitch(states, log, ["run_id"], 20, 1_000).collect()}
    assert good == {0: 4_000, 1: 4_000}
    broken = log.withColumn("k_avg", F.when((F.col("run_id") == 1) & (F.col("step") >= 3_000), F.col("k_avg") + 1).otherwise(F.col("k_avg")))
    assert {r["run_id"]: r["step"] for r in M.stitch(states, broken, ["run_id"], 20, 1_000).collect()} == {0: 4_000, 1: 2_000}
    assert {r["step"] for r in M.stitch(states, log.withColumn("triangles", F.lit(-1).cast("long")), ["run_id"], 20, 1_000).collect()} == {None}


def test_alignment_cache(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    x = spark.createDataFrame([(r, s, k, [float(s), float(k)]) for r in (1, 2) for s in (100, 200) for k in range(3)], "run_id long, step long, node_id long, x array<double>")
    S.write_alignment(x, path)
    S.write_alignment(x.where("step = 200").withColumn("x", F.array(F.lit(9.0), F.lit(9.0))), path)
    assert S.read_alignment(spark, path).count() == 12
    assert {(r["step"], r["x"][0]) for r in S.read_alignment(spark, path, 300).collect()} == {(200, 9.0)}
    assert {r["step"] for r in S.read_alignment(spark, path, 200).collect()} == {100}


def test_drop_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "m double")
    assert [r["m"] for r in S.drop_nan(df, "m").collect()] == [1.0]


def test_blocked_cosines_find_every_pair(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    e = np.array([r["embedding"] for r in rows], float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    ids = [r["vec_id"] for r in rows]
    want = {tuple(sorted((ids[a], ids[b]))) for a, b in zip(*np.nonzero(np.triu(e @ e.T > 0.3, 1)))}
    for block in (2048, 97):
        monkeypatch.setattr(X, "BLOCK", block)
        with scratch(spark):
            got = [(r["src"], r["dst"]) for r in X.vec_edges(spark, sf, 0.3).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_scratch_removes_what_was_stored(spark):
    with scratch(spark) as kept:
        a, b = checkpointed(spark.range(3)), checkpointed(spark.range(4))
        kept.append(b)
    assert b.count() == 4
    assert not os.path.exists(a.stored_at.removeprefix("file://").removeprefix("file:"))
