"""Queries over run logs and series, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import densify as D
from ..operators import monitor as N
from ..operators import stability as S
from ..sources import fixtures as X
from .graphs import q6, rounded

RUN = ["run_id"]
LOG = f"lg AS (SELECT * FROM ({X.RUN_LOG_DUCKDB}) x)"
STREAK = """st AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, island ORDER BY step) AS streak FROM (
    SELECT *, sum(changed) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
      SELECT *, CASE WHEN trunc(k_avg * 1000) = lag(trunc(k_avg * 1000)) OVER (PARTITION BY run_id ORDER BY step) THEN 0 ELSE 1 END AS changed FROM lg) a) b)"""
DONE = "dn AS (SELECT run_id, max(streak) AS longest, min(step) FILTER (WHERE streak >= 10 AND k_min >= 2 AND k_avg >= 2.8e0) AS done_step FROM st GROUP BY run_id)"
SPEED = """sp0 AS (
  SELECT run_id, min(step) AS s0, max(step) AS last_step, arg_min(elapsed_sec, step) AS t0, arg_max(elapsed_sec, step) AS t1, arg_max(gap, step) AS gap,
    arg_max(k_min, step) AS k_min, arg_max(k_avg, step) AS k_avg, arg_max(k_max, step) AS k_max, arg_max(triangles, step) AS triangles
  FROM (SELECT *, elapsed_sec - lag(elapsed_sec) OVER (PARTITION BY run_id ORDER BY step) AS gap FROM lg) x GROUP BY run_id),
sp AS (SELECT *, CASE WHEN last_step > s0 THEN (t1 - t0) / (last_step - s0) ELSE t1 / last_step END AS sec_per_step FROM sp0)"""
RUNS = "rn AS (SELECT sp.*, dn.done_step, i.n, i.engine_id, i.seed FROM sp JOIN dn USING (run_id) JOIN (SELECT DISTINCT run_id, n, engine_id, seed FROM lg) i USING (run_id))"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _log(spark, sf_dir):
    return X.run_log(spark, sf_dir)


def _runs(spark, sf_dir):
    log = _log(spark, sf_dir)
    ids = log.select("run_id", "n", "engine_id", "seed").distinct()
    return N.run_speed(log, RUN).join(S.completion(log, RUN), RUN).join(ids, RUN)


@query(f"""WITH {LOG}, a AS (SELECT run_id, step, triangles, coalesce(triangles - lag(triangles) OVER w, 0) AS velocity, max(triangles) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS peak FROM lg WINDOW w AS (PARTITION BY run_id ORDER BY step))
SELECT run_id, step, triangles, velocity, velocity - coalesce(lag(velocity) OVER (PARTITION BY run_id ORDER BY step), 0) AS acceleration, peak FROM a""")
def tri_kinematics(spark, sf_dir):
    return rounded(S.kinematics(_log(spark, sf_dir), RUN))


@query(f"WITH {LOG}, {STREAK} SELECT run_id, step, CAST(trunc(k_avg * 1000) AS BIGINT) AS level, streak FROM st")
def streak_islands(spark, sf_dir):
    return rounded(S.streaks(_log(spark, sf_dir), RUN).select("run_id", "step", "level", "streak"))


@query(f"WITH {LOG}, {STREAK}, {DONE} SELECT run_id, longest, done_step FROM dn")
def completion_step(spark, sf_dir):
    return rounded(S.completion(_log(spark, sf_dir), RUN))


@query(f"""WITH {LOG}, x AS (SELECT * FROM (SELECT *, max(step) OVER (PARTITION BY run_id) AS latest FROM lg) y WHERE step > latest - 1000 AND (latest - step) % 100 = 0)
SELECT run_id, max(latest) AS latest, count(DISTINCT step) AS found, count(DISTINCT step) = 10 AND count(DISTINCT trunc(k_avg * 1000)) = 1 AND arg_max(k_min, step) >= 2 AS stable FROM x GROUP BY run_id""")
def stability_disk(spark, sf_dir):
    return rounded(S.stable_on_disk(_log(spark, sf_dir), RUN, 100))


@query(f"""WITH {LOG}, x AS (SELECT *, max(step) OVER (PARTITION BY run_id) AS latest, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS rk FROM lg),
y AS (SELECT *, step >= latest - 0.01e0 * latest AS recent FROM x), z AS (SELECT *, sum(CAST(recent AS INT)) OVER (PARTITION BY run_id) AS n_recent FROM y)
SELECT run_id, count(*) AS rows_used, count(DISTINCT triangles) = 1 AND arg_max(k_min, step) > 0 AS stable FROM z WHERE CASE WHEN n_recent >= 3 THEN recent ELSE rk <= 3 END GROUP BY run_id""")
def stability_metrics(spark, sf_dir):
    return rounded(S.stable_by_metrics(_log(spark, sf_dir), RUN))


FRACTIONS = ", ".join(f"({int(round(f * 100))})" for f in S.SLICES)
SLICES = f"""sl AS (
  SELECT run_id, slice, target, step, k_avg, triangles, n, seed, engine_id FROM (
    SELECT e.run_id, slice, CAST(floor(last * slice / 100) AS BIGINT) AS target, last, lg.step, lg.k_avg, lg.triangles, lg.n, lg.seed, lg.engine_id
    FROM (SELECT run_id, max(step) AS last FROM lg GROUP BY run_id) e, (VALUES {FRACTIONS}) f(slice), lg WHERE lg.run_id = e.run_id
    QUALIFY row_number() OVER (PARTITION BY e.run_id, slice ORDER BY abs(lg.step - floor(last * slice / 100)), lg.step) = 1) x
  WHERE abs(step - target) <= greatest(1.0e0, 0.15e0 * last))"""


@query(f"WITH {LOG}, {SLICES} SELECT run_id, CAST(slice AS BIGINT) AS slice, target, step, {q6('k_avg')} AS k_avg, triangles FROM sl")
def progress_slices(spark, sf_dir):
    return rounded(S.progress_slices(_log(spark, sf_dir).select("run_id", "step", "k_avg", "triangles"), RUN))


@query(f"WITH {LOG}, {SLICES} SELECT engine_id, n, CAST(slice AS BIGINT) AS slice, count(DISTINCT seed) AS seeds, {q6('avg(k_avg)')} AS mean_k_avg, {q6('avg(triangles)')} AS mean_triangles FROM sl GROUP BY ALL")
def slice_report(spark, sf_dir):
    s = S.progress_slices(_log(spark, sf_dir).select("run_id", "engine_id", "n", "seed", "step", "k_avg", "triangles"), RUN)
    return rounded(S.slice_report(s, ["engine_id", "n"], "seed", ["k_avg", "triangles"]))


@query(f"WITH {LOG}, {STREAK}, {DONE}, {SPEED}, {RUNS} SELECT engine_id, n, count(*) AS runs, {q6('avg(k_avg)')} AS mean_k_avg, {q6('stddev_samp(k_avg)')} AS std_k_avg, {q6('avg(triangles)')} AS mean_triangles, {q6('stddev_samp(triangles)')} AS std_triangles, max(last_step) AS max_last_step FROM rn GROUP BY ALL")
def config_summary(spark, sf_dir):
    return rounded(S.config_summary(_runs(spark, sf_dir), ["engine_id", "n"], ["k_avg", "triangles"], ["last_step"]))


@query(f"WITH {LOG} SELECT n, step, count(*) AS n_rows, {q6('avg(k_min)')} AS mean_k_min, {q6('avg(k_avg)')} AS mean_k_avg, {q6('avg(k_max)')} AS mean_k_max FROM lg GROUP BY n, step")
def mean_trajectory(spark, sf_dir):
    return rounded(S.mean_trajectory(_log(spark, sf_dir), ["n", "step"], ["k_min", "k_avg", "k_max"]))


@query(f"WITH {LOG} SELECT run_id, n, seed, step, triangles, {q6('k_avg')} AS k_avg FROM lg")
def evolution_metrics(spark, sf_dir):
    return rounded(S.evolution(S.trajectories(_log(spark, sf_dir), ["run_id", "n", "seed"], ["triangles", "k_avg"])))


FRAMES = f"{LOG}, fr AS (SELECT run_id, step FROM lg WHERE triangles % 7 != 4)"


def _frames(spark, sf_dir):
    return _log(spark, sf_dir).where("triangles % 7 != 4").select("run_id", "step")


@query(f"WITH {FRAMES}, w AS (SELECT run_id, step + 50 AS step FROM lg) SELECT w.run_id, w.step, coalesce(f.step, 0) AS pad FROM w ASOF LEFT JOIN fr f ON w.run_id = f.run_id AND w.step >= f.step")
def launch_pad_asof(spark, sf_dir):
    return rounded(D.launch_pads(_log(spark, sf_dir).select("run_id", (F.col("step") + 50).alias("step")), _frames(spark, sf_dir), RUN))


@query(f"""WITH {FRAMES}, s AS (SELECT run_id, last, CAST(greatest(floor((last / greatest(n - 1, 1)) / 1.5e0), 1) AS BIGINT) AS stride FROM (SELECT run_id, max(step) AS last, count(DISTINCT step) AS n FROM fr GROUP BY run_id) x),
g AS (SELECT run_id, unnest(range(CAST(ceil(floor(last * 20.0e0 / 100) / stride) AS BIGINT) * stride, CAST(floor(last * 80.0e0 / 100) AS BIGINT) + 1, stride)) AS step FROM s)
SELECT g.run_id, g.step FROM g ANTI JOIN fr ON g.run_id = fr.run_id AND g.step = fr.step""")
def missing_frames(spark, sf_dir):
    return rounded(D.missing_frames(_frames(spark, sf_dir), RUN, 1.5, 20.0, 80.0))


BSP = """f AS (SELECT run_id, step, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS idx FROM (SELECT DISTINCT run_id, step FROM lg) x), nn AS (SELECT run_id, count(*) AS n FROM f GROUP BY run_id),
q(run_id, level, ord, a, b) AS (
  SELECT run_id, 0, CAST(0 AS HUGEINT), CAST(0 AS BIGINT), n - 1 FROM nn
  UNION ALL SELECT run_id, level + 1, ord * 2 + k, CASE WHEN k = 0 THEN a ELSE (a + b) // 2 END, CASE WHEN k = 0 THEN (a + b) // 2 ELSE b END FROM q, (VALUES (0), (1)) h(k) WHERE b - a > 1),
m AS (SELECT run_id, (a + b) // 2 AS idx, min(level) AS level, arg_min(ord, level) AS ord FROM q WHERE b - a > 1 GROUP BY ALL),
o AS (SELECT f.run_id, f.step, f.idx, CASE WHEN f.idx = 0 THEN -2 WHEN f.idx = n - 1 THEN -1 ELSE level END AS l, m.ord FROM f JOIN nn USING (run_id) LEFT JOIN m ON m.run_id = f.run_id AND m.idx = f.idx)"""


@query(f"WITH RECURSIVE {LOG}, {BSP} SELECT run_id, step, idx AS index, row_number() OVER (PARTITION BY run_id ORDER BY l, ord, idx) - 1 AS place FROM o")
def frame_bsp_order(spark, sf_dir):
    """The order in which each run's frames are made: first, last, then midpoints level by level."""
    return rounded(D.frame_order(_log(spark, sf_dir), RUN))


@query(f"""WITH {LOG}, a AS (SELECT run_id, max(step) AS last_step, {q6('max(elapsed_sec)')} AS seconds FROM lg WHERE run_id % 3 != 0 GROUP BY run_id), b AS (SELECT run_id, max(step) AS last_step, {q6('max(elapsed_sec)')} AS seconds FROM lg WHERE run_id % 3 != 1 GROUP BY run_id)
SELECT coalesce(a.run_id, b.run_id) AS run_id, CASE WHEN b.run_id IS NOT NULL THEN b.last_step ELSE a.last_step END AS last_step, CASE WHEN b.run_id IS NOT NULL THEN b.seconds ELSE a.seconds END AS seconds, CASE WHEN b.run_id IS NOT NULL THEN 'log' ELSE 'files' END AS origin FROM a FULL JOIN b USING (run_id)""")
def stats_merge(spark, sf_dir):
    """Two thirds of the runs have files, two thirds a log; each row of the log is in one of them or both."""
    log = _log(spark, sf_dir)
    part = lambda x: x.groupBy("run_id").agg(F.max("step").alias("last_step"), F.max("elapsed_sec").alias("seconds"))
    return rounded(N.merge_stats(part(log.where("run_id % 3 != 0")), part(log.where("run_id % 3 != 1")), RUN, ["last_step", "seconds"]))


@query(f"WITH {LOG}, {SPEED} SELECT run_id, last_step, {q6('sec_per_step')} AS sec_per_step, {q6('gap')} AS interval, k_min, {q6('k_avg')} AS k_avg, k_max, triangles FROM sp")
def run_speed(spark, sf_dir):
    return rounded(N.run_speed(_log(spark, sf_dir), RUN))


@query(f"WITH {LOG}, {STREAK}, {DONE}, {SPEED}, {RUNS} SELECT engine_id, {q6('regr_slope(ln(sec_per_step), ln(n))')} AS exponent, {q6('exp(regr_intercept(ln(sec_per_step), ln(n)))')} AS factor, count(*) AS points FROM rn WHERE sec_per_step > 0 GROUP BY engine_id")
def power_law_fit(spark, sf_dir):
    from ..operators.metrics import power_law

    b, a, n = power_law(F.col("sec_per_step"), F.col("n"))
    return rounded(_runs(spark, sf_dir).groupBy("engine_id").agg(b.alias("exponent"), a.alias("factor"), n.alias("points")))


@query(f"""WITH {LOG}, {STREAK}, {DONE}, {SPEED}, {RUNS}, g AS (SELECT n, count(*) AS seeds, count(done_step) AS completed, 1.0e0 / avg(sec_per_step) AS hz, min(k_min) AS k_min, avg(k_avg) AS k_avg, max(k_max) AS k_max, avg(triangles) AS tri_mean, stddev_pop(triangles) AS tri_std, avg(done_step) AS goal FROM rn GROUP BY n)
SELECT n, seeds, completed, {q6('hz')} AS hz, k_min, {q6('k_avg')} AS k_avg, k_max, {q6('tri_mean')} AS tri_mean, {q6('tri_std')} AS tri_std, {q6('goal')} AS goal, {q6('CASE WHEN goal > 0 AND tri_mean > 0 THEN tri_mean / goal * 1e6 END')} AS efficiency FROM g""")
def monitor_by_n(spark, sf_dir):
    return rounded(N.by_size(_runs(spark, sf_dir)))


@query(f"""WITH {LOG}, f AS (SELECT run_id, step, elapsed_sec, count(*) OVER w AS seen, regr_slope(k_avg, elapsed_sec) OVER w AS m, regr_intercept(k_avg, elapsed_sec) OVER w AS c FROM lg WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT run_id, step, seen, round(CASE WHEN seen >= 5 AND m > 1e-6 THEN 2 * (3.0e0 - c) / m - elapsed_sec END, 3) + 0.0e0 AS eta FROM f""")
def eta_sliding(spark, sf_dir):
    x = N.eta(_log(spark, sf_dir), RUN, 3.0)
    return x.withColumn("eta", F.round("eta", 3) + F.lit(0.0))


@query(f"""WITH {LOG}, {STREAK}, {DONE}, {SPEED}, {RUNS},
sm AS (SELECT regr_slope(ln(sec_per_step), ln(n)) AS b, exp(regr_intercept(ln(sec_per_step), ln(n))) AS a, max(n) AS top FROM rn WHERE sec_per_step > 0),
mm AS (SELECT n, avg(done_step) AS steps FROM rn WHERE done_step IS NOT NULL GROUP BY n), st2 AS (SELECT regr_slope(ln(steps), ln(n)) AS d, exp(regr_intercept(ln(steps), ln(n))) AS c FROM mm),
f AS (SELECT top * k AS n, a * pow(top * k, b) AS sec_per_step, c * pow(top * k, d) AS steps FROM sm, st2, (VALUES (4), (16)) t(k))
SELECT n, {q6('sec_per_step')} AS sec_per_step, {q6('steps')} AS steps, round(sec_per_step * steps, 3) AS seconds, rank() OVER (ORDER BY sec_per_step * steps) AS place FROM f""")
def forecast_rank(spark, sf_dir):
    x = N.forecast(_runs(spark, sf_dir), [4, 16])
    return rounded(x.withColumn("seconds", F.round("seconds", 3)))


@query(f"""WITH {X.snapshots_sql()}, c AS (SELECT 0 AS run_id, step, count(*) AS stored FROM e GROUP BY step), m AS (SELECT run_id, step, stored + CASE WHEN step = 2 THEN 1 ELSE 0 END AS edges FROM c)
SELECT CAST(run_id AS BIGINT) AS run_id, CAST(step AS BIGINT) AS step, edges, stored, edges != stored AS mismatch, max(CAST(edges != stored AS INT)) OVER (ORDER BY step) = 0 AS keep FROM m JOIN c USING (run_id, step)""")
def integrity_check(spark, sf_dir):
    _, e = X.snapshots(spark, sf_dir)
    counts = e.groupBy(F.lit(0).alias("run_id"), "step").agg(F.count("*").alias("edges"))
    return rounded(S.integrity(counts.withColumn("edges", F.col("edges") + (F.col("step") == 2).cast("long")), counts, RUN))


SESSIONS = """SELECT user_id AS run_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS "end", count(*) AS n_rows FROM (
  SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 DAY >= ts THEN 0 ELSE 1 END AS new FROM events) x) y GROUP BY user_id, s"""
SESSIONS = f"""SELECT run_id, epoch_us(start) AS start_us, epoch_us("end") AS end_us, n_rows FROM ({SESSIONS}) z"""


def _micros(df):
    return df.select("run_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_rows")


@query(SESSIONS)
def sessions_active(spark, sf_dir):
    X.tables(spark, sf_dir, "events")
    return _micros(N.sessions(spark.table("events").withColumnRenamed("user_id", "run_id"), RUN, gap_seconds=86400))


@query(SESSIONS.replace("FROM events", "FROM (SELECT * FROM events)"))
def stream_sessions(spark, sf_dir):
    from ..streaming import live

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    log = live.tail(spark, f"{sf_dir}/event[s].parquet", schema).withColumnRenamed("user_id", "run_id")
    return _micros(live.drain(live.activity(log, RUN, gap="86400 seconds", lateness="0 seconds"), "complete").drop("batch"))


@query("""SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n_rows, (round(sum(value), 4) + 0.0e0) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark, sf_dir):
    from ..streaming import live

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    x = live.drain(live.tumbling(live.tail(spark, f"{sf_dir}/event[s].parquet", schema), ["event_type"], "value"), "complete")
    return x.select(F.unix_micros("start").alias("start_us"), "event_type", "n_rows", (F.round("total", 4) + F.lit(0.0)).alias("total"))


def _stored_log(spark, sf_dir):
    """The log as files that a stream can read."""
    import uuid

    from ..session import shared_folder, stored

    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    stored.append(path)
    log = _log(spark, sf_dir)
    log.write.parquet(path)
    return path, log.schema


@query(f"WITH {LOG}, {STREAK}, {DONE} SELECT run_id, max(step) AS last_step, arg_max(streak, step) AS streak, min(done_step) AS done_step FROM st JOIN dn USING (run_id) GROUP BY run_id")
def stream_streaks(spark, sf_dir):
    from ..streaming import live

    path, schema = _stored_log(spark, sf_dir)
    return rounded(live.latest_state(live.drain(live.streaks(live.tail(spark, path, schema)), "update"), RUN))


@query(f"""WITH {LOG}, p AS (
  SELECT 'runs/E' || engine_id || '/N' || n || '/S' || seed || '/data/E' || engine_id || '_N' || n || '_S' || seed || '_iter_' || substr(z, 1, 3) || '_' || substr(z, 4, 3) || '_' || substr(z, 7, 3) || '_nodes.csv' AS path, engine_id, n, seed, step
  FROM (SELECT *, lpad(CAST(step * 1000 AS VARCHAR), 9, '0') AS z FROM lg) x)
SELECT path, engine_id AS engine, n, seed, step * 1000 AS step FROM p""")
def path_metadata(spark, sf_dir):
    log = _log(spark, sf_dir)
    tag = F.concat(F.lit("E"), "engine_id", F.lit("_N"), "n", F.lit("_S"), "seed")
    path = F.concat(F.lit("runs/E"), "engine_id", F.lit("/N"), "n", F.lit("/S"), "seed", F.lit("/data/"), tag, F.lit("_iter_"), T.step_label(F.col("step") * 1000), F.lit("_nodes.csv"))
    x = log.select(path.alias("path"))
    meta = T.path_metadata(F.col("path"))
    return rounded(x.select("path", meta["engine"].alias("engine"), meta["n"].alias("n"), meta["seed"].alias("seed"), T.step_of(F.col("path")).alias("step")))


@query(f"""WITH {LOG}, {STREAK}, {DONE}, r AS (SELECT run_id, max(step) AS step, arg_max(k_avg, step) AS k, arg_max(streak, step) AS streak, max(elapsed_sec) AS sec FROM st GROUP BY run_id)
SELECT run_id, CASE WHEN step >= 1000 THEN format('{{:.1f}}K', step / 1000.0) ELSE CAST(step AS VARCHAR) END AS steps_text, CASE WHEN k < 3.0e0 THEN printf('%.1f%%', 100 * k / 3.0e0) ELSE printf('%d/%d', streak, 10) END AS progress,
  CASE WHEN sec IS NULL OR sec < 0 THEN '---' ELSE (CASE WHEN floor(sec / 86400) = 1 THEN '1 day, ' WHEN floor(sec / 86400) > 1 THEN CAST(CAST(floor(sec / 86400) AS BIGINT) AS VARCHAR) || ' days, ' ELSE '' END) || printf('%d:%02d:%02d', CAST(floor(CAST(floor(sec) AS BIGINT) % 86400 / 3600) AS BIGINT), CAST(floor(CAST(floor(sec) AS BIGINT) % 3600 / 60) AS BIGINT), CAST(floor(sec) AS BIGINT) % 60) END AS age,
  run_id || ':' || step AS label FROM r""")
def labels_text(spark, sf_dir):
    s = S.streaks(_log(spark, sf_dir), RUN)
    r = s.groupBy("run_id").agg(F.max("step").alias("step"), F.max_by("k_avg", "step").alias("k"), F.max_by("streak", "step").alias("streak"), F.max("elapsed_sec").alias("sec"))
    return r.select("run_id", T.short_number(F.col("step")).alias("steps_text"), T.target_label(F.col("k"), F.col("streak")).alias("progress"), T.duration(F.col("sec")).alias("age"), T.joined(F.col("run_id"), F.col("step")).alias("label"))


@query(f"""WITH {LOG}, c AS (SELECT n, run_id, count(*) AS files FROM lg GROUP BY ALL) SELECT n, count(*) AS found, count(*) FILTER (WHERE files >= 66) AS valid, CASE WHEN count(*) FILTER (WHERE files >= 66) = 0 THEN 'EMPTY' WHEN count(*) FILTER (WHERE files >= 66) < count(*) THEN 'PARTIAL' ELSE 'OK' END AS status FROM c GROUP BY n""")
def found_counts(spark, sf_dir):
    c = _log(spark, sf_dir).groupBy("n", "run_id").agg(F.count("*").alias("files"))
    return S.found_counts(c, ["n"], "files", 66)
