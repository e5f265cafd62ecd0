"""Queries over stored rows of runs: file listings, field records, moves, live trends, and metrics that are kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.amplitude import temperature
from ..operators import growth as W
from ..operators import monitor as N
from ..operators import observables as O
from ..operators import stability as B
from ..operators import sweep as P
from ..session import checkpointed, shared_folder, stored
from ..sources import fixtures as X
from ..sources import snapshots as S
from .graphs import q6, rounded
from .runs import DONE, LOG, STREAK, _log

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- file listings ------------------------------------------------------------------------------------

FILES = f"""{LOG}, fl AS (SELECT engine_id AS engine, n, seed, step * 1000 AS step, make_timestamp(1735689600000000 + CAST(round(elapsed_sec * 1000000) AS BIGINT)) AS mtime FROM lg)"""


def _listing(spark, sf_dir):
    """The log's rows as a listing of snapshot files, written when their row was."""
    log = _log(spark, sf_dir)
    tag = F.concat(F.lit("E"), "engine_id", F.lit("_N"), "n", F.lit("_S"), "seed")
    path = F.concat(F.lit("runs/E"), "engine_id", F.lit("/N"), "n", F.lit("/S"), "seed", F.lit("/data/"), tag, F.lit("_iter_"), T.step_label(F.col("step") * 1000), F.lit("_nodes.csv"))
    return log.select(path.alias("path"), F.timestamp_micros(F.lit(1735689600000000) + F.round(F.col("elapsed_sec") * 1000000).cast("long")).alias("mtime"))


@query(f"""WITH {FILES}, g AS (SELECT engine, n, seed, count(*) AS files, arg_min(step, (mtime, step)) AS s0, arg_max(step, (mtime, step)) AS s1, (epoch_us(max(mtime)) - epoch_us(min(mtime))) / 1000000e0 AS seconds FROM fl GROUP BY ALL)
SELECT engine, n, seed, files, s1, {q6('seconds')} AS seconds, {q6('CASE WHEN s1 != s0 THEN seconds / (s1 - s0) END')} AS sec_per_step FROM g WHERE files >= 2 AND seconds > 0.1e0""")
def file_timing(spark, sf_dir):
    """Seconds per step of each run from its files' times."""
    return rounded(S.file_timing(_listing(spark, sf_dir)))


@query(f"WITH {FILES} SELECT DISTINCT engine FROM fl")
def engine_list(spark, sf_dir):
    return S.engines(_listing(spark, sf_dir))


@query(f"WITH {FILES} SELECT engine, n, epoch_us(min(mtime)) AS first_us, strftime(min(mtime), '%Y-%m-%d %H:%M') AS label FROM fl GROUP BY engine, n")
def earliest_snapshot(spark, sf_dir):
    """Of each engine and size the time of the first written snapshot."""
    return S.earliest(S.steps(_listing(spark, sf_dir))).select("engine", "n", F.unix_micros("first").alias("first_us"), "label")


# -- field records ------------------------------------------------------------------------------------

#: Users are nodes, days are times, a user's distance from the source is its id modulo 12.
RECORDS = "rc AS (SELECT CAST(day(ts) AS BIGINT) AS t, user_id AS node_id, avg(value) / 100.0e0 AS psi_re, avg(event_id % 7) / 7.0e0 AS psi_im, avg(event_id % 5) AS curvature FROM events GROUP BY 1, 2), ds AS (SELECT DISTINCT user_id AS node_id, user_id % 12 AS d FROM events)"


def _records(spark, sf_dir):
    X.tables(spark, sf_dir, "events")
    return spark.sql(f"WITH {RECORDS} SELECT * FROM rc"), spark.sql(f"WITH {RECORDS} SELECT * FROM ds")


@query(f"""WITH {RECORDS}, m AS (SELECT t, node_id, sqrt(psi_re * psi_re + psi_im * psi_im) AS m FROM rc), b AS (SELECT node_id, arg_min(m, t) AS base FROM m GROUP BY node_id),
c AS (SELECT t, d, avg(m - base) AS value FROM m JOIN b USING (node_id) JOIN ds USING (node_id) GROUP BY t, d),
u AS (SELECT t, d, sum(abs(value)) OVER (PARTITION BY t ORDER BY d) AS upto, sum(abs(value)) OVER (PARTITION BY t) AS total FROM c)
SELECT t, min(d) FILTER (WHERE total > 1e-12 AND upto >= 0.8e0 * total) AS radius FROM u WHERE t > 1 GROUP BY t""")
def lightcone(spark, sf_dir):
    """The front's radius at each time, of the records' change since the first."""
    records, dist = _records(spark, sf_dir)
    return rounded(O.front_radius(O.light_cone(records, dist).where("t > 1")))


_HALF = "avg(psi_re * psi_re + psi_im * psi_im) FILTER (WHERE t {0}) AS r{1}, avg(curvature) FILTER (WHERE t {0}) AS c{1}, count(*) FILTER (WHERE t {0}) AS n{1}"


@query(f"""WITH {RECORDS}, s AS (SELECT d, {_HALF.format('<= 15', 0)}, {_HALF.format('> 15', 1)} FROM rc JOIN ds USING (node_id) GROUP BY d)
SELECT count(*) AS shells, {q6('corr(c1 - c0, r1 - r0)')} AS r FROM s WHERE n0 >= 8 AND n1 > 0""")
def quench_response(spark, sf_dir):
    """Correlation of the changes of density and curvature profiles, the month's second half against its first."""
    records, dist = _records(spark, sf_dir)
    rho = F.avg(F.col("psi_re") * F.col("psi_re") + F.col("psi_im") * F.col("psi_im"))
    x = records.join(dist, "node_id")
    half = lambda w: x.where(w).groupBy("d").agg(F.count("*").alias("nodes"), rho.alias("mean_rho"), F.avg("curvature").alias("c"))
    before, after = half("t <= 15"), half("t > 15")
    curvature = before.select("d", F.col("c").alias("before")).join(after.select("d", F.col("c").alias("after")), "d")
    return rounded(O.quench_response(before, after, curvature))


@query(f"SELECT user_id % 3 AS engine, event_type, {q6('avg(CASE WHEN event_id % 4 = 1 THEN 1.0e0 ELSE 0.0e0 END)')} AS ratio FROM events GROUP BY ALL")
def acceptance_ratio(spark, sf_dir):
    """Accepted moves over all, of a table of moves by engine and kind."""
    X.tables(spark, sf_dir, "events")
    moves = spark.table("events").select((F.col("user_id") % 3).alias("engine"), "event_type", (F.col("event_id") % 4 == 1).alias("accepted"))
    return rounded(N.acceptance(moves, ["engine", "event_type"]))


@query(f"WITH {LOG} SELECT run_id, step, round(greatest(0.2e0 * pow(0.9999e0, step), 1e-20), 9) AS temp FROM lg")
def temperature_schedule(spark, sf_dir):
    """The annealing temperature at every logged step."""
    return _log(spark, sf_dir).select("run_id", "step", F.round(temperature(F.col("step"), 0.2, 0.9999), 9).alias("temp"))


@query(f"""WITH {LOG}, {STREAK}, {DONE}, e AS (SELECT run_id, max(step) AS steps, arg_max(k_avg, step) AS k_avg, arg_max(k_min, step) AS k_min, max(streak) AS streak FROM st GROUP BY run_id),
s AS (SELECT run_id, steps, CASE WHEN streak < 12 THEN 'TIMEOUT' WHEN k_avg >= 2.9e0 THEN CASE WHEN k_min >= 4 THEN 'CRYSTALLIZED' ELSE 'STABLE' END ELSE 'COLLAPSED' END AS status FROM e)
SELECT run_id, steps, status, status IN ('STABLE', 'CRYSTALLIZED') AS converged, row_number() OVER (ORDER BY status IN ('STABLE', 'CRYSTALLIZED') DESC, steps, run_id) AS place FROM s""")
def sweep_rank(spark, sf_dir):
    """The end states of all runs, converged ones first, then by steps."""
    x = B.streaks(_log(spark, sf_dir), ["run_id"])
    ends = x.groupBy("run_id").agg(F.max("step").alias("steps"), F.max_by("k_avg", "step").alias("k_avg"), F.max_by("k_min", "step").alias("k_min"), F.max("streak").alias("streak"))
    states = ends.select("run_id", "steps", P.status(F.lit(True), F.col("streak"), F.col("k_avg"), F.col("k_min"), 12, 2.9).alias("status"))
    return rounded(P.ranked(states))


# -- live ---------------------------------------------------------------------------------------------


def _as_files(spark, rows, parts: int):
    """Rows as ``parts`` files that a stream reads one after the other."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    stored.append(path)
    rows.repartitionByRange(parts, "step").sortWithinPartitions("step").write.parquet(path)
    return path


@query(f"""WITH {LOG}, f AS (SELECT run_id, step, elapsed_sec, count(*) OVER w AS seen, regr_slope(k_avg, elapsed_sec) OVER w AS m, regr_intercept(k_avg, elapsed_sec) OVER w AS c, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS back
  FROM lg WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT run_id, step AS last_step, seen, round(CASE WHEN seen >= 5 AND m > 1e-6 THEN 2 * (3.0e0 - c) / m - elapsed_sec END, 3) + 0.0e0 AS eta FROM f WHERE back = 1""")
def stream_trend(spark, sf_dir):
    """The log as a stream of files; each run's last twenty points are list state, and the remaining time follows from them."""
    from ..streaming import live

    log = _log(spark, sf_dir).select("run_id", "step", "elapsed_sec", "k_avg")
    x = live.latest_state(live.drain(live.trends(live.tail(spark, _as_files(spark, log, 4), log.schema)), "update"), ["run_id"])
    return x.select("run_id", "last_step", "seen", (F.round("eta", 3) + F.lit(0.0)).alias("eta"))


@query("""WITH g AS (SELECT user_id, event_id, ts, ts + to_seconds(greatest(10, 2 * 3600 * (1 + event_id % 24))) AS stop FROM events),
b AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
s AS (SELECT *, sum(CASE WHEN before >= ts THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM b)
SELECT user_id AS run_id, epoch_us(min(ts)) AS start_us, epoch_us(max(stop)) AS end_us, count(*) AS n_rows FROM s GROUP BY user_id, session""")
def stream_adaptive(spark, sf_dir):
    """Sessions of activity whose gap is twice the row's own update interval, as a stream."""
    from ..streaming import live

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    log = live.tail(spark, f"{sf_dir}/event[s].parquet", schema).withColumn("interval", (3600 * (1 + F.col("event_id") % 24)).cast("double")).withColumnRenamed("user_id", "run_id")
    x = live.drain(live.adaptive_activity(log, ["run_id"], "interval", lateness="0 seconds"), "complete")
    return x.select("run_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_rows")


# -- metrics that are kept up to date -----------------------------------------------------------------


def _step_metrics(edges):
    """Edges, nodes with an edge and the largest degree of each step."""
    from ..operators import graph as G

    d = G.degrees(edges, ["step"])
    return d.groupBy("step").agg((F.sum("d") / 2).cast("long").alias("edges"), F.count("*").alias("linked"), F.max("d").alias("max_degree"))


@query(f"""WITH {X.snapshots_sql()}, dg AS (SELECT step, src AS node_id, count(*) AS d FROM arcs GROUP BY ALL), m AS (SELECT step, CAST(sum(d) / 2 AS BIGINT) AS edges, count(*) AS linked, max(d) AS max_degree FROM dg GROUP BY step)
SELECT CAST(0 AS BIGINT) AS run_id, CAST(step AS BIGINT) AS step, edges, linked, CASE WHEN step > 2 THEN max_degree END AS max_degree FROM m""")
def incremental_metrics(spark, sf_dir):
    """Metrics of stored snapshots, of which three steps have some already.

    The stored ones are checked against the snapshots: step 5 has a wrong count and goes. Only the partitions of the missing steps are read
    again. The new metrics have a column that the old ones lack, so it is null for steps 0 and 2.
    """
    folder = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    stored.append(folder)
    edges = W.at_steps(W.born(checkpointed(X.part_edges(spark, sf_dir)), X.STEPS), X.STEPS)
    S.write_table(edges.select("step", "src", "dst"), f"{folder}/edges", "overwrite")
    snapshots = spark.read.parquet(f"{folder}/edges")
    old = _step_metrics(snapshots.where("step <= 5")).select(F.lit(0).alias("run_id"), "step", (F.col("edges") + (F.col("step") == 5).cast("long")).alias("edges"), "linked")
    old.write.parquet(f"{folder}/metrics")
    S.refresh(spark, f"{folder}/edges", f"{folder}/metrics", lambda rows: _step_metrics(rows).withColumn("run_id", F.lit(0)), ["run_id"])
    return rounded(spark.read.parquet(f"{folder}/metrics").select("run_id", "step", "edges", "linked", "max_degree"))

