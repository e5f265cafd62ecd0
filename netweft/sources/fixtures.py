"""Graph-, log- and series-shaped views over the driver's tables, in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed

#: Steps of the growing network: four early months, and one after all orders.
ALL = 1200
STEPS = (0, 2, 5, 11, ALL)

PART_NODES = """SELECT p_partkey AS node_id, p_size / 50e0 - 0.5e0 AS psi_re, ((p_partkey * 31) % 100) / 100e0 - 0.5e0 AS psi_im FROM part"""

_PART_EDGES = """SELECT src, dst, CAST(birth AS INT) AS birth, ((src * 7919 + dst * 104729) % 6283) / 1000e0 - 3.1415e0 AS theta
FROM (SELECT a.l_partkey AS src, b.l_partkey AS dst, min(12 * (year(o.o_orderdate) - 1995) + month(o.o_orderdate) - 1) AS birth
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
      JOIN orders o ON o.o_orderkey = a.l_orderkey
      GROUP BY a.l_partkey, b.l_partkey) x"""


def part_edges_sql() -> str:
    """Parts bought together in any order, with the first month of that."""
    return _PART_EDGES


_RUN_LOG = """SELECT user_id AS run_id, CAST((user_id % 2) + 1 AS BIGINT) AS engine_id, CAST(100 * power(2, user_id % 5) AS BIGINT) AS n, 1000 + user_id AS seed,
       CAST(100 * rn AS BIGINT) AS step, elapsed_sec, CASE WHEN elapsed_sec > 0 THEN 100 * rn / elapsed_sec END AS sps,
       CAST(greatest(types - 2, 0) AS BIGINT) AS k_min, types * 0.6e0 AS k_avg, types AS k_max,
       CAST(types * (types - 1) * (types - 2) / 6 AS BIGINT) AS triangles
FROM (SELECT user_id, ts, rn, {epochs} AS elapsed_sec,
             CAST(sum(CASE WHEN trn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS types
      FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
                   row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS trn,
                   min(ts) OVER (PARTITION BY user_id) AS t0
            FROM events) a) b"""

RUN_LOG_DUCKDB = _RUN_LOG.format(epochs="(epoch_us(ts) - epoch_us(t0)) / 1000000e0")
RUN_LOG_SPARK = _RUN_LOG.format(epochs="(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(t0 AS TIMESTAMP))) / 1000000e0")

VEC_DUCKDB = """SELECT a.vec_id AS src, b.vec_id AS dst, ((a.vec_id * 7919 + b.vec_id * 104729) % 6283) / 1000e0 - 3.1415e0 AS theta FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > {cos}e0"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "part")
    return spark.sql(PART_NODES)


#: Lines of a task in which the lines of an order meet; their pairs go to twice as many tasks.
LINES = 500_000


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``part_edges_sql``, in tasks whose number grows with the lines, so that a task's share of pairs doesn't."""
    tables(spark, sf_dir, "lineitem", "orders")
    lines = spark.table("lineitem")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES))
    lines = lines.select("l_orderkey", "l_partkey").repartition(n, "l_orderkey")
    orders = spark.table("orders").selectExpr("o_orderkey AS l_orderkey", "12 * (year(o_orderdate) - 1995) + month(o_orderdate) - 1 AS birth").repartition(n, "l_orderkey")
    pairs = lines.withColumnRenamed("l_partkey", "src").join(lines.withColumnRenamed("l_partkey", "dst"), "l_orderkey").where("src < dst").join(orders, "l_orderkey")
    # Hardly a pair is met twice in a task before the pairs are dealt, so they are summed after that alone.
    found = pairs.select("src", "dst", "birth").repartition(2 * n, "src", "dst").groupBy("src", "dst").agg(F.min("birth").alias("birth"))
    theta = (F.col("src") * 7919 + F.col("dst") * 104729) % 6283 / 1000 - 3.1415
    return found.select("src", "dst", F.col("birth").cast("int").alias("birth"), theta.alias("theta"))


def snapshots(spark: SparkSession, sf_dir: str, steps: tuple[int, ...] = STEPS) -> tuple[DataFrame, DataFrame]:
    """A growing network: nodes and edges keyed by step."""
    frame = spark.createDataFrame([(s,) for s in steps], "step int")
    nodes = part_nodes(spark, sf_dir).crossJoin(frame)
    edges = part_edges(spark, sf_dir).join(frame, on=_born()).select("step", "src", "dst", "theta")
    return nodes, edges


def _born():
    return F.col("birth") <= F.col("step")


def snapshots_sql(steps: tuple[int, ...] = STEPS) -> str:
    """CTEs v(step, node_id, psi_re, psi_im), e(step, src, dst, theta) and arcs(step, src, dst, theta)."""
    values = ", ".join(f"({s})" for s in steps)
    return f"""steps(step) AS (VALUES {values}),
v AS (SELECT step, n.* FROM ({PART_NODES}) n, steps),
e AS (SELECT step, src, dst, theta FROM ({part_edges_sql()}) x JOIN steps ON birth <= step),
arcs AS (SELECT * FROM e UNION ALL SELECT step, dst, src, -theta FROM e)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(RUN_LOG_SPARK)


#: Vectors of a block: two blocks' cosines are one matrix product of bounded size.
BLOCK = 2048


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors once for each pair of blocks (``low``, ``high``) that theirs is in."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    blocks = max(1, -(-v.count() // BLOCK))
    mine = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("x")
    dealt = v.select("vec_id", "embedding", mine).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.select("vec_id", "embedding", "x", F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"))


def vec_edges(spark: SparkSession, sf_dir: str, cos: float = 0.25, keep: bool = False) -> DataFrame:
    """Embedding pairs above a cosine, stored, with the cosine if ``keep``. Exact, by matrix products of blocks of vectors; only pairs above the cosine leave them."""
    dealt = _dealt(spark, sf_dir)

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.array(pdf["embedding"].tolist(), float)
        e /= np.linalg.norm(e, axis=1, keepdims=True)
        ids, x = pdf["vec_id"].to_numpy(), pdf["x"].to_numpy()
        one, two = x == pdf["low"].iloc[0], x == pdf["high"].iloc[0]
        product = e[one] @ e[two].T
        i, j = np.nonzero(product > cos)
        a, b = ids[one][i], ids[two][j]
        if pdf["low"].iloc[0] == pdf["high"].iloc[0]:
            i, j, a, b = i[a < b], j[a < b], a[a < b], b[a < b]
        return pd.DataFrame({"src": np.minimum(a, b), "dst": np.maximum(a, b), "cos": product[i, j]})

    pairs = dealt.groupBy("low", "high").applyInPandas(near, "src long, dst long, cos double")
    theta = (F.col("src") * 7919 + F.col("dst") * 104729) % 6283 / 1000 - 3.1415
    return checkpointed(pairs.select("src", "dst", theta.alias("theta"), *(["cos"] if keep else [])))


def vec_cells(spark: SparkSession, sf_dir: str, levels: tuple[float, ...]) -> DataFrame:
    """``step, a, b, ids_a, ids_b, cells``: the graphs of ``vec_edges`` above each cosine of ``levels`` (steps 0..), packed by pairs of blocks as ``landmarks.cells`` has them.

    An edge is two bytes in the row of its blocks, not a row. Every block has a row with itself; its ids rise.
    """
    from ..operators.landmarks import pack

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        e = np.array(pdf["embedding"].tolist(), float)
        e /= np.linalg.norm(e, axis=1, keepdims=True)
        ids, x, low, high = pdf["vec_id"].to_numpy(), pdf["x"].to_numpy(), int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        one, two = x == low, x == high
        product = e[one] @ e[two].T
        if low == high:
            product = np.where(ids[one][:, None] < ids[two], product, -2.0)
        rows = [(k, low, high, ids[one].tolist(), ids[two].tolist(), pack(product > cos)) for k, cos in enumerate(levels)]
        return pd.DataFrame(rows, columns=["step", "a", "b", "ids_a", "ids_b", "cells"])

    return checkpointed(_dealt(spark, sf_dir).groupBy("low", "high").applyInPandas(near, "step int, a int, b int, ids_a array<long>, ids_b array<long>, cells binary"))


def vec_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "embeddings")
    return spark.sql("SELECT vec_id AS node_id, CAST(embedding[0] AS DOUBLE) AS psi_re, CAST(embedding[1] AS DOUBLE) AS psi_im FROM embeddings")
