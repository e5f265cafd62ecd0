"""Live logs as streams: activity sessions, interval metrics, streaks and trends with state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructType

from ..session import shared_folder, stored

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tail(spark: SparkSession, path: str, schema: StructType, format: str = "parquet") -> DataFrame:
    """Rows of files as they appear; a path of a single file has to be a glob pattern."""
    return spark.readStream.schema(schema).format(format).load(path)


def activity(log: DataFrame, keys: list[str], ts: str = "ts", gap: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Sessions of each run: rows less than a gap apart."""
    x = log.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", lateness)
    return x.groupBy(*keys, F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n_rows")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_rows")


def adaptive_activity(log: DataFrame, keys: list[str], interval: str, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """As ``activity`` with a gap of max(10 s, twice the row's update interval in seconds)."""
    x = log.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", lateness)
    gap = F.concat(F.greatest(F.lit(10.0), 2 * F.col(interval)).cast("long").cast("string"), F.lit(" seconds"))
    return x.groupBy(*keys, F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n_rows")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_rows")


def tumbling(log: DataFrame, by: list[str], value: str, ts: str = "ts", width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    x = log.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", lateness)
    return x.groupBy(F.window("at", width).alias("w"), *by).agg(F.count("*").alias("n_rows"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n_rows", "total")


class Streak(StatefulProcessor):
    """Per run the length of the current run of equal quantised degrees and the first step that meets the goals."""

    goal, min_degree, mean_degree = 10, 2, 2.8

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "level long, streak long, done long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        level, streak, done, last = self.state.get() if self.state.exists() else (None, 0, None, None)
        # Rows of one batch come in any order; steps that were seen already are not counted again.
        for step, k_min, k_avg in pd.concat(list(rows)).sort_values("step")[["step", "k_min", "k_avg"]].itertuples(index=False):
            if last is not None and step <= last:
                continue
            own = int(k_avg * 1000)
            streak, level, last = (streak + 1 if own == level else 1), own, int(step)
            if done is None and streak >= self.goal and k_min >= self.min_degree and k_avg >= self.mean_degree:
                done = int(step)
        if last is not None:
            self.state.update((level, streak, done, last))
            yield pd.DataFrame({"run_id": [key[0]], "last_step": [last], "streak": [streak], "done_step": pd.array([done], dtype="Int64")})

    def close(self) -> None:
        pass


def streaks(log: DataFrame) -> DataFrame:
    """``run_id, last_step, streak, done_step`` after each batch, from run_id, step, k_min, k_avg; needs the RocksDB state store."""
    return log.select("run_id", "step", "k_min", "k_avg").groupBy("run_id").transformWithStateInPandas(Streak(), "run_id long, last_step long, streak long, done_step long", "Update", "None")


class Trend(StatefulProcessor):
    """Per run the last points and the remaining time by a regression over them."""

    points, least, target = 20, 5, 3.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("points", "step long, elapsed double, k double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.state.get()] if self.state.exists() else []
        new = [tuple(x) for f in rows for x in f[["step", "elapsed_sec", "k_avg"]].itertuples(index=False)]
        held = sorted({x[0]: x for x in [*held, *new]}.values())[-self.points :]
        self.state.put([(int(s), float(e), float(k)) for s, e, k in held])
        eta = None
        if len(held) >= self.least:
            e, k = pd.Series([x[1] for x in held]), pd.Series([x[2] for x in held])
            spread = ((e - e.mean()) ** 2).sum()
            m = ((e - e.mean()) * (k - k.mean())).sum() / spread if spread > 0 else 0.0
            if m > 1e-6:
                eta = float(2 * (self.target - (k.mean() - m * e.mean())) / m - e.iloc[-1])
        yield pd.DataFrame({"run_id": [key[0]], "last_step": [held[-1][0]], "seen": [len(held)], "eta": [eta]})

    def close(self) -> None:
        pass


def trends(log: DataFrame) -> DataFrame:
    """``run_id, last_step, seen, eta`` after each batch, from run_id, step, elapsed_sec, k_avg."""
    return log.select("run_id", "step", "elapsed_sec", "k_avg").groupBy("run_id").transformWithStateInPandas(Trend(), "run_id long, last_step long, seen long, eta double", "Update", "None")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives when all that its sources hold now has been read, as a table.

    The result goes through files of the shared folder, a batch each: nothing is collected.
    """
    spark = stream.sparkSession
    where = shared_folder(spark)
    out, state = f"{where}/stream-{uuid.uuid4().hex}", f"{where}/stream-state-{uuid.uuid4().hex}"
    stored.extend([out, state])

    def keep(batch: DataFrame, k: int) -> None:
        batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/batch_id={k}")

    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.read.schema(StructType([*stream.schema.fields]).add("batch", IntegerType())).option("recursiveFileLookup", True).parquet(out)


def latest_state(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of updates by batch the last of each key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")
