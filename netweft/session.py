"""A session with the settings that the operators are written for."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("NETWEFT_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_own_folder: list[str] = []
#: Tables that this process has stored in the shared folder and not removed.
stored: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode only, where it is unset, a temporary one that goes with the process."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="netweft-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written once to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    stored.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Remove a stored table."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    if path in stored:
        stored.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that are stored inside are removed at the end, but for those put in the list that is given.

    A query's result reads its stored tables, so whoever writes the result decides when they go:
    ``with scratch(spark): query(spark, folder).write.parquet(there)``.
    """
    before: set[str] = set(stored)
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        for path in [x for x in stored if x not in before and x not in [t.stored_at for t in kept]]:
            remove(spark, path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """The rows over all cores, by columns if given: for heavy kernels on few bytes, whose partitions would else be merged."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *columns) if columns else df.repartition(n)


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies, whatever folder the driver was started in."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, here) if x)
