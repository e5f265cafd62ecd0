"""Snapshot, log and metric files: readers, writers and listings over any store that Spark reads."""

from __future__ import annotations

import difflib
import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from . import schema as S


#: Where a reader that tolerates faults leaves a line that isn't a row.
CORRUPT = "corrupt_line"


def _read(spark: SparkSession, path: str, kind: str, struct, tolerant: bool) -> DataFrame:
    """Rows of snapshot files (plain or gzip) with their ``file``; a tolerant reader keeps faulty lines apart and goes on after files that can't be read."""
    reader = spark.read.option("header", True).option("enforceSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*_{kind}.{{csv,part*.csv}}*")
    if not tolerant:
        return reader.option("mode", "FAILFAST").schema(struct).csv(path).withColumn("file", F.col("_metadata.file_path"))
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return reader.schema(StructType([*struct.fields, StructField(CORRUPT, StringType())])).csv(path).withColumn("file", F.col("_metadata.file_path"))


def _table(spark: SparkSession, path: str, kind: str, struct, tolerant: bool) -> DataFrame:
    rows = _read(spark, path, kind, struct, tolerant)
    if tolerant:
        rows = rows.where(F.col(CORRUPT).isNull())
    meta = T.path_metadata(F.col("file"))
    return rows.select(meta["engine"].alias("engine"), meta["n"].alias("n"), meta["seed"].alias("seed"), T.step_of(F.col("file"), kind).alias("step"), *struct.names)


def faults(spark: SparkSession, path: str, kind: str = "edges") -> DataFrame:
    """``engine, n, seed, step, file, length, lines, faulty, status`` of every snapshot file of a kind.

    ``status``: ``empty`` (no bytes, or a header alone), ``unreadable`` (bytes, but no line that a reader can get out of them),
    ``faulty`` (lines that aren't rows, or a file that breaks off), ``good``.
    """
    files = listing(spark, path, f"*_{kind}.{{csv,part*.csv}}*").select(F.col("path").alias("file"), "length")
    # Spark's scans pass over files of no bytes; their names are in its index alone.
    index = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*_{kind}.{{csv,part*.csv}}*").text(path).inputFiles()
    plain = lambda c: F.regexp_replace(F.url_decode(c), "^file:/+", "file:///")
    names = spark.createDataFrame([(x,) for x in index], "file string").withColumn("plain", plain("file"))
    none = names.join(files.select(plain("file").alias("plain")), "plain", "left_anti").select("file", F.lit(0).cast("long").alias("length"))
    files = files.unionByName(none)
    struct = S.EDGES if kind == "edges" else S.NODES
    rows = _read(spark, path, kind, struct, True)
    # A line is checked by the columns that are asked for, so all are.
    asked = F.xxhash64(*struct.names) >= F.lit(-(1 << 63))  # holds for every line
    read = rows.groupBy("file").agg(F.count_if(asked).alias("lines"), F.count(CORRUPT).alias("faulty"))
    # A header alone leaves no rows but is text; what can't be unpacked or decoded leaves nothing at all.
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*_{kind}.{{csv,part*.csv}}*").option("ignoreCorruptFiles", True).text(path)
    seen = text.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("raw"))
    decoded = lambda d: d.withColumn("file", F.url_decode("file"))
    all_files = decoded(files).join(decoded(read), "file", "left").join(decoded(seen), "file", "left").na.fill(0, ["lines", "faulty", "raw"])
    status = F.when((F.col("length") == 0) | ((F.col("raw") > 0) & (F.col("lines") == 0)), "empty").when(F.col("raw") == 0, "unreadable").when(F.col("faulty") > 0, "faulty").otherwise("good")
    meta = T.path_metadata(F.col("file"))
    step = T.step_of(F.regexp_replace("file", r"\.gz$", ""), kind)
    return all_files.select(meta["engine"].alias("engine"), meta["n"].alias("n"), meta["seed"].alias("seed"), step.alias("step"), "file", "length", "lines", "faulty", status.alias("status"))


def snapshot_faults(files: DataFrame) -> DataFrame:
    """``engine, n, seed, step, lines, faulty, status`` of snapshots from the rows of their files: the worst of its parts' states, ``empty`` if all are."""
    is_ = lambda s: F.bool_or(F.col("status") == s)
    status = F.when(is_("unreadable"), "unreadable").when(is_("faulty"), "faulty").when(is_("good"), "good").otherwise("empty")
    return files.groupBy(*RUN, "step").agg(F.sum("lines").alias("lines"), F.sum("faulty").alias("faulty"), status.alias("status"))


def read_nodes(spark: SparkSession, path: str, tolerant: bool = False, within: bool = True) -> DataFrame:
    """Node snapshots below a folder, columns by position; ids of at least the run's N are dropped if ``within``."""
    rows = _table(spark, path, "nodes", S.NODES, tolerant).where("node_id IS NOT NULL")
    return rows.where((F.col("node_id") < F.col("n")) | (F.col("n") == 0)) if within else rows


def read_edges(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Edge snapshots below a folder, each edge once with src < dst."""
    rows = _table(spark, path, "edges", S.EDGES, tolerant).where("src IS NOT NULL AND dst IS NOT NULL AND src != dst")
    flip = F.col("src") > F.col("dst")
    return rows.withColumns({"theta": F.when(flip, -F.col("theta")).otherwise(F.col("theta")), "src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def read_legacy_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge files ``edges_step_<n>.csv`` of the older layout."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "edges_step_*.csv").schema(S.EDGES).csv(path).withColumn("file", F.col("_metadata.file_path"))
    meta = T.legacy_metadata(F.col("file"))
    return rows.select(meta["n"].alias("n"), meta["seed"].alias("seed"), T.legacy_step_of(F.col("file")).alias("step"), "src", "dst", "theta")


def listing(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """``path, mtime, length`` of files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), "length")


#: What ends the names of a snapshot's further parts.
PART = r"\.part\d+\.csv(\.gz)?$"


def steps(files: DataFrame, kind: str = "nodes") -> DataFrame:
    """``engine, n, seed, step, path, mtime`` of snapshot files."""
    meta = T.path_metadata(F.col("path"))
    rows = files.select(meta["engine"].alias("engine"), meta["n"].alias("n"), meta["seed"].alias("seed"), T.step_of(F.col("path"), kind).alias("step"), "path", "mtime")
    # A snapshot's further parts are no files of their own here.
    return rows.where("step IS NOT NULL AND n > 0").where(~F.col("path").rlike(PART))


RUN = ["engine", "n", "seed"]


def paired(files: DataFrame) -> DataFrame:
    """Steps that have both files."""
    return steps(files, "nodes").join(steps(files, "edges").select(*RUN, "step"), [*RUN, "step"], "left_semi")


def latest(files: DataFrame, runs: DataFrame, none: int = -1) -> DataFrame:
    """The latest step of every run, ``none`` where it has no snapshot."""
    top = steps(files).groupBy(*RUN).agg(F.max("step").alias("step"))
    return runs.select(*RUN).join(top, RUN, "left").withColumn("step", F.coalesce("step", F.lit(none).cast("long")))


def final_snapshots(files: DataFrame) -> DataFrame:
    """Per run the edge file of the largest step that has a node file too."""
    both = steps(files, "edges").join(steps(files, "nodes").select(*RUN, "step"), [*RUN, "step"], "left_semi")
    return both.groupBy(*RUN).agg(F.max("step").alias("step"), F.max_by("path", "step").alias("path"))


def file_timing(files: DataFrame, least: float = 0.1) -> DataFrame:
    """Seconds per step between the first and last written snapshot of each run (two files and more than ``least`` seconds)."""
    g = steps(files).groupBy(*RUN).agg(
        F.count("*").alias("files"), F.min("mtime").alias("first"), F.max("mtime").alias("last"), F.min_by("step", F.struct("mtime", "step")).alias("s0"), F.max_by("step", F.struct("mtime", "step")).alias("s1"),
    )
    seconds = F.unix_micros("last") / 1e6 - F.unix_micros("first") / 1e6
    g = g.withColumn("seconds", seconds)
    return g.where((F.col("files") >= 2) & (F.col("seconds") > least)).select(*RUN, "files", "s1", "seconds", F.try_divide(F.col("seconds"), F.col("s1") - F.col("s0")).alias("sec_per_step"))


def engines(files: DataFrame) -> DataFrame:
    return steps(files).select("engine").distinct().orderBy("engine")


def rendered(files: DataFrame) -> DataFrame:
    """Steps of rendered frames, from names ``.._i<step>_k..``."""
    digits = F.regexp_extract("path", r"_i([\d_]+)_k", 1)
    return files.select("path", F.replace(F.nullif(digits, F.lit("")), F.lit("_"), F.lit("")).try_cast("long").alias("step")).where("step IS NOT NULL")


def newest(folders: DataFrame, chosen: str | None = None) -> DataFrame:
    """The folder named, else that changed last (``folder, mtime``)."""
    if chosen is not None:
        return folders.where(F.col("folder") == chosen).select("folder").limit(1)
    return folders.agg(F.max_by("folder", F.struct("mtime", "folder")).alias("folder"))


# -- logs -------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, at, value``: lines that aren't blank, and what orders them within their file; files are split as Spark sees fit."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("lineSep", "\n").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("value"))
    return rows.where(F.trim("value") != "")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all logs of all runs with their metadata and whether their log is completed; the logs of one run are united.

    Lines are read one by one, whatever a file's size. A file's first line (metadata, if it is a comment) is a minimum over blocks and
    places, its last three (completion) are the last three of its blocks' last three; both are joined back by file.
    """
    lines = _lines(spark, path)
    place = F.struct("block", "at")
    first = lines.groupBy("path").agg(F.min_by("value", place).alias("first"))
    last = lines
    for part in (["path", "block"], ["path"]):
        order = Window.partitionBy(*part).orderBy(F.col("block").desc(), F.col("at").desc())
        last = last.withColumn("k", F.row_number().over(order)).where("k <= 3").drop("k")
    done = last.groupBy("path").agg(F.bool_or(F.col("value").startswith("# COMPLETED")).alias("completed"))
    files = first.join(done, "path").select("path", F.when(F.col("first").startswith("#"), T.key_values(F.col("first"))).alias("metadata"), "completed")
    rows = lines.where(~F.col("value").startswith("#") & ~F.col("value").startswith("timestamp")).join(files, "path")
    meta = T.path_metadata(F.col("path"))
    cells = F.split("value", ",")
    typed = [F.get(cells, F.lit(k)).try_cast(s.dataType).alias(s.name) for k, s in enumerate(S.RUN_LOG)]
    run = [meta[c].alias(c) for c in RUN]
    return rows.select("path", *run, F.col("metadata")["start_step"].try_cast("long").alias("start_step"), "completed", *typed).where("step IS NOT NULL")


# -- sinks ------------------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by run and step, so that a reader of later steps opens only these."""
    df.write.mode(mode).partitionBy(*[c for c in (*RUN, "step") if c in df.columns]).parquet(path)


def write_snapshot_csv(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """One node and one edge CSV per (run, step) folder, for interchange."""
    for kind, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").option("header", True).partitionBy(*RUN, "step").csv(f"{folder}/{kind}")


def append_metrics(new: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose keys are not stored yet; if the columns differ, the union is written anew."""
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        new.write.parquet(path)
        return
    fresh = new.join(old.select(*keys), keys, "left_anti")
    if set(old.columns) == set(new.columns):
        fresh.select(*old.columns).write.mode("append").parquet(path)
        return
    from ..session import checkpointed

    checkpointed(old.unionByName(fresh, allowMissingColumns=True)).write.mode("overwrite").parquet(path)


def refresh(spark: SparkSession, snapshots: str, metrics: str, compute, keys: list[str]) -> None:
    """Bring stored metrics up to date with stored snapshots (partitioned by step): rows from a run's first wrong edge count on go, missing steps are computed.

    Counts of edges come from the files' footers; ``compute`` gets the rows of the missing steps' partitions alone.
    """
    from ..operators.stability import incremental, integrity
    from ..session import checkpointed

    rows = spark.read.parquet(snapshots)
    counts = checkpointed(rows.groupBy("step").agg(F.count("*").alias("edges")))
    old = spark.read.parquet(metrics)
    runs = old.select(*keys).distinct()
    wanted = counts.crossJoin(F.broadcast(runs)) if keys else counts  # a row per run
    checked = integrity(old, wanted, keys, last=1 << 30).where("keep").select(*keys, "step")
    kept = checkpointed(old.join(checked, [*keys, "step"], "left_semi"))
    missing = incremental(kept, wanted.select(*keys, "step"), keys).select("step").distinct()
    # The missing steps meet the partitions' names, so other partitions aren't opened.
    fresh = checkpointed(compute(missing_partitions(rows, missing)))
    kept.write.mode("overwrite").parquet(metrics)
    append_metrics(fresh, metrics, [*keys, "step"])


def missing_partitions(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows of these steps, of a table that is partitioned by step; partitions are pruned as the steps become known."""
    return rows.join(F.broadcast(steps.select("step").distinct()), "step", "left_semi")  # a row per step


def append_log(rows: DataFrame, folder: str, start: dict[str, object] | None = None, completed: str | None = None) -> None:
    """Append rows of a run's log as a text file of their own in ``folder``; the first has metadata and header, the last one may end with the completion line.

    Files are named by their first step, so a reader of the folder gets the rows in order, and an append that is repeated replaces its own file.
    """
    spark, step = rows.sparkSession, rows.agg(F.min("step")).first()[0]
    line = F.concat_ws(",", *[F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in S.RUN_LOG])
    lines = rows.select(F.lit(1).alias("part"), F.col("step").alias("at"), line.alias("value"))
    head = []
    if start is not None:
        head += ["# " + ",".join(f"{k}={v}" for k, v in start.items()), ",".join(f.name for f in S.RUN_LOG)]
    extra = [(0, k, x) for k, x in enumerate(head)] + ([(2, 0, f"# COMPLETED at {completed}")] if completed else [])
    if extra:
        lines = lines.unionByName(spark.createDataFrame(extra, "part int, at long, value string"))
    name = f"{step if step is not None else 'end'}.csv".rjust(19, "0")
    _as_file(lines.orderBy("part", "at").select("value"), f"{folder.rstrip('/')}/{name}", "text")


def _as_file(rows: DataFrame, target: str, kind: str) -> None:
    """Rows as one file of that name, in any store that Spark writes: written beside it, then renamed; a retry replaces it."""
    spark = rows.sparkSession
    folder, name = target.rsplit("/", 1)
    being = f"{folder}/_{name}"
    rows.coalesce(1).write.mode("overwrite").format(kind).options(**({"header": True} if kind == "csv" else {})).save(being)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(being).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path(target), False)
    fs.rename(fs.globStatus(path(f"{being}/part-*"))[0].getPath(), path(target))
    fs.delete(path(being), True)


def remove_file(spark: SparkSession, file: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


def _name(engine: int, n: int, seed: int, step: int) -> str:
    digits = f"{step:09d}"
    digits = "_".join([digits[: len(digits) % 3 or 3], *(digits[k : k + 3] for k in range(len(digits) % 3 or 3, len(digits), 3))])
    return f"E{engine}/N{n}/S{seed}/data/E{engine}_N{n}_S{seed}_iter_{digits}"


#: Rows of a snapshot's file; a snapshot with more is several files, so that no task writes or reads more than this.
ROWS = 2_000_000


def write_snapshots(nodes: DataFrame, edges: DataFrame, folder: str, engine: int, n: int, seed: int) -> None:
    """All snapshots of one run (column ``step``) in the layout that the readers know: one job for the nodes, one for the edges, a task a file.

    A snapshot is one file, or beyond ``ROWS`` rows files that end in ``.csv``, ``.part00001.csv`` and so on, dealt by hash.
    Files are written beside the run, by step, and renamed once their job is done.
    """
    kinds = {
        "nodes": nodes.select("step", "node_id", F.col("psi_re").alias("psi_real"), F.col("psi_im").alias("psi_imag")),
        "edges": edges.select("step", F.col("src").alias("source"), F.col("dst").alias("target"), "theta"),
    }
    for kind, rows in kinds.items():
        write_parts(rows, kind, folder, engine, n, seed)


def write_parts(rows: DataFrame, kind: str, folder: str, engine: int, n: int, seed: int) -> None:
    """One kind of a run's snapshots: ``step`` and the columns of its files, in which a step's older files are replaced."""
    base, columns = folder.rstrip("/"), rows.columns[1:]
    being = f"{base}/_{kind}"
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    parts = {r["step"]: -(-r["count"] // ROWS) for r in rows.groupBy("step").count().collect()}  # a row a step
    some = F.create_map(*[F.lit(x).cast("long") for pair in (parts or {0: 1}).items() for x in pair])
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*columns), F.element_at(some, F.col("step").cast("long"))))
    # Twice as many tasks as files, so that few files fall to one.
    written = dealt.repartition(max(2 * sum(parts.values()), 1), "step", "part").sortWithinPartitions("step", "part", *columns[:-1])
    written.write.mode("overwrite").partitionBy("step", "part").option("header", True).csv(being)
    fs = path(being).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for step in parts:
        name = f"{base}/{_name(engine, n, seed, step)}_{kind}"
        fs.mkdirs(path(name).getParent())
        remove_parts(spark, name)
        # A part that no row fell to has no file, so files are numbered as they come.
        for place, part in enumerate(fs.globStatus(path(f"{being}/step={step}/part=*/part-*")) or []):
            fs.rename(part.getPath(), path(part_name(name, place)))
    fs.delete(path(being), True)


def part_name(name: str, part: int) -> str:
    """The file of a snapshot's part; the first has the plain name."""
    return f"{name}.part{part:05d}.csv" if part else f"{name}.csv"


def remove_parts(spark: SparkSession, name: str) -> None:
    """Remove a snapshot's files (``name``: without the ending)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for file in [x.getPath() for pattern in (f"{name}.csv", f"{name}.part*.csv") for x in (fs.globStatus(path(pattern)) or [])]:
        fs.delete(file, False)


def write_snapshot(nodes: DataFrame, edges: DataFrame, folder: str, engine: int, n: int, seed: int, step: int) -> None:
    """One snapshot of one run as its two files."""
    write_snapshots(nodes.withColumn("step", F.lit(step)), edges.withColumn("step", F.lit(step)), folder, engine, n, seed)


def drop_nan(metrics: DataFrame, column: str) -> DataFrame:
    """Rows whose metric is neither null nor NaN."""
    return metrics.na.drop(subset=[column])


def earliest(files: DataFrame) -> DataFrame:
    """Per engine and size the time of the first written snapshot, as label."""
    return files.groupBy("engine", "n").agg(F.min("mtime").alias("first")).withColumn("label", F.date_format("first", "yyyy-MM-dd HH:mm"))


# -- alignment cache --------------------------------------------------------------------------------


def write_alignment(aligned: DataFrame, path: str) -> None:
    """Append aligned embeddings ``run_id, step, node_id, x`` by step; a step that is written again is replaced."""
    aligned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def read_alignment(spark: SparkSession, path: str, step: int | None = None) -> DataFrame:
    """The stored alignment, or of each run its latest step before ``step``; only that step's partitions are read."""
    stored = spark.read.parquet(path)
    if step is None:
        return stored
    last = stored.where(F.col("step") < step).groupBy("run_id").agg(F.max("step").alias("step"))
    return stored.join(F.broadcast(last), ["run_id", "step"]) if last.count() < 1_000_000 else stored.join(last, ["run_id", "step"])


def write_report(lines: DataFrame, path: str, column: str = "line") -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def report_lines(summary: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Fixed-width lines."""
    return summary.select(F.format_string(" ".join(f"%-{w}s" for w in columns.values()), *[F.col(c).cast("string") for c in columns]).alias("line"))


def write_sweep(results: DataFrame, folder: str, p1: str, p2: str) -> str:
    path = f"{folder.rstrip('/')}/sweep_speed_{p1}_{p2}"
    results.write.mode("overwrite").option("header", True).csv(path)
    return path


def engine_diff(old: str, new: str) -> tuple[str, int, int]:
    """Unified diff of two engine sources, and lines added and removed."""
    lines = list(difflib.unified_diff(old.splitlines(), new.splitlines(), "old", "new", lineterm=""))
    return "\n".join(lines), sum(x.startswith("+") and not x.startswith("+++") for x in lines), sum(x.startswith("-") and not x.startswith("---") for x in lines)


def engine_version(source: bytes, archive: dict[int, bytes]) -> tuple[int, bool]:
    """The archived version with the same bytes, else the next one, and whether it is new."""
    digest = hashlib.sha256(source).digest()
    for version, other in sorted(archive.items()):
        if hashlib.sha256(other).digest() == digest:
            return version, False
    return max(archive, default=0) + 1, True


def truncate_from(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each run before its first bad one (boolean column ``bad``)."""
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("broken", F.max(F.col("bad").cast("int")).over(w)).where("broken = 0").drop("broken")
