"""Column functions of labels, paths, metadata lines and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def step_label(step: Column) -> Column:
    """Eleven characters, zero padded, an underscore between thousands."""
    return F.regexp_replace(F.format_string("%09d", step.cast("long")), r"(\d)(?=(\d{3})+$)", "$1_")


def step_of(name: Column, kind: str = "nodes") -> Column:
    """The step of a snapshot's file name, or null."""
    digits = F.regexp_extract(name, rf"iter_([\d_]+)_{kind}(?:\.part\d+)?\.csv", 1)
    return F.replace(F.nullif(digits, F.lit("")), F.lit("_"), F.lit("")).try_cast("long")


def legacy_step_of(name: Column, kind: str = "edges") -> Column:
    return F.nullif(F.regexp_extract(name, rf"{kind}_step_(\d+)\.csv", 1), F.lit("")).try_cast("long")


def path_metadata(path: Column) -> Column:
    """Struct engine, n, seed of a run's path (parts E.., N.., S..); zeros where a part is missing."""
    part = lambda letter: F.coalesce(F.regexp_extract(path, rf"(?:^|/){letter}(\d+)(?=/|$)", 1).try_cast("long"), F.lit(0).cast("long"))
    found = F.struct(part("E").alias("engine"), part("N").alias("n"), part("S").alias("seed"))
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("engine", "n", "seed")])
    return F.when((found["engine"] > 0) & (found["n"] > 0) & (F.regexp_extract(path, r"(?:^|/)S(\d+)(?=/|$)", 1) != ""), found).otherwise(none)


def legacy_metadata(path: Column) -> Column:
    """Struct n, seed of a legacy path: _N<digits>; seed_<digits>, else _s<digits>, else 0."""
    digits = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).try_cast("long")
    return F.struct(digits(r"_N(\d+)").alias("n"), F.coalesce(digits(r"seed_(\d+)"), digits(r"_s(\d+)"), F.lit(0).cast("long")).alias("seed"))


def key_values(line: Column) -> Column:
    """A map of a line ``# a=1,b=2``."""
    return F.str_to_map(F.regexp_replace(F.trim(line), r"^#\s*", ""), F.lit(","), F.lit("="))


def duration(seconds: Column) -> Column:
    """[d days, ]h:mm:ss of whole seconds; --- where null or negative."""
    s = F.floor(seconds).cast("long")
    days = F.floor(s / 86400)
    head = F.when(days > 0, F.concat(days.cast("string"), F.when(days == 1, " day, ").otherwise(" days, "))).otherwise("")
    return F.when(seconds.isNull() | (seconds < 0), "---").otherwise(F.concat(head, F.format_string("%d:%02d:%02d", F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)))


def short_number(x: Column) -> Column:
    """1.2M, 3.4K or the number."""
    return F.when(x >= 1e6, F.format_string("%.1fM", x / 1e6)).when(x >= 1e3, F.format_string("%.1fK", x / 1e3)).otherwise(F.format_string("%.0f", x.cast("double")))


def plus_minus(mean: Column, deviation: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f±%.{digits}f", mean, F.coalesce(deviation, F.lit(0.0)))


def joined(*columns: Column) -> Column:
    return F.concat_ws(":", *[c.cast("string") for c in columns])


def signature(engine: Column, params: Column) -> Column:
    """First eight hex digits of the SHA-256 of engine source and parameters, each with a stand-in if missing."""
    return F.substring(F.sha2(F.concat(F.coalesce(engine, F.lit(b"no_engine")), F.coalesce(params, F.lit(b"no_params"))), 256), 1, 8)


def frame_density(frames: Column) -> Column:
    return F.when(frames > 1000, "HD").when(frames > 150, "Dense").otherwise("Sparse")


def target_label(k_avg: Column, streak: Column, target: float = 3.0, goal: int = 10) -> Column:
    """Progress to the mean degree, then the streak."""
    return F.when(k_avg < target, F.format_string("%.1f%%", 100 * k_avg / target)).otherwise(F.format_string("%d/%d", streak, F.lit(goal)))


def timestamp_label(path: Column, fallback: Column) -> Column:
    """The first YYYY-MM-DD_HH-MM-SS of a path, else a fallback, else a far future."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})", 1), F.lit("")), fallback, F.lit("9999-12-31_23-59-59"))


def linspace(spark: SparkSession, start: float, end: float, n: int, name: str = "x") -> DataFrame:
    step = (end - start) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").cast("int").alias("k"), (F.lit(start) + F.col("id") * F.lit(step)).alias(name))


def logspace(spark: SparkSession, start: float, end: float, n: int, name: str = "t") -> DataFrame:
    return linspace(spark, start, end, n, "e").select("k", F.pow(F.lit(10.0), "e").alias(name))


def register(spark: SparkSession) -> None:
    """The scalar functions as SQL functions (macros over built-ins, so they inline)."""
    from ..sources.schema import PARAMS as p

    for name, args, body in (
        ("density", "re DOUBLE, im DOUBLE", "re * re + im * im"),
        ("wrap_angle", "t DOUBLE", "pmod(t + pi(), 2 * pi()) - pi()"),
        ("self_energy", "rho DOUBLE", f"{p['mass2']}D * rho + {p['lam_psi']}D * rho * rho + {p['lam_pauli']}D * exp(rho / {p['rho0']}D)"),
        ("forman", "du BIGINT, dv BIGINT", "4 - du - dv"),
        ("quantised", "k DOUBLE", "CAST(k * 1000 AS BIGINT)"),
    ):
        returns = "BIGINT" if name in ("forman", "quantised") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
