"""Quality classifier: random Fourier features, ridge regression and isotonic calibration.

Every whole text gives ``STATISTICS`` (lengths, character shares, line and word repetition, stop
words), standardised over the corpus. ``FEATURES`` random cosines approximate a Gaussian kernel on
them. Partitions sum the normal equations of each fold; the driver adds a fixed number of sums and
solves them. Scores of either fold under the other's weights are put in histogram bins, likewise
summed, and pooled to a rising curve (pool adjacent violators) that calibrates the final weights.

Training rows: at most ``TRAIN`` labelled ids with the smallest hashes, never those whose crc32 of
the id modulo 3 is 1. Only the text enters a score.

Defined cases: null and empty texts have zero statistics and get a score like any other; rows with
null labels don't train; a null id isn't held out and doesn't train; repeated rows are scored each;
without labels of both kinds all scores are the share of label 1 (0.5 without any); an empty table gives an
empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tokens
from .rules import ALL_STOP_WORDS
from .shared import arrow_kernel, arrow_schema, cut, id_remainder, parsed

STATISTICS = (
    "log_words", "log_bytes", "word_bytes", "word_bytes_deviation", "symbols", "bars", "exclamations", "capitals", "digits",
    "other_scripts", "punctuation", "distinct_words", "repeated_lines", "words_per_line", "repeated_windows", "word_after_itself", "stop_words", "commonest_word",
)
FEATURES, TRAIN, FOLDS, PARTS, RIDGE, SEED, CLIP, BINS = 256, 20_000, 2, 8, 1e-3, 7, 5.0, 4096


def _lut(chars: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars.encode())] = 1
    return table


_SYMBOLS, _PUNCTUATION = _lut("#*$%&|<>"), _lut(".,;:")


def _stop_hashes() -> np.ndarray:
    block = next(tokens.blocks(pa.array([" ".join(ALL_STOP_WORDS)])))
    return np.unique(block.hashes())


_STOP = _stop_hashes()


def statistics_of(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for block in tokens.blocks(texts, lower=False):
        data, bounds, first = block.data, block.bounds, block.first
        lower = tokens.Block(block.rows, data, bounds, True)
        h = lower.hashes()
        length = (block.end - block.start).astype(float)
        sums = {n: np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for n, x in (
            ("symbols", _SYMBOLS[data]), ("bars", data == 124), ("exclamations", data == 33), ("capitals", (data >= 65) & (data <= 90)), ("digits", (data >= 48) & (data <= 57)),
            ("other", data >= 128), ("punctuation", _PUNCTUATION[data]), ("lines", data == 10),
        )}
        stop = np.concatenate([[0], np.cumsum(np.isin(h, _STOP))])
        again = np.concatenate([[0, 0], np.cumsum(h[1:] == h[:-1])]) if len(h) else np.zeros(1, int)
        windows = np.zeros(max(len(h) - 7, 0), np.uint64)
        for k in range(8):
            windows = windows * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(windows)]
        raw = data.tobytes()
        for k, row in enumerate(block.rows):
            a, b, i, j = bounds[k], bounds[k + 1], first[k], first[k + 1]
            n, size = j - i, b - a
            if not size:
                continue
            share = {x: (s[b] - s[a]) / size for x, s in sums.items()}
            words = max(n, 1)
            lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
            own = np.unique(h[i:j], return_counts=True)[1] if n else np.zeros(1)
            wide = windows[i : j - 7] if n >= 8 else windows[:0]
            out[row] = (
                np.log1p(n), np.log1p(size), length[i:j].mean() if n else 0, length[i:j].std() if n else 0, share["symbols"], share["bars"] * size / words,
                share["exclamations"] * size / words, share["capitals"], share["digits"], share["other"], share["punctuation"] * size / words, len(own) / words ** 0.9,
                1 - len(set(lines)) / len(lines) if lines else 0, np.log1p(n / max(len(lines), 1)), 1 - len(np.unique(wide)) / len(wide) if len(wide) else 0,
                (again[j] - again[min(i + 1, j)]) / words, (stop[j] - stop[i]) / words, own.max() / words,
            )
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, x`` and columns to carry along."""

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        x = statistics_of(batch.column("text"))
        yield {"doc_id": batch.column("doc_id"), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS))} | {c: batch.column(c) for c in carry}

    schema = StructType(parsed("doc_id long, x array<double>").fields + [docs.schema[c] for c in carry])
    return arrow_kernel(docs.select(*carry, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), schema, rows)


class Features:
    """Random cosines of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray) -> None:
        rng = np.random.Generator(np.random.Philox(SEED))
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.standard_normal((len(mean), FEATURES)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def normal_equations(rows: DataFrame, features: Features) -> list[np.ndarray]:
    """For each fold the sums of f'f, f'y, y and rows; the driver gets PARTS rows for each."""
    n = FEATURES + 1
    target = arrow_schema(rows.sparkSession, "fold int, sums binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, n, n + 2))
        for batch in batches:
            f, y, fold = features(_matrix(batch.column("x"))), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for k in range(FOLDS):
                m = fold == k
                sums[k, :, :n] += f[m].T @ f[m]
                sums[k, :, n] += f[m].T @ y[m]
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS), pa.int32()), pa.array([s.tobytes() for s in sums])], schema=target)

    total = [np.zeros((n, n + 2)) for _ in range(FOLDS)]
    for r in rows.mapInArrow(run, "fold int, sums binary").collect():
        total[r["fold"]] += np.frombuffer(r["sums"]).reshape(n, n + 2)
    return total


def solve(sums: np.ndarray) -> np.ndarray:
    n = FEATURES + 1
    count = max(sums[-1, n - 1], 1.0)
    return np.linalg.solve(sums[:, :n] + RIDGE * count * np.eye(n), sums[:, n])


def isotonic(score: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising means by pooling adjacent violators: centres of the pools and their means."""
    pools: list[list[float]] = []
    for s, m, w in zip(score, mean, weight, strict=True):
        pools.append([s, m, w])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            s2, m2, w2 = pools.pop()
            s1, m1, w1 = pools.pop()
            w0 = w1 + w2
            pools.append([(s1 * w1 + s2 * w2) / w0, (m1 * w1 + m2 * w2) / w0, w0])
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``, and columns to carry along."""
    stats = cut(statistics(docs, id_col, text_col, carry), "classifier-statistics")
    moments = stats.agg(*[f(F.col("x")[k]).alias(f"{n}{k}") for k in range(len(STATISTICS)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, deviation = (np.array([moments[f"{n}{k}"] or 0.0 for k in range(len(STATISTICS))]) for n in "ms")
    features = Features(mean, deviation)
    remainder = id_remainder(F.col("doc_id"), 3)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(remainder != 1)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(TRAIN)  # so small enough to broadcast
    train = stats.select("doc_id", "x").join(F.broadcast(chosen), "doc_id").withColumn("fold", (remainder == 2).cast("int"))
    train = cut(train.repartition(PARTS), "classifier-train")
    sums = normal_equations(train, features)
    count, ones = sum(s[-1, FEATURES] for s in sums), sum(s[-1, FEATURES + 1] for s in sums)
    if not 0 < ones < count:
        constant = float(ones / count) if count else 0.5
        curve, weights = (np.array([0.0]), np.array([constant])), np.zeros(FEATURES + 1)
    else:
        weights = solve(sum(sums))
        other = [solve(sum(s for k, s in enumerate(sums) if k != fold)) for fold in range(FOLDS)]

        def bins(batch: pa.RecordBatch) -> Iterator[dict]:
            f, y, fold = features(_matrix(batch.column("x"))), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            s = np.einsum("ij,ij->i", f, np.array(other)[fold])
            yield {"bin": np.clip(((s + 1) / 3 * BINS), 0, BINS - 1).astype(int), "y": y}

        pairs = arrow_kernel(train, "bin int, y double", bins).groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect()  # at most BINS rows
        pairs = sorted((r["bin"], r["y"], r["n"]) for r in pairs)
        curve = isotonic(np.array([(b + 0.5) * 3 / BINS - 1 for b, _, _ in pairs]), np.array([y for _, y, _ in pairs]), np.array([float(n) for _, _, n in pairs]))

    def score(batch: pa.RecordBatch) -> Iterator[dict]:
        s = features(_matrix(batch.column("x"))) @ weights
        yield {"doc_id": batch.column("doc_id"), "score": np.clip(np.interp(s, *curve), 0.0, 1.0)} | {c: batch.column(c) for c in carry}

    schema = StructType(parsed("doc_id long, score double").fields + [stats.schema[c] for c in carry])
    scored = arrow_kernel(stats, schema, score)
    return scored.select(*carry, "doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted to have label 1, with their own columns; texts are not shuffled."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return classify(rows, labels, label_col, "id", "text", ("row",)).where("predicted = 1").select("row.*")
