"""Audit of five filters that overlap: what each removes, in every order in which they can be applied.

Filters of a whole text (words: maximal ``[^\\x20\\x09-\\x0D]+``, case-sensitive) and when a text fails:

* A: under 50 words,
* B: 100 * distinct words < 65 * words,
* C: 100 * characters ``[A-Z]`` > 5 * code points,
* D: holds any of ``#$%&*|``,
* E: identical to the text of any smaller doc_id in the table, removed or not.

A to D come from the bytes of Arrow's string buffers: a table of byte classes marks words, capitals, symbols
and continuation bytes, prefix sums over a block give each document's counts. Distinct words are
neighbours that differ in the sorted word hashes of a document; equal hashes are verified by the words'
bytes, and a document where that fails is counted by the words themselves. A row's failures are a mask of
five bits.

E needs the table: a text goes by its SHA-256 digest, only (digest, id, part, mask, labels) rows are shuffled.
Equal rows are summed before any shuffle by digest, minima of ids are taken in partial sums, and rows meet
them by digest and id, so that a text with very many copies isn't one task. What remains are counts by part
and mask, 32 numbers a part: every order's steps are sums of those whose mask holds the step's filter and
none of the earlier ones (a matrix product).

Defined cases: a null text is empty (0 words: fails A; an empty text equals another); a null source and an empty
one are the same part; a row with a null id is neither smaller nor greater than others, so it neither fails
E nor lets others fail, and has no labels; equal ids aren't smaller, so equal rows of one id don't fail each
other; of several labels of an id any 1 counts; an empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_kernel
from .tokens import BLOCK, Block, blocks

FILTERS = "ABCDE"
WORDS, DISTINCT, CAPITALS = 50, 65, 5
SYMBOLS = b"#$%&*|"
#: Null ids are dealt over so many keys when rows meet the labels.
SALTS = 256

MASKS = "doc_id long, part string, digest binary, words long, distinct_words long, capitals long, symbols long, code_points long, mask int"

_CLASS = np.zeros((3, 256), np.uint8)
_CLASS[0, 65:91] = 1
_CLASS[1, list(SYMBOLS)] = 1
_CLASS[2] = 1
_CLASS[2, 0x80:0xC0] = 0  # continuation bytes


def _sums(block: Block) -> np.ndarray:
    """Capitals, symbols and code points of each document."""
    out = np.zeros((3, len(block.bounds) - 1), np.int64)
    upto = np.zeros(len(block.data) + 1, np.uint32)  # a string has fewer than 2**31 bytes
    for k in range(3):
        np.cumsum(_CLASS[k][block.data], out=upto[1:], dtype=np.uint32)
        out[k] = upto[block.bounds[1:]] - upto[block.bounds[:-1]]
    return out


def _equal_words(block: Block, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words a[k] and b[k] have the same bytes; ``BLOCK`` bytes at a time, one pair at least."""
    size = block.end[a] - block.start[a]
    same = size == block.end[b] - block.start[b]
    k, upto = 0, np.cumsum(np.where(same, size, 0))
    while k < len(a):
        stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + BLOCK, "right")))
        if stop == k + 1:
            s, t, n = int(block.start[a[k]]), int(block.start[b[k]]), int(size[k])
            same[k] = same[k] and np.array_equal(block.data[s : s + n], block.data[t : t + n])
        else:
            pair = np.flatnonzero(same[k:stop]) + k
            n = size[pair]
            first = np.cumsum(n) - n
            at = np.arange(int(n.sum())) - np.repeat(first, n)
            differ = block.data[np.repeat(block.start[a[pair]], n) + at] != block.data[np.repeat(block.start[b[pair]], n) + at]
            same[pair[np.add.reduceat(differ, first) > 0] if len(pair) else pair] = False
        k = stop
    return same


def _distinct(block: Block, hashes: np.ndarray | None = None) -> np.ndarray:
    """Distinct words of each document."""
    h = block.hashes() if hashes is None else hashes
    n = np.diff(block.first)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    repeated = np.flatnonzero((h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])) + 1
    out = n - np.bincount(doc[order[repeated]], minlength=len(n))
    wrong = repeated[~_equal_words(block, order[repeated - 1], order[repeated])]
    for d in np.unique(doc[order[wrong]]).tolist():  # two words of one hash
        out[d] = len({block.data[block.start[w] : block.end[w]].tobytes() for w in range(block.first[d], block.first[d + 1])})
    return out


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row its id, part, digest, counts, and the failures of A to D as bits 0 to 3."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for block in blocks(batch.column("text"), lower=False):
            capitals, symbols, points = _sums(block)
            words, distinct = np.diff(block.first), _distinct(block)
            fails = (words < WORDS, 100 * distinct < DISTINCT * words, 100 * capitals > CAPITALS * points, symbols > 0)
            part = batch.slice(block.rows.start, len(block.rows))
            bounds = block.bounds.tolist()
            yield {
                "doc_id": part.column("doc_id"), "part": part.column("part"),
                "digest": [hashlib.sha256(block.data[a:b]).digest() for a, b in zip(bounds, bounds[1:])],
                "words": words, "distinct_words": distinct, "capitals": capitals, "symbols": symbols, "code_points": points,
                "mask": sum(f.astype(np.int32) << k for k, f in enumerate(fails)),
            }

    return arrow_kernel(narrow, MASKS, rows)


def failures(rows: DataFrame) -> DataFrame:
    """``doc_id, part, mask, n``: rows of ``masks`` summed by text, with bit 4 for E."""
    keys = ["digest", "doc_id", "part", "mask"]
    equal = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    first = equal.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("is_first", F.lit(True))
    found = equal.join(first, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return found.select("doc_id", "digest", "part", F.when(copy, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"), "n")


def profile(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: rows of ``failures`` by part and mask, and how many of them are labelled so."""
    marks = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("is_good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("is_toxic"))
        .withColumn("salt", F.lit(0))
    )
    # A null id meets no label; the salt keeps such rows from meeting in one task.
    dealt = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0).cast("int"))
    marked = dealt.join(marks, (dealt["doc_id"] == marks["id"]) & (dealt["salt"] == marks["salt"]), "left")
    n = F.col("n")
    return marked.groupBy("part", "mask").agg(F.sum(n).alias("n"), F.sum(n * F.coalesce("is_good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("is_toxic", F.lit(0))).alias("toxic"))


def _steps() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of all orders, and for each count a matrix that turns a part's 32 sums into it."""
    mask = np.arange(32)
    names, rows = [], {c: [] for c in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    size = np.array([bin(m).count("1") for m in mask])
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            has = mask & bit > 0
            names.append(("".join(order), step))
            rows["kept"].append(mask & (before | bit) == 0)
            rows["removed"].append(has & (mask & before == 0))
            rows["redundant"].append(has & (mask & before > 0))
            rows["unique_fails"].append(mask == bit)
            # Of the 120 orders, those in which the filter comes before all others that the mask holds.
            rows["shapley"].append(np.where(has, 120 // np.maximum(size, 1), 0))
            before |= bit
    return names, {c: np.array(m, np.int64).T for c, m in rows.items()}


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def steps(counts: DataFrame) -> DataFrame:
    """A row per part, order and step from rows of ``profile``; parts are summed in Spark, each to three rows of 32 numbers."""
    sums = [F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(32)]).alias(c) for c in ("n", "good", "toxic")]

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        names, by = _steps()
        for k in range(batch.num_rows):
            n, good, toxic = (np.array(batch.column(c)[k].as_py(), np.int64) for c in ("n", "good", "toxic"))
            yield {
                "part": [batch.column("part")[k].as_py()] * len(names), "filter_order": [o for o, _ in names], "step": [s for _, s in names],
                **{c: n @ by[c] for c in by}, "good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"],
            }

    return arrow_kernel(counts.groupBy("part").agg(*sums), AUDIT, rows)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per part, order of the five filters and step: what the step keeps and removes."""
    return steps(profile(failures(masks(docs, id_col, text_col, source_col)), labels))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS is_good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS is_toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(is_good, 0) AS is_good, coalesce(is_toxic, 0) AS is_toxic,
  [len(words) < 50, 100 * list_unique(words) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first_id, false)] AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(is_good) AS good, sum(is_toxic) AS toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS places FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT places, step, places[step] AS own, places[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, places, step, own, n, good, toxic, fails[own] AS fail, len(list_filter(before, lambda p: fails[p])) AS earlier, len(list_filter(fails, lambda x: x)) AS failed FROM c, s)
SELECT part, array_to_string(list_transform(places, lambda p: substr('ABCDE', p, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(sum(CASE WHEN NOT fail AND earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN fail AND earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN fail AND earlier > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fail AND failed = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN fail AND earlier = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN fail AND earlier = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN fail THEN n * 120 // failed ELSE 0 END) AS BIGINT) AS shapley
FROM r GROUP BY part, places, step"""
