"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Files are rows with a path. A text's passages are its lines, its paragraphs (lines up to one without
letters and digits, so comment signs don't matter) and the sentences of these, as far as they hold a
word of ``ANCHORS``; they are compared with the statements of ``license_texts``: titles, notices for
source files, references. Files with a name of ``LICENSE_NAMES`` are compared with the whole licence
texts as well. A file's own licence is that of its best cosine of at least ``LEAST``; whole texts go
before statements, these before bare reservations of rights, and of equal cosines the smaller name wins.
A file without one takes the licence of the licence file in its own or nearest ancestor directory,
found by joining its directory's ancestors with the directories that have one. Only built-in functions run.

Weights: term frequency times ``ln((1 + T) / (1 + df)) + 1`` over the T templates; words that no
template holds count in the norm with df 0. Equal passages are compared once: they go by their MD5,
and only that and single words are shuffled.

Defined cases: null and empty texts have no licence of their own; a null path has no directory and
inherits nothing; repeated rows are scanned each; of several licence files in a directory the best
match counts, then the smaller name; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_texts as L
from .shared import cut

LEAST = 0.7
ANCHORS = r"(?i)licen[cs]|redistribution|rights reserved|public domain|copyright|permission|creative commons|cc0|provided.*as.is|holder"
LICENSE_NAMES = ("LICENSE", "LICENSE.txt", "LICENSE.md", "LICENCE", "COPYING")
#: Between paragraphs, and between sentences.
PARAGRAPH, SENTENCE = r"\n[^A-Za-z0-9]*\n", r"[.!?]+[ \n]+"

#: (licence, text, rank): 2 whole texts, 1 statements, 0 reservations.
TEMPLATES = [(name, text, rank) for rank, kind in ((2, L.WHOLE), (1, L.STATEMENTS), (0, L.RESERVED)) for name, texts in kind.items() for text in texts]


def template_weights() -> tuple[list[tuple[int, str, int, str, float]], dict[str, float]]:
    """(template, licence, rank, word, weight over the template's norm) and the weight by word of a single occurrence."""
    counts = [Counter(re.findall("[a-z0-9]+", text.lower())) for _, text, _ in TEMPLATES]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for k, ((name, _, rank), c) in enumerate(zip(TEMPLATES, counts, strict=True)):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        rows += [(k, name, rank, w, n * idf[w] / norm) for w, n in sorted(c.items())]
    return rows, idf


UNKNOWN = math.log(1 + len(TEMPLATES)) + 1


def _best(rank: str = "rank", license: str = "license", cosine: str = "cosine") -> Column:
    return F.min(F.struct((-F.col(rank)).alias("r"), (-F.col(cosine)).alias("c"), F.col(license).alias("l"))).alias("best")


def _unpacked(*columns: str) -> list[Column]:
    return [*map(F.col, columns), (-F.col("best.r")).alias("rank"), F.col("best.l").alias("license"), (-F.col("best.c")).alias("cosine")]


def _cosines(spark: SparkSession, passages: DataFrame) -> DataFrame:
    """``key, rank, license, cosine`` of the best template for each passage of ``key, whole, passage`` that is near one."""
    rows, idf = template_weights()
    weights = F.broadcast(spark.createDataFrame([(*r, idf[r[3]]) for r in rows], "template int, license string, rank int, word string, weight double, idf double"))  # a fixed table
    words = passages.select("key", "whole", F.explode(F.regexp_extract_all(F.lower("passage"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")).groupBy("key", "whole", "word").agg(F.count("*").alias("tf"))
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "word string, idf double"))
    norms = words.join(known, "word", "left").groupBy("key").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(UNKNOWN)), F.lit(2.0)))).alias("norm"))
    dots = words.join(weights, "word").where(F.col("whole") == (F.col("rank") == 2)).groupBy("key", "template", "license", "rank").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "key").select("key", "rank", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).where(F.col("cosine") >= LEAST)
    return scored.groupBy("key").agg(_best()).select(*_unpacked("key"))


def _directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def passages(text: Column, named: Column) -> Column:
    """The distinct passages of a text that hold an anchor, as an array of (whole, passage)."""
    lines, paragraphs = F.split(text, "\n"), F.split(text, PARAGRAPH)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCE)))
    parts = F.array_distinct(F.filter(F.concat(lines, paragraphs, sentences), lambda x: x.rlike(ANCHORS)))
    whole = F.when(named, F.array(F.struct(F.lit(True).alias("whole"), text.alias("passage")))).otherwise(F.array().cast("array<struct<whole:boolean,passage:string>>"))
    found = F.concat(F.transform(parts, lambda p: F.struct(F.lit(False).alias("whole"), p.alias("passage"))), whole)
    return F.when(text.rlike(ANCHORS), found)


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``doc_id, path, license, cosine, inherited_from`` for each row; the last is a directory, null for a licence of the file's own."""
    spark = files.sparkSession
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    named = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).isin(*LICENSE_NAMES), F.lit(False))
    rows = cut(rows.select("row", "doc_id", "path", named.alias("named"), passages(F.col("text"), named).alias("passages")), "license-passages")
    found = rows.select("row", F.explode("passages").alias("p")).select("row", F.md5(F.concat(F.col("p.whole").cast("string"), F.col("p.passage")).cast("binary")).alias("key"), "p.whole", "p.passage")
    distinct = found.groupBy("key").agg(F.first("whole").alias("whole"), F.first("passage").alias("passage"))
    near = cut(_cosines(spark, distinct), "license-near")
    own = found.select("row", "key").join(near, "key").groupBy("row").agg(_best()).select(*_unpacked("row"))
    scanned = cut(rows.drop("passages").join(own, "row", "left").withColumn("dir", _directory(F.col("path"))), "license-own")

    licensed = scanned.where("named AND license IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(_best())
    licensed = licensed.select(F.col("dir").alias("ancestor"), F.col("best.l").alias("from_license"), (-F.col("best.c")).alias("from_cosine"))
    dirs = scanned.where("license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).select("dir", "depth", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, F.greatest("depth", F.lit(1))), "/")).alias("ancestor"))
    nearest = above.join(licensed, "ancestor").groupBy("dir").agg(F.max_by(F.struct("ancestor", "from_license", "from_cosine"), "depth").alias("near"))
    joined = scanned.join(nearest, "dir", "left")
    inherits = F.col("license").isNull()
    return joined.select(
        "doc_id", "path", F.coalesce("license", "near.from_license").alias("license"), F.coalesce("cosine", "near.from_cosine").alias("cosine"),
        F.when(inherits, F.col("near.ancestor")).alias("inherited_from"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: thousand and hundred of the id as directories; each hundred's first is its licence file."""
    thousand, hundred = F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string")
    name = F.when(F.pmod("doc_id", F.lit(100)) == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", "text", F.concat_ws("/", thousand, hundred, name).alias("path"))


def _sql() -> str:
    rows, idf = template_weights()
    weights = ", ".join(f"({k}, '{t}', {r}, '{w}', {x!r}, {idf[w]!r})" for k, t, r, w, x in rows)
    known = ", ".join(f"('{w}', {x!r})" for w, x in sorted(idf.items()))
    names = ", ".join(f"'{n}'" for n in LICENSE_NAMES)
    return f"""
WITH RECURSIVE weights(template, license, rank, word, weight, idf) AS (VALUES {weights}),
known(word, idf) AS (VALUES {known}),
f AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    concat_ws('/', CAST(CAST(floor(doc_id / 1000.0) AS BIGINT) AS VARCHAR), CAST(CAST(floor(doc_id / 100.0) AS BIGINT) AS VARCHAR),
      CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE CAST(doc_id AS VARCHAR) || '.txt' END) AS path
  FROM documents),
g AS (SELECT *, regexp_extract(path, '[^/]*$') IN ({names}) AS named, regexp_replace(path, '/[^/]*$', '') AS dir FROM f),
b AS (SELECT r, unnest(string_split_regex(text, '{PARAGRAPH}')) AS passage FROM g WHERE regexp_matches(text, '{ANCHORS}')),
p AS (
  SELECT DISTINCT r, whole, passage FROM (
    SELECT r, false AS whole, unnest(string_split(text, chr(10))) AS passage FROM g
    UNION ALL SELECT r, false, passage FROM b
    UNION ALL SELECT r, false, unnest(string_split_regex(passage, '{SENTENCE}')) FROM b
    UNION ALL SELECT r, true, text FROM g WHERE named) x WHERE regexp_matches(passage, '{ANCHORS}')),
w AS (SELECT whole, passage, word, count(*) AS tf FROM (SELECT whole, passage, unnest(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS word FROM (SELECT DISTINCT whole, passage FROM p) y) z GROUP BY ALL),
n AS (SELECT whole, passage, sqrt(sum(pow(tf * coalesce(idf, {UNKNOWN!r}), 2))) AS norm FROM w LEFT JOIN known USING (word) GROUP BY ALL),
c AS (SELECT whole, passage, template, license, rank, sum(tf * idf * weight) AS dot FROM w JOIN weights USING (word) WHERE whole = (rank = 2) GROUP BY ALL),
s AS (SELECT r, rank, license, round(dot / norm, 9) AS cosine FROM p JOIN c USING (whole, passage) JOIN n USING (whole, passage) WHERE round(dot / norm, 9) >= {LEAST}),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY rank DESC, cosine DESC, license) = 1),
own AS (SELECT g.*, o.rank, o.license, o.cosine FROM g LEFT JOIN o USING (r)),
l AS (SELECT dir AS ancestor, license, cosine FROM own WHERE named AND license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY rank DESC, cosine DESC, license) = 1),
a AS (
  SELECT own.r, l.* FROM own JOIN l ON own.license IS NULL AND (own.dir = l.ancestor OR l.ancestor = '' OR starts_with(own.dir, l.ancestor || '/'))
  QUALIFY row_number() OVER (PARTITION BY own.r ORDER BY length(l.ancestor) DESC) = 1)
SELECT doc_id, path, coalesce(own.license, a.license) AS license, coalesce(own.cosine, a.cosine) AS cosine, a.ancestor AS inherited_from
FROM own LEFT JOIN a USING (r)
"""


SQL = _sql()
