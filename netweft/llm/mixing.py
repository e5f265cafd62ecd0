"""Mixing sources to target weights by nested hash thresholds.

Every row has a hash in [0, 2**60) of its id, text and source; rows that are equal in all three are numbered, and the
number is hashed in too, so that no group of rows is larger than its largest document. A source takes each of its documents ``whole`` times and
those whose hash lies below its threshold once more. The threshold comes from histograms, not from
sorting: tokens are summed by source and hash bucket, the bucket in which the running sum crosses
the budget is found, and only that boundary bucket is refined by further bits, level by level, until
it holds a single hash. A histogram of 2**20 buckets a source at most is stored once a round; its sums by the
first ten bits give the first level, the boundary's buckets in it the second, and the documents of
the boundary bucket, a millionth of the source's, summed by their hashes the third.

The rest that remains is smaller than the boundary document. ``FILLS`` further rounds offer it, in
the same way, to the documents not chosen whose size is at most the rest; in the last of them the
boundary document is taken too if that brings the sum nearer to the budget.

Budgets: weights repeat 5, 2, 1 over the sources by code point, null last; every source aims at its
share of all tokens, but at most ``LIMIT`` times its own; the excess goes to the others by weight
until none is above (water filling, closed form over the sources in order of saturation).

Only built-in functions run. Per-source tables have a row per source; they are joined as Spark's
adaptive plan sees fit by their measured size. The one window that is not by source runs over that
table of sources.

Equal rows are counted by the partition in which they are found, and numbered from the counts of the partitions before; only
these counts are shuffled, and what is unequal needs none. Which of several equal rows is taken is of no consequence, how many are is.

Defined cases: a null text has size 0 and takes 0; null and repeated ids are rows like others; a source whose size is 0 has
target 0; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, cut

WEIGHTS, LIMIT, FILLS = (5, 2, 1), 3, 2
#: Hash bits, and the leading ones that the two levels of the stored histogram resolve; the third level has all.
BITS, FINE, COARSE = 60, 20, 10


def _hash60(text: Column) -> Column:
    """60 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def first_hash(doc_id: Column, text: Column, source: Column) -> Column:
    """The hash of a row, if no other equals it in these three."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")), F.coalesce(source, F.lit(""))]
    return _hash60(F.concat_ws(":", *parts))


def copy_hash(h: Column, copy: Column) -> Column:
    """The hash of a row's equal number ``copy``; the first one's is the row's."""
    return F.when(copy == 0, h).otherwise(_hash60(F.concat_ws(":", h.cast("string"), copy.cast("string"))))


def _equals(rows: DataFrame) -> DataFrame:
    """``doc_id, source, size, h, part, before, n``, stored: of rows that others equal, how many a partition has and how many those before it have."""
    own = ["doc_id", "source", "size", "h"]
    counts = rows.groupBy(*own, "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*own).orderBy("part")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy(*own))
    several = counts.select("*", F.coalesce(before, F.lit(0)).alias("before"), total.alias("total")).where("total > 1")
    return cut(several.drop("total"), "mix-equal-rows")


def _same_row() -> Column:
    """Rows equal in id, text and source, the other side's columns having names with ``e_``."""
    return (F.col("h") == F.col("e_h")) & F.col("doc_id").eqNullSafe(F.col("e_doc_id")) & F.col("source").eqNullSafe(F.col("e_source")) & (F.col("size") == F.col("e_size"))


def _told_apart(rows: DataFrame, equals: DataFrame) -> DataFrame:
    """Rows ``doc_id, source, size, h`` with a hash of their own each."""
    if equals.isEmpty():
        return rows.drop("part")
    own = equals.select(*[F.col(c).alias(f"e_{c}") for c in ("doc_id", "source", "size", "h")]).distinct()
    single = rows.join(own, _same_row(), "left_anti").drop("part")
    numbered = equals.withColumn("copy", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)))
    return cut(single.unionByName(numbered.select("doc_id", "source", "size", copy_hash(F.col("h"), F.col("copy")).alias("h"))), "mix-rows")


def targets(sources: DataFrame) -> DataFrame:
    """``source, source_size, target`` of a table ``source, source_size``; a few rows, one per source."""
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    w = sources.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(everything))
    # In order of saturation: what is left for a source and those after it, by weight.
    order = [F.col("source_size") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("rate", (F.col("total") - LIMIT * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
    w = w.withColumn("open", F.col("rate") * F.col("weight") <= LIMIT * F.col("source_size"))
    rate = F.max(F.when(F.col("open"), F.struct(-F.col("source_size") / F.col("weight"), "rate"))).over(everything)["rate"]
    target = F.when(F.col("open"), F.coalesce(rate, F.lit(0.0)) * F.col("weight")).otherwise((LIMIT * F.col("source_size")).cast("double"))
    return w.select("source", "source_size", F.least(target, (LIMIT * F.col("source_size")).cast("double")).alias("target"))


def _crossing(sums: DataFrame, budgets: DataFrame, at: str, start: str) -> DataFrame:
    """Of ``source, {at}, size`` the first place where the running sum from ``start`` on crosses the budget.

    ``budgets`` and place, what lies below and what it holds; place is null where nothing crosses, ``all`` then being the whole sum.
    """
    b = budgets.withColumnRenamed("source", "s")
    joined = sums.join(b, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    summed = joined.withColumn("upto", F.col(start) + F.sum("size").over(Window.partitionBy("source").orderBy(at)))
    columns = [c for c in budgets.columns if c != "source"]
    first = F.min_by(F.struct(F.col(at).alias("at"), "upto", "size"), F.when(F.col("upto") > F.col("budget"), F.col(at)))
    found = summed.groupBy("source", *columns).agg(first.alias("x"), F.max("upto").alias("all"))
    return found.select("source", *columns, F.col("x.at").alias(at), (F.col("x.upto") - F.col("x.size")).alias("under"), F.col("x.size").alias("held"), "all")


def _thresholds(rows: DataFrame, budgets: DataFrame, nearest: bool) -> DataFrame:
    """``source, budget, threshold, got``: hashes below the threshold sum up to ``got``, at most the budget.

    ``nearest`` takes the boundary document too where that is nearer. Sources whose rows don't reach
    their budget get them all. ``rows``: source, h, size; ``budgets``: source, budget.
    """
    # One stored histogram serves the two upper levels; only rows of the boundary bucket are looked at again.
    fine = cut(rows.groupBy("source", F.shiftright("h", BITS - FINE).alias("fine")).agg(F.sum("size").alias("size")), "mix-histogram")
    coarse = fine.groupBy("source", F.shiftright("fine", FINE - COARSE).alias("coarse")).agg(F.sum("size").alias("size"))
    one = _crossing(coarse, budgets.withColumn("zero", F.lit(0).cast("long")), "coarse", "zero")
    reached = one.where("coarse IS NOT NULL").select("source", "budget", F.col("coarse").alias("c"), F.col("under").alias("below"))
    inside = fine.join(reached.select(F.col("source").alias("s"), "c"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("fine", FINE - COARSE) == F.col("c"))).select("source", "fine", "size")
    two = _crossing(inside, reached.drop("c"), "fine", "below").select("source", "budget", "fine", F.col("under").alias("below"))
    everything = one.where("coarse IS NULL").select("source", "budget", F.lit(None).cast("long").alias("fine"), F.col("all").alias("below"))
    state = cut(two.unionByName(everything), "mix-level")
    last = state.where("fine IS NOT NULL")
    boundary = rows.join(last.select(F.col("source").alias("s"), "fine"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", BITS - FINE) == F.col("fine"))).groupBy("source", "h").agg(F.sum("size").alias("size"))
    three = _crossing(boundary, last.drop("fine"), "h", "below")
    up = (F.col("under") + F.col("held") - F.col("budget") <= F.col("budget") - F.col("under")) & F.lit(nearest)
    found = three.select("source", "budget", (F.col("h") + up.cast("long")).alias("threshold"), (F.col("under") + F.when(up, F.col("held")).otherwise(0)).alias("got"))
    return found.unionByName(state.where("fine IS NULL").select("source", "budget", F.lit(1 << BITS).alias("threshold"), F.col("below").alias("got")))


def _size(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _extra(upto: int) -> Column:
    """Whether one of the first rounds takes a row once more: below its threshold and no larger than what that round could take."""
    taken = F.lit(False)
    for k in range(upto):
        taken = taken | F.coalesce((F.col("h") < F.col(f"threshold_{k}")) & ((F.col("size") <= F.col(f"most_{k}")) if k else F.lit(True)), F.lit(False))
    return (F.col("size") > 0) & taken


def _decide(rows: DataFrame) -> DataFrame:
    """Per source ``source, source_size, target, whole`` and each round's threshold and largest size."""
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = cut(sources.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    for k in range(1 + FILLS):
        asking = plan.where("budget > 0")
        mine = asking.withColumnRenamed("source", "s").select("s", "budget", *[c for c in plan.columns if c.startswith(("threshold_", "most_"))])
        free = rows.join(mine, F.col("source").eqNullSafe(F.col("s"))).where(~_extra(k)).where("size > 0")
        free = (free.where("size <= budget") if k else free).select("source", "h", "size")
        rest = _thresholds(free, asking.select("source", "budget"), k == FILLS)
        joined = plan.withColumnRenamed("budget", f"most_{k}").join(rest.select(F.col("source").alias("s"), F.col("threshold").alias(f"threshold_{k}"), (F.col("budget") - F.col("got")).alias("budget")), F.col("source").eqNullSafe(F.col("s")), "left")
        # A source none of whose free documents fit has no threshold and is done.
        plan = cut(joined.drop("s"), "mix-plan")
    return plan


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    joined = rows.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return joined.withColumn("repeats", F.when(F.col("size") > 0, F.col("whole") + _extra(1 + FILLS).cast("long")).otherwise(0).cast("long"))


def _with_hash(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    source = F.col(source_col).cast("string")
    return docs.select(*more, F.col(id_col).alias("doc_id"), source.alias("source"), _size(text_col).alias("size"), first_hash(F.col(id_col), F.col(text_col), source).alias("h"), F.spark_partition_id().alias("part"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: ``doc_id, size, source, source_size, target, repeats, taken``."""
    found = cut(_with_hash(docs, id_col, text_col, source_col), "mix-sizes")
    rows = _told_apart(found, _equals(found))
    out = _with_plan(rows, _decide(rows.select("source", "size", "h")))
    return out.select("doc_id", "size", "source", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, with their own columns, as often as the mix takes them; only texts that others equal are shuffled."""
    rows = _with_hash(docs, id_col, text_col, source_col, F.struct("*").alias("row"))
    found = cut(rows.drop("row"), "mix-sizes")
    equals = _equals(found)
    plan = _decide(_told_apart(found, equals).select("source", "size", "h"))
    if not equals.isEmpty():
        own = ["doc_id", "source", "size", "h"]
        several = equals.select(*[F.col(c).alias(f"e_{c}") for c in own]).distinct()
        # Partitions are those of the stored copies, whatever the rows' own were.
        copies = cut(rows.drop("part").join(several, _same_row(), "left_semi").withColumn("part", F.spark_partition_id()), "mix-copies")
        places = _equals(copies.drop("row")).select(*[F.col(c).alias(f"e_{c}") for c in own], F.col("part").alias("e_part"), "before")
        within = Window.partitionBy(*own, "part").orderBy("h")
        numbered = copies.join(places, _same_row() & (F.col("part") == F.col("e_part"))).withColumn("copy", F.col("before") + F.row_number().over(within) - 1)
        numbered = numbered.select("row", *own[:3], copy_hash(F.col("h"), F.col("copy")).alias("h"))
        rows = rows.join(several, _same_row(), "left_anti").select("row", *own).unionByName(numbered)
    taken = _with_plan(rows, plan).where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return taken.select("row.*")


def _sql() -> str:
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0e0 WHEN 1 THEN 2.0e0 ELSE 1.0e0 END"
    ctes = [
        "d0 AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')), ':', coalesce(source, ''))), 1, 15) AS BIGINT) AS h0 FROM documents)",
        "d1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, h0) - 1 AS copy FROM d0)",
        "d AS (SELECT doc_id, source, size, CASE WHEN copy = 0 THEN h0 ELSE CAST('0x' || substr(md5(concat(h0, ':', copy)), 1, 15) AS BIGINT) END AS h FROM d1)",
        f"s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {weight} AS weight FROM d GROUP BY source)",
        f"""s1 AS (SELECT *, (sum(source_size) OVER () - {LIMIT} * coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM s0)""",
        f"s2 AS (SELECT *, rate * weight <= {LIMIT} * source_size AS unsaturated FROM s1)",
        f"""s3 AS (SELECT source, source_size, CAST(CASE WHEN unsaturated THEN least(weight * (SELECT rate FROM s2 WHERE unsaturated ORDER BY CAST(source_size AS DOUBLE) / weight, rate DESC LIMIT 1), {LIMIT} * source_size)
          ELSE {LIMIT} * source_size END AS DOUBLE) AS target FROM s2)""",
        "s4 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM s3)",
        "p0 AS (SELECT d.*, s4.source_size, s4.target, s4.whole, 0 AS extra, s4.target - s4.whole * s4.source_size AS budget FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source)",
    ]
    for k in range(1 + FILLS):
        fits = "AND size <= budget" if k else ""
        free = f"extra = 0 AND size > 0 AND budget > 0 {fits}"
        near = "OR (below <= budget AND upto - budget <= budget - below)" if k == FILLS else ""
        ctes += [
            f"c{k} AS (SELECT *, {free} AS free, sum(CASE WHEN {free} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) AS upto, sum(CASE WHEN {free} THEN size ELSE 0 END) OVER (PARTITION BY source, h) AS own FROM p{k})",
            f"n{k} AS (SELECT * EXCLUDE (extra, free, upto, own), extra + CASE WHEN free AND (upto <= budget {near.replace('below', '(upto - own)')}) THEN 1 ELSE 0 END AS extra, CASE WHEN free AND (upto <= budget {near.replace('below', '(upto - own)')}) THEN size ELSE 0 END AS now FROM c{k})",
            f"p{k + 1} AS (SELECT * EXCLUDE (budget, now), budget - sum(now) OVER (PARTITION BY source) AS budget FROM n{k})",
        ]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, size, source, source_size, target, CAST(CASE WHEN size > 0 THEN whole + extra ELSE 0 END AS BIGINT) AS repeats, CAST(CASE WHEN size > 0 THEN (whole + extra) * size ELSE 0 END AS BIGINT) AS taken FROM p{1 + FILLS}"


SQL = _sql()
