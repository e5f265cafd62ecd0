"""Prefix trie of conversations: a Patricia construction over sorted pieces of bounded length.

``rebuilt`` gives conversations as turns: depth, a 128-bit name of (depth, role, text) and the text's bytes. A prefix
goes by its depth and the sums of its turns' names, which a running sum gives at every depth.

``nodes`` cuts each conversation into segments of ``SEGMENT`` turns, so that no row grows with a conversation, and
counts equal segments below equal prefixes once. The distinct segments are sorted by (prefix, turns); within a sorted
partition, neighbours' common lengths give the trie's points by a stack: ends of segments (of conversations,
or of their first 64, 128, ... turns), and branches, where two segments part. Nothing else becomes a row: the turns between a
point and the one above it are its compressed edge. A node that several partitions hold lies on the path of the first or
last segment of each, so all nodes of these two paths are points, and equal points are summed.

On this compressed tree the counts are summed: members are sums over segments, children are points counted by their parent,
leaves and saved tokens of subtrees by pointer doubling (a round for each doubling of the height). Then the
unary nodes of each edge are expanded: they have their point's members, one child, its leaves, and its saved tokens plus
a suffix sum of the edge.

Hot groups: turns are numbered by ranges of (conversation, turn), a long conversation over many tasks; equal conversations are one
segment from the first shuffle on; the ids that end at a node are joined by ranges of (node, id) to chunks of text before
the digest, which is sequential by its nature, reads a node's chunks as a stream.

Defined cases: turns of a conversation are ordered by turn (null first), equal ones by the digest of role and text; a null role
or text is empty; equal rows are turns each; turns without a conv_id belong to none and are left out;
``c - c % 5`` has the sign rule of SQL (-7 % 5 = -2); an empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_schema, cut

#: Turns of a segment; segments of a block, whose names are summed before blocks are.
SEGMENT, BLOCK = 64, 4096
#: Conversations that share a head, and most turns of a head, less one.
FAMILY, HEADS = 5, 9
#: Ids that one chunk of text holds.
CHUNK = 8192


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def family(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def _numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``c, part, pos, digest, size`` with places from 0, and ``c, part, n``: the turns that a range holds of a conversation.

    A conversation may lie in several ranges; its parts follow each other in order.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    order = [F.col("turn").asc_nulls_first(), "digest"]
    ranged = cut(turns.repartitionByRange("c", *order).withColumn("part", F.spark_partition_id()), "trie-turns")
    within = Window.partitionBy("c", "part").orderBy(*order)
    local = ranged.withColumn("local", F.row_number().over(within) - 1).drop("turn")
    parts = cut(ranged.groupBy("c", "part").agg(F.count("*").alias("n")), "trie-parts")
    return local, parts


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``c, d, h1, h2, size`` of the rebuilt conversations (d from 1), and ``c, length`` of all of them, turnless ones included."""
    local, parts = _numbered(conversations)
    sizes = parts.groupBy("c").agg(F.sum("n").alias("own")).withColumn("h", head_length(F.col("c"))).withColumn("base", family(F.col("c")))
    bases = sizes.select(F.col("c").alias("base"), F.col("own").alias("there"))
    convs = sizes.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("there", F.lit(0))))
    convs = cut(convs.select("c", "base", "h", "head", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    # What a part's rows need, by part: the turns before it and the conversation's head.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = parts.withColumn("before", before).join(convs.select("c", "h", "head"), "c")
    placed = local.join(each.drop("n"), ["c", "part"]).withColumn("pos", F.col("before") + F.col("local"))
    tails = placed.where("pos >= h").select("c", (F.col("head") + F.col("pos") - F.col("h") + 1).alias("d"), "digest", "size")
    few = placed.where(F.col("pos") < HEADS - 1).select(F.col("c").alias("base"), "pos", "digest", "size")
    heads = few.join(convs.select("base", "c", "h"), "base").where("pos < h").select("c", (F.col("pos") + 1).alias("d"), "digest", "size")
    turns = tails.unionByName(heads)
    named = turns.select("c", F.col("d").cast("long").alias("d"), F.xxhash64("digest", "d", F.lit(1)).alias("h1"), F.xxhash64("digest", "d", F.lit(2)).alias("h2"), "size")
    return named, convs.select("c", F.col("length").cast("long").alias("length"))


def _wrapped(total: Column) -> Column:
    """A sum of longs, taken modulo 2**64 into a long."""
    two64 = F.lit(Decimal(1 << 64)).cast("decimal(38,0)")
    rest = F.pmod(total.cast("decimal(38,0)"), two64)
    return F.when(rest >= F.lit(Decimal(1 << 63)).cast("decimal(38,0)"), rest - two64).otherwise(rest).cast("long")


def _after(prefix: str, name: str) -> Column:
    """The name of the prefix that ends with a segment."""
    return _wrapped(F.aggregate("turns", F.col(prefix).cast("decimal(38,0)"), lambda total, turn: (total + turn[name]).cast("decimal(38,0)")))


def _sum(name: str) -> Column:
    return F.sum(F.col(name).cast("decimal(20,0)"))


def segments(turns: DataFrame) -> DataFrame:
    """``c, s, p1, p2, turns``: segments of each conversation with the name of the prefix before them."""
    s = F.floor((F.col("d") - 1) / SEGMENT).cast("long")
    cuts = turns.withColumn("s", s).groupBy("c", "s").agg(F.array_sort(F.collect_list(F.struct("d", "h1", "h2", "size"))).alias("turns"), _wrapped(_sum("h1")).alias("t1"), _wrapped(_sum("h2")).alias("t2"))
    cuts = cut(cuts, "trie-segments")
    first = cuts.where("s = 0").select("c", "s", F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "turns")
    # Conversations of several segments: sums of names before each, by blocks of segments, then within a block.
    long = cuts.where((F.col("s") > 0) | (F.size("turns") == SEGMENT)).select("c", "s", F.floor(F.col("s") / BLOCK).alias("block"), "t1", "t2")
    upto = Window.orderBy("block").partitionBy("c").rowsBetween(Window.unboundedPreceding, -1)
    blocks = long.groupBy("c", "block").agg(_sum("t1").alias("b1"), _sum("t2").alias("b2"))
    blocks = blocks.select("c", "block", F.sum("b1").over(upto).alias("b1"), F.sum("b2").over(upto).alias("b2"))
    inside = Window.partitionBy("c", "block").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    at = [_wrapped(F.coalesce(_sum(f"t{k}").over(inside), zero) + F.coalesce(f"b{k}", zero)).alias(f"p{k}") for k in (1, 2)]
    names = long.join(blocks, ["c", "block"]).select("c", "s", *at).where("s > 0")
    return first.unionByName(cuts.where("s > 0").join(names, ["c", "s"]).select("c", "s", "p1", "p2", "turns"))


POINTS = "depth long, k1 long, k2 long, up long, u1 long, u2 long, n long, first long, ends long, saves array<long>"


class _Stack:
    """Points of one sorted run of segments; ``out`` takes those that are complete."""

    def __init__(self, out: list[tuple]) -> None:
        self.out, self.open, self.trie = out, [], None

    def add(self, s: int, p: tuple[int, int], turns: np.ndarray, n: int, first: int, ends: int) -> None:
        """The next segment in order: ``turns`` has a row (h1, h2, size) per turn."""
        start = self.trie is None
        common = 0
        if self.trie == (s, *p):
            m = min(len(turns), len(self.turns))
            differ = (turns[:m] != self.turns[:m]).any(axis=1)
            common = int(differ.argmax()) if differ.any() else m
        self.close(common)
        self.trie, self.turns = (s, *p), turns
        names = np.vstack([np.array([p], np.int64).view(np.uint64), turns[:, :2].view(np.uint64)]).cumsum(axis=0, dtype=np.uint64)
        self.names = names.view(np.int64)
        if start:  # earlier partitions may hold any node of this path
            self.open = [[k, 0, None, 0] for k in range(1, len(turns))]
        self.open.append([len(turns), n, first, ends])

    def close(self, depth: int, path: bool = False) -> None:
        """Complete the points below ``depth``; with ``path`` all nodes above them are points too."""
        while self.open and self.open[-1][0] > depth:
            k, n, first, ends = self.open.pop()
            up = max(self.open[-1][0] if self.open else 0, depth, k - 1 if path else 0)
            s, base = self.trie[0], self.trie[0] * SEGMENT
            saves = self.turns[up:k, 2][::-1].cumsum()[::-1]
            self.out.append((base + k, *self.names[k].tolist(), base + up, *self.names[up].tolist(), n, first, ends, saves.tolist()))
            if up:
                if not self.open or self.open[-1][0] < up:
                    self.open.append([up, 0, None, 0])
                top = self.open[-1]
                top[1] += n
                top[2] = first if top[2] is None else min(top[2], first) if first is not None else top[2]


def points(parts: DataFrame, lengths: DataFrame) -> DataFrame:
    """The compressed tree but for its root: points by (depth, k1, k2) with the point above, members, ends, and the edge's suffix sums of bytes."""
    ended = parts.join(lengths, "c").withColumn("end", (F.col("s") * SEGMENT + F.size("turns") == F.col("length")).cast("long"))
    plain = F.transform("turns", lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["size"].alias("size")))
    # Equal segments are summed before they move.
    distinct = ended.withColumn("turns", plain).groupBy("s", "p1", "p2", "turns").agg(F.count("*").alias("n"), F.min("c").alias("first"), F.sum("end").alias("ends"))
    order = ["s", "p1", "p2", "turns"]
    ranged = cut(distinct, "trie-distinct").repartitionByRange(*order).sortWithinPartitions(*order)
    target = arrow_schema(parts.sparkSession, POINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack = _Stack(out)

        def given() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(target)], schema=target)
            out.clear()
            return made

        for batch in batches:
            lists = batch.column("turns")
            flat = lists.flatten()
            table = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1) if len(flat) else np.zeros((0, 3), np.int64)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            columns = [batch.column(c).to_pylist() for c in ("s", "p1", "p2", "n", "first", "ends")]
            for k, (s, p1, p2, n, first, ends) in enumerate(zip(*columns, strict=True)):
                stack.add(s, (p1, p2), table[bounds[k] : bounds[k + 1]], n, first, ends)
                if len(out) >= 1000:
                    yield given()
        stack.close(0, path=True)
        yield given()

    local = ranged.mapInArrow(run, POINTS)
    shared = [F.any_value(c).alias(c) for c in ("up", "u1", "u2", "saves")]
    return local.groupBy("depth", "k1", "k2").agg(*shared, F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("ends").alias("ends"))


def _subtrees(tree: DataFrame, names: list[str]) -> DataFrame:
    """``key`` and the sums of ``names`` over each subtree of ``key, above, ...``; above is null below the root.

    Pointer doubling: after round r a row has the sums of its descendants at less than 2**r steps, and the ancestor at 2**r.
    """
    state = cut(tree.select("key", "above", *names), "trie-sums")
    while not state.where("above IS NOT NULL").isEmpty():
        moving = state.where("above IS NOT NULL")
        sent = moving.groupBy(F.col("above").alias("key")).agg(*[F.sum(c).alias(c) for c in names]).withColumn("above", F.lit(None).cast(dict(state.dtypes)["above"]))
        next_up = state.select(F.col("key").alias("above"), F.col("above").alias("next"))
        hopped = moving.join(next_up, "above").select("key", F.col("next").alias("above"), *names)
        rest = state.where("above IS NULL")
        merged = hopped.unionByName(rest).unionByName(sent.select("key", "above", *names))
        state = cut(merged.groupBy("key").agg(F.max("above").alias("above"), *[F.sum(c).alias(c) for c in names]), "trie-sums")
    return state.drop("above")


def _digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of ``key, c``: the ids of a key in numeric order, joined by commas, as a stream of chunks."""
    ranged = ends.repartitionByRange("key", "c").sortWithinPartitions("key", "c")
    key_type = ends.schema["key"].dataType.simpleString()
    chunk_schema = f"key {key_type}, at long, ids string"
    chunk_target, digest_target = (arrow_schema(ends.sparkSession, x) for x in (chunk_schema, f"key {key_type}, ends_sha256 string"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("c").to_pylist()
            out, start = [], 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[start] or k - start == CHUNK:
                    out.append((keys[start], ids[start], ",".join(map(str, ids[start:k]))))
                    start = k
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(chunk_target)], schema=chunk_target)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            out = []
            for found, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if found != key or state is None:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = found, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(digest_target)], schema=digest_target)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((key, state.hexdigest()), digest_target, strict=True)], schema=digest_target)

    joined = ranged.mapInArrow(chunks, chunk_schema)
    n = ends.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return joined.repartition(int(n), "key").sortWithinPartitions("key", "at").mapInArrow(digests, f"key {key_type}, ends_sha256 string")


NONE = hashlib.sha256(b"").hexdigest()


def nodes(conversations: tuple[DataFrame, DataFrame]) -> DataFrame:
    """A row per node of the trie over ``rebuilt`` conversations."""
    turns, lengths = conversations
    key, above = F.struct("depth", "k1", "k2"), F.struct(F.col("up").alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2"))
    parts = segments(turns)
    found = cut(points(parts, lengths).withColumn("key", key).withColumn("above", above), "trie-points")
    children = found.groupBy(F.col("above").alias("key")).agg(F.count("*").alias("n_children"))
    first = found.select(F.col("key").alias("above"), F.col("first").alias("parent"))
    tree = found.join(children, "key", "left").join(first, "above", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    edge = (F.col("n") - 1) * F.element_at("saves", 1)
    tree = cut(tree.withColumn("edge", edge).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-tree")
    # Points below the root point nowhere: the root's sums are those of all points.
    sums = _subtrees(tree.select("key", F.when(F.col("up") > 0, F.col("above")).alias("above"), "edge", "leaf"), ["edge", "leaf"])
    summed = tree.drop("edge", "leaf").join(sums, "key")

    # Names at the ends of conversations; the digest of a node's ids goes with its point.
    last = parts.join(lengths, "c").where(F.col("s") * SEGMENT + F.size("turns") == F.col("length"))
    ends = last.select("c", F.col("length").alias("depth"), _after("p1", "h1").alias("k1"), _after("p2", "h2").alias("k2")).select("c", key.alias("key"))
    bare = lengths.where("length = 0").select("c", F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2")).alias("key"))
    digests = cut(_digests(ends.unionByName(bare)), "trie-ends")

    point = summed.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))
    spread = point.select("*", F.posexplode("saves").alias("k", "suffix")).withColumn("d", F.col("up") + 1 + F.col("k"))
    bottom = F.col("d") == F.col("depth")
    rows = spread.select(
        F.col("first").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("k") > 0, F.col("first")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaf").alias("n_leaves"),
        # The subtree's sum holds the whole edge; a node has the part from itself on.
        (F.col("edge") - (F.col("n") - 1) * (F.element_at("saves", 1) - F.col("suffix"))).alias("saved_tokens"),
        F.when(bottom, F.col("ends_sha256")).otherwise(F.lit(NONE)).alias("ends_sha256"),
    )

    everyone = lengths.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    whole = tree.agg(F.coalesce(F.sum((F.col("up") == 0).cast("long")), F.lit(0)).alias("n_children"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("edge"), F.lit(0)).alias("saved_tokens"))
    at_root = digests.where("key.depth = 0").select("ends_sha256").agg(F.max("ends_sha256").alias("ends_sha256"))
    root = everyone.join(F.broadcast(whole)).join(F.broadcast(at_root))  # one row each
    zero = F.lit(0).cast("long")
    root = root.select(
        "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"),
        F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
    )
    smallest = everyone.select(F.col("conv_id").alias("smallest"))
    rows = rows.join(F.broadcast(smallest)).withColumn("parent_conv_id", F.when((F.col("depth") == 1), F.col("smallest")).otherwise(F.col("parent_conv_id"))).drop("smallest")
    return rows.unionByName(root)


#: CRC-32 of the decimal id from the polynomial, byte by byte.
_CRC = """(SELECT c, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda acc, b: xor(acc >> 8, t.crc[1 + (xor(acc, b) & 255)]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 9 AS h FROM own, t)"""

SQL = f"""WITH RECURSIVE b AS (SELECT unnest(range(256)) AS i),
t AS (SELECT list(list_reduce(range(8), lambda acc, k: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, i) ORDER BY i) AS crc FROM b),
own AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS {_CRC},
re AS (SELECT own.c, list_concat(coalesce(base.turns, [])[1:h.h], own.turns[h.h + 1:]) AS turns FROM own JOIN h ON own.c = h.c LEFT JOIN own base ON base.c = own.c - own.c % 5),
m AS (SELECT c, len(turns) AS length, d, CASE WHEN d = 0 THEN '' ELSE sha256(CAST(turns[1:d] AS VARCHAR)) END AS key, CASE WHEN d = 0 THEN NULL WHEN d = 1 THEN '' ELSE sha256(CAST(turns[1:d - 1] AS VARCHAR)) END AS up,
  CASE WHEN d = 0 THEN 0 ELSE strlen(turns[d].t) END AS size FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM re)),
n AS (SELECT key, d, up, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size, sha256(coalesce(string_agg(CASE WHEN length = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM m GROUP BY key, d, up),
k AS (SELECT up AS key, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.key = k.key),
s AS (SELECT m.key, sum((f.n_convs - 1) * f.size) AS saved, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM f JOIN m ON f.conv_id = m.c AND m.d <= f.d GROUP BY m.key)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON f.key = s.key LEFT JOIN n p ON f.up = p.key"""
