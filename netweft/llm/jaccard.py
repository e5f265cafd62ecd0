"""N-gram Jaccard join of shingle sets, exact at any size of group.

Two documents link when the Jaccard distance of their sets is at most ``R`` = 1/4. Regions of document
pivots (level 3) decide among texts that are alike. Among all texts they can't: texts that share nothing are
at distance 1 from each other and from nearly every pivot, and a window of 2R = 1/2 around distance 1
holds everything, so a set would be replicated to nearly every region. Two levels before them therefore
form regions by shared shingles; what these replicate is decided by a bound on the overlap, not by
the triangle inequality.

Level 1: shingles are ordered, those that a bounded sample finds in many texts last. Linked sets must share
one of their first ``n - ceil(3n/4) + 1`` shingles in any common order, so each set is replicated to the regions
of these. A region of at most ``REGION`` sets gives its pairs; pairs whose shared shingles and what remains behind
them can't reach the overlap needed are dropped, and the others' distances are computed.

Level 2: the sets of larger regions are joined again, recursively, with shingles ordered by how many of
these sets hold them, the rarest first. Shingles held by one set alone link nothing.

Level 3: what still meets in a large region is alike. These regions, united where they overlap, are
joined by pivots that are documents: a set's Voronoi region is that of its nearest pivot; sets go there, those at the boundary (distance at
most that to the nearest plus 2R) to further ones, and the parts are joined in the same way until they
are small; there all overlaps are computed, by matrix products over shingles that many sets hold. A pair
is taken where the set of the smaller hash is at home, in the part of its nearest pivot, so once. A region beyond
``REGION_SETS`` or ``REGION_HASHES`` is first split in this way across the cluster; if pivots
don't split it, by pairs of blocks.

All links are found. Regions give their number for each set, weighted by the rows that the other set
stands for, and links that span their components; components follow by star contraction. Equal sets are
one class from the start and cost one set; rows of one set link with each other.

Shingles are identified by 64-bit hashes. Sets go by a 64-bit name; sets that share it, which a second
independent name shows, go by that one. Sampling affects the order of pivots only.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; repeated
rows are one class and linked; a null id takes the smallest id of its component, or null; texts of fewer than five words are one shingle;
an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .components import components
from .shared import arrow_kernel, arrow_schema, cut, discard, giving_back

WORDS, R = 5, 0.25
SHARED_MOST = 1 << 16
REGION, SAMPLE, COMMON_IN, COMMON_MOST = 32, 32_768, 2, 1 << 19
REGION_SETS, REGION_HASHES, PIVOTS, LEAF = 4096, 1 << 22, 16, 256
#: Sets of a region that hold a shingle from which on it is counted by matrix products, and columns of these.
HEAVY, CHUNK = 32, 1024
BITMAP = 1 << 22
_EPS = 1e-9


#: Bits of a set's first name; fewer make tests meet sets of one name.
NAME_BITS = 64


def _hash(s: np.ndarray, factor: int) -> int:
    """A 64-bit hash of a set of hashes, as a signed number."""
    x = tokens.mix(s * np.uint64(factor) + np.uint64(len(s))).sum(dtype=np.uint64, keepdims=True)
    return int(tokens.mix(x + np.uint64(len(s))).view(np.int64)[0])


def _names(s: np.ndarray, bits: int) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set. Sets whose first ones agree and second ones don't go by the second."""
    return _hash(s, 0xD6E8FEB86659FD93) >> 64 - bits, _hash(s, 0x8CB92BA72F3D8DD7)


def _name(s: np.ndarray, bits: int, shared: set[int]) -> int:
    """The name that a set goes by: the second one if other sets have the same first one."""
    x = _hash(s, 0xD6E8FEB86659FD93) >> 64 - bits
    return _hash(s, 0x8CB92BA72F3D8DD7) if x in shared else x


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1 if n else 0


def _large_arrays(values: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)))


# -- level 1: sets, names and first shingles ---------------------------------------------------------


def _common(docs: DataFrame) -> np.ndarray:
    """Shingles that at least COMMON_IN of about SAMPLE documents (those with the smallest id hashes) hold; at most COMMON_MOST."""
    total = docs.count()
    if not total:
        return np.zeros(0, np.uint64)
    share = min(1.0, SAMPLE / total)
    drawn = docs.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for block in tokens.blocks(batch.column("text")):
            sets = list(tokens.shingles(block, WORDS))
            yield {"sig": [_hash(s, 1) for s in sets], "h": _large_arrays(sets)}

    held = arrow_kernel(drawn, "sig long, h array<long>", rows).dropDuplicates(["sig"]).select(F.explode("h").alias("h"))
    counts = cut(held.groupBy("h").count().where(F.col("count") >= COMMON_IN), "jaccard-common")
    # As many of the largest counts, taken whole, as fit in COMMON_MOST.
    least, some = 1 << 40, 0
    for r in counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).collect():  # at most SAMPLE rows
        some += r["n"]
        if some > COMMON_MOST:
            break
        least = r["count"]
    found = counts.where(F.col("count") >= least).select("h").toArrow().column("h").to_numpy()
    discard(counts)
    return np.sort(found.view(np.uint64))


def _ordered(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first pivots of a set: by hash, common ones last."""
    if len(common) and len(s):
        late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        s = np.concatenate([s[~late], s[late]])
    return s[: prefix_length(len(s))]


def _signatures(docs: DataFrame, common) -> DataFrame:
    """``doc_id, row, n, sig, other, pivots``: two names, and the pivots of the first row in each task that has a set."""
    schema = "doc_id long, row long, n long, sig long, other long, pivots array<long>"
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            for block in tokens.blocks(batch.column("text")):
                n, names, pivots = [], [], []
                for s in tokens.shingles(block, WORDS):
                    x = _names(s, NAME_BITS)
                    n.append(len(s))
                    names.append(x)
                    pivots.append(s[:0] if x in seen else _ordered(s, common.value))
                    seen.add(x)
                ids = [batch.column(c).slice(block.rows.start, len(block.rows)) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n, pa.int64()), *(pa.array([x[k] for x in names], pa.int64()) for k in range(2)), _large_arrays(pivots).cast(target.field("pivots").type)], schema=target)

    return docs.mapInArrow(giving_back(run), schema)


def _shared_names(rows: DataFrame) -> list[int]:
    """First names that different sets have: among N sets about N**2 / 2**65, so none or few."""
    found = rows.where("n > 0").groupBy("sig").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x != y").select("sig").take(SHARED_MOST + 1)
    if len(found) > SHARED_MOST:
        raise RuntimeError("too many sets share a 64-bit name")
    return [r["sig"] for r in found]


# -- regions of shared shingles ---------------------------------------------------------------

_PAIRS = "a long, b long, i int, j int, na long, nb long"


def _regions(rows: DataFrame) -> DataFrame:
    """From ``key, n, sig, pos`` the pairs (a, b) of small regions and, with i null, members (a) of large regions (b).

    Rows arrive sorted, so that a region is a run; of a large one no more than a batch is held.
    """
    target = arrow_schema(rows.sparkSession, _PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        large: int | None = None  # the key of the large region that is going on

        def members(key: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(sig), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(key), none, none, pa.nulls(len(sig), pa.int64()), pa.nulls(len(sig), pa.int64())], schema=target)

        def whole(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Of complete runs."""
            key, n, sig, pos = x
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
            size = np.diff(np.append(start, len(key)))
            of = np.repeat(size, size)
            if (of > REGION).any():
                yield members(key[of > REGION], sig[of > REGION])
            keep = (of > 1) & (of <= REGION)
            key, n, sig, pos = (y[keep] for y in (key, n, sig, pos))
            found = []
            for d in range(1, min(REGION, len(key))):
                i = np.flatnonzero((key[d:] == key[:-d]) & (4 * n[:-d] >= 3 * n[d:]))
                if not (key[d:] == key[:-d]).any():
                    break
                found.append((sig[i], sig[i + d], pos[i], pos[i + d], n[i], n[i + d]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*found, strict=True), target, strict=True)], schema=target)

        for batch in batches:
            x = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "sig", "pos")]
            if held is not None:
                x = [np.concatenate(y) for y in zip(held, x, strict=True)]
            if not len(x[0]):
                continue
            new = np.concatenate([[True], (x[0][1:] != x[0][:-1]) | (x[2][1:] != x[2][:-1])])
            x = [y[new] for y in x]
            if large is not None:
                more = int(np.searchsorted(x[0] != large, True)) if x[0][0] == large else 0
                more = more if (x[0] != large).any() else len(x[0]) * (x[0][0] == large)
                if more:
                    yield members(x[0][:more], x[2][:more])
                    x = [y[more:] for y in x]
            large, held = (large, None) if not len(x[0]) else (None, x)
            if held is None:
                continue
            last = int(np.flatnonzero(np.concatenate([[True], x[0][1:] != x[0][:-1]]))[-1])
            yield from whole([y[:last] for y in x])
            held = [y[last:] for y in x]
            if len(held[0]) > REGION:
                yield members(held[0], held[2])
                large, held = int(held[0][0]), None
        if held is not None:
            yield from whole(held)

    return rows.repartition("key").sortWithinPartitions("key", "n", "sig").mapInArrow(giving_back(run), _PAIRS)


def _near(pairs: DataFrame) -> DataFrame:
    """Pairs whose shared pivots, and what lies behind the last of them, can make up the overlap that a link needs."""
    summed = pairs.where("i IS NOT NULL").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    most = F.col("c") + F.least(F.col("na") - 1 - F.col("i"), F.col("nb") - 1 - F.col("j"))
    return summed.where(7 * most >= 3 * (F.col("na") + F.col("nb"))).select("a", "b")


def _bitmap(sigs: DataFrame) -> np.ndarray:
    """A bitmap of BITMAP bits that has the low bits of all signatures: a filter of fixed size that lets all of them pass."""
    words = sigs.select(F.pmod("sig", F.lit(BITMAP)).alias("x")).groupBy(F.shiftright("x", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x % 32 as int))")).alias("bits"))
    table = np.zeros(BITMAP // 32, np.uint32)
    found = words.toArrow()  # at most BITMAP / 32 rows
    table[found.column("w").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def _sets(docs: DataFrame, sigs: DataFrame, shared: set[int]) -> DataFrame:
    """``sig, n, set`` and the other columns of ``sigs`` for each name in it."""
    passing = docs.sparkSession.sparkContext.broadcast(_bitmap(sigs.select("sig")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            for block in tokens.blocks(batch.column("text")):
                out: list[tuple[int, np.ndarray]] = []
                for s in tokens.shingles(block, WORDS):
                    x = _name(s, NAME_BITS, shared)
                    if x not in seen and passing.value[x % BITMAP]:
                        seen.add(x)
                        out.append((x, s))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([len(s) for _, s in out], pa.int64()), _large_arrays([s for _, s in out]).cast(target.field("set").type)], schema=target)

    schema = "sig long, n long, set array<long>"
    target = arrow_schema(docs.sparkSession, schema)
    found = docs.mapInArrow(giving_back(run), schema).join(sigs, "sig")
    out = found.groupBy(*sigs.columns, "n").agg(F.first("set").alias("set"))
    out.passing = passing
    return out


def _linked(docs: DataFrame, pairs: DataFrame, shared: set[int]) -> DataFrame:
    """The pairs ``a, b`` whose sets link: each set travels to its own place once and from there with each pair."""
    target = arrow_schema(docs.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_hash_sets(batch.column("one")), _hash_sets(batch.column("two")), strict=True):
                x, y = (x, y) if len(x) >= len(y) else (y, x)
                # As unsigned numbers sets are in order; so they are as signed ones but for a turn.
                x = np.sort(x)
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(7 * both >= 3 * (len(x) + len(y)))
            if any(keep):
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], schema=target)

    sets = _sets(docs, cut(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), "jaccard-wanted"), shared)
    one = pairs.join(sets.select(F.col("sig").alias("a"), F.col("set").alias("one")), "a")
    out = one.join(sets.select(F.col("sig").alias("b"), F.col("set").alias("two")), "b").select("a", "b", "one", "two").mapInArrow(giving_back(run), "a long, b long")
    out.passing = sets.passing
    return out


# -- regions of document pivots ---------------------------------------------------------------------


class Region:
    """Sets (sorted distinct hashes) in the order of their ids, the rows each stands for, and what is found about them.

    ``home`` says in which region a set's pairs with sets of larger ids are taken; of two sets with the
    same ``half`` (0 or 1, -1 for none) the pair is taken elsewhere.
    """

    def __init__(self, ids: list[int], sets: list[np.ndarray], home: np.ndarray | None = None, rows: np.ndarray | None = None, half: np.ndarray | None = None) -> None:
        k = len(ids)
        self.ids, self.n = ids, np.array([len(s) for s in sets])
        self.all = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.home = np.ones(k, bool) if home is None else home
        self.rows = np.ones(k, np.int64) if rows is None else rows
        self.half = np.full(k, -1) if half is None else half
        self.label = np.arange(k)
        self.counts = np.zeros(k, np.int64)
        self.links: list[tuple[int, int]] = []

    def of(self, members: np.ndarray) -> np.ndarray:
        return self.all if len(members) == len(self.n) else np.concatenate([self.all[self.at[m] : self.at[m + 1]] for m in members])

    def distance(self, x: int, members: np.ndarray) -> np.ndarray:
        """Jaccard distances."""
        own, other = self.all[self.at[x] : self.at[x + 1]], self.of(members)
        hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
        both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(self.n[members])[:-1]]), dtype=np.int64)
        return 1 - both / (self.n[x] + self.n[members] - both)

    def join(self, members: np.ndarray, home: np.ndarray) -> None:
        """All links between members (rising) whose first set is at home here."""
        if len(members) < 2 or not home.any():
            return
        if len(members) > LEAF:
            # Pivots: each the member farthest from those before, until all lie within R of one.
            pivot, table, nearest = int(members[0]), [], np.full(len(members), np.inf)
            while True:
                table.append(self.distance(pivot, members))
                nearest = np.minimum(nearest, table[-1])
                far = int(nearest.argmax())
                if len(table) == PIVOTS or nearest[far] <= R:
                    break
                pivot = int(members[far])
            inside = np.array(table) <= nearest + 2 * R + _EPS
            if inside.sum(1).max() <= 0.8 * len(members):
                own = np.argmin(table, 0)
                for k, part in enumerate(inside):
                    self.join(members[part], (home & (own == k))[part])
                return
        self.compare(members, home)

    def compare(self, members: np.ndarray, home: np.ndarray) -> None:
        n, k = self.n[members], len(members)
        column, inverse = np.unique(self.of(members), return_inverse=True)
        order = np.argsort(inverse, kind="stable")  # by shingle, then by member
        shingle, member = inverse[order], np.repeat(np.arange(k), n)[order]
        df = np.bincount(shingle, minlength=len(column))
        row = np.where(home, np.cumsum(home) - 1, -1)
        both = np.zeros((int(home.sum()), k), np.float32)
        light = (df[shingle] > 1) & (df[shingle] < HEAVY)
        c, m = shingle[light], member[light]
        for d in range(1, HEAVY - 1):
            same = c[d:] == c[:-d]
            if not same.any():
                break
            x, y = m[:-d][same], m[d:][same]
            np.add.at(both, (row[x[home[x]]], y[home[x]]), np.float32(1))
        heavy = df[shingle] >= HEAVY
        c, m = np.unique(shingle[heavy], return_inverse=True)[1], member[heavy]
        cuts = np.searchsorted(c, np.arange(0, (c[-1] if len(c) else -1) + 1 + CHUNK, CHUNK))
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            held = np.zeros((k, CHUNK), np.float32)
            held[m[start:stop], c[start:stop] % CHUNK] = 1
            at_home = held[home]
            for r in range(0, len(at_home), CHUNK):
                both[r : r + CHUNK] += at_home[r : r + CHUNK] @ held.T
        half, rows = self.half[members], self.rows[members]
        for x, overlap in zip(np.flatnonzero(home).tolist(), both, strict=True):
            y = x + 1 + np.flatnonzero(7 * overlap[x + 1 :].astype(np.int64) >= 3 * (n[x] + n[x + 1 :]))
            y = y[(half[y] < 0) | (half[y] != half[x])]
            if not len(y):
                continue
            self.counts[members[x]] += rows[y].sum()
            self.counts[members[y]] += rows[x]
            first = self.label[members[x]]
            for other in np.unique(self.label[members[y]]).tolist():
                if other != first:
                    z = int(members[y[np.argmax(self.label[members[y]] == other)]])
                    self.links.append((self.ids[members[x]], self.ids[z]))
                    self.label[self.label == other] = first


_FOUND = "a long, b long, c long"


def _hash_sets(column: pa.Array) -> list[np.ndarray]:
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _join_regions(regions: DataFrame) -> DataFrame:
    """Of ``region, sig, set, home, m, half``, each region small enough for one task: spanning links ``a, b`` and, with b null, the rows c that a links with."""
    target = arrow_schema(regions.sparkSession, _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, bool, int, int]] = []
        current = None

        def joined() -> Iterator[pa.RecordBatch]:
            ids, sets, home, rows, half = zip(*held, strict=True)
            region = Region(list(ids), [np.sort(s) for s in sets], np.array(home), np.array(rows), np.array(half))
            region.join(np.arange(len(ids)), region.home)
            some = np.flatnonzero(region.counts).tolist()
            out = [(a, b, None) for a, b in region.links] + [(ids[k], None, int(region.counts[k])) for k in some]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], schema=target)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("region", "sig", "home", "m", "half")]
            for key, sig, home, m, half, s in zip(*columns, _hash_sets(batch.column("set")), strict=True):
                if key != current:
                    if len(held) > 1:
                        yield from joined()
                    held, current = [], key
                held.append((sig, s.copy(), home, m, half))
        if len(held) > 1:
            yield from joined()

    return regions.select("region", "sig", "set", "home", "m", "half").repartition("region").sortWithinPartitions("region", "sig").mapInArrow(giving_back(run), _FOUND)


def _split(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Voronoi parts of large regions by sampled document pivots: rows ``region, parent, sig, n, set, home, m``."""
    schema = "region long, parent long, sig long, n long, set array<long>, home boolean, m long"
    target = arrow_schema(regions.sparkSession, schema)
    big = regions.join(sizes, "region").withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "sig"), F.col("parts")))
    drawn = big.where(F.pmod(F.xxhash64(F.lit(4), "region", "sig"), F.lit(1 << 20)) * F.col("sets") < F.lit(4 * PIVOTS << 20))
    ranked = drawn.withColumn("k", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64(F.lit(4), "region", "sig"), "sig"))).where(F.col("k") <= PIVOTS)
    pivots = ranked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    columns = ("sig", "n", "set", "home", "m")
    rows = pivots.select("region", "salt", F.lit(0).alias("role"), *columns).unionByName(big.select("region", "salt", F.lit(1).alias("role"), *columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, sets = None, [], []
        for batch in batches:
            out: list[tuple] = []
            for key, salt, role, sig, n, home, m, s in zip(*(batch.column(c).to_pylist() for c in ("region", "salt", "role", "sig", "n", "home", "m")), _hash_sets(batch.column("set")), strict=True):
                if (key, salt) != current:
                    current, ids, sets = (key, salt), [], []
                if role == 0:
                    ids.append(sig)
                    sets.append(np.sort(s))
                    continue
                d = Region([sig, *ids], [np.sort(s), *sets]).distance(0, np.arange(1, len(ids) + 1))
                own = int(d.argmin())
                for k in np.flatnonzero(d <= d[own] + 2 * R + _EPS).tolist():
                    out.append((int(tokens.mix(np.array([(key * 31 + ids[k]) % (1 << 64)], np.uint64)).view(np.int64)[0]), key, sig, n, s, home and k == own, m))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(target)], schema=target)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(target)], schema=target)

    return rows.repartition("region", "salt").sortWithinPartitions("region", "salt", "role", "sig").mapInArrow(giving_back(run), schema)


def _sized(regions: DataFrame, most_sets: int, most_hashes: int) -> DataFrame:
    parts = F.ceil(F.greatest(F.col("sets") / most_sets, F.col("hashes") / most_hashes)).cast("long")
    return regions.groupBy("region").agg(F.count("*").alias("sets"), F.sum("n").alias("hashes")).withColumn("parts", parts)


def join_regions(regions: DataFrame, most_sets: int = REGION_SETS, most_hashes: int = REGION_HASHES) -> DataFrame:
    """Links ``a, b`` that span the components of each region of a stored table ``region, sig, n, set``, whatever its size."""
    return found_in(regions.withColumn("m", F.lit(1).cast("long")), most_sets, most_hashes).where("b IS NOT NULL").select("a", "b")


def found_in(regions: DataFrame, most_sets: int = REGION_SETS, most_hashes: int = REGION_HASHES) -> DataFrame:
    """What ``_join_regions`` finds in a stored table ``region, sig, n, set, m``, a region being of any size; counts of a set may come in several rows."""
    none = F.lit(-1).alias("half")
    regions, found = regions.withColumn("home", F.lit(True)), None
    while True:
        sizes = cut(_sized(regions, most_sets, most_hashes), "jaccard-sizes")
        small = sizes.where("parts = 1 AND sets > 1").select("region")
        part = cut(_join_regions(regions.join(small, "region", "left_semi").select("*", none)), "jaccard-links")
        found = part if found is None else found.unionByName(part)
        large = sizes.where("parts > 1").select("region", "sets", "parts")
        if large.isEmpty():
            return found
        parts = cut(_split(regions, large), "jaccard-parts")
        # Parts that are nearly their whole parent don't shrink.
        state = parts.groupBy("region", "parent").agg(F.count("*").alias("now")).join(large.select(F.col("region").alias("parent"), "sets"), "parent")
        stuck = cut(state.where("now > 0.8 * sets").select("parent").distinct(), "jaccard-stuck")
        shrunk = parts.join(stuck, "parent", "left_anti").select("region", "sig", "n", "set", "home", "m")
        whole = regions.join(stuck.withColumnRenamed("parent", "region"), "region", "left_semi")
        found = found.unionByName(cut(_join_regions(_blocks(whole, sizes)), "jaccard-links"))
        regions = cut(shrunk, "jaccard-regions")


def _blocks(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each pair of blocks of a region as a region; two sets of one block are compared where it meets itself."""
    r = regions.join(sizes.select("region", (2 * F.col("parts")).alias("blocks")), "region").withColumn("x", F.pmod(F.xxhash64(F.lit(6), "sig"), F.col("blocks")))
    r = r.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    half = F.when(F.col("x") == F.col("y"), -1).when(F.col("x") < F.col("y"), 0).otherwise(1)
    return r.select(F.xxhash64("region", F.least("x", "y"), F.greatest("x", "y")).alias("region"), "sig", "n", "set", "home", "m", half.alias("half"))


# -- the operator -----------------------------------------------------------------------------------


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for each row; the last are the other rows within ``R``.

    With ``row_col``, an integer key of the rows, also ``row`` and ``is_first``, which is true for one
    row of each component, that of the smallest id (null last) and key, and for rows in none.
    """
    spark = docs.sparkSession
    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    common = spark.sparkContext.broadcast(_common(docs))
    with_pivots = cut(_signatures(docs, common), "jaccard-signatures")
    common.destroy()
    taken = set(_shared_names(with_pivots))
    named = with_pivots
    if taken:
        named = with_pivots.withColumn("sig", F.when(F.col("sig").isin(*taken), F.col("other")).otherwise(F.col("sig")))
    rows = named.where(F.size("pivots") > 0).select("n", "sig", F.posexplode("pivots").alias("pos", "key"))
    first = cut(_regions(rows), "jaccard-pairs")
    signed = cut(named.select("doc_id", "row", "n", "sig"), "jaccard-ids")
    discard(with_pivots)
    members = cut(first.where("i IS NULL").select(F.col("a").alias("sig")).distinct(), "jaccard-members")
    near = _near(first)
    # Pairs that are both members are joined at the next level, and their counts here lack large regions.
    both = near.join(members.withColumnRenamed("sig", "a"), "a", "left_semi").join(members.withColumnRenamed("sig", "b"), "b", "left_semi")
    near = cut(near.join(both, ["a", "b"], "left_anti"), "jaccard-near")

    # Level 2: the members, pivots rarest first.
    stands_for = cut(signed.where("n > 0").groupBy("sig").agg(F.count("*").alias("m")), "jaccard-rows")
    found = _sets(docs, members.join(stands_for, "sig"), taken)
    again = cut(found, "jaccard-sets")
    found.passing.destroy()
    held = again.select("sig", "n", F.explode("set").alias("key"))
    shared = held.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    pivots = held.join(shared, "key").groupBy("sig", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("p"))
    length = F.col("n") - F.ceil(3 * F.col("n") / 4) + 1 - (F.col("n") - F.size("p"))  # those held by one set alone come first
    rarest = pivots.where(length > 0).select("n", "sig", (F.col("n") - F.size("p")).cast("int").alias("alone"), F.posexplode(F.slice("p", 1, length.cast("int"))).alias("k", "x"))
    second = cut(_regions(rarest.select(F.col("x.key").alias("key"), "n", "sig", (F.col("k") + F.col("alone")).cast("int").alias("pos"))), "jaccard-pairs")
    large = second.where("i IS NULL").select(F.col("a").alias("sig"), F.col("b").alias("key"))
    inside = large.select("sig").distinct()
    nearer = _near(second)
    # Counts of pairs that may share a large region as well say nothing: these stay candidates.
    pairs = second.where("i IS NOT NULL").select("a", "b").distinct()
    open_pairs = pairs.join(inside.withColumnRenamed("sig", "a"), "a", "left_semi").join(inside.withColumnRenamed("sig", "b"), "b", "left_semi")

    # Level 3: what meets in large regions still, joined where regions overlap, is joined by document pivots.
    alike = large.join(large.groupBy("key").agg(F.min("sig").alias("least")), "key").select(F.col("sig").alias("a"), F.col("least").alias("b"))
    whole = cut(components(alike).select(F.col("node").alias("sig"), F.col("root").alias("region")), "jaccard-alike")
    inner = found_in(cut(again.join(whole, "sig"), "jaccard-regions"))
    # Pairs of one region are found there.
    candidates = near.unionByName(nearer).unionByName(open_pairs).distinct()
    placed = candidates.join(whole.select(F.col("sig").alias("a"), F.col("region").alias("of_a")), "a", "left").join(whole.select(F.col("sig").alias("b"), F.col("region").alias("of_b")), "b", "left")
    candidates = cut(placed.where("of_a IS NULL OR of_b IS NULL OR of_a != of_b").select("a", "b"), "jaccard-candidates")
    discard(first, second, again)
    found = _linked(docs, candidates, taken)
    outer = cut(found, "jaccard-links")
    found.passing.destroy()
    classes = components(inner.where("b IS NOT NULL").select("a", "b").unionByName(outer))
    ends = outer.union(outer.select("b", "a")).toDF("sig", "other")
    weighted = ends.join(stands_for.withColumnRenamed("sig", "other"), "other").select("sig", F.col("m").alias("c"))
    others = weighted.unionByName(inner.where("b IS NULL").select(F.col("a").alias("sig"), "c")).groupBy("sig").agg(F.sum("c").alias("c"))
    # Sets that stand for one row and link with nothing need no row here.
    known = stands_for.join(others, "sig", "left").join(classes.select(F.col("node").alias("sig"), "root"), "sig", "left").where("m > 1 OR c IS NOT NULL")

    rooted = signed.join(known, "sig", "left")
    n_links = F.coalesce("c", F.lit(0)) + F.coalesce("m", F.lit(1)) - 1
    rooted = rooted.select("doc_id", "row", "n", F.when(F.col("n") > 0, F.coalesce("root", "sig")).alias("root"), n_links.alias("n_links"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    least = rooted.where("n > 0").groupBy("root").agg(F.min(order).alias("least"))
    joined = rooted.join(least, "root", "left")
    is_first = (F.col("n") == 0) | order.eqNullSafe(F.col("least"))
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "n_links",
        *(["row", is_first.alias("is_first")] if row_col else []),
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each component (smallest id), and those that are in none, with their own columns.

    Rows get a key by being stored once; the decision is on it, so of rows that repeat an id or
    everything one stays.
    """
    keyed = cut(docs.select(F.struct("*").alias("all"), F.monotonically_increasing_id().alias("row")), "jaccard-rows-in")
    rows = keyed.select("row", F.col(f"all.{id_col}").alias("id"), F.col(f"all.{text_col}").alias("text"))
    first = join(rows, "id", "text", "row").where("is_first").select(F.col("row").alias("r"))
    return keyed.join(first, F.col("row") == F.col("r"), "left_semi").select("all.*")


#: The same rows by pairs of all documents that share a shingle; for small tables.
SQL = r"""WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT r, s FROM (
    SELECT r, list_slice(w, i, i + 4) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5) x
    UNION ALL SELECT r, w FROM t WHERE len(w) BETWEEN 1 AND 4) y),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
h AS (SELECT r, s FROM g QUALIFY count(*) OVER (PARTITION BY s) > 1),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM h a JOIN h b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT DISTINCT x AS root, x AS r FROM e UNION SELECT reach.root, e.y FROM reach JOIN e ON e.x = reach.r),
c AS (SELECT reach.root AS r, min(doc_id) AS component_id FROM reach JOIN t ON t.r = reach.r GROUP BY 1)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, t.doc_id) AS component_id FROM t LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""

#: The same with the number of links.
LINKS_SQL = SQL.replace("SELECT t.doc_id,", "k AS (SELECT x AS r, count(*) AS n_links FROM e GROUP BY 1)\nSELECT t.doc_id,").replace("GROUP BY 1)\nk AS", "GROUP BY 1),\nk AS")
LINKS_SQL = LINKS_SQL.replace(" AS component_id FROM t", " AS component_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links FROM t").rstrip() + " LEFT JOIN k USING (r)\n"
