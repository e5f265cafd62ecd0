"""Graph operators over edge tables ``[keys], src, dst[, theta]`` with src < dst.

``keys`` (run, step, ...) make a series of graphs one table: every operator works on all graphs at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

Keys = Sequence[str]


def arcs(edges: DataFrame) -> DataFrame:
    """Both orientations; the phase changes sign."""
    back = {c: F.col(c) for c in edges.columns} | {"src": F.col("dst"), "dst": F.col("src")} | ({"theta": -F.col("theta")} if "theta" in edges.columns else {})
    return edges.unionByName(edges.select(*[x.alias(c) for c, x in back.items()]))


def degrees(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """``[keys], node_id, d`` of nodes with an edge: both ends in one pass, summed before the shuffle."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy(*keys, "node_id").agg(F.count("*").alias("d"))


def all_degrees(nodes: DataFrame, edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """Degrees of all nodes, 0 for isolated ones; ends that are no nodes are left out."""
    return nodes.join(degrees(edges, keys), [*keys, "node_id"], "left").withColumn("d", F.coalesce("d", F.lit(0).cast("long")))


def graph_nodes(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """Nodes of an edge list alone: isolated ones vanish."""
    return edges.select(*keys, F.explode(F.array("src", "dst")).alias("node_id")).distinct()


def numbered(nodes: DataFrame, keys: Keys = ()) -> DataFrame:
    """``[keys], node_id, index``: 0..N-1 in order within each graph, however large: ranges of nodes are numbered apart, from the sums of those before."""
    ordered = nodes.select(*keys, "node_id").repartitionByRange(*keys, "node_id").sortWithinPartitions(*keys, "node_id")
    ordered = checkpointed(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    sizes = ordered.groupBy("part").count().toArrow().sort_by("part").to_pydict()  # a row for each partition
    before = [sum(sizes["count"][:k]) for k in range(len(sizes["count"]))]
    offsets = nodes.sparkSession.createDataFrame(list(zip(sizes["part"], before, strict=True)), "part int, before long")
    ranked = ordered.join(F.broadcast(offsets), "part").select(*keys, "node_id", (F.col("before") + F.col("place")).alias("index"))
    if not keys:
        return ranked
    first = ranked.groupBy(*keys).agg(F.min("index").alias("first"))
    return ranked.join(first, list(keys)).select(*keys, "node_id", (F.col("index") - F.col("first")).alias("index"))


def remap(nodes: DataFrame, edges: DataFrame, keys: Keys = ()) -> tuple[DataFrame, DataFrame]:
    """Node ids as 0..N-1 in order within each graph; edges to unknown nodes are dropped."""
    index = numbered(nodes, keys)
    at = index.select(*keys, "node_id", "index")
    out = edges.join(at.withColumnsRenamed({"node_id": "src", "index": "i"}), [*keys, "src"]).join(at.withColumnsRenamed({"node_id": "dst", "index": "j"}), [*keys, "dst"])
    return index, out.drop("src", "dst").withColumnsRenamed({"i": "src", "j": "dst"})


def closed(edges: DataFrame, keys: Keys = (), own: Sequence[str] = ()) -> DataFrame:
    """``[keys], u, w, x`` of triangles, each once, u < w < x by (degree, id), with the columns ``own`` of the edges u-w, u-x and w-x, suffixed _w, _ux and _wx.

    Edges point to the end that is later by (degree, id), so a node has few ends, at most the root of twice the edge count. An edge
    takes along the ends of its first node after itself, and what its second node's ends share with them closes a triangle:
    half the pairs of a node's ends, four bytes each where ids fit, and nothing else is moved an edge. At most the edge count to the power 1.5.
    """
    keys, own = list(keys), list(own)
    d = checkpointed(degrees(edges, keys))
    low, high = d.agg(F.min("node_id"), F.max("node_id")).first()
    whole = dict(d.dtypes)["node_id"]
    small = "int" if whole == "bigint" and low is not None and -(1 << 31) <= low and high < 1 << 31 else whole
    at = lambda end, name: d.select(*keys, F.col("node_id").alias(end), F.col("d").alias(name))
    rank = edges.select(*keys, "src", "dst", *own).join(at("src", "ds"), [*keys, "src"]).join(at("dst", "dd"), [*keys, "dst"])
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    directed = rank.select(*keys, pick("src", "dst").cast(small).alias("u"), pick("dst", "src").cast(small).alias("w"), F.greatest("ds", "dd").alias("d"), *own)
    lists = directed.groupBy(*keys, "u").agg(F.sort_array(F.collect_list(F.struct("d", "w", *own))).alias("list"))
    part = lambda c: F.transform("list", lambda e: e[c])
    ends = lists.select(*keys, "u", "list", part("w").alias("ends"))
    each = ends.select(*keys, "u", "ends", F.posexplode("list").alias("place", "e"))
    sent = each.where(F.col("place") + 1 < F.size("ends")).select(
        *keys, "u", F.col("e.w").alias("w"), *[F.col(f"e.{c}").alias(f"{c}_w") for c in own], F.slice("ends", F.col("place") + 2, F.size("ends")).alias("later"),
    )
    there = ends.select(*keys, F.col("u").alias("w"), F.col("ends").alias("others"), *[part(c).alias(f"all_{c}") for c in own])
    value = lambda x: F.struct(x.alias("x"), *[F.element_at(f"all_{c}", F.array_position("others", x).cast("int")).alias(f"{c}_wx") for c in own])
    met = sent.join(there, [*keys, "w"])
    found = met.select(*keys, "u", "w", *[f"{c}_w" for c in own], F.explode(F.transform(F.array_intersect("later", "others"), value)).alias("t"))
    found = found.select(*keys, "u", "w", *[f"{c}_w" for c in own], "t.*")
    if own:
        found = found.join(directed.select(*keys, "u", F.col("w").alias("x"), *[F.col(c).alias(f"{c}_ux") for c in own]), [*keys, "u", "x"])
    return found.select(*keys, *[F.col(c).cast(whole).alias(c) for c in "uwx"], *[f"{c}_{e}" for c in own for e in ("w", "ux", "wx")])


def ordered(theta: bool) -> dict[str, Column]:
    """``a, b, c`` with a < b < c of closed triangles, and ``t_ab, t_bc, t_ac`` with ``theta``."""
    u, w, x = F.col("u"), F.col("w"), F.col("x")
    a, c = F.least(u, w, x), F.greatest(u, w, x)
    out = {"a": a, "b": u + w + x - a - c, "c": c}
    if theta:
        # A phase goes by the node that its edge lacks.
        lacking = lambda n: F.when(x == n, F.col("theta_w")).when(w == n, F.col("theta_ux")).otherwise(F.col("theta_wx"))
        out |= {"t_ab": lacking(c), "t_bc": lacking(a), "t_ac": lacking(out["b"])}
    return out


def triangles(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """``[keys], a, b, c[, t_ab, t_bc, t_ac]`` with a < b < c, each once."""
    keys, phases = list(keys), "theta" in edges.columns
    found = closed(edges, keys, ["theta"] if phases else [])
    return found.select(*keys, *[e.alias(n) for n, e in ordered(phases).items()])


def node_triangles(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    found = triangles(edges.select(*keys, "src", "dst"), keys)
    return found.select(*keys, F.explode(F.array("a", "b", "c")).alias("node_id")).groupBy(*keys, "node_id").agg(F.count("*").alias("triangles"))


def wedges(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """``[keys], a, b, centres`` for pairs a < b with common neighbours."""
    both = arcs(edges.select(*keys, "src", "dst"))
    left = both.select(*keys, F.col("src").alias("z"), F.col("dst").alias("a"))
    right = both.select(*keys, F.col("src").alias("z"), F.col("dst").alias("b"))
    return left.join(right, [*keys, "z"]).where("a < b").groupBy(*keys, "a", "b").agg(F.count("*").alias("centres"))


def endpoints(nodes: DataFrame, edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """Edges with the columns of both ends, suffixed _i and _j."""
    rest = [c for c in nodes.columns if c not in (*keys, "node_id")]
    i = nodes.select(*keys, F.col("node_id").alias("src"), *[F.col(c).alias(f"{c}_i") for c in rest])
    j = nodes.select(*keys, F.col("node_id").alias("dst"), *[F.col(c).alias(f"{c}_j") for c in rest])
    return edges.join(i, [*keys, "src"]).join(j, [*keys, "dst"])


def induced(edges: DataFrame, members: DataFrame, keys: Keys = ()) -> DataFrame:
    """Edges with both ends among ``[keys], node_id``."""
    m = members.select(*keys, "node_id").distinct()
    return edges.join(m.withColumnRenamed("node_id", "src"), [*keys, "src"], "left_semi").join(m.withColumnRenamed("node_id", "dst"), [*keys, "dst"], "left_semi")


def bfs(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, keys: Keys = (), stored: bool = False) -> DataFrame:
    """``[keys], source, node_id, d``: hops from every source, all sources and graphs in one loop.

    Each level is a join of the frontier with the arcs, less what has been visited; lineage is cut
    at each level. Without a depth it ends when no frontier is left. ``stored`` edges are read as they
    are at each level, instead of both orientations being stored once more.
    """
    both = arcs(edges.select(*keys, "src", "dst"))
    both = both if stored else checkpointed(both)
    frontier = sources.select(*keys, F.col("node_id").alias("source"), "node_id").distinct()
    visited = checkpointed(frontier.withColumn("d", F.lit(0)))
    frontier = visited
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select(*keys, "source", F.col("node_id").alias("src")).join(both, [*keys, "src"]).select(*keys, "source", F.col("dst").alias("node_id")).distinct()
        frontier = checkpointed(step.join(visited.select(*keys, "source", "node_id"), [*keys, "source", "node_id"], "left_anti").withColumn("d", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def khop(edges: DataFrame, seeds: DataFrame, hops: int, keys: Keys = ()) -> DataFrame:
    """``[keys], node_id, d``: nodes within ``hops`` of any seed, with the smallest distance."""
    both = arcs(edges.select(*keys, "src", "dst"))
    reached = checkpointed(seeds.select(*keys, "node_id").distinct().withColumn("d", F.lit(0)))
    for k in range(1, hops + 1):
        step = reached.where(F.col("d") == k - 1).select(*keys, F.col("node_id").alias("src")).join(both, [*keys, "src"]).select(*keys, F.col("dst").alias("node_id")).distinct()
        reached = checkpointed(reached.unionByName(step.join(reached.select(*keys, "node_id"), [*keys, "node_id"], "left_anti").withColumn("d", F.lit(k))))
    return reached


def bfs_cluster(edges: DataFrame, start: int, size: int) -> DataFrame:
    """The first ``size`` nodes of a breadth-first search (order: distance, then id)."""
    seed = edges.sparkSession.createDataFrame([(start,)], "node_id long")
    reached = bfs(edges, seed)
    return reached.orderBy("d", "node_id").limit(size).select("node_id", "d")


def components(nodes: DataFrame, edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """``[keys], node_id, component``: the smallest node reachable; isolated nodes are their own.

    Labels spread along arcs and along the labels' own labels (pointer jumping), so the number of
    rounds grows with the logarithm of the diameter rather than with it. Labels, which pack well, are never sent to the driver whole.
    """
    both = checkpointed(arcs(edges.select(*keys, "src", "dst")))

    def near(label: DataFrame) -> DataFrame:
        return both.join(label.withColumnsRenamed({"node_id": "dst", "component": "m"}).hint("merge"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node_id")).agg(F.min("m").alias("m"))

    return spread_labels(nodes, near, keys)


def spread_labels(nodes: DataFrame, near: Callable[[DataFrame], DataFrame], keys: Keys = ()) -> DataFrame:
    """``components`` by ``near``, which gives ``[keys], node_id, m``, the smallest label next to a node, from ``[keys], node_id, component``."""
    label = checkpointed(nodes.select(*keys, "node_id", F.col("node_id").alias("component")))
    while True:
        hooked = label.join(near(label).hint("merge"), [*keys, "node_id"], "left").select(*keys, "node_id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        up = hooked.select(*keys, F.col("node_id").alias("component"), F.col("component").alias("top"))
        new = checkpointed(hooked.join(up.hint("merge"), [*keys, "component"], "left").select(*keys, "node_id", "old", F.least("component", "top").alias("component")))
        changed = not new.where("component != old").isEmpty()
        label = new.drop("old")
        if not changed:
            return label


def largest_component(labels: DataFrame, keys: Keys = ()) -> DataFrame:
    """Nodes of the component with most nodes; ties go to the smallest label."""
    sizes = labels.groupBy(*keys, "component").agg(F.count("*").alias("size"))
    best = F.max_by("component", F.struct("size", -F.col("component"))).alias("component")
    top = sizes.groupBy(*keys).agg(best) if keys else sizes.agg(best)
    return labels.join(top, [*keys, "component"], "left_semi")


def local_distances(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """``[keys], u, v, x, y, cost``: hops between the closed neighbourhoods of an edge's ends, which are at most 3."""
    from .blocks import hops_between

    return hops_between(edges, keys)


def shortest_path_phases(edges: DataFrame, sources: DataFrame, max_depth: int, keys: Keys = ()) -> DataFrame:
    """``[keys], source, node_id, d, phase``: the phase summed along a shortest path, each node's predecessor being the smallest possible.

    ``sources`` are some hundred nodes: an arc is met once a level with a bit a source, and the first of a node's arcs by
    predecessor to bring a bit gives it, so rows a node and source come from reached nodes alone, not from arcs.
    """
    from .landmarks import any_bit, bits, places, words

    keys = list(keys)
    node = [*keys, "node_id"]
    order = Window.partitionBy(*keys).orderBy("node_id")
    marks = checkpointed(sources.select(*node).distinct().withColumn("place", (F.row_number().over(order) - 1).cast("int")))
    k = (marks.agg(F.max("place")).first()[0] or 0) + 1
    names = words(k)
    both = checkpointed(arcs(edges.select(*keys, "src", "dst", "theta")))
    start = bits(marks, k, keys)
    state = checkpointed(start.select("*", *[F.col(n).alias(f"new_{n}") for n in names]))
    level = checkpointed(marks.select(*keys, "place", "node_id", F.lit(0).alias("d"), F.lit(0.0).alias("phase")))
    visited = level
    before = Window.partitionBy(*node).orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    for depth in range(1, max_depth + 1):
        front = state.where(any_bit(names, "new_")).select(*keys, F.col("node_id").alias("src"), *[F.col(f"new_{n}").alias(f"f_{n}") for n in names])
        met = front.join(both, [*keys, "src"]).select(*keys, F.col("dst").alias("node_id"), "src", "theta", *[f"f_{n}" for n in names])
        fresh = lambda n: F.col(f"f_{n}").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or(f"f_{n}").over(before), F.lit(0).cast("long"))))
        first = met.select(*node, "src", "theta", *[fresh(n).alias(f"f_{n}") for n in names]).where(any_bit(names, "f_"))
        known = first.join(state.select(*node, *names).hint("merge"), node, "left").na.fill(0, names)
        given = known.select(*node, "src", "theta", *[F.col(f"f_{n}").bitwiseAND(F.bitwise_not(F.col(n))).alias(f"f_{n}") for n in names])
        given = checkpointed(given.where(any_bit(names, "f_")))
        if given.isEmpty():
            break
        rows = given.select(*node, "src", "theta", F.explode(places(F.array(*[f"f_{n}" for n in names]), k)).alias("place"))
        earlier = level.select(*keys, "place", F.col("node_id").alias("src"), "phase")
        level = checkpointed(rows.join(earlier, [*keys, "place", "src"]).select(*keys, "place", "node_id", F.lit(depth).alias("d"), (F.col("phase") + F.col("theta")).alias("phase")))
        visited = visited.unionByName(level)
        got = given.groupBy(*node).agg(*[F.bit_or(f"f_{n}").alias(f"new_{n}") for n in names])
        joined = state.select(*node, *names).join(got, node, "full").na.fill(0)
        state = checkpointed(joined.select(*node, *[F.col(n).bitwiseOR(F.col(f"new_{n}")).alias(n) for n in names], *[f"new_{n}" for n in names]))
    return visited.join(F.broadcast(marks.withColumnRenamed("node_id", "source")), [*keys, "place"]).select(*keys, "source", "node_id", "d", "phase")  # some hundred sources


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, k: int, max_depth: int) -> DataFrame:
    """``source, node_id, rank, d, phase``: the k shortest simple paths of at most ``max_depth`` hops (order: hops, then nodes)."""
    both = arcs(edges.select("src", "dst", "theta"))
    paths = sources.select(F.col("node_id").alias("source"), "node_id", F.array("node_id").alias("path"), F.lit(0.0).alias("phase"))
    found = None
    for _ in range(max_depth):
        step = paths.select("source", F.col("node_id").alias("src"), "path", "phase").join(both, "src").where(~F.array_contains("path", F.col("dst")))
        paths = checkpointed(step.select("source", F.col("dst").alias("node_id"), F.concat("path", F.array("dst")).alias("path"), (F.col("phase") + F.col("theta")).alias("phase")))
        hit = paths.join(targets.select("node_id").distinct(), "node_id", "left_semi")
        found = hit if found is None else found.unionByName(hit)
    order = Window.partitionBy("source", "node_id").orderBy(F.size("path"), "path")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("source", "node_id", "rank", (F.size("path") - 1).alias("d"), "phase")


def edge_diff(after: DataFrame, before: DataFrame, keys: Keys = ()) -> DataFrame:
    """Edges of ``after`` that ``before`` lacks."""
    return after.join(before.select(*keys, "src", "dst"), [*keys, "src", "dst"], "left_anti")


def shared_nodes(one: DataFrame, two: DataFrame, least: int = 20) -> DataFrame:
    """Nodes in both snapshots; none if they share fewer than ``least``."""
    both = one.select("node_id").intersect(two.select("node_id"))
    enough = both.agg(F.count("*").alias("n")).where(F.col("n") >= least)  # one row or none
    return both.crossJoin(F.broadcast(enough)).drop("n")


def alive(triangles: DataFrame, edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """Those of stored triangles ``[keys], a, b, c`` whose three edges still exist."""
    for i, j in ("ab", "bc", "ac"):
        triangles = triangles.join(edges.select(*keys, F.col("src").alias(i), F.col("dst").alias(j)), [*keys, i, j], "left_semi")
    return triangles


def sampled_triangles(edges: DataFrame, keys: Keys = (), neighbours: int = 12, commons: int = 6, most: int = 1200, seed: int = 0) -> DataFrame:
    """A sample of triangles ``[keys], a, b, c``: of each node at most ``neighbours`` larger ones by hash, of each such edge at most ``commons`` third nodes, ``most`` in all per graph.

    Caps are the operator's point: loops are averaged over a sample of fixed size. One hash orders both the third nodes of an edge and the
    sample, so triangles beyond a bound on it change neither: only those below a small one are closed first, and
    graphs in which too few are found go on with a larger one, in the end with all.
    """
    keys = list(keys)
    by = lambda *c: F.xxhash64(F.lit(seed), *c)
    one = Window.partitionBy(*keys, "src").orderBy(by("src", "dst"), "dst")
    ends = edges.select(*keys, "src", "dst")
    some = checkpointed(ends.withColumn("k", F.row_number().over(one)).where(F.col("k") <= neighbours).select(*keys, F.col("src").alias("a"), F.col("dst").alias("b")))
    two = Window.partitionBy(*keys, "a", "b").orderBy("order", "c")
    part = Window.partitionBy(*keys, F.pmod("order", F.lit(64))).orderBy("order", "a", "b", "c")
    whole = Window.partitionBy(*keys).orderBy("order", "a", "b", "c")
    least = lambda df, w, k: df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).drop("k")
    out = None
    for share in SHARES:
        third = some.join(ends.withColumnsRenamed({"src": "b", "dst": "c"}), [*keys, "b"]).withColumn("order", by("a", "b", "c"))
        if share < 64:
            third = checkpointed(third.where(F.col("order") < -(1 << 63) + (1 << share)))
        third = third.join(ends.withColumnsRenamed({"src": "a", "dst": "c"}), [*keys, "a", "c"]).dropDuplicates([*keys, "a", "b", "c"])
        third = least(third, two, commons)
        if keys:  # of each graph the smallest in each of 64 parts, then in all
            found = checkpointed(least(least(third, part, most), whole, most).select(*keys, "a", "b", "c"))
        else:
            found = checkpointed(third.orderBy("order", "a", "b", "c").limit(most).select("a", "b", "c"))
        if share == 64:
            return found if out is None else out.unionByName(found)
        if not keys:
            if found.count() >= most:
                return found
            continue
        done = checkpointed(found.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= most).select(*keys))  # a row a graph
        kept = found.join(F.broadcast(done), keys, "left_semi")
        out = kept if out is None else out.unionByName(kept)
        some, ends = (x.join(F.broadcast(done), keys, "left_anti") for x in (some, ends))
    return out


#: Bits of the bounds on the hash below which triangles are closed: a share of 2^-12 of all, 2^-6, and all.
SHARES = (52, 58, 64)


def sample(nodes: DataFrame, k: int, seed: int = 0, column: str = "node_id") -> DataFrame:
    """k rows without replacement, the same each time: those first by ``(id * 7919 + seed) mod 1000003``, then id."""
    return nodes.orderBy((F.col(column) * 7919 + seed) % 1000003, column).limit(k)
