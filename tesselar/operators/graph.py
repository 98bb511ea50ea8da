"""Property-graph tables and network analytics as DataFrame operators.

A graph is two tables: nodes (id, label, name, type) and edges (src, dst, rel,
predicate). Everything is a join or an aggregation; iterative algorithms write
each round to the shared folder and run until nothing changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselar.operators import closed
from tesselar.storage import bucketed, written


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other) for each end of each edge."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    return edges.select(ends.alias("e")).select("e.node", "e.other")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over edges in either direction; multi-edges count."""
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def all_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, type, degree), zero for nodes without edges."""
    known = degrees(edges).withColumnRenamed("node", "id")
    return nodes.select("id", "label", "type").join(known, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))


def referential(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges within a set of nodes (column ``id``)."""
    return referential(edges, members)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.join(both_ways(edges).select(F.col("node").alias("id")).distinct(), "id", "left_anti")


def simple(edges: DataFrame) -> DataFrame:
    """The simple undirected graph: (a, b) with a < b, once each."""
    return edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _turned(pairs: DataFrame) -> DataFrame:
    """(u, v) of each pair from the end of lower degree to the higher: no node keeps more than the root of twice the edges."""
    d = pairs.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    ranked = pairs.join(d.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z) of each triangle of the simple graph, once; hubs open few wedges, as edges are turned away from them."""
    pairs = simple(edges)
    turned = _turned(pairs)
    one, two = turned.select("u", F.col("v").alias("v1")), turned.select("u", F.col("v").alias("v2"))
    wedge = one.join(two, "u").where(F.col("v1") < F.col("v2"))
    shut = wedge.join(pairs, (F.col("v1") == F.col("a")) & (F.col("v2") == F.col("b")), "left_semi")
    three = F.array_sort(F.array("u", "v1", "v2"))
    return shut.select(three[0].alias("x"), three[1].alias("y"), three[2].alias("z"))


def triangle_count(pairs: DataFrame) -> DataFrame:
    """One row: the number of triangles of a graph (a, b), without listing wedges."""
    return pairs.sparkSession.createDataFrame([closed.count(*closed.packed_edges(pairs))[:1]], "triangles bigint")


def clustering(packed: tuple[DataFrame, int]) -> DataFrame:
    """One row: triangles, wedges and 3 x triangles / wedges of the simple graph of packed pairs (``closed``)."""
    of = packed[0].sparkSession.createDataFrame([closed.count(*packed)], "triangles bigint, wedges bigint")
    return of.select("triangles", "wedges", F.round(F.when(F.col("wedges") == 0, F.lit(float("nan"))).otherwise(3 * F.col("triangles") / F.col("wedges")), 6).alias("coefficient"))


def concentration(edges: DataFrame) -> DataFrame:
    """Share and running share of each predicate, most frequent first."""
    counts = edges.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    running = Window.orderBy(F.desc("n"), "predicate").rowsBetween(Window.unboundedPreceding, 0)
    # the window runs over one row for each predicate, a vocabulary and not the edges
    out = counts.crossJoin(F.broadcast(total)).withColumn("upto", F.sum("n").over(running)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "predicate")))
    return out.select("rank", "predicate", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"), F.round(100.0 * F.col("upto") / F.col("total"), 4).alias("cum_pct"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge, the component named by its least node.

    Alternates large-star and small-star: every round links each node's larger
    (then smaller) neighbours to the least node around. Rounds grow with the
    logarithm of the longest path. A star's centre is replaced by an aggregation
    and a join, never by a gathered neighbourhood.
    """
    pairs = written(edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "pairs")
    before = _fingerprint(pairs)
    while True:
        pairs = written(_star(_star(pairs, larger=True), larger=False), "stars")
        now = _fingerprint(pairs)
        if now == before:
            break
        before = now
    members = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())


def _fingerprint(pairs: DataFrame) -> tuple:
    """Count and two sums of 64-bit hashes of distinct pairs: equal for equal sets, for others with a chance of 2^-128 or so; no shuffle of the pairs."""
    half = lambda h: F.sum(F.shiftright(h, 20).cast("decimal(20,0)"))
    return tuple(pairs.agg(F.count(F.lit(1)), half(F.xxhash64("u", "v")), half(F.xxhash64("v", F.lit(7), "u"))).first())


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """One star step over pairs (u, v) with u > v."""
    if larger:
        near = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = near.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        keep = least.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))
        return out.unionByName(keep).where(F.col("u") != F.col("v")).distinct()
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    out = pairs.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


#: Sources whose frontiers go together, a bit each.
TOGETHER = 63


def _levels(edges: DataFrame, sources: DataFrame, hops: int) -> tuple[DataFrame, list[DataFrame]]:
    """Sources (source, batch, bit), and for each distance from 0 on (batch, node, fresh): the bits of the sources that first reach a node there."""
    # the window runs over the sources, a stated set
    place = F.row_number().over(Window.orderBy("id")) - 1
    numbered = written(sources.select("id").where(F.col("id").isNotNull()).distinct().select(F.col("id").alias("source"), F.floor(place / TOGETHER).cast("int").alias("batch"), (place % TOGETHER).alias("bit")), "sources")
    own = F.expr("shiftleft(1L, bit)")
    seen = written(numbered.select("batch", F.col("source").alias("node"), own.alias("seen"), own.alias("fresh")), "seen")
    levels = [seen]
    both = both_ways(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()))  # repeats don't matter to bits
    with bucketed(both, "near", "node") as near:
        for _ in range(hops):
            step = levels[-1].where("fresh <> 0").select("batch", "node", "fresh").join(near, "node").groupBy("batch", F.col("other").alias("node")).agg(F.bit_or("fresh").alias("now"))
            state = levels[-1].select("batch", "node", "seen").join(step, ["batch", "node"], "full")
            before, now = F.coalesce("seen", F.lit(0).cast("bigint")), F.coalesce("now", F.lit(0).cast("bigint"))
            levels.append(written(state.select("batch", "node", before.bitwiseOR(now).alias("seen"), now.bitwiseAND(F.bitwise_not(before)).alias("fresh")), "seen"))
            if not levels[-1].where("fresh <> 0").take(1):
                break
    return numbered, [x.where("fresh <> 0").select("batch", "node", "fresh") for x in levels]


def distances(edges: DataFrame, sources: DataFrame, hops: int = 10) -> DataFrame:
    """(source, node, distance) by breadth-first frontiers over undirected edges, up to ``hops``."""
    numbered, levels = _levels(edges, sources, hops)
    rows = [x.join(numbered, "batch").where("fresh & shiftleft(1L, bit) <> 0").select("source", "node", F.lit(i).alias("distance")) for i, x in enumerate(levels)]
    return reduce(DataFrame.unionByName, rows)


def path_lengths(edges: DataFrame, sources: DataFrame, hops: int = 10) -> DataFrame:
    """(distance, n): how many pairs of a source and a node are so far from each other, from 0 on."""
    _, levels = _levels(edges, sources, hops)
    return reduce(DataFrame.unionByName, (x.agg(F.lit(i).alias("distance"), F.coalesce(F.sum(F.bit_count("fresh")), F.lit(0).cast("bigint")).alias("n")) for i, x in enumerate(levels)))


def bucket(degree: Column) -> Column:
    """Bucket of a degree."""
    out = F.lit("500+")
    for most, name in ((500, "101-500"), (100, "21-100"), (20, "6-20"), (5, "2-5"), (1, "1"), (0, "0")):
        out = F.when(degree <= most, F.lit(name)).otherwise(out)
    return out


def co_members(edges: DataFrame) -> DataFrame:
    """(a, b, shared) of ``src`` nodes that share a ``dst``, a < b."""
    member = edges.select("src", "dst").distinct()
    x, y = member.select(F.col("src").alias("a"), "dst"), member.select(F.col("src").alias("b"), "dst")
    return x.join(y, "dst").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
