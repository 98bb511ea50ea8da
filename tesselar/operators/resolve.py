"""Entity filtering, deduplication, merging and clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions import fuzzy
from tesselar.functions import text as X
from tesselar.functions import values as V
from tesselar.operators import graph
from tesselar.storage import written


def route(kind: Column) -> Column:
    """Which track an entity takes; unknown types are semantic."""
    return F.when(kind.isin(V.METADATA_TYPES), "metadata").otherwise("semantic")


def strategy(kind: Column) -> Column:
    """How relations are extracted for a type; unknown types are skipped."""
    return F.when(kind.isin(V.SEMANTIC_TYPES), "semantic").when(kind.isin(V.ACADEMIC_TYPES), "academic").otherwise("skip")


def tier(similarity: Column, merge: float = 0.98, reject: float = 0.885) -> Column:
    return F.when(similarity >= merge, "merge").when(similarity < reject, "reject").otherwise("uncertain")


def word_overlap(name: Column, text: Column) -> Column:
    """Share of the name's words that the text has."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"[^a-z0-9]+"), lambda w: w != ""))
    own = words(name)
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, words(text))) / F.size(own))


def provenance(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``mentions`` (name, chunk_id, ...) with score and in_source, by substring, else by shared words.

    A mention whose chunk has no text counts as in its source.
    """
    texts = chunks.where(F.col("text").isNotNull()).groupBy("chunk_id").agg(F.min("text").alias("chunk_text"))
    joined = mentions.join(texts, "chunk_id", "left")
    inside = F.contains(F.lower("chunk_text"), F.lower("name"))
    score = F.when(F.col("chunk_text").isNull() | (F.col("chunk_text") == "") | inside, F.lit(1.0)).otherwise(word_overlap(F.col("name"), F.col("chunk_text")))
    return joined.withColumn("score", score).withColumn("in_source", F.col("score") >= 0.8).drop("chunk_text")


def fuzzy_provenance(mentions: DataFrame, chunks: DataFrame, threshold: float = 0.8) -> DataFrame:
    """As ``provenance``, with the best matching window instead of shared words, computed only where no substring fits."""
    texts = chunks.where(F.col("text").isNotNull()).groupBy("chunk_id").agg(F.min("text").alias("chunk_text"))
    joined = mentions.join(texts, "chunk_id", "left")
    inside = F.col("chunk_text").isNull() | (F.col("chunk_text") == "") | F.contains(F.lower("chunk_text"), F.lower("name"))
    sure = joined.where(inside).withColumn("score", F.lit(1.0))
    rest = joined.where(~inside).withColumn("score", fuzzy.partial_ratio(F.lower("name"), F.lower("chunk_text")))
    return sure.unionByName(rest).withColumn("in_source", F.col("score") >= threshold).drop("chunk_text")


def filtered(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``mentions`` with the reason for leaving them out, null for those kept."""
    checked = provenance(mentions, chunks)
    return checked.withColumn("reason", F.when(X.garbage_name(F.col("name"), F.col("type")), "garbage").when(~F.col("in_source"), "not in source"))


def merge_groups(mentions: DataFrame, group: Column, order: str) -> DataFrame:
    """One entity for each group: most frequent name and type, longest description, all chunks and other spellings.

    Ties go to what comes first by ``order``. Counting by (group, name) first
    keeps a hot group's rows from one task.
    """
    rows = mentions.withColumn("g", group)

    def most_frequent(column: str) -> DataFrame:
        counts = rows.groupBy("g", column).agg(F.count(F.lit(1)).alias("k"), F.min(order).alias("first"))
        return counts.groupBy("g").agg(F.max_by(column, F.struct("k", -F.col("first"))).alias(column))

    names = rows.groupBy("g", "name").agg(F.min(order).alias("first"))
    total = rows.groupBy("g").agg(F.count(F.lit(1)).alias("merge_count"), F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col(order))).alias("description"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    out = total.join(most_frequent("name"), "g").join(most_frequent("type"), "g").join(names.groupBy("g").agg(F.collect_set("name").alias("spellings")), "g")
    aliases = F.array_sort(F.filter("spellings", lambda x: F.lower(x) != F.lower("name")))
    return out.select("g", "name", "type", "description", "chunk_ids", aliases.alias("aliases"), "merge_count")


def capped_union(pairs: DataFrame, cap: int = 20, in_one_task: int = 100_000) -> DataFrame:
    """(node, root) after uniting pairs (a, b, ord) in order, unless a group would exceed ``cap``.

    Unions never cross connected components. A component of up to ``in_one_task``
    pairs is worked off by itself in a task; a larger one by rounds over the whole cluster
    (``_union_rounds``), with the same result.
    """
    of = graph.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    keyed = written(pairs.join(of.withColumnRenamed("node", "a"), "a"), "keyed")
    large = written(keyed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > in_one_task).select("component"), "large")

    def unite(pdf):
        import pandas as pd

        parent: dict = {}
        size: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for r in pdf.sort_values("ord").itertuples():
            for x in (r.a, r.b):
                if x not in parent:
                    parent[x], size[x] = x, 1
            x, y = find(r.a), find(r.b)
            if x != y and size[x] + size[y] <= cap:
                parent[y] = x
                size[x] += size[y]
        return pd.DataFrame([(n, find(n)) for n in parent], columns=["node", "root"])

    kind = pairs.schema["a"].dataType.simpleString()
    small = keyed.join(large, "component", "left_anti").groupBy("component").applyInPandas(unite, f"node {kind}, root {kind}")
    if not large.take(1):
        return small
    return small.unionByName(_union_rounds(keyed.join(large, "component", "left_semi").select("a", "b", "ord"), cap))


def _union_rounds(pairs: DataFrame, cap: int) -> DataFrame:
    """The same by rounds: a pair that comes first for both of its groups can be decided, whatever the others bring.

    Groups only grow, so pairs whose groups are too large together are out for good,
    and of the pairs of the same two groups only the first counts.
    """
    pairs = pairs.where(F.col("a") != F.col("b"))
    of = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "roots")
    while True:
        size = of.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        x, y = (size.select(F.col("root").alias(c), F.col("size").alias(f"s{c}")) for c in "ab")
        live = pairs.join(x, "a").join(y, "b").where(F.col("sa") + F.col("sb") <= cap)
        pair = [F.least("a", "b"), F.greatest("a", "b")]
        live = written(live.groupBy(pair[0].alias("lo"), pair[1].alias("hi")).agg(F.min(F.struct("ord", "a", "b")).alias("p")).select("p.a", "p.b", "p.ord"), "live")
        if not live.take(1):
            return of
        first = live.select(F.explode(F.array("a", "b")).alias("g"), "ord").groupBy("g").agg(F.min("ord").alias("ord"))
        decided = live.join(first.select(F.col("g").alias("a"), "ord"), ["a", "ord"]).join(first.select(F.col("g").alias("b"), "ord"), ["b", "ord"])
        into = written(decided.select(F.col("b").alias("root"), F.col("a").alias("new")), "into")
        of = written(of.join(into, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "roots")
        ma, mb = (into.select(F.col("root").alias(c), F.col("new").alias(f"n{c}")) for c in "ab")
        moved = live.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), "ord")
        pairs = written(moved.where(F.col("a") != F.col("b")), "pairs")


def edge_betweenness(nodes: list, edges: list[tuple]) -> dict[tuple, float]:
    """Share of all shortest paths that pass each edge, normalised by the number of node pairs."""
    place = {n: i for i, n in enumerate(nodes)}
    near: list[list] = [[] for _ in nodes]
    for k, (a, b) in enumerate(edges):
        near[place[a]].append((place[b], k))
        near[place[b]].append((place[a], k))
    n = len(nodes)
    score = [0.0] * len(edges)
    for s in range(n):
        far, paths, before = [-1] * n, [0] * n, [[] for _ in range(n)]
        far[s], paths[s], order = 0, 1, [s]
        for v in order:
            next_, own = far[v] + 1, paths[v]
            for w, k in near[v]:
                if far[w] < 0:
                    far[w] = next_
                    order.append(w)
                if far[w] == next_:
                    paths[w] += own
                    before[w].append((v, k))
        held = [0.0] * n
        for w in reversed(order):
            for v, k in before[w]:
                part = paths[v] / paths[w] * (1 + held[w])
                score[k] += part
                held[v] += part
    return {tuple(sorted(e)): v / (n * (n - 1)) if n > 1 else v for e, v in zip(edges, score)}


class _Part:
    """A connected part of a component while it is cut.

    ``base`` has what passed each edge when it was last counted, ``moved`` the sum of
    that over the edges cut since: a pair whose paths lost a share of s gives any
    other edge s more at most, so no edge has more than base + moved now, and a part
    is counted anew only where that can be over the bound.
    """

    def __init__(self, nodes: list, own: list, base: dict | None, moved: float):
        self.nodes, self.own, self.base, self.moved, self.worst = nodes, own, base, moved, None


def _cutter(least_nodes: int, least_edges: int, most_between: float, ceiling: float, most_nodes: int, rounds: int):
    """The work on one component, as a frame (a, b, similarity)."""

    def cut(pdf):
        edges = {tuple(sorted((r.a, r.b))): r.similarity for r in pdf.itertuples()}

        def parted(own: list, base: dict | None, moved: float) -> list[_Part]:
            near: dict = {}
            for a, b in own:
                near.setdefault(a, []).append(b)
                near.setdefault(b, []).append(a)
            of: dict = {}
            groups: list[list] = []
            for n in sorted(near):
                if n in of:
                    continue
                of[n], group = len(groups), [n]
                for x in group:
                    for y in near[x]:
                        if y not in of:
                            of[y] = len(groups)
                            group.append(y)
                groups.append(group)
            inside: list[list] = [[] for _ in groups]
            for e in own:
                inside[of[e[0]]].append(e)
            return [rated(_Part(sorted(g), e, base, moved)) for g, e in zip(groups, inside)]

        def rated(part: _Part) -> _Part:
            if len(part.nodes) < least_nodes or len(part.own) < least_edges:
                return part
            weak, pairs = [e for e in part.own if edges[e] < ceiling], len(part.nodes) * (len(part.nodes) - 1)
            if not weak or part.base is not None and max(part.base.get(e, 0.0) for e in weak) + part.moved <= most_between * pairs * (1 - 1e-9):
                return part
            between = edge_betweenness(part.nodes, part.own)
            part.base, part.moved = {e: x * pairs for e, x in between.items()}, 0.0
            part.worst = max(((between[e], e) for e in weak if between[e] > most_between), default=None)
            return part

        parts = parted(list(edges), None, 0.0)
        for _ in range(rounds):
            part = max((p for p in parts if p.worst), key=lambda p: p.worst, default=None)
            if part:
                gone = part.worst[1]
            else:
                part = max(parts, key=lambda p: len(p.nodes), default=None)
                if part is None or len(part.nodes) <= most_nodes:
                    break
                gone = min(part.own, key=lambda e: (edges[e], e))
            del edges[gone]
            moved = part.moved + (part.base[gone] if part.base else 0.0)
            parts = sorted([*(p for p in parts if p is not part), *parted([e for e in part.own if e != gone], part.base, moved)], key=lambda p: p.nodes[0])
        keep = [tuple(sorted((r.a, r.b))) in edges for r in pdf.itertuples()]
        return pdf[keep][["a", "b", "similarity"]]

    return cut


def bridge_cut(links: DataFrame, least_nodes: int = 5, least_edges: int = 3, most_between: float = 0.25, ceiling: float = 0.91, most_nodes: int = 20, rounds: int = 1000) -> DataFrame:
    """(a, b, similarity) that are left of ``links`` when weak bridges and oversized clusters are cut."""
    of = graph.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    keyed = links.join(of.withColumnRenamed("node", "a"), "a")

    cut = _cutter(least_nodes, least_edges, most_between, ceiling, most_nodes, rounds)
    kind = links.schema["a"].dataType.simpleString()
    return keyed.groupBy("component").applyInPandas(cut, f"a {kind}, b {kind}, similarity double")


def first_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")
