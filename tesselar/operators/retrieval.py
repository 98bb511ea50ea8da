"""Retrieval: channel merging, soft filters, ranking, expansion and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def penalty(jurisdiction: Column, kind: Column, hinted_jurisdictions: Column, hinted_kinds: Column) -> Column:
    """Factor for chunks that don't fit the query's hints; unknown ones aren't penalised."""
    j = F.when((F.size(hinted_jurisdictions) > 0) & jurisdiction.isNotNull() & ~F.array_contains(hinted_jurisdictions, jurisdiction), 0.9).otherwise(1.0)
    k = F.when((F.size(hinted_kinds) > 0) & kind.isNotNull() & ~F.array_contains(hinted_kinds, kind), 0.85).otherwise(1.0)
    return j * k


def graph_score(entities: Column) -> Column:
    """Score of a chunk by how many of the query's entities it mentions."""
    return F.least(0.40 + 0.05 * entities, F.lit(0.60))


def graph_rank(terminals: Column, path: Column, members: Column, provenance: Column) -> Column:
    cover = lambda ids: F.when(F.size(ids) > 0, F.size(F.array_intersect(ids, members)) / F.size(ids)).otherwise(0.0)
    return F.least((cover(terminals) + 0.5 * cover(path) + F.when(provenance, 0.1).otherwise(0.0)) / 1.6, F.lit(1.0))


def merged_channels(semantic: DataFrame, graph: DataFrame) -> DataFrame:
    """(query, id, found_by, semantic_score, graph_score): both channels by query and chunk."""
    both = semantic.select("query", "id", F.col("score").alias("s"), F.lit(None).cast("double").alias("g")).unionByName(graph.select("query", "id", F.lit(None).cast("double").alias("s"), F.col("score").alias("g")))
    one = both.groupBy("query", "id").agg(F.max("s").alias("semantic_score"), F.max("g").alias("graph_score"))
    by = F.when(F.col("semantic_score").isNotNull() & F.col("graph_score").isNotNull(), "dual").when(F.col("graph_score").isNotNull(), "graph").otherwise("semantic")
    return one.select("query", "id", by.alias("found_by"), "semantic_score", "graph_score")


def top(rows: DataFrame, k: int, group: str = "query", score: str = "score") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def expand_nearest(terminals: DataFrame, nearest: DataFrame, k: int, cap: int) -> DataFrame:
    """(query, id, step): terminals (query, id) with k neighbours of each, up to ``cap`` a query, nearest first.

    ``nearest`` has (id, other, rank).
    """
    own = terminals.select("query", "id", F.lit(0).alias("step"))
    near = terminals.join(nearest.where(F.col("rank") <= k), "id").select("query", F.col("other").alias("id"), F.col("rank").alias("step"))
    one = own.unionByName(near).groupBy("query", "id").agg(F.min("step").alias("step"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("step", "id"))
    return one.withColumn("place", place).where(F.col("place") <= cap).drop("place")


def steiner(terminals: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """(query, id): terminals joined by shortest paths from the first one.

    Frontiers start at the first terminal of each query over undirected edges; a
    node keeps its least predecessor; the paths are followed back from the other
    terminals. Terminals out of reach stay alone.
    """
    from tesselar.operators.graph import both_ways
    from tesselar.storage import written

    near = written(both_ways(edges).distinct(), "near")
    first = terminals.groupBy("query").agg(F.min("id").alias("node"))
    seen = written(first.select("query", "node", F.lit(None).cast(terminals.schema["id"].dataType).alias("before"), F.lit(0).alias("hop")), "seen")
    for hop in range(1, hops + 1):
        step = seen.where(F.col("hop") == hop - 1).join(near, "node").groupBy("query", "other").agg(F.min("node").alias("before"))
        new = step.withColumnRenamed("other", "node").join(seen.select("query", "node"), ["query", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = written(seen.unionByName(new.select("query", "node", "before", "hop")), "seen")
    out = terminals.select("query", F.col("id").alias("node"))
    at = out
    for _ in range(hops):
        at = at.join(seen, ["query", "node"]).where(F.col("before").isNotNull()).select("query", F.col("before").alias("node")).distinct()
        out = out.unionByName(at)
    return out.distinct().withColumnRenamed("node", "id")


def winners(scores: DataFrame) -> DataFrame:
    """(query, winner): the mode with the best score; ties by precedence semantic, graph, dual; three-way ties are ties, all zero none.

    ``scores`` has (query, semantic, graph, dual).
    """
    s, g, d = F.col("semantic"), F.col("graph"), F.col("dual")
    best = F.greatest(s, g, d)
    winner = F.when(best == 0, "N/A").when((s == g) & (g == d), "tie").when(s == best, "semantic").when(g == best, "graph").otherwise("dual")
    return scores.select("query", winner.alias("winner"))


def coverage(answers: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, terms, covered, rate): which terms (query, term) the answer (query, answer) mentions."""
    joined = terms.join(answers, "query")
    hit = F.contains(F.lower("answer"), F.lower(F.replace("term", F.lit("_"), F.lit(" "))))
    return joined.groupBy("query").agg(F.count(F.lit(1)).alias("terms"), F.count_if(hit).alias("covered"), F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("rate"))
