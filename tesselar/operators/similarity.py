"""Exact similarity joins and searches over vector columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def similar_pairs(vectors: DataFrame, threshold: float, id_: str, vector: str, block_rows: int = 4_096) -> DataFrame:
    """(a, b, similarity) of all pairs over a threshold, a < b, exact.

    Vectors are packed into blocks of about ``block_rows``; each pair of blocks is
    one group and one matrix product, so a task's memory is two blocks and their
    products however large the table is. The work, and the number of times a vector
    is sent, grow with the number of blocks: this is the exact way, for tables
    that can afford all pairs.
    """
    blocks = max(1, -(-vectors.count() // block_rows))
    kind = vectors.schema[id_].dataType.simpleString()
    rows = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("v")).where(F.col("v").isNotNull()).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    # block i takes part in the pairs (min(i, j), max(i, j)) for every j
    placed = rows.withColumn("other", F.explode(others)).select("id", "v", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def product(pdf):
        import pandas as pd

        x, y = pdf.x.iloc[0], pdf.y.iloc[0]
        left, right = pdf[pdf.block == x], pdf[pdf.block == y]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        unit = lambda p: (m := np.stack(p.v.map(lambda v: np.asarray(v, "f8")))) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        scores = unit(left) @ unit(right).T
        i, j = np.nonzero(scores >= threshold)
        a, b, s = left.id.to_numpy()[i], right.id.to_numpy()[j], scores[i, j]
        keep = a < b if x == y else np.ones(len(a), bool)
        a, b, s = a[keep], b[keep], s[keep]
        return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "similarity": s})

    return placed.groupBy("x", "y").applyInPandas(product, f"a {kind}, b {kind}, similarity double")


def nearest_of_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """(id, other, similarity, rank) of the k best partners of each id, ties to the smaller."""
    both = pairs.select("a", "b", "similarity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity", "rank")


def search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, id, similarity, rank): the k best of ``vectors`` (id, v) for each of ``queries`` (query, qv).

    Every task scores its part of the vectors against all queries in blocks and
    passes on k for each query. The queries are collected; they are a stated
    set, checked to be at most 10,000 (beyond it use ``similar_pairs``).
    """
    rows = queries.select("query", "qv").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 queries; join them with similar_pairs")
    names = [r[0] for r in rows]
    matrix = np.array([r[1] for r in rows], "f8").reshape(len(rows), -1)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12) if len(rows) else matrix
    shared = queries.sparkSession.sparkContext.broadcast((names, matrix))
    kinds = queries.schema["query"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()

    def score(batches):
        import pandas as pd

        own, q = shared.value
        for pdf in batches:
            if not len(own) or not len(pdf):
                continue
            m = np.stack(pdf.v.map(lambda v: np.asarray(v, "f8")))
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            s = q @ m.T
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            yield pd.DataFrame({"query": np.repeat(np.array(own), top.shape[1]), "id": pdf.id.to_numpy()[top.ravel()], "similarity": np.take_along_axis(s, top, 1).ravel()})

    best = vectors.select("id", "v").where(F.col("v").isNotNull()).mapInPandas(score, f"query {kinds[0]}, id {kinds[1]}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def drop_repeats(ids: DataFrame, pairs: DataFrame, id_: str) -> DataFrame:
    """Without the ids that a smaller id is similar to, itself dropped or not."""
    return ids.join(pairs.select(F.col("b").alias(id_)).distinct(), id_, "left_anti")


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def cosine_of_distance(squared: Column) -> Column:
    """The cosine of two unit vectors from their squared Euclidean distance."""
    return 1 - squared / 2
