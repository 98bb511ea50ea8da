"""Co-occurrence, candidate selection, validation and deduplication of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cooccurrence(mentions: DataFrame) -> DataFrame:
    """(chunk_id, entities, concepts): the sorted ids of each chunk, and those of concepts."""
    return mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"), F.array_sort(F.collect_set(F.when(F.col("is_concept"), F.col("entity_id")))).alias("concepts"))


def validated(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """``relations`` (subject, object, ...) with a reason: unknown ends, no shared chunk, or valid."""
    known = mentions.select("entity_id").distinct()
    s, o = known.select(F.col("entity_id").alias("subject"), F.lit(True).alias("has_s")), known.select(F.col("entity_id").alias("object"), F.lit(True).alias("has_o"))
    wanted = relations.select("subject", "object").distinct()
    m = mentions.select("entity_id", "chunk_id").distinct()
    shared = wanted.join(m.withColumnRenamed("entity_id", "subject"), "subject").join(m.withColumnRenamed("entity_id", "object"), ["object", "chunk_id"]).select("subject", "object").distinct().withColumn("shared", F.lit(True))
    joined = relations.join(s, "subject", "left").join(o, "object", "left").join(shared, ["subject", "object"], "left")
    reason = F.when(F.col("has_s").isNull(), "subject_not_found").when(F.col("has_o").isNull(), "object_not_found").when(F.col("shared").isNull(), "no_cooccurrence").otherwise("valid")
    return joined.withColumn("reason", reason).drop("has_s", "has_o", "shared")


def deduplicated(relations: DataFrame) -> DataFrame:
    """One row for (subject, predicate, object) with all chunks."""
    chunks = relations.select("subject", "predicate", "object", F.explode("chunk_ids").alias("chunk")).groupBy("subject", "predicate", "object").agg(F.array_sort(F.collect_set("chunk")).alias("chunk_ids"))
    return chunks


def budgeted(rows: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The rows of each group before the budget is first exceeded."""
    spent = F.sum(cost).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("spent", spent).where(F.col("spent") <= budget)


def fitted(rows: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int, least: int) -> DataFrame:
    """As ``budgeted``, and the first row over the budget cut to what is left if that is at least ``least``; column ``granted`` says how much."""
    w = Window.partitionBy(*group).orderBy(*order)
    spent = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    withcost = rows.withColumn("cost", cost).withColumn("spent", spent)
    left = F.lit(budget) - (F.col("spent") - F.col("cost"))
    granted = F.when(F.col("spent") <= budget, F.col("cost")).when((left >= least) & (left > 0), left)
    return withcost.withColumn("granted", granted).where("granted IS NOT NULL").drop("spent", "cost")


def select_diverse(candidates: DataFrame, k: int, balance: float = 0.65, coverage: bool = False) -> DataFrame:
    """(query, id, place) of k candidates for each query by maximal marginal relevance.

    ``candidates`` has query, id, ord, relevance, vector and members (array of
    ids). With ``coverage`` 2k are selected so and k of them by most new members.
    At most ``limit`` candidates stand for one query upstream, so a group is
    small by construction.
    """

    def pick(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("ord").reset_index(drop=True)
        unit = np.stack(pdf.vector.map(lambda v: np.asarray(v, "f8")))
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
        sims, want = unit @ unit.T, 2 * k if coverage else k
        if len(pdf) <= want:
            chosen = list(range(len(pdf)))
        else:
            chosen, rest = [], list(range(len(pdf)))
            while len(chosen) < want:
                score = [balance * pdf.relevance[i] - (1 - balance) * (max(sims[i][j] for j in chosen) if chosen else 0.0) for i in rest]
                best = max(range(len(rest)), key=lambda x: (score[x], -x))
                if score[best] <= -1.0:
                    break
                chosen.append(rest.pop(best))
        if coverage and len(chosen) > k:
            seen: set = set()
            final = []
            rest = list(chosen)
            while len(final) < k:
                best = max(range(len(rest)), key=lambda x: (len(set(pdf.members[rest[x]]) - seen), -x))
                i = rest.pop(best)
                seen |= set(pdf.members[i])
                final.append(i)
            chosen = final
        return pd.DataFrame({"query": pdf["query"].iloc[0], "id": [pdf.id[i] for i in chosen], "place": range(len(chosen))})

    q, i = candidates.schema["query"].dataType.simpleString(), candidates.schema["id"].dataType.simpleString()
    return candidates.groupBy("query").applyInPandas(pick, f"query {q}, id {i}, place int")


def adaptive(candidates: DataFrame, k: int, limits: tuple[float, ...] = (0.25, 0.30)) -> DataFrame:
    """(query, id, round): a further round of k unused candidates while their centroid is far from the chosen ones'."""

    def rounds(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["relevance", "ord"], ascending=[False, True]).reset_index(drop=True)
        unit = np.stack(pdf.vector.map(lambda v: np.asarray(v, "f8")))
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
        taken, number = [(i, 1) for i in range(min(k, len(pdf)))], 1
        for limit in limits:
            rest = list(range(len(taken), len(pdf)))
            if not rest:
                break
            a, b = unit[[i for i, _ in taken]].mean(0), unit[rest].mean(0)
            near = float(a @ b / max(1e-12, np.linalg.norm(a) * np.linalg.norm(b)))
            if 1 - near <= limit:
                break
            number += 1
            taken += [(i, number) for i in rest[:k]]
        return pd.DataFrame({"query": pdf["query"].iloc[0], "id": [pdf.id[i] for i, _ in taken], "round": [r for _, r in taken]})

    q, i = candidates.schema["query"].dataType.simpleString(), candidates.schema["id"].dataType.simpleString()
    return candidates.groupBy("query").applyInPandas(rounds, f"query {q}, id {i}, round int")
