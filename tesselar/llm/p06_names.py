"""Problem 6: variant spellings of the names of people and organisations.

Spellings are read into a core (surname or proper name), a code (first initial;
initials of an organisation's kind and field) and a given name or kind, and equal
readings are one node. A node's vector has the TF-IDF weighted character n-grams
of its core in two parts, three letters in a row and pairs of letters up to
three apart (these outlast a typing error better), of ``share`` and 1 - ``share`` of
the squared length, and its code. Names whose codes differ are different by the problem's
statement (other initials, other kind and field), so the code's weight keeps such
vectors below the threshold whatever their cores, and the join runs within a code.

The sparse similarity join is a join of postings, nodes within a code on an
n-gram of three, whose products are added up for each pair: that is the first part of
the cosine, exact. As the second is at most 1, pairs under
(threshold - share) / (1 - share) there can't reach the threshold and end in the JVM;
the others get the second part. Links are the pairs whose cosine reaches
``threshold``; pairs with given names or kinds that contradict are taken out.
Postings of over ``block`` nodes are cut into blocks, and each two blocks meet in a task
of their own, so a code or an n-gram that a third of all names has is split.

The links are grouped by average linkage. All pairs of clusters that are each
other's nearest are merged at once, which gives the same groups as one merge
after the other; averages are kept by summing over the merged pairs, a missing
link counting as none. Every step is a join or an aggregation over links, so no
group is gathered in one task. No cap is set on partners.

Defined results: null and unreadable names take no part; equal spellings are one
node; ties go to the smaller node; names of a single row (name and aliases) are
linked whatever they look like; rows of other types are left out; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm.names import NICKNAMES, TITLES, Name, conflict, fold, letter_pairs, read_organisation, read_person
from tesselar.llm.words import Memo
from tesselar.storage import written

PERSON, ORGANISATION = ["Author"], ["Organization", "Affiliation"]
NODE = "node bigint, kind string, core string, code string, given string"


def spellings(entities: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key, is_person, spelling) of each name and alias of people and organisations."""
    names = F.array_distinct(F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (F.trim(x) != "")))
    rows = entities.where(F.col("type").isin(PERSON + ORGANISATION))
    return rows.select(key, F.col("type").isin(PERSON).alias("is_person"), F.explode(names).alias("spelling"))


def given_names(rows: DataFrame, least: int = 8, share: float = 1e-3) -> frozenset[str]:
    """Words that stand beside many others in people's names.

    A word needs ``share`` of the spellings as companions, so their number is
    bounded by the words in a name over ``share``.
    """

    def pairs(batches):
        for batch in batches:
            seen = set()
            for text in batch.column(0).to_pylist():
                tokens = {w for t in text.replace(",", " ").split() if len(w := fold(t).strip(".")) > 2}
                seen.update((a, b) for a in tokens for b in tokens if a != b)
            own = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in own], pa.string()), pa.array([b for _, b in own], pa.string())], ["word", "beside"])

    people = rows.where("is_person").select("spelling").distinct()
    floor = max(least, int(share * people.count()))
    found = people.mapInArrow(pairs, "word string, beside string").distinct().groupBy("word").count().where(F.col("count") >= floor)
    known = {r.word for r in found.collect()}
    return frozenset(known | NICKNAMES.keys() | set(NICKNAMES.values())) - TITLES


def read_names(rows: DataFrame, given: frozenset[str], keep: list[str]) -> DataFrame:
    """``rows`` (columns ``keep``) with the node that each spelling is read as; unreadable ones are left out."""
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        known: dict[tuple, tuple] = {}
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                who = (row.is_person, row.spelling)
                if who not in known:
                    name: Name | None = read_person(row.spelling, given) if row.is_person else read_organisation(row.spelling)
                    if len(known) > 100_000:
                        known.clear()
                    if name is None or not name.core:
                        known[who] = None
                    else:
                        text = "\x00".join((name.kind, name.core, name.code, name.given))
                        known[who] = (xxhash.xxh64_intdigest(text) - (1 << 63), name.kind, name.core, name.code, name.given)
                if known[who]:
                    out.append((*(getattr(row, c) for c in keep), *known[who]))
            yield pd.DataFrame(out, columns=[*keep, "node", "kind", "core", "code", "given"])

    return rows.mapInPandas(run, f"{fields}, {NODE}")


def trigram_vectors(cores: DataFrame, n: int) -> DataFrame:
    """(core, g, w): unit vectors of the n-grams of three letters of each core between marks."""
    marked = F.concat(F.lit("^^"), "core", F.lit("$$"))
    each = F.transform(F.sequence(F.lit(1), F.length(marked) - 2), lambda i: marked.substr(i, F.lit(3)))
    counted = cores.select("core", F.explode(each).alias("g")).groupBy("core", "g").agg(F.count(F.lit(1)).alias("tf"))
    held = counted.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    weighted = counted.join(held, "g").select("core", "g", ((1 + F.log("tf")) * F.log(1 + n / F.col("df"))).alias("w"))
    norm = weighted.groupBy("core").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, "core").select("core", "g", (F.col("w") / F.col("norm")).alias("w"))


class PairWeights:
    """TF-IDF vectors of pairs of letters; the number of different pairs is bounded by the alphabet (see ``letter_pairs``)."""

    def __init__(self, frequency: dict[str, int], cores: int):
        self.frequency, self.cores = frequency, max(1, cores)
        self.vectors = Memo(self.vector, 100_000)

    def vector(self, core: str) -> dict[str, float]:
        own = {g: (1 + math.log(n)) * math.log(1 + self.cores / self.frequency.get(g, 1)) for g, n in Counter(letter_pairs(core)).items()}
        norm = math.sqrt(sum(x * x for x in own.values()))
        return {g: x / norm for g, x in own.items()}

    def cosine(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        va, vb = self.vectors[a], self.vectors[b]
        return sum(w * vb[g] for g, w in va.items() if g in vb)


def shared_trigrams(nodes: DataFrame, vectors: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b, r): pairs of nodes with one code, a < b, and the cosine of their n-grams of three, if ``least`` or more."""
    place = ["kind", "code", "g"]
    posted = nodes.select("node", "kind", "code", "core").join(vectors, "core").select("node", *place, "w")
    counts = posted.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    cut = posted.join(counts, place).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    a = cut.select(*place, F.col("node").alias("x"), F.col("w").alias("wx"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    b = cut.select(*place, F.col("node").alias("y"), F.col("w").alias("wy"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), "own")).alias("i"))
    met = a.join(b, [*place, "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    return met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum(F.col("wx") * F.col("wy")).alias("r")).where(F.col("r") >= least)


def similar_nodes(nodes: DataFrame, threshold: float = 0.42, share: float = 0.35, block: int = 2_000) -> DataFrame:
    """(a, b, similarity) of the pairs of nodes with one code whose cosine reaches the threshold, a < b."""
    spark = nodes.sparkSession

    def counted(batches):
        counts: Counter = Counter()
        for batch in batches:
            for core in batch.column(0).to_pylist():
                counts.update(set(letter_pairs(core)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["g", "n"])

    cores = nodes.select("core").distinct()
    n = cores.count()
    # at most some ten thousand pairs of letters, see letter_pairs
    frequency = {r.g: r.n for r in cores.mapInArrow(counted, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    weights = spark.sparkContext.broadcast(PairWeights(frequency, n))

    @F.pandas_udf("double")
    def similarity(core_a, core_b, kind, given_a, given_b, r):
        value = weights.value
        out = [0.0 if conflict(k, x, y) else min(1.0, share * value.cosine(a, b) + (1 - share) * z) for a, b, k, x, y, z in zip(core_a, core_b, kind, given_a, given_b, r)]
        return pd.Series(out, dtype="float64")

    found = shared_trigrams(nodes, written(trigram_vectors(cores, n), "grams"), max(1e-9, (threshold - share) / (1 - share)), block)
    one, two = (nodes.select(F.col("node").alias(c), F.col("core").alias(f"c{c}"), F.col("given").alias(f"g{c}"), F.col("kind").alias(f"k{c}")) for c in "ab")
    named = found.join(one, "a").join(two, "b")
    return named.select("a", "b", similarity("ca", "cb", "ka", "ga", "gb", "r").alias("similarity")).where(F.col("similarity") >= threshold)


def average_linkage(links: DataFrame, threshold: float) -> DataFrame:
    """(node, cluster) of all nodes that end up in a cluster with others.

    ``links`` has (a, b, similarity) with a < b, each pair once. Stops when no
    two clusters are on average similar enough.
    """
    work = written(links.select("a", "b", F.col("similarity").alias("s"), F.lit(1).cast("bigint").alias("na"), F.lit(1).cast("bigint").alias("nb")), "links")
    of = None
    while True:  # each round merges a pair at least
        mean, size = F.col("s") / (F.col("na") * F.col("nb")), F.col("na") + F.col("nb")
        order = F.named_struct(F.lit("m"), mean, F.lit("x"), -F.col("a"), F.lit("y"), -F.col("b"), F.lit("z"), size)
        nearest = work.where(mean >= threshold).select(F.explode(F.array("a", "b")).alias("node"), order.alias("o")).groupBy("node").agg(F.max("o").alias("o"))
        mutual = nearest.groupBy((-F.col("o.x")).alias("into"), (-F.col("o.y")).alias("node"), F.col("o.z").alias("size")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2)
        merged = written(mutual.select("into", "node", "size"), "merged")
        if not merged.take(1):
            break
        if of is None:
            of = merged.select("node", F.col("into").alias("cluster")).unionByName(merged.select(F.col("into").alias("node"), F.col("into").alias("cluster")))
        else:
            known = of.join(merged.select(F.col("node").alias("cluster"), "into"), "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster"))
            fresh = merged.select(F.col("into").alias("cluster"), "node").unionByName(merged.select(F.col("into").alias("cluster"), F.col("into").alias("node")))
            of = known.unionByName(fresh.join(of.select("node"), "node", "left_anti").select("node", "cluster"))
        of = written(of, "clusters")
        moved = merged.select("node", "into", "size").unionByName(merged.select(F.col("into").alias("node"), "into", "size"))
        ma, mb = (moved.select(F.col("node").alias(c), F.col("into").alias(f"i{c}"), F.col("size").alias(f"z{c}")) for c in ("a", "b"))
        new = work.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("ia", "a").alias("a"), F.coalesce("ib", "b").alias("b"), "s", F.coalesce("za", "na").alias("na"), F.coalesce("zb", "nb").alias("nb")).where(F.col("a") != F.col("b"))
        turned = F.col("a") > F.col("b")
        new = new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        work = written(new.groupBy("a", "b").agg(F.sum("s").alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb")), "links")
    return of if of is not None else links.select(F.col("a").alias("node"), F.col("b").alias("cluster")).where(F.lit(False))


def linked_names(rows: DataFrame, key: str | None = "entity_id", threshold: float = 0.42) -> DataFrame:
    """(key or spelling, node, cluster): the cluster of each spelling; ``rows`` has is_person, spelling and maybe the key.

    With a key, spellings of one key are linked.
    """
    keep = [key] if key else ["spelling"]
    read = written(read_names(rows, given_names(rows), keep), "names")
    nodes = read.select("node", "kind", "core", "code", "given").distinct()
    links = similar_nodes(nodes, threshold)
    if key:
        first = read.groupBy(key).agg(F.min("node").alias("a"))
        own = read.join(first, key).where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b"), F.lit(1.0).alias("similarity"))
        links = links.unionByName(own).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    clusters = average_linkage(links, threshold)
    return read.select(*keep, "node").distinct().join(clusters, "node", "left").select(*keep, "node", F.coalesce("cluster", "node").alias("cluster"))


def same_bearer(entities: DataFrame, key: str = "entity_id") -> DataFrame:
    """Pairs of rows that name one person or organisation, the smaller key first."""
    named = linked_names(spellings(entities, key), key).select(key, "cluster").distinct()
    x, y = named.select(F.col(key).alias("x"), "cluster"), named.select(F.col(key).alias("y"), "cluster")
    return x.join(y, "cluster").where(F.col("x") < F.col("y")).select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b")).distinct()
