"""Problem 2: near-duplicate texts by b-bit MinHash.

Each text becomes the set of its shingles (runs of ``width`` words). Of 64
minima, 60 in bands of three make the candidate buckets; of each of the 64 two
bits are kept, packed in two numbers. Two texts in a bucket are compared by
counting the places in which either bit differs; since unequal minima agree in
both bits a quarter of the time, a share m of equal places estimates a
similarity of (m - 1/4) / (3/4). Pairs whose estimate is not clearly below the
threshold go on to an exact comparison of their shingle sets.

Texts with equal shingle sets are one node from the start. A task sends a node's
bands once, so copies, however many, cost a row each and no pairs. Buckets are compared inside a join whose
condition is the bit count: nothing that fails it leaves the join. A bucket that
many nodes share (told by a sample of the nodes, one in HOT_SHARE) is cut into
blocks, and each two blocks meet in a task of their own, so its pairs are spread
over the cluster; how it is cut changes no result. Nothing is capped.

The exact comparison is of whole 64-bit shingle hashes of both texts. Links are
between nodes, the classes' representatives; ``groups`` gives each text its class
and number of links, ``expand`` all pairs of keys where a result asks for them.

Defined results: null and empty texts and texts under ``min_words`` words are in
no pair; rows delivered again count once; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm.words import Memo, words
from tesselar.storage import written

BANDS, ROWS, BITS = 20, 3, 64
MIX = np.uint64(0x9E3779B97F4A7C15)
#: One node in so many is counted to find hot buckets; a bucket of over HOT_NODES nodes (as estimated) is cut into blocks of about as many.
HOT_SHARE, HOT_NODES = 64, 4_096


def _constants(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


FACTORS, SHIFTS, PLACES = _constants(1, BITS), _constants(2, BITS), _constants(3, 16)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Shingle sets of many texts at once, as sorted 64-bit hashes."""

    def __init__(self, width: int):
        self.width = width
        self.units = Memo(lambda unit: b"".join(xxhash.xxh64_digest(w) for w in words(unit)))

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, start of each text's set, its word count); a text of too few words has an empty set."""
        raw = [b"".join(map(self.units.__getitem__, (t or "").split())) for t in texts]
        sizes = np.array([len(r) >> 3 for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), "<u8")
        if len(flat) < self.width:
            return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), sizes
        n = len(flat) - self.width + 1
        mixed = np.zeros(n, np.uint64)
        for i in range(self.width):
            mixed += _scramble(flat[i : i + n]) * PLACES[i]
        mixed = _scramble(mixed)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)[:n]
        mine = np.arange(n) + self.width <= ends[owner]
        mixed, owner = mixed[mine], owner[mine]
        order = np.lexsort((mixed, owner))
        mixed, owner = mixed[order], owner[order]
        new = np.ones(len(mixed), bool)
        new[1:] = (mixed[1:] != mixed[:-1]) | (owner[1:] != owner[:-1])
        mixed, owner = mixed[new], owner[new]
        return mixed, np.searchsorted(owner, np.arange(len(texts))), sizes


@lru_cache(4)
def shingler_of(width: int) -> Shingler:
    """The worker's shingler, with the hashes of the units it has seen."""
    return Shingler(width)


def sketch(texts: list[str], shingler: Shingler, min_words: int):
    """(kept rows, node, low bits, high bits, bands): arrays over the texts of at least ``min_words`` words."""
    hashes, starts, sizes = shingler.sets(texts)
    counts = np.diff(np.append(starts, len(hashes)))
    kept = np.flatnonzero((counts > 0) & (sizes >= min_words))
    if not len(kept):
        return kept, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BANDS), np.int64)
    take = np.repeat(sizes >= min_words, counts)
    hashes = hashes[take]
    counts = counts[kept]
    starts = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        node = _scramble(np.add.reduceat(_scramble(hashes), starts) + _scramble(counts.astype(np.uint64)))
        low, high = np.zeros(len(kept), np.uint64), np.zeros(len(kept), np.uint64)
        bands = np.zeros((len(kept), BANDS), np.uint64)
        for i in range(BITS):
            least = np.minimum.reduceat(hashes * FACTORS[i] + SHIFTS[i], starts)
            low |= ((least >> np.uint64(17)) & np.uint64(1)) << np.uint64(i)
            high |= ((least >> np.uint64(18)) & np.uint64(1)) << np.uint64(i)
            if i < BANDS * ROWS:
                bands[:, i // ROWS] = _scramble(bands[:, i // ROWS] * MIX + least + np.uint64(i))
    return kept, node.view(np.int64), low.view(np.int64), high.view(np.int64), bands.view(np.int64)


@dataclass
class NearPairs:
    """Members (key, node) of all texts that took part, and the links (a, b, similarity) between nodes, a < b."""

    members: DataFrame
    links: DataFrame


def bucket_pairs(banded: DataFrame, most: int, hot_share: int, hot_nodes: int) -> DataFrame:
    """(a, b): pairs of nodes of ``banded`` (node, low, high, bucket) in one bucket that differ in ``most`` places at most, a < b."""
    differing = F.bit_count(F.col("a.low").bitwiseXOR(F.col("b.low")).bitwiseOR(F.col("a.high").bitwiseXOR(F.col("b.high"))))

    def met(left: DataFrame, right: DataFrame, together) -> DataFrame:
        return left.alias("a").join(right.alias("b"), together & (differing <= most)).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))

    sampled = banded.where(F.pmod(F.xxhash64("node"), F.lit(hot_share)) == 0).groupBy("bucket").agg(F.countDistinct("node").alias("n"))
    hot = written(sampled.where(F.col("n") * hot_share > hot_nodes).select("bucket", F.ceil(F.col("n") * hot_share / hot_nodes).cast("int").alias("blocks")), "hot")
    rest = banded.join(hot, "bucket", "left_anti")
    found = met(rest, rest, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.node") < F.col("b.node")))
    cut = banded.join(hot, "bucket").withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    x = cut.select("node", "low", "high", "bucket", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    y = cut.select("node", "low", "high", "bucket", F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), "own")).alias("i"))
    same_block = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    found = found.unionByName(met(x, y, same_block & (F.col("a.node") != F.col("b.node")) & ((F.col("a.i") < F.col("a.j")) | (F.col("a.node") < F.col("b.node")))))
    return found.distinct()


def near_pairs(rows: DataFrame, threshold: float = 0.6, width: int = 3, min_words: int = 30, key: str = "chunk_id", text: str = "text", deviations: float = 4.0, hot_share: int = HOT_SHARE, hot_nodes: int = HOT_NODES) -> NearPairs:
    """``deviations``: by how many standard deviations the estimate may fall short of the threshold."""
    kind = rows.schema[key].dataType.simpleString()

    def sketches(batches):
        shingler = shingler_of(width)
        sent: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # a block's hashes stay in the cache
                part = batch.slice(at, 512)
                kept, node, low, high, bands = sketch(part.column(1).to_pylist(), shingler, min_words)
                first = np.zeros(len(node), bool)
                for i, n in enumerate(node.tolist()):
                    if n not in sent:
                        first[i] = True
                        sent.add(n)
                if len(sent) > 500_000:
                    sent.clear()
                ends = np.append(0, np.cumsum(first * BANDS)).astype("i4")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(bands[first]).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), pa.array(node), pa.array(low), pa.array(high), lists], [key, "node", "low", "high", "buckets"])

    source = rows.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull())
    sketched = written(source.mapInArrow(sketches, f"`{key}` {kind}, node bigint, low bigint, high bigint, buckets array<bigint>"), "sketch")
    members = sketched.select(key, "node").distinct()
    banded = sketched.select("node", "low", "high", F.explode("buckets").alias("bucket"))
    unequal = 0.75 * (1 - threshold)
    most = int(BITS * unequal + deviations * (BITS * unequal * (1 - unequal)) ** 0.5)
    pairs = written(bucket_pairs(banded, most, hot_share, hot_nodes), "pairs")

    @F.pandas_udf("double")
    def jaccard(left, right):
        import pandas as pd

        shingler = shingler_of(width)
        sets = []
        for column in (left, right):
            hashes, starts, _ = shingler.sets(column.tolist())
            sets.append((hashes, np.append(starts, len(hashes))))
        (x, at), (y, by) = sets
        out = []
        for s, e, t, f in zip(at, at[1:], by, by[1:]):
            common = len(np.intersect1d(x[s:e], y[t:f], assume_unique=True))
            out.append(common / max(1, (e - s) + (f - t) - common))
        return pd.Series(out, dtype="float64")

    # any text of a node has the node's shingle set
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = sketched.groupBy("node").agg(F.min(key).alias(key)).join(wanted, "node", "left_semi")
    keyed = pairs.join(one.select(F.col("node").alias("a"), F.col(key).alias("ka")), "a").join(one.select(F.col("node").alias("b"), F.col(key).alias("kb")), "b")
    texts = source.select(F.col(key).alias("k"), F.col(text).alias("t"))
    half = keyed.join(texts, F.col("ka") == F.col("k")).select("a", "b", "kb", F.col("t").alias("ta"))
    links = half.join(texts, F.col("kb") == F.col("k")).select("a", "b", jaccard("ta", "t").alias("similarity"))
    links = links.where(F.col("similarity") >= threshold).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return NearPairs(members, links)


def groups(near: NearPairs, key: str = "chunk_id") -> DataFrame:
    """(key, class, links): the class of each text that took part, named by a node, and how many other texts it is linked to.

    Copies share a node; links between different texts make the classes.
    """
    from tesselar.operators.graph import components

    links = written(near.links.select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
    of = components(links).select("node", F.col("component").alias("class"))
    n = links.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    return near.members.join(of, "node", "left").join(n, "node", "left").select(key, F.coalesce("class", "node").alias("class"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def expand(near: NearPairs, key: str = "chunk_id") -> DataFrame:
    """All pairs of keys whose texts are linked or equal, the smaller key first."""
    m = near.members
    x, y = m.select(F.col(key).alias("x"), F.col("node").alias("nx")), m.select(F.col(key).alias("y"), F.col("node").alias("ny"))
    equal = x.join(y, (F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))).select("x", "y")
    linked = near.links.join(x, F.col("a") == F.col("nx")).join(y, F.col("b") == F.col("ny")).where(F.col("x") != F.col("y"))
    linked = linked.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return equal.unionByName(linked).select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b")).distinct()
