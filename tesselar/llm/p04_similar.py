"""Problem 4: the k most similar vectors of every vector, by a hash-prefix forest.

A tree gives a vector a long hash string, and the tree is the array of its
vectors sorted by that string; vectors that share a prefix are a contiguous range
of it. The trees share their leading symbols and differ in the others.

*Leading symbols* say which range a vector is shuffled to. Symbols are nearest
centroids, fitted on a bounded sample: one of ``symbols`` first, then, where the
range would hold over ``hot`` vectors, one of FAN of that range, and so on, so
their number differs from range to range and none grows with the collection. A vector
is a member of the range of its own prefix and a guest in the ranges of the next best
prefixes (``probes`` of them in all, twice as many with each further symbol), so
that neighbours across a border meet. Every range is a task's; no task sees more.

*Within a range* each tree hashes by centroids of its own, about CELL vectors for each,
and after that by the sides of PLANES random planes. The search descends in all
trees to the longest prefixes and ascends in all of them at once, symbol by
symbol, until the prefix ranges of a vector hold ``candidates`` vectors together:
these are compared with it, by matrix products over vectors of one prefix range.
Candidates are found for members among all, and for guests among members.
The k best of all trees, then of all ranges, are the answer.

Vectors travel as 24-bit integers of the unit vector and cosines of what is given
off are summed in double precision, exact to about 1e-7. Equal vectors are one
node: within a batch before the shuffle, and finally within the range.

Defined results: null vectors, vectors of another length, with values that are
not finite, or all zero take no part; vectors needn't be of length 1; ties go to
the smaller key; rows delivered again count once; a collection of fewer than k+1
vectors gives what there is; an empty one no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselar.storage import written

#: Vectors in the sample that leading symbols are fitted on, at most; and per centroid, at least.
SAMPLE, PER_CENTROID = 32_768, 64
#: Values of a further leading symbol; vectors per centroid of a tree; its centroids, at most; its planes.
FAN, CELL, CELLS, PLANES = 4, 256, 256, 40
SCALE = float(2**23 - 1)


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of usable vectors, their unit vectors) of an Arrow list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    usable = np.flatnonzero(np.nan_to_num(sizes.astype("f8"), nan=-1) == dim)
    flat = column.take(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).astype("f4").reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((flat.astype("f8") ** 2).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        return usable[good], (flat[good] / norm[good, None]).astype("f4")


def packed_unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors as rows of bytes, three for each number."""
    whole = np.rint(vectors.astype("f8") * SCALE).astype("<i4")
    return np.ascontiguousarray(whole.view("u1").reshape(*whole.shape, 4)[..., :3]).reshape(len(whole), -1)


def unpacked(raw: np.ndarray) -> np.ndarray:
    """The unit vectors of such rows, in double precision."""
    wide = np.zeros((len(raw), raw.shape[1] // 3, 4), "u1")
    wide[..., 1:] = raw.reshape(len(raw), -1, 3)
    v = wide.view("<i4")[..., 0].astype("f8") / 256
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def centroids(sample: np.ndarray, n: int, rng, rounds: int = 8) -> np.ndarray:
    """n unit centroids of the sample (k-means by cosine)."""
    centres = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T, 1)
        order = np.argsort(nearest, kind="stable")
        held, start = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(sample[order], start, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres[held] = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres[held])
    return centres


class Prefixes:
    """The leading symbols: a tree of centroids whose leaves are the ranges."""

    def __init__(self, sample: np.ndarray, n: int, symbols: int, hot: int, probes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.probes, self.ranges, self.depth = probes, 0, 1
        self.top = self._node(sample, max(1, min(symbols, len(sample) // PER_CENTROID)), float(n), hot, rng, 1)

    def _node(self, sample: np.ndarray, fan: int, size: float, hot: int, rng, depth: int) -> dict:
        """Centroids below a prefix that about ``size`` vectors share, and for each a range's number or the next node."""
        self.depth = max(self.depth, depth)
        if len(sample) >= 4 * fan:
            centres = centroids(sample, fan, rng)
            held = np.argmax(sample @ centres.T, 1)
            parts = [sample[held == i] for i in range(fan)]
            sizes = [size * len(x) / len(sample) for x in parts]
        else:  # too few of the sample are left: directions around what there is
            centre = sample.mean(0) if len(sample) else np.zeros(sample.shape[1], "f4")
            centres = (centre + rng.standard_normal((fan, sample.shape[1])) / sample.shape[1] ** 0.5).astype("f4")
            centres /= np.linalg.norm(centres, axis=1, keepdims=True)
            parts, sizes = [sample[:0]] * fan, [size / fan] * fan
        below = []
        for part, own in zip(parts, sizes):
            if own * self.probes > hot and depth < 12:
                below.append(self._node(part, FAN, own, hot, rng, depth + 1))
            else:
                below.append(self.ranges)
                self.ranges += 1
        return {"centres": centres, "below": below, "depth": depth}

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, range, is a member there) of all copies of the vectors."""
        found: list[tuple] = []

        def descend(node: dict, rows: np.ndarray, own: np.ndarray) -> None:
            scores = v[rows] @ node["centres"].T
            few = min(self.probes, scores.shape[1])
            best = np.argsort(-scores, axis=1, kind="stable")[:, :few]
            for i, below in enumerate(node["below"]):
                at, rank = np.nonzero(best == i)
                if not len(at):
                    continue
                mine = own[at] & (rank == 0)
                if isinstance(below, dict):
                    descend(below, rows[at], mine)
                else:
                    found.append((rows[at], np.full(len(at), below), mine, scores[at, i], np.full(len(at), node["depth"])))

        if len(v):
            descend(self.top, np.arange(len(v)), np.ones(len(v), bool))
        if not found:
            return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, bool)
        row, place, mine, score, depth = map(np.concatenate, zip(*found))
        deepest = np.zeros(len(v), "i8")
        np.maximum.at(deepest, row, depth)
        order = np.lexsort((-score, ~mine, row))
        row, place, mine = row[order], place[order], mine[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.probes * 2 ** (deepest[row] - 1)
        return row[keep], place[keep], mine[keep]


class Best:
    """The k best (query, candidate, score) found so far for each of n vectors."""

    def __init__(self, n: int, k: int, least: float):
        self.n, self.k, self.bar = n, k, np.full(n, least, "f4")
        self.kept: tuple = (np.zeros(0, "i8"), np.zeros(0, "f4"))
        self.new: list[tuple] = []

    def add(self, queries: np.ndarray, candidates: np.ndarray, scores: np.ndarray) -> None:
        """What of a matrix of scores reaches the queries' bars."""
        row, column = np.nonzero(scores >= self.bar[queries][:, None])
        a, b = queries[row], candidates[column]
        real = a != b
        self.new.append((a[real] * self.n + b[real], scores[row, column][real]))

    def merge(self) -> None:
        """Keep the k best; the k-th is the bar from now on."""
        pair, score = map(np.concatenate, zip(self.kept, *self.new))
        self.new = []
        pair, first = np.unique(pair, return_index=True)
        score = score[first]
        order = np.lexsort((-score, pair // self.n))
        a = pair[order] // self.n
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = order[rank < self.k]
        self.kept = pair[keep], score[keep]
        full = order[rank == self.k - 1]
        self.bar[pair[full] // self.n] = np.maximum(self.bar[pair[full] // self.n], score[full])


def hash_strings(v: np.ndarray, rng) -> np.ndarray:
    """The hash string of each vector in one tree, as a number: eight bits of the nearest centroid, then a bit for each plane."""
    cells = int(np.clip(len(v) // CELL, 1, CELLS))
    if cells > 1:
        size = min(len(v), PER_CENTROID // 4 * cells)
        centres = centroids(v[rng.choice(len(v), size, replace=False)], cells, rng, 3)
    else:
        centres = v.mean(0, keepdims=True)
    cell = np.argmax(v @ centres.T, 1)
    planes = rng.standard_normal((PLANES, v.shape[1])).astype("f4")
    sides = (v @ planes.T) > (centres @ planes.T)[cell]
    return (cell.astype("u8") << np.uint64(PLANES)) | (sides.astype("u8") << np.arange(PLANES - 1, -1, -1, dtype="u8")).sum(1)


def prefix_ranges(strings: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in the sorted array of the range of strings that share the first ``level`` symbols with each."""
    if level == 0:
        return np.zeros(len(strings), "i8"), np.full(len(strings), len(strings))
    prefix = strings >> np.uint64(PLANES - level + 1)
    return np.searchsorted(prefix, prefix, "left"), np.searchsorted(prefix, prefix, "right")


def search_range(v: np.ndarray, member: np.ndarray, k: int, trees: int, candidates: int, least: float = -2.0, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(query, neighbour), k for each vector of a range at most: of members among all, of guests among members."""
    n = len(v)
    best = Best(n, k, least)
    rng = np.random.default_rng([seed, n])
    forest = []
    for _ in range(trees if n > candidates else 1):
        strings = hash_strings(v, rng)
        order = np.argsort(strings, kind="stable")
        forest.append((order, strings[order]))
    # synchronous ascent: the longest prefix length at which the ranges of all trees hold enough
    level, levels = np.zeros(n, "i8"), PLANES + 1
    if n > candidates:
        open_ = np.arange(n)  # descend while there are enough
        for x in range(1, levels + 1):
            total = np.zeros(n, "i8")
            for order, strings in forest:
                start, end = prefix_ranges(strings, x)
                total[order] += end - start
            open_ = open_[total[open_] >= candidates]
            if not len(open_):
                break
            level[open_] = x
    for t, (order, strings) in enumerate(forest):
        for x in np.unique(level).tolist():
            if x == 0 and t:
                continue  # the whole range is the same in every tree
            start, end = prefix_ranges(strings, x)
            wanted = level[order] == x
            for lo in np.unique(start[wanted]).tolist():
                hi = int(end[lo])
                everyone = order[lo:hi]
                asking = everyone[wanted[lo:hi]]
                mine, theirs = asking[member[asking]], asking[~member[asking]]
                members = everyone[member[everyone]]
                for queries, among in ((mine, everyone), (theirs, members)):
                    for at in range(0, len(queries), 512 if len(among) > 4096 else 4096):
                        for by in range(0, len(among), 16_384):
                            part = queries[at : at + (512 if len(among) > 4096 else 4096)]
                            other = among[by : by + 16_384]
                            scores = v[part] @ v[other].T
                            if t == 0 and least < -1 and len(other) > 4 * k:  # a bar from the first matrix
                                bar = np.partition(scores, len(other) - k - 1, axis=1)[:, len(other) - k - 1]
                                best.bar[part] = np.maximum(best.bar[part], bar)
                            best.add(part, other, scores)
        if t & (t + 1) == 0 or t == len(forest) - 1:
            best.merge()
    pair, _ = best.kept
    return pair // n, pair % n


def most_similar(
    rows: DataFrame, k: int = 10, dim: int = 64, trees: int = 12, candidates: int = 5_000, symbols: int = 32, probes: int = 3, hot: int = 60_000,
    key: str = "chunk_id", vector: str = "embedding", min_cosine: float | None = None,
) -> DataFrame:
    """(key, neighbour, cosine, rank) for each usable vector.

    ``min_cosine`` leaves out neighbours below it (ranks stay what they are).
    """
    spark: SparkSession = rows.sparkSession
    source = rows.select(key, vector).where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    kind = rows.schema[key].dataType.simpleString()
    least = -2.0 if min_cosine is None else min_cosine - 1e-5

    def binary(raw: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in raw], pa.binary())

    def to_nodes(batches):
        for batch in batches:
            at, unit = unit_rows(batch.column(1), dim)
            body = [r.tobytes() for r in packed_unit(unit)]
            ids = np.array([xxhash.xxh64_intdigest(r) for r in body], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(ids, pa.int64()), pa.array(body, pa.binary())], [key, "node", "v"])

    def matrix(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(-1, 3 * dim)

    nodes = written(source.mapInArrow(to_nodes, f"`{key}` {kind}, node bigint, v binary"), "vectors")  # the table is read once
    n = nodes.count()
    members = nodes.select(key, "node").distinct()
    if not n:
        return members.select(key, F.col(key).alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).where(F.lit(False))
    # node ids are hashes: a bound on them samples distinct vectors at random, alike in every run
    share = min(1.0, 1.3 * SAMPLE / n)
    sampled = nodes.where(F.col("node") < int(-(1 << 63) + share * (1 << 64) * 0.9999999)).select("node", "v").dropDuplicates(["node"]).orderBy("node").limit(SAMPLE).collect()
    sample = unpacked(np.frombuffer(b"".join(r.v for r in sampled), "u1").reshape(-1, 3 * dim)).astype("f4")
    prefixes = spark.sparkContext.broadcast(Prefixes(sample, n, symbols, hot, probes))

    def placed(batches):
        for batch in batches:
            ids = batch.column(1).to_numpy()
            _, one = np.unique(ids, return_index=True)
            raw = matrix(batch.column(2))[one] if len(one) else np.zeros((0, 3 * dim), "u1")
            row, place, mine = prefixes.value.place(unpacked(raw).astype("f4"))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(mine), pa.array(ids[one][row], pa.int64()), binary(raw).take(pa.array(row))], ["range", "member", "node", "v"])

    def searched(part: pa.Table) -> pa.Table:
        ids = part.column("node").to_numpy()
        _, one = np.unique(ids, return_index=True)
        ids, v = ids[one], unpacked(matrix(part.column("v"))[one])
        a, b = search_range(v.astype("f4"), part.column("member").to_numpy()[one], k, trees, candidates, least)
        cos = np.concatenate([np.einsum("ij,ij->i", v[a[i : i + 65_536]], v[b[i : i + 65_536]]) for i in range(0, max(1, len(a)), 65_536)])
        order = np.lexsort((-cos, a))
        a, b, cos = a[order], b[order], cos[order]
        who, start = np.unique(a, return_index=True)
        offsets = pa.array(np.append(start, len(a)).astype("i4"))
        return pa.table({"node": pa.array(ids[who], pa.int64()), "near": pa.ListArray.from_arrays(offsets, pa.array(ids[b], pa.int64())), "cos": pa.ListArray.from_arrays(offsets, pa.array(cos, pa.float64()))})

    def merged(batches):
        """The k best over all ranges; batches are sorted by node, one may end within a node's rows."""
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            ids = held.column(0).to_numpy()
            done = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            if done:
                yield best_merged(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield best_merged(held)

    def best_merged(part: pa.RecordBatch) -> pa.RecordBatch:
        lengths = part.column(1).value_lengths().to_numpy()
        a = np.repeat(part.column(0).to_numpy(), lengths)
        b, cos = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
        order = np.lexsort((-cos, b, a))
        a, b, cos = a[order], b[order], cos[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, cos = a[new], b[new], cos[new]
        order = np.lexsort((b, -cos, a))
        a, b, cos = a[order], b[order], cos[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        if min_cosine is not None:
            keep &= cos >= min_cosine - 1e-7
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(cos[keep])], ["node", "near", "cosine"])

    ranges = nodes.select(key, "node", "v").mapInArrow(placed, "range bigint, member boolean, node bigint, v binary")
    per_range = ranges.groupBy("range").applyInArrow(searched, "node bigint, near array<bigint>, cos array<double>")
    best = per_range.repartition("node").sortWithinPartitions("node").mapInArrow(merged, "node bigint, near bigint, cosine double")
    # k + 1 keys of a group of equal vectors are enough for anyone's k nearest
    first = members.withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy(key))).where(F.col("i") <= k + 1)
    fewest = first.select(F.col(key).alias("neighbour"), F.col("node").alias("near"))
    others = members.join(best, "node").join(fewest, "near").select(key, "neighbour", "cosine")
    same = members.join(fewest, F.col("node") == F.col("near")).where(F.col(key) != F.col("neighbour")).select(key, "neighbour", F.lit(1.0).alias("cosine"))
    ranked = others.unionByName(same).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cosine"), "neighbour")))
    return ranked.where(F.col("rank") <= k)


def close_pairs(nearest: DataFrame, least: float, key: str = "chunk_id") -> DataFrame:
    """Pairs with a cosine of at least ``least`` of which one is among the other's nearest, the smaller key first."""
    pair = nearest.where(F.col("cosine") >= least).select(F.least(key, "neighbour").alias(f"{key}_a"), F.greatest(key, "neighbour").alias(f"{key}_b"))
    return pair.distinct()
