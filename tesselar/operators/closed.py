"""Triangles and wedges of large graphs, counted over packed lists of pairs.

Nodes are numbered densely from few to many rows, so an edge runs from its lower
number to its higher and no node, however large a hub, keeps a long list. Pairs
travel sorted and packed, about a byte each, never as a row each. Numbers are dealt
to P parts; what a list has in part b closes with what it has in part c over the
edges from b to c, so cell (b, c) is a task of its own, holds 1 / P^2 of the
edges and reads every list's two parts only: a pair travels 2 P - 1 times.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.storage import written

#: Pairs that a task collects before it packs them; pairs of a bucket; edges of a cell; nodes whose numbers are broadcast.
HELD, BUCKET, CELL, SENT = 2_000_000, 4_000_000, 6_000_000, 1_000_000
FINE = 1024


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys (u << 32 | v): their steps as planes of bytes, compressed."""
    planes = np.diff(keys, prepend=0).astype("<u8").view("u1").reshape(-1, 8).T
    return _codec().compress(np.ascontiguousarray(planes), asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_codec().decompress(data, n * 8, asbytes=True), "u1").reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8")[:, 0].astype("int64"))


def numbers(counts: DataFrame) -> tuple[DataFrame, int]:
    """(n, k) and how many: the nodes of (n, d) numbered from 0 on by d."""
    kept = written(counts.orderBy("d", "n").select("n", F.monotonically_increasing_id().alias("k")), "numbers")
    part, place = F.shiftright("k", 33), F.col("k").bitwiseAND(F.lit((1 << 33) - 1))
    runs = sorted(kept.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect())
    if not runs:
        return kept, 0
    starts = dict(zip((r.p for r in runs), accumulate((r.c for r in runs), initial=0)))
    total = sum(r.c for r in runs)
    if total >= 1 << 31:
        raise ValueError("numbers of nodes are packed in 31 bits")
    at = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv))
    return kept.select("n", (F.element_at(at, part) + place).cast("int").alias("k")), total


def _numbered(rows: DataFrame, of: DataFrame, n: int, *columns: str) -> DataFrame:
    for x in columns:
        names = of.select(F.col("n").alias(x), F.col("k").alias(f"k_{x}"))
        rows = rows.join(F.broadcast(names) if n <= SENT else names.hint("merge"), x).drop(x)
    return rows


class _Held:
    """Pairs waiting to be packed, by fine bucket of the lower number."""

    def __init__(self):
        self.keys, self.n = [], 0

    def add(self, u, v):
        self.keys.append(u.astype("int64") << 32 | v.astype("int64"))
        self.n += len(u)

    def packed(self) -> pa.RecordBatch:
        keys = np.unique(np.concatenate(self.keys)) if self.keys else np.zeros(0, "int64")
        self.keys, self.n = [], 0
        h = (keys >> 32) % FINE
        order = np.argsort(h, kind="stable")
        ends = np.cumsum(np.bincount(h, minlength=FINE))
        out = [(i, x) for i, x in enumerate(np.split(keys[order], ends[:-1])) if len(x)]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([len(x) for _, x in out], pa.int64()), pa.array([pack(x) for _, x in out], pa.binary())], ["h", "n", "data"])


PACKED = "h int, n bigint, data binary"


def _edges(batches):
    held = _Held()
    for b in batches:
        u, v = b.column("k_a").to_numpy(), b.column("k_b").to_numpy()
        held.add(np.minimum(u, v)[u != v], np.maximum(u, v)[u != v])
        if held.n >= HELD:
            yield held.packed()
    yield held.packed()


def _members(batches):
    """Pairs of each group's members; rows come sorted by group and member, a group may go on in the next batch."""
    held, group, member = _Held(), np.zeros(0, "int64"), np.zeros(0, "int32")

    def pairs(g, m):
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (m[1:] != m[:-1])
        g, m = g[keep], m[keep]
        at, by = np.arange(len(g)), 0
        while len(at):
            by += 1
            at = at[at + by < len(g)]
            at = at[g[at] == g[at + by]]
            held.add(m[at], m[at + by])
            if held.n >= HELD:
                yield held.packed()

    for b in batches:
        group, member = np.concatenate([group, b.column("g").to_numpy()]), np.concatenate([member, b.column("k_src").to_numpy()])
        if not len(group):
            continue
        whole = np.searchsorted(group, group[-1])
        yield from pairs(group[:whole], member[:whole])
        group, member = group[whole:], member[whole:]
    yield from pairs(group, member)
    yield held.packed()


def packed_edges(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Packed edges (a, b), and the number of nodes."""
    of, n = numbers(pairs.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d")))
    return _numbered(pairs.select("a", "b"), of, n, "a", "b").mapInArrow(_edges, PACKED), n


def packed_co_members(members: DataFrame) -> tuple[DataFrame, int]:
    """Packed pairs of ``src`` that share a ``dst`` (a number), and the number of ``src``."""
    members = members.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", F.col("dst").cast("bigint").alias("g"))
    of, n = numbers(members.groupBy(F.col("src").alias("n")).agg(F.count(F.lit(1)).alias("d")))
    return _numbered(members, of, n, "src").repartition("g").sortWithinPartitions("g", "k_src").mapInArrow(_members, PACKED), n


def count(packed: DataFrame, nodes: int) -> tuple[int, int | None]:
    """Triangles and wedges of the simple graph; no wedges (None) without an edge."""
    held = written(packed, "packed")
    total = held.agg(F.sum("n")).first()[0] or 0
    if not total:
        return 0, None
    parts = 4
    while total / parts**2 > CELL:
        parts *= 2
    buckets = max(2 * parts, 8)
    while total / buckets > BUCKET and buckets < FINE:
        buckets *= 2
    lists = written(held.withColumn("g", F.col("h") % buckets).groupBy("g").applyInArrow(_merged(parts, nodes), "g int, p int, n bigint, data binary, nodes array<int>, degrees array<int>"), "lists")
    degrees = lists.where("p < 0").select(F.explode(F.arrays_zip("nodes", "degrees")).alias("x")).groupBy("x.nodes").agg(F.sum("x.degrees").alias("d"))
    wedges = degrees.agg(F.sum(F.expr("d * (d - 1) div 2"))).first()[0]
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    cells = F.array_union(F.transform(every, lambda x: F.col("p") * parts + x), F.transform(every, lambda x: x * parts + F.col("p")))
    dealt = lists.where("p >= 0").select("g", "p", "n", "data", F.explode(cells).alias("cell"))
    # a cell is a task: hashes would put two in one and leave others without
    closed = dealt.repartitionById(parts * parts, F.col("cell")).groupBy("cell").applyInArrow(_closed(parts, nodes), "triangles bigint").agg(F.sum("triangles")).first()[0]
    return closed or 0, wedges


def _merged(parts: int, nodes: int):
    """The pairs of a bucket, each once, by part of the higher number; and how many of them each node has."""

    def run(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        keys = np.unique(np.concatenate([unpack(d, n) for d, n in zip(table.column("data").to_pylist(), table.column("n").to_pylist())]))
        u, v = keys >> 32, keys & 0xFFFFFFFF
        ends, often = np.unique(np.concatenate([u, v]), return_counts=True)
        rows = [(p, x) for p in range(parts) if len(x := keys[v % parts == p])]
        none = [None] * len(rows)
        return pa.table(
            {
                "g": pa.array([g] * (len(rows) + 1), pa.int32()),
                "p": pa.array([*(p for p, _ in rows), -1], pa.int32()),
                "n": pa.array([*(len(x) for _, x in rows), 0], pa.int64()),
                "data": pa.array([*(pack(x) for _, x in rows), None], pa.binary()),
                "nodes": pa.array([*none, ends.astype("int32")], pa.list_(pa.int32())),
                "degrees": pa.array([*none, often.astype("int32")], pa.list_(pa.int32())),
            }
        )

    return run


def _closed(parts: int, nodes: int):
    """Triangles u < v < w with v in part b and w in part c; lists of 64 nodes meet the edges from b to c at once, a bit each."""

    def run(table: pa.Table) -> pa.Table:
        b, c = divmod(table.column("cell")[0].as_py(), parts)
        rows = {(g, p): (d, n) for g, p, n, d in zip(*(table.column(x).to_pylist() for x in ("g", "p", "n", "data")))}
        own = [unpack(*rows[k]) for k in sorted(rows) if k[1] == c and k[0] % parts == b]
        if not own:
            return pa.table({"triangles": pa.array([0], pa.int64())})
        keys = np.sort(np.concatenate(own))
        owner, near = (keys >> 32) // parts, (keys & 0xFFFFFFFF) // parts
        size = nodes // parts + 1
        starts = np.searchsorted(owner, np.arange(size + 1))
        lens = np.diff(starts)
        of_v, of_w = np.zeros(size, "uint64"), np.zeros(size, "uint64")
        step = 1 << 16
        one, two = np.empty(step, "uint64"), np.empty(step, "uint64")
        found = 0

        def lists(g, p):
            if (g, p) not in rows:
                return {}
            k = unpack(*rows[g, p])
            u, other = k >> 32, (k & 0xFFFFFFFF) // parts
            first = np.flatnonzero(np.diff(u, prepend=-1))
            return dict(zip(u[first].tolist(), np.split(other, first[1:])))

        for g in sorted({g for g, _ in rows}):
            to_v = lists(g, b)
            to_w = to_v if b == c else lists(g, c)
            us = sorted(to_v.keys() & to_w.keys())
            for at in range(0, len(us), 64):
                of_v[:] = 0
                of_w[:] = 0
                for i, u in enumerate(us[at : at + 64]):
                    bit = np.uint64(1 << i)
                    of_v[to_v[u]] |= bit
                    of_w[to_w[u]] |= bit
                vs = np.flatnonzero(of_v)
                lo, hi = starts[vs[0]], starts[vs[-1] + 1]
                n = lens[vs]
                wanted = int(n.sum())
                if 3 * wanted > hi - lo:
                    places = None
                else:
                    before = np.cumsum(n) - n
                    places, lo, hi = np.repeat(starts[vs] - before, n) + np.arange(wanted), 0, wanted
                for x in range(int(lo), int(hi), step):
                    y = min(x + step, int(hi))
                    w, v = (near[x:y], owner[x:y]) if places is None else (near[places[x:y]], owner[places[x:y]])
                    p, q = one[: y - x], two[: y - x]
                    np.take(of_w, w, out=p, mode="clip")
                    np.take(of_v, v, out=q, mode="clip")
                    p &= q
                    found += int(np.bitwise_count(p).sum(dtype="int64"))
        return pa.table({"triangles": pa.array([found], pa.int64())})

    return run
