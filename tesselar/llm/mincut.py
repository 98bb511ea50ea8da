"""Minimum cuts of small graphs: two-way labelling with costs and smoothness."""

from __future__ import annotations

from collections import deque


def min_cut_labels(cost_off: list[float], cost_on: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True is on) of least total cost.

    ``cost_off[i]`` is paid if node i is off, ``cost_on[i]`` if it is on, and an
    edge's weight if its ends differ. Ties are off. Augmenting paths by breadth-first search
    (levels) and blocking flows; costs are the capacities to the terminals.
    """
    n = len(cost_off)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forward: float, backward: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forward)
        out[b].append(len(to))
        to.append(a)
        cap.append(backward)

    for i in range(n):
        common = min(cost_off[i], cost_on[i])  # paid either way
        if cost_off[i] > common:
            arc(source, i, cost_off[i] - common, 0.0)
        elif cost_on[i] > common:
            arc(i, sink, cost_on[i] - common, 0.0)
    for a, b, w in edges:
        if w > 0 and a != b:
            arc(a, b, w, w)

    level: list[int] = []

    def levels() -> bool:
        nonlocal level
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        return level[sink] >= 0

    while levels():
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                path, a = [], source
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                at[a] += 1
            else:
                break
    return [level[i] >= 0 for i in range(n)]
