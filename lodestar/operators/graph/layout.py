"""Orders of a graph's nodes that put nodes used together side by side. They change no search result."""

from __future__ import annotations

import heapq
from collections import deque

from .core import Graph

ORIGINAL, RCM, GORDER, PORDER = "original", "rcm", "gorder", "porder"


def _both_ways(graph: Graph) -> list[set[int]]:
    around = [set(levels[0]) for levels in graph.links]
    for i, levels in enumerate(graph.links):
        for j in levels[0]:
            around[j].add(i)
    return around


def rcm(graph: Graph) -> list[int]:
    """Reverse Cuthill-McKee: breadth first from nodes of least degree, neighbours by (degree, number), then reversed."""
    around = _both_ways(graph)
    key = [(len(a), i) for i, a in enumerate(around)]
    seen, order = [False] * len(graph), []
    for _, seed in sorted(key):
        if seen[seed]:
            continue
        seen[seed] = True
        line = deque([seed])
        while line:
            i = line.popleft()
            order.append(i)
            for j in sorted((j for j in around[i] if not seen[j]), key=key.__getitem__):
                seen[j] = True
                line.append(j)
    return order[::-1]


def gorder(graph: Graph, window: int = 5, walks: dict[tuple[int, int], int] | None = None) -> list[int]:
    """Greedy: next comes the node with the most links to, and shared sources of links with, the last ``window`` nodes.

    With ``walks`` (how often each link was walked), links count one more for each walk.
    """
    n = len(graph)
    if not n:
        return []
    out_of = [{j: 1 + (walks or {}).get((i, at), 0) for at, j in enumerate(levels[0])} for i, levels in enumerate(graph.links)]
    into: list[dict[int, int]] = [{} for _ in range(n)]
    for i, near in enumerate(out_of):
        for j, w in near.items():
            into[j][i] = w
    score, placed = [0] * n, [False] * n
    heap = [(0, i) for i in range(n)]
    heapq.heapify(heap)

    def shift(i: int, sign: int) -> None:
        changed = set()
        for near in (out_of[i], into[i]):
            for j, w in near.items():
                score[j] += sign * w
                changed.add(j)
        for source, w in into[i].items():
            for j, x in out_of[source].items():
                if j != i:
                    score[j] += sign * min(w, x)
                    changed.add(j)
        for j in changed:
            if not placed[j]:
                heapq.heappush(heap, (-score[j], j))

    order: list[int] = []
    i = max(range(n), key=lambda x: (sum(into[x].values()), -x))
    while True:
        order.append(i)
        placed[i] = True
        shift(i, 1)
        if len(order) > window:
            shift(order[-window - 1], -1)
        while heap and (placed[heap[0][1]] or -heap[0][0] != score[heap[0][1]]):
            heapq.heappop(heap)
        if not heap:
            return order
        i = heapq.heappop(heap)[1]


def window_score(graph: Graph, window: int = 5, walks: dict[tuple[int, int], int] | None = None) -> int:
    """Links (by weight) between nodes at most ``window`` places apart."""
    total = 0
    for i, levels in enumerate(graph.links):
        for at, j in enumerate(levels[0]):
            if abs(i - j) <= window:
                total += 1 + (walks or {}).get((i, at), 0)
    return total


def order(graph: Graph, how: str, window: int = 5, walks=None) -> list[int]:
    if how == ORIGINAL:
        return list(range(len(graph)))
    if how == RCM:
        return rcm(graph)
    if how == GORDER:
        return gorder(graph, window)
    if how == PORDER:
        if walks is None:
            raise ValueError("porder needs a profile of walked links")
        return gorder(graph, window, walks)
    raise ValueError(f"unknown layout: {how}")
