"""Integer min-cost max-flow: Dijkstra potentials, then blocking flow along tight arcs."""

from __future__ import annotations

import heapq
from collections.abc import Iterable


class FlowNetwork:
    """Residual network over nodes 0..n-1 with integer capacities and non-negative costs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        """Add an arc and its reverse; returns the arc's number."""
        k = len(self.head)
        self.head += [b, a]
        self.room += [capacity, 0]
        self.cost += [cost, -cost]
        self.out[a].append(k)
        self.out[b].append(k + 1)
        return k

    def sent(self, k: int) -> int:
        return self.room[k ^ 1]

    def solve(self, s: int, t: int) -> tuple[int, int]:
        """Send as much as possible from s to t as cheaply as possible: (flow, cost)."""
        n = len(self.out)
        price = [0] * n
        flow = cost = 0
        while True:
            far = self._distances(s, price)
            if far[t] is None:
                return flow, cost
            top = max(d for d in far if d is not None)
            for v in range(n):
                price[v] += top if far[v] is None else far[v]
            step = price[t] - price[s]
            while pushed := self._blocking(s, t, price):
                flow += pushed
                cost += pushed * step

    def _distances(self, s: int, price: list[int]) -> list[int | None]:
        far: list[int | None] = [None] * len(self.out)
        far[s] = 0
        queue = [(0, s)]
        while queue:
            d, v = heapq.heappop(queue)
            if d > far[v]:
                continue
            for k in self.out[v]:
                w = self.head[k]
                if self.room[k] > 0:
                    e = d + self.cost[k] + price[v] - price[w]
                    if far[w] is None or e < far[w]:
                        far[w] = e
                        heapq.heappush(queue, (e, w))
        return far

    def _blocking(self, s: int, t: int, price: list[int]) -> int:
        """One blocking flow in the level graph of arcs whose reduced cost is zero."""

        def tight(k: int, v: int) -> bool:
            return self.room[k] > 0 and self.cost[k] + price[v] == price[self.head[k]]

        level = {s: 0}
        ring = [s]
        while ring and t not in level:
            nxt = []
            for v in ring:
                for k in self.out[v]:
                    if tight(k, v) and self.head[k] not in level:
                        level[self.head[k]] = level[v] + 1
                        nxt.append(self.head[k])
            ring = nxt
        if t not in level:
            return 0
        at = {v: 0 for v in level}
        total = 0
        while True:
            path: list[int] = []
            v = s
            while v != t:
                arcs = self.out[v]
                while at[v] < len(arcs):
                    k = arcs[at[v]]
                    w = self.head[k]
                    if tight(k, v) and level.get(w, -1) == level[v] + 1:
                        path.append(k)
                        v = w
                        break
                    at[v] += 1
                else:
                    if not path:
                        return total
                    level[v] = -1
                    v = self.head[path.pop() ^ 1]
            put = min(self.room[k] for k in path)
            for k in path:
                self.room[k] -= put
                self.room[k ^ 1] += put
            total += put


def route(
    patterns: Iterable[tuple[tuple[str, ...], int]], quotas: dict[str, int], repeat_costs: list[int]
) -> tuple[dict[tuple[int, str], int], int, int]:
    """Route the token capacity of membership patterns to source quotas.

    ``patterns`` are (sources, tokens); the r-th use of a pattern's tokens costs
    ``repeat_costs[r]`` a token, which must not fall with r. Returns ({(pattern number, source):
    tokens}, tokens routed, cost).
    """
    if any(a > b for a, b in zip(repeat_costs, repeat_costs[1:])):
        raise ValueError("repetition costs must be convex: marginal costs may not fall")
    patterns = list(patterns)
    names = sorted(quotas)
    number = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    net = FlowNetwork(2 + len(patterns) + len(names))
    sink = len(net.out) - 1
    links = []
    for i, (members, tokens) in enumerate(patterns):
        for c in repeat_costs:
            net.arc(0, 1 + i, tokens, c)
        links += [(i, s, net.arc(1 + i, number[s], tokens * len(repeat_costs))) for s in sorted(set(members)) if s in number]
    for s in names:
        net.arc(number[s], sink, quotas[s])
    flow, cost = net.solve(0, sink)
    return {(i, s): net.sent(k) for i, s, k in links if net.sent(k)}, flow, cost
