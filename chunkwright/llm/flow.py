"""Min-cost flow of token capacity from membership patterns to source quotas."""

from __future__ import annotations

from collections import deque


def quotas(sizes: dict, weights: dict, total: int, most: int) -> dict[object, float]:
    """Targets that share ``total`` by weight, none above ``most`` times its source's size; the excess is shared anew."""
    open_, target, left = {s for s in sizes if sizes[s] > 0}, {s: 0.0 for s in sizes}, float(total)
    while open_:
        whole = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / whole > most * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weights[s] / whole
            break
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


class MinCostFlow:
    """Successive shortest paths on integer capacities."""

    def __init__(self):
        self.to, self.capacity, self.cost, self.out = [], [], [], []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def edge(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        for x, y, cap, c in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.capacity.append(cap)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        while True:
            far, via = {source: 0}, {}
            queue, queued = deque([source]), {source}
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.capacity[e] > 0 and far[a] + self.cost[e] < far.get(b, 1 << 60):
                        far[b], via[b] = far[a] + self.cost[e], e
                        if b not in queued:
                            queue.append(b)
                            queued.add(b)
            if sink not in via:
                return
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            amount = min(self.capacity[e] for e in path)
            for e in path:
                self.capacity[e] -= amount
                self.capacity[e ^ 1] += amount


def route(patterns: dict[tuple, int], targets: dict[object, float], most: int) -> dict[tuple, int]:
    """Tokens to take of each pattern (a tuple of sources): every quota as far as it goes, at the least repetition.

    A pattern of n tokens gives n for nothing, n more at cost 1 each, then n at
    cost 2 and so on up to ``most`` copies: the costs are convex, so a further
    copy is taken only where no first copy is left for the quota.
    """
    net = MinCostFlow()
    source, sink = net.node(), net.node()
    at = {s: net.node() for s in targets}
    for s, tokens in targets.items():
        net.edge(at[s], sink, round(tokens))
    copies = {}
    for pattern, tokens in patterns.items():
        node = net.node()
        copies[pattern] = [net.edge(source, node, tokens, cost) for cost in range(most)]
        for s in pattern:
            net.edge(node, at[s], most * tokens)
    net.run(source, sink)
    return {p: sum(net.capacity[e ^ 1] for e in edges) for p, edges in copies.items()}
