"""Plain forms on the driver that tests compare with."""

from __future__ import annotations

from collections import defaultdict

import numpy as np


def louvain(edges: list[tuple[int, int, float]], resolution: float = 1.0, seed: int = 42) -> dict[int, int]:
    """Communities of a small graph: local moves by modularity gain, then the graph of communities, named by their least nodes."""
    member = {n: n for e in edges for n in e[:2]}
    graph: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        graph[a][b] += w
        if a != b:
            graph[b][a] += w
    rng = np.random.Generator(np.random.PCG64(seed))
    while True:
        degree = {n: sum(w for m, w in graph[n].items()) + graph[n].get(n, 0.0) for n in graph}
        total = sum(degree.values())
        if not total:
            break
        label, sums = {n: n for n in graph}, dict(degree)
        moved, any_move = True, False
        while moved:
            moved = False
            for n in rng.permutation(sorted(graph)).tolist():
                home = label[n]
                sums[home] -= degree[n]
                weights: dict[int, float] = defaultdict(float)
                for m, w in graph[n].items():
                    if m != n:
                        weights[label[m]] += w
                gain = {c: w - resolution * degree[n] * sums.get(c, 0.0) / total for c, w in weights.items()}
                gain.setdefault(home, -resolution * degree[n] * sums[home] / total + weights.get(home, 0.0))
                best = max(sorted(gain), key=lambda c: gain[c])
                if gain[best] <= gain[home] + 1e-12:
                    best = home
                sums[best] = sums.get(best, 0.0) + degree[n]
                if best != home:
                    label[n], moved, any_move = best, True, True
        member = {n: label[c] for n, c in member.items()}
        if not any_move:
            break
        merged: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for n in graph:
            for m, w in graph[n].items():
                if n <= m or label[n] != label[m]:
                    a, b = label[n], label[m]
                    if a == b:
                        merged[a][a] += w
                    else:
                        merged[a][b] += w
        graph = merged
    least: dict[int, int] = {}
    for n, c in member.items():
        least[c] = min(n, least.get(c, n))
    return {n: least[c] for n, c in member.items()}
