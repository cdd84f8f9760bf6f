"""Geodesic between two trees, plainly, on Python lists of (mask, length): what the array version is tested against."""

from __future__ import annotations

from collections import deque
from math import sqrt

Edges = list[tuple[int, float]]


def crosses(a: int, b: int) -> bool:
    both = a & b
    return both != 0 and both != a and both != b


def decompose(a: Edges, b: Edges) -> tuple[list[tuple[int, float, float]], dict[int, tuple[Edges, Edges]]]:
    """Common edges (mask, both lengths; 0 where a tree lacks one that all its edges allow), and the other edges by the
    smallest common edge around them (0: the root)."""
    in_a, in_b = dict(a), dict(b)
    left_a = [(m, x) for m, x in a if m not in in_b and any(crosses(m, n) for n in in_b)]
    left_b = [(m, x) for m, x in b if m not in in_a and any(crosses(m, n) for n in in_a)]
    apart = {m for m, _ in left_a} | {m for m, _ in left_b}
    common = sorted((in_a.keys() | in_b.keys()) - apart)
    by_size = sorted(common, key=int.bit_count)
    parts: dict[int, tuple[Edges, Edges]] = {}
    for side, edges in enumerate((left_a, left_b)):
        for m, x in edges:
            owner = next((c for c in by_size if c != m and c & m == m), 0)
            parts.setdefault(owner, ([], []))[side].append((m, x))
    return [(m, in_a.get(m, 0.0), in_b.get(m, 0.0)) for m in common], parts


def norm(edges: Edges) -> float:
    return sqrt(sum(x * x for _, x in edges))


def least_cover(a: Edges, b: Edges) -> tuple[float, set[int], set[int]]:
    """Least-weight vertex cover of the crossing graph, by augmenting paths; weights are squared lengths as shares of
    their side. Returns its weight and the places covered on both sides."""
    total_a, total_b = sum(x * x for _, x in a), sum(x * x for _, x in b)
    free_a, free_b = [x * x / total_a for _, x in a], [x * x / total_b for _, x in b]
    near = [[j for j, (n, _) in enumerate(b) if crosses(m, n)] for m, _ in a]
    flow: dict[tuple[int, int], float] = {}
    small = 1e-15
    moved = 0.0
    while True:
        came: dict[tuple[int, int], tuple[int, int] | None] = {(0, i): None for i, f in enumerate(free_a) if f > small}
        queue, end = deque(came), None
        while queue and end is None:
            side, k = queue.popleft()
            if side == 0:
                steps = [(1, j) for j in near[k]]
            else:
                if free_b[k] > small:
                    end = (1, k)
                    break
                steps = [(0, i) for i in range(len(a)) if flow.get((i, k), 0.0) > small]
            for s in steps:
                if s not in came:
                    came[s] = (side, k)
                    queue.append(s)
        if end is None:
            break
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        pairs = list(zip(path, path[1:]))
        amount = min([free_a[path[0][1]], free_b[end[1]], *(flow[t[1], f[1]] for f, t in pairs if f[0] == 1)])
        free_a[path[0][1]] -= amount
        free_b[end[1]] -= amount
        for f, t in pairs:
            key = (f[1], t[1]) if f[0] == 0 else (t[1], f[1])
            flow[key] = flow.get(key, 0.0) + (amount if f[0] == 0 else -amount)
        moved += amount
    return moved, {i for i in range(len(a)) if (0, i) not in came}, {j for j in range(len(b)) if (1, j) in came}


def ratios(a: Edges, b: Edges) -> list[tuple[Edges, Edges]]:
    """The support of one part: pairs of edges dropped and added, in order."""
    if len(a) == 1 or len(b) == 1:
        return [(a, b)]
    weight, cover_a, cover_b = least_cover(a, b)
    if weight >= 1 - 1e-12:
        return [(a, b)]
    first = [e for i, e in enumerate(a) if i in cover_a], [e for j, e in enumerate(b) if j not in cover_b]
    second = [e for i, e in enumerate(a) if i not in cover_a], [e for j, e in enumerate(b) if j in cover_b]
    if not all((*first, *second)):
        return [(a, b)]
    return ratios(*first) + ratios(*second)


def merge(sequence: list[tuple[Edges, Edges]], strict: bool = False) -> list[tuple[Edges, Edges]]:
    """Joins neighbours until the ratios of norms don't descend (or, strictly, ascend)."""
    out: list[tuple[Edges, Edges]] = []
    for a, b in sequence:
        out.append((a, b))
        while len(out) > 1:
            (a1, b1), (a2, b2) = out[-2:]
            low, high = norm(a1) * norm(b2), norm(a2) * norm(b1)
            if low < high - 1e-12 * high or (not strict and low <= high + 1e-12 * high):
                break
            out[-2:] = [(a1 + a2, b1 + b2)]
    return out


def geodesic(a: Edges, b: Edges) -> tuple[list[tuple[int, float, float]], list[tuple[int, Edges, Edges]]]:
    """Common edges, and the ratios of all parts (owner, dropped, added) interleaved by their ratio."""
    common, parts = decompose(a, b)
    found = [(owner, x, y) for owner, (p, q) in sorted(parts.items()) for x, y in merge(ratios(p, q))]
    found.sort(key=lambda r: norm(r[1]) / norm(r[2]))
    return common, found
