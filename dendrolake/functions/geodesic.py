"""Geodesics of many pairs of trees at once, on arrays; runs on batches inside Spark tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Edges of the smaller side of a part up to which all its subsets are weighed; larger parts go through a flow.
SUBSETS = 8
#: Numbers of an array at most while parts are weighed together.
_TOGETHER = 4_000_000
_LITTLE = 1e-12


@dataclass
class Edges:
    """Edges of several trees after another: each tree's first (and the end), masks as rows of words, lengths."""

    bounds: np.ndarray
    masks: np.ndarray
    lengths: np.ndarray

    def of(self, trees: np.ndarray) -> Edges:
        """The edges of these trees, which may come several times."""
        sizes = np.diff(self.bounds)[trees]
        at = ragged(self.bounds[trees], sizes)
        return Edges(np.concatenate([[0], np.cumsum(sizes)]), self.masks[at], self.lengths[at])


@dataclass
class Paths:
    """Of each pair: common edges with both lengths, by mask; and ratios by ascending value, with the common edge they lie
    under (all zeros: the root), the edges dropped and added, and their norms. ``bounds`` are of pairs, in ``a`` and ``b``
    of ratios."""

    common_bounds: np.ndarray
    common: np.ndarray
    first: np.ndarray
    second: np.ndarray
    bounds: np.ndarray
    part: np.ndarray
    a: Edges
    b: Edges
    a_norm: np.ndarray
    b_norm: np.ndarray

    def square(self) -> np.ndarray:
        """Squared length of each path without the leaves' share."""
        n = len(self.bounds) - 1
        own = np.repeat(np.arange(n), np.diff(self.common_bounds))
        ratio = np.repeat(np.arange(n), np.diff(self.bounds))
        return np.bincount(own, (self.first - self.second) ** 2, n) + np.bincount(ratio, (self.a_norm + self.b_norm) ** 2, n)


    def at(self, x: np.ndarray) -> Edges:
        """The interior edges of the trees at positions ``x`` (0 to 1) of the paths; edges that are gone are left out."""
        n = len(self.bounds) - 1
        common, ratio = (np.repeat(np.arange(n), np.diff(b)) for b in (self.common_bounds, self.bounds))
        here = (1 - x[ratio]) * self.a_norm - x[ratio] * self.b_norm
        owner, masks, lengths = [common], [self.common], [(1 - x[common]) * self.first + x[common] * self.second]
        for side, scale in ((self.a, here / self.a_norm), (self.b, -here / self.b_norm)):
            each = np.repeat(np.arange(len(ratio)), np.diff(side.bounds))
            owner.append(ratio[each])
            masks.append(side.masks)
            lengths.append(side.lengths * scale[each])
        owner, masks, lengths = map(np.concatenate, (owner, masks, lengths))
        kept = np.flatnonzero(lengths > 1e-10)
        kept = kept[np.argsort(owner[kept], kind="stable")]
        return Edges(np.searchsorted(owner[kept], np.arange(n + 1)), masks[kept], lengths[kept])


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... as many as sizes[k], for all k after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of an edge of the first and one of the second tree of each pair, by the bounds of both."""
    sizes_a, sizes_b = np.diff(a), np.diff(b)
    each = np.repeat(sizes_b, sizes_a)
    return np.repeat(np.arange(a[-1]), each), ragged(np.repeat(b[:-1], sizes_a), each)


def crosses(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Neither disjoint nor nested, row by row."""
    both = x & y
    return both.any(axis=1) & (both != x).any(axis=1) & (both != y).any(axis=1)


def _flow_cover(wa: np.ndarray, wb: np.ndarray, near: np.ndarray) -> tuple[float, np.ndarray]:
    """Weight of the least vertex cover, and which of A it leaves out, by augmenting paths."""
    free_a, free_b, flow, moved = wa.copy(), wb.copy(), np.zeros(near.shape), 0.0
    while True:
        seen_a, seen_b = free_a > 1e-15, np.zeros(len(wb), bool)
        from_a, from_b = np.full(len(wb), -1), np.full(len(wa), -1)
        new, end = np.flatnonzero(seen_a), -1
        while len(new) and end < 0:
            open_b = near[new] & ~seen_b
            found = np.flatnonzero(open_b.any(axis=0))
            from_a[found] = new[open_b[:, found].argmax(axis=0)]
            seen_b[found] = True
            if not len(found):
                break
            last = found[free_b[found] > 1e-15]
            if len(last):
                end = int(last[0])
                break
            back = (flow[:, found] > 1e-15) & ~seen_a[:, None]
            new = np.flatnonzero(back.any(axis=1))
            from_b[new] = found[back[new].argmax(axis=1)]
            seen_a[new] = True
        if end < 0:
            return moved, seen_a
        path, b = [], end
        while True:
            a = int(from_a[b])
            path.append((a, b))
            if from_b[a] < 0:
                break
            b = int(from_b[a])
        amount = min([free_a[path[-1][0]], free_b[end], *(flow[path[k][0], path[k + 1][1]] for k in range(len(path) - 1))])
        free_a[path[-1][0]] -= amount
        free_b[end] -= amount
        for k, (a, b) in enumerate(path):
            flow[a, b] += amount
            if k + 1 < len(path):
                flow[a, path[k + 1][1]] -= amount
        moved += amount


def _subset_covers(w: np.ndarray, other: np.ndarray, near: np.ndarray, smallest: bool) -> tuple[np.ndarray, np.ndarray]:
    """For parts of one size (part, edge; ``near`` part, edge, other edge): the least weight of a cover, and which of this side
    it leaves out: of equal covers the one that leaves out least (or most)."""
    s = w.shape[1]
    subsets = (np.arange(1 << s)[:, None] >> np.arange(s) & 1).astype(float)
    weight = 1 - w @ subsets.T + ((subsets @ near > 0) @ other[:, :, None])[:, :, 0]
    best = weight.min(axis=1)
    n_out = subsets.sum(axis=1)
    rank = np.where(weight <= best[:, None] + _LITTLE, n_out if smallest else -n_out, s + 1)
    return best, subsets[rank.argmin(axis=1)] > 0


def _covers(part_a: np.ndarray, part_b: np.ndarray, a: Edges, b: Edges, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For these parts (``part_*``: each edge's): whether the least cover splits them, and for all edges whether it leaves out
    that of A, or has that of B, so that they come second."""
    late_a, late_b, split = np.zeros(len(part_a), bool), np.zeros(len(part_b), bool), np.zeros(len(parts), bool)
    edges_a, edges_b = (np.argsort(p, kind="stable") for p in (part_a, part_b))
    low_a, high_a = (np.searchsorted(part_a[edges_a], parts, side) for side in ("left", "right"))
    low_b, high_b = (np.searchsorted(part_b[edges_b], parts, side) for side in ("left", "right"))
    n_a, n_b = high_a - low_a, high_b - low_b

    def weights(edges: np.ndarray, e: Edges) -> np.ndarray:
        x = e.lengths[edges] ** 2
        return x / x.sum(axis=1, keepdims=True)

    sizes = n_a * 1000 + n_b
    for size in np.unique(sizes).tolist():
        alike = np.flatnonzero(sizes == size)
        p, q = int(n_a[alike[0]]), int(n_b[alike[0]])
        step = max(1, _TOGETHER // (p * q * (1 << min(p, q) if min(p, q) <= SUBSETS else 1)))
        for at in range(0, len(alike), step):
            own = alike[at : at + step]
            ea, eb = edges_a[low_a[own][:, None] + np.arange(p)], edges_b[low_b[own][:, None] + np.arange(q)]
            wa, wb = weights(ea, a), weights(eb, b)
            near = crosses(np.repeat(a.masks[ea], q, axis=1).reshape(-1, a.masks.shape[1]), np.tile(b.masks[eb], (1, p, 1)).reshape(-1, b.masks.shape[1])).reshape(len(own), p, q)
            if p <= q and p <= SUBSETS:
                weight, out = _subset_covers(wa, wb, near.astype(float), True)
                second = (out[:, :, None] & near).any(axis=1)
            elif q <= SUBSETS:
                weight, out_b = _subset_covers(wb, wa, near.astype(float).transpose(0, 2, 1), False)
                out = ~(out_b[:, None, :] & near).any(axis=2)
                second = (out[:, :, None] & near).any(axis=1)
            else:
                found = [_flow_cover(x, y, z) for x, y, z in zip(wa, wb, near)]
                weight, out = np.array([f[0] for f in found]), np.array([f[1] for f in found])
                second = (out[:, :, None] & near).any(axis=1)
            good = (weight < 1 - _LITTLE) & out.any(axis=1) & ~out.all(axis=1) & second.any(axis=1) & ~second.all(axis=1)
            split[own] = good
            late_a[ea[good]], late_b[eb[good]] = out[good], second[good]
    return split, late_a, late_b


def geodesics(a: Edges, b: Edges, strict: bool = False) -> Paths:
    """The geodesic from each tree of ``a`` to the one of ``b`` at its place. ``strict``: equal ratios are one, under the root.

    Edges that cross none of the other tree are common (of length 0 where it lacks them). The others lie under the smallest
    common edge that holds them, which cuts the pair into parts; a part with one edge on a side is one ratio, others are
    split by least covers of their crossings until none splits.
    """
    n, words = len(a.bounds) - 1, a.masks.shape[1]
    pair_a, pair_b = (np.repeat(np.arange(n), np.diff(e.bounds)) for e in (a, b))
    ia, ib = met(a.bounds, b.bounds)
    cross, same = crosses(a.masks[ia], b.masks[ib]), (a.masks[ia] == b.masks[ib]).all(axis=1)
    apart_a, apart_b = np.zeros(len(pair_a), bool), np.zeros(len(pair_b), bool)
    apart_a[ia[cross]], apart_b[ib[cross]] = True, True
    other, known = np.zeros(len(pair_a)), np.zeros(len(pair_b), bool)
    other[ia[same]], known[ib[same]] = b.lengths[ib[same]], True
    apart_a[ia[same]], apart_b[known] = False, False

    alone = ~apart_b & ~known
    pair = np.concatenate([pair_a[~apart_a], pair_b[alone]])
    masks = np.concatenate([a.masks[~apart_a], b.masks[alone]])
    first = np.concatenate([a.lengths[~apart_a], np.zeros(alone.sum())])
    second = np.concatenate([other[~apart_a], b.lengths[alone]])
    order = np.lexsort((*masks.T, pair))
    pair, masks, first, second = pair[order], masks[order], first[order], second[order]
    common_bounds = np.searchsorted(pair, np.arange(n + 1))

    # the smallest common edge around each edge that is apart
    left = [Edges(np.searchsorted(p[x], np.arange(n + 1)), e.masks[x], e.lengths[x]) for e, x, p in ((a, apart_a, pair_a), (b, apart_b, pair_b))]
    sizes = np.bitwise_count(masks).sum(axis=1).astype(np.int64)
    part = []
    for e in left:
        k, c = met(e.bounds, common_bounds)
        inside = ((masks[c] & e.masks[k]) == e.masks[k]).all(axis=1)
        owner = np.full(len(e.lengths), np.iinfo(np.int64).max)
        np.minimum.at(owner, k[inside], sizes[c[inside]] << 40 | c[inside])
        owner = np.where(owner == np.iinfo(np.int64).max, -1, owner & (1 << 40) - 1)
        part.append(np.repeat(np.arange(n), np.diff(e.bounds)) + (owner + 1) * n)  # one number for a pair and an owner
    names, number = np.unique(np.concatenate(part), return_inverse=True)
    seg_a, seg_b = number[: len(part[0])], number[len(part[0]) :]
    of_part = np.arange(len(names))
    lost = np.setxor1d(seg_a, seg_b)
    assert not len(lost), "edges of one tree cross none of the other's under their common edge"

    open_ = of_part
    while len(open_):
        n_a, n_b = np.bincount(seg_a, minlength=len(of_part)), np.bincount(seg_b, minlength=len(of_part))
        open_ = open_[(n_a[open_] > 1) & (n_b[open_] > 1)]
        if not len(open_):
            break
        split, late_a, late_b = _covers(seg_a, seg_b, *left, open_)
        open_ = open_[split]
        new = np.full(len(of_part), -1)
        new[open_] = len(of_part) + np.arange(len(open_))
        seg_a, seg_b = np.where(late_a, new[seg_a], seg_a), np.where(late_b, new[seg_b], seg_b)
        of_part = np.concatenate([of_part, of_part[open_]])
        open_ = np.concatenate([open_, new[open_]])

    norm = lambda e, s, m: np.sqrt(np.bincount(s, e.lengths**2, m))
    m = len(of_part)
    value = norm(left[0], seg_a, m) / norm(left[1], seg_b, m) if m else np.zeros(0)
    of_pair, owner = names[of_part] % n if n else names[of_part], names[of_part] // max(n, 1) - 1
    order = np.lexsort((np.arange(m), owner, value, of_pair))
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    if strict and m:
        v, p = value[order], of_pair[order]
        merged = np.cumsum(np.concatenate([[True], (p[1:] != p[:-1]) | (v[:-1] < v[1:] * (1 - _LITTLE))])) - 1
        rank = merged[rank]
    groups = int(rank.max()) + 1 if m else 0
    pair_of = np.zeros(groups, np.int64)
    pair_of[rank] = of_pair
    under = np.zeros((groups, words), np.int64)
    if not strict:
        under[rank[owner >= 0]] = masks[owner[owner >= 0]]
    sides = []
    for e, s in zip(left, (rank[seg_a], rank[seg_b])):
        by = np.argsort(s, kind="stable")
        sides.append(Edges(np.searchsorted(s[by], np.arange(groups + 1)), e.masks[by], e.lengths[by]))
    norms = [norm(e, np.repeat(np.arange(groups), np.diff(e.bounds)), groups) for e in sides]
    return Paths(common_bounds, masks, first, second, np.searchsorted(pair_of, np.arange(n + 1)), under, *sides, *norms)
