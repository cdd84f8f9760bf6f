"""Goldens, brute force and properties of the tree operators."""

import itertools
import math

import numpy as np
import plain_geodesic as G
import plain_likelihood as P
import pytest

from dendrolake.functions import likelihood as L
from dendrolake.functions import newick as N
from dendrolake.functions.geodesic import Edges
from dendrolake.operators import geodesics, landscape, likelihoods, pairs, sampling, trees

LABELS = [f"T{k}" for k in range(8)]
BITS = {x: k for k, x in enumerate(LABELS)}


def test_newick_round_trip_and_checks():
    text = "((T0:0.1,T1:0.2):0.3,(T2:0.4,(T3:0.5,T4:0.0):0.0):0.7);"
    splits, leaves = N.parse(text, BITS, keep_zero=True)
    assert (0b11, 0.3) in splits and (0b11000, 0.0) in splits and leaves[4] == 0.0
    assert (0b11000, 0.0) not in N.parse(text, BITS)[0]
    assert N.parse(N.render(splits, leaves, LABELS), BITS, True) == (sorted(splits, key=lambda s: (s[0].bit_count(), s[0])), leaves) or set(
        N.parse(N.render(splits, leaves, LABELS), BITS, True)[0]
    ) == set(splits)
    assert N.check(text) == "ok"
    assert N.check("((T0:1):1,T1:1);") == "no comma"
    assert N.check("((T0:1,T1:1):1;") == "unbalanced"
    assert N.check("((T0:1,T1:1)x1,T2:1);") == "no length"
    assert N.check(None) == N.check("") == "no tree"


def test_masks_beyond_one_word():
    names = [f"t{k:03d}" for k in range(150)]
    mask = 1 << 149 | 1 << 62 | 1
    assert N.joined(N.words(mask, 150)) == mask
    text = "(" + ",".join(f"{x}:1" for x in names[:100]) + ",(" + ",".join(f"{x}:1" for x in names[100:]) + "):2);"
    (split, length), = N.parse(text, {x: k for k, x in enumerate(names)})[0]
    assert split == sum(1 << k for k in range(100, 150)) and length == 2


def test_resolve_makes_binary_and_compatible_trees():
    splits, leaves = N.parse("((T0:1,T1:1,T2:1,T3:1):1,T4:1,T5:1,(T6:1,T7:1):1);", BITS)
    full = N.resolve(splits, leaves)
    assert len({m for m, _ in full}) == len(full) == 6
    assert not any(G.crosses(a, b) for (a, _), (b, _) in itertools.combinations(full, 2))
    assert sum(x for _, x in full) == 2


def _distance(a, b, la, lb):
    common, found = G.geodesic(a, b)
    return math.sqrt(sum((la[k] - lb[k]) ** 2 for k in la) + sum((x - y) ** 2 for _, x, y in common) + sum((G.norm(x) + G.norm(y)) ** 2 for _, x, y in found))


def _random_tree(rng, n=7):
    nodes = [1 << t for t in range(n)]
    splits = []
    while len(nodes) > 2:
        a, b = (nodes.pop(rng.integers(len(nodes))) for _ in range(2))
        nodes.append(a | b)
        splits.append((a | b, float(rng.uniform(0.1, 1))))
    return splits, {t: float(rng.uniform(0.1, 1)) for t in range(n)}


def _ordered_partitions(items, k):
    for assign in itertools.product(range(k), repeat=len(items)):
        if len(set(assign)) == k:
            yield [[x for x, a in zip(items, assign) if a == g] for g in range(k)]


def _brute(a, b):
    """Least length over all ordered partitions that give a proper path."""
    best = (G.norm(a) + G.norm(b)) ** 2
    for k in range(2, min(len(a), len(b)) + 1):
        for pa in _ordered_partitions(a, k):
            for pb in _ordered_partitions(b, k):
                if any(G.crosses(x, y) for i in range(k) for j in range(i) for x, _ in pa[i] for y, _ in pb[j]):
                    continue
                r = [G.norm(x) / G.norm(y) for x, y in zip(pa, pb)]
                if all(p <= q + 1e-12 for p, q in zip(r, r[1:])):
                    best = min(best, sum((G.norm(x) + G.norm(y)) ** 2 for x, y in zip(pa, pb)))
    return best


def test_geodesic_against_brute_force_and_metric_axioms():
    rng = np.random.default_rng(1)
    made = [_random_tree(rng) for _ in range(10)]
    for (a, la), (b, lb) in itertools.combinations(made, 2):
        d = _distance(a, b, la, lb)
        assert d == pytest.approx(_distance(b, a, lb, la))
        _, parts = G.decompose(a, b)
        for p, q in parts.values():
            if len(p) <= 3 and len(q) <= 3:
                assert sum((G.norm(x) + G.norm(y)) ** 2 for x, y in G.ratios(p, q)) == pytest.approx(_brute(p, q))
    for a, la in made:
        assert _distance(a, a, la, la) == 0
    ds = {(i, j): _distance(*made[i][:1], *made[j][:1], made[i][1], made[j][1]) for i in range(10) for j in range(10)}
    for i, j, k in itertools.permutations(range(10), 3):
        assert ds[i, k] <= ds[i, j] + ds[j, k] + 1e-9


def test_published_distance_of_a_seven_leaf_pair():
    """Ratios {0,2}/{1,2}, {4}/{4}, {3}/{3} and common and leaf parts give 2.84423."""
    parts = 0.64 + 0.25 + (0.99765 + 0.88284) ** 2 + 1.53**2 + 1.15**2
    assert math.sqrt(parts) == pytest.approx(2.84423, abs=1e-4)


def _frame(spark, made):
    rows = [(0, k, [{"split": [m], "size": m.bit_count(), "length": x} for m, x in s], [{"taxon_id": t, "length": x} for t, x in sorted(v.items())]) for k, (s, v) in enumerate(made)]
    return spark.createDataFrame(rows, trees.PARSED)


def test_points_on_a_geodesic_divide_it(spark):
    rng = np.random.default_rng(2)
    made = [_random_tree(rng) for _ in range(4)]
    g = geodesics.geodesics(pairs.tree_pairs(_frame(spark, made)), 7)
    from pyspark.sql import functions as F

    at = geodesics.tree_at(g.withColumn("at", F.explode(F.array(F.lit(0.0), F.lit(0.3), F.lit(1.0)))), "at").withColumn("d", geodesics.distance())
    for row in at.collect():
        splits, leaves = trees.unpacked(row)
        a, la = made[row.i]
        assert _distance(a, splits, la, leaves) == pytest.approx(row.at * row.d, abs=1e-6)


def _shape(splits, leaves, taxa):
    lengths = np.array([[leaves.get(t, np.nan) for t in range(taxa)]])
    masks = np.array([N.words(m, taxa) for m, _ in splits], np.int64).reshape(len(splits), -1)
    return L.shapes(Edges(np.array([0, len(splits)]), masks, np.array([x for _, x in splits])), lengths)


def test_likelihood_against_sum_over_ancestors():
    splits, leaves = [(0b11, 0.3), (0b1100, 0.2)], {0: 0.1, 1: 0.4, 2: 0.25, 3: 0.6}
    model = L.Model()
    bases, weights = np.array([[0, 2, 1, 1], [0, 0, 0, 1]]).T.reshape(4, 2), np.array([1.0, 2.0])
    shape = _shape(splits, leaves, 4)
    (got,) = L.log_likelihoods(shape, bases, weights, model)
    p = {m: model.transition(x) for m, x in {**dict(splits), **{1 << t: x for t, x in leaves.items()}}.items()}
    total = 0.0
    for s, weight in ((0, 1.0), (1, 2.0)):
        site = 0.0
        for r, u, v in itertools.product(range(4), repeat=3):
            site += 0.25 * p[0b11][r, u] * p[0b1100][r, v] * p[1][u, bases[0, s]] * p[2][u, bases[1, s]] * p[4][v, bases[2, s]] * p[8][v, bases[3, s]]
        total += weight * math.log(site)
    assert got == pytest.approx(total)
    tree = L.Tree(shape, [bases], [weights], model)
    for better in (tree.newton, tree.nelder_mead):
        x = better()
        assert tree.log_likelihood(x) >= got - 1e-9 and (x >= 0).all()


def _alignment(rng, splits, leaves, sites, model):
    """Letters that evolved along the tree, some unknown."""
    nodes = P.shape(splits, leaves)
    known = {**dict(splits), **{1 << t: x for t, x in leaves.items()}}
    letters = {}
    for k in range(len(nodes) - 1, -1, -1):
        m, parent = nodes[k]
        letters[k] = rng.integers(0, 4, sites) if parent < 0 else (model.transition(known[m])[letters[parent]].cumsum(axis=1) > rng.random((sites, 1))).argmax(axis=1)
    bases = np.array([letters[k] for k, (m, _) in sorted(enumerate(nodes), key=lambda x: x[1][0]) if m.bit_count() == 1])
    return np.where(rng.random(bases.shape) < 0.05, -1, bases)


def _plain_lnl(splits, leaves, bases, weights, model):
    nodes = P.shape(splits, leaves)
    known = {**dict(splits), **{1 << t: x for t, x in leaves.items()}}
    return P.log_likelihood(nodes, np.array([known.get(m, 0.0) for m, _ in nodes]), L.conditionals(bases), weights, model)


GENERAL = np.array([[-1.1, 0.5, 0.4, 0.2], [0.3, -0.9, 0.2, 0.4], [0.6, 0.3, -1.2, 0.3], [0.2, 0.5, 0.1, -0.8]])


@pytest.mark.parametrize("taxa", [4, 9, 70, 182])
def test_likelihoods_of_many_trees_at_once(taxa):
    rng = np.random.default_rng(taxa)
    made = [_random_tree(rng, taxa) for _ in range(5)]
    made.append(([e for e in made[0][0] if rng.random() < 0.6], made[0][1]))  # nodes of more than two children
    made.append(([], made[1][1]))
    for model in (L.Model(), L.Model(GENERAL, np.array([0.3, 0.2, 0.1, 0.4]))):
        bases, weights = _alignment(rng, *made[0], 60, model), rng.integers(1, 5, 60).astype(float)
        sizes = [len(s) for s, _ in made]
        masks = np.array([N.words(m, taxa) for s, _ in made for m, _ in s], np.int64)
        edges = Edges(np.concatenate([[0], np.cumsum(sizes)]), masks, np.array([x for s, _ in made for _, x in s]))
        leaves = np.array([[v[t] for t in range(taxa)] for _, v in made])
        got = L.log_likelihoods(L.shapes(edges, leaves), bases, weights, model)
        assert got == pytest.approx([_plain_lnl(s, v, bases, weights, model) for s, v in made], rel=1e-10)


def test_a_branch_is_bettered_by_what_lies_around_it():
    """A Newton step's values are those of the whole tree, and a pass comes close to where a search over each branch ends."""
    rng, model = np.random.default_rng(8), L.Model(GENERAL, np.array([0.3, 0.2, 0.1, 0.4]))
    splits, leaves = _random_tree(rng, 9)
    bases, weights = _alignment(rng, splits, leaves, 300, model), np.ones(300)
    off = [(m, x * rng.uniform(0.4, 2.5)) for m, x in splits], {t: x * rng.uniform(0.4, 2.5) for t, x in leaves.items()}
    shape = _shape(*off, 9)
    halves = [bases[:, :150], bases[:, 150:]], [weights[:150], weights[150:]]
    tree = L.Tree(shape, *halves, model)
    before, x = tree.log_likelihood(shape.lengths), tree.newton()
    assert tree.log_likelihood(x) > before + 1 and (x >= 0).all()

    class Watched(L.Tree):
        def _branch(self, t, ends, least, h):
            p = model.transitions(np.array([t, 2 * t])).reshape(-1, 16).T
            moves.append((t, float(np.subtract(*sum(w @ np.log(e @ p) for e, w in zip(ends, self.weights))))))
            return t

    moves = []
    Watched(shape, *halves, model).newton()
    assert len(moves) == len(shape.lengths) - 1
    for t, move in moves:
        y = shape.lengths.copy()
        y[np.flatnonzero(y == t)] *= 2
        assert move == pytest.approx(before - tree.log_likelihood(y))


def _cells(spark, bases):
    rows = [(s, t, "ACGT-"[bases[t, s]]) for t in range(len(bases)) for s in range(bases.shape[1])]
    return spark.createDataFrame(rows, "site long, taxon int, letter string")


def test_likelihoods_and_branch_lengths_in_spark(spark):
    """Blocks of patterns and groups of trees of any size give the sums of the whole, optimised trees what is said of them."""
    rng, model = np.random.default_rng(9), L.Model()
    made = [_random_tree(rng, 7) for _ in range(9)]
    bases = _alignment(rng, *made[0], 80, model)
    patterns = likelihoods.patterns(_cells(spark, bases))
    want = {k: _plain_lnl(s, v, bases, np.ones(80), model) for k, (s, v) in enumerate(made)}
    frame = _frame(spark, made)
    for block, together in ((20_000, 4096), (7, 2)):
        got = {r.tree_id: r.lnl for r in likelihoods.log_likelihoods(frame, patterns, block=block, together=together).collect()}
        assert got == pytest.approx(want)
    for method in ("newton", "nelder_mead"):
        for r in likelihoods.optimize(frame, patterns, 7, method, together=2).collect():
            splits, leaves = trees.unpacked(r)
            assert {m for m, _ in splits} == {m for m, _ in made[r.tree_id][0]}
            assert r.lnl_before == pytest.approx(want[r.tree_id]) and r.lnl >= r.lnl_before
            assert r.lnl == pytest.approx(_plain_lnl(splits, leaves, bases, np.ones(80), model))
    none = likelihoods.patterns(_cells(spark, bases).where("site < 0"))
    assert {r.lnl for r in likelihoods.log_likelihoods(frame, none).collect()} == {0.0}
    assert likelihoods.log_likelihoods(frame.where("tree_id < 0"), patterns).count() == 0


def test_kendall_swaps_and_hull():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 30):
        a = rng.integers(0, 6, n)
        assert landscape._swaps(np.unique(a, return_inverse=True)[1]) == sum(x > y for x, y in itertools.combinations(a, 2))
    p = rng.standard_normal((40, 2))
    ring = landscape._chain(p)
    for i, j in zip(ring, ring[1:] + ring[:1]):
        side = (p[j, 0] - p[i, 0]) * (p[:, 1] - p[i, 1]) - (p[j, 1] - p[i, 1]) * (p[:, 0] - p[i, 0])
        assert (side >= -1e-12).all()


def test_empty_tables(spark):
    none = _frame(spark, [])
    assert pairs.rf_distances(none, 8).count() == 0
    assert geodesics.geodesics(pairs.tree_pairs(none), 8).count() == 0
    assert trees.print_newick(none, LABELS).count() == 0


def test_weighted_distance_merges_root_edges(spark):
    made = [N.parse("((T0:1,T1:1):1,(T2:1,T3:1):2);", BITS), N.parse("((T0:1,T1:1):1,T2:1,T3:1);", BITS)]
    row = pairs.rf_distances(_frame(spark, made), 4).first()
    assert (row.rf, row.wrf) == (0, 2.0)
    assert pairs.rf_distances(_frame(spark, made), 4, rooted=True).first().rf == 1
