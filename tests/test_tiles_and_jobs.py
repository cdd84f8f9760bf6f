"""Distances by tiles, projections, orders and jobs against plain versions."""

import itertools
import math

import numpy as np
import plain_geodesic as PG
import plain_likelihood as PL
import pytest
from pyspark.sql import functions as F

from dendrolake.functions import likelihood as L
from dendrolake.functions import newick as N
from dendrolake.jobs import workflows as W
from dendrolake.operators import geodesics, landscape, likelihoods, order, pairs, sampling, trees

RNG = np.random.default_rng(77)


def tree(n, keep=1.0, rng=RNG):
    nodes, splits = [1 << t for t in range(n)], []
    while len(nodes) > 2:
        a, b = (nodes.pop(int(rng.integers(len(nodes)))) for _ in range(2))
        nodes.append(a | b)
        if rng.random() < keep:
            splits.append((a | b, float(rng.uniform(0.1, 1))))
    return splits, {t: float(rng.uniform(0.1, 1)) for t in range(n)}


def frame(spark, made, taxa, sample=lambda k: 0):
    rows = [(sample(k), k, [{"split": N.words(m, taxa), "size": m.bit_count(), "length": x} for m, x in s], [{"taxon_id": t, "length": x} for t, x in sorted(v.items())]) for k, (s, v) in enumerate(made)]
    return spark.createDataFrame(rows, trees.PARSED)


def plain_rf(a, b, taxa, rooted=False):
    full, out = (1 << taxa) - 1, []
    for splits, leaves in (a, b):
        d = {}
        for m, x in [*splits, *((1 << t, x) for t, x in leaves.items())]:
            m = full - m if m & 1 and not rooted else m
            d[m] = d.get(m, 0) + x
        out.append(d)
    x, y = out
    trivial = lambda m: m.bit_count() in ((1,) if rooted else (1, taxa - 1))
    rf = sum(not trivial(m) for m in x.keys() ^ y.keys())
    return rf, sum(abs(x.get(m, 0) - y.get(m, 0)) for m in x.keys() | y.keys())


def plain_distance(a, b):
    common, found = PG.geodesic(a[0], b[0])
    square = sum((a[1][k] - b[1][k]) ** 2 for k in a[1]) + sum((x - y) ** 2 for _, x, y in common)
    return math.sqrt(square + sum((PG.norm(x) + PG.norm(y)) ** 2 for _, x, y in found))


def plain_kc(t, taxa, c):
    splits, leaves = t
    m, big = [], []
    for a, b in itertools.combinations(range(taxa), 2):
        above = [x for s, x in splits if s >> a & 1 and s >> b & 1]
        m.append(float(len(above)))
        big.append(sum(above))
    m, big = np.array(m + [1.0] * taxa), np.array(big + [leaves[k] for k in range(taxa)])
    return (1 - c) * m / m.sum() + c * big / big.sum()


@pytest.mark.parametrize("taxa", [5, 9, 70])
@pytest.mark.parametrize("block", [3, 100])
def test_distances_by_tiles(spark, taxa, block):
    """Samples of one block and of several, binary trees and others, masks of one word and of two."""
    rng = np.random.default_rng(taxa)
    made = [tree(taxa, rng.choice([1.0, 0.6]), rng) for _ in range(17)]
    made[5] = made[2]
    sample = lambda k: 1 if k > 12 else 0
    table = frame(spark, made, taxa, sample).repartition(3)
    want = [(i, j) for i, j in itertools.combinations(range(17), 2) if sample(i) == sample(j)]
    for rooted in (False, True):
        got = {(r.i, r.j): (r.rf, r.wrf) for r in pairs.rf_distances(table, taxa, rooted, block).collect()}
        assert sorted(got) == want
        for i, j in want:
            rf, wrf = plain_rf(made[i], made[j], taxa, rooted)
            assert got[i, j][0] == rf and got[i, j][1] == pytest.approx(wrf)
    geo = {(r.i, r.j): r.d for r in geodesics.distances(table, taxa, block).collect()}
    kc = {(r.i, r.j): r.d for r in pairs.kc_distances(table, taxa, 0.3, block).collect()}
    assert sorted(geo) == sorted(kc) == want and geo[2, 5] == kc[2, 5] == 0
    for i, j in want:
        assert geo[i, j] == pytest.approx(plain_distance(made[i], made[j]))
        assert kc[i, j] == pytest.approx(np.linalg.norm(plain_kc(made[i], taxa, 0.3) - plain_kc(made[j], taxa, 0.3)))


def test_only_pairs_of_new_trees(spark):
    made = [tree(6) for _ in range(12)]
    table = frame(spark, made, 6).withColumn("fresh", F.col("tree_id") >= 9)
    for block in (2, 50):
        got = {(r.i, r.j) for r in pairs.rf_distances(table, 6, block=block, fresh="fresh").collect()}
        assert got == {(i, j) for i, j in itertools.combinations(range(12), 2) if j >= 9}


def test_trees_that_are_null_are_of_no_pair(spark):
    good = frame(spark, [tree(5) for _ in range(4)], 5)
    bad = spark.createDataFrame([(0, 90, None, None)], trees.PARSED)
    assert pairs.rf_distances(good.union(bad), 5).count() == geodesics.distances(good.union(bad), 5).count() == 6


def test_contributions_by_columns(spark):
    made = [tree(7, k) for k in (1, 0.5, 0.8, 1, 0.3)] + [tree(7)]
    made.append(([(m, x / 2) for m, x in made[0][0][:3]], made[0][1]))
    for r in geodesics.contributions(pairs.tree_pairs(frame(spark, made, 7))).collect():
        common, _ = PG.geodesic(made[r.i][0], made[r.j][0])
        assert r.common_square == pytest.approx(sum((x - y) ** 2 for _, x, y in common))
        assert r.leaf_square == pytest.approx(sum((made[r.i][1][t] - made[r.j][1][t]) ** 2 for t in range(7)))


def test_edges_that_cross_as_bits(spark):
    made = [tree(70) for _ in range(3)]
    for r in pairs.incidence(pairs.tree_pairs(frame(spark, made, 70))).collect():
        a, others = N.joined(r.a), sorted(m for m, _ in made[r.j][0])
        assert N.joined(r.crossed) == sum(1 << k for k, m in enumerate(others) if PG.crosses(a, m))


def test_projection_against_a_grid_of_positions(spark):
    made = [tree(6, rng=np.random.default_rng(k)) for k in range(9)]
    wanted = [(0, t, i, j) for t, i, j in itertools.permutations(range(9), 3) if (t + 3 * i + j) % 5 == 0] + [(0, 4, 4, 7), (0, 7, 4, 7), (0, 99, 1, 2)]
    table = frame(spark, made, 6)
    got = W.project(table, spark.createDataFrame(wanted, "sample long, tree_id long, i long, j long"), 6).collect()
    assert sorted((r.tree_id, r.i, r.j) for r in got) == sorted(w[1:] for w in wanted if w[1] != 99)
    geo = geodesics.geodesics(pairs.tree_pairs(table), 6).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(50)))).withColumn("at", F.col("at") / 50)
    grid = {(r.i, r.j, round(50 * r.at)): trees.unpacked(r) for r in geodesics.tree_at(geo, "at").collect()}
    for r in got:
        on = [grid[r.i, r.j, k] if r.i < r.j else grid[r.j, r.i, 50 - k] for k in range(51)]
        far = [plain_distance(made[r.tree_id], t) for t in on]
        k = int(np.argmin(far))
        assert r.d <= min(far) + 1e-6 and r.d >= min(far) - plain_distance(on[max(k - 1, 0)], on[min(k + 1, 50)])
        assert 0 <= r.at <= 1 and abs(r.at - k / 50) <= 0.25
    ends = {(r.tree_id, r.i, r.j): (r.at, r.d) for r in got}
    assert ends[4, 4, 7] == (0.0, pytest.approx(0, abs=1e-6)) and ends[7, 4, 7] == (1.0, pytest.approx(0, abs=1e-6))


def test_classes_of_a_hot_topology(spark):
    one, two, three = tree(6, rng=np.random.default_rng(1)), tree(6, rng=np.random.default_rng(2)), ([], tree(6)[1])
    made = [(one if k % 3 else two if k % 2 else three) for k in range(60)]
    got = {r.tree_id: (r.first, r.n_same) for r in trees.topology_classes(frame(spark, made, 6)).collect()}
    kind = lambda k: 1 if k % 3 else 2 if k % 2 else 3
    first = {1: 1, 2: 3, 3: 0}
    assert got == {k: (first[kind(k)], sum(kind(j) == kind(k) for j in range(60)) - 1) for k in range(60)}
    groups = trees.topology_groups(frame(spark, [([(0b11, 1e-6), (0b1100, 0.5)], one[1]), ([(0b1100, 0.2)], one[1]), one], 6)).collect()
    assert {(r.first, r.n_trees, r.n_edges) for r in groups} == {(0, 2, 1), (2, 1, 4)}


def test_places_in_a_sample_of_any_size(spark):
    rows = [(0 if k < 900 else k % 5, k, float(RNG.integers(0, 40))) for k in range(1000)]
    table = spark.createDataFrame(rows, "sample long, tree_id long, lnl double").repartition(4)
    got = {(r.sample, r.tree_id): r.place for r in likelihoods.ranked(table).collect()}
    for s in range(5):
        own = sorted((x, t) for q, t, x in rows if q == s)
        assert [got[s, t] for _, t in own] == list(range(len(own)))
    sized = order.placed_in_sample(table, ["tree_id"], "at", "n").groupBy("sample").agg(F.max("at").alias("a"), F.first("n").alias("n")).collect()
    assert all(r.a == r.n - 1 for r in sized) and sum(r.n for r in sized) == 1000
    drawn = sampling.resample(table, 5).toPandas()
    assert (drawn.groupby("sample").size() == spark.createDataFrame(rows, table.schema).toPandas().groupby("sample").size()).all()
    assert set(zip(drawn["sample"], drawn["tree_id"])) <= {(s, t) for s, t, _ in rows}
    assert drawn["tree_id"].nunique() < 800  # with replacement


def _cells(spark, bases):
    return spark.createDataFrame([(s, t, "ACGT"[bases[t, s]]) for t in range(len(bases)) for s in range(bases.shape[1])], "site long, taxon int, letter string")


def _lnl(t, bases):
    nodes = PL.shape(*t)
    known = {**dict(t[0]), **{1 << k: x for k, x in t[1].items()}}
    return PL.log_likelihood(nodes, np.array([known.get(m, 0.0) for m, _ in nodes]), L.conditionals(bases), np.ones(bases.shape[1]), L.Model())


def _corners(points):
    """Ids of the corners of the hull of 2-D points."""
    out = []
    for k, p in points.items():
        angles = sorted(math.atan2(q[1] - p[1], q[0] - p[0]) for j, q in points.items() if j != k)
        gaps = [b - a for a, b in zip(angles, [*angles[1:], angles[0] + 2 * math.pi])]
        if max(gaps) > math.pi + 1e-9:
            out.append(k)
    return set(out)


def _map(made, taxa):
    n = len(made)
    d = np.array([[plain_rf(a, b, taxa)[1] for b in made] for a in made])
    j = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * j @ (d * d) @ j)
    return vectors[:, :-3:-1] * np.sqrt(np.maximum(values[:-3:-1], 0))


def test_boundary_and_explore_against_a_plain_loop(spark):
    """Two samples, kept apart: corners of the map, path trees between them, the best of each topology bettered, the pool's map."""
    taxa, labels = 5, [f"T{k}" for k in range(5)]
    rng = np.random.default_rng(13)
    made = [tree(taxa, rng=rng) for _ in range(12)]
    bases = rng.integers(0, 4, (taxa, 30))
    table = frame(spark, made, taxa, lambda k: k % 2)
    start = {}
    for s in (0, 1):
        own = [k for k in range(12) if k % 2 == s]
        start[s] = _corners(dict(zip(own, _map([made[k] for k in own], taxa).tolist())))
    got = W.boundary(table, taxa).collect()
    assert {(r.sample, r.tree_id) for r in got} == {(s, k) for s in (0, 1) for k in start[s]}

    external = frame(spark, [tree(taxa, rng=rng), tree(taxa, rng=rng)], taxa, lambda k: k).withColumn("tree_id", -1 - F.col("tree_id"))
    pool = W.explore(table, _cells(spark, bases), labels, external, n=4, most=6).toPandas()
    for s in (0, 1):
        own = pool[pool["sample"] == s]
        count = own.groupby("role").size()
        n = len(start[s])
        assert set(own.loc[own["role"] == "start", "tree_id"]) == start[s]
        assert count["path"] == n * (n - 1) // 2 * 2 and count["external"] == 1
        for r in own[own["role"] == "start"].itertuples():
            assert r.lnl == pytest.approx(_lnl(made[r.tree_id], bases))
        # the best six of start and path trees hold the optimised ones' starting points
        assert 1 <= count["optimised"] <= 6 and own.loc[own["role"] == "optimised", "lnl"].max() >= own.loc[own["role"] != "optimised", "lnl"].max() - 1e-9
        assert own["tree_id"].is_unique and abs(own["x"].mean()) < 1e-6 and abs(own["y"].mean()) < 1e-6 and own["x"].std() > 0
        # path trees are at a third and two thirds of each geodesic, so their best is no worse than what a plain loop finds there
        best = -np.inf
        for i, j in itertools.combinations(sorted(start[s]), 2):
            common, found = PG.geodesic(made[i][0], made[j][0])
            for at in (1 / 3, 2 / 3):
                edges = [(m, (1 - at) * x + at * y) for m, x, y in common]
                for _, a, b in found:
                    here = (1 - at) * PG.norm(a) - at * PG.norm(b)
                    edges += [(m, x * here / PG.norm(a)) for m, x in a] if here > 0 else [(m, -x * here / PG.norm(b)) for m, x in b]
                leaves = {t: (1 - at) * made[i][1][t] + at * made[j][1][t] for t in range(taxa)}
                best = max(best, _lnl(([e for e in edges if e[1] > 1e-10], leaves), bases))
        assert own.loc[own["role"] == "path", "lnl"].max() == pytest.approx(best, abs=1e-5)


def test_rounds_add_to_one_pool(spark):
    taxa, labels = 5, [f"T{k}" for k in range(5)]
    rng = np.random.default_rng(21)
    table = frame(spark, [tree(taxa, rng=rng) for _ in range(8)], taxa, lambda k: k % 2)
    bases = rng.integers(0, 4, (taxa, 20))
    out = W.iterate(table, _cells(spark, bases), labels, paths=[3], kept=[3], rounds=2).toPandas()
    assert set(out["round"]) == {0, 1, 2} and set(out.loc[out["round"] == 0, "role"]) == {"start"}
    assert set(out.loc[out["round"] > 0, "role"]) == {"path", "optimised"} and not out.duplicated(["sample", "tree_id"]).any()
    for s in (0, 1):
        own = out[out["sample"] == s]
        assert own["x"].notna().all() and abs(own["x"].mean()) < 1e-6
        better = own[own["role"] == "optimised"].groupby("round")["lnl"].max()
        assert better[1] >= own.loc[own["round"] == 0, "lnl"].max() - 1e-9


def test_landscape_and_surface(spark):
    """The surface meets lnl at the points, and the landscape's figures are those of its parts."""
    rng = np.random.default_rng(5)
    points = rng.standard_normal((12, 2))
    coords = spark.createDataFrame([(0, k, p.tolist()) for k, p in enumerate(points)], "sample long, tree_id long, x array<double>")
    lnl = np.sin(points[:, 0]) + points[:, 1]
    values = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(lnl)], "sample long, tree_id long, lnl double")
    cells = landscape.surface(coords, values, cells=41).toPandas()
    r = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    phi = np.where(r > 0, r * r * np.log(np.where(r > 0, r, 1)), 0)
    w = np.linalg.lstsq(phi - 1e-10 * np.eye(12), lnl, rcond=None)[0]
    assert phi @ w == pytest.approx(lnl, abs=1e-4)
    inner = cells[cells["z"].notna()]
    assert 0 < len(inner) < len(cells) == 41 * 41
    for c in inner.itertuples():
        far = np.sqrt((c.px - points[:, 0]) ** 2 + (c.py - points[:, 1]) ** 2)
        assert c.z == pytest.approx(float(np.where(far > 0, far**2 * np.log(np.where(far > 0, far, 1)), 0) @ w))
    made = [tree(6, rng=rng) for _ in range(9)]
    scored = frame(spark, made, 6).withColumn("lnl", -F.col("tree_id").cast("double"))
    row = W.landscape(scored, 6).first()
    flat = _map(made, 6)
    d = np.array([[plain_rf(a, b, 6)[1] for b in made] for a in made])
    e = np.sqrt(((flat[:, None] - flat[None]) ** 2).sum(axis=2))
    assert row.n == 81 and row.pearson == pytest.approx(np.corrcoef(d.ravel(), e.ravel())[0, 1])
    assert row.corners == len(_corners(dict(enumerate(flat.tolist())))) and row.inside > 0


@pytest.mark.parametrize("block", [3, 100])
def test_trees_between_are_those_at_positions(spark, block):
    taxa = 8
    made = [tree(taxa, k) for k in (1, 0.6, 1, 0.3, 1, 1, 0.8)] + [([], tree(taxa)[1])]
    table = frame(spark, made, taxa).repartition(2)
    at = [0.0, 0.25, 0.6, 1.0]
    geo = geodesics.geodesics(pairs.tree_pairs(table), taxa).withColumn("at", F.explode(F.array(*map(F.lit, at))))
    key = lambda r: (r.i, r.j, round(r.at, 6))
    want = {key(r): trees.unpacked(r) for r in geodesics.tree_at(geo, "at").collect()}
    got = {key(r): trees.unpacked(r) for r in geodesics.trees_between(table, taxa, at, block).collect()}
    assert got.keys() == want.keys() and len(got) == 28 * 4
    for k, (splits, leaves) in got.items():
        assert dict(splits) == pytest.approx(dict(want[k][0]), abs=1e-9) and leaves == pytest.approx(want[k][1], abs=1e-9)
    assert geodesics.trees_between(table, taxa, []).count() == 0
    for r in W.path_trees(table, 4, taxa).collect():
        assert len(r.splits) == taxa - 2


def test_same_topology_gives_every_pair(spark, tmp_path):
    """The query's rows are those of its SQL: all pairs of a sample's trees with the same splits."""
    duckdb = pytest.importorskip("duckdb")
    from dendrolake import queries

    rows = [(k, k % 3, 1000.0 + k % 4) for k in range(0, 2200, 5)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in queries.QUERIES["same_topology"](spark, str(tmp_path)).select("sample", "i", "j").collect()}
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == set(connection.sql(queries.ORACLE_SQL["same_topology"]).fetchall()) and len(got) > 400


def test_patterns_are_not_copied_for_every_few_trees():
    """Groups stay few as trees become many, but are of a few trees each while those are few."""
    assert likelihoods._groups(100, 4, 256) == 25 and likelihoods._groups(0, 4, 256) == 1
    assert likelihoods._groups(400_000, 4, 256) == likelihoods.GROUPS
    assert likelihoods._groups(54_000_000, 256, likelihoods.MOST_TREES) <= 54_000_000 // 4000
    assert likelihoods._groups(10_000_000, 4, 256) == -(-10_000_000 // 256)


def test_projection_moves_each_tree_once(spark, monkeypatch):
    """Rows of small samples are met with their trees in one task, those of larger ones joined; both give the same, and rows of
    trees that a sample lacks are left out."""
    random = np.random.default_rng(5)
    labels = [f"t{k}" for k in range(5)]
    texts = []
    for k in range(14):
        a, b, c, d, e = random.permutation(labels)
        x = np.round(random.random(8) + 0.1, 3)
        texts.append((k // 7, k, f"((({a}:{x[0]},{b}:{x[1]}):{x[2]},{c}:{x[3]}):{x[4]},({d}:{x[5]},{e}:{x[6]}):{x[7]});"))
    table = trees.parse_newick(spark.createDataFrame(texts, "sample long, tree_id long, newick string"), labels)
    rows = [(s, 7 * s + t, 7 * s + i, 7 * s + (i + 1) % 7) for s in range(2) for t in range(7) for i in range(7)]
    wanted = spark.createDataFrame([*rows, (0, 99, 0, 1), (1, 7, 8, 3), (5, 1, 2, 3)], "sample long, tree_id long, i long, j long")
    found = lambda: {tuple(r)[:4]: tuple(r)[4:] for r in W.project(table, wanted, 5).collect()}
    once = found()
    assert set(once) == set(rows)
    plan = W.project(table, wanted, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    monkeypatch.setattr(pairs, "BLOCK", 3)
    joined = found()
    assert set(joined) == set(rows) and all(joined[k] == pytest.approx(once[k], abs=1e-5) for k in rows)
