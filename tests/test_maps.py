"""Blocks of pairs, trees of many taxa, bad lines, order of lines, and maps against plain versions."""

import itertools
import math

import numpy as np
import plain_geodesic as G
import pytest
from pyspark.sql import functions as F

from dendrolake.functions import newick as N
from dendrolake.jobs import workflows
from dendrolake.operators import geodesics, landscape, likelihoods, pairs, samples, sampling, trees
from dendrolake.sources import files, store

RNG = np.random.default_rng(21)


def _tree(n, rng=RNG):
    nodes, splits = [1 << t for t in range(n)], []
    while len(nodes) > 2:
        a, b = (nodes.pop(rng.integers(len(nodes))) for _ in range(2))
        nodes.append(a | b)
        splits.append((a | b, float(rng.uniform(0.1, 1))))
    return splits, {t: float(rng.uniform(0.1, 1)) for t in range(n)}


def _frame(spark, made, taxa, sample=lambda k: 0):
    rows = [(sample(k), k, [{"split": N.words(m, taxa), "size": m.bit_count(), "length": x} for m, x in s], [{"taxon_id": t, "length": x} for t, x in sorted(v.items())]) for k, (s, v) in enumerate(made)]
    return spark.createDataFrame(rows, trees.PARSED)


def _plain_rf(a, b, la, lb, taxa):
    whole = (1 << taxa) - 1

    def sides(splits, leaves):
        inner, own = {}, dict(leaves)
        for m, x in splits:
            m = whole ^ m if m & 1 else m
            if m.bit_count() == 1:
                own[m.bit_length() - 1] += x
            elif m == whole - 1:
                own[0] += x
            else:
                inner[m] = inner.get(m, 0.0) + x
        return inner, own

    (x, u), (y, v) = sides(a, la), sides(b, lb)
    rf = len(x.keys() ^ y.keys())
    return rf, sum(abs(x.get(m, 0) - y.get(m, 0)) for m in x.keys() | y.keys()) + sum(abs(u[t] - v[t]) for t in u)


@pytest.mark.parametrize("block", [3, 512])
def test_all_pairs_of_one_sample_in_blocks(spark, block):
    made = [_tree(7) for _ in range(17)]
    frame = _frame(spark, made, 7)
    got = {(r.i, r.j): (r.rf, r.wrf) for r in pairs.rf_distances(frame, 7, block=block).collect()}
    assert set(got) == set(itertools.combinations(range(17), 2))
    for (i, j), (rf, wrf) in got.items():
        want = _plain_rf(made[i][0], made[j][0], made[i][1], made[j][1], 7)
        assert rf == want[0] and wrf == pytest.approx(want[1])
    found = pairs.tree_pairs(frame, block).collect()
    assert sorted((r.i, r.j) for r in found) == sorted(got)
    for r in found[:20]:
        assert [N.joined(s["split"]) for s in r.a_splits] == [m for m, _ in made[r.i][0]] and [N.joined(s["split"]) for s in r.b_splits] == [m for m, _ in made[r.j][0]]
    several = _frame(spark, made, 7, lambda k: k % 3)
    assert {(r.i, r.j) for r in pairs.tree_pairs(several, block).collect()} == {(i, j) for i, j in got if i % 3 == j % 3}


def test_trees_of_182_taxa(spark):
    """As many taxa as the larger published alignment has: three words to a mask."""
    taxa = 182
    made = [_tree(taxa) for _ in range(4)]
    labels = [f"t{k:03d}" for k in range(taxa)]
    frame = _frame(spark, made, taxa)
    again = trees.parse_newick(trees.print_newick(frame, labels), labels)
    for r in again.collect():
        splits, leaves = trees.unpacked(r)
        assert r.error is None and dict(splits) == pytest.approx(dict(made[r.tree_id][0])) and leaves == pytest.approx(made[r.tree_id][1])
    for r in pairs.rf_distances(frame, taxa).collect():
        want = _plain_rf(made[r.i][0], made[r.j][0], made[r.i][1], made[r.j][1], taxa)
        assert r.rf == want[0] and r.wrf == pytest.approx(want[1])
    near = [made[0], ([(m, x * 1.5) for m, x in made[0][0]], made[0][1]), made[1]]
    frame = _frame(spark, near, taxa)
    for r in geodesics.geodesics(pairs.tree_pairs(frame), taxa).withColumn("d", geodesics.distance()).collect():
        common, found = G.geodesic(near[r.i][0], near[r.j][0])
        square = sum((near[r.i][1][t] - near[r.j][1][t]) ** 2 for t in range(taxa)) + sum((x - y) ** 2 for _, x, y in common)
        assert r.d == pytest.approx(math.sqrt(square + sum((G.norm(x) + G.norm(y)) ** 2 for _, x, y in found)))
        assert sorted(N.joined(s["part"]) for s in r.supports) == sorted(o for o, _, _ in found)
    wanted = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 2)], "sample long, tree_id long, i long, j long")
    for r in workflows.project(frame, wanted, taxa).collect():
        assert r.tree_id == 0 and (r.i, r.j) in {(0, 1), (1, 2)}
        assert r.d == pytest.approx(0, abs=1e-5) if r.i == 0 else r.d > 0
    v = pairs.kc_vectors(_frame(spark, [_tree(70)], 70), 70).first()
    assert len(v.m) == 70 * 71 // 2 and v.m[-70:] == [1.0] * 70


def test_kc_vectors_of_a_small_tree(spark):
    splits, leaves = [(0b11, 0.5), (0b111, 0.25)], {0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0}
    v = pairs.kc_vectors(_frame(spark, [(splits, leaves)], 4), 4).first()
    assert v.m == [2.0, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0]
    assert v.big_m == pytest.approx([0.75, 0.25, 0.0, 0.25, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0])


def test_bad_texts_give_rows_with_what_is_wrong(spark):
    texts = ["((a:1,b:1):1,c:1);", None, "", "a,b", "((a:1,b:1:1,c:1);", "((a:1,z:1):1,c:1);", "((a:x,b:1):1,c:1);", "(a:1,b:1)):1;"]
    frame = spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], "sample long, tree_id long, newick string")
    out = {r.tree_id: r for r in trees.parse_newick(frame, ["a", "b", "c"]).collect()}
    assert len(out) == len(texts) and out[0].error is None and len(out[0].leaves) == 3
    assert all(out[k].error and out[k].splits is None and out[k].leaves is None for k in range(1, len(texts)))
    assert out[5].error == "unknown label z"


def test_lines_are_numbered_by_file_and_line(spark, tmp_path):
    sizes = [40, 1, 300, 7]
    for k, n in enumerate(sizes):
        (tmp_path / f"part-{k}.txt").write_text("# top\n\n" + "".join(f"x = (a{k}_{j}:1,b:1);\n" for j in range(n)))
    out = {r.line_id: r.newick for r in files.read_newick(spark, f"file://{tmp_path}").collect()}
    assert [out[k] for k in range(sum(sizes))] == [f"(a{k}_{j}:1,b:1);" for k, n in enumerate(sizes) for j in range(n)]


def test_edits_and_duplicates(spark):
    made = [([(0b11, 1.0), (0b1100, 2.0), (0b11, 3.0)], {t: 1.0 for t in range(5)})]
    frame = _frame(spark, made, 5)
    (row,) = trees.duplicate_splits(frame).collect()
    assert (N.joined(row.split), row.n) == (0b11, 2)
    mask = lambda m: F.array(F.lit(m).cast("long"))
    new = F.array(F.struct(mask(0b1100).alias("split"), F.lit(2).alias("size"), F.lit(9.0).alias("length")), F.struct(mask(0b11100).alias("split"), F.lit(3).alias("size"), F.lit(5.0).alias("length")))
    splits, _ = trees.unpacked(trees.edit_splits(frame, F.array(mask(0b11)), new).first())
    assert splits == [(0b1100, 2.0), (0b11100, 5.0)]


def test_results_are_reloaded(spark, tmp_path):
    made = [_tree(5) for _ in range(6)]
    labels = list("abcde")
    scored = _frame(spark, made, 5, lambda k: k % 2).withColumn("lnl", -F.col("tree_id").cast("double"))
    path = f"file://{tmp_path}/results"
    workflows.write_results({"start": scored, "path": scored.where("tree_id > 2")}, labels, path)
    again = workflows.read_results(spark, path, labels, ["start", "path"])
    assert {r.tree_id: r.lnl for r in again["start"].collect()} == {k: -float(k) for k in range(6)} and again["path"].count() == 3
    for r in again["path"].collect():
        assert dict(trees.unpacked(r)[0]) == pytest.approx(dict(made[r.tree_id][0]))
    assert {r.sample: r.tree_id for r in spark.read.parquet(f"{path}/top").collect()} == {0: 0, 1: 1}


def _points(n):
    x = RNG.standard_normal((n, 3)) * [3, 1, 0.2]
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def _distances(spark, d, sample=0):
    n = len(d)
    return spark.createDataFrame([(sample, i, j, float(d[i, j])) for i, j in itertools.combinations(range(n), 2)], "sample long, i long, j long, d double")


@pytest.mark.parametrize("most", [5000, 4])
def test_coordinates_by_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(landscape, "MOST", most)
    d = _points(12)
    h = np.eye(12) - 1 / 12
    values, vectors = np.linalg.eigh(-0.5 * h @ (d * d) @ h)
    want = vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
    want *= np.sign(want[np.abs(want).argmax(axis=0), [0, 1]])
    got = {r.tree_id: r.x for r in landscape.coordinates(_distances(spark, d)).collect()}
    assert np.array([got[k] for k in range(12)]) == pytest.approx(want, abs=1e-6)


def test_large_samples_of_a_slow_spectrum(spark, monkeypatch):
    """60 points that spread alike in twenty directions, in blocks of about 13, beside a small sample: the residual is reached, and
    the coordinates are those of the whole matrix. With one round it is not, and the rows say so."""
    monkeypatch.setattr(landscape, "MOST", 20)
    monkeypatch.setattr(landscape, "PIECE", 13)
    x = np.random.default_rng(3).standard_normal((60, 20)) * np.linspace(1.15, 0.9, 20)
    d, small = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), _points(8)
    table = _distances(spark, d).union(_distances(spark, small, 1)).repartition(3)
    for sample, one in ((0, d), (1, small)):
        h = np.eye(len(one)) - 1 / len(one)
        values, vectors = np.linalg.eigh(-0.5 * h @ (one * one) @ h)
        want = vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
        want *= np.sign(want[np.abs(want).argmax(axis=0), [0, 1]])
        rows = landscape.coordinates(table).where(F.col("sample") == sample).collect()
        assert len(rows) == len(one) and all(r.residual <= landscape.TOLERANCE for r in rows)
        got = {r.tree_id: r.x for r in rows}
        assert np.array([got[k] for k in range(len(one))]) == pytest.approx(want, abs=1e-4)
    assert landscape.coordinates(table, rounds=1).agg(F.max("residual")).first()[0] > 1e-3


def _tau(x, y):
    s = lambda v: np.sign(v[:, None] - v[None])
    a, b = s(x), s(y)
    return (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())


def _mean_ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() - 1) / 2 for v in x])


@pytest.mark.parametrize("most", [5000, 2])
def test_validation_by_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(landscape, "MOST", most)
    monkeypatch.setattr(landscape, "_BLOCK", 7)
    n = 9
    d, e = np.round(_points(n), 1), np.round(_points(n), 0)
    row = landscape.validation(_distances(spark, d), _distances(spark, e)).first()
    x, y = d.ravel(), e.ravel()
    assert row.n == n * n and row.pearson == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert row.spearman == pytest.approx(np.corrcoef(_mean_ranks(x), _mean_ranks(y))[0, 1]) and row.kendall == pytest.approx(_tau(x, y))


def test_smooth_line_follows_the_points(spark):
    d = _points(25)
    e = 2 * d + 1
    e[3, 9] = 40.0  # a point far off, which the further passes give no weight
    out = landscape.shepard(_distances(spark, d), _distances(spark, e), every=3).toPandas()
    assert len(out) == 100
    good = out["e"] < 39
    assert np.abs(out["smooth"] - (2 * out["d"] + 1))[good].max() < 0.05
    order = sorted((d[i, j], e[i, j]) for i, j in itertools.combinations(range(25), 2))[::3]
    assert np.array(sorted(zip(out["d"], out["e"]))) == pytest.approx(np.array(order))


def test_several_blocks_of_patterns_add_up(spark):
    made = [_tree(5) for _ in range(4)]
    frame = _frame(spark, made, 5)
    cells = spark.createDataFrame([(s, t, "ACGT-"[int(RNG.integers(5))]) for s in range(60) for t in range(5)], "site int, taxon int, letter string")
    found = likelihoods.patterns(cells)
    one = {r.tree_id: r.lnl for r in likelihoods.log_likelihoods(frame, found).collect()}
    many = {r.tree_id: r.lnl for r in likelihoods.log_likelihoods(frame, found, block=7).collect()}
    assert one == pytest.approx(many) and len(one) == 4


def test_resampling_and_random_lengths(spark):
    frame = spark.createDataFrame([(s, 10 * s + k) for s in range(2) for k in range(5)], "sample long, tree_id long")
    drawn = sampling.resample(frame, 3, n=400).toPandas()
    assert drawn.groupby("sample")["draw"].nunique().tolist() == [400, 400] and drawn["tree_id"].nunique() == 10
    assert sampling.resample(frame, 3).count() == 10
    keys = frame.withColumn("total", F.lit(2.0))
    labels = list("abcdef")
    length = lambda made: [r.x for r in trees.parse_newick(made, labels, keep_zero=True).select(trees.tree_length().alias("x")).collect()]
    assert length(sampling.random_trees(keys, labels, 1)) == pytest.approx([2.0] * 10)
    drawn = length(sampling.random_trees(keys, labels, 1, "a", p_distance=0.5, low=1.0, high=3.0))
    assert all(0.5 <= x <= 1.5 for x in drawn) and len(set(np.round(drawn, 6))) == 10


@pytest.mark.parametrize("most", [5000, 2])
def test_validation_of_a_map_of_one_place(spark, monkeypatch, most):
    """Trees that lie on one place of the map have no correlation: not a number, and no error for the samples beside them."""
    monkeypatch.setattr(landscape, "MOST", most)
    d, e = _points(5), _points(5)
    flat = np.zeros((5, 5))
    table = _distances(spark, d).union(_distances(spark, d, 1)).union(_distances(spark, d[:2, :2], 2))
    places = _distances(spark, e).union(_distances(spark, flat, 1)).union(_distances(spark, flat[:2, :2], 2))
    rows = {r["sample"]: r for r in landscape.validation(table, places).collect()}
    assert [rows[k].n for k in range(3)] == [25, 25, 4]
    assert rows[0].kendall == pytest.approx(_tau(d.ravel(), e.ravel()))
    assert all(math.isnan(x) for k in (1, 2) for x in (rows[k].pearson, rows[k].spearman, rows[k].kendall))


def test_small_samples_go_together(spark, monkeypatch):
    """Many samples of two to nine trees in one task, cut into several pieces: coordinates, distances and correlations of each are those
    that it has alone."""
    monkeypatch.setattr(samples, "TOGETHER", 50)
    sizes = [2 + k % 8 for k in range(40)]
    made = [_points(n) for n in sizes]
    table = spark.createDataFrame([(s, i, j, float(np.round(d[i, j], 1))) for s, d in enumerate(made) for i, j in itertools.combinations(range(len(d)), 2)], "sample long, i long, j long, d double").repartition(3)
    coords = landscape.coordinates(table)
    places = {(r["sample"], r.tree_id): np.array(r.x) for r in coords.collect()}
    assert len(places) == sum(sizes)
    near = store.saved(landscape.embedded_distances(coords), "near")
    apart = {(r["sample"], r.i, r.j): r.d for r in near.collect()}
    for (s, i, j), e in apart.items():
        assert i < j and e == pytest.approx(np.sqrt(((places[s, i] - places[s, j]) ** 2).sum()))
    assert len(apart) == sum(n * (n - 1) // 2 for n in sizes)
    rows = {r["sample"]: r for r in landscape.validation(table, near).collect()}
    assert len(rows) == 40
    for s, d in enumerate(made):
        x = np.round(d, 1)
        h = np.eye(len(d)) - 1 / len(d)
        assert sum(places[s, k] @ places[s, k] for k in range(len(d))) == pytest.approx(np.maximum(np.linalg.eigvalsh(-0.5 * h @ (x * x) @ h)[::-1][:2], 0).sum(), abs=1e-9)
        e = np.zeros_like(x)
        for i, j in itertools.combinations(range(len(d)), 2):
            e[i, j] = e[j, i] = apart[s, i, j]
        assert rows[s].n == len(d) ** 2 and rows[s].pearson == pytest.approx(np.corrcoef(x.ravel(), e.ravel())[0, 1])
        assert rows[s].spearman == pytest.approx(np.corrcoef(_mean_ranks(x.ravel()), _mean_ranks(e.ravel()))[0, 1]) and rows[s].kendall == pytest.approx(_tau(x.ravel(), e.ravel()))


def test_hulls_and_surfaces_of_many_samples(spark, monkeypatch):
    """Hulls, points inside and surfaces of samples of one to twelve trees together, against each alone; the grid is joined with no trees,
    for such a table of places comes to the driver where Spark takes it for small."""
    monkeypatch.setattr(samples, "TOGETHER", 40)
    made = [np.round(RNG.standard_normal((1 + k % 12, 2)), 1 if k % 2 else 6) for k in range(30)]
    made.append(np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [1.0, 1.0]]))
    rows = [(s, 100 * s + k, p.tolist(), float(k % 5)) for s, points in enumerate(made) for k, p in enumerate(points)]
    coords = spark.createDataFrame(rows, "sample long, tree_id long, x array<double>, lnl double").repartition(5)
    corners = store.saved(landscape.hull(coords), "hull")
    rings = corners.toPandas().sort_values(["sample", "place"])
    for s, points in enumerate(made):
        own = rings[rings["sample"] == s]
        assert own["place"].tolist() == list(range(len(own))) and (own["tree_id"] - 100 * s).tolist() == landscape._chain(points)
    grid = landscape.surface(coords.select("sample", "tree_id", "x"), coords, cells=5)
    assert "Generate" not in grid._jdf.queryExecution().executedPlan().toString()
    drawn = grid.toPandas()
    assert len(drawn) == 25 * len(made) and set(drawn.groupby("sample").size()) == {25}
    for s in (11, 22, 23):
        points, own = made[s], drawn[drawn["sample"] == s]
        phi = lambda r: np.where(r > 0, r * r * np.log(np.where(r > 0, r, 1.0)), 0.0)
        r = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
        w = np.linalg.lstsq(phi(r) - 1e-10 * np.eye(len(points)), np.arange(len(points)) % 5.0, rcond=None)[0]
        at = own[["px", "py"]].to_numpy()
        z = phi(np.sqrt(((at[:, None] - points[None]) ** 2).sum(axis=2))) @ w
        chain = points[landscape._chain(points)]
        turn = np.roll(chain, -1, axis=0) - chain
        side = turn[:, 0] * (at[:, None, 1] - chain[:, 1]) - turn[:, 1] * (at[:, None, 0] - chain[:, 0])
        within = (side >= -1e-12).all(axis=1) if len(chain) > 2 else np.zeros(len(at), bool)
        assert len(chain) < 3 or (own["z"].notna().to_numpy() == within).all()
        there = own["z"].notna().to_numpy()
        assert own["z"].to_numpy()[there] == pytest.approx(z[there], abs=1e-5)


def test_smooth_line_by_both_ways(spark, monkeypatch):
    """Small samples by arrays, many at a time, and large ones by sums: the same places and the same line."""
    made = [_points(n) for n in (2, 3, 9, 12)]
    table = _distances(spark, made[0])
    for s, d in enumerate(made[1:], 1):
        table = table.union(_distances(spark, d, s))
    other = table.withColumn("d", F.round(2 * F.col("d") + (F.col("i") % 3) / 7, 3))

    def drawn():
        out = landscape.shepard(table, other, every=2).toPandas().sort_values(["sample", "d", "e"])
        return out[["sample", "d", "e", "smooth"]].to_numpy()

    monkeypatch.setattr(samples, "TOGETHER", 20)
    small = drawn()
    assert len(small) == sum(-(-n * (n - 1) // 2 // 2) for n in (2, 3, 9, 12))
    monkeypatch.setattr(landscape, "MOST", 4)
    assert drawn() == pytest.approx(small, abs=1e-9)
