"""Geodesics: their supports by arrays over batches of pairs, all that follows as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geodesic as G
from ..functions.geodesic import Edges
from . import arrays as A
from .pairs import Trees, _crossing_any, by_tiles
from .samples import by_sample, numbers, starts
from .trees import LEAVES, SPLITS

_EDGE = "array<struct<split:array<bigint>,length:double>>"
SUPPORTS = f"array<struct<part:array<bigint>,a:{_EDGE},b:{_EDGE},a_norm:double,b_norm:double>>"
COMMON = "array<struct<split:array<bigint>,l1:double,l2:double>>"
LEAF = "array<struct<taxon_id:int,l1:double,l2:double>>"
SCHEMA = f"sample long, i long, j long, supports {SUPPORTS}, common {COMMON}, leaf {LEAF}"


TREES = f"at double, splits {SPLITS}, leaves {LEAVES}"
PROJECTED = "sample long, tree_id long, i long, j long, at double, d double"
#: Pairs of edges that are met together.
MET = 2_000_000


def _leaf_terms() -> Column:
    """Both lengths of each leaf, by taxon."""
    both = F.zip_with(F.array_sort("a_leaves"), F.array_sort("b_leaves"), lambda x, y: F.struct(x["taxon_id"].alias("taxon_id"), x["length"].alias("l1"), y["length"].alias("l2")))
    return both.cast(LEAF)


def geodesics(pairs: DataFrame, taxa: int, strict: bool = False) -> DataFrame:
    """``sample, i, j, supports, common, leaf`` for pairs with both trees' edges.

    ``supports``: edges dropped and added together, by ascending ratio of their norms, with the common
    edge they lie under (all zeros: the root). ``strict``: equal ratios are one (an orthant boundary each). A batch of
    pairs goes through arrays together, some at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            n_edges = [np.asarray(whole.column(c).value_lengths().fill_null(0), np.int64) for c in ("a_splits", "b_splits")]
            for low, high in A.chunks(n_edges[0] * n_edges[1] + 1, MET):
                batch = whole.slice(low, high - low)
                found = G.geodesics(A.edges(batch.column("a_splits"), taxa), A.edges(batch.column("b_splits"), taxa), strict)
                side = lambda e: A.lists(e.bounds, A.structs(split=A.splits(e.masks), length=e.lengths))
                ratio = A.structs(part=A.splits(found.part), a=side(found.a), b=side(found.b), a_norm=found.a_norm, b_norm=found.b_norm)
                common = A.structs(split=A.splits(found.common), l1=found.first, l2=found.second)
                columns = [*batch.columns[:3], A.lists(found.bounds, ratio), A.lists(found.common_bounds, common), batch.column("leaf")]
                yield pa.RecordBatch.from_arrays(columns, names=["sample", "i", "j", "supports", "common", "leaf"])

    return pairs.select("sample", "i", "j", "a_splits", "b_splits", _leaf_terms().alias("leaf")).mapInArrow(run, SCHEMA)


def contributions(pairs: DataFrame) -> DataFrame:
    """``sample, i, j, leaf_square, common_square``: the leaves' and the common edges' shares of the squared distances, by
    column expressions alone. An edge that crosses none of the other tree is common."""
    square = lambda x, y: (x - y) * (x - y)
    leaf = _total(F.transform(_leaf_terms(), lambda x: square(x["l1"], x["l2"])))
    same = lambda x, other: F.filter(other, lambda y: y["split"] == x["split"])
    free = lambda side, other: F.filter(side, lambda x: ~_crossing_any(x, other))
    own = F.transform(free("a_splits", "b_splits"), lambda x: square(x["length"], _total(F.transform(same(x, "b_splits"), lambda y: y["length"]))))
    alone = F.filter(free("b_splits", "a_splits"), lambda x: F.size(same(x, "a_splits")) == 0)
    rest = F.transform(alone, lambda x: x["length"] * x["length"])
    return pairs.select("sample", "i", "j", leaf.alias("leaf_square"), _total(F.concat(own, rest)).alias("common_square"))


def distances(parsed: DataFrame, taxa: int, block: int | None = None) -> DataFrame:
    """``sample, i, j, d``: the geodesic distances of all pairs of each sample, tile by tile; no pair is a row before its
    distance is known. Trees that are null are of no pair."""

    def of(low: Trees, high: Trees, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        d = np.empty(len(x))
        work = np.diff(low.edges.bounds)[x] * np.diff(high.edges.bounds)[y] + 1
        for lo, hi in A.chunks(work, MET):
            i, j = x[lo:hi], y[lo:hi]
            d[lo:hi] = np.sqrt(G.geodesics(low.edges.of(i), high.edges.of(j)).square() + ((low.leaves[i] - high.leaves[j]) ** 2).sum(axis=1))
        return [d]

    return by_tiles(parsed, taxa, of, "d double", block)


def _total(array) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def _sum(array, value) -> Column:
    return _total(F.transform(array, value))


def leaf_square() -> Column:
    return _sum("leaf", lambda x: (x["l1"] - x["l2"]) * (x["l1"] - x["l2"]))


def common_square() -> Column:
    return _sum("common", lambda x: (x["l1"] - x["l2"]) * (x["l1"] - x["l2"]))


def distance() -> Column:
    parts = _sum("supports", lambda x: (x["a_norm"] + x["b_norm"]) * (x["a_norm"] + x["b_norm"]))
    return F.sqrt(parts + common_square() + leaf_square())


def limit(x: Column) -> Column:
    """Where on the path a ratio's edges are exchanged, to ten decimals."""
    return F.round(x["a_norm"] / (x["a_norm"] + x["b_norm"]), 10)


def limits() -> Column:
    """Limits of the legs, both ends included."""
    return F.concat(F.array(F.lit(0.0)), F.array_distinct(F.transform("supports", limit)), F.array(F.lit(1.0)))


def legs(geodesic: DataFrame) -> DataFrame:
    """``sample, i, j, leg, low, high, splits``: a row for each orthant that the path crosses, from where to where, and
    the splits of its trees: the common ones, those not yet dropped and those already added. The geodesic's equal
    ratios must be one (``strict``)."""
    n = F.size("supports")
    rows = geodesic.select("sample", "i", "j", "supports", "common", F.explode(F.sequence(F.lit(0), n)).alias("leg"))
    of = lambda part, side: F.flatten(F.transform(part, lambda s: F.transform(s[side], lambda e: e["split"])))
    kept = of(F.slice("supports", F.col("leg") + 1, n - F.col("leg")), "a")
    new = of(F.slice("supports", F.lit(1), F.col("leg")), "b")
    bound = lambda k: limit(F.get("supports", k))
    low = F.when(F.col("leg") > 0, bound(F.col("leg") - 1)).otherwise(0.0)
    high = F.when(F.col("leg") < n, bound(F.col("leg"))).otherwise(1.0)
    return rows.select("sample", "i", "j", "leg", low.alias("low"), high.alias("high"), F.concat(F.transform("common", lambda x: x["split"]), kept, new).alias("splits"))


def direction_vector(geodesic: DataFrame) -> DataFrame:
    """``sample, i, j, edges, leaf``: how the first tree's lengths change on the way to the first orthant boundary that the
    path meets, or to the other tree where it meets none. Interior edges (split, x) are the first tree's own; one
    that the other tree lacks though all its edges allow it shrinks to nothing there."""
    first = F.when(F.size("supports") > 0, limit(F.get("supports", F.lit(0)))).otherwise(F.lit(1.0))
    own = F.transform(F.filter("common", lambda x: x["l1"] > 0), lambda x: F.struct(x["split"].alias("split"), ((x["l2"] - x["l1"]) * F.col("first")).alias("x")))
    gone = F.flatten(
        F.transform(
            "supports",
            lambda s: F.transform(s["a"], lambda e: F.struct(e["split"].alias("split"), (-e["length"] * F.col("first") * (s["a_norm"] + s["b_norm"]) / s["a_norm"]).alias("x"))),
        )
    )
    leaf = F.transform("leaf", lambda x: F.struct(x["taxon_id"].alias("taxon_id"), ((x["l2"] - x["l1"]) * F.col("first")).alias("x")))
    return geodesic.withColumn("first", first).select("sample", "i", "j", F.concat(own, gone).alias("edges"), leaf.alias("leaf"))


def report(geodesic: DataFrame) -> DataFrame:
    """``sample, i, j, place, ratio, a_norm, b_norm, dropped, added``: a row for each ratio of a geodesic, in order, with its value,
    both norms, and the splits that are dropped and added there (an array of masks each, in their order)."""
    rows = geodesic.select("sample", "i", "j", F.posexplode("supports").alias("place", "s"))
    masks = lambda side: F.array_sort(F.transform(f"s.{side}", lambda e: e["split"]))
    return rows.select("sample", "i", "j", "place", (F.col("s.a_norm") / F.col("s.b_norm")).alias("ratio"), "s.a_norm", "s.b_norm", masks("a").alias("dropped"), masks("b").alias("added"))


def combinatorial_type(names) -> Column:
    """The ratios of ``supports`` as ``{dropped}/{added};``, a split as ``names`` of its mask."""
    side = lambda x: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.transform(x, lambda e: e["split"])), names), ","), F.lit("}"))
    return F.array_join(F.transform("supports", lambda s: F.concat(side(s["a"]), F.lit("/"), side(s["b"]), F.lit(";"))), "")


def projection(rows: DataFrame, taxa: int, tolerance: float = 1e-6) -> DataFrame:
    """``sample, tree_id, i, j, at, d``: the point of the geodesic from tree i to tree j that is nearest to the tree, and how far.

    ``rows``: ``sample, tree_id, i, j`` and the edges of all three (``t_splits, t_leaves, a_splits, ...``). The distance is
    convex along a geodesic: first the leg that holds the least one is found from the distances at its ends, then the
    place within it by golden section until the interval is ``tolerance`` at most; an end of the path is taken if no place is
    nearer. All rows of a batch go together, each step one run over arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [(A.edges(batch.column(f"{x}_splits"), taxa), A.leaves(batch.column(f"{x}_leaves"), taxa)) for x in "abt"]
            for lo, hi, at, found in _nearest(trees, [np.arange(batch.num_rows)] * 3, tolerance):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("sample", "tree_id", "i", "j")), pa.array(at), pa.array(found)], names=["sample", "tree_id", "i", "j", "at", "d"])

    return rows.mapInArrow(run, PROJECTED)


def projection_in_samples(parsed: DataFrame, wanted: DataFrame, taxa: int, tolerance: float = 1e-6) -> DataFrame:
    """The same for ``wanted`` (sample, tree_id, i, j) and ``parsed`` trees, of samples whose trees fit a task: each tree is shuffled
    once, however many rows want it. Rows of trees that the sample lacks are left out."""

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        bounds = starts(numbers(batch, "sample")[0])
        own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        is_tree = numbers(batch, "kind")[0] == 0
        trees, rows = batch.filter(pa.array(is_tree)), batch.filter(pa.array(~is_tree))
        ids, names = numbers(trees, "tree_id")[0], numbers(rows, "tree_id", "i", "j")
        known, code = np.unique(np.concatenate([ids, *names]), return_inverse=True)
        code += np.concatenate([own[is_tree], *[own[~is_tree]] * 3]) * max(len(known), 1)
        have, of = code[: len(ids)], code[len(ids) :].reshape(3, -1)  # in order: by sample and id
        at = np.searchsorted(have, of)
        there = (have[np.minimum(at, len(have) - 1)] == of).all(axis=0) if len(have) else np.zeros(of.shape[1], bool)
        t, a, b = at[:, there]
        keys = [rows.column("sample").to_numpy(zero_copy_only=False)[there], *(x[there] for x in names)]
        e = (A.edges(trees.column("splits"), taxa), A.leaves(trees.column("leaves"), taxa))
        for lo, hi, place, found in _nearest([e] * 3, [a, b, t], tolerance):
            yield [*(x[lo:hi] for x in keys), place, found]

    zero = F.lit(0).cast("long")
    nothing = [F.lit(None).cast(parsed.schema[c].dataType).alias(c) for c in ("splits", "leaves")]
    rows = parsed.select("sample", F.lit(0).alias("kind"), "tree_id", zero.alias("i"), zero.alias("j"), "splits", "leaves")
    return by_sample(rows.union(wanted.select("sample", F.lit(1), "tree_id", "i", "j", *nothing)), run, PROJECTED, ("kind", "tree_id"))


def _nearest(trees: list, rows: list[np.ndarray], tolerance: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Some rows after others (from, to): place on the geodesic and distance. ``trees``: edges and leaves of first, second and the tree,
    ``rows``: which of them each row has."""
    golden = (5**0.5 - 1) / 2
    n_edges = np.diff(trees[0][0].bounds)[rows[0]]
    for lo, hi in A.chunks((n_edges + 1) ** 2 * 3, MET // 4):
        (a, la), (b, lb), (t, lt) = ((e.of(r[lo:hi]), leaves[r[lo:hi]]) for (e, leaves), r in zip(trees, rows))
        path, n = G.geodesics(a, b), hi - lo

        def far(x: np.ndarray, path=path, t=t, la=la, lb=lb, lt=lt) -> np.ndarray:
            leaves = (1 - x[:, None]) * la + x[:, None] * lb
            return np.sqrt(G.geodesics(path.at(x), t).square() + ((leaves - lt) ** 2).sum(axis=1))

        # limits of the legs, as many for all as the longest path has, further ones at its end
        ratio = np.repeat(np.arange(n), np.diff(path.bounds))
        most = int(np.diff(path.bounds).max(initial=0))
        ends = np.ones((n, most + 2))
        ends[:, 0] = 0.0
        ends[ratio, 1 + np.arange(len(ratio)) - path.bounds[ratio]] = path.a_norm / (path.a_norm + path.b_norm)
        d = np.stack([far(x) for x in ends.T], axis=1)
        best = d.argmin(axis=1)
        low, high = ends[np.arange(n), np.maximum(best - 1, 0)], ends[np.arange(n), np.minimum(best + 1, most + 1)]
        x, y = high - golden * (high - low), low + golden * (high - low)
        fx, fy = far(x), far(y)
        while (high - low).max(initial=0) > tolerance:
            left = fx <= fy
            high, low = np.where(left, y, high), np.where(left, low, x)
            x, y = np.where(left, high - golden * (high - low), y), np.where(left, x, low + golden * (high - low))
            new = far(np.where(left, x, y))
            fx, fy = np.where(left, new, fy), np.where(left, fx, new)
        place = (low + high) / 2
        inner = far(place)
        at_end = d[np.arange(n), best] <= inner
        at, found = np.where(at_end, ends[np.arange(n), best], place), np.where(at_end, d[np.arange(n), best], inner)
        yield lo, hi, at, found


def tree_at(geodesic: DataFrame, at: str) -> DataFrame:
    """Adds ``splits`` and ``leaves`` of the tree at position ``at`` (a column, 0 to 1) of each geodesic."""
    lam = F.round(F.col(at), 10)

    def dropped(s: Column) -> Column:
        factor = F.greatest(F.lit(0.0), ((1 - lam) * s["a_norm"] - lam * s["b_norm"]) / s["a_norm"])
        edges = F.transform(s["a"], lambda e: F.struct(e["split"].alias("split"), (e["length"] * factor).alias("length")))
        return F.when(lam < limit(s), edges).otherwise(F.array().cast(_EDGE))

    def added(s: Column) -> Column:
        factor = F.greatest(F.lit(0.0), (lam * s["b_norm"] - (1 - lam) * s["a_norm"]) / s["b_norm"])
        edges = F.transform(s["b"], lambda e: F.struct(e["split"].alias("split"), (e["length"] * factor).alias("length")))
        return F.when(lam > limit(s), edges).otherwise(F.array().cast(_EDGE))

    between = lambda x: (1 - lam) * x["l1"] + lam * x["l2"]
    common = F.transform("common", lambda x: F.struct(x["split"].alias("split"), between(x).alias("length")))
    edges = F.concat(common, F.flatten(F.transform("supports", dropped)), F.flatten(F.transform("supports", added)))
    size = lambda m: F.aggregate(F.transform(m, F.bit_count), F.lit(0), lambda s, x: s + x)
    kept = F.filter(edges, lambda e: e["length"] > 1e-10)
    ten = lambda x: F.round(x, 10)
    return geodesic.withColumn(
        "splits", F.transform(kept, lambda e: F.struct(e["split"].alias("split"), size(e["split"]).alias("size"), ten(e["length"]).alias("length")))
    ).withColumn("leaves", F.transform("leaf", lambda x: F.struct(x["taxon_id"].alias("taxon_id"), ten(between(x)).alias("length"))))


def trees_between(parsed: DataFrame, taxa: int, positions: list[float], block: int | None = None) -> DataFrame:
    """``sample, i, j, at, splits, leaves``: the trees at these positions (0 to 1, to ten decimals; none: no rows) of the geodesics of all pairs
    i < j of each sample, tile by tile: neither a pair nor a geodesic is a row before its trees are made."""

    def of(low: Trees, high: Trees, x: np.ndarray, y: np.ndarray) -> list:
        n, k = len(low.ids), len(positions)
        edges = Edges(np.concatenate([low.edges.bounds, low.edges.bounds[-1] + high.edges.bounds[1:]]), np.concatenate([low.edges.masks, high.edges.masks]), np.concatenate([low.edges.lengths, high.edges.lengths]))
        leaves, turned = np.concatenate([low.leaves, high.leaves]), low.ids[x] > high.ids[y]
        first, second = np.where(turned, n + y, x), np.where(turned, x, n + y)
        path, found = G.geodesics(edges.of(first), edges.of(second)), []
        if not positions:
            return [pa.array([], pa.float64()), A.parsed(edges.of(np.zeros(0, np.int64))), A.lists(np.zeros(1), A.structs(taxon_id=np.zeros(0, np.int32), length=np.zeros(0)))]
        for at in positions:
            e = path.at(np.full(len(x), round(at, 10)))
            found.append(Edges(e.bounds, e.masks, np.round(e.lengths, 10)))
        # a pair's trees after another
        whole = Edges(np.concatenate([[0], *(e.bounds[1:] + sum(len(f.lengths) for f in found[:c]) for c, e in enumerate(found))]), np.concatenate([e.masks for e in found]), np.concatenate([e.lengths for e in found]))
        whole = whole.of((np.arange(k)[None, :] * len(x) + np.arange(len(x))[:, None]).ravel())
        at = np.tile(np.round(positions, 10), len(x))
        tips = np.round((1 - at[:, None]) * np.repeat(leaves[first], k, axis=0) + at[:, None] * np.repeat(leaves[second], k, axis=0), 10)
        there, taxon = np.nonzero(~np.isnan(tips))
        pendant = A.lists(np.searchsorted(there, np.arange(len(tips) + 1)), A.structs(taxon_id=taxon.astype(np.int32), length=tips[there, taxon]))
        return [np.tile(positions, len(x)), A.parsed(whole), pendant]

    return by_tiles(parsed, taxa, of, TREES, block, times=len(positions), together=max(1, 400_000 // (taxa * max(1, len(positions)))), lacking=np.nan)


def path_positions(n: int) -> list[float]:
    """Inner positions of ``n`` trees from end to end, both ends counted."""
    return [k / (n - 1) for k in range(1, n - 1)]


def reverse(geodesic: DataFrame) -> DataFrame:
    """The geodesic from j to i."""
    swapped = F.transform(
        F.reverse("supports"),
        lambda s: F.struct(s["part"].alias("part"), s["b"].alias("a"), s["a"].alias("b"), s["b_norm"].alias("a_norm"), s["a_norm"].alias("b_norm")),
    )
    turned = lambda name, key: F.transform(name, lambda x: F.struct(x[key].alias(key), x["l2"].alias("l1"), x["l1"].alias("l2")))
    return geodesic.select("sample", F.col("j").alias("i"), F.col("i").alias("j"), swapped.alias("supports"), turned("common", "split").alias("common"), turned("leaf", "taxon_id").alias("leaf"))


def log_map(geodesic: DataFrame) -> DataFrame:
    """``sample, i, j, d, edges``: the start direction in the first tree's edges, as long as the geodesic."""
    first = F.when(F.size("supports") > 0, limit(F.get("supports", F.lit(0)))).otherwise(F.lit(1.0))
    own = F.transform("common", lambda x: F.struct(x["split"].alias("split"), (x["l2"] - x["l1"]).alias("x")))
    gone = F.flatten(
        F.transform(
            "supports",
            lambda s: F.transform(s["a"], lambda e: F.struct(e["split"].alias("split"), (-e["length"] * (s["a_norm"] + s["b_norm"]) / s["a_norm"]).alias("x"))),
        )
    )
    leaf = F.transform("leaf", lambda x: x["l2"] - x["l1"])
    d = geodesic.select("sample", "i", "j", distance().alias("d"), first.alias("first_limit"), F.concat(own, gone).alias("edges"), leaf.alias("leaf"))
    norm = F.sqrt(_sum("edges", lambda x: x["x"] * x["x"]) + _sum("leaf", lambda x: x * x))
    d = d.withColumn("norm", norm)
    scale = F.when(F.col("norm") > 0, F.col("d") / F.col("norm")).otherwise(0.0)
    return d.withColumn("edges", F.transform("edges", lambda x: x.withField("x", x["x"] * scale))).withColumn("leaf", F.transform("leaf", lambda x: x * scale))
