"""Operators on pairs of trees of one sample."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesic import Edges, met, ragged
from ..functions.geodesic import crosses as crossing
from ..functions.newick import WORD
from ..sources.store import saved
from . import arrays as A
from .trees import full_mask

#: Trees of a block, about: all pairs of a sample are met block against block, each two blocks under a key of their own.
BLOCK = 512
#: Edges of a block, about, beyond which it has fewer trees.
BLOCK_EDGES = 60_000
#: Samples of more than one block up to which their numbers of blocks are sent to all tasks; beyond, they are joined by shuffle,
#: salted.
SENT, _SALTS = 100_000, 16
#: Pairs of trees that are worked on together.
TOGETHER = 400_000
#: Pairs of edges that are met together.
MET = 2_000_000


def blocked(rows: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (sample, tree_id and others) with ``_own``, the tree's block, and ``_blocks``, how many its sample has.
    ``sizes`` has a row for each tree of the samples. No sample's rows meet in one task: samples of one block, nearly all as
    a rule, are not joined at all."""
    counts = sizes.groupBy("sample").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).where("_blocks > 1")
    joined = with_blocks(rows, saved(counts, "blocks"), "tree_id").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    return joined.withColumn("_own", F.pmod(F.xxhash64("tree_id", F.lit(1)), "_blocks").cast("int"))


def with_blocks(rows: DataFrame, counts: DataFrame, spread: str) -> DataFrame:
    """``rows`` with ``_blocks`` of ``counts`` (``sample, _blocks``, a row for each large sample), null for other samples. Up to SENT
    rows of ``counts`` go to all tasks; more are joined by shuffle, a sample's rows dealt out by ``spread``."""
    if counts.limit(SENT + 1).count() <= SENT:
        return rows.join(F.broadcast(counts), "sample", "left")
    counts = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(_SALTS)).cast("int"))
    return salted.join(counts.hint("merge"), ["sample", "_salt"], "left").drop("_salt")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows once for each tile (two blocks ``_lo`` <= ``_hi``) of their block: as the lower one's, and as the higher one's."""
    low = rows.withColumn("_lo", F.col("_own")).withColumn("_hi", F.explode(F.sequence("_own", F.col("_blocks") - 1)))
    high = rows.withColumn("_hi", F.col("_own")).withColumn("_lo", F.explode(F.sequence(F.lit(0), "_own")))
    return low, high


def all_pairs(parsed: DataFrame, columns: list[str], block: int = BLOCK, keys: list[str] | None = None) -> DataFrame:
    """``sample, a, b``: all pairs of trees of a sample, each tree a struct of ``tree_id`` and ``columns``, the smaller id
    first; with ``keys``, those that agree on these columns as well."""
    keys = keys or []
    rows = blocked(parsed.select("sample", "tree_id", *columns, *keys), parsed.select("sample", "tree_id").distinct() if keys else parsed, block)
    low, high = _sides(rows)
    tile = ["sample", "_lo", "_hi", *keys]
    x = low.select(*tile, F.struct("tree_id", *columns).alias("x"))
    y = high.select(*tile, F.struct("tree_id", *columns).alias("y"))
    met = x.join(y, tile).where("_lo < _hi or x.tree_id < y.tree_id")
    first = F.col("x.tree_id") < F.col("y.tree_id")
    return met.select("sample", F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"), *keys)


def tree_pairs(parsed: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs i < j of a sample, each with both trees' edges as arrays: one compact row a pair."""
    met = all_pairs(parsed, ["splits", "leaves"], block)
    return met.select(
        "sample", F.col("a.tree_id").alias("i"), F.col("b.tree_id").alias("j"),
        F.col("a.splits").alias("a_splits"), F.col("a.leaves").alias("a_leaves"), F.col("b.splits").alias("b_splits"), F.col("b.leaves").alias("b_leaves"),
    )


def crosses(a: Column, b: Column) -> Column:
    """Neither disjoint nor nested."""
    both = F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))
    return F.exists(both, lambda x: x != 0) & (both != a) & (both != b)


def _crossing_any(x: Column, others: str) -> Column:
    return F.exists(F.col(others), lambda y: crosses(x["split"], y["split"]))


def incompatible_edges(pairs: DataFrame, of: str = "a", against: str = "b") -> Column:
    """Edges of one tree that cross at least one of the other."""
    return F.filter(f"{of}_splits", lambda x: _crossing_any(x, f"{against}_splits"))


def common_edges(pairs: DataFrame) -> DataFrame:
    """``sample, i, j, split, l1, l2``: edges that both trees have or that all edges of the other allow (length 0 there)."""
    shared = F.array_intersect(F.transform("a_splits", lambda x: x["split"]), F.transform("b_splits", lambda x: x["split"]))

    def one(side: str, other: str) -> Column:
        good = F.filter(f"{side}_splits", lambda x: F.array_contains(F.col("_shared"), x["split"]) | ~_crossing_any(x, f"{other}_splits"))
        zero = F.lit(0.0)
        return F.transform(
            good,
            lambda x: F.struct(x["split"].alias("split"), (x["length"] if side == "a" else zero).alias("l1"), (x["length"] if side == "b" else zero).alias("l2")),
        )

    found = pairs.withColumn("_shared", shared).select("sample", "i", "j", F.explode(F.concat(one("a", "b"), one("b", "a"))).alias("x"))
    return found.groupBy("sample", "i", "j", "x.split").agg(F.sum("x.l1").alias("l1"), F.sum("x.l2").alias("l2"))


def crossing_matrix(pairs: DataFrame) -> DataFrame:
    """``sample, i, j, a, b``: the crossing pairs of edges of two trees."""
    rows = pairs.select("sample", "i", "j", F.explode("a_splits.split").alias("a"), "b_splits")
    return rows.select("sample", "i", "j", "a", F.explode("b_splits.split").alias("b")).where(crosses(F.col("a"), F.col("b")))


def incidence(pairs: DataFrame) -> DataFrame:
    """``sample, i, j, a, crossed``: for each edge of the first tree one that says which of the second it crosses: bits in words of
    62, the edges of the second in the order of their masks (from the last word)."""
    names = ["sample", "i", "j", "a", "crossed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in A.chunks(np.asarray(whole.column("x").value_lengths().fill_null(0), np.int64) ** 2 + 1, MET):
                batch = whole.slice(lo, hi - lo)
                (first, a), (second, b) = (_masks(batch.column(c)) for c in "xy")
                if not len(a):
                    continue
                pair = np.repeat(np.arange(batch.num_rows), np.diff(second))
                order = np.lexsort((*b.T, pair))
                b, place = b[order], np.arange(len(b)) - second[pair]
                e, f = met(first, second)
                across = crossing(a[e], b[f])
                e, f = e[across], f[across]
                # as many words as the second tree's edges take, one at least
                size = np.repeat(np.maximum(-(-np.diff(second) // WORD), 1), np.diff(first))
                at = np.concatenate([[0], np.cumsum(size)])
                bits = np.zeros(at[-1], np.int64)
                np.add.at(bits, at[e] + place[f] // WORD, np.int64(1) << (place[f] % WORD))
                own = np.repeat(np.arange(batch.num_rows), np.diff(first))
                keys = [batch.column(c).take(pa.array(own)) for c in names[:3]]
                yield pa.RecordBatch.from_arrays([*keys, A.splits(a), A.lists(at, pa.array(bits))], names=names)

    rows = pairs.select("sample", "i", "j", F.col("a_splits.split").alias("x"), F.col("b_splits.split").alias("y"))
    return rows.mapInArrow(run, "sample long, i long, j long, a array<bigint>, crossed array<bigint>")


def _masks(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the lists of splits, and the end; and the splits' words."""
    flat = column.flatten()
    return A.offsets(column), flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1), np.int64)


@dataclass
class Trees:
    """Trees of several blocks after another: each block's first tree (and the end), ids, interior edges, leaf lengths."""

    bounds: np.ndarray
    ids: np.ndarray
    edges: Edges
    leaves: np.ndarray


def _trees(column: pa.ListArray, taxa: int, lacking: float) -> Trees:
    flat = column.flatten()
    return Trees(A.offsets(column), flat.field("tree_id").to_numpy(zero_copy_only=False), A.edges(flat.field("splits"), taxa), A.leaves(flat.field("leaves"), taxa, lacking))


def tiled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``sample, low, high`` of ``blocked`` rows: each tile as one row, the columns of its blocks' rows as lists of structs; ``high`` is null
    for a block with itself."""
    blocks = rows.groupBy("sample", "_own", "_blocks").agg(F.collect_list(F.struct(*columns)).alias("x"))
    nothing = F.lit(None).cast(blocks.schema["x"].dataType)
    alone = blocks.select("sample", F.col("x").alias("low"), nothing.alias("high"))
    several = blocks.where("_blocks > 1")
    low = several.select("sample", F.col("_own").alias("_lo"), F.explode(F.sequence(F.col("_own"), F.col("_blocks") - 1)).alias("_hi"), F.col("x").alias("low")).where("_lo < _hi")
    high = several.select("sample", F.col("_own").alias("_hi"), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_lo"), F.col("x").alias("high")).where("_lo < _hi")
    tiles = alone.union(low.join(high.hint("merge"), ["sample", "_lo", "_hi"]).select("sample", "low", "high"))
    return tiles.repartition(F.xxhash64("sample", F.get("low", F.lit(0))["tree_id"], F.get("high", F.lit(0))["tree_id"]))


def by_tiles(parsed: DataFrame, taxa: int, of: Callable[..., list[np.ndarray]], schema: str, block: int | None = None, once: Callable[[Trees], Trees] = lambda t: t, fresh: str | None = None, times: int = 1, together: int = TOGETHER, lacking: float = 0.0) -> DataFrame:
    """``sample, i, j`` and the columns of ``schema`` for all pairs i < j of each sample.

    A block of trees is one row, and so is a tile (two blocks of a sample), so that pairs are formed in the tasks and never
    shuffled. ``of(low, high, x, y)`` gives the columns for the pairs of tree x of ``low`` and y of ``high``; ``once``
    changes a tile's trees before. ``fresh``: a column that says which trees are new; pairs of two others are left out.
    ``times``: rows that ``of`` gives for each pair, one after another; ``together``: pairs that are worked on together;
    ``lacking``: a leaf's length where a tree lacks it.
    """
    trees = parsed.where("splits is not null").select("sample", "tree_id", "splits", "leaves", (F.col(fresh) if fresh else F.lit(True)).alias("fresh"))
    trees = saved(trees, "trees")
    block = block or max(16, min(BLOCK, BLOCK_EDGES // max(taxa, 1)))
    rows = blocked(trees, trees, block)
    tiles = tiled(rows, ["tree_id", "splits", "leaves", "fresh"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_low, n_high = (np.asarray(batch.column(c).value_lengths().fill_null(0), np.int64) for c in ("low", "high"))
            for lo, hi in A.chunks(n_low * np.where(n_high > 0, n_high, n_low), together):
                part = batch.slice(lo, hi - lo)
                self_ = n_high[lo:hi] == 0
                first = once(_trees(part.column("low"), taxa, lacking))
                second = first if self_.all() else once(_trees(either(part, self_), taxa, lacking))
                x, y = met(first.bounds, second.bounds)
                a, b = first.ids[x], second.ids[y]
                new = [p.flatten().field("fresh").to_numpy(zero_copy_only=False) for p in (part.column("low"), part.column("low") if self_.all() else either(part, self_))]
                keep = (new[0][x] | new[1][y]) & ((a < b) | ~np.repeat(self_, np.diff(first.bounds) * np.diff(second.bounds)) & (a != b))
                x, y, a, b = x[keep], y[keep], a[keep], b[keep]
                sample = np.repeat(part.column("sample").to_numpy(zero_copy_only=False), np.diff(first.bounds))[x]
                keys = [np.repeat(c, times) for c in (sample, np.minimum(a, b), np.maximum(a, b))]
                columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in (*keys, *of(first, second, x, y))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = f"sample long, i long, j long, {schema}"
    names = ["sample", "i", "j", *(c.strip().split()[0] for c in re.split(r",(?![^<]*>)", schema))]
    return tiles.mapInArrow(run, kinds)


def either(part: pa.RecordBatch, self_: np.ndarray) -> pa.ListArray:
    """The second block of each tile, the first where there is none."""
    both = pa.concat_arrays([part.column("low"), part.column("high")])
    return both.take(pa.array(np.where(self_, np.arange(len(self_)), len(self_) + np.arange(len(self_)))))


def _away_from_first(t: Trees, taxa: int) -> Trees:
    """Splits as their side without taxon 0, each once (the root's two edges are one); those of one taxon go to the leaves."""
    full = np.array(full_mask(taxa), np.int64)
    n, leaves = len(t.ids), t.leaves.copy()
    owner = np.repeat(np.arange(n), np.diff(t.edges.bounds))
    masks = np.where((t.edges.masks[:, :1] & 1) > 0, t.edges.masks ^ full, t.edges.masks)
    size, lengths = A.sizes(masks), t.edges.lengths
    one = np.flatnonzero(size == 1)
    word = (masks[one] != 0).argmax(axis=1)
    taxon = word * WORD + np.bitwise_count(masks[one, word] - 1).astype(np.int64)
    np.add.at(leaves, (owner[one], taxon), lengths[one])
    rest = size == taxa - 1
    np.add.at(leaves, (owner[rest], 0), lengths[rest])
    inner = (size > 1) & ~rest
    return Trees(t.bounds, t.ids, _merged(owner[inner], masks[inner], lengths[inner], n), leaves)


def _merged(owner: np.ndarray, masks: np.ndarray, lengths: np.ndarray, n: int) -> Edges:
    """Edges of n trees, those of one tree and split added up."""
    order = np.lexsort((*masks.T, owner))
    owner, masks, lengths = owner[order], masks[order], lengths[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (masks[1:] != masks[:-1]).any(axis=1)])) if len(owner) else np.zeros(0, np.int64)
    return Edges(np.searchsorted(owner[first], np.arange(n + 1)), masks[first], np.add.reduceat(lengths, first) if len(first) else lengths)


def rf_distances(parsed: DataFrame, taxa: int, rooted: bool = False, block: int | None = None, fresh: str | None = None) -> DataFrame:
    """``sample, i, j, rf, wrf`` of all pairs: the number of splits that one tree has alone, and the sum of all absolute
    differences of lengths, leaves included. Trees that are null are of no pair. ``fresh``: a column that says which trees are
    new; only pairs with a new one are given.

    A tile's edges are sorted by split; those of one split are met, and what they have in common is taken off the sums of
    both trees. Leaves are a matrix, for every tree has them all.
    """

    def of(low: Trees, high: Trees, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        sums = lambda t: np.bincount(np.repeat(np.arange(len(t.ids)), np.diff(t.edges.bounds)), t.edges.lengths, len(t.ids))
        n_high = np.diff(high.bounds)
        tile = np.repeat(np.arange(len(low.bounds) - 1), np.diff(low.bounds))
        at = np.concatenate([[0], np.cumsum(np.diff(low.bounds) * n_high)])[:-1]  # where a tile's pairs begin
        code_low, code_high = _codes(low, high)
        order = np.argsort(code_high, kind="stable")
        start, end = (np.searchsorted(code_high[order], code_low, side) for side in ("left", "right"))
        e, f = np.repeat(np.arange(len(code_low)), end - start), order[ragged(start, end - start)]
        tree_low, tree_high = (np.repeat(np.arange(len(t.ids)), np.diff(t.edges.bounds)) for t in (low, high))
        place = lambda i, j: at[tile[i]] + (i - low.bounds[tile[i]]) * n_high[tile[i]] + j - high.bounds[tile[i]]
        total = int((np.diff(low.bounds) * n_high).sum())
        met_at, own = place(tree_low[e], tree_high[f]), place(x, y)
        common = np.bincount(met_at, minlength=total)[own]
        shared = np.bincount(met_at, np.minimum(low.edges.lengths[e], high.edges.lengths[f]), total)[own]
        pendant = np.zeros(len(x))
        for lo in range(0, len(x), max(1, TOGETHER * 8 // taxa)):
            hi = lo + max(1, TOGETHER * 8 // taxa)
            pendant[lo:hi] = np.abs(low.leaves[x[lo:hi]] - high.leaves[y[lo:hi]]).sum(axis=1)
        rf = np.diff(low.edges.bounds)[x] + np.diff(high.edges.bounds)[y] - 2 * common
        return [rf, sums(low)[x] + sums(high)[y] - 2 * shared + pendant]

    once = (lambda t: t) if rooted else (lambda t: _away_from_first(t, taxa))
    return by_tiles(parsed, taxa, of, "rf long, wrf double", block, once, fresh)


def _codes(low: Trees, high: Trees) -> tuple[np.ndarray, np.ndarray]:
    """A number for each edge that edges of one tile and split share."""
    tiles = [np.repeat(np.repeat(np.arange(len(t.bounds) - 1), np.diff(t.bounds)), np.diff(t.edges.bounds)) for t in (low, high)]
    tile, masks = np.concatenate(tiles), np.concatenate([low.edges.masks, high.edges.masks])
    order = np.lexsort((*masks.T, tile))
    new = (tile[order[1:]] != tile[order[:-1]]) | (masks[order[1:]] != masks[order[:-1]]).any(axis=1)
    code = np.empty(len(tile), np.int64)
    code[order] = np.cumsum(np.concatenate([[0], new])) if len(tile) else 0
    return code[: len(tiles[0])], code[len(tiles[0]) :]


def _bits(masks: np.ndarray, taxa: int) -> np.ndarray:
    """A row of 0 and 1 for each mask."""
    t = np.arange(taxa)
    return (masks[:, t // WORD] >> (t % WORD) & 1).astype(float)


def _to_ancestors(e: Edges, leaves: np.ndarray, taxa: int) -> np.ndarray:
    """For each tree, two rows: edges, and length, from the root to each two taxa's common ancestor, then 1, and the
    pendant length, of each taxon."""
    bits, (a, b), n = _bits(e.masks, taxa), np.triu_indices(taxa, 1), len(leaves)
    out = np.empty((n, 2, len(a) + taxa))
    out[:, 0, len(a) :], out[:, 1, len(a) :] = 1.0, leaves
    for k, (lo, hi) in enumerate(zip(e.bounds.tolist(), e.bounds[1:].tolist())):
        own = bits[lo:hi]
        out[k, 0, : len(a)] = (own.T @ own)[a, b]
        out[k, 1, : len(a)] = (own.T @ (own * e.lengths[lo:hi, None]))[a, b]
    return out


def kc_vectors(parsed: DataFrame, taxa: int) -> DataFrame:
    """``sample, tree_id, m, big_m`` of trees that are not null: for each pair of taxa the number of edges and the length from
    the root to their common ancestor, then 1 and the pendant length for each taxon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in A.chunks(np.full(whole.num_rows, taxa * taxa), 4_000_000):
                batch = whole.slice(lo, hi - lo)
                v = _to_ancestors(A.edges(batch.column("splits"), taxa), A.leaves(batch.column("leaves"), taxa), taxa)
                bounds = np.arange(len(v) + 1) * v.shape[2]
                columns = [A.lists(bounds, pa.array(np.ascontiguousarray(v[:, k]).ravel())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["sample", "tree_id", "m", "big_m"])

    whole = parsed.where("splits is not null").select("sample", "tree_id", "splits", "leaves")
    return whole.mapInArrow(run, "sample long, tree_id long, m array<double>, big_m array<double>")


def kc_distances(parsed: DataFrame, taxa: int, c: float, block: int | None = None) -> DataFrame:
    """``sample, i, j, d``: distance of the vectors (1 - c) m / sum m + c M / sum M of all pairs (see ``kc_vectors``)."""

    def scaled(t: Trees) -> Trees:
        v = np.empty((len(t.ids), taxa * (taxa + 1) // 2))
        for lo, hi in A.chunks(np.full(len(v), taxa * taxa), 4_000_000):
            e = Edges(t.edges.bounds[lo : hi + 1] - t.edges.bounds[lo], t.edges.masks[t.edges.bounds[lo] : t.edges.bounds[hi]], t.edges.lengths[t.edges.bounds[lo] : t.edges.bounds[hi]])
            own = _to_ancestors(e, t.leaves[lo:hi], taxa)
            own /= own.sum(axis=2, keepdims=True)
            v[lo:hi] = (1 - c) * own[:, 0] + c * own[:, 1]
        return Trees(t.bounds, t.ids, t.edges, v)

    def of(low: Trees, high: Trees, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        d, step = np.empty(len(x)), max(1, 4_000_000 // low.leaves.shape[1])
        for lo in range(0, len(x), step):
            d[lo : lo + step] = np.sqrt(((low.leaves[x[lo : lo + step]] - high.leaves[y[lo : lo + step]]) ** 2).sum(axis=1))
        return [d]

    return by_tiles(parsed, taxa, of, "d double", block, scaled)


def differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs on which two distance tables disagree at ten truncated decimals, or that one of them lacks."""
    cut = lambda x: F.floor(x * 1e10)
    both = left.withColumnRenamed("d", "d1").join(right.withColumnRenamed("d", "d2"), keys, "full_outer")
    return both.where(~cut(F.col("d1")).eqNullSafe(cut(F.col("d2"))))  # with d1 and d2
