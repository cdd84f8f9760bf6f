"""Alignments, site patterns, log-likelihoods and branch lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import likelihood as L
from ..functions.geodesic import Edges
from ..sources.files import numbered
from ..sources.store import saved
from . import arrays as A
from .order import placed_in_sample
from .trees import LEAVES, SPLITS

#: Site patterns of a block, and trees of a group: a task has one of each.
BLOCK, TREES = 20_000, 256
#: Groups that trees are dealt to with no more than that in each, before groups grow instead (up to TREES trees a group where
#: lengths are bettered, MOST_TREES where trees are scored): each group has a copy of the patterns.
GROUPS, MOST_TREES = 4096, 4096


def _groups(trees: int, together: int, most: int) -> int:
    """Groups of about ``together`` trees, of more beyond GROUPS of them, up to ``most``."""
    return max(1, min(-(-trees // together), max(GROUPS, -(-trees // max(most, together)))))


def variable_sites(cells: DataFrame) -> DataFrame:
    """One row: ``variable`` (sites of more than one letter but gaps), ``total``, and their quotient ``p``."""
    sites = cells.groupBy("site").agg((F.count_distinct(F.when(F.col("letter") != "-", F.col("letter"))) > 1).cast("long").alias("v"))
    return sites.agg(F.sum("v").alias("variable"), F.count("*").alias("total")).withColumn("p", F.col("variable") / F.col("total"))


def sequences(cells: DataFrame) -> DataFrame:
    """``taxon, sequence`` with letters in order of the site."""
    ordered = F.sort_array(F.collect_list(F.struct("site", "letter")))
    return cells.groupBy("taxon").agg(F.array_join(F.transform(ordered, lambda x: x["letter"]), "").alias("sequence"))


def match_labels(tips: DataFrame, sequences: DataFrame) -> DataFrame:
    """``label, sequence_label`` (null if none fits): the tip's label, else its label without the last underscore."""
    names = sequences.select(F.col("label").alias("sequence_label")).distinct()
    exact = tips.join(names.withColumn("_e", F.col("sequence_label")).drop("sequence_label"), tips["label"] == F.col("_e"), "left")
    second = names.withColumnRenamed("sequence_label", "_s")
    found = exact.join(second, F.col("_e").isNull() & (F.regexp_replace("label", "_([^_]*)$", "$1") == F.col("_s")), "left")
    return found.withColumn("sequence_label", F.coalesce("_e", "_s")).drop("_e", "_s")


def tip_conditionals(letter: Column) -> Column:
    """Four conditionals of a letter: one-hot for A, C, G, T in either case, all ones for others."""
    b = F.upper(letter)
    known = b.isin("A", "C", "G", "T")
    return F.array(*(F.when(~known | (b == x), 1.0).otherwise(0.0) for x in "ACGT"))


def jukes_cantor(t: Column, same: bool) -> Column:
    """Probability of the same base, or of a certain other one, after t."""
    return F.lit(0.25) + 0.75 * F.exp(-4 * t / 3) if same else F.lit(0.25) - 0.25 * F.exp(-4 * t / 3)


def patterns(cells: DataFrame) -> DataFrame:
    """``pattern_id, bases, weight``: each distinct column of the alignment and how often it comes."""
    code = F.instr(F.lit("ACGT"), F.upper("letter")) - 1
    ordered = F.sort_array(F.collect_list(F.struct("taxon", code.cast("tinyint").alias("b"))))
    columns = cells.groupBy("site").agg(F.transform(ordered, lambda x: x["b"]).alias("bases"))
    return numbered(columns.groupBy("bases").agg(F.count("*").alias("weight")), "pattern_id")


def _in_blocks(patterns: DataFrame, block: int) -> DataFrame:
    """``block, cols``: the patterns in rows of at most ``block``."""
    number = F.floor(F.col("pattern_id") / block).alias("block")
    return saved(patterns.groupBy(number).agg(F.collect_list(F.struct("bases", "weight")).alias("cols")), "pattern-blocks")


def _bases(cols: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Codes by taxon and pattern, and weights."""
    bases = cols.values.field("bases").flatten().to_numpy(zero_copy_only=False).reshape(len(cols.values), -1)
    return bases.T.astype(np.int64), cols.values.field("weight").to_numpy(zero_copy_only=False).astype(float)


def _edges(trees: pa.Table, taxa: int) -> tuple[Edges, np.ndarray]:
    splits, leaves = trees.column("splits").combine_chunks(), trees.column("leaves").combine_chunks()
    return A.edges(splits, taxa), A.leaves(leaves, taxa, np.nan)


def log_likelihoods(parsed: DataFrame, patterns: DataFrame, model: L.Model | None = None, block: int = BLOCK, together: int = TREES) -> DataFrame:
    """Parsed trees with ``lnl``. Nodes of more than two children are allowed.

    Trees are dealt out about ``together`` to a group by a hash (more beyond GROUPS groups, and then worked out TREES at a time), patterns are rows of ``block`` at most, and each group of
    trees meets each block in a task of its own; a tree's sums over several blocks are added by one shuffle of a number for
    each. Nothing of the alignment comes to the driver. Without patterns lnl is 0. Trees that are null are left out.
    """
    model, parsed = model or L.Model(), saved(parsed.where("splits is not null"), "parsed")
    blocks = _in_blocks(patterns, block)
    groups, numbers = _groups(parsed.count(), together, MOST_TREES), [r.block for r in blocks.select("block").collect()]
    if not numbers:
        return parsed.withColumn("lnl", F.lit(0.0))
    whole, names = len(numbers) == 1, parsed.columns
    kept = names if whole else ["sample", "tree_id"]

    def score(trees: pa.Table, block: pa.Table) -> pa.Table:
        bases, weights = _bases(block.column("cols")[0])
        edges, leaves = _edges(trees, len(bases))
        lnl = np.zeros(trees.num_rows)
        for lo, hi in A.chunks(np.maximum((np.diff(edges.bounds) + leaves.shape[1]) ** 2, 2_000_000 // TREES), 2_000_000):
            lnl[lo:hi] = L.log_likelihoods(L.shapes(edges.of(np.arange(lo, hi)), leaves[lo:hi]), bases, weights, model)
        return pa.table([*(trees.column(c) for c in kept), pa.array(lnl)], names=[*kept, "lnl"])

    group = F.pmod(F.xxhash64("sample", "tree_id", F.lit(3)), F.lit(groups)).cast("int")
    dealt = parsed.select(*kept, *(c for c in ("splits", "leaves") if c not in kept), group.alias("_group"), F.explode(F.lit(numbers).cast("array<bigint>")).alias("_block"))
    spread = blocks.select("cols", F.col("block").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"))
    kinds = ", ".join(f"`{c}` {parsed.schema[c].dataType.simpleString()}" for c in kept)
    scored = dealt.groupBy("_group", "_block").cogroup(spread.groupBy("_group", "_block"))
    parts = scored.applyInArrow(score, f"{kinds}, lnl double")
    if whole:
        return parts
    return parsed.join(parts.groupBy("sample", "tree_id").agg(F.sum("lnl").alias("lnl")).hint("merge"), ["sample", "tree_id"])


def optimize(parsed: DataFrame, patterns: DataFrame, taxa: int, method: str = "newton", model: L.Model | None = None, together: int = 4, **options) -> DataFrame:
    """Trees with bettered branch lengths and ``lnl_before, lnl``. Each tree costs far more than its row, so about
    ``together`` trees (more beyond GROUPS groups) are dealt to a group, which meets all blocks of patterns; each step adds up their sums. Trees that are
    null are left out."""
    model, parsed = model or L.Model(), saved(parsed.where("splits is not null"), "to-better")
    blocks = _in_blocks(patterns, BLOCK)
    groups = _groups(parsed.count(), together, TREES)
    names = [f.name for f in parsed.schema if f.name not in ("splits", "leaves", "lnl")]
    kinds = "".join(f"`{c}` {parsed.schema[c].dataType.simpleString()}, " for c in names) + f"splits {SPLITS}, leaves {LEAVES}, lnl_before double, lnl double"

    def better(trees: pa.Table, cols: pa.Table) -> pa.Table:
        found = [_bases(x) for x in cols.column("cols")]
        bases, weights = [f[0] for f in found], [f[1] for f in found]
        edges, leaves = _edges(trees, taxa)
        lengths, before, after = edges.lengths.copy(), np.zeros(trees.num_rows), np.zeros(trees.num_rows)
        for k in range(trees.num_rows if found else 0):
            shape = L.shapes(edges.of(np.array([k])), leaves[k : k + 1])
            tree = L.Tree(shape, bases, weights, model)
            x = getattr(tree, method)(**options)
            before[k], after[k] = tree.log_likelihood(shape.lengths), tree.log_likelihood(x)
            own = shape.taxon >= 0
            leaves[k, shape.taxon[own]] = x[own]
            inner = np.flatnonzero(~own)[:-1]  # in order of their masks, as `order` has the tree's edges
            mine = slice(edges.bounds[k], edges.bounds[k + 1])
            order = np.lexsort((*edges.masks[mine].T, A.sizes(edges.masks[mine])))
            lengths[np.arange(edges.bounds[k], edges.bounds[k + 1])[order]] = x[inner]
        there, taxon = np.nonzero(~np.isnan(leaves))
        tip = A.structs(taxon_id=taxon.astype(np.int32), length=leaves[there, taxon])
        columns = [A.parsed(Edges(edges.bounds, edges.masks, lengths)), A.lists(np.searchsorted(there, np.arange(len(leaves) + 1)), tip), pa.array(before), pa.array(after)]
        return pa.table([*(trees.column(c) for c in names), *columns], names=[*names, "splits", "leaves", "lnl_before", "lnl"])

    group = F.pmod(F.xxhash64("sample", "tree_id", F.lit(3)), F.lit(groups)).cast("int")
    dealt = parsed.drop("lnl").withColumn("_group", group).repartition(min(groups, 100_000), "_group")
    spread = blocks.select("cols", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group")).repartition(min(groups, 100_000), "_group")
    return dealt.groupBy("_group").cogroup(spread.groupBy("_group")).applyInArrow(better, kinds)


def best(trees: DataFrame, n: int) -> DataFrame:
    """The n trees of highest lnl of each sample, with ``place`` from 0 in ascending order; ties by tree_id."""
    down = Window.partitionBy("sample").orderBy(F.desc("lnl"), F.desc("tree_id"))
    top = trees.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= n)
    up = Window.partitionBy("sample").orderBy("lnl", "tree_id")
    return top.withColumn("place", (F.row_number().over(up) - 1).cast("long")).drop("_r")


def ranked(trees: DataFrame) -> DataFrame:
    """All trees with ``place``, from 0, by ascending lnl within their sample; ties by tree_id. The last one is the answer."""
    return placed_in_sample(trees, ["lnl", "tree_id"], "place")


def best_every_step(trees: DataFrame, n: int, step: int) -> DataFrame:
    return best(trees, n).where(F.col("place") % step == 0)


def best_per_topology(trees: DataFrame) -> DataFrame:
    """``sample, topology, tree_id, lnl, n_trees``: the tree of highest lnl of each group, the last one on ties."""
    top = F.max(F.struct("lnl", "tree_id"))
    return trees.groupBy("sample", "topology").agg(top.alias("x"), F.count("*").alias("n_trees")).select("sample", "topology", "x.tree_id", "x.lnl", "n_trees")
