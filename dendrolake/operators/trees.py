"""Operators on single trees.

A parsed tree is one row: ``splits`` holds its interior edges (a bit mask of the taxa below, 62 to a word, the number of
taxa, the length), ``leaves`` its pendant edges by taxon. A tree moves as one compact row; what needs its edges as rows
explodes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import newick as N
from .order import with_one

SPLITS = "array<struct<split:array<bigint>,size:int,length:double>>"
LEAVES = "array<struct<taxon_id:int,length:double>>"
PARSED = f"sample long, tree_id long, splits {SPLITS}, leaves {LEAVES}"


def _rows(splits: list[tuple[int, float]], taxa: int) -> list[dict]:
    return [{"split": N.words(m, taxa), "size": m.bit_count(), "length": x} for m, x in sorted(splits)]


def unpacked(row) -> tuple[list[tuple[int, float]], dict[int, float]]:
    """A row's edges as plain Python: (mask, length) and lengths by taxon."""
    return [(N.joined(list(s["split"])), s["length"]) for s in row.splits], {int(x["taxon_id"]): x["length"] for x in row.leaves}


def validate_newick(trees: DataFrame) -> DataFrame:
    """Adds ``code``: ``ok`` or what is wrong with the text."""

    @F.pandas_udf("string")
    def code(text: pd.Series) -> pd.Series:
        return text.map(N.check)

    return trees.withColumn("code", code("newick"))


def parse_newick(trees: DataFrame, labels: list[str], keep_zero: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed trees of ``sample, tree_id, newick``, with ``error`` and the columns of ``keep``; interior edges of length 0
    are left out unless kept.

    A text that is null or has no bracket, unbalanced brackets, an unknown label or a length that is no number gives a row
    with null edges and what is wrong; on good ones ``error`` is null.
    """
    bits, taxa = {name: i for i, name in enumerate(labels)}, len(labels)
    low, shifts = (1 << N.WORD) - 1, range(0, max(taxa, 1), N.WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, lengths, size, taxon, pendant, errors = [], [], [], [], [], []
            n_splits, n_leaves = [], []
            for text in batch.column("newick").to_pylist():
                try:
                    splits, leaves = N.parse(text, bits, keep_zero)
                except ValueError as wrong:
                    splits, leaves = (), {}
                    errors.append(str(wrong))
                else:
                    errors.append(None)
                for m, x in sorted(splits):
                    masks += [m >> s & low for s in shifts]
                    size.append(m.bit_count())
                    lengths.append(x)
                for t in sorted(leaves):
                    taxon.append(t)
                    pendant.append(leaves[t])
                n_splits.append(len(splits))
                n_leaves.append(len(leaves))
            bad = pa.array([e is not None for e in errors], pa.bool_())
            bounds = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * len(shifts), pa.int32()), pa.array(masks, pa.int64()))
            edges = pa.StructArray.from_arrays([words, pa.array(size, pa.int32()), pa.array(lengths, pa.float64())], ["split", "size", "length"])
            tips = pa.StructArray.from_arrays([pa.array(taxon, pa.int32()), pa.array(pendant, pa.float64())], ["taxon_id", "length"])
            columns = [pa.ListArray.from_arrays(bounds(n_splits), edges, mask=bad), pa.ListArray.from_arrays(bounds(n_leaves), tips, mask=bad), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, *(batch.column(c) for c in keep)], names=["sample", "tree_id", "splits", "leaves", "error", *keep])

    others = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in trees.select(*keep).schema)
    return trees.select("sample", "tree_id", "newick", *keep).mapInArrow(run, f"{PARSED}, error string{others}")


def print_newick(parsed: DataFrame, labels: list[str], lengths: bool = True, resolved: bool = False) -> DataFrame:
    """``newick`` text beside the other columns of parsed trees, which are one row each."""
    others = [f for f in parsed.schema if f.name not in ("splits", "leaves")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[f.name for f in others]].copy()
            texts = []
            for row in batch.itertuples():
                splits, leaves = unpacked(row)
                texts.append(N.render(N.resolve(splits, leaves) if resolved else splits, leaves, labels, lengths))
            out["newick"] = texts
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return parsed.mapInPandas(run, f"{schema}, newick string")


def to_bifurcating(parsed: DataFrame, taxa: int) -> DataFrame:
    """Resolves nodes of more than two children into ladders of clades of length 0. Batches of binary trees pass as they
    are; only other trees are turned into Python objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("splits")
            column = batch.column(at)
            short = np.flatnonzero(pc.fill_null(pc.less(pc.list_value_length(column), taxa - 2), False).to_numpy(zero_copy_only=False))
            if not len(short):
                yield batch
                continue
            some = batch.take(pa.array(short))
            rows = [
                _rows(N.resolve([(N.joined(s["split"]), s["length"]) for s in splits], {x["taxon_id"]: x["length"] for x in leaves}), taxa)
                for splits, leaves in zip(some.column(at).to_pylist(), some.column("leaves").to_pylist())
            ]
            both = pa.concat_arrays([column, pa.array(rows, column.type)])
            take = np.arange(batch.num_rows)
            take[short] = batch.num_rows + np.arange(len(short))
            columns = batch.columns
            columns[at] = both.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return parsed.mapInArrow(run, parsed.schema)


def edit_splits(parsed: DataFrame, remove: Column, add: Column) -> DataFrame:
    """Trees without the splits of ``remove`` (an array of masks) and with the edges of ``add`` (an array like ``splits``)
    that they don't have yet. An added split must not cross what is kept; that is the caller's to see to."""
    kept = F.filter("splits", lambda x: ~F.array_contains(remove, x["split"]))
    known = F.transform("_kept", lambda x: x["split"])
    new = F.filter(add, lambda x: ~F.array_contains(known, x["split"]))
    return parsed.withColumn("_kept", kept).withColumn("splits", F.concat("_kept", new)).drop("_kept")


def duplicate_splits(parsed: DataFrame) -> DataFrame:
    """``sample, tree_id, split, n``: splits that a tree has more than once."""
    return splits(parsed).groupBy("sample", "tree_id", "split").agg(F.count("*").alias("n")).where("n > 1")


def splits(parsed: DataFrame) -> DataFrame:
    """``sample, tree_id, split, size, length``: a row for each interior edge."""
    return parsed.select("sample", "tree_id", F.explode("splits").alias("x")).select("sample", "tree_id", "x.*")


def leaves(parsed: DataFrame) -> DataFrame:
    """``sample, tree_id, taxon_id, length``: a row for each leaf."""
    return parsed.select("sample", "tree_id", F.explode("leaves").alias("x")).select("sample", "tree_id", "x.*")


def _sum(array: str, value) -> Column:
    return F.aggregate(F.transform(array, value), F.lit(0.0), lambda a, x: a + x)


def tree_length() -> Column:
    return _sum("splits", lambda x: x["length"]) + _sum("leaves", lambda x: x["length"])


def norm(with_leaves: bool = True) -> Column:
    """Distance from the origin of tree space."""
    square = _sum("splits", lambda x: x["length"] * x["length"])
    return F.sqrt(square + _sum("leaves", lambda x: x["length"] * x["length"]) if with_leaves else square)


def map_lengths(parsed: DataFrame, change) -> DataFrame:
    """Changes every length by a column function."""
    return parsed.withColumn("splits", F.transform("splits", lambda x: x.withField("length", change(x["length"])))).withColumn(
        "leaves", F.transform("leaves", lambda x: x.withField("length", change(x["length"])))
    )


def clamp_zero_lengths(parsed: DataFrame, least: float = 1e-8) -> DataFrame:
    return map_lengths(parsed, lambda x: F.when(x == 0, F.lit(least)).otherwise(x))


def normalize(parsed: DataFrame) -> DataFrame:
    scaled = map_lengths(parsed.withColumn("_norm", norm()), lambda x: x / F.col("_norm"))
    return scaled.drop("_norm")


def to_multifurcating(parsed: DataFrame, least: float = 1e-5) -> DataFrame:
    return parsed.withColumn("splits", F.filter("splits", lambda x: x["length"] > least))


def full_mask(taxa: int) -> list[int]:
    return N.words((1 << taxa) - 1, taxa)


def _has(split: Column, taxon: int) -> Column:
    return F.get(split, taxon // N.WORD).bitwiseAND(F.lit(1 << taxon % N.WORD)) != 0


def _complement(split: Column, taxa: int) -> Column:
    return F.zip_with(split, F.array(*(F.lit(w).cast("bigint") for w in full_mask(taxa))), lambda a, b: a.bitwiseXOR(b))


def reroot(parsed: DataFrame, taxa: int, leaf: int | None = None) -> DataFrame:
    """Each split as its side without ``leaf`` (the last one if none is named)."""
    leaf = taxa - 1 if leaf is None else leaf

    def turned(x: Column) -> Column:
        away = _has(x["split"], leaf)
        return F.struct(
            F.when(away, _complement(x["split"], taxa)).otherwise(x["split"]).alias("split"),
            F.when(away, F.lit(taxa) - x["size"]).otherwise(x["size"]).alias("size"),
            x["length"].alias("length"),
        )

    return parsed.withColumn("splits", F.transform("splits", turned))


def clade_names(split: Column, labels: list[str]) -> Column:
    """Sorted tip names of a split."""
    tips = F.array(*(F.when(_has(split, t), F.lit(name)) for t, name in enumerate(labels)))
    return F.array_sort(F.filter(tips, lambda x: x.isNotNull()))


def relabel(parsed: DataFrame, mapping: list[int]) -> DataFrame:
    """Moves taxon t to ``mapping[t]``, with its length."""
    n_words = len(full_mask(len(mapping)))

    def moved(split: Column) -> Column:
        parts = []
        for w in range(n_words):
            bits = [F.when(_has(split, t), F.lit(1 << to % N.WORD).cast("bigint")).otherwise(0) for t, to in enumerate(mapping) if to // N.WORD == w]
            parts.append(F.aggregate(F.array(*bits), F.lit(0).cast("bigint"), lambda a, x: a + x))
        return F.array(*parts)

    to = F.array(*(F.lit(t) for t in mapping))
    return parsed.withColumn("splits", F.transform("splits", lambda x: x.withField("split", moved(x["split"])))).withColumn(
        "leaves", F.transform("leaves", lambda x: x.withField("taxon_id", F.get(to, x["taxon_id"])))
    )


def topology() -> Column:
    """A key that two trees share when they have the same splits."""
    texts = F.array_sort(F.transform("splits", lambda x: F.array_join(x["split"].cast("array<string>"), ".")))
    return F.sha2(F.array_join(F.array_distinct(texts), ","), 256)


def topology_classes(parsed: DataFrame) -> DataFrame:
    """``sample, tree_id, first, n_same``: of each tree the least tree of its sample with the same splits, and how many others
    have them. Rows grow with the trees, however many share a topology."""
    keys = parsed.select("sample", "tree_id", topology().alias("_key"))
    classes = keys.groupBy("sample", "_key").agg(F.min("tree_id").alias("first"), (F.count("*") - 1).alias("n_same"))
    return with_one(keys, classes, ["sample", "_key"]).select("sample", "tree_id", "first", "n_same")


def topology_groups(parsed: DataFrame, least: float = 1e-5) -> DataFrame:
    """``sample, first, n_trees, n_edges``: the groups of trees with the same splits once edges of up to ``least`` are dropped."""
    keyed = to_multifurcating(parsed, least).select("sample", "tree_id", topology().alias("_key"), F.size("splits").cast("long").alias("_n"))
    return keyed.groupBy("sample", "_key").agg(F.min("tree_id").alias("first"), F.count("*").alias("n_trees"), F.first("_n").alias("n_edges")).drop("_key")


def leafset_check(parsed: DataFrame) -> DataFrame:
    """Trees whose leaves differ from those of the first tree of their sample."""
    sets = parsed.select("sample", "tree_id", F.array_join(F.array_sort(F.transform("leaves", lambda x: x["taxon_id"])), ",").alias("taxa"))
    first = sets.groupBy("sample").agg(F.min_by("taxa", "tree_id").alias("first"))
    return sets.join(first, "sample").where("taxa <> first").drop("first")


def parse_attribute(text: Column) -> Column:
    """A scalar or a bracketed vector as an array of doubles."""
    return F.split(F.regexp_replace(F.trim(text), r"^\[|\]$", ""), r"\s+").cast("array<double>")


def combine_attributes(a: Column, b: Column, wa: float, wb: float) -> Column:
    """wa a + wb b; a missing one counts as zeros."""
    zeros = lambda x: F.transform(x, lambda _: F.lit(0.0))
    return F.zip_with(F.coalesce(a, zeros(b)), F.coalesce(b, zeros(a)), lambda x, y: x * wa + y * wb)


def attribute_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.coalesce(a, F.array(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x))
