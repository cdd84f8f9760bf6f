"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, saved
from .components import connected_components, join_by_root

#: Least number of passes; bits of a pass's sort key; vectors of a block. A vector is compared with its own block and the
#: two beside it in each pass. Measured recall is in the README.
PASSES, BITS, BLOCK = 8, 62, 512
#: Share of pairs at the threshold that may meet in no pass; the number of passes follows from it and the largest label.
MISSED = 0.001
#: Vectors of a tile: a larger group is compared tile by tile, each pair of tiles in a task of its own.
TILE = 2048


def _planes(dim: int, p: int, bits: int) -> np.ndarray:
    return np.random.default_rng([20_240_613, p, dim]).standard_normal((dim, bits))


def passes_for(n: int, cosine: float, block: int) -> int:
    """Passes after which a pair at ``cosine`` among ``n`` evenly spread vectors has shared, but for MISSED, the leading
    bits that tell blocks apart."""
    bits = max(0.0, math.log2(max(n, 1) / block))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return PASSES if same == 1 else max(PASSES, math.ceil(math.log(MISSED) / math.log(1 - same)))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    passes: int | None = None,
    block: int = BLOCK,
    tile: int = TILE,
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row.

    Rows link when their labels are equal and their cosine, in double precision, is ``cosine`` or more. Each pass
    sorts the distinct vectors of each label by the signs of random projections, read as one number, and compares
    every vector with those of its block of the order and of the next; a block gives each vector's place in the
    block's groups, never its pairs. ``passes``, if not given, grows with the vectors of the largest label.

    The passes only find the groups. Links are counted afterwards, over all pairs of each group: groups of up to
    ``tile`` vectors many to a task, larger ones cut into tiles whose pairs are tasks that return a count for each
    vector. So no link within a group is lost, however dense it is; the work grows with the square of a group's
    distinct vectors.

    Equal vectors of a label are one class: they are linked with each other and share their links, however many
    they are. Rows whose label is null, or whose vector is null, zero or has a null or non-finite component, link
    with nothing. Repeated ids count as so many vectors. An empty table gives no rows. Other columns are not used.
    """
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    # 128 bits that stand for a label and vector; a class has a number of its own
    hashes = {"h1": F.xxhash64("label", "v"), "h2": F.xxhash64("v", F.lit(7), "label")}
    source = source.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumns(hashes)
    named = source.where("usable")
    classes = named.groupBy("label", "v").agg(F.count("*").alias("size"), F.min("id").alias("least"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("key"), "label", "v", "size", "least", "h1", "h2"), "classes")

    if passes is None:
        most = classes.groupBy("label").count().agg(F.max("count")).first()[0]  # one number
        passes = passes_for(most or 0, cosine, block)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in _by_length(batch.column("v")):
                for p in range(passes):
                    signs = x @ _planes(x.shape[1], p, BITS) >= 0
                    order = signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    part = batch.take(pa.array(i))
                    key = part.column("key").to_numpy().view(np.uint64)
                    tie = mix(key + np.uint64((p + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)  # another order in each pass
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(i), p, np.int32)), part.column("label"), pa.array(order), pa.array(tie), part.column("key")],
                        names=["p", "label", "order", "tie", "key"],
                    )

    label_type = classes.schema["label"].dataType.simpleString()
    orders = classes.select("key", "label", "v").mapInArrow(keyed, f"p int, label {label_type}, order long, tie long, key long")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("p"), batch.column("key"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))],
                names=["p", "key", "part", "at"],
            )
            at += n

    by = ["p", "label", "order", "tie"]
    ranked = saved(orders.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(placed, "p int, key long, part int, at long"), "orders")
    before, starts = 0, {}
    for row in ranked.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        starts[row["part"]] = before
        before += row["count"]
    spark = vectors.sparkSession
    offsets = spark.createDataFrame(list(starts.items()), "part int, before long")
    numbered = ranked.join(F.broadcast(offsets), "part").select("p", "key", F.expr(f"(before + at) div {block}").alias("b"))
    dealt = numbered.withColumn("home", F.explode(F.array(F.col("b"), F.col("b") - 1))).join(
        classes.select("key", "label", "v").hint("merge"), "key"
    )

    def compare(key, pdf):
        pdf = pdf.sort_values("key", ignore_index=True)
        has, root = np.zeros(len(pdf), bool), np.arange(len(pdf))
        for _, i in pdf.groupby([pdf["label"], pdf["v"].map(len)]).indices.items():
            x = _unit(pdf["v"].iloc[i])
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            has[i] = near.any(axis=1)
            low = np.arange(len(i))
            while len(i):
                new = np.minimum(low, np.where(near, low[None, :], len(i)).min(axis=1))
                new = new[new]
                if (new == low).all():
                    break
                low = new
            root[i] = i[low]
        out = pdf.loc[has, ["key"]].copy()
        out["root"] = pdf["key"].to_numpy()[root[has]]
        return out

    found = saved(dealt.select("home", "p", "key", "label", "v").groupBy("home", "p").applyInPandas(compare, "key long, root long"), "found")
    roots = connected_components(found, "key", "root").select(F.col("node").alias("key"), "root")

    # the tiles of each group: one for most
    tiles = roots.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    members = join_by_root(roots, tiles, "key").join(classes.select("key", "v", "size").hint("merge"), "key")
    members = saved(members, "members")
    tasks = roots.count() // tile + 1

    def count_small(key, pdf):
        links = np.zeros(len(pdf), np.int64)
        for i in pdf.groupby("root").indices.values():
            x, sizes = _unit(pdf["v"].iloc[i]), pdf["size"].to_numpy()[i]
            links[i] = _linked(x, sizes, x, sizes, cosine)[0] - sizes
        return pd.DataFrame({"key": pdf["key"], "links": links})

    def pack(key, pdf):
        x = _unit(pdf["v"])
        held = [pdf[c].to_numpy(np.int64).tobytes() for c in ("key", "size")]
        return pd.DataFrame([[*key, *held, x.tobytes()]], columns=["root", "tiles", "t", "keys", "sizes", "x"])

    def count_large(key, pdf):
        tiles = []
        for r in pdf.sort_values("t").itertuples():
            keys = np.frombuffer(r.keys, np.int64)
            tiles.append((keys, np.frombuffer(r.x).reshape(len(keys), -1), np.frombuffer(r.sizes, np.int64)))
        (keys, x, sizes), (others, y, weights) = tiles[0], tiles[-1]
        if key[1] == key[2]:
            return pd.DataFrame({"key": keys, "links": _linked(x, sizes, x, sizes, cosine)[0] - sizes})
        if len(tiles) < 2:  # the other tile is empty
            return pd.DataFrame({"key": keys[:0], "links": sizes[:0]})
        return pd.DataFrame({"key": np.concatenate([keys, others]), "links": np.concatenate(_linked(x, sizes, y, weights, cosine))})

    bucket = F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("bucket")
    small = members.where("tiles = 1").drop("tiles").groupBy(bucket).applyInPandas(count_small, "key long, links long")
    packed = (
        members.where("tiles > 1")
        .withColumn("t", F.pmod("key", "tiles").cast("int"))
        .groupBy("root", "tiles", "t")
        .applyInPandas(pack, "root long, tiles int, t int, keys binary, sizes binary, x binary")
    )
    paired = packed.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns(
        {"one": F.least("t", "u"), "two": F.greatest("t", "u")}
    )
    counted = paired.groupBy("root", "one", "two").applyInPandas(count_large, "key long, links long")
    counts = small.union(counted).groupBy("key").agg(F.sum("links").alias("links"))
    grouped = (
        classes.select("key", "size", "least")
        .join(counts.hint("merge"), "key", "left")
        .join(roots.hint("merge"), "key", "left")
        .select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    )
    grouped = saved(grouped, "counted")
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    grouped = join_by_root(grouped, names, "key").select("key", "n_links", "component_id")
    grouped = saved(classes.select("key", "h1", "h2").join(grouped.hint("merge"), "key").drop("key"), "groups")
    # an unusable row has no class
    mine = lambda h: F.when(F.col("usable"), F.col(h)).alias(h)
    out = source.select("id", mine("h1"), mine("h2")).join(grouped.hint("merge"), ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _by_length(column: pa.Array):
    """Rows of equal vector length: their places and their vectors, row by row."""
    sizes = np.diff(np.asarray(column.offsets))
    flat, first = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    for n in np.unique(sizes):
        i = np.flatnonzero(sizes == n)
        yield i, flat[first[i][:, None] + np.arange(n)]


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def _linked(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weights: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the weights of the rows of y within reach, and for each row of y the sizes of those of x."""
    ahead, back = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    for i in range(0, len(x), 512):
        near = x[i : i + 512] @ y.T >= cosine
        ahead[i : i + 512] = near @ weights
        back += sizes[i : i + 512] @ near
    return ahead, back
