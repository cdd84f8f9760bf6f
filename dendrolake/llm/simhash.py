"""SimHash near-duplicates: fingerprints, pigeonhole blocks, exact check of the distance, groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HashSet, hash_words, mix, saved, slices, split_words
from .components import connected_components, join_by_root

#: Blocks of a fingerprint, and how many of them a join compares at once: seven blocks and up to four differing
#: bits leave at least three blocks equal, so 35 joins on 27 or 28 bits miss no pair.
BLOCKS, DISTANCE = 7, 4
#: Distinct fingerprints in a bucket up to which its pairs are compared; larger buckets go through the middle points.
PAIRWISE_BUCKET = 64


#: Near copies: fingerprints of a text's distinct words, each by hashes of its own; words of a shingle and the least
#: similarity of two texts' sets of shingles; texts of a group that a round goes through in one task, and about how many of
#: its others a task holds against them; blocks of such a fingerprint (more for more fingerprints).
SEEDS, SHINGLE, SIMILARITY, TOGETHER, DEALT, COPY_BLOCKS = 8, 5, 0.8, 200, 1000, 6
#: Text bytes whose words are taken together.
SLICE_BYTES = 4_000_000


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64 bits: one is set if it is set in over half of the XXH64 of the text's shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z, splits at ASCII space
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """``id, fp`` (the fingerprint as a signed long) of every row. Null, empty and blank texts have fingerprint zero."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                found = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of all choices of ``blocks - distance`` blocks, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    own = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(own, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bucket_links(rows: DataFrame, bucket: list[str], distance: int = DISTANCE) -> DataFrame:
    """``bucket, a, b``: links between the fingerprints of each bucket (``bucket, fp``), at most one for each. In a bucket of up to
    PAIRWISE_BUCKET they connect what pairs within ``distance`` bits connect there, and nothing else; of a larger one all
    are linked to the smallest. All fingerprints are shuffled once and pass through in order, those alone in their bucket
    too, and only links come out. No task keeps more of a bucket than a batch and PAIRWISE_BUCKET."""
    most = PAIRWISE_BUCKET
    rows = rows.select(*bucket, "fp").repartition(*bucket).sortWithinPartitions(*reversed(bucket), "fp")  # keys differ soonest

    def linked(batch: pa.RecordBatch, first: np.ndarray, crowded: bool) -> pa.RecordBatch:
        """Links of buckets; ``first``: the row where each row's bucket starts; ``crowded``: that at row 0 is a large one."""
        size = np.bincount(first, minlength=len(first))
        if crowded:
            size[0] = most + 1
        several = np.flatnonzero(size[first] > 1)
        fp, head = batch.column("fp").to_numpy(zero_copy_only=False)[several], np.searchsorted(several, first[several])
        small = size[first[several]] <= most
        us, vs, k = [], [], 1
        while len(same := np.flatnonzero((head[k:] == head[:-k]) & small[k:])):  # rows k apart of one bucket
            close = same[np.bitwise_count((fp[same] ^ fp[same + k]).view(np.uint64)) <= distance]
            us.append(close)
            vs.append(close + k)
            k += 1
        root = np.where(small, np.arange(len(fp)), head)
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            while (root[u] != root[v]).any():
                least = np.minimum(root[u], root[v])
                for end in (u, v):
                    np.minimum.at(root, root[end], least)
                root = root[root]
        own = np.flatnonzero(root != np.arange(len(fp)))
        columns = [batch.column(c).take(pa.array(several[own])) for c in bucket]
        return pa.RecordBatch.from_arrays([*columns, pa.array(fp[root[own]]), pa.array(fp[own])], names=[*bucket, "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, crowded = None, False  # the last bucket, which may go on in the next batch; of a large one its smallest
        for batch in batches:
            if left is not None:
                batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in bucket]
            new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in values], axis=0)])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            end = int(first[-1])
            if end:
                yield linked(batch.slice(0, end), first[:end], crowded)
                crowded = False
            left = batch.slice(end)
            if crowded or left.num_rows > most:
                yield linked(left, np.zeros(left.num_rows, np.int64), True)
                left, crowded = left.slice(0, 1), True
        if left is not None:
            yield linked(left, np.zeros(left.num_rows, np.int64), crowded)

    kinds = [(c, rows.schema[c].dataType.simpleString()) for c in bucket]
    return rows.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in kinds) + ", a long, b long")


def close_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, by: tuple[str, ...] = (), loose: bool = False) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that connect all pairs within ``distance`` bits; with ``by``,
    those that agree on these columns, which come first. ``loose``: they may connect others as well, as candidates do that are
    held against each other later; then all of a large bucket are linked to its smallest, and of the others each fingerprint
    to one of those that its bucket's pairs connect it with (``bucket_links``): no row for each pair, and none for each
    fingerprint that only shares a bucket, as more and more do by chance while the keys stay as long.

    Buckets of up to PAIRWISE_BUCKET fingerprints give their pairs (unless ``loose``), each checked by its distance. The
    fingerprints of larger buckets are joined through middle points instead (unless ``loose``): two within 4 bits share a point
    within 2 bits of both, and all that share a point are within 4, so a link from each to the smallest at the
    point is right and whole, and its rows grow with the fingerprints and not with their pairs.
    """
    n = fps.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while 1 << (64 * (blocks - distance) // blocks - 3) < n and blocks < 12:  # keys too short for so many
        blocks += 1
    masks = F.array(*(F.lit(m) for m in block_masks(blocks, distance)))
    spread = fps.select(*by, "fp", F.explode(F.sequence(F.lit(0), F.size(masks) - 1)).alias("c"))
    bucket = [*by, "c", "key"]
    key = F.col("fp").bitwiseAND(F.get(masks, F.col("c")))
    if loose:
        return bucket_links(spread.withColumn("key", key), bucket, distance).select(*by, "a", "b")
    keyed = saved(spread, "blocks").withColumn("key", key)
    sizes = keyed.groupBy(*bucket).agg(F.count("*").alias("n"))
    shared = saved(keyed.join(sizes.where("n > 1").hint("merge"), bucket), "buckets")
    small = shared.where(F.col("n") <= PAIRWISE_BUCKET)
    pairs = (
        small.select(*bucket, F.col("fp").alias("a"))
        .join(small.select(*bucket, F.col("fp").alias("b")).hint("merge"), bucket)
        .where(F.col("a") < F.col("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        .select(*by, "a", "b")
    )
    crowded = shared.where(F.col("n") > PAIRWISE_BUCKET).select(*by, "fp").distinct()
    flips = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))]
    one = F.array(*(F.lit(f - (1 << 64) if f >> 63 else f) for f in flips[:65]))
    # two flips: the first and a second at a higher bit or none, so that each point comes once
    points = (
        crowded.select(*by, "fp", F.posexplode(one).alias("i", "first"))
        .select(*by, "fp", "i", "first", F.posexplode(one).alias("j", "second"))
        .where("j > i or (i = 0 and j = 0)")
        .select(*by, "fp", F.col("fp").bitwiseXOR(F.col("first")).bitwiseXOR(F.col("second")).alias("point"))
    )
    heads = points.groupBy(*by, "point").agg(F.min("fp").alias("head"), F.max("fp").alias("tail")).where("head < tail")
    stars = points.join(heads.hint("merge"), [*by, "point"]).where("fp <> head").select(*by, F.col("head").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """``id_col, fingerprint`` (16 hex digits) and ``component_id``: the smallest id reachable over links.

    Texts link when their fingerprints differ in at most 4 bits. Rows of one fingerprint are one node, so copies
    cost nothing. Null, empty and blank texts have fingerprint zero and link like others. Repeated rows keep their
    rows; null ids count as no id and are never a component's name unless alone; an empty table gives no rows.
    Other columns of ``docs``, of whatever name, are not looked at.
    """
    marked = saved(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    nodes = saved(marked.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = connected_components(close_links(nodes)).withColumnRenamed("node", "fp")
    linked = saved(nodes.join(roots.hint("merge"), "fp"), "linked")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = join_by_root(linked, smallest, "fp").select("fp", "component_id")
    alone = nodes.join(roots.hint("merge"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    names = saved(named.union(alone), "names")
    return marked.join(names.hint("merge"), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def word_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = SEEDS) -> DataFrame:
    """``id, text_key`` (hash of the text) and ``fps``: for each seed the fingerprint of the text's distinct words, lower-cased
    (A-Z). Words that come often weigh no more than others, so that few but alike texts are close. Texts without a word
    have zeros."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                words, first = split_words(batch.column("text"), lower=True)
                index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
                each = np.sort(owner << 32 | index)
                each = each[np.concatenate([[True], each[1:] != each[:-1]])] if len(each) else each
                owner, index = each >> 32, each & 0xFFFFFFFF
                hashes, found = hash_words(words.dictionary, 42), np.zeros((batch.num_rows, seeds), np.int64)
                start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
                size = np.diff(np.append(start, len(owner)))
                for s in range(seeds if len(owner) else 0):
                    own = mix(hashes + np.uint64((s + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).astype(">u8").view(np.uint8).reshape(-1, 8)
                    bits = np.add.reduceat(np.unpackbits(own, axis=1)[index], start, axis=0, dtype=np.int32)
                    packed = np.packbits(2 * bits > size[:, None], axis=1)
                    found[owner[start], s] = np.ascontiguousarray(packed).view(">u8").ravel().astype(np.uint64).view(np.int64)
                fps = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, seeds), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), fps], names=["id", "text_key", "fps"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text_key long, fps array<long>")


def shingles(text: str | None, words: int = SHINGLE) -> set[int]:
    """Hashes of the text's runs of ``words`` words, lower-cased (A-Z); fewer words are one run, no words none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    return {digest(b" ".join(parts[k : k + words])) for k in range(max(1, len(parts) - words + 1))} if parts else set()


def similarity(a: set[int], b: set[int]) -> float:
    """Shared part of two sets; two empty ones are alike."""
    return len(a & b) / len(a | b) if a or b else 1.0


def shingle_groups(texts: DataFrame, words: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """``text_key, part``: parts of each ``root`` of ``texts`` (``root, text_key, text``), with all pairs of ``least`` or more
    similarity in one part each; texts that have no such pair may be left out.

    Of two sets that are so alike, the first m - ceil(least * m) + 1 of each one's m shingles share one, in any order that
    both follow: here those that come in fewest texts of the root first. Shingles of a single text are counted, and go no
    further. Rows grow with the texts' words, not with pairs. Texts without a word share a mark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                sets = [shingles(t, words) or {0} for t in batch.column("text").to_pylist()]
                values = np.concatenate([np.fromiter(s, np.uint64, len(s)) for s in sets]).view(np.int64)
                bounds = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("text_key"), lists], names=["root", "text_key", "hs"])

    sets = saved(texts.select("root", "text_key", "text").mapInArrow(run, "root long, text_key long, hs array<long>"), "shingles")
    rows = sets.select("root", "text_key", F.size("hs").alias("m"), F.explode("hs").alias("h"))
    shared = rows.groupBy("root", "h").agg(F.count("*").alias("c")).where("c > 1")
    own = rows.join(shared.hint("merge"), ["root", "h"]).groupBy("root", "text_key", "m")
    own = own.agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("hs"))
    need = F.col("m") - F.ceil(F.lit(least) * F.col("m") - 1e-9) + 1 - (F.col("m") - F.size("hs"))
    first = F.slice("hs", F.lit(1), F.greatest(need, F.lit(0)).cast("int"))
    first = saved(own.select("root", "text_key", F.explode(first).alias("x")).select("root", "text_key", "x.h"), "first-shingles")
    heads = first.groupBy("root", "h").agg(F.min("text_key").alias("a"), F.max("text_key").alias("last")).where("a < last")
    links = first.join(heads.hint("merge"), ["root", "h"]).select("a", F.col("text_key").alias("b")).distinct()
    return connected_components(links).select(F.col("node").alias("text_key"), F.col("root").alias("part"))


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = SEEDS, distance: int = DISTANCE, words: int = SHINGLE, least: float = SIMILARITY, together: int = TOGETHER
) -> DataFrame:
    """``text_key, id_col``: the distinct texts that stay, each with the smallest id it comes with.

    Candidates are groups of texts joined by fingerprints of distinct words (``seeds`` of them) that are equal or within
    ``distance`` bits, or share blocks with over PAIRWISE_BUCKET others. In the order of their ids (null last, then by text_key) the texts of a group stay or go: one goes
    if the similarity of its set of ``words``-word shingles with that of a text that stays is ``least`` or more. Groups of over
    ``together`` texts are first cut by the shingles that so alike texts must share (``shingle_groups``). In each
    round the first ``together`` texts of a group are gone through in one task, and all its others, dealt to many, are
    held against those of them that stay; this goes on until none is left, so no group is cut.

    Null, empty and blank texts are alike. Exact copies and repeated rows are one text. An empty table gives no rows.
    Other columns, of whatever name, are not used.
    """
    marked = saved(word_fingerprints(docs, id_col, text_col, seeds), "fingerprints")
    texts = marked.groupBy("text_key").agg(F.min("id").alias("id"), F.first("fps").alias("fps"))
    texts = saved(texts, "texts")
    own = saved(texts.select("text_key", F.posexplode("fps").alias("s", "fp")), "text-fingerprints")
    fps = saved(own.groupBy("s", "fp").agg(F.count("*").alias("n")), "distinct-fingerprints")
    links = saved(close_links(fps.select("s", "fp"), distance, COPY_BLOCKS, ("s",), loose=True), "links")
    number = lambda fp: F.xxhash64("s", fp)
    shared = links.select("s", F.col("a").alias("fp")).union(links.select("s", F.col("b").alias("fp"))).union(fps.where("n > 1").select("s", "fp")).distinct()
    held = own.join(shared.hint("merge"), ["s", "fp"]).select(F.xxhash64("text_key", F.lit("text")).alias("a"), number("fp").alias("b"))
    roots = connected_components(held.union(links.select(number("a").alias("a"), number("b").alias("b"))))
    named = texts.select("text_key", "id", F.xxhash64("text_key", F.lit("text")).alias("node")).join(roots.hint("merge"), "node").select("text_key", "id", "root")
    named = saved(named, "members")
    several = named.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    named = saved(join_by_root(named, several, "text_key"), "groups")

    # the texts of groups, once each; a set of fixed size passes over most others before anything is shuffled
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(text)
    likely = docs.where(HashSet(named.select(F.col("text_key").alias("h"))).may_have(key)).select(key.alias("text_key"), text.alias("text"))
    order = [F.col("id").isNull().alias("none"), F.col("id"), F.col("text_key")]
    left = named.join(likely.hint("merge"), "text_key").dropDuplicates(["text_key"]).select("root", "n", F.struct(*order).alias("at"), "text_key", "text")
    left = saved(left, "contents")
    large = left.where(F.col("n") > together)
    if not large.isEmpty():
        parts = saved(shingle_groups(large, words, least), "parts")
        sizes = parts.groupBy(F.col("part").alias("root")).agg(F.count("*").alias("n"))
        parts = join_by_root(parts.select("text_key", F.col("part").alias("root")), sizes, "text_key")
        large = large.drop("root", "n").join(parts.hint("merge"), "text_key").select("root", "n", "at", "text_key", "text")
        left = saved(left.where(F.col("n") <= together).union(large), "contents")

    def sorted_out(pdf: pd.DataFrame) -> pd.DataFrame:
        """The first texts of a group in order: which of them stay."""
        pdf, kept, stays = pdf.sort_values("place"), [], []
        for t in pdf["text"]:
            own = shingles(t, words)
            stays.append(not any(similarity(own, other) >= least for other in kept))
            if stays[-1]:
                kept.append(own)
        return pdf[["root", "text_key", "text"]].assign(stays=stays)

    def held_against(pdf: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        """Some of a group's other texts: which are like one of the first that stay."""
        kept = [shingles(t, words) for t in first["text"]]
        near = [any(similarity(own, other) >= least for other in kept) for own in (shingles(t, words) for t in pdf["text"])]
        return pdf[["root", "text_key"]].assign(near=np.array(near, bool))

    dropped = []
    while True:
        place = F.row_number().over(Window.partitionBy("root").orderBy("at"))
        heads = left.select("root", "at", "text_key").withColumn("place", place).where(F.col("place") <= together)
        heads = saved(heads.select("root", "text_key", "place"), "heads")
        first = left.select("root", "text_key", "text").join(heads.drop("root").hint("merge"), "text_key")
        first = saved(first.groupBy("root").applyInPandas(sorted_out, "root long, text_key long, text string, stays boolean"), "first")
        dropped.append(first.where("not stays").select("text_key"))
        rest = left.where(F.col("n") > together).join(heads.select("text_key").hint("merge"), "text_key", "left_anti")
        rest = saved(rest.withColumn("parts", F.ceil(F.col("n") / DEALT).cast("int")), "rest")
        if rest.isEmpty():
            break
        parts = rest.groupBy("root").agg(F.first("parts").alias("parts"))
        kept = join_by_root(first.where("stays"), parts, "text_key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        others = rest.withColumn("part", F.pmod(F.xxhash64("text_key", F.lit(2)), "parts").cast("int")).select("root", "part", "text_key", "text")
        both = others.groupBy("root", "part").cogroup(kept.select("root", "part", "text").groupBy("root", "part"))
        judged = saved(both.applyInPandas(held_against, "root long, text_key long, near boolean"), "judged")
        dropped.append(judged.where("near").select("text_key"))
        apart = judged.where("not near").select("root", "text_key")
        sizes = apart.groupBy("root").agg(F.count("*").alias("n"))
        apart = join_by_root(apart, sizes, "text_key").select("text_key", "n")
        left = saved(rest.drop("n", "parts").join(apart.hint("merge"), "text_key").select("root", "n", "at", "text_key", "text"), "contents")
    gone = dropped[0]
    for more in dropped[1:]:
        gone = gone.union(more)
    return texts.select("text_key", "id").join(saved(gone, "gone").hint("merge"), "text_key", "left_anti").withColumnRenamed("id", id_col)
