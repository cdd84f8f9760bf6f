"""Winnowed fingerprints: rolling hashes of a text's runs of characters, of which each window keeps its smallest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, saved, slices

#: Characters of a gram and grams of a window: two texts that share GRAM + WINDOW - 1 characters share a fingerprint.
GRAM, WINDOW = 16, 33
#: Windows that are gone through at a time in a long text.
SEGMENT = 1 << 18
#: Rows of a block, about, and blocks at most: a block's last row comes to the next block as well.
BLOCK_ROWS, MOST_BLOCKS = 2048, 20_000
#: Text bytes that are turned into strings at a time.
SLICE_BYTES = 4_000_000
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    steps = np.full((2, n), 1, np.uint64)
    steps[0, 1:], steps[1, 1:] = _BASE, pow(_BASE, -1, 1 << 64)
    up, down = np.multiply.accumulate(steps, axis=1)
    return up, down


def rolling(codes: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hashes of all runs of ``gram`` code points: differences of one running sum, so that each costs the same."""
    up, down = _powers(SEGMENT + 1024 if len(codes) < SEGMENT + 1024 else len(codes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])])
    h = (sums[gram:] - sums[:-gram]) * down[: len(codes) - gram + 1]
    return (mix(h) >> np.uint64(32)).astype(np.uint32)


def rightmost_minima(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window, the rightmost on ties; each place once. Windows grow by doubling."""
    at, low, width = np.arange(len(h)), h, 1
    while width < window:
        step = min(width, window - width)
        at = np.where(low[step:] <= low[:-step], at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        width += step
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places (code points) and hashes of the grams that the text's windows keep, by place.

    A text of fewer grams than a window is one window, one of fewer characters than a gram is one gram; an empty text
    keeps none. Long texts are gone through in segments whose windows overlap: the same grams.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    gram = min(gram, len(codes))
    grams = len(codes) - gram + 1
    window = min(window, grams)
    places, hashes = [], []
    for low in range(0, grams - window + 1, SEGMENT):
        high = min(low + SEGMENT, grams - window + 1)
        h = rolling(codes[low : high + window + gram - 2], gram)
        at = rightmost_minima(h, window)
        places.append(low + at)
        hashes.append(h[at])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def written(place: np.ndarray, hashes: np.ndarray, window: int = WINDOW) -> str:
    """For each gram kept, eight hex digits of its hash and, in as many as ``window`` needs, its distance from the one before
    (the first: its place)."""
    digits = 2 * -(-window.bit_length() // 8)
    gaps = np.diff(place, prepend=0).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - digits // 2 :]
    return np.concatenate([hashes.astype(">u4").view(np.uint8).reshape(-1, 4), gaps], axis=1).tobytes().hex()


def read(fingerprint: str, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a fingerprint as ``written``."""
    extra = -(-window.bit_length() // 8)
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 4 + extra)
    gaps = np.pad(raw[:, 4:], ((0, 0), (8 - extra, 0)))
    return np.cumsum(np.ascontiguousarray(gaps).view(">u8").ravel().astype(np.int64)), np.ascontiguousarray(raw[:, :4]).view(">u4").ravel().astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets of hashes; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = np.unique(a), np.unique(b)
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``id_col, places array<long>, hashes array<long>``: the grams that each row's text keeps.

    Two texts with a common run of ``gram + window - 1`` characters have a common hash, and the places say where. A null
    or empty text keeps none. Repeated rows and null ids each get their row; an empty table gives no rows. Other
    columns, of whatever name, are not used.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                found = [winnow(t or "", gram, window) for t in batch.column("text").to_pylist()]
                lists = [pa.array([f[k].astype(np.int64) for f in found], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=["id", "places", "hashes"])

    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, places array<long>, hashes array<long>")
    return out.withColumnRenamed("id", id_col)


def _in_blocks(docs: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """``id, text, helper, block, key``: all rows in ascending order (by id, nulls first, then a hash of the text) within
    blocks, and before each block's rows, as helpers, the last row of the block before (of the first: of the last).

    The bounds come from the ids alone, sorted by ranges: a row for each block. Each text is shuffled once.
    """
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"))
    n_blocks = min(MOST_BLOCKS, max(1, -(-source.count() // rows)))
    last = source.select("id", "key").repartitionByRange(n_blocks, "id", "key").groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("id", "key")).alias("x"))
    bounds = saved(last.agg(F.sort_array(F.collect_list("x")).alias("bounds")), "bounds")  # one row of MOST_BLOCKS keys at most
    mine, n = F.struct("id", "key"), F.size("bounds")

    def halved(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        above = F.get("bounds", middle) < mine
        return F.struct(F.when(above, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(above, acc["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(n)).cast("int") + 1)  # of as many bounds as there are, which Spark decides
    block = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), (n - 1).alias("hi")), halved)["lo"]
    placed = source.crossJoin(F.broadcast(bounds)).withColumn("block", block)
    own = F.struct("block", F.lit(False).alias("helper"))
    ends = F.when(F.get("bounds", F.col("block")) == mine, F.array(own, F.struct(F.pmod(F.col("block") + 1, n).alias("block"), F.lit(True).alias("helper"))))
    spread = placed.withColumn("to", F.explode(F.coalesce(ends, F.array(own)))).select("id", "text", "key", "to.block", "to.helper")
    return spread.repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", F.desc("helper"), "id", "key")


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id_col, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    ``edited``: the text with its last half (rounded down) replaced by the first as many characters of the next text in
    descending order of id (after the last: of the first), or by all of it if it has fewer. Fingerprints are
    ``written`` with places; ``near_*`` is the shared part of the hashes of the text and the edited or the next text.

    A null text is empty. Rows of one id come in order of a hash of the text, null ids last; repeated rows are next to
    each other. A lone row is its own next one. An empty table gives no rows. Other columns, of whatever name, are not
    used.
    """
    rows = _in_blocks(docs, id_col, text_col, block_rows)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, prints = "", None  # the row before in ascending order: the next document
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                found, own = [], []
                for k, (text, helper) in enumerate(zip(batch.column("text").to_pylist(), batch.column("helper").to_pylist())):
                    text = text or ""
                    now = winnow(text, gram, window)
                    if not helper:
                        half = len(text) // 2
                        edited = text[: len(text) - half] + before[:half]
                        then = winnow(edited, gram, window)
                        found.append((len(text), edited, written(*now, window), written(*then, window), likeness(now[1], then[1]), likeness(now[1], prints)))
                        own.append(k)
                    before, prints = text, now[1]
                if own:
                    kinds = [pa.int64(), pa.large_string(), pa.large_string(), pa.large_string(), pa.float64(), pa.float64()]
                    arrays = [pa.array(x, t).cast(pa.string() if t == pa.large_string() else t) for x, t in zip(zip(*found), kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), *arrays], names=["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kinds = f"id {id_type}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("id", "text", "helper").mapInArrow(run, kinds).withColumnRenamed("id", id_col)
