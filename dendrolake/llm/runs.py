"""Stretches of words that repeat with a period: Main-Lorentz divide and conquer over word numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, split_words

#: Words and periods that a run has at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Text bytes whose words are numbered together.
SLICE_BYTES = 4_000_000


def z_function(s: list[int]) -> list[int]:
    """For each place, how many values from there on are those at the start."""
    n = len(s)
    z, low, high = [0] * n, 0, 0
    for i in range(1, n):
        k = 0
        if i < high:
            k = z[i - low]
            if k < high - i:
                z[i] = k
                continue
            k = high - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if k:
            low, high = i, i + k
    return z


def find_runs(ids: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period: stretches that no neighbour extends keeping their smallest
    period q, of ``least_words`` and ``least_periods`` (2 or more) times q words at least.

    A part is cut at its middle. Z-functions of the right half and of the left half from its end, each followed by what is
    held against it, give for every period how far it goes on to both sides of the middle. A repetition that goes on
    beyond the part crosses an earlier middle too, and has been found whole there. Of one stretch the smallest period
    is kept.
    """
    found: dict[tuple[int, int], int] = {}
    parts = [(0, len(ids))]
    while parts:
        lo, hi = parts.pop()
        most = (hi - lo) // least_periods
        if hi - lo < least_words or not most:
            continue
        middle = (lo + hi) // 2
        parts += [(lo, middle), (middle, hi)]
        n_left, n_right = middle - lo, hi - middle
        forward = z_function([*ids[middle:hi], -1, *ids[middle - most : hi]])
        back = ids[lo : middle + most]
        back.reverse()
        backward = z_function([*back[most:], -1, *back])
        for p in range(1, most + 1):
            # the period to the right of the middle, then to the left of it
            after, before = forward[p] if p < n_right else 0, backward[n_left + 1 + most - p]
            again, earlier = forward[n_right + 1 + most - p], backward[p] if p < n_left else 0
            least = max(least_words, least_periods * p) - p
            for start, end in ((middle - before, middle + p + after) if after + before >= least else (0, 0), (middle - p - earlier, middle + again) if again + earlier >= least else (0, 0)):
                if end and not (start == lo and lo and ids[lo - 1] == ids[lo - 1 + p]) and not (end == hi < len(ids) and ids[hi] == ids[hi - p]):
                    if found.get((start, end), p) >= p:
                        found[start, end] = p
    return sorted((start, end - start, p) for (start, end), p in found.items())


def suspects(index: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int]]:
    """Stretches of the words of several texts (``first``: where each begins, and the end) that hold all their runs, apart
    from each other and within one text each.

    In a run of period q every word but the first q comes at most q words after the same word. So for each power of two
    the stretches are taken in which all words come again so closely, if they are long enough for such a period, with as
    many words before them.
    """
    n = len(index)
    if not n:
        return []
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = owner.astype(np.int64) << 32 | index
    order = np.argsort(key, kind="stable")
    again = key[order[1:]] == key[order[:-1]]
    gap = np.full(n, n + 1, np.int64)
    gap[order[1:][again]] = (order[1:] - order[:-1])[again]
    low, high = [], []
    scale = 1
    while scale * least_periods <= int(np.diff(first).max()):
        q = 2 * scale - 1  # the longest period of this scale
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gap <= q, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        good = ends - starts >= max(least_words - q, (least_periods - 1) * scale)
        starts, ends = starts[good], ends[good]
        low.append(np.maximum(starts - q, first[owner[starts]]))
        high.append(ends)
        scale *= 2
    if not low:
        return []
    low, high = np.concatenate(low), np.concatenate(high)
    order = np.argsort(low)
    out: list[tuple[int, int]] = []
    for a, b in zip(low[order].tolist(), high[order].tolist()):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``id_col, n_words, runs`` (array of start, length, period, by start, then period; in words from 0) and ``collapsed``, the
    text's words joined by one space without those that a run holds after its first period.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``. Repeated rows and null ids each get
    their row; an empty table gives no rows. Other columns, of whatever name, are not used.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                words, first = split_words(batch.column("text"))
                index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                runs: dict[int, list[tuple[int, int, int]]] = {}
                for lo, hi in suspects(index, first, least_words, least_periods):
                    k = int(np.searchsorted(first, lo, "right")) - 1
                    at = lo - int(first[k])
                    runs.setdefault(k, []).extend((at + s, n, p) for s, n, p in find_runs(index[lo:hi].tolist(), least_words, least_periods))
                collapsed, names = [], None
                for k, text in enumerate(batch.column("text").to_pylist()):
                    if not runs.get(k):
                        collapsed.append(b" ".join((text or "").encode("utf-8", "surrogatepass").split()))
                        continue
                    names = words.dictionary if names is None else names
                    kept = np.ones(int(first[k + 1] - first[k]), bool)
                    for start, n, p in runs[k]:
                        kept[start + p : start + n] = False
                    collapsed.append(" ".join(names.take(pa.array(index[first[k] : first[k + 1]][kept])).to_pylist()).encode("utf-8", "surrogatepass"))
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in runs.get(k, [])] for k in range(batch.num_rows)]
                columns = [batch.column("id"), pa.array(np.diff(first)), pa.array(rows, run_type), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    kinds = f"id {source.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return source.mapInArrow(run, kinds).withColumnRenamed("id", id_col)
