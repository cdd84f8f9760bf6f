"""Bounded-space online packing of tokenised documents into training sequences."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import saved, slices

#: Bits of a sequence id for the number within a task, and for the task; the round of merging stands above.
NUMBER_BITS, TASK_BITS = 28, 28


class Windows:
    """A fixed number of open windows: best fit, and the fullest is emitted when none fits."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.order: list[tuple[int, int]] = []  # (free, number) of the open windows
        self.held: dict[int, list] = {}
        self.n = 0

    def put(self, length: int, piece) -> tuple[int, list] | None:
        """Places a piece; returns the window (number, pieces) that had to be emitted, if any."""
        out = None
        at = bisect.bisect_left(self.order, (length, -1))
        if at == len(self.order):
            if len(self.order) == self.most:
                _, k = self.order.pop(0)
                out = k, self.held.pop(k)
            free, k = self.capacity, self.n
            self.n += 1
            self.held[k] = []
        else:
            free, k = self.order.pop(at)
        self.held[k].append(piece)
        if free == length:
            done = k, self.held.pop(k)
            assert out is None or free == self.capacity
            return done if out is None else (out, done)
        bisect.insort(self.order, (free - length, k))
        return out

    def rest(self) -> list[tuple[int, list]]:
        return [(k, self.held[k]) for _, k in self.order]


def _emitted(out) -> list[tuple[int, list]]:
    if out is None:
        return []
    return list(out) if isinstance(out[0], tuple) else [out]


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, task int, closed boolean"


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    open_windows: int = 64,
    merge_tasks: int = 16,
    merge_open: int = 8,
) -> DataFrame:
    """Pieces of documents and the sequences they fill.

    A document's ids (with ``end_id`` after them) are cut into whole sequences of ``capacity`` ids and one
    remainder. Each task keeps ``open_windows`` windows: a remainder goes to the one that it fills best, and when
    none has room the fullest is emitted. What stays open at a task's end is merged: the pieces of
    ``merge_tasks`` tasks meet in one, are packed longest first, and all but the ``merge_open`` emptiest windows
    are emitted; this is repeated until one task is left. Only open windows are moved, a bounded number per task.

    Returns ``id_col, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset``.
    A null or empty text is the end id alone. Repeated rows are packed one by one. Ties go to the window opened
    first. An empty table gives no rows. Other columns of ``docs`` are not looked at.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def rows(windows: list[tuple[int, list]], closed: bool, base: int, task: int):
        for k, pieces in windows:
            at = 0
            for doc, start, ids, doc_tokens in pieces:
                n = len(ids) // 4
                yield doc, start, n, ids, doc_tokens, base + k, at, task, closed
                at += n

    def write(found: list, schema: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*found)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        base = task << NUMBER_BITS
        coder, windows, schema = bpe.tokenizer(tokenizer_path), Windows(capacity, open_windows), None
        for whole_batch in batches:
            for batch in slices(whole_batch, "text", bpe.SLICE_BYTES):
                schema = schema or _schema(batch.schema.field("id").type)
                ids, lengths = coder.encode(batch.column("text"))
                ids = ids.astype("<u4", copy=False)
                found, at = [], 0
                for doc, n in zip(batch.column("id").to_pylist(), lengths.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4").tobytes()
                    at += n
                    total = n + 1
                    whole = total // capacity
                    for i in range(whole):
                        piece = (doc, i * capacity, own[4 * i * capacity : 4 * (i + 1) * capacity], total)
                        found += rows([(windows.n, [piece])], True, base, task)
                        windows.n += 1
                    if rest := own[4 * whole * capacity :]:
                        out = windows.put(len(rest) // 4, (doc, whole * capacity, rest, total))
                        found += rows(_emitted(out), True, base, task)
                    if len(found) >= 2000:
                        yield write(found, schema)
                        found = []
                yield write(found, schema)
        if schema:
            yield write(list(rows(windows.rest(), False, base, task)), schema)

    def merger(base_level: int, most: int):
        def merge(key, pdf):
            task = int(key[0])
            pdf = pdf.sort_values(["length", "id", "start", "sequence_id", "offset"], ascending=[False, True, True, True, True])
            windows = Windows(capacity, len(pdf) + 1)
            full = []
            for p in zip(pdf["id"], pdf["start"], pdf["ids"], pdf["doc_tokens"]):
                full += _emitted(windows.put(len(p[2]) // 4, p))
            rest = windows.rest()
            cut = max(0, len(rest) - most)
            base = base_level | task << NUMBER_BITS
            found = [*rows(full + rest[:cut], True, base, task), *rows(rest[cut:], False, base, task)]
            return type(pdf)(found, columns=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "task", "closed"])

        return merge

    first = saved(source.mapInArrow(pack, f"id {id_type}, {SCHEMA}"), "packed")
    done, open_, level = [first.where("closed")], first.where("not closed"), 1
    last = open_.agg(F.max("task")).first()[0]
    tasks = -1 if last is None else last + 1
    while tasks > 0:
        tasks = -(-tasks // merge_tasks)
        merge = merger(level << (NUMBER_BITS + TASK_BITS), merge_open if tasks > 1 else 0)
        merged = saved(
            open_.groupBy((F.col("task") / merge_tasks).cast("int").alias("to")).applyInPandas(merge, first.schema), "merged"
        )
        done.append(merged.where("closed"))
        if tasks == 1:
            break
        open_, level = merged.where("not closed"), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out.select(F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def _schema(id_type: pa.DataType) -> pa.Schema:
    long = pa.int64()
    return pa.schema(
        [("id", id_type), ("start", long), ("length", long), ("ids", pa.binary()), ("doc_tokens", long)]
        + [("sequence_id", long), ("offset", long), ("task", pa.int32()), ("closed", pa.bool_())]
    )
