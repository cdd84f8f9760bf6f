"""Token ids in fixed-width bit-packed blocks.

A token file is a folder of two Parquet tables. ``blocks`` has a row for each block: the ids of whole documents,
each id in as many bits as the largest id of the vocabulary needs, with the documents' ids and bounds beside
them, so that a block is unpacked by numpy at once and any document or id is found without reading the others.
``index`` has a row for each part: how many ids stand before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe

#: Ids after which a block ends with the document.
BLOCK_IDS = 1 << 16


def bits_for(vocabulary: int) -> int:
    """Bits that the largest id needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    """Ids side by side, ``width`` bits each, lowest bit first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if width % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_ids(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a block, without unpacking the others."""
    n = stop - start
    first = start * width // 8
    raw = np.frombuffer(payload, np.uint8, -(-stop * width // 8) - first, first)
    if width % 8 == 0:
        out = np.zeros((n, 4), np.uint8)
        out[:, : width // 8] = raw.reshape(n, width // 8)
    else:
        skip = start * width - first * 8
        bits = np.unpackbits(raw, bitorder="little")[skip : skip + n * width].reshape(n, width)
        out = np.packbits(np.pad(bits, ((0, 0), (0, 32 - width))), axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


BLOCKS = "part int, block long, start long, n_ids long, width int, bounds array<long>, payload binary"


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Writes the ids of all texts, ``end_id`` after each, in ascending order of ``id_col`` (nulls first).

    A null or empty text is the end id alone; repeated rows are all written, ordered by text; an empty table
    gives empty files. Range partitioning sorts without one task for all; only a count for each part comes to
    the driver. Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder, block, start = TaskContext.get().partitionId(), bpe.tokenizer(tokenizer_path, False), 0, 0
        width = bits_for(coder.tokenizer.get_vocab_size())
        held, names, sizes, count = [], [], [], 0
        schema = None

        def out() -> pa.RecordBatch:
            ids = np.concatenate(held)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            values = [names, part, block, start, count, width, bounds, pack_ids(ids, width)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)

        for batch in batches:
            if schema is None:
                long = pa.int64()
                schema = pa.schema(
                    [("ids", pa.list_(batch.schema.field("id").type)), ("part", pa.int32()), ("block", long), ("start", long)]
                    + [("n_ids", long), ("width", pa.int32()), ("bounds", pa.list_(long)), ("payload", pa.binary())]
                )
            ids, lengths = coder.encode(batch.column("text"))
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, np.uint32(end_id))
            at = 0
            for name, n in zip(batch.column("id").to_pylist(), (lengths + 1).tolist()):
                held.append(ids[at : at + n])
                names.append(name)
                sizes.append(n)
                at += n
                count += n
                if count >= block_ids:
                    yield out()
                    block, start = block + 1, start + count
                    held, names, sizes, count = [], [], [], 0
        if held:
            yield out()

    ordered = source.repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(encode, f"ids array<{id_type}>, {BLOCKS}").write.option("compression", "none").parquet(f"{path}/blocks")
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids")).orderBy("part").collect()
    before, index = 0, []
    for p in parts:
        index.append((p.part, before))
        before += p.n_ids
    spark.createDataFrame(index, "part int, before long").coalesce(1).write.parquet(f"{path}/index")


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """A row for each document of a token file: its id, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids`` (little-endian unsigned 32-bit)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    index = spark.read.parquet(f"{path}/index")  # a row for each part written
    placed = blocks.join(F.broadcast(index), "part").select(
        "ids", "width", "bounds", "payload", (F.col("before") + F.col("start")).alias("start")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bounds = np.asarray(batch.column("bounds")[i].values, np.int64)
                ids = unpack_ids(batch.column("payload")[i].as_py(), batch.column("width")[i].as_py(), 0, int(bounds[-1]))
                raw = pa.py_buffer(ids.astype("<u4").tobytes())
                values = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), raw])
                start = batch.column("start")[i].as_py() + bounds[:-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, pa.array(start), pa.array(np.diff(bounds)), values],
                    names=["id", "start", "n_tokens", "ids"],
                )

    out = placed.mapInArrow(decode, f"id {id_type}, start long, n_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """``start, ids`` (little-endian unsigned 32-bit): the ids at places ``first`` to ``last`` (exclusive) of a token file, a
    row for each block that holds some. Other blocks are passed over by their places, and of a block only those bits
    are unpacked. A range beyond the end, or an empty one, gives no rows."""
    index = spark.read.parquet(f"{path}/index")  # a row for each part written
    at = F.col("before") + F.col("start")
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "start", "n_ids", "width", "payload").join(F.broadcast(index), "part")
    mine = blocks.where((at < last) & (at + F.col("n_ids") > first) & F.lit(first < last)).select(at.alias("start"), "n_ids", "width", "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, n = batch.column("start")[i].as_py(), batch.column("n_ids")[i].as_py()
                a, b = max(first - start, 0), min(last - start, n)
                ids = unpack_ids(batch.column("payload")[i].as_py(), batch.column("width")[i].as_py(), a, b)
                yield pa.RecordBatch.from_arrays([pa.array([start + a]), pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=["start", "ids"])

    return mine.mapInArrow(decode, "start long, ids binary")
