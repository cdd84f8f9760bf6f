"""What the training-data operators share: the shared folder, tables, and words of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the five control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a session of one process (``local``, as in tests) that names none
    is given one; on a cluster that is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        context._conf.set("spark.checkpoint.dir", named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, and lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, or longer ones, that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bucket_of_id(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts after another, dictionary-encoded, and each text's first word (with a last bound)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:  # of a copy: on a slice that was cast, ascii_lower reads the wrong bytes
        texts = pc.ascii_lower(pa.concat_arrays([texts]))
    for space in "\t\n\x0b\f\r":
        texts = pc.replace_substring(texts, space, " ")
    split = pc.split_pattern(texts, " ")
    offsets = np.asarray(split.offsets, np.int64)
    offsets, values = offsets - offsets[0], split.flatten()
    full = pc.greater(pc.binary_length(values), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return values.filter(full).dictionary_encode(), kept[offsets]


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each string."""
    h = xxhash.xxh64_intdigest
    raw = words.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    return np.fromiter(map(h, raw, repeat(seed)), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers (a finaliser of multiply and shift steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashSet:
    """A set of hashes as an array of ``bits`` / 64 words, three bits a hash. The words come to the driver: ``bits`` bounds
    their size. Queries get them by a scalar subquery, as a literal would be printed with each plan that the driver tells of.
    The set may hold hashes that were not given, more as it fills, and lacks none."""

    def __init__(self, hashes: DataFrame, bits: int = 1 << 20) -> None:
        self.bits = bits
        place = F.explode(F.array(*self._places(F.col("h")))).alias("p")
        one = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p") % 64)).alias("x")
        found = hashes.select(place).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(one).toArrow()  # no object for a word
        full = np.zeros(bits // 64, np.int64)
        full[found.column("w").to_numpy()] = found.column("x").to_numpy()
        self.row = hashes.sparkSession.createDataFrame([(full.tolist(),)], "words array<bigint>")

    @property
    def words(self) -> Column:
        """The array; within a function of array elements it must come as a column, see ``may_have``."""
        return self.row.scalar()

    def _places(self, h: Column) -> list[Column]:
        return [F.pmod(x, F.lit(self.bits)).cast("int") for x in (h, F.xxhash64(h), F.xxhash64(h, F.lit(1)))]

    def may_have(self, h: Column, words: Column | None = None) -> Column:
        """``words``: the set's array, where a subquery may not stand."""
        words = self.words if words is None else words
        found = [F.call_function("getbit", F.get(words, (p / 64).cast("int")), p % 64) == 1 for p in self._places(h)]
        return found[0] & found[1] & found[2]


class HashIndex:
    """Finds 64-bit hashes among given ones. A slot holds one of them; those that lost theirs stand in a second, sorted
    table, and the slots where that happened are marked. ``shift``: low bits that many hashes share."""

    def __init__(self, hashes: np.ndarray, shift: int = 0) -> None:
        self.h, self.shift = hashes.view(np.uint64), np.uint64(shift)
        bits = 12
        while 1 << bits < 8 * len(hashes):
            bits += 1
        self.mask = np.uint64((1 << bits) - 1)
        self.slots, self.more = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, bool)
        mine = (self.h >> self.shift & self.mask).astype(np.int64)
        own = np.arange(len(hashes))
        self.slots[mine] = own
        lost = np.flatnonzero(self.slots[mine] != own)
        self.more[mine[lost]] = True
        self.lost = lost[np.argsort(self.h[lost])]

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values that are there, in order, and where each stands among the given hashes."""
        if not len(self.h):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        value = value.view(np.uint64)
        slot = (value >> self.shift & self.mask).astype(np.int64)
        entry = self.slots[slot]
        good = self.h[entry] == value
        if len(self.lost):
            again = np.flatnonzero(self.more[slot] & ~good)
            if len(again):
                k = np.searchsorted(self.h[self.lost], value[again])
                k = self.lost[np.minimum(k, len(self.lost) - 1)]
                entry[again] = k
                good[again] = self.h[k] == value[again]
        where = np.flatnonzero(good)
        return where, entry[where]


def slices(batch: pa.RecordBatch, column: str, most: int = 16_000_000):
    """Cuts a batch into runs of rows of about so many bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)
