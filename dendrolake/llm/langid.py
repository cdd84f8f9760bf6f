"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

#: n-grams of a profile, of a language or of a document.
PROFILE = 400
#: Distinct n-grams that a task counts before it sends them on.
HELD = 400_000


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of one to three characters as 63-bit keys (21 bits a character), and their counts.

    Letters are lower-cased; runs of all else count as one space; n-grams lie within a word and its two spaces.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = np.where(_letters(code), code, 32)
    code = np.concatenate([[32], code, [32]])
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code = code[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = code[code != 32]
    two = code[:-1] << 21 | code[1:]
    inner = code[1:-1] != 32
    three = (code[:-2] << 42 | code[1:-1] << 21 | code[2:])[inner]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


_letter_table: np.ndarray | None = None


def _letters(code: np.ndarray) -> np.ndarray:
    global _letter_table
    if _letter_table is None:
        _letter_table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter_table[code]


def top(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent keys, first the most frequent; ties by key."""
    return keys[np.lexsort((keys, -counts))[:most]]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = PROFILE) -> dict[str, np.ndarray]:
    """A profile for each language: its most frequent n-grams over all rows whose text and language are not null.

    Only the profiles come to the driver: ``most`` keys for each language. Equal counts go by key. Repeated rows count as
    often as they come; empty texts add nothing; an empty table gives no profiles. Other columns are not used.
    """
    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                    found = gram_counts(text)
                    size += len(found[0])
                    held.setdefault(lang, []).append(found)
                    if size > HELD * 10:
                        held = {k: [merged(v)] for k, v in held.items()}
                        size = sum(len(v[0][0]) for v in held.values())
                        if size > HELD:
                            yield from out()
                            held, size = {}, 0
        yield from out()

    counted = source.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = [F.desc("n"), F.asc("gram")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(16))).orderBy(*best)
    whole = Window.partitionBy("lang").orderBy(*best)
    first = counted.withColumn("r", F.row_number().over(part)).where(F.col("r") <= most)
    found = first.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= most).collect()
    profiles: dict[str, dict[int, int]] = {}
    for row in found:
        profiles.setdefault(row.lang, {})[row.r] = row.gram
    return {k: np.array([v[r] for r in sorted(v)], np.int64) for k, v in sorted(profiles.items())}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", most: int = PROFILE) -> DataFrame:
    """``id_col, lang_pred, score`` for every row.

    The distance to a language is the sum, over a document's most frequent n-grams, of how many places the n-gram's
    rank is off in the profile, and ``most`` for one that the profile lacks. The score is the lead over the next
    language as a share of the next one's distance, from 0 (a tie) to 1. Ties go to the first language by name.
    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned. Whole texts
    are counted, however long. Repeated rows and null ids keep their rows; an empty table gives none. Other columns are
    not used.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = list(profiles)
    keys = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
    ranks = np.full((len(names), len(keys) + 1), -1, np.int64)  # the last column: not in any profile
    for i, name in enumerate(names):
        ranks[i, np.searchsorted(keys, profiles[name])] = np.arange(len(profiles[name]))

    def one(text: str | None) -> tuple[str, float]:
        grams, counts = gram_counts(text or "")
        if not len(grams) or not names:
            return "und", 0.0
        own = top(grams, counts, most)
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        at = np.where(keys[at] == own, at, len(keys))
        theirs = ranks[:, at]
        off = np.where(theirs < 0, most, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(off))
        others = np.delete(off, best)
        return names[best], float(1 - off[best] / others.min()) if len(others) and others.min() else float(len(others) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["id", "lang_pred", "score"],
            )

    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
