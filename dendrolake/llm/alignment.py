"""Alignment of two tokenizers over the bytes of a text: groups of tokens that end together, and how often ids do so."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import slices

#: Text bytes that are aligned together.
SLICE_BYTES = 4_000_000
MARK = "▁"
#: A byte's label: no token ends there, one of A, one of B, one of each.
LABELS = b"-ab+"
#: A span of bytes up to one where both end.
SPAN = re.compile(rb"[^+]*\+")


class PieceTokenizer(bpe.ChunkTokenizer):
    """Encodes Arrow string columns by a SentencePiece file that keeps white space and adds a space. No piece holds a space
    after another character, so that the pieces of a text are those of its words in order; a text with two spaces in a
    row, or one at an end, is encoded whole."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spaced, self.lead, self.prefix = False, False, ""
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.parted = not any(a != MARK and b == MARK for n in names for a, b in zip(n, n[1:]))
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _dirty(self, chunks: list[str]) -> list[bool]:
        return [not c or not self.parted for c in chunks]

    def _plain(self, text: str) -> list[int]:
        return self.pieces.encode(text)

    def _coded(self, chunks: pa.Array) -> pa.ListArray:
        if len(self.known) > bpe.CACHE_CHUNKS:
            self._reset()
        words = chunks.to_pylist()
        new = [w for w in words if w not in self.known]
        if new:
            found = self.pieces.encode(new, num_threads=1)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in found])])
        row = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return pa.ListArray.from_arrays(pa.array(self.starts.astype(np.int32)), pa.array(self.ids)).take(pa.array(row))


class Vocabulary:
    """The bytes that each id spells, and an id as text with what may follow it in a list of groups."""

    def __init__(self, spelled: list[bytes], ends: str) -> None:
        self.size, self.spelled = len(spelled), np.array([*spelled, None], object)[:-1]
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.written = np.array([f"{i}{mark}" for i in range(len(spelled)) for mark in ends], object)


@cache
def tokenizers(a_path: str, b_path: str) -> tuple[bpe.ChunkTokenizer, PieceTokenizer, Vocabulary, Vocabulary]:
    """Both tokenizers and their vocabularies; loaded once in a process."""
    a, b = bpe.tokenizer(a_path, True, True, False), PieceTokenizer(b_path)
    letters = {c: k for k, c in bpe.byte_letters().items()}
    names = [a.tokenizer.id_to_token(i) or "" for i in range(a.tokenizer.get_vocab_size())]
    of_a = [bytes(letters[c] for c in n) if all(c in letters for c in n) else b"" for n in names]
    sp = b.pieces
    of_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.get_piece_size())]
    return a, b, Vocabulary(of_a, ",|"), Vocabulary(of_b, ",;")


def _spelled(ids: np.ndarray, lengths: np.ndarray, words: Vocabulary, wanted: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Of the texts that are wanted, those whose ids spell them."""
    ends = np.cumsum(lengths)
    pieces = words.spelled[ids].tolist()
    good = wanted.copy()
    for k in np.flatnonzero(wanted).tolist():
        good[k] = b"".join(pieces[ends[k] - lengths[k] : ends[k]]) == texts[k]
    return good


def align_batch(texts: pa.Array, a_path: str, b_path: str) -> dict[str, pa.Array]:
    """Columns of ``align`` for an array of texts."""
    a, b, words_a, words_b = tokenizers(a_path, b_path)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n = len(texts)
    raw = [b" " + t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    (ids_a, n_a), (ids_b, n_b) = a.encode(texts), b.encode(texts)
    good = _spelled(ids_b, n_b, words_b, _spelled(ids_a, n_a, words_a, full, raw), raw)
    ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
    n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)

    # labels of all bytes of the texts after another; a text ends with both, so that no span goes beyond it
    end_a, end_b = np.cumsum(words_a.lengths[ids_a]), np.cumsum(words_b.lengths[ids_b])
    label = np.zeros(int(end_a[-1]) if len(end_a) else 0, np.uint8)
    label[end_a - 1] += 1
    label[end_b - 1] += 2
    spans = np.fromiter((m.end() for m in SPAN.finditer(np.frombuffer(LABELS, np.uint8)[label].tobytes())), np.int64)
    upto_a, upto_b = (np.cumsum(label & bit > 0)[spans - 1] for bit in (1, 2))  # tokens up to each span's end
    in_a, in_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)

    # each group's ids as text: those of A, then those of B
    group_a, group_b = np.repeat(np.arange(len(spans)), in_a), np.repeat(np.arange(len(spans)), in_b)
    last_a, last_b = upto_a - 1, upto_b - 1
    shown = np.empty(len(ids_a) + len(ids_b), object)
    flag_a, flag_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    flag_a[last_a], flag_b[last_b] = 1, 1
    shown[np.arange(len(ids_a)) + (upto_b - in_b)[group_a]] = words_a.written[ids_a.astype(np.int64) * 2 + flag_a]
    shown[np.arange(len(ids_b)) + upto_a[group_b]] = words_b.written[ids_b.astype(np.int64) * 2 + flag_b]
    shown = shown.tolist()

    # linked ids of each text, once each, and how often
    owner = np.searchsorted(np.cumsum(n_a), last_a, "right")
    pair = ids_a[last_a].astype(np.int64) * words_b.size + ids_b[last_b]
    order = np.lexsort((pair, owner))
    owner, pair = owner[order], pair[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])])) if len(pair) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(pair)))
    bounds = pa.array(np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32))
    ends = np.cumsum(n_a + n_b)
    groups = ["".join(shown[e - k : e])[:-1] if k else "" for e, k in zip(ends.tolist(), (n_a + n_b).tolist())]
    return {
        "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(np.bincount(owner, minlength=n).astype(np.int64)), "groups": pa.array(groups, pa.string()),
        "pairs": pa.ListArray.from_arrays(bounds, pa.array(pair[first])), "times": pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32))),
    }


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_a, n_b, n_groups, groups, pairs, times`` of every row.

    A space and the text are encoded by A (a byte-level file of ``tokenizers``) and B (a SentencePiece file, which adds the
    space itself). Each byte has a label: whether a token of A, of B or of each ends there. A span up to the next byte
    where both end is a group; ``groups`` lists each as ids of A, a bar, ids of B. The last tokens of a group are linked:
    ``pairs`` has each linked pair of ids once (id of A times the size of B's vocabulary, plus id of B), ``times`` how
    often.

    A text that is null or empty, or that the ids of A or B do not spell byte for byte, has no tokens. Repeated rows and
    null ids each get their row; an empty table gives no rows. Other columns, of whatever name, are not used.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                found = align_batch(batch.column("text"), a_path, b_path)
                yield pa.RecordBatch.from_arrays([batch.column("id"), *found.values()], names=["id", *found])

    kinds = f"id {source.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>"
    return source.mapInArrow(run, kinds).withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: how many links of all rows hold each pair of ids."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    return each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))


def most_pairs(a_path: str, b_path: str) -> int:
    """Pairs of ids that can be linked at all: of two tokens that end together the bytes of one end with those of the other."""
    *_, words_a, words_b = tokenizers(a_path, b_path)
    total = 0
    for longer, other, whole in ((words_a, words_b, True), (words_b, words_a, False)):
        known: dict[bytes, int] = {}
        for s in other.spelled.tolist():
            known[s] = known.get(s, 0) + 1
        for s in longer.spelled.tolist():
            total += sum(known.get(s[k:], 0) for k in range(0 if whole else 1, len(s)))
    return total


def with_counts(aligned: DataFrame, counts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``aligned`` with ``n_best`` (links whose pair has the highest count of all pairs of its id of B, ties included) and
    ``count_sum`` (the counts of all its links) in place of ``pairs`` and ``times``.

    The table of counts is sent to all tasks: its rows are bounded by the two vocabularies (``most_pairs``), whatever the
    corpus; more than that is an error.
    """
    spark, size = aligned.sparkSession, tokenizers(a_path, b_path)[3].size
    most = most_pairs(a_path, b_path)
    found = counts.limit(most + 1).toPandas()
    if len(found) > most:
        raise ValueError(f"over {most} linked pairs of ids: the counts are of other tokenizers")
    found = found.sort_values("pair")
    pair, n = found["pair"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    top = np.zeros(size, np.int64)
    np.maximum.at(top, pair % size, n)
    shared = spark.sparkContext.broadcast((pair, n, n == top[pair % size]))
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            links, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            bounds = np.asarray(links.offsets, np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            at = np.searchsorted(pair, links.flatten().to_numpy())
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], owner, times * best[at])
            np.add.at(sums[1], owner, times * n[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, sums)], names=[*kept, "n_best", "count_sum"])

    kinds = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept)
    return aligned.mapInArrow(run, f"{kinds}, n_best long, count_sum long")
