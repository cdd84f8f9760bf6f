"""Sampled segmentations over the piece lattice of a SentencePiece file, and lossless decoding.

Forward filtering sums the weights of all ways to reach each place of a word; backward sampling walks from the end,
taking each piece with its share of that sum. Both run on arrays that hold the lattices of all distinct words of
a batch, and the draws depend only on the row's key, the word's number and the step.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, mix, slices

MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a literal mark in a text, so that only bytes spell it.
_LITERAL = 0x110001
SLICE_BYTES = 3_000_000
#: Characters up to which words go through the lattice side by side; longer ones go one at a time.
LONG = 64


class _Pieces:
    """The pieces of one length: ids and weights by hash."""

    def __init__(self, found: list[tuple[int, int, float]]) -> None:
        self.find = HashIndex(np.array([x[0] for x in found], np.uint64)).find
        self.ids = np.array([x[1] for x in found], np.int32)
        self.weights = np.array([x[2] for x in found])


class Lattice:
    """The pieces of a file as tables. A piece's weight is ``alpha`` times the log of one over its rank."""

    def __init__(self, path: str, alpha: float = 1.0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        self.spelled: list[bytes] = [b""] * n
        by_length: dict[int, list[tuple[int, int, float]]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b], self.spelled[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.spelled[i] = piece.replace(MARK, " ").encode()
                if MARK not in piece[1:]:  # words are cut at each space, so no other piece can be used
                    code = np.array([ord(c) for c in piece], np.uint64)
                    by_length.setdefault(len(code), []).append((int(_prefix(code)[-1]), i, -alpha * np.log1p(-sp.get_score(i))))
        self.byte_weight = -alpha * np.log(n)
        # longest first: a node's longest piece is the likeliest, so that a draw mostly ends at the first one
        self.tables = {length: _Pieces(found) for length, found in sorted(by_length.items(), reverse=True)}
        self.powers = {length: np.uint64(pow(int(_BASE), length, 1 << 64)) for length in self.tables}
        self.lengths = np.array([len(s) for s in self.spelled])
        self.flat = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])

    def _alone(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces (-1 - character) and weights of characters that are spelled in bytes."""
        literal = np.where(code == _LITERAL, ord(MARK), code).astype(np.int32)
        n_bytes = 1 + (literal > 0x7F) + (literal > 0x7FF) + (literal > 0xFFFF)
        return -1 - literal, self.byte_weight * n_bytes

    def prepare(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Forward filter over words side by side, the longest first; ``size``: their characters, the mark counted.

        Node ``level[k] + w`` stands after the k-th character of word w. For each node: its first edge; for each edge:
        its piece (or -1 - the character), its length, and the sum of the shares up to it, to 31 bits, so that no other
        word of the batch can move a draw.
        """
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        heads = np.cumsum(size - 1) - (size - 1)
        longest = int(size[0])
        count = np.searchsorted(-size, -np.arange(longest + 1), side="right")  # words of k characters or more
        level = np.concatenate([[0], np.cumsum(count)])
        prefix, alpha = [np.zeros(len(words), np.uint64)], [np.zeros(len(words))]
        degree, pieces, lengths, sums = [np.zeros(len(words), np.int32)], [], [], []
        for k in range(1, longest + 1):
            n = int(count[k])
            if k == 1:
                here = np.full(n, ord(MARK), np.uint64)
            else:
                here = code[heads[:n] + (k - 2)].astype(np.uint64)
                here[here == ord(MARK)] = _LITERAL
            prefix.append(prefix[-1][:n] * _BASE + here + np.uint64(1))
            best, found = np.full(n, -np.inf), []
            for length, table in self.tables.items():
                if length > k:
                    continue
                where, entry = table.find(prefix[k] - prefix[k - length][:n] * self.powers[length])
                ids, weight = table.ids[entry], table.weights[entry]
                if length == 1 and len(where) < n:
                    odd = np.ones(n, bool)
                    odd[where] = False
                    odd = np.flatnonzero(odd)
                    extra, extra_weight = self._alone(here[odd])
                    where, ids, weight = np.concatenate([where, odd]), np.concatenate([ids, extra]), np.concatenate([weight, extra_weight])
                if len(where):
                    t = alpha[k - length][where] + weight
                    best[where] = np.logaddexp(best[where], t)
                    found.append((length, where, ids, t))
            alpha.append(best)
            own = np.zeros(n, np.int32)
            for _, where, _, _ in found:
                own[where] += 1
            degree.append(own)
            at = np.cumsum(own) - own
            total, run = int(own.sum()), np.zeros(n)
            piece, long, upto = np.empty(total, np.int32), np.empty(total, np.uint8), np.empty(total, np.uint32)
            for length, where, ids, t in found:
                run[where] += np.exp(t - best[where])
                place = at[where]
                piece[place], long[place], upto[place] = ids, length, np.minimum(run[where] * (1 << 31), 1 << 31)
                at[where] += 1
            pieces.append(piece)
            lengths.append(long)
            sums.append(upto)
        first = np.concatenate([[0], np.cumsum(np.concatenate(degree))])
        return level, first, np.concatenate(pieces), np.concatenate(lengths), np.concatenate(sums)

    def prepare_long(self, word: str, step: int = 8192) -> tuple[np.ndarray, ...]:
        """The forward filter over one long word, character after character: first edges, pieces, lengths, sums."""
        code = np.frombuffer((MARK + word).encode("utf-32-le"), np.uint32).astype(np.uint64)
        code[1:][code[1:] == ord(MARK)] = _LITERAL
        prefix = _prefix(code)
        alpha, degree, pieces, lengths, sums = [0.0], [np.zeros(1, np.int32)], [], [], []
        for lo in range(1, len(code) + 1, step):
            hi = min(lo + step, len(code) + 1)
            ends, ids, weights, longs = [], [], [], []
            for length, table in self.tables.items():
                from_ = max(lo, length)
                where, entry = table.find(prefix[from_:hi] - prefix[from_ - length : max(hi - length, 0)] * self.powers[length]) if from_ < hi else ([], [])
                end = np.asarray(where, np.int64) + from_
                ends.append(end)
                ids.append(table.ids[entry] if len(end) else np.zeros(0, np.int32))
                weights.append(table.weights[entry] if len(end) else np.zeros(0))
                longs.append(np.full(len(end), length))
                if length == 1:
                    odd = np.setdiff1d(np.arange(lo, hi), end, assume_unique=True)
                    extra, extra_weight = self._alone(code[odd - 1])
                    for to, x in ((ends, odd), (ids, extra), (weights, extra_weight), (longs, np.ones(len(odd), np.int64))):
                        to.append(x)
            end, piece, weight, long = (np.concatenate(x) for x in (ends, ids, weights, longs))
            order = np.lexsort((-long, end))
            end, piece, weight, long = end[order], piece[order], weight[order], long[order]
            own = np.bincount(end - lo, minlength=hi - lo).astype(np.int32)
            out, at = np.empty(len(end), np.uint32), 0
            w, n = weight.tolist(), long.tolist()
            base = max(0, lo - 64)
            recent = alpha[base - lo :] if base - lo else alpha[-1:]
            for d in own.tolist():
                k = len(recent)
                ts = [recent[k - n[e]] + w[e] for e in range(at, at + d)]
                top = max(ts)
                shares = [math.exp(t - top) for t in ts]
                whole, run = sum(shares), 0.0
                for e, share in enumerate(shares):
                    run += share / whole
                    out[at + e] = min(int(run * (1 << 31)), 1 << 31)
                recent.append(top + math.log(whole))
                at += d
            alpha = recent[-64:]
            degree.append(own)
            pieces.append(piece)
            lengths.append(long.astype(np.uint8))
            sums.append(out)
        first = np.concatenate([[0], np.cumsum(np.concatenate(degree))])
        return first, np.concatenate(pieces), np.concatenate(lengths), np.concatenate(sums)

    @staticmethod
    def _pick(first, upto, node, u):
        """For each node the edge that a draw of 31 bits falls on."""
        e, last = first[node], first[node + 1] - 1
        open_ = np.flatnonzero((upto[e] <= u) & (e < last))
        while len(open_):
            e[open_] += 1
            some = e[open_]
            open_ = open_[(upto[some] <= u[open_]) & (some < last[open_])]
        return e

    def encode(self, texts: pa.Array, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all texts after another, and each text's number of ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(texts, " ")
        offsets = np.asarray(split.offsets, np.int64)
        offsets = offsets - offsets[0]
        coded = split.flatten().dictionary_encode()
        del split
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        size = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        number = np.arange(len(index)) - np.repeat(offsets[:-1], np.diff(offsets))
        salt = mix(np.repeat(keys, np.diff(offsets)) + number.astype(np.uint64) * _BASE + np.uint64(seed))
        del number
        rank = np.argsort(-size, kind="stable")
        n_long = int((size > LONG).sum())
        words = coded.dictionary.take(pa.array(rank)).to_pylist()
        place_of = np.empty(len(rank), np.int32)
        place_of[rank] = np.arange(len(rank))
        which = place_of[index]
        order = np.argsort(which, kind="stable")  # tokens of a word side by side: their draws read the same few edges
        n_tokens_long = int(np.searchsorted(which[order], n_long))
        count = np.zeros(len(index), np.int64)
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray | int]] = []  # ids, tokens, places from the token's end

        at = 0
        while at < n_tokens_long:  # long words, one at a time
            w = int(which[order[at]])
            first, piece, length, upto = self.prepare_long(words[w])
            while at < n_tokens_long and which[order[at]] == w:
                token = int(order[at])
                u = (mix(salt[token] + (np.arange(1, size[rank[w]] + 1).astype(np.uint64)) * _BASE) >> np.uint64(33)).astype(np.uint32)
                node, edges = int(size[rank[w]]), []
                while node:
                    e, last = int(first[node]), int(first[node + 1]) - 1
                    while e < last and upto[e] <= u[len(edges)]:
                        e += 1
                    edges.append(e)
                    node -= int(length[e])
                taken.append((piece[edges], np.full(len(edges), token), np.arange(len(edges))))
                count[token] = len(edges)
                at += 1
        if n_long < len(words):
            level, first, piece, length, upto = self.prepare(words[n_long:], size[rank[n_long:]])
            active = order[n_tokens_long:]
            word = which[active] - n_long
            left = size[rank][which[active]]
            step = 0
            while len(active):
                u = (mix(salt[active] + np.uint64((step + 1) * int(_BASE) % (1 << 64))) >> np.uint64(33)).astype(np.uint32)
                e = self._pick(first, upto, level[left] + word, u)
                taken.append((piece[e], active, step))
                count[active] += 1
                left = left - length[e]
                go = left > 0
                active, word, left = active[go], word[go], left[go]
                step += 1
        place = np.cumsum(count)
        ids = np.empty(int(place[-1]) if len(place) else 0, np.int32)
        for x, t, k in taken:
            ids[place[t] - 1 - k] = x  # the first draw is the word's last piece
        per_text = np.add.reduceat(count, offsets[:-1]) if len(count) else count
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            kinds, kind = np.unique(ids[odd], return_inverse=True)
            spelled = [self.byte_ids[list(chr(-1 - c).encode())] for c in kinds.tolist()]
            long = np.array([len(s) for s in spelled])
            n = np.ones(len(ids), np.int64)
            n[odd] = long[kind]
            ends = np.cumsum(n)
            out = np.repeat(ids, n)
            flat, begin, own = np.concatenate(spelled), np.cumsum(long) - long, long[kind]
            out[np.repeat(ids < 0, n)] = flat[np.repeat(begin[kind] - np.cumsum(own) + own, own) + np.arange(own.sum())]
            bounds = np.cumsum(per_text)
            return out.astype(np.uint32), np.diff(np.concatenate([[0], np.where(bounds > 0, ends[bounds - 1], 0)]))
        return ids.astype(np.uint32), per_text

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes: pieces and bytes side by side, without the space before the first word."""
        size = self.lengths[ids]
        at = np.repeat(self.first[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.flat[at].tobytes()[1:]


def _prefix(code: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes modulo 2^64: value k is that of the first k characters."""
    out = np.zeros(len(code) + 1, np.uint64)
    step = 1024
    powers = np.ones(step + 1, np.uint64)
    np.multiply.accumulate(np.full(step, _BASE, np.uint64), out=powers[1:])
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    back = np.ones(step + 1, np.uint64)
    np.multiply.accumulate(np.full(step, inverse, np.uint64), out=back[1:])
    for i in range(0, len(code), step):
        part = code[i : i + step] + np.uint64(1)
        n = len(part)
        # h(k) = B h(k-1) + x: in units of B^k a running sum
        out[i + 1 : i + n + 1] = (out[i] + np.cumsum(part * back[1 : n + 1], dtype=np.uint64)) * powers[1 : n + 1]
    return out


_loaded: dict[tuple[str, float], Lattice] = {}


def lattice(path: str, alpha: float) -> Lattice:
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Lattice(path, alpha)
    return _loaded[path, alpha]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.select("id", F.xxhash64("text").alias("text_key"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), "text")


def _sampled(own: Lattice, batch: pa.RecordBatch, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch's texts (little-endian unsigned 32-bit) and the bounds of each text's ids."""
    keys = np.array([xxhash.xxh64_intdigest(k, seed) for k in batch.column("name").to_pylist()], np.uint64)
    ids, sizes = own.encode(batch.column("text"), keys, seed)
    return ids.astype("<u4"), np.concatenate([[0], np.cumsum(sizes)])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """``id_col, text_key`` (hash of the text) and ``ids`` (little-endian unsigned 32-bit) of every row.

    The same row key, text and seed give the same ids, however rows are dealt to tasks. Words are cut at each space;
    a character without a piece is spelled in bytes. A null text counts as empty, and an empty text is one piece
    (or bytes) for its mark. A null id is a key of its own. Repeated rows get the same ids. An empty table gives no
    rows. Other columns, of whatever name, are not used.
    """
    source = _source(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model_path, alpha)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                ids, bounds = _sampled(own, batch, seed)
                values = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), values.cast(pa.binary())], names=["id", "text_key", "ids"])

    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text_key long, ids binary")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded", alpha: float = 1.0) -> DataFrame:
    """Adds the text that the ids spell; null ids give a null text. A column of that name is replaced, all others stay."""
    encoded = encoded.drop(text_col)
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model_path, alpha)
        for whole in batches:
            for batch in slices(whole, ids_col, SLICE_BYTES):
                texts = [own.decode(np.frombuffer(x, "<u4")).decode("utf-8") if x is not None else None for x in batch.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, text_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, `{text_col}` string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """``id_col, n_pieces, ids_crc32, lossless`` of every row: ``encode`` and ``decode`` in one pass, so that neither ids
    nor texts leave the task. ``lossless``: the ids spell the text, byte for byte. Odd inputs are treated as there."""
    source = _source(docs, id_col, text_col).drop("text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model_path, alpha)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                ids, bounds = _sampled(own, batch, seed)
                text = batch.column("text").cast(pa.large_binary())
                start, crc, same = bounds.tolist(), [], []
                for i, x in enumerate(text):
                    part = ids[start[i] : start[i + 1]]
                    crc.append(zlib.crc32(part))
                    same.append(own.decode(part) == x.as_py())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array(same)], names=["id", "n_pieces", "ids_crc32", "lossless"])

    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, lossless boolean")
    return out.withColumnRenamed("id", id_col)
