"""Token ids of whole texts, by a byte-pair tokenizer file of the ``tokenizers`` library.

A text is cut at single spaces that stand between two non-space characters. Both pre-tokenizers in use
(byte-level words with a leading space, and words with white space dropped) always cut there, so the ids
of a text are the ids of its chunks in order. Each distinct chunk of a slice is encoded once and the ids are
put back by Arrow; a text with other white space at such a place is encoded as it is. Chunks of Latin-1
letters, digits and marks are cut into words here, all in one pass, and each distinct word is merged by the
file's model; all other chunks go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks whose ids a tokenizer that keeps them has from one slice to the next. Bounds memory; never changes ids.
CACHE_CHUNKS = 500_000
#: Text bytes that are encoded at a time.
SLICE_BYTES = 16_000_000

# Letters and numbers of Latin-1, as the tokenizers' patterns see them.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: Chunks of these characters are cut here.
PLAIN = "\\A[\n\x20-\x7e\u00a1-\u00ac\u00ae-\u00ff]+\\z"
CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"
#: Words with the space before them; white space is kept. A zero character, which no such chunk holds, stands before each chunk.
SPACED = re.compile(f"\0|{CONTRACTIONS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\0\\s{LETTERS}{NUMBERS}]+|\\s+(?![^\0\\s])|\\s+")
#: Words without white space.
BARE = re.compile(f"\0|{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^\0\\s{LETTERS}{NUMBERS}]+")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(others)) for b in range(256)}


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _lists(bounds: np.ndarray, ids: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))


class ChunkTokenizer:
    """Encodes Arrow string columns. ``spaced``: the file keeps white space (else it drops it and lower-cases). ``lead``: each
    text is taken with a space before it. ``special``: strings of special tokens in a text stand for those tokens (else
    they are plain text)."""

    def __init__(self, path: str, spaced: bool = True, lead: bool = False, special: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.spaced, self.lead = spaced, lead
        self.prefix = " " if spaced else ""
        self.letters = byte_letters()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _coded(self, chunks: pa.Array) -> pa.ListArray:
        """Each chunk's ids."""
        ready = pc.match_substring_regex(chunks, PLAIN)
        for s in self.special:
            ready = pc.and_not(ready, pc.match_substring(chunks, s))
        ready = ready.to_numpy(zero_copy_only=False)
        text = "".join(["\0" + c for c in _strings(chunks.filter(pa.array(ready)))])
        words = pa.array((SPACED if self.spaced else BARE).findall(text if self.spaced else text.lower()), pa.string()).dictionary_encode()
        own = _strings(words.dictionary)[1:]  # the first is the mark
        spelled = "\0".join(own).encode().decode("latin-1").translate(self.letters).split(self.letters[0]) if own else []
        ids, ends, merge = [], [0, 0], self.tokenizer.model.tokenize
        for letters in spelled:
            ids += [t.id for t in merge(letters)]
            ends.append(len(ids))
        index = words.indices.to_numpy(zero_copy_only=False)
        marks = np.flatnonzero(index == 0)
        sizes = np.add.reduceat(np.diff(ends)[index], marks) if len(marks) else np.zeros(0, np.int64)
        flat = _lists(np.array(ends), np.array(ids, np.uint32)).take(words.indices).values
        if ready.all():
            return _lists(np.concatenate([[0], np.cumsum(sizes)]), flat)
        others = [e.ids for e in self.tokenizer.encode_batch_fast(_strings(chunks.filter(pa.array(~ready))), add_special_tokens=False)]
        flat = pa.concat_arrays([flat, pa.array([i for x in others for i in x], pa.uint32())])
        sizes = np.concatenate([sizes, [len(x) for x in others]])
        order = np.empty(len(chunks), np.int64)
        order[np.argsort(~ready, kind="stable")] = np.arange(len(chunks))
        return _lists(np.concatenate([[0], np.cumsum(sizes)]), flat).take(pa.array(order))

    @staticmethod
    def _dirty(chunks: list[str]) -> list[bool]:
        """Whether a text with this chunk must be encoded whole."""
        return [not c or c[0].isspace() or c[-1].isspace() for c in chunks]

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(texts, " ")
        offsets = np.asarray(split.offsets, np.int64)
        first, values = (offsets - offsets[0])[:-1], split.flatten()
        coded = values.dictionary_encode()
        chunks, row = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        bad = np.logical_or.reduceat(np.array(self._dirty(_strings(chunks)), bool)[row], first)
        bad &= np.diff(offsets) > 1  # a text of one chunk is encoded as it is in any case
        if self.prefix:
            spaced = pc.binary_join_element_wise(pa.scalar(self.prefix), chunks, "")
            if self.lead:
                chunks = spaced
            else:  # a text's first chunk has no space before it
                heads, at = np.unique(row[first], return_inverse=True)
                row = row.copy()
                row[first] = len(chunks) + at
                chunks = pa.concat_arrays([spaced, chunks.take(pa.array(heads))])
        lists = self._coded(chunks)
        lengths = np.add.reduceat(np.diff(np.asarray(lists.offsets))[row], first, dtype=np.int64)
        ids = lists.take(pa.array(row)).values.to_numpy()
        if bad.any():
            pieces = np.split(ids, np.cumsum(lengths)[:-1])
            for i in np.flatnonzero(bad):
                pieces[i] = np.array(self._plain(" " * self.lead + str(texts[int(i)])), np.uint32)
                lengths[i] = len(pieces[i])
            ids = np.concatenate(pieces)
        return ids, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after another (uint32) and each text's number of ids. A null counts as empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.unique(np.searchsorted(size, np.arange(SLICE_BYTES, size[-1] + SLICE_BYTES, SLICE_BYTES)) + 1)
        out, at = [], 0
        for cut in [*cuts[cuts < len(texts)].tolist(), len(texts)]:
            out.append(self._slice(texts.slice(at, cut - at)))
            at = cut
        pa.default_memory_pool().release_unused()
        if len(out) == 1:
            return out[0]
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])


_loaded: dict[tuple, ChunkTokenizer] = {}


def tokenizer(path: str, spaced: bool = True, lead: bool = False, special: bool = True) -> ChunkTokenizer:
    """The tokenizer of this worker process; loaded once."""
    key = (path, spaced, lead, special)
    if key not in _loaded:
        _loaded[key] = ChunkTokenizer(path, spaced, lead, special)
    return _loaded[key]
