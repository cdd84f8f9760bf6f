"""What the byte-pair coder keeps and takes."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from dendrolake.llm import bpe

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


@pytest.mark.parametrize("file,spaced", FILES)
def test_distinct_words_leave_nothing_behind(file, spaced):
    coder = bpe.ChunkTokenizer(public_tokenizers.path(file), spaced)
    coder.encode(pa.array(["a first text"]))
    texts = pa.array([" ".join(f"w{k}x{i}" for i in range(1000)) for k in range(20)])
    tracemalloc.start()
    coder.encode(texts)
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 500_000


@pytest.mark.parametrize("file,spaced", FILES)
def test_chunks_side_by_side_are_as_alone(file, spaced):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(file))
    parts = ["", "a", "it's", "'s", "x\n", "\nx", "\n\n", "1234", "--", "é9", " ", "ж", "ab　c", "<|endoftext|>", "I'D", "\0", "a\0b", "ß", "µm", "\n!\n?"]
    rng = np.random.default_rng(3)
    texts = [*parts, *(" ".join(rng.choice(parts, n)) for n in (2, 3, 5, 8) for _ in range(60))]
    for cut in (50, 1 << 24):
        coder = bpe.ChunkTokenizer(public_tokenizers.path(file), spaced)
        ids, n = [], []
        for at in range(0, len(texts), cut):
            i, k = coder.encode(pa.array([*texts[at : at + cut], None]))
            ids.append(i), n.append(k)
            assert k[-1] == 0
        got = np.split(np.concatenate(ids), np.cumsum(np.concatenate(n))[:-1])
        got = [g.tolist() for g, end in zip(got, np.concatenate([[False] * (len(k) - 1) + [True] for k in n])) if not end]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_scored_block_takes_its_table_rows_at_once(monkeypatch):
    from dendrolake.llm import gru

    p = gru.initial(np.log(np.full(64, 1 / 64)), classes=8, per_class=8)
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 90, 40)
    ids = rng.integers(0, 63, int(sizes.sum()))
    ids[np.cumsum(sizes) - 1] = 63
    # a plain loop over each document
    table, u = gru._halved(p)
    want, at = [], 0
    for n in sizes.tolist():
        h, seen, total = np.zeros((1, u.shape[1]), np.float32), 63, 0.0
        for t in ids[at : at + n].tolist():
            h = gru._step(table[:, [seen]], u, h)[0] if seen != 63 else gru._step(table[:, [63]], u, np.zeros_like(h))[0]
            total += float(gru.log_probabilities(p, h, np.array([t]))[0][0])
            seen = t
        want.append(total)
        at += n
    calls, take = [], np.take
    monkeypatch.setattr(gru.np, "take", lambda *a, **k: calls.append(1) or take(*a, **k))
    for streams, block in ((7, 50), (512, 16384), (1, 1)):
        calls.clear()
        got = gru.score_documents(p, ids, np.cumsum(sizes), 63, streams, block)
        assert np.allclose(got, want, atol=1e-3)
        assert block < 16384 or len(calls) < 10  # not a call for each step
