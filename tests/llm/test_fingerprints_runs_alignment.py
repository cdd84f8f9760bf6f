"""Winnowing, periodic runs and tokenizer alignment against plain versions."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dendrolake.llm import alignment, queries, runs, winnowing

RNG = np.random.default_rng(31)
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# Winnowing


def plain_hash(codes):
    value, power = 0, 1
    for c in codes:
        value = (value + (c + 1) * power) % 2**64
        power = power * 0x9E3779B97F4A7C15 % 2**64
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        value = (value ^ value >> shift) * factor % 2**64
    return (value ^ value >> 31) >> 32


def plain_winnow(text, gram, window):
    codes = [ord(c) for c in text]
    gram = min(gram, len(codes))
    h = [plain_hash(codes[i : i + gram]) for i in range(len(codes) - gram + 1)] if codes else []
    window = min(window, len(h))
    kept = {}
    for i in range(len(h) - window + 1 if h else 0):
        at = min(range(i, i + window), key=lambda j: (h[j], -j))
        kept[at] = h[at]
    return sorted(kept.items())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é😀\n", max_size=80), st.integers(1, 6), st.integers(1, 9))
def test_winnow_keeps_the_rightmost_minimum_of_each_window(text, gram, window):
    place, h = winnowing.winnow(text, gram, window)
    assert list(zip(place.tolist(), h.tolist())) == plain_winnow(text, gram, window)
    again = winnowing.read(winnowing.written(place, h, window), window)
    assert (again[0] == place).all() and (again[1] == h).all()


def test_segments_of_long_texts_change_nothing(monkeypatch):
    text = "".join(RNG.choice(list("abcde "), 5000)) + "x" * 400
    whole = winnowing.winnow(text)
    monkeypatch.setattr(winnowing, "SEGMENT", 97)
    parts = winnowing.winnow(text)
    assert all((x == y).all() for x, y in zip(whole, parts))


def test_a_shared_run_is_found_where_it_stands():
    for _ in range(60):
        shared = "".join(RNG.choice(list("abcdefgh "), winnowing.GRAM + winnowing.WINDOW - 1))
        a, b = ("".join(RNG.choice(list("qrstuvw"), int(RNG.integers(0, 300)))) for _ in range(2))
        one, two = winnowing.winnow(a + shared + b), winnowing.winnow(b + shared + a)
        there = lambda w, at: {(int(p) - at, int(h)) for p, h in zip(*w) if at <= p <= at + winnowing.WINDOW - 1}
        assert there(one, len(a)) & there(two, len(b))


ROWS = [(5, "alpha beta gamma " * 9), (None, "no id " * 30), (None, None), (3, ""), (9, None), (7, "short"), (7, "other text of one id " * 4), (2, "alpha beta gamma " * 9), (2, "alpha beta gamma " * 9), (11, "😀é" * 60)]
ROWS += [(20 + k, " ".join(RNG.choice(["stone", "river", "light", "wind"], int(RNG.integers(1, 60))))) for k in range(40)]


def plain_edits(rows, gram=winnowing.GRAM, window=winnowing.WINDOW):
    """In ascending order (ties by what is told apart there) each row's next one is the row before it."""
    out = []
    for k, (i, text) in enumerate(rows):
        nxt = rows[k - 1][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        sets = [{h for _, h in plain_winnow(t, gram, window)} for t in (text, edited, nxt)]
        near = lambda x, y: len(x & y) / len(x | y) if x or y else 1.0
        out.append((i, len(text), edited, near(sets[0], sets[1]), near(sets[0], sets[2])))
    return out


@pytest.mark.parametrize("block_rows", [1, 3, 7, 1000])
def test_edits_with_the_next_document(spark, block_rows):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    keyed = docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS k").collect()
    rows = [(r.doc_id, r.text) for r in sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.k))]
    got = winnowing.against_edits(docs, block_rows=block_rows).collect()
    show = lambda x: sorted((str(i), n, e, round(p, 9), round(q, 9)) for i, n, e, p, q in x)
    assert show((r.doc_id, r.n_chars, r.edited, r.near_edited, r.near_next) for r in got) == show(plain_edits(rows))
    for r in got:
        place, h = winnowing.read(r.fingerprint)
        assert len(place) == 0 or r.n_chars > 0
    equal = [r.fingerprint for r in got if r.doc_id in (2, 5)]
    assert len(set(equal)) == 1 and len(equal) == 3


def test_edits_of_one_row_of_none_and_of_clashing_names(spark):
    one = spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")
    r = winnowing.against_edits(one).first()
    assert (r.edited, r.near_next) == ("abcabc", 1.0)
    assert winnowing.against_edits(one.where("doc_id < 0")).count() == 0
    wide = spark.createDataFrame([(k, f"text number {k} " * 20, "x", 1, 2, 3, 4) for k in range(9)], "doc_id long, text string, id string, block int, helper int, key int, bounds int")
    assert winnowing.against_edits(wide).columns == ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert winnowing.fingerprints(wide).count() == 9


def test_op11_of_the_next_document(spark, tmp_path):
    rows = [(k, " ".join(RNG.choice(["oak", "elm", "ash", "fir"], int(RNG.integers(1, 90))))) for k in range(60)] + [(99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    want = {i: (n, hashlib.sha256(e.encode()).hexdigest(), p, q) for i, n, e, p, q in plain_edits(rows)}
    for r in queries.op11_winnowing(spark, f"file://{tmp_path}").collect():
        assert (r.n_chars, r.edited_sha256) == want[r.doc_id][:2] and (r.near_edited, r.near_next) == pytest.approx(want[r.doc_id][2:])


# Periodic runs


def plain_runs(ids, least_words=6, least_periods=4):
    n, best = len(ids), {}
    for p in range(1, n // least_periods + 1):
        i = 0
        while i + p < n:
            if ids[i] != ids[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and ids[i] == ids[i + p]:
                i += 1
            if i + p - start >= max(least_words, least_periods * p):
                best.setdefault((start, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in best.items())


def repeating(n):
    """Words with planted stretches of several periods, some within others."""
    ids = RNG.integers(0, int(RNG.choice([2, 3, 20, 1000])), n).tolist()
    for _ in range(int(RNG.integers(0, 4))):
        a, q = int(RNG.integers(0, n)), int(RNG.integers(1, 9))
        for i in range(a + q, min(n, a + q + int(RNG.integers(0, 60)))):
            ids[i] = ids[i - q]
    return ids


def test_runs_against_all_periods_and_places():
    for _ in range(1500):
        ids = repeating(int(RNG.integers(1, 90)))
        for least_words, least_periods in ((6, 4), (1, 2), (9, 3)):
            want = plain_runs(ids, least_words, least_periods)
            assert runs.find_runs(ids, least_words, least_periods) == want
            index = np.array(ids)
            found = [(a + s, n, p) for a, b in runs.suspects(index, np.array([0, len(ids)]), least_words, least_periods) for s, n, p in runs.find_runs(ids[a:b], least_words, least_periods)]
            assert found == want


def test_z_function():
    for _ in range(300):
        s = RNG.integers(0, 2, int(RNG.integers(1, 30))).tolist()
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert runs.z_function(s)[1:] == want[1:]


def test_a_hundred_thousand_equal_words():
    assert runs.find_runs([7] * 100_000) == [(0, 100_000, 1)]
    assert runs.find_runs([0, 1, 2] * 30_000) == [(0, 90_000, 3)]


def plain_op13(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    milli = 1000 * best[1] // best[2] if found else None
    return len(found), *best, milli, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_op13_against_brute_force(spark, tmp_path):
    names = np.array([f"w{k}" for k in range(1000)])
    rows = [(k, RNG.choice([" ", "\n", "  ", "\t "]).join(names[repeating(int(RNG.integers(1, 150)))])) for k in range(260)]
    rows += [(900, None), (901, ""), (902, " \n "), (903, "é é é é é é é"), (904, "a" * 5000 + " b"), (10**12, "x y " * 500)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(rows) and sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 10
    for r in got:
        assert tuple(r)[1:] == plain_op13(r.doc_id, dict(rows)[r.doc_id]), r.doc_id


def test_runs_of_odd_rows(spark):
    rows = [(None, "go go go go go go on"), (None, None), (1, "a b " * 4), (1, "a b " * 4), (2, "")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, id string")
    got = sorted(str((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in runs.periodic_runs(docs).collect())
    two = (1, 8, [(0, 8, 2)], "a b")
    assert got == sorted(map(str, [(None, 7, [(0, 6, 1)], "go on"), (None, 0, [], ""), two, two, (2, 0, [], "")]))
    assert runs.periodic_runs(docs.where("doc_id = 77")).count() == 0


# Alignment


TEXTS = [None, "", " ", "a", "Hello world, it's 42!", "  two  spaces ", "line one\nline two \n\n three\t", "naïve café — ﬁne 😀 日本語", "▁mark", "<|endoftext|> and <s> </s> <unk>", "x\x00y", "é", "word " * 300, "ab" * 4000, "a\xa0b", "under_score <0x41>"]


def plain_align(text):
    """Ids and byte ends by the libraries themselves, then a group at each common end."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: k for k, c in alignment.bpe.byte_letters().items()}
    a = t.encode(" " + text, add_special_tokens=False).ids if text else []
    b = sp.encode(text) if text else []
    of_a = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
    of_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not text or b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
        return [], [], []
    ends = lambda xs: np.cumsum([len(x) for x in xs]).tolist()
    ends_a, ends_b = ends(of_a), ends(of_b)
    groups, i, j = [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(e) + 1, ends_b.index(e) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups


def test_op12_against_the_libraries(spark, tmp_path):
    letters = list("abc  .,'1é\n") + ["the ", "ing ", "tion"]
    texts = TEXTS + ["".join(RNG.choice(letters, int(RNG.integers(1, 80)))) for _ in range(150)] + [TEXTS[4]] * 3
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    plain = {k: plain_align(t) for k, t in rows}
    count = Counter((g[0][-1], g[1][-1]) for *_, groups in plain.values() for g in groups)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    got = queries.op12_alignment(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(rows)
    for r in got:
        a, b, groups = plain[r.doc_id]
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        want = len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""
        assert tuple(r)[1:] == want, (r.doc_id, texts[r.doc_id])
    assert sum(bool(plain[k][0]) for k in range(len(TEXTS))) >= 11 and not plain[TEXTS.index("▁mark")][0]


def test_slices_and_caches_change_no_group(monkeypatch):
    texts = pa.array([t for t in TEXTS if t] * 2)
    want = {k: v.to_pylist() for k, v in alignment.align_batch(texts, A, B).items()}
    monkeypatch.setattr(alignment.bpe, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(alignment.bpe, "SLICE_BYTES", 50)
    assert {k: v.to_pylist() for k, v in alignment.align_batch(texts, A, B).items()} == want


def test_linked_pairs_are_bounded_by_the_vocabularies(spark):
    most = alignment.most_pairs(A, B)
    assert 50_000 < most < 2_000_000
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    found = alignment.align(docs, A, B)
    other = spark.range(most + 1).selectExpr("id AS pair", "1L AS n")
    with pytest.raises(ValueError):
        alignment.with_counts(found, other, A, B)


def test_alignment_of_odd_rows(spark):
    rows = [(None, "null id"), (None, None), (1, "twice"), (1, "twice")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, pairs int, id string, n_a int")
    found = alignment.align(docs, A, B)
    out = alignment.with_counts(found, alignment.pair_counts(found), A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "groups", "n_best", "count_sum"]
    got = {(r.doc_id, r.n_groups > 0): r.count_sum for r in out.collect()}
    assert out.count() == 4 and got[1, True] >= 2 and got[None, False] == 0
    nothing = alignment.align(docs.where("doc_id = 9"), A, B)
    assert alignment.with_counts(nothing, alignment.pair_counts(nothing), A, B).count() == 0
