"""The training-data operators against brute-force versions, exact round trips and odd inputs."""

import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from dendrolake.llm import bpe, components, embeddings, gru, langid, lm_scores, nbsvm, packing, pii, quality_rules, sampling, simhash, token_files

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(5)
VOCABULARY = ["the", "of", "river", "and", "stone", "Éclair", "über", "light", "wind", "a", "tree", "ñandú", "sky,", "end."]
LONG = " ".join(RNG.choice(VOCABULARY, 6000))
TEXTS = [None, "", "  \t\n", LONG, LONG, LONG + " tail", "one", "x" * 5000, "日本 語　テスト 🙂 end", "a  b \n c\n\na  b ", "same line here\nsame line here\nother"]
TEXTS += [" ".join(RNG.choice(VOCABULARY, int(n))) for n in RNG.integers(5, 120, 25)]
ROWS = [(k, t, "en", "src", 0) for k, t in enumerate(TEXTS)] + [(3, LONG, "en", "src", 0)]
EXTRA = "doc_id long, text string, lang string, id string, score int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, lang, "x", 1) for k, t, lang, *_ in ROWS]
    return spark.createDataFrame(rows, EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


def _ids(file, text, end):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(public_tokenizers.path(file)).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("file,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunk_tokenizer_is_the_tokenizer(file, spaced):
    texts = [*TEXTS, "x <|endoftext|> y", "it's  they'll I'D\r\n ok", "é İ ΑΣ Σ", "\x00 \x1c\x85   z", " lead", "tail "]
    ids, n = bpe.ChunkTokenizer(public_tokenizers.path(file), spaced).encode(pa.array(texts))
    for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert got.tolist() == _ids(file, t, 0)[:-1].tolist()


def test_packing_keeps_every_id_once(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack_documents(docs, path, open_windows=4).toPandas()
    sequences = out.groupby("sequence_id")
    assert sequences["length"].sum().max() <= 2048
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    copies = {}
    for doc, text, *_ in ROWS:
        copies.setdefault(doc, []).append(text)
    for doc, group in out.groupby("doc_id"):
        ids = _ids("byte_bpe_50k.json", copies[doc][0], 1)
        covered = np.zeros(len(ids), int)
        for p in group.itertuples():
            assert p.ids == ids[p.start : p.start + p.length].tobytes() and p.doc_tokens == len(ids)
            covered[p.start : p.start + p.length] += 1
        assert (covered == len(copies[doc])).all()
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("width", [1, 5, 11, 16, 17, 24])
def test_bits_round_trip(width):
    ids = RNG.integers(0, 1 << width, 1001).astype(np.uint32)
    raw = token_files.pack_ids(ids, width)
    assert len(raw) == -(-1001 * width // 8)
    for a, b in ((0, 1001), (3, 4), (500, 777), (8, 8)):
        assert (token_files.unpack_ids(raw, width, a, b) == ids[a:b]).all()


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(docs, f"file://{tmp_path}/t", path, block_ids=500)
    out = token_files.read_token_files(spark, f"file://{tmp_path}/t").orderBy("doc_id", "start").toPandas()
    at = 0
    for (doc, text, *_), row in zip(sorted(ROWS, key=lambda r: r[0]), out.itertuples()):
        ids = _ids("word_bpe_49k.json", text, 2)
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc, at, len(ids), ids.tobytes())
        at += len(ids)
    whole = b"".join(out["ids"])
    for a, b in ((0, at), (0, 1), (at - 3, at + 50), (495, 505), (1234, 3210), (7, 7), (at, at + 5)):
        found = token_files.read_range(spark, f"file://{tmp_path}/t", a, b).orderBy("start").collect()
        assert b"".join(r.ids for r in found) == whole[4 * a : 4 * min(b, at)] and (not found or found[0].start == a)
    token_files.write_token_files(empty, f"file://{tmp_path}/e", path)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def _fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(text or "")]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_against_brute_force(docs, empty):
    out = simhash.near_duplicates(docs).toPandas()
    fps = {k: _fingerprint(t) for k, t, *_ in ROWS}
    groups = _groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert len(out) == len(ROWS)
    for r in out.itertuples():
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == groups[r.doc_id]
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("most", [64, 2])
def test_close_links_miss_none(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "PAIRWISE_BUCKET", most)
    base = [int(x) for x in RNG.integers(-(2**62), 2**62, 12)]
    near = [x ^ sum(1 << int(b) for b in RNG.choice(63, int(n), replace=False)) for x in base for n in (1, 2, 3, 4, 4, 5, 6)]
    fps = sorted({*base, *near})
    links = simhash.close_links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    want = _groups(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert {x: got.get(x, x) for x in fps} == want


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 1000 for k in range(1000, 1100))


def test_embeddings_against_brute_force(spark):
    centres = RNG.standard_normal((6, 16))
    rows = [(k, [float(v) for v in centres[k % 6] + RNG.standard_normal(16) * 0.1 * (k % 4)], k % 2) for k in range(80)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [None] * 16, 0), (104, rows[0][1], None), (105, rows[0][1], 0), (106, rows[0][1], 0)]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=8, passes=12).toPandas().set_index("vec_id")
    good = {k: (np.array(v), c) for k, v, c in rows if v and c is not None and k not in (101, 102, 103)}

    def linked(a, b):
        (x, c), (y, d) = good[a], good[b]
        return c == d and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    groups = _groups(sorted(good), linked)
    total = sum(sum(linked(a, b) for b in good if b != a) for a in good)
    assert 0.9 * total <= out["n_links"].sum() <= total
    for k, row in out.iterrows():
        if k not in good:
            assert (row.n_links, row.component_id, row.kept) == (0, k, True)
        else:
            assert groups[row.component_id] == groups[k] and row.kept == (k == row.component_id)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_embeddings_count_every_link_of_a_dense_group(spark):
    rng = np.random.default_rng(3)
    centre, spread = rng.standard_normal(16), np.where(np.arange(400) % 2, 0.16, 0.1)[:, None]
    x = centre + rng.standard_normal((400, 16)) * spread
    x = np.concatenate([x, x[:20], rng.standard_normal((60, 16))])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=16, tile=64).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    assert 100 < near[:400, :400].sum(axis=1).mean() < 390  # more than the windows hold, and not all
    assert (out.sort_values("vec_id")["n_links"].to_numpy() == near.sum(axis=1) - 1).all()
    assert embeddings.passes_for(10, 0.98, 512) == 8 < embeddings.passes_for(10**8, 0.98, 512)


def _rules(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 500 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_against_brute_force(spark, docs, empty):
    more = [(200, "# * a|b " * 12, "en", "x", 1), (201, ("u v w x y z p q r s\n" * 6), "en", "x", 1)]
    table = docs.union(spark.createDataFrame(more, EXTRA))
    trusted = spark.createDataFrame([(k,) for k in range(11, 30)], "doc_id long")
    out = quality_rules.judge(table, trusted, buckets=512).toPandas()
    texts = {**{k: t for k, t, *_ in ROWS}, **{k: t for k, t, *_ in more}}
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORDS.findall(text or "")]
        pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
        return [signed(x) % 512 for x in h] + [signed(pair(a, b)) % 512 for a, b in zip(h, h[1:])]

    raw, target = np.zeros(512), np.zeros(512)
    for k, t, *_ in [*ROWS, *more]:
        np.add.at(raw, grams(t), 1)
        if 11 <= k < 30:
            np.add.at(target, grams(t), 1)
    ratio = np.log((target + 1) / (target.sum() + 512) * (raw.sum() + 512) / (raw + 1))
    assert len(out) == len(ROWS) + 2
    own = [r.ratio for r in out.itertuples() if 11 <= r.doc_id < 30 and not r.base_failed]
    cut = math.floor(min(own) * quality_rules.STEPS) / quality_rules.STEPS - quality_rules.MARGIN
    for r in out.itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _rules(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        g = grams(texts[r.doc_id])
        assert r.ratio == pytest.approx(ratio[g].mean() if g else 0.0, abs=2e-6)
        assert r.kept == (not r.base_failed and r.ratio >= cut)
    assert quality_rules.judge(empty, trusted).count() == 0
    assert quality_rules.keep_good(table, trusted, buckets=512).columns == docs.columns


def _luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def _spans(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for k, (p, good) in enumerate(
        [
            (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
            (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
            (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and _luhn(digits(s))),
            (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
        ]
    ):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text or "") if good(m[0])]
    return sorted(out)


def test_pii_against_brute_force(spark, docs, empty):
    odd = [
        "mail 🙂 a.b@c-d.example.com, b@x.y.z_d@e.f.g and +1 (386) 555-3733; 1.2.3.4.5.6.7.8 999.1.1.1 010.0.0.255",
        "4041894974608795 4041-8949 7460-8795 12345678901234 +49 30 1234567 1..2 @@ a@b a@b.c.",
        "é" * 50 + "x@y.zz" + "é" * 50 + "." * 3000 + "@",
        ("z" * 2000 + "@" + "a.") * 3,
    ]
    shared = [f"{a} Marlowe wrote jane@secret.example.org from Quayside {b} again" for a, b in zip(["pine", "quay", "rust", "sand", "tide", "urn", "vale"], ["ash", "bay", "cob", "dew", "elm", "fir", "gum"])]
    rows = [(300 + k, t, "en", "x", 1) for k, t in enumerate(odd + shared)]
    table = docs.union(spark.createDataFrame(rows, EXTRA))
    out = pii.find_spans(table).toPandas()
    texts = {**{k: t for k, t, *_ in ROWS}, **{k: t for k, t, *_ in rows}}
    assert len(out) == len(ROWS) + len(rows)
    for r in out.itertuples():
        assert [(s["s"], s["k"], s["e"]) for s in r.spans if s["k"] < 4] == _spans(texts[r.doc_id])
        terms = {s["v"] for s in r.spans if s["k"] == 4}
        assert terms == ({"marlowe", "wrote", "from", "quayside", "again"} if r.doc_id >= 304 else set())
    clean = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert "[email]" in clean[304] and "Marlowe" not in clean[304] and clean[3] == LONG and clean[0] is None
    assert pii.find_spans(empty).count() == 0 and pii.sanitise(empty).columns == empty.columns


def test_pii_terms_far_from_the_value_and_in_other_documents(spark):
    filler = lambda k: " ".join(f"{w}{k}" for w in ["alpha", "beta", "gamma"] * 60)
    texts = [f"Quayside {filler(k)} jane@secret.example.org" for k in range(9)]
    texts += [f"common words {k} of others" for k in range(1000)] + ["the QUAYSIDE, quayside and xQuayside, quayside@b.example.com", "see a@b.example.com Quayside."]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: [s["s"] for s in r.spans if s["k"] == 4] for r in pii.find_spans(table).collect()}
    assert len(out) == len(texts) and {k: v for k, v in out.items() if v} == {**{k: [0] for k in range(9)}, 1009: [4, 14], 1010: [20]}
    clean = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert clean[1009] == "the [term], [term] and xQuayside, [email]" and clean[1010] == "see [email] [term]." and clean[9] == texts[9]
    assert clean[0] == f"[term] {filler(0)} [email]"


def test_language_profiles(spark, docs, empty):
    rows = [(k, " ".join(RNG.choice(list("abcde") if k % 2 else list("vwxyz"), 60)).replace(" ", "" if k % 3 else " "), "one" if k % 2 else "two") for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.fit(table.where("doc_id < 40"))
    out = {r.doc_id: r for r in langid.predict(table, profiles).collect()}
    assert all(out[k].lang_pred == lang and 0 <= out[k].score <= 1 for k, _, lang in rows)
    odd = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame([(0, None), (1, ""), (2, "12 ?!")], "doc_id long, text string"), profiles).collect()}
    assert set(odd.values()) == {"und"}
    assert langid.fit(empty) == {} and langid.predict(docs, {}).where("lang_pred <> 'und'").count() == 0


def test_quality_classifier_on_held_out_rows(spark, empty):
    def text(good, k):
        rng = np.random.default_rng(k)
        return " ".join(rng.choice(VOCABULARY if good else ["BUY!!", "NOW!!", "the", "of", "and"], int(rng.integers(8, 60))))

    rows = [(k, text(k % 3 > 0, k), int(k % 3 > 0)) for k in range(600)]
    table = spark.createDataFrame(rows, "id long, text string, label int")
    model = nbsvm.fit(table.where("id < 400"), fit_rows=200, calibration_rows=100)
    out = nbsvm.score(table.where("id >= 400").withColumn("score", F.lit("x")), model).toPandas()
    assert ((out["score"] > 0.5) == (out["label"] == 1)).mean() > 0.97
    assert nbsvm.score(spark.createDataFrame([(1, None)], "id long, text string"), model).first().score is not None
    assert nbsvm.score(empty, nbsvm.fit(empty.select(F.col("doc_id").alias("id"), "text", F.col("score").alias("label")))).count() == 0


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.initial(np.log(np.full(12, 1 / 12)), 3, 3, 4).items()}
    p = {k: v + rng.standard_normal(v.shape) * 0.3 for k, v in p.items()}
    tokens, target, h = rng.integers(0, 12, (4, 5)), rng.integers(0, 12, (4, 5)), rng.standard_normal((5, 3))
    g, _, _ = gru.gradients(p, tokens, target, h, 11)
    for name in p:
        for at in list(np.ndindex(p[name].shape))[:: max(1, p[name].size // 5)]:
            values = []
            for step in (-1e-4, 1e-4):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += step
                values.append(gru.gradients(q, tokens, target, h, 11)[1])
            assert g[name][at] == pytest.approx((values[1] - values[0]) / 2e-4, abs=2e-3)


def test_language_model_scores(docs, empty):
    held = F.col("doc_id") % 7 == 2
    out = lm_scores.score_documents(docs, held).toPandas()
    train, counts = [t for k, t, *_ in ROWS if k % 7 != 2], {}
    lower = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(t or "")]
    for t in train:
        for w in [*lower(t), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    texts = {k: t for k, t, *_ in ROWS}
    for r in out.itertuples():
        tokens = [*lower(texts[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(w in counts for w in tokens), n, r.doc_id % 7 == 2)
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens))
        assert np.isfinite(r.score) and r.score < 0
    assert len(out) == len(ROWS) and lm_scores.score_documents(empty, held).count() == 0


def test_network_probabilities_sum_to_one():
    p = gru.initial(np.log(np.full(12, 1 / 12)), 3, 3, 4, seed=1)
    h = RNG.standard_normal((1, 3)).astype(np.float32)
    total = sum(float(np.exp(gru.log_probabilities(p, h, np.array([w]))[0][0])) for w in range(12))
    assert total == pytest.approx(1, abs=1e-5)


def test_sampled_pieces_are_lossless_and_reproducible(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    one = sampling.encode(docs, path).toPandas().sort_values(["doc_id"])
    two = sampling.encode(docs.repartition(1), path).toPandas().sort_values(["doc_id"])
    assert one["ids"].tolist() == two["ids"].tolist()
    other = sampling.encode(docs, path, seed=1).toPandas().sort_values(["doc_id"])
    assert one["ids"].tolist() != other["ids"].tolist()
    texts = {k: t or "" for k, t, *_ in ROWS}
    for r in sampling.decode(sampling.encode(docs, path), path).collect():
        assert r.decoded == texts[r.doc_id]
    assert sampling.decode(sampling.encode(empty, path), path).count() == 0


def test_samples_follow_the_lattice():
    lattice = sampling.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    ids, n = lattice.encode(pa.array(["hello"] * 4000), np.arange(4000, dtype=np.uint64), 0)
    seen = {}
    for x in np.split(ids, np.cumsum(n)[:-1]):
        seen[tuple(x.tolist())] = seen.get(tuple(x.tolist()), 0) + 1
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(i): -np.log1p(-sp.get_score(i)) for i in range(sp.get_piece_size()) if not sp.is_byte(i)}
    word = "▁hello"
    ways = []
    for cut in itertools.product([0, 1], repeat=5):
        parts, at = [], 0
        for k, c in enumerate(cut, 1):
            if c:
                parts.append(word[at:k])
                at = k
        parts.append(word[at:])
        if all(x in pieces for x in parts):
            ways.append((tuple(sp.piece_to_id(x) for x in parts), np.exp(sum(pieces[x] for x in parts))))
    total = sum(w for _, w in ways)
    assert set(seen) <= {k for k, _ in ways}
    for k, w in ways:
        assert seen.get(k, 0) / 4000 == pytest.approx(w / total, abs=0.03)


@pytest.mark.parametrize("lower", [False, True])
def test_words_of_slices(lower):
    from dendrolake.llm.common import split_words

    texts = [*TEXTS, "".join(map(chr, range(1, 0x250))), "Ò É x \u0085 Y"] * 3
    for at in (0, 7, 40):
        words, first = split_words(pa.array(texts).slice(at, 30), lower)
        index, names = words.indices.to_pylist(), words.dictionary.to_pylist()
        for t, a, b in zip(texts[at : at + 30], first[:-1], first[1:]):
            raw = (t or "").encode()
            assert [names[k] for k in index[a:b]] == [w.decode() for w in (raw.lower() if lower else raw).split()]


def test_crc_of_ids_in_spark(spark):
    raw = np.arange(5, dtype="<u4").tobytes()
    assert spark.createDataFrame([(raw,)], "x binary").select(F.crc32("x")).first()[0] == zlib.crc32(raw)
