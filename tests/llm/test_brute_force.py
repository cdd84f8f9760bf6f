"""Language distances, classifier, network scores and disclosing terms against plain versions."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrolake.llm import embeddings, gru, langid, lm_scores, nbsvm, pii, quality_rules
from dendrolake.llm.common import bucket_of_id

RNG = np.random.default_rng(12)


def _grams(text):
    """Runs of one to three characters within words and the two spaces around them."""
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        out.update(word)
        out.update(padded[k : k + 2] for k in range(len(padded) - 1))
        out.update(padded[k : k + 3] for k in range(len(padded) - 2))
    return out


def _key(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def test_out_of_place_distances(spark):
    letters = {"one": list("abcdeé "), "two": list("cdefgh "), "three": list("xyzabü ")}
    rows = [(k, "".join(RNG.choice(letters[lang], 120)), lang) for k, lang in enumerate(["one", "two", "three"] * 12)] + [(90, "ab!", "one"), (91, None, "two")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    most = 25
    profiles = langid.fit(table.where("doc_id < 30"), most=most)
    counts = {}
    for k, text, lang in rows[:30]:
        counts.setdefault(lang, Counter()).update(_grams(text))
    ranked = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], _key(x[0])))[:most]]
    want = {lang: ranked(c) for lang, c in counts.items()}
    assert {lang: x.tolist() for lang, x in profiles.items()} == {lang: [_key(g) for g in x] for lang, x in want.items()}
    for r in langid.predict(table, profiles, most=most).collect():
        text = rows[[x[0] for x in rows].index(r.doc_id)][1]
        own = ranked(_grams(text or ""))
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        off = {lang: sum(abs(x.index(g) - k) if g in x else most for k, g in enumerate(own)) for lang, x in want.items()}
        first, second = sorted(off, key=lambda lang: (off[lang], lang))[:2]
        assert r.lang_pred == first and r.score == pytest.approx(1 - off[first] / off[second])


def test_log_count_ratios_over_documents(spark):
    texts = [" ".join(RNG.choice(["Oak", "elm", "ash!!", "fir", "7", "ivy ivy"], int(n))) for n in RNG.integers(1, 12, 60)]
    rows = [(k, t, int(k % 3 > 0)) for k, t in enumerate(texts)]
    got = nbsvm.log_count_ratios(spark.createDataFrame(rows, "id long, text string, label int").repartition(5), buckets=256)

    def seen(text):  # one text at a time, without the arrays of a batch
        import pyarrow as pa

        return set(nbsvm.indicators(pa.array([text]), 256)[0].tolist())

    has = {label: Counter(itertools.chain.from_iterable(seen(t) for _, t, y in rows if y == label)) for label in (0, 1)}
    n = {label: sum(y == label for *_, y in rows) for label in (0, 1)}
    for b in range(256):
        assert got[b] == pytest.approx(math.log((has[1][b] + 1) / (n[1] + 2) / ((has[0][b] + 1) / (n[0] + 2))))


def test_indicators_of_one_text():
    """Words, pairs, shapes in runs of up to three, and one mark for a repeated word: as many as there are kinds of each."""
    import pyarrow as pa

    text = "Big Big elm 42 elm 42 oak"
    words, shape = text.split(), ["Xxx", "Xxx", "xxx", "99", "xxx", "99", "xxx"]
    runs = lambda x, k: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    want = len(runs(words, 1)) + len(runs(words, 2)) + len({tuple(s[:2] for s in r) for r in runs(shape, 1)}) + 1
    want += len(runs([s[:2] for s in shape], 2)) + len(runs([s[:2] for s in shape], 3))
    found, sizes = nbsvm.indicators(pa.array([text]), 1 << 30)
    assert sizes.tolist() == [want] and len(set(found.tolist())) == want


def test_dual_coordinate_descent_reaches_the_optimum():
    """At the end primal and dual values meet: no linear model has a smaller hinge loss plus half its squared norm."""
    buckets, rows = 40, [np.unique(RNG.integers(0, 40, 8)) for _ in range(60)]
    y = np.array([1.0 if 3 in r or 7 in r else -1.0 for r in rows])
    scale, cost = RNG.uniform(0.5, 1.5, buckets), np.where(y > 0, 0.8, 0.4)
    w = nbsvm.dual_coordinate_descent(rows, y, scale, cost, epochs=3000)
    x = np.zeros((60, buckets + 1))
    for i, r in enumerate(rows):
        x[i, r], x[i, -1] = scale[r] / np.sqrt(len(r)), 1.0
    primal = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best, v = primal(w), np.zeros(buckets + 1)
    for t in range(1, 20_000):  # plain subgradient descent on the same loss
        loss = 1 - y * (x @ v) > 0
        v -= (v - x.T @ (cost * y * loss)) / t
    assert best <= primal(v) * 1.001 and best == pytest.approx(primal(v), rel=0.02)  # passes end when no step is over 0.001
    for _ in range(200):
        assert primal(w + RNG.standard_normal(buckets + 1) * 10.0 ** RNG.uniform(-4, 0)) >= best * 0.999


def _plain_log_p(p, ids, fresh):
    """One document, one token after another, every sum written out."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    h, total, before = np.zeros(p["u"].shape[1]), 0.0, fresh
    per_class = p["w"].shape[1]
    for word in ids:
        x, a = p["x"][:, before] + p["b"], np.array([h @ p["u"][k] for k in range(3)])
        z, r = sig(x[0] + a[0]), sig(x[1] + a[1])
        h = (1 - z) * np.tanh(x[2] + r * a[2]) + z * h
        k, j = divmod(int(word), per_class)
        c, w = h @ p["c"] + p["cb"], p["w"][k] @ h + p["wb"][k]
        total += c[k] - np.log(np.exp(c).sum()) + w[j] - np.log(np.exp(w).sum())
        before = word
    return total


def test_network_scores_against_a_plain_recurrence():
    p = gru.initial(np.log(np.full(24, 1 / 24)), 5, 4, 6, seed=2)
    p = {k: v + RNG.standard_normal(v.shape).astype(np.float32) * 0.5 for k, v in p.items()}
    docs = [np.append(RNG.integers(0, 23, int(n)), 23) for n in [0, 1, 2, 300, 5, 40, 7, 7]]
    ends = np.cumsum([len(d) for d in docs])
    plain = {k: v.astype(np.float64) for k, v in p.items()}
    want = [_plain_log_p(plain, d, 23) for d in docs]
    for streams, block in ((1, 16), (3, 16), (512, 100_000)):
        assert gru.score_documents(p, np.concatenate(docs), ends, 23, streams, block) == pytest.approx(want, rel=1e-4)


def _documents(n):
    syllables = ["ka", "lo", "mi", "tu", "re", "san", "vel", "or"]
    word = lambda: "".join(RNG.choice(syllables, int(RNG.integers(1, 5))))
    return [(k, " ".join(word() for _ in range(int(RNG.integers(1, 60))))) for k in range(n)]


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.createDataFrame(_documents(300), "doc_id long, text string")
    one, many = (
        lm_scores.score_documents(docs.repartition(n), bucket_of_id("doc_id", 7) == 2, share_tokens=1500).toPandas().sort_values("doc_id", ignore_index=True) for n in (1, 7)
    )
    assert np.abs(one["score"] - many["score"]).max() < 1e-3 and (one["base_score"] == many["base_score"]).all()


def test_counts_that_are_asked_for(spark, monkeypatch):
    """With few outputs and few words known to all tasks, the rest go through the join: the same counts."""
    rows = _documents(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = bucket_of_id("doc_id", 7) == 2
    want = lm_scores.score_documents(docs, held).toPandas().sort_values("doc_id", ignore_index=True)
    monkeypatch.setattr(lm_scores, "KNOWN", 40)
    monkeypatch.setattr(gru, "CLASSES", 17)
    monkeypatch.setattr(lm_scores, "CHUNK_BYTES", 3000)
    got = lm_scores.score_documents(docs, held).toPandas().sort_values("doc_id", ignore_index=True)
    for name in ("n_tokens", "n_known", "train_tokens", "base_score"):
        assert got[name].to_numpy() == pytest.approx(want[name].to_numpy())


def test_disclosing_terms_against_brute_force(spark):
    people = [f"p{k}@mail.example.org" for k in range(6)]
    names = ["Alder", "Birch", "Cedar", "Damson", "Elder", "Fir"]
    texts = []
    for k in range(240):
        words = list(RNG.choice([f"word{j}" for j in range(30)], 12))
        who = k % 12
        if who < 6:
            words += [people[who]] * int(RNG.integers(1, 3)) + ([names[who]] if k % 24 < 14 else [])
        elif who == 7:
            words += [names[k % 5]]
        texts.append(" ".join(RNG.permutation(words)))
    texts += texts[:3]  # copies count as documents, not as further texts
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = {t: {v for v in people if v in t.split()} for t in set(texts)}
    terms = lambda t: {w.lower() for w in t.split() if w.isalnum() and len(w) > 2}
    n, n_v, n_t, n_vt, places, homes = len(texts), Counter(), Counter(), Counter(), Counter(), Counter()
    for t in texts:
        n_t.update(terms(t))
        n_v.update(base[t])
        n_vt.update(itertools.product(base[t], terms(t)))
    for t in set(texts):
        homes.update(base[t])
        places.update(itertools.product(base[t], terms(t)))
    want = set()
    for (v, w), both in n_vt.items():
        if homes[v] >= 2 and places[v, w] >= 2 and n > n_v[v] and math.log2(n * both / (n_v[v] * n_t[w])) >= 0.6 * math.log2(n / n_v[v]):
            want.add(w)
    got = {r.t for r in pii.disclosing_terms(table, disclosure=0.6).collect()}
    assert got == want and want & {x.lower() for x in names} and not any(w.startswith("word") for w in want)
    for r in pii.find_spans(table, disclosure=0.6).collect():
        text = texts[r.doc_id]
        marked = [text[s.s : s.e] for s in r.spans if s.k == 4]
        assert sorted(marked) == sorted(w for w in text.split() if w.lower() in want)


def test_cut_of_the_trusted_ratios(spark):
    values = [k / 1000 for k in range(-50, 950)]
    cut = quality_rules.cut_of(spark.createDataFrame([(v,) for v in values], "ratio double").repartition(4), lost=0.01, margin=0.5).first().cut
    assert cut == pytest.approx(values[10] - 0.5, abs=1.5e-3)
    assert quality_rules.cut_of(spark.createDataFrame([], "ratio double")).first().cut == -quality_rules.LIMIT


@pytest.mark.parametrize("kind", ["scaled", "noisy"])
def test_every_link_of_a_group_of_thousands(spark, kind):
    """3,000 copies of one vector of one label, scaled or with noise, among others: no link is lost and none is false."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    x = centre * rng.uniform(0.5, 2, (3000, 1)) if kind == "scaled" else centre + rng.standard_normal((3000, 16)) * 0.13
    x = np.concatenate([x, rng.standard_normal((500, 16))])
    frame = spark.createDataFrame(list(zip(range(len(x)), x.tolist(), [1] * len(x))), "vec_id long, embedding array<double>, label int")
    out = embeddings.near_duplicates(frame).toPandas().sort_values("vec_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert (out["n_links"].to_numpy() <= want).all() and out["n_links"].sum() >= 0.999 * want.sum()


def test_no_chunk_of_a_task_is_lost(spark, monkeypatch):
    """More chunks than 4,096 in a task, beside those of another: a row for each row, and the scores that few chunks give."""
    rows = [(k, f"oak elm {['ash', 'fir', 'ivy'][k % 3]}") for k in range(4160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs = docs.union(spark.createDataFrame([(5000 + k, "elm yew") for k in range(40)], "doc_id long, text string").coalesce(1))
    held = bucket_of_id("doc_id", 7) == 2
    want = lm_scores.score_documents(docs, held).toPandas().sort_values("doc_id", ignore_index=True)
    monkeypatch.setattr(lm_scores, "CHUNK_BYTES", 1)
    got = lm_scores.score_documents(docs, held).toPandas().sort_values("doc_id", ignore_index=True)
    assert len(got) == len(want) == 4200 and (got["doc_id"] == want["doc_id"]).all()
    assert np.abs(got["score"] - want["score"]).max() < 1e-3 and np.abs(got["base_score"] - want["base_score"]).max() < 1e-9


def test_models_are_averaged_in_a_tree(spark, monkeypatch):
    """Two at a time, by tasks that take several shares: the same model as all at once but for rounding."""
    docs = spark.createDataFrame(_documents(300), "doc_id long, text string")
    held = bucket_of_id("doc_id", 7) == 2
    want = lm_scores.score_documents(docs, held, share_tokens=800).toPandas().sort_values("doc_id", ignore_index=True)
    monkeypatch.setattr(lm_scores, "TOGETHER", 2)
    monkeypatch.setattr(lm_scores, "MOST_TASKS", 3)
    got = lm_scores.score_documents(docs, held, share_tokens=800).toPandas().sort_values("doc_id", ignore_index=True)
    assert np.abs(got["score"] - want["score"]).max() < 1e-2


def test_words_inside_addresses_are_no_terms(spark):
    """A term counts where it stands outside base spans, for itself as beside a value."""
    rows = [f"number {k} is plain" for k in range(60)] + [f"Smith can be reached at john.smith@mail.example.org, note {k}" for k in range(4)]
    rows += [f"write to jane.smith@mail.example.org about case {k}" for k in range(40)]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for docs in (table.where("doc_id < 64"), table):
        assert "smith" in {r.t for r in pii.disclosing_terms(docs).collect()}
    found = {r.doc_id: [s.v for s in r.spans if s.k == 4] for r in pii.find_spans(table).collect()}
    assert all("smith" in found[k] for k in range(60, 64)) and not any("smith" in found[k] for k in range(64, 104))


def test_values_of_the_same_texts_are_counted_as_one(spark):
    """Two texts with a list of 3,000 addresses and 600 terms: one row for a term, not one for each address and term."""
    list_ = " ".join(f"user{k}@mail.example.org" for k in range(3000))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = " ".join(f"term{a}{b}" for a in letters for b in letters[:23])
    table = spark.createDataFrame([(0, f"{list_} {words} one"), (1, f"{words} {list_} two")] + [(9 + k, f"plain text {k}") for k in range(20)], "doc_id long, text string")
    assert len([r for r in pii.disclosing_terms(table).collect() if r.t.startswith("term")]) == 598
