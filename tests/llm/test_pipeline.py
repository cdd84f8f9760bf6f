"""The pipeline's stages against brute-force versions of their decisions."""

import math

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from dendrolake.llm import pii, quality_rules, simhash
from dendrolake.llm.common import HashSet, saved

from test_operators import VOCABULARY, WORDS, _groups, _ids, _rules, _spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _lower(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(text or "")]


def _mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def _word_fingerprints(text):
    own = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(_lower(text))]
    out = []
    for s in range(simhash.SEEDS):
        h = [_mixed((x + (s + 1) * 0x9E3779B97F4A7C15) % 2**64) for x in own]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def _stay(texts):
    """Ids of the texts that stay: groups by fingerprints, then one after another by exact similarity."""
    first = {}
    for k in sorted(texts):
        first.setdefault(texts[k] or "", k)
    fps = {k: _word_fingerprints(t) for t, k in first.items()}
    near = lambda a, b: any((x ^ y).bit_count() <= 4 for x, y in zip(fps[a], fps[b]))
    group, kept = _groups(sorted(fps), near), {}
    for k in sorted(fps):
        words = _lower(texts[k])
        own = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        alike = lambda other: len(own & other) >= 0.8 * len(own | other)  # noqa: E731,B023
        if not any(alike(x) for x in kept.get(group[k], {}).values()):
            kept.setdefault(group[k], {})[k] = own
    return {k for members in kept.values() for k in members}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(VOCABULARY, int(n))) for n in rng.integers(40, 200, 120)]
    texts += [" ".join(rng.choice(["BUY!!", "NOW!!", "###", "the"], 60)) for _ in range(40)]
    texts += [t + " more" for t in texts[:10]] + texts[:5] + [texts[20] + " write a.b@c.example.com today", None, ""]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    labels = [(k, int(not 120 <= k < 160), 0) for k in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}", dict(enumerate(texts))


def test_stages(spark, folder):
    path, texts = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, path), name)
        kept[name] = docs
    first, second, third, fourth, last = (x.toPandas() for x in kept.values())
    for x in (first, second, third, fourth):
        assert list(x.columns) == COLUMNS
    good = {k for k, t in texts.items() if t and not 120 <= k < 160}
    assert good <= set(first["doc_id"]) and not set(first["doc_id"]) & set(range(120, 160))

    def passes(t):
        n, *_, again = _rules(t)
        return n >= 20 and 100 * again <= 30 * n

    judged = quality_rules.judge(kept["quality_classifier"], spark.read.parquet(f"{path}/labels.parquet").where("quality = 1")).toPandas().set_index("doc_id")
    trusted = sorted(judged.ratio[k] for k in first["doc_id"] if passes(texts[k]) and k < 160)  # all good ones are labelled
    cut = math.floor(trusted[0] * quality_rules.STEPS) / quality_rules.STEPS - quality_rules.MARGIN
    assert {k for k in first["doc_id"] if passes(texts[k]) and judged.ratio[k] >= cut} == set(second["doc_id"])
    assert set(third["doc_id"]) == _stay({k: texts[k] for k in second["doc_id"]}) and third["doc_id"].is_unique
    assert len(third) < len(second)
    assert set(fourth["doc_id"]) == set(third["doc_id"])
    for r in fourth.itertuples():
        spans = _spans(texts[r.doc_id])
        assert (r.text == texts[r.doc_id]) == (not spans) and r.n_chars == len(r.text)
        assert not _spans(r.text)
    size = last.groupby("doc_id")["length"].sum()
    for r in fourth.itertuples():
        assert size[r.doc_id] == len(_ids("byte_bpe_50k.json", r.text, 1))
    assert set(last["doc_id"]) == set(fourth["doc_id"]) and public_tokenizers.path("byte_bpe_50k.json")


def test_near_copies_by_similarity(spark, monkeypatch):
    """Copies with one word changed go, texts of the same words in another order stay; large groups go round by round."""
    rng = np.random.default_rng(5)
    texts = []
    for k in range(6):
        words = [f"w{rng.integers(400)}" for _ in range(60)]
        texts.append(" ".join(words))
        for j in range(6):
            copy = list(words)
            copy[int(rng.integers(60))] = f"new{j}"
            texts.append(" ".join(copy))
        texts += [" ".join(words[::-1]), " ".join(rng.permutation(words)), " ".join(words).upper()]
    texts += ["", None, " \n", "one", "one", "one two"]
    want = _stay(dict(enumerate(texts)))
    assert len(want) < 45 and {0, 7, 8} <= want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for together in (300, 2):
        assert {r.doc_id for r in simhash.near_copies(docs, together=together).collect()} == want
    plain = {k: fp for k, fp in ((r.id, r.fps) for r in simhash.word_fingerprints(docs).collect())}
    assert all([x % 2**64 for x in plain[k]] == _word_fingerprints(t) for k, t in enumerate(texts))


def test_large_groups_are_cut_by_shingles(spark):
    """No pair of 0.8 or more similarity is cut apart, texts without one are, blank texts hold together."""
    rng = np.random.default_rng(8)
    common, texts = " ".join(f"c{k}" for k in range(12)), ["", " ", "a b c", "A b c", "a b c d e f", "solo"]
    for k in range(12):
        words = [f"w{rng.integers(900)}" for _ in range(int(rng.integers(30, 90)))]
        texts += [" ".join(words) + " " + common, " ".join(words), " ".join([*words[:-1], "x"]), " ".join(words[: len(words) * 4 // 5 + 1])]
    rows = [(k % 2, k, t) for k, t in enumerate(texts + texts)]
    found = {r.text_key: r.part for r in simhash.shingle_groups(spark.createDataFrame(rows, "root long, text_key long, text string").repartition(3)).collect()}
    sets = [simhash.shingles(t) for _, _, t in rows]
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] == rows[b][0] and simhash.similarity(sets[a], sets[b]) >= 0.8]
    assert len(alike) > 60 and all(a in found and found[a] == found[b] for a, b in alike)
    assert all(rows[k][0] == rows[part][0] for k, part in found.items())
    assert len(set(found.values())) > 20  # a passage that all share does not join them
    empty = spark.createDataFrame([], "root long, text_key long, text string")
    assert simhash.shingle_groups(empty).count() == 0


def test_loose_links_of_large_buckets(spark, monkeypatch):
    """Groups of many near copies: linked to one another, in as many links as there are fingerprints, none lost."""
    monkeypatch.setattr(simhash, "PAIRWISE_BUCKET", 4)
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**63))
    near = {base} | {base ^ (1 << int(rng.integers(63))) for _ in range(60)}
    alone = {int(x) for x in rng.integers(0, 2**63, 40)}
    frame = spark.createDataFrame([(k, f) for k in (0, 1) for f in near | alone], "s int, fp long")
    links = {(r.s, r.a, r.b) for r in simhash.close_links(frame, by=("s",), loose=True).collect()}
    for k in (0, 1):
        group = _groups(sorted(near | alone), lambda a, b: (k, a, b) in links or (k, b, a) in links)
        assert len({group[f] for f in near}) == 1 and {f for f in alone if group[f] == group[base]} <= near
    exact = {(r.s, r.a, r.b) for r in simhash.close_links(frame, by=("s",)).collect()}
    assert all((a ^ b).bit_count() <= 4 for _, a, b in exact)
    for k in (0, 1):
        group = _groups(sorted(near), lambda a, b: (k, a, b) in exact or (k, b, a) in exact)
        assert len(set(group.values())) == 1


def test_loose_links_grow_with_the_fingerprints(spark):
    """A bucket's links are fewer than its fingerprints, not as many as its pairs, and connect what its pairs connect."""
    rng = np.random.default_rng(6)
    bases = [int(x) for x in rng.integers(-(2**62), 2**62, 30)]
    fps = sorted({b ^ (1 << k) for b in bases[:3] for k in range(40)} | {b ^ sum(1 << int(k) for k in rng.choice(63, 3, replace=False)) for b in bases for _ in range(5)})
    frame = spark.createDataFrame([(k, f) for k in (0, 1) for f in fps], "s int, fp long").repartition(3)
    links = [(r.s, r.a, r.b) for r in simhash.close_links(frame, blocks=6, by=("s",), loose=True).collect()]
    assert 0 < len(links) <= 2 * 15 * len(fps)  # pairs would be over 3 * 780 in most of the 15 choices of blocks
    want = _groups(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    for s in (0, 1):
        own = {frozenset((a, b)) for k, a, b in links if k == s}
        assert _groups(fps, lambda a, b: frozenset((a, b)) in own) == want
    rows = [(int(k), int(f)) for k in range(7) for f in fps[k :: 7]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)  # buckets go on in later batches
    try:
        found = {(r.c, r.b): r.a for r in simhash.bucket_links(spark.createDataFrame(rows, "c int, fp long"), ["c"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(7):
        want = _groups(fps[k :: 7], lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
        assert {f: found.get((k, f), f) for f in fps[k :: 7]} == want


def test_buckets_shared_by_chance_cost_no_rows(spark, monkeypatch):
    """Fingerprints that share blocks but are far apart: no table is written that has a row for each, and no link is made."""
    rng, sizes = np.random.default_rng(7), []
    masks = [m & (2**64 - 1) for m in simhash.block_masks(6)]
    bases = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    fps = sorted({b & 0x3FFFFF | int(x) & ~0x3FFFFF for b in bases for x in rng.integers(-(2**62), 2**62, 20)})
    assert min(((a ^ b) & (2**64 - 1)).bit_count() for a in fps for b in fps if a < b) > 4
    shared = sum(n for m in masks for n in np.unique([f & m for f in fps], return_counts=True)[1] if n > 1)
    assert shared >= 800

    def counted(df, label):
        out = saved(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "saved", counted)
    frame = spark.createDataFrame([(k, f) for k in (0, 1) for f in fps], "s int, fp long")
    assert simhash.close_links(frame, blocks=6, by=("s",), loose=True).count() == 0
    assert not sizes


@pytest.mark.parametrize("together", [5, 10_000])
def test_large_buckets_go_through_batches(spark, monkeypatch, together):
    """All of a bucket over the limit are linked to its smallest, wherever batches end; buckets at the limit by their pairs."""
    monkeypatch.setattr(simhash, "PAIRWISE_BUCKET", 4)
    rng = np.random.default_rng(3)
    buckets = {(k % 2, k): sorted({int(x) for x in rng.integers(-(2**62), 2**62, n)}) for k, n in enumerate([1, 4, 5, 1, 23, 4, 1, 1, 40, 6, 2, 5])}
    buckets[1, 5][1:] = sorted(buckets[1, 5][0] + d for d in (1, 2, 2**40 - 1))  # within 4 bits of one another, or far
    rows = [(s, c, f) for (s, c), own in buckets.items() for f in own]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", together)
    try:
        frame = spark.createDataFrame(rows, "s int, c int, fp long").repartition(3)
        found = [((r.s, r.c), r.b, r.a) for r in simhash.bucket_links(frame, ["s", "c"]).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k, own in buckets.items():
        near = lambda a, b: len(own) > 4 or ((a ^ b) & (2**64 - 1)).bit_count() <= 4  # noqa: E731,B023
        want += [(k, f, root) for f, root in _groups(own, near).items() if f != root]
    assert sorted(found) == sorted(want) and len(want) > 74


def test_plans_do_not_hold_the_set_of_hashes(spark, capsys):
    """The driver keeps each plan's text, and tells of it again as often as the plan changes."""
    words = spark.range(3000).select(F.xxhash64("id").alias("h"))
    known = HashSet(words)
    assert words.where(known.may_have(F.col("h"))).count() == 3000
    assert spark.range(10**6, 10**6 + 3000).where(known.may_have(F.xxhash64("id"))).count() < 30
    docs = spark.createDataFrame([(k, f"alice met bob{k % 2} at a{k % 2}@example.org") for k in range(4)], "doc_id long, text string")
    for df in (words.where(known.may_have(F.col("h"))), pii.sanitise(docs)):
        df.explain("formatted")
        assert len(capsys.readouterr().out) < 60_000


def test_texts_are_searched_for_words_twice(spark, monkeypatch):
    """Once to count terms and once to find those that disclose something; a filter or a union would do it again for all texts."""
    plans = []

    def planned(df, label):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return saved(df, label)

    monkeypatch.setattr(pii, "saved", planned)
    docs = spark.createDataFrame([(k, f"alice met bob{k % 2} at a{k % 2}@example.org") for k in range(4)] + [(4, None)], "doc_id long, text string")
    out = pii.sanitise(docs.withColumn("nothing", F.lit(None)))
    plans.append(("result", out._jdf.queryExecution().optimizedPlan().toString()))
    assert {label: n for label, plan in plans if (n := plan.count(pii._WORDS))} == {"risky": 1, "cleaned": 1}
    assert out.dtypes == [("doc_id", "bigint"), ("text", "string"), ("nothing", "void")]
    assert {r.text for r in out.collect()} == {"alice met bob0 at [email]", "alice met bob1 at [email]", None}


def test_few_words_pass_a_set_of_many_terms(spark):
    """With a fixed set, nearly every text had a word that passed by chance once there were tens of thousands of terms."""
    terms = saved(spark.range(100_000).select(F.xxhash64("id").alias("h")), "terms")
    known = pii._term_set(terms)
    assert known.bits <= pii.MOST_BITS and pii._term_set(terms.limit(0)).bits == pii.LEAST_BITS
    assert terms.where(known.may_have(F.col("h"))).count() == 100_000
    assert spark.range(10**6, 10**6 + 100_000).where(known.may_have(F.xxhash64("id"))).count() < 20


def test_run_of_an_empty_table(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").where(F.lit(False)).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").where(F.lit(False)).write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
