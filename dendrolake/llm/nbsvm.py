"""Quality classifier: naive Bayes log-count ratios as feature scales, and a linear hinge-loss model over them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, saved, slices, split_words

#: Buckets of hashed n-grams; bounds what is learned and sent about.
BUCKETS = 1 << 18
#: Labelled rows that the hinge-loss model is fitted on at most (those of least hashed id), and those that its
#: scores are turned into probabilities with. Log-count ratios are taken from all labelled rows.
FIT_ROWS, CALIBRATION_ROWS = 8192, 4096
#: Text bytes whose n-grams are worked out at a time.
SLICE_BYTES = 3_000_000


class _Kinds(dict):
    """A character's kind, worked out when first met: X and x for letters, 9 for digits, other marks for themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return kind


_kinds, _repeats = _Kinds(), re.compile(r"(.)\1+")


def shapes(words: list[str]) -> list[str]:
    """Each word's kinds of characters, repeats folded."""
    spelled = [w.translate(_kinds) for w in words]
    folded = {s: _repeats.sub(r"\1\1", s)[:8] for s in set(spelled)}
    return [folded[s] for s in spelled]


def indicators(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that each text has, without repeats: all texts' after another, and their counts.

    n-grams: words and pairs of words; shapes of words, in runs of one to three; a word that repeats the one
    before it.
    """
    words, first = split_words(texts)
    index = words.indices.to_numpy(zero_copy_only=False)
    n_docs = len(first) - 1
    doc = np.repeat(np.arange(n_docs, dtype=np.uint64), np.diff(first))
    if not len(index):
        return np.zeros(0, np.int64), np.zeros(n_docs, np.int64)
    one = hash_words(words.dictionary)[index]
    kinds = pa.array(shapes(words.dictionary.to_pylist()), pa.string()).dictionary_encode()
    kind = hash_words(kinds.dictionary, 7)[kinds.indices.to_numpy(zero_copy_only=False)][index]
    same = doc[1:] == doc[:-1]
    far = same[1:] & same[:-1]
    step = np.uint64(0x9E3779B97F4A7C15)
    two = mix(one[:-1] * step + one[1:])
    kind2 = mix(kind[:-1] * step + kind[1:])
    kind3 = mix(kind2[:-1] * step + kind[2:])
    again = same & (one[1:] == one[:-1])
    grams = [one, two[same], kind, kind2[same], kind3[far], np.full(again.sum(), 99, np.uint64)]
    owner = [doc, doc[1:][same], doc, doc[1:][same], doc[2:][far], doc[1:][again]]
    keys = np.concatenate([d << np.uint64(32) | mix(g) % np.uint64(buckets) for d, g in zip(owner, grams)])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    counts = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=n_docs)
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), counts


def log_count_ratios(labelled: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> np.ndarray:
    """log of (positive rows with the n-gram / all) over (negative rows with it / all), for each bucket.

    ``labelled`` has ``text`` and ``label`` (0 or 1). All rows count; a task sends a row for each bucket at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets + 1), np.int64)  # the last: rows
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                label = batch.column("label").to_numpy(zero_copy_only=False)
                found, sizes = indicators(batch.column("text"), buckets)
                side = np.repeat(label, sizes)
                for k in (0, 1):
                    total[k, :buckets] += np.bincount(found[side == k], minlength=buckets)
                    total[k, buckets] += (label == k).sum()
        has = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[0, has]), pa.array(total[1, has])], names=["bucket", "no", "yes"])

    counted = labelled.mapInArrow(count, "bucket long, no long, yes long").groupBy("bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    found = counted.toPandas()  # a row for each bucket at most
    table = np.zeros((2, buckets + 1))
    table[0, found["bucket"]], table[1, found["bucket"]] = found["no"], found["yes"]
    share = (table[:, :buckets] + smoothing) / (table[:, buckets:] + 2 * smoothing)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of a linear model with hinge loss, one dual variable at a time.

    Row i has the value scale[b] / sqrt(n) in each of its n buckets b, and 1 for the bias; ``cost`` bounds its dual
    variable.
    """
    w = np.zeros(len(scale) + 1)
    values = [scale[r] / np.sqrt(max(1, len(r))) for r in rows]
    norms = np.array([float(v @ v) + 1.0 for v in values])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = y[i] * (float(w[r] @ v) + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def sigmoid_fit(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps, with the two labels' targets drawn in a little."""
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[margin, np.ones(len(margin))]
    ab = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -35, 35)))
        grad = x.T @ (p - target) + 1e-6 * ab
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        ab -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return max(float(ab[0]), 1e-3), float(ab[1])


def fit(labelled: DataFrame, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> dict:
    """Learns from ``id, text, label`` (rows whose label is 0 or 1).

    Ratios come from all rows. The hinge-loss model is fitted in one task on ``fit_rows`` rows at most and made
    into probabilities on ``calibration_rows`` further ones; both are the rows of least hashed id, so the same for
    any partitioning. Without rows of both labels every score is the share of label 1 (0.5 without rows). A null text is
    an empty one; rows of other or null labels are passed over; repeated rows count as often as they come; null ids hash
    like others. Other columns are not used.
    """
    labelled = labelled.where(F.col("label").isin(0, 1)).select("id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("long").alias("label"))
    labelled = saved(labelled, "labelled")
    ratios = log_count_ratios(labelled, buckets)
    # hashes of about twice as many rows come first, so that tasks send few others on to be ranked
    need, n, rank = fit_rows + calibration_rows, labelled.count(), F.xxhash64("id")
    near = labelled.where(rank < F.lit(-(1 << 63) + (2 * need << 64) // n)) if n > 2 * need else labelled
    if near.count() < min(need, n):  # ids that come very often
        near = labelled
    ranked = near.orderBy(rank, "id", F.xxhash64("text")).limit(need)

    def learn(pdf):
        pdf = pdf.sort_values("order")
        found, sizes = [], []
        for at in range(0, len(pdf), 512):
            f, n = indicators(pa.array(pdf["text"].iloc[at : at + 512], pa.string()), buckets)
            found.append(f)
            sizes.append(n)
        rows = np.split(np.concatenate(found), np.cumsum(np.concatenate(sizes))[:-1])
        label = pdf["label"].to_numpy()
        n_fit = max(1, round(len(rows) * fit_rows / (fit_rows + calibration_rows)))
        y = np.where(label[:n_fit] == 1, 1.0, -1.0)
        share = np.array([(y < 0).mean(), (y > 0).mean()])
        if not share.all():
            w, a, b = np.zeros(buckets + 1), 1.0, float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
        else:
            w = dual_coordinate_descent(rows[:n_fit], y, ratios, 0.5 / share[(y > 0).astype(int)])
            held = [float((w[r] * ratios[r]).sum() / np.sqrt(max(1, len(r))) + w[-1]) for r in rows[n_fit:] or rows]
            a, b = sigmoid_fit(np.array(held), label[n_fit:] if len(rows) > n_fit else label)
        out = np.append(w[:-1] * ratios, [w[-1], a, b])
        return type(pdf)({"w": [out.astype("<f8").tobytes()]})

    one = ranked.select("text", "label", F.xxhash64("id").alias("order")).groupBy(F.lit(0).alias("all")).applyInPandas(learn, "w binary").first()
    model = np.frombuffer(one.w, "<f8") if one else np.zeros(buckets + 3)
    return {"weights": model[:buckets], "bias": float(model[buckets]), "a": float(model[buckets + 1]), "b": float(model[buckets + 2]), "buckets": buckets}


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds ``score_col`` (0 to 1; higher: label 1 likelier) to all rows. A null text is scored as an empty one. Repeated rows
    and all columns stay, but for one named ``score_col``, which is replaced. An empty table gives no rows."""
    docs = docs.drop(score_col)  # a column of that name is replaced
    spark, names = docs.sparkSession, docs.columns
    shared = spark.sparkContext.broadcast(model)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, text_col, SLICE_BYTES):
                found, sizes = indicators(batch.column(text_col), m["buckets"])
                owner = np.repeat(np.arange(len(sizes)), sizes)
                margin = np.bincount(owner, m["weights"][found], minlength=len(sizes)) / np.sqrt(np.maximum(sizes, 1)) + m["bias"]
                p = 1 / (1 + np.exp(-np.clip(m["a"] * margin + m["b"], -35, 35)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*names, score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{score_col}` double")
