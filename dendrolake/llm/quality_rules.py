"""Quality rules: fixed rules on words and lines, and a hashed n-gram log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, saved, unused

#: Buckets of hashed unigrams and bigrams; bounds the table of ratios that is broadcast.
BUCKETS = 1 << 16
#: Windows of so many words count as repeated text when they come twice or more.
WINDOW = 8
#: Ratios are kept as whole multiples of 1 / SCALE, so that sums don't depend on their order.
SCALE = 1_000_000
#: Columns of the fixed rules.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The cut follows from the trusted documents that pass the fixed rules: the mean ratio that all but this share of them
#: reach, less a margin, since their own n-grams are among those that the ratios were counted from.
LOST, MARGIN = 0.001, 0.05
#: Ratios are counted in steps of 1 / STEPS for that, from -LIMIT to LIMIT: a bounded table.
STEPS, LIMIT = 1000, 16


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, NOT_WORD))


def _with_words(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("_words", _words(text)).withColumn("_n", F.size("_words"))
    return out.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))


def _grams(n: Column, hashes: Column, buckets: int) -> Column:
    """Buckets of the unigrams and bigrams."""
    ones = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)))
    twos = F.transform(
        F.sequence(F.lit(0), n - 2), lambda i: F.pmod(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), F.lit(buckets))
    )
    return F.when(n >= 2, F.concat(ones, twos)).otherwise(ones)


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and helper columns ``_n``, ``_hash``. Columns of
    these names, and others that start with ``_`` and are used on the way, are replaced."""
    docs = docs.drop(*BASE, "_n", "_hash", "_words", "_lines", "_keys", "_placed", "_starts")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = _with_words(docs, text_col)
    d = d.withColumn(
        "_lines", F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    )
    at = lambda i: [F.get(F.col("_hash"), i + k) for k in range(WINDOW)]
    d = d.select(
        *docs.columns,
        "_n",
        "_hash",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.col("_n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("_n") - WINDOW), lambda i: F.xxhash64(*at(i)))
        ).alias("_keys"),
    )
    # places of windows that come twice or more: sorted by hash they stand side by side
    d = d.withColumn(
        "_placed",
        F.when(
            F.size(F.array_distinct("_keys")) < F.size("_keys"),
            F.sort_array(F.transform("_keys", lambda k, i: F.struct(k.alias("k"), i.alias("i")))),
        ),
    )
    placed = F.col("_placed")
    d = d.withColumn(
        "_starts",
        F.sort_array(
            F.transform(
                F.filter(
                    placed,
                    lambda x, i: (x.k == F.coalesce(F.get(placed, i + 1).k, x.k + 1))
                    | (x.k == F.coalesce(F.when(i > 0, F.get(placed, i - 1).k), x.k + 1)),
                ),
                lambda x: x.i,
            )
        ),
    )
    starts = F.col("_starts")
    covered = F.aggregate(
        F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_keys", "_placed", "_starts")


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = 1.0) -> DataFrame:
    """``bucket, ratio``: log of the n-gram's share in trusted documents over its share in all, times SCALE, rounded.

    ``trusted`` names documents by ``id_col``. Both multinomials are counted over every document; a task sends a
    row for each bucket at most. Without trusted documents all ratios are zero.
    """
    names = trusted.select(F.col(id_col).alias("_id")).dropna().distinct().withColumn("_trusted", F.lit(1))
    # by shuffle at any size: the number of trusted documents has no bound
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(names.hint("merge"), "_id", "left")
    d = _with_words(d, "_text")
    grams = d.select("_trusted", F.explode(_grams(F.col("_n"), F.col("_hash"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_trusted").alias("target"))
    counts = saved(counts, "gram-counts")
    total = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    share = lambda n, t: (F.col(n) + smoothing) / (F.col(t) + smoothing * buckets)
    ratio = F.when(F.col("all_target") > 0, F.log(share("target", "all_target") / share("raw", "all_raw"))).otherwise(0.0)
    return counts.crossJoin(F.broadcast(total)).select("bucket", F.round(ratio * SCALE).cast("long").alias("ratio"))


def cut_of(ratios: DataFrame, lost: float = LOST, margin: float = MARGIN) -> DataFrame:
    """One row, ``cut``: the greatest step that all but a share ``lost`` of the ratios (column ``ratio``) reach, less
    ``margin``. Counts by step are all that meets in one task. Without ratios the cut is below every ratio."""
    step = F.greatest(F.least(F.floor(F.col("ratio") * STEPS), F.lit(LIMIT * STEPS)), F.lit(-LIMIT * STEPS)).cast("long")
    counts = ratios.select(step.alias("step")).groupBy("step").agg(F.count("*").alias("n"))
    rows = counts.agg(F.sort_array(F.collect_list(F.struct("step", "n"))).alias("rows"), F.sum("n").alias("all"))
    below = F.aggregate("rows", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-LIMIT * STEPS).cast("long").alias("at")), lambda a, x: F.struct(
        (a["n"] + x["n"]).alias("n"), F.when(a["n"] <= lost * F.col("all"), x["step"]).otherwise(a["at"]).alias("at")
    ))
    return rows.select(F.when(F.col("all").isNull(), F.lit(-float(LIMIT))).otherwise(below["at"] / STEPS - margin).alias("cut"))


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    threshold: float | None = None,
) -> DataFrame:
    """``id_col, text_key`` (hash of the text), ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, ratio`` (mean log ratio for each n-gram, 0 without words) and ``kept``, for every row.

    A text fails the base rules with fewer than 20 words, or when over 30 % of its words stand in repeated windows.
    One that passes is kept if its mean ratio is ``threshold`` or more. If none is given, it is the cut of the trusted
    documents (``cut_of``), the same for every row. Null and empty texts have no words and fail. Repeated rows each
    get their row, null ids too. An empty table gives no rows. Other columns of ``docs``, of whatever name, are not
    looked at.
    """
    ratios = log_ratios(docs, trusted, id_col, text_col, buckets).withColumnRenamed("ratio", "_ratio")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("text_key"), text.alias("_text"))
    d = base_rules(rows.withColumn("_row", F.monotonically_increasing_id()), "_text")
    # a row's counts travel with its n-grams as grouping keys, and its sum is made before the shuffle: one row a text
    held = ["_id", "text_key", "_row", *BASE]
    grams = d.select(*held, F.explode_outer(_grams(F.col("_n"), F.col("_hash"), buckets)).alias("bucket"))
    # the table of ratios has a row for each bucket at most: a bound that does not depend on the data
    summed = grams.join(F.broadcast(ratios), "bucket", "left").groupBy(*held).agg(F.sum("_ratio").alias("_sum"), F.count("bucket").alias("_grams"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    mean = F.coalesce(F.col("_sum") / F.greatest("_grams", F.lit(1)) / SCALE, F.lit(0.0))
    measured = saved(summed.select(F.col("_id").alias(id_col), "text_key", *BASE, failed.alias("base_failed"), mean.alias("ratio")), "measured")
    if threshold is None:
        good = trusted.select(F.col(id_col).alias("_good")).dropna().distinct().hint("merge")
        own = measured.where(~F.col("base_failed")).select(F.col(id_col).alias("_good"), "ratio").join(good, "_good")
        cut = F.broadcast(cut_of(own))  # one row
        judged = measured.crossJoin(cut).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.col("cut"))).drop("cut")
    else:
        judged = measured.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
    return judged


def keep_good(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns; repeated rows stay repeated."""
    name, hashed, own = unused(docs, "id", "key", "own")
    good = judge(docs.select(id_col, text_col), trusted, id_col, text_col, **options).where("kept").select(F.col(id_col).alias(name), F.col("text_key").alias(hashed))
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = docs.withColumn(own, key)
    return keyed.join(good, F.col(id_col).eqNullSafe(F.col(name)) & (F.col(own) == F.col(hashed)), "left_semi").drop(own)
