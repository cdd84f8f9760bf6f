"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, embeddings, langid, lm_scores, nbsvm, packing, pii, quality_rules, runs, sampling, simhash, token_files, winnowing
from .common import NOT_WORD, bucket_of_id, fresh_path, let, saved, table


#: Score from which the quality classifier predicts a good document.
KEEP_SCORE = 0.7


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), trusted_documents(spark, sf_dir)).drop("text_key")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["k"] < len(pii.KINDS))

    def count(k: int):
        return F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")

    counts = [count(k) for k in range(len(pii.KINDS))]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = bucket_of_id("doc_id", 3) == 1
    profiles = langid.fit(docs.where(~held))
    found = langid.predict(docs, profiles)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score_documents(table(spark, sf_dir, "documents"), bucket_of_id("doc_id", 7) == 2)


def labelled_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``id, text, label`` of the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    learn = labels.where(bucket_of_id("id", 4) != 2).dropna().distinct()
    return docs.select(F.col("doc_id").alias("id"), "text").join(learn.hint("merge"), "id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.fit(labelled_quality(spark, docs, sf_dir))
    scored = nbsvm.score(docs, model)
    return scored.select(
        "doc_id", (bucket_of_id("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted")
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    read = token_files.read_token_files(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.against_edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.align(table(spark, sf_dir, "documents"), a, b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = saved(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    whole = alignment.with_counts(found, alignment.pair_counts(found), a, b)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def repeated_words(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where the words of every tenth document (by a hash of its id) repeat with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", NOT_WORD), lambda w: w != "")

    def rewritten(words):
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        again = F.transform(F.sequence(F.lit(0), n - a - 1), lambda j: F.get(words, a + F.pmod(j, p)))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise("")

    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, let(words, rewritten)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(repeated_words(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    longer = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  by start, then period: the first of equal ones stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda y, x: F.when(longer(x, y), x).otherwise(y)).alias("best")
    digests = F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256), F.sha2("collapsed", 256)
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, digests[0].alias("runs_sha256"), digests[1].alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_sampled_pieces": op4_sampled_pieces,
    "op5_embeddings": op5_embeddings,
    "op6_pii": op6_pii,
    "op7_language": op7_language,
    "op8_lm_scores": op8_lm_scores,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_files": op10_token_files,
    "op11_winnowing": op11_winnowing,
    "op12_alignment": op12_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Vectors, their links within a label by cosine, and what each reaches over links.
EMBEDDINGS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counts USING (vec_id)"""

#: Hashes, models, tokenizers and look-behind patterns are beyond SQL: those queries are tested against plain versions.
ORACLE_SQL: dict[str, str] = {"op5_embeddings": EMBEDDINGS_SQL}
