"""A corpus pipeline: stages of the training-data operators, each over all that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolake.llm import nbsvm, packing, pii, quality_rules, queries, simhash
from dendrolake.llm.common import saved, table, unused


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, does not reject.

    Null and empty texts get the score of no words; repeated rows are scored alike; null ids are never labelled. All
    columns stay, whatever their names. An empty table gives no rows.
    """
    model = nbsvm.fit(queries.labelled_quality(spark, docs, sf_dir))
    (score,) = unused(docs, "score")
    return nbsvm.score(docs, model, score_col=score).where(F.col(score) >= queries.KEEP_SCORE).drop(score)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the likelihood ratio.

    Null and empty texts go (they have under 20 words). Repeated rows are judged alike, null ids like others. All
    columns stay, whatever their names. An empty table gives no rows.
    """
    return quality_rules.keep_good(docs, queries.trusted_documents(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: candidates by SimHash, five-word shingles with a similarity of 0.8 or more
    to a document that stays and comes before by id.

    Null, empty and blank texts are copies of each other. Of rows with one text that of the smallest id stays, once;
    null ids come last. All columns stay, whatever their names. An empty table gives no rows.
    """
    # the id as text, with a mark for null, and a hash of the text: what rows are joined and told apart by, in one shuffle
    names = unused(docs, "known", "name", "key")
    as_keys = lambda key: dict(zip(names, (F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), key)))
    stay = simhash.near_copies(docs).withColumns(as_keys(F.col("text_key"))).select(*names)
    keyed = docs.withColumns(as_keys(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    return keyed.join(stay.hint("merge"), names, "left_semi").dropDuplicates(names).drop(*names)  # a repeated row is a copy too


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it replaced; ``n_chars`` follows the text.

    Null texts stay null; empty ones, repeated rows, null ids and all columns, whatever their names, stay. An empty
    table gives no rows.
    """
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in training sequences.

    A null or empty text is one end token. Repeated rows are packed as often as they come, null ids too. Other columns
    are not used. An empty table gives no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Models and packing are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages after another over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
