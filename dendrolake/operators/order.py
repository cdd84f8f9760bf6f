"""Places of rows in an order, and joins by a key that most rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import saved

#: Parts that the rows of one key are dealt to where they are joined with its one row.
SALTS = 16


def placed(rows: DataFrame, by: list, name: str) -> DataFrame:
    """``rows`` with their place, from 0, in the order of sample and ``by``: sorted by ranges, a count for each range."""
    ordered = rows.repartitionByRange("sample", *by).sortWithinPartitions("sample", *by)
    marked = saved(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "placed")
    counts = marked.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row for each partition
    return marked.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_before", "_first")


def with_one(rows: DataFrame, ones: DataFrame, keys: list[str], spread: str = "tree_id") -> DataFrame:
    """``rows`` joined with ``ones``, which has a row for each key. Where Spark doesn't find ``ones`` small enough to send it to
    all tasks, the rows of a key are dealt out by ``spread``, so that no key comes to one task whole."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = ones.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def placed_in_sample(rows: DataFrame, by: list, name: str, size: str | None = None, spread: str = "tree_id") -> DataFrame:
    """``rows`` with their place, from 0, within their sample, and its number of rows as ``size``: a sample of any size is
    sorted in many tasks."""
    whole = placed(rows, by, "_place")
    ends = whole.groupBy("sample").agg(F.min("_place").alias("_low"), F.count("*").alias("_size"))
    out = with_one(whole, ends, ["sample"], spread).withColumn(name, F.col("_place") - F.col("_low")).drop("_place", "_low")
    return out.withColumnRenamed("_size", size) if size else out.drop("_size")
