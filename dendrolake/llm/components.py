"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Parts that the nodes of one root are dealt to where they are joined by it: a component may hold most of the nodes.
SALTS = 8


def join_by_root(rows: DataFrame, of_root: DataFrame, node: str) -> DataFrame:
    """``rows`` (with ``root`` and the column ``node``) joined with ``of_root`` (a row for each root), salted."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("int"))
    spread = of_root.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread.hint("merge"), ["root", "_salt"]).drop("_salt")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Returns ``node, root`` for every node of a link; root is the smallest node reachable.

    Each round, a node and the root it points at take the smallest root among the neighbours, then pointers
    are shortened. Rounds grow with the logarithm of a component's diameter. Each round is written to the
    shared folder, and only a sum that shows whether anything changed comes to the driver.
    Null ends and self-links are ignored; an empty table gives an empty result.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = saved(one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    roots = saved(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "roots")
    before = None
    while True:
        total = roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == before or total is None:
            return roots
        before = total
        near = (
            both.join(roots.select(F.col("node").alias("v"), "root").hint("merge"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        offers = roots.join(near.hint("merge"), "node").select("node", "root", "near")
        hooked = (
            offers.select("node", F.least("root", "near").alias("root"))
            .union(offers.select(F.col("root").alias("node"), F.least("root", "near").alias("root")))
            .groupBy("node")
            .agg(F.min("root").alias("root"))
        )
        hooked = saved(hooked, "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        roots = saved(join_by_root(hooked, up, "node").select("node", F.least("root", "upper").alias("root")), "roots")
