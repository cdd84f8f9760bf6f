"""Trees, alignments and logs made from the driver's tables by integer formulas.

Every order is a tree, and the orders of a customer are one sample of trees; every part is a site. So all tables are
used whole, and work grows with them. The SQL here runs in Spark and in DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tree_sql(taxa: int = 8, orders: str = "orders") -> str:
    """Common table expressions: ``cum`` (caterpillar sides), ``interior`` and ``leaf`` (edges of all trees)."""
    side = f"{3 if taxa == 8 else 2} + tree_id % {3 if taxa == 8 else 2}"
    names = ", ".join(f"({t}, {1 << t})" for t in range(taxa))
    return f"""WITH taxa AS (SELECT * FROM (VALUES {names}) AS t(taxon, bit)),
base AS (SELECT o_orderkey AS tree_id, o_custkey AS sample, cast(floor(o_totalprice) AS bigint) AS px FROM {orders}),
placed AS (SELECT tree_id, sample, px, taxon, bit, row_number() OVER (PARTITION BY tree_id
  ORDER BY ((tree_id % 11 + 1) * (taxon + 1) * 37 + (sample % 5) * taxon) % 101, taxon) - 1 AS p FROM base CROSS JOIN taxa),
sided AS (SELECT *, CASE WHEN p < {side} THEN 0 ELSE 1 END AS side,
  cast(1 + (tree_id * 5 + taxon * 17) % 97 AS double) / cast(1000 AS double) AS leaf_length FROM placed),
cum AS (SELECT *, sum(bit) OVER (PARTITION BY tree_id, side ORDER BY p ROWS UNBOUNDED PRECEDING) AS mask,
  row_number() OVER (PARTITION BY tree_id, side ORDER BY p) AS k FROM sided),
interior AS (SELECT sample, tree_id, side, cast(mask AS bigint) AS mask, cast(k AS int) AS size,
  cast(1 + (tree_id * 7 + px * 3 + side * 13 + k * 29) % 89 AS double) / cast(1000 AS double) AS length FROM cum WHERE k >= 2),
leaf AS (SELECT sample, tree_id, taxon, leaf_length AS length FROM sided)"""


#: Newick text of the trees, for DuckDB.
NEWICK_SQL = """texts AS (SELECT sample, tree_id, side, repeat('(', cast(count(*) - 1 AS int)) || string_agg(
  CASE WHEN k = 1 THEN '' ELSE ',' END || 'T' || taxon || ':' || leaf_length || CASE WHEN k = 1 THEN '' ELSE
  '):' || cast(1 + (tree_id * 7 + px * 3 + side * 13 + k * 29) % 89 AS double) / cast(1000 AS double) END, '' ORDER BY p) AS text
  FROM cum GROUP BY sample, tree_id, side),
trees AS (SELECT a.sample, a.tree_id, '(' || a.text || ',' || b.text || ');' AS newick FROM texts a JOIN texts b
  ON a.tree_id = b.tree_id AND a.side = 0 AND b.side = 1)"""


def labels(taxa: int = 8) -> list[str]:
    return [f"T{t}" for t in range(taxa)]


def trees(spark: SparkSession, sf_dir: str, taxa: int = 8) -> DataFrame:
    """``sample, tree_id, newick`` of all orders, each text from its own row by array functions."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS sample", "o_orderkey AS tree_id", "cast(floor(o_totalprice) AS bigint) AS px")
    # a row is small and its tree is not: rows are dealt out before they are turned to trees
    rows = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tree_id")
    least = 3 if taxa == 8 else 2
    key = "((tree_id % 11 + 1) * (t + 1) * 37 + (sample % 5) * t) % 101"
    rows = rows.withColumn("p", F.expr(f"array_sort(transform(sequence(0, {taxa - 1}), t -> struct({key} AS k, t AS t)))"))
    rows = rows.withColumn("m", F.expr(f"cast({least} + tree_id % {least} AS int)"))

    def side(number: int, start: str, size: str) -> str:
        leaf = "concat('T', x.t, ':', cast(1 + (tree_id * 5 + x.t * 17) % 97 AS double) / cast(1000 AS double))"
        length = f"cast(1 + (tree_id * 7 + px * 3 + {number} * 13 + (i + 1) * 29) % 89 AS double) / cast(1000 AS double)"
        piece = f"if(i = 0, {leaf}, concat(',', {leaf}, '):', {length}))"
        return f"concat(repeat('(', {size} - 1), array_join(transform(slice(p, {start}, {size}), (x, i) -> {piece}), ''))"

    text = f"concat('(', {side(0, '1', 'm')}, ',', {side(1, 'm + 1', f'({taxa} - m)')}, ');')"
    return rows.select("sample", "tree_id", F.expr(text).alias("newick"))


def alignment_sql(taxa: int = 8, part: str = "part") -> str:
    """``cells``: a letter for each taxon and site."""
    names = ", ".join(f"({t})" for t in range(taxa))
    x = "CASE WHEN (p_partkey + taxon * 3) % 7 < 5 THEN p_size ELSE p_size + taxon * (p_partkey % 3 + 1) END"
    return f"""cells AS (SELECT p_partkey AS site, taxon, CASE WHEN (p_partkey + taxon) % 13 = 0 THEN '-'
  ELSE substring('ACGT', cast(1 + ({x}) % 4 AS int), 1) END AS letter FROM {part} CROSS JOIN (VALUES {names}) AS t(taxon))"""


def cells(spark: SparkSession, sf_dir: str, taxa: int = 8) -> DataFrame:
    """``site, taxon, letter`` of all parts: the alignment in long form."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    return spark.sql(f"WITH {alignment_sql(taxa, '{part}')} SELECT * FROM cells", part=part)
