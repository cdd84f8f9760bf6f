"""A query for each operator over the driver's tables, and SQL for those that SQL can express.

The orders of a customer are one sample of trees (see sources/fixtures.py); numbers are rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import newick as N
from .jobs import workflows as W
from .operators import geodesics as G
from .operators import landscape as M
from .operators import likelihoods as L
from .operators import pairs as P
from .operators import sampling as S
from .operators import trees as T
from .operators.order import placed_in_sample
from .sources import files, fixtures
from .sources.store import fresh_path, saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EIGHT, FOUR = fixtures.tree_sql(8), fixtures.tree_sql(4)
LABELS = fixtures.labels(8)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def parsed(spark: SparkSession, sf_dir: str, taxa: int = 8) -> DataFrame:
    return T.parse_newick(fixtures.trees(spark, sf_dir, taxa), fixtures.labels(taxa)).drop("error")


def r6(x, name: str):
    return (F.round(x, 6) + 0.0).alias(name)


def n6(x, name: str):
    """Six decimals of a value that may stand on a rounding tie: both sides move it off the tie alike, and by half a unit of
    the tenth decimal more, so that one that is kept to ten decimals and one that is not go the same way."""
    return (F.round(x + 1.05e-9, 6) + 0.0).alias(name)


def all_edges(trees: DataFrame, *columns: str) -> DataFrame:
    """A row for each edge, interior ones and leaves, as ``mask, length`` beside the columns."""
    leaf = F.expr("transform(leaves, x -> named_struct('mask', cast(pow(2, x.taxon_id) as bigint), 'length', x.length))")
    inner = F.transform("splits", lambda x: F.struct(F.get(x["split"], F.lit(0)).alias("mask"), x["length"].alias("length")))
    return trees.select(*columns, F.explode(F.concat(inner, leaf)).alias("e")).select(*columns, "e.mask", "e.length")


def word(split="split", name: str = "mask"):
    return F.get(split, F.lit(0)).alias(name)


# Sources and sinks


@query(f"{EIGHT}, {fixtures.NEWICK_SQL} SELECT row_number() OVER (ORDER BY tree_id) - 1 AS line_id, newick FROM trees")
def read_newick(spark, sf_dir):
    path = fresh_path(spark, "newick")
    text = F.explode(F.array(F.concat(F.lit("tree = "), "newick"), F.lit("# note"), F.lit(""), F.lit("no tree")))
    fixtures.trees(spark, sf_dir).orderBy("tree_id").select(text.alias("value")).write.text(path)
    return files.read_newick(spark, path)


@query(f"WITH {fixtures.alignment_sql()} SELECT 'T' || taxon AS label, string_agg(letter, '' ORDER BY site) AS sequence FROM cells GROUP BY taxon")
def read_phylip(spark, sf_dir):
    path = fresh_path(spark, "phylip")
    rows = L.sequences(fixtures.cells(spark, sf_dir)).select(F.concat(F.rpad(F.concat(F.lit("T"), "taxon"), 10, " "), F.lit(" "), "sequence").alias("value"))
    rows.union(spark.createDataFrame([("8 2000",)], "value string")).write.text(path)
    return files.read_phylip(spark, path)


@query(f"WITH {fixtures.alignment_sql()} SELECT 'Taxon_number_T' || taxon AS label, string_agg(letter, '' ORDER BY site) AS sequence FROM cells GROUP BY taxon")
def read_phylip_extended(spark, sf_dir):
    path = fresh_path(spark, "phylip")
    rows = L.sequences(fixtures.cells(spark, sf_dir)).select(F.concat(F.lit("Taxon number T"), "taxon", F.lit("   "), "sequence").alias("value"))
    rows.union(spark.createDataFrame([("8 2000",)], "value string")).write.text(path)
    return files.read_phylip(spark, path, extended=True)


LOG = "[&index=' || event_id || ']tree TREE1 = ((A:' || user_id || ',B:1):2, C:3);"


@query(
    f"""WITH log AS (SELECT user_id AS sample, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx,
  count(*) OVER (PARTITION BY user_id) AS n, -value AS likelihood, '((A:' || user_id || ',B:1):2,C:3);' AS newick FROM events)
SELECT sample, idx, likelihood, newick FROM log WHERE idx >= n // 2 AND (idx - n // 2) % 3 = 0"""
)
def read_trace(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    idx = "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1"
    lines = events.select(F.concat_ws("\t", "user_id", F.expr(idx).cast("string"), F.col("value").cast("string"), (-F.col("value")).cast("string"), F.expr(f"'{LOG}'")).alias("value"))
    path = fresh_path(spark, "trace")
    lines.union(spark.createDataFrame([("sample\tindex\tposterior\tlikelihood\ttree",)], "value string")).write.text(path)
    return files.thin_trace(files.read_trace(spark, path), 3)


UNROOTED = f"""{EIGHT}, sides AS (SELECT sample, tree_id, CASE WHEN mask % 2 = 1 THEN 255 - mask ELSE mask END AS mask, sum(length) AS length
  FROM interior GROUP BY ALL), counts AS (SELECT sample, tree_id, count(*) AS n FROM sides GROUP BY ALL),
pairs AS (SELECT a.sample, a.tree_id AS i, b.tree_id AS j, a.n AS n_i, b.n AS n_j FROM counts a JOIN counts b ON a.sample = b.sample AND a.tree_id < b.tree_id),
common AS (SELECT a.tree_id AS i, b.tree_id AS j, count(*) AS n, sum(abs(a.length - b.length) - a.length - b.length) AS w
  FROM sides a JOIN sides b ON a.sample = b.sample AND a.mask = b.mask AND a.tree_id < b.tree_id GROUP BY ALL),
pendant AS (SELECT a.tree_id AS i, b.tree_id AS j, sum(abs(a.length - b.length)) AS w FROM leaf a JOIN leaf b
  ON a.sample = b.sample AND a.taxon = b.taxon AND a.tree_id < b.tree_id GROUP BY ALL),
total AS (SELECT tree_id, sum(length) AS t FROM sides GROUP BY ALL),
wrf AS (SELECT p.sample, p.i, p.j, x.t + y.t + coalesce(c.w, 0) + l.w AS d FROM pairs p JOIN total x ON x.tree_id = p.i JOIN total y ON y.tree_id = p.j
  JOIN pendant l ON l.i = p.i AND l.j = p.j LEFT JOIN common c ON c.i = p.i AND c.j = p.j)"""


def _wrf(spark, sf_dir):
    return P.rf_distances(parsed(spark, sf_dir), 8).select("sample", "i", "j", F.col("wrf").alias("d"))


@query(f"{UNROOTED} SELECT i, j, round(d, 4) AS d FROM wrf UNION ALL SELECT j, i, round(d, 4) FROM wrf")
def read_distances(spark, sf_dir):
    path = fresh_path(spark, "distances")
    files.write_distances(_wrf(spark, sf_dir), path)
    return files.read_distances(spark, path).select("i", "j", F.round("d", 4).alias("d"))


@query(f"{UNROOTED} SELECT i, j, cast(printf('%.5e', round(d, 9)) AS double) AS d FROM wrf")
def write_distances(spark, sf_dir):
    path = fresh_path(spark, "distances")
    files.write_distances(_wrf(spark, sf_dir).withColumn("d", F.round("d", 9)), path)
    return spark.read.csv(path, sep="\t", schema=files.DISTANCES)


LENGTHS = f"""{EIGHT}, lengths AS (SELECT sample, tree_id, round(sum(length), 6) AS length FROM (SELECT sample, tree_id, length FROM interior
  UNION ALL SELECT sample, tree_id, length FROM leaf) GROUP BY ALL), scored AS (SELECT sample, tree_id, -length AS lnl FROM lengths)"""


def scored(spark, sf_dir) -> DataFrame:
    """All trees with a simple score in the place of a log-likelihood: less its length."""
    return parsed(spark, sf_dir).withColumn("lnl", -F.round(T.tree_length(), 6))


LISTS = f"""{LENGTHS}, keys AS (SELECT sample, tree_id, string_agg(mask::varchar, ',' ORDER BY mask) AS key FROM interior GROUP BY ALL),
ranked AS (SELECT sample, tree_id, lnl, row_number() OVER (PARTITION BY sample ORDER BY lnl DESC, tree_id DESC) AS r,
  row_number() OVER (PARTITION BY sample, key ORDER BY lnl DESC, tree_id DESC) AS k FROM scored JOIN keys USING (sample, tree_id)),
lists AS (SELECT 'start' AS role, sample, tree_id, lnl FROM ranked UNION ALL SELECT 'best', sample, tree_id, lnl FROM ranked WHERE r <= 3
  UNION ALL SELECT 'optimised', sample, tree_id, lnl FROM ranked WHERE k = 1)"""


def _lists(spark, sf_dir) -> dict[str, DataFrame]:
    start = saved(scored(spark, sf_dir), "scored")
    top = L.best_per_topology(start.withColumn("topology", T.topology())).select("sample", "tree_id")
    return {"start": start, "best": L.best(start, 3), "optimised": start.join(top, ["sample", "tree_id"], "left_semi")}


@query(f"""{LISTS} SELECT role, sample, tree_id, lnl, 7::bigint AS n_commas FROM lists UNION ALL
  SELECT 'top', sample, tree_id, lnl, 7 FROM ranked WHERE r = 1""")
def write_results(spark, sf_dir):
    path = fresh_path(spark, "results")
    lists = _lists(spark, sf_dir)
    W.write_results(lists, LABELS, path)
    commas = F.length(F.regexp_replace("newick", "[^,]", "")).cast("long").alias("n_commas")
    parts = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("role"), "sample", "tree_id", "lnl", commas) for name in [*lists, "top"]]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"""{LISTS}, edges AS (SELECT tree_id, mask, length FROM interior UNION ALL SELECT tree_id, cast(1 << taxon AS bigint), length FROM leaf)
SELECT role, sample, l.tree_id, lnl, mask, length FROM lists l JOIN edges e ON e.tree_id = l.tree_id""")
def read_results(spark, sf_dir):
    path = fresh_path(spark, "results")
    lists = _lists(spark, sf_dir)
    W.write_results(lists, LABELS, path)
    again = W.read_results(spark, path, LABELS, list(lists))
    parts = [all_edges(x.withColumn("role", F.lit(name)), "role", "sample", "tree_id", "lnl") for name, x in again.items()]
    return parts[0].union(parts[1]).union(parts[2])


# Single trees


@query("""SELECT o_orderkey AS tree_id, CASE o_orderkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'unbalanced' WHEN 2 THEN 'no length' WHEN 3 THEN 'no comma'
  ELSE 'no length' END AS code FROM orders""")
def validate_newick(spark, sf_dir):
    t = F.col("newick")
    bad = (
        F.when(F.col("tree_id") % 5 == 0, t).when(F.col("tree_id") % 5 == 1, F.concat(F.lit("("), t)).when(F.col("tree_id") % 5 == 2, F.replace(t, F.lit(");"), F.lit("));")))
        .when(F.col("tree_id") % 5 == 3, F.concat(F.lit("(("), F.substring("newick", 2, 2), F.lit("a:1):1,b:1);"))).otherwise(F.regexp_replace("newick", r"\):", ")x"))
    )
    bad = F.when(F.col("tree_id") % 5 == 3, F.lit("((a:1):1,b:1);")).otherwise(bad)
    return T.validate_newick(fixtures.trees(spark, sf_dir).withColumn("newick", bad)).select("tree_id", "code")


@query(f"{EIGHT} SELECT sample, tree_id, mask, size, length FROM interior")
def parse_newick(spark, sf_dir):
    return T.splits(parsed(spark, sf_dir)).select("sample", "tree_id", word(), "size", "length")


@query(f"{EIGHT} SELECT tree_id, string_agg('T' || taxon, ',' ORDER BY taxon) AS clade, length FROM interior JOIN taxa ON (mask & bit) <> 0 GROUP BY tree_id, mask, length")
def tree_clades(spark, sf_dir):
    return T.splits(parsed(spark, sf_dir)).select("tree_id", F.array_join(T.clade_names(F.col("split"), LABELS), ",").alias("clade"), "length")


@query(f"{EIGHT} SELECT sample, tree_id, mask, size, length FROM interior")
def print_newick(spark, sf_dir):
    again = T.parse_newick(T.print_newick(parsed(spark, sf_dir), LABELS), LABELS)
    return T.splits(again).select("sample", "tree_id", word(), "size", "length")


@query(f"{LENGTHS} SELECT sample, tree_id, length FROM lengths")
def tree_length(spark, sf_dir):
    return parsed(spark, sf_dir).select("sample", "tree_id", r6(T.tree_length(), "length"))


def shortened(trees: DataFrame) -> DataFrame:
    """A variant with edges of length 0 and of 0.000001."""
    k = lambda x: (F.col("tree_id") + x["size"]) % 5
    return trees.withColumn("splits", F.transform("splits", lambda x: x.withField("length", F.when(k(x) == 0, 0.0).when(k(x) == 1, 0.000001).otherwise(x["length"]))))


SHORT = f"{EIGHT}, short AS (SELECT sample, tree_id, mask, size, CASE (tree_id + size) % 5 WHEN 0 THEN 0.0::double WHEN 1 THEN 0.000001::double ELSE length END AS length FROM interior)"


@query(f"{SHORT} SELECT tree_id, mask, CASE WHEN length = 0 THEN 1e-8::double ELSE length END AS length FROM short")
def clamp_zero_lengths(spark, sf_dir):
    return T.splits(T.clamp_zero_lengths(shortened(parsed(spark, sf_dir)))).select("tree_id", word(), "length")


@query(f"{SHORT} SELECT tree_id, mask, length FROM short WHERE length > 1e-5")
def to_multifurcating(spark, sf_dir):
    return T.splits(T.to_multifurcating(shortened(parsed(spark, sf_dir)))).select("tree_id", word(), "length")


@query(f"""{SHORT}, kept AS (SELECT tree_id, mask, size, length FROM short WHERE length > 1e-5),
node AS (SELECT tree_id, mask, size FROM kept UNION ALL SELECT tree_id, cast(1 << taxon AS bigint), 1 FROM leaf),
child AS (SELECT n.tree_id, n.mask, n.size, coalesce(arg_min(k.mask, k.size), 255) AS parent FROM node n
  LEFT JOIN kept k ON k.tree_id = n.tree_id AND k.size > n.size AND (k.mask & n.mask) = n.mask GROUP BY n.tree_id, n.mask, n.size),
ladder AS (SELECT tree_id, row_number() OVER w AS r, sum(mask) OVER w - first_value(mask) OVER w AS mask FROM child
  WINDOW w AS (PARTITION BY tree_id, parent ORDER BY size DESC, mask ROWS UNBOUNDED PRECEDING))
SELECT tree_id, mask, length FROM kept UNION ALL SELECT tree_id, cast(mask AS bigint), 0.0 FROM ladder WHERE r > 2""")
def to_bifurcating(spark, sf_dir):
    whole = T.to_bifurcating(T.to_multifurcating(shortened(parsed(spark, sf_dir))), 8)
    return T.splits(whole).select("tree_id", word(), "length")


SQUARES = f"{EIGHT}, squares AS (SELECT tree_id, sum(i) AS i, sum(l) AS l FROM (SELECT tree_id, length * length AS i, 0 AS l FROM interior UNION ALL SELECT tree_id, 0, length * length FROM leaf) GROUP BY ALL)"


@query(f"{SQUARES} SELECT tree_id, round(sqrt(i + l), 6) AS norm, round(sqrt(i), 6) AS inner_norm FROM squares")
def distance_from_origin(spark, sf_dir):
    return parsed(spark, sf_dir).select("tree_id", r6(T.norm(), "norm"), r6(T.norm(False), "inner_norm"))


@query(f"{SQUARES} SELECT tree_id, mask, round(length / sqrt(i + l), 6) AS length FROM interior JOIN squares USING (tree_id)")
def normalize_tree(spark, sf_dir):
    return T.splits(T.normalize(parsed(spark, sf_dir))).select("tree_id", word(), r6(F.col("length"), "length"))


@query(f"{EIGHT} SELECT tree_id, CASE WHEN mask >= 128 THEN 255 - mask ELSE mask END AS mask, CASE WHEN mask >= 128 THEN 8 - size ELSE size END AS size, length FROM interior")
def reroot_last_leaf(spark, sf_dir):
    return T.splits(T.reroot(parsed(spark, sf_dir), 8)).select("tree_id", word(), "size", "length")


@query(f"""{EIGHT} SELECT tree_id, string_agg('T' || taxon, ',' ORDER BY taxon) AS clade, length FROM interior JOIN taxa
  ON ((CASE WHEN (mask & 4) <> 0 THEN 255 - mask ELSE mask END) & bit) <> 0 GROUP BY tree_id, mask, length""")
def reroot_at_leaf(spark, sf_dir):
    return T.splits(T.reroot(parsed(spark, sf_dir), 8, 2)).select("tree_id", F.array_join(T.clade_names(F.col("split"), LABELS), ",").alias("clade"), "length")


@query(f"{SHORT} SELECT tree_id, 8::bigint AS n_leaves, count(*) FILTER (length > 1e-5) AS n_edges, count(*) FILTER (length > 1e-5) >= 6 AS is_binary FROM short GROUP BY tree_id")
def tree_shape(spark, sf_dir):
    n = F.size("splits").cast("long")
    return T.to_multifurcating(shortened(parsed(spark, sf_dir))).select("tree_id", F.size("leaves").cast("long").alias("n_leaves"), n.alias("n_edges"), (n >= F.size("leaves") - 2).alias("is_binary"))


@query("""SELECT o_orderkey AS tree_id, round(sqrt(power(o_orderkey % 7, 2) + 4), 6) AS norm, round((o_orderkey % 7) * 0.25 + o_custkey % 5 * 0.75, 6) AS first,
  CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 1.25 END::double AS second FROM orders""")
def edge_attr_ops(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a = T.parse_attribute(F.concat(F.lit("["), F.col("o_orderkey") % 7, F.lit(" 2]")))
    b = T.parse_attribute(F.concat(F.lit("["), F.col("o_custkey") % 5, F.lit(" 1]")))
    both = T.combine_attributes(a, b, 0.25, 0.75)
    second = T.combine_attributes(a, F.when(F.col("o_orderkey") % 3 != 0, b), 0.25, 0.75)[1]  # a missing one counts as zeros
    return orders.select(F.col("o_orderkey").alias("tree_id"), r6(T.attribute_norm(a), "norm"), r6(both[0], "first"), r6(second, "second"))


@query(f"""{EIGHT} SELECT tree_id, cast(sum(1 << cast((taxon * 3 + 1) % 8 AS int)) AS bigint) AS mask, length FROM interior JOIN taxa ON (mask & bit) <> 0
  GROUP BY tree_id, interior.mask, length
  UNION ALL SELECT tree_id, cast(1 << cast((taxon * 3 + 1) % 8 AS int) AS bigint), length FROM leaf""")
def relabel_leaves(spark, sf_dir):
    return all_edges(T.relabel(parsed(spark, sf_dir), [(t * 3 + 1) % 8 for t in range(8)]), "tree_id")


@query(f"""{EIGHT} SELECT tree_id, mask, length FROM interior WHERE mask NOT IN (3, 12, 48) UNION ALL
  SELECT tree_id, 192::bigint, 0.5::double FROM interior GROUP BY tree_id HAVING count(*) FILTER (mask = 192) = 0""")
def edit_splits(spark, sf_dir):
    gone = F.array(*(F.array(F.lit(m).cast("long")) for m in (3, 12, 48)))
    new = F.array(F.struct(F.array(F.lit(192).cast("long")).alias("split"), F.lit(2).alias("size"), F.lit(0.5).alias("length")))
    return T.splits(T.edit_splits(parsed(spark, sf_dir), gone, new)).select("tree_id", word(), "length")


@query(f"{EIGHT} SELECT sample, tree_id, mask, 2::bigint AS n FROM interior WHERE size = 2 AND tree_id % 3 = 0")
def duplicate_splits(spark, sf_dir):
    again = F.when(F.col("tree_id") % 3 == 0, F.filter("splits", lambda x: x["size"] == 2)).otherwise(F.array().cast(T.SPLITS))
    twice = parsed(spark, sf_dir).withColumn("splits", F.concat("splits", again))
    return T.duplicate_splits(twice).select("sample", "tree_id", word(), "n")


@query("""WITH x AS (SELECT o_orderkey AS tree_id, o_custkey AS sample, o_orderkey % 3 = 0 AS odd FROM orders),
first AS (SELECT sample, arg_min(odd, tree_id) AS odd FROM x GROUP BY sample) SELECT x.sample, x.tree_id FROM x JOIN first USING (sample) WHERE x.odd <> first.odd""")
def leafset_check(spark, sf_dir):
    odd = F.when(F.col("tree_id") % 3 == 0, F.slice("leaves", 1, 7)).otherwise(F.col("leaves"))
    return T.leafset_check(parsed(spark, sf_dir).withColumn("leaves", odd)).select("sample", "tree_id")


# Alignment and likelihood


@query(f"""WITH {fixtures.alignment_sql()}, s AS (SELECT site, count(DISTINCT letter) FILTER (letter <> '-') > 1 AS v FROM cells GROUP BY site)
SELECT count(*) FILTER (v) AS variable, count(*) AS total, round(count(*) FILTER (v) / count(*), 6) AS p FROM s""")
def variable_sites(spark, sf_dir):
    return L.variable_sites(fixtures.cells(spark, sf_dir)).select("variable", "total", r6(F.col("p"), "p"))


@query("""SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN left(p_brand, -1) || '_' || right(p_brand, 1) ELSE '_' || p_brand || '_' END AS label,
  CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS sequence_label FROM part""")
def match_labels(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    marked = F.expr("concat(left(p_brand, length(p_brand) - 1), '_', right(p_brand, 1))")
    label = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, marked).otherwise(F.concat(F.lit("_"), "p_brand", F.lit("_")))
    return L.match_labels(part.select(label.alias("label")).distinct(), part.select(F.col("p_brand").alias("label")))


@query(f"""WITH {fixtures.alignment_sql()} SELECT site, taxon, (letter IN ('A', '-'))::int::double AS a, (letter IN ('C', '-'))::int::double AS c,
  (letter IN ('G', '-'))::int::double AS g, (letter IN ('T', '-'))::int::double AS t FROM cells""")
def tip_conditionals(spark, sf_dir):
    x = fixtures.cells(spark, sf_dir).withColumn("x", L.tip_conditionals(F.col("letter")))
    return x.select("site", "taxon", *(F.col("x")[k].alias(n) for k, n in enumerate("acgt")))


@query(f"{EIGHT} SELECT tree_id, mask, round(0.25 + 0.75 * exp(-4 * length / 3), 6) AS same, round(0.25 - 0.25 * exp(-4 * length / 3), 6) AS other FROM interior")
def transition_probs(spark, sf_dir):
    edges = T.splits(parsed(spark, sf_dir))
    return edges.select("tree_id", word(), r6(L.jukes_cantor(F.col("length"), True), "same"), r6(L.jukes_cantor(F.col("length"), False), "other"))


def likelihood_sql() -> str:
    """Pruning on eight taxa written out: each side of a tree is a caterpillar of three to five leaves, so a site's conditionals
    go up from its first two leaves, one leaf after another, and both sides meet at the root."""
    letters = "ACGT"
    prob = lambda x, n: f"0.25 + 0.75 * exp(-4 * {x} / 3) AS s{n}, 0.25 - 0.25 * exp(-4 * {x} / 3) AS d{n}"
    leaf = lambda k, c: f"CASE x[t{k} + 1] WHEN '-' THEN 1 WHEN '{c}' THEN sl{k} ELSE dl{k} END"
    each = lambda name, of: ", ".join(f"{of(c)} AS {name}{c}" for c in letters)
    up = lambda k, c: f"(de{k} * (" + " + ".join(f"n{k}{d}" for d in letters) + f") + (se{k} - de{k}) * n{k}{c})"
    steps = [f"v2 AS (SELECT *, {each('n2', lambda c: f'{leaf(1, c)} * {leaf(2, c)}')} FROM met)"]
    for k in (3, 4, 5):
        steps.append(f"v{k} AS (SELECT * EXCLUDE ({', '.join(f'n{k - 1}{c}' for c in letters)}), {each(f'g{k}', lambda c: up(k - 1, c))} FROM v{k - 1})")
        more = lambda c: f"g{k}{c} * {leaf(k, c)}"  # noqa: E731,B023
        if k == 3:  # every side has three leaves
            steps.append(f"w3 AS (SELECT * EXCLUDE ({', '.join(f'g3{c}' for c in letters)}), {each('n3', more)} FROM v3)")
        else:  # a side that ends before keeps what it has
            steps.append(f"w{k} AS (SELECT * EXCLUDE ({', '.join(f'g{k}{c}' for c in letters)}), {each(f'n{k}', lambda c: f'CASE WHEN m >= {k} THEN {more(c)} ELSE g{k}{c} END')} FROM v{k})")
        steps[-2] = steps[-2].replace(f"FROM v{k - 1})", f"FROM {'v2' if k == 3 else f'w{k - 1}'})")
    return f"""{EIGHT}, {fixtures.alignment_sql()},
pat AS (SELECT x, count(*) AS w FROM (SELECT list(letter ORDER BY taxon) AS x FROM cells GROUP BY site) GROUP BY x),
e AS (SELECT tree_id, side, {', '.join(f"max(length) FILTER (size = {k}) AS e{k}" for k in (2, 3, 4, 5))} FROM interior GROUP BY ALL),
l AS (SELECT sample, tree_id, side, count(*) AS m, {', '.join(f"max(taxon) FILTER (k = {k}) AS t{k}, max(leaf_length) FILTER (k = {k}) AS l{k}" for k in range(1, 6))} FROM cum GROUP BY ALL),
half AS (SELECT sample, tree_id, side, m, {', '.join(f"t{k}, {prob(f'l{k}', f'l{k}')}" for k in range(1, 6))}, {', '.join(prob(f'coalesce(e{k}, 0)', f'e{k}') for k in (2, 3, 4, 5))} FROM l JOIN e USING (tree_id, side)),
met AS (SELECT * FROM half CROSS JOIN pat), {', '.join(steps)},
top AS (SELECT sample, tree_id, side, x, w, {each('u', lambda c: up(5, c))} FROM w5)
SELECT a.sample, a.tree_id, round(sum(a.w * ln(0.25 * ({' + '.join(f'a.u{c} * b.u{c}' for c in letters)}))) + 1.05e-6, 3) AS lnl
FROM top a JOIN top b ON a.tree_id = b.tree_id AND a.x = b.x AND a.side = 0 AND b.side = 1 GROUP BY ALL"""


@query(likelihood_sql())
def log_likelihood(spark, sf_dir):
    found = L.log_likelihoods(parsed(spark, sf_dir), L.patterns(fixtures.cells(spark, sf_dir)))
    return found.select("sample", "tree_id", (F.round(F.col("lnl") + 1.05e-6, 3) + 0.0).alias("lnl"))


def _one_each(spark, sf_dir) -> DataFrame:
    """The best tree of each topology over all samples."""
    trees = scored(spark, sf_dir).withColumn("topology", T.topology())
    top = L.best_per_topology(trees.withColumn("sample", F.lit(0).cast("long"))).select("tree_id")
    return trees.join(top, "tree_id", "left_semi").select("sample", "tree_id", "splits", "leaves")


@query()
def optimize_nr(spark, sf_dir):
    found = L.optimize(_one_each(spark, sf_dir), L.patterns(fixtures.cells(spark, sf_dir)), 8)
    return found.select("sample", "tree_id", "lnl_before", "lnl", r6(T.tree_length(), "length"))


@query()
def optimize_nm(spark, sf_dir):
    found = L.optimize(_one_each(spark, sf_dir), L.patterns(fixtures.cells(spark, sf_dir)), 8, "nelder_mead")
    return found.select("sample", "tree_id", "lnl_before", "lnl", r6(T.tree_length(), "length"))


# Pairs

PAIRS = f"{EIGHT}, pairs AS (SELECT a.sample, a.tree_id AS i, b.tree_id AS j FROM (SELECT DISTINCT sample, tree_id FROM base) a JOIN (SELECT DISTINCT sample, tree_id FROM base) b ON a.sample = b.sample AND a.tree_id < b.tree_id)"
CROSS = "(a.mask & b.mask) <> 0 AND (a.mask & b.mask) <> a.mask AND (a.mask & b.mask) <> b.mask"


@query(f"{PAIRS} SELECT sample, i, j FROM pairs")
def tree_pairs(spark, sf_dir):
    return P.tree_pairs(parsed(spark, sf_dir)).select("sample", "i", "j")


@query(f"""{EIGHT}, long AS (SELECT * FROM interior WHERE (tree_id + size) % 5 > 0),
p AS (SELECT a.sample, a.tree_id AS i, b.tree_id AS j FROM base a JOIN base b ON a.sample = b.sample AND a.tree_id < b.tree_id),
x AS (SELECT i, j, mask, length AS l1, 0 AS l2 FROM p JOIN long a ON a.tree_id = i WHERE NOT EXISTS (SELECT 1 FROM long b WHERE b.tree_id = j AND {CROSS})
  UNION ALL SELECT i, j, mask, 0, length FROM p JOIN long a ON a.tree_id = j WHERE NOT EXISTS (SELECT 1 FROM long b WHERE b.tree_id = i AND {CROSS}))
SELECT i, j, mask, round(sum(l1), 6) AS l1, round(sum(l2), 6) AS l2 FROM x GROUP BY i, j, mask""")
def common_edges(spark, sf_dir):
    trees = parsed(spark, sf_dir).withColumn("splits", F.filter("splits", lambda x: (F.col("tree_id") + x["size"]) % 5 > 0))
    return P.common_edges(P.tree_pairs(trees)).select("i", "j", word(), r6(F.col("l1"), "l1"), r6(F.col("l2"), "l2"))


@query(f"""{PAIRS} SELECT DISTINCT p.i, p.j, a.mask FROM pairs p JOIN interior a ON a.tree_id = p.i JOIN interior b ON b.tree_id = p.j AND {CROSS}""")
def incompatible_edges(spark, sf_dir):
    pairs = P.tree_pairs(parsed(spark, sf_dir))
    return pairs.select("i", "j", F.explode(P.incompatible_edges(pairs)).alias("x")).select("i", "j", word("x.split"))


@query(f"""{EIGHT}, e AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY mask) - 1 AS r FROM interior)
SELECT a.tree_id AS i, b.tree_id AS j, a.mask AS a, cast(sum(CASE WHEN {CROSS} THEN 1 << b.r ELSE 0 END) AS bigint) AS crossed FROM e a JOIN e b ON a.sample = b.sample AND a.tree_id < b.tree_id GROUP BY ALL""")
def crossing_matrix(spark, sf_dir):
    return P.incidence(P.tree_pairs(parsed(spark, sf_dir))).select("i", "j", word("a", "a"), word("crossed", "crossed"))


TOPOLOGY = f"{EIGHT}, keys AS (SELECT sample, tree_id, string_agg(mask::varchar, ',' ORDER BY mask) AS key FROM interior GROUP BY ALL)"


@query(f"{TOPOLOGY} SELECT a.sample, a.tree_id AS i, b.tree_id AS j FROM keys a JOIN keys b ON a.sample = b.sample AND a.key = b.key AND a.tree_id < b.tree_id")
def same_topology(spark, sf_dir):
    # a class's trees are met by blocks, so that no topology that many trees share comes to one task
    classes = saved(T.topology_classes(parsed(spark, sf_dir)).where("n_same > 0"), "classes")
    met = P.all_pairs(classes, [], keys=["first"])
    return met.select("sample", F.col("a.tree_id").alias("i"), F.col("b.tree_id").alias("j"))


@query(f"{UNROOTED} SELECT p.sample, p.i, p.j, n_i + n_j - 2 * coalesce(c.n, 0) AS rf FROM pairs p LEFT JOIN common c ON p.i = c.i AND p.j = c.j")
def rf_distance(spark, sf_dir):
    return P.rf_distances(parsed(spark, sf_dir), 8).select("sample", "i", "j", "rf")


@query(f"{UNROOTED} SELECT sample, i, j, round(d, 6) AS wrf FROM wrf")
def wrf_distance(spark, sf_dir):
    return P.rf_distances(parsed(spark, sf_dir), 8).select("sample", "i", "j", r6(F.col("wrf"), "wrf"))


KC = f"""{EIGHT}, tp AS (SELECT x.taxon AS a, y.taxon AS b, x.bit AS abit, y.bit AS bbit FROM taxa x JOIN taxa y ON x.taxon < y.taxon),
kc AS (SELECT s.sample, s.tree_id, a, b, count(i.mask) AS m, coalesce(sum(i.length), 0) AS big_m FROM base s CROSS JOIN tp
  LEFT JOIN interior i ON i.tree_id = s.tree_id AND (i.mask & abit) <> 0 AND (i.mask & bbit) <> 0 GROUP BY ALL
  UNION ALL SELECT sample, tree_id, taxon, taxon, 1, length FROM leaf)"""


@query(f"""{EIGHT} SELECT tree_id, x.taxon AS a, y.taxon AS b, sum(CASE WHEN (mask & x.bit) <> 0 AND (mask & y.bit) <> 0 THEN 1 ELSE 0 END)::double AS m,
  round(sum(CASE WHEN (mask & x.bit) <> 0 AND (mask & y.bit) <> 0 THEN length ELSE 0 END), 6) AS big_m
  FROM interior CROSS JOIN taxa x CROSS JOIN taxa y WHERE x.taxon < y.taxon GROUP BY ALL""")
def kc_vectors(spark, sf_dir):
    names = [(a, b) for a in range(8) for b in range(a + 1, 8)]
    v = P.kc_vectors(parsed(spark, sf_dir), 8)
    both = F.arrays_zip(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in names)).alias("p"), F.slice("m", 1, 28).alias("m"), F.slice("big_m", 1, 28).alias("big_m"))
    return v.select("tree_id", F.explode(both).alias("x")).select("tree_id", "x.p.a", "x.p.b", "x.m", r6(F.col("x.big_m"), "big_m"))


@query(f"""{KC}, sums AS (SELECT tree_id, sum(m) AS sm, sum(big_m) AS sb FROM kc GROUP BY tree_id),
v AS (SELECT sample, tree_id, a, b, 0.5 * m / sm + 0.5 * big_m / sb AS v FROM kc JOIN sums USING (tree_id))
SELECT x.sample, x.tree_id AS i, y.tree_id AS j, round(sqrt(sum((x.v - y.v) * (x.v - y.v))), 6) AS d FROM v x JOIN v y
  ON x.sample = y.sample AND x.a = y.a AND x.b = y.b AND x.tree_id < y.tree_id GROUP BY ALL""")
def kc_distance(spark, sf_dir):
    return P.kc_distances(parsed(spark, sf_dir), 8, 0.5).select("sample", "i", "j", r6(F.col("d"), "d"))


# Geodesics, on four taxa where a closed form exists

GEO = f"""{FOUR}, t AS (SELECT sample, tree_id, min(mask) AS m1, max(mask) AS m2, arg_min(length, mask) AS l1, arg_max(length, mask) AS l2 FROM interior GROUP BY ALL),
p AS (SELECT a.sample, a.tree_id AS i, b.tree_id AS j, a.m1 AS a1, a.m2 AS a2, a.l1 AS x1, a.l2 AS x2, b.m1 AS b1, b.m2 AS b2, b.l1 AS y1, b.l2 AS y2
  FROM t a JOIN t b ON a.sample = b.sample AND a.tree_id < b.tree_id),
lf AS (SELECT a.tree_id AS i, b.tree_id AS j, sum(power(a.length - b.length, 2)) AS leaf2 FROM leaf a JOIN leaf b ON a.sample = b.sample AND a.taxon = b.taxon AND a.tree_id < b.tree_id GROUP BY ALL),
c AS (SELECT p.*, leaf2, (a1 IN (b1, b2))::int + (a2 IN (b1, b2))::int AS n,
  CASE WHEN a1 = b1 THEN power(x1 - y1, 2) WHEN a1 = b2 THEN power(x1 - y2, 2) ELSE 0 END + CASE WHEN a2 = b1 THEN power(x2 - y1, 2) WHEN a2 = b2 THEN power(x2 - y2, 2) ELSE 0 END AS common2,
  CASE WHEN a1 IN (b1, b2) THEN x2 ELSE x1 END AS xa, CASE WHEN b1 IN (a1, a2) THEN y2 ELSE y1 END AS yb,
  CASE WHEN a1 IN (b1, b2) THEN a2 ELSE a1 END AS ma, CASE WHEN b1 IN (a1, a2) THEN b2 ELSE b1 END AS mb FROM p JOIN lf USING (i, j)),
steps AS (SELECT c.*, u.ai, u.mi, u.ak, u.mk, w.bj, w.mj, w.bl, w.ml FROM c, LATERAL (SELECT x1 AS ai, a1 AS mi, x2 AS ak, a2 AS mk UNION ALL SELECT x2, a2, x1, a1) u,
  LATERAL (SELECT y1 AS bj, b1 AS mj, y2 AS bl, b2 AS ml UNION ALL SELECT y2, b2, y1, b1) w WHERE n = 0),
two AS (SELECT i, j, min(power(ai + bj, 2) + power(ak + bl, 2)) AS s,
  arg_min(struct_pack(ai := ai, mi := mi, ak := ak, mk := mk, bj := bj, mj := mj, bl := bl, ml := ml), power(ai + bj, 2) + power(ak + bl, 2)) AS t FROM steps
  WHERE NOT ((mk & mj) <> 0 AND (mk & mj) <> mk AND (mk & mj) <> mj) AND round(ai * 1000) * round(bl * 1000) < round(ak * 1000) * round(bj * 1000) GROUP BY i, j),
geo AS (SELECT c.*, two.s IS NOT NULL AS stepped, t.ai, t.mi, t.ak, t.mk, t.bj, t.mj, t.bl, t.ml, t.ai / (t.ai + t.bj) AS f1, t.ak / (t.ak + t.bl) AS f2,
  sqrt(x1 * x1 + x2 * x2) AS na, sqrt(y1 * y1 + y2 * y2) AS nb,
  CASE n WHEN 2 THEN 0 WHEN 1 THEN power(xa + yb, 2) ELSE coalesce(two.s, power(sqrt(x1 * x1 + x2 * x2) + sqrt(y1 * y1 + y2 * y2), 2)) END AS part2 FROM c LEFT JOIN two USING (i, j))"""

# a row for each edge: of the ratios (r from 0, side a dropped, side b added), and of what both trees have (leaves too)
PARTS = f"""{GEO}, sup AS (SELECT i, j, 0 AS r, xa AS na, yb AS nb, unnest(['a', 'b']) AS side, unnest([ma, mb]) AS mask, unnest([xa, yb]) AS length FROM geo WHERE n = 1
  UNION ALL SELECT i, j, 0, na, nb, unnest(['a', 'a', 'b', 'b']), unnest([a1, a2, b1, b2]), unnest([x1, x2, y1, y2]) FROM geo WHERE n = 0 AND NOT stepped
  UNION ALL SELECT i, j, unnest([0, 0, 1, 1]), unnest([ai, ai, ak, ak]), unnest([bj, bj, bl, bl]), unnest(['a', 'b', 'a', 'b']), unnest([mi, mj, mk, ml]), unnest([ai, bj, ak, bl])
  FROM geo WHERE n = 0 AND stepped),
com AS (SELECT i, j, a1 AS mask, x1 AS l1, CASE WHEN a1 = b1 THEN y1 ELSE y2 END AS l2 FROM geo WHERE a1 IN (b1, b2)
  UNION ALL SELECT i, j, a2, x2, CASE WHEN a2 = b1 THEN y1 ELSE y2 END FROM geo WHERE a2 IN (b1, b2)),
lv AS (SELECT a.tree_id AS i, b.tree_id AS j, cast(1 << a.taxon AS bigint) AS mask, a.length AS l1, b.length AS l2 FROM leaf a
  JOIN leaf b ON a.sample = b.sample AND a.taxon = b.taxon AND a.tree_id < b.tree_id),
shared AS (SELECT * FROM com UNION ALL SELECT * FROM lv),
lim AS (SELECT DISTINCT i, j, r, round(na / (na + nb), 10) AS pos FROM sup)"""


def trees_sql(places: str, more: str = "") -> str:
    """Edges of the trees at the places (i, j, pos) of the pairs' geodesics."""
    return f"""{PARTS}, q AS ({places}), tree AS (SELECT i, j, pos, mask, (1 - pos) * l1 + pos * l2 AS length FROM q JOIN shared USING (i, j)
  UNION ALL SELECT i, j, pos, mask, CASE side WHEN 'a' THEN length * ((1 - pos) * na - pos * nb) / na ELSE length * (pos * nb - (1 - pos) * na) / nb END FROM q JOIN sup USING (i, j))
SELECT i, j, {more}round(pos + 1.05e-9, 6) AS pos, mask, round(length + 1.05e-9, 6) AS length FROM tree WHERE length > 1e-9"""


def edges_at(trees: DataFrame, *more: str) -> DataFrame:
    rows = all_edges(trees, "i", "j", "at", *more).where("length > 1e-9")
    return rows.select("i", "j", *more, n6(F.col("at"), "pos"), "mask", n6(F.col("length"), "length"))


def _geo(spark, sf_dir, taxa: int = 4, strict: bool = False) -> DataFrame:
    return G.geodesics(P.tree_pairs(parsed(spark, sf_dir, taxa)), taxa, strict)


@query(f"{GEO} SELECT i, j, round(leaf2, 6) AS leaf2, round(common2, 6) AS common2 FROM geo")
def geo_contributions(spark, sf_dir):
    found = G.contributions(P.tree_pairs(parsed(spark, sf_dir, 4)))
    return found.select("i", "j", r6(F.col("leaf_square"), "leaf2"), r6(F.col("common_square"), "common2"))


@query(f"""{EIGHT}, p AS (SELECT a.sample, a.tree_id AS i, b.tree_id AS j FROM base a JOIN base b ON a.sample = b.sample AND a.tree_id < b.tree_id),
shared AS (SELECT i, j, a.mask, a.size FROM p JOIN interior a ON a.tree_id = i JOIN interior b ON b.tree_id = j AND a.mask = b.mask),
own AS (SELECT i, j, mask FROM p JOIN interior a ON a.tree_id = i WHERE NOT EXISTS (SELECT 1 FROM interior b WHERE b.tree_id = j AND b.mask = a.mask))
SELECT o.i, o.j, o.mask, coalesce(arg_min(s.mask, s.size), 0) AS part FROM own o LEFT JOIN shared s ON s.i = o.i AND s.j = o.j AND (s.mask & o.mask) = o.mask GROUP BY ALL""")
def geo_decompose(spark, sf_dir):
    found = _geo(spark, sf_dir, 8).select("i", "j", F.explode("supports").alias("s"))
    return found.select("i", "j", F.explode("s.a").alias("e"), F.col("s.part").alias("part")).select("i", "j", word("e.split"), word("part", "part"))


@query(f"{GEO} SELECT i, j, (CASE WHEN n = 2 THEN 0 WHEN n = 1 THEN 1 WHEN stepped THEN 2 ELSE 1 END)::bigint AS n_ratios FROM geo")
def geo_supports(spark, sf_dir):
    return _geo(spark, sf_dir, strict=True).select("i", "j", F.size("supports").cast("long").alias("n_ratios"))


@query(f"""{GEO} SELECT i, j, CASE WHEN n = 2 THEN '' WHEN n = 1 THEN round(xa / (xa + yb) + 1e-9, 6)::varchar
  WHEN stepped THEN round(f1 + 1e-9, 6) || ',' || round(f2 + 1e-9, 6) ELSE round(na / (na + nb) + 1e-9, 6)::varchar END AS limits FROM geo""")
def geo_ratio_merge(spark, sf_dir):
    at = F.transform("supports", lambda s: F.round(s["a_norm"] / (s["a_norm"] + s["b_norm"]) + 1e-9, 6).cast("string"))
    return _geo(spark, sf_dir, strict=True).select("i", "j", F.array_join(at, ",").alias("limits"))


@query(f"{GEO} SELECT sample, i, j, round(sqrt(leaf2 + common2 + part2), 6) AS d FROM geo")
def geodesic_distance(spark, sf_dir):
    return G.distances(parsed(spark, sf_dir, 4), 4).select("sample", "i", "j", r6(F.col("d"), "d"))


@query(f"""{PARTS}, row_ AS (SELECT i, j, r, na, nb, string_agg(mask::varchar, ',' ORDER BY mask) FILTER (side = 'a') AS dropped, string_agg(mask::varchar, ',' ORDER BY mask) FILTER (side = 'b') AS added FROM sup GROUP BY ALL)
SELECT i, j, r AS place, round(na / nb + 1.05e-9, 6) AS ratio, round(na + 1.05e-9, 6) AS a_norm, round(nb + 1.05e-9, 6) AS b_norm, dropped, added,
  string_agg('{{' || dropped || '}}/{{' || added || '}};', '' ORDER BY r) OVER (PARTITION BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS type FROM row_""")
def geodesic_report(spark, sf_dir):
    geo = saved(_geo(spark, sf_dir, strict=True), "geodesics")
    first = lambda m: F.get(m, F.lit(0)).cast("string")
    rows = G.report(geo).join(geo.select("i", "j", G.combinatorial_type(first).alias("type")), ["i", "j"])
    text = lambda c: F.array_join(F.transform(c, first), ",").alias(c)
    return rows.select("i", "j", "place", n6(F.col("ratio"), "ratio"), n6(F.col("a_norm"), "a_norm"), n6(F.col("b_norm"), "b_norm"), text("dropped"), text("added"), "type")


@query(f"""{PARTS}, q AS (SELECT i, j, unnest(range(CASE WHEN n = 2 THEN 1 WHEN stepped THEN 3 ELSE 2 END)) AS leg FROM geo),
e AS (SELECT i, j, mask, 0 AS f, 99 AS t FROM com UNION ALL SELECT i, j, mask, CASE side WHEN 'a' THEN 0 ELSE r + 1 END, CASE side WHEN 'a' THEN r ELSE 99 END FROM sup)
SELECT q.i, q.j, cast(leg AS int) AS leg, round(coalesce(lo.pos, 0) + 1.05e-9, 6) AS low, round(coalesce(hi.pos, 1) + 1.05e-9, 6) AS high, mask
FROM q JOIN e ON e.i = q.i AND e.j = q.j AND leg BETWEEN f AND t LEFT JOIN lim lo ON lo.i = q.i AND lo.j = q.j AND lo.r = leg - 1
LEFT JOIN lim hi ON hi.i = q.i AND hi.j = q.j AND hi.r = leg""")
def geodesic_legs(spark, sf_dir):
    legs = G.legs(_geo(spark, sf_dir, strict=True))
    return legs.select("i", "j", "leg", n6(F.col("low"), "low"), n6(F.col("high"), "high"), F.explode("splits").alias("s")).select("i", "j", "leg", "low", "high", word("s"))


@query(trees_sql("SELECT i, j, 0.3::double AS pos FROM geo"))
def tree_at(spark, sf_dir):
    return edges_at(G.tree_at(_geo(spark, sf_dir).withColumn("at", F.lit(0.3)), "at"))


@query(trees_sql("SELECT i, j, unnest([0.25, 0.5, 0.75])::double AS pos FROM geo", "2::bigint AS n_edges, "))
def path_trees(spark, sf_dir):
    path = W.path_trees(parsed(spark, sf_dir, 4), 5, 4)
    return edges_at(path.withColumn("n_edges", F.size("splits").cast("long")), "n_edges")


@query(trees_sql("SELECT i, j, pos FROM lim"))
def boundary_trees(spark, sf_dir):
    return edges_at(G.tree_at(_geo(spark, sf_dir, strict=True).withColumn("at", F.explode(F.transform("supports", G.limit))), "at"))


@query(trees_sql("SELECT i, j, avg(pos) AS pos FROM lim GROUP BY i, j HAVING count(*) = 2"))
def mid_orthant_trees(spark, sf_dir):
    inner = F.zip_with(F.slice(G.limits(), F.lit(2), F.greatest(F.size("supports") - 1, F.lit(0))), F.slice(G.limits(), F.lit(3), F.greatest(F.size("supports") - 1, F.lit(0))), lambda a, b: (a + b) / 2)
    return edges_at(G.tree_at(_geo(spark, sf_dir, strict=True).withColumn("at", F.explode(inner)), "at"))


@query(f"""{PARTS} SELECT j AS i, i AS j, cast(CASE WHEN stepped THEN 1 - r ELSE r END AS int) AS place, round(s.nb / (s.na + s.nb) + 1.05e-9, 6) AS pos,
  CASE side WHEN 'a' THEN 'added' ELSE 'dropped' END AS step, mask, length FROM sup s JOIN geo USING (i, j)""")
def reverse_geodesic(spark, sf_dir):
    back = G.reverse(_geo(spark, sf_dir, strict=True)).select("i", "j", F.posexplode("supports").alias("place", "s"))
    sides = F.explode(F.array(*(F.struct(F.lit(step).alias("step"), F.col(f"s.{side}").alias("e")) for step, side in (("dropped", "a"), ("added", "b")))))
    rows = back.select("i", "j", "place", n6(G.limit(F.col("s")), "pos"), sides.alias("x"))
    return rows.select("i", "j", "place", "pos", "x.step", F.explode("x.e").alias("e")).select("i", "j", "place", "pos", "step", word("e.split"), "e.length")


@query(f"{GEO} SELECT i, j, round(sqrt(leaf2 + common2 + part2) + 1.05e-9, 6) AS d1, 1000::bigint AS off FROM geo WHERE (i + j) % 11 = 0")
def distance_double_check(spark, sf_dir):
    there = P.tree_pairs(parsed(spark, sf_dir, 4))
    back = there.select("sample", F.col("j").alias("i"), F.col("i").alias("j"), F.col("b_splits").alias("a_splits"), F.col("a_splits").alias("b_splits"), F.col("b_leaves").alias("a_leaves"), F.col("a_leaves").alias("b_leaves"))
    # both ways are held against each other at ten decimals; every eleventh pair is off by a planted error
    wrong = F.when((F.col("i") + F.col("j")) % 11 == 0, F.lit(1e-6)).otherwise(0.0)
    a = G.geodesics(there, 4).select("i", "j", F.round(G.distance(), 12).alias("d"))
    b = G.geodesics(back, 4).select(F.col("j").alias("i"), F.col("i").alias("j"), F.round(G.distance() + wrong, 12).alias("d"))
    return P.differing(a, b, ["i", "j"]).select("i", "j", n6(F.col("d1"), "d1"), F.round((F.col("d2") - F.col("d1")) * 1e9).cast("long").alias("off"))


@query(f"{UNROOTED} SELECT i, j, round(d + 1.05e-9, 6) AS d1, round(d + 0.001 + 1.05e-9, 6) AS d2 FROM wrf WHERE (i + j) % 7 = 0")
def compare_distances(spark, sf_dir):
    d = _wrf(spark, sf_dir).select("i", "j", "d")
    other = d.withColumn("d", F.when((F.col("i") + F.col("j")) % 7 == 0, F.col("d") + 0.001).otherwise(F.col("d")))
    return P.differing(d, other, ["i", "j"]).select("i", "j", n6(F.col("d1"), "d1"), n6(F.col("d2"), "d2"))


@query(f"""{PARTS} SELECT i, j, mask, round(l2 - l1 + 1.05e-9, 6) AS x FROM shared UNION ALL
  SELECT i, j, mask, round(-length * (na + nb) / na + 1.05e-9, 6) FROM sup WHERE side = 'a'""")
def log_map(spark, sf_dir):
    m = G.log_map(_geo(spark, sf_dir))
    leaf = F.transform("leaf", lambda x, k: F.struct(F.pow(F.lit(2), k).cast("long").alias("mask"), x.alias("x")))
    edges = F.transform("edges", lambda e: F.struct(F.get(e["split"], F.lit(0)).alias("mask"), e["x"].alias("x")))
    return m.select("i", "j", F.explode(F.concat(edges, leaf)).alias("e")).select("i", "j", "e.mask", n6(F.col("e.x"), "x"))


@query(f"""{PARTS}, first AS (SELECT g.i, g.j, coalesce(min(pos), 1) AS f FROM geo g LEFT JOIN lim l ON l.i = g.i AND l.j = g.j GROUP BY g.i, g.j)
SELECT i, j, mask, round((l2 - l1) * f + 1.05e-9, 6) AS x FROM shared JOIN first USING (i, j) UNION ALL
  SELECT i, j, mask, round(-length * f * (na + nb) / na + 1.05e-9, 6) FROM sup JOIN first USING (i, j) WHERE side = 'a'""")
def direction_vector(spark, sf_dir):
    m = G.direction_vector(_geo(spark, sf_dir))
    leaf = F.transform("leaf", lambda e: F.struct(F.pow(F.lit(2), e["taxon_id"]).cast("long").alias("mask"), e["x"].alias("x")))
    edges = F.transform("edges", lambda e: F.struct(F.get(e["split"], F.lit(0)).alias("mask"), e["x"].alias("x")))
    return m.select("i", "j", F.explode(F.concat(edges, leaf)).alias("e")).select("i", "j", "e.mask", n6(F.col("e.x"), "x"))


@query()
def project_to_geodesic(spark, sf_dir):
    # every tree of a sample onto the geodesics from each other one of its trees to the one after that
    trees = saved(parsed(spark, sf_dir, 4), "trees")
    place = saved(placed_in_sample(trees.select("sample", "tree_id"), ["tree_id"], "at"), "placed")
    after = place.select("sample", F.col("tree_id").alias("j"), (F.col("at") - 1).alias("at"))
    legs = saved(place.withColumnRenamed("tree_id", "i").join(after, ["sample", "at"]).select("sample", "i", "j"), "legs")
    met = P.all_pairs(place.select("sample", "tree_id"), [])
    both = met.select("sample", F.explode(F.array(F.struct(F.col("a.tree_id").alias("tree_id"), F.col("b.tree_id").alias("i")), F.struct(F.col("b.tree_id").alias("tree_id"), F.col("a.tree_id").alias("i")))).alias("x"))
    wanted = both.select("sample", "x.*").join(legs, ["sample", "i"]).where("tree_id <> j")
    return W.project(trees, wanted, 4).select("i", "j", "tree_id", r6(F.col("at"), "at"), r6(F.col("d"), "d"))


# Selection


@query(f"{LENGTHS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY lnl DESC, tree_id DESC) AS r FROM scored) SELECT sample, tree_id, lnl, row_number() OVER (PARTITION BY sample ORDER BY lnl, tree_id) - 1 AS place FROM r WHERE r <= 5")
def best_likelihoods(spark, sf_dir):
    return L.best(scored(spark, sf_dir), 5).select("sample", "tree_id", "lnl", "place")


@query(f"{LENGTHS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY lnl DESC, tree_id DESC) AS r FROM scored), u AS (SELECT sample, tree_id, lnl, row_number() OVER (PARTITION BY sample ORDER BY lnl, tree_id) - 1 AS place FROM r WHERE r <= 6) SELECT * FROM u WHERE place % 2 = 0")
def best_every_step(spark, sf_dir):
    return L.best_every_step(scored(spark, sf_dir), 6, 2).select("sample", "tree_id", "lnl", "place")


GROUPS = f"""{LENGTHS}, keys AS (SELECT sample, tree_id, string_agg(mask::varchar, ',' ORDER BY mask) AS key FROM interior GROUP BY ALL),
groups AS (SELECT sample, key, max(struct_pack(lnl := lnl, t := tree_id)).t AS tree_id, max(lnl) AS lnl, count(*) AS n_trees, min(tree_id) AS first FROM keys JOIN scored USING (sample, tree_id) GROUP BY ALL)"""


@query(f"""{SHORT}, keys AS (SELECT sample, tree_id, string_agg(mask::varchar, ',' ORDER BY mask) AS key, count(*) AS n FROM short WHERE length > 1e-5 GROUP BY ALL),
whole AS (SELECT base.sample, base.tree_id, coalesce(key, '') AS key, coalesce(n, 0) AS n FROM base LEFT JOIN keys USING (sample, tree_id))
SELECT sample, min(tree_id) AS first, count(*) AS n_trees, any_value(n) AS n_edges FROM whole GROUP BY sample, key""")
def topology_groups(spark, sf_dir):
    return T.topology_groups(shortened(parsed(spark, sf_dir)))


@query(f"{GROUPS} SELECT sample, tree_id, lnl, n_trees FROM groups")
def best_per_topology(spark, sf_dir):
    return L.best_per_topology(scored(spark, sf_dir).withColumn("topology", T.topology())).drop("topology")


@query(f"{GROUPS} SELECT sample, tree_id, lnl, row_number() OVER (PARTITION BY sample ORDER BY lnl, tree_id) - 1 AS place FROM groups")
def rank_optimized(spark, sf_dir):
    top = L.best_per_topology(scored(spark, sf_dir).withColumn("topology", T.topology()))
    return L.ranked(top).select("sample", "tree_id", "lnl", "place")


@query(f"{GROUPS} SELECT sample, tree_id, lnl, 'start' AS role FROM scored UNION ALL SELECT sample, tree_id, lnl, 'optimised' FROM groups")
def tree_pool(spark, sf_dir):
    start = scored(spark, sf_dir)
    top = L.best_per_topology(start.withColumn("topology", T.topology()))
    return S.pool({"start": start, "optimised": top}).select("sample", "tree_id", "lnl", "role")


@query(f"""{LENGTHS}, b AS (SELECT sample, max(lnl) AS best FROM scored GROUP BY sample),
squares AS (SELECT sample, tree_id, sum(length) AS t, sqrt(sum(length * length)) AS norm FROM (SELECT sample, tree_id, length FROM interior UNION ALL SELECT sample, tree_id, length FROM leaf) GROUP BY ALL),
external AS (SELECT sample, -1 - tree_id AS tree_id, -round(t / norm, 6) AS lnl FROM squares) SELECT sample, tree_id, lnl, round(lnl - best, 6) AS less FROM external JOIN b USING (sample)""")
def compare_external(spark, sf_dir):
    # other trees: those of the sample on the unit sphere, under ids of their own
    external = T.normalize(parsed(spark, sf_dir)).withColumn("tree_id", -1 - F.col("tree_id")).withColumn("lnl", -F.round(T.tree_length(), 6))
    return S.compare(external, scored(spark, sf_dir)).select("sample", "tree_id", "lnl", r6(F.col("less"), "less"))


@query(f"""{SHORT}, whole AS (SELECT tree_id, round(sum(length), 6) AS length, 0 AS k FROM (SELECT tree_id, length FROM interior UNION ALL SELECT tree_id, length FROM leaf) GROUP BY tree_id
  UNION ALL SELECT tree_id, round(sum(length), 6), 1 FROM (SELECT tree_id, length FROM short UNION ALL SELECT tree_id, length FROM leaf) GROUP BY tree_id)
SELECT least(cast(floor(length / 0.1) AS bigint), 12) AS bucket, count(*) FILTER (k = 0) AS n_before, count(*) FILTER (k = 1) AS n_after FROM whole GROUP BY ALL""")
def length_before_after(spark, sf_dir):
    before = parsed(spark, sf_dir)
    return S.lengths_before_after(before, shortened(before), 0.1, 12)


@query("SELECT o_custkey AS sample, 25::bigint AS n, 25::bigint AS draws, true AS valid FROM orders GROUP BY o_custkey")
def resample_trees(spark, sf_dir):
    trees = fixtures.trees(spark, sf_dir)
    drawn = S.resample(trees, seed=7, n=25)
    known = trees.select("sample", "tree_id", F.lit(True).alias("known"))
    valid = F.bool_and(F.coalesce("known", F.lit(False)))
    return drawn.join(known, ["sample", "tree_id"], "left").groupBy("sample").agg(F.count("*").alias("n"), F.count_distinct("draw").alias("draws"), valid.alias("valid"))


@query("SELECT o_orderkey AS tree_id, 8::bigint AS n_leaves, 6::bigint AS n_edges, 0::bigint AS n_crossing, 127::bigint AS clade_of_seven, true AS in_range FROM orders")
def random_trees(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(0).cast("long").alias("sample"), F.col("o_orderkey").alias("tree_id"))
    made = T.parse_newick(S.random_trees(keys, LABELS, seed=3, outgroup="T7", p_distance=0.25), LABELS, keep_zero=True)
    crossing = F.expr("size(filter(flatten(transform(splits, x -> transform(splits, y -> (x.split[0] & y.split[0]) not in (0, x.split[0], y.split[0])))), z -> z))")
    return made.select(
        "tree_id", F.size("leaves").cast("long").alias("n_leaves"), F.size("splits").cast("long").alias("n_edges"), crossing.cast("long").alias("n_crossing"),
        F.array_max(F.transform("splits", lambda x: F.get(x["split"], F.lit(0)))).alias("clade_of_seven"), F.round(T.tree_length(), 6).between(0.05, 25).alias("in_range"),
    )


# Landscape

SQUARE = f"""{UNROOTED}, sq AS (SELECT sample, i, j, round(d, 6) AS d FROM wrf UNION ALL SELECT sample, j, i, round(d, 6) FROM wrf UNION ALL SELECT DISTINCT sample, x, x, 0 FROM (SELECT sample, i AS x FROM wrf UNION SELECT sample, j FROM wrf)),
rows_ AS (SELECT sample, i, avg(d * d) AS r FROM sq GROUP BY ALL), whole AS (SELECT sample, avg(r) AS w FROM rows_ GROUP BY ALL)"""


def _distances(spark, sf_dir) -> DataFrame:
    return saved(_wrf(spark, sf_dir).withColumn("d", F.round("d", 6)), "distances")


@query(f"{SQUARE} SELECT s.sample, s.i, s.j, round(-0.5 * (d * d - a.r - b.r + w) + 1.05e-9, 6) + 0.0 AS k FROM sq s JOIN rows_ a ON a.sample = s.sample AND a.i = s.i JOIN rows_ b ON b.sample = s.sample AND b.i = s.j JOIN whole w ON w.sample = s.sample")
def mds_gram(spark, sf_dir):
    return M.gram(_distances(spark, sf_dir)).select("sample", "i", "j", n6(F.col("k"), "k"))


@query()
def mds_coords(spark, sf_dir):
    found = M.coordinates(_distances(spark, sf_dir))
    return found.select("sample", "tree_id", r6(F.col("x")[0], "x"), r6(F.col("x")[1], "y"), r6(F.col("residual"), "residual"))


@query()
def mds_distances(spark, sf_dir):
    e = M.embedded_distances(M.coordinates(_distances(spark, sf_dir)))
    return e.select("sample", "i", "j", r6(F.col("d"), "d"))


@query()
def mds_validation(spark, sf_dir):
    d = _distances(spark, sf_dir)
    found = M.validation(d, M.embedded_distances(M.coordinates(d)))
    return found.select("sample", "n", r6(F.col("pearson"), "pearson"), r6(F.col("spearman"), "spearman"), r6(F.col("kendall"), "kendall"))


# A plain map that SQL can draw as well: interior length across, leaf length up. Both are whole thousandths.
PLAIN = f"""{UNROOTED}, plain AS (SELECT sample, tree_id, sum(x)::bigint AS x, sum(y)::bigint AS y FROM (SELECT sample, tree_id, cast(round(length * 1000) AS bigint) AS x, 0 AS y FROM interior
  UNION ALL SELECT sample, tree_id, 0, cast(round(length * 1000) AS bigint) FROM leaf) GROUP BY ALL)"""


def _plain(spark, sf_dir) -> DataFrame:
    whole = lambda name: F.aggregate(F.transform(name, lambda x: F.round(x["length"] * 1000)), F.lit(0.0), lambda a, x: a + x)
    return parsed(spark, sf_dir).select("sample", "tree_id", F.array(whole("splits"), whole("leaves")).alias("x"))


@query(f"""{PLAIN} SELECT a.sample, a.tree_id AS i, b.tree_id AS j, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) + 1.05e-9, 6) AS d
FROM plain a JOIN plain b ON a.sample = b.sample AND a.tree_id < b.tree_id""")
def map_distances(spark, sf_dir):
    return M.embedded_distances(_plain(spark, sf_dir)).select("sample", "i", "j", n6(F.col("d"), "d"))


@query(f"""{PLAIN}, half AS (SELECT w.sample, w.i, w.j, cast(round(w.d * 1000) AS bigint) AS d, power(a.x - b.x, 2) + power(a.y - b.y, 2) AS e FROM wrf w
  JOIN plain a ON a.tree_id = w.i JOIN plain b ON b.tree_id = w.j),
diag AS (SELECT sample, count(DISTINCT i) AS n FROM (SELECT sample, unnest([i, j]) AS i FROM half) GROUP BY sample),
full_ AS (SELECT sample, d, e FROM half UNION ALL SELECT sample, d, e FROM half UNION ALL SELECT sample, 0, 0 FROM diag, LATERAL (SELECT unnest(range(n)))),
ranked AS (SELECT sample, d, e, sqrt(e) AS f, rank() OVER (PARTITION BY sample ORDER BY d) + (count(*) OVER (PARTITION BY sample, d) - 1) / 2 AS rd,
  rank() OVER (PARTITION BY sample ORDER BY e) + (count(*) OVER (PARTITION BY sample, e) - 1) / 2 AS re, row_number() OVER (PARTITION BY sample ORDER BY d, e) AS k FROM full_),
tau AS (SELECT a.sample, sum(sign(a.d - b.d) * sign(a.e - b.e)) / sqrt(sum(abs(sign(a.d - b.d))) * sum(abs(sign(a.e - b.e)))) AS kendall
  FROM ranked a JOIN ranked b ON a.sample = b.sample AND a.k < b.k GROUP BY a.sample)
SELECT sample, count(*) AS n, round(corr(d, f) + 1.05e-9, 6) AS pearson, round(corr(rd, re) + 1.05e-9, 6) AS spearman, round(any_value(kendall) + 1.05e-9, 6) AS kendall
FROM ranked LEFT JOIN tau USING (sample) GROUP BY sample""")
def map_validation(spark, sf_dir):
    d = _wrf(spark, sf_dir).withColumn("d", F.round(F.col("d") * 1000))
    found = M.validation(d, M.embedded_distances(_plain(spark, sf_dir)))
    return found.select("sample", "n", n6(F.col("pearson"), "pearson"), n6(F.col("spearman"), "spearman"), n6(F.col("kendall"), "kendall"))


@query()
def shepard_curve(spark, sf_dir):
    d = _distances(spark, sf_dir)
    return M.shepard(d, M.embedded_distances(M.coordinates(d)))


# A point is outside a hull's interior when the directions to the sample's points leave a gap of half a turn or more.
GAPS = """rays AS (SELECT q.sample, q.tree_id, atan2((p.y - q.y)::double, (p.x - q.x)::double) AS a FROM q JOIN plain p ON p.sample = q.sample AND (p.x <> q.x OR p.y <> q.y)),
turns AS (SELECT sample, tree_id, a, lead(a) OVER w AS b, first_value(a) OVER w AS f FROM rays WINDOW w AS (PARTITION BY sample, tree_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
gaps AS (SELECT sample, tree_id, max(coalesce(b, f + 2 * pi()) - a) AS gap FROM turns GROUP BY ALL)"""


@query(f"""{PLAIN}, q AS (SELECT sample, min(tree_id) AS tree_id, x, y FROM plain GROUP BY sample, x, y), {GAPS}
SELECT sample, q.x::double AS px, q.y::double AS py FROM q LEFT JOIN gaps USING (sample, tree_id) WHERE gap > pi() + 1e-9 OR gap IS NULL""")
def convex_hull(spark, sf_dir):
    return M.hull(_plain(spark, sf_dir)).select("sample", "px", "py")


@query(f"""{PLAIN}, q AS (SELECT sample, tree_id, x + 7 AS x, y - 3 AS y FROM plain), {GAPS}
SELECT q.sample, q.tree_id, coalesce(gap <= pi() + 1e-9, false) OR EXISTS (SELECT 1 FROM plain p WHERE p.sample = q.sample AND p.x = q.x AND p.y = q.y) AS inside
FROM q LEFT JOIN gaps ON gaps.sample = q.sample AND gaps.tree_id = q.tree_id""")
def point_in_hull(spark, sf_dir):
    coords = saved(_plain(spark, sf_dir), "coords")
    points = coords.select("sample", "tree_id", (F.col("x")[0] + 7).alias("px"), (F.col("x")[1] - 3).alias("py"))
    return M.inside(points, M.hull(coords)).select("sample", "tree_id", "inside")


@query()
def rbf_surface(spark, sf_dir):
    coords = saved(M.coordinates(_distances(spark, sf_dir)), "coords")
    return M.surface(coords, scored(spark, sf_dir))


# Jobs


@query()
def job_boundary(spark, sf_dir):
    return W.boundary(parsed(spark, sf_dir), 8).select("sample", "tree_id")


@query()
def job_boundary_geodesic(spark, sf_dir):
    return W.boundary(parsed(spark, sf_dir), 8, "geodesic").select("sample", "tree_id")


@query()
def job_explore(spark, sf_dir):
    trees = parsed(spark, sf_dir)
    external = T.normalize(trees.groupBy("sample").agg(F.min_by(F.struct("tree_id", "splits", "leaves"), "tree_id").alias("t")).select("sample", "t.*"))
    external = external.withColumn("tree_id", -1 - F.col("tree_id"))
    return W.explore(trees, fixtures.cells(spark, sf_dir), LABELS, external)


@query()
def job_iterate(spark, sf_dir):
    return W.iterate(parsed(spark, sf_dir), fixtures.cells(spark, sf_dir), LABELS, paths=[3, 4], kept=[4], rounds=2)


@query()
def job_landscape(spark, sf_dir):
    return W.landscape(scored(spark, sf_dir), 8)


@query()
def job_landscape_geodesic(spark, sf_dir):
    return W.landscape(scored(spark, sf_dir), 8, "geodesic")
