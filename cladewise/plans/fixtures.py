"""The domain's inputs, derived from the driver tables; every row of a table takes part.

Data sets are runs of ids of a bounded length, so that their number, and not
their size, grows with the table. Each has a twin in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAXA, CELLS, SITES = 64, 50, 10
STATES = {"error": -1, "view": 0, "click": 1, "purchase": 2, "signup": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ds, taxon, x``: embeddings, in data sets of 64 taxa."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return e.select(F.floor(F.col("vec_id") / TAXA).cast("long").alias("ds"), F.col("vec_id").alias("taxon"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


POINTS = f"points AS (SELECT vec_id // {TAXA} AS ds, vec_id AS taxon, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL)"


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ds, taxon, codes``: a site for each dimension, bases 0 to 3, -1 where missing."""
    code = lambda v: F.when(F.abs(v) < 0.01, -1).otherwise((F.floor((v + 1) * 16) % 4).cast("int"))
    return points(spark, sf_dir).select("ds", "taxon", F.transform("x", code).alias("codes"))


ALIGNMENT = f"{POINTS}, alignment AS (SELECT ds, taxon, list_transform(x, lambda v: CASE WHEN abs(v) < 0.01 THEN -1 ELSE CAST(floor((v + 1) * 16) AS INTEGER) % 4 END) AS codes FROM points)"


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ds, cell, site, state``: the first event of a user on days of the same last digit; -1 is silent, 0 unedited."""
    e = table(spark, sf_dir, "events")
    state = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in STATES.items()])
    first = e.groupBy(F.col("user_id").alias("cell"), (F.dayofmonth("ts") % SITES).alias("site")).agg(F.min_by(state, F.col("event_id")).alias("state"))
    return first.select(F.floor(F.col("cell") / CELLS).cast("long").alias("ds"), "cell", "site", "state")


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in STATES.items()) + " END"
MUTATIONS = f"mutations AS (SELECT user_id // {CELLS} AS ds, user_id AS cell, CAST(day(ts) % {SITES} AS INTEGER) AS site, arg_min({_CASE}, event_id) AS state FROM events GROUP BY ALL)"


def cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ds, taxon, codes``: a cell's states in the order of sites; a site without events is silent."""
    m = mutations(spark, sf_dir).groupBy("ds", F.col("cell").alias("taxon")).agg(F.map_from_entries(F.collect_list(F.struct("site", "state"))).alias("m"))
    return m.select("ds", "taxon", F.transform(F.sequence(F.lit(0), F.lit(SITES - 1)), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(-1))).alias("codes"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tree, node, parent, length``: a tree for each customer; its children are the years of orders, theirs the orders. Root: parent null."""
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    leaf = o.select(F.col("o_custkey").alias("tree"), F.concat(F.lit("L"), F.col("o_orderkey").cast("string")).alias("node"), F.concat(F.lit("Y"), year.cast("string")).alias("parent"), (0.5 + F.col("o_totalprice").cast("double") / 771234.57).alias("length"))
    inner = o.select(F.col("o_custkey").alias("tree"), F.concat(F.lit("Y"), year.cast("string")).alias("node"), F.lit("R").alias("parent"), (1.0 + 0.1 * (year - 1992)).alias("length")).distinct()
    root = o.select(F.col("o_custkey").alias("tree"), F.lit("R").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("length")).distinct()
    return leaf.unionByName(inner).unionByName(root)


def other_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees over the same leaves, grouped by priority of the order instead of its year."""
    o = table(spark, sf_dir, "orders")
    tree = F.col("o_custkey").alias("tree")
    leaf = o.select(tree, F.concat(F.lit("L"), F.col("o_orderkey").cast("string")).alias("node"), F.concat(F.lit("Y"), "o_orderpriority").alias("parent"), F.lit(1.0).alias("length"))
    inner = o.select(tree, F.concat(F.lit("Y"), "o_orderpriority").alias("node"), F.lit("R").alias("parent"), F.lit(1.0).alias("length")).distinct()
    root = o.select(tree, F.lit("R").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("length")).distinct()
    return leaf.unionByName(inner).unionByName(root)


def _trees_sql(name: str, group: str, inner: str, leaf: str) -> str:
    return f"""{name} AS (
  SELECT o_custkey AS tree, 'L' || o_orderkey AS node, 'Y' || {group} AS parent, {leaf} AS length FROM orders
  UNION ALL SELECT DISTINCT o_custkey, 'Y' || {group}, 'R', {inner} FROM orders
  UNION ALL SELECT DISTINCT o_custkey, 'R', NULL, CAST(0 AS DOUBLE) FROM orders)"""


TREES = _trees_sql("trees", "year(o_orderdate)", "CAST(1.0 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (year(o_orderdate) - 1992)", "CAST(0.5 AS DOUBLE) + CAST(o_totalprice AS DOUBLE) / 771234.57")
OTHER_TREES = _trees_sql("other_trees", "o_orderpriority", "CAST(1 AS DOUBLE)", "CAST(1 AS DOUBLE)")


def leaf_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tree, node, state``: an order's priority."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tree"), F.concat(F.lit("L"), F.col("o_orderkey").cast("string")).alias("node"), F.col("o_orderpriority").alias("state"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ds, draw, lw``: log weights of a user's events in the order of ids."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("ds"), F.col("event_id").alias("draw"), (F.col("value") / 100).alias("lw"))


WEIGHTS = "weights AS (SELECT user_id AS ds, event_id AS draw, value / 100 AS lw FROM events)"
