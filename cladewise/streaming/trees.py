"""Summaries over a folder to which files of trees are added."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladewise.operators.newick import parse

_PAIRS = T.ArrayType(T.StructType([T.StructField("i", T.StringType()), T.StructField("j", T.StringType()), T.StructField("d", T.DoubleType())]))


def _leaf_pairs(text: str) -> list[tuple]:
    nodes = parse(text)
    inner = {p for _, p, _, _ in nodes}
    up = {n: (p, x) for n, p, _, x in nodes}
    paths = []
    for n, _, name, _ in nodes:
        if n not in inner:
            path, dist, k = {}, 0.0, n
            while k >= 0:
                path[k] = dist
                dist, k = dist + up[k][1], up[k][0]
            paths.append((name, path))
    paths.sort()
    return [(a, b, min(x + q[k] for k, x in p.items() if k in q)) for at, (a, p) in enumerate(paths) for b, q in paths[at + 1 :]]


@F.pandas_udf(_PAIRS)
def _pairs(texts: pd.Series) -> pd.Series:
    return texts.map(_leaf_pairs)


def stream_pair_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming ``i, j, n, mean, med``: each pair of leaves over all trees so far; for output mode complete or update."""
    lines = spark.readStream.schema("value string").text(folder).where(F.trim("value").startswith("("))
    pairs = lines.select(F.explode(_pairs(F.trim("value"))).alias("p")).select("p.*")
    return pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.approx_percentile("d", 0.5, 10_000).alias("med"))
