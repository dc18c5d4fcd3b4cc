"""The state of an approximation as text: a line for each row of its matrices, so no line grows but with the taxa of one data set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.operators import distances as D


def number(v: Column) -> Column:
    """Six decimals, without a sign before zero."""
    return F.format_string("%.6f", F.round(v, 6) + F.lit(0.0))


def matrix_rows(entries: DataFrame, value: str) -> DataFrame:
    """``ds, row, line`` of a symmetric matrix ``entries(ds, i, j, value)`` that stands in full, columns in order."""
    cells = F.array_sort(F.collect_list(F.struct("j", number(F.col(value)).alias("t"))))
    return entries.groupBy("ds", F.col("i").alias("row")).agg(F.array_join(F.transform(cells, lambda c: c["t"]), " ").alias("line"))


def _full(entries: DataFrame, value: str) -> DataFrame:
    """From one triangle with its diagonal."""
    off = entries.where("i <> j").select("ds", F.col("j").alias("i"), F.col("i").alias("j"), value)
    return entries.select("ds", "i", "j", value).unionByName(off)


def covariance(distances: DataFrame, dims: int, form: str, parameters: DataFrame, pseudo: DataFrame | None = None, factors: DataFrame | None = None) -> DataFrame:
    """``ds, section, row, line`` of a covariance and what it rests on.

    Sections: ``head`` (row 0), ``distances`` (a row for each taxon),
    ``parameters`` (``parameters(ds, place, value)``, logarithms, row 0), and
    ``pseudo`` (``pseudo(ds, i, j, b)``, i <= j) or ``factor``
    (``factors(ds, taxon, r)``) as the form has one or the other. Data sets of one taxon have no distances and no text.
    """
    zero = F.lit(0).cast("long").alias("row")
    ends = D.ends(distances)
    own = ends.select("ds", "i", F.col("i").alias("j"), F.lit(0.0).alias("d")).distinct()
    sizes = own.groupBy("ds").agg(F.count(F.lit(1)).alias("n"))
    first = parameters.groupBy("ds").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("p"))
    known = sizes.join(first, "ds")
    spread = number(F.exp(F.get("p", F.lit(0))["value"]))
    head = known.select("ds", F.lit("head").alias("section"), zero, F.format_string(f"{form} taxa %d dimensions {dims} lambda %s", "n", spread).alias("line"))
    free = known.select("ds", F.lit("parameters").alias("section"), zero, F.array_join(F.transform("p", lambda x: number(x["value"])), " ").alias("line"))
    parts = [head, free, matrix_rows(ends.unionByName(own), "d").withColumn("section", F.lit("distances"))]
    if pseudo is not None:
        parts.append(matrix_rows(_full(pseudo, "b"), "b").withColumn("section", F.lit("pseudo")))
    if factors is not None:
        parts.append(factors.select("ds", F.col("taxon").alias("row"), F.array_join(F.transform("r", number), " ").alias("line")).withColumn("section", F.lit("factor")))
    return reduce(DataFrame.unionByName, parts)
