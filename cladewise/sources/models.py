"""Substitution models with their trees in the ``.mod`` text format: a line for each of ALPHABET, ORDER, SUBST_MOD, BACKGROUND and TREE, and the rows of a matrix behind RATE_MAT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NEAR = 1e-4  # published models give six decimals


def _numbers(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: w.try_cast("double"))


def _field(name: str) -> Column:
    return F.trim(F.regexp_extract("value", rf"(?m)^[ \t]*{name}:[ \t]*([^\r\n]*)", 1))


def parse(texts: DataFrame) -> DataFrame:
    """``path, alphabet, kind, freqs, rates, newick`` from ``texts(path, value)``, a model a row; ``rates`` is the matrix by rows.

    An error is: no alphabet, background or matrix, one that does not match the
    alphabet or holds other than numbers, rows that do not sum to zero, and an
    order above zero. Without a tree ``newick`` is null. A background that does not sum to one is scaled.
    """
    found = texts.select(
        "path", F.regexp_replace(_field("ALPHABET"), r"\s+", "").alias("alphabet"), _field("SUBST_MOD").alias("kind"), _field("ORDER").alias("order"), F.nullif(_field("TREE"), F.lit("")).alias("newick"),
        _numbers(_field("BACKGROUND")).alias("freqs"), _numbers(F.regexp_extract("value", r"RATE_MAT:[ \t]*\r?\n([-+.0-9eE \t\r\n]*)", 1)).alias("flat"),
    )
    k = F.length("alphabet")
    rows = F.transform(F.sequence(F.lit(0), k - 1), lambda a: F.slice(F.col("flat"), a * k + 1, k))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    bad = lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x))
    wrong = (
        F.when(k == 0, "no alphabet").when(~F.col("order").isin("", "0"), "a model of higher order")
        .when((F.size("freqs") != k) | (F.size("flat") != k * k), "background or rates do not match the alphabet").when(bad("freqs") | bad("flat"), "other than numbers")
        .when(F.exists("freqs", lambda x: x < 0) | (add("freqs") <= 0), "frequencies below zero or all zero").when(F.exists(rows, lambda row: F.abs(add(row)) > _NEAR), "a row of rates does not sum to zero")
    )
    ok = lambda value: F.when(wrong.isNull(), value).otherwise(F.raise_error(F.concat(F.lit("model: "), wrong)))
    return found.select("path", ok(F.col("alphabet")).alias("alphabet"), "kind", ok(F.transform("freqs", lambda x: x / add("freqs"))).alias("freqs"), ok(rows).alias("rates"), "newick")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The models of all files of ``path``; a file is one model of a few lines and a tree."""
    return parse(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def write(models: DataFrame) -> DataFrame:
    """``path, value``: the text of each of ``models(path, alphabet, kind, freqs, rates, newick)``; numbers come back to the last digit."""
    line = lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), " ")
    parts = [
        F.concat(F.lit("ALPHABET: "), F.array_join(F.split("alphabet", ""), " ")), F.lit("ORDER: 0"), F.concat(F.lit("SUBST_MOD: "), "kind"), F.concat(F.lit("BACKGROUND: "), line("freqs")),
        F.lit("RATE_MAT:"), F.array_join(F.transform("rates", lambda row: F.concat(F.lit("  "), line(row))), "\n"), F.concat(F.lit("TREE: "), "newick"),
    ]
    return models.select("path", F.concat_ws("\n", *parts, F.lit("")).alias("value"))
