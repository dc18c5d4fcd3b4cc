"""Corpus pipeline over ``documents``: quality, exact copies, near copies, mixing, packing.

For every stage: null texts count as empty ones, texts are read whole however
long, null ids and sources are values like others, rows that agree in all
columns are rows of their own until the exact stage, extra columns pass through
to the last stage but one, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladewise.llm.common import RID, materialise, table
from cladewise.llm.exact_dedup import drop_exact_copies
from cladewise.llm.mixing import apply_mix
from cladewise.llm.packing import pack
from cladewise.llm.quality import keep_good, train
from cladewise.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go; equal texts stay or go together. Without labels all stay."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays (null ids last); of rows equal in both too, one."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints, directly or over others, that with the smallest id stays; of equal ids one row. Texts without words are linked to each other."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document occurs as often as the mix takes it: not at all, once or twice. Texts without words are not taken."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, a sequence each. ``row`` tells the copies of a document apart."""
    return pack(docs).withColumnRenamed(RID, "row")


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: Fingerprints, the fitted classifier and the tokenizer are beyond SQL; tests hold each stage's rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
