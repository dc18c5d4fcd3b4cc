"""Shared pieces: tables in the shared folder, global row numbers, safe column names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladewise.sources.shared import stored as materialise

#: Internal column names start with this, so they do not meet a caller's columns.
P = "__cw_"
RID = P + "rid"


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, a few at a time: what a task makes of texts (strings, filtered copies) then is small beside the batch that Spark sends."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def with_row_ids(df: DataFrame) -> DataFrame:
    """``df`` with a unique number per row in ``RID`` that stays the same in every later job.

    Rows read straight from files are numbered by file and place in the file,
    which costs no copy. Other rows are stored with their numbers.
    """
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return materialise(df.withColumn(RID, F.monotonically_increasing_id()))
    where = df.select("*", F.col("_metadata.file_path").alias(P + "path"), F.col("_metadata.row_index").alias(P + "row"))
    files = where.select(P + "path").distinct().withColumn(P + "file", F.row_number().over(Window.orderBy(P + "path")).cast("long"))
    # one row for each file: bounded by the number of files
    numbered = where.join(F.broadcast(materialise(files)), P + "path")
    return numbered.withColumn(RID, F.shiftleft(P + "file", 40) + F.col(P + "row")).select(*df.columns, RID)


def number_rows(df: DataFrame, order: list[Column], name: str, weight: Column | None = None) -> DataFrame:
    """Global row number from 0 in ``order``, without gathering the rows in one task.

    The rows are range-partitioned and sorted; only the row count of each
    partition meets in one place. With ``weight`` (a long column) the number is
    the sum of the weights of all earlier rows instead.
    """
    mid, part = P + "mid", P + "part"
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mid, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftrightunsigned(mid, 33))
    each = F.lit(1).cast("long") if weight is None else weight
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(F.sum(each).alias(P + "n")).select(part, F.coalesce(F.sum(P + "n").over(before), F.lit(0)).alias(P + "start"))
    if weight is None:
        inside = F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))
    else:
        inside = F.coalesce(F.sum(each).over(Window.partitionBy(part).orderBy(mid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per partition: bounded by the number of partitions
    return placed.join(F.broadcast(starts), part).withColumn(name, F.col(P + "start") + inside).drop(mid, part, P + "start")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
