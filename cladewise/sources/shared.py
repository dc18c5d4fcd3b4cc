"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset and the master is local."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="cladewise-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def stored(df: DataFrame, **options: int | str) -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends here, and lost executors cost nothing.

    ``options`` are those of Spark's writer.
    On a local master the table goes when the process ends; :func:`clear` removes all of them earlier.
    """
    path = f"{shared_dir(df.sparkSession)}/cladewise/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _stored.append(path)
    if df.sparkSession.sparkContext.master.startswith("local["):
        atexit.register(shutil.rmtree, path.removeprefix("file:"), ignore_errors=True)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._cladewise_path = path
    return kept


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that does not go through the driver.

    Spark broadcasts a side that looks small. Steps that come in many rounds
    would send all of these, once each, through one process, and tables just
    below the limit are several times as large there.
    """
    return df.hint("merge")


def release(*frames: DataFrame) -> None:
    """Remove the tables behind ``frames``, each a result of :func:`stored` that no later frame reads; others are left alone."""
    for df in frames:
        path = getattr(df, "_cladewise_path", None)
        if path in _stored:
            _stored.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Remove the tables that this process has stored; frames that read them end here."""
    while _stored:
        _delete(spark, _stored.pop())
