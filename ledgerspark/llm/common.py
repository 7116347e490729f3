"""Shared helpers: table reading, shared-folder staging, and word shingles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, and that exact deduplication ignores.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='ledgerspark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark then deletes an execution's shuffle files when it ends; what was made of them is in the table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back.

    Cuts the lineage at a point that outlives any executor. The shuffle files of the finished job are deleted with it, so
    that peak disk use is that of one step, not of all of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a staged table that nothing reads any more, because what was made of it is itself staged."""
    jvm, context = table.sparkSession._jvm, table.sparkSession._jsc
    path = jvm.org.apache.hadoop.fs.Path(table.staged_path)
    path.getFileSystem(context.hadoopConfiguration()).delete(path, True)
