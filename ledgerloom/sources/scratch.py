"""Tables written between the steps of an iterative operator, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``; only where that is unset, below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


#: Fixed value: tasks that whole rows are dealt to at least.
TASKS = 200


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by keys to TASKS tasks or more. JSON packs well, so that tasks merged by the bytes of their packed rows
    would hold many times as much; a named number of tasks isn't merged."""
    return df.repartition(max(TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """The frame written and read back: later steps neither repeat its work nor carry its plan, and lost executors cost a
    retry only. instead_of: a frame of an earlier step that nothing reads any more; if ``cut`` wrote it, its files go."""
    spark, path = df.sparkSession, work_folder(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    old = getattr(instead_of, "_written", None)
    if old is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(old)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return out
