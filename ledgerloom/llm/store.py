"""Intermediate tables in the folder that all executors share, so that lost executors cost no results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that frees the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local session (tests) takes a temporary folder once;
    on a cluster, whose machines share no such folder, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get("ledgerloom.local.folder", None) or "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("ledgerloom.local.folder", folder)
    return folder.rstrip("/")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind. Their results must be written or collected."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Written:
    """A DataFrame written to the shared folder and read back; ``drop`` frees its disk once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str, codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"
        with freed_shuffles(self.spark):
            df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write, then read."""
    return Written(df, name).df
