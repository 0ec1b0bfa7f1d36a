"""Reading and writing: partitioned raw files, format preference, snapshots, idempotent batches, compaction, loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.columns import entity_of
from ledgerloom.operators.bronze import utc_partition
from ledgerloom.sources.scratch import work_folder as work_folder

PARTS = ("migration", "year", "month", "day")
#: How reports write times.
TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches a path or glob of any file system that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_raw(spark: SparkSession, root: str, kind: str, schema: T.StructType) -> DataFrame:
    """Hive-partitioned raw Parquet of a kind (events, updates) with its partition columns; files may lack columns."""
    fields = [*schema.fields, *[T.StructField(p, T.IntegerType()) for p in PARTS]]
    return spark.read.schema(T.StructType(fields)).option("basePath", f"{root}/{kind}").parquet(f"{root}/{kind}")


def read_ledger(spark: SparkSession, root: str, kind: str, schema: T.StructType) -> DataFrame:
    """Parquet if there is any, else JSON lines (plain or compressed; bad lines are dropped), else a typed empty frame."""
    if exists(spark, f"{root}/{kind}"):
        try:
            found = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/{kind}")
            if found.inputFiles():
                return found
        except AnalysisException:
            pass
        lines = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").json(f"{root}/{kind}")
        if lines.inputFiles():
            return lines
    return spark.createDataFrame([], schema)


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """An explicit list of Parquet files, united by column name."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_day(raw: DataFrame, year: int, month: int, day: int) -> DataFrame:
    """One day of a partitioned frame: constants on partition columns, so that only its files are read."""
    return raw.where((F.col("year") == year) & (F.col("month") == month) & (F.col("day") == day))


def read_acs(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Snapshot contracts of both formats, each row once."""
    frames = []
    for pattern, reader in (("*.parquet", "parquet"), ("*.json*", "json")):
        if exists(spark, f"{root}/acs"):
            frame = getattr(spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern), reader)(f"{root}/acs")
            if frame.inputFiles():
                frames.append(frame)
    if not frames:
        return spark.createDataFrame([], schema)
    return frames[0].distinct() if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True).distinct()


def write_partitioned(df: DataFrame, root: str, kind: str, at: str = "effective_at", mode: str = "append") -> None:
    """Parquet (zstd), every row in the partition of its own UTC day; rows without a valid day are refused by name."""
    parts = utc_partition(df, at).withColumnRenamed("migration_id", "migration")
    good = parts.where("partition_ok").drop("partition_ok")
    good.repartition("migration", "year", "month", "day").write.mode(mode).option("compression", "zstd").partitionBy(*PARTS).parquet(f"{root}/{kind}")


def store_events(events: DataFrame, path: str, day: str = "event_date", mode: str = "append") -> None:
    """Typed events with their entity as a column, in files that each hold a range of (entity, day): a view of one entity,
    and a day of it, then reads few files and row groups. Large entities are cut into several ranges by their days and ids."""
    keyed = events.withColumn("entity", entity_of(F.col("template_id")))
    order = ["entity", day, *[c for c in ("event_id",) if c in events.columns]]
    keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option("compression", "zstd").parquet(path)


def rejected_rows(df: DataFrame, at: str = "effective_at") -> DataFrame:
    """The rows that ``write_partitioned`` leaves out."""
    return utc_partition(df, at).where("not partition_ok").drop("year", "month", "day", "partition_ok")


def write_batch_idempotent(df: DataFrame, path: str, batch_id: int | str) -> None:
    """Write one batch so that a replay leaves the same rows: its slice, keyed by the batch id, is overwritten alone."""
    out = df.withColumn("batch", F.lit(str(batch_id)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("batch").parquet(path)


def compact(df: DataFrame, id_col: str, at: str, max_rows: int = 1_000_000) -> DataFrame:
    """Rows deduplicated (the latest of an id) and ranged by id for few, sorted files; write with ``maxRecordsPerFile``."""
    from ledgerloom.operators.quality import dedup_latest

    return dedup_latest(df, id_col, at).repartitionByRange(id_col).sortWithinPartitions(id_col)


def write_compacted(df: DataFrame, path: str, id_col: str, at: str, max_rows: int = 1_000_000) -> None:
    compact(df, id_col, at).write.mode("overwrite").option("maxRecordsPerFile", max_rows).option("compression", "zstd").parquet(path)


def jsonl_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType) -> None:
    """JSON lines to typed Parquet; lines that are no JSON are kept apart under ``<target>_bad``."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(source)
    lines.where("_corrupt_record is null").drop("_corrupt_record").write.mode("overwrite").option("compression", "zstd").parquet(target)
    text = spark.read.text(source).where("value <> '' and try_parse_json(value) is null")
    text.write.mode("overwrite").text(f"{target}_bad")


def incremental_load(loaded: DataFrame, source: DataFrame, id_col: str, day: str, as_of: Column) -> DataFrame:
    """Rows to append: from the day before the last loaded one to the day before as_of, without (id, day) present. The
    range is a constant predicate on the day of both sides; only the last loaded days are compared."""
    last = loaded.agg(F.max(day).alias("d")).first()["d"]
    until = F.date_sub(F.to_date(as_of), 1)
    window = source.where(F.col(day) <= until)
    if last is None:
        return window
    begin = F.date_sub(F.lit(last), 1)
    return window.where(F.col(day) >= begin).join(loaded.where(F.col(day) >= begin).select(id_col, day), [id_col, day], "left_anti")


def upsert(current: DataFrame, new: DataFrame, key: str, update: Sequence[str]) -> DataFrame:
    """Merge by key: named columns take the new value where there is one, the others keep the old; new keys are added."""
    own = new.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in new.columns if c != key])
    joined = current.join(own, key, "full")

    def value(c: str) -> Column:
        if c == key or f"new_{c}" not in own.columns:
            return F.col(c)
        first, second = (f"new_{c}", c) if c in update else (c, f"new_{c}")
        return F.coalesce(first, second).alias(c)

    return joined.select(*[value(c) for c in current.columns])


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """Report rows as JSON lines or CSV with a header; times keep microseconds."""
    writer = df.write.mode("overwrite").option("timestampFormat", TIMES)
    writer.json(path) if kind == "json" else writer.option("header", "true").option("escape", '"').csv(path)


def file_stats(df: DataFrame, at: str) -> DataFrame:
    """Per file: rows, bytes and the range of times, from the reader's own file metadata."""
    meta = F.col("_metadata")
    return df.select(meta["file_path"].alias("file"), meta["file_size"].alias("bytes"), F.col(at).alias("at")).groupBy("file", "bytes").agg(F.count("*").alias("rows"), F.min("at").alias("first"), F.max("at").alias("last"))


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """Candles of JSON-lines files: pair, time (ISO text or milliseconds since 1970), prices and volume as text or numbers. The
    price is the close where none is given; rows without pair or time, and texts that are no JSON, drop out."""
    names = ("open", "high", "low", "close", "price", "volume", "count")
    rows = spark.read.schema("pair string, ts string, " + ", ".join(f"{n} string" for n in names)).option("mode", "DROPMALFORMED").json(path)
    at = F.when(F.col("ts").rlike("^[0-9]+$"), F.timestamp_millis(F.col("ts").try_cast("long"))).otherwise(F.try_to_timestamp("ts"))
    number = lambda n: F.col(n).try_cast("double")
    out = rows.select("pair", at.alias("ts"), *[number(n).alias(n) for n in ("open", "high", "low", "close")], F.coalesce(number("price"), number("close")).alias("price"), number("volume").alias("volume"), F.col("count").try_cast("long").alias("count"))
    return out.where("pair is not null and ts is not null")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A report that ``export`` wrote as CSV."""
    return spark.read.schema(schema).option("header", "true").option("timestampFormat", TIMES).option("escape", '"').option("multiLine", "true").csv(path)


def tiny_files(stats: DataFrame, under: int = 1024) -> DataFrame:
    return stats.where(F.col("bytes") < under)


def archive_stats(stats: DataFrame) -> DataFrame:
    """Files and bytes per migration and kind, read from the paths of ``file_stats``."""
    migration = F.regexp_extract("file", r"/migration=([^/]+)/", 1)
    kind = F.regexp_extract("file", r"/([^/]+)/migration=", 1)
    return stats.groupBy(kind.alias("kind"), migration.alias("migration")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def repair_partitions(spark: SparkSession, root: str, kind: str, target: str, schema: T.StructType, at: str = "effective_at") -> None:
    """Rewrite a raw tree so that every row lies in the partition of its own day."""
    rows = read_raw(spark, root, kind, schema).drop("year", "month", "day").withColumnRenamed("migration", "path_migration")
    fixed = rows.withColumn(at, F.try_to_timestamp(F.col(at).cast("string")))
    write_partitioned(fixed.drop("path_migration"), target, kind, at, mode="overwrite")
