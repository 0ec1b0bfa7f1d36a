"""Streams of updates: reading, normalising with a dead-letter sink, deduplication, incremental aggregates, sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.bronze import extract_events, normalize_event, normalize_update, split_unknown
from ledgerloom.sources.io import write_batch_idempotent

#: How late a record may be: the look-back of the batch load.
LATENESS = "1 day"


def stream_files(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """A file stream of landed Parquet or JSON lines, a bounded number of files in a batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path) if kind == "json" else reader.parquet(path)


def stream_dedup(stream: DataFrame, id_col: str, at: str, lateness: str = LATENESS) -> DataFrame:
    """Each id once; state is kept for the lateness only. Later repeats are dropped by the batch load."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([id_col])


def tumbling_counts(stream: DataFrame, at: str, width: str, *keys: str, lateness: str = LATENESS) -> DataFrame:
    """Rows per window and key, late ones included up to the watermark."""
    rows = stream.withWatermark(at, lateness) if stream.isStreaming else stream
    counted = rows.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("rows"))
    return counted.select(F.col("window.start").alias("period"), *keys, "rows")


def type_counts(stream: DataFrame) -> DataFrame:
    """Running count per event type; in update mode only changed types are given out."""
    return stream.groupBy("event_type").agg(F.count("*").alias("events"))


def start_normalize(raw: DataFrame, target: str, checkpoint: str, pace: str | None = None) -> StreamingQuery:
    """Normalise a stream of raw JSON records (column json) into updates, events and dead letters under ``target``.

    Each batch is written under its batch id; with the checkpoint a replayed batch overwrites its own slice, so every
    record counts once. pace: a processing interval; none: all files there are, then end. A batch of a few files is dealt out
    to all slots of the cluster, and its records are parsed once for the three outputs.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        updates = normalize_update(batch.repartition(batch.sparkSession.sparkContext.defaultParallelism)).persist()
        known, rejected = split_unknown(updates)
        write_batch_idempotent(known, f"{target}/updates", batch_id)
        write_batch_idempotent(normalize_event(extract_events(known)), f"{target}/events", batch_id)
        write_batch_idempotent(rejected.select("update_data"), f"{target}/dead", batch_id)
        updates.unpersist()

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=pace) if pace else writer.trigger(availableNow=True)).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all files there are, and read what its sink holds at the end: the last batch in complete
    mode, all batches in append mode. The sink writes each batch under its id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch_idempotent(batch, path, f"{batch_id:08d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.StringType())])
    rows = spark.read.schema(schema).parquet(path)
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        rows = rows.join(F.broadcast(last), "batch", "left_semi")  # a single value
    return rows.drop("batch")


def run_changes(stream: DataFrame, path: str, checkpoint: str, *keys: str) -> DataFrame:
    """Run an aggregating stream over all files there are in update mode: each batch adds only the groups that it changed,
    and reading takes the newest row of each key. A replayed batch overwrites its own slice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch_idempotent(batch, path, f"{batch_id:08d}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.StringType())])
    rest = [c for c in stream.columns if c not in keys]
    newest = stream.sparkSession.read.schema(schema).parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("newest"))
    return newest.select(*keys, "newest.*")


def freshness(rows: DataFrame, at: str, as_of: Column, *keys: str) -> DataFrame:
    """Age of the latest record per key: live under a minute, idle under five, else stale. Migrations are keys of one
    query, each with an order of its own."""
    latest = rows.groupBy(*keys).agg(F.max(at).alias("latest"), F.count("*").alias("rows"))
    age = F.timestamp_diff("SECOND", F.col("latest"), as_of)
    return latest.select(*keys, "rows", age.alias("age_seconds"), F.when(age < 60, "live").when(age < 300, "idle").otherwise("stale").alias("state"))


#: What the keys of a bucket have behind them, as JSON: for each key the last migration that is complete, the one that is open, its next
#: place, the records given out, and the records that came too early.
ORDER_STATE = "keys string"


def ordered_migrations(stream: DataFrame, buckets: int = 4096) -> DataFrame:
    """(key, migration, place, position, record): the records of every key in order, whatever the order of their arrival.

    stream: key string, migration long, after long (the key's migration before it, null for its first), place long (0, 1, ...
    within the migration), closing boolean (the migration's last record), record string. A record is given out when all
    before it have been; a migration opens when the one before it is complete. ``position`` counts the records of a key.
    Repeats of a record that is given out or waits are dropped. The state of a key holds only the records that came too
    early; it lives in the checkpoint, so that a restarted stream goes on where it stood. Keys are dealt to ``buckets`` groups by
    hash, because a group costs far more than a record; a checkpoint is for one number of buckets.
    """

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        behind = {key: (done, open_, place, given, {(r[0], r[2]): r for r in early}) for key, done, open_, place, given, early in json.loads(state.get[0] if state.exists else "[]")}
        arrived: dict[str | None, list[tuple]] = {}
        for frame in frames:
            for row in zip(*[frame[c].tolist() for c in ("key", "migration", "after", "place", "closing", "record")], strict=True):
                arrived.setdefault(row[0], []).append(row[1:])
        out = []
        for key, rows in arrived.items():
            done, open_, place, given, waiting = behind.get(key, (None, None, 0, 0, {}))
            for migration, after, at, closing, record in rows:
                passed = (done is not None and migration <= done) or (migration == open_ and at < place)
                if not passed:
                    waiting.setdefault((int(migration), int(at)), [int(migration), None if pd.isna(after) else int(after), int(at), bool(closing), record])
            while True:
                if open_ is None:
                    open_ = next((r[0] for r in waiting.values() if r[1] == done), None)
                    place = 0
                found = waiting.pop((open_, place), None)
                if found is None:
                    break
                out.append((key, found[0], found[2], given, found[4]))
                given, place = given + 1, place + 1
                if found[3]:
                    done, open_ = found[0], None
            behind[key] = (done, open_, place, given, waiting)
        state.update((json.dumps([[key, *own[:4], list(own[4].values())] for key, own in behind.items()]),))
        yield pd.DataFrame(out, columns=["key", "migration", "place", "position", "record"])

    grouped = stream.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket")
    return grouped.applyInPandasWithState(run, "key string, migration long, place long, position long, record string", ORDER_STATE, "append", GroupStateTimeout.NoTimeout)
