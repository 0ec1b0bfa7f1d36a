"""Source, sink, load and streaming queries: each writes or streams data of the benchmark tables and reads it back."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import metrics as M
from ledgerloom.operators import views
from ledgerloom.plans.check_queries import raw_updates
from ledgerloom.plans.digest import plain
from ledgerloom.plans.metric_queries import NOW, D, R, as_of, trunc_diff
from ledgerloom.plans.metric_queries import T as text_of
from ledgerloom.plans.oracles import sql
from ledgerloom.sources import derive, io
from ledgerloom.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], text: str, *ctes: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(query(spark, sf_dir))
    ORACLE_SQL[name] = sql(text, *ctes)


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.ledger_updates(spark, sf_dir).select("update_id", "update_type", "migration_id", "synchronizer_id", "effective_at", "record_time", "event_count", "offset")


def _landed(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    root = io.work_folder(spark)
    rows = _updates(spark, sf_dir)
    io.write_partitioned(rows, root, "updates", mode="overwrite")
    return root, rows


def partitioned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, rows = _landed(spark, sf_dir)
    return io.read_raw(spark, root, "updates", rows.drop("migration_id").schema).select("update_id", "migration", "year", "month", "day", "event_count")


def day_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, rows = _landed(spark, sf_dir)
    return io.read_day(io.read_raw(spark, root, "updates", rows.drop("migration_id").schema), 2024, 1, 12).select("update_id", "effective_at")


def file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, rows = _landed(spark, sf_dir)
    return io.file_stats(io.read_raw(spark, root, "updates", rows.drop("migration_id").schema), "effective_at").agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))


def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and times of every file, by the day that its path names (one file a day and migration here)."""
    root, rows = _landed(spark, sf_dir)
    stats = io.file_stats(io.read_raw(spark, root, "updates", rows.drop("migration_id").schema), "effective_at")
    part = lambda name: F.regexp_extract("file", f"/{name}=([^/]+)/", 1)
    return stats.select(F.concat_ws("/", *[part(p) for p in io.PARTS]).alias("path"), "rows", "first", "last", (F.col("bytes") > 0).alias("filled"))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = io.work_folder(spark), _updates(spark, sf_dir)
    io.export(rows, path, "csv")
    return io.read_csv(spark, path, rows.schema).select("update_id", "update_type", "effective_at", "event_count")


def candle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles landed as JSON lines, every seventh with its time in milliseconds, and read back."""
    path, rows = io.work_folder(spark), derive.candles(spark, sf_dir)
    at = F.when(F.unix_seconds(F.col("ts").cast("timestamp")) % 7 == 0, F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    io.export(rows.withColumn("ts", at), path, "json")
    return io.read_candles(spark, path).select("pair", "ts", "open", "price", "volume", "count")


def stored_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored by entity and day; rows of every view of one entity, read by the stored column."""
    path, events = io.work_folder(spark), derive.ledger_events(spark, sf_dir)
    io.store_events(events, path)
    stored = spark.read.parquet(path)
    found = [views.template_view(stored, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("view"), "rows") for name in ("amulet", "vote_request", "validator_license", "dso_rules", "open_mining_round")]
    return reduce(DataFrame.unionByName, found)


def batch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches by offset, the third written twice: the replay leaves one copy."""
    path, rows = io.work_folder(spark), _updates(spark, sf_dir)
    for batch in (0, 1, 2, 3, 2):
        io.write_batch_idempotent(rows.where(F.col("offset") % 4 == batch), path, batch)
    return spark.read.parquet(path).groupBy("batch").agg(F.count("*").alias("rows"), F.count_distinct("update_id").alias("ids"))


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = io.work_folder(spark), _updates(spark, sf_dir)
    later = rows.where("offset % 3 = 0").withColumn("record_time", F.expr("record_time + interval 1 hour"))
    io.write_compacted(rows.unionByName(later), path, "update_id", "record_time", max_rows=200)
    return spark.read.parquet(path).select("update_id", "record_time")


def daily_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = derive.ledger_updates(spark, sf_dir).select("update_id", "record_date")
    loaded = source.where("record_date < date '2024-01-15' and substring(update_id, 2) % 5 <> 0")
    return io.incremental_load(loaded, source, "update_id", "record_date", F.lit("2024-01-20 00:00:00").cast("timestamp"))


def vote_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = derive.ledger_base(spark, sf_dir)
    current = base.where("id % 2 = 0").select(F.col("id").alias("tracking_cid"), F.lit("open").alias("status"), F.col("k").alias("votes"), F.col("kind").alias("note"))
    new = base.where("id % 3 = 0").select(F.col("id").alias("tracking_cid"), F.lit("passed").alias("status"), (F.col("k") + 1).alias("votes"), F.lit("new").alias("note"))
    return io.upsert(current, new, "tracking_cid", ["status", "votes"])


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = io.work_folder(spark), _updates(spark, sf_dir)
    io.export(rows, f"{path}/lines", "json")
    io.jsonl_to_parquet(spark, f"{path}/lines", f"{path}/typed", rows.schema)
    return spark.read.parquet(f"{path}/typed").select("update_id", "effective_at", "event_count")


def json_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No Parquet there, so the JSON lines are read."""
    path, rows = io.work_folder(spark), _updates(spark, sf_dir)
    rows.write.option("compression", "gzip").json(f"{path}/updates")
    return io.read_ledger(spark, path, "updates", rows.schema).select("update_id", "record_time")


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files lists of different columns, united by name."""
    path, rows = io.work_folder(spark), _updates(spark, sf_dir)
    rows.where("offset % 2 = 0").drop("offset").write.parquet(f"{path}/a")
    rows.where("offset % 2 = 1").write.parquet(f"{path}/b")
    return io.read_files(spark, [f"{path}/a", f"{path}/b"]).select("update_id", "offset")


def acs_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot contracts landed as Parquet and as JSON lines; those of the second migration lie in both."""
    path, rows = io.work_folder(spark), derive.ledger_acs(spark, sf_dir).select("contract_id", "template_id", "migration_id", "snapshot_time")
    rows.where("migration_id = 1 or substring(contract_id, 2) % 2 = 0").write.parquet(f"{path}/acs/a")
    rows.where("migration_id = 1 or substring(contract_id, 2) % 2 = 1").write.option("compression", "gzip").json(f"{path}/acs/b")
    return io.read_acs(spark, path, rows.schema)


def _lines(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """Updates landed as JSON lines of known length, one file in each partition of ``parts``; read back."""
    path, rows = io.work_folder(spark), derive.ledger_updates(spark, sf_dir).withColumn("few", F.expr("offset % 5 = 0"))
    rows.withColumnRenamed("migration_id", "migration").select("update_id", "update_type", "synchronizer_id", *parts).repartition(*parts).write.partitionBy(*parts).json(f"{path}/updates")
    return spark.read.json(f"{path}/updates")


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth update is landed under the day after its own, then the tree is repaired."""
    root, target, rows = io.work_folder(spark), io.work_folder(spark), _updates(spark, sf_dir)
    at = F.when(F.col("offset") % 4 == 0, F.expr("effective_at + interval 1 day")).otherwise(F.col("effective_at"))
    landed = rows.select("*", F.col("migration_id").alias("migration"), F.year(at).alias("year"), F.month(at).alias("month"), F.dayofmonth(at).alias("day"))
    landed.write.partitionBy(*io.PARTS).parquet(f"{root}/updates")
    io.repair_partitions(spark, root, "updates", target, rows.schema)
    return io.read_raw(spark, target, "updates", rows.drop("migration_id").schema).select("update_id", "migration", "year", "month", "day", "event_count")


def stream_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records as a stream, three files a batch, every thirteenth damaged: updates with the number of their events,
    and one row with the number of dead letters."""
    folder = io.work_folder(spark)
    raw = raw_updates(lambda frame: getattr(derive, frame)(spark, sf_dir))
    raw.select(F.when(F.regexp_extract("json", '"update_id":"u([0-9]+)"', 1).cast("long") % 13 == 0, "{broken").otherwise(F.col("json")).alias("json")).write.parquet(f"{folder}/raw")
    jobs.start_normalize(jobs.stream_files(spark, f"{folder}/raw", raw.schema, files_per_batch=3), f"{folder}/out", f"{folder}/state").awaitTermination()
    events = spark.read.parquet(f"{folder}/out/events").groupBy("update_id").agg(F.count("*").alias("events"))
    good = spark.read.parquet(f"{folder}/out/updates").select("update_id", "update_type").join(events, "update_id", "left")
    dead = spark.read.schema("update_data string, batch string").parquet(f"{folder}/out/dead").agg(F.count("*").alias("events"))
    return good.unionByName(dead.select(F.lit("dead").alias("update_id"), F.lit(None).cast("string").alias("update_type"), "events"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the benchmark's event files."""
    path = f"{sf_dir}/events.parquet"
    rows = jobs.stream_files(spark, path + "*", derive.table(spark, sf_dir, "events").schema)
    return rows.select(F.col("event_id").alias("id"), F.col("event_type"), F.col("ts").cast("timestamp").alias("at"), F.expr("case when ts < timestamp '2024-01-16 00:00:00' then 0L else 1L end").alias("migration_id"))


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = io.work_folder(spark)
    return jobs.run_to_table(jobs.tumbling_counts(_stream(spark, sf_dir), "at", "1 hour", "migration_id"), f"{folder}/out", f"{folder}/state")


def stream_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch gives out the types that it changed."""
    folder = io.work_folder(spark)
    return jobs.run_changes(jobs.type_counts(_stream(spark, sf_dir)), f"{folder}/out", f"{folder}/state", "event_type")


def stream_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every party's events, landed in two lots without any order; the stream ends after the first lot, and a new one goes on
    from its checkpoint."""
    folder = io.work_folder(spark)
    order = Window.partitionBy("u", "m").orderBy("ts", "id")
    rows = derive.ledger_base(spark, sf_dir).select("id", "u", "m", (F.row_number().over(order) - 1).cast("long").alias("place"), F.lead("id").over(order).isNull().alias("closing"))
    first = F.min("m").over(Window.partitionBy("u"))
    rows = rows.withColumn("after", F.when(F.col("m") > first, F.col("m") - 1)).select(F.concat(F.lit("p"), "u").alias("key"), F.col("m").alias("migration"), "after", "place", "closing", F.col("id").cast("string").alias("record"))
    lots = rows.withColumn("lot", F.pmod(F.xxhash64("record"), F.lit(2)))
    schema = T.StructType([f for f in lots.schema.fields if f.name != "lot"])
    for lot in (1, 0):
        lots.where(F.col("lot") == lot).drop("lot").repartition(3, F.xxhash64("record", "key")).write.mode("append").parquet(f"{folder}/in")
        stream = jobs.ordered_migrations(jobs.stream_files(spark, f"{folder}/in", schema, files_per_batch=2))
        found = jobs.run_to_table(stream, f"{folder}/out", f"{folder}/state", mode="append")
    return found.select("key", "migration", "place", "position", F.col("record").cast("long").alias("id"))


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = io.work_folder(spark)
    twice = _stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return jobs.run_to_table(jobs.stream_dedup(twice, "id", "at", "60 days"), f"{folder}/out", f"{folder}/state", mode="append").select("id", "event_type", "at")


def stream_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.freshness(_updates(spark, sf_dir), "record_time", as_of(), "migration_id", "synchronizer_id")


_PLACED = "SELECT update_id, migration_id AS migration, CAST(year(effective_at) AS BIGINT) AS year, CAST(month(effective_at) AS BIGINT) AS month, CAST(day(effective_at) AS BIGINT) AS day, event_count FROM up"
add("partitioned_read", partitioned_read, _PLACED)
add("day_read", day_read, f"SELECT update_id, {text_of('effective_at')} FROM up WHERE CAST(effective_at AS DATE) = DATE '2024-01-12'")
add("file_ranges", file_ranges, f"SELECT count(*) AS rows, {text_of('min(effective_at)', 'first')}, {text_of('max(effective_at)', 'last')} FROM up")
add("batch_replay", batch_replay, 'SELECT CAST("offset" % 4 AS BIGINT) AS batch, count(*) AS rows, count(DISTINCT update_id) AS ids FROM up GROUP BY 1')
add("compacted", compacted, """SELECT update_id, strftime(CASE WHEN "offset" % 3 = 0 THEN record_time + INTERVAL 1 HOUR ELSE record_time END, '%Y-%m-%d %H:%M:%S') AS record_time FROM up""")
add("daily_load", daily_load, f"""SELECT update_id, {D("record_date")} FROM up WHERE record_date BETWEEN (SELECT max(record_date) - 1 FROM up WHERE record_date < DATE '2024-01-15' AND "offset" % 5 <> 0) AND DATE '2024-01-19' AND NOT (record_date < DATE '2024-01-15' AND "offset" % 5 <> 0)""")
add("vote_upsert", vote_upsert, "SELECT id AS tracking_cid, CASE WHEN id % 3 = 0 THEN 'passed' ELSE 'open' END AS status, CASE WHEN id % 3 = 0 THEN k + 1 ELSE k END AS votes, CASE WHEN id % 2 = 0 THEN kind ELSE 'new' END AS note FROM base WHERE id % 2 = 0 OR id % 3 = 0")
add("json_roundtrip", json_roundtrip, f"SELECT update_id, {text_of('effective_at')}, event_count FROM up")
add("json_ledger", json_ledger, f"SELECT update_id, {text_of('record_time')} FROM up")
_LINE = "len(update_id) + len(update_type) + len(synchronizer_id) + len('{\"update_id\":\"\",\"update_type\":\"\",\"synchronizer_id\":\"\"}') + 1"
add("listed_files", listed_files, 'SELECT update_id, CASE WHEN "offset" % 2 = 1 THEN "offset" END AS "offset" FROM up')
add("acs_formats", acs_formats, f"SELECT DISTINCT contract_id, template_id, migration_id, {text_of('snapshot_time')} FROM acs")
add("tiny_files", lambda s, d: io.tiny_files(io.file_stats(_lines(s, d, "record_date", "few"), "record_date")).select("bytes", "rows", F.col("first").alias("day")), f"""
SELECT CAST(sum({_LINE}) AS BIGINT) AS bytes, count(*) AS rows, {D("record_date", "day")} FROM up GROUP BY record_date, "offset" % 5 = 0 HAVING sum({_LINE}) < 1024""")
add("archive_stats", lambda s, d: io.archive_stats(io.file_stats(_lines(s, d, "migration", "record_date"), "record_date")), f"""
SELECT 'updates' AS kind, CAST(migration_id AS VARCHAR) AS migration, count(DISTINCT record_date) AS files, CAST(sum({_LINE}) AS BIGINT) AS bytes FROM up GROUP BY migration_id""")
add("repaired_partitions", repaired, _PLACED)
add("stream_normalized", stream_normalized, """
SELECT update_id, CASE WHEN g % 7 = 0 THEN 'reassignment' ELSE 'transaction' END AS update_type, CASE WHEN g % 7 = 0 THEN 1 ELSE n END AS events FROM (SELECT update_id, CAST(substr(update_id, 2) AS BIGINT) AS g, count(*) AS n FROM ev WHERE event_type <> 'archived' GROUP BY update_id) WHERE g % 13 <> 0
UNION ALL SELECT 'dead', NULL, count(DISTINCT update_id) FROM ev WHERE event_type <> 'archived' AND CAST(substr(update_id, 2) AS BIGINT) % 13 = 0""")
add("stream_hourly", stream_hourly, f"SELECT {text_of('period')}, migration_id, rows FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS period, m AS migration_id, count(*) AS rows FROM base GROUP BY 1, 2)")
add("stream_types", stream_types, "SELECT kind AS event_type, count(*) AS events FROM base GROUP BY kind")
add("stream_distinct", stream_distinct, "SELECT id, kind AS event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS \"at\" FROM base")
add("stream_migrations", stream_migrations, "SELECT 'p' || u AS key, m AS migration, row_number() OVER (PARTITION BY u, m ORDER BY ts, id) - 1 AS place, row_number() OVER (PARTITION BY u ORDER BY m, ts, id) - 1 AS position, id FROM base")
add("file_report", file_report, f"SELECT migration_id || '/' || year(effective_at) || '/' || month(effective_at) || '/' || day(effective_at) AS path, count(*) AS rows, {text_of('min(effective_at)', 'first')}, {text_of('max(effective_at)', 'last')}, true AS filled FROM up GROUP BY 1")
add("csv_roundtrip", csv_roundtrip, f"SELECT update_id, update_type, {text_of('effective_at')}, event_count FROM up")
add("candle_files", candle_files, f"SELECT pair, {text_of('ts')}, {R('open', 'open')}, {R('close', 'price')}, {R('volume', 'volume')}, count FROM candles")
add("stored_views", stored_views, " UNION ALL ".join(f"SELECT '{name}' AS view, count(*) AS rows FROM ev WHERE event_type IN ({', '.join(repr(e) for e in views.VIEWS[name].events)}) AND template_id LIKE '%:{views.VIEWS[name].entity}'" for name in ("amulet", "vote_request", "validator_license", "dso_rules", "open_mining_round")))
add("stream_freshness", stream_freshness, f"SELECT migration_id, synchronizer_id, n AS rows, a AS age_seconds, CASE WHEN a < 60 THEN 'live' WHEN a < 300 THEN 'idle' ELSE 'stale' END AS state FROM (SELECT migration_id, synchronizer_id, count(*) AS n, {trunc_diff('second', 'max(record_time)', NOW)} AS a FROM up GROUP BY 1, 2)")
add("round_party_totals", lambda s, d: derive.round_party_totals(s, d), f"SELECT party, closed_round, {R('cumulative_app_rewards', 'cumulative_app_rewards')} FROM rpt")
add("candles", lambda s, d: derive.candles(s, d), f"SELECT pair, {text_of('ts')}, {R('open', 'open')}, {R('high', 'high')}, {R('low', 'low')}, {R('close', 'close')}, {R('volume', 'volume')}, count FROM candles")
add("ingestion_stats", lambda s, d: derive.ledger_updates(s, d).agg(F.count("*").alias("updates"), F.count_if(F.col("update_type") == "reassignment").alias("reassignments"), F.sum("event_count").alias("events"), F.max("record_time").alias("latest")), f"SELECT count(*) AS updates, count(*) FILTER (update_type = 'reassignment') AS reassignments, CAST(sum(event_count) AS BIGINT) AS events, {text_of('max(record_time)', 'latest')} FROM up")
add("updates_by_type", lambda s, d: derive.ledger_updates(s, d).groupBy("update_type").agg(F.count("*").alias("updates")), "SELECT update_type, count(*) AS updates FROM up GROUP BY update_type")
add("count_styles", lambda s, d: M.total_counts(derive.ledger_events(s, d), derive.ledger_updates(s, d)).select((F.col("events") + F.col("updates")).alias("both"), "events"), "SELECT (SELECT count(*) FROM ev) + (SELECT count(*) FROM up) AS both, (SELECT count(*) FROM ev) AS events")
