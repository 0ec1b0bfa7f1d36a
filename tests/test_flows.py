"""Sources, sinks and streams on temporary folders."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.bronze import extract_events, normalize_event, normalize_update
from ledgerloom.sources import io
from ledgerloom.streaming import jobs

SCHEMA = "update_id string, migration_id long, effective_at timestamp"


def rows(spark):
    return spark.createDataFrame([("a", 0, dt.datetime(2024, 1, 1, 23, 59)), ("b", 0, dt.datetime(2024, 1, 2, 0, 1)), ("c", 1, dt.datetime(2024, 1, 2)), ("d", 1, dt.datetime(1999, 1, 1)), ("e", 1, None)], SCHEMA)


def test_batch_over_midnight_goes_to_two_partitions(spark, tmp_path):
    io.write_partitioned(rows(spark), str(tmp_path), "updates")
    assert (tmp_path / "updates/migration=0/year=2024/month=1/day=1").is_dir() and (tmp_path / "updates/migration=0/year=2024/month=1/day=2").is_dir()
    raw = io.read_raw(spark, str(tmp_path), "updates", T.StructType.fromDDL("update_id string, effective_at timestamp"))
    assert raw.count() == 3
    assert {r["update_id"] for r in io.rejected_rows(rows(spark)).collect()} == {"d", "e"}
    day = io.read_day(raw, 2024, 1, 2)
    assert {r["update_id"] for r in day.collect()} == {"b", "c"}
    assert "PartitionFilters: [isnotnull(year" in day._jdf.queryExecution().toString()


def test_ledger_format_preference_and_empty(spark, tmp_path):
    schema = T.StructType.fromDDL("update_id string, n long")
    assert io.read_ledger(spark, str(tmp_path), "updates", schema).count() == 0
    (tmp_path / "updates").mkdir()
    (tmp_path / "updates/x.jsonl").write_text('{"update_id":"a","n":1}\nbroken\n{"update_id":"b"}\n')
    assert {r["update_id"] for r in io.read_ledger(spark, str(tmp_path), "updates", schema).collect()} == {"a", "b"}
    spark.createDataFrame([("p", 1)], schema).write.parquet(str(tmp_path / "updates/day"))
    assert [r["update_id"] for r in io.read_ledger(spark, str(tmp_path), "updates", schema).collect()] == ["p"]


def test_acs_union_is_distinct(spark, tmp_path):
    schema = T.StructType.fromDDL("contract_id string, snapshot_time string")
    spark.createDataFrame([("a", "t"), ("b", "t")], schema).write.parquet(str(tmp_path / "acs/p"))
    spark.createDataFrame([("b", "t"), ("c", "t")], schema).write.json(str(tmp_path / "acs/j"))
    assert sorted(r["contract_id"] for r in io.read_acs(spark, str(tmp_path), schema).collect()) == ["a", "b", "c"]


def test_files_with_missing_columns_are_united(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "1"))
    spark.createDataFrame([(2, "x")], "a int, b string").write.parquet(str(tmp_path / "2"))
    got = io.read_files(spark, [str(tmp_path / "1"), str(tmp_path / "2")])
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(1, None), (2, "x")]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    for batch in (1, 2, 1):
        io.write_batch_idempotent(rows(spark).limit(batch), path, batch)
    assert spark.read.parquet(path).count() == 3


def test_incremental_load_adds_only_new_rows(spark):
    day = lambda d: dt.date(2024, 1, d)
    loaded = spark.createDataFrame([("a", day(1)), ("b", day(3))], "id string, day date")
    source = spark.createDataFrame([("a", day(1)), ("x", day(1)), ("b", day(3)), ("c", day(3)), ("y", day(2)), ("d", day(4)), ("e", day(6))], "id string, day date")
    got = io.incremental_load(loaded, source, "id", "day", F.lit("2024-01-06").cast("timestamp"))
    assert sorted(r["id"] for r in got.collect()) == ["c", "d", "y"]


def test_repair_and_file_reports(spark, tmp_path):
    wrong = tmp_path / "raw/updates/migration=0/year=2024/month=1/day=9"
    spark.createDataFrame([("a", "2024-01-01T00:00:00Z")], "update_id string, effective_at string").write.parquet(str(wrong))
    schema = T.StructType.fromDDL("update_id string, effective_at string, migration_id long")
    rows_ = io.read_raw(spark, str(tmp_path / "raw"), "updates", schema).withColumn("migration_id", F.col("migration").cast("long"))
    io.write_partitioned(rows_.drop("migration", "year", "month", "day").withColumn("effective_at", F.try_to_timestamp("effective_at")), str(tmp_path / "fixed"), "updates")
    assert (tmp_path / "fixed/updates/migration=0/year=2024/month=1/day=1").is_dir()
    stats = io.file_stats(io.read_raw(spark, str(tmp_path / "fixed"), "updates", T.StructType.fromDDL("update_id string, effective_at timestamp")), "effective_at")
    assert stats.first()["rows"] == 1 and io.tiny_files(stats, 10**6).count() == 1
    assert io.archive_stats(stats).first()["files"] == 1


def test_bad_json_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"a":1}\nnope\n{"a":2}\n')
    io.jsonl_to_parquet(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), T.StructType.fromDDL("a long"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert spark.read.text(str(tmp_path / "out_bad")).first()["value"] == "nope"


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def land(n, *updates):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps({"json": json.dumps(u)}) for u in updates))

    def update(k):
        return {"transaction": {"update_id": f"u{k}", "record_time": "2024-01-01T00:00:00Z", "events_by_id": {f"u{k}:0": {"created_event": {"event_id": f"u{k}:0", "contract_id": f"c{k}"}}}}}

    schema = T.StructType.fromDDL("json string")
    land(1, update(1), update(2), {"noise": 1})
    for n in (2, 3):
        stream = jobs.stream_files(spark, str(tmp_path / "in"), schema, "json", files_per_batch=1)
        jobs.start_normalize(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        land(n, update(n + 1))
    stream = jobs.stream_files(spark, str(tmp_path / "in"), schema, "json", files_per_batch=1)
    jobs.start_normalize(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    streamed = {r["event_id"] for r in spark.read.parquet(str(tmp_path / "out/events")).collect()}
    batch = normalize_event(extract_events(normalize_update(spark.read.schema(schema).json(str(tmp_path / "in")))))
    assert streamed == {r["event_id"] for r in batch.collect()} == {"u1:0", "u2:0", "u3:0", "u4:0"}
    assert spark.read.parquet(str(tmp_path / "out/dead")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out/updates")).count() == 4


def test_migrations_in_order_whatever_arrives(spark):
    """Shuffled, repeated and late records over several restarts: each key's records come out in order, once, and nothing
    passes a gap or an unfinished migration."""
    import random

    from pyspark.sql import types as T

    from ledgerloom.sources.scratch import work_folder
    from ledgerloom.streaming import jobs

    schema = T._parse_datatype_string("key string, migration long, after long, place long, closing boolean, record string")
    sizes = {"a": {0: 5, 1: 3, 4: 2}, "b": {2: 6}, "c": {0: 1, 3: 4}, "gap": {0: 4, 1: 2}}
    rows = []
    for key, parts in sizes.items():
        before = None
        for migration, n in parts.items():
            rows += [(key, migration, before, k, k == n - 1, f"{key}{migration}-{k}") for k in range(n)]
            before = migration
    rows = [r for r in rows if r[5] != "gap0-2"]  # never arrives
    pick = random.Random(3)
    pick.shuffle(rows)
    folder = work_folder(spark)
    for k in range(3):
        lot = rows[k::3] + (rows[:4] if k else [])
        spark.createDataFrame(lot, schema).repartition(2).write.mode("append").parquet(f"{folder}/in")
        found = jobs.run_to_table(jobs.ordered_migrations(jobs.stream_files(spark, f"{folder}/in", schema, files_per_batch=1)), f"{folder}/out", f"{folder}/state", mode="append")
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["key"], r["position"])):
        got.setdefault(r["key"], []).append((r["position"], r["migration"], r["place"], r["record"]))
    want = {key: [(m, k) for m, n in parts.items() for k in range(n)] for key, parts in sizes.items()}
    want["gap"] = [(0, 0), (0, 1)]
    assert got == {key: [(p, m, k, f"{key}{m}-{k}") for p, (m, k) in enumerate(places)] for key, places in want.items()}
