"""Stored events by entity, ranks of ties, reports and decisions on small frames."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import governance, lifecycle, metrics, views
from ledgerloom.sources import io
from ledgerloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
EVENT = "event_id string, update_id string, contract_id string, event_type string, template_id string, choice string, consuming boolean, effective_at timestamp, event_date date, migration_id long, payload string, exercise_result string"


def test_views_of_stored_events_read_few_files(spark):
    names = ["Splice.Amulet:Amulet", "Splice.Amulet:LockedAmulet", "Splice.DsoRules:VoteRequest", "Splice.Ans:AnsEntry", "Splice.Round:OpenMiningRound"]
    rows = [(f"e{k}", f"u{k}", f"c{k}", "created", f"pkg:{names[k % 5]}", None, None, T0 + dt.timedelta(days=k % 20), (T0 + dt.timedelta(days=k % 20)).date(), 0, '{"owner":"p"}', None) for k in range(2000)]
    events = spark.createDataFrame(rows, EVENT)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        plain, stored = io.work_folder(spark), io.work_folder(spark)
        events.repartition(20).write.parquet(plain)
        io.store_events(events, stored)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    before, after = spark.read.parquet(plain), spark.read.parquet(stored)
    view = lambda df: views.template_view(df, "ans_entry")
    assert sorted(map(str, view(before).collect())) == sorted(map(str, view(after).collect()))
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(entity,AnsEntry\)", view(after)._jdf.queryExecution().executedPlan().toString())
    holding = lambda df: df.where(F.col("template_id").endswith(":AnsEntry")).select(F.col("_metadata.file_path")).distinct().count()
    assert holding(before) == 20 and holding(after) <= 6
    assert view(after).count() == 400 and views.template_view(after, "amulet").count() == 400  # a locked token is no token


def test_ranks_of_equal_amounts(spark):
    """All amounts equal: still split over several parts, and numbered by id."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        coupons = spark.range(4000).select(F.format_string("c%05d", "id").alias("contract_id"), F.lit(T0).alias("effective_at"), F.lit(5).cast("decimal(38,10)").alias("amount"))
        spread = coupons.repartitionByRange(-F.col("amount"), "contract_id").groupBy(F.spark_partition_id()).count().collect()
        got = metrics.dev_fund_summary(coupons).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in spread) <= 2 * 4000 / 4 and len(spread) == 4
    assert {r["contract_id"]: r["rank"] for r in got} == {f"c{k:05d}": k + 1 for k in range(4000)}
    mixed = spark.createDataFrame([("a", T0, None), ("b", T0, 3), ("c", T0, 7), ("d", T0, 3)], "contract_id string, effective_at timestamp, amount long").withColumn("amount", F.col("amount").cast("decimal(38,10)"))
    assert {r["contract_id"]: r["rank"] for r in metrics.dev_fund_summary(mixed).collect()} == {"c": 1, "b": 2, "d": 3, "a": 4}
    assert metrics.dev_fund_summary(mixed.where("false")).count() == 0


def test_reports_keep_what_they_hold(spark):
    rows = [("a,b", 'say "x"\nand', dt.datetime(2024, 1, 2, 3, 4, 5, 678901), 1.5), ("", None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, at timestamp, d double")
    path = io.work_folder(spark)
    io.export(df, path, "csv")
    got = io.read_csv(spark, path, df.schema).where("a = 'a,b'").first()
    assert tuple(got) == rows[0]


def test_candles_of_odd_lines(spark):
    path = io.work_folder(spark)
    lines = ['{"pair":"cc","ts":1704067200000,"open":"1.5","close":2,"volume":"x","count":"3"}', '{"pair":"cc","ts":"2024-01-01T01:00:00Z","price":9,"close":1}', '{"ts":"2024-01-01"}', "no json", '{"pair":"cc","ts":"never"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    got = sorted((r["ts"].hour, r["open"], r["price"], r["volume"], r["count"]) for r in io.read_candles(spark, path).collect())
    assert got == [(0, 1.5, 2.0, None, 3), (1, None, 9.0, None, None)]


def test_decision_filters(spark):
    rows = [("a", "t1", T0, "cip", True, 0.9), ("a", "t2", T0 + dt.timedelta(days=2), "other", False, 0.2), ("b", "t3", T0 + dt.timedelta(days=1), "cip", True, 0.5), ("c", "t4", T0, "cip", None, None)]
    traces = spark.createDataFrame(rows, "item_id string, trace_id string, decided_at timestamp, final_type string, consulted boolean, confidence double")
    latest = governance.latest_decisions(traces)
    ids = lambda df: [r["item_id"] for r in df.collect()]
    assert ids(governance.query_decisions(latest)) == ["a", "b", "c"]
    assert ids(governance.query_decisions(latest, kind="cip")) == ["b", "c"]
    assert ids(governance.query_decisions(latest, since="2024-01-02", until="2024-01-02")) == ["b"]
    assert ids(governance.query_decisions(latest, consulted=False)) == ["a"] and ids(governance.query_decisions(latest, min_confidence=0.4)) == ["b"]
    assert ids(governance.query_decisions(latest, limit=1)) == ["a"]
    totals = {r["final_type"]: (r["items"], r["consulted"], r["confidence"]) for r in governance.decision_totals(latest).collect()}
    assert totals == {"cip": (2, 1, 0.5), "other": (1, 0, 0.2), None: (3, 1, 0.35)}


def test_states_of_proposals(spark):
    ask = lambda n, payload, update=None, at=0: (f"e{n}", update or f"u{n}", f"c{n}", "created", "p:Splice.DsoRules:VoteRequest", None, None, T0 + dt.timedelta(days=at), T0.date(), 0, payload, None)
    rows = [
        ask(1, '{"trackingCid":"p1","voteBefore":"2024-01-05T00:00:00Z","reason":{"body":"why"}}'), ask(2, '{"trackingCid":"p1","voteBefore":"2024-01-05T00:00:00Z"}', at=1),
        ask(3, '{"voteBefore":"2024-01-05T00:00:00Z","votes":{"x":{"accept":"true"}}}'), ask(4, '{"voteBefore":"2025-01-05T00:00:00Z"}'),
        ("e5", "u5", "c2", "archived", "p:Splice.DsoRules:VoteRequest", None, None, T0, T0.date(), 0, "{}", None), ("e6", "u5", "r", "exercised", "p:Splice.DsoRules:DsoRules", "DsoRules_CloseVoteRequest", True, T0, T0.date(), 0, "{}", None),
        ("e7", "u7", "r", "exercised", "p:Splice.DsoRules:DsoRules", "DsoRules_AddSv", True, T0, T0.date(), 0, "{}", None), ("e8", "u4", "r", "exercised", "p:Splice.DsoRules:DsoRules", "DsoRules_AddSv", True, T0, T0.date(), 0, "{}", None),
    ]
    events = spark.createDataFrame(rows, EVENT)
    results = spark.createDataFrame([("p1", "c1", "VRO_Rejected", T0), ("p1", "c2", "VRO_Accepted", T0 + dt.timedelta(days=3)), ("", "c9", None, T0)], "tracking_cid string, contract_id string, outcome_tag string, completed_at timestamp")
    closed = lifecycle.closed_votes(results)
    assert {r["proposal_id"]: r["status"] for r in closed.collect()} == {"p1": "accepted", "c9": "expired"}
    got = {r["proposal_id"]: tuple(r)[1:] for r in lifecycle.proposal_states(events, closed, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {"p1": ("c2", "accepted", True, True, False, 2), "c3": ("c3", "expired", True, False, True, 1), "c4": ("c4", "in_progress", False, False, False, 1)}
    direct = [(r["event_id"], r["action_subject"], r["status"]) for r in governance.direct_actions(events).collect()]
    assert sorted(direct) == [("e6", "CloseVoteRequest", "executed"), ("e7", "AddSv", "executed")]


def test_a_paced_stream(spark):
    """A processing interval instead of one run over all files."""
    folder = io.work_folder(spark)
    schema = T.StructType([T.StructField("json", T.StringType())])
    spark.createDataFrame([("{broken",), ('{"update_id":"u1"}',)], schema).write.parquet(f"{folder}/raw")
    query = jobs.start_normalize(jobs.stream_files(spark, f"{folder}/raw", schema, files_per_batch=1), f"{folder}/out", f"{folder}/state", pace="1 second")
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert spark.read.schema("update_data string, batch string").parquet(f"{folder}/out/dead").count() >= 1
