"""Plans that must hold at scale: running ends of split keys, day-pruned checks, one snapshot read, chains of overrides."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import governance, metrics, quality
from ledgerloom.sources.scratch import work_folder

T0 = dt.datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gaps_of_one_hot_key_equal_brute_force(spark):
    pick = random.Random(5)
    rows = []
    for k in range(3000):
        start = T0 + dt.timedelta(seconds=pick.randint(0, 400_000))
        rows.append(("hot" if k % 10 else pick.choice(["a", "b", None]), start, start + dt.timedelta(seconds=pick.choice([5, 60, 300, 3000]))))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "k string, start timestamp, end timestamp")
    want = []
    for key in ("hot", "a", "b", None):
        top, own = None, []
        for _, start, end in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            if top is not None and (start - top).total_seconds() > 120:
                own.append((key, top, start, int((start - top).total_seconds() * 1000)))
            top = end if top is None else max(top, end)
        want += [(*g, sum(x[3] for x in own)) for g in own]
    got = [tuple(r) for r in quality.time_gaps(df, "k", 120).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 100
    assert quality.time_gaps(df.where("false"), "k", 120).count() == 0


def test_running_max_splits_a_key(spark):
    df = spark.range(4000).select(F.lit("one").alias("k"), F.col("id").alias("at"), F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = quality.running_max(df, "k", ("at",), "v", "top")
        rows = found.orderBy("at").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    top = None
    for r in rows:
        assert r["top"] == top
        top = r["v"] if top is None else max(top, r["v"])
    assert "Window" in plan_of(found) and not re.search(r"hashpartitioning\(k#\d+, \d+\), ENSURE.*\n.*Sort \[k", plan_of(found))


@pytest.fixture
def landed(spark):
    folder = work_folder(spark)
    days = [dt.date(2024, 1, d) for d in range(1, 21)]
    updates = spark.createDataFrame([(f"u{k}", days[k % 20], 2) for k in range(200) if k % 9], "update_id string, record_date date, event_count long")
    events = spark.createDataFrame([(f"u{k}", days[(k + s) % 20 if s < 2 or k % 10 else (k + 5) % 20]) for k in range(200) for s in (0, 1 + k % 2)], "update_id string, event_date date")
    updates.repartition("record_date").write.partitionBy("record_date").parquet(f"{folder}/updates")
    events.repartition("event_date").write.partitionBy("event_date").parquet(f"{folder}/events")
    read = lambda kind, like: spark.read.schema(like.schema).parquet(f"{folder}/{kind}")
    return read("updates", updates), read("events", events)


def test_day_checks_read_days_alone(spark, landed):
    updates, events = landed
    days = ("2024-01-08", "2024-01-10")
    for found in (quality.orphan_events(events, updates, days), quality.event_count_mismatch(events, updates, days), quality.completeness(updates, updates.where("update_id <> 'u7'"), "update_id", "record_date", days)):
        filters = re.findall(r"PartitionFilters: \[([^]]*)\]", plan_of(found))
        assert len(filters) >= 2 and all(">=" in f and "<=" in f for f in filters)
    own, near = updates.collect(), lambda a, b: abs((a - b).days) <= 1
    first, last = (dt.date.fromisoformat(d) for d in days)
    want = {}
    for e in events.collect():
        if first <= e["event_date"] <= last and not any(u["update_id"] == e["update_id"] and near(u["record_date"], e["event_date"]) for u in own):
            want[e["update_id"], str(e["event_date"])] = want.get((e["update_id"], str(e["event_date"])), 0) + 1
    got = {(r["scope"], r["detail"]): r["affected"] for r in quality.orphan_events(events, updates, days).collect()}
    assert got == want and want
    whole = {(r["scope"], r["detail"]): r["affected"] for r in quality.orphan_events(events, updates).collect()}
    assert {k: n for k, n in whole.items() if days[0] <= k[1] <= days[1]} == want
    miss = {r["scope"]: r["detail"] for r in quality.event_count_mismatch(events, updates, days).collect()}
    for u in own:
        n = sum(e["update_id"] == u["update_id"] and near(e["event_date"], u["record_date"]) for e in events.collect()) if first <= u["record_date"] <= last else 0
        assert miss.get(u["update_id"]) == (f"{n} observed, declared 2" if n not in (0, 2) else None)


def test_latest_snapshot_reads_one_snapshot(spark):
    folder = work_folder(spark)
    rows = spark.range(300).select(F.concat(F.lit("c"), "id").alias("contract_id"), F.lit("p:Splice.Amulet:Amulet").alias("template_id"), F.lit(T0).alias("record_time"), F.format_string('{"owner":"p%d","amount":{"initialAmount":"2.5"}}', F.col("id") % 7).alias("payload"), F.timestamp_add("DAY", (F.col("id") % 3).cast("int"), F.lit(T0)).alias("snapshot_time"))
    rows.repartition("snapshot_time").write.partitionBy("snapshot_time").parquet(folder)
    acs = spark.read.schema(rows.schema).parquet(folder)
    latest = metrics.latest_snapshot(acs)
    assert latest.count() == 100
    assert re.search(r"PartitionFilters: \[[^]]*snapshot_time#\d+ = (Scalar)?[Ss]ubquery", plan_of(latest))
    events = spark.createDataFrame(
        [("c2", "archived", "p:Splice.Amulet:Amulet", T0 + dt.timedelta(days=3), "{}"), ("c2", "created", "p:Splice.Amulet:Amulet", T0 + dt.timedelta(days=2), '{"owner":"p2","amount":{"initialAmount":"9"}}'),
         ("n1", "created", "p:Splice.Amulet:Amulet", T0 + dt.timedelta(days=2), '{"owner":"p2","amount":{"initialAmount":"9"}}'), ("n2", "created", "p:Splice.Amulet:Amulet", T0 + dt.timedelta(days=4), '{"owner":"new","amount":{"initialAmount":"10"}}')],
        "contract_id string, event_type string, template_id string, effective_at timestamp, payload string",
    )
    supply = metrics.realtime_supply(acs, events).first()
    assert (float(supply["total"]), supply["holders"]) == (99 * 2.5 + 10, 8)  # what was created at the snapshot's instant is in it


def replayed(edges):
    """The edges one by one in log order; one that leads back to its own start is void."""
    into = {}
    for key, target, _ in sorted(edges, key=lambda e: e[2]):
        at = target
        while at in into:
            at = into[at]
        if at != key:
            into[key] = target
    out = {}
    for key, _, _ in edges:
        at = key
        while at in into:
            at = into[at]
        out[key] = at
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chains_and_cycles_equal_the_replay(spark, seed):
    pick = random.Random(seed)
    keys = pick.sample(range(400), 300)
    edges = [(k, pick.choice([x for x in (k + 1, k - 1, pick.randrange(400)) if x != k]), s) for s, k in enumerate(keys)]
    got = {r["id"]: r["root"] for r in governance.resolve_chains(spark.createDataFrame(edges, "id long, into long, seq long").repartition(3)).collect()}
    assert got == replayed(edges)


def test_one_long_chain_and_one_long_cycle(spark):
    chain = [(k, k + 1, k) for k in range(700)]
    cycle = [(2000 + k, 2000 + (k + 1) % 90, (k * 37) % 90) for k in range(90)]
    got = {r["id"]: r["root"] for r in governance.resolve_chains(spark.createDataFrame(chain + cycle, "id long, into long, seq long")).collect()}
    assert got == replayed(chain + cycle)
    assert governance.resolve_chains(spark.createDataFrame([], "id long, into long, seq long")).count() == 0


def test_overrides_in_order(spark):
    cards = spark.createDataFrame([(k, k - k % 2, "cip" if k < 4 else "other") for k in range(10)], "topic_id long, item_id long, item_type string")
    log = [(1, "item", 0, "merge", "2"), (2, "item", 2, "merge", "4"), (3, "item", 4, "merge", "0"), (4, "item", 4, "type", "outcome"), (5, "topic", 6, "move", "0"), (6, "topic", 7, "move", "99"), (7, "topic", 8, "extract", None), (8, "topic", 9, "reclassify", "cip"), (9, "topic", 1, "reclassify", "outcome"), (2, "topic", 6, "move", "8"), (10, "topic", 77, "extract", None)]
    got = {r["topic_id"]: (r["card"], r["topic_type"]) for r in governance.apply_overrides(cards, spark.createDataFrame(log, "seq long, level string, key long, action string, value string")).collect()}
    merged = ("lifecycle-4", "outcome")
    assert got == {0: merged, 1: merged, 2: merged, 3: merged, 4: merged, 5: merged, 6: merged, 7: ("lifecycle-6", "other"), 8: ("topic-extracted-8", "other"), 9: ("topic-reclassified-9", "cip")}


def test_names_with_a_common_start_meet_seldom_and_on_no_driver(spark):
    """Short names that share whole parts (a start, an end) meet under selective keys, in a join that isn't broadcast."""
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("abcdefghjkpqruvw") for _ in range(9))
    own = [f"node{word()}" for _ in range(600)] + [f"x{word()} wallet" for _ in range(600)]
    own += [own[0][:-1], own[600].replace(" wallet", "s walle")]
    df = spark.createDataFrame(list(enumerate(own)), "id long, name string")
    found = governance.match_entities(df, df)
    got = {(r["left_id"], r["right_id"]): r["how"] for r in found.collect()}
    assert len(got) < 1300 and got[0, 1200] == "contained" and got[600, 1201] == "edit"
    node = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert re.search(r"SortMergeJoin \[key#", node) and not re.search(r"BroadcastHashJoin \[key#", node)
    keys = df.withColumn("n", F.length("name")).select("name", F.expr(f"explode(array_distinct(concat({governance._segment_keys('e')}, {governance._remainder_keys('r')})))").alias("key"))
    assert keys.join(keys.withColumnRenamed("name", "other"), "key").where("name <> other").count() < 2000
    assert "key" not in "".join(re.findall(r"Broadcast\w*Join \[([^]]*)\]", node))


def test_whole_rows_are_moved_and_sorted_once(spark):
    """Rows with payloads are sorted after they were dealt out, in many small tasks, and of ties the same row is taken."""
    rows = spark.createDataFrame([(f"c{k % 40}", "p:Splice.Amulet:Amulet", T0, f"{k:03d}", T0 + dt.timedelta(days=1)) for k in range(120)], "contract_id string, template_id string, record_time timestamp, payload string, snapshot_time timestamp")
    found = {"latest_snapshot": metrics.latest_snapshot(rows), "dedup_latest": quality.dedup_latest(rows, "contract_id", "record_time")}
    for df in found.values():
        assert sorted((r["contract_id"], r["payload"]) for r in df.collect()) == sorted((f"c{k}", f"{k + 80:03d}") for k in range(40))
        plan = plan_of(df).split("Initial Plan")[0]
        assert int(re.search(r"hashpartitioning\(contract_id#\d+, (\d+)\), REPARTITION_BY_NUM", plan)[1]) >= 200
        assert "Sort" not in plan.split("REPARTITION_BY_NUM")[1].split("Subqueries")[0]


def test_long_names_with_a_common_start_are_dealt_out_and_looked_at_once(spark):
    """Names of 38 letters that share 29 stand under six common keys: each pair is looked at once, in tasks dealt by key and lot."""
    pick = random.Random(8)
    own = ["validator onboarding for bolt" + "".join(pick.choice("abcdefgh") for _ in range(9)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(own)), "id long, name string")
    found = governance.match_entities(df, df)
    plan = plan_of(found).split("Initial Plan")[0]
    assert re.search(r"SortMergeJoin \[key#\d+L, lot#\d+", plan) and re.search(r"hashpartitioning\(key#\d+L, lot#\d+, \d{3,}\), REPARTITION_BY_NUM", plan)
    left, right = df.selectExpr("id as left_id", "name as l"), df.selectExpr("id as right_id", "name as r")
    want = left.crossJoin(right).where("left_id <> right_id and levenshtein(l, r) <= 7").select("left_id", "right_id")
    got = [tuple(r)[:2] for r in found.where("how = 'edit'").collect()]
    assert sorted(got) == sorted(tuple(r) for r in want.collect()) and len(got) > 1000
    names = df.select("name", F.length("name").alias("n"))
    met = governance._near_long(names, names).where("longer < shorter and key = array_min(array_intersect(longer_keys, shorter_keys))")
    assert met.count() == met.select("longer", "shorter").distinct().count()


def test_claims_take_a_round_for_each_step_and_no_broadcast(spark, monkeypatch):
    """In a chain of names of which each matches its neighbours every second one is an anchor: a round for each, not two."""
    names = ["a" * k + "b" * (60 - k) for k in range(0, 60, 10)]
    rows = [(k, "featured-app", None, name, False, dt.date(2024, 1, 30 - k)) for k, name in enumerate(names)] + [(100 + k, "outcome", None, None, False, T0.date()) for k in range(30)]
    typed = spark.createDataFrame(rows, "topic_id long, topic_type string, cip string, entity string, many_entities boolean, date date")
    steps, plain_cut = [], governance.cut
    monkeypatch.setattr(governance, "cut", lambda df, instead_of=None: steps.append((df.columns, df.count())) or plain_cut(df, instead_of))
    found = governance.correlate_topics(typed)
    got = {r["topic_id"]: r["item_id"] for r in found.collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4} | {100 + k: 100 + k for k in range(30)}
    states = [n for columns, n in steps if columns == ["node", "top", "state", "item_id"]]
    assert states == [6] * 4  # the first one and a round for each anchor; outcomes stand outside
    assert "Broadcast" not in plan_of(found).split("Initial Plan")[0]


def test_pending_items_are_found_out_once(spark):
    items = spark.range(30).select("id", F.concat(F.lit("app"), F.col("id") + 100).alias("name"))
    pending = governance.pending_apps(items, spark.createDataFrame([("App105 Wallet",), ("app11",)], "name string"))
    assert "Range" not in plan_of(pending)
    assert sorted(r["id"] for r in pending.collect()) == [k for k in range(30) if k != 5 and not 10 <= k < 20]


def test_fields_read_in_one_pass_equal_single_reads(spark):
    """Odd and damaged texts give what one read for each field gives."""
    from ledgerloom.operators import bronze

    texts = [None, "", "not json", "[]", '"a"', '{"a":null,"b":1}', '{"a":"x\\"y\\u00e9é","b":""}', '{"a":{"b":[1,2.50,1e5,"q"],"c":null},"b":[ ]}', '{"a":1', '{"a":1,"b":}', '{"a":1} more', '[{"a":1}]', '{"c":{"a":1},"b":-0.10}', "{'a':'single','b':true}", '{"A":1,"b":12345678901234567890.123}', '{"a":"{\\"b\\":1}"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = bronze._fields(df, "t", "a", "b").withColumns({f"own_{n}": F.get_json_object("t", f"$.{n}") for n in "ab"}).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["t_a"], r["t_b"]) == (r["own_a"], r["own_b"]), r["t"]


def test_events_are_extracted_in_one_pass_over_the_updates(spark):
    from ledgerloom.operators import bronze

    tx = '{"transaction":{"update_id":"u","events_by_id":{"e1":{"createdEvent":{"contractId":"c1"}},"e2":{"event_type":"exercised","contract_id":"c2"}}}}'
    moves = ['{"reassignment":{"update_id":"m1","event":{"created_event":{"event_id":"x","contract_id":"c3"}}}}', '{"update_id":"m2","event":{"archived_event":{"contract_id":"c4"}}}', '{"reassignment":{"update_id":"m3"}}', '{"transaction":{"update_id":"none"}}']
    df = spark.range(5).select(F.element_at(F.array(*[F.lit(t) for t in (tx, *moves)]), (F.col("id") + 1).cast("int")).alias("json"))
    found = bronze.normalize_event(bronze.extract_events(bronze.normalize_update(df)))
    assert plan_of(found).split("Initial Plan")[0].count("Range (") == 1
    assert sorted((r["event_id"], r["update_id"], r["event_type"], r["contract_id"]) for r in found.collect()) == [
        ("e1", "u", "created", "c1"), ("e2", "u", "exercised", "c2"), ("m2:reassign", "m2", "reassign_archive", "c4"), ("m3:reassign", "m3", "reassign_archive", None), ("x", "m1", "reassign_create", "c3"),
    ]


def test_a_batch_of_one_file_is_dealt_to_all_slots(spark, tmp_path):
    from ledgerloom.streaming import jobs

    spark.range(400).coalesce(1).select(F.format_string('{"transaction":{"update_id":"u%d","events_by_id":{"e%d":{}}}}', "id", "id").alias("json")).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_batch=3)
    jobs.start_normalize(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/events")).select("event_id").distinct().count() == 400
    assert len(list((tmp_path / "out/events/batch=0").glob("part-*"))) == spark.sparkContext.defaultParallelism > 1


def test_keys_of_a_stream_share_groups(spark, tmp_path):
    """Six thousand keys (and none) lie in at most 4096 groups of state, and each key's records are in order."""
    from ledgerloom.streaming import jobs

    rows = spark.range(18_000).selectExpr("nullif(concat('k', id % 6000), 'k7') as key", "0L as migration", "cast(null as long) as after", "2 - id div 6000 as place", "id div 6000 = 0 as closing", "cast(id as string) as record")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    ordered = jobs.ordered_migrations(jobs.stream_files(spark, str(tmp_path / "in"), rows.schema))
    query = ordered.writeStream.format("memory").queryName("shared_groups").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert 2000 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4096
    found = spark.table("shared_groups")
    assert found.count() == 18_000 and found.where("position <> place or cast(record as long) <> (2 - place) * 6000 + coalesce(cast(substring(key, 2) as long), 7)").count() == 0


def test_transform_verification_makes_texts_once(spark):
    """Dear columns of the raw frame are made once where the typed frame has their texts beside it; a lost row still shows."""
    raw = spark.range(60).select(F.col("id"), F.when(F.col("id") % 7 > 0, F.repeat(F.col("id").cast("string"), 3)).alias("text"))
    typed = raw.select("id", F.col("text").alias("raw_text"), F.when(F.col("id") % 10 > 0, F.col("text")).alias("text")).where("id <> 1")
    found = quality.transform_verification(raw, typed, ("text",), "raw_")
    assert {r["detail"]: r["affected"] for r in found.collect()} == {"row difference": 1, "parse loss: text": 5}
    assert plan_of(found).split("Initial Plan")[0].count("repeat(") == 1
