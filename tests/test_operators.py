"""Operators on small literal frames, null and malformed cases included."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators import bronze, governance, lifecycle, metrics, quality, views

NOW = dt.datetime(2024, 2, 1)
EVENT = "event_id string, update_id string, contract_id string, event_type string, template_id string, choice string, consuming boolean, effective_at timestamp, migration_id long, payload string, exercise_result string"


def event(n, kind="created", template="p:Splice.Amulet:Amulet", at=dt.datetime(2024, 1, 1), payload="{}", contract=None, choice=None, result=None):
    return (f"e{n}", f"u{n}", contract or f"c{n}", kind, template, choice, None, at, 0, payload, result)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


def test_bad_values_become_null_and_rows_stay(spark):
    rows = [("e1", "2024-01-01T00:00:00.123456Z", '{"a":1}'), ("e2", "yesterday", "{broken"), ("e3", None, None)]
    typed = bronze.parse_events(spark.createDataFrame(rows, "event_id string, effective_at string, payload string")).orderBy("event_id").collect()
    assert len(typed) == 3
    assert typed[0]["effective_at"].microsecond == 123456
    assert typed[1]["effective_at"] is None and typed[1]["payload"] is None


def test_template_forms(spark):
    rows = [("abc:Splice.Amulet:Amulet",), ("Splice.Amulet:Amulet",), ("abc:Splice:Amulet:Amulet",), ("0123456789ab_Splice_Amulet_Amulet",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r["k"] for r in df.select(C.template_key(F.col("t")).alias("k")).collect()]
    assert got[:4] == ["Splice.Amulet:Amulet"] * 4
    forms = [r["f"] for r in df.select(C.template_format(F.col("t")).alias("f")).collect()]
    assert forms == ["package", "plain", "colons", "underscore", "unknown", "unknown"]


def test_locked_token_is_no_token(spark):
    rows = events(spark, event(1), event(2, template="p:Splice.Amulet:LockedAmulet"), event(3, template="p:X:NotAmulet"))
    assert [r["event_id"] for r in views.template_view(rows, "amulet").collect()] == ["e1"]


@pytest.mark.parametrize(("text", "value"), [("12.5", 12.5), ("1e3", None), ("abc", None), ("", None), (None, None), ("-3", -3.0)])
def test_money_is_strict(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(C.money(F.col("t")).cast("double").alias("m")).first()["m"]
    assert got == value


def test_amount_falls_back_in_order(spark):
    df = spark.createDataFrame([('{"amount":"7"}',), ('{"amount":{"initialAmount":"3"}}',), ('{"amount":{"initialAmount":"x"},"initialAmount":"4"}',), ("{}",)], "p string")
    assert [r["a"] for r in df.select(C.pick_amount(F.col("p")).cast("double").alias("a")).collect()] == [7.0, 3.0, 4.0, None]


def test_text_weight_is_a_whole_number(spark):
    rows = events(spark, event(1, template="p:Splice.Amulet:SvRewardCoupon", payload='{"sv":"a","round":{"number":"5"},"weight":"1.0"}'))
    assert views.template_view(rows, "sv_reward_coupon").first()["sv_weight"] == 1


def test_contract_archived_twice_is_one_row(spark):
    late = dt.datetime(2024, 1, 3)
    rows = events(spark, event(1), event(2, "archived", contract="c1", at=late), event(3, "archived", contract="c1", at=dt.datetime(2024, 1, 2)), event(4))
    got = {r["contract_id"]: r for r in lifecycle.amulet_lifecycle(rows, F.lit(NOW)).collect()}
    assert len(got) == 2
    assert got["c1"]["lifespan_seconds"] == 86400 and got["c1"]["status"] == "archived"
    assert got["c4"]["status"] == "active" and got["c4"]["lifespan_seconds"] == 31 * 86400


def test_votes_of_parties_with_colons(spark):
    payload = '{"requester":"a","votes":{"sv::1":{"accept":"true","reason":{"body":"b"}},"sv::2":{"accept":"no"}}}'
    rows = events(spark, event(1, template="p:Splice.DsoRules:VoteRequest", payload=payload))
    got = {r["voter"]: r["vote_accepted"] for r in views.template_view(rows, "votes").collect()}
    assert got == {"sv::1": True, "sv::2": False}
    assert views.template_view(rows, "vote_request").first()["vote_count"] == 2


def test_tree_order_cycles_and_orphans(spark):
    rows = [Row(update_id="u", event_id=e, root_event_ids=["a"], child_event_ids=c) for e, c in (("a", ["b", "c"]), ("b", ["d"]), ("c", []), ("d", ["a"]), ("y", ["z"]), ("z", []), ("x", []))]
    got = {r["event_id"]: r["ordinal"] for r in bronze.tree_order(spark.createDataFrame(rows, "update_id string, event_id string, root_event_ids array<string>, child_event_ids array<string>")).collect()}
    assert sorted(got, key=got.get) == ["a", "b", "d", "c", "x", "y", "z"]


def test_normalize_wrapped_bare_and_unknown_updates(spark):
    rows = [('{"transaction":{"update_id":"u1","record_time":"2024-01-01T00:00:00Z","events_by_id":{"u1:0":{"created_event":{"event_id":"u1:0","template_id":"h:M:E","created_at":"2024-01-01T00:00:05Z"}}}}}',), ('{"update_id":"u2","events_by_id":{}}',), ('{"reassignment":{"update_id":"u3","counter":"2","event":{"archived_event":{"event_id":"u3:0"}}}}',), ('{"noise":1}',), ("not json",)]
    known, bad = bronze.split_unknown(bronze.normalize_update(spark.createDataFrame(rows, "json string")))
    got = {r["update_id"]: r for r in known.collect()}
    assert set(got) == {"u1", "u2", "u3"} and bad.count() == 2
    out = {r["event_id"]: r for r in bronze.normalize_event(bronze.extract_events(known)).collect()}
    assert out["u1:0"]["effective_at"] == dt.datetime(2024, 1, 1, 0, 0, 5) and out["u1:0"]["package_name"] == "h"
    assert out["u3:0"]["event_type"] == "reassign_archive"


@pytest.mark.parametrize(("text"), ["2024-01-01T00:00:00Z", "1704067200", "1704067200000", "1704067200000000", '{"microsecondsSinceEpoch":"1704067200000000"}', '{"seconds":1704067200,"nanos":0}', '{"unixtime":"1704067200"}'])
def test_time_encodings(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(C.normal_time(F.col("t")).alias("x")).first()["x"] == dt.datetime(2024, 1, 1)


def test_time_that_is_none(spark):
    assert spark.createDataFrame([("soon",)], "t string").select(C.normal_time(F.col("t")).alias("x")).first()["x"] is None


def test_usage_series_counts_moving_transfers_only(spark):
    rows = [(dt.date(2024, 1, 1), "a", [("b", 1.0)]), (dt.date(2024, 1, 1), "c", [("b", 0.0)]), (dt.date(2024, 1, 3), "a", [("b", 1.0)]), (dt.date(2024, 1, 3), "d", [("b", 1.0)])]
    df = spark.createDataFrame(rows, "date date, sender string, receivers array<struct<party:string,amount:double>>")
    got = metrics.usage_series(df, "2024-01-01", "2024-01-04").orderBy("date").collect()
    assert [r["cumulative_parties"] for r in got] == [1, 1, 2, 2]
    assert [r["users"] for r in got] == [1, 0, 2, 0]


def test_reward_fallback_and_its_source(spark):
    rows = [("e1", "a", "app", 1, 5.0, None), ("e2", "b", "sv", 1, None, 4), ("e3", "b", "sv", 2, None, 4)]
    df = spark.createDataFrame(rows, "event_id string, recipient_party string, reward_type string, round_number long, reward_amount double, sv_weight long").withColumn("event_type", F.lit("created")).withColumn("effective_at", F.lit(NOW))
    rates = spark.createDataFrame([(1, "sv", 2.5)], "round_number long, reward_type string, rate double")
    got = {r["event_id"]: (r["amount"], r["amount_source"]) for r in metrics.reward_calculation(df, rates).collect()}
    assert got == {"e1": (5.0, "direct"), "e2": (10.0, "issuance"), "e3": (4.0, "weight")}


def test_lock_tiers(spark):
    rows = [("a", 70.0, 100.0, 10), ("b", 45.0, 100.0, 10), ("c", 35.0, 100.0, 10), ("d", 1.0, 100.0, 10), ("e", 1.0, 0.0, 10)]
    got = {r["party"]: r["effective_weight"] for r in metrics.sv_lock_tiers(spark.createDataFrame(rows, "party string, locked double, earned double, weight long")).collect()}
    assert got == {"a": 10, "b": 6, "c": 4, "d": 0, "e": 0}


def test_gaps_ignore_covered_ranges(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("s", t(0), t(30)), ("s", t(5), t(6)), ("s", t(31), t(32)), ("s", t(50), t(51))]
    got = quality.time_gaps(spark.createDataFrame(rows, "k string, start timestamp, end timestamp"), "k", 120).collect()
    assert [(r["gap_start"], r["gap_ms"]) for r in got] == [(t(32), 18 * 60_000)]


def test_dedup_is_idempotent_and_both_forms_agree(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, None), ("c", 1, None)]
    df = spark.createDataFrame(rows, "id string, at int, v string")
    once = quality.dedup_latest(df, "id", "at").select(*df.columns)
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert key(once) == key(quality.dedup_latest(once, "id", "at").select(*df.columns)) == key(quality.dedup_two_pass(df, "id", "at")) == [("a", 2, "y"), ("b", 1, "z"), ("c", 1, None)]


def test_schema_diff(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "a long, b string, d double")
    got = {r["column"]: r["state"] for r in quality.schema_diff(spark.createDataFrame([], "a long, b long, c string").schema, df).collect()}
    assert got == {"a": "match", "b": "type", "c": "missing", "d": "extra"}


def test_entity_matching_equals_all_pairs(spark):
    names = ["Figment", "Figmint Inc", "Five North", "FiveNorth", "Digital Harbor", "Digital Harbors Ltd", "Obsidian", "Obsidian Systems", "Cumberland", "Cumbrland", "SBI", "Sbl", ""]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {(r["left_id"], r["right_id"]) for r in governance.match_entities(df, df).collect()}
    norm = [r["n"] for r in df.orderBy("id").select(governance.normal_name(F.col("name")).alias("n")).collect()]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    want = set()
    for i, a in enumerate(norm):
        for j, b in enumerate(norm):
            long, short = max(len(a), len(b)), min(len(a), len(b))
            if a and b and (a in b or b in a or a.replace(" ", "") == b.replace(" ", "") or (short >= 0.7 * long and distance(a, b) <= max(2, int(0.2 * long)))):
                want.add((i, j))
    assert got == want


def test_identifiers(spark):
    rows = [(1, "CIP-42: fees on MainNet", "cip-discuss"), (2, "cip 0007 vote", "cip-vote"), (3, "Featured App Request: Wallet by X", "sv-announce"), (4, None, "tokenomics")]
    df = spark.createDataFrame(rows, "topic_id long, subject string, stage string")
    got = {r["topic_id"]: r for r in governance.classify_topic(governance.extract_identifiers(df)).collect()}
    assert got[1]["cip"] == "0042" and got[1]["network"] == "mainnet" and got[2]["cip"] == "0007"
    assert got[3]["entity"] == "Wallet" and got[3]["topic_type"] == "featured-app" and got[4]["topic_type"] == "featured-app"


def test_names_and_types_of_subjects(spark):
    """One subject for each pattern: flow, name, several names, CIP number, type."""
    rows = [
        ("Validator Operators Approved: Ann, Bob and Cy", "tokenomics-announce", None, True, None, "validator"),
        ("Validator Approved: Ann, Bob", "sv-announce", None, True, None, "validator"),
        ("Node as a Service reviewed and approved", "sv-announce", "Node as a Service", False, None, "validator"),
        ("Re: Validator Operator Approved - Blue Node", "cip-vote", "Blue Node", False, None, "validator"),
        ("Featured App Approved: Swapper", "tokenomics-announce", "Swapper", False, None, "featured-app"),
        ("Proposal to feature the Big Wallet", "tokenomics", "Big Wallet", False, None, "featured-app"),
        ("Apply featured application status for Zed9", "cip-vote", "Zed9", False, None, "featured-app"),
        ("TestNet: Lender by Loan Co", "cip-vote", "Lender", False, None, "other"),
        ("New Featured App Request: MainNet: Lender by Loan Co", "sv-announce", "Lender", False, None, "featured-app"),
        ("Rocket Super Validator", "tokenomics", "Rocket", False, None, "validator"),
        ("[Kilo] hello", "tokenomics", "Kilo", False, None, "featured-app"),
        ("hello from Grand Central today", "cip-discuss", "Grand Central", False, None, "other"),
        ("money for Nova7", "cip-discuss", "Nova7", False, None, "other"),
        ("about Vote Proposal", "cip-discuss", None, False, None, "other"),
        ("Vote Proposal on CIP 12345", "tokenomics", "on CIP 12345", False, "12345", "cip"),
        ("0031 on fees", "cip-discuss", None, False, "0031", "cip"),
        ("CIP-TBD fees", "tokenomics", None, False, "00XX", "cip"),
        ("Tokenomics Outcomes of May", "cip-vote", "Outcomes of May", False, None, "outcome"),
        ("Hard fork in June", "cip-vote", None, False, None, "protocol-upgrade"),
        ("", "cip-vote", None, False, None, "other"),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "topic_id long, subject string, stage string")
    got = governance.classify_topic(governance.extract_identifiers(df)).orderBy("topic_id").collect()
    assert [(r["subject"], r["stage"], r["entity"], r["many_entities"], r["cip"], r["topic_type"]) for r in got] == rows


def test_as_of_join(spark):
    totals = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 50.0), ("b", 2, 7.0)], "party string, closed_round long, cumulative_app_rewards double")
    asks = spark.createDataFrame([("a", 4), ("b", 1), ("c", 3)], "party string, round long")
    got = {r["party"]: r["rewards_at_approval"] for r in lifecycle.as_of_rewards(asks, totals).collect()}
    assert got == {"a": 10.0, "b": 0.0, "c": 0.0}


def test_burn_by_hand(spark):
    """Every kind of burn, with a payment for a name that holds a transfer; amounts added up by hand."""
    day = dt.date(2024, 1, 1)
    kind = "event_id string, update_id string, contract_id string, event_type string, template_id string, choice string, event_date date, payload string, exercise_result string, child_event_ids array<string>"
    made = lambda i, u, c, payload: (i, u, c, "created", "p:Splice.Amulet:Amulet", None, day, payload, None, [])
    used = lambda i, u, choice, result, below=(): (i, u, "x" + i, "exercised", "p:a:b", choice, day, "{}", result, list(below))
    moved = '{"summary":{"holdingFees":"0.5","senderChangeFee":"0.25","outputFees":["0.1","0.2"]}}'
    rows = [
        used("1", "a", "AmuletRules_BuyMemberTraffic", '{"amuletPaid":"10","summary":{"holdingFees":"1","senderChangeFee":"2","outputFees":["9"]}}'),
        used("2", "b", "AmuletRules_Transfer", moved),
        used("3", "b", "Transfer", moved),
        used("4", "c", "SubscriptionInitialPayment_Collect", '{"amulet":"t"}', ["5", "6"]),
        used("5", "c", "AmuletRules_Transfer", moved),
        made("6", "c", "t", '{"amount":{"initialAmount":"7.5"}}'),
        made("7", "d", "s", '{"amount":{"initialAmount":"100"}}'),
        used("8", "e", "AnsEntryContext_CollectRenewalEntryPayment", '{"amulet":"s"}'),
        used("9", "f", "AmuletRules_CreateExternalPartySetupProposal", '{"amuletPaid":"3","transferResult":' + moved + "}"),
        used("10", "f", "TransferPreapproval_Renew", moved),
        used("11", "g", "AmuletRules_BuyMemberTraffic", None),
    ]
    got = {r["update_id"]: [round(r[c], 6) for c in ("traffic", "transfer", "names", "preapproval", "total")] for r in metrics.burn_by_transaction(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"a": [13, 0, 0, 0, 13], "b": [0, 1.05, 0, 0, 1.05], "c": [0, 1.05, 8.55, 0, 9.6], "e": [0, 0, 0, 0, 0], "f": [0, 0, 0, 4.05, 4.05], "g": [0, 0, 0, 0, 0]}


def test_proposal_status(spark):
    """Passed at the threshold; expired when closed or past voteBefore without a vote; failed else, open ones too."""
    vote = lambda **v: "{" + ",".join(f'"{k}":{{"accept":"{x}"}}' for k, x in v.items()) + "}"
    ask = lambda n, votes, before: event(n, template="p:Splice.DsoRules:VoteRequest", payload=f'{{"votes":{votes},"voteBefore":"{before}","expiresAt":"2000-01-01T00:00:00Z"}}')
    rows = [
        ask(1, vote(a="true", b="true"), "2024-03-01T00:00:00Z"),
        ask(2, vote(a="true"), "2024-03-01T00:00:00Z"),
        ask(3, "{}", "2024-03-01T00:00:00Z"),
        ask(4, "{}", "2024-01-15T00:00:00Z"),
        ask(5, vote(a="false"), "2024-01-15T00:00:00Z"),
        ask(6, "{}", "2024-03-01T00:00:00Z"),
        event(7, kind="archived", template="p:Splice.DsoRules:VoteRequest", contract="c6"),
    ]
    got = {r["contract_id"]: r["status"] for r in lifecycle.unique_proposals(events(spark, *rows), F.lit(NOW), threshold=2).collect()}
    assert got == {"c1": "passed", "c2": "failed", "c3": "failed", "c4": "expired", "c5": "failed", "c6": "expired"}
