"""Ledger-shaped frames over the benchmark tables: the same rows that ``plans.oracles.LEDGER`` states in SQL.

Every benchmark event becomes a contract: a created event, an archived one for every third, an exercised one for every
fifth. Templates, choices and parties follow from the event's numbers; payloads are built as JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.schemas import TEMPLATES

#: Choices that exercised events take in turn.
CHOICES = (
    "AmuletRules_Transfer", "AmuletRules_BuyMemberTraffic", "DsoRules_CastVote", "Amulet_Lock", "AppRewardCoupon_Claim",
    "DsoRules_RequestVote", "Transfer", "OpenMiningRound_Advance", "AmuletRules_CreateTransferPreapproval",
    "AmuletRules_CreateExternalPartySetupProposal", "SubscriptionInitialPayment_Collect", "AnsEntryContext_CollectRenewalEntryPayment",
)
PACKAGE = "a1b2c3"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _say(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _text(expression: str) -> Column:
    return F.expr(f"cast({expression} as string)")


def _iso(expression: str) -> Column:
    return F.date_format(F.expr(expression), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _amount() -> Column:
    return F.expr("concat(cast(cents div 100 as string), '.', lpad(cast(cents % 100 as string), 2, '0'))")


def _payload() -> Column:
    u = _text("u")
    held = _say('{"initialAmount":"', _amount(), '","createdAt":{"number":"', _text("k"), '"},"ratePerRound":{"rate":"0.0', _text("k % 9"), '1"}}')
    plain = F.col("t").isin(2, 5)
    action = _say('{"tag":"ARC_DsoRules","value":{"tag":"CRARC_', _text("k % 4"), '","value":{"sv":"sv', _text("u % 7"), '"},"dsoAction":{"tag":"SRARC_', _text("k % 3"), '"}}}')
    vote = lambda sv, yes: _say('"sv', sv, '":{"accept":"', yes, '","reason":{"body":"b', _text("k"), '","url":"https://v/', _text("k % 10"), '"}}')
    votes = _say("{", vote(_text("u % 7"), "true"), ",", vote(_text("7 + k % 3"), F.when(F.expr("k % 2 = 0"), "true").otherwise("false")), "}")
    return _say(
        '{"dso":"dso","owner":"p', u, '","user":"p', u, '","provider":"p', _text("u % 20"), '","validator":"v', _text("u % 30"), '","sv":"sv', _text("u % 7"),
        '","beneficiary":"p', _text("(u + 1) % 50"), '","sponsor":"sv', _text("u % 5"), '","requester":"sv', _text("u % 7"), '","sender":"p', u,
        '","receiver":"p', _text("(u + 3) % 150"), '","receiverParty":"p', _text("(u + 3) % 150"), '","buyer":"p', u, '","memberId":"m', _text("u % 40"),
        '","synchronizerId":"sync', _text("u % 3"), '","domain":"sync', _text("u % 3"), '","name":"name', _text("id % 97"), '","url":"https://n/', _text("id % 97"),
        '","description":"d', _text("k"), '","weight":"', _text("1 + k % 5"), '.0","featured":"', F.when(F.expr("k % 2 = 0"), "true").otherwise("false"),
        '","nonce":"', _text("k"), '","nextNonce":"', _text("k + 1"), '","epoch":"', _text("k % 4"), '","migrationId":"', _text("m"), '","trackingCid":"c', _text("id - id % 2"),
        '","round":{"number":"', _text("k"), '"},"issuingFor":{"number":"', _text("k + 1"), '"},"amount":', F.when(plain, _say('"', _amount(), '"')).otherwise(held),
        ',"amuletPrice":"0.00', _text("1 + k % 9"), '","totalTrafficPurchased":"', _text("cents"), '","trafficAmount":"', _text("cents"), '","opensAt":"', _iso("ts"),
        '","targetClosesAt":"', _iso("ts + make_interval(0, 0, 0, 0, 0, 20)"), '","expiresAt":"', _iso("ts + make_interval(0, 0, 0, k % 5, 0, 0)"), '","voteBefore":"', _iso("ts + make_interval(0, 0, 0, k % 7, 0, 0)"),
        '","amulet":{"owner":"p', u, '","amount":', held, '},"lock":{"holders":["p', u, '","p', _text("(u + 2) % 150"), '"]',
        F.when(F.expr("k % 2 = 0"), _say(',"expiresAt":{"number":"', _text("k + 10"), '"}')).otherwise(""), '},"faucetState":{"tag":"FaucetState","value":{"numCouponsMissed":"', _text("k % 6"),
        '","firstReceivedFor":{"number":"', _text("k"), '"},"lastReceivedFor":{"number":"', _text("k + cents % 50"), '"}}},"metadata":{"version":"0.', _text("k % 5"),
        '","contactPoint":"mail', _text("u % 30"), '","lastUpdatedAt":"', _iso("ts"), '"},"activityRecord":{"trafficReceived":"', _text("cents"), '","lastActiveAt":"', _iso("ts"),
        '"},"issuanceConfig":{"amuletToIssuePerYear":"', _text("cents * 100"), '","validatorRewardPercentage":"0.05","appRewardPercentage":"0.15","svRewardPercentage":"0.8"},"transferConfigUsd":{"createFee":{"fee":"0.03"},"holdingFee":{"rate":"0.0000190259"},"transferFee":{"initialRate":"0.01"}}',
        ',"dsoDelegate":"sv', _text("u % 7"), '","config":{"numMemberTrafficContractsThreshold":"5","numUnclaimedRewardsThreshold":"10","actionConfirmationTimeout":"3600","svOnboardingRequestTimeout":"7200","voteRequestTimeout":"604800"}',
        ',"svs":{"sv0":{"name":"sv zero","weight":"', _text("k"), '","joinedAt":"', _iso("ts"), '","participantId":"part0"},"sv', _text("1 + k % 6"), '":{"name":"sv ', _text("1 + k % 6"),
        '","weight":"10","joinedAt":"', _iso("ts"), '","participantId":"part1"}},"confirmedBy":["sv0","sv', _text("1 + k % 6"), '"],"ranking":[{"sv":"sv', _text("u % 7"), '","rank":"1"},{"sv":"sv', _text("7 + u % 2"), '","rank":"2"}]',
        ',"state":{"synchronizerNodes":{"sync', _text("u % 3"), '":"node"}},"action":', action, ',"reason":{"url":"https://v/', _text("k % 10"), '","body":"proposal ', _text("k"), '"},"votes":', votes,
        ',"vote":{"accept":"', F.when(F.expr("k % 2 = 0"), "true").otherwise("false"), '","reason":{"body":"b', _text("k"), '"}},"transfer":{"sender":"p', u, '","receivers":[{"party":"p', _text("(u + 3) % 150"), '","amount":"', _amount(), '"}]}}',
    )


def _result() -> Column:
    return _say(
        '{"round":{"number":"', _text("k"), '"},"amuletPaid":"', _text("cents % 700"), '.5","summary":{"inputAmuletAmount":"', _amount(), '","outputAmuletAmount":"', _text("cents div 200"),
        '.25","holdingFees":"0.', _text("k % 10"), '","senderChangeFee":"0.0', _text("k % 10"), '","amuletPrice":"0.00', _text("1 + k % 9"), '","outputFees":["0.1","0.', _text("k % 10"), '"],"balanceChanges":[{"changeToInitialAmountAsOfRoundZero":"', _text("cents div 100"), '"}]},"amulet":"c', _text("id + 1"),
        '","transferResult":{"summary":{"holdingFees":"0.', _text("k % 7"), '","senderChangeFee":"0.0', _text("k % 3"), '","outputFees":["0.2","0.', _text("k % 5"), '"]}}}',
    )


def _transfers_below() -> Column:
    """Payments for names hold the next transfer of their update, initial ones and renewals in turn."""
    at = f"(id div 5) % {len(CHOICES)}"
    turn = f"(id div {5 * len(CHOICES)}) % 2"
    initial, renewal = CHOICES.index("SubscriptionInitialPayment_Collect"), CHOICES.index("AnsEntryContext_CollectRenewalEntryPayment")
    return F.expr(
        f"case when {at} = {initial} and {turn} = 0 then array(concat('e', cast(id + 10 as string), ':2'))"
        f" when {at} = {renewal} and {turn} = 1 then array(concat('e', cast(id + 5 as string), ':2')) else cast(array() as array<string>) end"
    )


def _pick(names: tuple[str, ...], at: str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.expr(f"cast({at} as int) + 1"))


def ledger_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per benchmark event with the numbers that its contract derives from."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_id").cast("long").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("long").alias("u"),
        F.expr("cast(abs(round(value * 100)) as bigint)").alias("cents"),
        F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"),
        F.col("event_type").alias("kind"),
        F.expr(f"cast(event_id % {len(TEMPLATES)} as int)").alias("t"),
        F.expr("case when ts < timestamp '2024-01-16 00:00:00' then 0L else 1L end").alias("m"),
    )


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed events (bronze): created, archived and exercised rows of every contract."""
    base = ledger_base(spark, sf_dir)
    # the kinds of events a contract has: 0 created, 1 archived, 2 exercised
    ordinals = F.filter(F.array(F.lit(0), F.when(F.expr("id % 3 = 0"), 1), F.when(F.expr("id % 5 = 0"), 2)), lambda x: x.isNotNull())
    rows = base.withColumn("n", F.explode(ordinals))
    kind = F.when(F.col("n") == 0, "created").when(F.col("n") == 1, "archived").otherwise("exercised")
    at = F.expr("case when n = 1 then ts + make_interval(0, 0, 0, 0, 0, k + 1) else ts end")
    exercised = F.col("n") == 2
    return rows.select(
        _say("e", _text("id"), ":", _text("n")).alias("event_id"),
        _say("u", _text("id div 15")).alias("update_id"),
        _say("c", _text("id")).alias("contract_id"),
        kind.alias("event_type"),
        _say(PACKAGE + ":", _pick(TEMPLATES, "t")).alias("template_id"),
        F.when(exercised, _pick(CHOICES, f"(id div 5) % {len(CHOICES)}")).alias("choice"),
        F.when(exercised, F.expr("id % 2 = 0")).alias("consuming"),
        F.when(exercised & F.expr("id % 4 = 0"), "iface:Splice.Api:Holding").alias("interface_id"),
        at.alias("effective_at"),
        (at + F.expr("make_interval(0, 0, 0, 0, 0, 1)")).alias("recorded_at"),
        F.to_date(at).alias("event_date"),
        F.col("m").alias("migration_id"),
        _say("sync", _text("u % 3")).alias("synchronizer_id"),
        F.array(_say("p", _text("u")), F.lit("dso")).alias("signatories"),
        F.when(F.expr("k % 2 = 0"), F.array(_say("p", _text("(u + 1) % 50")))).otherwise(F.array().cast("array<string>")).alias("observers"),
        F.when(exercised, F.array(_say("p", _text("u")))).otherwise(F.array().cast("array<string>")).alias("acting_parties"),
        F.when(exercised, F.concat(F.expr("transform(sequence(1, cast(1 + k % 3 as int)), x -> concat('e', cast(id + x as string), ':0'))"), _transfers_below())).otherwise(F.array().cast("array<string>")).alias("child_event_ids"),
        F.when(F.col("n") == 1, F.lit("{}")).otherwise(_payload()).alias("payload"),
        F.when(exercised, _result()).alias("exercise_result"),
    )


def ledger_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed updates (bronze): one per fifteen benchmark events; every seventh is a reassignment."""
    base = ledger_base(spark, sf_dir).withColumn("up", F.expr("id div 15"))
    size = F.expr("1 + cast(id % 3 = 0 as int) + cast(id % 5 = 0 as int)")
    grouped = base.groupBy("up").agg(F.min("ts").alias("ts"), F.max("m").alias("m"), F.min("u").alias("u"), F.sum(size).alias("events"))
    moved = F.expr("up % 7 = 0")
    return grouped.select(
        _say("u", _text("up")).alias("update_id"),
        F.when(moved, "reassignment").otherwise("transaction").alias("update_type"),
        F.col("m").alias("migration_id"),
        _say("sync", _text("u % 3")).alias("synchronizer_id"),
        F.col("ts").alias("effective_at"),
        (F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, 1)")).alias("record_time"),
        F.to_date("ts").alias("record_date"),
        F.col("up").alias("offset"),
        # every eleventh update declares one event too many
        F.expr("cast(events + case when up % 11 = 0 then 1 else 0 end as bigint)").alias("event_count"),
        F.when(moved, _say("sync", _text("(u + 1) % 3"))).alias("source_synchronizer"),
        F.when(moved, _say("sync", _text("u % 3"))).alias("target_synchronizer"),
        F.when(moved, F.col("up")).alias("reassignment_counter"),
        _say('{"traceId":"t', _text("up"), '","spanId":"s', _text("up % 100"), '"}').alias("trace_context"),
    )


def ledger_acs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active-contract snapshots: per migration one at the end of each tenth day, of the contracts created by then and
    not archived; the first snapshot of a migration has no completion marker (``complete`` false)."""
    base = ledger_base(spark, sf_dir).withColumn("snapshot_time", F.explode(F.expr("array(timestamp '2024-01-11 00:00:00', timestamp '2024-01-21 00:00:00', timestamp '2024-01-31 00:00:00')")))
    alive = F.expr("ts < snapshot_time and not (id % 3 = 0 and ts + make_interval(0, 0, 0, 0, 0, k + 1) < snapshot_time)")
    return base.where(alive).select(
        _say("c", _text("id")).alias("contract_id"),
        _say(PACKAGE + ":", _pick(TEMPLATES, "t")).alias("template_id"),
        F.col("m").alias("migration_id"),
        F.col("ts").alias("record_time"),
        "snapshot_time",
        F.array(_say("p", _text("u")), F.lit("dso")).alias("signatories"),
        _payload().alias("payload"),
        (F.col("snapshot_time") > F.expr("timestamp '2024-01-11 00:00:00'")).alias("complete"),
    )


def candles(spark: SparkSession, sf_dir: str, minutes: int = 5) -> DataFrame:
    """Price candles: benchmark events by type (the pair) and time slice; trades count, cents are the price."""
    rows = ledger_base(spark, sf_dir).select("kind", "id", "cents", "k", F.expr(f"timestamp_micros((unix_micros(ts) div {minutes * 60_000_000}) * {minutes * 60_000_000})").alias("at"))
    price = F.col("cents") / 100.0
    order = F.struct("id", "cents")
    return rows.groupBy(F.col("kind").alias("pair"), F.col("at").alias("ts")).agg(
        (F.min(order)["cents"] / 100.0).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), (F.max(order)["cents"] / 100.0).alias("close"),
        F.sum("k").cast("double").alias("volume"), F.count("*").alias("count"),
    )


def round_party_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative app rewards by party and closed round."""
    from pyspark.sql import Window

    own = ledger_base(spark, sf_dir).groupBy(_say("p", _text("u")).alias("party"), F.col("k").alias("closed_round")).agg(F.sum("cents").alias("cents"))
    upto = F.sum("cents").over(Window.partitionBy("party").orderBy("closed_round"))
    return own.select("party", "closed_round", (upto / 100.0).alias("cumulative_app_rewards"))


def round_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per closed round its last event's time and the change of supply (positive: minted)."""
    return ledger_base(spark, sf_dir).groupBy(F.col("k").alias("closed_round")).agg(F.max("ts").alias("closed_round_effective_at"), (F.sum(F.expr("case when id % 4 = 0 then -cents else cents end")) / 100.0).alias("change_to_initial_amount"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers: purchases and clicks; those of k below 5 move nothing."""
    rows = ledger_base(spark, sf_dir).where("kind in ('purchase', 'click')")
    amount = F.expr("case when k < 5 then 0.0 else cents / 100.0 end").cast("double")
    return rows.select(F.to_date("ts").alias("date"), _say("p", _text("u")).alias("sender"), F.array(F.struct(_say("p", _text("(u + 3) % 150")).alias("party"), amount.alias("amount"))).alias("receivers"))


#: A made-up word of nine letters for any value; the texts of both engines' SQL are the same.
WORD = "translate(substr(md5(cast({} as string)), 1, 9), '0123456789', 'ghjkpqruvw')"


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governance topics over ``documents``: the body ends with the document's whole text; subject, date and stage follow
    from the id. Names are made of words whose number grows with the table; some differ by a letter or a second word."""
    docs = table(spark, sf_dir, "documents").withColumn("n", F.expr("cast(doc_id % 50 as string)"))
    docs = docs.withColumn("w", F.expr(WORD.format("doc_id div 40"))).withColumn("x", F.expr(WORD.format("doc_id div 300")))
    return docs.select(
        F.col("doc_id").cast("long").alias("topic_id"),
        F.expr(
            "case doc_id % 5 when 0 then concat('CIP-', lpad(cast(doc_id div 50 as string), 4, '0'), ' Discussion: change ', cast(doc_id % 13 as string))"
            " when 1 then concat('Featured App Request: App', case (doc_id div 5) % 4 when 1 then concat(left(w, 4), substr(w, 6)) when 2 then concat(w, ' Wallet') else w end)"
            " when 2 then concat('Validator Approved: Node', w, ' Ltd')"
            " when 3 then concat('Vote Proposal: set fee to ', cast(doc_id % 9 as string), ' on TestNet') else element_at(array("
            "concat('Weekly notes ', n), concat('Re: [Acme', x, '] update'), concat('Swap', x, ' Featured App Tokenomics'), 'Validators Approved: A1, B2 and C3',"
            " concat('Request to Feature the Wallet', x, ' by Corp'), 'Node as a Service approved', concat('MainNet: Swap', x, ' by Trade Co'), concat('Tokenomics Outcomes week ', n),"
            " concat('Splice 0.', n, ' upgrade notes'), concat('Vote Proposal: Validator onboarding for Bolt', x, ' - Vote'), concat('CIP TBD discuss new fee ', n), concat('Fwd: grant for Nova', x)"
            "), cast((doc_id div 5) % 12 as int) + 1) end"
        ).alias("subject"),
        F.concat(F.lit("see https://forum/t/"), F.col("doc_id").cast("string"), F.lit(" and https://v/"), (F.col("doc_id") % 10).cast("string"), F.lit(" in "), F.coalesce("lang", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("body"),
        F.expr("date_add(date '2024-01-01', cast(doc_id % 300 as int))").alias("date"),
        F.expr("element_at(array('cip-discuss', 'cip-vote', 'cip-announce', 'sv-announce', 'tokenomics', 'tokenomics-announce'), cast((doc_id div 5) % 6 as int) + 1)").alias("stage"),
        F.col("source"),
    )
