"""Aggregates: activity, rewards, supply, usage, market and network metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import action_tag, is_template, json_text, money, pick_amount, pick_locked_amount, pick_owner
from ledgerloom.operators.views import template_view
from ledgerloom.sources.scratch import cut, dealt


def _if(condition: str | Column, value: Column | None = None) -> Column:
    """Sum of value (or count of rows) where the condition holds; 0 where it never does."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return F.count_if(condition) if value is None else F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def updates_summary(updates: DataFrame) -> DataFrame:
    return updates.groupBy("record_date", "update_type", "migration_id").agg(F.count("*").alias("update_count"), F.sum("event_count").alias("total_events"), F.min("record_time").alias("first_record"), F.max("record_time").alias("last_record"))


def daily_activity(updates: DataFrame) -> DataFrame:
    return updates.groupBy("record_date").agg(F.count_distinct("update_id").alias("transactions"), F.sum("event_count").alias("events"), F.count_distinct("synchronizer_id").alias("synchronizers"))


def governance_action_summary(events: DataFrame) -> DataFrame:
    p = F.col("payload")
    rows = events.where(is_template(F.col("template_id"), "VoteRequest")).select("event_date", "event_type", json_text(p, "action.tag").alias("action_category"), action_tag(p).alias("action_type"), json_text(p, "requester").alias("requester"))
    return rows.groupBy("event_date", "action_category", "action_type", "event_type").agg(F.count("*").alias("actions"), F.count_distinct("requester").alias("requesters"))


def rewards_by_round_long(rewards: DataFrame) -> DataFrame:
    return rewards.groupBy("round_number", "reward_type", "event_type").agg(F.count("*").alias("coupons"), F.count_distinct("recipient_party").alias("recipients"), F.sum("reward_amount").alias("amount"), _if("is_featured").alias("featured"))


def rewards_by_recipient(rewards: DataFrame) -> DataFrame:
    return rewards.where("event_type = 'created'").groupBy("recipient_party", "reward_type").agg(
        F.count("*").alias("coupons"), F.sum("reward_amount").alias("amount"), F.count_distinct("round_number").alias("active_rounds"), F.min("round_number").alias("first_round"), F.max("round_number").alias("last_round")
    )


def app_provider_leaderboard(rewards: DataFrame) -> DataFrame:
    return rewards.where("reward_type = 'app' and event_type = 'created'").groupBy(F.col("recipient_party").alias("provider_party")).agg(
        F.count("*").alias("coupons"), F.sum("reward_amount").alias("amount"), _if("is_featured").alias("featured"), F.min("effective_at").alias("first_reward"), F.max("effective_at").alias("last_reward")
    )


def validator_reward_performance(rewards: DataFrame) -> DataFrame:
    return rewards.where("reward_type = 'validator' and event_type = 'created'").groupBy(F.col("recipient_party").alias("validator_party"), "user_party").agg(
        F.count("*").alias("coupons"), F.count_distinct("round_number").alias("rounds"), F.min("round_number").alias("first_round"), F.max("round_number").alias("last_round")
    )


def supply_over_time(events: DataFrame) -> DataFrame:
    amount = money(json_text(F.col("payload"), "amount.initialAmount"))
    rows = events.where(is_template(F.col("template_id"), "Amulet"))
    return rows.groupBy("event_date").agg(F.sum(F.when(F.col("event_type") == "created", amount)).alias("minted"), _if("event_type = 'created'").alias("contracts_created"), _if("event_type = 'archived'").alias("contracts_archived"))


def daily_supply_metrics(events: DataFrame) -> DataFrame:
    p, made = F.col("payload"), F.col("event_type") == "created"
    rows = events.where(is_template(F.col("template_id"), "Amulet"))
    number = json_text(p, "amount.createdAt.number").try_cast("long")
    return rows.groupBy(F.col("event_date").alias("supply_date"), "migration_id").agg(
        _if(made).alias("amulets_created"), _if("event_type = 'archived'").alias("amulets_archived"), F.sum(F.when(made, money(json_text(p, "amount.initialAmount")))).alias("minted"),
        F.count_distinct(F.when(made, json_text(p, "owner"))).alias("recipients"), F.min(number).alias("min_round"), F.max(number).alias("max_round"),
    )


def rewards_by_round(rewards: DataFrame) -> DataFrame:
    """One row per round, its date that of the earliest coupon."""
    made = rewards.where("event_type = 'created'")
    kinds = ("app", "sv", "validator")
    metrics = [_if(f"reward_type = '{k}'").alias(f"{k}_coupons") for k in kinds]
    metrics += [F.count_distinct(F.when(F.col("reward_type") == k, F.col("recipient_party"))).alias(f"{k}_recipients") for k in kinds]
    return made.groupBy("round_number").agg(
        F.min("event_date").alias("round_date"), F.count("*").alias("coupons"), *metrics, F.sum(F.when(F.col("reward_type") == "app", F.col("reward_amount"))).alias("app_amount"),
        _if("is_featured").alias("featured"), F.sum("sv_weight").alias("sv_weight"),
    )


def reward_leaderboard(rewards: DataFrame) -> DataFrame:
    return rewards.where("event_type = 'created'").groupBy("recipient_party", "reward_type").agg(
        F.count_distinct("contract_id").alias("coupons"), F.sum("reward_amount").alias("amount"), F.avg(F.coalesce("reward_amount", F.lit(0))).alias("average"), F.count_distinct("round_number").alias("rounds"),
        F.min("round_number").alias("first_round"), F.max("round_number").alias("last_round"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"), F.count_distinct("event_date").alias("days"),
    )


def validator_performance(lifecycle: DataFrame) -> DataFrame:
    """Rewards per round of a licence's validator; 0 where no round passed."""
    span = F.col("last_reward_round") - F.col("first_reward_round") + 1
    return lifecycle.select("contract_id", "validator_party", "status", "reward_count", span.alias("round_span"), F.when(span > 0, F.col("reward_count") / span).otherwise(0.0).alias("rewards_per_round"))


def daily_network_metrics(events: DataFrame) -> DataFrame:
    is_ = lambda e: is_template(F.col("template_id"), e) & (F.col("event_type") == "created")
    any_ = [is_template(F.col("template_id"), e) for e in ("OpenMiningRound", "ClosedMiningRound", "MemberTraffic", "AnsEntry", "AmuletPriceVote")]
    rows = events.where(any_[0] | any_[1] | any_[2] | any_[3] | any_[4])
    return rows.groupBy("event_date").agg(
        _if(is_("OpenMiningRound")).alias("rounds_opened"), _if(is_("ClosedMiningRound")).alias("rounds_closed"), _if(is_("MemberTraffic")).alias("traffic_contracts"),
        F.count_distinct(F.when(is_("MemberTraffic"), json_text(F.col("payload"), "memberId"))).alias("traffic_members"), _if(is_("AnsEntry")).alias("ans_entries"), _if(is_("AmuletPriceVote")).alias("price_votes"),
    )


def choice_frequency(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'exercised'").groupBy("choice", "template_id", "consuming").agg(F.count("*").alias("exercises"), F.min("effective_at").alias("first_seen"), F.max("effective_at").alias("last_seen"))


def daily_choice_stats(events: DataFrame) -> DataFrame:
    children = F.size("child_event_ids")
    return events.where("event_type = 'exercised'").groupBy("event_date", "choice").agg(
        F.count("*").alias("exercises"), _if("consuming").alias("consuming"), F.count_distinct("contract_id").alias("contracts"), F.count_distinct("update_id").alias("updates"),
        F.sum(children).alias("child_events"), F.avg(children).alias("child_events_mean"),
    )


def template_choice_map(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'exercised'").groupBy("template_id", "choice").agg(F.count("*").alias("exercises"), _if("consuming").alias("consuming"), F.count_distinct("event_date").alias("active_days"))


def event_type_counts(events: DataFrame, after: Column, upto: Column) -> DataFrame:
    """Delta of an incremental aggregate and the running total with it: rows recorded in (after, upto], and all to upto."""
    at = F.col("recorded_at")
    return events.where(at <= upto).groupBy("event_type").agg(_if(at > after).alias("delta"), F.count("*").alias("total"))


def template_event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("template_id", "event_type").agg(F.count("*").alias("events"))


def total_counts(events: DataFrame, updates: DataFrame) -> DataFrame:
    e = events.agg(F.count("*").alias("events"), F.count_distinct("contract_id").alias("contracts"), F.min("effective_at").alias("first_event"), F.max("effective_at").alias("last_event"))
    u = updates.agg(F.count("*").alias("updates"), F.sum("event_count").alias("declared_events"))
    return e.crossJoin(u)  # one row each


def updates_daily(updates: DataFrame, as_of: Column, days: int) -> DataFrame:
    recent = updates.where(F.col("record_time") >= as_of - F.make_dt_interval(F.lit(days)))
    return recent.groupBy(F.date_trunc("day", "record_time").alias("day"), "update_type").agg(F.count("*").alias("updates"))


def reward_calculation(rewards: DataFrame, issuance: DataFrame) -> DataFrame:
    """Amount of every created coupon and where it came from: the coupon's own amount; else weight times its round's
    issuance, where both are known; else the weight. issuance: (round_number, reward_type, rate), one row per kind and
    round, joined by that key."""
    made = rewards.where("event_type = 'created'").withColumn("round_number", F.coalesce("round_number", F.lit(0)))
    joined = made.join(issuance, ["round_number", "reward_type"], "left")
    direct, weight = F.coalesce("reward_amount", F.lit(0)), F.coalesce("sv_weight", F.lit(0)).cast("decimal(20,0)")
    source = F.when(direct != 0, "direct").when((weight > 0) & F.col("rate").isNotNull(), "issuance").otherwise("weight")
    amount = F.when(direct != 0, direct.cast("double")).when((weight > 0) & F.col("rate").isNotNull(), weight.cast("double") * F.col("rate").cast("double")).otherwise(weight.cast("double"))
    return joined.select("event_id", "recipient_party", "reward_type", "round_number", "effective_at", amount.alias("amount"), source.alias("amount_source"))


def reward_totals(calculated: DataFrame) -> DataFrame:
    """Totals by party and round with subtotals by party and a grand total (null keys)."""
    return calculated.rollup("recipient_party", "round_number").agg(F.count("*").alias("coupons"), F.sum("amount").alias("amount"))


def reward_weight_by_round(rewards: DataFrame) -> DataFrame:
    return rewards.where("reward_type = 'sv' and event_type = 'created'").groupBy("round_number").agg(F.count("*").alias("coupons"), F.sum("sv_weight").alias("weight"), F.count_distinct("recipient_party").alias("providers"))


def party_events(events: DataFrame) -> DataFrame:
    """(party, event columns): every event once for each party in its signatories or observers."""
    return events.withColumn("party", F.explode(F.array_union("signatories", "observers")))


def party_summary(events: DataFrame) -> DataFrame:
    """Per party: events, contracts, templates, first and last, created and archived (by lower-cased type)."""
    kind = F.lower("event_type")
    return party_events(events).groupBy("party").agg(
        F.count("*").alias("events"), F.count_distinct("contract_id").alias("contracts"), F.count_distinct("template_id").alias("templates"), F.min("effective_at").alias("first_seen"), F.max("effective_at").alias("last_seen"),
        _if(kind == "created").alias("created"), _if(kind == "archived").alias("archived"),
    )


def party_templates(events: DataFrame) -> DataFrame:
    return party_events(events).groupBy("party", "template_id").agg(F.count("*").alias("events"), F.count_distinct("contract_id").alias("contracts"))


def template_list(events: DataFrame) -> DataFrame:
    return events.groupBy("template_id").agg(F.count("*").alias("events"), F.count_distinct("contract_id").alias("contracts"), F.min("effective_at").alias("first_seen"), F.max("effective_at").alias("last_seen"))


def newest_snapshot(acs: DataFrame) -> Column:
    """The latest snapshot time as a scalar subquery: it is run first, and its value is a constant to what it filters, so
    that of files partitioned by the snapshot time only those of one snapshot are read."""
    return acs.agg(F.max("snapshot_time")).scalar()


def latest_snapshot(acs: DataFrame) -> DataFrame:
    """Rows of the latest snapshot, one per contract: of repeats the one recorded last (then that of the largest payload).
    Rows are dealt out by contract first (``dealt``), so that each payload is moved and sorted once."""
    rows = acs.where(F.col("snapshot_time") == newest_snapshot(acs))
    columns = [c for c in acs.columns if c != "contract_id"]
    order = ["record_time", "payload"]
    best = dealt(rows, "contract_id").groupBy("contract_id").agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("row"))
    return best.select("contract_id", *[F.col(f"row.{c}").alias(c) for c in columns])


def complete_snapshots(acs: DataFrame, markers: DataFrame) -> DataFrame:
    """Rows of the snapshots that have a completion marker (migration_id, snapshot_time)."""
    return acs.join(markers.select("migration_id", "snapshot_time").distinct(), ["migration_id", "snapshot_time"], "left_semi")


def retained_snapshots(acs: DataFrame, keep: int) -> DataFrame:
    """Rows of the newest ``keep`` snapshots of each migration. The times are ranked among themselves, not the rows."""
    times = acs.select("migration_id", "snapshot_time").distinct()
    rank = F.row_number().over(Window.partitionBy("migration_id").orderBy(F.col("snapshot_time").desc()))
    kept = times.withColumn("rank", rank).where(F.col("rank") <= keep).drop("rank")
    return acs.join(kept, ["migration_id", "snapshot_time"], "left_semi")


def held_tokens(contracts: DataFrame) -> DataFrame:
    """(contract_id, owner, is_locked, amount) of the tokens among contracts; those without an owner drop out."""
    locked, unlocked = is_template(F.col("template_id"), "LockedAmulet"), is_template(F.col("template_id"), "Amulet")

    def read(p: Column) -> Column:  # within a lambda, where the paths are not expanded into one long generated method
        own = F.when(locked, F.coalesce(F.nullif(json_text(p, "amulet.owner"), F.lit("")), pick_owner(p))).otherwise(pick_owner(p))
        return F.struct(own.alias("owner"), F.when(locked, pick_locked_amount(p)).otherwise(money(json_text(p, "amount.initialAmount"))).alias("amount"))

    held = F.get(F.transform(F.array("payload"), read), F.lit(0))
    rows = contracts.where(locked | unlocked).select("contract_id", locked.alias("is_locked"), held.alias("held"))
    return rows.select("contract_id", F.col("held.owner").alias("owner"), "is_locked", F.col("held.amount").alias("amount")).where("owner is not null")


def _balances(tokens: DataFrame) -> DataFrame:
    sums = tokens.groupBy("owner").agg(_if(~F.col("is_locked"), F.col("amount")).alias("unlocked"), _if("is_locked", F.col("amount")).alias("locked"))
    return sums.withColumn("total", F.col("unlocked") + F.col("locked"))


def holder_balances(acs: DataFrame) -> DataFrame:
    """Owner: unlocked, locked and total amount over a snapshot's tokens; rows without an owner drop out."""
    return _balances(held_tokens(acs))


def rich_list(balances: DataFrame, n: int) -> DataFrame:
    """The n richest owners, with supply and number of holders over all of them."""
    whole = balances.agg(F.sum("total").alias("supply"), F.count("*").alias("holders"))
    return balances.orderBy(F.col("total").desc(), "owner").limit(n).crossJoin(whole)  # one row


def _supply(balances: DataFrame) -> DataFrame:
    return balances.agg(F.sum("unlocked").alias("unlocked"), F.sum("locked").alias("locked"), F.sum("total").alias("total"), F.count("*").alias("holders"))


def supply_totals(acs: DataFrame) -> DataFrame:
    return _supply(holder_balances(acs))


def mining_rounds(acs: DataFrame) -> DataFrame:
    """Rounds of a snapshot by kind."""
    kind = F.when(is_template(F.col("template_id"), "OpenMiningRound"), "open").when(is_template(F.col("template_id"), "IssuingMiningRound"), "issuing").when(is_template(F.col("template_id"), "ClosedMiningRound"), "closed")
    number = json_text(F.col("payload"), "round.number").try_cast("long")
    rows = acs.select(kind.alias("kind"), number.alias("round")).where("kind is not null")
    return rows.groupBy("kind").agg(F.count("*").alias("rounds"), F.min("round").alias("first_round"), F.max("round").alias("last_round"))


def overview_stats(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total_events"), F.count_distinct("contract_id").alias("unique_contracts"), F.count_distinct("template_id").alias("unique_templates"), F.min("effective_at").alias("earliest_event"), F.max("effective_at").alias("latest_event"))


def period_stats(events: DataFrame, unit: str) -> DataFrame:
    return events.groupBy(F.date_trunc(unit, "effective_at").alias("period")).agg(F.count("*").alias("event_count"), F.count_distinct("contract_id").alias("contract_count"))


def stats_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("event_count"), F.count_distinct("contract_id").alias("contract_count"))


def acs_templates(acs: DataFrame) -> DataFrame:
    """Contracts per template of a snapshot and their share in percent."""
    counts = acs.groupBy("template_id").agg(F.count("*").alias("contracts"))
    return counts.withColumn("percentage", F.col("contracts") * 100.0 / F.sum("contracts").over(Window.partitionBy()))  # one row per template


def acs_stats(acs: DataFrame) -> DataFrame:
    return acs.groupBy("snapshot_time", "migration_id").agg(F.count("*").alias("contracts"), F.count_distinct("template_id").alias("templates"), F.max("record_time").alias("last_record"))


def realtime_supply(acs: DataFrame, events: DataFrame) -> DataFrame:
    """Balances of the latest snapshot with the tokens created after it, without those archived after it. A snapshot holds
    what was there at its own instant, so that only later events count. Amounts are read before the two are united."""
    since = events.where(F.col("effective_at") > newest_snapshot(acs))
    gone = since.where("event_type = 'archived'").select("contract_id")
    now = held_tokens(latest_snapshot(acs)).unionByName(held_tokens(since.where("event_type = 'created'")))
    return _supply(_balances(now.join(gone, "contract_id", "left_anti")))


#: The exercised choices that burn tokens.
BURN_CHOICES = {
    "AmuletRules_BuyMemberTraffic": "traffic", "AmuletRules_Transfer": "transfer",
    "SubscriptionInitialPayment_Collect": "names", "AnsEntryContext_CollectRenewalEntryPayment": "names",
    "AmuletRules_CreateTransferPreapproval": "preapproval", "AmuletRules_CreateExternalPartySetupProposal": "preapproval", "TransferPreapproval_Renew": "preapproval",
}


def burn_by_transaction(events: DataFrame) -> DataFrame:
    """(update_id, event_date, traffic, transfer, names, preapproval, total) burned by exercised choices.

    Traffic: the fees and the paid amount; transfers: the fees with all output fees; pre-approvals: the paid amount and
    the fees of the transfer they hold (``transferResult``). Payments for names: the initial amount of the contract that
    the result names as ``amulet``, created in the same update, and the fees of the transfers among the payment's child
    events (which count as transfers too). Missing amounts are 0; a choice without its summary burns nothing.
    """
    r = F.col("exercise_result")
    number = lambda path: F.coalesce(money(json_text(r, path)), F.lit(0)).cast("double")

    def fees(at: str, outputs: bool = True) -> Column:
        listed = F.coalesce(F.from_json(json_text(r, f"{at}.outputFees"), "array<string>"), F.array().cast("array<string>"))
        paid = F.aggregate(listed, F.lit(0.0), lambda a, x: a + F.coalesce(money(x), F.lit(0)).cast("double"))
        return number(f"{at}.holdingFees") + number(f"{at}.senderChangeFee") + (paid if outputs else F.lit(0.0))

    kind = F.coalesce(*[F.when(F.col("choice") == c, k) for c, k in BURN_CHOICES.items()])
    used = events.where("event_type = 'exercised'").withColumn("kind", kind).where("kind is not null")
    has = lambda path: F.get_json_object(r, f"$.{path}").isNotNull()
    amount = (
        F.when((F.col("kind") == "traffic") & has("summary"), fees("summary", outputs=False) + number("amuletPaid"))
        .when((F.col("kind") == "transfer") & has("summary"), fees("summary"))
        .when((F.col("kind") == "preapproval") & has("transferResult.summary"), fees("transferResult.summary") + number("amuletPaid")).otherwise(F.lit(0.0))
    )
    burned = cut(used.select("update_id", "event_date", "event_id", "kind", amount.alias("amount"), json_text(r, "amulet").alias("amulet"), "child_event_ids"))
    payments = burned.where("kind = 'names'")
    # of the created events only those of a payment's update are unfolded
    made = events.where("event_type = 'created'").join(payments.select("update_id").distinct(), "update_id", "left_semi").select(
        "update_id", F.explode(F.array_distinct(F.array("event_id", "contract_id"))).alias("amulet"), F.coalesce(money(json_text(F.col("payload"), "amount.initialAmount")), F.lit(0)).cast("double").alias("token")
    )
    tokens = payments.join(made, ["update_id", "amulet"]).select("update_id", "event_date", "kind", F.col("token").alias("amount"))
    moved = burned.where("kind = 'transfer'").select("update_id", F.col("event_id").alias("child"), F.col("amount").alias("fees"))
    below = payments.select("update_id", "event_date", "kind", F.explode("child_event_ids").alias("child")).join(moved, ["update_id", "child"]).select("update_id", "event_date", "kind", F.col("fees").alias("amount"))
    every = burned.select("update_id", "event_date", "kind", "amount").unionByName(tokens).unionByName(below)
    of = lambda name: F.sum(F.when(F.col("kind") == name, F.col("amount")).otherwise(0.0)).alias(name)
    sums = every.groupBy("update_id", "event_date").agg(*[of(k) for k in ("traffic", "transfer", "names", "preapproval")])
    return sums.withColumn("total", F.col("traffic") + F.col("transfer") + F.col("names") + F.col("preapproval"))


def burn_by_day(burns: DataFrame) -> DataFrame:
    kinds = ("traffic", "transfer", "names", "preapproval", "total")
    return burns.groupBy("event_date").agg(*[F.sum(k).alias(k) for k in kinds])


def daily_mint_vs_burn(rounds: DataFrame, burns: DataFrame) -> DataFrame:
    minted = rounds.where("change_to_initial_amount > 0").groupBy(F.to_date("closed_round_effective_at").alias("event_date")).agg(F.sum("change_to_initial_amount").alias("minted"))
    burned = burn_by_day(burns).select("event_date", F.col("total").alias("burned"))
    return minted.join(burned, "event_date", "full").select("event_date", F.coalesce("minted", F.lit(0.0)).alias("minted"), F.coalesce("burned", F.lit(0.0)).alias("burned"))


def rounds_per_day(rounds: DataFrame) -> DataFrame:
    ends = rounds.agg(F.min("closed_round").alias("a"), F.max("closed_round").alias("b"), F.min_by("closed_round_effective_at", "closed_round").alias("from"), F.max_by("closed_round_effective_at", "closed_round").alias("to"))
    seconds = F.abs(F.timestamp_diff("SECOND", F.col("from"), F.col("to"))) / (F.col("b") - F.col("a"))
    return ends.select(seconds.alias("seconds_per_round"), (F.lit(86_400.0) / seconds).alias("rounds_per_day"))


def validator_uptime(licences: DataFrame) -> DataFrame:
    """Share of coupons collected; inactive with more than one missed."""
    collected = F.col("last_received_round") - F.col("first_received_round") + 1 - F.col("coupons_missed")
    every = collected + F.col("coupons_missed")
    return licences.select("contract_id", "validator_party", F.when(every > 0, collected * 100.0 / every).alias("uptime"), F.when(F.col("coupons_missed") > 1, "inactive").otherwise("active").alias("state"))


def unclaimed_rewards_by_user(acs: DataFrame) -> DataFrame:
    rows = acs.where(is_template(F.col("template_id"), "UnclaimedReward"))
    return rows.groupBy(json_text(F.col("payload"), "beneficiary").alias("beneficiary")).agg(F.count("*").alias("coupons"), F.sum(money(json_text(F.col("payload"), "amount"))).alias("amount"))


def claimed_expired_rewards(events: DataFrame) -> DataFrame:
    """Exercised and archived coupons: claimed (a claiming choice) or expired."""
    coupon = F.col("template_id").like("%RewardCoupon")
    state = F.when(F.col("choice").contains("Claim"), "claimed").when(F.col("event_type") == "archived", "expired")
    return events.where(coupon).select("event_id", "contract_id", "template_id", state.alias("state")).where("state is not null")


def average_price_vote(events: DataFrame) -> DataFrame:
    return template_view(events, "amulet_price_vote").agg(F.avg(F.col("voted_price").cast("double")).alias("average_price"), F.count("voted_price").alias("votes"))


def update_mix(updates: DataFrame, as_of: Column) -> DataFrame:
    """Share of each update type, its latest record and freshness: live under a minute, idle under five, else stale."""
    by = updates.groupBy("update_type").agg(F.count("*").alias("updates"), F.max("record_time").alias("latest"))
    age = F.timestamp_diff("SECOND", F.col("latest"), as_of)
    state = F.when(age < 60, "live").when(age < 300, "idle").otherwise("stale")
    return by.select("update_type", "updates", (F.col("updates") * 100.0 / F.sum("updates").over(Window.partitionBy())).alias("share"), age.alias("age_seconds"), state.alias("state"))


def top_templates(events: DataFrame, n: int = 5) -> DataFrame:
    """The n entities with most events (of equal ones the first by name)."""
    counts = events.groupBy(F.element_at(F.split("template_id", ":"), -1).alias("template")).agg(F.count("*").alias("events"))
    return counts.where("template <> ''").orderBy(F.col("events").desc(), "template").limit(n)


def typical_price() -> Column:
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4


def twap(candles: DataFrame) -> DataFrame:
    """Mean typical price per pair over candles with all four prices."""
    valid = candles.where("open is not null and high is not null and low is not null and close is not null")
    return valid.groupBy("pair").agg(F.avg(typical_price()).alias("twap"), F.count("*").alias("candles"))


def vw_twap(candles: DataFrame, minutes: int) -> DataFrame:
    """Mean over time slices of the volume-weighted typical price; slices without volume are counted and left out."""
    micros = minutes * 60_000_000
    valid = candles.where("open is not null and high is not null and low is not null and close is not null")
    slices = valid.groupBy("pair", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / micros).alias("slice")).agg(F.sum(typical_price() * F.col("volume")).alias("pv"), F.sum("volume").alias("v"))
    return slices.groupBy("pair").agg(F.avg(F.when(F.col("v") != 0, F.col("pv") / F.col("v"))).alias("vw_twap"), _if("v <> 0").alias("slices"), _if("v = 0").alias("empty_slices"))


def price_changes(candles: DataFrame) -> DataFrame:
    """Daily close per pair and its change in percent to the day before that has one."""
    daily = candles.groupBy("pair", F.to_date("ts").alias("day")).agg(F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("count").alias("trades"))
    before = F.lag("close").over(Window.partitionBy("pair").orderBy("day"))
    return daily.select("*", ((F.col("close") - before) / F.when(before != 0, before) * 100).alias("change_pct"))


def market_overview(candles: DataFrame, preferred: str) -> DataFrame:
    """Latest day of each pair; over all: weighted price, volume, trades; reference price of the preferred pair, else of
    the first pair that has a close."""
    daily = price_changes(candles)
    rank = F.row_number().over(Window.partitionBy("pair").orderBy(F.col("day").desc()))
    latest = daily.withColumn("rank", rank).where("rank = 1").drop("rank")
    good = (F.col("close") > 0) & (F.col("volume") > 0)
    first = F.min(F.when(F.col("close").isNotNull(), F.struct((F.col("pair") != preferred).alias("other"), "pair", "close")))
    whole = latest.agg((F.sum(F.when(good, F.col("close") * F.col("volume"))) / F.sum(F.when(good, F.col("volume")))).alias("weighted_price"), F.sum("volume").alias("total_volume"), F.sum("trades").alias("total_trades"), first["close"].alias("reference_price"))
    return latest.crossJoin(whole)  # one row


def usage_series(transfers: DataFrame, start: str, end: str) -> DataFrame:
    """Day by day between start and end: parties seen so far, senders and transfers of the day, and their mean over the
    last seven days. Only transfers that move something count. First-seen days are summed, not distinct sets."""
    moved = F.aggregate(F.transform("receivers", lambda r: F.coalesce(r["amount"], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    own = transfers.where(moved > 0).select("date", "sender")
    daily = own.groupBy("date").agg(F.count_distinct("sender").alias("users"), F.count("*").alias("transfers"))
    new = own.groupBy("sender").agg(F.min("date").alias("date")).groupBy("date").agg(F.count("*").alias("new_parties"))
    days = transfers.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    filled = days.join(daily, "date", "left").join(new, "date", "left").fillna(0, ["users", "transfers", "new_parties"])
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    week = Window.orderBy("date").rowsBetween(-6, 0)
    half_up = lambda c: F.floor(F.avg(c).over(week) + 0.5)
    return filled.select("date", F.sum("new_parties").over(so_far).alias("cumulative_parties"), "users", half_up("users").alias("users_mean7"), "transfers", half_up("transfers").alias("transfers_mean7"))


def transaction_classes(events: DataFrame, wallets: DataFrame) -> DataFrame:
    """Per wallet (party): outbound (it acts), inbound (it signs or observes without acting) and other events."""
    rows = party_events(events.withColumn("acts", F.col("acting_parties"))).join(wallets.select(F.col("wallet").alias("party")), "party", "left_semi")
    kind = F.when(F.array_contains("acts", F.col("party")), "outbound").when(F.col("event_type") == "created", "inbound").otherwise("other")
    return rows.groupBy("party").agg(_if(kind == "outbound").alias("outbound"), _if(kind == "inbound").alias("inbound"), _if(kind == "other").alias("other"))


def transfer_activity(events: DataFrame) -> DataFrame:
    """(party): parties of events whose template is a transfer's or whose choice is Transfer."""
    moved = F.col("template_id").contains("Transfer") | F.coalesce(F.col("choice") == "Transfer", F.lit(False))
    return party_events(events.where(moved)).select("party").distinct()


def wallet_immobility(classes: DataFrame, balances: DataFrame, active: DataFrame) -> DataFrame:
    """A wallet is immobile without outbound events and without any transfer activity (``active``: party); alert if it holds
    an unlocked balance then."""
    joined = classes.join(balances.select(F.col("owner").alias("party"), "unlocked"), "party", "left").join(active.select("party", F.lit(True).alias("active")), "party", "left")
    still = (F.col("outbound") == 0) & F.col("active").isNull()
    return joined.select("party", "outbound", F.coalesce("active", F.lit(False)).alias("transfers"), F.when(still, "immobile").otherwise("mobile").alias("verdict"), (still & (F.coalesce("unlocked", F.lit(0)) > 0)).alias("alert"))


def numbered(rows: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """The rows with their number from 1 on in an order over all of them.

    Rows are ranged by the whole order into sorted parts and written once; every part starts after the rows of those before it,
    a table of one row a part. With a unique column in the order, equal values are split over parts too.
    """
    keys = [f"__order_{k}" for k in range(len(order))]
    placed = rows.select("*", *[c.alias(k) for k, c in zip(keys, order, strict=True)])
    parts = cut(placed.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__rows"))
    before = sizes.select("__part", (F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")).alias("__before"))  # one row a part
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    found = parts.withColumn("__inside", inside).join(before, "__part")
    return found.withColumn(out, F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__before", *keys)


def dev_fund_summary(coupons: DataFrame) -> DataFrame:
    """Coupons (contract_id, effective_at, amount) ranked by amount (of equal ones by id), beside total and latest one."""
    ranked = numbered(coupons, -F.coalesce(F.col("amount").cast("decimal(38,10)"), F.lit("-1e20").cast("decimal(38,10)")), F.col("contract_id")).withColumn("rank", F.col("rank").cast("int"))
    whole = coupons.agg(F.sum("amount").alias("total"), F.max(F.struct("effective_at", "contract_id"))["contract_id"].alias("latest_contract"))
    return ranked.crossJoin(whole)  # one row


def validator_cohorts(licences: DataFrame, super_validators: DataFrame, rounds_a_day: int = 144) -> DataFrame:
    """Validators, super validators left out, by how long they have collected."""
    own = licences.join(super_validators, "validator_party", "left_anti").groupBy("validator_party").agg(F.max(F.col("last_received_round") - F.col("first_received_round")).alias("rounds"))
    days = F.col("rounds") / rounds_a_day
    cohort = F.when(days <= 1, "day").when(days <= 7, "week").when(days <= 30, "month").when(days <= 182, "half_year").otherwise("year")
    return own.groupBy(cohort.alias("cohort")).agg(F.count("*").alias("validators"))


def joins_by_month(joined: DataFrame, start: str, end: str) -> DataFrame:
    """(validator_party, joined_at) counted by month over a calendar without gaps."""
    months = joined.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("month"))
    counts = joined.groupBy("validator_party").agg(F.min("joined_at").alias("at")).groupBy(F.to_date(F.date_trunc("month", "at")).alias("month")).agg(F.count("*").alias("validators"))
    return months.join(counts, "month", "left").fillna(0, ["validators"])


def template_sum(acs: DataFrame, entity: str) -> DataFrame:
    rows = latest_snapshot(acs).where(is_template(F.col("template_id"), entity))
    return rows.agg(F.sum(pick_amount(F.col("payload"))).alias("amount"), F.count("*").alias("contracts"), F.count_distinct("template_id").alias("templates"))


def allocation_summary(acs: DataFrame, entity: str) -> DataFrame:
    rows = latest_snapshot(acs).where(is_template(F.col("template_id"), entity))
    return rows.agg(F.count("*").alias("allocations"), F.sum(pick_amount(F.col("payload"))).alias("amount"), F.count_distinct(json_text(F.col("payload"), "provider")).alias("executors"))


def sv_lock_tiers(amounts: DataFrame) -> DataFrame:
    """(party, locked, earned, weight): locked percentage, tier multiplier and effective weight."""
    share = F.when(F.col("earned") > 0, F.col("locked") / F.col("earned") * 100).otherwise(0.0)
    tier = F.when(share >= 70, 1.0).when(share >= 45, 0.6).when(share >= 35, 0.4).otherwise(0.0)
    return amounts.select("party", share.alias("locked_pct"), tier.alias("multiplier"), F.round(F.col("weight") * tier).cast("long").alias("effective_weight"))


def reward_distribution(stages: DataFrame, dev_fund: float = 0.05) -> DataFrame:
    """(stage, validator, app): shares with the rest for super validators; from stage 2 on a part for the dev fund."""
    left = F.when(F.col("stage") >= 2, 1 - dev_fund).otherwise(1.0)
    return stages.select("stage", (F.col("validator") * left).alias("validator_share"), (F.col("app") * left).alias("app_share"), ((1 - F.col("validator") - F.col("app")) * left).alias("sv_share"), F.when(F.col("stage") >= 2, dev_fund).otherwise(0.0).alias("dev_fund_share"))


def beneficiary_weights(operators: DataFrame) -> DataFrame:
    """(name, reward_weight_bps, beneficiaries array<struct<beneficiary, weight>>): weight per beneficiary, escrowed if
    its party says so, and whether the operator's parts sum to its total within one bps (the rest is its own)."""
    rows = operators.select("name", "reward_weight_bps", F.explode_outer("beneficiaries").alias("b"))
    per = rows.groupBy("name", "reward_weight_bps", F.coalesce("b.beneficiary", F.col("name")).alias("beneficiary")).agg(F.sum(F.coalesce("b.weight", F.col("reward_weight_bps"))).alias("bps"))
    given = F.sum("bps").over(Window.partitionBy("name"))
    escrow = F.col("beneficiary").rlike("(?i)ghost|escrow")
    return per.select("name", "beneficiary", "bps", F.when(escrow, "escrowed").otherwise("direct").alias("status"), (F.abs(given - F.col("reward_weight_bps")) <= 1).alias("balanced"))
