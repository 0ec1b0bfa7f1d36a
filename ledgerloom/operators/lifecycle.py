"""Lifecycles, joins and histories of contracts, proposals, rounds and validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import action_tag, is_template, json_text, money, of_entity
from ledgerloom.operators.views import template_view


def first_archives(events: DataFrame, entity: str) -> DataFrame:
    """(contract_id, archived_at): one row per archived contract, the earliest, so that joins don't multiply rows."""
    rows = events.where((F.col("event_type") == "archived") & is_template(F.col("template_id"), entity))
    return rows.groupBy("contract_id").agg(F.min("effective_at").alias("archived_at"))


def amulet_lifecycle(events: DataFrame, as_of: Column) -> DataFrame:
    """Created tokens with their archive: status and lifespan in seconds (open ones until as_of)."""
    created = template_view(events, "amulet").withColumnRenamed("effective_at", "created_at")
    joined = created.join(first_archives(events, "Amulet"), "contract_id", "left")
    status = F.when(F.col("archived_at").isNull(), "active").otherwise("archived")
    seconds = F.timestamp_diff("SECOND", F.col("created_at"), F.coalesce("archived_at", as_of))
    return joined.select("contract_id", "event_id", "owner_party", "initial_amount", "created_at_round", "created_at", "archived_at", status.alias("status"), seconds.alias("lifespan_seconds"))


def proposal_lifecycle(events: DataFrame, as_of: Column) -> DataFrame:
    """Vote requests: completed (archived), expired (deadline before as_of) or active; hours from creation to its end."""
    created = template_view(events, "vote_request").withColumnRenamed("effective_at", "created_at")
    joined = created.join(first_archives(events, "VoteRequest"), "contract_id", "left")
    status = F.when(F.col("archived_at").isNotNull(), "completed").when(F.col("expires_at") < as_of, "expired").otherwise("active")
    hours = F.timestamp_diff("HOUR", F.col("created_at"), F.coalesce("archived_at", as_of))
    return joined.select("contract_id", "created_at", "requester_party", "action_category", "action_type", "expires_at", "archived_at", status.alias("status"), hours.alias("duration_hours"))


def round_lifecycle(events: DataFrame, as_of: Column) -> DataFrame:
    """Rounds by number: first opening, first closing, price at the opening, status and minutes open."""
    opened = template_view(events, "open_mining_round").groupBy("round_number").agg(
        F.min("effective_at").alias("opened_at"), F.min_by("amulet_price", F.struct("effective_at", "contract_id")).alias("amulet_price"), F.min("target_closes_at").alias("target_closes_at")
    )
    closed = template_view(events, "closed_mining_round").groupBy("round_number").agg(F.min("effective_at").alias("closed_at"))
    joined = opened.join(closed, "round_number", "left")
    status = F.when(F.col("closed_at").isNotNull(), "closed").otherwise("open")
    minutes = F.timestamp_diff("MINUTE", F.col("opened_at"), F.coalesce("closed_at", as_of))
    return joined.select("round_number", "opened_at", "closed_at", "amulet_price", "target_closes_at", status.alias("status"), minutes.alias("duration_minutes"))


def validator_lifecycle(events: DataFrame, as_of: Column) -> DataFrame:
    """Licences with archive, number of users and rewards of their validator (counted before the join)."""
    licence = template_view(events, "validator_license").withColumnRenamed("effective_at", "licensed_at")
    users = template_view(events, "validator_right").groupBy("validator_party").agg(F.count_distinct("user_party").alias("user_count"))
    coupons = template_view(events, "validator_reward_coupon").groupBy("validator_party").agg(
        F.count("*").alias("reward_count"), F.min("round_number").alias("first_reward_round"), F.max("round_number").alias("last_reward_round")
    )
    joined = licence.join(first_archives(events, "ValidatorLicense"), "contract_id", "left").join(users, "validator_party", "left").join(coupons, "validator_party", "left")
    status = F.when(F.col("archived_at").isNull(), "active").otherwise("inactive")
    days = F.timestamp_diff("DAY", F.col("licensed_at"), F.coalesce("archived_at", as_of))
    return joined.select(
        "contract_id", "validator_party", "sponsor_party", status.alias("status"), F.coalesce("user_count", F.lit(0)).alias("user_count"),
        F.coalesce("reward_count", F.lit(0)).alias("reward_count"), "first_reward_round", "last_reward_round", days.alias("age_days"),
    )


def daily_mint_burn(events: DataFrame) -> DataFrame:
    """Per day the minted amount and number of created and archived tokens."""
    rows = events.where(is_template(F.col("template_id"), "Amulet"))
    minted = rows.where("event_type = 'created'").groupBy("event_date").agg(F.sum(money(json_text(F.col("payload"), "amount.initialAmount"))).alias("minted_amount"), F.count("*").alias("mint_count"))
    burned = rows.where("event_type = 'archived'").groupBy("event_date").agg(F.count("*").alias("burn_count"))
    both = minted.join(burned, "event_date", "full")
    return both.select("event_date", F.coalesce("minted_amount", F.lit(0)).alias("minted_amount"), F.coalesce("mint_count", F.lit(0)).alias("mint_count"), F.coalesce("burn_count", F.lit(0)).alias("burn_count"))


def active_contracts(events: DataFrame, entity: str) -> DataFrame:
    """Contracts of a template that were created and never archived."""
    created = events.where((F.col("event_type") == "created") & is_template(F.col("template_id"), entity))
    gone = events.where("event_type = 'archived'").select("contract_id")
    return created.join(gone, "contract_id", "left_anti").select("contract_id", "template_id", F.col("effective_at").alias("created_at"), "payload")


def all_rewards(events: DataFrame) -> DataFrame:
    """The three coupon kinds in one schema, with event type and day (created and other events alike)."""
    out = None
    kinds = (("AppRewardCoupon", "app", "provider"), ("SvRewardCoupon", "sv", "sv"), ("ValidatorRewardCoupon", "validator", "validator"))
    for entity, kind, who in kinds:
        p = F.col("payload")
        rows = events.where(is_template(F.col("template_id"), entity)).select(
            "event_id", "contract_id", "event_type", "event_date", "effective_at", F.lit(kind).alias("reward_type"), json_text(p, who).alias("recipient_party"),
            json_text(p, "round.number").try_cast("long").alias("round_number"),
            (money(json_text(p, "amount")) if kind == "app" else F.lit(None).cast("decimal(38,10)")).alias("reward_amount"),
            (money(json_text(p, "weight")).try_cast("long") if kind == "sv" else F.lit(None).cast("long")).alias("sv_weight"),
            (json_text(p, "featured").try_cast("boolean") if kind == "app" else F.lit(None).cast("boolean")).alias("is_featured"),
            (json_text(p, "user") if kind == "validator" else F.lit(None).cast("string")).alias("user_party"),
            (json_text(p, "beneficiary") if kind == "sv" else F.lit(None).cast("string")).alias("beneficiary_party"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def sv_weight_history(rewards: DataFrame, dedup_first: bool = True) -> DataFrame:
    """Weight of every (sv, round), latest coupon of a round, with the weight of the sv's round before and the change.
    dedup_first=False takes the previous coupon instead of the previous round's."""
    coupons = rewards.where("reward_type = 'sv' and event_type = 'created'")
    latest = Window.partitionBy("recipient_party", "round_number").orderBy(F.col("effective_at").desc(), F.col("contract_id").desc())
    by_round = Window.partitionBy("recipient_party").orderBy("round_number", "effective_at", "contract_id")
    ranked = coupons.withColumn("rank", F.row_number().over(latest))
    if dedup_first:
        ranked = ranked.where("rank = 1")
    out = ranked.withColumn("previous_weight", F.lag("sv_weight").over(by_round)).where("rank = 1")
    return out.select("recipient_party", "round_number", "sv_weight", "previous_weight", (F.col("sv_weight") - F.col("previous_weight")).alias("weight_change"))


def unique_proposals(events: DataFrame, as_of: Column, threshold: int = 10) -> DataFrame:
    """One row per proposal (payload tracking id, else contract id): its latest request, votes for and against, number
    of merged requests, and status: passed at the threshold; expired if it is archived or past ``voteBefore`` without
    any vote; failed else, open ones below the threshold too."""
    requests = events.where((F.col("event_type") == "created") & is_template(F.col("template_id"), "VoteRequest"))
    p = F.col("payload")
    votes = F.from_json(F.get_json_object(p, "$.votes"), "map<string,struct<accept:string>>")
    yes = F.size(F.filter(F.map_values(votes), lambda v: F.lower(v["accept"]) == "true"))
    rows = requests.select(
        F.coalesce(json_text(p, "trackingCid"), F.col("contract_id")).alias("proposal_id"), "contract_id", "effective_at", action_tag(p).alias("action_type"),
        F.try_to_timestamp(json_text(p, "voteBefore")).alias("vote_before"), yes.alias("votes_for"), (F.size(F.map_values(votes)) - yes).alias("votes_against"),
    )
    by = Window.partitionBy("proposal_id")
    last = by.orderBy(F.col("effective_at").desc(), F.col("contract_id").desc())
    latest = rows.select("*", F.row_number().over(last).alias("rank"), F.count("*").over(by).alias("merged")).where("rank = 1")
    joined = latest.join(first_archives(events, "VoteRequest"), "contract_id", "left")
    over = F.col("archived_at").isNotNull() | F.coalesce(F.col("vote_before") < as_of, F.lit(False))
    status = F.when(F.col("votes_for") >= threshold, "passed").when(over & (F.col("votes_for") + F.col("votes_against") == 0), "expired").otherwise("failed")
    return joined.select("proposal_id", "contract_id", "action_type", F.col("effective_at").alias("latest_at"), "votes_for", "votes_against", "merged", status.alias("status"))


def outcome_status(tag: Column) -> Column:
    """Status of a closed vote by the tag of its outcome; without a known tag it has expired."""
    return F.when(tag == "VRO_Accepted", "accepted").when(tag == "VRO_Rejected", "rejected").otherwise("expired")


def closed_votes(results: DataFrame) -> DataFrame:
    """(proposal_id, status, completed_at) of vote results (tracking_cid, contract_id, outcome_tag, completed_at): the latest
    result of each proposal, which is its tracking id, else its contract."""
    proposal = F.coalesce(F.nullif("tracking_cid", F.lit("")), F.col("contract_id"))
    latest = results.groupBy(proposal.alias("proposal_id")).agg(F.max_by(F.struct("outcome_tag", "completed_at"), F.struct("completed_at", "contract_id")).alias("last"))
    return latest.select("proposal_id", outcome_status(F.col("last.outcome_tag")).alias("status"), F.col("last.completed_at").alias("completed_at"))


def proposal_states(events: DataFrame, closed: DataFrame, as_of: Column) -> DataFrame:
    """(proposal_id, contract_id, status, is_closed, is_executed, is_human, requests) of every proposal, by its latest request.

    The status is that of its closed vote where there is one, else expired once ``voteBefore`` has passed, else in progress.
    It is executed if it was accepted and a consuming exercise of the rules followed in the update that archived it. It
    is a human's unless it has neither a reason nor any vote.
    """
    requests = events.where((F.col("event_type") == "created") & of_entity(events, "VoteRequest"))
    p = F.col("payload")
    reason = F.coalesce(json_text(p, "reason.body"), json_text(p, "reason.url"), F.lit(""))
    votes = F.coalesce(F.size(F.json_object_keys(json_text(p, "votes"))), F.lit(0))
    rows = requests.select(F.coalesce(F.nullif(json_text(p, "trackingCid"), F.lit("")), F.col("contract_id")).alias("proposal_id"), "contract_id", "effective_at", F.try_to_timestamp(json_text(p, "voteBefore")).alias("until"), ((reason != "") | (votes > 0)).alias("is_human"))
    latest = rows.groupBy("proposal_id").agg(F.max_by(F.struct("contract_id", "until", "is_human"), F.struct("effective_at", "contract_id")).alias("r"), F.count("*").alias("requests")).select("proposal_id", "r.*", "requests")
    ended = events.where((F.col("event_type") == "archived") & of_entity(events, "VoteRequest")).select("contract_id", F.col("update_id").alias("ended_in")).groupBy("contract_id").agg(F.min("ended_in").alias("ended_in"))
    ruled = events.where((F.col("event_type") == "exercised") & F.col("consuming") & of_entity(events, "DsoRules")).select(F.col("update_id").alias("ended_in"), F.lit(True).alias("ruled")).distinct()
    joined = latest.join(closed.select("proposal_id", F.col("status").alias("closed_status")), "proposal_id", "left").join(ended, "contract_id", "left").join(ruled, "ended_in", "left")
    over = F.coalesce(F.col("until") < as_of, F.lit(False))
    status = F.coalesce("closed_status", F.when(over, "expired").otherwise("in_progress"))
    return joined.select("proposal_id", "contract_id", status.alias("status"), (status != "in_progress").alias("is_closed"), ((status == "accepted") & F.coalesce("ruled", F.lit(False))).alias("is_executed"), "is_human", "requests")


def first_actions(events: DataFrame) -> DataFrame:
    """First event per contract and kind of governance action: vote request, rule change, confirmation."""
    kind = (
        F.when(is_template(F.col("template_id"), "VoteRequest"), "vote").when(is_template(F.col("template_id"), "DsoRules"), "rule_change")
        .when(is_template(F.col("template_id"), "Confirmation"), "confirmation")
    )
    rows = events.withColumn("kind", kind).where("kind is not null")
    rank = F.row_number().over(Window.partitionBy("kind", "contract_id").orderBy("effective_at", "event_id"))
    return rows.withColumn("rank", rank).where("rank = 1").select("kind", "contract_id", "event_id", "event_type", F.col("effective_at").alias("first_seen"))


def all_proposals(active: DataFrame, historical: DataFrame, key: str = "proposal_id") -> DataFrame:
    """Union of two proposal sources; of an id in both, the historical row stays."""
    both = active.withColumn("priority", F.lit(0)).unionByName(historical.withColumn("priority", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("priority").desc()))
    return both.withColumn("rank", rank).where("rank = 1").drop("rank", "priority")


def as_of_rewards(approvals: DataFrame, totals: DataFrame) -> DataFrame:
    """(party, round) of approvals with the cumulative rewards at the latest round not after it: the totals and the
    approvals are put into one order by party and round, and the last total is carried forward (no inequality join)."""
    marks = approvals.select("party", F.col("round").alias("closed_round"), F.lit(None).cast("double").alias("cumulative_app_rewards"), F.lit(1).alias("ask"))
    known = totals.select("party", "closed_round", "cumulative_app_rewards", F.lit(0).alias("ask"))
    carried = F.last("cumulative_app_rewards", ignorenulls=True).over(Window.partitionBy("party").orderBy("closed_round", "ask").rowsBetween(Window.unboundedPreceding, 0))
    return known.unionByName(marks).withColumn("at_approval", carried).where("ask = 1").select("party", F.col("closed_round").alias("round"), F.coalesce("at_approval", F.lit(0.0)).alias("rewards_at_approval"))


def reward_milestones(totals: DataFrame, approvals: DataFrame, thresholds: tuple[float, ...], seconds_per_round: int = 600) -> DataFrame:
    """First round at which a party's cumulative rewards reach each threshold, days from its approval round, and the
    rewards before and after approval."""
    steps = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = totals.select("party", "closed_round", "cumulative_app_rewards", F.explode(steps).alias("threshold")).groupBy("party", "threshold").agg(
        F.min(F.when(F.col("cumulative_app_rewards") >= F.col("threshold"), F.col("closed_round"))).alias("reached_round"), F.max("cumulative_app_rewards").alias("total")
    )
    before = as_of_rewards(approvals, totals)
    joined = reached.join(before, "party")
    days = (F.col("reached_round") - F.col("round")) * F.lit(seconds_per_round) / F.lit(86_400.0)
    return joined.select("party", "threshold", "reached_round", days.alias("days_from_approval"), F.col("rewards_at_approval").alias("before"), F.greatest(F.lit(0.0), F.col("total") - F.col("rewards_at_approval")).alias("after"))


def step_at(times: DataFrame, at: str, steps: tuple[tuple[int, str], ...]) -> DataFrame:
    """The step of a schedule (seconds since its start, name) that holds at each elapsed time: the last one begun."""
    schedule = F.array(*[F.struct(F.lit(int(s)).alias("start"), F.lit(n).alias("name")) for s, n in sorted(steps)])
    begun = F.filter(schedule, lambda s: s["start"] <= F.col(at))
    return times.withColumn("stage", F.when(F.size(begun) > 0, F.element_at(begun, -1)["name"]))


def prefix_lookup(external: DataFrame, indexed: DataFrame, length: int = 6) -> DataFrame:
    """External (id, status) against indexed (id, status) by id prefix: found, missing, status mismatch or extra. An
    indexed prefix that stands for several ids keeps its smallest id."""
    ours = indexed.groupBy(F.substring("id", 1, length).alias("prefix")).agg(F.min(F.struct("id", "status")).alias("ours"))
    theirs = external.select(F.substring("id", 1, length).alias("prefix"), F.col("id").alias("external_id"), F.col("status").alias("external_status"))
    both = theirs.join(ours, "prefix", "full")
    outcome = (
        F.when(F.col("external_id").isNull(), "extra").when(F.col("ours").isNull(), "missing")
        .when(F.col("ours.status") == F.col("external_status"), "found").otherwise("status_mismatch")
    )
    return both.select("prefix", "external_id", F.col("ours.id").alias("indexed_id"), outcome.alias("outcome"))
