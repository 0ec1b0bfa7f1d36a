"""Per-template typed views from one declarative table: a filter and a list of (column, JSON path, type)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.columns import of_entity
from ledgerloom.sources.schemas import MONEY

#: Type names of view columns: text, long (through decimal, so that "1.0" is 1), money, bool, time, list (of text),
#: size (of an object's top-level keys or an array), json (text of the value), has (whether the path is there).
TEXT, LONG, DECIMAL, BOOL, TIME, LIST, SIZE, JSON, HAS = "text", "long", "money", "bool", "time", "list", "size", "json", "has"


@dataclass(frozen=True)
class View:
    """entity: template's last part (None: any). events: event types. columns: (name, path, type), a path beginning
    with ``result:`` is read from the exercise result; alternatives are divided by ``|``. keep: event columns."""

    entity: str | None
    columns: tuple[tuple[str, str, str], ...] = ()
    events: tuple[str, ...] = ("created",)
    keep: tuple[str, ...] = ("event_id", "contract_id", "migration_id", "effective_at")
    where: str | None = None
    explode: tuple[str, str] | None = None


def _spec(text: str) -> tuple[tuple[str, str, str], ...]:
    return tuple((line.split()[0], line.split()[1], line.split()[2]) for line in text.strip().splitlines())


_CHOICE = ("event_id", "contract_id", "choice", "consuming", "effective_at")

VIEWS: dict[str, View] = {
    "amulet": View("Amulet", _spec("""
        dso_party dso text
        owner_party owner text
        initial_amount amount.initialAmount money
        created_at_round amount.createdAt.number long
        holding_fee_rate amount.ratePerRound.rate money""")),
    "amulet_archives": View("Amulet", events=("archived",)),
    "locked_amulet": View("LockedAmulet", _spec("""
        owner_party amulet.owner text
        locked_amount amulet.amount.initialAmount money
        created_at_round amulet.amount.createdAt.number long
        holding_fee_rate amulet.amount.ratePerRound.rate money
        lock_holders lock.holders list
        expires_at_round lock.expiresAt.number long
        time_locked lock.expiresAt has""")),
    "validator_license": View("ValidatorLicense", _spec("""
        validator_party validator text
        sponsor_party sponsor text
        faucet_state_tag faucetState.tag text
        coupons_missed faucetState.value.numCouponsMissed long
        first_received_round faucetState.value.firstReceivedFor.number long
        last_received_round faucetState.value.lastReceivedFor.number long
        version metadata.version text
        contact_point metadata.contactPoint text
        metadata_last_updated metadata.lastUpdatedAt time""")),
    "validator_right": View("ValidatorRight", _spec("""
        user_party user text
        validator_party validator text""")),
    "app_reward_coupon": View("AppRewardCoupon", _spec("""
        provider_party provider text
        round_number round.number long
        reward_amount amount money
        is_featured featured bool""")),
    "sv_reward_coupon": View("SvRewardCoupon", _spec("""
        sv_party sv text
        round_number round.number long
        sv_weight weight long
        beneficiary_party beneficiary text""")),
    "validator_reward_coupon": View("ValidatorRewardCoupon", _spec("""
        user_party user text
        validator_party validator text
        round_number round.number long""")),
    "unclaimed_reward": View("UnclaimedReward", _spec("""
        dso_party dso text
        reward_amount amount money""")),
    "member_traffic": View("MemberTraffic", _spec("""
        member_id memberId text
        traffic_synchronizer_id synchronizerId text
        round_number round.number long
        total_traffic_purchased totalTrafficPurchased long
        traffic_migration_id migrationId long""")),
    "featured_app_right": View("FeaturedAppRight", _spec("""
        dso_party dso text
        provider_party provider text""")),
    "ans_entry": View("AnsEntry", _spec("""
        user_party user text
        ans_name name text
        ans_url url text
        description description text
        expires_at expiresAt time""")),
    "open_mining_round": View("OpenMiningRound", _spec("""
        round_number round.number long
        amulet_price amuletPrice money
        opens_at opensAt time
        target_closes_at targetClosesAt time
        issuing_for_round issuingFor.number long
        create_fee_usd transferConfigUsd.createFee.fee money
        holding_fee_rate transferConfigUsd.holdingFee.rate money
        transfer_fee_rate transferConfigUsd.transferFee.initialRate money""")),
    "closed_mining_round": View("ClosedMiningRound", _spec("round_number round.number long")),
    "issuing_mining_round": View("IssuingMiningRound", _spec("""
        round_number round.number long
        amulet_to_issue_per_year issuanceConfig.amuletToIssuePerYear money
        validator_reward_pct issuanceConfig.validatorRewardPercentage money
        app_reward_pct issuanceConfig.appRewardPercentage money
        sv_reward_pct issuanceConfig.svRewardPercentage money""")),
    "validator_faucet_coupon": View("ValidatorFaucetCoupon", _spec("""
        validator_party validator text
        round_number round.number long""")),
    "validator_liveness": View("ValidatorLivenessActivityRecord", _spec("""
        validator_party validator text
        round_number round.number long
        active_synchronizer_id domain text
        traffic_received activityRecord.trafficReceived long
        last_active_at activityRecord.lastActiveAt time""")),
    "dso_rules": View("DsoRules", _spec("""
        epoch epoch long
        dso_delegate dsoDelegate text
        traffic_threshold config.numMemberTrafficContractsThreshold long
        unclaimed_rewards_threshold config.numUnclaimedRewardsThreshold long
        action_confirmation_timeout config.actionConfirmationTimeout text
        sv_onboarding_timeout config.svOnboardingRequestTimeout text
        vote_request_timeout config.voteRequestTimeout text
        sv_count svs size""")),
    "vote_request": View("VoteRequest", _spec("""
        requester_party requester text
        action_category action.tag text
        action_type action.value.tag text
        target_party action.value.value.sv|action.value.value.validator|action.value.value.provider|action.value.value.user text
        reason_url reason.url text
        reason_body reason.body text
        expires_at expiresAt time
        tracking_cid trackingCid text
        vote_count votes size""")),
    "votes": View("VoteRequest", _spec("""
        vote_accepted accept bool
        vote_reason reason.body text
        vote_reason_url reason.url text"""), explode=("votes", "voter")),
    "sv_membership": View("DsoRules", _spec("""
        sv_name name text
        sv_weight weight long
        joined_at joinedAt time
        participant_id participantId text"""), explode=("svs", "sv_party")),
    "confirmation": View("Confirmation", _spec("""
        action_category action.tag text
        action_type action.value.tag text
        confirmed_by confirmedBy list
        confirmation_count confirmedBy size""")),
    "election_request": View("ElectionRequest", _spec("""
        epoch epoch long
        first_candidate ranking[0].sv text
        first_rank ranking[0].rank long
        candidates_count ranking size""")),
    "sv_node_state": View("SvNodeState", _spec("""
        sv_party sv text
        sv_name name text
        synchronizer_nodes_json state.synchronizerNodes json""")),
    "sv_reward_state": View("SvRewardState", _spec("""
        sv_party sv text
        round_number round.number long""")),
    "amulet_price_vote": View("AmuletPriceVote", _spec("""
        sv_party sv text
        round_number round.number long
        voted_price amuletPrice money""")),
    "transfer_command": View("TransferCommand", _spec("""
        sender_party sender text
        provider_party provider text
        receiver_party receiverParty text
        nonce nonce long""")),
    "transfer_counter": View("TransferCommandCounter", _spec("""
        sender_party sender text
        next_nonce nextNonce long""")),
    "exercised_events": View(None, _spec("result_round result:round.number long"), ("exercised",), (*_CHOICE, "template_id", "acting_parties", "child_event_count")),
    "dso_rules_choices": View(None, _spec("""
        action_category action.tag text
        action_type action.value.tag text
        vote_accepted vote.accept bool
        vote_reason vote.reason.body text"""), ("exercised",), _CHOICE, "template_id LIKE '%:DsoRules' OR choice LIKE 'DsoRules!_%' ESCAPE '!'"),
    "amulet_rules_choices": View("AmuletRules", _spec("provider_party provider text"), ("exercised",), _CHOICE),
    "transfer_operations": View(None, _spec("""
        sender_party transfer.sender text
        receiver_party transfer.receivers[0].party text
        input_amount result:summary.inputAmuletAmount money
        amount_transferred result:summary.balanceChanges[0].changeToInitialAmountAsOfRoundZero money
        sender_fee result:summary.senderChangeFee money
        amulet_price_at_transfer result:summary.amuletPrice money
        round_number result:round.number long"""), ("exercised",), _CHOICE, "choice IN ('AmuletRules_Transfer', 'Transfer')"),
    "traffic_purchases": View(None, _spec("""
        buyer_party buyer text
        member_id memberId text
        traffic_amount trafficAmount long
        amulet_paid result:summary.inputAmuletAmount money
        round_number result:round.number long"""), ("exercised",), _CHOICE, "choice LIKE '%BuyMemberTraffic%'"),
    "mining_round_choices": View(None, _spec("round_number round.number|result:round.number long"), ("exercised",), _CHOICE, "template_id LIKE '%Round:%' OR template_id LIKE '%.Round:%'"),
    "vote_request_choices": View(None, _spec("""
        vote_accept vote.accept bool
        vote_reason vote.reason.body text"""), ("exercised",), _CHOICE, "choice LIKE '%Vote%' OR choice LIKE '%DsoRules!_%' ESCAPE '!'"),
    "interface_exercises": View(None, (), ("exercised",), (*_CHOICE, "interface_id"), "interface_id IS NOT NULL"),
    "reward_claims": View(None, _spec("round_number round.number long"), ("exercised",), (*_CHOICE, "template_id", "reward_type", "acting_parties"), "choice LIKE '%Claim%' OR choice LIKE '%Collect%' OR template_id LIKE '%RewardCoupon'"),
}

#: Columns of events that views may keep but that are derived, as SQL that both engines read.
DERIVED = {
    "child_event_count": "cardinality(child_event_ids)",
    "reward_type": "CASE WHEN template_id LIKE '%:AppRewardCoupon' THEN 'app' WHEN template_id LIKE '%:SvRewardCoupon' THEN 'sv' WHEN template_id LIKE '%:ValidatorRewardCoupon' THEN 'validator' ELSE 'other' END",
}


def _typed(text: Column, kind: str) -> Column:
    if kind == LONG:
        return text.try_cast(MONEY).try_cast("long")
    if kind == DECIMAL:
        return text.try_cast(MONEY)
    if kind == BOOL:
        return text.try_cast("boolean")
    if kind == TIME:
        return F.try_to_timestamp(text)
    if kind == LIST:
        return F.from_json(text, T.ArrayType(T.StringType()))
    if kind == SIZE:
        return F.coalesce(F.json_array_length(text).cast("long"), F.size(F.json_object_keys(text)).cast("long"))
    return text


def _nested(paths: list[str]) -> T.StructType:
    """The struct of text leaves that holds all the given plain paths (a leaf that others go through stays text)."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})
    build = lambda node: T.StructType([T.StructField(k, build(v) if v else T.StringType()) for k, v in node.items()])
    return build(tree)


def _reader(columns: tuple[tuple[str, str, str], ...], payload: Column, result: Column | None):
    """path -> text column. Plain leaf paths of a payload are parsed once, by one schema; paths with an index, or of
    whole objects, are read on their own."""
    every = [p for _, alternatives, _ in columns for p in alternatives.split("|")]
    whole = {p for _, a, kind in columns for p in a.split("|") if kind in (JSON, HAS, SIZE)}

    def plain(p: str) -> bool:
        return "[" not in p and p not in whole and not any(o != p and o.startswith(p + ".") for o in every) and not any(p.startswith(w + ".") for w in whole)

    parsed = {}
    for mark, source in (("", payload), ("result:", result)):
        own = [p[len(mark) :] for p in every if (p.startswith("result:") == bool(mark)) and plain(p)]
        if own and source is not None:
            parsed[mark] = (F.from_json(source, _nested(own)), set(own))

    def read(path: str) -> Column:
        mark = "result:" if path.startswith("result:") else ""
        bare = path[len(mark) :]
        if mark in parsed and bare in parsed[mark][1]:
            out = parsed[mark][0]
            for part in bare.split("."):
                out = out[part]
            return out
        return F.get_json_object(result if mark else payload, "$." + bare)

    return read


def template_view(events: DataFrame, name: str) -> DataFrame:
    """The typed rows of one view. Text that does not parse as its type is null; a row is never dropped for it."""
    view = VIEWS[name]
    rows = events.where(F.col("event_type").isin(*view.events))
    if view.entity:
        rows = rows.where(of_entity(events, view.entity))
    if view.where:
        rows = rows.where(view.where)
    kept = [F.expr(DERIVED[c]).cast("long" if c == "child_event_count" else "string").alias(c) if c in DERIVED else F.col(c) for c in view.keep]
    payload = F.col("payload")
    if view.explode:
        path, key = view.explode
        entries = F.from_json(F.get_json_object(payload, "$." + path), T.MapType(T.StringType(), T.StringType()))
        rows = rows.select("*", F.explode(entries).alias(key, "entry_json"))
        kept.append(F.col(key))
        payload = F.col("entry_json")
    result = F.col("exercise_result") if "exercise_result" in events.columns else None
    read = _reader(view.columns, payload, result)
    out = []
    for column, alternatives, kind in view.columns:
        text = F.coalesce(*[read(p) for p in alternatives.split("|")])
        out.append((text.isNotNull() if kind == HAS else _typed(text, kind)).alias(column))
    typed = rows.select(*kept, *out)
    if name == "locked_amulet":
        lock = F.when(F.col("time_locked"), "time_locked").when(F.size("lock_holders") > 0, "holder_locked").otherwise("unknown")
        typed = typed.withColumn("lock_type", lock).drop("time_locked")
    if name == "validator_license":
        typed = typed.withColumn("active_round_span", F.col("last_received_round") - F.col("first_received_round"))
    return typed


def transactions(updates: DataFrame) -> DataFrame:
    """Transaction updates with their trace ids."""
    return updates.where("update_type = 'transaction'").select(
        "update_id", "migration_id", "synchronizer_id", "effective_at", "event_count",
        F.get_json_object("trace_context", "$.traceId").alias("trace_id"), F.get_json_object("trace_context", "$.spanId").alias("span_id"),
    )


def reassignments(updates: DataFrame) -> DataFrame:
    """Reassignment updates with their synchronizers and counter."""
    return updates.where("update_type = 'reassignment'").select("update_id", "migration_id", "effective_at", "source_synchronizer", "target_synchronizer", "reassignment_counter")
