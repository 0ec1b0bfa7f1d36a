"""Lifecycle and aggregate queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import json_text, money
from ledgerloom.operators import lifecycle as L
from ledgerloom.operators import metrics as M
from ledgerloom.operators.views import template_view
from ledgerloom.plans.digest import plain
from ledgerloom.plans.oracles import sql
from ledgerloom.sources import derive

#: The clock of all queries.
AS_OF_TEXT = "2024-02-01 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def as_of():
    return F.lit(AS_OF_TEXT).cast("timestamp")


def add(name: str, query: Callable[[Callable[[str], DataFrame]], DataFrame], text: str, *ctes: str) -> None:
    """query gets a function that reads a ledger frame by name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(query(lambda frame: getattr(derive, frame)(spark, sf_dir)))

    QUERIES[name] = run
    ORACLE_SQL[name] = sql(text, *ctes)


def T(c: str, alias: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {alias or c}"


def D(c: str, alias: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {alias or c}"


def R(c: str, alias: str) -> str:
    return f"round(CAST({c} AS DOUBLE), 6) AS {alias}"


def J(path: str, column: str = "payload") -> str:
    return f"json_extract_string({column}, '$.{path}')"


def MONEY(path: str, column: str = "payload") -> str:
    return f"TRY_CAST({J(path, column)} AS DECIMAL(38, 10))"


def IS(entity: str) -> str:
    return f"template_id LIKE '%:{entity}'"


NOW = f"TIMESTAMP '{AS_OF_TEXT}'"


def archived(entity: str) -> str:
    return f"arch AS (SELECT contract_id, min(effective_at) AS archived_at FROM ev WHERE event_type = 'archived' AND {IS(entity)} GROUP BY contract_id)"


def trunc_diff(unit: str, a: str, b: str) -> str:
    """Whole units between two times, as timestampdiff gives them."""
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
    return f"CAST(trunc((epoch_us({b}) - epoch_us({a})) / {seconds * 1_000_000}.0) AS BIGINT)"


E = "ledger_events"
U = "ledger_updates"

add("daily_mint_burn", lambda f: L.daily_mint_burn(f(E)), f"""
SELECT {D("coalesce(c.event_date, a.event_date)", "event_date")}, {R("coalesce(minted_amount, 0)", "minted_amount")}, coalesce(mint_count, 0) AS mint_count, coalesce(burn_count, 0) AS burn_count
FROM (SELECT event_date, sum({MONEY("amount.initialAmount")}) AS minted_amount, count(*) AS mint_count FROM ev WHERE event_type = 'created' AND {IS("Amulet")} GROUP BY event_date) c
FULL JOIN (SELECT event_date, count(*) AS burn_count FROM ev WHERE event_type = 'archived' AND {IS("Amulet")} GROUP BY event_date) a USING (event_date)""")

add("amulet_lifecycle", lambda f: L.amulet_lifecycle(f(E), as_of()), f"""
SELECT contract_id, event_id, {J("owner")} AS owner_party, {R(MONEY("amount.initialAmount"), "initial_amount")}, TRY_CAST({J("amount.createdAt.number")} AS BIGINT) AS created_at_round,
  {T("effective_at", "created_at")}, {T("archived_at")}, CASE WHEN archived_at IS NULL THEN 'active' ELSE 'archived' END AS status,
  {trunc_diff("second", "effective_at", f"coalesce(archived_at, {NOW})")} AS lifespan_seconds
FROM ev LEFT JOIN arch USING (contract_id) WHERE event_type = 'created' AND {IS("Amulet")}""", archived("Amulet"))

add("proposal_lifecycle", lambda f: L.proposal_lifecycle(f(E), as_of()), f"""
SELECT contract_id, {T("effective_at", "created_at")}, {J("requester")} AS requester_party, {J("action.tag")} AS action_category, {J("action.value.tag")} AS action_type,
  {T(f"TRY_CAST({J('expiresAt')} AS TIMESTAMP)", "expires_at")}, {T("archived_at")},
  CASE WHEN archived_at IS NOT NULL THEN 'completed' WHEN TRY_CAST({J("expiresAt")} AS TIMESTAMP) < {NOW} THEN 'expired' ELSE 'active' END AS status,
  {trunc_diff("hour", "effective_at", f"coalesce(archived_at, {NOW})")} AS duration_hours
FROM ev LEFT JOIN arch USING (contract_id) WHERE event_type = 'created' AND {IS("VoteRequest")}""", archived("VoteRequest"))

add("round_lifecycle", lambda f: L.round_lifecycle(f(E), as_of()), f"""
SELECT round_number, {T("opened_at")}, {T("closed_at")}, {R("amulet_price", "amulet_price")}, {T("target_closes_at")}, CASE WHEN closed_at IS NOT NULL THEN 'closed' ELSE 'open' END AS status,
  {trunc_diff("minute", "opened_at", f"coalesce(closed_at, {NOW})")} AS duration_minutes
FROM (SELECT TRY_CAST({J("round.number")} AS BIGINT) AS round_number, min(effective_at) AS opened_at, arg_min({MONEY("amuletPrice")}, {{'a': effective_at, 'b': contract_id}}) AS amulet_price,
        min(TRY_CAST({J("targetClosesAt")} AS TIMESTAMP)) AS target_closes_at FROM ev WHERE event_type = 'created' AND {IS("OpenMiningRound")} GROUP BY 1)
LEFT JOIN (SELECT TRY_CAST({J("round.number")} AS BIGINT) AS round_number, min(effective_at) AS closed_at FROM ev WHERE event_type = 'created' AND {IS("ClosedMiningRound")} GROUP BY 1) USING (round_number)""")

VALIDATORS = f"""vl AS (
SELECT contract_id, {J("validator")} AS validator_party, {J("sponsor")} AS sponsor_party, CASE WHEN archived_at IS NULL THEN 'active' ELSE 'inactive' END AS status,
  coalesce(user_count, 0) AS user_count, coalesce(reward_count, 0) AS reward_count, first_reward_round, last_reward_round, {trunc_diff("day", "effective_at", f"coalesce(archived_at, {NOW})")} AS age_days
FROM ev LEFT JOIN arch USING (contract_id)
LEFT JOIN (SELECT {J("validator")} AS v, count(DISTINCT {J("user")}) AS user_count FROM ev WHERE event_type = 'created' AND {IS("ValidatorRight")} GROUP BY 1) r ON r.v = {J("validator")}
LEFT JOIN (SELECT {J("validator")} AS v, count(*) AS reward_count, min(TRY_CAST({J("round.number")} AS BIGINT)) AS first_reward_round, max(TRY_CAST({J("round.number")} AS BIGINT)) AS last_reward_round
           FROM ev WHERE event_type = 'created' AND {IS("ValidatorRewardCoupon")} GROUP BY 1) c ON c.v = {J("validator")}
WHERE event_type = 'created' AND {IS("ValidatorLicense")})"""
add("validator_lifecycle", lambda f: L.validator_lifecycle(f(E), as_of()), "SELECT * FROM vl", archived("ValidatorLicense"), VALIDATORS)
add("validator_performance", lambda f: M.validator_performance(L.validator_lifecycle(f(E), as_of())), f"""
SELECT contract_id, validator_party, status, reward_count, last_reward_round - first_reward_round + 1 AS round_span,
  {R("CASE WHEN last_reward_round - first_reward_round + 1 > 0 THEN CAST(reward_count AS DOUBLE) / (last_reward_round - first_reward_round + 1) ELSE 0 END", "rewards_per_round")} FROM vl""", archived("ValidatorLicense"), VALIDATORS)

add("active_contracts", lambda f: L.active_contracts(f(E), "Amulet").drop("payload"), f"""
SELECT contract_id, template_id, {T("effective_at", "created_at")} FROM ev WHERE event_type = 'created' AND {IS("Amulet")}
AND contract_id NOT IN (SELECT contract_id FROM ev WHERE event_type = 'archived')""")

REWARDS = f"""rewards AS (
SELECT event_id, contract_id, event_type, event_date, effective_at,
  CASE WHEN {IS("AppRewardCoupon")} THEN 'app' WHEN {IS("SvRewardCoupon")} THEN 'sv' ELSE 'validator' END AS reward_type,
  CASE WHEN {IS("AppRewardCoupon")} THEN {J("provider")} WHEN {IS("SvRewardCoupon")} THEN {J("sv")} ELSE {J("validator")} END AS recipient_party,
  TRY_CAST({J("round.number")} AS BIGINT) AS round_number, CASE WHEN {IS("AppRewardCoupon")} THEN {MONEY("amount")} END AS reward_amount,
  CASE WHEN {IS("SvRewardCoupon")} THEN TRY_CAST({MONEY("weight")} AS BIGINT) END AS sv_weight, CASE WHEN {IS("AppRewardCoupon")} THEN TRY_CAST({J("featured")} AS BOOLEAN) END AS is_featured,
  CASE WHEN {IS("ValidatorRewardCoupon")} THEN {J("user")} END AS user_party, CASE WHEN {IS("SvRewardCoupon")} THEN {J("beneficiary")} END AS beneficiary_party
FROM ev WHERE {IS("AppRewardCoupon")} OR {IS("SvRewardCoupon")} OR {IS("ValidatorRewardCoupon")})"""


def add_rewards(name: str, query: Callable[[DataFrame], DataFrame], text: str, *ctes: str) -> None:
    add(name, lambda f: query(L.all_rewards(f(E))), text, REWARDS, *ctes)


add_rewards("all_rewards", lambda r: r, f"SELECT * EXCLUDE (event_date, effective_at, reward_amount), {D('event_date')}, {T('effective_at')}, {R('reward_amount', 'reward_amount')} FROM rewards")
WEIGHTS = """FROM (SELECT * FROM rewards WHERE reward_type = 'sv' AND event_type = 'created' QUALIFY row_number() OVER (PARTITION BY recipient_party, round_number ORDER BY effective_at DESC, contract_id DESC) = 1)"""
add_rewards("sv_weight_history", L.sv_weight_history, f"""
SELECT recipient_party, round_number, sv_weight, lag(sv_weight) OVER w AS previous_weight, sv_weight - lag(sv_weight) OVER w AS weight_change {WEIGHTS}
WINDOW w AS (PARTITION BY recipient_party ORDER BY round_number)""")
add_rewards("sv_weight_history_by_coupon", lambda r: L.sv_weight_history(r, dedup_first=False), """
SELECT recipient_party, round_number, sv_weight, previous_weight, sv_weight - previous_weight AS weight_change FROM (
  SELECT *, lag(sv_weight) OVER (PARTITION BY recipient_party ORDER BY round_number, effective_at, contract_id) AS previous_weight,
         row_number() OVER (PARTITION BY recipient_party, round_number ORDER BY effective_at DESC, contract_id DESC) AS rank FROM rewards WHERE reward_type = 'sv' AND event_type = 'created') WHERE rank = 1""")
add_rewards("rewards_by_round_long", M.rewards_by_round_long, f"""
SELECT round_number, reward_type, event_type, count(*) AS coupons, count(DISTINCT recipient_party) AS recipients, {R("sum(reward_amount)", "amount")}, count(*) FILTER (is_featured) AS featured FROM rewards GROUP BY ALL""")
add_rewards("rewards_by_recipient", M.rewards_by_recipient, f"""
SELECT recipient_party, reward_type, count(*) AS coupons, {R("sum(reward_amount)", "amount")}, count(DISTINCT round_number) AS active_rounds, min(round_number) AS first_round, max(round_number) AS last_round
FROM rewards WHERE event_type = 'created' GROUP BY recipient_party, reward_type""")
add_rewards("app_provider_leaderboard", M.app_provider_leaderboard, f"""
SELECT recipient_party AS provider_party, count(*) AS coupons, {R("sum(reward_amount)", "amount")}, count(*) FILTER (is_featured) AS featured, {T("min(effective_at)", "first_reward")}, {T("max(effective_at)", "last_reward")}
FROM rewards WHERE event_type = 'created' AND reward_type = 'app' GROUP BY recipient_party""")
add_rewards("validator_reward_performance", M.validator_reward_performance, """
SELECT recipient_party AS validator_party, user_party, count(*) AS coupons, count(DISTINCT round_number) AS rounds, min(round_number) AS first_round, max(round_number) AS last_round
FROM rewards WHERE event_type = 'created' AND reward_type = 'validator' GROUP BY recipient_party, user_party""")
add_rewards("rewards_by_round", M.rewards_by_round, f"""
SELECT round_number, {D("min(event_date)", "round_date")}, count(*) AS coupons, count(*) FILTER (reward_type = 'app') AS app_coupons, count(*) FILTER (reward_type = 'sv') AS sv_coupons,
  count(*) FILTER (reward_type = 'validator') AS validator_coupons, count(DISTINCT recipient_party) FILTER (reward_type = 'app') AS app_recipients, count(DISTINCT recipient_party) FILTER (reward_type = 'sv') AS sv_recipients,
  count(DISTINCT recipient_party) FILTER (reward_type = 'validator') AS validator_recipients, {R("sum(reward_amount) FILTER (reward_type = 'app')", "app_amount")}, count(*) FILTER (is_featured) AS featured, CAST(sum(sv_weight) AS BIGINT) AS sv_weight
FROM rewards WHERE event_type = 'created' GROUP BY round_number""")
add_rewards("reward_leaderboard", M.reward_leaderboard, f"""
SELECT recipient_party, reward_type, count(DISTINCT contract_id) AS coupons, {R("sum(reward_amount)", "amount")}, {R("avg(CAST(coalesce(reward_amount, 0) AS DOUBLE))", "average")}, count(DISTINCT round_number) AS rounds,
  min(round_number) AS first_round, max(round_number) AS last_round, {D("min(event_date)", "first_date")}, {D("max(event_date)", "last_date")}, count(DISTINCT event_date) AS days FROM rewards WHERE event_type = 'created' GROUP BY recipient_party, reward_type""")
add_rewards("reward_weight_by_round", M.reward_weight_by_round, """
SELECT round_number, count(*) AS coupons, CAST(sum(sv_weight) AS BIGINT) AS weight, count(DISTINCT recipient_party) AS providers FROM rewards WHERE reward_type = 'sv' AND event_type = 'created' GROUP BY round_number""")

ISSUANCE = f"""issuance AS (
SELECT round_number, reward_type, avg(rate) AS rate FROM (SELECT TRY_CAST({J("round.number")} AS BIGINT) AS round_number, TRY_CAST({J("amuletPrice")} AS DOUBLE) AS rate, unnest(['sv', 'validator']) AS reward_type
  FROM ev WHERE event_type = 'created' AND {IS("IssuingMiningRound")}) GROUP BY ALL),
calc AS (
SELECT event_id, recipient_party, reward_type, coalesce(r.round_number, 0) AS round_number, effective_at,
  CASE WHEN coalesce(reward_amount, 0) <> 0 THEN CAST(reward_amount AS DOUBLE) WHEN coalesce(sv_weight, 0) > 0 AND rate IS NOT NULL THEN sv_weight * rate ELSE CAST(coalesce(sv_weight, 0) AS DOUBLE) END AS amount,
  CASE WHEN coalesce(reward_amount, 0) <> 0 THEN 'direct' WHEN coalesce(sv_weight, 0) > 0 AND rate IS NOT NULL THEN 'issuance' ELSE 'weight' END AS amount_source
FROM rewards r LEFT JOIN issuance i USING (round_number, reward_type) WHERE event_type = 'created')"""


def _issuance(events: DataFrame) -> DataFrame:
    """Issuance rate per round and coupon kind: the mean over the round's issuing contracts."""
    p = F.col("payload")
    rows = events.where("event_type = 'created'").where(F.col("template_id").endswith(":IssuingMiningRound"))
    rows = rows.select(json_text(p, "round.number").try_cast("long").alias("round_number"), json_text(p, "amuletPrice").try_cast("double").alias("rate"), F.explode(F.array(F.lit("sv"), F.lit("validator"))).alias("reward_type"))
    return rows.groupBy("round_number", "reward_type").agg(F.avg("rate").alias("rate"))


add("reward_calculation", lambda f: M.reward_calculation(L.all_rewards(f(E)), _issuance(f(E))), f"SELECT event_id, recipient_party, reward_type, round_number, {T('effective_at')}, {R('amount', 'amount')}, amount_source FROM calc", REWARDS, ISSUANCE)
add("reward_totals", lambda f: M.reward_totals(M.reward_calculation(L.all_rewards(f(E)), _issuance(f(E)))), f"SELECT recipient_party, round_number, count(*) AS coupons, {R('sum(amount)', 'amount')} FROM calc GROUP BY ROLLUP (recipient_party, round_number)", REWARDS, ISSUANCE)

PROPOSALS = f"""proposals AS (
SELECT proposal_id, contract_id, action_type, {T("effective_at", "latest_at")}, votes_for, votes_against, merged,
  CASE WHEN votes_for >= 2 THEN 'passed' WHEN over AND votes_for + votes_against = 0 THEN 'expired' ELSE 'failed' END AS status
FROM (SELECT *, archived_at IS NOT NULL OR TRY_CAST({J("voteBefore")} AS TIMESTAMP) < {NOW} AS over, {J("action.value.dsoAction.tag")} AS action_type
      FROM (SELECT *, {J("trackingCid")} AS proposal_id, CAST(len(list_filter(json_extract_string(payload, '$.votes.*.accept'), lambda v: v = 'true')) AS BIGINT) AS votes_for,
                   CAST(len(list_filter(json_extract_string(payload, '$.votes.*.accept'), lambda v: v <> 'true')) AS BIGINT) AS votes_against FROM ev WHERE event_type = 'created' AND {IS("VoteRequest")})
      LEFT JOIN arch USING (contract_id)
      QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY effective_at DESC, contract_id DESC) = 1) p
JOIN (SELECT {J("trackingCid")} AS proposal_id, count(*) AS merged FROM ev WHERE event_type = 'created' AND {IS("VoteRequest")} GROUP BY 1) USING (proposal_id))"""
add("unique_proposals", lambda f: L.unique_proposals(f(E), as_of(), threshold=2), "SELECT * FROM proposals", archived("VoteRequest"), PROPOSALS)

add("first_actions", lambda f: L.first_actions(f(E)), f"""
SELECT kind, contract_id, event_id, event_type, {T("effective_at", "first_seen")} FROM (
  SELECT *, CASE WHEN {IS("VoteRequest")} THEN 'vote' WHEN {IS("DsoRules")} THEN 'rule_change' WHEN {IS("Confirmation")} THEN 'confirmation' END AS kind FROM ev)
WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind, contract_id ORDER BY effective_at, event_id) = 1""")



def _both_origins(f: Callable[[str], DataFrame]) -> DataFrame:
    every = L.unique_proposals(f(E), as_of(), threshold=2).select("proposal_id", "status", "latest_at", "merged")
    active, historical = every, every.where("status <> 'failed'")
    return L.all_proposals(active.withColumn("origin", F.lit("active")), historical.withColumn("origin", F.lit("historical"))).drop("merged")


add("all_proposals", _both_origins, """
SELECT proposal_id, status, latest_at, CASE WHEN status <> 'failed' THEN 'historical' ELSE 'active' END AS origin FROM proposals""", archived("VoteRequest"), PROPOSALS)

APPROVED = "approvals AS (SELECT 'p' || u AS party, min(k) + 3 AS round FROM base WHERE id % 9 = 0 GROUP BY u)"


def add_base(name: str, query: Callable[[SparkSession, str], DataFrame], text: str, *ctes: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(query(spark, sf_dir))
    ORACLE_SQL[name] = sql(text, *ctes)


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.ledger_base(spark, sf_dir).where("id % 9 = 0").groupBy(F.concat(F.lit("p"), F.col("u").cast("string")).alias("party")).agg((F.min("k") + 3).alias("round"))


AT_APPROVAL = """before AS (SELECT a.party, a.round, coalesce((SELECT arg_max(r.cumulative_app_rewards, r.closed_round) FROM rpt r WHERE r.party = a.party AND r.closed_round <= a.round), 0) AS rewards FROM approvals a)"""
add_base("as_of_rewards", lambda s, d: L.as_of_rewards(approvals(s, d), derive.round_party_totals(s, d)), f"SELECT party, round, {R('rewards', 'rewards_at_approval')} FROM before", APPROVED, AT_APPROVAL)
add_base("reward_milestones", lambda s, d: L.reward_milestones(derive.round_party_totals(s, d), approvals(s, d), (500.0, 2500.0)), f"""
SELECT party, t AS threshold, reached_round, {R("(reached_round - round) * 600 / 86400.0", "days_from_approval")}, {R("rewards", "before")}, {R("greatest(0, total - rewards)", "after")}
FROM (SELECT party, t, min(closed_round) FILTER (cumulative_app_rewards >= t) AS reached_round, max(cumulative_app_rewards) AS total FROM rpt, (VALUES (500.0::DOUBLE), (2500.0::DOUBLE)) v(t) GROUP BY party, t) JOIN before USING (party)""", APPROVED, AT_APPROVAL)

STEPS = ((0, "start"), (86_400 * 5, "growth"), (86_400 * 20, "steady"))
add("issuance_stage", lambda f: L.step_at(f("ledger_base").select("id", F.timestamp_diff("SECOND", F.lit("2024-01-03 00:00:00").cast("timestamp"), F.col("ts")).alias("elapsed")), "elapsed", STEPS), f"""
SELECT id, elapsed, CASE WHEN elapsed >= {86_400 * 20} THEN 'steady' WHEN elapsed >= {86_400 * 5} THEN 'growth' WHEN elapsed >= 0 THEN 'start' END AS stage
FROM (SELECT id, {trunc_diff("second", "TIMESTAMP '2024-01-03 00:00:00'", "ts")} AS elapsed FROM base)""")

add("prefix_lookup", lambda f: L.prefix_lookup(
    f("ledger_base").where("id % 4 = 0").select(F.expr("concat('x', lpad(cast(id as string), 19, '0'))").alias("id"), F.expr("case when k < 50 then 'open' else 'closed' end").alias("status")),
    f("ledger_base").where("id % 6 = 0").select(F.expr("concat('x', lpad(cast(id as string), 19, '0'))").alias("id"), F.expr("case when k < 40 then 'open' else 'closed' end").alias("status")), 19), """
SELECT prefix, external_id, indexed_id, CASE WHEN external_id IS NULL THEN 'extra' WHEN indexed_id IS NULL THEN 'missing' WHEN ours = status THEN 'found' ELSE 'status_mismatch' END AS outcome
FROM (SELECT left('x' || lpad(CAST(id AS VARCHAR), 19, '0'), 19) AS prefix, 'x' || lpad(CAST(id AS VARCHAR), 19, '0') AS external_id, CASE WHEN k < 50 THEN 'open' ELSE 'closed' END AS status FROM base WHERE id % 4 = 0) e
FULL JOIN (SELECT left('x' || lpad(CAST(id AS VARCHAR), 19, '0'), 19) AS prefix, min('x' || lpad(CAST(id AS VARCHAR), 19, '0')) AS indexed_id,
                  arg_min(CASE WHEN k < 40 THEN 'open' ELSE 'closed' END, id) AS ours FROM base WHERE id % 6 = 0 GROUP BY 1) i USING (prefix)""")  # fmt: skip

add("updates_summary", lambda f: M.updates_summary(f(U)), f"""
SELECT {D("record_date")}, update_type, migration_id, count(*) AS update_count, CAST(sum(event_count) AS BIGINT) AS total_events, {T("min(record_time)", "first_record")}, {T("max(record_time)", "last_record")} FROM up GROUP BY record_date, update_type, migration_id""")
add("daily_activity", lambda f: M.daily_activity(f(U)), f"""
SELECT {D("record_date")}, count(DISTINCT update_id) AS transactions, CAST(sum(event_count) AS BIGINT) AS events, count(DISTINCT synchronizer_id) AS synchronizers FROM up GROUP BY record_date""")
add("governance_action_summary", lambda f: M.governance_action_summary(f(E)), f"""
SELECT {D("event_date")}, {J("action.tag")} AS action_category, coalesce({J("action.value.dsoAction.tag")}, {J("action.value.tag")}, {J("action.tag")}) AS action_type, event_type, count(*) AS actions, count(DISTINCT {J("requester")}) AS requesters
FROM ev WHERE {IS("VoteRequest")} GROUP BY event_date, 2, 3, event_type""")
add("supply_over_time", lambda f: M.supply_over_time(f(E)), f"""
SELECT {D("event_date")}, {R(f"sum(CASE WHEN event_type = 'created' THEN {MONEY('amount.initialAmount')} END)", "minted")}, count(*) FILTER (event_type = 'created') AS contracts_created,
  count(*) FILTER (event_type = 'archived') AS contracts_archived FROM ev WHERE {IS("Amulet")} GROUP BY event_date""")
add("daily_supply_metrics", lambda f: M.daily_supply_metrics(f(E)), f"""
SELECT {D("event_date", "supply_date")}, migration_id, count(*) FILTER (event_type = 'created') AS amulets_created, count(*) FILTER (event_type = 'archived') AS amulets_archived,
  {R(f"sum(CASE WHEN event_type = 'created' THEN {MONEY('amount.initialAmount')} END)", "minted")}, count(DISTINCT CASE WHEN event_type = 'created' THEN {J("owner")} END) AS recipients,
  min(TRY_CAST({J("amount.createdAt.number")} AS BIGINT)) AS min_round, max(TRY_CAST({J("amount.createdAt.number")} AS BIGINT)) AS max_round FROM ev WHERE {IS("Amulet")} GROUP BY event_date, migration_id""")
add("daily_network_metrics", lambda f: M.daily_network_metrics(f(E)), f"""
SELECT {D("event_date")}, count(*) FILTER ({IS("OpenMiningRound")} AND event_type = 'created') AS rounds_opened, count(*) FILTER ({IS("ClosedMiningRound")} AND event_type = 'created') AS rounds_closed,
  count(*) FILTER ({IS("MemberTraffic")} AND event_type = 'created') AS traffic_contracts, count(DISTINCT CASE WHEN {IS("MemberTraffic")} AND event_type = 'created' THEN {J("memberId")} END) AS traffic_members,
  count(*) FILTER ({IS("AnsEntry")} AND event_type = 'created') AS ans_entries, count(*) FILTER ({IS("AmuletPriceVote")} AND event_type = 'created') AS price_votes
FROM ev WHERE {" OR ".join(IS(e) for e in ("OpenMiningRound", "ClosedMiningRound", "MemberTraffic", "AnsEntry", "AmuletPriceVote"))} GROUP BY event_date""")
add("choice_frequency", lambda f: M.choice_frequency(f(E)), f"""
SELECT choice, template_id, consuming, count(*) AS exercises, {T("min(effective_at)", "first_seen")}, {T("max(effective_at)", "last_seen")} FROM ev WHERE event_type = 'exercised' GROUP BY choice, template_id, consuming""")
add("daily_choice_stats", lambda f: M.daily_choice_stats(f(E)), f"""
SELECT {D("event_date")}, choice, count(*) AS exercises, count(*) FILTER (consuming) AS consuming, count(DISTINCT contract_id) AS contracts, count(DISTINCT update_id) AS updates,
  CAST(sum(len(child_event_ids)) AS BIGINT) AS child_events, {R("avg(len(child_event_ids))", "child_events_mean")} FROM ev WHERE event_type = 'exercised' GROUP BY event_date, choice""")
add("template_choice_map", lambda f: M.template_choice_map(f(E)), """
SELECT template_id, choice, count(*) AS exercises, count(*) FILTER (consuming) AS consuming, count(DISTINCT event_date) AS active_days FROM ev WHERE event_type = 'exercised' GROUP BY template_id, choice""")
add("event_type_counts", lambda f: M.event_type_counts(f(E), F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp")), """
SELECT event_type, count(*) FILTER (recorded_at > TIMESTAMP '2024-01-10') AS delta, count(*) AS total FROM ev WHERE recorded_at <= TIMESTAMP '2024-01-20' GROUP BY event_type""")
add("template_event_counts", lambda f: M.template_event_counts(f(E)), "SELECT template_id, event_type, count(*) AS events FROM ev GROUP BY ALL")
add("total_counts", lambda f: M.total_counts(f(E), f(U)), f"""
SELECT events, contracts, {T("first_event")}, {T("last_event")}, updates, declared_events FROM (SELECT count(*) AS events, count(DISTINCT contract_id) AS contracts, min(effective_at) AS first_event, max(effective_at) AS last_event FROM ev),
  (SELECT count(*) AS updates, CAST(sum(event_count) AS BIGINT) AS declared_events FROM up)""")
add("updates_daily", lambda f: M.updates_daily(f(U), as_of(), 10), f"SELECT {T('day')}, update_type, updates FROM (SELECT CAST(date_trunc('day', record_time) AS TIMESTAMP) AS day, update_type, count(*) AS updates FROM up WHERE record_time >= {NOW} - INTERVAL 10 DAY GROUP BY 1, 2)")
add("party_summary", lambda f: M.party_summary(f(E)), f"""
SELECT party, count(*) AS events, count(DISTINCT contract_id) AS contracts, count(DISTINCT template_id) AS templates, {T("min(effective_at)", "first_seen")}, {T("max(effective_at)", "last_seen")},
  count(*) FILTER (event_type = 'created') AS created, count(*) FILTER (event_type = 'archived') AS archived FROM (SELECT *, unnest(list_distinct(list_concat(signatories, observers))) AS party FROM ev) GROUP BY party""")
add("party_templates", lambda f: M.party_templates(f(E)), "SELECT party, template_id, count(*) AS events, count(DISTINCT contract_id) AS contracts FROM (SELECT *, unnest(list_distinct(list_concat(signatories, observers))) AS party FROM ev) GROUP BY party, template_id")
add("template_list", lambda f: M.template_list(f(E)), f"SELECT template_id, count(*) AS events, count(DISTINCT contract_id) AS contracts, {T('min(effective_at)', 'first_seen')}, {T('max(effective_at)', 'last_seen')} FROM ev GROUP BY template_id")
add("overview_stats", lambda f: M.overview_stats(f(E)), f"SELECT count(*) AS total_events, count(DISTINCT contract_id) AS unique_contracts, count(DISTINCT template_id) AS unique_templates, {T('min(effective_at)', 'earliest_event')}, {T('max(effective_at)', 'latest_event')} FROM ev")
for _unit in ("day", "hour"):
    add("daily_stats" if _unit == "day" else "hourly_stats", lambda f, u=_unit: M.period_stats(f(E), u), f"SELECT {T('period')}, event_count, contract_count FROM (SELECT CAST(date_trunc('{_unit}', effective_at) AS TIMESTAMP) AS period, count(*) AS event_count, count(DISTINCT contract_id) AS contract_count FROM ev GROUP BY 1)")
add("stats_by_type", lambda f: M.stats_by_type(f(E)), "SELECT event_type, count(*) AS event_count, count(DISTINCT contract_id) AS contract_count FROM ev GROUP BY event_type")

LATEST = "latest AS (SELECT * FROM acs WHERE snapshot_time = (SELECT max(snapshot_time) FROM acs))"
A = "ledger_acs"
BALANCES = f"""balances AS (
SELECT owner, sum(CASE WHEN NOT locked THEN amount ELSE 0 END) AS unlocked, sum(CASE WHEN locked THEN amount ELSE 0 END) AS locked, sum(amount) AS total FROM (
  SELECT CASE WHEN {IS("LockedAmulet")} THEN {J("amulet.owner")} ELSE {J("owner")} END AS owner, {IS("LockedAmulet")} AS locked,
         CASE WHEN {IS("LockedAmulet")} THEN {MONEY("amulet.amount.initialAmount")} ELSE {MONEY("amount.initialAmount")} END AS amount FROM latest WHERE {IS("LockedAmulet")} OR {IS("Amulet")}) GROUP BY owner)"""
add("latest_snapshot", lambda f: M.latest_snapshot(f(A)).drop("payload"), f"SELECT contract_id, template_id, migration_id, {T('record_time')}, {T('snapshot_time')}, array_to_string(signatories, ',') AS signatories, complete FROM latest", LATEST)
add("complete_snapshots", lambda f: M.complete_snapshots(f(A), f(A).where("complete").select("migration_id", "snapshot_time").distinct()).select("contract_id", "snapshot_time", "migration_id"), f"SELECT contract_id, {T('snapshot_time')}, migration_id FROM acs WHERE complete")
add("retained_snapshots", lambda f: M.retained_snapshots(f(A), 2).select("contract_id", "snapshot_time", "migration_id"), f"""
SELECT contract_id, {T("snapshot_time")}, migration_id FROM acs JOIN (SELECT DISTINCT migration_id, snapshot_time FROM acs QUALIFY dense_rank() OVER (PARTITION BY migration_id ORDER BY snapshot_time DESC) <= 2) USING (migration_id, snapshot_time)""")
add("holder_balances", lambda f: M.holder_balances(M.latest_snapshot(f(A))), f"SELECT owner, {R('unlocked', 'unlocked')}, {R('locked', 'locked')}, {R('total', 'total')} FROM balances", LATEST, BALANCES)
add("rich_list", lambda f: M.rich_list(M.holder_balances(M.latest_snapshot(f(A))), 25), f"""
SELECT owner, {R("unlocked", "unlocked")}, {R("locked", "locked")}, {R("total", "total")}, {R("(SELECT sum(total) FROM balances)", "supply")}, (SELECT count(*) FROM balances) AS holders FROM balances ORDER BY balances.total DESC, owner LIMIT 25""", LATEST, BALANCES)
add("supply_totals", lambda f: M.supply_totals(M.latest_snapshot(f(A))), f"SELECT {R('sum(unlocked)', 'unlocked')}, {R('sum(locked)', 'locked')}, {R('sum(total)', 'total')}, count(*) AS holders FROM balances", LATEST, BALANCES)
add("mining_rounds", lambda f: M.mining_rounds(M.latest_snapshot(f(A))), f"""
SELECT kind, count(*) AS rounds, min(round) AS first_round, max(round) AS last_round FROM (SELECT CASE WHEN {IS("OpenMiningRound")} THEN 'open' WHEN {IS("IssuingMiningRound")} THEN 'issuing' WHEN {IS("ClosedMiningRound")} THEN 'closed' END AS kind,
  TRY_CAST({J("round.number")} AS BIGINT) AS round FROM latest) WHERE kind IS NOT NULL GROUP BY kind""", LATEST)
add("acs_templates", lambda f: M.acs_templates(M.latest_snapshot(f(A))), f"SELECT template_id, contracts, {R('contracts * 100.0 / sum(contracts) OVER ()', 'percentage')} FROM (SELECT template_id, count(*) AS contracts FROM latest GROUP BY template_id)", LATEST)
add("acs_stats", lambda f: M.acs_stats(f(A)), f"SELECT {T('snapshot_time')}, migration_id, count(*) AS contracts, count(DISTINCT template_id) AS templates, {T('max(record_time)', 'last_record')} FROM acs GROUP BY snapshot_time, migration_id")
HELD_NOW = (
    "early AS (SELECT * FROM acs WHERE snapshot_time < TIMESTAMP '2024-01-25')",
    "since AS (SELECT * FROM ev WHERE effective_at > (SELECT max(snapshot_time) FROM early))",
    "latest AS (SELECT * FROM (SELECT contract_id, template_id, payload FROM early WHERE snapshot_time = (SELECT max(snapshot_time) FROM early)"
    " UNION ALL SELECT contract_id, template_id, payload FROM since WHERE event_type = 'created') WHERE contract_id NOT IN (SELECT contract_id FROM since WHERE event_type = 'archived'))",
)
add("realtime_supply", lambda f: M.realtime_supply(f(A).where("snapshot_time < timestamp '2024-01-25'"), f(E)), f"SELECT {R('sum(unlocked)', 'unlocked')}, {R('sum(locked)', 'locked')}, {R('sum(total)', 'total')}, count(*) AS holders FROM balances", *HELD_NOW, BALANCES)

_N = lambda path: f"CAST(coalesce({MONEY(path, 'exercise_result')}, 0) AS DOUBLE)"
_OUT = lambda at: f"coalesce(list_sum([coalesce(TRY_CAST(x AS DOUBLE), 0) FOR x IN json_extract_string(exercise_result, '$.{at}.outputFees[*]')]), 0)"
_FEES = lambda at: f"({_N(at + '.holdingFees')} + {_N(at + '.senderChangeFee')})"
BURN = f"""burnt AS (
SELECT update_id, event_date, event_id, child_event_ids, json_extract_string(exercise_result, '$.amulet') AS amulet,
  CASE WHEN choice = 'AmuletRules_BuyMemberTraffic' THEN 'traffic' WHEN choice = 'AmuletRules_Transfer' THEN 'transfer'
       WHEN choice IN ('SubscriptionInitialPayment_Collect', 'AnsEntryContext_CollectRenewalEntryPayment') THEN 'names' ELSE 'preapproval' END AS kind,
  CASE WHEN choice = 'AmuletRules_BuyMemberTraffic' THEN {_FEES("summary")} + {_N("amuletPaid")} WHEN choice = 'AmuletRules_Transfer' THEN {_FEES("summary")} + {_OUT("summary")}
       WHEN choice IN ('SubscriptionInitialPayment_Collect', 'AnsEntryContext_CollectRenewalEntryPayment') THEN 0
       ELSE {_N("amuletPaid")} + {_FEES("transferResult.summary")} + {_OUT("transferResult.summary")} END AS amount
FROM ev WHERE event_type = 'exercised' AND choice IN ('AmuletRules_BuyMemberTraffic', 'AmuletRules_Transfer', 'SubscriptionInitialPayment_Collect',
  'AnsEntryContext_CollectRenewalEntryPayment', 'AmuletRules_CreateTransferPreapproval', 'AmuletRules_CreateExternalPartySetupProposal', 'TransferPreapproval_Renew')),
burnt_parts AS (
SELECT update_id, event_date, kind, amount FROM burnt
UNION ALL SELECT b.update_id, b.event_date, 'names', CAST(coalesce({MONEY("amount.initialAmount")}, 0) AS DOUBLE) FROM burnt b
  JOIN ev e ON e.update_id = b.update_id AND e.event_type = 'created' AND (e.contract_id = b.amulet OR e.event_id = b.amulet) WHERE b.kind = 'names'
UNION ALL SELECT b.update_id, b.event_date, 'names', t.amount FROM (SELECT *, unnest(child_event_ids) AS child FROM burnt WHERE kind = 'names') b
  JOIN burnt t ON t.update_id = b.update_id AND t.event_id = b.child AND t.kind = 'transfer'),
burns AS (
SELECT update_id, event_date, coalesce(sum(amount) FILTER (kind = 'traffic'), 0) AS traffic, coalesce(sum(amount) FILTER (kind = 'transfer'), 0) AS transfer,
  coalesce(sum(amount) FILTER (kind = 'names'), 0) AS names, coalesce(sum(amount) FILTER (kind = 'preapproval'), 0) AS preapproval
FROM burnt_parts GROUP BY update_id, event_date)"""
_TOTAL = "traffic + transfer + names + preapproval"
add("burn_by_transaction", lambda f: M.burn_by_transaction(f(E)), f"SELECT update_id, {D('event_date')}, {R('traffic', 'traffic')}, {R('transfer', 'transfer')}, {R('names', 'names')}, {R('preapproval', 'preapproval')}, {R(_TOTAL, 'total')} FROM burns", BURN)
add("burn_by_day", lambda f: M.burn_by_day(M.burn_by_transaction(f(E))), f"SELECT {D('event_date')}, {R('sum(traffic)', 'traffic')}, {R('sum(transfer)', 'transfer')}, {R('sum(names)', 'names')}, {R('sum(preapproval)', 'preapproval')}, {R(f'sum({_TOTAL})', 'total')} FROM burns GROUP BY event_date", BURN)
add("daily_mint_vs_burn", lambda f: M.daily_mint_vs_burn(f("round_totals"), M.burn_by_transaction(f(E))), f"""
SELECT {D("event_date")}, {R("coalesce(minted, 0)", "minted")}, {R("coalesce(burned, 0)", "burned")} FROM (SELECT CAST(closed_round_effective_at AS DATE) AS event_date, sum(change_to_initial_amount) AS minted FROM rounds WHERE change_to_initial_amount > 0 GROUP BY 1)
FULL JOIN (SELECT event_date, sum({_TOTAL}) AS burned FROM burns GROUP BY event_date) USING (event_date)""", BURN)
add("rounds_per_day", lambda f: M.rounds_per_day(f("round_totals")), f"""
SELECT {R("s", "seconds_per_round")}, {R("86400.0 / s", "rounds_per_day")} FROM (SELECT CAST(abs({trunc_diff("second", "arg_min(closed_round_effective_at, closed_round)", "arg_max(closed_round_effective_at, closed_round)")}) AS DOUBLE) / (max(closed_round) - min(closed_round)) AS s FROM rounds)""")
LICENCES = f"lic AS (SELECT contract_id, effective_at, {J('validator')} AS validator_party, TRY_CAST({J('faucetState.value.firstReceivedFor.number')} AS BIGINT) AS a, TRY_CAST({J('faucetState.value.lastReceivedFor.number')} AS BIGINT) AS b, TRY_CAST({J('faucetState.value.numCouponsMissed')} AS BIGINT) AS missed FROM ev WHERE event_type = 'created' AND {IS('ValidatorLicense')})"
add("validator_uptime", lambda f: M.validator_uptime(template_view(f(E), "validator_license")), f"SELECT contract_id, validator_party, {R('CASE WHEN b - a + 1 > 0 THEN (b - a + 1 - missed) * 100.0 / (b - a + 1) END', 'uptime')}, CASE WHEN missed > 1 THEN 'inactive' ELSE 'active' END AS state FROM lic", LICENCES)
add("validator_cohorts", lambda f: M.validator_cohorts(template_view(f(E), "validator_license"), template_view(f(E), "validator_right").where("cast(substring(validator_party, 2) as int) % 10 = 0").select("validator_party").distinct(), rounds_a_day=10), f"""
SELECT cohort, count(*) AS validators FROM (SELECT validator_party, CASE WHEN r / 10.0 <= 1 THEN 'day' WHEN r / 10.0 <= 7 THEN 'week' WHEN r / 10.0 <= 30 THEN 'month' WHEN r / 10.0 <= 182 THEN 'half_year' ELSE 'year' END AS cohort FROM (
  SELECT validator_party, max(b - a) AS r FROM lic WHERE validator_party NOT IN (SELECT {J("validator")} FROM ev WHERE event_type = 'created' AND {IS("ValidatorRight")} AND CAST(substr({J("validator")}, 2) AS INTEGER) % 10 = 0) GROUP BY validator_party)) GROUP BY cohort""", LICENCES)
add("validator_joins_by_month", lambda f: M.joins_by_month(template_view(f(E), "validator_license").select("validator_party", F.col("effective_at").alias("joined_at")), "2023-11-01", "2024-03-01"), f"""
SELECT {D("month")}, coalesce(validators, 0) AS validators FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-11-01', TIMESTAMP '2024-03-01', INTERVAL 1 MONTH)) AS DATE) AS month)
LEFT JOIN (SELECT CAST(date_trunc('month', first_at) AS DATE) AS month, count(*) AS validators FROM (SELECT validator_party, min(effective_at) AS first_at FROM lic GROUP BY 1) GROUP BY 1) USING (month)""", LICENCES)
add("unclaimed_rewards_by_user", lambda f: M.unclaimed_rewards_by_user(M.latest_snapshot(f(A))), f"SELECT {J('beneficiary')} AS beneficiary, count(*) AS coupons, {R('sum(' + MONEY('amount') + ')', 'amount')} FROM latest WHERE {IS('UnclaimedReward')} GROUP BY 1", LATEST)
add("claimed_expired_rewards", lambda f: M.claimed_expired_rewards(f(E)), "SELECT * FROM (SELECT event_id, contract_id, template_id, CASE WHEN choice LIKE '%Claim%' THEN 'claimed' WHEN event_type = 'archived' THEN 'expired' END AS state FROM ev WHERE template_id LIKE '%RewardCoupon') WHERE state IS NOT NULL")
add("average_price_vote", lambda f: M.average_price_vote(f(E)), f"SELECT {R('avg(TRY_CAST(' + J('amuletPrice') + ' AS DOUBLE))', 'average_price')}, count(*) AS votes FROM ev WHERE event_type = 'created' AND {IS('AmuletPriceVote')}")
add("update_mix", lambda f: M.update_mix(f(U), as_of()), f"""
SELECT update_type, updates, {R("updates * 100.0 / sum(updates) OVER ()", "share")}, age AS age_seconds, CASE WHEN age < 60 THEN 'live' WHEN age < 300 THEN 'idle' ELSE 'stale' END AS state
FROM (SELECT update_type, count(*) AS updates, {trunc_diff("second", "max(record_time)", NOW)} AS age FROM up GROUP BY update_type)""")
_TYP = "(open + high + low + close) / 4"
add("twap", lambda f: M.twap(f("candles")), f"SELECT pair, {R(f'avg({_TYP})', 'twap')}, count(*) AS candles FROM candles GROUP BY pair")
add("vw_twap", lambda f: M.vw_twap(f("candles"), 60), f"""
SELECT pair, {R("avg(CASE WHEN v <> 0 THEN pv / v END)", "vw_twap")}, count(*) FILTER (v <> 0) AS slices, count(*) FILTER (v = 0) AS empty_slices
FROM (SELECT pair, epoch_us(ts) // 3600000000 AS s, sum({_TYP} * volume) AS pv, sum(volume) AS v FROM candles GROUP BY 1, 2) GROUP BY pair""")
CHANGES = "daily AS (SELECT *, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) * 100 AS change_pct FROM (SELECT pair, CAST(ts AS DATE) AS day, arg_max(close, ts) AS close, sum(volume) AS volume, CAST(sum(count) AS BIGINT) AS trades FROM candles GROUP BY 1, 2) WINDOW w AS (PARTITION BY pair ORDER BY day))"
add("price_changes", lambda f: M.price_changes(f("candles")), f"SELECT pair, {D('day')}, {R('close', 'close')}, {R('volume', 'volume')}, trades, {R('change_pct', 'change_pct')} FROM daily", CHANGES)
add("market_overview", lambda f: M.market_overview(f("candles"), "purchase"), f"""
SELECT pair, {D("day")}, {R("close", "close")}, {R("volume", "volume")}, trades, {R("change_pct", "change_pct")}, {R("sum(CASE WHEN close > 0 AND volume > 0 THEN close * volume END) OVER () / sum(CASE WHEN close > 0 AND volume > 0 THEN volume END) OVER ()", "weighted_price")},
  {R("sum(volume) OVER ()", "total_volume")}, CAST(sum(trades) OVER () AS BIGINT) AS total_trades, {R("max(CASE WHEN pair = 'purchase' THEN close END) OVER ()", "reference_price")}
FROM (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY pair ORDER BY day DESC) = 1)""", CHANGES)
add("usage_series", lambda f: M.usage_series(f("transfers"), "2023-12-30", "2024-02-02"), f"""
SELECT {D("date")}, CAST(sum(n) OVER (ORDER BY date) AS BIGINT) AS cumulative_parties, users, CAST(floor(avg(users) OVER w + 0.5) AS BIGINT) AS users_mean7, t AS transfers, CAST(floor(avg(t) OVER w + 0.5) AS BIGINT) AS transfers_mean7
FROM (SELECT date, coalesce(users, 0) AS users, coalesce(t, 0) AS t, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS date)
  LEFT JOIN (SELECT date, count(DISTINCT sender) AS users, count(*) AS t FROM transfers WHERE amount > 0 GROUP BY date) USING (date)
  LEFT JOIN (SELECT date, count(*) AS n FROM (SELECT sender, min(date) AS date FROM transfers WHERE amount > 0 GROUP BY sender) GROUP BY date) USING (date))
WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
CLASSES = """classes AS (
SELECT party, count(*) FILTER (k = 'outbound') AS outbound, count(*) FILTER (k = 'inbound') AS inbound, count(*) FILTER (k = 'other') AS other FROM (
  SELECT party, CASE WHEN list_contains(acting_parties, party) THEN 'outbound' WHEN event_type = 'created' THEN 'inbound' ELSE 'other' END AS k FROM (SELECT *, unnest(list_distinct(list_concat(signatories, observers))) AS party FROM ev))
WHERE party IN (SELECT 'p' || u FROM base WHERE id % 7 = 0) GROUP BY party)"""
_wallets = lambda f: f("ledger_base").where("id % 7 = 0").select(F.concat(F.lit("p"), F.col("u").cast("string")).alias("wallet")).distinct()
add("transaction_classes", lambda f: M.transaction_classes(f(E), _wallets(f)), "SELECT * FROM classes", CLASSES)
add("wallet_immobility", lambda f: M.wallet_immobility(M.transaction_classes(f(E), _wallets(f)), M.holder_balances(M.latest_snapshot(f(A))), M.transfer_activity(f(E).where("substring(contract_id, 2) % 10 = 0"))), """
SELECT party, outbound, moved IS NOT NULL AS transfers, CASE WHEN outbound = 0 AND moved IS NULL THEN 'immobile' ELSE 'mobile' END AS verdict, outbound = 0 AND moved IS NULL AND coalesce(unlocked, 0) > 0 AS alert FROM classes LEFT JOIN balances ON owner = party
LEFT JOIN (SELECT DISTINCT unnest(list_concat(signatories, observers)) AS moved FROM ev WHERE CAST(substr(contract_id, 2) AS BIGINT) % 10 = 0 AND (contains(template_id, 'Transfer') OR choice = 'Transfer')) ON moved = party""", CLASSES, LATEST, BALANCES)
add("top_templates", lambda f: M.top_templates(f(E).where("event_type <> 'archived'")), "SELECT substr(template_id, strpos(template_id, ':') + 1) AS t, count(*) AS n FROM ev WHERE event_type <> 'archived' GROUP BY 1 ORDER BY 2 DESC".replace("SELECT substr", "SELECT list_last(string_split(t, ':')) AS template, n AS events FROM (SELECT substr") + ") ORDER BY n DESC, template LIMIT 5")
add("dev_fund_summary", lambda f: M.dev_fund_summary(M.latest_snapshot(f(A)).where(F.col("template_id").endswith(":UnclaimedReward")).select("contract_id", F.col("record_time").alias("effective_at"), money(json_text(F.col("payload"), "amount")).alias("amount"))), f"""
SELECT contract_id, {T("record_time", "effective_at")}, {R("amount", "amount")}, row_number() OVER (ORDER BY d.amount DESC, contract_id) AS rank, {R("sum(d.amount) OVER ()", "total")}, (SELECT arg_max(contract_id, {{'a': record_time, 'b': contract_id}}) FROM latest WHERE {IS("UnclaimedReward")}) AS latest_contract
FROM (SELECT *, {MONEY("amount")} AS amount FROM latest WHERE {IS("UnclaimedReward")}) d""", LATEST)
_PICK = f"coalesce({MONEY('amount.initialAmount')}, {MONEY('amulet.amount.initialAmount')})"
add("acs_template_sum", lambda f: M.template_sum(f(A), "Amulet"), f"SELECT {R(f'sum({_PICK})', 'amount')}, count(*) AS contracts, count(DISTINCT template_id) AS templates FROM latest WHERE {IS('Amulet')}", LATEST)
add("allocation_summary", lambda f: M.allocation_summary(f(A), "LockedAmulet"), f"SELECT count(*) AS allocations, {R(f'sum({_PICK})', 'amount')}, count(DISTINCT {J('provider')}) AS executors FROM latest WHERE {IS('LockedAmulet')}", LATEST)
add("sv_lock_tiers", lambda f: M.sv_lock_tiers(f("ledger_base").groupBy(F.concat(F.lit("p"), F.col("u").cast("string")).alias("party")).agg((F.sum(F.expr("case when id % 2 = 0 then cents else 0 end")) / 100.0).alias("locked"), (F.sum("cents") / 100.0).alias("earned"), F.sum("k").alias("weight"))), f"""
SELECT party, {R("share", "locked_pct")}, {R("tier", "multiplier")}, CAST(round(weight * tier) AS BIGINT) AS effective_weight FROM (SELECT *, CASE WHEN share >= 70 THEN 1.0 WHEN share >= 45 THEN 0.6 WHEN share >= 35 THEN 0.4 ELSE 0.0 END AS tier FROM (
  SELECT 'p' || u AS party, CASE WHEN sum(cents) > 0 THEN sum(CASE WHEN id % 2 = 0 THEN cents ELSE 0 END) * 100.0::DOUBLE / sum(cents) ELSE 0 END AS share, sum(k) AS weight FROM base GROUP BY u))""")
add("reward_distribution", lambda f: M.reward_distribution(f("ledger_base").groupBy((F.col("k") % 5).alias("stage")).agg((F.avg("k") / 400).alias("validator"), (F.avg("k") / 300).alias("app"))), f"""
SELECT stage, {R("v * l", "validator_share")}, {R("a * l", "app_share")}, {R("(1 - v - a) * l", "sv_share")}, {R("CASE WHEN stage >= 2 THEN 0.05 ELSE 0 END", "dev_fund_share")} FROM (SELECT k % 5 AS stage, avg(k) / 400 AS v, avg(k) / 300 AS a, CASE WHEN k % 5 >= 2 THEN 0.95 ELSE 1.0 END AS l FROM base GROUP BY k % 5)""")
def _operators(f: Callable[[str], DataFrame]) -> DataFrame:
    """Operators with the summed weight of each of their beneficiaries, so that a list is as long as these are many."""
    rows = f("ledger_base").select(F.concat(F.lit("op"), (F.col("u") % 40).cast("string")).alias("name"), F.expr("case when u % 3 = 0 then 'ghost-1' else concat('b', cast(u as string)) end").alias("beneficiary"), "k", "u")
    each = rows.groupBy("name", "beneficiary").agg(F.sum("k").alias("weight"), F.max("u").alias("u"))
    return each.groupBy("name").agg((F.sum("weight") + F.max("u") % 3).alias("reward_weight_bps"), F.collect_list(F.struct("beneficiary", "weight")).alias("beneficiaries"))


add("beneficiary_weights", lambda f: M.beneficiary_weights(_operators(f)), """
SELECT name, beneficiary, bps, CASE WHEN beneficiary LIKE 'ghost%' THEN 'escrowed' ELSE 'direct' END AS status, abs(sum(bps) OVER (PARTITION BY name) - total) <= 1 AS balanced
FROM (SELECT 'op' || (u % 40) AS name, CASE WHEN u % 3 = 0 THEN 'ghost-1' ELSE 'b' || u END AS beneficiary, CAST(sum(k) AS BIGINT) AS bps FROM base GROUP BY 1, 2)
JOIN (SELECT 'op' || (u % 40) AS name, sum(k) + max(u) % 3 AS total FROM base GROUP BY 1) USING (name)""")
