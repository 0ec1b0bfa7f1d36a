"""DuckDB text of the ledger derivation: the same rows as ``sources.derive``, for the SQL side of the queries."""

from __future__ import annotations

from ledgerloom.sources.derive import CHOICES, PACKAGE, WORD
from ledgerloom.sources.schemas import TEMPLATES


def _list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_AMOUNT = "(cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0')"
_HELD = f"""'{{"initialAmount":"' || {_AMOUNT} || '","createdAt":{{"number":"' || k || '"}},"ratePerRound":{{"rate":"0.0' || (k % 9) || '1"}}}}'"""


def _iso(at: str) -> str:
    return f"strftime({at}, '%Y-%m-%dT%H:%M:%SZ')"


def _vote(sv: str, yes: str) -> str:
    return f"""'"sv' || {sv} || '":{{"accept":"' || {yes} || '","reason":{{"body":"b' || k || '","url":"https://v/' || (k % 10) || '"}}}}'"""


_EVEN = "CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END"

_PAYLOAD = " || ".join(
    (
        """'{"dso":"dso","owner":"p' || u || '","user":"p' || u || '","provider":"p' || (u % 20) || '","validator":"v' || (u % 30) || '","sv":"sv' || (u % 7)""",
        """'","beneficiary":"p' || ((u + 1) % 50) || '","sponsor":"sv' || (u % 5) || '","requester":"sv' || (u % 7) || '","sender":"p' || u""",
        """'","receiver":"p' || ((u + 3) % 150) || '","receiverParty":"p' || ((u + 3) % 150) || '","buyer":"p' || u || '","memberId":"m' || (u % 40)""",
        """'","synchronizerId":"sync' || (u % 3) || '","domain":"sync' || (u % 3) || '","name":"name' || (id % 97) || '","url":"https://n/' || (id % 97)""",
        f"""'","description":"d' || k || '","weight":"' || (1 + k % 5) || '.0","featured":"' || {_EVEN}""",
        """'","nonce":"' || k || '","nextNonce":"' || (k + 1) || '","epoch":"' || (k % 4) || '","migrationId":"' || m || '","trackingCid":"c' || (id - id % 2)""",
        f"""'","round":{{"number":"' || k || '"}},"issuingFor":{{"number":"' || (k + 1) || '"}},"amount":' || CASE WHEN t IN (2, 5) THEN '"' || {_AMOUNT} || '"' ELSE {_HELD} END""",
        f"""',"amuletPrice":"0.00' || (1 + k % 9) || '","totalTrafficPurchased":"' || cents || '","trafficAmount":"' || cents || '","opensAt":"' || {_iso("ts")}""",
        f"""'","targetClosesAt":"' || {_iso("ts + INTERVAL 20 MINUTE")} || '","expiresAt":"' || {_iso("ts + to_days(CAST(k % 5 AS INTEGER))")} || '","voteBefore":"' || {_iso("ts + to_days(CAST(k % 7 AS INTEGER))")}""",
        f"""'","amulet":{{"owner":"p' || u || '","amount":' || {_HELD} || '}},"lock":{{"holders":["p' || u || '","p' || ((u + 2) % 150) || '"]'""",
        """CASE WHEN k % 2 = 0 THEN ',"expiresAt":{"number":"' || (k + 10) || '"}' ELSE '' END || '},"faucetState":{"tag":"FaucetState","value":{"numCouponsMissed":"' || (k % 6)""",
        """'","firstReceivedFor":{"number":"' || k || '"},"lastReceivedFor":{"number":"' || (k + cents % 50) || '"}}},"metadata":{"version":"0.' || (k % 5)""",
        f"""'","contactPoint":"mail' || (u % 30) || '","lastUpdatedAt":"' || {_iso("ts")} || '"}},"activityRecord":{{"trafficReceived":"' || cents || '","lastActiveAt":"' || {_iso("ts")}""",
        """'"},"issuanceConfig":{"amuletToIssuePerYear":"' || (cents * 100) || '","validatorRewardPercentage":"0.05","appRewardPercentage":"0.15","svRewardPercentage":"0.8"},"transferConfigUsd":{"createFee":{"fee":"0.03"},"holdingFee":{"rate":"0.0000190259"},"transferFee":{"initialRate":"0.01"}}'""",
        """',"dsoDelegate":"sv' || (u % 7) || '","config":{"numMemberTrafficContractsThreshold":"5","numUnclaimedRewardsThreshold":"10","actionConfirmationTimeout":"3600","svOnboardingRequestTimeout":"7200","voteRequestTimeout":"604800"}'""",
        f"""',"svs":{{"sv0":{{"name":"sv zero","weight":"' || k || '","joinedAt":"' || {_iso("ts")} || '","participantId":"part0"}},"sv' || (1 + k % 6) || '":{{"name":"sv ' || (1 + k % 6)""",
        f"""'","weight":"10","joinedAt":"' || {_iso("ts")} || '","participantId":"part1"}}}},"confirmedBy":["sv0","sv' || (1 + k % 6) || '"],"ranking":[{{"sv":"sv' || (u % 7) || '","rank":"1"}},{{"sv":"sv' || (7 + u % 2) || '","rank":"2"}}]'""",
        """',"state":{"synchronizerNodes":{"sync' || (u % 3) || '":"node"}},"action":{"tag":"ARC_DsoRules","value":{"tag":"CRARC_' || (k % 4) || '","value":{"sv":"sv' || (u % 7) || '"},"dsoAction":{"tag":"SRARC_' || (k % 3) || '"}}}'""",
        f"""',"reason":{{"url":"https://v/' || (k % 10) || '","body":"proposal ' || k || '"}},"votes":{{' || {_vote("(u % 7)", "'true'")} || ',' || {_vote("(7 + k % 3)", _EVEN)} || '}}'""",
        f"""',"vote":{{"accept":"' || {_EVEN} || '","reason":{{"body":"b' || k || '"}}}},"transfer":{{"sender":"p' || u || '","receivers":[{{"party":"p' || ((u + 3) % 150) || '","amount":"' || {_AMOUNT} || '"}}]}}}}'""",
    )
)

_RESULT = f"""'{{"round":{{"number":"' || k || '"}},"amuletPaid":"' || (cents % 700) || '.5","summary":{{"inputAmuletAmount":"' || {_AMOUNT} || '","outputAmuletAmount":"' || (cents // 200)
 || '.25","holdingFees":"0.' || (k % 10) || '","senderChangeFee":"0.0' || (k % 10) || '","amuletPrice":"0.00' || (1 + k % 9) || '","outputFees":["0.1","0.' || (k % 10) || '"],"balanceChanges":[{{"changeToInitialAmountAsOfRoundZero":"' || (cents // 100) || '"}}]}},"amulet":"c' || (id + 1)
 || '","transferResult":{{"summary":{{"holdingFees":"0.' || (k % 7) || '","senderChangeFee":"0.0' || (k % 3) || '","outputFees":["0.2","0.' || (k % 5) || '"]}}}}}}'"""

_TURN = f"(id // {5 * len(CHOICES)}) % 2"
_AT = f"(id // 5) % {len(CHOICES)}"
_INITIAL, _RENEWAL = (CHOICES.index(c) for c in ("SubscriptionInitialPayment_Collect", "AnsEntryContext_CollectRenewalEntryPayment"))
_BELOW = f"CASE WHEN {_AT} = {_INITIAL} AND {_TURN} = 0 THEN ['e' || (id + 10) || ':2'] WHEN {_AT} = {_RENEWAL} AND {_TURN} = 1 THEN ['e' || (id + 5) || ':2'] ELSE CAST([] AS VARCHAR[]) END"

#: CTEs: base, ev (events), up (updates), acs (snapshots). Put a query after ``WITH`` + this text.
LEDGER = f"""
base AS MATERIALIZED (
  SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, user_id AS u, CAST(abs(round(value * 100)) AS BIGINT) AS cents,
         TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind, CAST(event_id % {len(TEMPLATES)} AS INTEGER) AS t,
         CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 0::BIGINT ELSE 1::BIGINT END AS m
  FROM events),
numbered AS (
  SELECT *, CASE WHEN n = 1 THEN ts + to_minutes(k + 1) ELSE ts END AS eff
  FROM base, (VALUES (0), (1), (2)) AS v(n) WHERE n = 0 OR (n = 1 AND id % 3 = 0) OR (n = 2 AND id % 5 = 0)),
ev AS MATERIALIZED (
  SELECT 'e' || id || ':' || n AS event_id, 'u' || (id // 15) AS update_id, 'c' || id AS contract_id,
         CASE n WHEN 0 THEN 'created' WHEN 1 THEN 'archived' ELSE 'exercised' END AS event_type,
         '{PACKAGE}:' || ({_list(TEMPLATES)})[t + 1] AS template_id,
         CASE WHEN n = 2 THEN ({_list(CHOICES)})[CAST((id // 5) % {len(CHOICES)} AS INTEGER) + 1] END AS choice,
         CASE WHEN n = 2 THEN id % 2 = 0 END AS consuming,
         CASE WHEN n = 2 AND id % 4 = 0 THEN 'iface:Splice.Api:Holding' END AS interface_id,
         eff AS effective_at, eff + INTERVAL 1 MINUTE AS recorded_at, CAST(eff AS DATE) AS event_date, m AS migration_id, 'sync' || (u % 3) AS synchronizer_id,
         ['p' || u, 'dso'] AS signatories, CASE WHEN k % 2 = 0 THEN ['p' || ((u + 1) % 50)] ELSE CAST([] AS VARCHAR[]) END AS observers,
         CASE WHEN n = 2 THEN ['p' || u] ELSE CAST([] AS VARCHAR[]) END AS acting_parties,
         CASE WHEN n = 2 THEN list_concat(['e' || (id + x) || ':0' FOR x IN range(1, 2 + k % 3)], {_BELOW}) ELSE CAST([] AS VARCHAR[]) END AS child_event_ids,
         CASE WHEN n = 1 THEN '{{}}' ELSE {_PAYLOAD} END AS payload,
         CASE WHEN n = 2 THEN {_RESULT} END AS exercise_result
  FROM numbered),
up AS MATERIALIZED (
  SELECT 'u' || g AS update_id, CASE WHEN g % 7 = 0 THEN 'reassignment' ELSE 'transaction' END AS update_type, m AS migration_id, 'sync' || (u % 3) AS synchronizer_id,
         ts AS effective_at, ts + INTERVAL 1 MINUTE AS record_time, CAST(ts AS DATE) AS record_date, g AS "offset",
         CAST(events + CASE WHEN g % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS event_count,
         CASE WHEN g % 7 = 0 THEN 'sync' || ((u + 1) % 3) END AS source_synchronizer, CASE WHEN g % 7 = 0 THEN 'sync' || (u % 3) END AS target_synchronizer,
         CASE WHEN g % 7 = 0 THEN g END AS reassignment_counter, '{{"traceId":"t' || g || '","spanId":"s' || (g % 100) || '"}}' AS trace_context
  FROM (SELECT id // 15 AS g, min(ts) AS ts, max(m) AS m, min(u) AS u, CAST(sum(1 + CAST(id % 3 = 0 AS INTEGER) + CAST(id % 5 = 0 AS INTEGER)) AS BIGINT) AS events FROM base GROUP BY id // 15)),
acs AS (
  SELECT 'c' || id AS contract_id, '{PACKAGE}:' || ({_list(TEMPLATES)})[t + 1] AS template_id, m AS migration_id, ts AS record_time, snapshot_time,
         ['p' || u, 'dso'] AS signatories, {_PAYLOAD} AS payload, snapshot_time > TIMESTAMP '2024-01-11 00:00:00' AS complete
  FROM base, (VALUES (TIMESTAMP '2024-01-11 00:00:00'), (TIMESTAMP '2024-01-21 00:00:00'), (TIMESTAMP '2024-01-31 00:00:00')) AS s(snapshot_time)
  WHERE ts < snapshot_time AND NOT (id % 3 = 0 AND ts + to_minutes(k + 1) < snapshot_time)),
candles AS (
  SELECT kind AS pair, make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS ts, arg_min(cents, id) / 100.0::DOUBLE AS open, max(cents) / 100.0::DOUBLE AS high,
         min(cents) / 100.0::DOUBLE AS low, arg_max(cents, id) / 100.0::DOUBLE AS close, CAST(sum(k) AS DOUBLE) AS volume, count(*) AS count
  FROM base GROUP BY kind, epoch_us(ts) // 300000000),
rpt AS (
  SELECT 'p' || u AS party, k AS closed_round, sum(sum(cents)) OVER (PARTITION BY u ORDER BY k) / 100.0::DOUBLE AS cumulative_app_rewards FROM base GROUP BY u, k),
rounds AS (
  SELECT k AS closed_round, max(ts) AS closed_round_effective_at, sum(CASE WHEN id % 4 = 0 THEN -cents ELSE cents END) / 100.0::DOUBLE AS change_to_initial_amount FROM base GROUP BY k),
transfers AS (
  SELECT CAST(ts AS DATE) AS date, 'p' || u AS sender, 'p' || ((u + 3) % 150) AS receiver, CASE WHEN k < 5 THEN 0.0::DOUBLE ELSE cents / 100.0::DOUBLE END AS amount FROM base WHERE kind IN ('purchase', 'click')),
topics AS MATERIALIZED (
  SELECT doc_id AS topic_id,
         CASE doc_id % 5 WHEN 0 THEN 'CIP-' || lpad(CAST(doc_id // 50 AS VARCHAR), 4, '0') || ' Discussion: change ' || (doc_id % 13)
              WHEN 1 THEN 'Featured App Request: App' || CASE (doc_id // 5) % 4 WHEN 1 THEN left(w, 4) || substr(w, 6) WHEN 2 THEN w || ' Wallet' ELSE w END
              WHEN 2 THEN 'Validator Approved: Node' || w || ' Ltd'
              WHEN 3 THEN 'Vote Proposal: set fee to ' || (doc_id % 9) || ' on TestNet' ELSE (['Weekly notes ' || (doc_id % 50), 'Re: [Acme' || x || '] update', 'Swap' || x || ' Featured App Tokenomics', 'Validators Approved: A1, B2 and C3',
                'Request to Feature the Wallet' || x || ' by Corp', 'Node as a Service approved', 'MainNet: Swap' || x || ' by Trade Co', 'Tokenomics Outcomes week ' || (doc_id % 50),
                'Splice 0.' || (doc_id % 50) || ' upgrade notes', 'Vote Proposal: Validator onboarding for Bolt' || x || ' - Vote', 'CIP TBD discuss new fee ' || (doc_id % 50), 'Fwd: grant for Nova' || x])[CAST((doc_id // 5) % 12 AS INTEGER) + 1] END AS subject,
         'see https://forum/t/' || doc_id || ' and https://v/' || (doc_id % 10) || ' in ' || coalesce(lang, '') || chr(10) || coalesce(text, '') AS body,
         CAST(DATE '2024-01-01' + to_days(CAST(doc_id % 300 AS INTEGER)) AS DATE) AS date,
         (['cip-discuss', 'cip-vote', 'cip-announce', 'sv-announce', 'tokenomics', 'tokenomics-announce'])[CAST((doc_id // 5) % 6 AS INTEGER) + 1] AS stage, source, w, x
  FROM (SELECT *, {WORD.format("doc_id // 40")} AS w, {WORD.format("doc_id // 300")} AS x FROM documents))
"""


def sql(text: str, *more: str) -> str:
    """A query over the ledger CTEs, with further CTEs of its own before it."""
    return "WITH RECURSIVE " + ",\n".join([LEDGER.strip(), *more]) + "\n" + text.strip()
