"""Declared schemas of the raw and typed frames, and the template names that views select by."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(38, 10)

#: Module-qualified template names of the ledger, as they end a template id.
TEMPLATES = (
    "Splice.Amulet:Amulet",
    "Splice.Amulet:LockedAmulet",
    "Splice.Amulet:AppRewardCoupon",
    "Splice.Amulet:SvRewardCoupon",
    "Splice.Amulet:ValidatorRewardCoupon",
    "Splice.Amulet:UnclaimedReward",
    "Splice.Amulet:FeaturedAppRight",
    "Splice.Amulet:ValidatorRight",
    "Splice.ValidatorLicense:ValidatorLicense",
    "Splice.ValidatorLicense:ValidatorFaucetCoupon",
    "Splice.ValidatorLicense:ValidatorLivenessActivityRecord",
    "Splice.DecentralizedSynchronizer:MemberTraffic",
    "Splice.Round:OpenMiningRound",
    "Splice.Round:ClosedMiningRound",
    "Splice.Round:IssuingMiningRound",
    "Splice.Ans:AnsEntry",
    "Splice.DsoRules:DsoRules",
    "Splice.DsoRules:VoteRequest",
    "Splice.DsoRules:Confirmation",
    "Splice.DsoRules:ElectionRequest",
    "Splice.DSO.SvState:SvNodeState",
    "Splice.DSO.SvState:SvRewardState",
    "Splice.DSO.AmuletPrice:AmuletPriceVote",
    "Splice.ExternalPartyAmuletRules:TransferCommand",
    "Splice.ExternalPartyAmuletRules:TransferCommandCounter",
    "Splice.AmuletRules:AmuletRules",
)

_TEXT, _LIST = T.StringType(), T.ArrayType(T.StringType())


def _raw(text: str, lists: str = "", longs: str = "", flags: str = "") -> T.StructType:
    fields = [(n, _TEXT) for n in text.split()] + [(n, _LIST) for n in lists.split()]
    fields += [(n, T.LongType()) for n in longs.split()] + [(n, T.BooleanType()) for n in flags.split()]
    return T.StructType([T.StructField(n, t) for n, t in fields])


#: Raw files: times and JSON are text, as they are landed.
RAW_EVENTS = _raw(
    "event_id update_id event_type event_type_original synchronizer_id effective_at recorded_at timestamp created_at_ts contract_id template_id"
    " package_name source_synchronizer target_synchronizer unassign_id submitter payload contract_key exercise_result raw_event trace_context choice interface_id",
    "signatories observers acting_parties witness_parties child_event_ids",
    "migration_id reassignment_counter",
    "consuming",
)
RAW_UPDATES = _raw(
    "update_id update_type synchronizer_id effective_at recorded_at record_time timestamp command_id workflow_id kind update_data source_synchronizer"
    " target_synchronizer unassign_id submitter trace_context",
    "root_event_ids",
    "migration_id offset event_count reassignment_counter",
)
RAW_ACS = _raw(
    "contract_id event_id template_id package_name module_name entity_name record_time snapshot_time payload raw",
    "signatories observers",
    "migration_id",
)
