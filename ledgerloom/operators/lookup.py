"""Lookups: filtered pages, searches, parties and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import is_template


def newest_first(events: DataFrame) -> list[Column]:
    """Order of pages: newest first, missing times last, ids break ties."""
    at = F.coalesce("recorded_at", "effective_at") if "recorded_at" in events.columns else F.col("effective_at")
    return [at.desc_nulls_last(), F.col("event_id").asc()]


def page(events: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the newest events (top-k per task, no whole sort)."""
    return events.orderBy(*newest_first(events)).offset(offset).limit(limit)


def events_where(events: DataFrame, kind: str | None = None, template: str | None = None, contract: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events of a type, of templates that contain a text, of a contract, and of effective times in [start, end)."""
    out = events
    if kind is not None:
        out = out.where(F.col("event_type") == kind)
    if template is not None:
        out = out.where(F.col("template_id").contains(template))
    if contract is not None:
        out = out.where(F.col("contract_id") == contract)
    if start is not None:
        out = out.where(F.col("effective_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("effective_at") < F.lit(end).cast("timestamp"))
    return out


#: Entities of the fixed event sets.
SETS = {
    "governance": ("VoteRequest", "Confirmation", "ElectionRequest", "DsoRules"),
    "reward": ("AppRewardCoupon", "SvRewardCoupon", "ValidatorRewardCoupon", "UnclaimedReward"),
    "member_traffic": ("MemberTraffic",),
}


def event_set(events: DataFrame, name: str) -> DataFrame:
    condition = F.lit(False)
    for entity in SETS[name]:
        condition = condition | is_template(F.col("template_id"), entity)
    return events.where(condition)


def search_events(events: DataFrame, text: str | None = None, kind: str | None = None, template: str | None = None, party: str | None = None) -> DataFrame:
    """Events that meet all given conditions; text is looked for in contract id, template id and payload (any case)."""
    out = events_where(events, kind=kind, template=template)
    if text is not None:
        low = text.lower()
        out = out.where(F.lower("contract_id").contains(low) | F.lower("template_id").contains(low) | F.lower("payload").contains(low))
    if party is not None:
        out = out.where(of_party(party))
    return out


def of_party(party: str) -> Column:
    return F.array_contains("signatories", party) | F.array_contains("observers", party)


def contract_prefix(events: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """The newest contracts whose id begins so, with template and first sight."""
    rows = events.where(F.col("contract_id").startswith(prefix)).groupBy("contract_id", "template_id").agg(F.min("effective_at").alias("first_seen"))
    return rows.orderBy(F.col("first_seen").desc(), "contract_id", "template_id").limit(limit)


def party_list(events: DataFrame) -> DataFrame:
    return events.select(F.explode(F.array_union("signatories", "observers")).alias("party")).distinct()


def party_search(events: DataFrame, text: str) -> DataFrame:
    return party_list(events).where(F.lower("party").contains(text.lower()))


def party_events(events: DataFrame, party: str) -> DataFrame:
    return events.where(of_party(party))


def activity_of(events: DataFrame, watched: list[str]) -> DataFrame:
    """Events that any watched party signs, observes or acts in, with the parties matched (few names, a literal list)."""
    every = F.array_union(F.array_union("signatories", "observers"), "acting_parties")
    names = F.array(*[F.lit(w) for w in watched])
    return events.where(F.arrays_overlap(every, names)).withColumn("matched", F.array_sort(F.array_intersect(every, names)))


def contract_history(events: DataFrame, contract: str) -> DataFrame:
    return events.where(F.col("contract_id") == contract).orderBy("effective_at", "event_id")


def keyset_page(events: DataFrame, after: str | None, limit: int, newest: bool = True) -> DataFrame:
    """The page beyond a recorded_at cursor: ``limit`` rows, each beside has_more and the next cursor."""
    rows = events
    if after is not None:
        at = F.lit(after).cast("timestamp")
        rows = rows.where(F.col("recorded_at") < at if newest else F.col("recorded_at") > at)
    order = [F.col("recorded_at").desc() if newest else F.col("recorded_at").asc(), F.col("event_id").asc()]
    more = rows.orderBy(*order).limit(limit + 1)
    whole = more.agg(F.count("*").alias("n"))
    shown = more.orderBy(*order).limit(limit)
    cursor = shown.agg((F.min if newest else F.max)("recorded_at").alias("next_cursor"))
    return shown.crossJoin(whole.select((F.col("n") > limit).alias("has_more"))).crossJoin(cursor)  # one row each


def latest_updates(updates: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the newest updates with the total and whether more follow."""
    total = updates.agg(F.count("*").alias("total"))
    rows = updates.orderBy(F.col("record_time").desc_nulls_last(), "update_id").offset(offset).limit(limit)
    return rows.crossJoin(total).withColumn("has_more", F.col("total") > offset + limit)  # one row


def stored_vote_results(results: DataFrame, status: str | None = None, action: str | None = None, limit: int = 100) -> DataFrame:
    out = results
    if status is not None:
        out = out.where(F.col("status") == status)
    if action is not None:
        out = out.where(F.col("action_type") == action)
    return out.orderBy(F.col("latest_at").desc_nulls_last(), "proposal_id").limit(limit)
