"""Normalisation: raw text frames to typed events, updates and contracts; extraction and order of event trees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import entity_of, in_years, module_of, package_of

_TIMES = ("effective_at", "recorded_at", "record_time", "timestamp", "created_at_ts", "snapshot_time")
#: Record kinds that updates may have.
UPDATE_TYPES = ("transaction", "reassignment")


def _typed(raw: DataFrame, json_columns: tuple[str, ...]) -> DataFrame:
    """Times parsed, JSON checked (text that is no JSON becomes null); all other columns as they are."""
    out = []
    for name in raw.columns:
        c = F.col(name)
        if name in _TIMES:
            c = F.try_to_timestamp(c)
        elif name in json_columns:
            c = F.when(F.try_parse_json(c).isNotNull(), c)
        out.append(c.alias(name))
    return raw.select(*out)


def parse_events(raw: DataFrame) -> DataFrame:
    """Raw events to typed ones; bad values become null, no row is lost. Adds event_date (of the effective time)."""
    typed = _typed(raw, ("payload", "contract_key", "exercise_result", "raw_event", "trace_context"))
    return typed.withColumn("event_date", F.to_date("effective_at"))


def parse_updates(raw: DataFrame) -> DataFrame:
    typed = _typed(raw, ("update_data", "trace_context"))
    return typed.withColumn("record_date", F.to_date("record_time"))


def _j(data: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(data, f"$.{p}") for p in paths])


def _fields(rows: DataFrame, text: str, *names: str) -> DataFrame:
    """The rows with named fields of a JSON column as text, all read in one pass over it (one ``get_json_object`` a field would
    go over it as often as there are fields); text that is no JSON object has none. Of repeated fields the last counts."""
    return rows.select("*", F.json_tuple(text, *names).alias(*[f"{text}_{n}" for n in names]))


def _first(text: str, *names: str) -> Column:
    """The first of the columns that ``_fields`` made that isn't null."""
    return F.coalesce(*[F.col(f"{text}_{n}") for n in names])


def normalize_update(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Typed updates from JSON text of transactions and reassignments, wrapped (``{transaction: …}``,
    ``{reassignment: …}``) or bare. Updates of no known type have update_type null; ``split_unknown`` parts them."""
    outer = _fields(raw.select(F.col(json_col).alias("j")), "j", "transaction", "reassignment", "events_by_id", "migration_id")
    kind = (
        F.when(F.col("j_transaction").isNotNull(), "transaction").when(F.col("j_reassignment").isNotNull(), "reassignment")
        .when(F.col("j_events_by_id").isNotNull(), "transaction").when(_j(F.col("j"), "event.created_event", "event.archived_event", "event.unassign_id").isNotNull(), "reassignment")
    )
    inner = outer.select("j_migration_id", kind.alias("update_type"), F.coalesce("j_transaction", "j_reassignment", "j").alias("i"))
    names = (
        "update_id", "migration_id", "synchronizer_id", "record_time", "effective_at", "workflow_id", "command_id", "offset", "root_event_ids", "events_by_id", "source", "source_synchronizer",
        "target", "target_synchronizer", "unassign_id", "submitter", "counter", "reassignment_counter", "trace_context",
    )
    one = lambda *n: _first("i", *n)
    kind = F.col("update_type")
    roots = F.from_json(one("root_event_ids"), "array<string>")
    count = F.when(kind == "transaction", F.size(F.json_object_keys(one("events_by_id")))).when(kind == "reassignment", 1)
    return _fields(inner, "i", *names).select(
        one("update_id").alias("update_id"), kind, F.coalesce(F.col("j_migration_id"), one("migration_id")).try_cast("long").alias("migration_id"),
        one("synchronizer_id").alias("synchronizer_id"), F.try_to_timestamp(one("record_time")).alias("record_time"), F.try_to_timestamp(one("effective_at", "record_time")).alias("effective_at"),
        one("workflow_id").alias("workflow_id"), one("command_id").alias("command_id"), one("offset").try_cast("long").alias("offset"), roots.alias("root_event_ids"),
        count.cast("long").alias("event_count"), one("source", "source_synchronizer").alias("source_synchronizer"), one("target", "target_synchronizer").alias("target_synchronizer"),
        one("unassign_id").alias("unassign_id"), one("submitter").alias("submitter"), one("counter", "reassignment_counter").try_cast("long").alias("reassignment_counter"),
        one("trace_context").alias("trace_context"), F.col("i").alias("update_data"),
    )


def split_unknown(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, rejected): updates of a known type, and the others."""
    known = F.col("update_type").isin(*UPDATE_TYPES) & F.col("update_id").isNotNull()
    return updates.where(known), updates.where(~F.coalesce(known, F.lit(False)))


def extract_events(updates: DataFrame) -> DataFrame:
    """Every event of every update's JSON: the entries of a transaction's events_by_id, the one event of a reassignment
    (tagged reassign_create / reassign_archive). (update_id, event_id, kind, event JSON, update times and ids.)
    Both types are read in one pass over the updates, which may be dear to make."""
    keep = ["update_id", "migration_id", "synchronizer_id", "record_time", "effective_at"]
    data, none = F.col("update_data"), F.lit(None).cast("string")
    entry = lambda key, wrapped, created, archived: F.struct(key.alias("key"), wrapped.alias("wrapped"), created.alias("created"), archived.alias("archived"))
    of_tx = F.transform(F.map_entries(F.from_json(_j(data, "events_by_id"), "map<string,string>")), lambda e: entry(e["key"], e["value"], none, none))
    of_move = F.array(entry(none, none, _j(data, "event.created_event"), _j(data, "event.archived_event")))
    entries = F.when(F.col("update_type") == "transaction", of_tx).when(F.col("update_type") == "reassignment", of_move)
    rows = updates.select(*keep, "update_type", F.explode(entries).alias("e")).select(*keep, "update_type", "e.*")
    kinds = ("created", "archived", "exercised")
    rows = _fields(rows, "wrapped", *[f"{kind}{end}" for kind in kinds for end in ("_event", "Event")], "event_type")
    bodies = [(kind, _first("wrapped", f"{kind}_event", f"{kind}Event")) for kind in kinds]
    kind = F.coalesce(*[F.when(body.isNotNull(), F.lit(kind)) for kind, body in bodies], F.col("wrapped_event_type"))
    bare = F.coalesce(*[body for _, body in bodies], F.col("wrapped"))
    created, archived = F.col("created"), F.col("archived")
    moved = F.col("update_type") == "reassignment"
    moved_id = F.coalesce(_j(created, "event_id"), _j(archived, "event_id"), F.concat("update_id", F.lit(":reassign")))
    moved_type = F.when(created.isNotNull(), "reassign_create").otherwise("reassign_archive")
    return rows.select(*keep, F.when(moved, moved_id).otherwise(F.col("key")).alias("event_id"), F.when(moved, moved_type).otherwise(kind).alias("event_type"), F.when(moved, F.coalesce(created, archived)).otherwise(bare).alias("event"))


def normalize_event(extracted: DataFrame) -> DataFrame:
    """Typed events from ``extract_events``. Payload: created arguments, choice argument, or none. Effective time:
    a created event's own creation time, else the update's effective time, its record time, then created_at; rows
    without any have null. Package: the event's, else that of its template id."""
    payload = ("create_arguments", "createArguments", "choice_argument", "choiceArgument", "payload")
    lists = (("signatories",), ("observers",), ("acting_parties", "actingParties"), ("child_event_ids", "childEventIds"))
    texts = (("created_at", "createdAt"), ("contract_id", "contractId"), ("template_id", "templateId"), ("package_name", "packageName"), ("choice",), ("consuming",), ("exercise_result", "exerciseResult"))
    keep = ["event_id", "update_id", "migration_id", "synchronizer_id", "event_type", "effective_at", "record_time", "event"]
    one = lambda *n: _first("event", *n)
    rows = _fields(extracted.select(*keep), "event", *payload, *[n for names in (*lists, *texts) for n in names])
    made = F.try_to_timestamp(one("created_at", "createdAt"))
    at = F.when(F.col("event_type").isin("created", "reassign_create"), F.coalesce(made, "effective_at", "record_time")).otherwise(F.coalesce("effective_at", "record_time", made))
    template = one("template_id", "templateId")
    parties = lambda *n: F.coalesce(F.from_json(one(*n), "array<string>"), F.array().cast("array<string>")).alias(n[0])
    return rows.select(
        "event_id", "update_id", "migration_id", "synchronizer_id", "event_type", one("contract_id", "contractId").alias("contract_id"), template.alias("template_id"),
        F.coalesce(one("package_name", "packageName"), package_of(template)).alias("package_name"), at.alias("effective_at"), "record_time",
        one(*payload).alias("payload"), one("choice").alias("choice"), one("consuming").try_cast("boolean").alias("consuming"),
        one("exercise_result", "exerciseResult").alias("exercise_result"), *[parties(*names) for names in lists], F.col("event").alias("raw_event"),
    )


def tree_order(events: DataFrame) -> DataFrame:
    """(update_id, event_id, ordinal): preorder place of every event in its update's tree. events: update_id, event_id,
    root_event_ids (of the update), child_event_ids. Events on a cycle are visited once; those that no root reaches
    come last, by id. Rows are sorted by update; a task holds one update's ids (some fifteen) at a time."""

    def order(children: dict[str, list[str]], roots: list[str]) -> list[str]:
        seen: dict[str, None] = {}
        for start in [*roots, *sorted(children)]:
            stack = [start]
            while stack:
                one = stack.pop()
                if one in children and one not in seen:
                    seen[one] = None
                    stack.extend(reversed(children[one]))
        return list(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        update, children, roots = None, {}, None
        for batch in batches:
            done: list[tuple[str | None, list[str]]] = []
            for u, event, own, below in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if u != update and children:
                    done.append((update, order(children, roots or [])))
                    children, roots = {}, None
                update, roots = u, own if roots is None else roots
                children[event] = below or []
            yield placed(done)
        if children:
            yield placed([(update, order(children, roots or []))])

    def placed(done: list[tuple[str | None, list[str]]]) -> pa.RecordBatch:
        updates = pa.array([u for u, ids in done for _ in ids], pa.string())
        ids = pa.array([i for _, ids in done for i in ids], pa.string())
        return pa.RecordBatch.from_arrays([updates, ids, pa.array([n for _, ids in done for n in range(len(ids))], pa.int64())], names=["update_id", "event_id", "ordinal"])

    rows = events.where("event_id is not null").select("update_id", "event_id", "root_event_ids", "child_event_ids")
    return rows.repartition("update_id").sortWithinPartitions("update_id").mapInArrow(run, "update_id string, event_id string, ordinal long")


def normalize_acs_contract(raw: DataFrame) -> DataFrame:
    """Snapshot contracts: typed times (missing ones stay null), template parts, payload from either argument name."""
    t = F.col("template_id")
    return raw.select(
        "contract_id", "event_id", "template_id", F.coalesce("package_name", package_of(t)).alias("package_name"), module_of(t).alias("module_name"), entity_of(t).alias("entity_name"),
        "migration_id", F.try_to_timestamp("record_time").alias("record_time"), F.try_to_timestamp("snapshot_time").alias("snapshot_time"), "signatories", "observers", "payload", "raw",
    )


def utc_partition(df: DataFrame, at: str = "effective_at") -> DataFrame:
    """With year, month and day of the UTC time; ``partition_ok`` is false for a null time or a year out of bounds."""
    c = F.col(at)
    return df.select("*", F.year(c).alias("year"), F.month(c).alias("month"), F.dayofmonth(c).alias("day"), F.coalesce(in_years(c), F.lit(False)).alias("partition_ok"))

