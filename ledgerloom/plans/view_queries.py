"""One query per template view, with SQL generated from the same column list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import views
from ledgerloom.plans.digest import plain
from ledgerloom.plans.oracles import sql
from ledgerloom.sources import derive


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(views.template_view(derive.ledger_events(spark, sf_dir), name))

    return run


def _text(path: str, payload: str) -> str:
    source, bare = ("exercise_result", path[7:]) if path.startswith("result:") else (payload, path)
    return f"json_extract_string({source}, '$.{bare}')"


def _typed(text: str, path: str, kind: str, payload: str) -> str:
    if kind == views.LONG:
        return f"TRY_CAST(TRY_CAST({text} AS DECIMAL(38, 10)) AS BIGINT)"
    if kind == views.DECIMAL:
        return f"round(CAST(TRY_CAST({text} AS DECIMAL(38, 10)) AS DOUBLE), 6)"
    if kind == views.BOOL:
        return f"TRY_CAST({text} AS BOOLEAN)"
    if kind == views.TIME:
        return f"strftime(TRY_CAST({text} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
    if kind == views.LIST:
        return f"array_to_string(json_extract_string({payload}, '$.{path}[*]'), ',')"
    if kind == views.SIZE:
        at = f"json_extract({payload}, '$.{path}')"
        return f"CAST(CASE json_type({at}) WHEN 'ARRAY' THEN json_array_length({at}) WHEN 'OBJECT' THEN len(json_keys({at})) END AS BIGINT)"
    if kind == views.JSON:
        return f"CAST(json_extract({payload}, '$.{path}') AS VARCHAR)"
    if kind == views.HAS:
        return f"json_extract({payload}, '$.{path}') IS NOT NULL"
    return text


def _sql(name: str) -> str:
    view = views.VIEWS[name]
    payload = "payload" if not view.explode else "entry"
    columns = []
    for c in view.keep:
        if c == "child_event_count":
            columns.append("CAST(len(child_event_ids) AS BIGINT) AS child_event_count")
        elif c in views.DERIVED:
            columns.append(f"{views.DERIVED[c]} AS {c}")
        elif c == "effective_at":
            columns.append("strftime(effective_at, '%Y-%m-%d %H:%M:%S') AS effective_at")
        elif c == "acting_parties":
            columns.append("array_to_string(acting_parties, ',') AS acting_parties")
        else:
            columns.append(c)
    if view.explode:
        columns.append(view.explode[1])
    for column, alternatives, kind in view.columns:
        paths = alternatives.split("|")
        text = f"coalesce({', '.join(_text(p, payload) for p in paths)})"
        typed = f"{_typed(text, paths[0], kind, payload)} AS {column}"
        if column == "time_locked":
            typed = f"CASE WHEN {_typed(text, paths[0], kind, payload)} THEN 'time_locked' WHEN json_array_length(payload, '$.lock.holders') > 0 THEN 'holder_locked' ELSE 'unknown' END AS lock_type"
        columns.append(typed)
    if name == "validator_license":
        at = "TRY_CAST(json_extract_string(payload, '$.faucetState.value.{}.number') AS BIGINT)"
        columns.append(f"{at.format('lastReceivedFor')} - {at.format('firstReceivedFor')} AS active_round_span")
    where = [f"event_type IN ({', '.join(repr(e) for e in view.events)})"]
    if view.entity:
        where.append(f"template_id LIKE '%:{view.entity}'")
    if view.where:
        where.append(f"({view.where})")
    source = "ev"
    if view.explode:
        path, key = view.explode
        inner = f"SELECT *, unnest(json_keys(payload, '$.{path}')) AS {key} FROM ev WHERE {' AND '.join(where)}"
        source = f"(SELECT *, json_extract(payload, '$.{path}.\"' || {key} || '\"') AS entry FROM ({inner}))"
        where = ["true"]
    return sql(f"SELECT {', '.join(columns)} FROM {source} WHERE {' AND '.join(where)}")


QUERIES = {f"view_{name}": _query(name) for name in views.VIEWS}
ORACLE_SQL = {f"view_{name}": _sql(name) for name in views.VIEWS}

QUERIES["view_transactions"] = lambda spark, sf_dir: plain(views.transactions(derive.ledger_updates(spark, sf_dir)))
ORACLE_SQL["view_transactions"] = sql(
    "SELECT update_id, migration_id, synchronizer_id, strftime(effective_at, '%Y-%m-%d %H:%M:%S') AS effective_at, event_count,"
    " json_extract_string(trace_context, '$.traceId') AS trace_id, json_extract_string(trace_context, '$.spanId') AS span_id FROM up WHERE update_type = 'transaction'"
)
QUERIES["view_reassignments"] = lambda spark, sf_dir: plain(views.reassignments(derive.ledger_updates(spark, sf_dir)))
ORACLE_SQL["view_reassignments"] = sql(
    "SELECT update_id, migration_id, strftime(effective_at, '%Y-%m-%d %H:%M:%S') AS effective_at, source_synchronizer, target_synchronizer, reassignment_counter"
    " FROM up WHERE update_type = 'reassignment'"
)
