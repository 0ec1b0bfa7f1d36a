"""Normalisation, lookup, quality and deduplication queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.functions import columns as C
from ledgerloom.operators import bronze as B
from ledgerloom.operators import lifecycle as L
from ledgerloom.operators import lookup as K
from ledgerloom.operators import quality as Q
from ledgerloom.plans.digest import plain
from ledgerloom.plans.metric_queries import D, IS, J, R, T, as_of, trunc_diff
from ledgerloom.plans.oracles import sql
from ledgerloom.sources import derive, io
from ledgerloom.sources.schemas import TEMPLATES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
E, U, A = "ledger_events", "ledger_updates", "ledger_acs"


def add(name: str, query: Callable[[Callable[[str], DataFrame]], DataFrame], text: str | None, *ctes: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(query(lambda frame: getattr(derive, frame)(spark, sf_dir)))
    if text is not None:
        ORACLE_SQL[name] = sql(text, *ctes)


def _raw(events: DataFrame) -> DataFrame:
    """Events as text, as they are landed; every 13th time and every 17th payload is damaged."""
    n = F.expr("cast(substring(contract_id, 2) as bigint)")
    at = F.when(n % 13 == 0, "not a time").otherwise(F.date_format("effective_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return events.select("event_id", "update_id", "contract_id", "event_type", "template_id", "migration_id", at.alias("effective_at"), F.when(n % 17 == 0, "{broken").otherwise(F.col("payload")).alias("payload"), "signatories")


def _schema_coverage(updates: DataFrame) -> DataFrame:
    """A declared schema against the updates' columns, with the number of values in each."""
    declared = StructType.fromDDL("update_id string, event_count long, offset string, root_event_ids array<string>, source_synchronizer string")
    return Q.schema_diff(declared, updates).join(Q.column_population(updates).select("column", "filled"), "column", "left")


_N = "CAST(substr(contract_id, 2) AS BIGINT)"
add("parse_events", lambda f: B.parse_events(_raw(f(E))).withColumn("payload", F.get_json_object("payload", "$.owner")), f"""
SELECT event_id, update_id, contract_id, event_type, template_id, migration_id, CASE WHEN {_N} % 13 <> 0 THEN strftime(effective_at, '%Y-%m-%d %H:%M:%S') END AS effective_at,
  CASE WHEN {_N} % 17 <> 0 THEN {J("owner")} END AS payload, array_to_string(signatories, ',') AS signatories, CASE WHEN {_N} % 13 <> 0 THEN strftime(effective_at, '%Y-%m-%d') END AS event_date FROM ev""")
add("parse_updates", lambda f: B.parse_updates(f(U).drop("record_date").withColumn("record_time", F.date_format("record_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("effective_at", F.col("effective_at").cast("string"))).select("update_id", "record_time", "effective_at", "record_date", "event_count"),
    f"SELECT update_id, {T('record_time')}, {T('effective_at')}, strftime(record_time, '%Y-%m-%d') AS record_date, event_count FROM up")


def raw_updates(f) -> DataFrame:
    """Landed transactions: created (and exercised) events of fifteen contracts as nested JSON; every seventh is a reassignment."""
    ev = f(E).where("event_type <> 'archived'").select("update_id", "event_id", "contract_id", "template_id", "event_type", "choice", "effective_at", "synchronizer_id", "migration_id")
    iso = F.date_format("effective_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.when(F.col("event_type") == "created", F.concat(F.lit('{"created_event":{"event_id":"'), "event_id", F.lit('","contract_id":"'), "contract_id", F.lit('","template_id":"'), "template_id", F.lit('","created_at":"'), iso, F.lit('","create_arguments":{"v":1},"signatories":["dso"]}}')))
    body = body.otherwise(F.concat(F.lit('{"exercised_event":{"event_id":"'), "event_id", F.lit('","contract_id":"'), "contract_id", F.lit('","template_id":"'), "template_id", F.lit('","choice":"'), "choice", F.lit('","consuming":true,"choice_argument":{"v":2}}}')))
    rows = ev.select("update_id", "migration_id", "synchronizer_id", "effective_at", F.concat(F.lit('"'), "event_id", F.lit('":'), body).alias("entry"))
    grouped = rows.groupBy("update_id").agg(F.min("migration_id").alias("m"), F.min("synchronizer_id").alias("s"), F.min("effective_at").alias("at"), F.array_join(F.sort_array(F.collect_list("entry")), ",").alias("entries"))
    at = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    moved = F.expr("cast(substring(update_id, 2) as bigint) % 7 = 0")
    tx = F.concat(F.lit('{"migration_id":'), F.col("m").cast("string"), F.lit(',"transaction":{"update_id":"'), "update_id", F.lit('","synchronizer_id":"'), "s", F.lit('","record_time":"'), at, F.lit('","effective_at":"'), at, F.lit('","root_event_ids":[],"events_by_id":{'), "entries", F.lit("}}}"))
    re = F.concat(F.lit('{"migration_id":'), F.col("m").cast("string"), F.lit(',"reassignment":{"update_id":"'), "update_id", F.lit('","source":"a","target":"b","counter":"3","record_time":"'), at, F.lit('","event":{"created_event":{"event_id":"'), "update_id", F.lit(':r","contract_id":"x","template_id":"p:M:E","created_at":"'), at, F.lit('"}}}}'))
    return grouped.select(F.when(moved, re).otherwise(tx).alias("json"))


add("schema_diff", lambda f: _schema_coverage(f(U).select("update_id", "event_count", "offset", "source_synchronizer", "record_date")), """
SELECT s.*, CASE s."column" WHEN 'update_id' THEN n1 WHEN 'event_count' THEN n2 WHEN 'offset' THEN n3 WHEN 'source_synchronizer' THEN n4 WHEN 'record_date' THEN n5 END AS filled
FROM (SELECT count(update_id) AS n1, count(event_count) AS n2, count("offset") AS n3, count(source_synchronizer) AS n4, count(record_date) AS n5 FROM up), (VALUES ('update_id', 'string', 'string', 'match'), ('event_count', 'bigint', 'bigint', 'match'),
  ('offset', 'string', 'bigint', 'type'), ('root_event_ids', 'array<string>', NULL, 'missing'), ('source_synchronizer', 'string', 'string', 'match'), ('record_date', NULL, 'date', 'extra')) s("column", expected, actual, state)""")
add("normalize_updates", lambda f: B.split_unknown(B.normalize_update(raw_updates(f)))[0].select("update_id", "update_type", "migration_id", "record_time", "event_count", "source_synchronizer", "reassignment_counter"), f"""
SELECT update_id, CASE WHEN moved THEN 'reassignment' ELSE 'transaction' END AS update_type, m AS migration_id, {T("at_min", "record_time")}, CASE WHEN moved THEN 1 ELSE n END AS event_count, CASE WHEN moved THEN 'a' END AS source_synchronizer, CASE WHEN moved THEN 3::BIGINT END AS reassignment_counter
FROM (SELECT update_id, CAST(substr(update_id, 2) AS BIGINT) % 7 = 0 AS moved, min(migration_id) AS m, min(effective_at) AS at_min, count(*) AS n FROM ev WHERE event_type <> 'archived' GROUP BY update_id)""")
add("extract_events", lambda f: B.normalize_event(B.extract_events(B.normalize_update(raw_updates(f)))).select("event_id", "update_id", "event_type", "contract_id", "package_name", "effective_at", "choice", "consuming"), f"""
SELECT event_id, update_id, event_type, contract_id, 'a1b2c3' AS package_name, {T("CASE WHEN event_type = 'created' THEN effective_at ELSE min(effective_at) OVER (PARTITION BY update_id) END", "effective_at")}, choice, CASE WHEN event_type = 'exercised' THEN true END AS consuming
FROM ev WHERE event_type <> 'archived' AND CAST(substr(update_id, 2) AS BIGINT) % 7 <> 0
UNION ALL SELECT update_id || ':r', update_id, 'reassign_create', 'x', 'p', strftime(min(effective_at), '%Y-%m-%d %H:%M:%S'), NULL, NULL FROM ev WHERE event_type <> 'archived' AND CAST(substr(update_id, 2) AS BIGINT) % 7 = 0 GROUP BY update_id""")
add("tree_order", lambda f: B.tree_order(f("ledger_base").select(
    F.expr("concat('u', cast(id div 15 as string))").alias("update_id"), F.expr("concat('e', cast(id as string))").alias("event_id"), F.expr("array(concat('e', cast((id div 15) * 15 as string)))").alias("root_event_ids"),
    F.expr("filter(array(concat('e', cast((id div 15) * 15 + (id % 15) * 2 + 1 as string)), concat('e', cast((id div 15) * 15 + (id % 15) * 2 + 2 as string))), x -> (id % 15) * 2 + 1 < 15)").alias("child_event_ids"))),
    "SELECT 'u' || (id // 15) AS update_id, 'e' || id AS event_id, row_number() OVER (PARTITION BY id // 15 ORDER BY bin(id % 15 + 1)) - 1 AS ordinal FROM base")
add("normalize_acs", lambda f: B.normalize_acs_contract(f(A).withColumn("event_id", F.lit(None).cast("string")).withColumn("package_name", F.lit(None).cast("string")).withColumn("observers", F.col("signatories")).withColumn("raw", F.col("payload")).withColumn("record_time", F.col("record_time").cast("string")).withColumn("snapshot_time", F.col("snapshot_time").cast("string"))).select("contract_id", "package_name", "module_name", "entity_name", "record_time", "snapshot_time"), f"""
SELECT contract_id, 'a1b2c3' AS package_name, split_part(template_id, ':', 2) AS module_name, split_part(template_id, ':', 3) AS entity_name, {T("record_time")}, {T("snapshot_time")} FROM acs""")
add("template_parts", lambda f: f(E).select("template_id").distinct().select("template_id", C.package_of(F.col("template_id")).alias("package"), C.module_of(F.col("template_id")).alias("module"), C.entity_of(F.col("template_id")).alias("entity"), C.template_key(F.col("template_id")).alias("key"), C.template_format(F.col("template_id")).alias("format")), """
SELECT DISTINCT template_id, split_part(template_id, ':', 1) AS package, split_part(template_id, ':', 2) AS module, split_part(template_id, ':', 3) AS entity, split_part(template_id, ':', 2) || ':' || split_part(template_id, ':', 3) AS key, 'package' AS format FROM ev""")
add("utc_partitions", lambda f: B.utc_partition(f(E)).groupBy("migration_id", "year", "month", "day", "partition_ok").agg(F.count("*").alias("rows")), """
SELECT migration_id, CAST(year(effective_at) AS BIGINT) AS year, CAST(month(effective_at) AS BIGINT) AS month, CAST(day(effective_at) AS BIGINT) AS day, year(effective_at) BETWEEN 2020 AND 2035 AS partition_ok, count(*) AS rows FROM ev GROUP BY ALL""")
add("token_amounts", lambda f: f(A).where("template_id like '%Amulet'").select("contract_id", "snapshot_time", C.pick_owner(F.col("payload")).alias("owner"), C.pick_amount(F.col("payload")).alias("amount"), C.pick_locked_amount(F.col("payload")).alias("locked_amount"), C.to_coin(C.pick_amount(F.col("payload")) * 1_000_000).alias("coins")), f"""
SELECT contract_id, {T("snapshot_time")}, {J("owner")} AS owner, {R("a", "amount")}, {R("b", "locked_amount")}, {R("a / 10000", "coins")} FROM (SELECT *, TRY_CAST({J("amount.initialAmount")} AS DOUBLE) AS a, TRY_CAST({J("amulet.amount.initialAmount")} AS DOUBLE) AS b FROM acs WHERE template_id LIKE '%Amulet')""")
add("ledger_times", lambda f: f("ledger_base").select("id", C.normal_time(F.expr("case id % 5 when 0 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") when 1 then cast(unix_seconds(ts) as string) when 2 then concat('{\"microsecondsSinceEpoch\":\"', cast(unix_micros(ts) as string), '\"}') when 3 then concat('{\"seconds\":', cast(unix_seconds(ts) as string), ',\"nanos\":0}') else concat('{\"unixtime\":\"', cast(unix_seconds(ts) as string), '\"}') end")).alias("at")),
    f"SELECT id, {T('ts', 'at')} FROM base")

# lookups
add("events_by_type", lambda f: K.events_where(f(E), kind="archived").select("event_id", "contract_id", "effective_at"), f"SELECT event_id, contract_id, {T('effective_at')} FROM ev WHERE event_type = 'archived'")
add("events_by_template", lambda f: K.events_where(f(E), template="MiningRound").select("event_id", "template_id"), "SELECT event_id, template_id FROM ev WHERE template_id LIKE '%MiningRound%'")
add("events_by_date", lambda f: K.events_where(f(E), start="2024-01-05", end="2024-01-08").select("event_id", "effective_at"), f"SELECT event_id, {T('effective_at')} FROM ev WHERE effective_at >= TIMESTAMP '2024-01-05' AND effective_at < TIMESTAMP '2024-01-08'")
add("latest_events", lambda f: K.page(f(E), 50, 10).select("event_id", "recorded_at"), f"SELECT event_id, {T('recorded_at')} FROM (SELECT event_id, recorded_at FROM ev ORDER BY recorded_at DESC NULLS LAST, event_id LIMIT 50 OFFSET 10)")
for _set, _entities in K.SETS.items():
    add(f"{_set}_events", lambda f, s=_set: K.event_set(f(E), s).select("event_id", "event_type", "template_id"), f"SELECT event_id, event_type, template_id FROM ev WHERE {' OR '.join(IS(e) for e in _entities)}")
add("search_events", lambda f: K.search_events(f(E), text="NAME42", party="dso", kind="created").select("event_id", "template_id"), f"""
SELECT event_id, template_id FROM ev WHERE event_type = 'created' AND (lower(contract_id) LIKE '%name42%' OR lower(template_id) LIKE '%name42%' OR lower(payload) LIKE '%name42%') AND (list_contains(signatories, 'dso') OR list_contains(observers, 'dso'))""")
add("contract_prefix", lambda f: K.contract_prefix(f(E), "c12"), f"SELECT contract_id, template_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS first_seen FROM (SELECT contract_id, template_id, min(effective_at) AS s FROM ev WHERE starts_with(contract_id, 'c12') GROUP BY 1, 2 ORDER BY s DESC, contract_id, template_id LIMIT 50)")
add("party_list", lambda f: K.party_list(f(E)), "SELECT DISTINCT unnest(list_concat(signatories, observers)) AS party FROM ev")
add("party_search", lambda f: K.party_search(f(E), "P1"), "SELECT * FROM (SELECT DISTINCT unnest(list_concat(signatories, observers)) AS party FROM ev) WHERE party LIKE '%p1%'")
add("party_events", lambda f: K.party_events(f(E), "p7").select("event_id", "effective_at"), f"SELECT event_id, {T('effective_at')} FROM ev WHERE list_contains(signatories, 'p7') OR list_contains(observers, 'p7')")
add("party_activity", lambda f: K.activity_of(f(E), ["p3", "p5", "p8"]).select("event_id", "matched"), """
SELECT event_id, array_to_string(m, ',') AS matched FROM (SELECT event_id, list_sort(list_filter(['p3', 'p5', 'p8'], lambda p: list_contains(signatories, p) OR list_contains(observers, p) OR list_contains(acting_parties, p))) AS m FROM ev) WHERE len(m) > 0""")
add("contract_history", lambda f: K.contract_history(f(E), "c30").select("event_id", "event_type", "effective_at"), f"SELECT event_id, event_type, {T('effective_at')} FROM ev WHERE contract_id = 'c30'")
add("keyset_page", lambda f: K.keyset_page(f(E), "2024-01-20 00:00:00", 40).select("event_id", "recorded_at", "has_more", "next_cursor"), f"""
SELECT event_id, {T("recorded_at")}, true AS has_more, {T("min(recorded_at) OVER ()", "next_cursor")} FROM (SELECT * FROM ev WHERE recorded_at < TIMESTAMP '2024-01-20' ORDER BY recorded_at DESC, event_id LIMIT 40)""")
add("latest_updates", lambda f: K.latest_updates(f(U), 30).select("update_id", "record_time", "total", "has_more"), f"SELECT update_id, {T('record_time')}, (SELECT count(*) FROM up) AS total, (SELECT count(*) FROM up) > 30 AS has_more FROM (SELECT * FROM up ORDER BY record_time DESC NULLS LAST, update_id LIMIT 30)")

# quality
def F_(severity: str, check: str, scope: str, detail: str, affected: str, total: str = "CAST(NULL AS BIGINT)") -> str:
    return f"{severity} AS severity, '{check}' AS \"check\", CAST({scope} AS VARCHAR) AS scope, CAST({detail} AS VARCHAR) AS detail, CAST({affected} AS BIGINT) AS affected, {total} AS total"


_sparse = lambda f: f(U).where("day(record_date) % 6 <> 0")
_SPARSE = "up WHERE day(record_date) % 6 <> 0"
add("missing_days", lambda f: Q.missing_days(_sparse(f), ["migration_id"], "record_date"), f"""
SELECT {F_("'error'", "missing_days", "migration_id", "d", "1")} FROM (SELECT migration_id, CAST(unnest(generate_series(CAST(min(record_date) AS TIMESTAMP), CAST(max(record_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM {_SPARSE} GROUP BY migration_id)
WHERE (migration_id, d) NOT IN (SELECT (migration_id, record_date) FROM {_SPARSE})""")
add("coverage_by_day", lambda f: Q.coverage_by_day(_sparse(f), ["migration_id"], "record_date"), f"""
SELECT migration_id, {D("d", "record_date")}, coalesce(n, 0) AS rows FROM (SELECT migration_id, CAST(unnest(generate_series(CAST(min(record_date) AS TIMESTAMP), CAST(max(record_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM {_SPARSE} GROUP BY migration_id)
LEFT JOIN (SELECT migration_id, record_date AS d, count(*) AS n FROM {_SPARSE} GROUP BY ALL) USING (migration_id, d)""")
add("time_gaps", lambda f: Q.time_gaps(f(E).groupBy("synchronizer_id", "update_id").agg(F.min("effective_at").alias("start"), F.max("recorded_at").alias("end")).select("synchronizer_id", "start", "end"), "synchronizer_id", 1800), f"""
SELECT synchronizer_id, {T("gap_start")}, {T('"start"', "gap_end")}, gap_ms, CAST(sum(gap_ms) OVER (PARTITION BY synchronizer_id) AS BIGINT) AS total_gap_ms FROM (
  SELECT *, CAST((epoch_us("start") - epoch_us(gap_start)) // 1000 AS BIGINT) AS gap_ms FROM (SELECT *, max("end") OVER (PARTITION BY synchronizer_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start
    FROM (SELECT synchronizer_id, update_id, min(effective_at) AS "start", max(recorded_at) AS "end" FROM ev GROUP BY 1, 2))) WHERE gap_ms > 1800000""")
add("intra_day_gaps", lambda f: Q.intra_day_gaps(f(U), "synchronizer_id", "record_time", 3600), f"""
SELECT {F_("'warning'", "intra_day_gaps", "synchronizer_id", "strftime(b, '%Y-%m-%d %H:%M:%S')", "s")} FROM (SELECT synchronizer_id, b, {trunc_diff("second", "b", "record_time")} AS s FROM (
  SELECT synchronizer_id, record_time, lag(record_time) OVER (PARTITION BY synchronizer_id, CAST(record_time AS DATE) ORDER BY record_time) AS b FROM (SELECT DISTINCT synchronizer_id, record_time FROM up))) WHERE s > 3600""")
add("day_alignment", lambda f: Q.day_alignment(f(U).where("day(record_date) <> 7"), f(E).where("day(event_date) <> 9")), f"""
SELECT {F_("'error'", "day_alignment", "d", "CASE WHEN u IS NULL THEN 'updates missing' ELSE 'events missing' END", "1")} FROM (SELECT DISTINCT record_date AS d, 1 AS u FROM up WHERE day(record_date) <> 7) FULL JOIN (SELECT DISTINCT event_date AS d, 1 AS e FROM ev WHERE day(event_date) <> 9) USING (d) WHERE u IS NULL OR e IS NULL""")
add("null_critical", lambda f: Q.null_critical(f(E), ("event_id", "contract_id", "choice", "effective_at")), " UNION ALL ".join(f"SELECT {F_(f'CASE WHEN count(*) > count({c}) THEN {chr(39)}error{chr(39)} ELSE {chr(39)}ok{chr(39)} END', 'null_critical', repr(c), chr(39) + 'nulls' + chr(39), f'count(*) - count({c})', 'count(*)')} FROM ev" for c in ("event_id", "contract_id", "choice", "effective_at")))
_twice = lambda f: f(E).unionByName(f(E).where("event_type = 'archived'"))
_TWICE = "(SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE event_type = 'archived')"
add("duplicate_ids", lambda f: Q.duplicate_ids(_twice(f), "event_id", "migration_id"), f"SELECT {F_('CASE WHEN count(event_id) > count(DISTINCT event_id) THEN ' + repr('error') + ' ELSE ' + repr('ok') + ' END', 'duplicate_ids', 'migration_id', repr('event_id'), 'count(event_id) - count(DISTINCT event_id)', 'count(*)')} FROM {_TWICE} GROUP BY migration_id")
add("partition_mismatch", lambda f: Q.partition_mismatch(f(E).select("effective_at", "migration_id", F.year("recorded_at").alias("path_year"), F.month("recorded_at").alias("path_month"), F.dayofmonth("recorded_at").alias("path_day"), F.col("migration_id").alias("path_migration")), "effective_at"), f"""
SELECT {F_("'error'", "partition_mismatch", "migration_id || '/' || year(recorded_at) || '/' || month(recorded_at) || '/' || day(recorded_at)", "'effective_at'", "count(*) FILTER (CAST(effective_at AS DATE) <> CAST(recorded_at AS DATE))", "count(*)")} FROM ev
GROUP BY migration_id, year(recorded_at), month(recorded_at), day(recorded_at) HAVING count(*) FILTER (CAST(effective_at AS DATE) <> CAST(recorded_at AS DATE)) > 0""")
add("timestamp_sanity", lambda f: Q.timestamp_sanity(f(E).withColumn("recorded_at", F.expr("case when event_type = 'exercised' then recorded_at + interval 2 days else recorded_at end")), "recorded_at", "effective_at"), f"""
SELECT {F_("CASE WHEN n > 0 THEN 'warning' ELSE 'ok' END", "timestamp_sanity", "'effective_at'", "what", "n", "total")} FROM (SELECT 'recorded late' AS what, count(*) FILTER (event_type = 'exercised') AS n, count(*) AS total FROM ev UNION ALL SELECT 'year out of bounds', count(*) FILTER (year(effective_at) NOT BETWEEN 2020 AND 2035), count(*) FROM ev)""")
add("offset_duplicates", lambda f: Q.offset_duplicates(f(U).withColumn("offset", F.expr("case when offset % 10 = 0 then null else offset div 2 end"))), f"""
SELECT {F_("CASE WHEN count(o) > count(DISTINCT o) THEN 'error' ELSE 'ok' END", "offset_duplicates", "migration_id", "'offset'", "count(o) - count(DISTINCT o)", "count(*)")} FROM (SELECT migration_id, "offset" // 2 AS o FROM up WHERE "offset" % 10 <> 0) GROUP BY migration_id""")
_ORPHANS = f"""SELECT {F_("'error'", "orphan_events", "update_id", "strftime(event_date, '%Y-%m-%d')", "count(*)")} FROM ev
WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.update_id = ev.update_id AND "offset" % 9 <> 0 AND abs(date_diff('day', up.record_date, ev.event_date)) <= 1)"""
_MISCOUNTED = f"""SELECT {F_("'error'", "event_count_mismatch", "update_id", "n || ' observed, declared ' || event_count", "abs(n - event_count)")}
FROM (SELECT up.update_id, event_count, record_date, count(*) AS n FROM up JOIN ev ON ev.update_id = up.update_id AND abs(date_diff('day', up.record_date, ev.event_date)) <= 1 GROUP BY ALL) WHERE n <> event_count"""
add("orphan_events", lambda f: Q.orphan_events(f(E), f(U).where("offset % 9 <> 0")), _ORPHANS + " GROUP BY update_id, event_date")
add("event_count_mismatch", lambda f: Q.event_count_mismatch(f(E), f(U)), _MISCOUNTED)


def _by_day(df: DataFrame, day: str) -> DataFrame:
    """The frame landed in files by day and read back."""
    path = io.work_folder(df.sparkSession)
    df.repartition(day).write.partitionBy(day).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A range of days, as the daily job checks one; the files of no other days are read.
DAYS = ("2024-01-10", "2024-01-12")
_BETWEEN = f"BETWEEN DATE '{DAYS[0]}' AND DATE '{DAYS[1]}'"
add("orphans_of_days", lambda f: Q.orphan_events(_by_day(f(E).select("update_id", "event_date"), "event_date"), _by_day(f(U).where("offset % 9 <> 0").select("update_id", "record_date"), "record_date"), DAYS), _ORPHANS + f" AND event_date {_BETWEEN} GROUP BY update_id, event_date")
add("miscounted_of_days", lambda f: Q.event_count_mismatch(_by_day(f(E).select("update_id", "event_date"), "event_date"), _by_day(f(U).select("update_id", "event_count", "record_date"), "record_date"), DAYS), _MISCOUNTED + f" AND record_date {_BETWEEN}")
add("boundary_overlap", lambda f: Q.boundary_overlap(f(U).where("record_time < timestamp '2024-01-16'"), f(U).where("record_time > timestamp '2024-01-14'"), "update_id"), f"SELECT {F_('CASE WHEN count(*) > 0 THEN ' + repr('warning') + ' ELSE ' + repr('ok') + ' END', 'boundary_overlap', repr('update_id'), repr('in both sources'), 'count(*)')} FROM up WHERE record_time > TIMESTAMP '2024-01-14' AND record_time < TIMESTAMP '2024-01-16'")
add("missing_ids", lambda f: Q.missing_ids(f(U), f(U).where("offset % 8 <> 0"), "update_id"), 'SELECT update_id FROM up WHERE "offset" % 8 = 0')
add("acs_checks", lambda f: Q.acs_checks(f(A).unionByName(f(A).where("template_id like '%:Amulet'")), f(A).where("complete").select("migration_id", "snapshot_time")), f"""
SELECT {F_("'error'", "acs_checks", "migration_id || '/' || strftime(snapshot_time, '%Y-%m-%d %H:%M:%S')", "what", "n", "total")} FROM (
  SELECT migration_id, snapshot_time, 'repeated contracts' AS what, count(*) - count(DISTINCT contract_id) AS n, count(*) AS total FROM (SELECT * FROM acs UNION ALL SELECT * FROM acs WHERE {IS("Amulet")}) GROUP BY 1, 2
  UNION ALL SELECT migration_id, snapshot_time, 'no marker', 1, count(*) FROM (SELECT * FROM acs UNION ALL SELECT * FROM acs WHERE {IS("Amulet")}) GROUP BY 1, 2 HAVING NOT bool_or(complete)) WHERE n > 0""")
_CHECKED = ("effective_at", "payload")
_beside = lambda raw: raw.withColumns({f"raw_{c}": F.col(c) for c in _CHECKED})
add("transform_verification", lambda f: Q.transform_verification(_raw(f(E)), B.parse_events(_beside(_raw(f(E)))), _CHECKED, "raw_"), f"""
SELECT {F_("CASE WHEN n <> 0 THEN 'error' ELSE 'ok' END", "transform_verification", "'events'", "what", "n", "total")} FROM (SELECT 'row difference' AS what, 0 AS n, count(*) AS total FROM ev UNION ALL SELECT 'parse loss: effective_at', count(*) FILTER ({_N} % 13 = 0), count(*) FROM ev UNION ALL SELECT 'parse loss: payload', count(*) FILTER ({_N} % 17 = 0), count(*) FROM ev)""")
add("completeness", lambda f: Q.completeness(f(U), f(U).where("offset % 8 <> 0"), "update_id", "record_date"), f"""
SELECT {D("record_date", "day")}, count(*) AS expected, count(*) FILTER ("offset" % 8 <> 0) AS present, count(*) FILTER ("offset" % 8 = 0) AS missing, {R('count(*) FILTER ("offset" % 8 = 0) * 100.0 / count(*)', "drift_pct")} FROM up GROUP BY record_date""")
add("completeness_of_days", lambda f: Q.completeness(_by_day(f(U).select("update_id", "record_date"), "record_date"), _by_day(f(U).where("offset % 8 <> 0").select("update_id", "record_date"), "record_date"), "update_id", "record_date", DAYS), f"""
SELECT {D("record_date", "day")}, count(*) AS expected, count(*) FILTER ("offset" % 8 <> 0) AS present, count(*) FILTER ("offset" % 8 = 0) AS missing, {R('count(*) FILTER ("offset" % 8 = 0) * 100.0 / count(*)', "drift_pct")} FROM up WHERE record_date {_BETWEEN} GROUP BY record_date""")
add("column_population", lambda f: Q.column_population(f(E).select("event_id", "choice", "interface_id", "consuming")), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS filled, count(*) AS total, {R(f'count({c}) / count(*)', 'rate')} FROM ev" for c in ("event_id", "choice", "interface_id", "consuming")))


def _registry(f) -> DataFrame:
    names = [(t, k % 2 == 0) for k, t in enumerate((*TEMPLATES[3:], "Splice.Wallet:Allocation", "Splice.Wallet:Offer"))]
    return f("ledger_base").sparkSession.createDataFrame(names, "template string, required boolean")


_REGISTRY = ", ".join(f"('{t}', {'true' if k % 2 == 0 else 'false'})" for k, t in enumerate((*TEMPLATES[3:], "Splice.Wallet:Allocation", "Splice.Wallet:Offer")))
add("template_registry", lambda f: Q.template_registry_check(f(A), _registry(f)), f"""
SELECT {F_("CASE WHEN n IS NULL AND required THEN 'error' WHEN n IS NOT NULL AND required IS NOT NULL THEN 'ok' ELSE 'warning' END", "template_registry", "t", "CASE WHEN required IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' ELSE 'expected' END", "coalesce(n, 0)")}
FROM (SELECT substr(template_id, 8) AS t, count(*) AS n FROM acs GROUP BY 1) FULL JOIN (VALUES {_REGISTRY}) r(t, required) USING (t)""")
add("contract_fields", lambda f: Q.contract_field_check(f(A).select("contract_id", F.expr("case when migration_id = 0 then null else template_id end").alias("template_id"), F.expr("case when snapshot_time > timestamp '2024-01-25' then null else record_time end").alias("record_time")), ("contract_id", "template_id"), ("record_time",)), """
SELECT contract_id, CASE WHEN migration_id = 0 THEN 'template_id' ELSE '' END AS critical, CASE WHEN snapshot_time > TIMESTAMP '2024-01-25' THEN 'record_time' ELSE '' END AS important, CASE WHEN migration_id = 0 THEN 'error' ELSE 'warning' END AS severity FROM acs WHERE migration_id = 0 OR snapshot_time > TIMESTAMP '2024-01-25'""")
add("repair_plan", lambda f: Q.partition_repair_plan(f(E).select(F.concat(F.lit("f"), F.substring("update_id", 2, 3)).alias("file"), F.to_date("recorded_at").alias("path_day"), "effective_at")), f"""
SELECT file, {D("path_day")}, count(*) AS rows, count(DISTINCT CAST(effective_at AS DATE)) AS days, CASE WHEN count(DISTINCT CAST(effective_at AS DATE)) = 1 AND min(CAST(effective_at AS DATE)) = path_day THEN 'skip' WHEN count(DISTINCT CAST(effective_at AS DATE)) = 1 THEN 'move' ELSE 'split' END AS action
FROM (SELECT 'f' || substr(update_id, 2, 3) AS file, CAST(recorded_at AS DATE) AS path_day, effective_at FROM ev) GROUP BY file, path_day""")
add("rematerialize_check", lambda f: Q.rematerialize_check(f(U), f(E)), f"""
SELECT {D("record_date", "day")}, CAST(sum(event_count) AS BIGINT) AS declared, coalesce(any_value(n), 0) AS extracted, coalesce(any_value(n), 0) BETWEEN sum(event_count) AND sum(event_count) + 2 * count(*) FILTER (update_type = 'reassignment') AS "within"
FROM up LEFT JOIN (SELECT record_date AS d, count(*) AS n FROM ev JOIN up USING (update_id) GROUP BY 1) ON d = record_date GROUP BY record_date""")
_CATEGORIES = "CASE WHEN m LIKE 'Splice.AmuletRules%' THEN 'rules' WHEN m LIKE 'Splice.Amulet%' THEN 'token' WHEN m LIKE 'Splice.ValidatorLicense%' THEN 'validator' WHEN m LIKE 'Splice.DsoRules%' OR m LIKE 'Splice.DSO%' THEN 'governance' WHEN m LIKE 'Splice.Round%' THEN 'round' WHEN m LIKE 'Splice.Ans%' THEN 'names' WHEN m LIKE 'Splice.DecentralizedSynchronizer%' THEN 'traffic' WHEN m LIKE 'Splice.ExternalParty%' THEN 'transfer' ELSE 'other' END"
add("discover_templates", lambda f: Q.discover_templates(f(E)), f"SELECT substr(template_id, 8) AS template, e AS entity, {_CATEGORIES} AS category, 'package' AS format, count(*) AS events, count(DISTINCT contract_id) AS contracts FROM (SELECT *, split_part(template_id, ':', 2) AS m, split_part(template_id, ':', 3) AS e FROM ev) GROUP BY 1, 2, 3")
add("reconcile_counts", lambda f: Q.reconcile_counts(f(U).groupBy("update_type").agg(F.sum("event_count").alias("recorded")), f(E).join(f(U).select("update_id", "update_type"), "update_id").groupBy("update_type").agg(F.count("*").alias("observed")), "update_type"), f"""
SELECT update_type, recorded, observed, CASE WHEN observed = recorded THEN 'match' WHEN observed < recorded THEN 'missing' ELSE 'extra' END AS state, {R("(observed - recorded) * 100.0 / recorded", "difference_pct")}
FROM (SELECT update_type, CAST(sum(event_count) AS BIGINT) AS recorded FROM up GROUP BY 1) JOIN (SELECT update_type, count(*) AS observed FROM ev JOIN up USING (update_id) GROUP BY 1) USING (update_type)""")
add("canonical_score", lambda f: Q.canonical_field_score(f(E), {"has_payload": (F.col("payload").isNotNull(), 3.0), "has_choice": (F.col("choice").isNotNull(), 1.0), "indexed_id": (F.col("event_id").rlike(r"^e\d+:\d+$"), 2.0)}), f"""
SELECT 1.0::DOUBLE AS has_payload, {R("c", "has_choice")}, 1.0::DOUBLE AS indexed_id, {R("(3 + c + 2) / 6", "score")} FROM (SELECT avg(CASE WHEN choice IS NOT NULL THEN 1.0 ELSE 0.0 END) AS c FROM ev)""")
add("source_overlap_days", lambda f: Q.source_overlap_days(f(U).where("migration_id = 0"), f(U).where("offset % 4 = 0"), "record_date"), f'SELECT {D("record_date")} FROM (SELECT record_date FROM up WHERE migration_id = 0 INTERSECT SELECT record_date FROM up WHERE "offset" % 4 = 0)')
add("partial_days", lambda f: Q.partial_days(f(U).where("day(record_date) % 5 <> 0"), f(E).where("day(event_date) % 7 <> 0"), "2024-01-20"), f"""
SELECT {F_("'error'", "day_alignment", "d", "CASE WHEN u IS NULL THEN 'updates missing' ELSE 'events missing' END", "1")} FROM (SELECT DISTINCT record_date AS d, 1 AS u FROM up WHERE day(record_date) % 5 <> 0) FULL JOIN (SELECT DISTINCT event_date AS d, 1 AS e FROM ev WHERE day(event_date) % 7 <> 0) USING (d) WHERE (u IS NULL OR e IS NULL) AND CAST(d AS VARCHAR) < '2024-01-20'""")
add("backfill_day_counts", lambda f: Q.day_counts(f(U), "migration_id", "record_date"), f"SELECT migration_id, {D('record_date')}, count(*) AS rows FROM up GROUP BY migration_id, record_date")
add("backfill_summary", lambda f: Q.backfill_summary(f(U), "record_date"), f"SELECT {D('min(record_date)', 'earliest')}, {D('max(record_date)', 'latest')}, count(DISTINCT record_date) AS days, count(*) AS rows FROM up")
add("dedup_latest", lambda f: Q.dedup_latest(f(E).select("contract_id", "recorded_at", "event_id", "event_type"), "contract_id", "recorded_at").select("contract_id", "event_type", "recorded_at"), f"SELECT contract_id, event_type, {T('recorded_at')} FROM ev QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY ev.recorded_at DESC, event_id DESC) = 1")
add("dedup_two_pass", lambda f: Q.dedup_two_pass(_twice(f).select("event_id", "event_type", "recorded_at"), "event_id", "recorded_at").select("event_id", "event_type", "recorded_at"), f"SELECT event_id, event_type, {T('recorded_at')} FROM ev")
add("sample_comparison", lambda f: Q.sample_comparison(_raw(f(E)), B.parse_events(_raw(f(E))), "event_id", "effective_at", "effective_at"), f"""
SELECT event_id, CASE WHEN {_N} % 13 = 0 THEN 'not a time' ELSE strftime(effective_at, '%Y-%m-%dT%H:%M:%SZ') END AS raw_value, CASE WHEN {_N} % 13 <> 0 THEN strftime(effective_at, '%Y-%m-%d %H:%M:%S') END AS parsed_value, CASE WHEN {_N} % 13 <> 0 THEN true END AS agree FROM ev""")
add("stored_vote_results", lambda f: K.stored_vote_results(L.unique_proposals(f(E), as_of(), threshold=2), status="passed", limit=40).select("proposal_id", "latest_at"), f"""
SELECT proposal_id, strftime(at_max, '%Y-%m-%d %H:%M:%S') AS latest_at FROM (SELECT {J("trackingCid")} AS proposal_id, max(effective_at) AS at_max, arg_max(len(list_filter(json_extract_string(payload, '$.votes.*.accept'), lambda v: v = 'true')), {{'a': effective_at, 'b': contract_id}}) AS yes FROM ev WHERE event_type = 'created' AND {IS("VoteRequest")} GROUP BY 1)
WHERE yes >= 2 ORDER BY at_max DESC, proposal_id LIMIT 40""")
