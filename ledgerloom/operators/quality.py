"""Data quality: every check returns findings rows (severity, check, scope, detail, affected, total)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.columns import entity_of, template_category, template_format, template_key
from ledgerloom.sources.scratch import cut, dealt


def finding(df: DataFrame, check: str, severity: str | Column, scope: Column, detail: Column, affected: Column, total: Column | None = None) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(level.alias("severity"), F.lit(check).alias("check"), scope.cast("string").alias("scope"), detail.cast("string").alias("detail"), affected.cast("long").alias("affected"), (total if total is not None else F.lit(None)).cast("long").alias("total"))


def _calendar(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Every day between the first and last day of each key group."""
    ends = df.groupBy(*keys).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return ends.select(*keys, F.explode(F.sequence("a", "b")).alias(day))


def missing_days(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Days without rows between a group's first and last day."""
    gone = _calendar(df, keys, day).join(df.select(*keys, day).distinct(), [*keys, day], "left_anti")
    return finding(gone, "missing_days", "error", F.concat_ws("/", *keys), F.col(day), F.lit(1))


def coverage_by_day(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Calendar days of each group with their row count, 0 where missing."""
    return _calendar(df, keys, day).join(df.groupBy(*keys, day).agg(F.count("*").alias("rows")), [*keys, day], "left").fillna(0, ["rows"])


def running_max(rows: DataFrame, key: str, order: tuple[str, ...], value: str, out: str) -> DataFrame:
    """The rows with the largest ``value`` among all earlier ones of their key (by ``order``) as ``out``, null for the first.

    Rows are ranged by key and order into sorted parts and written once; the largest value of each part is carried over to the
    parts of the key behind it, a table of one row a part and key. So no task holds a whole key.
    """
    parts = cut(rows.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()))
    tops = parts.groupBy(key, "part").agg(F.max(value).alias("top"))
    carried = F.max("top").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = F.max(value).over(Window.partitionBy(key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    inside = parts.withColumn(out, before)
    both = inside.join(tops.select(F.col(key).alias("of_key"), F.col("part").alias("of_part"), carried.alias("carried")), F.col(key).eqNullSafe(F.col("of_key")) & (F.col("part") == F.col("of_part")))
    return both.withColumn(out, F.greatest(out, "carried")).drop("part", "of_key", "of_part", "carried")


def time_gaps(ranges: DataFrame, key: str, threshold_seconds: int) -> DataFrame:
    """Gaps between consecutive ranges (key, start, end) of a key that exceed the threshold, with the key's total; a
    range that an earlier one covers makes no gap. The ends so far come from ``running_max``, so that a hot key is split."""
    ms = F.floor((F.unix_micros("start") - F.unix_micros("gap_start")) / 1000)
    found = running_max(ranges.select(key, "start", "end"), key, ("start", "end"), "end", "gap_start").where("gap_start is not null")
    gaps = found.select(key, "gap_start", F.col("start").alias("gap_end"), ms.alias("gap_ms")).where(F.col("gap_ms") > threshold_seconds * 1000)
    totals = gaps.groupBy(F.col(key).alias("of_key")).agg(F.sum("gap_ms").alias("total_gap_ms"))
    return gaps.join(totals, F.col(key).eqNullSafe(F.col("of_key"))).drop("of_key")


def intra_day_gaps(rows: DataFrame, key: str, at: str, threshold_seconds: int = 300) -> DataFrame:
    """Pauses within a day longer than the threshold."""
    day = F.to_date(at)
    before = F.lag(at).over(Window.partitionBy(key, day).orderBy(at))
    seconds = F.timestamp_diff("SECOND", F.col("before"), F.col(at))
    gaps = rows.select(key, at).distinct().withColumn("before", before).withColumn("seconds", seconds).where(F.col("seconds") > threshold_seconds)
    return finding(gaps, "intra_day_gaps", "warning", F.col(key), F.date_format("before", "yyyy-MM-dd HH:mm:ss"), F.col("seconds"))


def day_alignment(updates: DataFrame, events: DataFrame) -> DataFrame:
    """Days that only one of updates and events has."""
    u = updates.select(F.col("record_date").alias("day"), F.lit(True).alias("u")).distinct()
    e = events.select(F.col("event_date").alias("day"), F.lit(True).alias("e")).distinct()
    odd = u.join(e, "day", "full").where("u is null or e is null")
    return finding(odd, "day_alignment", "error", F.col("day"), F.when(F.col("u").isNull(), "updates missing").otherwise("events missing"), F.lit(1))


def null_critical(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Null counts of critical columns, one pass over the rows."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = counts.select("total", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("column", "nulls"))
    return finding(rows, "null_critical", F.when(F.col("nulls") > 0, "error").otherwise("ok"), F.col("column"), F.lit("nulls"), F.col("nulls"), F.col("total"))


def duplicate_ids(df: DataFrame, id_col: str, *scope: str) -> DataFrame:
    """Rows beyond the first of each id, by scope (a day, a migration)."""
    by = df.groupBy(*scope).agg((F.count(id_col) - F.count_distinct(id_col)).alias("extra"), F.count("*").alias("total"))
    return finding(by, "duplicate_ids", F.when(F.col("extra") > 0, "error").otherwise("ok"), F.concat_ws("/", *scope), F.lit(id_col), F.col("extra"), F.col("total"))


def partition_mismatch(df: DataFrame, at: str) -> DataFrame:
    """Rows whose path (year, month, day, migration as path_*) differs from their own values."""
    wrong = (F.year(at) != F.col("path_year")) | (F.month(at) != F.col("path_month")) | (F.dayofmonth(at) != F.col("path_day")) | (F.col("migration_id") != F.col("path_migration"))
    path = F.concat_ws("/", "path_migration", "path_year", "path_month", "path_day")
    by = df.groupBy(path.alias("path")).agg(F.count_if(wrong).alias("wrong"), F.count("*").alias("total")).where("wrong > 0")
    return finding(by, "partition_mismatch", "error", F.col("path"), F.lit(at), F.col("wrong"), F.col("total"))


def timestamp_sanity(df: DataFrame, recorded: str, effective: str, hours: int = 24) -> DataFrame:
    """Rows recorded long after their effective time, and rows of impossible years."""
    late = F.timestamp_diff("SECOND", F.col(effective), F.col(recorded)) > hours * 3600
    bad = ~F.year(effective).between(2020, 2035)
    counts = df.agg(F.count_if(late).alias("late"), F.count_if(bad).alias("bad"), F.count("*").alias("total"))
    rows = counts.select("total", F.explode(F.create_map(F.lit("recorded late"), "late", F.lit("year out of bounds"), "bad")).alias("what", "n"))
    return finding(rows, "timestamp_sanity", F.when(F.col("n") > 0, "warning").otherwise("ok"), F.lit(effective), F.col("what"), F.col("n"), F.col("total"))


def offset_duplicates(updates: DataFrame) -> DataFrame:
    own = updates.where("offset is not null").groupBy("migration_id").agg((F.count("offset") - F.count_distinct("offset")).alias("extra"), F.count("*").alias("total"))
    return finding(own, "offset_duplicates", F.when(F.col("extra") > 0, "error").otherwise("ok"), F.col("migration_id"), F.lit("offset"), F.col("extra"), F.col("total"))


def _within(df: DataFrame, day: str, days: tuple[str, str] | None, around: int = 0) -> DataFrame:
    """The rows of a range of days (first, last) and of so many days around it. The bounds are constants on the day's own
    column, so that of files partitioned by it only those days are listed."""
    if days is None:
        return df
    first, last = (dt.date.fromisoformat(d) for d in days)
    return df.where(F.col(day).between(F.lit(first - dt.timedelta(days=around)), F.lit(last + dt.timedelta(days=around))))


def orphan_events(events: DataFrame, updates: DataFrame, days: tuple[str, str] | None = None) -> DataFrame:
    """Update ids of a day's events that no update of the day before to the day after has, with their number of events.

    Events are counted by id and day before the join, an anti-join on the id with the days as a further condition. days
    (first, last): check the events of these days alone, against the updates of one day more on either side.
    """
    counts = _within(events, "event_date", days).groupBy("update_id", "event_date").agg(F.count("*").alias("n"))
    known = _within(updates, "record_date", days, 1).select(F.col("update_id").alias("known_id"), "record_date")
    near = (F.col("update_id") == F.col("known_id")) & F.col("record_date").between(F.date_sub("event_date", 1), F.date_add("event_date", 1))
    return finding(counts.join(known, near, "left_anti"), "orphan_events", "error", F.col("update_id"), F.col("event_date"), F.col("n"))


def event_count_mismatch(events: DataFrame, updates: DataFrame, days: tuple[str, str] | None = None) -> DataFrame:
    """Updates whose declared event count differs from the number of their events from the day before to the day after;
    those without any event there are left to other checks. days (first, last): the updates of these days alone."""
    own = _within(updates, "record_date", days).where("event_count is not null").select("update_id", "record_date", "event_count")
    counts = _within(events, "event_date", days, 1).groupBy(F.col("update_id").alias("of_id"), "event_date").agg(F.count("*").alias("n"))
    near = (F.col("update_id") == F.col("of_id")) & F.col("event_date").between(F.date_sub("record_date", 1), F.date_add("record_date", 1))
    both = own.join(counts, near).groupBy("update_id", "record_date", "event_count").agg(F.sum("n").alias("observed")).where("event_count <> observed")
    return finding(both, "event_count_mismatch", "error", F.col("update_id"), F.concat_ws(" observed, declared ", "observed", "event_count"), F.abs(F.col("observed") - F.col("event_count")))


def boundary_overlap(backfill: DataFrame, live: DataFrame, id_col: str) -> DataFrame:
    """Ids that two sources share."""
    shared = backfill.select(id_col).intersect(live.select(id_col)).agg(F.count("*").alias("n"))
    return finding(shared, "boundary_overlap", F.when(F.col("n") > 0, "warning").otherwise("ok"), F.lit(id_col), F.lit("in both sources"), F.col("n"))


def missing_ids(expected: DataFrame, actual: DataFrame, id_col: str) -> DataFrame:
    return expected.select(id_col).distinct().join(actual.select(id_col), id_col, "left_anti")


def acs_checks(acs: DataFrame, markers: DataFrame) -> DataFrame:
    """Per snapshot: repeated contracts, null contract or template ids, and a missing completion marker."""
    keys = ["migration_id", "snapshot_time"]
    by = acs.groupBy(*keys).agg(F.count("*").alias("total"), (F.count("contract_id") - F.count_distinct("contract_id")).alias("repeated"), F.count_if(F.col("contract_id").isNull() | F.col("template_id").isNull()).alias("nulls"))
    marked = by.join(markers.select(*keys, F.lit(True).alias("marked")).distinct(), keys, "left").withColumn("unmarked", F.when(F.col("marked"), 0).otherwise(1))
    rows = marked.select(*keys, "total", F.explode(F.create_map(F.lit("repeated contracts"), F.col("repeated"), F.lit("null ids"), F.col("nulls"), F.lit("no marker"), F.col("unmarked").cast("long"))).alias("what", "n")).where("n > 0")
    return finding(rows, "acs_checks", "error", F.concat_ws("/", "migration_id", F.date_format("snapshot_time", "yyyy-MM-dd HH:mm:ss")), F.col("what"), F.col("n"), F.col("total"))


def transform_verification(raw: DataFrame, typed: DataFrame, columns: tuple[str, ...], kept: str | None = None) -> DataFrame:
    """Row parity of raw and typed frames, and per column values that were text but parsed to null. kept: the typed frame has
    the raw text of each column beside it, under this prefix; then of the raw frame the rows alone are counted, so that
    dear columns are made once."""
    texts = [F.count((kept or "") + c).alias(f"raw_{c}") for c in columns]
    a = raw.agg(F.count("*").alias("raw_rows"), *([] if kept else texts))
    b = typed.agg(F.count("*").alias("typed_rows"), *[F.count(c).alias(f"typed_{c}") for c in columns], *(texts if kept else []))
    lost = [x for c in columns for x in (F.lit(f"parse loss: {c}"), F.col(f"raw_{c}") - F.col(f"typed_{c}"))]
    rows = a.crossJoin(b).select("raw_rows", F.explode(F.create_map(F.lit("row difference"), F.col("raw_rows") - F.col("typed_rows"), *lost)).alias("what", "n"))  # one row each
    return finding(rows, "transform_verification", F.when(F.col("n") != 0, "error").otherwise("ok"), F.lit("events"), F.col("what"), F.col("n"), F.col("raw_rows"))


def completeness(expected: DataFrame, actual: DataFrame, id_col: str, day: str, days: tuple[str, str] | None = None) -> DataFrame:
    """Per day: expected and present distinct ids, missing ids, drift in percent. An id is present if a row of the day before
    to the day after has it. days (first, last): these days alone, read with one day more on either side."""
    e = _within(expected, day, days).select(id_col, F.col(day).alias("day")).distinct()
    a = _within(actual, day, days, 1).select(F.col(id_col).alias("of_id"), F.col(day).alias("of_day"))
    near = (F.col(id_col) == F.col("of_id")) & F.col("of_day").between(F.date_sub("day", 1), F.date_add("day", 1))
    here, gone = e.join(a, near, "left_semi").withColumn("here", F.lit(1)), e.join(a, near, "left_anti").withColumn("here", F.lit(0))
    by = here.unionByName(gone).groupBy("day").agg(F.count("*").alias("expected"), F.sum("here").alias("present"))
    return by.select("day", "expected", "present", (F.col("expected") - F.col("present")).alias("missing"), ((F.col("expected") - F.col("present")) * 100.0 / F.col("expected")).alias("drift_pct"))


def schema_diff(expected: T.StructType, actual: DataFrame) -> DataFrame:
    """Columns of a declared schema against a frame's: match, type, missing or extra."""
    spark = actual.sparkSession
    rows = {f.name: [f.dataType.simpleString(), None] for f in expected.fields}
    for f in actual.schema.fields:
        rows.setdefault(f.name, [None, None])[1] = f.dataType.simpleString()
    state = lambda e, a: "missing" if a is None else "extra" if e is None else "match" if e == a else "type"
    return spark.createDataFrame([(n, e, a, state(e, a)) for n, (e, a) in rows.items()], "column string, expected string, actual string, state string")


def column_population(df: DataFrame) -> DataFrame:
    """Share of non-null values of every column, one pass."""
    counts = df.agg(F.count("*").alias("total"), *[F.count(F.col(c)).alias(f"c_{c}") for c in df.columns])
    rows = counts.select("total", F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"c_{c}"))])).alias("column", "filled"))
    return rows.select("column", "filled", "total", F.when(F.col("total") > 0, F.col("filled") / F.col("total")).alias("rate"))


def template_registry_check(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Templates seen against a registry (template, required): expected, missing (an error if required), unexpected."""
    seen = rows.groupBy(template_key(F.col("template_id")).alias("template")).agg(F.count("*").alias("n"))
    both = seen.join(registry, "template", "full")
    state = F.when(F.col("required").isNull(), "unexpected").when(F.col("n").isNull(), "missing").otherwise("expected")
    level = F.when((state == "missing") & F.col("required"), "error").when(state == "expected", "ok").otherwise("warning")
    return finding(both, "template_registry", level, F.col("template"), state, F.coalesce("n", F.lit(0)))


def contract_field_check(acs: DataFrame, critical: tuple[str, ...], important: tuple[str, ...]) -> DataFrame:
    """Contracts that lack critical or important fields, with the names."""
    absent = lambda names: F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in names]))
    rows = acs.select("contract_id", absent(critical).alias("critical"), absent(important).alias("important")).where("size(critical) + size(important) > 0")
    return rows.select("contract_id", F.array_join("critical", ",").alias("critical"), F.array_join("important", ",").alias("important"), F.when(F.size("critical") > 0, "error").otherwise("warning").alias("severity"))


def partition_repair_plan(rows: DataFrame, at: str = "effective_at") -> DataFrame:
    """(file, path day) -> skip, move or split by the true UTC days of its rows. rows: file, path_day (date), at."""
    days = rows.groupBy("file", "path_day").agg(F.count_distinct(F.to_date(at)).alias("days"), F.min(F.to_date(at)).alias("first_day"), F.count("*").alias("rows"))
    action = F.when((F.col("days") == 1) & (F.col("first_day") == F.col("path_day")), "skip").when(F.col("days") == 1, "move").otherwise("split")
    return days.select("file", "path_day", "rows", "days", action.alias("action"))


def rematerialize_check(updates: DataFrame, events: DataFrame) -> DataFrame:
    """Per day: events extracted lie between the declared sum and that sum with two more per reassignment."""
    u = updates.groupBy(F.col("record_date").alias("day")).agg(F.sum("event_count").alias("declared"), F.count_if(F.col("update_type") == "reassignment").alias("moves"))
    e = events.join(updates.select("update_id", F.col("record_date").alias("day")), "update_id").groupBy("day").agg(F.count("*").alias("extracted"))
    both = u.join(e, "day", "left").fillna(0, ["extracted"])
    return both.select("day", "declared", "extracted", F.col("extracted").between(F.col("declared"), F.col("declared") + 2 * F.col("moves")).alias("within"))


def discover_templates(events: DataFrame) -> DataFrame:
    """Templates with counts, category and format."""
    t = F.col("template_id")
    return events.groupBy(template_key(t).alias("template"), entity_of(t).alias("entity"), template_category(t).alias("category"), template_format(t).alias("format")).agg(F.count("*").alias("events"), F.count_distinct("contract_id").alias("contracts"))


def reconcile_counts(recorded: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Recorded against observed totals by key: match, missing or extra rows and their percentage."""
    both = recorded.join(observed, key, "full").fillna(0, ["recorded", "observed"])
    diff = F.col("observed") - F.col("recorded")
    state = F.when(diff == 0, "match").when(diff < 0, "missing").otherwise("extra")
    return both.select(key, "recorded", "observed", state.alias("state"), F.when(F.col("recorded") > 0, diff * 100.0 / F.col("recorded")).alias("difference_pct"))


def canonical_field_score(events: DataFrame, weights: dict[str, tuple[Column, float]]) -> DataFrame:
    """Share of rows that meet each named condition and the weighted score of them all."""
    shares = events.agg(*[F.avg(F.when(c, 1.0).otherwise(0.0)).alias(n) for n, (c, _) in weights.items()])
    whole = sum(w for _, w in weights.values())
    score = sum((F.col(n) * w for n, (_, w) in weights.items()), F.lit(0.0)) / whole
    return shares.withColumn("score", score)


def source_overlap_days(a: DataFrame, b: DataFrame, day: str) -> DataFrame:
    return a.select(day).intersect(b.select(day))


def partial_days(updates: DataFrame, events: DataFrame, before: str) -> DataFrame:
    """Days before a resume point that only one of updates and events has."""
    odd = day_alignment(updates, events)
    return odd.where(F.col("scope") < before)


def day_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"))


def backfill_summary(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.min(day).alias("earliest"), F.max(day).alias("latest"), F.count_distinct(day).alias("days"), F.count("*").alias("rows"))


def dedup_latest(df: DataFrame, id_col: str, at: str) -> DataFrame:
    """One row per id, the one recorded last. Rows are dealt out by id first, so that whole rows are moved and sorted once."""
    columns = [c for c in df.columns if c != id_col]
    best = dealt(df, id_col).groupBy(id_col).agg(F.max(F.struct(at, *[c for c in columns if c != at])).alias("row"))
    return best.select(id_col, *[F.col(f"row.{c}").alias(c) for c in columns])


def dedup_two_pass(df: DataFrame, id_col: str, at: str) -> DataFrame:
    """The same rows where repeats are rare: ids that occur once pass through, only the others are collapsed."""
    repeated = df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col)
    return df.join(repeated, id_col, "left_anti").unionByName(dedup_latest(df.join(repeated, id_col, "left_semi"), id_col, at).select(*df.columns))


def sample_comparison(raw: DataFrame, typed: DataFrame, id_col: str, raw_at: str, at: str) -> DataFrame:
    """Raw and parsed values of one id side by side, and whether they agree."""
    a = raw.select(id_col, F.col(raw_at).alias("raw_value"))
    b = typed.select(id_col, F.col(at).alias("parsed_value"))
    return a.join(b, id_col).select(id_col, "raw_value", "parsed_value", (F.try_to_timestamp("raw_value") == F.col("parsed_value")).alias("agree"))
