"""Column functions: template ids, categories, money, times, actions and text patterns of ledger data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.schemas import MONEY

#: Smallest units in one coin.
UNITS = 10_000_000_000


def package_of(template_id: Column) -> Column:
    """Leading package hash of ``hash:Module.Path:Entity`` (or ``hash:Module:Path:Entity``); null without one."""
    parts = F.split(template_id, ":")
    return F.when(F.size(parts) >= 3, parts[0])


def template_format(template_id: Column) -> Column:
    """Label of a template id's form: 'package', 'colons', 'plain', 'underscore' or 'unknown'."""
    colons = F.regexp_count(template_id, F.lit(":"))
    return (
        F.when(template_id.isNull() | (template_id == ""), "unknown")
        .when(colons == 2, "package").when(colons > 2, "colons").when(colons == 1, "plain")
        .when(template_id.contains("_"), "underscore").otherwise("unknown")
    )


def entity_of(template_id: Column) -> Column:
    """Entity name of any form."""
    under = F.element_at(F.split(template_id, "_"), -1)
    return F.when(template_id.contains(":"), F.element_at(F.split(template_id, ":"), -1)).when(template_id.contains("_"), under).otherwise(template_id)


def module_of(template_id: Column) -> Column:
    """Dotted module path: between package and entity; in the underscore form after the hexadecimal segments."""
    parts = F.split(template_id, ":")
    n = F.size(parts)
    dotted = F.when(n >= 3, F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(1))), ".")).when(n == 2, parts[0])
    segments = F.filter(F.split(template_id, "_"), lambda s: ~s.rlike("^[0-9a-f]{8,}$"))
    under = F.array_join(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), ".")
    return F.when(template_id.contains(":"), dotted).when(template_id.contains("_"), under)


def template_key(template_id: Column) -> Column:
    """Canonical ``Module.Path:Entity``."""
    module = module_of(template_id)
    return F.when(module.isNull() | (module == ""), entity_of(template_id)).otherwise(F.concat(module, F.lit(":"), entity_of(template_id)))


def template_category(template_id: Column) -> Column:
    """Area of the ledger by module prefix."""
    module = module_of(template_id)
    ordered = (
        ("Splice.AmuletRules", "rules"), ("Splice.Amulet", "token"), ("Splice.ValidatorLicense", "validator"), ("Splice.DsoRules", "governance"), ("Splice.DSO", "governance"),
        ("Splice.Round", "round"), ("Splice.Ans", "names"), ("Splice.DecentralizedSynchronizer", "traffic"), ("Splice.ExternalParty", "transfer"), ("Splice.Wallet", "wallet"),
    )
    out = F.when(module.isNull(), "unknown")
    for prefix, name in ordered:
        out = out.when(module.startswith(prefix), name)
    return out.otherwise("other")


def is_template(template_id: Column, entity: str) -> Column:
    """Whether the id's last part is exactly this entity (so a locked token is no token)."""
    return template_id.endswith(":" + entity)


def of_entity(df: DataFrame, entity: str) -> Column:
    """Whether a row's template is this entity: by the stored column ``entity`` where the frame has one (see ``store_events``),
    so that the statistics of files and row groups decide what is read, else by the end of the template id."""
    return F.col("entity") == entity if "entity" in df.columns else is_template(F.col("template_id"), entity)


def json_text(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, "$." + path)


def money(text: Column) -> Column:
    """Strictly numeric text as a decimal of ledger scale; anything else is null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), text).try_cast(MONEY)


def first_money(payload: Column, *paths: str) -> Column:
    return F.coalesce(*[money(json_text(payload, p)) for p in paths])


def pick_amount(payload: Column) -> Column:
    """First valid amount of a token payload."""
    return first_money(payload, "amount.initialAmount", "amulet.amount.initialAmount", "initialAmount", "amount")


def pick_locked_amount(payload: Column) -> Column:
    return first_money(payload, "amulet.amount.initialAmount", "amount.initialAmount", "initialAmount")


def pick_owner(payload: Column) -> Column:
    return F.coalesce(*[F.nullif(json_text(payload, p), F.lit("")) for p in ("owner", "amulet.owner", "party")])


def to_coin(units: Column) -> Column:
    return (units.cast(MONEY) / F.lit(UNITS)).cast(MONEY)


def normal_time(value: Column) -> Column:
    """Time of any encoding in JSON text: ISO text, a number of seconds, milliseconds or microseconds (by size), or an
    object of ``microsecondsSinceEpoch``, ``seconds`` and ``nanos``, or ``unixtime``. Others are null."""
    number = lambda c: F.when(c.rlike(r"^-?[0-9]+$"), c).try_cast("long")
    plain = number(value)
    micros = number(F.get_json_object(value, "$.microsecondsSinceEpoch"))
    seconds, nanos = number(F.get_json_object(value, "$.seconds")), number(F.get_json_object(value, "$.nanos"))
    unix = number(F.get_json_object(value, "$.unixtime"))
    size = F.abs(plain)
    return (
        F.when(size >= 100_000_000_000_000, F.timestamp_micros(plain)).when(size >= 100_000_000_000, F.timestamp_millis(plain)).when(plain.isNotNull(), F.timestamp_seconds(plain))
        .when(micros.isNotNull(), F.timestamp_micros(micros)).when(seconds.isNotNull(), F.timestamp_micros(seconds * 1_000_000 + F.coalesce(F.expr("0L") + F.floor(nanos / 1000), F.lit(0))))
        .when(unix.isNotNull(), F.timestamp_seconds(unix)).otherwise(F.try_to_timestamp(F.regexp_replace(value, '^"|"$', "")))
    )


def in_years(at: Column, first: int = 2020, last: int = 2035) -> Column:
    """Whether a time's UTC year can be a partition."""
    return F.year(at).between(first, last)


def action_tag(payload: Column) -> Column:
    """Action type of a vote request, wherever the payload keeps it."""
    return F.coalesce(*[json_text(payload, f"action.value.{p}.tag") for p in ("dsoAction", "amuletRulesAction")], json_text(payload, "action.value.tag"), json_text(payload, "action.tag"))


def action_title(tag: Column) -> Column:
    """Readable title: prefix taken off, words split."""
    bare = F.regexp_replace(tag, "^[A-Z]+_", "")
    return F.trim(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1 $2"))


def half_life(value: Column, days: Column, half: float = 30.0, floor: float = 0.1) -> Column:
    """Confidence after some days."""
    return F.greatest(value * F.pow(F.lit(0.5), days / half), F.lit(floor))
