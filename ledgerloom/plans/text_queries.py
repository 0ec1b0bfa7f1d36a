"""Governance and text queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import action_tag, action_title
from ledgerloom.operators import governance as G
from ledgerloom.operators import lifecycle as L
from ledgerloom.operators.views import template_view
from ledgerloom.plans.digest import plain
from ledgerloom.plans.metric_queries import AS_OF_TEXT, D, IS, J, R, T
from ledgerloom.plans.oracles import sql
from ledgerloom.sources import derive
from ledgerloom.sources.scratch import cut, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
E = "ledger_events"


def add(name: str, query: Callable[[Callable[[str], DataFrame]], DataFrame], text: str | None, *ctes: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(query(lambda frame: getattr(derive, frame)(spark, sf_dir)))
    if text is not None:
        ORACLE_SQL[name] = sql(text, *ctes)


_NAME = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '\b(llc|inc|corp|ltd|gmbh|ag|sa|bv|pty|co|company|limited|incorporated|corporation)\b\.?', '', 'g'), '[.,\-_''"()]', ' ', 'g'), '\s+', ' ', 'g'))"""
_KEYS = "list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: len(w) >= 4 AND w NOT IN (" + ", ".join(f"'{w}'" for w in G.STOPWORDS) + "))))"
#: The identifiers follow from the kind of subject (c, and v of the varied ones), not from patterns.
IDENTIFIED = f"""kinds AS (SELECT *, topic_id % 5 AS c, CASE WHEN topic_id % 5 = 4 THEN (topic_id // 5) % 12 END AS v FROM topics),
ident AS MATERIALIZED (
SELECT topic_id, subject, body, date, stage, source, CASE WHEN c = 0 THEN lpad(CAST(topic_id // 50 AS VARCHAR), 4, '0') WHEN v = 10 THEN '00XX' END AS cip,
  CASE c WHEN 1 THEN 'App' || CASE (topic_id // 5) % 4 WHEN 1 THEN left(w, 4) || substr(w, 6) WHEN 2 THEN w || ' Wallet' ELSE w END WHEN 2 THEN 'Node' || w || ' Ltd' WHEN 3 THEN 'set fee to ' || (topic_id % 9) || ' on TestNet' WHEN 4 THEN
    CASE v WHEN 1 THEN 'Acme' || x WHEN 2 THEN 'Swap' || x WHEN 4 THEN 'Wallet' || x WHEN 5 THEN 'Node as a Service' WHEN 6 THEN 'Swap' || x WHEN 7 THEN 'Outcomes week ' || (topic_id % 50) WHEN 9 THEN 'Validator onboarding for Bolt' || x WHEN 11 THEN 'Nova' || x END END AS entity,
  coalesce(v = 3, false) AS many_entities, CASE WHEN c = 3 THEN 'testnet' WHEN v = 6 THEN 'mainnet' END AS network, c = 3 OR coalesce(v = 9, false) AS is_vote, c = 0 OR coalesce(v = 10, false) AS is_cip_discussion, false AS is_cip_vote, false AS is_app_vote,
  coalesce(v = 9, false) AS is_validator_vote, c = 1 OR coalesce(v = 2, false) AS is_app, c = 2 OR coalesce(v IN (5, 9), false) AS is_validator, {_KEYS.format("subject")} AS keywords FROM kinds),
typed AS MATERIALIZED (SELECT *, CASE WHEN subject LIKE 'Tokenomics Outcomes%' THEN 'outcome' WHEN subject LIKE 'Splice %' THEN 'protocol-upgrade' WHEN stage = 'tokenomics-announce' THEN CASE WHEN subject LIKE 'Validator Approved%' OR subject LIKE 'Validators Approved%' THEN 'validator' ELSE 'featured-app' END
  WHEN cip IS NOT NULL THEN 'cip' WHEN is_validator THEN 'validator' WHEN stage LIKE 'cip-%' AND NOT is_app THEN 'other' ELSE 'featured-app' END AS topic_type FROM ident)"""
#: The claims one topic after another, newest first: ``owner`` holds the place of the claimer of every topic, 0 if it is open.
CLAIMS = f"""placed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date DESC, topic_id DESC) AS k, nullif({_NAME.format("entity")}, '') AS name FROM typed),
reach AS MATERIALIZED (
  SELECT a.k AS k, list(b.k) AS held FROM placed a JOIN placed b ON a.k <> b.k AND NOT b.many_entities AND CASE
    WHEN a.topic_type = 'cip' THEN a.cip = b.cip WHEN a.topic_type = 'outcome' THEN false
    WHEN a.topic_type IN ('featured-app', 'validator') THEN NOT a.many_entities AND a.topic_type = b.topic_type AND (contains(a.name, b.name) OR contains(b.name, a.name) OR replace(a.name, ' ', '') = replace(b.name, ' ', '')
      OR (least(len(a.name), len(b.name)) >= greatest(len(a.name), len(b.name)) * 0.7 AND levenshtein(a.name, b.name) <= greatest(2, floor(greatest(len(a.name), len(b.name)) * 0.2))))
    ELSE coalesce(a.cip = b.cip, false) OR coalesce(contains(a.name, b.name) OR contains(b.name, a.name), false) END
  GROUP BY a.k),
way AS (
  SELECT CAST(0 AS BIGINT) AS k, (SELECT list_transform(range(count(*)), lambda x: CAST(0 AS BIGINT)) FROM placed) AS owner
  UNION ALL
  SELECT w.k + 1, CASE WHEN w.owner[w.k + 1] <> 0 THEN w.owner ELSE list_transform(w.owner, lambda o, j: CASE WHEN o <> 0 THEN o WHEN j = w.k + 1 OR list_contains(coalesce(r.held, []), j) THEN w.k + 1 ELSE 0 END) END
  FROM way w LEFT JOIN reach r ON r.k = w.k + 1 WHERE w.k < len(w.owner)),
owned AS (SELECT unnest(owner) AS anchor, unnest(range(1, len(owner) + 1)) AS k FROM way WHERE k = len(owner)),
corr AS MATERIALIZED (SELECT p.topic_id, a.topic_id AS item_id FROM owned o JOIN placed p ON p.k = o.k JOIN placed a ON a.k = o.anchor)"""
_ident = lambda f: G.extract_identifiers(f("topics"))
_typed = lambda f: G.classify_topic(_ident(f))

add("topic_identifiers", lambda f: _ident(f).drop("body", "source"), f"SELECT topic_id, subject, {D('date')}, stage, cip, entity, many_entities, network, is_vote, is_cip_discussion, is_cip_vote, is_app_vote, is_validator_vote, is_app, is_validator, array_to_string(list_filter(ordered, lambda w, i: list_position(ordered, w) = i)[:10], ',') AS keywords FROM (SELECT *, " + _KEYS.format("subject").replace("list_sort(list_distinct(", "", 1)[:-2] + " AS ordered FROM ident)", IDENTIFIED)
#: Keywords learned from corrections, and types learned for one topic in nine.
LEARNED = {"featured-app": ("Wallet", "grant"), "validator": ("node", "bolt"), "cip": ("fee",)}
_said = lambda kind: "(" + " OR ".join(f"contains(lower(subject), '{w.lower()}')" for w in LEARNED[kind]) + ")"
add("learned_types", lambda f: G.classify_topic(G.extract_identifiers(f("topics").withColumn("learned", F.when(F.col("topic_id") % 9 == 0, "outcome")), LEARNED), "learned").select("topic_id", "is_cip_discussion", "is_app", "is_validator", "topic_type"), f"""
SELECT topic_id, talk AS is_cip_discussion, app AS is_app, validator AS is_validator, CASE WHEN topic_id % 9 = 0 THEN 'outcome' WHEN subject LIKE 'Tokenomics Outcomes%' THEN 'outcome' WHEN subject LIKE 'Splice %' THEN 'protocol-upgrade' WHEN stage = 'tokenomics-announce' THEN CASE WHEN subject LIKE 'Validator Approved%' OR subject LIKE 'Validators Approved%' THEN 'validator' ELSE 'featured-app' END
  WHEN cip IS NOT NULL THEN 'cip' WHEN validator THEN 'validator' WHEN stage LIKE 'cip-%' AND NOT (app AND entity IS NOT NULL) THEN 'other' ELSE 'featured-app' END AS topic_type
FROM (SELECT *, is_cip_discussion OR {_said("cip")} AS talk, NOT is_cip_discussion AND (is_app OR {_said("featured-app")}) AS app, is_validator OR {_said("validator")} AS validator FROM ident)""", IDENTIFIED)
add("topic_urls", lambda f: G.extract_urls(f("topics"), "topic_id", "body"), r"""SELECT topic_id, unnest(list_distinct(regexp_extract_all(body, '(https?://[^\s<>"'')]+)', 1))) AS url FROM topics""")
add("topic_types", lambda f: _typed(f).select("topic_id", "topic_type"), "SELECT topic_id, topic_type FROM typed", IDENTIFIED)
add("topic_correlation", lambda f: G.correlate_topics(_typed(f)), "SELECT * FROM corr", IDENTIFIED, CLAIMS)
_FLOWS = "MAP {" + ", ".join(f"'{kind}': {list(reversed(stages))}" for kind, stages in G.WORKFLOWS.items()) + "}"
add("lifecycle_items", lambda f: G.lifecycle_items(_typed(f), G.correlate_topics(_typed(f))), f"""
SELECT item_id, topics, {D("f", "first_date")}, {D("l", "last_date")}, coalesce(list_filter({_FLOWS}[a.topic_type], lambda s: list_contains(seen, s))[1], a.stage) AS stage, a.topic_type
FROM (SELECT item_id, count(*) AS topics, min(date) AS f, max(date) AS l, list(stage) AS seen FROM typed JOIN corr USING (topic_id) GROUP BY item_id) i JOIN typed a ON a.topic_id = i.item_id""", IDENTIFIED, CLAIMS)
add("business_order", lambda f: G.business_order(_ident(f)).select("topic_id", "cip"), "SELECT topic_id, cip FROM ident", IDENTIFIED)


_PARTY = "case id % 4 when 0 then concat('App', {0}) when 1 then concat('Nodes', {0}) when 2 then concat('node ', {0}) else concat('Apq', {0}, ' Inc') end"


def _names(f: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Distinct entity names of topics, and of all benchmark parties, some with small spelling differences."""
    left = _ident(f).where("entity is not null").groupBy(F.col("entity").alias("name")).agg(F.min("topic_id").alias("id")).select("id", "name")
    right = f("ledger_base").select(F.col("u").alias("id")).distinct().select("id", F.expr(_PARTY.format(derive.WORD.format("id"))).alias("name"))
    return left, right


ENTITIES = f"""lefts AS MATERIALIZED (SELECT min(topic_id) AS id, {_NAME.format("entity")} AS name FROM ident WHERE entity IS NOT NULL GROUP BY entity),
rights AS MATERIALIZED (SELECT id, {_NAME.format("(" + _PARTY.format(derive.WORD.format("id")) + ")")} AS name FROM (SELECT DISTINCT u AS id FROM base)),
matched AS MATERIALIZED (SELECT * FROM (SELECT l.id AS left_id, r.id AS right_id, CASE WHEN l.name = r.name THEN 'equal' WHEN contains(l.name, r.name) OR contains(r.name, l.name) THEN 'contained' WHEN replace(l.name, ' ', '') = replace(r.name, ' ', '') THEN 'spaces'
  WHEN least(len(l.name), len(r.name)) >= greatest(len(l.name), len(r.name)) * 0.7 AND levenshtein(l.name, r.name) <= greatest(2, floor(greatest(len(l.name), len(r.name)) * 0.2)) THEN 'edit' END AS how FROM lefts l, rights r) WHERE how IS NOT NULL)"""
add("entity_matches", lambda f: G.match_entities(*_names(f)), "SELECT * FROM matched", IDENTIFIED, ENTITIES)
add("pending_apps", lambda f: G.pending_apps(*_names(f)).select("id"), "SELECT id FROM lefts WHERE id NOT IN (SELECT left_id FROM matched WHERE how IN ('equal', 'contained'))", IDENTIFIED, ENTITIES)


def _pairs(f: Callable[[str], DataFrame]) -> DataFrame:
    """Pairs of classes of topics that share a CIP number or have equal or contained names. All that a score reads is equal
    within a class; the smallest topic id stands for it, and a class of several topics meets itself too."""
    known = cut(_ident(f).select("topic_id", "cip", "entity", "is_app", "is_validator", "date")).where("cip is not null or entity is not null")
    own = cut(known.groupBy("cip", "entity", "is_app", "is_validator", "date").agg(F.min("topic_id").alias("topic_id"), F.count("*").alias("topics")))
    other = own.select(*[F.col(c).alias(f"o_{c}") for c in own.columns])
    names = own.where("entity is not null").select(G.normal_name(F.col("entity")).alias("id")).distinct().withColumn("name", F.col("id"))
    alike = G.match_entities(names, names, edits=False).where("how in ('equal', 'contained')").select("left_id", "right_id")
    by_name = own.join(alike, G.normal_name(F.col("entity")) == F.col("left_id")).join(other, G.normal_name(F.col("o_entity")) == F.col("right_id")).drop("left_id", "right_id")
    both = own.join(other, F.col("cip") == F.col("o_cip")).unionByName(by_name).where("topic_id < o_topic_id or (topic_id = o_topic_id and topics > 1)")
    return both.dropDuplicates(["topic_id", "o_topic_id"])


_E, _OE = _NAME.format("a.entity"), _NAME.format("b.entity")
CLASSED = "classed AS (SELECT cip, entity, is_app, is_validator, date, min(topic_id) AS topic_id, count(*) AS topics FROM ident WHERE cip IS NOT NULL OR entity IS NOT NULL GROUP BY cip, entity, is_app, is_validator, date)"
add("topic_similarity", lambda f: G.topic_similarity(_pairs(f)).select("topic_id", "o_topic_id", "topics", "o_topics", "score", "is_match"), f"""
SELECT topic_id, o_topic_id, topics, o_topics, s AS score, s >= 70 AS is_match FROM (SELECT *, CAST(c + n + CASE WHEN n = 100 THEN kind ELSE 0 END + CASE WHEN days <= 7 THEN 10 WHEN days <= 30 THEN 5 WHEN days <= 90 THEN 2 ELSE 0 END AS BIGINT) AS s
FROM (SELECT a.topic_id, b.topic_id AS o_topic_id, a.topics, b.topics AS o_topics, CASE WHEN a.cip = b.cip THEN 100 ELSE 0 END AS c, abs(date_diff('day', a.date, b.date)) AS days, 50 * CAST(a.is_app AND b.is_app AS INTEGER) + 50 * CAST(a.is_validator AND b.is_validator AS INTEGER) AS kind,
        CASE WHEN {_E} = {_OE} THEN 100 WHEN contains({_E}, {_OE}) OR contains({_OE}, {_E}) THEN 80 ELSE 0 END AS n
      FROM classed a JOIN classed b ON a.topic_id < b.topic_id OR (a.topic_id = b.topic_id AND a.topics > 1)) WHERE c > 0 OR n > 0)""", IDENTIFIED, CLASSED)
add("attach_votes", lambda f: G.attach_votes(
    template_view(f(E), "vote_request").select(F.col("contract_id").alias("vote_id"), F.expr("case when substring(contract_id, 2) % 3 = 0 then reason_url else 'none' end").alias("url"), F.expr("case when substring(contract_id, 2) % 5 = 0 then lpad(cast(substring(contract_id, 2) % 70 as string), 4, '0') end").alias("cip"), F.expr("case when substring(contract_id, 2) % 7 = 0 then concat('app', " + derive.WORD.format("substring(contract_id, 2) % 50") + ") end").alias("entity")),
    _ident(f), G.extract_urls(f("topics"), "topic_id", "body")), f"""
SELECT vote_id, coalesce(t_url, t_cip, t_name) AS topic_id, CASE WHEN t_url IS NOT NULL THEN 'url' WHEN t_cip IS NOT NULL THEN 'cip' WHEN t_name IS NOT NULL THEN 'entity' ELSE 'synthetic' END AS how
FROM (SELECT contract_id AS vote_id, CASE WHEN n % 3 = 0 THEN {J("reason.url")} ELSE 'none' END AS url, CASE WHEN n % 5 = 0 THEN lpad(CAST(n % 70 AS VARCHAR), 4, '0') END AS cip, CASE WHEN n % 7 = 0 THEN 'app' || {derive.WORD.format('n % 50')} END AS name FROM (SELECT *, CAST(substr(contract_id, 2) AS BIGINT) AS n FROM ev WHERE event_type = 'created' AND {IS("VoteRequest")}))
LEFT JOIN (SELECT 'https://v/' || (topic_id % 10) AS url, min(topic_id) AS t_url FROM topics GROUP BY 1) USING (url)
LEFT JOIN (SELECT cip, min(topic_id) AS t_cip FROM ident WHERE cip IS NOT NULL GROUP BY 1) USING (cip)
LEFT JOIN (SELECT {_NAME.format("entity")} AS name, min(topic_id) AS t_name FROM ident WHERE entity IS NOT NULL GROUP BY 1) USING (name)""", IDENTIFIED)  # fmt: skip


#: Votes on vote requests with reasons of every kind: forum links in odd spellings, numbers, parties with fingerprints, names.
_VOTE = """SELECT contract_id AS vote_id, CASE WHEN n % 3 = 0 THEN concat(' HTTPS://Forum/t/', CAST(n % 1500 AS STRING), '/?page=1') ELSE 'https://other' END AS url,
  CASE WHEN n % 5 = 0 THEN concat('fees of CIP#', CAST(n % 90 AS STRING), ' now') WHEN n % 5 = 1 THEN concat('MainNet: App', {w}, ', and more') WHEN n % 5 = 2 THEN 'validator milestone(s)' ELSE 'x' END AS body,
  CASE n % 6 WHEN 0 THEN 'SRARC_GrantFeaturedAppRight' WHEN 1 THEN 'SRARC_OffboardSv' WHEN 2 THEN 'CRARC_MintUnclaimedRewards' WHEN 3 THEN 'ScheduleDomainMigration' ELSE 'SetConfig' END AS action_tag,
  CASE WHEN n % 7 = 0 THEN concat('testnet: Node', {w}, '::1220abcdef') WHEN n % 7 = 1 THEN 'provider' END AS party, effective_at AS {at}, n % 2 = 0 AS closed"""
_VOTE = _VOTE.replace("{w}", derive.WORD.format("n % 60"))


def _resolved(f: Callable[[str], DataFrame]) -> DataFrame:
    asked = template_view(f(E), "vote_request").select("contract_id", "effective_at", F.expr("cast(substring(contract_id, 2) as bigint)").alias("n"))
    typed = cut(_typed(f).select(F.col("topic_id").alias("item_id"), "topic_type", "cip", "entity", "subject"))
    links = f("topics").select(F.col("topic_id").alias("item_id"), F.concat(F.lit("https://forum/t/"), F.col("topic_id").cast("string")).alias("url"))
    return G.resolve_votes(asked.sparkSession.sql(_VOTE.replace("{at}", "at") + " FROM {asked}", asked=asked), G.lifecycle_keys(typed), links)


_PARTY_OF = lambda c: f"lower(regexp_replace(regexp_replace(trim({c}), '(?i)^(mainnet|testnet):\\s*', ''), '(?i)::[0-9a-f]{{6,}}$', ''))"
RESOLVED = f"""vkeys AS MATERIALIZED (SELECT topic_id AS item_id, CASE WHEN topic_type = 'cip' AND regexp_full_match(cip, '[0-9]+') THEN 'CIP-' || cip WHEN topic_type IN ('featured-app', 'validator') THEN {_PARTY_OF("coalesce(entity, cip, subject)")} ELSE lower(coalesce(cip, entity, subject)) END AS key FROM typed),
vraw AS MATERIALIZED ({_VOTE.replace('{at}', chr(34) + 'at' + chr(34))} FROM (SELECT *, CAST(substr(contract_id, 2) AS BIGINT) AS n FROM ev WHERE event_type = 'created' AND {IS("VoteRequest")})),
vread AS (SELECT *, body || ' ' || url AS reason, TRY_CAST(regexp_extract(lower(trim(url)), '^https://forum/t/([0-9]+)/\\?', 1) AS BIGINT) AS topic FROM vraw),
vfound AS (SELECT v.*, k.key AS url_key, CASE WHEN regexp_extract(reason, 'CIP#0*([0-9]+)', 1) <> '' THEN 'CIP-' || lpad(regexp_extract(reason, 'CIP#0*([0-9]+)', 1), 4, '0') END AS cip_key, {_PARTY_OF("party")} AS party_key, nullif(lower(regexp_extract(reason, 'MainNet: ([^ ,]+)', 1)), '') AS name_key FROM vread v LEFT JOIN vkeys k ON k.item_id = v.topic),
vres AS MATERIALIZED (SELECT vote_id, key, how, item_id, CASE how WHEN 'url' THEN CASE WHEN key LIKE 'CIP-%' THEN 'cip' WHEN regexp_matches(key, 'validator|offboard|onboard') THEN 'validator' WHEN regexp_matches(key, 'migration|upgrade') THEN 'protocol-upgrade' ELSE 'featured-app' END WHEN 'cip-number' THEN 'cip' ELSE CASE WHEN how IS NULL THEN NULL ELSE
    CASE action_tag WHEN 'SRARC_GrantFeaturedAppRight' THEN 'featured-app' WHEN 'SRARC_OffboardSv' THEN 'validator' WHEN 'CRARC_MintUnclaimedRewards' THEN 'featured-app' WHEN 'ScheduleDomainMigration' THEN 'protocol-upgrade' ELSE CASE WHEN contains(body, 'validator') THEN 'validator' ELSE 'other' END END END END AS vote_type,
  action_tag LIKE '%Reward%' OR contains(body, 'milestone') AS milestone, "at", closed FROM (
  SELECT *, coalesce(url_key, cip_key, party_key, name_key) AS key, CASE WHEN url_key IS NOT NULL THEN 'url' WHEN cip_key IS NOT NULL THEN 'cip-number' WHEN party_key IS NOT NULL THEN 'party-id' WHEN name_key IS NOT NULL THEN 'base-name' END AS how FROM vfound) LEFT JOIN (SELECT key, min(item_id) AS item_id FROM vkeys GROUP BY key) USING (key))"""
add("resolved_votes", _resolved, f"SELECT vote_id, key, how, item_id, vote_type, milestone, {T('"at"', 'at')}, closed FROM vres", IDENTIFIED, RESOLVED)
add("synthetic_items", lambda f: G.synthetic_items(_resolved(f)), f"""
SELECT 'synthetic-' || key AS item_id, key, arg_min(vote_type, {{'o': NOT closed, 'a': "at", 'v': vote_id}}) AS item_type, count(*) FILTER (closed) AS votes, count(*) FILTER (NOT closed) AS active, {T("min(\"at\")", "first_date")}, {T("max(\"at\")", "last_date")}
FROM vres WHERE key IS NOT NULL AND item_id IS NULL AND key NOT IN ('provider', 'validator', 'sv', 'beneficiary', 'partyid', 'name') AND len(key) >= 4 GROUP BY key""", IDENTIFIED, RESOLVED)
#: Overrides of every kind, from topic ids: chains of merges of up to thirty items, a cycle in every fortieth, repeats of one key.
_LOG = """SELECT id AS seq, 'item' AS level, id AS key, 'type' AS action, 'outcome' AS value FROM t WHERE id % 35 = 0
UNION ALL SELECT id, 'item', id, 'merge', CAST(CASE WHEN {0} % 40 = 29 THEN id - 50 ELSE id + 5 END AS STRING) FROM t WHERE id % 5 = 0 AND {0} % 40 < 30 AND {0} % 7 <> 3
UNION ALL SELECT id + 1, 'topic', id, 'merge', CAST(id - id % 5 + 15 AS STRING) FROM t WHERE id % 11 = 0
UNION ALL SELECT id + 2, 'topic', id, 'move', CAST(id - id % 5 + 40 AS STRING) FROM t WHERE id % 22 = 0 OR id % 13 = 0
UNION ALL SELECT id + 900, 'topic', id, 'move', CAST(id - id % 5 AS STRING) FROM t WHERE id % 26 = 0
UNION ALL SELECT id, 'topic', id, 'reclassify', CASE WHEN id % 2 = 0 THEN 'cip' ELSE 'validator' END FROM t WHERE id % 17 = 0
UNION ALL SELECT id, 'topic', id, 'extract', CAST(NULL AS STRING) FROM t WHERE id % 19 = 0
UNION ALL SELECT id, 'topic', id, 'move', 'nowhere' FROM t WHERE id % 23 = 0 AND id % 13 <> 0 AND id % 22 <> 0"""


def _overrides(f: Callable[[str], DataFrame]) -> DataFrame:
    return f("topics").sparkSession.sql(_LOG.format("(id div 5)").replace("FROM t ", "FROM {t} "), t=f("topics").select(F.col("topic_id").alias("id")))


def _cards(f: Callable[[str], DataFrame]) -> DataFrame:
    """Five topics in a row are one card of the first one's type."""
    rows = _typed(f).select("topic_id", F.expr("topic_id - topic_id % 5").alias("item_id"), "topic_type")
    return rows.withColumn("item_type", F.expr("case (item_id div 5) % 3 when 0 then 'cip' when 1 then 'featured-app' else 'other' end")).drop("topic_type")


#: The log replayed: the last of each key; merges between items followed step by step, the last merge of a cycle left out.
REPLAY = f"""olog AS MATERIALIZED (SELECT level, key, action, arg_max(coalesce(value, '-'), seq) AS value, max(seq) AS seq FROM ({_LOG.format("(id // 5)").replace("FROM t ", "FROM (SELECT topic_id AS id FROM topics) ")}) GROUP BY level, key, action),
oitems AS MATERIALIZED (SELECT DISTINCT topic_id - topic_id % 5 AS item FROM topics),
steps AS MATERIALIZED (SELECT key AS a, TRY_CAST(value AS BIGINT) AS b, seq FROM olog WHERE level = 'item' AND action = 'merge' AND key <> TRY_CAST(value AS BIGINT) AND key IN (SELECT item FROM oitems) AND TRY_CAST(value AS BIGINT) IN (SELECT item FROM oitems)),
rounds_ AS (SELECT a AS start, b AS at, seq AS top, [a] AS seen FROM steps UNION ALL SELECT r.start, s.b, greatest(r.top, s.seq), list_append(r.seen, s.a) FROM rounds_ r JOIN steps s ON s.a = r.at WHERE NOT list_contains(r.seen, r.at)),
voids AS MATERIALIZED (SELECT start AS a FROM rounds_ r JOIN steps s ON s.a = r.start WHERE r.at = r.start AND s.seq = r.top),
goods AS MATERIALIZED (SELECT * FROM steps WHERE a NOT IN (SELECT a FROM voids)),
led AS (SELECT a, b FROM goods UNION SELECT l.a, g.b FROM led l JOIN goods g ON g.a = l.b),
oroots AS MATERIALIZED (SELECT item, coalesce((SELECT any_value(b) FROM led WHERE a = item AND b NOT IN (SELECT a FROM goods)), item) AS root FROM oitems),
told AS (SELECT o.key, o.action, o.value, r.root FROM olog o LEFT JOIN oroots r ON CAST(r.item AS VARCHAR) = o.value WHERE o.level = 'topic'),
otypes AS (SELECT item, coalesce(value, CASE (item // 5) % 3 WHEN 0 THEN 'cip' WHEN 1 THEN 'featured-app' ELSE 'other' END) AS type FROM oitems LEFT JOIN (SELECT key AS item, value FROM olog WHERE level = 'item' AND action = 'type') USING (item)),
replayed AS MATERIALIZED (SELECT t.topic_id, coalesce(mv.root, mg.root, r.root) AS item, rc.value AS reclassify, ex.key IS NOT NULL AS extracted FROM topics t JOIN oroots r ON r.item = t.topic_id - t.topic_id % 5
  LEFT JOIN told mv ON mv.key = t.topic_id AND mv.action = 'move' LEFT JOIN told mg ON mg.key = t.topic_id AND mg.action = 'merge' LEFT JOIN told rc ON rc.key = t.topic_id AND rc.action = 'reclassify' LEFT JOIN told ex ON ex.key = t.topic_id AND ex.action = 'extract'),
carded AS MATERIALIZED (SELECT topic_id, CASE WHEN extracted THEN 'topic-extracted-' || topic_id WHEN reclassify IS NOT NULL AND reclassify <> type THEN 'topic-reclassified-' || topic_id ELSE 'lifecycle-' || item END AS card,
  CASE WHEN reclassify IS NOT NULL AND reclassify <> type THEN reclassify ELSE type END AS topic_type FROM replayed JOIN otypes USING (item))"""
add("apply_overrides", lambda f: G.apply_overrides(_cards(f), _overrides(f)), "SELECT topic_id, card, topic_type FROM carded", REPLAY)
add("override_effects", lambda f: G.override_effects(_cards(f), G.apply_overrides(_cards(f), _overrides(f))), "SELECT card, count(*) AS topics, count(*) FILTER (card <> 'lifecycle-' || (topic_id - topic_id % 5)) AS came, min(topic_type) AS topic_type FROM carded GROUP BY card", REPLAY)
add("override_stats", lambda f: G.override_stats(_overrides(f).join(f("topics").select(F.col("topic_id").alias("key"), F.col("date").alias("at")), "key")), f"SELECT action, strftime(date, '%Y-%m') AS month, count(*) AS entries FROM ({_LOG.format('(id // 5)').replace('FROM t ', 'FROM (SELECT topic_id AS id FROM topics) ')}) l JOIN topics ON topic_id = l.key GROUP BY ALL")
CORRECTIONS = """corrections AS (SELECT topic_id, subject AS label, topic_type AS original, CASE WHEN topic_id % 7 = 0 THEN 'vote' ELSE 'outcome' END AS corrected, keywords FROM typed WHERE topic_id % 3 = 0),
words AS (SELECT original, corrected, word, count(*) AS count, count(*) / any_value(total) AS share FROM (SELECT original, corrected, unnest(keywords) AS word FROM corrections) JOIN (SELECT original, corrected, count(*) AS total FROM corrections GROUP BY ALL) USING (original, corrected) GROUP BY original, corrected, word HAVING count(*) >= 2 AND count(*) / any_value(total) >= 0.5)"""
_corrections = lambda f: _typed(f).where("topic_id % 3 = 0").select("topic_id", F.col("subject").alias("label"), F.col("topic_type").alias("original"), F.expr("case when topic_id % 7 = 0 then 'vote' else 'outcome' end").alias("corrected"))
add("correction_words", lambda f: G.correction_words(_corrections(f)), f"SELECT original, corrected, word, count, {R('share', 'share')} FROM words", IDENTIFIED, CORRECTIONS)
add("pattern_suggestions", lambda f: G.pattern_suggestions(_corrections(f)), f"""
SELECT original, corrected, c.count, examples, {R("coalesce(f, 0)", "frequency")}, w AS words, CASE WHEN c.count >= 5 AND coalesce(f, 0) > 0.7 AND examples >= 3 THEN 'general' WHEN c.count >= 2 AND coalesce(f, 0) > 0.5 THEN 'contextual' ELSE 'edge_case' END AS level
FROM (SELECT original, corrected, count(*) AS count, count(DISTINCT label) AS examples FROM corrections GROUP BY ALL) c LEFT JOIN (SELECT original, corrected, avg(share) AS f, array_to_string(list_sort(list(word)), ',') AS w FROM words GROUP BY ALL) USING (original, corrected)""", IDENTIFIED, CORRECTIONS)
add("pattern_decay", lambda f: G.pattern_decay(f("topics").select(F.col("topic_id").alias("pattern_id"), ((F.col("topic_id") % 10 + 1) / 10).alias("confidence"), F.col("date").alias("last_used")), F.lit("2024-11-01").cast("date")), f"""
SELECT topic_id AS pattern_id, {R("c", "confidence")}, c < 0.2 AS archived FROM (SELECT topic_id, greatest((topic_id % 10 + 1) / 10.0 * pow(0.5, date_diff('day', date, DATE '2024-11-01') / 30.0), 0.1) AS c FROM topics)""")
_patterns = lambda f: f("topics").sparkSession.createDataFrame([("featured", "app"), ("validator", "validator"), ("testnet", "network"), ("weekly", "notes")], "word string, label string")
add("keyword_classify", lambda f: G.keyword_classify(f("topics"), _patterns(f)), "SELECT topic_id, label FROM ident JOIN (VALUES ('featured', 'app'), ('validator', 'validator'), ('testnet', 'network'), ('weekly', 'notes')) p(word, label) ON list_contains(keywords, word)", IDENTIFIED)
add("score_topics", lambda f: G.score_topics(f("topics"), G.keyword_model), """
SELECT topic_id, CASE WHEN a > 0 OR v > 0 OR n > 0 THEN CASE WHEN v >= a AND v >= n THEN 'vote' WHEN a >= n THEN 'app' ELSE 'validator' END ELSE 'other' END AS label, greatest(a, v, n) AS score
FROM (SELECT topic_id, (CAST(regexp_matches(subject, '(?i)\\bvote') AS DOUBLE) + CAST(regexp_matches(subject, '(?i)\\bfee') AS DOUBLE)) / 2 AS v, (CAST(regexp_matches(subject, '(?i)\\bfeatured') AS DOUBLE) + CAST(regexp_matches(subject, '(?i)\\bapp') AS DOUBLE)) / 2 AS a, (CAST(regexp_matches(subject, '(?i)\\bvalidator') AS DOUBLE) + CAST(regexp_matches(subject, '(?i)\\bnode') AS DOUBLE)) / 2 AS n FROM topics)""")


def _fitted(f: Callable[[str], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all topics' whole bodies by a model fitted on ``labels`` of every document that isn't held out (one in five)."""
    path = work_folder(spark)
    gold = derive.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("topic_id"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("label"))
    rows = f("topics").join(gold.where("crc32(cast(topic_id as string)) % 5 <> 0"), "topic_id").select(F.col("body").alias("text"), "label")
    G.fit_topic_model(rows, path)
    return G.score_fitted(f("topics"), path)


QUERIES["fitted_scores"] = lambda spark, sf_dir: plain(_fitted(lambda frame: getattr(derive, frame)(spark, sf_dir), spark, sf_dir))
LABELS = "labelled AS (SELECT topic_id AS id, topic_type AS truth, CASE WHEN topic_id % 4 = 0 THEN 'other' ELSE topic_type END AS now, CASE WHEN topic_id % 6 = 0 THEN 'vote' ELSE topic_type END AS before FROM typed)"
_gold = lambda f: _typed(f).select(F.col("topic_id").alias("id"), F.col("topic_type").alias("truth"))
_label = lambda f, n, other: _gold(f).select("id", F.when(F.col("id") % n == 0, other).otherwise(F.col("truth")).alias("label"))
_EVAL = f"SELECT truth, count(*) AS items, {R('avg(CASE WHEN now = truth THEN 1.0 ELSE 0.0 END)', 'accuracy')}, count(*) FILTER (before = truth AND now <> truth) AS regressions, count(*) FILTER (now = truth AND before <> truth) AS improvements FROM labelled GROUP BY ROLLUP (truth)"
_evaluation = lambda f: G.evaluate_classifier(_gold(f), _label(f, 4, "other"), _label(f, 6, "vote"))
add("evaluate_classifier", _evaluation, _EVAL, IDENTIFIED, LABELS)
add("no_regression_gate", lambda f: G.no_regression_gate(_evaluation(f)), f"SELECT regressions > 0 AS blocked, regressions, improvements FROM ({_EVAL}) WHERE truth IS NULL", IDENTIFIED, LABELS)
_compared = lambda f: _gold(f).join(_label(f, 6, "vote").withColumnRenamed("label", "current"), "id").join(_label(f, 4, "other").withColumnRenamed("label", "proposed"), "id")
add("impact_preview", lambda f: G.impact_preview(_compared(f)), 'SELECT before AS current, now AS proposed, count(*) AS items, count(*) FILTER (now = truth AND before <> truth) AS improved, count(*) FILTER (before = truth AND now <> truth) AS degraded FROM labelled GROUP BY before, now', IDENTIFIED, LABELS)
add("proposal_test", lambda f: G.proposal_test(_compared(f)), """
SELECT count(*) FILTER (b = 'u') AS unchanged, count(*) FILTER (b = 'i') AS improved, count(*) FILTER (b = 'd') AS degraded, count(*) FILTER (b = 'c') AS changed, count(*) FILTER (b = 'd') = 0 AS safe
FROM (SELECT CASE WHEN before = now THEN 'u' WHEN now = truth AND before <> truth THEN 'i' WHEN before = truth AND now <> truth THEN 'd' ELSE 'c' END AS b FROM labelled)""", IDENTIFIED, LABELS)
add("audit_disagreements", lambda f: G.audit_disagreements(_gold(f).select(F.col("id").alias("topic_id"), F.col("truth").alias("rule_type")), _label(f, 6, "vote").select(F.col("id").alias("topic_id"), F.col("label").alias("reviewed_type"), ((F.col("id") % 10) / 10).alias("confidence"))), f"""
SELECT id AS topic_id, truth AS rule_type, before AS reviewed_type, {R("(id % 10) / 10.0", "confidence")}, (id % 10) / 10.0 < 0.8 AS needs_review FROM labelled WHERE truth <> before""", IDENTIFIED, LABELS)
add("decision_stats", lambda f: G.decision_stats(_typed(f).select(F.col("topic_type").alias("label"), "source", ((F.col("topic_id") % 10) / 10).alias("confidence"))), f"SELECT topic_type AS label, source, count(*) AS decisions, {R('avg((topic_id % 10) / 10.0)', 'confidence')}, count(*) FILTER (topic_id % 10 < 5) AS low FROM typed GROUP BY ALL", IDENTIFIED)
#: Two traces of every third item; the later one holds.
_TRACES = """SELECT id AS item_id, concat('t', CAST(id AS STRING), '-', CAST(n AS STRING)) AS trace_id, CASE WHEN (id + n) % 4 = 0 THEN 'cip' WHEN (id + n) % 4 = 1 THEN 'featured-app' WHEN (id + n) % 4 = 2 THEN 'validator' ELSE 'other' END AS final_type,
  (id + n) % 3 = 0 AS consulted, CAST(((id * 7 + n) % 10) / 10.0 AS DOUBLE) AS confidence, day + n * INTERVAL 1 DAY AS decided_at FROM t, (VALUES (0), (1)) AS v(n) WHERE n = 0 OR id % 3 = 0"""
_decisions = lambda f: G.latest_decisions(f("topics").sparkSession.sql(_TRACES.replace("FROM t,", "FROM {t},"), t=f("topics").select(F.col("topic_id").alias("id"), F.col("date").cast("timestamp").alias("day"))))
DECIDED = "decided AS (SELECT * FROM (" + _TRACES.replace("FROM t,", "FROM (SELECT topic_id AS id, CAST(date AS TIMESTAMP) AS day FROM topics) t,") + ") QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY decided_at DESC, trace_id DESC) = 1)"
_SHOWN = "item_id, trace_id, final_type, consulted, " + R("confidence", "confidence") + ", " + T("decided_at")
add("latest_decisions", _decisions, f"SELECT {_SHOWN} FROM decided", DECIDED)
add("query_decisions", lambda f: G.query_decisions(_decisions(f), "featured-app", "2024-02-01", "2024-08-01", False, 0.3), f"SELECT * FROM (SELECT {_SHOWN} FROM decided WHERE final_type = 'featured-app' AND decided_at BETWEEN TIMESTAMP '2024-02-01' AND TIMESTAMP '2024-08-01' AND NOT consulted AND confidence >= 0.3) ORDER BY decided_at DESC, item_id LIMIT 100", DECIDED)
add("decision_totals", lambda f: G.decision_totals(_decisions(f)), f"SELECT final_type, count(*) AS items, count(*) FILTER (consulted) AS consulted, {R('round(avg(confidence) FILTER (confidence > 0), 2)', 'confidence')} FROM decided GROUP BY ROLLUP (final_type)", DECIDED)
add("accuracy_by_category", lambda f: G.accuracy_by_category(_gold(f).join(f("topics").select(F.col("topic_id").alias("id"), F.when(F.col("topic_id") % 7 > 0, F.col("source")).alias("category")), "id"), _label(f, 4, "other")), f"SELECT category, count(*) AS items, count(*) FILTER (now = truth) AS correct, {R('avg(CASE WHEN now = truth THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM (SELECT l.*, coalesce(CASE WHEN id % 7 > 0 THEN source END, 'standard') AS category FROM labelled l JOIN topics ON topic_id = id) GROUP BY ROLLUP (category)", IDENTIFIED, LABELS)
#: Updates of four contracts each, so that some hold a rule exercise and no vote request.
_few = lambda f: f(E).withColumn("update_id", F.expr("concat('w', cast((cast(substring(contract_id, 2) as bigint) + 3) div 4 as string))"))
FEW = "few AS MATERIALIZED (SELECT * REPLACE ('w' || ((CAST(substr(contract_id, 2) AS BIGINT) + 3) // 4) AS update_id) FROM ev)"
add("direct_actions", lambda f: G.direct_actions(_few(f)), f"SELECT event_id, update_id, contract_id, choice, regexp_replace(choice, '^[A-Za-z]+_', '') AS action_subject, 'executed' AS status, {T('effective_at')} FROM few WHERE event_type = 'exercised' AND consuming AND {IS('DsoRules')} AND update_id NOT IN (SELECT update_id FROM few WHERE event_type = 'created' AND {IS('VoteRequest')})", FEW)
_results = lambda f: template_view(f(E), "vote_request").select(F.col("tracking_cid"), "contract_id", F.expr("element_at(array('VRO_Accepted', 'VRO_Rejected', 'VRO_Expired', null), cast(substring(contract_id, 2) % 4 as int) + 1)").alias("outcome_tag"), F.col("effective_at").alias("completed_at")).where("substring(contract_id, 2) % 3 > 0")
CLOSED = f"""closed AS MATERIALIZED (SELECT proposal_id, CASE coalesce(tag, '') WHEN 'VRO_Accepted' THEN 'accepted' WHEN 'VRO_Rejected' THEN 'rejected' ELSE 'expired' END AS status, effective_at AS completed_at
FROM (SELECT coalesce(nullif({J("trackingCid")}, ''), contract_id) AS proposal_id, contract_id, effective_at, (['VRO_Accepted', 'VRO_Rejected', 'VRO_Expired', NULL])[CAST(CAST(substr(contract_id, 2) AS BIGINT) % 4 AS INTEGER) + 1] AS tag FROM ev WHERE event_type = 'created' AND {IS("VoteRequest")} AND CAST(substr(contract_id, 2) AS BIGINT) % 3 > 0)
QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY effective_at DESC, contract_id DESC) = 1)"""
add("closed_votes", lambda f: L.closed_votes(_results(f)), f"SELECT proposal_id, status, {T('completed_at')} FROM closed", CLOSED)
add("proposal_states", lambda f: L.proposal_states(_few(f), L.closed_votes(_results(f)), F.lit(AS_OF_TEXT).cast("timestamp")), f"""
SELECT proposal_id, contract_id, status, status <> 'in_progress' AS is_closed, status = 'accepted' AND ruled AS is_executed, is_human, requests FROM (
  SELECT r.proposal_id, r.contract_id, coalesce(c.status, CASE WHEN coalesce(until < TIMESTAMP '{AS_OF_TEXT}', false) THEN 'expired' ELSE 'in_progress' END) AS status, is_human, requests,
    EXISTS (SELECT 1 FROM few a JOIN few d ON d.update_id = a.update_id WHERE a.contract_id = r.contract_id AND a.event_type = 'archived' AND d.event_type = 'exercised' AND d.consuming AND d.template_id LIKE '%:DsoRules') AS ruled
  FROM (SELECT coalesce(nullif({J("trackingCid")}, ''), contract_id) AS proposal_id, contract_id, TRY_CAST({J("voteBefore")} AS TIMESTAMP) AS until, coalesce({J("reason.body")}, {J("reason.url")}, '') <> '' OR coalesce(len(json_keys(payload, '$.votes')), 0) > 0 AS is_human,
          count(*) OVER (PARTITION BY coalesce(nullif({J("trackingCid")}, ''), contract_id)) AS requests FROM few WHERE event_type = 'created' AND {IS("VoteRequest")}
        QUALIFY row_number() OVER (PARTITION BY coalesce(nullif({J("trackingCid")}, ''), contract_id) ORDER BY effective_at DESC, contract_id DESC) = 1) r LEFT JOIN closed c USING (proposal_id))""", FEW, CLOSED)
CANON = f"""canon AS (SELECT {J("trackingCid")} AS proposal_id, arg_max(CASE WHEN TRY_CAST({J("expiresAt")} AS TIMESTAMP) < TIMESTAMP '{AS_OF_TEXT}' THEN 'closed' ELSE 'open' END, {{'a': effective_at, 'b': contract_id}}) AS status, count(*) AS related, min(effective_at) AS first_seen, max(effective_at) AS last_seen FROM ev WHERE event_type = 'created' AND {IS("VoteRequest")} GROUP BY 1)"""
_canon = lambda f: G.canonical_proposals(template_view(f(E), "vote_request").select(F.col("tracking_cid").alias("proposal_id"), "contract_id", F.col("effective_at").alias("at"), F.expr(f"case when expires_at < timestamp '{AS_OF_TEXT}' then 'closed' else 'open' end").alias("status")))
add("canonical_proposals", _canon, f"SELECT proposal_id, status, related, {T('first_seen')}, {T('last_seen')} FROM canon", CANON)
add("status_breakdown", lambda f: G.status_breakdown(_canon(f)), f"SELECT status, count(*) AS proposals, CAST(sum(related) AS BIGINT) AS requests, {R('count(*) * 100.0 / sum(count(*)) OVER ()', 'share')} FROM canon GROUP BY status", CANON)
add("proposal_dedupe_stats", lambda f: G.proposal_dedupe_stats(_canon(f)), f"SELECT CAST(sum(related) AS BIGINT) AS requests, count(*) AS proposals, {R('(sum(related) - count(*)) * 100.0 / sum(related)', 'duplicate_pct')} FROM canon", CANON)
add("parse_actions", lambda f: f(E).where("event_type = 'created' and template_id like '%:VoteRequest'").select("contract_id", action_tag(F.col("payload")).alias("action_type"), action_title(action_tag(F.col("payload"))).alias("title")), f"""
SELECT contract_id, {J("action.value.dsoAction.tag")} AS action_type, regexp_replace({J("action.value.dsoAction.tag")}, '^[A-Z]+_', '') AS title FROM ev WHERE event_type = 'created' AND {IS("VoteRequest")}""")
add("tally_votes", lambda f: template_view(f(E), "votes").groupBy("contract_id").agg(F.count_if("vote_accepted").alias("accepted"), F.count_if(~F.col("vote_accepted")).alias("rejected")), f"""
SELECT contract_id, CAST(len(list_filter(json_extract_string(payload, '$.votes.*.accept'), lambda v: v = 'true')) AS BIGINT) AS accepted, CAST(len(list_filter(json_extract_string(payload, '$.votes.*.accept'), lambda v: v <> 'true')) AS BIGINT) AS rejected FROM ev WHERE event_type = 'created' AND {IS("VoteRequest")}""")
