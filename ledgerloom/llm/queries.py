"""The registered queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import chat, id_files, language, line_dedup, media, mixing, near_dedup, packing, quality, runs, spelling, token_counts, vector_dedup
from ledgerloom.llm.store import Written

#: Production parameters.
VOCABULARY = "byte_bpe_50k.json"
MAX_TOKENS = 1024
SIMILARITY = 0.8
COSINE = 0.93
GOOD = 0.3
LETTERS = 7
TIMES = 10
#: crc32 of the text {s} in SQL: eight shifts a byte.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({s}))), lambda i: ('0x' || substr(hex(encode({s})), 2 * i + 1, 2))::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295::BIGINT)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=MAX_TOKENS)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Written(media.store_media(table(spark, sf_dir, "documents")), "media", codec="none")
    return media.media_features(stored.df).drop("damaged")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), threshold=SIMILARITY).select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"), "text")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), threshold=SIMILARITY)


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_links(table(spark, sf_dir, "embeddings"), threshold=COSINE)


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.read_ids(id_files.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=2))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    records = rows.unionByName(more).select("conv_id", chat.as_record("conv_id", "turn", "role", "text").alias("record"))
    return chat.read_chats(chat.format_chats(chat.canonical_turns(records, "conv_id", "record"), "conv_id"), "conv_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), capacity=MAX_TOKENS, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=GOOD)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"), damage=True, least_letters=LETTERS, least_count=2, times=TIMES)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    return runs.digest(runs.find_runs(docs.select("doc_id", runs.repeat_tail(F.col("text"), key).alias("text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_source_mix": op2_source_mix,
    "op3_media": op3_media,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_vector_dedup": op6_vector_dedup,
    "op7_id_files": op7_id_files,
    "op8_chat": op8_chat,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_language": op11_language,
    "op12_spelling": op12_spelling,
    "op13_runs": op13_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT >> 18 AS cell
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
rated AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS k FROM by_source),
weighed AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS most FROM rated),
levels AS (
  SELECT *, most / w AS ratio,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY most / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
water AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE ratio >= level),
targets AS (
  SELECT source, source_size, round(least(most, coalesce(water.level, 'infinity'::DOUBLE) * w), 6) AS target FROM levels, water),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM targets),
cells AS (
  SELECT source, cell, sum(sum(size)) OVER (PARTITION BY source ORDER BY cell) AS upto FROM sized GROUP BY source, cell)
SELECT s.doc_id, s.size, p.source_size, p.target,
       CAST(s.size * (p.passes + CASE WHEN c.upto <= p.target - p.passes * p.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN passes p ON s.source IS NOT DISTINCT FROM p.source
JOIN cells c ON c.source IS NOT DISTINCT FROM s.source AND c.cell = s.cell
""",
    "op4_line_dedup": r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
raw AS (SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS words FROM docs),
lines AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(words, '[^\x20\x09-\x0D]+'))) AS tokens FROM raw),
sets AS (
  SELECT tokens, len(tokens) AS n, min({'d': doc_id, 'l': line}) AS first, row_number() OVER () AS id
  FROM lines WHERE len(tokens) > 0 GROUP BY tokens),
words AS (SELECT id, n, unnest(tokens) AS token FROM sets),
rarity AS (SELECT token, count(*) AS df FROM words GROUP BY token),
ranked AS (
  SELECT id, n, token, row_number() OVER (PARTITION BY id ORDER BY df, token) AS pos FROM words JOIN rarity USING (token)),
prefix AS (SELECT id, n, token, pos FROM ranked WHERE pos <= n - CAST(ceil(0.8 * n - 1e-9) AS BIGINT) + 1),
pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.token = b.token AND a.id <> b.id
  WHERE a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n),
matched AS (
  SELECT DISTINCT x.id FROM pairs JOIN sets x ON x.id = pairs.a JOIN sets y ON y.id = pairs.b
  WHERE y.first < x.first
    AND len(list_intersect(x.tokens, y.tokens)) >= 0.8 * (x.n + y.n - len(list_intersect(x.tokens, y.tokens))) - 1e-9),
gone AS (
  SELECT l.doc_id, list_sort(list(DISTINCT l.line)) AS removed FROM lines l JOIN sets s ON s.tokens = l.tokens
  WHERE s.id IN (SELECT id FROM matched) OR s.first <> {'d': l.doc_id, 'l': l.line} GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.parts), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(g.removed), 0) AS INTEGER) AS n_removed,
       coalesce(array_to_string(g.removed, ','), '') AS removed,
       CASE WHEN g.removed IS NULL THEN d.text
            ELSE coalesce(array_to_string([d.parts[k + 1] FOR k IN range(len(d.parts)) IF NOT list_contains(g.removed, k)], chr(10)), '') END AS text
FROM docs d LEFT JOIN gone g ON g.doc_id IS NOT DISTINCT FROM d.doc_id
""",
    "op12_spelling": r"""
WITH RECURSIVE found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
said AS (
  SELECT run, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run AS s, count(*) AS m FROM found GROUP BY ALL),
hashed AS (SELECT run, m, CRC_OF_S AS h FROM said),
bent AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, m FROM hashed),
words AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM bent WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
cuts AS (SELECT word, n, k, left(word, k) AS head, substr(word, k + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
near AS (
  SELECT DISTINCT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM cuts a JOIN cuts b ON a.k = b.k AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON b.word = a.head || a.tail
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON b.word = a.head || a.tail),
best AS (SELECT a, b, b_n, a_n, row_number() OVER (PARTITION BY a ORDER BY b_n DESC, b COLLATE "binary") AS place FROM near),
forms AS (SELECT a AS word, b AS form, b_n AS form_n FROM best WHERE place = 1 AND b_n >= 10 * a_n),
counts AS (SELECT a AS word, count(*) AS n_near FROM near GROUP BY a),
way AS (
  SELECT word, form AS root FROM forms UNION SELECT w.word, f.form FROM way w JOIN forms f ON f.word = w.root),
ends AS (SELECT word, root FROM way WHERE root NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, CAST(coalesce(c.n_near, 0) AS BIGINT) AS n_near, f.form_n
FROM words w LEFT JOIN forms f USING (word) LEFT JOIN counts c USING (word) LEFT JOIN ends e USING (word)
""".replace("CRC_OF_S", _CRC32.format(s="s")),
    "op13_runs": r"""
WITH keyed AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS s, row_number() OVER () AS id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
sized AS (SELECT *, len(words) AS n, CRC_OF_S AS h FROM keyed),
tails AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM sized),
places AS (
  SELECT id, n, unnest(range(n)) AS i, words, CASE WHEN h % 10 = 0 THEN a ELSE n END AS a, CASE WHEN n > 0 THEN 1 + (n - a) // (3 + (h // 10) % 8) END AS p FROM tails),
said AS (SELECT id, n, i, words[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS w FROM places),
equal AS (
  SELECT x.id, x.i, y.i - x.i AS q FROM said x JOIN said y ON x.id = y.id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
marked AS (SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS part FROM equal),
stretches AS (SELECT id, min(i) AS start, count(*) + q AS length, q FROM marked GROUP BY id, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT id, start, length, min(q) AS period FROM stretches GROUP BY id, start, length),
listed AS (
  SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS all_runs FROM runs GROUP BY id),
best AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM runs),
gone AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT id, string_agg(w, ' ' ORDER BY i) AS collapsed FROM said s ANTI JOIN gone g USING (id, i) GROUP BY id)
SELECT k.doc_id, CAST(coalesce(l.n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period,
       CAST(b.length * 1000 // b.period AS BIGINT) AS exponent_milli, sha256(coalesce(l.all_runs, '')) AS runs_sha256, sha256(coalesce(c.collapsed, '')) AS collapsed_sha256
FROM keyed k LEFT JOIN listed l USING (id) LEFT JOIN best b ON b.id = k.id AND b.place = 1 LEFT JOIN kept c ON c.id = k.id
""".replace("CRC_OF_S", _CRC32.format(s="s")),
}
