"""Entity matching against all pairs and topic claims against the sequential rule, on random names and topics."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import governance

SYLLABLES = ["no", "va", "wal", "let", "ka", "mi", "sto", "ne", "x", "ri", "ver", "da", "ta", "é", "q7", " ", " bay ", "-", "lo"]


def names(many, seed):
    pick = random.Random(seed)
    out = []
    while len(out) < many:
        name = "".join(pick.choice(SYLLABLES) for _ in range(pick.randint(1, 9)))
        out.append(name)
        for _ in range(pick.randint(0, 2)):  # small changes, longer names, legal forms
            k = pick.randrange(len(name))
            out.append(pick.choice([name[:k] + name[k + 1 :], name[:k] + "z" + name[k:], name + " systems", name.replace(" ", ""), name + " Ltd.", "the " + name]))
    return out[:many] + ["a", "ab", "b", "", None, "Inc", "w" * 70, "w" * 69 + "v", "long " * 15 + "name", "long " * 15 + "nome", "long " * 14 + "lang nome", "x" * 100 + "y", "x" * 100]


ALL_PAIRS = """SELECT l.id, r.id, CASE WHEN l.name = r.name THEN 'equal' WHEN contains(l.name, r.name) OR contains(r.name, l.name) THEN 'contained' WHEN replace(l.name, ' ', '') = replace(r.name, ' ', '') THEN 'spaces'
  WHEN least(length(l.name), length(r.name)) >= greatest(length(l.name), length(r.name)) * 0.7 AND levenshtein(l.name, r.name) <= greatest(2, floor(greatest(length(l.name), length(r.name)) * 0.2)) THEN 'edit' END AS how
FROM named l, named r WHERE how IS NOT NULL"""


def test_matches_equal_all_pairs(spark):
    own = [n if n is None else n.replace("é", "e") for n in names(2500, 1)]  # the other engine counts bytes
    df = spark.createDataFrame(list(enumerate(own)), "id long, name string").repartition(4)
    got = {tuple(r) for r in governance.match_entities(df, df).collect()}
    named = df.select("id", governance.normal_name(F.col("name")).alias("name")).where("name <> ''").toPandas()
    db = duckdb.connect()
    db.register("named", pd.DataFrame(named))
    assert got == set(db.execute(ALL_PAIRS).fetchall())


def test_wide_letters_and_two_sides(spark):
    left = spark.createDataFrame([(1, "Café Müller"), (2, None), (3, "")], "id long, name string")
    right = spark.createDataFrame([(7, "cafe muller gmbh"), (8, "Müller"), (9, "CaféMüller"), (10, "other")], "id long, name string")
    assert {tuple(r) for r in governance.match_entities(left, right).collect()} == {(1, 7, "edit"), (1, 8, "contained"), (1, 9, "spaces")}
    assert governance.match_entities(left.where("false"), right).count() == 0


def test_keys_are_selective(spark):
    """Few unlike names meet under the keys of edits, and only equal ones among these under those of contained names."""
    met = {}
    for many in (500, 2000):
        pick = random.Random(many)
        own = spark.createDataFrame([("".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)),) for _ in range(many)], "name string").withColumn("n", F.length("name"))
        side = lambda keys: own.select("name", F.expr(f"explode(array_distinct({keys}))").alias("key"))  # noqa: B023, E731
        longer, shorter = side(governance._segment_keys("e")), side(governance._probe_keys("e")).withColumnRenamed("name", "other")
        holder, inside = side(governance._holder_keys("h")), side(governance._inside_key("h")).withColumnRenamed("name", "other")
        met[many] = longer.join(shorter, "key").where("name <> other").count()
        assert holder.join(inside, "key").count() == many
    assert met[500] < 25 and met[2000] < 400


def matches(a, b):
    if not a or not b:
        return False
    long, short = max(len(a), len(b)), min(len(a), len(b))
    if a in b or b in a or a.replace(" ", "") == b.replace(" ", ""):
        return True
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return short >= 0.7 * long and row[-1] <= max(2, int(0.2 * long))


def sequential(topics):
    """One topic after another, newest first, as the rule is stated."""
    order = sorted(topics, key=lambda t: (t["date"], t["topic_id"]), reverse=True)
    item = {}
    for t in order:
        if t["topic_id"] in item:
            continue
        item[t["topic_id"]] = t["topic_id"]
        kind, name = t["topic_type"], t["entity"]
        if kind == "outcome" or (kind in ("featured-app", "validator") and (not name or t["many_entities"])):
            continue
        for o in order:
            if o["topic_id"] in item or o["many_entities"]:
                continue
            if kind == "cip":
                hit = bool(t["cip"]) and t["cip"] == o["cip"]
            elif kind in ("featured-app", "validator"):
                hit = o["topic_type"] == kind and matches(name, o["entity"])
            else:
                part = bool(name and o["entity"]) and (name in o["entity"] or o["entity"] in name)
                hit = (bool(t["cip"]) and t["cip"] == o["cip"]) or part
            if hit:
                item[o["topic_id"]] = t["topic_id"]
    return item


@pytest.mark.parametrize("seed", range(4))
def test_claims_equal_the_sequential_rule(spark, seed):
    pick = random.Random(seed)
    pool = ["nova", "novi", "nova pay", "pay", "stone", "stones", "stonne", "bay stone", "river", "rivers", "riverside", "wallet", "wallet one", "walet", "zz"]
    topics = []
    for k in range(260):
        many = pick.random() < 0.08
        topics.append({
            "topic_id": k, "topic_type": pick.choice(["cip", "cip", "featured-app", "featured-app", "validator", "outcome", "other", "protocol-upgrade"]), "cip": pick.choice([None, None, "0001", "0002", "0003", "00XX"]),
            "entity": None if many or pick.random() < 0.2 else pick.choice(pool), "many_entities": many, "date": dt.date(2024, 1, 1) + dt.timedelta(days=pick.randint(0, 60)), "stage": "tokenomics",
        })
    schema = "topic_id long, topic_type string, cip string, entity string, many_entities boolean, date date, stage string"
    df = spark.createDataFrame([tuple(t.values()) for t in topics], schema).repartition(3)
    found = governance.correlate_topics(df)
    assert {r["topic_id"]: r["item_id"] for r in found.collect()} == sequential(topics)
    items = {r["item_id"]: r for r in governance.lifecycle_items(df, found).collect()}
    kinds = {t["topic_id"]: t["topic_type"] for t in topics}
    assert all(r["topic_type"] == kinds[k] and r["stage"] == "tokenomics" for k, r in items.items())


def test_claims_along_a_chain(spark):
    """Each name matches only the next one: claims alternate, and settling them takes several rounds."""
    chain = ["aaaaaaaaaa", "aaaaaaaabb", "aaaaaabbbb", "aaaabbbbbb", "aabbbbbbbb", "bbbbbbbbbb", "bbbbbbbbcc", "bbbbbbcccc"]
    rows = [(k, "validator", None, n, False, dt.date(2024, 1, 30 - k), "tokenomics") for k, n in enumerate(chain)]
    df = spark.createDataFrame(rows, "topic_id long, topic_type string, cip string, entity string, many_entities boolean, date date, stage string")
    assert {r["topic_id"]: r["item_id"] for r in governance.correlate_topics(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 6}
    assert governance.correlate_topics(df.where("false")).count() == 0


def test_fitted_model_on_held_out_labels(spark):
    """Fitted on four fifths of the labels over whole texts, stored, loaded, and measured on the rest."""
    import zlib

    from ledgerloom.plans import registry

    data = "/root/testdata/sf0.01"
    gold = {r["doc_id"]: "good" if r["quality"] == 1 else "poor" for r in spark.read.parquet(f"{data}/labels.parquet").where("quality is not null").collect()}
    rows = registry.QUERIES["fitted_scores"](spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r["label"] == gold[r["topic_id"]] for r in rows if r["topic_id"] in gold and zlib.crc32(str(r["topic_id"]).encode()) % 5 == 0]
    print("held-out accuracy", sum(held) / len(held), "of", len(held))
    assert len(held) > 20 and sum(held) / len(held) > 0.8
    assert governance.score_topics(spark.createDataFrame([(1, None), (2, "vote on fee")], "topic_id long, subject string"), governance.keyword_model).count() == 2


def test_votes_find_their_items(spark):
    """Each of the four ways to a key in its order, types, milestones, and items for keys that none has."""
    at = dt.datetime(2024, 1, 1)
    items = spark.createDataFrame([(1, "cip", "0042", None, "CIP-42: fees"), (2, "featured-app", None, "Nova", "Nova app"), (3, "validator", None, "MainNet: Stone::1220abcdef", "x"), (4, "other", None, None, "Splice Upgrade")], "item_id long, topic_type string, cip string, entity string, subject string")
    keys = governance.lifecycle_keys(items)
    assert {r["item_id"]: r["key"] for r in keys.collect()} == {1: "CIP-0042", 2: "nova", 3: "stone", 4: "splice upgrade"}
    urls = spark.createDataFrame([(2, "https://forum/t/2"), (4, "https://forum/t/2/"), (4, "https://forum/t/9"), (1, None)], "item_id long, url string")
    rows = [
        ("a", "HTTPS://Forum/t/2/?p=1#x", "CIP-0042", None, None), ("b", "https://forum/t/9", None, "X", None), ("c", "", "on cip-42", "SRARC_OffboardSv", "stone"), ("d", None, None, "SRARC_GrantFeaturedAppRight", "mainnet:stone::1220abcdef"),
        ("e", None, "TestNet: Nova, please", "Set", None), ("f", None, "app: zz", None, None), ("g", None, None, "CRARC_MintUnclaimedRewards", "New-Party::1220abcdef"), ("h", None, "the milestones", "OnboardValidator", "New-Party"), ("i", None, "x", None, "sv"), ("j", None, None, None, None),
    ]
    votes = spark.createDataFrame([(*r, at + dt.timedelta(days=k), k % 2 == 0) for k, r in enumerate(rows)], "vote_id string, url string, body string, action_tag string, party string, at timestamp, closed boolean")
    resolved = governance.resolve_votes(votes, keys, urls)
    got = {r["vote_id"]: (r["key"], r["how"], r["item_id"], r["vote_type"], r["milestone"]) for r in resolved.collect()}
    assert got == {
        "a": ("nova", "url", 2, "featured-app", False), "b": ("splice upgrade", "url", 4, "protocol-upgrade", False), "c": ("CIP-0042", "cip-number", 1, "cip", False), "d": ("stone", "party-id", 3, "featured-app", False),
        "e": ("nova", "base-name", 2, "other", False), "f": (None, None, None, None, False), "g": ("new-party", "party-id", None, "featured-app", True), "h": ("new-party", "party-id", None, "validator", True), "i": ("sv", "party-id", None, "other", False), "j": (None, None, None, None, False),
    }
    made = [tuple(r) for r in governance.synthetic_items(resolved).collect()]
    assert made == [("synthetic-new-party", "new-party", "featured-app", 1, 1, at + dt.timedelta(days=6), at + dt.timedelta(days=7))]
