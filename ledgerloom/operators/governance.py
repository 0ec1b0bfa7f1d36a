"""Governance text: identifiers, classification, matching and correlation of topics, votes and classifier evaluation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import half_life, of_entity
from ledgerloom.sources.scratch import cut, dealt

#: The flow that each stage's forum group belongs to, and the stages of each type in the order of its workflow.
FLOWS = {"cip-discuss": "cip", "cip-vote": "cip", "cip-announce": "cip", "tokenomics": "shared", "tokenomics-announce": "featured-app", "sv-announce": "shared"}
WORKFLOWS = {
    "cip": ("cip-discuss", "cip-vote", "cip-announce", "sv-announce"), "featured-app": ("tokenomics", "tokenomics-announce", "sv-announce"),
    "validator": ("tokenomics", "sv-announce"), "protocol-upgrade": ("tokenomics", "sv-announce"), "outcome": ("sv-announce",), "other": ("tokenomics", "sv-announce"),
}
#: Legal forms and signs that don't count in names.
LEGAL_FORMS, SIGNS = r"\b(llc|inc|corp|ltd|gmbh|ag|sa|bv|pty|co|company|limited|incorporated|corporation)\b\.?", r"[.,\-_'\"()]"
#: Words that carry no meaning in subjects.
STOPWORDS = (
    "the", "and", "for", "this", "that", "with", "from", "featured", "validator", "tokenomics", "announcement", "announce", "proposal",
    "vote", "request", "application", "listing", "onboarding", "supervalidator",
)
#: Patterns of subjects. What is cut off a subject first; a list of names; the signs of networks and types.
REPLY, VOTE_END, SEVERAL = r"(?i)^(re:|fwd:|fw:)\s*", r"(?i)\s*-?\s*vote\s*(proposal)?\s*$", r"(?i),|\s+and\s+"
NETWORK_START, BY_END = r"(?i)^(?:mainnet|testnet|main\s*net|test\s*net)[:\s]+", r"(?i)\s+by\s+.*$"
BATCH = r"(?i)(?:validator\s*operators?|validators|featured\s*apps?)\s*approved[:\s-]+(.+?)$"
NODE_SERVICE = r"(?i)^node\s+as\s+a\s+service\s+(?:reviewed\s+and\s+)?approved"
VALIDATOR_APPROVED, APP_APPROVED = r"(?i)validator\s*(?:approved|operator\s+approved)[:\s-]+(.+?)$", r"(?i)featured\s*app\s*approved[:\s-]+(.+?)$"
TESTNET, MAINNET, NETWORK_COLON = r"(?i)testnet|test\s*net|tn\b", r"(?i)mainnet|main\s*net|mn\b", r"(?i)(?:mainnet|testnet|main\s*net|test\s*net):"
CIP_OPEN, CIP_NUMBER, CIP_ALONE = r"(?i)CIP\s*[-#]?\s*(TBD|00XX|XXXX|\?\?|unassigned)", r"(?i)CIP\s*[-#]?\s*(\d{2,})", r"^\s*0*(\d{4})\s+"
CIP_TALK, CIP_VOTE = r"(?i)^\s*(?:re:\s*)?CIP[#\-\s]|^(?:re:\s*)?(?:new\s+)?CIP\s+(?:discuss|proposal|draft)", r"(?i)CIP[#\-\s]?\d+|CIP\s+(?:vote|voting|approval)"
VOTE, APP_VOTE, VALIDATOR_VOTE = r"(?i)\bVote\s+Proposal\b", r"(?i)featured\s*app|featured\s*application|app\s+rights", r"(?i)validator\s+(?:operator|onboarding|license)"
APP = r"(?i)featured\s*app|featured\s*application|app\s+(?:application|listing|request|tokenomics|vote|approved)|application\s+status\s+for"
VALIDATOR = r"(?i)super\s*validator|validator\s+(?:approved|application|onboarding|license|candidate|operator\s+approved)|sv\s+(?:application|onboarding)|validator\s+operator|node\s+as\s+a\s+service"
OUTCOME, VALIDATOR_WORK, VALIDATOR_DONE = r"(?i)\bTokenomics\s+Outcomes\b", r"(?i)\bValidator\s+Operations\b", r"(?i)validator.*approved|approved.*validator|validator\s*operator.*approved"
UPGRADE = r"(?i)\b(?:synchronizer\s+migration|splice\s+\d+\.\d+|protocol\s+upgrade|network\s+upgrade|hard\s*fork|migration\s+to\s+splice)\b"
#: Patterns of names in the order in which they are tried, the least length of a name, what is cut off it,
#: and names that don't count.
NAMES = (
    (VALIDATOR_APPROVED, 2, (), None),
    (APP_APPROVED, 2, (), None),
    (r"(?i)to\s+feature\s+(?:the\s+)?([A-Za-z0-9][\w\s-]*?)$", 2, (BY_END,), None),
    (r"(?i)(?:to\s+)?(?:implement|apply|for)\s+featured\s*(?:app(?:lication)?|application)\s+(?:status|rights)\s+for\s+([A-Za-z0-9][\w\s-]*?)$", 2, (), None),
    (r"(?i)(?:mainnet|testnet|main\s*net|test\s*net)[:\s]+([^:]+?)(?:\s+by\s+.+)?$", 3, (BY_END,), None),
    (r"(?i)(?:request|proposal|onboarding|tokenomics|announce|announcement|approved|vote\s*proposal)[:\s-]+(.+?)$", 3, (NETWORK_START, BY_END), r"(?i)^(the|this|new|our)$"),
    (r"(?i)new\s+featured\s*app\s+request[:\s-]+(.+?)$", 3, (NETWORK_START, BY_END), None),
    (r"(?i)^([A-Za-z][A-Za-z0-9\s-]{1,30}?)\s+(?:featured\s*app|super\s*validator|validator|tokenomics|onboarding)", 2, (), r"(?i)^(the|and|for|this|that|with|from|featured|app|vote|proposal|to)$"),
    (r"\[([^\]]+)\]", 3, (), None),
    (r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", 1, (), r"(?i)^(featured app|super validator|vote proposal|new request|token economics|main net|test net)$"),
    (r"for\s+([A-Z][A-Za-z0-9-]+)$", 2, (), r"(?i)^(the|this|that|it)$"),
)
#: Scores of topic similarity and the score from which two topics belong together.
SAME_CIP, SAME_ENTITY, PART_ENTITY, SAME_KIND, MATCH = 100, 100, 80, 50, 70


def extract_cip(text: Column) -> Column:
    """Number of a CIP mentioned ('CIP-0042', 'CIP 42', 'cip#42', or four digits at the start), of four digits at least;
    00XX for one without a number yet; null without one."""
    number = F.coalesce(F.nullif(F.regexp_extract(text, CIP_NUMBER, 1), F.lit("")), F.nullif(F.regexp_extract(text, CIP_ALONE, 1), F.lit("")))
    return F.when(text.rlike(CIP_OPEN), "00XX").otherwise(F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))


def network_of(text: Column) -> Column:
    return F.when(text.rlike(TESTNET), "testnet").when(text.rlike(MAINNET), "mainnet")


def _of_bare(subject: Column, found: Callable[[Column], Column]) -> Column:
    """``found`` of a subject without its start and end. The long chains of patterns stand within a lambda, where the
    subject is cut once and Spark evaluates them without generated code (which would pass the size of a method)."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(subject, REPLY, ""), VOTE_END, ""))
    return F.get(F.transform(F.array(bare), found), F.lit(0))


def _lists_names(bare: Column) -> Column:
    lists = lambda pattern: F.regexp_extract(bare, pattern, 1).rlike(SEVERAL)
    one = F.length(F.trim(F.regexp_extract(bare, VALIDATOR_APPROVED, 1))) > 1
    return lists(BATCH) | (~bare.rlike(NODE_SERVICE) & (lists(VALIDATOR_APPROVED) | (~one & lists(APP_APPROVED))))


def many_entities(subject: Column) -> Column:
    """Whether an approval names several apps or validators, so that it has no single name."""
    return _of_bare(subject, _lists_names)


def entity_name(subject: Column) -> Column:
    """Name of the app or validator that a subject is about: the first pattern that gives one; null for several names."""

    def first_name(bare: Column) -> Column:
        found = []
        for pattern, least, cut, banned in NAMES:
            name = F.regexp_extract(bare, pattern, 1)
            for end in cut:
                name = F.regexp_replace(name, end, "")
            name = F.trim(name)
            good = F.length(name) >= least
            found.append(F.when(good if banned is None else good & ~name.rlike(banned), name))
        return F.when(_lists_names(bare), None).when(bare.rlike(NODE_SERVICE), "Node as a Service").otherwise(F.coalesce(*found))

    return _of_bare(subject, first_name)


def normal_name(name: Column) -> Column:
    """Lower case, legal forms taken off, signs and white space as single blanks."""
    bare = F.regexp_replace(F.lower(name), LEGAL_FORMS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, SIGNS, " "), r"\s+", " "))


def keywords(text: Column) -> Column:
    """Distinct words of at least four letters that are no stopwords, sorted."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), " ")
    kept = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS))
    return F.array_sort(F.array_distinct(kept))


def first_keywords(text: Column, most: int = 10) -> Column:
    """The first distinct words of at least four letters that are no stopwords, in text order."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), " ")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS))), 1, most)


def extract_identifiers(topics: DataFrame, learned: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Topics with CIP number, entity name, network, flags and the first keywords of the subject. An app or validator is one
    of which the name is known and the flag is set (``is_app`` or ``is_validator`` beside ``entity``). learned: keywords of
    corrections by kind (featured-app, validator, cip), found anywhere in a subject, that set the flags too."""
    s = F.col("subject")
    known = learned or {}
    has = lambda kind: reduce(or_, [F.contains(F.lower(s), F.lit(w.lower())) for w in known.get(kind, ())], F.lit(False))
    vote, talk = s.rlike(VOTE), s.rlike(CIP_TALK)
    app_vote, validator_vote = vote & (s.rlike(APP_VOTE) | s.rlike(NETWORK_COLON)), vote & s.rlike(VALIDATOR_VOTE)
    return topics.select(
        "*", extract_cip(s).alias("cip"), entity_name(s).alias("entity"), many_entities(s).alias("many_entities"), network_of(s).alias("network"), vote.alias("is_vote"),
        (talk | has("cip")).alias("is_cip_discussion"), (vote & s.rlike(CIP_VOTE)).alias("is_cip_vote"), app_vote.alias("is_app_vote"), validator_vote.alias("is_validator_vote"),
        (~talk & (s.rlike(APP) | app_vote | has("featured-app"))).alias("is_app"), (s.rlike(VALIDATOR) | validator_vote | has("validator")).alias("is_validator"), first_keywords(s).alias("keywords"),
    )


def extract_urls(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(url, id): distinct URLs of every text."""
    urls = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(r"(https?://[^\s<>\"')]+)"), 1))
    return df.select(F.col(id_col), F.explode(urls).alias("url"))


def classify_topic(identified: DataFrame, learned: str | None = None) -> DataFrame:
    """Type by ordered rules on subject, flow of the stage and flags; a learned type (a column's name) comes before all.
    The flow of CIPs falls back to other; announcements of tokenomics are apps and approved validators; the shared groups
    and unknown stages fall back to apps."""
    s = F.col("subject")
    flow = F.create_map(*[F.lit(x) for pair in FLOWS.items() for x in pair])[F.col("stage")]
    cip = F.col("is_cip_vote") | F.col("cip").isNotNull()
    validator = F.col("is_validator_vote") | F.col("is_validator") | s.rlike(VALIDATOR_WORK)
    app = F.col("is_app_vote") | F.col("is_app") & F.col("entity").isNotNull()
    kind = (
        F.when(s.rlike(OUTCOME), "outcome").when(s.rlike(UPGRADE), "protocol-upgrade")
        .when(flow == "featured-app", F.when(s.rlike(VALIDATOR_DONE), "validator").otherwise("featured-app")).when(flow.isNull(), "featured-app")
        .when(cip, "cip").when(validator, "validator").when((flow == "cip") & ~F.coalesce(app, F.lit(False)), "other").otherwise("featured-app")
    )
    return identified.withColumn("topic_type", kind if learned is None else F.coalesce(F.col(learned), kind))


#: Letters of the longest key of a contained name, of the longest name that is keyed by what is left without some letters (three
#: edits at most), and of the longest name whose other edit keys tell place and length.
WHOLE_KEY, CUT_NAME, SHORT_NAME = 64, 19, 48
NO_KEYS = "cast(array() as array<bigint>)"
#: Names of one key that one task compares with all that ask for it, about.
DEALT_NAMES = 256


def _edits(n: str) -> str:
    """Edits allowed where the longer name has n letters."""
    return f"cast(greatest(2, floor({n} * 0.2D)) as int)"


def _part(b: str, k: str, i: str) -> tuple[str, str]:
    """(begin, letters) of the i-th of k + 1 even parts of b letters."""
    plain, wide = f"{b} div ({k} + 1)", f"{k} + 1 - {b} % ({k} + 1)"
    return f"({i} * ({plain}) + greatest(0, {i} - ({wide})))", f"({plain} + if({i} >= {wide}, 1, 0))"


def _inside_key(tag: str) -> str:
    return f"array(xxhash64('{tag}', least(n, {WHOLE_KEY}), left(name, {WHOLE_KEY})))"


def _holder_keys(tag: str) -> str:
    """All parts of a name, each once: a name that it contains is one of them."""
    parts = f"flatten(transform(sequence(1, least(n, {WHOLE_KEY})), m -> transform(sequence(1, n - m + 1), p -> xxhash64('{tag}', m, substring(name, p, m)))))"
    return f"array_distinct({parts})"


def _remainder_keys(tag: str) -> str:
    """A name of up to CUT_NAME letters without any 0, 1, ... letters, as many as edits are allowed. Two names within the edits
    of the longer one have such a remainder in common, whichever of their letters are common to many names."""
    on = "(acc, d) -> flatten(transform(acc, x -> if(x.at > length(x.s), cast(array() as array<struct<s: string, at: int>>), transform(sequence(x.at, length(x.s)), p -> struct(concat(left(x.s, p - 1), substring(x.s, p + 1)) as s, p as at)))))"
    levels = f"transform(sequence(0, {_edits('n')}), k -> aggregate(if(k = 0, cast(array() as array<int>), sequence(1, k)), array(struct(name as s, 1 as at)), {on}))"
    return f"if(n > {CUT_NAME}, {NO_KEYS}, transform(flatten({levels}), x -> xxhash64('{tag}', x.s)))"


def _segment_keys(tag: str) -> str:
    """A name of over CUT_NAME letters as the longer one of a pair: cut into one part more than edits are allowed, so that one
    part stays whole."""
    begin, wide = _part("n", _edits("n"), "i")
    letters = f"substring(name, {begin} + 1, {wide})"
    return f"if(n <= {CUT_NAME}, {NO_KEYS}, transform(sequence(0, {_edits('n')}), i -> if(n <= {SHORT_NAME}, xxhash64('{tag}', n, i, {letters}), xxhash64('{tag}', {letters}))))"


def _probe_keys(tag: str) -> str:
    """A name as the shorter one: its parts that may be a whole part of a name of b (over CUT_NAME) letters. With i parts before it broken
    at most i edits stand before, and at most k - i behind it; that bounds the places. Parts of long names (of four and
    five letters) are sought at any place."""
    lengths = f"filter(transform(sequence(greatest(n, {CUT_NAME + 1}), greatest(n, {CUT_NAME + 1}, least({SHORT_NAME}, n + n div 2 + 1))), b -> struct(b, {_edits('b')} as k)), y -> y.b <= {SHORT_NAME} and n >= y.b * 0.7D and y.b - n <= y.k)"
    begin, wide = _part("y.b", "y.k", "i")
    parts = f"flatten(transform({lengths}, y -> transform(sequence(0, y.k), i -> struct(y.b as b, y.k as k, i, {begin} as p, {wide} as w))))"
    low, high = "greatest(0, z.p - z.i, z.p + n - z.b - z.k + z.i)", "least(n - z.w, z.p + z.i, z.p + n - z.b + z.k - z.i)"
    short = f"flatten(transform({parts}, z -> if({low} > {high}, {NO_KEYS}, transform(sequence({low}, {high}), q -> xxhash64('{tag}', cast(z.b as int), z.i, substring(name, q + 1, z.w))))))"
    long = f"if(n * 10 >= {SHORT_NAME} * 7, flatten(transform(array(4, 5), m -> transform(sequence(1, n - m + 1), p -> xxhash64('{tag}', substring(name, p, m))))), {NO_KEYS})"
    return f"concat({short}, {long})"


def match_entities(left: DataFrame, right: DataFrame, edits: bool = True) -> DataFrame:
    """(left_id, right_id, how) of entity names (id, name): equal, one contained in the other, equal without blanks, or
    within edit distance max(2, 20 % of the longer) if the shorter has at least 70 % of its length (without ``edits`` not).

    Distinct names meet under keys that only names with much in common share, by one equi-join: a name is a key to
    the names that contain it (all their parts are keys; beyond 64 letters its first 64); names without blanks are
    keys; and for edits names of up to 19 letters meet under what is left of them without as many letters as edits are
    allowed. Of longer pairs the longer name is cut into one part more than edits are allowed, keyed by its length, the
    number of the part and its letters, while the shorter one asks for those of its parts that stand near enough. Of
    names of over 48 letters the parts alone are keys. Names of 20 letters and more that begin alike in whole parts meet
    under those (``_near_long``). Pairs that match are joined with their ids. Names are written to the shared folder first,
    so that they are found out once. A name has hundreds of keys, so their tables are dealt out by key, never broadcast;
    names matched with themselves are looked up in one direction.
    Null and empty names match nothing.
    """

    def named(df: DataFrame) -> DataFrame:
        return cut(df.select("id", normal_name(F.col("name")).alias("name")).where("name <> ''").distinct())

    def spread(df: DataFrame) -> DataFrame:
        own = df.select("name").distinct()
        tasks = own.count() // 500 + 1  # named, as a few MB of names make many keys: tasks must not be merged by their size
        return own.repartition(tasks, F.xxhash64("name")).withColumn("n", F.length("name"))

    def keyed(own: DataFrame, side: str, *keys: str) -> DataFrame:
        return own.select(F.col("name").alias(side), F.expr(f"explode(array_distinct(concat({', '.join(keys)})))").alias("key"))

    size = "greatest(length(left_name), length(right_name))"
    close = F.expr(f"least(length(left_name), length(right_name)) >= {size} * 0.7D and levenshtein(left_name, right_name, {_edits(size)}) >= 0")  # -1: more
    how = (
        F.when(F.contains("left_name", "right_name") | F.contains("right_name", "left_name"), "contained")
        .when(F.replace("left_name", F.lit(" "), F.lit("")) == F.replace("right_name", F.lit(" "), F.lit("")), "spaces")
    )
    how = how.when(close, "edit") if edits else how

    def matched(pairs: DataFrame, once: str, side: str = "left_name", other: str = "right_name") -> DataFrame:
        """Matches among the pairs; ``once`` tells which rows to look at. It stands in the expression, as a filter before
        it would be merged with the dear one behind it, in any order."""
        return pairs.select(F.col(side).alias("left_name"), F.col(other).alias("right_name"), *[c for c in pairs.columns if c not in (side, other)]).select("left_name", "right_name", F.when(F.expr(once), how).alias("how")).where("how is not null")

    a = named(left)
    own = right is left
    b = a if own else named(right)
    one = spread(a)
    two = one if own else spread(b)
    bare = "array(xxhash64('bare', replace(name, ' ', '')))"
    lefts_of, rights_of = [_holder_keys("h1"), bare], [_inside_key("h1"), bare]
    if not own:
        lefts_of, rights_of = [*lefts_of, _inside_key("h2")], [*rights_of, _holder_keys("h2")]
    found = [matched(keyed(one, "left_name", *lefts_of).join(keyed(two, "right_name", *rights_of).hint("merge"), "key"), "left_name <> right_name")]
    if edits:
        rests = keyed(one.where(f"n <= {CUT_NAME}"), "left_name", _remainder_keys("rest"))
        others = rests.withColumnRenamed("left_name", "right_name") if own else keyed(two.where(f"n <= {CUT_NAME}"), "right_name", _remainder_keys("rest"))
        found.append(matched(rests.join(others.hint("merge"), "key"), "left_name < right_name" if own else "left_name <> right_name"))
        first = "key = array_min(array_intersect(longer_keys, shorter_keys))"
        found.append(matched(_near_long(one, two), f"{'(length(left_name) <> length(right_name) or left_name < right_name)' if own else 'left_name <> right_name'} and {first}", "longer", "shorter"))
        if not own:
            found.append(matched(_near_long(two, one), f"left_name <> right_name and {first}", "shorter", "longer"))
    alike = reduce(DataFrame.unionByName, found)
    if own:
        turned = F.struct(F.col("right_name").alias("left_name"), F.col("left_name").alias("right_name"))
        alike = alike.select(F.explode(F.array(F.struct("left_name", "right_name"), turned)).alias("pair"), "how").select("pair.*", "how")
    alike = alike.distinct()
    lefts, rights = a.select(F.col("id").alias("left_id"), F.col("name").alias("left_name")), b.select(F.col("id").alias("right_id"), F.col("name").alias("right_name"))
    equal = lefts.join(rights.hint("merge"), F.col("left_name") == F.col("right_name")).select("left_id", "right_id", F.lit("equal").alias("how"))
    others = alike.join(lefts.hint("merge"), "left_name").join(rights.hint("merge"), "right_name").select("left_id", "right_id", "how")
    return equal.unionByName(others)


def _near_long(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """(key, longer, longer_keys, shorter, shorter_keys): names (name, n) that meet under a key, as the longer one has over
    CUT_NAME letters and a whole part where the shorter one may have it. Many names share the parts of a common beginning, so
    the keys that a pair may share come with it, to look at it once, and the names under one key are dealt to as many tasks
    as they fill."""
    keys = lambda own, which, name: own.select(F.col("name").alias(name), F.expr(f"array_distinct({which})").alias(f"{name}_keys"))
    long = keys(longer.where(f"n > {CUT_NAME}"), _segment_keys("e"), "longer").select("*", F.explode("longer_keys").alias("key"))
    counts = long.groupBy("key").agg(F.ceil(F.count("*") / DEALT_NAMES).cast("int").alias("lots"))
    asked = keys(shorter.where(f"n >= {CUT_NAME} * 0.7"), _probe_keys("e"), "shorter").select("shorter", F.explode("shorter_keys").alias("key")).join(counts.hint("merge"), "key")
    asked = asked.groupBy("shorter").agg(F.collect_list(F.struct("key", "lots")).alias("met")).select("shorter", F.col("met.key").alias("shorter_keys"), F.explode("met").alias("one"))
    asked = asked.select("shorter", "shorter_keys", F.col("one.key").alias("key"), F.explode(F.sequence(F.lit(0), F.col("one.lots") - 1)).alias("lot"))
    long = long.join(counts.hint("merge"), "key").select("longer", "longer_keys", "key", F.pmod(F.hash("longer"), F.col("lots")).alias("lot"))
    return dealt(long, "key", "lot").join(dealt(asked, "key", "lot").hint("merge"), ["key", "lot"]).drop("lot")


def topic_similarity(pairs: DataFrame) -> DataFrame:
    """Score of topic pairs (columns with and without o_): same CIP 100; same entity 100, contained 80; 50 for an app
    of the same name and 50 for a validator of the same name; 10, 5 or 2 more for dates within 7, 30 or 90 days; a
    match from 70 on."""
    a, b = F.nullif(normal_name(F.col("entity")), F.lit("")), F.nullif(normal_name(F.col("o_entity")), F.lit(""))
    part = F.when(F.col("cip") == F.col("o_cip"), SAME_CIP).otherwise(0)
    name = F.when(a == b, SAME_ENTITY).when(F.contains(a, b) | F.contains(b, a), PART_ENTITY).otherwise(0)
    kinds = [F.when(F.col(k) & F.col(f"o_{k}") & (a == b), SAME_KIND).otherwise(0) for k in ("is_app", "is_validator")]
    days = F.abs(F.datediff("date", "o_date"))
    near = F.when(days <= 7, 10).when(days <= 30, 5).when(days <= 90, 2).otherwise(0)
    return pairs.withColumn("score", part + name + kinds[0] + kinds[1] + near).withColumn("is_match", F.col("score") >= MATCH)


def correlate_topics(typed: DataFrame) -> DataFrame:
    """(topic_id, item_id): topics grouped into items by greedy claims. From the newest topic on (of one date the largest
    id first), a topic that is still open becomes the anchor of an item, which it names, and claims all open topics that
    match it: a CIP those with its number; an app or validator those of its type whose names match (``match_entities``);
    any other topic but an outcome those that score 70 or more with it (``topic_similarity``), which are those with its
    number or an equal or contained name. Outcomes, and apps and validators without a single name, claim nothing; a topic
    of several names is claimed by nothing. typed: identified topics with topic_type.

    Topics alike in all that matters form one class, which its newest topic stands for. The claims of all classes are
    settled in rounds: a class whose newest unclaimed possible claimer is an anchor, or becomes one in this round, is
    claimed by it, one without a newer one is an anchor, others wait. Only the newest such class under each number or name
    is looked at, so that no pairs of classes are made; each round is written to the shared folder. Classes that neither
    claim nor can be claimed stand outside the rounds, and no round sends a table through the driver.
    """
    name = F.nullif(normal_name(F.col("entity")), F.lit(""))
    named = F.col("topic_type").isin("featured-app", "validator")
    scored = ~F.col("topic_type").isin("cip", "outcome", "featured-app", "validator")
    many = F.coalesce("many_entities", F.lit(False))
    rows = typed.select("topic_id", "topic_type", "cip", name.alias("name"), many.alias("many"), F.struct("date", "topic_id").alias("top"))
    claims = ((F.col("topic_type") == "cip") & F.col("cip").isNotNull()) | (named & F.col("name").isNotNull() & ~F.col("many")) | (scored & (F.col("cip").isNotNull() | F.col("name").isNotNull()))
    one = claims & ~F.col("many")  # its own class is among what it claims, so that the class is settled as a whole
    key = F.when(one, F.to_json(F.struct("topic_type", "cip", "name"))).otherwise(F.concat(F.lit("#"), F.col("topic_id").cast("string")))
    rows = cut(rows.withColumn("claims", claims).withColumn("class", key))
    nodes = rows.groupBy("class").agg(F.max("top").alias("top"), *[F.first(c).alias(c) for c in ("topic_type", "cip", "name", "many", "claims")])
    nodes = cut(nodes.withColumn("node", F.col("top.topic_id")))
    names = rows.where("name is not null").select(F.col("name").alias("id"), "name").distinct()
    alike = cut(match_entities(names, names).select("left_id", F.col("right_id").alias("o_name"), "how"))
    # under which keys a class claims, and under which it is looked for
    say = lambda tag, *cs: F.concat_ws(":", F.lit(tag), *cs)
    number = say("cip", "cip")
    under = [nodes.where(~named & F.col("cip").isNotNull()).select("node", number.alias("block")), nodes.where(named).select("node", say("type", "topic_type", "name").alias("block")), nodes.where(scored & F.col("name").isNotNull()).select("node", say("name", "name").alias("block"))]
    claimers = under[0].unionByName(under[1]).unionByName(under[2]).join(nodes.where("claims").select("node"), "node", "left_semi")
    near = nodes.where("name is not null and not many").join(alike, F.col("name") == F.col("left_id"))
    sought = nodes.where("cip is not null and not many").select("node", number.alias("block"))
    sought = sought.unionByName(near.where(named).select("node", say("type", "topic_type", "o_name").alias("block"))).unionByName(near.where("how in ('equal', 'contained')").select("node", say("name", "o_name").alias("block")))
    claimers, sought = cut(claimers), cut(sought.join(claimers.select("block").distinct(), "block", "left_semi").distinct())
    involved = claimers.select("node").union(sought.select("node")).distinct()
    state = cut(nodes.join(involved.hint("merge"), "node", "left_semi").select("node", "top", F.lit(None).cast("string").alias("state"), F.lit(None).cast("long").alias("item_id")))
    while True:
        standing = claimers.join(state.where("state is null or state = 'anchor'").select("node", "top", (F.col("state") == "anchor").alias("anchor")).hint("merge"), "node")
        newest = standing.groupBy("block").agg(F.max(F.struct("top", F.coalesce("anchor", F.lit(False)).alias("anchor"))).alias("newest"))
        waiting = state.where("state is null").select("node", "top").join(sought.hint("merge"), "node", "left")
        found = waiting.join(newest.hint("merge"), "block", "left").groupBy("node").agg(F.max("top").alias("top"), F.max("newest").alias("newest"))
        found = cut(found.select("node", "newest.anchor", F.col("newest.top.topic_id").alias("by"), (F.col("newest").isNull() | (F.col("newest.top") <= F.col("top"))).alias("free")))
        now = found.where("free").select(F.col("node").alias("by"), F.lit(True).alias("becomes"))
        told = found.join(now.hint("merge"), "by", "left").select("node", F.when(F.col("free"), "anchor").when(F.col("anchor") | F.col("becomes"), "claimed").alias("now"), F.when(F.col("free"), F.col("node")).when(F.col("anchor") | F.col("becomes"), F.col("by")).alias("item"))
        state = cut(state.join(told.hint("merge"), "node", "left").select("node", "top", F.coalesce("state", "now").alias("state"), F.coalesce("item_id", "item").alias("item_id")), instead_of=state)
        if not state.where("state is null").take(1):
            break
    items = nodes.select("class", "node").join(state.select("node", "item_id").hint("merge"), "node", "left").select("class", F.coalesce("item_id", "node").alias("item_id"))
    return rows.select("topic_id", "class").join(items.hint("merge"), "class").select("topic_id", "item_id")


def lifecycle_items(topics: DataFrame, correlated: DataFrame) -> DataFrame:
    """Per item: number of topics, first and last date, the type of its anchor (the topic that names it), and the last stage
    in that type's workflow that any of its topics shows, else the anchor's stage."""
    joined = topics.join(correlated, "topic_id")
    own = F.col("topic_id") == F.col("item_id")
    items = joined.groupBy("item_id").agg(
        F.count("*").alias("topics"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max(F.when(own, F.col("topic_type"))).alias("topic_type"),
        F.max(F.when(own, F.col("stage"))).alias("at_first"), F.collect_set("stage").alias("seen"),
    )
    order = F.create_map(*[x for kind, stages in WORKFLOWS.items() for x in (F.lit(kind), F.array(*[F.lit(s) for s in reversed(stages)]))])
    stages = F.coalesce(order[F.col("topic_type")], order["other"])
    return items.select("item_id", "topics", "first_date", "last_date", F.coalesce(F.get(F.filter(stages, lambda s: F.array_contains("seen", s)), F.lit(0)), "at_first").alias("stage"), "topic_type")


def business_order(items: DataFrame) -> DataFrame:
    """Items without a CIP number yet first, then by number descending, then newest."""
    return items.orderBy(F.col("cip").isNotNull(), F.col("cip").desc(), F.col("date").desc(), "topic_id")


def attach_votes(votes: DataFrame, topics: DataFrame, urls: DataFrame) -> DataFrame:
    """Votes (vote_id, url, cip, entity) with the topic found by URL, else by CIP number, else by entity name; of
    several topics the smallest id. A vote without any becomes an item of its own (``how`` synthetic)."""
    by_url = urls.groupBy("url").agg(F.min("topic_id").alias("t_url"))
    by_cip = topics.where("cip is not null").groupBy("cip").agg(F.min("topic_id").alias("t_cip"))
    by_name = topics.where("entity is not null").groupBy(normal_name(F.col("entity")).alias("name")).agg(F.min("topic_id").alias("t_name"))
    joined = votes.withColumn("name", normal_name(F.col("entity"))).join(by_url, "url", "left").join(by_cip, "cip", "left").join(by_name, "name", "left")
    how = F.when(F.col("t_url").isNotNull(), "url").when(F.col("t_cip").isNotNull(), "cip").when(F.col("t_name").isNotNull(), "entity").otherwise("synthetic")
    return joined.select("vote_id", F.coalesce("t_url", "t_cip", "t_name").alias("topic_id"), how.alias("how"))


#: Patterns of actions and texts in the order in which they tell the type of a vote, and those of milestone votes.
ACTION_TYPES = (
    (r"(?i)OffboardSv|OnboardSv|GrantSvStatus", "validator"), (r"(?i)OnboardValidator|OffboardValidator|ValidatorOnboard", "validator"),
    (r"(?i)GrantFeaturedAppRight|RevokeFeaturedAppRight|SetFeaturedAppRight|FeaturedApp", "featured-app"), (r"(?i)ScheduleDomainMigration|ProtocolUpgrade|Synchronizer", "protocol-upgrade"),
    (r"(?i)MintUnclaimed|MintRewards|DistributeRewards|Coupon", "featured-app"),
)
TEXT_TYPES = ((r"(?i)validator", "validator"), (r"(?i)migration|splice\s*\d+\.\d+", "protocol-upgrade"))
KEY_TYPES = ((r"(?i)^cip-\d+$", "cip"), (r"(?i)validator|offboard|onboard", "validator"), (r"(?i)migration|upgrade", "protocol-upgrade"))
MILESTONE_ACTION, MILESTONE_TEXT = r"(?i)MintUnclaimedRewards|SRARC_MintUnclaimed|MintRewards|DistributeRewards|Reward|Coupon", r"(?i)\bmilestone(?:s|\(s\))?\b"
#: Keys of votes that name nothing.
EMPTY_KEYS = ("provider", "validator", "sv", "beneficiary", "partyid", "name")


def _first_type(text: Column, patterns: tuple[tuple[str, str], ...]) -> list[Column]:
    return [F.when(text.rlike(pattern), kind) for pattern, kind in patterns]


def normal_url(url: Column) -> Column:
    """Lower case, without query, fragment and a last slash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"[?#].*$", ""), r"/$", "")


def normal_party(party: Column) -> Column:
    """A party or name in lower case without its network and its fingerprint."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(party), r"(?i)^(mainnet|testnet):\s*", ""), r"(?i)::[0-9a-f]{6,}$", ""))


def lifecycle_keys(items: DataFrame) -> DataFrame:
    """(item_id, key) of items (item_id, topic_type, cip, entity, subject): the number of a CIP, the party of an app or
    validator by its name (else its subject), the subject of others."""
    primary = F.coalesce("cip", "entity", "subject")
    number = F.concat(F.lit("CIP-"), F.lpad(F.regexp_extract("cip", r"^0*(\d+)$", 1), 4, "0"))
    key = F.when((F.col("topic_type") == "cip") & F.col("cip").rlike(r"^\d+$"), number).when(F.col("topic_type").isin("featured-app", "validator"), normal_party(F.coalesce("entity", primary))).otherwise(F.lower(primary))
    return items.select("item_id", key.alias("key"))


def resolve_votes(votes: DataFrame, keys: DataFrame, urls: DataFrame) -> DataFrame:
    """(vote_id, key, how, item_id, vote_type, milestone, at, closed) of votes (vote_id, url, body, action_tag, party, at, closed).

    The key of a vote is, in this order, that of the item that its URL leads to (urls: item_id, url; of several the smallest
    item), the number of a CIP in its reason, the party that its action names, a name in its reason. item_id: the smallest
    item of that key, null if there is none. ``how`` is null where nothing was found.
    """
    text = F.concat_ws(" ", F.coalesce("body", F.lit("")), F.coalesce("url", F.lit("")))
    first = keys.groupBy("key").agg(F.min("item_id").alias("item_id"))
    by_url = urls.select(normal_url(F.col("url")).alias("spot"), "item_id").where("spot <> ''").groupBy("spot").agg(F.min("item_id").alias("item_id")).join(keys, "item_id").select("spot", F.col("key").alias("url_key"))
    number = F.regexp_extract(text, r"(?i)CIP[#\-\s]?0*(\d+)", 1)
    cip = F.when(number != "", F.concat(F.lit("CIP-"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)))
    said = F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)(?:mainnet|testnet):\s*([^\s,\n]+)", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?i)app[:\s]+([^\s,\n]+)", 1), F.lit("")))
    party, name = F.nullif(normal_party(F.col("party")), F.lit("")), normal_party(said)
    rows = votes.withColumn("spot", normal_url(F.col("url"))).join(by_url, "spot", "left")
    rows = rows.select("*", cip.alias("cip_key"), party.alias("party_key"), F.when(F.length(name) > 2, name).alias("name_key"), text.alias("reason"))
    how = F.when(F.col("url_key").isNotNull(), "url").when(F.col("cip_key").isNotNull(), "cip-number").when(F.col("party_key").isNotNull(), "party-id").when(F.col("name_key").isNotNull(), "base-name")
    tag = F.coalesce("action_tag", F.lit(""))
    by_action = F.coalesce(*_first_type(tag, ACTION_TYPES), *_first_type(F.col("reason"), TEXT_TYPES), F.lit("other"))
    kind = F.when(how == "url", F.coalesce(*_first_type(F.col("url_key"), KEY_TYPES), F.lit("featured-app"))).when(how == "cip-number", "cip").when(how.isNotNull(), by_action)
    found = rows.select("vote_id", F.coalesce("url_key", "cip_key", "party_key", "name_key").alias("key"), how.alias("how"), kind.alias("vote_type"), (tag.rlike(MILESTONE_ACTION) | F.col("reason").rlike(MILESTONE_TEXT)).alias("milestone"), "at", "closed")
    return found.join(first, "key", "left").select("vote_id", "key", "how", "item_id", "vote_type", "milestone", "at", "closed")


def synthetic_items(resolved: DataFrame) -> DataFrame:
    """(item_id, key, item_type, votes, active, first_date, last_date): items for the keys of resolved votes that no item has,
    so that votes nobody discussed are seen. Keys that name nothing, of under four signs, or bare hashes give none. The type
    is that of the key's first vote, closed ones before open ones."""
    key = F.col("key")
    open_ = resolved.where(key.isNotNull() & F.col("item_id").isNull() & ~key.isin(*EMPTY_KEYS) & (F.length("key") >= 4) & ~key.rlike(r"(?i)^[0-9a-f]{40,}$"))
    first = F.min_by("vote_type", F.struct((~F.col("closed")).alias("open"), "at", "vote_id"))
    by = open_.groupBy("key").agg(first.alias("item_type"), F.count_if("closed").alias("votes"), F.count_if(~F.col("closed")).alias("active"), F.min("at").alias("first_date"), F.max("at").alias("last_date"))
    return by.select(F.concat(F.lit("synthetic-"), "key").alias("item_id"), "key", "item_type", "votes", "active", "first_date", "last_date")


def resolve_chains(edges: DataFrame) -> DataFrame:
    """(id, root): where each id ends that is led on by edges (id, into, seq), one edge an id. Of the edges of a cycle the
    last one (by seq) is void, as if they had been followed in their order and it had led back to its start.

    Every round doubles the way that is known (pointer jumping); ids that end at no root lead into a cycle, and those on
    which such ways land are the cycle itself. Both passes take as many rounds as the logarithm of the longest way.
    """
    edges = cut(edges.select(F.col("id").cast("long").alias("id"), F.col("into").cast("long").alias("into"), F.col("seq").cast("long").alias("seq")))

    def jumped(own: DataFrame, rounds: int) -> DataFrame:
        way = own.select("id", F.col("into").alias("at"), F.col("seq").alias("last"))
        for _ in range(rounds):
            on = way.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("last").alias("next_last"))
            way = cut(way.join(on, "at", "left").select("id", F.coalesce("next", "at").alias("at"), F.greatest("last", "next_last").alias("last")), instead_of=way)
        return way

    rounds = max(1, edges.count().bit_length())
    ends = jumped(edges, rounds)
    on_cycle = ends.join(edges.select(F.col("id").alias("at")), "at", "left_semi").select(F.col("at").alias("id")).distinct()
    void = ends.join(on_cycle, "id", "left_semi").select("id", "last").join(edges, "id").where("seq = last").select("id")
    good = edges.join(void, "id", "left_anti")
    found = jumped(cut(good), rounds).select("id", F.col("at").alias("root"))
    return found.unionByName(void.select("id", F.col("id").alias("root")))


def apply_overrides(cards: DataFrame, overrides: DataFrame) -> DataFrame:
    """(topic_id, card, topic_type) after manual overrides of lifecycle cards.

    cards: (topic_id, item_id, item_type), one row a topic. overrides: (seq, level, key, action, value); of several of one
    level, key and action the last (by seq) holds. In this order: ``type`` sets an item's type; ``merge`` puts an item
    (level item) into another, chains being followed to their end and a merge that would close a cycle being void, or
    a topic (level topic) into an item; ``move`` puts a topic into an item; ``reclassify`` gives a topic of another type a
    card of its own (topic-reclassified-<id>); ``extract`` gives it one of its item's type (topic-extracted-<id>). Other
    cards are lifecycle-<item>. Targets that are no item, and keys that are nothing, have no effect.
    """
    last = overrides.groupBy("level", "key", "action").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    last = cut(last.withColumn("key", F.col("key").cast("long")).withColumn("target", F.col("value").try_cast("long")))
    items = cards.groupBy("item_id").agg(F.min("item_type").alias("item_type"))
    known = items.select(F.col("item_id").alias("target"))
    own = lambda level, action: last.where((F.col("level") == level) & (F.col("action") == action))
    merges = own("item", "merge").join(known, "target", "left_semi").join(known.withColumnRenamed("target", "key"), "key", "left_semi").where("key <> target")
    roots = cut(resolve_chains(merges.select(F.col("key").alias("id"), F.col("target").alias("into"), "seq")))
    typed = items.join(own("item", "type").select(F.col("key").alias("item_id"), F.col("value").alias("new_type")), "item_id", "left")
    typed = typed.select(F.col("item_id").alias("item"), F.coalesce("new_type", "item_type").alias("type"))

    def placed(rows: DataFrame, column: str) -> DataFrame:
        """``column`` led on to where its item was merged into."""
        return rows.join(roots.select(F.col("id").alias(column), "root"), column, "left").withColumn(column, F.coalesce("root", column)).drop("root")

    def target(action: str) -> DataFrame:
        return placed(own("topic", action).join(known, "target", "left_semi").select(F.col("key").alias("topic_id"), F.col("target").alias(action)), action)

    rows = placed(cards.select("topic_id", F.col("item_id").alias("item")), "item").join(target("merge"), "topic_id", "left").join(target("move"), "topic_id", "left")
    rows = rows.select("topic_id", F.coalesce("move", "merge", "item").alias("item")).join(typed, "item", "left")
    for action in ("reclassify", "extract"):
        rows = rows.join(own("topic", action).select(F.col("key").alias("topic_id"), F.coalesce("value", F.lit("")).alias(action)), "topic_id", "left")
    anew = F.col("reclassify").isNotNull() & ~F.col("reclassify").eqNullSafe(F.col("type"))
    card = F.when(F.col("extract").isNotNull(), F.concat(F.lit("topic-extracted-"), "topic_id")).when(anew, F.concat(F.lit("topic-reclassified-"), "topic_id")).otherwise(F.concat(F.lit("lifecycle-"), "item"))
    return rows.select("topic_id", card.alias("card"), F.when(anew, F.col("reclassify")).otherwise(F.col("type")).alias("topic_type"))


def override_effects(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cards (topics, type) after overrides with the number of topics that came from other items: before (topic_id, item_id),
    after (topic_id, card, topic_type)."""
    both = after.join(before, "topic_id")
    strange = F.col("card") != F.concat(F.lit("lifecycle-"), F.col("item_id").cast("string"))
    return both.groupBy("card").agg(F.count("*").alias("topics"), F.count_if(strange).alias("came"), F.min("topic_type").alias("topic_type"))


def correction_words(corrections: DataFrame) -> DataFrame:
    """(original, corrected, word, count, share): words of at least two and half of the subjects of one transition."""
    rows = corrections.select("original", "corrected", "topic_id", F.explode(keywords(F.col("label"))).alias("word"))
    totals = corrections.groupBy("original", "corrected").agg(F.count_distinct("topic_id").alias("total"))
    counts = rows.groupBy("original", "corrected", "word").agg(F.count_distinct("topic_id").alias("count"))
    share = F.col("count") / F.col("total")
    return counts.join(totals, ["original", "corrected"]).select("original", "corrected", "word", "count", share.alias("share")).where("count >= 2 and share >= 0.5")


def correction_counts(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("original", "corrected").agg(F.count("*").alias("count"), F.count_distinct("label").alias("examples"))


def pattern_suggestions(corrections: DataFrame) -> DataFrame:
    """Per transition the mean share of its significant words, and its level: general with five corrections, mean over
    0.7 and three examples; contextual with two over 0.5; else an edge case."""
    mean = correction_words(corrections).groupBy("original", "corrected").agg(F.avg("share").alias("frequency"), F.array_join(F.array_sort(F.collect_set("word")), ",").alias("words"))
    both = correction_counts(corrections).join(mean, ["original", "corrected"], "left")
    f = F.coalesce("frequency", F.lit(0.0))
    level = F.when((F.col("count") >= 5) & (f > 0.7) & (F.col("examples") >= 3), "general").when((F.col("count") >= 2) & (f > 0.5), "contextual").otherwise("edge_case")
    return both.select("original", "corrected", "count", "examples", f.alias("frequency"), "words", level.alias("level"))


def pattern_decay(patterns: DataFrame, as_of: Column) -> DataFrame:
    """Patterns (pattern_id, confidence, last_used): confidence halved every 30 days, 0.1 at least; archived under 0.2."""
    now = half_life(F.col("confidence"), F.datediff(as_of, F.col("last_used")))
    return patterns.select("pattern_id", now.alias("confidence"), (now < 0.2).alias("archived"))


def keyword_classify(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(topic_id, label): texts that contain any word of a pattern (word, label); words are looked up by equality, so
    this is an equi-join whatever the number of patterns."""
    words = texts.select("topic_id", F.explode(keywords(F.col("subject"))).alias("word"))
    return words.join(patterns, "word").select("topic_id", "label").distinct()


def score_topics(topics: DataFrame, load: Callable[[], Callable[[pd.Series], pd.DataFrame]], text_col: str = "subject") -> DataFrame:
    """(topic_id, label, score): best label of every text by a pluggable model, loaded once in each task. ``load``
    returns a function from a series of texts to a frame of label and score."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            found = model(frame["text"].fillna(""))
            yield pd.DataFrame({"topic_id": frame["topic_id"], "label": found["label"].to_numpy(), "score": found["score"].to_numpy()})

    return topics.select("topic_id", F.col(text_col).alias("text")).mapInPandas(run, "topic_id long, label string, score double")


def fit_topic_model(labelled: DataFrame, path: str, text_col: str = "text", label_col: str = "label", features: int = 1 << 16, rounds: int = 40) -> None:
    """Fit a linear model of labels on the words and word pairs of whole texts, hashed to ``features`` cells, and store it under
    ``path`` (a folder that all executors share). Rows without a label or text don't train. The fit is distributed; what the
    driver holds are the weights, of a fixed size for each label."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("text is not null and label is not null")
    steps = [
        StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc"), RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+"), NGram(inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"), HashingTF(inputCol="terms", outputCol="cells", numFeatures=features, binary=True), LogisticRegression(featuresCol="cells", labelCol="target", maxIter=rounds, regParam=0.01),
    ]
    Pipeline(stages=steps).fit(rows).write().overwrite().save(path)


def score_fitted(topics: DataFrame, path: str, id_col: str = "topic_id", text_col: str = "body") -> DataFrame:
    """(id_col, label, score): the likeliest label of every text and its probability, by a model that ``fit_topic_model`` stored.
    Scoring is vectorised in the JVM; a null text counts as empty."""
    model = PipelineModel.load(path)
    labels = model.stages[0].labels
    scored = PipelineModel(model.stages[1:]).transform(topics.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")))
    chances = vector_to_array("probability")
    best = F.array_max(F.transform(chances, lambda p, k: F.struct(p.alias("p"), (-k).alias("k"))))
    picked = scored.select(id_col, best.alias("best"))
    return picked.select(id_col, F.array(*[F.lit(x) for x in labels])[-F.col("best.k")].alias("label"), F.col("best.p").alias("score"))


def keyword_model() -> Callable[[pd.Series], pd.DataFrame]:
    """A small scorer for tests and defaults: share of each stage's marker words found in a text."""
    marks = {"vote": ("vote", "fee"), "app": ("featured", "app"), "validator": ("validator", "node")}
    found = {label: [re.compile(rf"(?i)\b{w}") for w in words] for label, words in marks.items()}

    def score(texts: pd.Series) -> pd.DataFrame:
        shares = pd.DataFrame({label: sum(texts.str.contains(p).astype(float) for p in ps) / len(ps) for label, ps in found.items()})
        best = shares.idxmax(axis=1).where(shares.max(axis=1) > 0, "other")
        return pd.DataFrame({"label": best, "score": shares.max(axis=1)})

    return score


def evaluate_classifier(gold: DataFrame, predicted: DataFrame, previous: DataFrame) -> DataFrame:
    """Per true type (and over all: null): items, accuracy, and items that got worse or better than in the run before.
    gold: (id, truth); the others: (id, label)."""
    joined = gold.join(predicted.withColumnRenamed("label", "now"), "id", "left").join(previous.withColumnRenamed("label", "before"), "id", "left")
    good, was = F.coalesce(F.col("now") == F.col("truth"), F.lit(False)), F.coalesce(F.col("before") == F.col("truth"), F.lit(False))
    return joined.rollup("truth").agg(F.count("*").alias("items"), F.avg(F.when(good, 1.0).otherwise(0.0)).alias("accuracy"), F.count_if(was & ~good).alias("regressions"), F.count_if(good & ~was).alias("improvements"))


def accuracy_by_category(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Items and accuracy per category (null: standard) and over all (null). gold: (id, truth, category); predicted: (id, label)."""
    joined = gold.withColumn("category", F.coalesce("category", F.lit("standard"))).join(predicted, "id", "left")
    good = F.coalesce(F.col("label") == F.col("truth"), F.lit(False))
    return joined.rollup("category").agg(F.count("*").alias("items"), F.count_if(good).alias("correct"), F.avg(F.when(good, 1.0).otherwise(0.0)).alias("accuracy"))


def no_regression_gate(evaluation: DataFrame) -> DataFrame:
    """One row: whether any item regressed and the change is blocked."""
    return evaluation.where("truth is null").select((F.col("regressions") > 0).alias("blocked"), "regressions", "improvements")


def audit_disagreements(rule: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(topic_id, rule_type, reviewed_type, confidence) where they differ, with whether a review is needed."""
    both = rule.join(reviewed, "topic_id").where("rule_type <> reviewed_type")
    return both.select("topic_id", "rule_type", "reviewed_type", "confidence", (F.col("confidence") < 0.8).alias("needs_review"))


def decision_stats(decisions: DataFrame) -> DataFrame:
    """Decisions (label, source, confidence) by label and source."""
    return decisions.groupBy("label", "source").agg(F.count("*").alias("decisions"), F.avg("confidence").alias("confidence"), F.count_if(F.col("confidence") < 0.5).alias("low"))


def latest_decisions(traces: DataFrame) -> DataFrame:
    """Of the decision traces (item_id, decided_at, ...) of each item the latest one."""
    rest = [c for c in traces.columns if c != "item_id"]
    return traces.groupBy("item_id").agg(F.max_by(F.struct(*rest), F.struct("decided_at", "trace_id")).alias("t")).select("item_id", "t.*")


def query_decisions(
    decisions: DataFrame, kind: str | None = None, since: str | None = None, until: str | None = None, consulted: bool | None = None, min_confidence: float | None = None, limit: int = 100,
) -> DataFrame:
    """Decisions newest first, ``limit`` of them: of one final type, decided between two times (both included), with or without
    a model consulted, of a least confidence. A filter that is None holds for all."""
    out = decisions
    for value, holds in ((kind, F.col("final_type") == kind), (since, F.col("decided_at") >= F.lit(since).cast("timestamp")), (until, F.col("decided_at") <= F.lit(until).cast("timestamp")), (consulted, F.col("consulted") == F.lit(consulted)), (min_confidence, F.col("confidence") >= F.lit(min_confidence))):
        out = out if value is None else out.where(holds)
    return out.orderBy(F.col("decided_at").desc(), "item_id").limit(limit)


def decision_totals(decisions: DataFrame) -> DataFrame:
    """Items, those with a model consulted, and mean confidence, per final type and over all (null)."""
    return decisions.rollup("final_type").agg(F.count("*").alias("items"), F.count_if("consulted").alias("consulted"), F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 2).alias("confidence"))


def direct_actions(events: DataFrame) -> DataFrame:
    """Consuming rule exercises without a vote request in their update; such actions count as executed."""
    used = events.where((F.col("event_type") == "exercised") & F.col("consuming") & of_entity(events, "DsoRules"))
    asked = events.where((F.col("event_type") == "created") & of_entity(events, "VoteRequest")).select("update_id")
    subject = F.regexp_replace("choice", "^[A-Za-z]+_", "")
    return used.join(asked, "update_id", "left_anti").select("event_id", "update_id", "contract_id", "choice", subject.alias("action_subject"), F.lit("executed").alias("status"), "effective_at")


def status_breakdown(canonical: DataFrame) -> DataFrame:
    """Proposals and requests by status, with their share in percent."""
    by = canonical.groupBy("status").agg(F.count("*").alias("proposals"), F.sum("related").alias("requests"))
    return by.select("status", "proposals", "requests", (F.col("proposals") * 100.0 / F.sum("proposals").over(Window.partitionBy())).alias("share"))  # a row a status


def canonical_proposals(proposals: DataFrame) -> DataFrame:
    """One row per proposal id of requests (proposal_id, contract_id, at, status): latest status, related requests,
    first and last sight."""
    return proposals.groupBy("proposal_id").agg(F.max_by("status", F.struct("at", "contract_id")).alias("status"), F.count("*").alias("related"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def proposal_dedupe_stats(canonical: DataFrame) -> DataFrame:
    rows = canonical.agg(F.sum("related").alias("requests"), F.count("*").alias("proposals"))
    return rows.select("requests", "proposals", ((F.col("requests") - F.col("proposals")) * 100.0 / F.col("requests")).alias("duplicate_pct"))


def impact_preview(labels: DataFrame) -> DataFrame:
    """Items (id, current, proposed, truth) by change of label: counts, and how many got better or worse."""
    was, now = F.coalesce(F.col("current") == F.col("truth"), F.lit(False)), F.coalesce(F.col("proposed") == F.col("truth"), F.lit(False))
    return labels.groupBy("current", "proposed").agg(F.count("*").alias("items"), F.count_if(now & ~was).alias("improved"), F.count_if(was & ~now).alias("degraded"))


def proposal_test(labels: DataFrame) -> DataFrame:
    """One row: items unchanged, improved, degraded and otherwise changed, and whether the change is safe."""
    same = F.col("current") == F.col("proposed")
    was, now = F.coalesce(F.col("current") == F.col("truth"), F.lit(False)), F.coalesce(F.col("proposed") == F.col("truth"), F.lit(False))
    bucket = F.when(same, "unchanged").when(now & ~was, "improved").when(was & ~now, "degraded").otherwise("changed")
    counts = labels.agg(*[F.count_if(bucket == b).alias(b) for b in ("unchanged", "improved", "degraded", "changed")])
    return counts.withColumn("safe", F.col("degraded") == 0)


def override_stats(log: DataFrame) -> DataFrame:
    """Override log (action, at) by action and month."""
    return log.groupBy("action", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("entries"))


def pending_apps(items: DataFrame, apps: DataFrame) -> DataFrame:
    """Governance items (id, name) without an app (name) of equal or containing name, either way. Containment is
    resolved by ``match_entities``; there is no pairwise comparison of all names. Items are written first, as they are
    read twice."""
    own = cut(items.select("id", "name"))
    matched = match_entities(own, apps.select(F.monotonically_increasing_id().alias("id"), "name"), edits=False).where("how in ('equal', 'contained')")
    return own.join(matched.select(F.col("left_id").alias("id")), "id", "left_anti")
