"""Language id, spelling variants and periodic runs against plain versions of their definitions."""

from __future__ import annotations

import collections
import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import language, quality, queries, runs, spelling
from ledgerloom.llm.ragged import utf8

EXTRA = "doc_id long, text string, lang string, word string, runs string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "w", "r", "s") for i, t, lang in rows], EXTRA)


# ---- runs -------------------------------------------------------------------------------------------------------------------


def plain_runs(words):
    """Every stretch by every period, the definition read off."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        k = 0
        while k < n - q:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k < n - q and words[k] == words[k + q]:
                k += 1
            length = k - start + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
    return sorted((s, length, q) for (s, length), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.integers(1, 6))
def test_runs_equal_the_definition(texts, repeats):
    texts = [t[:8] * repeats + t[8:] for t in texts]
    ids = np.array([w for t in texts for w in t], dtype=np.int64)
    row = np.array([k for k, t in enumerate(texts) for _ in t], dtype=np.int64)
    want, at = [], 0
    for t in texts:
        want += sorted(([s + at, length, q] for s, length, q in plain_runs(t)), key=lambda r: (r[0], r[2]))
        at += len(t)
    assert runs.runs_of(ids, row).tolist() == want


RUN_TEXTS = [
    None, "", " \n\t ", "a", "a a a a a a", "a a a a a", "x a b a b a b a b y", "a\nb\ta b  a b a b", "é é é é é é ü", "one two three four", "w " * 4000 + "end", ("p q r " * 700 + "z ") * 2,
    "a b a b a b a b c a b a b a b a b", "a b a b a b a b c a b a b a b a b",
]


def plain_digest(text):
    words = (text or "").encode().split()
    found = plain_runs(words)
    found.sort(key=lambda r: (r[0], r[2]))
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    first = (best[0], best[1], best[2], best[1] * 1000 // best[2]) if best else (None,) * 4
    return (len(found), *first, sha("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_run_digests(spark):
    docs = frame(spark, [(i if i % 3 else None, t, "en") for i, t in enumerate(RUN_TEXTS)]).repartition(3)
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = collections.Counter(tuple(r[c] for c in columns) for r in runs.digest(runs.find_runs(docs)).collect())
    assert got == collections.Counter(plain_digest(t) for t in RUN_TEXTS)
    assert runs.digest(runs.find_runs(docs.where("false"))).count() == 0


def test_long_texts_and_colliding_words(spark, monkeypatch):
    text = "la " * 120_000 + "b c " * 50_000
    got = runs.find_runs(frame(spark, [(1, text, None)])).first()
    assert [tuple(r) for r in got["runs"]] == [(0, 120_000, 1), (120_000, 100_000, 2)]
    assert (got["n_words"], got["collapsed"]) == (220_000, "la b c")
    monkeypatch.setattr(runs, "hash_spans", lambda flat, starts, ends: (ends - starts).astype(np.uint64))
    flat, _ = utf8(pa.array(["ab cd ab ef cd"]))
    assert len(set(runs.word_ids(flat, np.array([0, 3, 6, 9, 12]), np.array([2, 5, 8, 11, 14])).tolist())) == 3


def test_repeated_tails(spark):
    texts = {i: " ".join(f"w{k}" for k in range(i % 50 + 1)) for i in range(200)} | {300: "", 301: None}
    rows = frame(spark, [(i, t, None) for i, t in texts.items()])
    from pyspark.sql import functions as F

    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    got = {r["doc_id"]: r["t"] for r in rows.select("doc_id", runs.repeat_tail(F.col("text"), key).alias("t")).collect()}
    for i, t in texts.items():
        h, words = zlib.crc32(str(i).encode()), (t or "").split()
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(words[k if k < a else a + (k - a) % p] for k in range(n))
        assert got[i] == t


# ---- spelling ---------------------------------------------------------------------------------------------------------------

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(rows, damage, least=7, count=2):
    found = collections.Counter()
    for i, text in rows:
        for run in LETTERS.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if damage and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= count}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None)
    return out


def spelled(spark, words):
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    return {r["word"]: tuple(r) for r in spelling.spelling_variants(table).collect()}


def test_near_words_equal_all_pairs(spark):
    random = np.random.default_rng(7)
    words = {}
    for alphabet, lengths, many in (("ab", (7, 11), 250), ("abcdefgéÉÿ", (7, 9), 250), ("a", (7, 16), 9)):
        for _ in range(many):
            w = "".join(random.choice(list(alphabet), random.integers(*lengths)))
            words[w] = int(10 ** random.integers(0, 5)) + 2
            k, c = random.integers(len(w)), random.choice(list(alphabet))
            for v in (w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]):
                if len(v) >= 7:
                    words[v] = int(10 ** random.integers(0, 5)) + 2
    assert spelled(spark, words) == plain_variants(words)


def test_chains_of_forms_and_ties(spark):
    words = {"aaaaaaab": 2, "aaaaaaac": 20, "aaaaaadc": 200, "aaaaaedc": 2000, "bbbbbbbb": 3, "bbbbbbbc": 30, "bbbbbbbd": 30, "b" * 3000: 5, "b" * 3001: 50, "qrstuvw": 4}
    got = spelled(spark, words)
    assert got == plain_variants(words)
    assert got["aaaaaaab"][2] == "aaaaaedc" and got["bbbbbbbb"][1] == "bbbbbbbc" and got["qrstuvw"][1:3] == (None, "qrstuvw")


@pytest.mark.parametrize("damage", [False, True])
def test_words_of_texts(spark, damage):
    texts = [None, "", "123 --", "Ordinary ORDINARY ordinaryé ÉTRANGE étrange āordinaryā ordinar", "x" * 5000, "×÷" * 5, "abcdefg1abcdefg", "ãããããããã ã" + "ã" * 8] + [f"letters{chr(97 + k % 26)} common words repeat" for k in range(300)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] * 2
    got = {r["word"]: r["n"] for r in spelling.count_words(frame(spark, [(i, t, None) for i, t in rows]), damage=damage).collect()}
    assert {w: n for w, n in got.items() if n >= 2} == plain_words(rows, damage)
    assert spelling.group_spellings(frame(spark, []), damage=damage).count() == 0


def test_crc_of_spans():
    flat, offsets = utf8(pa.array(["a", "", "bc", "longer text é", "zz"]))
    state = np.array([zlib.crc32(b"17:"), zlib.crc32(b""), zlib.crc32(b"x"), zlib.crc32(b"null:"), 0], dtype=np.uint32)
    got = spelling.crc32_spans(state, flat, offsets[:-1], offsets[1:])
    assert got.tolist() == [zlib.crc32(b"17:a"), 0, zlib.crc32(b"xbc"), zlib.crc32("null:longer text é".encode()), zlib.crc32(b"zz")]


# ---- language ---------------------------------------------------------------------------------------------------------------


def plain_cells(text):
    """Cells of all 1- to 4-grams, one character at a time."""
    mask, odd, mix = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD
    signs = []
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        signs.append(ord(low) if unicodedata.category(c)[0] in "LM" else 0)
    codes = [0]
    for c in [*signs, 0]:
        if c or codes[-1]:
            codes.append(c)
    cells = set()
    for k in range(len(codes)):
        key = 0
        for n in range(1, 5):
            if k + n > len(codes):
                break
            key = codes[k] * odd & mask if n == 1 else ((key ^ key >> 31) * odd + codes[k + n - 1] * mix) & mask
            if n > 1 or codes[k]:
                cells.add(((key ^ key >> 29) * odd & mask) >> 48)
    return cells


MIXED = ["", "a", "Hello, World! 12", "  Über  allen\n\n", "中文 text", "näive", "--", "x" * 50, "İstanbul"]


def test_presence_equals_plain_grams():
    flat, offsets = utf8(pa.array(MIXED))
    got = [set(np.flatnonzero(p).tolist()) for p in language.presence(flat, offsets)]
    assert got == [plain_cells(t) if any(unicodedata.category(c)[0] in "LM" for c in t) else set() for t in MIXED]


def corpus(n=240):
    random = np.random.default_rng(3)
    parts = {"en": ["th", "e", "ing", "an", "d", "er"], "de": ["sch", "en", "ü", "ber", "ung", "ei"], "fr": ["eau", "é", "le", "tion", "ou", "ai"]}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 3]
        words = ["".join(random.choice(parts[lang], random.integers(1, 4))) for _ in range(random.integers(3, 60))]
        rows.append((i, " ".join(words), lang if i % 11 else None))
    return rows


def test_languages_equal_a_plain_regression(spark):
    rows = corpus()
    odd = [(900, None, "en"), (901, "12 --", "de"), (902, "", None), (None, "the ing and", "en"), (904, "the " * 300_000, "en"), (5, rows[5][1], rows[5][2])]
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in language.identify(frame(spark, rows + odd).repartition(4)).collect()]
    out = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 0
    # the model, from the definition: all learnable rows once, in the operator's order, kernel by sets
    learnt = {(r["lang"], r["key"]): r["text"] for r in frame(spark, rows + odd).selectExpr("lang", "text", "doc_id", "xxhash64(doc_id, text) as key").collect() if r["lang"] and r["text"] is not None and not out(r["doc_id"])}
    train = [(k[0], plain_cells(t) if any(map(str.isalpha, t)) else set()) for k, t in sorted(learnt.items())]
    names = sorted({lang for lang, _ in train})
    marks = [c for name in names for c in [c for lang, c in train if lang == name][: language.LANDMARKS // len(names)]]
    kern = lambda one, two: np.array([[len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1)) for b in two] for a in one])
    value, vector = np.linalg.eigh(kern(marks, marks))
    fine = value > 1e-8 * value.max()
    root = vector[:, fine] / np.sqrt(value[fine])
    x = np.c_[kern([c for _, c in train], marks) @ root, np.ones(len(train))]
    own = np.array([names.index(lang) for lang, _ in train])
    y = np.where(own[:, None] == np.arange(len(names)), 1.0, -1.0)
    w = len(own) / (len(names) * np.bincount(own)[own])
    ridge = np.eye(x.shape[1]) * language.RIDGE * len(own)
    ridge[-1, -1] = 1e-9 * len(own)
    solved = np.linalg.solve(x.T @ (w[:, None] * x) + ridge, x.T @ (w[:, None] * y))
    want = []
    for i, text, _ in rows + odd:
        if not any(map(str.isalpha, text or "")):
            want.append((i, out(i), "und", 0.0))
            continue
        values = np.r_[(kern([plain_cells(text)], marks) @ root)[0], 1.0] @ solved
        want.append((i, out(i), names[int(values.argmax())], min(max((values.max() + 1) / 2, 0), 1)))
    order = lambda r: (str(r[0]), r[3])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-4)


def test_language_without_labels_and_bounds(spark, monkeypatch):
    assert language.identify(frame(spark, [])).count() == 0
    got = language.identify(frame(spark, [(1, "some text", None), (2, None, None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    # a row repeated very often is one training row
    names, packed = language.sample(frame(spark, [(1, "some text", "en")] * 500 + [(2, "un texte", "fr"), (3, "autre texte", "fr")]), "doc_id", "text", "lang", 10)
    assert len(packed) == len(names) <= 3
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language.identify(frame(spark, [(k, "text", f"l{k}") for k in range(20)]))


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op11_language(spark, data).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.97

# ---- quality ----------------------------------------------------------------------------------------------------------------


def plain_features(text):
    """The features of one text, a word and a character at a time."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, size = len(words), len(data)
    lines = data.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines  # nothing stands behind the last break
    share = lambda keep: sum(keep(b) for b in data)
    letters = share(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
    triples = [tuple(words[k : k + 3]) for k in range(n - 2)]
    return [
        np.log1p(n), sum(map(len, words)) / n, share(lambda b: 65 <= b <= 90) / max(letters, 1), share(lambda b: b in b"#$%&*+=<>@^_~`\\/") / size, share(lambda b: 48 <= b <= 57) / size,
        share(lambda b: b in b"\t\n\v\f\r ") / size, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, max(collections.Counter(words).values()) / n, len(lines) / n,
        1 - len(set(lines)) / max(len(lines), 1), data.count(b"|") / size, sum(w[-1] in b"!?" for w in words) / n, sum(w[-1] in b".,;:" for w in words) / n, share(lambda b: b >= 128) / size,
        len(set(triples)) / max(len(triples), 1), np.log1p(max(map(len, words))), share(lambda b: b in b"[]{}()") / size,
    ]


def plain_tree(g, h, depth):
    """The shallow tree by trying every cut."""
    def worth(gs, hs):
        return sum(gs) ** 2 / (sum(hs) + 1)

    best, at = worth(g, h) + 1e-9, 0
    for k in range(1, len(g)):
        if depth and sum(h[:k]) >= quality.LEAF and sum(h[k:]) >= quality.LEAF:
            gain = worth(g[:k], h[:k]) + worth(g[k:], h[k:])
            if gain > best:
                best, at = gain, k
    if not at:
        return [sum(g) / (sum(h) + 1)] * len(g)
    return plain_tree(g[:at], h[:at], depth - 1) + plain_tree(g[at:], h[at:], depth - 1)


def test_quality_features_equal_plain_ones():
    texts = ["", " \n", "One two, two THREE! [x] a|b 12 é\n\nsame line\nsame line\n", "a", "a a a a a a a", "x\n", "\nlast", "w" * 300 + "? " + "é" * 40, "a b c a b c a b c d"]
    flat, offsets = utf8(pa.array(texts))
    np.testing.assert_allclose(quality.features(flat, offsets), [plain_features(t) for t in texts], atol=1e-12)


def test_quality_model_equals_a_plain_boosting(monkeypatch):
    """The single-feature part of the model, boosted by exhaustive cuts over plain lists, and scores by plain table look-ups."""
    monkeypatch.setattr(quality, "ROUNDS", 6)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 3)
    random = np.random.default_rng(4)
    x = random.normal(size=(90, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 3] * x[:, 5] + random.normal(size=90) * 0.3 > 0).astype(float)
    model = quality.fit(x, y)
    edges = [sorted({float(np.quantile(x[:, k], q)) for q in np.linspace(0, 1, quality.BINS + 1)[1:-1]}) for k in range(x.shape[1])]
    own = [[sum(v >= e for e in edges[k]) for v in x[:, k]] for k in range(x.shape[1])]
    base = float(np.log(y.mean() / (1 - y.mean())))
    total, tables = [base] * 90, [[0.0] * quality.BINS for _ in edges]
    for _ in range(6):
        for k in range(len(edges)):
            g, h = [0.0] * quality.BINS, [0.0] * quality.BINS
            for i in range(90):
                p = 1 / (1 + np.exp(-total[i]))
                g[own[k][i]] += y[i] - p
                h[own[k][i]] += p * (1 - p)
            step = plain_tree(g, h, 2)
            for b in range(quality.BINS):
                tables[k][b] += quality.STEP * step[b]
            total = [t + quality.STEP * step[own[k][i]] for i, t in enumerate(total)]
    for k in range(len(edges)):
        shift = sum(tables[k][own[k][i]] for i in range(90)) / 90
        np.testing.assert_allclose(model.tables[k], np.array(tables[k]) - shift, atol=1e-9)
        base += shift
    assert model.base == pytest.approx(base, abs=1e-9) and len(model.pairs) == quality.PAIRS
    want = []
    for row in x:
        s = model.base + sum(model.tables[k][sum(row[k] >= e for e in model.edges[k])] for k in range(len(row)))
        for (a, b), grid in zip(model.pairs, model.pair_tables, strict=True):
            s += grid[sum(row[a] >= e for e in model.coarse[a]) * quality.PAIR_BINS + sum(row[b] >= e for e in model.coarse[b])]
        want.append(1 / (1 + np.exp(-s)))
    np.testing.assert_allclose(model.score(x), want, atol=1e-9)
