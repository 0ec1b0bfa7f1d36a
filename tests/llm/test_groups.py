"""Line dedup, near dedup, vectors, mixing, chat, quality and the pipeline against plain versions on small tables."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import chat, components, line_dedup, mixing, near_dedup, quality, vector_dedup

WORDS = [f"w{k}" for k in range(400)]


def frame(spark, rows):
    """Documents with a column whose name the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")


def corpus(seed=1):
    """Random texts, exact copies, edited copies, shared and edited lines, a large group, nulls and repeats."""
    r = random.Random(seed)
    lines = lambda n: "\n".join(" ".join(r.choice(WORDS) for _ in range(r.randint(3, 14))) for _ in range(n))
    texts = [lines(r.randint(1, 6)) for _ in range(40)]
    base = lines(5)
    for k in range(60):
        words = base.split(" ")
        for _ in range(k % 7):
            words[r.randrange(len(words))] = r.choice(WORDS)
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], texts[5].upper(), texts[7] + "\n" + texts[8], "", " \n ", None, "one", "one two", "one two", "a\n\na\nb a", base + "\n" + base]
    return [(i, t, f"s{i % 3}" if i % 10 else None) for i, t in enumerate(texts)] + [(4, texts[4], "s1")]


def brute_lines(rows):
    """doc -> removed line numbers: Jaccard with any earlier line at least 0.8."""
    seen, gone, every = [], {}, []
    for i, t, _ in rows:
        for k, line in enumerate((t or "").split("\n")):
            every.append(((i, k), frozenset(line.split())))
    for at, words in sorted(every, key=lambda x: x[0]):
        if words:
            if any(o < at and len(words & w) >= 0.8 * len(words | w) - 1e-9 for o, w in seen):
                gone.setdefault(at[0], set()).add(at[1])
            seen.append((at, words))
    return gone


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute_lines(rows)
    for tried, hot, seen in ((3, 8192, 1 << 18), (1, 3, 4), (1, 8192, 1 << 18), (2, 1, 0)):
        monkeypatch.setattr(line_dedup, "TRIED", tried)
        monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
        monkeypatch.setattr(line_dedup, "SEEN", seen)
        got = line_dedup.dedup_lines(frame(spark, rows)).collect()
        assert len(got) == len(rows)
        for r in got:
            removed = want.get(r["doc_id"], set())
            assert set(r["removed"]) == removed
            text = dict((i, t) for i, t, _ in rows)[r["doc_id"]]
            kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in removed)
            assert r["text"] == kept


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, "a b c\nq"), (1, "a b c"), (None, None)], "doc_id long, text string")
    got = {r["text"] for r in line_dedup.dedup_lines(nulls).collect()}
    assert got == {"q", "a b c", None}
    kept = line_dedup.drop_repeated_lines(frame(spark, [(1, "a b", "s"), (2, "a b", "s"), (3, "", "s"), (4, None, "s")])).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4] and set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "key"}


def test_line_dedup_of_clashing_columns(spark):
    rows = [(1, "a b c", 1, 2, 3), (2, "a b c\nd", 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_lines int, kept_text int, doc int")
    got = line_dedup.drop_repeated_lines(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [rows[0], (2, "d", 4, 5, 6)]
    assert line_dedup.dedup_lines(df).count() == 2


def test_lines_of_one_hash_pattern_and_of_one_long_text(spark):
    """Words that polynomial hashes confuse stay apart; a text longer than one chunk is read whole."""
    wave = "a"
    while len(wave) < 4096:
        wave += wave.translate(str.maketrans("az", "za"))
    long = "\n".join(" ".join(f"x{(k * 7919 + j) % 90_001}" for j in range(12)) for k in range(16_000))
    texts = [wave, wave.translate(str.maketrans("az", "za")), long, long + "\nnew line here\nnew line here", wave]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(df).collect()}
    assert len(long) > 1 << 20 and got[0] == got[1] == 0 and got[4] == 1 and got[3] == 16_001


def test_line_dedup_of_null_and_repeated_ids(spark):
    """Every row without an id, and every text of a repeated id, is judged as a document of its own."""
    texts = {"a b c\nd e f": None, "g h i\na b c": None, "j k l\nm n o": None, "p q r\na b c": 7, "s t u\nv w x": 7, "a b c": 1}
    df = spark.createDataFrame([(i, t) for t, i in texts.items()] + [(None, "j k l\nm n o")], "doc_id long, text string")
    want = sorted([("", 2), ("a b c", 0), ("d e f", 1), ("g h i", 1), ("j k l\nm n o", 0), ("p q r", 1), ("s t u\nv w x", 0)])
    assert sorted((r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(df).collect()) == want
    assert sorted(r["text"] for r in line_dedup.drop_repeated_lines(df).collect()) == [t for t, _ in want if t]


def brute_classes(rows, threshold=0.8):
    """doc -> least doc of its component; similarity by the longest common subsequence of words."""
    cut = lambda text: (text or "").lower().split()

    def common(a, b):
        last = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
            last = row
        return last[-1]

    docs = [(i, cut(t)) for i, t, _ in rows]
    label = list(range(len(docs)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            x, y = docs[a][1], docs[b][1]
            m = len(x) if x == y else (0 if not set(x) & set(y) else common(x, y))
            if x == y or m >= threshold * (len(x) + len(y) - m) - 1e-9:
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: least[root(k)] for k, (i, _) in enumerate(docs)}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    want = brute_classes(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    kept = near_dedup.drop_near_duplicates(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_near_dedup_edges(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f g"), (None, "h i j k l m n"), (2, "h i j k l m n")], "doc_id long, text string")
    assert sorted((r["class_id"] is None, r["kept"]) for r in near_dedup.near_duplicates(nulls).collect()) == [(False, False), (False, True), (True, True)]
    assert near_dedup.drop_near_duplicates(nulls).count() == 2


def test_alignment_is_ordered_and_exact():
    a = list(range(100))
    assert near_dedup.aligned(a, a, 0.8)
    assert not near_dedup.aligned(a, a[50:] + a[:50], 0.8)
    for cut in (10, 11, 12):
        b = [x + 1000 * (20 <= x < 20 + cut) for x in a]
        assert near_dedup.aligned(a, b, 0.8) == ((100 - cut) / (100 + cut) >= 0.8)
    assert near_dedup.aligned(a, a[:80], 0.8) and not near_dedup.aligned(a, a[:79], 0.8)
    r = random.Random(2)
    for _ in range(400):
        a = [r.randrange(r.choice((3, 12, 200))) for _ in range(r.randint(1, 60))]
        b = [x for x in a if r.random() > 0.08]
        for _ in range(r.randint(0, 5)):
            b.insert(r.randint(0, len(b)), r.randrange(9))
        if not b:
            continue
        last = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
            last = row
        assert near_dedup.aligned(a, b, 0.8) == (last[-1] >= 0.8 * (len(a) + len(b) - last[-1]) - 1e-9)


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (7, None)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 1000 for k in range(1000, 1100)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 8))
    vectors = [*base, *(base[:30] + r.normal(size=(30, 8)) * 0.15), *(base[0] + r.normal(size=(70, 8)) * 0.1), *base[:4], *base[:4]]
    rows = [(k, [float(x) for x in v], k % 2 if k < 60 else 0) for k, v in enumerate(vectors)]
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] + [1.0] * 7, 0), (903, [None] + [1.0] * 7, 0), (904, rows[0][1], None), (905, rows[0][1][:4], 0), (906, [x * 1e200 for x in rows[0][1]], 0), (907, [float("inf")] * 8, 0), (5, rows[5][1], 1)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<double>, label int, key string")
    got = sorted((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in vector_dedup.vector_links(df).collect())

    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.sqrt(v @ v)

    units, n = [unit(v) for _, v, _ in rows], len(rows)
    link = [[i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] @ units[j] >= 0.93 for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *[label[j] for j in range(n) if link[i][j]]]) for i in range(n)]
    least = {g: min(rows[i][0] for i in range(n) if label[i] == g) for g in set(label)}
    want = sorted((rows[i][0], sum(link[i]), least[label[i]], rows[i][0] == least[label[i]]) for i in range(n))
    assert got == want
    assert vector_dedup.vector_links(df.where("false")).count() == 0


def test_vectors_links_of_a_dense_label(spark):
    """Where all vectors of a label are alike, links that no window of any pass holds are found too."""
    r = np.random.default_rng(5)
    unit = lambda v: v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    base = unit(np.sqrt(0.85) * unit(r.normal(size=(1, 64))) + np.sqrt(0.15) * unit(r.normal(size=(6000, 64))))
    far = r.normal(size=(300, 64))
    far = unit(far - (far * base[:300]).sum(axis=1, keepdims=True) * base[:300])
    vectors = unit(np.r_[base, 0.932 * base[:300] + np.sqrt(1 - 0.932**2) * far])
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in vector_dedup.vector_links(df).collect()}
    link = vectors @ vectors.T >= 0.93
    left, right = np.nonzero(link)
    label = np.arange(len(vectors))
    for _ in range(len(vectors)):
        low = label.copy()
        np.minimum.at(low, left, label[right])
        if (low == label).all():
            break
        label = low
    assert got == {k: (int(link[k].sum()) - 1, int(label[k])) for k in range(len(vectors))}


def test_mixing_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), f"s{i % 4}" if i % 9 else None) for i in range(3000)] + [(5000, None, "empty"), (5001, "a b", "ü")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, targets = 1.5 * sum(sizes.values()), {}
    while True:  # fill, stop those over twice their size, share again
        left = budget - sum(targets.values())
        free = [s for s in names if s not in targets]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            targets |= share
            break
        targets |= {s: 2.0 * sizes[s] for s in over}
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
    for s in names:
        assert 0 <= targets[s] - taken[s] < 60
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark, rows).repartition(5)).collect()))
    repeated = mixing.take(frame(spark, rows))
    assert repeated.count() == sum(r["copies"] for r in got) and repeated.columns == frame(spark, []).columns
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixing_of_clashing_columns_null_and_repeated_ids(spark):
    rows = [(1, "a b", "s", 7), (1, "c", "s", 8), (None, "d e", "s", 9), (None, None, None, 1), (3, "x " * 9, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    copies = mixing.mix(df).collect()
    assert len(copies) == 5
    taken = mixing.take(df)
    assert taken.columns == df.columns and taken.count() == sum(r["copies"] for r in copies)


def test_mixing_of_sources_with_equal_ratios(spark):
    """Ties of cap / weight: equal sizes and weights stop at the same level."""
    df = spark.createDataFrame([(i, "w " * 10, f"s{i % 6}") for i in range(600)], "doc_id long, text string, source string")
    got = {(r["source"], r["target"]) for r in mixing.mix(df).collect()}
    assert got == {(f"s{k}", (2000.0, 833.333333, 1666.666667)[k % 3]) for k in range(6)}


LAYOUTS = [
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "x", "output": "o", "id": 7}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": None}, [("user", "i"), ("assistant", "")]),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "human", "content": "h"}, {"role": "assistant", "content": "a"}]}, [("system", "s"), ("user", "h"), ("assistant", "a")]),
    ({"conversations": [{"from": "gpt", "value": "g"}]}, [("assistant", "g")]),
    ({"question": "q", "answer": "a", "context": "k"}, [("user", "k\n\nq"), ("assistant", "a")]),
]


def test_layouts_are_told_apart(spark):
    records = [(k, json.dumps(r)) for k, (r, _) in enumerate(LAYOUTS)] + [(90, "no json"), (91, None), (92, '{"other":1}'), (93, "[1]")]
    rows = chat.canonical_turns(spark.createDataFrame(records, "id long, json string"), "id", "json").orderBy("id", "turn").collect()
    for k, (_, want) in enumerate(LAYOUTS):
        assert [(r["role"], r["text"]) for r in rows if r["id"] == k] == want
    assert all(r["layout"] is None for r in rows if r["id"] >= 90) and sum(r["id"] >= 90 for r in rows) == 4
    assert chat.fingerprint({"a": 1, "b": [{"c": 2}]}) == chat.fingerprint({"b": [{"c": "x"}, {"c": None}], "a": "y"}) != chat.fingerprint({"a": 1, "b": [{"d": 2}]})


@pytest.mark.parametrize("text", ["", "<|end|>", "</s>[INST] ok [/INST]", "\\", "<\\", "[\\\\<", "\\<|turn|>\\", "a\nb<|text|>", "<" * 9 + "\\" * 9])
def test_template_is_reversible(text):
    marked = chat.escape(text)
    assert chat.unescape(marked) == text
    assert not any(s in marked for s in ("<|", "</s>", "[INST]", "[/INST]"))
    assert chat.parse_chat(chat.format_turn(text, text) + chat.format_turn("user", text)) == [(text, text), ("user", text)]


def test_chats(spark):
    turns = [(1, 0, "user", "hi"), (1, 2, "assistant", "b<|end|>"), (1, 1, "assistant", None), (2, None, None, "x"), (2, 0, "assistant", "é"), (2, 0, "assistant", "é"), (None, 0, "user", "n")]
    chats = chat.format_chats(spark.createDataFrame(turns, "id long, turn long, role string, text string"), "id")
    got = {r["id"]: r for r in chat.read_chats(chats, "id").collect()}
    said = {1: [("user", "hi"), ("assistant", ""), ("assistant", "b<|end|>")], 2: [("", "x"), ("assistant", "é"), ("assistant", "é")], None: [("user", "n")]}
    for i, want in said.items():
        loss = "".join(t for r, t in want if r == "assistant")
        assert got[i]["n_turns"] == len(want) and got[i]["loss_chars"] == len(loss)
        assert got[i]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
        assert got[i]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def labelled(spark, n=600):
    r = random.Random(5)
    rows, marks = [], []
    for i in range(n):
        good = r.random() < 0.7
        words = [r.choice(WORDS) for _ in range(r.randint(20, 80))]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), "s"))
        marks.append((i, int(good), 0))
    return frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert 60 < len(held) < 200
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    again = quality.score_quality(docs.repartition(3), labels.repartition(2))
    assert {r["doc_id"]: r["score"] for r in again.collect()} == {r["doc_id"]: r["score"] for r in got}


def test_quality_sees_no_held_out_labels(spark):
    docs, labels = labelled(spark, 200)
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted((r["doc_id"], r["score"]) for r in quality.score_quality(docs, x).collect()) for x in (labels, turned))
    assert one == two


def test_quality_of_rows_without_an_id(spark):
    docs, labels = labelled(spark, 200)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good, bad = (next(t for i, t in texts.items() if marks[i] == k) for k in (1, 0))
    more = frame(spark, [(None, good, "s"), (None, bad, "s"), (9000, good, "s"), (9000, bad, "s")])
    kept = quality.keep_good(docs.unionByName(more), labels).where("doc_id is null or doc_id = 9000").collect()
    assert [r["text"] for r in kept] == [good, good]


def test_quality_edges(spark):
    docs, labels = labelled(spark, 50)
    odd = docs.unionByName(frame(spark, [(None, None, None), (7000, "", "s"), (7001, " \n", "s"), (3, "again", "s")]))
    assert quality.score_quality(odd, labels).count() == 54
    assert {r["score"] for r in quality.score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert quality.score_quality(docs.where("false"), labels).count() == 0
    wide = quality.score_quality(docs, labels, sample_rows=10)
    assert wide.count() == 50


def test_model_finds_an_interaction():
    r = np.random.default_rng(0)
    x = r.uniform(size=(4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (7, 2) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_pipeline_stages(spark, tmp_path):
    docs, labels = labelled(spark, 60)
    docs = docs.unionByName(frame(spark, [(200 + i, t, s) for i, t, s in corpus()]))
    docs.drop("key").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near dedup", "mixing", "packing"]
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, left, str(tmp_path))
        if name != "packing":
            assert out.columns == left.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        before, left = left, spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append((name, before, left))
    rejected = {r["doc_id"] for r in quality.score_quality(seen[0][1], labels).where("predicted = 0").collect()}
    assert not rejected & {r["doc_id"] for r in seen[0][2].collect()}
    rows = [(r["doc_id"], r["text"], None) for r in seen[1][1].collect()]
    gone = brute_lines(rows)
    kept = {r["doc_id"]: r["text"] for r in seen[1][2].collect()}
    for i, t, _ in rows:
        want = t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert kept.get(i) == want if i in kept else not (want or "").split()
    classes = brute_classes([(r["doc_id"], r["text"], None) for r in seen[2][1].collect()])
    assert sorted(r["doc_id"] for r in seen[2][2].collect()) == sorted(set(classes.values()))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(seen[3][1]).collect()}
    assert Counter(r["doc_id"] for r in seen[3][2].collect()) == Counter({i: n for i, n in copies.items() if n})
    assert sum(r["length"] for r in seen[4][2].collect()) >= seen[4][1].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4][2].count()


def test_vectors_repeated_at_the_head_of_a_batch(spark):
    """Equal vectors are one, and only they: repeats among the first rows of a batch link with their copies alone."""
    r = np.random.default_rng(11)
    vectors = r.normal(size=(64, 64))
    vectors[1], vectors[17], vectors[18] = vectors[0], vectors[16], vectors[16] * 3.0
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").coalesce(1)
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in vector_dedup.vector_links(df).collect()}
    twins = {0: (1, 0, True), 1: (1, 0, False), 16: (2, 16, True), 17: (2, 16, False), 18: (2, 16, False)}
    assert got == {k: twins.get(k, (0, k, True)) for k in range(64)}


def test_chat_records_that_cannot_be_read(spark):
    deep = '{"messages":' + "[" * 200_000 + "]" * 200_000 + "}"
    bad = [None, "", "no json", deep, '{"prompt":"\\ud800","completion":"x"}', '{"conv_id":1,"turn":"two","role":"user","text":"x"}', '{"conv_id":1,"turn":1.5,"role":"user","text":"x"}', '{"conv_id":1,"turn":' + "9" * 30 + ',"role":"user","text":"x"}', "[1]", '{"other":1}']
    good = '{"prompt":"a","completion":"b"}'
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*bad, good])], "conv_id long, record string")
    rows = chat.canonical_turns(df, "conv_id", "record").collect()
    assert sorted(tuple(x) for x in rows if x["conv_id"] < len(bad)) == [(k, None, None, None, None) for k in range(len(bad))]
    assert sorted((x["layout"], x["turn"], x["role"], x["text"]) for x in rows if x["conv_id"] == len(bad)) == [("prompt-completion", 0, "user", "a"), ("prompt-completion", 1, "assistant", "b")]


def test_quality_trains_once_on_an_id(spark):
    """However often an id repeats in either table, it is one row for the fit."""
    docs = spark.createDataFrame([(k % 4, f"text {k % 4} " * (k % 4 + 1)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 4, k % 2) for k in range(400)], "doc_id long, quality int")
    once = quality.score_quality(docs.dropDuplicates(["doc_id"]), labels.dropDuplicates(["doc_id"]))
    many = quality.score_quality(docs, labels)
    want = {r["doc_id"]: r["score"] for r in once.collect()}
    assert all(abs(r["score"] - want[r["doc_id"]]) < 1e-12 for r in many.collect()) and many.count() == 400


def test_near_copies_of_every_length_are_linked(spark):
    """Pairs at the threshold with single words replaced at even distance, the worst case for shingles."""
    r = np.random.default_rng(8)
    rows, many = [], 120
    lengths = (9, 12, 18, 30, 47, 48, 55, 60, 61, 100, 200, 1000)
    for n in lengths:
        for _ in range(many):
            words = [f"w{x}" for x in r.integers(0, 50_000, n)]
            copy, edits = list(words), n // 9
            for k in range(edits):
                copy[min(n - 1, (2 * k + 1) * n // (2 * edits))] = f"x{r.integers(0, 50_000)}"
            assert near_dedup.aligned(words, copy, 0.8)
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, n in enumerate(lengths):
        ids = range(2 * many * k, 2 * many * (k + 1), 2)
        assert np.mean([got[i] == got[i + 1] for i in ids]) >= 0.95, n
        assert len({got[i] for i in ids}) == many


def test_texts_of_colliding_keys_are_told_apart(spark):
    """Texts whose first keys are equal are one only if the second ones, of other word hashes under a secret seed, agree."""
    real = near_dedup.hash_runs
    try:
        near_dedup.hash_runs = lambda values, starts, ends, seed=0: real(values, starts, ends, seed) if seed else np.full(len(starts), 7, dtype=np.uint64)
        docs = spark.createDataFrame([(k, f"text {k} " * 12) for k in range(6)] + [(9, "text 3 " * 12)], "doc_id long, text string")
        got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(docs).collect()}
    finally:
        near_dedup.hash_runs = real
    assert got[9] == 3
