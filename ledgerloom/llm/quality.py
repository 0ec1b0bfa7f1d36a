"""Quality classifier: a generalised additive model with pairwise interactions, as lookup tables over feature bins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.ragged import hash_spans, row_chunks, utf8, word_spans
from ledgerloom.llm.store import Written
from ledgerloom.llm.worker import giving_back

FEATURES = (
    "log_words", "word_bytes", "upper", "marks", "digits", "white", "distinct_words", "repeats_before", "top_word", "lines",
    "repeated_lines", "bars", "shouts", "stops", "high_bytes", "distinct_triples", "longest_word", "brackets",
)
#: Most labelled rows that the model is fitted on (a hash of the id chooses them) and share of ids held out: 1 of FOLDS.
SAMPLE_ROWS, FOLDS = 50_000, 5
#: Bins of a feature, bins a side of a pair, pairs, boosting rounds of each, step size, and least weight of a leaf.
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, STEP, LEAF = 48, 12, 8, 250, 80, 0.08, 2.0
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _byte_flags(signs: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(signs)] = True
    return out


_UPPER = _byte_flags(bytes(range(65, 91)))
_LETTER = _byte_flags(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGIT = _byte_flags(bytes(range(48, 58)))
_MARK = _byte_flags(b"#$%&*+=<>@^_~`\\/")
_WHITE = _byte_flags(bytes([9, 10, 11, 12, 13, 32]))


def features(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, features) of whole texts; a text without words has zeros (and log_words 0)."""
    rows = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    row_of = np.repeat(np.arange(rows), np.diff(offsets))

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(row_of, weights=flags[flat], minlength=rows)

    starts, ends, row = word_spans(flat, offsets)
    words = hash_spans(flat, starts, ends)
    n = np.bincount(row, minlength=rows)
    some = np.maximum(n, 1)
    length = ends - starts

    def distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct values, most frequent value's count) of each row."""
        key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
        if not len(key):
            return np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        own = (key[heads] >> np.uint64(44)).astype(np.int64)
        most = np.zeros(rows, dtype=np.int64)
        np.maximum.at(most, own, np.diff(np.r_[heads, len(key)]))
        return np.bincount(own, minlength=rows), most

    kinds, most = distinct(words, row)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    triple = words[:-2] + words[1:-1] * _ODD + words[2:] * _ODD * _ODD
    inside = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, dtype=bool)
    triples, _ = distinct(triple[inside], row[2:][inside])
    per_triple = np.maximum(np.bincount(row[2:][inside], minlength=rows), 1)
    breaks = np.flatnonzero(flat == 10)
    heads = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], breaks + 1])
    heads = heads[heads < len(flat)]
    stops = np.r_[heads[1:], len(flat)][: len(heads)]
    line_row = np.searchsorted(offsets, heads, side="right") - 1
    lines = np.bincount(line_row, minlength=rows)
    line_kinds, _ = distinct(hash_spans(flat, heads, stops - (flat[stops - 1] == 10)), line_row) if len(heads) else (lines, lines)
    last = flat[ends - 1] if len(ends) else np.zeros(0, dtype=np.uint8)
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)

    def of_words(flag: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=flag, minlength=rows) / some

    columns = (
        np.log1p(n), np.bincount(row, weights=length, minlength=rows) / some, share(_UPPER) / np.maximum(share(_LETTER), 1), share(_MARK) / size,
        share(_DIGIT) / size, share(_WHITE) / size, kinds / some, of_words(again), most / some, lines / some,
        1 - line_kinds / np.maximum(lines, 1), share(_byte_flags(b"|")) / size, of_words(np.isin(last, list(b"!?"))), of_words(np.isin(last, list(b".,;:"))),
        share(_byte_flags(bytes(range(128, 256)))) / size, triples / per_triple, np.log1p(longest), share(_byte_flags(b"[]{}()")) / size,
    )
    return np.where(n[:, None] > 0, np.stack(columns, axis=1), 0.0)


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_hash long, features array<double>) of every whole text; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            for a, b in row_chunks(offsets):
                found = features(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                bounds = np.arange(b - a + 1) * len(FEATURES)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found.ravel()))], names=["id", "text_hash", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    return rows.mapInArrow(giving_back(run), f"id {kind}, text_hash long, features array<double>").withColumnRenamed("id", id_col)


@dataclass
class Model:
    """Score = sigmoid(base + one table entry per feature + one per chosen pair of features)."""

    base: float
    edges: list[np.ndarray]
    tables: np.ndarray
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, edges in enumerate(self.edges):
            total += self.tables[k][np.searchsorted(edges, x[:, k], side="right")]
        low = [np.searchsorted(edges, x[:, k], side="right") for k, edges in enumerate(self.coarse)]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[low[a] * PAIR_BINS + low[b]]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray) -> int:
    """Where to cut a row of bins in two by the gain of the logistic loss; 0: not at all."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1)
    gain[(left_h < LEAF) | (right_h < LEAF)] = -1
    best = int(gain.argmax()) if len(gain) else 0
    return best + 1 if len(gain) and gain[best] > g.sum() ** 2 / (h.sum() + 1) + 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton steps of a shallow tree over ordered bins."""
    cut = _split(g, h) if depth else 0
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.r_[_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)]


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree over a grid: cut one side, then each half on the other side. The first cut is the one after which the two
    second cuts gain most, so that a pure interaction, which no single cut shows, is found; the better order of sides."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        one, two = (g.T, h.T) if turned else (g, h)
        top_g, top_h = np.cumsum(one, axis=0)[:-1], np.cumsum(two, axis=0)[:-1]
        halves = ((top_g, top_h), (one.sum(axis=0) - top_g, two.sum(axis=0) - top_h))
        gains = sum(_cut_gains(a, b).max(axis=1) for a, b in halves)
        cut = int(gains.argmax()) + 1
        if gains[cut - 1] > best:
            best = float(gains[cut - 1])
            step = np.empty_like(one)
            step[:cut] = _tree(halves[0][0][cut - 1], halves[0][1][cut - 1], 1)
            step[cut:] = _tree(halves[1][0][cut - 1], halves[1][1][cut - 1], 1)
            out = step.T if turned else step
    return out


def _cut_gains(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Gain of every cut of every row of bins."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    right_g, right_h = g.sum(axis=1, keepdims=True) - left_g, h.sum(axis=1, keepdims=True) - left_h
    return np.where((left_h < LEAF) | (right_h < LEAF), 0.0, left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting: round by round each feature in turn gets a shallow tree on the gradients of its bins; then the
    pairs whose grids explain most of what is left get trees in turn. Without rows of both labels: the prior alone."""
    if not len(y):
        x, y = np.zeros((1, len(FEATURES))), np.array([0.5])
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    low = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]
    tables = np.zeros((x.shape[1], BINS))
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, own in enumerate(bins):
            g, h = slopes()
            step = STEP * _tree(np.bincount(own, g, BINS), np.bincount(own, h, BINS))
            tables[k] += step
            total += step[own]
    for k, own in enumerate(bins):  # centre the tables; the base takes their means
        shift = float(np.bincount(own, minlength=BINS) @ tables[k]) / len(y)
        tables[k] -= shift
        base += shift
    g, h = slopes()
    cells = {(a, b): low[a] * PAIR_BINS + low[b] for a in range(len(low)) for b in range(a)}

    def gain(own: np.ndarray) -> float:
        gg, hh = (np.bincount(own, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))
        return float((_pair_tree(gg, hh) * gg).sum())

    pairs = sorted(cells, key=lambda p: (-gain(cells[p]), p))[:PAIRS]
    pair_tables = np.zeros((len(pairs), PAIR_BINS**2))
    for _ in range(PAIR_ROUNDS):
        for k, pair in enumerate(pairs):
            g, h = slopes()
            own = cells[pair]
            gg, hh = (np.bincount(own, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))
            step = STEP * _pair_tree(gg, hh).ravel()
            pair_tables[k] += step
            total += step[own]
    return Model(base, edges, tables, coarse, pairs, pair_tables)


def held_out(id_col: str):
    """Whether crc32 of the id as text is divisible by FOLDS; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % FOLDS == 0


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(id_col, held_out boolean, score double, predicted int), one row per row of ``docs``.

    Features are counts and shares of the text's bytes, words and lines, nothing else. The model is fitted on labelled
    rows that aren't held out, on all of them up to ``sample_rows``, else on about that many chosen by a hash of the
    id; the fit itself is small and runs in the driver, scoring adds table entries by bins in the tasks. Rows with a
    null label or id don't train; an id trains once, with the mean of its labels and, of several texts, the one of the least
    hash, so that what the driver holds is bounded however often an id repeats; without labels every score is 0.5. Null and empty
    texts are scored like any other (all features 0). An empty table gives an empty result.
    """
    return _scored(docs, labels, id_col, text_col, label_col, threshold, sample_rows).drop("text_hash")


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, threshold: float, sample_rows: int) -> DataFrame:
    """The columns of ``score_quality`` and text_hash, the xxhash64 of the row's text."""
    table = Written(feature_table(docs, id_col, text_col), "features").df
    marked = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("double").alias("y")).where(F.col("of").isNotNull() & F.col("y").isNotNull() & ~held_out("of"))
    marked = marked.groupBy("of").agg(F.avg("y").alias("y"))
    rows = marked.count()
    if rows > sample_rows:
        marked = marked.where(F.pmod(F.xxhash64("of"), F.lit(1 << 20)) < int(sample_rows / rows * (1 << 20)))
    joined = marked.join(table, F.col("of") == F.col(id_col))
    one = joined.groupBy("of").agg(F.min("y").alias("y"), F.min_by("features", "text_hash").alias("features"))
    got = one.collect()  # one row an id: sample_rows at most, about
    got = sorted((r["of"], r["y"], r["features"]) for r in got)
    model = fit(np.array([g[2] for g in got]), np.array([g[1] for g in got])) if got else fit(np.zeros((0, len(FEATURES))), np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], names=["id", "text_hash", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = table.select(F.col(id_col).alias("id"), "text_hash", "features").mapInArrow(giving_back(run), f"id {kind}, text_hash long, score double")
    return scored.select(F.col("id").alias(id_col), "text_hash", held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The rows of ``docs`` (all columns) that the classifier does not reject. Rows are matched by id and the hash of
    their text, so that each row of a repeated id, and each without an id, is judged by its own text."""
    scored = _scored(docs, labels, id_col, text_col, label_col, threshold, sample_rows)
    good = scored.where("predicted = 1").select(F.col(id_col).alias("good_id"), F.col("text_hash").alias("good_hash")).distinct()
    return docs.join(good, docs[id_col].eqNullSafe(good["good_id"]) & (F.xxhash64(docs[text_col]) == good["good_hash"]), "left_semi")
