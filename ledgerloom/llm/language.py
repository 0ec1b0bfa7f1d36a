"""Language identification: presence kernels over n-grams, Nystroem landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.quality import held_out
from ledgerloom.llm.ragged import row_chunks, utf8

#: n-grams of 1 to GRAMS letters and blanks, and hash cells that mark their presence (a power of two).
GRAMS, CELLS = 4, 1 << 16
#: About so many labelled rows are fitted on in all (shared evenly by the languages), with so many landmarks among them.
SAMPLE_ROWS, LANDMARKS = 2_000, 128
#: More languages than this are taken for an error in the label column.
MOST_LANGUAGES = 500
#: Texts scored by one matrix product, and weight of the ridge for each training row.
TOGETHER, RIDGE = 64, 1e-3
UNKNOWN = "und"
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """What each code point counts as: its lower-case letter or mark, 0 (a blank) for all else."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        sign = chr(c)
        if unicodedata.category(sign)[0] in "LM":
            low = sign.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def spelled(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of all texts one after another, text of each letter or of the one before a blank, text of each letter or
    of the one after a blank): runs of other signs are one blank, which also parts the texts and stands at both ends."""
    texts = [flat[a:b].tobytes().decode("utf-8") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    chars = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), dtype=np.uint32)
    code = letters()[chars]
    keep = code != 0
    keep[1:] |= keep[:-1]  # the first sign behind a word stands for the blank
    keep[0] = True
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    sizes[:1] += 1
    codes, row = code[keep], np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[keep]
    after = row.copy()
    after[:-1] = np.where(codes[:-1] == 0, row[1:], row[:-1])
    return codes, row, after


def presence(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, CELLS) of 0 and 1: which cells hold an n-gram of the row's text. An n-gram never spans two texts."""
    rows = len(offsets) - 1
    out = np.zeros(max(rows, 1) * CELLS, dtype=np.uint8)
    if rows:
        codes, row, after = spelled(flat, offsets)
        base = after.astype(np.int64) * CELLS
        shift = np.uint64(64 - CELLS.bit_length() + 1)
        wide = codes.astype(np.uint64)
        key = wide * _ODD
        for n in range(1, GRAMS + 1):
            if n > 1:
                key = (key[:-1] ^ (key[:-1] >> np.uint64(31))) * _ODD + wide[n - 1 :] * _MIX
            cell = ((key ^ (key >> np.uint64(29))) * _ODD) >> shift
            good = after[: len(cell)] == row[n - 1 :] if n > 1 else codes != 0
            out[(base[: len(cell)] + cell.astype(np.int64))[good]] = 1
    return out.reshape(-1, CELLS)[:rows]


def no_letters(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text lacks any letter."""
    ascii_letter = ((flat | 32) - np.uint8(97)) < 26
    count = np.cumsum(np.r_[0, ascii_letter])[offsets]
    out = np.diff(count) == 0
    for k in np.flatnonzero(out).tolist():
        out[k] = not any(map(str.isalpha, flat[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8")))
    return out


@dataclass(frozen=True)
class Model:
    """Landmarks as packed presence rows, and the weights of each landmark's kernel value for each language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


@dataclass(frozen=True)
class Marks:
    """Landmarks ready for products: the cells that any of them holds, (cells, landmarks) of 0 and 1, and their sizes."""

    cells: np.ndarray
    held: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(packed: np.ndarray) -> Marks:
        bits = np.unpackbits(packed, axis=1)
        cells = np.flatnonzero(bits.any(axis=0))
        return Marks(cells, np.ascontiguousarray(bits[:, cells].T.astype(np.float32)), np.maximum(bits.sum(axis=1, dtype=np.float64), 1))


def kernel(present: np.ndarray, marks: Marks) -> np.ndarray:
    """Normalised presence kernel: shared cells over the root of the product of both numbers of cells."""
    shared = present.take(marks.cells, axis=1).astype(np.float32) @ marks.held  # whole numbers: exact in any order
    size = np.maximum(np.count_nonzero(present, axis=1), 1)
    return shared.astype(np.float64) / np.sqrt(size[:, None] * marks.sizes)


def fit(languages: list[str], packed: np.ndarray, landmarks: int = LANDMARKS) -> Model:
    """Ridge regression on Nystroem features, a target of 1 for a language's own rows and -1 for others, rows weighted
    so that every language counts alike. Rows are taken in the given order: the first ones of each language are landmarks."""
    names = sorted(set(languages))
    own = np.searchsorted(names, languages)
    if not names:
        return Model([], np.zeros((0, CELLS // 8), np.uint8), np.zeros((0, 0)), np.zeros(0))
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(own == c)[:each] for c in range(len(names))])
    marks = Marks.of(packed[chosen])
    value, vector = np.linalg.eigh(kernel(np.unpackbits(packed[chosen], axis=1), marks))
    fine = value > 1e-8 * value.max(initial=0)
    root = vector[:, fine] / np.sqrt(value[fine])  # K_mm ^ -1/2
    whole = np.concatenate([kernel(np.unpackbits(packed[k : k + TOGETHER], axis=1), marks) for k in range(0, len(own), TOGETHER)])
    x = np.c_[whole @ root, np.ones(len(own))]
    y = np.where(own[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = len(own) / (len(names) * np.bincount(own)[own])
    ridge = np.eye(x.shape[1]) * RIDGE * len(own)
    ridge[-1, -1] = 1e-9 * len(own)  # the bias is free
    solved = np.linalg.solve(x.T @ (weight[:, None] * x) + ridge, x.T @ (weight[:, None] * y))
    return Model(names, packed[chosen], root @ solved[:-1], solved[-1])


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int) -> tuple[list[str], np.ndarray]:
    """(language, packed presence) of the training rows, in an order that doesn't depend on the partitions."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("key"), held_out(id_col).alias("out"))
    rows = rows.where("lang is not null and text is not null and not out")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return [], np.zeros((0, CELLS // 8), np.uint8)
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} holds more than {MOST_LANGUAGES} languages")
    share = max(1, sample_rows // len(counts))
    grain = 1 << 30
    below = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(grain if n <= share else max(1, round(share / n * grain))))])
    # copies of a row are one: what is collected is bounded by sample_rows, about, however often a row repeats
    chosen = rows.where(F.pmod("key", F.lit(grain)) < below[F.col("lang")]).dropDuplicates(["lang", "key"]).select("lang", "key", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(2))
            for a, b in row_chunks(offsets):
                for k in range(a, b, TOGETHER):
                    end = min(b, k + TOGETHER)
                    bits = np.packbits(presence(flat[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k]), axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, end - k), batch.column(1).slice(k, end - k), pa.array([x.tobytes() for x in bits], pa.binary())], names=["lang", "key", "bits"])

    got = sorted((r["lang"], r["key"], bytes(r["bits"])) for r in chosen.mapInArrow(pack, "lang string, key long, bits binary").collect())
    return [g[0] for g in got], np.frombuffer(b"".join(g[2] for g in got), dtype=np.uint8).reshape(len(got), CELLS // 8)


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    landmarks: int = LANDMARKS,
) -> DataFrame:
    """(id_col, held_out boolean, lang_pred string, score double), one row per row of ``docs``.

    Texts are compared by the n-grams of 1 to 4 letters that they hold at all (a blended-spectrum presence kernel over
    hash cells, whole texts). The model learns from rows that are not held out and whose language is known: all of a
    language up to ``sample_rows`` shared evenly among the languages, else about that many chosen by a hash of id and
    text. The fit is small and runs in the driver; texts are scored in the tasks, by matrix products of 64 at once.
    score is (value + 1) / 2 of the best language's regression, cut to [0, 1]; ties go to the first language in order.
    Texts that are null or hold no letter are ``und`` with score 0; so is every text if no row can be learnt from. A
    null id counts as the text 'null' for ``held_out``. An empty table gives an empty result; other columns (and those
    that clash with result names) are not read.
    """
    languages, packed = sample(docs, id_col, text_col, lang_col, sample_rows)
    model = fit(languages, packed, landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks.of(model.landmarks)
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            best = np.full(batch.num_rows, len(names) - 1)
            score = np.zeros(batch.num_rows)
            for a, b in row_chunks(offsets) if len(model.languages) else ():
                for k in range(a, b, TOGETHER):
                    end = min(b, k + TOGETHER)
                    part, bounds = flat[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k]
                    values = np.round(kernel(presence(part, bounds), marks) @ model.weights + model.bias, 6)
                    known = ~no_letters(part, bounds)
                    best[k:end][known] = values.argmax(axis=1)[known]
                    score[k:end][known] = np.clip((values.max(axis=1) + 1) / 2, 0, 1)[known]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
