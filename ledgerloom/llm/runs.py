"""Periodic runs of words: maximal pairs from the LCP-interval tree of each text."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.ragged import equal_spans, hash_spans, ranges, row_chunks, run_starts, utf8, word_spans

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def word_ids(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of words; two words have one number only if their bytes are equal."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    keys, first, own = np.unique(hash_spans(flat, starts, ends), return_index=True, return_inverse=True)
    lead = first[own]
    apart = np.flatnonzero(~equal_spans(flat, starts, ends, flat, starts[lead], ends[lead]))
    others: dict[bytes, int] = {}
    for i in apart.tolist():  # words that share a hash with another one
        own[i] = others.setdefault(flat[starts[i] : ends[i]].tobytes(), len(keys) + len(others))
    return own


def suffix_order(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(suffixes of the rows in order, [(h, rank by the first h words)]) by prefix doubling.

    Suffixes are compared within their row; the rank is the place of the first suffix with the same h words, so only
    suffixes that still share a rank are sorted again. The number after the last rank stands for "past the end".
    """
    n = len(ids)
    key = row.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key, kind="stable")
    first = run_starts(key[order])
    rank = np.full(n + 1, -1, dtype=np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    levels, h = [(1, rank.astype(np.int32))], 1
    place = np.arange(n)
    while True:
        own = rank[order[place]]
        same = np.r_[own[1:] == own[:-1], False]
        place = place[same | np.r_[False, same[:-1]]] if len(place) else place
        if not len(place):
            return order, levels
        at = order[place]
        next_ = np.minimum(at + h, n)
        second = np.where((at + h < n) & (row[np.minimum(at + h, n - 1)] == row[at]), rank[next_] + 1, 0)
        old = rank[at]
        by = np.lexsort((second, old))
        at, old, second = at[by], old[by], second[by]
        order[place] = at
        head = np.r_[True, (old[1:] != old[:-1]) | (second[1:] != second[:-1])]
        rank[at] = place[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        h *= 2
        levels.append((h, rank.astype(np.int32)))


def common_words(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Length of the longest common prefix of the suffixes a and b of one row, pair by pair."""
    a, b, n = a.copy(), b.copy(), len(levels[0][1]) - 1
    out = np.zeros(len(a), dtype=np.int64)
    for h, rank in reversed(levels):
        step = np.where((a < n) & (b < n) & (rank[np.minimum(a, n)] == rank[np.minimum(b, n)]), h, 0)
        a += step
        b += step
        out += step
    return out


def _merge(one: list[int], two: list[int], lcp: int, left: list[int], found: list[tuple[int, int, int]]) -> list[int]:
    """Unite the positions of two children of an interval (both in text order). A position of one child and its
    neighbour among those of the other are a maximal pair if their left words are of different classes."""
    small, large = (one, two) if len(one) < len(two) else (two, one)
    most = lcp // (LEAST_PERIODS - 1)
    for p in small:
        k = bisect_left(large, p)
        if k and p - large[k - 1] <= most and left[large[k - 1]] != left[p]:
            found.append((large[k - 1], p, lcp))
        if k < len(large) and large[k] - p <= most and left[large[k]] != left[p]:
            found.append((p, large[k], lcp))
    if len(small) * 16 < len(large):
        for p in small:
            insort(large, p)
    else:
        large += small
        large.sort()
    return large


def maximal_pairs(at: np.ndarray, lcp: np.ndarray, left: np.ndarray) -> list[tuple[int, int, int]]:
    """(a, b, lcp) of the maximal pairs a < b whose distance is at most lcp / 3, from suffixes in order and the common
    prefix of each with the one before it: intervals of equal prefixes are united bottom-up.

    Neighbours in an interval are enough: if q is the smallest period of a run, no third position lies between a and
    a + q there, for it would give the run a smaller period.
    """
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []
    places, depths, classes = at.tolist(), lcp.tolist(), left.tolist()
    for k, depth in enumerate([*depths[1:], 0]):
        last = [places[k]]
        while stack and stack[-1][0] > depth:
            deeper, own = stack.pop()
            last = _merge(own, last, deeper, classes, found)
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, _merge(stack[-1][1], last, depth, classes, found))
        elif depth:
            stack.append((depth, last))
    return found


def runs_of(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(k, 3) array of first word, words and period of all runs, by first word, then period. Words are numbered through all rows."""
    none = np.zeros((0, 3), dtype=np.int64)
    if len(ids) < LEAST_WORDS:
        return none
    order, levels = suffix_order(ids, row)
    # a pair needs five words in common (5 + 1 for period 1, 6 + 2 for period 2, and so on)
    least = LEAST_WORDS - 1
    four = next((rank for h, rank in levels if h == 4), None)
    if four is None:
        return none
    same = four[order[1:]] == four[order[:-1]]
    lcp = np.zeros(len(order), dtype=np.int64)
    again = np.flatnonzero(same) + 1
    lcp[again] = common_words(order[again - 1], order[again], levels)
    lcp[lcp < least] = 0
    # leave out positions too far from any other of their five words
    inside = np.flatnonzero((lcp > 0) | np.r_[lcp[1:] > 0, False])
    if not len(inside):
        return none
    group = np.cumsum(lcp == 0)
    by = inside[np.lexsort((order[inside], group[inside]))]
    gap = np.where(group[by[1:]] == group[by[:-1]], order[by[1:]] - order[by[:-1]], len(ids))
    nearest = np.empty(len(order), dtype=np.int64)
    nearest[by] = np.minimum(np.r_[gap, len(ids)], np.r_[len(ids), gap])
    longest = np.maximum(lcp, np.r_[lcp[1:], 0])
    kept = inside[nearest[inside] * (LEAST_PERIODS - 1) <= longest[inside]]
    if len(kept) < 2:
        return none
    between = np.minimum.reduceat(lcp[: kept[-1] + 1], np.r_[0, kept[:-1] + 1])  # least common prefix on the way from the one kept before
    between[0] = 0
    left = np.where(np.r_[True, row[1:] != row[:-1]], -1, np.r_[-1, ids[:-1]])
    pairs = np.array(maximal_pairs(order[kept], between, left), dtype=np.int64).reshape(-1, 3)
    runs = np.stack([pairs[:, 0], pairs[:, 2] + pairs[:, 1] - pairs[:, 0], pairs[:, 1] - pairs[:, 0]], axis=1)
    runs = runs[(runs[:, 1] >= LEAST_WORDS) & (runs[:, 1] >= LEAST_PERIODS * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # multiples of a smallest period have the same stretch
    runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]] if len(runs) else runs
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, runs array of (start, length, period), n_words long, collapsed string), one row per row of ``docs``.

    A run is a stretch of words with smallest period q that is at least 6 words and 4 periods long and that neither
    neighbour extends. Words are what ASCII white space separates, numbered from 0. ``collapsed`` is the text without
    the words that some run repeats (those after its first q words), joined by one space.
    Null and empty texts and texts without words have no run and an empty ``collapsed``; ids are carried along as they
    are; an empty table gives an empty result; other columns are not read. One narrow map over whole texts, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            for a, b in row_chunks(offsets):
                part, bounds = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                runs, sizes, words, texts = _collapse(part, bounds)
                parts = [pa.array(runs[:, k]) for k in range(3)]
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), listed, pa.array(words), texts], names=["id", "runs", "n_words", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, runs array<{RUN}>, n_words long, collapsed string")
    return found.select(F.col("id").alias(id_col), "runs", "n_words", "collapsed")


def _collapse(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(runs with starts in their text, runs per text, words per text, collapsed texts)."""
    rows = len(offsets) - 1
    starts, ends, row = word_spans(flat, offsets)
    words = np.bincount(row, minlength=rows)
    runs = runs_of(word_ids(flat, starts, ends), row)
    owner = row[runs[:, 0]] if len(runs) else np.zeros(0, dtype=np.int64)
    gone = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
    more = np.r_[False, row[kept][1:] == row[kept][:-1]] if len(kept) else np.zeros(0, dtype=bool)  # a blank before each but the first
    size = ends[kept] - starts[kept] + more
    if len(kept):
        data = flat[ranges(starts[kept] - more, size)]
        data[(np.cumsum(size) - size)[more]] = 32
    else:
        data = np.zeros(0, dtype=np.uint8)
    bounds = np.r_[0, np.cumsum(np.bincount(row[kept], weights=size, minlength=rows).astype(np.int64))]
    texts = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    runs = runs - np.stack([(np.cumsum(words) - words)[owner], np.zeros_like(owner), np.zeros_like(owner)], axis=1)
    return runs, np.bincount(owner, minlength=rows), words, texts


def repeat_tail(text: Column, key: Column) -> Column:
    """``text`` whose words from the a-th on repeat with a period p, for keys divisible by 10: with g = key div 10 and n
    words, a = g % n and p = 1 + (n - a) div (3 + g % 8). Other texts, and texts without words, stay as they are."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(key / 10), F.size(words)

    def spread(all_words: Column) -> Column:
        a = F.pmod(g, F.size(all_words))
        p = 1 + F.floor((F.size(all_words) - a) / (3 + F.pmod(g, F.lit(8))))
        at = F.transform(F.sequence(F.lit(0), F.size(all_words) - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
        return F.array_join(F.transform(at, lambda i: F.get(all_words, i)), " ")

    bent = F.get(F.transform(F.array(words), spread), 0)
    return F.when((F.pmod(key, F.lit(10)) == 0) & (n > 0), bent).otherwise(text)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of ``find_runs``: the number of runs, the one of most periods (exactly compared; the earliest, then
    the shortest period, among equals), and hashes of all runs and of the collapsed text."""
    better = "r.length * best.period > best.length * r.period"
    best = F.expr(f"aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), get(runs, 0), (best, r) -> if({better}, r, best))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select(
        id_col, "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
