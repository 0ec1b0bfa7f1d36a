"""Spelling variants: words at edit distance one, joined by pivotal grams, and the forms that rare words vary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.ragged import equal_spans, hash_spans, lower_ascii, mix64, ranges, row_chunks, run_starts, utf8
from ledgerloom.llm.sketch import summed_cells
from ledgerloom.llm.store import Written

#: Bytes of text whose words are counted together in a task.
COUNT_BYTES = 1 << 23
#: One in so many pairs of document and word loses a code point in ``damaged_words``.
DAMAGE = 31
#: Cells that count pairs of letters: the letters are the 58 bytes A to z and the 64 code points C0 to FF, or fewer.
SIGNS = 128
_ODD, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def letter_runs(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of A-Z, a-z and U+00C0 to U+00FF; those are the two-byte signs after byte C3."""
    if not len(flat):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    wide = flat == 0xC3
    inside = (((flat | 32) - np.uint8(97)) < 26) | wide
    inside[1:] |= wide[:-1]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    begin[offsets[:-1][filled]] = inside[offsets[:-1][filled]]
    stop[offsets[1:][filled] - 1] = inside[offsets[1:][filled] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def crc32_spans(state: np.ndarray, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each span [start, end), carried on from the crc32 ``state`` of what stands before it."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    crc, size = ~state.astype(np.uint32), ends - starts
    by = np.argsort(-size, kind="stable")  # the spans that are still open stand in front
    crc, start, size = crc[by], starts[by], size[by]
    open_ = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    for k, n in enumerate(open_.tolist()):
        crc[:n] = table[(crc[:n] ^ flat[start[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty_like(crc)
    out[by] = ~crc
    return out


def damaged(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, crc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): the words, of which those whose crc32 DAMAGE divides lose the code point crc % length."""
    hit = np.flatnonzero(crc % DAMAGE == 0)
    if not len(hit):
        return flat, starts, ends
    begins = np.flatnonzero((flat & 0xC0) != 0x80)  # of code points
    first = np.searchsorted(begins, starts[hit])
    points = np.searchsorted(begins, ends[hit]) - first
    at = begins[first + crc[hit].astype(np.int64) % points]
    wide = np.where(flat[at] >= 0xC0, 2, 1)
    size = (ends[hit] - starts[hit]) - wide
    cut = np.stack([starts[hit], at + wide], axis=1).ravel()  # what stands before and behind the code point
    kept = np.stack([at - starts[hit], ends[hit] - at - wide], axis=1).ravel()
    more = flat[ranges(cut, kept)]
    new_ends = np.cumsum(size) + len(flat)
    starts, ends = starts.copy(), ends.copy()
    starts[hit], ends[hit] = new_ends - size, new_ends
    return np.r_[flat, more], starts, ends


def _counted(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """(word, n) of the spans; a word may have several rows."""
    keys, first, own, n = np.unique(hash_spans(flat, starts, ends), return_index=True, return_inverse=True, return_counts=True)
    lead = first[own]
    apart = np.flatnonzero(~equal_spans(flat, starts, ends, flat, starts[lead], ends[lead]))  # words that share a hash
    n = n - np.bincount(own[apart], minlength=len(keys))
    at = np.r_[first, apart]
    size = ends[at] - starts[at]
    bounds = np.r_[0, np.cumsum(size)]
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat[ranges(starts[at], size)])).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(np.r_[n, np.ones(len(apart), dtype=np.int64)])], names=["word", "n"])


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = False, least_letters: int = 7) -> DataFrame:
    """(word, n): how often each run of letters (A-Z and U+00C0 to U+00FF; A-Z lower-cased) of at least ``least_letters``
    code points occurs in the texts. ``damage``: a run of which the crc32 of ``<id>:<run>`` is divisible by 31 first
    loses one code point (a null id reads 'null'). Null texts hold no word. Counted in the tasks before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            flat = lower_ascii(flat)
            for a, b in row_chunks(offsets, COUNT_BYTES):
                part, bounds = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, row = letter_runs(part, bounds)
                if damage:
                    heads, at = utf8(batch.column(0).slice(a, b - a))
                    crc = crc32_spans(np.zeros(b - a, dtype=np.uint32), heads, at[:-1], at[1:])
                    part, starts, ends = damaged(part, starts, ends, crc32_spans(crc[row], part, starts, ends))
                points = np.cumsum(np.r_[0, (part & 0xC0) != 0x80])
                long = points[ends] - points[starts] >= least_letters
                if long.any():
                    yield _counted(part, starts[long], ends[long])

    heads = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":")).alias("head")
    return docs.select(heads, F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """Words of a batch as letters: numbers 0 to SIGNS - 1, one after another."""

    def __init__(self, column: pa.Array):
        flat, offsets = utf8(column)
        wide = flat >= 0xC0
        code = np.where(wide, np.r_[flat[1:], 0], flat).astype(np.int64)
        # a to z are 97 to 122; U+00C0 to U+00FF, second bytes 80 to BF, take the numbers 0 to 63
        code = np.where(wide, code - 0x80, code)
        keep = (flat & 0xC0) != 0x80
        self.letters = code[keep]
        self.starts = np.cumsum(np.r_[0, keep])[offsets]
        self.sizes = np.diff(self.starts)
        self.starts = self.starts[:-1]

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram number, word, place in the word) of every pair of neighbours."""
        n = np.maximum(self.sizes - 1, 0)
        at = ranges(self.starts, n)
        word = np.repeat(np.arange(len(n)), n)
        return self.letters[at] * SIGNS + self.letters[np.minimum(at + 1, len(self.letters) - 1)], word, at - self.starts[word]


class _Hashes:
    """Hashes of parts of words in constant time each: differences of power sums modulo 2^64. Two parts with one hash only
    cost a comparison."""

    def __init__(self, words: Words):
        n = len(words.letters)
        self.back = np.cumprod(np.full(n + 1, _inverse(_BASE), dtype=np.uint64)) * _BASE
        power = np.cumprod(np.full(n + 1, _BASE, dtype=np.uint64))[:n]
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix64(words.letters.astype(np.uint64) + _ODD) * power, dtype=np.uint64)]

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64) * _ODD)


#: Kinds of keys: the text up to the end of a gram, or from its begin on, with the nearer or the farther half of the rest.
FRONT_NEAR, FRONT_FAR, BACK_NEAR, BACK_FAR = range(4)


def _key(kind: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix64(mix64(one + np.uint64(kind + 1)) * _ODD + two).view(np.int64)


def gram_keys(words: Words, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Prefixes and pivots of the words: (last rank of the prefix, prefix rows: word, key, kind; pivot rows: word, key,
    kind, place, limit).

    Grams are taken by rarity (``rank``). The prefix of a word is its three rarest ones and all that are as rare as the
    third; its pivots are two of the three rarest that share no letter, of least total frequency. One edit leaves one
    pivot whole, so that a near word holds it, if the edit is behind it at the same place from the front and with all
    letters before it, if the edit is before it at the same place from the back with all letters behind it; and of the
    letters on the other side either the nearer or the farther half is left whole. Each key is that whole text and tells
    the gram's place.
    """
    gram, word, place = words.grams()
    rare = rank[gram]
    by = np.lexsort((place, rare, word))
    first = np.searchsorted(word, np.arange(len(words.sizes)))
    third = rare[by][first + 2]
    inside = np.flatnonzero(rare <= third[word])
    hashes = _Hashes(words)

    def rest(w: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return words.starts[w], words.starts[w] + p, words.starts[w] + words.sizes[w]

    w, p = word[inside], place[inside]
    a, g, z = rest(w, p)
    m = words.sizes[w] - p - 2
    front, back = m // 2, p // 2
    own = [
        (FRONT_NEAR, _key(FRONT_NEAR, hashes.part(a, g + 2 + front), front.astype(np.uint64))),
        (FRONT_FAR, _key(FRONT_FAR, hashes.part(a, g + 2), hashes.part(z - (m - front), z))),
        (BACK_NEAR, _key(BACK_NEAR, hashes.part(g - back, z), back.astype(np.uint64))),
        (BACK_FAR, _key(BACK_FAR, hashes.part(g, z), hashes.part(a, a + p - back))),
    ]
    index = (np.tile(w, 4), np.concatenate([k for _, k in own]), np.repeat(np.arange(4), len(w)))
    # pivots: of the three rarest by place, the two disjoint ones of least cost; best[i] is the cheapest gram that ends
    # before gram i begins
    three = np.sort(np.stack([place[by][first + k] for k in range(3)], axis=1), axis=1)
    cost = rare[first[:, None] + three]  # rarer grams have shorter lists
    low = np.full((len(three), 3), np.iinfo(np.int64).max // 4)
    choice = np.zeros((len(three), 3), dtype=np.int64)
    for i in (1, 2):
        for j in range(i):
            better = (three[:, i] - three[:, j] >= 2) & (cost[:, j] < low[:, i])
            low[better, i], choice[better, i] = cost[better, j], j
    end = np.where(low[:, 1] + cost[:, 1] <= low[:, 2] + cost[:, 2], 1, 2)
    all_ = np.arange(len(three))
    p2, p1 = three[all_, end], three[all_, choice[all_, end]]
    probes = []
    for p, limit in ((p2, np.full(len(p2), np.iinfo(np.int32).max, dtype=np.int64)), (p1, p2 + 2)):  # edits behind p2, else behind p1
        a, g, z = rest(all_, p)
        m = words.sizes - p - 2
        for q in ((m - 1) // 2, (m + 1) // 2):  # what half the rest of a word one letter shorter or longer is, and of an equal one
            on = np.flatnonzero((q >= 0) & (q <= m))
            probes.append((on, _key(FRONT_NEAR, hashes.part(a[on], g[on] + 2 + q[on]), q[on].astype(np.uint64)), FRONT_NEAR, p[on], limit[on]))
        for q in (m // 2, (m + 2) // 2):
            on = np.flatnonzero((q >= 0) & (q <= m))
            probes.append((on, _key(FRONT_FAR, hashes.part(a[on], g[on] + 2), hashes.part(z[on] - q[on], z[on])), FRONT_FAR, p[on], limit[on]))
    a, g, z = rest(all_, p2)
    for q in ((p2 - 1) // 2, (p2 + 1) // 2):  # edits before the end of p1
        on = np.flatnonzero((q >= 0) & (q <= p2))
        probes.append((on, _key(BACK_NEAR, hashes.part(g[on] - q[on], z[on]), q[on].astype(np.uint64)), BACK_NEAR, p2[on], p1[on] + 2))
    for q in (p2 // 2, (p2 + 2) // 2):
        on = np.flatnonzero(q <= p2)
        probes.append((on, _key(BACK_FAR, hashes.part(g[on], z[on]), hashes.part(a[on], a[on] + q[on])), BACK_FAR, p2[on], p1[on] + 2))
    kinds = np.concatenate([np.full(len(x[0]), x[2]) for x in probes])
    pivots = (*(np.concatenate([x[k] for x in probes]) for k in (0, 1)), kinds, *(np.concatenate([x[k] for x in probes]) for k in (3, 4)))
    return third, index, pivots


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words that differ by one inserted, deleted or replaced code point, once.

    words: (word, n), distinct words of at least 7 letters (see ``count_words``). Grams are ordered by how many words
    hold them, a table of fixed size. Each word looks for words whose prefix ends at a gram at least as frequent, by the
    keys of ``gram_keys``; the limit of a key says how many first letters the words must not share, so that each pair
    comes up under one key. Candidates meet in an equi-join, which Spark splits where a key is hot, and are verified
    by edit distance there. No list of a key is held in memory.
    """

    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        gram, word, _ = Words(batch.column(0)).grams()
        table += np.bincount(gram[run_starts(word * SIGNS**2 + gram)] if len(gram) else gram, minlength=SIGNS**2)

    held = summed_cells(words.select("word"), SIGNS**2, fill)
    rank = np.empty(SIGNS**2, dtype=np.int64)
    rank[np.argsort(held, kind="stable")] = np.arange(SIGNS**2)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = Words(batch.column(0))
            third, index, pivots = gram_keys(own, rank)
            for probe, (word, key, kind, *more) in ((False, index), (True, pivots)):
                place, limit = more or (np.zeros(len(word), dtype=np.int64), np.zeros(len(word), dtype=np.int64))
                at = pa.array(word)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(own.sizes[word].astype(np.int32)), pa.array(third[word].astype(np.int32))]
                columns += [pa.array(key), pa.array(kind.astype(np.int8)), pa.array(place.astype(np.int32)), pa.array(limit.astype(np.int32)), pa.array(np.full(len(word), probe))]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "size", "last", "key", "kind", "place", "limit", "probe"])

    rows = Written(words.select("word", "n").mapInArrow(keyed, "word string, n long, size int, last int, key long, kind byte, place int, limit int, probe boolean"), "gram-keys")
    s = rows.df.where("probe").drop("probe").alias("s")
    r = rows.df.where("not probe").select("word", "n", "size", "last", "key", "kind").alias("r")
    half = f"""case s.kind when {FRONT_NEAR} then s.limit when {FRONT_FAR} then least(s.limit, s.place + 2 + (r.size - s.place - 2) div 2)
        when {BACK_FAR} then s.limit else least(s.limit, s.place + r.size - s.size - (s.place + r.size - s.size) div 2) end"""
    same = F.expr("s.key = r.key and s.kind = r.kind and (r.last > s.last or (r.last = s.last and r.word > s.word)) and abs(r.size - s.size) <= 1")
    near = F.expr(f"levenshtein(s.word, r.word, 1) = 1 and left(s.word, cast({half} as int)) <> left(r.word, cast({half} as int))")
    found = s.hint("merge").join(r, same & near).select(F.col("s.word").alias("a"), F.col("s.n").alias("a_n"), F.col("r.word").alias("b"), F.col("r.n").alias("b_n"))
    pairs = Written(found, "near-words")
    rows.drop()
    return pairs.df


def spelling_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of ``words`` (word, n).

    n_near counts the words at edit distance one. ``form`` is the most frequent of them (the first in code-point order
    among equals) if it is at least ``times`` as frequent as the word, else null; ``root`` is the last word reached from
    form to form, the word itself if it has none. An empty table gives an empty result.
    """
    pairs = near_words(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    counts = both.groupBy("a").agg(F.count("*").alias("n_near"))
    better = both.where(F.col("b_n") >= times * F.col("a_n")).groupBy("a").agg(F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("b"))).alias("best"))
    forms = Written(better.select(F.col("a").alias("of"), F.col("best.b").alias("form"), (-F.col("best.less")).alias("form_n")), "forms").df
    # each step doubles the part of the way that is known; frequencies grow tenfold along it, so few steps lead to its end
    reached = forms.select("of", F.col("form").alias("root"))
    while True:
        on = reached.select(F.col("of").alias("root"), F.col("root").alias("next"))
        step = Written(reached.join(on, "root", "left").select("of", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots").df
        reached = step.select("of", "root")
        if not step.where("moved").take(1):
            break
    known = words.join(counts, words["word"] == counts["a"], "left").drop("a").join(forms.join(reached, "of"), F.col("word") == F.col("of"), "left")
    return known.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = False, least_letters: int = 7, least_count: int = 2, times: int = 10) -> DataFrame:
    """The variants among the words of whole texts that occur at least ``least_count`` times; see ``count_words`` and
    ``spelling_variants``. Null and empty texts hold no words; repeated rows count as often as they occur; other
    columns are not read; ``least_letters`` is 4 at least, so that every word has three grams."""
    if least_letters < 4:
        raise ValueError("words need four letters to have three grams")
    words = Written(count_words(docs, id_col, text_col, damage, least_letters).where(F.col("n") >= least_count), "words").df
    return spelling_variants(words, times)
