"""Near-duplicate documents by order-sensitive min-hashes, verified by banded alignment."""

from __future__ import annotations

import secrets
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.ragged import hash_runs, hash_spans, lower_ascii, mix64, ranges, row_chunks, utf8, word_spans
from ledgerloom.llm.sketch import key_filter, passes
from ledgerloom.llm.store import Written
from ledgerloom.llm.worker import giving_back

#: Words of a shingle, minima kept by a sketch, and sketches of a document.
SHINGLE, MINIMA, SKETCHES = 5, 2, 64
#: Texts of fewer words than SHORT have sketches of shingles of PAIR words, for one edit in nine words may leave no longer one
#: whole. Up to a quarter more words (all that a text of fewer than SHORT may be linked with) every MIXED-th sketch is such a one.
SHORT, PAIR, MIXED = 48, 2, 4
#: Cells of a parity table of a text, and tables (of different bits of the words' hashes).
CELLS, TABLES = 1024, 2
_NO_ID = (1 << 63) - 1
_ODD = mix64(np.arange(1, 97, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all rows, bounds): ``size`` words each; a row of fewer words is one shingle."""
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = ranges(bounds[:-1], count)
    row = np.repeat(np.arange(len(n)), count)
    out = np.full(len(at), size, dtype=np.uint64)
    padded = np.r_[words.astype(np.uint64), np.zeros(size, dtype=np.uint64)]
    for k in range(size):
        own = padded[at + k] * _ODD[k]
        out += np.where(at + k < bounds[1:][row], own, np.uint64(k + 1))
    return mix64(out), np.r_[0, np.cumsum(count)]


def labelled(one: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of one text, each labelled with its occurrence number, so that repeats differ."""
    order = np.argsort(one, kind="stable")
    ordered = one[order]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    if len(heads) == len(one):
        return one
    nth = np.arange(len(one)) - np.repeat(heads, np.diff(np.r_[heads, len(one)]))
    out = one.copy()
    out[order] = np.where(nth > 0, mix64(ordered + nth.astype(np.uint64) * _ODD[90]), ordered)
    return out


def parities(words: np.ndarray) -> bytes:
    """Parity of the number of words in each cell of each table, as 64-bit words."""
    tables = [(words >> np.uint64(20 * k)) & np.uint64(CELLS - 1) for k in range(TABLES)]
    odd = [np.bincount(t.astype(np.int64), minlength=CELLS) & 1 for t in tables]
    return np.packbits(np.concatenate(odd).astype(np.uint8)).tobytes()


def sketches_of(words: int, long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """SKETCHES keys of a text of so many words, from its labelled shingles of SHINGLE and of PAIR words."""
    if words < SHORT:
        return order_sketches(short)
    out = order_sketches(long)
    if words * 4 <= SHORT * 5:
        out[::MIXED] = order_sketches(short)[::MIXED]
    return out


def order_sketches(marks: np.ndarray) -> np.ndarray:
    """SKETCHES keys of a text: each of its MINIMA least labelled shingles under one hash, in the order of the text."""
    if len(marks) <= MINIMA:
        places = np.tile(np.arange(len(marks)), (SKETCHES, 1))
    else:
        under, each = marks[None] * _ODD[:SKETCHES, None], np.arange(SKETCHES)
        least = []
        for _ in range(MINIMA):
            least.append(under.argmin(axis=1))
            under[each, least[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        places = np.sort(np.stack(least, axis=1), axis=1)
    out = np.arange(SKETCHES, dtype=np.uint64) + np.uint64(1)
    for k in range(places.shape[1]):
        out = mix64(out * _ODD[91] + marks[places[:, k]])
    return out.view(np.int64)


def aligned(a: list, b: list, threshold: float) -> bool:
    """Whether two sequences align: matched / (all - matched) >= threshold, matches being in order.

    Equal ends are cut off. The middle is aligned row by row in bit vectors as wide as the band that a pair over the
    threshold can't leave: as many places on either side of the diagonal as words may stay unmatched.
    """
    need = int(np.ceil(threshold / (1 + threshold) * (len(a) + len(b)) - 1e-9))
    short = min(len(a), len(b))
    if short < need:
        return False
    band = len(a) + len(b) - 2 * need
    head = 0
    while head < short and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < short - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    matched = head + tail
    if matched >= need or matched + sum((Counter(a) & Counter(b)).values()) < need:
        return matched >= need
    places: dict[object, list[int]] = {}
    for k, x in enumerate(a):
        places.setdefault(x, []).append(k)
    width = 2 * band + 1
    full, top = (1 << width) - 1, 1 << width - 1
    free = full  # bit j: place low + j of a adds no match
    for low, x in enumerate(b, -band):
        if low > -band:
            matched += not free & 1
            free = free >> 1 | top
        at = places.get(x)
        if at:
            hit = 0
            for p in at[bisect_left(at, low) : bisect_right(at, low + width - 1)] if len(at) > 4 else at:
                if low <= p < low + width:
                    hit |= 1 << p - low
            free = ((free + (free & hit)) | (free & ~hit)) & full
    return matched + width - free.bit_count() >= need


def _words(texts: pa.Array, seed: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk of rows: (first row, last row, hashes of the words, others under ``seed``, word bounds by row)."""
    flat, offsets = utf8(texts)
    flat = lower_ascii(flat)
    for a, b in row_chunks(offsets):
        part, bounds = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, row = word_spans(part, bounds)
        yield a, b, hash_spans(part, starts, ends), hash_spans(part, starts, ends, seed), np.searchsorted(row, np.arange(b - a + 1))


def _alike(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of keys whose texts align. Texts travel for the documents in pairs only, one for each key."""
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = Written(wanted.join(nodes, "key").select("key", "doc", "sub", F.expr("doc ^ sub").alias("spot")), "near-wanted")
    bits = key_filter(wanted.df, "spot", wanted.df.count())

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(passes(bits, batch.column(0).to_numpy() ^ batch.column(1).to_numpy()))
            yield batch.filter(hit)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = lambda text: text.translate(_LOWER).split()
        last, kept = None, []
        for batch in batches:
            good = []
            for b, one, two in zip(batch.column("b").to_pylist(), batch.column("one"), batch.column("two"), strict=True):
                if b != last:
                    last, kept = b, cut(two.as_buffer().to_pybytes())
                good.append(aligned(cut(one.as_buffer().to_pybytes()), kept, threshold))
            chosen = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column("a"), chosen.column("b")], names=["a", "b"])

    passed = rows.select("doc", "sub", F.col("text").cast("binary").alias("text")).mapInArrow(giving_back(texts), "doc long, sub long, text binary")
    found = Written(passed.join(wanted.df.select("key", "doc", "sub"), ["doc", "sub"]).select("key", "text").dropDuplicates(["key"]), "near-texts")
    joined = pairs.join(found.df.select(F.col("key").alias("a"), F.col("text").alias("one")), "a").join(found.df.select(F.col("key").alias("b"), F.col("text").alias("two")), "b")
    links = Written(joined.select("a", "b", "one", "two").mapInArrow(giving_back(verify), "a long, b long"), "near-links").df
    wanted.drop()
    found.drop()
    return links


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id_col, class_id, kept) for every row of ``docs``; see ``text_components``.

    A class is a connected component of links; class_id is its smallest id, ``kept`` marks the row of that id (of
    repeated rows with that id, all are marked). A null id is kept as it is and counts as the largest; a class of
    null ids alone has class_id null and all its rows are marked. Other columns are not read; an empty table gives an
    empty result.
    """
    classed = text_components(docs, id_col, text_col, threshold)
    out = classed.join(classed.groupBy("component").agg(F.min("doc").alias("class_id")), "component")
    real = F.when(F.col("class_id") < _NO_ID, F.col("class_id"))
    doc = F.when(F.col("doc") < _NO_ID, F.col("doc"))
    return out.select(doc.alias(id_col), real.alias("class_id"), (F.col("doc") == F.col("class_id")).alias("kept"))


def text_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc, sub, component) for every row: its id (null: the largest long), the hash of its text, its class.

    Words are split at ASCII white space, ASCII letters count as lower case. Two texts are linked if they share a sketch
    and their words align with in-order matches / (all - matches) >= ``threshold``: an edit similarity. A component is a
    connected component of links. Equal word sequences (two hashes of 64 bits over separate word hashes, one of them under a
    seed drawn anew in each run) are one text, and so are texts without words (null, empty, white space).

    Sketches are over five-word shingles, of texts under 48 words over two-word ones (of texts up to 60 words a quarter
    of them): a sketch keeps the two least occurrence-labelled shingles under its hash, in text order; every text has 64.
    The worst pairs at the threshold, whose edits are single words spread evenly, have a resemblance of 0.29 in long texts,
    so that one sketch is shared with a chance of 0.08 and any of 64 with 0.995; edits in fewer places leave more. Measured
    on such pairs of 9 to 1000 words (``tests/llm``): 0.95 or more linked at every length.
    In a bucket every text is compared with one pivot first: the text with the most neighbours in all its buckets, so that
    a group of near copies is mostly joined through its middle. Buckets whose texts then still lie in several components
    are resolved: each text outside the bucket's largest component may link with all texts of other components that can
    reach the threshold by their sizes and by the parities of their words in two tables of 1024 cells (each word of one
    text only changes at most one parity). All of these are verified.
    """
    seed = secrets.randbits(63)  # of the second half of the keys, which decides what is one text, never of what is found
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    rows = docs.select(ids.alias("doc"), F.xxhash64(F.col(text_col)).alias("sub"), F.col(text_col).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, others, at in _words(batch.column(2), seed):
                keys, second = hash_runs(words, at[:-1], at[1:]), hash_runs(others, at[:-1], at[1:], seed)
                size = np.diff(at)
                found, bounds = shingles(words, at)
                few = size * 4 <= SHORT * 5
                small = np.r_[0, np.cumsum(np.where(few, size, 0))]
                pairs, pair_bounds = shingles(words[np.repeat(few, size)], small, PAIR)
                done: dict[tuple[int, int], tuple[bytes, bytes]] = {}
                both_keys = list(zip(keys.tolist(), second.tolist(), strict=True))
                for k, key in enumerate(both_keys):
                    if key not in done:
                        long, short = labelled(found[bounds[k] : bounds[k + 1]]), labelled(pairs[pair_bounds[k] : pair_bounds[k + 1]])
                        done[key] = (sketches_of(int(size[k]), long, short).tobytes(), parities(words[at[k] : at[k + 1]])) if size[k] else (b"", b"")
                out = [done[key] for key in both_keys]
                both = [pa.array([x[k] for x in out], pa.binary()) for k in range(2)]
                own = [batch.column(k).slice(a, b - a) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(keys.view(np.int64)), pa.array(second.view(np.int64)), pa.array(np.diff(at)), *both], names=["doc", "sub", "key", "second", "n", "sketches", "parity"])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # every text with words has SKETCHES of them
            data = np.frombuffer(b"".join(batch.column("sketches").to_pylist()), dtype="<i8")
            row, at = np.divmod(np.arange(len(data)), SKETCHES)
            yield pa.RecordBatch.from_arrays([pa.array(data), pa.array(at.astype(np.int32)), *[batch.column(c).take(pa.array(row)) for c in ("key", "n")]], names=["bucket", "place", "key", "n"])

    read = Written(rows.mapInArrow(giving_back(sketch), "doc long, sub long, key long, second long, n long, sketches binary, parity binary"), "near-sketches").df
    twice = read.groupBy("key").agg(F.min("second").alias("least"), F.max("second").alias("most")).where("least <> most")
    if twice.take(1):  # different texts of one key: all but one text take the other half of the hash
        read = Written(read.join(twice, "key", "left").withColumn("key", F.when(F.col("second") > F.col("least"), F.col("second")).otherwise(F.col("key"))).drop("least", "most"), "near-sketches").df
    texts = read.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    nodes = read.where("n > 0").groupBy("key").agg(F.min(F.struct("doc", "sub")).alias("at")).select("key", "at.doc", "at.sub")
    dealt = texts.select("key", "n", "sketches").mapInArrow(giving_back(buckets), "bucket long, place int, key long, n long")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("texts")).where("texts > 1")
    shared = Written(dealt.join(sizes, "bucket"), "near-buckets")
    # step one: every text against the pivot of each of its buckets
    near = shared.df.groupBy("key").agg(F.sum("texts").alias("near"))
    pivots = shared.df.join(near, "key").groupBy("bucket").agg(F.max(F.struct("near", "key", "n")).alias("p")).select("bucket", F.col("p.key").alias("pivot"), F.col("p.n").alias("p_n"))
    stars = shared.df.join(pivots, "bucket").where(F.col("key") != F.col("pivot")).where(_sizes_fit(threshold, F.col("n"), F.col("p_n")))
    tried = Written(stars.select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct(), "near-pairs").df
    links = _alike(tried, nodes, rows, threshold)
    grouped = Written(components(links), "near-components").df
    # step two: what is left between the components of a bucket
    pairs = Written(_open_pairs(shared.df, grouped, read, tried, threshold), "near-pairs").df
    if pairs.take(1):
        more = _alike(pairs, nodes, rows, threshold)
        # components of the components found so far, joined by the new links
        of = lambda end: grouped.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
        lifted = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
        united = Written(components(lifted), "near-united").df.select(F.col("node").alias("component"), F.col("component").alias("whole"))
        ends = more.select(F.col("a").alias("node")).unionByName(more.select(F.col("b").alias("node"))).distinct().join(grouped.select("node"), "node", "left_anti")
        every = grouped.unionByName(ends.select("node", F.col("node").alias("component")))
        grouped = Written(every.join(united, "component", "left").select("node", F.coalesce("whole", "component").alias("component")), "near-components").df
    shared.drop()
    return read.select("doc", "sub", "key").join(grouped.withColumnRenamed("node", "key"), "key", "left").select("doc", "sub", F.coalesce("component", "key").alias("component"))


def _sizes_fit(threshold: float, n: Column, o: Column) -> Column:
    return F.least(n, o) >= F.ceil(F.lit(threshold) / (1 + threshold) * (n + o) - 1e-9)


def _open_pairs(shared: DataFrame, grouped: DataFrame, read: DataFrame, tried: DataFrame, threshold: float) -> DataFrame:
    """(a, b): texts of one bucket and different components that may be linked and haven't been tried."""
    placed = shared.select("bucket", "place", "key", "n").join(grouped.withColumnRenamed("node", "key"), "key", "left").select("bucket", "place", "key", "n", F.coalesce("component", "key").alias("component"))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("most")).where("parts > 1")
    contested = placed.join(open_.select("bucket", F.col("most.component").alias("main")), "bucket")
    words = TABLES * CELLS // 64
    columns = [f"p{w}" for w in range(words)]
    own = read.join(contested.select("key").distinct(), "key", "left_semi").select("key", "parity", "sketches").dropDuplicates(["key"])
    marks = own.mapInArrow(giving_back(_numbers), "key long, " + ", ".join(f"{c} long" for c in columns) + ", sketches array<long>")
    rated = Written(contested.join(marks, "key"), "near-contested").df
    other = rated.select("bucket", *[F.col(c).alias(f"o_{c}") for c in ("key", "n", "component", "sketches", *columns)])
    apart = [reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"o_{c}"))) for c in columns[k * words // TABLES : (k + 1) * words // TABLES]]) for k in range(TABLES)]
    need = F.ceil(F.lit(threshold) / (1 + threshold) * (F.col("n") + F.col("o_n")) - 1e-9)
    enough = (F.least("n", "o_n") >= need) & (F.greatest(*apart) <= F.col("n") + F.col("o_n") - 2 * need)
    once = (F.col("o_component") == F.col("main")) | (F.col("key") < F.col("o_key"))
    # of the buckets that two texts share, the first one gives the pair
    first = F.array_position(F.zip_with("sketches", "o_sketches", lambda x, y: x == y), True) == F.col("place") + 1
    found = rated.where("component <> main").join(other, "bucket").where((F.col("component") != F.col("o_component")) & once & enough & first)
    pairs = found.select(F.least("key", "o_key").alias("a"), F.greatest("key", "o_key").alias("b"))
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(known.distinct(), ["a", "b"], "left_anti").select("a", "b").distinct()


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parities of texts as columns and their sketches as arrays."""
    for batch in batches:
        words, sketches = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<i8") for c in (1, 2))
        words = words.reshape(batch.num_rows, -1)
        bounds = np.arange(batch.num_rows + 1) * SKETCHES
        listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sketches))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(words.shape[1])], listed], names=["key", *[f"p{k}" for k in range(words.shape[1])], "sketches"])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs``, all columns, with one row of each class: of the smallest id, and of repeats of that row any one."""
    classed = text_components(docs.select(id_col, text_col), id_col, text_col, threshold)
    best = classed.groupBy("component").agg(F.min(F.struct("doc", "sub")).alias("best")).select("best.doc", "best.sub")
    free = "near"
    while any(c.lower().startswith(free) for c in docs.columns):
        free = "_" + free
    own = [f"{free}_doc", f"{free}_sub"]
    keyed = docs.withColumns({own[0]: F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), own[1]: F.xxhash64(F.col(text_col))})
    return keyed.join(best.select(F.col("doc").alias(own[0]), F.col("sub").alias(own[1])), own, "left_semi").dropDuplicates(own).select(*[f"`{c}`" for c in docs.columns])
