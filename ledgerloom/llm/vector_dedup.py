"""Near-duplicate embeddings by sorted projection passes, and an exact step over the blocks of a label."""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.ragged import hash_runs, mix64, run_starts
from ledgerloom.llm.store import Written

#: Vectors behind each one that a pass compares it with, random signs in a sort key, and passes sorted in one job.
WINDOW, SIGNS, TOGETHER = 32, 60, 7
#: Chance of missing a link in all passes that sets their number, and the seed of the projections.
MISS, SEED = 1e-4, 20_231
#: Vectors in one block of the exact step, numbers in one tile of blocks, and tiles on one side of a task's cell.
BLOCK, TILE, SIDE_TILES = 256, 1 << 17, 16


def _signs(width: int, number: int) -> np.ndarray:
    return np.random.default_rng((SEED, number)).standard_normal((width, SIGNS))


def passes_for(rows: int, threshold: float) -> int:
    """Passes after which a pair at the threshold has been within a window with probability 1 - MISS, if the vectors
    spread evenly over the signs.

    Sorted among ``rows`` vectors, a pair meets in a window if it shares its first log2(rows / WINDOW) signs (or the
    keys differ later than that); each sign is equal with probability 1 - angle / pi.
    """
    same = 1 - math.acos(threshold) / math.pi
    shared = max(1.0, math.log2(max(rows, 2) / WINDOW) + 1)
    return max(4, math.ceil(math.log(MISS) / math.log(1 - same**shared)))


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the usable vectors, unit vectors in double precision) of one batch; all usable rows have one width."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    return sizes, column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).copy()


def vector_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """(id_col, n_links long, component_id long, kept boolean), one row per row of ``vectors``.

    Two vectors of the same non-null label are linked if their cosine in double precision is at least ``threshold``.
    Vectors that are null, zero, of another width than their partner, or that hold a null or non-finite component link
    with nothing. Equal vectors of a label are one until the end. In a pass the vectors of a label are sorted by the
    signs of random projections, read as one word; each is compared with the WINDOW ones before it, across the
    partitions' borders too, and pairs over the threshold are united. The number of passes follows the largest label.
    The passes unite most vectors cheaply, but promise nothing where a label is dense. So all pairs of a label are then
    settled exactly, block by block: that counts every vector's links and unites what no window held. Blocks whose
    radius and distance settle all their pairs at once are not multiplied.
    component_id is the smallest id of a component; a null id counts as the largest one, and repeated rows as vectors
    of their own. An empty table gives an empty result. Other columns are not read.
    """
    kind = "row long, id long, label long, hash long, check long, width int, vector array<double>"
    last = (1 << 63) - 1
    seeds = (secrets.randbits(63), secrets.randbits(63))  # equal vectors of a label are known by 128 bits of hash over their own numbers

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes, flat = _unit(batch.column(1))
            bounds = np.r_[0, np.cumsum(sizes)]
            row = np.repeat(np.arange(len(sizes)), sizes)
            norm2 = np.bincount(row, weights=flat * flat, minlength=len(sizes))
            far = np.isinf(norm2) | (norm2 < 1e-200)  # squares out of range: scale first
            for k in np.flatnonzero(far).tolist():
                own = flat[bounds[k] : bounds[k + 1]]
                if np.isfinite(own).all() and own.any():
                    flat[bounds[k] : bounds[k + 1]] = own / np.abs(own).max()
                    norm2[k] = (flat[bounds[k] : bounds[k + 1]] ** 2).sum()
            label = batch.column(2)
            fine = np.isfinite(norm2) & (norm2 > 0) & label.is_valid().to_numpy(zero_copy_only=False)
            unit = flat / np.sqrt(np.where(fine, norm2, 1.0))[row]
            labels = label.fill_null(0).to_numpy()
            bits = (unit + 0.0).view(np.uint64)
            key, check = (hash_runs(bits, bounds[:-1], bounds[1:], seed) ^ mix64(labels.view(np.uint64) + np.uint64(seed)) for seed in seeds)
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(unit))
            width = np.where(fine, sizes, 0)
            yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(sizes))), batch.column(0), pa.array(labels), pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), pa.array(width.astype(np.int32)), listed], names=["row", "id", "label", "hash", "check", "width", "vector"])
            first += len(sizes)

    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label"))
    read = Written(rows.mapInArrow(prepare, kind), "vectors").df
    own = read.where("width > 0").groupBy("hash", "check").agg(F.min("row").alias("key"), F.count("*").alias("copies"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("width").alias("width"), F.first("vector").alias("vector"))
    distinct = Written(own, "vector-keys").df
    largest = distinct.groupBy("label", "width").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    keys = distinct.select(F.col("hash").alias("of"), F.col("check").alias("of_check"), F.col("key").alias("of_key"))
    distinct = distinct.drop("hash", "check")
    links = None
    if largest:
        rounds = passes_for(largest, threshold)
        for k in range(0, rounds, TOGETHER):
            found = _pass_links(distinct, range(k, min(rounds, k + TOGETHER)), threshold)
            links = found if links is None else links.unionByName(found)
    if links is None:
        links = read.select(F.col("row").alias("a"), F.col("row").alias("b")).where("false")
    grouped = Written(components(links), "vector-components").df
    members = distinct.join(grouped.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    pairs = _all_pairs(members, threshold)
    counts = pairs.where("not edge").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("linked"))
    edges = pairs.where("edge").select("a", "b")
    state = members.select("key", "copies", "component", "least").join(counts, "key", "left")
    if edges.take(1):
        united = Written(components(edges), "vector-united").df.select(F.col("node").alias("component"), F.col("component").alias("whole"))
        state = state.join(united, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    state = state.select("key", "component", "least", F.coalesce("linked", "copies").alias("linked"))
    least = state.groupBy("component").agg(F.min("least").alias("component_id"))
    state = state.join(least, "component").join(keys, F.col("key") == F.col("of_key")).select("of", "of_check", "linked", "component_id")
    state = Written(state, "vector-state").df
    joined = read.join(state, (F.col("hash") == F.col("of")) & (F.col("check") == F.col("of_check")) & (F.col("width") > 0), "left")
    linked = F.coalesce(F.col("linked") - 1, F.lit(0)).cast("long")
    group = F.coalesce("component_id", "id")
    hide = lambda c: F.when(c < last, c)
    return joined.select(hide(F.col("id")).alias(id_col), linked.alias("n_links"), hide(group).alias("component_id"), (F.col("id") == group).alias("kept"))


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    column = batch.column("vector")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    width = batch.column("width")[0].as_py()
    return column.flatten().to_numpy().reshape(-1, width)


def _window_pairs(pass_: np.ndarray, label: np.ndarray, key: np.ndarray, unit: np.ndarray, threshold: float, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs over the threshold, at most WINDOW places apart, whose later one is at ``fresh`` or after."""
    left, right = [], []
    for gap in range(1, min(WINDOW, len(key) - 1) + 1):
        a, b = np.arange(max(0, fresh - gap), len(key) - gap), np.arange(max(gap, fresh), len(key))
        near = (pass_[a] == pass_[b]) & (label[a] == label[b])
        a, b = a[near], b[near]
        hit = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
        left.append(key[a[hit]])
        right.append(key[b[hit]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _pass_links(distinct: DataFrame, numbers: range, threshold: float) -> DataFrame:
    """(a, b): the links found by the passes of these numbers, written to the shared folder."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy()
            for w in np.unique(width).tolist():
                part = batch.filter(pa.array(width == w))
                unit = _matrix(part)
                for number in numbers:
                    bits = (unit @ _signs(w, number)) > 0
                    word = bits.astype(np.int64) @ (np.int64(1) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(unit), pa.int32()), pa.array(word), *[part.column(c) for c in ("label", "key", "width", "vector")]], names=["pass", "word", "label", "key", "width", "vector"])

    fields = "pass int, word long, label long, key long, width int, vector array<double>"
    order = ["pass", "width", "label", "word", "key"]
    ranged = distinct.select("label", "key", "width", "vector").mapInArrow(keyed, fields).repartitionByRange(*order).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside a partition (kind 0), and its first and last WINDOW rows (kinds 1 and 2) for its neighbours."""
        task = TaskContext.get().partitionId()
        tail: pa.Table | None = None
        firsts, first = 0, None
        names = ["kind", "a", "b", "part", "pass", "label", "key", "width", "vector"]

        def edge(table: pa.Table, kind: int) -> Iterator[pa.RecordBatch]:
            n, table = table.num_rows, table.combine_chunks()
            none = pa.nulls(n, pa.int64())
            out = pa.table([pa.array([kind] * n, pa.int32()), none, none, pa.array([task] * n, pa.int32()), *[table.column(c) for c in ("pass", "label", "key", "width", "vector")]], names=names)
            yield from out.to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = tail.num_rows if tail is not None else 0
            table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])]).combine_chunks()
            if firsts < WINDOW:
                more = pa.Table.from_batches([batch]).slice(0, WINDOW - firsts)
                first = more if first is None else pa.concat_tables([first, more])
                firsts = first.num_rows
            a, b = _window_rows(table, threshold, fresh)
            if len(a):
                blank = [pa.nulls(len(a), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(a), pa.int32()), pa.array(a), pa.array(b), *blank], names=names)
            tail = table.slice(max(0, table.num_rows - WINDOW))
        if tail is not None:
            yield from edge(first, 1)
            yield from edge(tail, 2)

    schema = "kind int, a long, b long, part int, pass int, label long, key long, width int, vector array<double>"
    done = Written(ranged.mapInArrow(compare, schema), "vector-passes").df
    links = done.where("kind = 0").select("a", "b")
    # the last rows of a partition stand before the first ones of the next
    seam = done.where("kind > 0").withColumn("seam", F.when(F.col("kind") == 2, F.col("part") + 1).otherwise(F.col("part")))

    def across(key: tuple, table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        before, after = table.filter(pa.array(kinds == 2)), table.filter(pa.array(kinds == 1))
        if not before.num_rows or not after.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = _window_rows(pa.concat_tables([before, after]).combine_chunks(), threshold, before.num_rows)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return links.unionByName(seam.groupBy("seam").applyInArrow(across, "a long, b long"))


def _window_rows(table: pa.Table, threshold: float, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    pass_, label, key, width = (table.column(c).to_numpy() for c in ("pass", "label", "key", "width"))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    heads = np.r_[run_starts(width), len(width)]
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        unit = _matrix(table.slice(a, b - a))
        one, two = _window_pairs(pass_[a:b], label[a:b], key[a:b], unit, threshold, max(0, fresh - a))
        left.append(one)
        right.append(two)
    return np.concatenate(left), np.concatenate(right)


def _all_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """(edge, a, b) from all pairs of a label and width: for edge false the copies b of all vectors at or over the
    threshold of vector a, itself included (to be summed); for edge true two components a, b that a link unites.

    Tiles of vectors that are neighbours in the order of the sign words are dealt to cells of a grid, so that no task
    holds a whole label. Of two tiles, blocks whose balls settle all their pairs at once are not multiplied.
    """
    signed = members.select("label", "width", "key", "copies", "component", "vector")

    def word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy()
            for w in np.unique(width).tolist():
                part = batch.filter(pa.array(width == w))
                bits = (_matrix(part) @ _signs(w, 1 << 20)) > 0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bits.astype(np.int64) @ (np.int64(1) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)))], names=[*part.schema.names, "word"])

    fields = "label long, width int, key long, copies long, component long, vector array<double>"
    order = ["label", "width", "word", "key"]
    ordered = signed.mapInArrow(word, fields + ", word long").repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            label, width = batch.column("label").to_numpy(), batch.column("width").to_numpy()
            heads = [*np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (width[1:] != width[:-1])]).tolist(), len(label)] if len(label) else [0]
            for a, b in zip(heads[:-1], heads[1:], strict=True):
                size = _tile(int(width[a]))
                for k in range(a, b, size):
                    part = batch.slice(k, min(size, b - k))
                    data = [part.column(c).to_numpy().tobytes() for c in ("key", "copies", "component")]
                    yield pa.RecordBatch.from_pydict({"label": pa.array([label[a]]), "width": pa.array([width[a]], pa.int32()), "tile": pa.array([number], pa.int64()), "keys": [data[0]], "copies": [data[1]], "components": [data[2]], "matrix": [_matrix(part).tobytes()]})
                    number += 1

    tiles = Written(ordered.mapInArrow(pack, "label long, width int, tile long, keys binary, copies binary, components binary, matrix binary"), "vector-tiles").df
    # a grid of sides x sides cells for a label, of which those on and over the diagonal are needed
    values = F.sum(F.length("matrix") / 8).alias("values")
    sides = tiles.groupBy("label", "width").agg(values).select("label", "width", F.ceil(F.col("values") / (SIDE_TILES * TILE)).cast("int").alias("sides"))
    placed = tiles.join(sides, ["label", "width"]).withColumn("place", F.pmod(F.xxhash64("tile"), F.col("sides")).cast("int"))
    mine = placed.withColumn("o_place", F.explode(F.sequence("place", F.col("sides") - 1))).drop("sides")
    other = placed.withColumn("at", F.explode(F.sequence(F.lit(0), "place"))).select("label", "width", F.col("at").alias("place"), F.col("place").alias("o_place"), *[F.col(c).alias(f"o_{c}") for c in ("tile", "keys", "copies", "components", "matrix")])
    cell = ["label", "width", "place", "o_place"]
    many = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = mine.repartition(many, *cell).join(other.repartition(many, *cell).hint("merge"), cell).where("place < o_place or tile <= o_tile")
    limit = math.acos(threshold)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[k].as_buffer(), dtype=kind)  # noqa: B023, E731
                same, width = batch.column("tile")[k].as_py() == batch.column("o_tile")[k].as_py(), batch.column("width")[k].as_py()
                keys, copies, group, one = get("keys", np.int64), get("copies", np.int64), get("components", np.int64), get("matrix", np.float64).reshape(-1, width)
                o_keys, o_copies, o_group, two = get("o_keys", np.int64), get("o_copies", np.int64), get("o_components", np.int64), get("o_matrix", np.float64).reshape(-1, width)
                linked, o_linked = np.zeros(len(keys), np.int64), np.zeros(len(o_keys), np.int64)
                edges = [np.zeros((0, 2), np.int64)]
                for a, b, hit in _block_hits(one, two, same, threshold, limit):
                    linked[a] += hit @ o_copies[b] if hit is not None else o_copies[b].sum()
                    if not same or a != b:
                        o_linked[b] += copies[a] @ hit if hit is not None else copies[a].sum()
                    if hit is None:
                        ends = np.unique(np.r_[group[a], o_group[b]])
                        edges.append(np.stack([np.full(len(ends) - 1, ends[0]), ends[1:]], axis=1))
                    elif (apart := hit & (group[a][:, None] != o_group[b])).any():
                        r, c = np.nonzero(apart)
                        edges.append(np.unique(np.stack([group[a][r], o_group[b][c]], axis=1), axis=0))
                found = np.unique(np.concatenate(edges), axis=0)
                own, their = linked > 0, o_linked > 0
                first, second = np.r_[keys[own], o_keys[their], found[:, 0]], np.r_[linked[own], o_linked[their], found[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(first)) >= len(first) - len(found)), pa.array(first), pa.array(second)], names=["edge", "a", "b"])

    return Written(both.mapInArrow(multiply, "edge boolean, a long, b long"), "vector-pairs").df


def _tile(width: int) -> int:
    return max(1, TILE // width)


def _block_hits(one: np.ndarray, two: np.ndarray, same: bool, threshold: float, limit: float) -> Iterator[tuple[slice, slice, np.ndarray | None]]:
    """(rows of one, rows of two, which pairs are links) by blocks that may hold one; None if all pairs are. Products are
    in single precision, those too near to the threshold for it again in double. ``same``: two is one, each block pair
    once."""
    cut = lambda n: [slice(k, min(n, k + BLOCK)) for k in range(0, n, BLOCK)]
    parts, o_parts = cut(len(one)), cut(len(two))
    balls, o_balls = [_ball(one[s]) for s in parts], [_ball(two[s]) for s in o_parts]
    low, o_low = one.astype(np.float32), two.astype(np.float32)
    margin = (one.shape[1] + 8) * 2.0**-22
    apart = np.arccos(np.clip(np.stack([c for c, _ in balls]) @ np.stack([c for c, _ in o_balls]).T, -1, 1))
    for i, a in enumerate(parts):
        for j in range(i if same else 0, len(o_parts)):
            b, around = o_parts[j], balls[i][1] + o_balls[j][1]
            if apart[i, j] - around > limit + 1e-9:
                continue
            if apart[i, j] + around < limit - 1e-9:
                yield a, b, None
                continue
            product = low[a] @ o_low[b].T
            if product.max() < threshold - margin:
                continue
            hit = product >= threshold
            r, c = np.nonzero(np.abs(product - threshold) <= margin)
            if len(r):
                hit[r, c] = np.einsum("ij,ij->i", one[a][r], two[b][c]) >= threshold
            yield a, b, hit


def _ball(unit: np.ndarray) -> tuple[np.ndarray, float]:
    """Direction of the mean of unit vectors, and the largest angle from it."""
    mean = unit.mean(axis=0)
    size = np.sqrt(mean @ mean)
    if not size:
        return unit[0], math.pi
    mean = mean / size
    return mean, math.acos(max(-1.0, min(1.0, float((unit @ mean).min()))))
