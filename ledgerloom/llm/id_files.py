"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding, in document order, and its reader."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import bpe
from ledgerloom.llm.ragged import ranges, row_chunks, utf8
from ledgerloom.llm.store import Written

#: Ids in one block of a file; a longer document has a block of its own.
BLOCK_IDS = 1 << 19


def code_sizes(ranks: np.ndarray) -> np.ndarray:
    return 1 + (ranks >= 1 << 8).astype(np.int64) + (ranks >= 1 << 16) + (ranks >= 1 << 24)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes): two control bits per number, four numbers to a control byte, hold its size less 1;
    the data bytes are the numbers' low bytes, least first."""
    size = code_sizes(ranks)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    each = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), each[np.arange(4) < size[:, None]].tobytes()


@lru_cache(maxsize=1)
def _size_table() -> np.ndarray:
    """Sizes of the four numbers of every control byte."""
    return ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def number_sizes(control: bytes) -> np.ndarray:
    """Data bytes of all the numbers of these control bytes, by table lookup."""
    return _size_table()[np.frombuffer(control, dtype=np.uint8)].ravel()


def decode(data: bytes, size: np.ndarray) -> np.ndarray:
    """The numbers whose data bytes are these, given their sizes."""
    at = np.r_[0, np.cumsum(size)][:-1]
    padded = np.r_[np.frombuffer(data, dtype=np.uint8), np.zeros(3, dtype=np.uint8)].astype(np.uint32)
    out = padded[at]
    for k in range(1, 4):
        more = size > k
        if not more.any():
            break
        out[more] |= padded[at[more] + k] << np.uint32(8 * k)
    return out


class IdFiles:
    """Written files and what reads them: the table of blocks, the ids by rank, and ids before each partition."""

    def __init__(self, blocks: DataFrame, by_rank: np.ndarray, before: dict[int, int]):
        self.blocks, self.by_rank, self.before = blocks, by_rank, before


def write_ids(docs: DataFrame, vocabulary: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> IdFiles:
    """Encode all texts, rank ids by frequency over all documents, and write them in ascending order of id_col.

    First every text is encoded once (the library encodes each distinct pre-token of a worker) and its ids are kept in
    the shared folder; their counts give the ranks (a table as long as the vocabulary). Then documents are dealt by
    ranges of their id, sorted, and written as blocks of rank codes: control bytes, data bytes, and per document its
    number of ids and bytes. A file is a Parquet part, so lost tasks are written again and never twice.
    Null texts are empty (the end id alone); null ids come first; documents with equal ids stand in the order read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            for a, b in row_chunks(offsets):
                ids, counts = bpe.encode_rows(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], vocabulary, "library")
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                wide = ids.max(initial=0) >= 1 << 16
                data, size = ids.astype("<u4" if wide else "<u2").tobytes(), 4 if wide else 2
                bounds = (np.r_[0, np.cumsum(counts)] * size).tolist()
                parts = [data[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), pa.array(parts, pa.binary())], names=["id", "n", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    encoded = Written(rows.mapInArrow(encode_all, f"id {kind}, n long, ids binary"), "token-ids")

    def ids_of(column: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds) of a batch; rows of four bytes an id are read apart from those of two."""
        parts = column.to_pylist()
        wide = np.array([len(p) for p in parts]) == 4 * n
        if not wide.any() or not len(n):
            return np.frombuffer(b"".join(parts), dtype="<u2").astype(np.uint32), np.r_[0, np.cumsum(n)]
        each = [np.frombuffer(p, dtype="<u4" if w else "<u2").astype(np.uint32) for p, w in zip(parts, wide.tolist(), strict=True)]
        return np.concatenate(each), np.r_[0, np.cumsum(n)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            own = np.bincount(ids_of(batch.column(1), batch.column(0).to_numpy())[0])
            if len(own) > len(total):
                own[: len(total)] += total
                total = own
            else:
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counted = encoded.df.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(((r["n"], r["id"]) for r in counted.collect()), key=lambda x: (-x[0], x[1]))  # as long as the vocabulary
    by_rank = np.array([i for _, i in ranked], dtype=np.uint32)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = ids_of(batch.column(2), batch.column(1).to_numpy())
            ranks = rank_of[ids]
            coded = [encode(ranks[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())], names=["id", "n", "control", "data"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        n_held = 0

        def block() -> pa.RecordBatch:
            nonlocal before
            n = np.array([h[1] for h in held], dtype=np.int64)
            size = np.array([len(h[3]) for h in held], dtype=np.int64)
            values = [[task], [before], [[h[0] for h in held]], [n.tobytes()], [size.tobytes()], [b"".join(h[2] for h in held)], [b"".join(h[3] for h in held)]]
            kinds = [pa.int32(), pa.int64(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            before += int(n.sum())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["part", "before", "ids", "n", "sizes", "control", "data"])

        for batch in batches:
            id_type = batch.column(0).type
            for row in zip(*[batch.column(c).to_pylist() for c in ("id", "n", "control", "data")], strict=True):
                if held and n_held + row[1] > BLOCK_IDS:
                    yield block()
                    n_held = 0
                held.append(row)
                n_held += row[1]
        if held:
            yield block()

    keyed = encoded.df.select("id", "n", "ids").mapInArrow(code, f"id {kind}, n long, control binary, data binary").withColumn("place", F.monotonically_increasing_id())
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, "id", "place").sortWithinPartitions("id", "place").drop("place")
    written = Written(ranged.mapInArrow(blocks, f"part int, before long, ids array<{kind}>, n binary, sizes binary, control binary, data binary"), "id-files")
    encoded.drop()
    totals = written.df.select("part", "before", "n").mapInArrow(_block_totals, "part int, upto long").groupBy("part").agg(F.max("upto").alias("n")).collect()  # one row per partition
    before, so_far = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        before[row["part"]] = so_far
        so_far += row["n"]
    return IdFiles(written.df, by_rank, before)


def _block_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [int(np.frombuffer(n, dtype=np.int64).sum()) for n in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(1).to_numpy() + np.array(sums, dtype=np.int64))], names=["part", "upto"])


def read_ids(files: IdFiles, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: id_col, start long (ids of all documents before it), n_tokens long,
    ids_crc32 long (of its ids as little-endian unsigned 32-bit numbers), and with_ids the ids themselves."""
    by_rank, before = files.by_rank, files.before
    kind = files.blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                n, size = (np.frombuffer(row[c].as_py(), dtype=np.int64) for c in ("n", "sizes"))
                control, data = row["control"].as_py(), row["data"].as_py()
                c_at, d_at, at = (np.r_[0, np.cumsum(x)].tolist() for x in (-(-n // 4), size, n))
                # documents begin at whole control bytes: one lookup decodes the block, padding falls out by position
                spread = np.zeros(len(control) * 4, dtype=bool)
                spread[ranges(np.array(c_at[:-1], dtype=np.int64) * 4, n)] = True
                ids = by_rank[decode(data, number_sizes(control)[spread])].astype("<u4")
                flat = ids.tobytes()
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                start = before[row["part"].as_py()] + row["before"].as_py() + np.array(at[:-1], dtype=np.int64)
                out = [row["ids"].values, pa.array(start), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["id", "start", "n_tokens", "ids_crc32", *["token_ids"] * with_ids])

    schema = f"id {kind}, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids
    return files.blocks.mapInArrow(run, schema).withColumnRenamed("id", id_col)
