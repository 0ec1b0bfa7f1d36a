"""Packing token sequences harmonically: remainders in classes of reciprocal size, a fixed number of them to a bin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import bpe
from ledgerloom.llm.ragged import ranges, row_chunks, utf8
from ledgerloom.llm.worker import give_back, giving_back

#: Share of the remainders that fill what the bins of the others leave, at first; a worker adapts it as it goes.
FILL_SHARE = 0.2


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, size) of all pieces: whole sequences first, then the remainder in one piece."""
    whole, rest = lengths // capacity, lengths % capacity
    count = whole + (rest > 0)
    doc = np.repeat(np.arange(len(lengths)), count)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
    return doc, start, np.minimum(lengths[doc] - start, capacity)


def per_bin(size: np.ndarray, capacity: int) -> np.ndarray:
    """The class of a piece: k pieces of over capacity / (k + 1) and up to capacity / k ids fill a bin."""
    return capacity // size


class _Bins:
    """The bins of one worker. Pieces wait until their class has enough of them for a bin; what full bins leave is filled
    with ids cut from other pieces, the filler."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.share = capacity, first, FILL_SHARE
        self.waiting: dict[int, pa.Table] = {}
        self.filler: pa.Table | None = None
        self.gaps = np.zeros((0, 3), dtype=np.int64)  # sequence, offset, ids still free

    def add(self, pieces: pa.Table) -> Iterator[pa.Table]:
        """Take pieces in; give out those that have a place."""
        size = pieces.column("length").to_numpy()
        full = size == self.capacity
        if full.any():
            n = int(full.sum())
            yield self._placed(pieces.filter(pa.array(full)), self.next + np.arange(n), np.zeros(n, dtype=np.int64))
            self.next += n
        rest = np.flatnonzero(~full)
        many = int(len(rest) * self.share)
        fill, own = rest[:many], rest[many:]
        kinds = per_bin(size[own], self.capacity)
        for k in np.unique(kinds).tolist():
            mine = pieces.take(pa.array(own[kinds == k]))
            if k in self.waiting:
                mine = pa.concat_tables([self.waiting.pop(k), mine])
            bins = mine.num_rows // k
            if bins:
                inside = mine.column("length").to_numpy()[: bins * k].reshape(bins, k)
                offset = np.cumsum(inside, axis=1) - inside
                sequence = self.next + np.arange(bins)
                yield self._placed(mine.slice(0, bins * k), np.repeat(sequence, k), offset.ravel())
                used = inside.sum(axis=1)
                free = np.stack([sequence, used, self.capacity - used], axis=1)
                self.gaps = np.concatenate([self.gaps, free[free[:, 2] > 0]])
                self.next += bins
            if bins * k < mine.num_rows:
                self.waiting[k] = mine.slice(bins * k).combine_chunks()
        if len(fill):
            more = pieces.take(pa.array(fill))
            self.filler = more if self.filler is None else pa.concat_tables([self.filler, more]).combine_chunks()
        yield from self._fill()
        self.share = min(0.5, max(0.0, self.share + (0.02 if len(self.gaps) else -0.02)))

    def _fill(self) -> Iterator[pa.Table]:
        """Cut the filler along the gaps, as far as either goes."""
        if self.filler is None or not len(self.gaps):
            return
        size = self.filler.column("length").to_numpy()
        total = min(int(size.sum()), int(self.gaps[:, 2].sum()))
        ends, g_ends = np.cumsum(size), np.cumsum(self.gaps[:, 2])
        cuts = np.unique(np.r_[0, ends[ends < total], g_ends[g_ends < total], total])
        begin, length = cuts[:-1], np.diff(cuts)
        gap = np.searchsorted(g_ends, begin, side="right")
        inside = begin - (g_ends - self.gaps[:, 2])[gap]
        yield self._placed(self._cut_out(self.filler, begin, length), self.gaps[gap, 0], self.gaps[gap, 1] + inside)
        at = int(np.searchsorted(ends, total, side="right"))
        if total == ends[-1]:
            self.filler = None
        else:
            left = np.r_[ends[at] - total, size[at + 1 :]]
            self.filler = self._cut_out(self.filler, np.r_[total, ends[at:-1]], left)
        done = int(np.searchsorted(g_ends, total, side="right"))
        rest = self.gaps[done:].copy()
        if len(rest):
            used = total - (g_ends[done] - rest[0, 2])
            rest[0, 1] += used
            rest[0, 2] -= used
        self.gaps = rest

    @staticmethod
    def _cut_out(pieces: pa.Table, begin: np.ndarray, length: np.ndarray) -> pa.Table:
        """The parts [begin, begin + length) of the pieces' ids, one after another; no part reaches over two pieces."""
        ends = np.cumsum(pieces.column("length").to_numpy())
        piece = np.searchsorted(ends, begin, side="right")
        inside = begin - np.r_[0, ends][piece]
        ids = pieces.column("ids").to_pylist()
        parts = [ids[p][4 * a : 4 * (a + n)] for p, a, n in zip(piece.tolist(), inside.tolist(), length.tolist(), strict=True)]
        start = pieces.column("start").to_numpy()[piece] + inside
        at = pa.array(piece)
        return pa.table({"id": pieces.column("id").take(at), "start": pa.array(start), "length": pa.array(length), "doc_tokens": pieces.column("doc_tokens").take(at), "ids": pa.array(parts, pa.binary())})

    def _placed(self, pieces: pa.Table, sequence: np.ndarray, offset: np.ndarray) -> pa.Table:
        return pieces.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    def close(self) -> Iterator[pa.Table]:
        """What is left, as one stream of ids: first into the gaps, then cut into full sequences and powers of two, so that
        only gaps that nothing is left for are padded (under two bins' worth of them a class, as ``add`` fills them)."""
        rest = [*(self.waiting[k] for k in sorted(self.waiting)), *([self.filler] if self.filler is not None else [])]
        if not rest:
            return
        self.filler = pa.concat_tables(rest).combine_chunks()
        yield from self._fill()
        if self.filler is None:
            return
        total = int(self.filler.column("length").to_numpy().sum())
        bounds = [0]
        while bounds[-1] < total:
            left = total - bounds[-1]
            bounds.append(bounds[-1] + (self.capacity if left >= self.capacity else 1 << left.bit_length() - 1))
        cuts = np.unique(np.r_[0, np.cumsum(self.filler.column("length").to_numpy()), bounds])
        begin, length = cuts[:-1], np.diff(cuts)
        sequence = np.searchsorted(np.array(bounds), begin, side="right") - 1
        yield self._placed(self._cut_out(self.filler, begin, length), self.next + sequence, begin - np.array(bounds)[sequence])


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, length, doc_tokens, ids binary, sequence_id, offset): the pieces of all documents in sequences.

    A document is its ids (of the library; none for a null or empty text) and the end id. It is cut into whole
    sequences and a remainder. A remainder of over capacity / (k + 1) and up to capacity / k ids is of class k, of which
    each bin takes k, whole; every worker fills its own bins of each class. What a bin then lacks is filled with ids cut
    from a share of the remainders that is set apart for it and follows the need. What a worker has left in the end goes
    into the last gaps and then into sequences of full length and of powers of two, which aren't padded. So workers
    need nothing of each other, and only open bins and the filler of a few batches are kept in memory.

    Sequence ids are unique, not gapless; the high bits are the partition. Rows are taken in the order of the input
    partition: over files this is the same in every attempt of a task. Repeated or null ids are documents of their
    own. An empty table gives an empty result. Other columns are not read. ``ids`` are little-endian 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = _Bins(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            for a, b in row_chunks(offsets):
                ids, counts = bpe.encode_rows(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], vocabulary, "library")
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                doc, start, size = cut(counts, capacity)
                bounds = np.r_[0, np.cumsum(size)] * 4
                stored = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                table = pa.table({"id": batch.column(0).slice(a, b - a).take(pa.array(doc)), "start": pa.array(start), "length": pa.array(size), "doc_tokens": pa.array(counts[doc]), "ids": stored})
                for done in bins.add(table):
                    yield from done.combine_chunks().to_batches()
            give_back()  # the arrays of a batch leave gaps between what lasts
        for done in bins.close():
            yield from done.combine_chunks().to_batches()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(giving_back(run), f"id {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long").withColumnRenamed("id", id_col)
