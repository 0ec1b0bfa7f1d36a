"""Bounded count tables and bit tables that are summed over all rows: a fixed number of cells whatever the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.ragged import mix64
from ledgerloom.llm.store import freed_shuffles
from ledgerloom.llm.worker import giving_back

#: Partial tables that one group of the first two of three reducing steps adds up.
FAN_IN = 32


def summed_cells(df: DataFrame, cells: int, fill: Callable[[pa.RecordBatch, np.ndarray], None], either: bool = False) -> np.ndarray:
    """Sum (or bitwise or, if ``either``) of one table of ``cells`` 64-bit numbers over all batches of ``df``.

    Each task fills its own table; slices of the tables are then added by key in three steps. Only the result, of a
    fixed size, reaches the driver.
    """
    parts = max(1, cells // 32768)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            fill(batch, table)
        task = TaskContext.get().partitionId()
        small = table.astype(np.int32) if not either and table.max(initial=0) < 1 << 31 else table
        slices = [s.tobytes() for s in np.array_split(small, parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([task] * parts, pa.int32()), pa.array(slices, pa.binary())], names=["slice", "part", "cells"])

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(0, dtype=np.int64)
        size = -(-cells // parts)
        for data in table.column("cells").to_pylist():
            own = np.frombuffer(data, dtype=np.int64) if len(data) > 4 * size else np.frombuffer(data, dtype=np.int32).astype(np.int64)
            total = own if not len(total) else total | own if either else total + own
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    schema = "slice int, part int, cells binary"
    partial = df.mapInArrow(giving_back(local), schema)
    for group in (f"part div {FAN_IN}", f"part div {FAN_IN}", "0"):
        partial = partial.withColumn("part", F.expr(f"cast({group} as int)")).groupBy("slice", "part").applyInArrow(reduce, schema)
    with freed_shuffles(df.sparkSession):
        rows = {r["slice"]: np.frombuffer(r["cells"], dtype=np.int64) for r in partial.collect()}  # cells * 8 bytes
    sizes = [len(s) for s in np.array_split(np.zeros(cells, dtype=np.int8), parts)]
    return np.concatenate([rows.get(k, np.zeros(n, dtype=np.int64)) for k, n in enumerate(sizes)])


def bit_positions(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three bit numbers of each 64-bit key in a table of ``bits`` (a power of two) bits: steps of one half of the key
    from the other half."""
    keys = keys.astype(np.uint64)
    step, mask = keys >> np.uint64(32) | np.uint64(1), np.uint64(bits - 1)
    return [((keys + np.uint64(k) * step) & mask).astype(np.int64) for k in range(3)]


def key_filter(keys: DataFrame, column: str, rows: int, most_bits: int = 1 << 26) -> np.ndarray:
    """A Bloom filter of a long column as 64-bit words. 16 bits a key, up to ``most_bits``: beyond it more foreign keys
    pass (more rows are moved than needed), own keys always pass."""
    bits = min(most_bits, max(1 << 12, 1 << (16 * max(rows, 1) - 1).bit_length()))

    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        own = mix64(batch.column(0).to_numpy().view(np.uint64))
        view = table.view(np.uint64)
        for at in bit_positions(own, bits):
            np.bitwise_or.at(view, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))

    return summed_cells(keys.select(column), bits // 64, fill, either=True)


def passes(filter_words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    view, bits = filter_words.view(np.uint64), len(filter_words) * 64
    out = np.ones(len(keys), dtype=bool)
    for at in bit_positions(mix64(keys.view(np.uint64)), bits):
        out &= ((view[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return out
