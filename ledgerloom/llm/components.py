"""Connected components of a link table by alternating large and small stars; no link reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import Written
from ledgerloom.llm.worker import giving_back


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of one batch by a star forest of the same components (fewer rows, same result)."""
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        if not len(a):
            continue
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        left, right, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
        while True:
            low = np.minimum(label[left], label[right])
            new = label.copy()
            np.minimum.at(new, label[left], low)
            np.minimum.at(new, label[right], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link, component being its smallest node.

    links: two long columns, any order, repeats and self-links allowed; rows with a null end are ignored. An empty
    table gives an empty result. Each round is written to the shared folder; rounds grow with the logarithm of the
    longest chain. Hubs are joined as plain equi-joins, which adaptive execution splits.
    """
    start = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    pairs = Written(start.mapInArrow(giving_back(_forest), "a long, b long").distinct(), "links")
    while True:
        both = pairs.df.unionByName(pairs.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every node links its smaller neighbours and itself to the smallest of them
        lower = large.where("b < a").distinct()
        least = lower.groupBy("a").agg(F.min("b").alias("m"))
        small = lower.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = Written(small, "links")
        # finished when every node has one link and no target has a link of its own
        many = new.df.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        chained = new.df.select(F.col("b").alias("a")).join(new.df.select("a"), "a", "left_semi")
        pairs.drop()
        pairs = new
        if not many.unionByName(chained).take(1):
            break
    stars = pairs.df
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
