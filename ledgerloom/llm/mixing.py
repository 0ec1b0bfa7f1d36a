"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.store import Written

#: Bits of the hash read by each of the nested histograms.
LEVEL_BITS = (10, 10, 10)
#: Sources up to which the table of thresholds is broadcast.
MOST_SOURCES = 100_000
#: Hexadecimal digits of the md5 of the id that make the hash (48 bits; the levels read the first 30).
HEX_DIGITS = 12


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, size): water-filling of share * all sizes by weight.

    Sources in code-point order, null last, take the weights in turn. A target stops at cap times its source's size
    and the rest is shared again by weight: with sources sorted by cap/weight, the level is the first one at which no
    further source stops. The table has one row per source, so its windows are small whatever the corpus.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = by_source.select("*", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("k"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    rated = ordered.select("source", "source_size", "k", weight.alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("most"))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), "k")
    whole = Window.partitionBy()
    rated = rated.select(
        "*",
        (F.sum("source_size").over(whole) * F.lit(float(share))).alias("budget"),
        F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("stopped"),
        F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("open_w"),
    )
    rated = rated.withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("open_w"))
    ratio = F.col("most") / F.col("w")
    level = F.min(F.when(ratio >= F.col("level"), F.struct(ratio.alias("ratio"), "k", "level"))).over(whole)["level"]
    return rated.select("source", "source_size", F.round(F.least("most", F.coalesce(level, F.lit(float("inf"))) * F.col("w")), 6).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """How often each document enters the mix.

    A source's target is a number of whole passes over it plus a part of one more. The part is cut by a threshold on
    a hash of the id: a histogram of sizes by source and first hash bits finds the bucket in which the budget ends,
    further histograms refine that bucket alone, and rows are then kept by comparing their hash. Nothing is sorted.
    The taken words of a source fall short of its target by less than the last, 2**-30, hash cell holds.

    Documents with the same id share their hash and so their fate; a null id hashes as the text 'null'; a null text
    has size 0; null is a source of its own, the last one; sources of size 0 have target 0; an empty table gives an
    empty result. Other columns are not read.
    Returns id_col, size, source, source_size, target double, copies int, taken long.
    """
    digits = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 1, HEX_DIGITS)
    cell_bits = sum(LEVEL_BITS)
    cell = F.shiftright(F.conv(digits, 16, 10).cast("long"), 4 * HEX_DIGITS - cell_bits)
    sized = Written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), cell.alias("cell")), "sizes").df
    targets = source_targets(sized, weights, share, cap)
    targets = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    # state of the search: up to where cells are in (below), and the words still to be given out (left)
    state = targets.select("*", (F.col("target") - F.col("passes") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("below"))
    state = Written(state, "targets").df
    # one row per source: broadcast up to a checked number of sources, else a shuffled join that can split hot ones
    small = F.broadcast if state.count() <= MOST_SOURCES else (lambda df: df)
    seen = 0
    for bits in LEVEL_BITS:
        seen += bits
        shift = cell_bits - seen
        edge = small(state.select(F.col("source").alias("s"), "below"))
        # the first level reads all rows, each later one only the bucket in which its source's budget ends
        rows = sized.join(edge, sized["source"].eqNullSafe(edge["s"]))
        rows = rows.where(F.shiftright("cell", shift + bits) == F.shiftright("below", shift + bits))
        histogram = rows.groupBy(sized["source"], F.shiftright("cell", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        running = histogram.select("source", "bucket", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")).alias("upto"))
        other = running.select(F.col("source").alias("s"), "bucket", "upto")
        ended = state.join(other, state["source"].eqNullSafe(other["s"]), "left").groupBy("source", "source_size", "target", "passes", "left", "below")
        fits = F.col("upto") <= F.col("left")
        found = ended.agg(F.max(F.when(fits, F.col("upto"))).alias("used"), F.min(F.when(~fits, F.col("bucket"))).alias("edge"))
        after = F.coalesce(F.shiftleft("edge", shift), F.shiftleft(F.shiftright("below", shift + bits) + 1, shift + bits))
        state = Written(found.select("source", "source_size", "target", "passes", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"), after.alias("below")), "targets").df
    final = small(state.select(F.col("source").alias("s"), "source_size", "target", "passes", "below"))
    joined = sized.join(final, sized["source"].eqNullSafe(final["s"]))
    copies = (F.col("passes") + (F.col("cell") < F.col("below")).cast("int")).cast("int")
    return joined.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` (all columns) with every row as often as the mix takes its id: rows not taken go, repeats are repeated.

    Rows of one id share their number of copies; null ids too.
    """
    free = "take"
    while any(c.lower().startswith(free) for c in docs.columns):
        free = "_" + free
    t_id, t_source, n, k = (f"{free}_{c}" for c in ("id", "source", "copies", "copy"))
    copies = mix(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), "id", "text", "source", **how)
    keys = copies.where("copies > 0").select(F.col("id").alias(t_id), F.col("source").alias(t_source), F.col("copies").alias(n)).distinct()
    matched = F.col(id_col).eqNullSafe(F.col(t_id)) & F.col(source_col).eqNullSafe(F.col(t_source))
    return docs.join(keys, matched).withColumn(k, F.explode(F.sequence(F.lit(1), n))).select(*[f"`{c}`" for c in docs.columns])
