"""Per-key results over keys of which a few hold most rows, by exact offset chunking.

Rows are pre-aggregated per (key, item), range-partitioned on both columns (so that a hot key spreads
over several partitions), written once, numbered with exact offsets (rows per partition, prefix sums),
cut into chunks of equal size, and reduced chunk by chunk. A key that crosses chunk borders has one
boundary state per chunk - refs, items, first and last item - and the states are merged in order.
No task receives more rows than its neighbours, whatever the distribution of the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised

#: monotonically_increasing_id() holds the partition above these bits and the row's place below them.
PLACE_BITS = 33


def distinct_chunks(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row per chunk id: the latest delivery of each, of which all are equal but for their time."""
    return chunks.select("id", *columns).where(F.col("id").isNotNull()).dropDuplicates(["id"])


def numbered(rows: DataFrame, key: str, item: str) -> DataFrame:
    """``rows`` in the order of (key, item), with ``place``: their exact 0-based number in that order."""
    ordered = materialised(rows.repartitionByRange(F.col(key), F.col(item)).sortWithinPartitions(key, item))
    tagged = ordered.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", PLACE_BITS))
    sizes = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    place = F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return tagged.join(F.broadcast(starts), "_p").withColumn("place", place).drop("_m", "_p", "_s")


def keyed_totals(pairs: DataFrame, chunk_rows: int = 50_000) -> DataFrame:
    """``pairs(key, item, n)`` to one row per key: ``total`` (sum of n) and ``items`` (distinct items).

    Null keys are dropped, as they name nothing; a null item counts in ``total`` and not in ``items``;
    an empty input gives an empty result. ``chunk_rows`` is the size of a chunk in (key, item) rows.
    """
    once = pairs.where(F.col("key").isNotNull()).groupBy("key", "item").agg(F.sum("n").alias("n"))
    rows = numbered(once, "key", "item").withColumn("chunk", F.floor(F.col("place") / chunk_rows))
    states = rows.groupBy("chunk", "key").agg(
        F.sum("n").alias("total"),
        F.count("item").alias("items"),
        F.min("item").alias("first_item"),
        F.max("item").alias("last_item"),
    )
    order = Window.partitionBy("key").orderBy("chunk")  # a key has as many states as chunks it reaches into
    joined = states.withColumn("again", F.coalesce((F.lag("last_item").over(order) == F.col("first_item")).cast("long"), F.lit(0)))
    return joined.groupBy("key").agg(F.sum("total").alias("total"), F.sum(F.col("items") - F.col("again")).alias("items"))


def symbol_totals(chunks: DataFrame, chunk_rows: int = 50_000) -> DataFrame:
    """References per symbol: ``symbol, total_refs, inbound_files`` over distinct chunks.

    ``total_refs`` counts every element of ``referenced_symbols`` (repeats inside one list too);
    ``inbound_files`` counts the distinct paths they stand in. Null lists and null names count nothing.
    """
    refs = distinct_chunks(chunks, "path", "referenced_symbols").select("path", F.explode("referenced_symbols").alias("symbol"))
    pairs = refs.select(F.col("symbol").alias("key"), F.col("path").alias("item"), F.lit(1).cast("long").alias("n"))
    return keyed_totals(pairs, chunk_rows).select(F.col("key").alias("symbol"), F.col("total").alias("total_refs"), F.col("items").alias("inbound_files"))


def hot_symbols(chunks: DataFrame, share: float = 0.025, chunk_rows: int = 50_000) -> DataFrame:
    """``symbol``: those that make up at least ``share`` of all elements."""
    totals = symbol_totals(chunks, chunk_rows)
    whole = totals.agg(F.sum("total_refs").alias("whole"))  # one row
    return totals.crossJoin(F.broadcast(whole)).where(F.col("total_refs") >= share * F.col("whole")).select("symbol")
