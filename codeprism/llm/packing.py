"""Fixed-capacity containers, by harmonic packing over exact size classes.

A document of s tokens belongs to the reciprocal class k = capacity // s: k of its class fit into a
container, and with ``fill=False`` every container holds k documents of one class. By default the room
that this leaves is filled in a second stage: the classes are refined to single sizes (at most ``capacity`` of them), so the histogram of
sizes is bounded by the capacity whatever the corpus holds. From the histogram alone a plan is made:
container kinds, each with a fixed number of documents of its main size (k, as in harmonic packing)
and fixed numbers of smaller sizes that fill the room the main class leaves. Containers of a kind are
filled independently: a document's number among those of its size says which container it goes to.
The numbers are exact offsets over hash buckets, so that one size with a third of all documents is
spread over as many tasks as any other.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from .tokens import sized


def kinds(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Container kinds ``(containers, [(size, documents in each), ...])`` that use up the histogram."""
    left = {s: n for s, n in histogram.items() if 0 < s <= capacity and n > 0}
    sizes = sorted(left)
    plan = []
    while sizes:
        room, content, top = capacity, [], len(sizes)
        while top:
            s = sizes[top - 1]
            m = min(room // s, left[s])
            if m:
                content.append((s, m))
                room -= m * s
            top = min(top - 1, bisect_right(sizes, room))
        n = min(left[s] // m for s, m in content)
        plan.append((n, content))
        for s, m in content:
            left[s] -= n * m
            if not left[s]:
                del left[s]
                sizes.remove(s)
    return plan


def classes(histogram: dict[int, int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """The same for plain harmonic packing; the histogram is that of the classes, k documents a container."""
    return [(-(-n // k), [(k, k)]) for k, n in sorted(histogram.items()) if k > 0]


def ranges(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan turned round: for each size, from which number on documents go to which containers."""
    rows, used, first = [], {}, 0
    for n, content in plan:
        for s, m in content:
            rows.append((s, used.get(s, 0), first, m))
            used[s] = used.get(s, 0) + n * m
        first += n
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"size": a[:, 0], "number": a[:, 1], "first": a[:, 2], "each": a[:, 3], "containers": np.int64(first)}


def packed(docs: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", path: str | None = None, buckets: int = 256, fill: bool = True) -> DataFrame:
    """``container_id, <key>, piece, start_token, n_tokens``: one row per document or piece of one.

    A document over the capacity is cut into full pieces, each alone in its container, and a rest that
    is packed like any document; no other document is cut. Empty and null texts take no room: they
    have n_tokens 0 and a null container. Rows with equal keys are separate documents here, so remove
    repeats first where they mean the same. The order inside a size is by bucket and key, ties by
    text size only, hence the result is the same in every run for unique keys. ``fill=False`` gives plain
    harmonic packing.
    """
    sizes = materialised(sized(docs, key, text, path).withColumnRenamed(key, "_k"))
    cut = sizes.select(
        "_k",
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity)))).alias("piece"),
        F.col("n_tokens").alias("_whole"),
    )
    items = cut.select(
        "_k",
        "piece",
        (F.col("piece") * capacity).alias("start_token"),
        F.least(F.lit(capacity), F.col("_whole") - F.col("piece") * capacity).alias("n_tokens"),
    ).withColumn("_b", F.pmod(F.xxhash64("_k", "piece"), F.lit(buckets)))
    own = F.col("n_tokens").cast("long")  # the class of an item: its size, or how many of them fill a container
    items = items.withColumn("_c", own if fill else F.when(own > 0, F.floor(F.lit(capacity) / own)).otherwise(0).cast("long"))
    counts = items.groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    histogram = {r["_c"]: r["n"] for r in counts.groupBy("_c").agg(F.sum("_n").alias("n")).collect()}  # at most capacity + 1 rows
    where = ranges(kinds(histogram, capacity) if fill else classes(histogram))
    at = where["size"] * (1 << 40) + where["number"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, number = b.column(5).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            i = np.maximum(np.searchsorted(at, size * (1 << 40) + number, side="right") - 1, 0)
            if len(at):
                to = where["first"][i] + (number - where["number"][i]) // where["each"][i]
            else:
                to = np.zeros(len(size), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64(), mask=size == 0), *(b.column(j) for j in range(4))], ["container_id", key, "piece", "start_token", "n_tokens"])

    inside = Window.partitionBy("_c", "_b").orderBy("_k", "piece")
    ranked = items.join(offsets, ["_c", "_b"]).withColumn("_r", F.col("_o") + F.row_number().over(inside) - 1)
    kind = docs.schema[key].dataType.simpleString()
    return ranked.select("_k", F.col("piece").cast("long").alias("piece"), F.col("start_token").cast("long").alias("start_token"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("_r").cast("long").alias("_r"), "_c").mapInArrow(place, f"container_id bigint, {key} {kind}, piece bigint, start_token bigint, n_tokens bigint")
