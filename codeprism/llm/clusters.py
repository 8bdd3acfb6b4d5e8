"""Clusters of similar signatures: banded buckets, stars, verification, connected components.

A signature is a row of MinHash places, and some keys, one for each of its bands. Signatures with a
key in common fall into one bucket. In every bucket one member is the star and all others are compared
with it; members that no star has taken yet give the stars of the next round, four times as many each,
until the bucket is used up. Ids are hashes and the order of stars is that of the ids, in every other
band reversed, so the buckets of a family share two stars, and a pair is compared once. Links that hold
give the components. No list of members is ever built: buckets, stars and labels are aggregates and
equi-joins, so a hot bucket or a large family spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised


def bands(places: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` places, of each signature (the rows of ``places``)."""
    with np.errstate(over="ignore"):
        b = places.reshape(len(places), -1, rows).astype(np.uint64)
        h = np.zeros(b.shape[:2], np.uint64)
        for i in range(rows):
            h = (h ^ b[:, :, i]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        h = (h + np.arange(b.shape[1], dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h.view(np.int64)


def stacked(column: pa.Array, dtype=np.uint16) -> np.ndarray:
    """Signatures of equal length as the rows of a matrix."""
    got = column.to_pylist()
    return np.frombuffer(b"".join(got), dtype).reshape(len(got), -1) if got else np.zeros((0, 0), dtype)


def links(units: DataFrame, agree: float) -> DataFrame:
    """``u, star``: pairs of which at least ``agree`` of the signature's places are equal.

    ``units`` has distinct ids ``u`` (bigint, hashes), ``keys`` (array of bigint, see ``bands``) and signatures
    ``sig`` (binary, uint16 places).
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = (stacked(b.column(2)) == stacked(b.column(3))).mean(axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same >= agree)], ["u", "star", "ok"])

    keyed = units.select("u", F.posexplode("keys").alias("p", "bucket"))
    keyed = keyed.select("bucket", F.when(F.col("p") % 2 == 0, F.col("u")).otherwise(F.bitwise_not("u")).alias("o"), (F.col("p") % 2 == 1).alias("flip"))
    id_of = lambda o: F.when(F.col("flip"), F.bitwise_not(o)).otherwise(F.col(o))
    first = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("v")).where("n > 1").select("bucket", "v")
    sigs, other = units.select("u", "sig"), units.select(F.col("u").alias("star"), F.col("sig").alias("sig2"))
    free, held, count = materialised(keyed.join(first.select("bucket"), "bucket")), None, 1
    stars = free.groupBy("bucket").agg(F.min("o").alias("v"))
    while True:
        met = free.join(stars, "bucket").where("o > v").select("bucket", "o", "flip", id_of("o").alias("u"), id_of("v").alias("star"))
        judged = materialised(met.select("u", "star").distinct().join(sigs, "u").join(other, "star").select("u", "star", "sig", "sig2").mapInArrow(compare, "u bigint, star bigint, ok boolean"))
        ok = judged.where("ok").select("u", "star")
        held = ok if held is None else held.unionByName(ok)
        if judged.where("not ok").isEmpty():
            return held
        # free are the members that neither matched a star nor were one, where there are at least two
        taken = met.join(ok, ["u", "star"]).select("bucket", "o").unionByName(stars.select("bucket", F.col("v").alias("o"))).distinct()
        rest = free.join(taken, ["bucket", "o"], "left_anti")
        free = materialised(rest.join(rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "bucket"))
        if free.isEmpty():
            return held
        count *= 4
        stars = free.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("o"))).where(F.col("r") <= count).select("bucket", F.col("o").alias("v"))


def components(edges: DataFrame, a: str = "u", b: str = "star") -> DataFrame:
    """``u, c``: each node of an edge with the smallest id of its component.

    Alternates two steps until nothing moves: every node hands its larger neighbours to its smallest one,
    then its smaller ones too. Only minima are aggregated, so a hub costs no list.
    """
    x = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    x = materialised(x.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())  # u > v
    before = None
    while True:
        both = x.unionByName(x.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialised(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        x = materialised(small)
        now = x.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            break
        before = now
    tops = x.select(F.col("v").alias("u"), F.col("v").alias("c")).distinct()
    return x.select("u", F.col("v").alias("c")).unionByName(tops)
