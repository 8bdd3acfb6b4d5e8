"""Keeping an index up to date: coalesced changes, the change ladder, coherence, replacement, snapshots, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HASH_VERSION = 2


def latest_events(feed: DataFrame) -> DataFrame:
    """``path, event, ts``: the last event of each path; null times come first, ties by arrival, then unlink wins."""
    last = F.max_by(F.struct("event", "ts"), F.struct(F.coalesce("ts", F.lit("1970-01-01").cast("timestamp_ntz")), F.coalesce("received_at", F.lit("1970-01-01").cast("timestamp_ntz")), "event"))
    return feed.where("path is not null and event is not null").groupBy("path").agg(last.alias("l")).select("path", "l.event", "l.ts")


def distinct_changes(feed: DataFrame) -> DataFrame:
    """The feed without exact repeats."""
    return feed.distinct()


def change_ladder(listing: DataFrame, meta: DataFrame) -> DataFrame:
    """``path, action``: what a listed file needs, against the stored entry.

    Same time (in whole milliseconds) and size: skip. Same size and hash: refresh the time. Else
    process; a file without an entry is new, an entry without a file is gone.
    """
    m = meta.select("path", F.col("mtime_ms").alias("m_time"), F.col("size").alias("m_size"), F.lower("hash").alias("m_hash"), F.lit(1).alias("known"))
    rows = listing.select("path", "mtime_ms", "size", F.lower("hash").alias("hash"), F.lit(1).alias("listed")).join(m, "path", "full")
    action = (
        F.when(F.col("listed").isNull(), "gone")
        .when(F.col("known").isNull(), "new")
        .when((F.floor("mtime_ms") == F.floor("m_time")) & (F.col("size") == F.col("m_size")), "skip")
        .when((F.col("size") == F.col("m_size")) & (F.col("hash") == F.col("m_hash")), "refresh")
        .otherwise("process")
    )
    return rows.select("path", action.alias("action"))


def coherence(meta: DataFrame, vector_paths: DataFrame) -> DataFrame:
    """``path, action, rewrite``: whether the stored entry and the vectors of a path agree.

    reprocess with rewrite where they contradict each other, reprocess without where the entry has
    another hash version or is an older one of Markdown, whose hash was made otherwise; stamp where an
    old entry only lacks its state, else current.
    """
    v = vector_paths.select("path").distinct().withColumn("v", F.lit(True))
    rows = meta.select("path", "hash_version", "has_vectors", F.lit(True).alias("m")).join(v, "path", "full")
    there = F.coalesce("v", F.lit(False))
    clash = F.when(F.col("has_vectors").isNull(), ~there).otherwise(F.col("has_vectors") != there)
    action = (
        F.when(F.col("m").isNull() | clash, "reprocess")
        .when(F.col("hash_version").isNotNull() & (F.col("hash_version") != HASH_VERSION), "reprocess")
        .when(F.col("hash_version").isNull() & F.lower("path").rlike(r"\.mdx?$"), "reprocess")
        .when(F.col("hash_version").isNull() | F.col("has_vectors").isNull(), "stamp")
        .otherwise("current")
    )
    rewrite = F.when(F.col("m").isNull(), there).otherwise(clash)
    return rows.select("path", action.alias("action"), rewrite.alias("rewrite"))


def stale_paths(known: DataFrame, seen: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Known paths that were not seen; below a protected (unreadable) directory nothing is stale."""
    gone = known.select("path").distinct().join(seen.select("path").distinct(), "path", "left_anti")
    if protected is None:
        return gone
    parts = F.split("path", "/")
    up = gone.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    return gone.join(up.join(protected.select("root"), "root", "left_semi").select("path").distinct(), "path", "left_anti")


def replaced(index: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The index with all rows of the fresh paths replaced and those of the gone paths dropped."""
    touched = fresh.select("path").distinct()
    if gone is not None:
        touched = touched.union(gone.select("path")).distinct()
    return index.join(touched, "path", "left_anti").unionByName(fresh, allowMissingColumns=True)


def without_prefix(index: DataFrame, prefix: str) -> DataFrame:
    """The index without what lies below a directory; a sibling with the same beginning stays."""
    return index.where(~F.col("path").startswith(prefix.rstrip("/") + "/"))


def updated(index: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """The index with one column set by id; null becomes ''."""
    new = changes.select("id", F.coalesce(column, F.lit("")).alias("_new"), F.lit(True).alias("_hit"))
    return index.join(new, "id", "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit")


def checked_insert(rows: DataFrame, width: int) -> DataFrame:
    """Rows ready to append: defaults in place of nulls, an error on a vector of another width."""
    out = rows.withColumn("vector", F.when(F.size("vector") == width, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector has not {width} places"))))
    for name, kind in out.dtypes:
        if kind == "string" and name not in ("id", "path", "summary"):
            out = out.withColumn(name, F.coalesce(name, F.lit("")))
        elif kind == "boolean":
            out = out.withColumn(name, F.coalesce(name, F.lit(False)))
        elif kind == "array<string>":
            out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def retry_plan(failures: DataFrame, most: int = 5) -> DataFrame:
    """``path, tries, wait_ms, terminal``: the next try of each failed path, by exponential backoff up to 30 s."""
    n = failures.groupBy("path").agg(F.count(F.lit(1)).alias("tries"))
    return n.select("path", "tries", F.least(F.lit(30000.0), 2000 * F.pow(F.lit(2.0), F.col("tries") - 1)).cast("bigint").alias("wait_ms"), (F.col("tries") >= most).alias("terminal"))


def sampled(rows: DataFrame, key: str, n: int) -> DataFrame:
    """A deterministic sample: the ``n`` rows of least FNV-1a hash of their key."""
    from ..functions.text import fnv1a

    return rows.select("*", fnv1a(key).alias("h")).orderBy("h", key).limit(n)


def in_file_order(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("path").orderBy("start_line", "id")
    return rows.withColumn("place", F.row_number().over(w))
