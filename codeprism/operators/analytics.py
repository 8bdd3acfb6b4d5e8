"""Analytics over a corpus: symbol lists, project summaries, related files, impact, risk, surprising pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, directory_bucket, extension, family, is_eval_path, is_test_path, relative
from .symbols import all_references, definitions, not_builtin, references


def symbol_list(c: DataFrame, contains: str | None = None) -> DataFrame:
    """``symbol, count, path, line``: how many chunks define a symbol and where first (1-based)."""
    defs = definitions(c)
    if contains:
        defs = defs.where(F.lower("symbol").contains(contains.lower()))
    return defs.groupBy("symbol").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("path", "start_line")).alias("f")).select("symbol", "count", F.col("f.path").alias("path"), (F.col("f.start_line") + 1).alias("line"))


def extension_counts(c: DataFrame) -> DataFrame:
    return c.groupBy("project_root", extension("path").alias("ext")).agg(F.count(F.lit(1)).alias("chunks"))


def directory_counts(c: DataFrame, depth: int = 2) -> DataFrame:
    bucket = directory_bucket(relative("path", "project_root"), depth)
    return c.groupBy("project_root", bucket.alias("dir")).agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("chunks"))


def role_counts(c: DataFrame) -> DataFrame:
    """``project_root, role, chunks, percent``; a missing role is ''."""
    n = c.groupBy("project_root", F.coalesce("role", F.lit("")).alias("role")).agg(F.count(F.lit(1)).alias("chunks"))
    return n.withColumn("percent", F.round(100 * F.col("chunks") / F.sum("chunks").over(Window.partitionBy("project_root")), 6))


def key_symbols(c: DataFrame, top: int = 8) -> DataFrame:
    """The most referenced symbols that a project defines itself; ties by name."""
    refs = references(c).where(not_builtin("symbol")).groupBy("project_root", "symbol").agg(F.count(F.lit(1)).alias("refs"))
    own = refs.join(definitions(c).select("project_root", "symbol").distinct(), ["project_root", "symbol"], "left_semi")
    return own.withColumn("r", F.row_number().over(Window.partitionBy("project_root").orderBy(F.desc("refs"), "symbol"))).where(F.col("r") <= top).drop("r")


def entry_points(c: DataFrame, least: float = 5) -> DataFrame:
    """``project_root, symbol, path``: exported orchestration of a complexity of ``least`` or more."""
    rows = c.where((F.col("is_exported")) & (F.col("role") == "ORCHESTRATION") & (F.col("complexity") >= least))
    return rows.select("project_root", F.explode("defined_symbols").alias("symbol"), "path").distinct()


def project_status(c: DataFrame, projects: DataFrame) -> DataFrame:
    """``root, name, chunks, files, registered, state`` of every registered project, by the longest root of a path."""
    roots = projects.select("root", "name", "chunk_count", "status")
    own = project_of(c.select("id", "path"), projects).groupBy("root").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("path").alias("files"))
    rows = roots.join(own, "root", "left")
    n = F.coalesce("chunks", F.lit(0))
    state = F.when(n == 0, "empty").when(F.col("chunk_count").isNull() | (n != F.col("chunk_count")), "stale").otherwise(F.coalesce("status", F.lit("unknown")))
    return rows.select("root", "name", n.cast("bigint").alias("chunks"), F.coalesce("files", F.lit(0)).cast("bigint").alias("files"), F.col("chunk_count").alias("registered"), state.alias("state"))


def project_of(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """``rows`` (id, path) with the longest registered root that holds the path, null outside of all.

    A root is matched by equality: every directory above a path is looked up, so that the registry may
    be of any size and no prefix join is needed.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = rows.select("id", "path", F.explode(above).alias("root"))
    hit = up.join(projects.select("root").distinct(), "root").groupBy("id", "path").agg(F.max_by("root", F.length("root")).alias("root"))
    return rows.join(hit, ["id", "path"], "left")


def by_project(hits: DataFrame) -> DataFrame:
    """``project, hits, first_rank``: groups of ranked hits in the order of their best hit."""
    return hits.groupBy("project").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first_rank"))


def dependents(c: DataFrame, symbols: list[str], anchor_family: str | None = None) -> DataFrame:
    """``path, shared, symbols``: files that use the symbols, language by language; ties by path."""
    refs = references(c).where(F.col("symbol").isin(*symbols))
    defining = definitions(c).where(F.col("symbol").isin(*symbols)).select("path").distinct()
    rows = refs.join(defining, "path", "left_anti")
    if anchor_family:
        rows = rows.where(family("path").isNull() | (family("path") == anchor_family))
    return rows.groupBy("path").agg(F.countDistinct("symbol").alias("shared"), F.sort_array(F.collect_set("symbol")).alias("symbols"))


def related_files(c: DataFrame, path: str) -> DataFrame:
    """``direction, path, n``: files that a file depends on and files that depend on it, by shared symbols."""
    own = c.where(F.col("path") == path)
    defs = own.select(F.explode("defined_symbols").alias("symbol")).distinct()
    needs = own.select(F.explode(F.array_except(all_references(), "defined_symbols")).alias("symbol")).distinct()
    to = definitions(c).where(F.col("path") != path).select("symbol", "path").distinct().join(needs, "symbol").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    back = references(c).where(F.col("path") != path).select("symbol", "path").distinct().join(defs, "symbol").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return to.select(F.lit("dependency").alias("direction"), "path", "n").unionByName(back.select(F.lit("dependent").alias("direction"), "path", "n"))


def importers(c: DataFrame, symbol: str) -> DataFrame:
    """``path``: files with a chunk that speaks of an import and, after it, of the symbol."""
    return c.where(F.col("content").like(f"%import%{symbol}%")).select("path").distinct()


def dead_status(c: DataFrame) -> DataFrame:
    """``project_root, symbol, status, users``: DEAD, PUBLIC_EXPORT or LIVE with the number of other chunks that use it."""
    defs = definitions(c).groupBy("project_root", "symbol").agg(F.max("is_exported").alias("exported"))
    used = references(c).groupBy("project_root", "symbol").agg(F.count(F.lit(1)).alias("users"))
    n = F.coalesce("users", F.lit(0))
    status = F.when(n > 0, "LIVE").when(F.col("exported"), "PUBLIC_EXPORT").otherwise("DEAD")
    return defs.join(used, ["project_root", "symbol"], "left").select("project_root", "symbol", status.alias("status"), n.cast("bigint").alias("users"))


def package_bucket(path, root):
    """The package of a path in its project: ``packages/x``, else the first directory."""
    parts = F.filter(F.split(relative(path, root), "/"), lambda x: x != "")
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return F.when((first == "packages") & second.isNotNull(), F.concat(first, F.lit("/"), second)).otherwise(first)


def impact_rollup(c: DataFrame) -> DataFrame:
    """``project_root, bucket, dependents, symbols``: packages by the files in them that use what other files export."""
    exports = definitions(c).where("is_exported").select("project_root", "symbol", F.col("path").alias("home")).distinct()
    used = references(c).select("project_root", "symbol", "path").distinct().join(exports, ["project_root", "symbol"]).where("path <> home")
    return used.groupBy("project_root", package_bucket("path", "project_root").alias("bucket")).agg(F.countDistinct("path").alias("dependents"), F.countDistinct("symbol").alias("symbols"))


def risk(rows: DataFrame) -> DataFrame:
    """``rows`` (symbol, caller_count, churn, has_tests) with ``score``: untested symbols count double."""
    value = (F.col("caller_count") + 1) * F.when(F.col("has_tests"), 1).otherwise(2) * (1 + F.log2(F.col("churn") + 1))
    return rows.withColumn("score", F.round(value, 2))


def risk_table(c: DataFrame, feed: DataFrame) -> DataFrame:
    """``project_root, symbol, path, caller_count, churn, has_tests, score`` of every symbol by its first definition.

    Churn is the number of distinct changes of the defining file, tests are test files that use the symbol.
    """
    from .symbols import first_definitions

    firsts = first_definitions(definitions(c)).select("project_root", "symbol", F.col("file").alias("path"))
    refs = references(c).groupBy("project_root", "symbol").agg(F.count(F.lit(1)).alias("n"), F.max(is_test_path("path")).alias("t"))
    churn = feed.where("event = 'change' and ts is not null").select("path", "ts").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("k"))
    rows = firsts.join(refs, ["project_root", "symbol"], "left").join(churn, "path", "left")
    rows = rows.select("project_root", "symbol", "path", F.coalesce("n", F.lit(0)).cast("bigint").alias("caller_count"), F.coalesce("k", F.lit(0)).cast("bigint").alias("churn"), F.coalesce("t", F.lit(False)).alias("has_tests"))
    return risk(rows)


def symbol_tokens(symbol):
    """Lower-case words of a symbol, of more than one letter."""
    spaced = F.lower(F.regexp_replace(F.regexp_replace(symbol, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " "))
    return F.array_distinct(F.filter(F.split(spaced, "[^a-z0-9]+"), lambda x: F.length(x) > 1))


def shape_similarity(a, b):
    """Jaccard similarity of the words of two symbols."""
    x, y = symbol_tokens(a), symbol_tokens(b)
    both = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def surprising_pairs(c: DataFrame, pairs: DataFrame, edges: DataFrame, least: float = 0.0, dir_depth: int = 2) -> DataFrame:
    """``a, b, similarity, reason``: similar chunk pairs with the reason to reject them, null where there is none.

    ``pairs`` (a, b, similarity) are chunk ids, for instance from the search for similar vectors. The
    first reason that holds is told: same-file, weak-code, tests, eval, same-dir, graph-edge, below.
    """
    side = c.select("id", "path", "project_root", F.length(F.trim(F.coalesce("content", F.lit("")))).alias("size"), F.size("defined_symbols").alias("defs"), is_test_path("path").alias("test"), is_eval_path("path").alias("ev"), directory_bucket(relative("path", "project_root"), dir_depth).alias("dir"))
    one = side.select(*[F.col(x).alias(f"a_{x}") for x in side.columns])
    two = side.select(*[F.col(x).alias(f"b_{x}") for x in side.columns])
    linked = edges.select(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")).distinct().withColumn("linked", F.lit(True))
    rows = pairs.join(one, F.col("a") == F.col("a_id")).join(two, F.col("b") == F.col("b_id")).withColumn("p", F.least("a_path", "b_path")).withColumn("q", F.greatest("a_path", "b_path")).join(linked, ["p", "q"], "left")
    reason = (
        F.when(F.col("a_path") == F.col("b_path"), "same-file")
        .when(any_of([F.col("a_size") < 80, F.col("b_size") < 80, F.col("a_defs") == 0, F.col("b_defs") == 0]), "weak-code")
        .when(F.col("a_test") | F.col("b_test"), "tests")
        .when(F.col("a_ev") | F.col("b_ev"), "eval")
        .when((F.col("a_project_root") == F.col("b_project_root")) & (F.col("a_dir") == F.col("b_dir")), "same-dir")
        .when(F.coalesce("linked", F.lit(False)), "graph-edge")
        .when(F.col("similarity") < least, "below")
    )
    return rows.select("a", "b", "a_path", "b_path", "similarity", reason.alias("reason"))


def file_pair_findings(pairs: DataFrame) -> DataFrame:
    """``file_a, file_b, pairs, most, median, similarities, examples``: kept pairs by their two files, in either order.

    ``pairs`` is what ``surprising_pairs`` gives. The median interpolates; the five largest similarities and
    the three most similar pairs (ties by ids) are listed.
    """
    kept = pairs.where("reason is null").withColumn("e", F.struct((-F.col("similarity")).alias("s"), "a", "b"))
    g = kept.groupBy(F.least("a_path", "b_path").alias("file_a"), F.greatest("a_path", "b_path").alias("file_b"))
    out = g.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.max("similarity"), 3).alias("most"), F.round(F.percentile("similarity", F.lit(0.5)), 3).alias("median"), F.sort_array(F.collect_list("e")).alias("e"))
    top = F.transform(F.slice("e", 1, 5), lambda x: F.round(-x["s"], 3))
    return out.select("file_a", "file_b", "pairs", "most", "median", top.alias("similarities"), F.transform(F.slice("e", 1, 3), lambda x: F.concat_ws("~", x["a"], x["b"])).alias("examples"))


def similarity_stats(rows: DataFrame, column: str) -> DataFrame:
    """``least, p50, p90, most, mean``, to three digits; percentiles interpolate."""
    return rows.agg(F.round(F.min(column), 3).alias("least"), F.round(F.percentile(column, F.lit(0.5)), 3).alias("p50"), F.round(F.percentile(column, F.lit(0.9)), 3).alias("p90"), F.round(F.max(column), 3).alias("most"), F.round(F.avg(column), 3).alias("mean"))


def eval_metrics(results: DataFrame) -> DataFrame:
    """``cases, found, hits_at_1, mrr, recall_at_10`` of (case, rank), the rank 1-based and null where nothing was found."""
    rr = F.coalesce(1 / F.col("rank"), F.lit(0.0))
    return results.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count("rank").alias("found"),
        F.sum((F.col("rank") == 1).cast("bigint")).alias("hits_at_1"),
        F.round(F.avg(rr), 6).alias("mrr"),
        F.round(F.avg(F.coalesce((F.col("rank") <= 10).cast("double"), F.lit(0.0))), 6).alias("recall_at_10"),
    )


