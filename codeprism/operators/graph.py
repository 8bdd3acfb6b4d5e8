"""Walks over the symbol graph: neighbours, paths, subgraphs, PageRank, call trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_test_path
from ..session import materialised
from .symbols import all_references, edges, references


def call_graph(c: DataFrame) -> DataFrame:
    """``src, dst``: each defined symbol of a chunk to each symbol that the chunk refers to; no loops, no repeats."""
    pairs = c.select(F.explode(F.array_distinct("defined_symbols")).alias("src"), all_references().alias("refs"))
    return pairs.select("src", F.explode("refs").alias("dst")).where("src <> dst").distinct()


def neighbours(graph: DataFrame, start: str, hops: int) -> DataFrame:
    """``symbol, hops``: what can be reached from a symbol in 1 to 5 hops, by the shortest way; the start excluded.

    The frontier is a table; a level is one join and one anti-join against what has been seen.
    """
    seen = front = materialised(graph.sparkSession.createDataFrame([(start, 0)], "symbol string, hops int"))
    for level in range(1, max(1, min(5, hops)) + 1):
        step = graph.join(front.select(F.col("symbol").alias("src")), "src").select(F.col("dst").alias("symbol")).distinct()
        front = materialised(step.join(seen, "symbol", "left_anti").withColumn("hops", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.where("hops > 0")


def shortest_path(graph: DataFrame, start: str, end: str, most: int = 6) -> DataFrame:
    """``path`` (array): the shortest way, the least one among equals; no row where there is none in ``most`` hops."""
    spark = graph.sparkSession
    front = materialised(spark.createDataFrame([(start, [start])], "node string, path array<string>"))
    seen = front.select("node")
    for _ in range(max(0, min(10, most)) + 1):
        hit = front.where(F.col("node") == end).select("path")
        if not hit.isEmpty():
            return hit.orderBy("path").limit(1)
        step = graph.join(front, graph.src == front.node).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = materialised(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        if front.isEmpty():
            break
        seen = seen.union(front.select("node"))
    return spark.createDataFrame([], "path array<string>")


def pagerank(nodes: DataFrame, graph: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """``node, score``: dangling mass is spread evenly, edges to unknown nodes are ignored, scores sum to one.

    Rounds stop when the scores move by less than ``tolerance`` altogether; each is written, so the
    plan does not grow.
    """
    nodes = materialised(nodes.select("node").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    g = graph.where("src <> dst").distinct().join(nodes.withColumnRenamed("node", "src"), "src").join(nodes.withColumnRenamed("node", "dst"), "dst")
    g = materialised(g.join(g.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src"))
    score = materialised(nodes.withColumn("score", F.lit(1.0 / n)))
    for _ in range(rounds):
        given = g.join(score.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") / F.col("out")).alias("g"))
        loose = score.join(g.select(F.col("src").alias("node")).distinct(), "node", "left_anti").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("loose"))  # one row
        step = score.join(given, "node", "left").crossJoin(F.broadcast(loose))
        value = F.lit((1 - damping) / n) + damping * (F.coalesce("g", F.lit(0.0)) + F.col("loose") / n)
        step = materialised(step.select("node", value.alias("score"), F.abs(value - F.col("score")).alias("moved")))
        score = step.drop("moved")
        if tolerance > 0 and step.agg(F.sum("moved")).first()[0] < tolerance:
            break
    return score


def page_rank_boost(c: DataFrame, ranks: DataFrame, weight: float = 0.05) -> DataFrame:
    """``id, boost``: the best score of a chunk's symbols, relative to the best of all, times the weight."""
    best = ranks.agg(F.max("score").alias("m"))  # one row
    own = c.select("id", F.explode("defined_symbols").alias("node")).join(ranks, "node").groupBy("id").agg(F.max("score").alias("s"))
    return own.crossJoin(F.broadcast(best)).select("id", (weight * F.col("s") / F.col("m")).alias("boost"))


def file_subgraph(c: DataFrame, files: list[str]) -> DataFrame:
    """``part, a, b``: symbols of the files, edges between them, and the names that they take from elsewhere."""
    own = c.where(F.col("path").isin(*files))
    symbols = own.select(F.explode("defined_symbols").alias("a")).distinct()
    pairs = call_graph(own)
    inner = pairs.join(symbols.withColumnRenamed("a", "dst"), "dst", "left_semi").select(F.lit("internal").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"))
    outer = pairs.join(symbols.withColumnRenamed("a", "dst"), "dst", "left_anti").select(F.lit("external").alias("part"), F.col("dst").alias("a"), F.lit("").alias("b")).distinct()
    return symbols.select(F.lit("symbol").alias("part"), "a", F.lit("").alias("b")).unionByName(inner).unionByName(outer)


def trace_groups(c: DataFrame, symbol: str) -> DataFrame:
    """``src, path, lines``: callers of a symbol with all their lines (1-based), the symbol itself left out."""
    e = edges(c).where((F.col("dst") == symbol) & (F.col("src") != symbol))
    return e.groupBy("src", "path").agg(F.sort_array(F.collect_set(F.coalesce("start_line", F.lit(0)) + 1)).alias("lines"))


def call_sites(c: DataFrame, symbol: str) -> DataFrame:
    """``path, line, src``: the first line of each caller that names the symbol as a word (1-based), else its start."""
    own = c.join(edges(c).where(F.col("dst") == symbol).select("id", "src").distinct(), "id")
    word = rf"(^|[^A-Za-z0-9_])\Q{symbol}\E([^A-Za-z0-9_]|$)"
    lines = F.split(F.coalesce("content", F.lit("")), "\r?\n")
    place = F.array_position(F.transform(lines, lambda x: x.rlike(word)), True)
    line = F.coalesce("start_line", F.lit(0)) + F.when(place > 0, place).otherwise(1)
    return own.select("path", line.cast("bigint").alias("line"), "src").groupBy("path", "line").agg(F.min("src").alias("src"))


def caller_tree(c: DataFrame, symbol: str, depth: int = 3) -> DataFrame:
    """``symbol, parent, hops``: callers of callers up to ``depth`` levels, each symbol once, under its least parent."""
    e = edges(c).where("src <> 'unknown' and src <> dst").select("src", "dst").distinct()
    seen = front = materialised(c.sparkSession.createDataFrame([(symbol, None, 0)], "symbol string, parent string, hops int"))
    for level in range(1, max(1, min(3, depth)) + 1):
        step = e.join(front.select(F.col("symbol").alias("dst")), "dst").groupBy(F.col("src").alias("symbol")).agg(F.min("dst").alias("parent"))
        front = materialised(step.join(seen, "symbol", "left_anti").withColumn("hops", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.where("hops > 0")


def tests_reaching(c: DataFrame, symbols: list[str], depth: int = 3) -> DataFrame:
    """``path, hops, line, via``: test files that reach the symbols, nearest first.

    Hops are counted from the direct use, 0. ``via`` lists the symbols through which a file was
    reached, by hops and name. Only where no test reaches any of them, those come that mention a symbol
    in their text, with hops -1.
    """
    spark = c.sparkSession
    targets = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    refs = references(c).join(c.select("id", "start_line", F.try_element_at("defined_symbols", F.lit(1)).alias("own")), "id").select("path", "symbol", "start_line", "own")
    level = materialised(targets)
    seen, hits = level, None
    for hop in range(depth):
        users = materialised(refs.join(level, "symbol"))
        got = users.where(is_test_path("path")).select("path", F.lit(hop).alias("hops"), F.coalesce("start_line", F.lit(0)).alias("line"), F.col("symbol").alias("via"))
        hits = got if hits is None else hits.unionByName(got)
        level = materialised(users.where("own is not null").select(F.col("own").alias("symbol")).distinct().join(seen, "symbol", "left_anti"))
        if level.isEmpty():
            break
        seen = seen.union(level)
    mention = c.where(is_test_path("path") & F.col("content").isNotNull()).crossJoin(F.broadcast(targets)).where(F.expr("contains(content, symbol)"))
    text = mention.select("path", F.lit(-1).alias("hops"), F.coalesce("start_line", F.lit(0)).alias("line"), F.col("symbol").alias("via"))
    both = text if hits is None or hits.isEmpty() else hits
    nearest = both.groupBy("path").agg(F.min(F.struct("hops", "line")).alias("b"))
    via = both.groupBy("path", "via").agg(F.min("hops").alias("h")).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "via"))), lambda x: x["via"]).alias("via"))
    return nearest.join(via, "path").select("path", F.col("b.hops").alias("hops"), F.col("b.line").alias("line"), "via")
