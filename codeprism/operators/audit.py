"""Audit of a corpus: god nodes, hub files, dead symbols, file dependencies and their cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .symbols import definitions, first_definitions, not_builtin, references


def god_nodes(c: DataFrame) -> DataFrame:
    """``project_root, symbol, file, line, inbound_files, total_refs, def_files`` of symbols used in other files."""
    firsts = first_definitions(definitions(c)).where((F.length("symbol") >= 3) & not_builtin("symbol"))
    # references are pre-aggregated per file, so a hot symbol reaches the join as one row a file
    refs = references(c).groupBy("project_root", "symbol", "path").agg(F.count(F.lit(1)).alias("n"))
    used = refs.join(firsts, ["project_root", "symbol"]).where("path <> file")
    return used.groupBy("project_root", "symbol", "file", "line", "def_files").agg(F.count(F.lit(1)).alias("inbound_files"), F.sum("n").alias("total_refs"))


def hub_files(c: DataFrame) -> DataFrame:
    """``project_root, file, dependents, defines, fan_out`` of files that other files depend on."""
    defs = definitions(c).select("project_root", "symbol", F.col("path").alias("file")).distinct()
    refs = references(c).select("project_root", "symbol", "path").distinct()
    dependents = defs.join(refs, ["project_root", "symbol"]).where("path <> file").select("project_root", "file", "path").distinct().groupBy("project_root", "file").agg(F.count(F.lit(1)).alias("dependents"))
    defines = defs.groupBy("project_root", "file").agg(F.count(F.lit(1)).alias("defines"))
    fan = refs.join(defs.select("project_root", "symbol").distinct(), ["project_root", "symbol"]).groupBy("project_root", F.col("path").alias("file")).agg(F.count(F.lit(1)).alias("fan_out"))
    return dependents.join(defines, ["project_root", "file"]).join(fan, ["project_root", "file"], "left").withColumn("fan_out", F.coalesce("fan_out", F.lit(0)))


def dead_candidates(c: DataFrame) -> DataFrame:
    """``project_root, symbol, path, start_line``: not exported and referred to nowhere, the own file included."""
    return definitions(c).where("not is_exported").select("project_root", "symbol", "path", "start_line").distinct().join(references(c).select("project_root", "symbol").distinct(), ["project_root", "symbol"], "left_anti")


def file_edges(c: DataFrame) -> DataFrame:
    """``project_root, src, dst``: a file refers to a symbol that exactly one other file defines."""
    one = first_definitions(definitions(c)).where((F.col("def_files") == 1) & not_builtin("symbol")).select("project_root", "symbol", F.col("file").alias("dst"))
    refs = references(c).select("project_root", "symbol", F.col("path").alias("src")).distinct()
    return refs.join(one, ["project_root", "symbol"]).where("src <> dst").select("project_root", "src", "dst").distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component``: strongly connected components of two nodes or more, named by their largest node.

    Nodes without an edge in or out are trimmed away; then the largest name that reaches a node
    colours it, and within a colour the nodes that reach back to the name form its component. Both
    steps are joins whose state is written each round, until nothing moves; everything found is removed
    and the rest is coloured again until no edge is left. A component holds its members as rows, nothing is collected.
    """
    e = materialised(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s <> d").distinct())
    found = None
    while True:
        before = -1
        while True:  # trim
            n = e.count()
            if n == before or n == 0:
                break
            before = n
            e = materialised(e.join(e.select(F.col("d").alias("s")).distinct(), "s", "left_semi").join(e.select(F.col("s").alias("d")).distinct(), "d", "left_semi").select("s", "d"))
        if e.isEmpty():
            break
        colour = materialised(e.select(F.col("s").alias("node")).union(e.select("d")).distinct().withColumn("c", F.col("node")))
        while True:
            pushed = e.join(colour.withColumnRenamed("node", "s"), "s").groupBy(F.col("d").alias("node")).agg(F.max("c").alias("p"))
            step = materialised(colour.join(pushed, "node", "left").select("node", F.greatest("c", F.coalesce("p", "c")).alias("c"), (F.coalesce("p", "c") > F.col("c")).alias("moved")))
            colour = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        inside = materialised(e.join(colour.select(F.col("node").alias("s"), F.col("c").alias("cs")), "s").join(colour.select(F.col("node").alias("d"), F.col("c").alias("cd")), "d").where("cs = cd").select("s", "d", "cs"))
        member = materialised(colour.where("node = c"))
        front = member
        while True:
            front = materialised(inside.join(front.select(F.col("node").alias("d"), "c"), "d").where("cs = c").select(F.col("s").alias("node"), "c").distinct().join(member, ["node", "c"], "left_anti"))
            if front.isEmpty():
                break
            member = materialised(member.union(front))
        found = member if found is None else found.union(member)
        e = materialised(e.join(member.select(F.col("node").alias("s")), "s", "left_anti").join(member.select(F.col("node").alias("d")), "d", "left_anti").select("s", "d"))
    if found is None:
        return edges.sparkSession.createDataFrame([], "node string, component string")
    sized = found.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(sized, "c").select("node", F.col("c").alias("component"))


def file_cycles(c: DataFrame) -> DataFrame:
    """``project_root, files, file_count, edge_count`` of every dependency cycle."""
    e = materialised(file_edges(c))
    member = materialised(components(e))
    inner = e.join(member.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(member.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").where("a = b")
    counts = inner.groupBy("project_root", F.col("a").alias("component")).agg(F.count(F.lit(1)).alias("edge_count"))
    files = member.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("files"), F.count(F.lit(1)).alias("file_count"))
    return files.join(counts, "component").select("project_root", "files", "file_count", "edge_count")
