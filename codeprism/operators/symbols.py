"""The symbol tables of a chunk corpus: definitions, references and the edges between them.

A repeated delivery of a chunk counts once, a null list is an empty one, a null project is ''.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BUILTINS, family

LISTS = ("defined_symbols", "referenced_symbols", "type_referenced_symbols", "member_referenced_symbols", "imports")


def corpus(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row per chunk id with the named columns (all but indexed_at where none are named)."""
    columns = tuple(c for c in (columns or chunks.columns) if c not in ("id", "indexed_at"))
    rows = chunks.select("id", *columns).dropDuplicates(["id"])
    for c in columns:
        if c in LISTS:
            rows = rows.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    if "project_root" in columns:
        rows = rows.withColumn("project_root", F.coalesce("project_root", F.lit("")))
    return rows


def definitions(c: DataFrame) -> DataFrame:
    """``project_root, path, start_line, is_exported, symbol`` for each defined symbol of a chunk."""
    return c.select("project_root", "path", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("is_exported", F.lit(False)).alias("is_exported"), F.explode(F.array_distinct("defined_symbols")).alias("symbol"))


def all_references(refs_col: str = "referenced_symbols", types_col: str = "type_referenced_symbols"):
    """Calls and types, each once a chunk."""
    return F.array_union(refs_col, types_col)


def references(c: DataFrame) -> DataFrame:
    """``id, project_root, path, symbol`` for each symbol that a chunk calls or names as a type."""
    return c.select("id", "project_root", "path", F.explode(all_references()).alias("symbol"))


def first_definitions(defs: DataFrame, *keys: str) -> DataFrame:
    """The first definition of each symbol, by path and line."""
    keys = keys or ("project_root", "symbol")
    return defs.groupBy(*keys).agg(F.min(F.struct("path", "start_line")).alias("_f"), F.countDistinct("path").alias("def_files")).select(*keys, F.col("_f.path").alias("file"), F.col("_f.start_line").alias("line"), "def_files")


def edges(c: DataFrame) -> DataFrame:
    """``src, dst, kind, id, path, start_line, project_root``: from a chunk's own symbol to what it refers to.

    The own symbol is the first defined one, else the parent, else ``unknown``. A name among the
    member references is a member call, else a name among the references is free, else it is a type.
    """
    own = F.coalesce(F.try_element_at("defined_symbols", F.lit(1)), F.nullif("parent_symbol", F.lit("")), F.lit("unknown"))
    named = c.select("id", "project_root", "path", "start_line", own.alias("src"), "referenced_symbols", "member_referenced_symbols", F.explode(F.array_union(all_references(), F.col("member_referenced_symbols"))).alias("dst"))
    kind = F.when(F.array_contains("member_referenced_symbols", F.col("dst")), "member").when(F.array_contains("referenced_symbols", F.col("dst")), "free").otherwise("type")
    return named.select("src", "dst", kind.alias("kind"), "id", "path", "start_line", "project_root")


def not_builtin(column: str):
    return ~F.col(column).isin(*BUILTINS)


def callers(c: DataFrame, symbol: str) -> DataFrame:
    """Who refers to a symbol: free calls first, then members, then types; members of builtin names are dropped."""
    e = edges(c).where(F.col("dst") == symbol)
    if symbol in BUILTINS:
        e = e.where("kind <> 'member'")
    anchor = definitions(c).where(F.col("symbol") == symbol).agg(F.min(F.struct("path", "start_line"))["path"].alias("_d"))  # one row
    e = e.crossJoin(F.broadcast(anchor)).where(family("path").isNull() | family("_d").isNull() | (family("path") == family("_d")))
    tier = F.when(F.col("kind") == "free", 0).when(F.col("kind") == "member", 1).otherwise(2)
    confidence = F.when(F.col("kind") == "free", "EXTRACTED").otherwise("INFERRED")
    return e.select("id", "src", "path", "start_line", "kind", confidence.alias("confidence"), tier.alias("tier"))


def callees(c: DataFrame, symbol: str) -> DataFrame:
    """What the first definition of a symbol refers to, each name resolved to one definition.

    A name resolves to the same file first, then to the same family, then to the first by path and
    line; builtin names without a definition are dropped, others come out unresolved (null path).
    """
    defs = definitions(c)
    home = c.where(F.array_contains("defined_symbols", symbol)).select(F.col("path").alias("home"), F.coalesce("start_line", F.lit(0)).alias("_l"), "id", all_references().alias("refs")).orderBy("home", "_l", "id").limit(1)
    names = home.select("home", F.explode("refs").alias("symbol")).where(F.col("symbol") != symbol)
    found = names.join(defs.select("symbol", "path", "start_line"), "symbol", "left")
    rank = Window.partitionBy("symbol").orderBy(F.desc(F.coalesce(F.col("path") == F.col("home"), F.lit(False))), F.desc(F.coalesce(family("path") == family("home"), F.lit(False))), "path", "start_line")
    best = found.withColumn("_r", F.row_number().over(rank)).where("_r = 1").where(F.col("path").isNotNull() | not_builtin("symbol"))
    return best.select("symbol", "path", "start_line")
