"""Chunks from files: line windows, pieces, context, texts, skeletons, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension, token_estimate

WINDOW_LINES, STRIDE = 75, 65


def line_windows(files: DataFrame, key: str = "file_id", text: str = "content", lines: int = WINDOW_LINES, stride: int = STRIDE) -> DataFrame:
    """``key, chunk_index, start_line, end_line, n_chars``: windows of lines that overlap; a null text has none.

    All in the JVM: the lines of a row are split once and sliced. Each stride opens a window, however
    short the rest is. A line end at the very end opens no line.
    """
    split = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\n\z", ""), "\n")
    rows = files.where(F.col(text).isNotNull()).select(F.col(key), split.alias("_l")).withColumn("_n", F.size("_l"))
    starts = F.sequence(F.lit(0), F.col("_n") - 1, F.lit(stride))
    out = rows.select(key, "_l", "_n", F.posexplode(starts).alias("chunk_index", "start_line"))
    stop = F.least(F.col("start_line") + lines, F.col("_n"))
    body = F.array_join(F.slice("_l", F.col("start_line") + 1, stop - F.col("start_line")), "\n")
    return out.select(key, "chunk_index", "start_line", (stop - 1).alias("end_line"), F.length(body).cast("bigint").alias("n_chars"))


def with_context(c: DataFrame, chars: int = 200) -> DataFrame:
    """``id, previous_id, next_id``: the neighbours of each chunk in its file, by index and id."""
    w = Window.partitionBy("path").orderBy("chunk_index", "id")
    return c.select("id", F.lag("id").over(w).alias("previous_id"), F.lead("id").over(w).alias("next_id"))


def formatted(c: DataFrame):
    """The text that is indexed: path, imports, place in its parent, body and documentation."""
    imports = F.when(F.size("imports") > 0, F.concat(F.lit("Imports: "), F.array_join("imports", ", ")))
    place = F.when(F.coalesce("parent_symbol", F.lit("")) != "", F.concat(F.col("parent_symbol"), F.lit(" > "), F.coalesce(F.try_element_at("defined_symbols", F.lit(1)), F.lit(""))))
    return F.concat_ws("\n", F.concat(F.lit("File: "), F.col("path")), imports, place, F.col("content"), F.col("docstring"))


def chunk_texts(c: DataFrame) -> DataFrame:
    """``id, n_chars, tokens, digest`` of the indexed text of each chunk; the digest is its deterministic identity."""
    return c.select("id", formatted(c).alias("_t")).select("id", F.length("_t").cast("bigint").alias("n_chars"), token_estimate("_t").alias("tokens"), F.sha2("_t", 256).alias("digest"))


def data_file_guard(files: DataFrame, most: int = 100_000) -> DataFrame:
    """Files that are cut into chunks: data files above a size are not."""
    data = extension("path").isin(".json", ".yaml", ".yml", ".xml", ".csv", ".map")
    return files.where(~(data & (F.coalesce(F.length("content"), F.lit(0)) > most)))


def scoped_symbols(pieces: DataFrame, c: DataFrame) -> DataFrame:
    """``chunk_id, piece, defined_symbols, referenced_symbols``: of a chunk's symbols those that occur in a piece."""
    rows = pieces.join(c.select(F.col("id").alias("chunk_id"), "defined_symbols", "referenced_symbols"), "chunk_id")
    inside = lambda name: F.filter(name, lambda s: F.col("content").contains(s))
    return rows.select("chunk_id", "piece", inside("defined_symbols").alias("defined_symbols"), inside("referenced_symbols").alias("referenced_symbols"))


def budget_pack(candidates: DataFrame, budget: int, group: str = "grp") -> DataFrame:
    """``group, picked, used, dropped``: what fits a token budget, per group of candidates.

    Candidates (grp, idx, tokens, score) are taken by score in steps of 0.02, then the shorter, then
    the earlier; one that does not fit is skipped. If none fits, the one of the highest score itself is
    taken alone, the earliest of equals. A group is the candidate list of one request, a few hundred rows
    at most; its fold runs in the JVM.
    """
    order = F.sort_array(F.collect_list(F.struct((-F.round(F.col("score") / 0.02)).alias("s"), "tokens", "idx")))
    start = F.struct(F.array().cast("array<int>").alias("picked"), F.lit(0).cast("bigint").alias("used"))

    def take(acc, x):
        fits = acc["used"] + x["tokens"] <= budget
        return F.struct(F.when(fits, F.concat(acc["picked"], F.array(x["idx"].cast("int")))).otherwise(acc["picked"]).alias("picked"), F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).cast("bigint").alias("used"))

    first = F.max_by(F.struct("idx", "tokens"), F.struct("score", -F.col("idx")))
    rows = candidates.groupBy(group).agg(order.alias("o"), first.alias("f"))
    done = rows.withColumn("a", F.aggregate("o", start, take))
    none = F.size("a.picked") == 0
    picked = F.when(none, F.array(F.col("f.idx").cast("int"))).otherwise(F.sort_array("a.picked"))
    used = F.when(none, F.col("f.tokens").cast("bigint")).otherwise(F.col("a.used"))
    return done.select(group, picked.alias("picked"), used.alias("used"), (F.size("o") - F.size(picked)).alias("dropped"))


def import_lines(files: DataFrame) -> DataFrame:
    """``file_id, imports``: how many lines of a file open an import, in any of its languages."""
    pattern = r"(?m)^[ \t]*(?:import\b|from[ \t]+\S+[ \t]+import\b|use[ \t]+[\w:]+|(?:const|let|var)[ \t]+\S+[ \t]*=[ \t]*require\()"
    return files.where("content is not null").select("file_id", F.regexp_count("content", F.lit(pattern)).alias("imports"))


def signature_lines(c: DataFrame) -> DataFrame:
    """``id, signature``: the first line of a chunk that names its first symbol, trimmed and without a trailing brace."""
    own = F.try_element_at("defined_symbols", F.lit(1))
    line = F.try_element_at(F.filter(F.split("content", "\r?\n"), lambda x: F.contains(x, own)), F.lit(1))
    return c.where("content is not null").select("id", F.regexp_replace(F.trim(line), r"[ \t]*[{:]$", "").alias("signature")).where("signature is not null")


def skeletons(c: DataFrame) -> DataFrame:
    """``path, entries``: the outline of each file, one line a symbol with its calls and complexity, by line."""
    calls = F.array_join(F.slice(F.array_distinct("referenced_symbols"), 1, 4), ", ")
    entry = F.concat_ws(" | ", F.concat(F.coalesce("start_line", F.lit(0)) + 1, F.lit(" "), F.try_element_at("defined_symbols", F.lit(1))), F.when(calls != "", F.concat(F.lit("-> "), calls)), F.concat(F.lit("C:"), F.coalesce(F.col("complexity").cast("int"), F.lit(0))), F.when(F.col("role") == "ORCHESTRATION", "ORCH"))
    rows = c.where(F.size("defined_symbols") > 0).select("path", F.struct(F.coalesce("start_line", F.lit(0)).alias("l"), "id", entry.alias("e")).alias("s"))
    return rows.groupBy("path").agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["e"]).alias("entries"))


def sql_tables(c: DataFrame) -> DataFrame:
    """``id, operation, table_name``: tables that SQL text in a chunk reads or changes."""
    # fixed values: operation -> how the statement names its table
    forms = {"select": r"(?i)\bselect\b[^;\"']*?\bfrom\s+([A-Za-z_][\w.]*)", "insert": r"(?i)\binsert\s+into\s+([A-Za-z_][\w.]*)", "update": r"(?i)\bupdate\s+([A-Za-z_][\w.]*)\s+set\b", "delete": r"(?i)\bdelete\s+from\s+([A-Za-z_][\w.]*)", "merge": r"(?i)\bmerge\s+into\s+([A-Za-z_][\w.]*)", "create": r"(?i)\bcreate\s+table\s+([A-Za-z_][\w.]*)", "alter": r"(?i)\balter\s+table\s+([A-Za-z_][\w.]*)", "drop": r"(?i)\bdrop\s+table\s+([A-Za-z_][\w.]*)", "truncate": r"(?i)\btruncate\s+table\s+([A-Za-z_][\w.]*)"}
    found = F.concat(*[F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), _named(o)) for o, p in forms.items()])
    return c.where("content is not null").select("id", F.explode(F.array_distinct(found)).alias("f")).select("id", "f.operation", "f.table_name")


def _named(operation: str):
    return lambda x: F.struct(F.lit(operation).alias("operation"), F.lower(x).alias("table_name"))


def hint_lines(c: DataFrame, query: str) -> DataFrame:
    """``id, line, hits``: the line of a chunk that holds the most words of a query; code before comments, then the earliest."""
    import re

    words = sorted(set(re.findall(r"[a-z0-9_]+", query.lower())))
    rows = c.where("content is not null").select("id", F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
    low = F.lower("text")
    hits = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    comment = F.trim("text").rlike(r"^(//|/\*|\*|#)").cast("int")
    best = rows.select("id", "line", hits.alias("hits"), comment.alias("c")).where("hits > 0").groupBy("id").agg(F.max(F.struct("hits", (-F.col("c")).alias("c"), (-F.col("line")).alias("l"))).alias("b"))
    return best.select("id", (-F.col("b.l") + 1).alias("line"), F.col("b.hits").alias("hits"))
