"""Ranked retrieval: vectors, full text, fusion, boosts, late interaction, overlap, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75


def squared_distance(a, b) -> Column:
    """Squared Euclidean distance of two arrays of equal length, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query, k: int, key: str = "vec_id", column: str = "embedding", digits: int = 6) -> DataFrame:
    """``key, distance, similarity``: exact nearest neighbours of one vector; ties by key.

    ``query`` is an array column or a list. Top-k is one pass without a shuffle of the vectors.
    """
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    d = F.round(squared_distance(column, q), digits)
    ranked = vectors.where(F.col(column).isNotNull()).select(F.col(key), d.alias("distance")).orderBy("distance", key).limit(k)
    return ranked.withColumn("similarity", F.round(1 / (1 + F.greatest(F.lit(0.0), "distance")), digits))


def nearest_to(vectors: DataFrame, target, k: int, key: str = "vec_id", column: str = "embedding", least: float | None = None) -> DataFrame:
    """Neighbours of a stored vector, itself left out, with a least similarity if one is given."""
    own = vectors.where(F.col(key) == target).select(F.col(column).alias("_q")).limit(1)
    rows = vectors.where(F.col(key) != target).crossJoin(F.broadcast(own))
    out = nearest(rows, F.col("_q"), k, key, column)
    return out if least is None else out.where(F.col("similarity") >= least)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, term, tf, dl``: the inverted index; null texts have no postings."""
    words = docs.where(F.col(text).isNotNull()).select(F.col(key), tokens(text).alias("w"))
    return words.select(key, F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``term, df``: in how many documents a term occurs."""
    return docs.where(F.col(text).isNotNull()).select(F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, query: str, k: int | None = None, key: str = "doc_id", text: str = "text", digits: int = 6) -> DataFrame:
    """``key, score``: documents with any term of the query, best first, ties by key.

    The corpus is read twice without a shuffle of its texts: lengths, frequencies of the few query
    terms and sizes are aggregates of one row, the score is computed row by row in the JVM.
    """
    terms = sorted(set(_words(query)))
    words = docs.where(F.col(text).isNotNull()).select(F.col(key), tokens(text).alias("w"))
    # of a text only its length and its query terms are kept, so the terms are counted in short lists
    rows = words.select(key, F.size("w").alias("dl"), F.filter("w", lambda x: x.isin(terms)).alias("h"))
    tf = {t: F.size(F.filter("h", _is(t))) for t in terms}
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"), *[F.sum((tf[t] > 0).cast("bigint")).alias(f"df{i}") for i, t in enumerate(terms)])
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + F.when(tf[t] > 0, idf * tf[t] * (K1 + 1) / (tf[t] + K1 * (1 - B + B * F.col("dl") / F.col("avg")))).otherwise(0.0)
    out = rows.crossJoin(F.broadcast(stats)).select(F.col(key), F.round(score, digits).alias("score")).where("score > 0")
    return out if k is None else out.orderBy(F.desc("score"), key).limit(k)


def _is(term: str):
    return lambda x: x == term


def _words(query: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9_]+", query.lower())


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with their 1-based rank. Only for the few rows of a top-k result: the window has one group."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(lists: list[DataFrame], key: str, constant: int = 60, digits: int = 6) -> DataFrame:
    """``key, score, best_rank`` of ranked lists (key, rank) by reciprocal rank."""
    rows = lists[0].select(key, "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select(key, "rank"))
    return rows.groupBy(key).agg(F.round(F.sum(1 / (constant + F.col("rank"))), digits).alias("score"), F.min("rank").alias("best_rank"))


def seed_bonus(path, defined, referenced, best_rank, files=(), symbols=(), file_weight=0.02, def_weight=0.02, ref_weight=0.006, most_rank=8) -> Column:
    """Bonus of a candidate that the seeds name: by file suffix, by definition, else by reference; only near the top."""
    low = F.lower(path)
    named = F.lit(False)
    for f in files:
        named = named | low.endswith(f.strip().lower().lstrip("./"))
    wanted = F.array(*[F.lit(s) for s in symbols]) if symbols else F.array().cast("array<string>")
    part = F.when(F.arrays_overlap(defined, wanted), def_weight).when(F.arrays_overlap(referenced, wanted), ref_weight).otherwise(0.0)
    return F.when((best_rank >= 1) & (best_rank <= most_rank), F.when(named, file_weight).otherwise(0.0) + part).otherwise(0.0)


def structure_boost(intent: str = "GENERAL") -> Column:
    """Factor by the structure of a chunk: its kind, role, references, place and size."""
    refs = F.coalesce(F.size("referenced_symbols"), F.lit(0))
    role = F.coalesce("role", F.lit(""))
    code = F.lit(1.1) * F.when(role == "ORCHESTRATION", 1.5).when(role == "DEFINITION", 1.2).when(role == "IMPLEMENTATION", 1.1).otherwise(1.0)
    code = code * F.when(refs > 5, 1.1).otherwise(1.0) * F.when(refs > 15, 1.25).otherwise(1.0)
    for name, of, factor in (("DEFINITION", "DEFINITION", 1.2), ("FLOW", "ORCHESTRATION", 1.4), ("USAGE", "IMPLEMENTATION", 1.2)):
        if intent == name:
            code = code * F.when(role == of, factor).otherwise(1.0)
    kind = F.coalesce("chunk_type", F.lit("")).isin("function", "class", "method", "interface", "type_alias")
    base = F.when(F.coalesce("is_anchor", F.lit(False)), 0.99).when(kind, code).otherwise(1.0)
    path = F.lower("path")
    test = path.rlike(r"(^|/)(__tests__|tests?|specs?|benchmark)(/|$)") | path.rlike(r"\.(test|spec)\.[cm]?[jt]sx?$")
    docs = (role == "DOCS") | path.rlike(r"\.(md|mdx|txt|json|lock)$") | path.contains("/docs/")
    small = (F.length(F.coalesce("content", F.lit(""))) < 50) & ~F.coalesce("is_exported", F.lit(False))
    return base * F.when(test, 0.5).otherwise(1.0) * F.when(docs, 0.6).otherwise(1.0) * F.when(small, 0.9).otherwise(1.0)


def confidence(score) -> Column:
    return F.when(score > 0.8, "High").when(score > 0.5, "Medium").otherwise("Low")


def without_overlap(hits: DataFrame) -> DataFrame:
    """``hits`` (id, path, start_line, end_line, score) less those that overlap a better one of their file.

    In score order a hit goes when it shares more than half of the shorter range with a hit that
    stays. A file's hits are folded in the JVM; hits are the few rows of a result, not the corpus.
    """
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "start_line", "end_line")))
    kept_type = "array<struct<id:string,s:int,e:int>>"

    def fold(kept, x):
        size = x["end_line"] - x["start_line"]
        clash = F.exists(kept, lambda y: (F.least(x["end_line"], y["e"]) - F.greatest(x["start_line"], y["s"])) > 0.5 * F.least(size, y["e"] - y["s"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(F.struct(x["id"].cast("string").alias("id"), x["start_line"].cast("int").alias("s"), x["end_line"].cast("int").alias("e")))))

    kept = hits.groupBy("path").agg(F.aggregate(order, F.array().cast(kept_type), fold).alias("kept"))
    return hits.join(kept.select(F.explode("kept.id").alias("id")), "id", "left_semi")


def diversified(hits: DataFrame, per_file: int = 3, limit: int | None = None) -> DataFrame:
    """The best ``per_file`` hits of each file, then the best ``limit`` of all."""
    order = Window.partitionBy("path").orderBy(F.desc("score"), "id")
    out = hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_file).drop("_r")
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def max_sim(query: DataFrame, docs: DataFrame, width_check: bool = True) -> DataFrame:
    """``doc, score``: late interaction, for each query token the best document token, summed.

    ``query`` (q, v) is one query, whose tokens are few; ``docs`` (doc, v) has a row a token.
    """
    best = docs.crossJoin(F.broadcast(query.withColumnRenamed("v", "qv"))).select("doc", "q", dot("v", "qv").alias("s"))
    return best.groupBy("doc", "q").agg(F.max("s").alias("m")).groupBy("doc").agg(F.round(F.sum("m"), 6).alias("score"))


def quantised(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``scale`` and ``codes``: the vector at unit length as whole numbers -127..127 of its largest part.

    Norm and scale are columns of their own, so they are computed once a row and not once an element.
    """
    norm = rows.withColumn("_n", F.sqrt(dot(column, column)))
    unit = norm.withColumn("_u", F.transform(column, lambda x: x.cast("double") / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0)))
    scaled = unit.withColumn("scale", F.array_max(F.transform("_u", F.abs)))
    codes = F.transform("_u", lambda x: F.round(x / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0) * 127).cast("int"))
    return scaled.withColumn("codes", codes).drop("_n", "_u")


def stitched(hits: DataFrame, gap: int = 10) -> DataFrame:
    """``path, start_line, end_line, parts``: neighbouring hits of a file merged where at most ``gap`` lines lie between."""
    w = Window.partitionBy("path").orderBy("start_line", "end_line")
    marks = hits.withColumn("_n", F.when(F.col("start_line") > F.lag("end_line").over(w) + gap, 1).otherwise(0))
    isles = marks.withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isles.groupBy("path", "_g").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count(F.lit(1)).alias("parts")).drop("_g")


def concentration(hits: DataFrame, top: int = 10) -> DataFrame:
    """``share``: the largest part of the best ``top`` hits that one file holds."""
    best = hits.orderBy(F.desc("score"), "id").limit(top)
    return best.groupBy("path").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def search(chunks: DataFrame, vectors: DataFrame, query: str, query_vector, scope=None, limit: int = 10, files=(), symbols=(), per_file: int = 3) -> DataFrame:
    """Hybrid search over a chunk corpus, in the order of its stages: scope, two retrievers, fusion, seeds, boosts, overlap, diversity.

    ``vectors`` has (vec_id, embedding); only light columns travel through the ranking, the display
    columns are joined to the final rows.
    """
    from ..functions.text import agreed_intent

    c = chunks if scope is None else chunks.where(scope.condition())
    wide = max(5 * limit, 500)
    near = nearest(vectors.join(c.select("vec_id"), "vec_id", "left_semi"), query_vector, wide)
    near = ranked(near.join(c.select("vec_id", "id"), "vec_id"), "distance", "id").select("id", "rank")
    text = ranked(bm25(c, query, wide, "id", "content"), F.desc("score"), "id").select("id", "rank")
    fused = fuse([near, text], "id").orderBy(F.desc("score"), "best_rank", "id").limit(200)
    light = c.select("id", "path", "start_line", "end_line", "chunk_type", "role", "content", "is_anchor", "is_exported", "defined_symbols", "referenced_symbols")
    rows = fused.join(light, "id")
    bonus = seed_bonus(F.col("path"), F.col("defined_symbols"), F.col("referenced_symbols"), F.col("best_rank"), files, symbols)
    rows = rows.withColumn("score", (F.col("score") + bonus) * 1.5 * structure_boost(agreed_intent(query)))
    shown = diversified(without_overlap(rows.select("id", "path", "start_line", "end_line", "score")), per_file, limit)
    top = shown.agg(F.max("score").alias("_m"))
    out = shown.crossJoin(F.broadcast(top)).withColumn("normalized", F.round(F.col("score") / F.col("_m"), 6))
    return out.select("id", "path", "start_line", "end_line", F.round("score", 6).alias("score"), "normalized", confidence(F.col("normalized")).alias("confidence"))
