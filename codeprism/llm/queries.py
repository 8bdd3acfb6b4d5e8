"""The queries of this package: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, audit, symbols
from ..session import table
from . import documented, generated, packing, prose, residue, similar, split, tokens
from .syntax import files as syntax

CAPACITY = 2048


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "source_files"), table(spark, d, "languages"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "source_files"), table(spark, d, "languages"))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return prose.file_languages(table(spark, d, "source_files"), table(spark, d, "languages"), table(spark, d, "lang_samples"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_shares(spark, d).select("file_id", "lang")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return generated.classified(table(spark, d, "source_files"), table(spark, d, "languages"), table(spark, d, "vendor_catalog"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_reasons(spark, d).select("file_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.similar_pairs(table(spark, d, "embed_responses"), 0.83, 10)


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_chunks(table(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).where(F.col("piece") == 1).select("chunk_id")  # whatever is cut has a second piece


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documented.documented(table(spark, d, "chunks"), table(spark, d, "languages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).select("chunk_id", "function_name").distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), CAPACITY)


def p9_harmonic(spark: SparkSession, d: str) -> DataFrame:
    """Plain harmonic packing, for comparison."""
    return packing.packed(table(spark, d, "documents"), CAPACITY, fill=False)


def near_pairs(spark: SparkSession, d: str, floor: float = 0.83) -> DataFrame:
    """Chunks with the 20 nearest vectors of each, whatever their cosine, and why a pair is no surprise."""
    c = symbols.corpus(table(spark, d, "chunks"), "project_root", "path", "content", "defined_symbols", "referenced_symbols", "type_referenced_symbols", "start_line", "is_exported", "vec_id")
    near = similar.neighbours(table(spark, d, "embed_responses"), 20)
    one, two = (c.where("vec_id is not null").select(F.col("vec_id").alias(v), F.col("id").alias(k)) for v, k in (("id", "x"), ("neighbour", "y")))
    both = near.join(one, "id").join(two, "neighbour").where("x <> y")
    pairs = both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("cosine").alias("similarity"))
    return analytics.surprising_pairs(c, pairs, audit.file_edges(c), floor, 3)


def surprise_vectors(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(spark, d).select("a", "b", "similarity", F.coalesce("reason", F.lit("kept")).alias("reason"))


def surprise_funnel(spark: SparkSession, d: str) -> DataFrame:
    return surprise_vectors(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("pairs"))


def surprise_findings(spark: SparkSession, d: str) -> DataFrame:
    return analytics.file_pair_findings(near_pairs(spark, d))


def p10_reasons(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_content(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_reasons(spark, d).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_shares, p3_found, p3_reasons, p4_found, p5_found, p5_pieces, p6_found, p6_pairs, p8_ids, p9_containers, p9_harmonic, p10_found, p10_reasons, surprise_vectors, surprise_funnel, surprise_findings)}
