"""Source files that do not parse, as an operator over DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hosted
from .elements import without_elements

#: language of the table `languages` -> module with its grammar
GRAMMARS = {"json": "data", "typescript": "script", "tsx": "script", "javascript": "script", "go": "golang", "rust": "rust", "java": "java"}
LEAD = re.compile(r"\A﻿?(?:#!(?![ \t]*\[)[^\n]*)?")
PIECE = 1 << 18


@lru_cache(maxsize=8)
def grammar(language: str):
    from importlib import import_module

    return import_module(f"{__package__}.{GRAMMARS[language]}").LANGUAGE


def plain(language: str, text: str) -> str:
    """``text`` without byte-order mark, ``#!`` line and carriage returns, elements of JSX replaced."""
    text = LEAD.sub("", text, count=1) if language != "json" else text.removeprefix("\ufeff")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return without_elements(text) if language in ("tsx", "javascript") else text


def valid(language: str, text: str) -> bool:
    """Whether a whole file is valid. A byte-order mark and a ``#!`` line in front are; so is nothing at all.

    Python is judged by the host's parser. Any other file is one piece: of its map the entry for the
    state at the start of a file is made, and reduced.
    """
    if language == "python":
        return hosted.python_valid(LEAD.sub("", text, count=1))
    return grammar(language).valid(plain(language, text))


def cut(language: str, text: str, size: int = PIECE) -> list[str]:
    """Pieces of about ``size`` characters that begin with a line, between two tokens."""
    out, start = [], 0
    if len(text) > size:
        for at in grammar(language).lines(text):
            if at - start >= size:
                out.append(text[start:at])
                start = at
    return [*out, text[start:]]


def with_language(files: DataFrame, languages: DataFrame) -> DataFrame:
    """``files`` with ``language``, by the extension of ``path`` without regard to case; others are left out."""
    known = languages.select(F.explode("extensions").alias("_e"), F.col("lang_id").alias("language")).select(F.lower("_e").alias("_e"), "language")
    known = known.groupBy("_e").agg(F.min("language").alias("language"))  # an extension names one language
    return files.withColumn("_e", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))).join(F.broadcast(known), "_e").drop("_e")


def verdicts(files: DataFrame, languages: DataFrame, key: str = "file_id", long: int = 4 * PIECE) -> DataFrame:
    """``key, project_root, language, valid`` of every file whose content and language are known.

    Null contents, null paths and unknown extensions give no row; a repeated delivery gives one row.
    A file of more than ``long`` characters, but for Python, is cut into pieces between tokens, which are
    spread over all tasks, mapped on their own, and put together by an associative reduction; the verdict
    is that of the whole file.
    """
    rows = with_language(files.select(F.col(key).alias("_k"), "project_root", "path", "content").where("content is not null"), languages)
    rows = rows.select("_k", "project_root", "language", "content")
    pieced = (F.length("content") > long) & (F.col("language") != "python")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [valid(lang, t) for lang, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(good, pa.bool_())], ["_k", "project_root", "language", "valid"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (lang, t) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                parts = cut(lang, plain(lang, t), min(PIECE, long))
                n = len(parts)
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([one.column(0)] * n), pa.concat_arrays([one.column(1)] * n), pa.array([lang] * n), pa.array(range(n), pa.int32()), pa.array(parts)], ["_k", "project_root", "language", "piece", "text"])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [json.dumps(grammar(lang).piece(t)) for lang, t in zip(b.column(2).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(maps)], ["_k", "project_root", "language", "piece", "map"])

    def reduce(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("piece").sort_values("piece")
        lang = grammar(part["language"].iloc[0])
        maps = [{s: tuple(v) for s, v in json.loads(m).items()} for m in part["map"]]
        while len(maps) > 1:  # neighbours first, so that no text is reduced more than log(n) times
            maps = [lang.joined(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return part[["_k", "project_root", "language"]].head(1).assign(valid=lang.whole(*maps[0][""]))

    kind = files.schema[key].dataType.simpleString()
    head = f"_k {kind}, project_root string, language string"
    short = rows.where(~pieced).mapInArrow(judge, f"{head}, valid boolean")
    pieces = rows.where(pieced).mapInArrow(split, f"{head}, piece int, text string").repartition("_k", "piece")
    far = pieces.mapInArrow(summarise, f"{head}, piece int, map string").groupBy("_k").applyInPandas(reduce, f"{head}, valid boolean")
    return short.unionByName(far).withColumnRenamed("_k", key)


def invalid_files(files: DataFrame, languages: DataFrame, key: str = "file_id") -> DataFrame:
    """``key`` of every invalid file, once."""
    return verdicts(files, languages, key).where(~F.col("valid")).select(key).distinct()


def rates(files: DataFrame, languages: DataFrame, key: str = "file_id") -> DataFrame:
    """``project_root, language, files, invalid, rate`` over distinct files; a null root is a group of its own."""
    once = verdicts(files, languages, key).dropDuplicates([key])
    bad = F.sum((~F.col("valid")).cast("long"))
    return once.groupBy("project_root", "language").agg(F.count(F.lit(1)).alias("files"), bad.alias("invalid"), F.round(bad / F.count(F.lit(1)), 6).alias("rate"))
