"""Reading source trees, registries and commit logs."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES = 2 * 1024 * 1024
# fixed values: what is never indexed, and the extensions that are
IGNORED_NAMES = "node_modules dist build out target __pycache__ coverage venv .venv site-packages .tox .mypy_cache .pytest_cache .next .nuxt .gradle .m2 vendor .git .ssh .gnupg .aws .gcloud .azure .idea .vscode __generated__ Generated fixtures benchmark testdata __fixtures__ __snapshots__".split()
IGNORED_FILES = "*.lock *.bin *.ipynb *.pyc *.onnx *.txt *.log *.csv *.min.js *.min.css *.map *.wasm *.graphql.swift *.pb.go *.pb.cc *.pb.h *_pb2.py *_pb2.pyi *_pb2_grpc.py *.g.dart *.freezed.dart *.gr.dart *.designer.cs *.generated.ts *.generated.tsx package-lock.json yarn.lock pnpm-lock.yaml bun.lockb composer.lock .env .env.* *.key *.pem *.p12 *.pfx *.p8 id_rsa id_ed25519 *.pub *.gpg secrets.* credentials.* .DS_Store *.tmp.* *.sb-* Thumbs.db".split()
EXTENSIONS = ".ts .tsx .js .jsx .mjs .cjs .py .go .rs .java .c .cpp .cc .cxx .h .hpp .rb .php .cs .swift .kt .kts .scala .sc .lua .sh .sql .html .css .dart .el .clj .ex .exs .m .mm .f90 .f95 .json .yaml .yml .toml .xml .md .mdx .gitignore .dockerfile".split()
BARE_NAMES = ("dockerfile", "makefile")

REGISTRY = T.StructType([T.StructField(n, t) for n, t in (("root", T.StringType()), ("name", T.StringType()), ("modelTier", T.StringType()), ("embedMode", T.StringType()), ("lastIndexed", T.StringType()), ("vectorDim", T.IntegerType()), ("chunkCount", T.LongType()), ("status", T.StringType()), ("chunkerVersion", T.IntegerType()))])


def walk(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, mtime_ms, content`` of every file below a root, one row a file, read by the executors."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")


def _pattern(globs) -> str:
    return "|".join(fnmatch.translate(g).removesuffix("\\z").removesuffix("\\Z") for g in globs)


def admitted(files: DataFrame, extra_ignored=()) -> DataFrame:
    """``files`` (path, size) that the policy lets in: no ignored directory or name, a known extension, not empty, not too large."""
    name = F.substring_index("path", "/", -1)
    parts = F.split("path", "/")
    ignored = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, [*IGNORED_NAMES, *extra_ignored])))
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    known = ext.isin(*EXTENSIONS) | F.lower(name).isin(*BARE_NAMES)
    return files.where(~ignored & ~name.rlike(f"^(?:{_pattern(IGNORED_FILES)})$") & known & (F.col("size") > 0) & (F.col("size") <= MOST_BYTES))


def is_binary(content: str):
    """A zero byte among the first 1024."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, 1024)) > 0


def decoded(files: DataFrame) -> DataFrame:
    """Files with text content: binaries left out, bytes that are no UTF-8 replaced, the hash of the bytes kept."""
    rows = files.where(~is_binary("content"))
    return rows.select("path", "size", "mtime_ms", F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The project registry, a JSON array with checked types; a malformed file is an error."""
    return spark.read.schema(REGISTRY).option("multiLine", True).option("mode", "FAILFAST").json(path)


def commits(log: DataFrame, column: str = "value") -> DataFrame:
    """Commits of a log with record (0x1e) and unit (0x1f) separators, ``numstat`` lines behind each.

    ``hash, author, date, subject, files_changed, insertions, deletions, paths``; binary files count 0.
    """
    record = log.select(F.explode(F.split(column, "\x1e")).alias("r")).where(F.length(F.trim("r")) > 0)
    unit = F.split("r", "\x1f")
    stat = F.filter(F.split(F.element_at(unit, -1), "\n"), lambda x: x.rlike(r"^(\d+|-)\t(\d+|-)\t"))
    number = lambda x, i: F.coalesce(F.split(x, "\t")[i].try_cast("int"), F.lit(0))
    rows = record.select(unit[0].alias("hash"), unit[1].alias("author"), unit[2].alias("date"), unit[3].alias("subject"), stat.alias("s"))
    add = lambda i: F.aggregate("s", F.lit(0), lambda a, x: a + number(x, i))
    return rows.select(F.trim("hash").alias("hash"), "author", "date", "subject", F.size("s").alias("files_changed"), add(0).alias("insertions"), add(1).alias("deletions"), F.transform("s", lambda x: F.split(x, "\t")[2]).alias("paths"))


def churn(log: DataFrame) -> DataFrame:
    """``path, commits``: how many commits touched a file."""
    return log.select("hash", F.explode("paths").alias("path")).groupBy("path").agg(F.countDistinct("hash").alias("commits"))


def touched(log: DataFrame, paths: list[str]) -> DataFrame:
    """Commits that touched any of the paths."""
    return log.where(F.arrays_overlap("paths", F.array(*map(F.lit, paths))))


