"""Generated, minified, vendored and data-only source files.

Each file is read once. Its tokens give two MinHash signatures of their shingles: one with identifiers
and literals masked, which tells the shape, and one of the tokens as they stand. Files whose masked
signatures agree form clusters (banding, verification, components, see ``clusters``), and clusters are
what is judged: by the number of their repositories, their share of literals, and how many of their
members carry a tool's mark, stand on minified lines or hold nothing but literals. What a file shows by
itself (leading comments, name, path, shape) only confirms its cluster's verdict for it; a file that is
like no other is a cluster of one, which its own evidence decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .clusters import bands, components, links, stacked
from .syntax.files import valid, with_language

SHINGLE, BANDS, ROWS = 5, 16, 16
#: Places that are compared, and their share that must be equal.
PLACES, AGREE = 128, 0.85
#: Places over shingles as they stand, by which copies are told from files of one shape, and rows of their bands.
NAMED_PLACES, NAMED_ROWS, NAMED_AGREE = 30, 3, 0.5
#: A file of fewer different named shingles is a copy only of a file in the catalog, and only if all places agree.
LEAST_SHINGLES = 24
#: Share of the tokens of a cluster from which it is one of literals, and of its members from which their mark is its own.
LITERAL, MARKED = 0.85, 0.5
MASKED_KEYWORDS = frozenset("if else for while do switch case default break continue return try catch finally throw new class struct enum interface impl trait fn func function def async await import from export package use const let var static public private protected void in of as with match loop yield lambda pass raise except elif and or not is".split())

TOKENS = {
    False: re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|[^\W\d]\w*|\d[\w.]*|[^\w\s]"),
    True: re.compile(r"\#[^\n]*|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\W\d]\w*|\d[\w.]*|[^\w\s]"),
}
LEADING = re.compile(r"﻿?(?:#!(?!\[)[^\n]*\n)?((?:\s*(?://[^\n]*|#(?![!\[])[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''))*)")
MARKS = re.compile(r"^[\s/*#!\"'<;-]*", re.M)

# fixed values: how tools sign what they write, at the start of a line of a leading comment
SIGNED = re.compile(
    r"^(?:@generated\b|(?:code|file|source) (?:is |was )?(?:auto-?|automatically )?generated (?:by|from)\b|auto-?generated\b(?! (?:file|code|client|source)s? (?:are|is|live))|\*- machine-generated|machine-generated\b"
    r"|(?:this|the) (?:file|code|source|module) (?:is|was|has been) (?:automatically |auto-?|machine )?(?:generated|produced|created|written) (?:by|from|with)\b"
    r"|generated (?:by|from|with|automatically)\b|automatisch (?:aus|von|mit) .*\b(?:erzeugt|generiert)|(?:diese datei|datei) .*\b(?:automatisch|generiert|erzeugt)"
    r"|(?:ce )?fichier (?:produit|généré|créé)\b|(?:este )?(?:archivo|fichero|arquivo|ficheiro) (?:generado|gerado|producido|produzido)\b|(?:file|codice) generato\b|(?:dit )?bestand .*gegenereerd|(?:ten )?plik .*wygenerowan"
    r"|(?:этот )?файл .*(?:сгенерирован|создан)|(?:本|此)?文件由.*(?:生成|产生)|(?:この)?ファイルは.*生成|이 ?파일은 .*생성|[\w.-]+: output of \S+)",
    re.I | re.M,
)
FORBID = re.compile(r"\bDO NOT (?:EDIT|MODIFY)\b|(?:bitte )?nicht von hand (?:ändern|bearbeiten)|ne pas (?:le |la )?modifier|no (?:lo )?(?:editar|modificar)\b|não (?:editar|edite|modificar)|non modificare|niet (?:handmatig )?(?:bewerken|wijzigen)|nie (?:edytować|zmieniać)|не (?:редактир|измен)\w+|请勿(?:编辑|修改|手动)|編集しない|수정하지 ?마", re.I)
TRAILER = re.compile(r"@@[\w-]+:eof@@|\bend of (?:generated )?output\b.*\b(?:digest|checksum|hash)=|@generated-end|<end-generated", re.I)
NAMED = re.compile(r"(?:[._-]generated|\.gen|\.g|\.pb|_pb2|_pb2_grpc|\.designer|OuterGen|OuterClass|\.min|[.-]bundle)\.\w+$|[.-]bundle\.", re.I)
PLACED = re.compile(r"/(?:__generated__|autogen|gen-out|generated|gen-src|auto_generated)/", re.I)
FOREIGN_PLACE = re.compile(r"/(?:vendor|third_party|third-party|3rdparty|external|node_modules|bower_components|deps)/", re.I)
LEGAL = re.compile(r"\b(?:licen[cs]ed?|copyright|all rights reserved|governed by|released under)\b|\(c\)|©|SPDX", re.I)


def leading(text: str) -> str:
    """The comments in front of the first code, without their marks."""
    m = LEADING.match(text)
    return MARKS.sub("", m.group(1)) if m else ""


def own_evidence(path: str, root: str | None, language: str, text: str, house: str) -> str | None:
    """What a file shows by itself: generated, vendored, minified, data, or nothing."""
    rel = path[len(root) :] if root and path.startswith(root) else path
    if language == "json":
        return "data" if json_data(text) else None
    head = leading(text)
    if SIGNED.search(head) or FORBID.search(head) and re.search(r"generat|erzeugt|produ|schema|生成|생성|сгенер|output", head, re.I) or TRAILER.search(text[-300:]) or NAMED.search(rel) or PLACED.search(rel):
        return "generated"
    if FOREIGN_PLACE.search(rel) or LEGAL.search(head) and house.lower() not in head.lower():
        return "vendored"
    if len(text) > 400 and minified(text):
        return "minified"
    return "data" if data_only(text) else None


def minified(text: str) -> bool:
    """Most code stands on very long lines, in short names and with next to no blanks."""
    long = [x for x in text.split("\n") if len(x) > 250]
    if sum(map(len, long)) < 0.7 * len(text):
        return False
    code = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|/\*[\s\S]*?\*/|//.*", "", " ".join(long))
    names = re.findall(r"[^\W\d]\w*", code)
    names = [x for x in names if x not in MASKED_KEYWORDS]
    return len(names) > 40 and sum(len(x) <= 2 for x in names) > 0.45 * len(names) and sum(c.isspace() for c in code) < 0.12 * len(code)


def data_only(text: str) -> bool:
    """Numbers or one long string make up the file; a short table of numbers beside code does not."""
    strings = re.findall(r"\"((?:[^\"\\\n]|\\.){400,})\"|'((?:[^'\\\n]|\\.){400,})'|`([^`]{400,})`", text) if "`" in text or max(map(len, text.split("\n"))) > 400 else ()
    packed = sum(len(s) for group in strings for s in group if s and not re.search(r"\s", s[:200]))
    if packed > 0.6 * len(text):
        return True
    if sum(map(text.count, "0123456789")) < 150:
        return False
    words, numbers = 0, 0
    for t in re.findall(r"[^\W\d]\w*|\d[\w.]*", text):
        numbers += t[0].isdigit()
        words += not t[0].isdigit()
    return numbers >= 150 and numbers > 3 * words


def json_data(text: str) -> bool:
    """A lock file or a dump of numbers; settings are neither."""
    keys = len(re.findall(r'"(?:integrity|checksum|sha\d+|hash|digest)"\s*:\s*"(?:sha\d+-)?[\w+/=:-]{32,}"', text))
    if keys >= 5 or re.search(r'"(?:lock|lockfile|lockfileVersion|lock_version)"\s*:', text) and re.search(r'"(?:resolved|packages|dependencies)"\s*:', text):
        return True
    numbers = len(re.findall(r"(?<![\w.\"])-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w\"])", text))
    return numbers >= 150 and numbers > 10 * text.count('"')


class _Masks(dict):
    """Token -> two hashes in one number: identifiers and literals masked in the upper half, kept in the lower."""

    def __missing__(self, t):
        c = t[0]
        if t.startswith(("//", "/*", '"""', "'''")) or c == "#" and len(t) > 1:
            h = 0
        elif c.isalpha() or c == "_":
            h = _hash(t if t in MASKED_KEYWORDS else "a") << 32 | _hash(t)
        elif c.isdigit() or c in "\"'`" and len(t) > 1:
            h = (NUMBER if c.isdigit() else STRING) << 32 | _hash(t)
        else:
            h = _hash(t) << 32 | _hash(t)
        if len(t) < 40:
            if len(self) > 200_000:
                self.clear()
            self[t] = h
        return h


def _hash(t: str) -> int:
    return xxhash.xxh32_intdigest(t) | 1


NUMBER, STRING, NAME = _hash("0"), _hash('""'), _hash("a")


@lru_cache(maxsize=1)
def _tools():
    rng = np.random.default_rng(11)
    n = BANDS * ROWS + NAMED_PLACES
    odd = rng.integers(1, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flips = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    powers = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
    return _Masks(), odd, flips, powers


def _shingles(h: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """32-bit hashes of five tokens in a row; of a shorter text, of all its tokens."""
    n = min(SHINGLE, len(h))
    with np.errstate(over="ignore"):
        s = sum(h[i : len(h) - n + 1 + i] * powers[i] for i in range(n))
        s ^= s >> np.uint64(31)
    return (s >> np.uint64(16)).astype(np.uint32)


def _places(s: np.ndarray, odd: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """The least value of each permutation of 32 bits, of which the lower half is kept."""
    places = np.full(len(odd), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(s), 1024):
        places = np.minimum(places, ((s[i : i + 1024, None] ^ flips) * odd).min(axis=0))
    return places.astype(np.uint16)


def signature(text: str, python: bool) -> tuple[np.ndarray, np.ndarray, int, float] | None:
    """(masked places, named places, different named shingles at least, share of literals); None without any token."""
    masks, odd, flips, powers = _tools()
    h = np.fromiter(map(masks.__getitem__, TOKENS[python].findall(text)), np.uint64)
    h = h[h != 0]
    if not len(h):
        return None
    shape, named = h >> np.uint64(32), _shingles(h & np.uint64(0xFFFFFFFF), powers)
    kinds = len(np.unique(named[:256]))
    if kinds < LEAST_SHINGLES and len(named) > 256:
        kinds = len(np.unique(named))
    literal = int(((shape == NUMBER) | (shape == STRING)).sum())
    words = int((shape == NAME).sum())
    n = BANDS * ROWS
    return _places(np.unique(_shingles(shape, powers)), odd[:n], flips[:n]), _places(named, odd[n:], flips[n:]), kinds, literal / max(1, literal + words)


def classified(files: DataFrame, languages: DataFrame, catalog: DataFrame, key: str = "file_id", house: str = "Lantern Works") -> DataFrame:
    """``key, reason, cluster, cluster_files`` of every file that is not hand-written.

    reason is generated, vendored, minified or data; cluster_files counts the files of the cluster, with
    those of the catalog. Files that do not parse, have no content or an unknown extension are left out;
    a repeated delivery gives one row. ``house`` is the name in the notices that the projects' own files carry.
    """
    kind = files.schema[key].dataType.simpleString()
    rows = with_language(files.select(F.col(key).alias("_k"), "project_root", "path", "content").where("content is not null and path is not null"), languages)
    known = with_language(catalog.select(F.lit(None).cast(kind).alias("_k"), F.lit(None).cast("string").alias("project_root"), F.col("file_name").alias("path"), "content").where("content is not null"), languages)
    columns = ["_k", "project_root", "path", "language", "content"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owns, shapes, at, nameds, sizes, literals = [], [], [], [], [], []
            for i, (k, root, path, lang, text) in enumerate(zip(*(b.column(i).to_pylist() for i in range(5)))):
                own = None if k is None else own_evidence(path, root, lang, text, house)
                if own and not valid(lang, text):
                    continue
                if sig := signature(text, lang == "python"):
                    at.append(i), owns.append(own), shapes.append(sig[0]), nameds.append(sig[1].tobytes()), sizes.append(sig[2]), literals.append(sig[3])
            places = np.array(shapes, np.uint16).reshape(len(at), BANDS * ROWS)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands(places, ROWS).ravel()))
            u = [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in places]
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), pa.array(owns, pa.string()), pa.array(u, pa.int64()), keys, pa.array([x.tobytes() for x in places[:, :PLACES]], pa.binary()), pa.array(nameds, pa.binary()), pa.array(sizes, pa.int32()), pa.array(literals, pa.float64())],
                ["_k", "root", "own", "u", "keys", "sig", "named", "shingles", "literal"],
            )

    seen = materialised(rows.select(*columns).unionByName(known.select(*columns)).mapInArrow(read, f"_k {kind}, root string, own string, u bigint, keys array<bigint>, sig binary, named binary, shingles int, literal double"))
    units = seen.select("u", "keys", "sig").dropDuplicates(["u"])
    linked = components(links(units, AGREE))
    member = seen.drop("keys", "sig").join(linked, "u", "left").withColumn("c", F.coalesce("c", "u"))
    stats = cluster_stats(member)
    member = materialised(member.join(stats, "c").where("files > 1").select("c", "_k", "root", "own", "named", "shingles"))
    told = judged(stats, member.drop("named", "shingles"), copies(member))
    # a cluster of one, and a member that its cluster says nothing of, is decided by what it shows itself
    alone = seen.where("own is not null").select("_k", "own", F.lit(None).cast("bigint").alias("cluster"))
    found = told.select("_k", "reason", "own", "c", "files")
    by_self = alone.join(found.select("_k"), "_k", "left_anti").select("_k", F.col("own").alias("reason"), "own", F.col("cluster").alias("c"), F.lit(1).cast("bigint").alias("files"))
    found = found.unionByName(by_self)
    # files without evidence of their own have not been parsed yet; those few are looked up again
    later = rows.select("_k", "language", "content").join(found.where("own is null").dropDuplicates(["_k"]), "_k").select("_k", "language", "content", "reason", "c", "files")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [valid(lang, t) for lang, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in (0, 3, 4, 5)], ["_k", "reason", "c", "files"]).filter(pa.array(ok, pa.bool_()))

    parsed = found.where("own is not null").select("_k", "reason", "c", "files").unionByName(later.mapInArrow(parse, f"_k {kind}, reason string, c bigint, files bigint"))
    best = F.max(F.struct("files", "reason", "c")).alias("b")
    return parsed.groupBy("_k").agg(best).select(F.col("_k").alias(key), "b.reason", F.col("b.c").alias("cluster"), F.col("b.files").alias("cluster_files"))


def cluster_stats(member: DataFrame) -> DataFrame:
    """``c, files, literal, generated, minified, data``: size of a cluster, mean share of literals, shares of marked members."""
    share = [F.avg((F.coalesce("own", F.lit("")) == w).cast("int")).alias(w) for w in ("generated", "minified", "data")]
    return member.groupBy("c").agg(F.count(F.lit(1)).alias("files"), F.avg("literal").alias("literal"), *share)


def copies(member: DataFrame, cell_rows: int = 2000) -> DataFrame:
    """``_k, foreign, tool``: whether a member's own wording stands in the catalog, a vendored file or another repository, or in a generated file.

    Members of a cluster with one named signature are one node, which knows its first and last repository and
    whether the catalog, a vendored or a generated file is among them. The nodes are banded in turn, and every two
    nodes of a bucket are compared; a node learns from all that it agrees with, and only those minima and maxima
    leave a task. A bucket of more than ``cell_rows`` nodes is cut into blocks, a cell for each two of them.
    """
    kind = member.schema["_k"].dataType.simpleString()
    knows = ["lo", "hi", "cat", "ven", "gen"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = bands(stacked(b.column(2)), NAMED_ROWS) if b.num_rows else np.zeros((0, 1), np.int64)
            at = pa.array(np.repeat(np.arange(len(h)), h.shape[1]))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(b.num_columns)), pa.array(h.ravel())], [*b.schema.names, "band"])

    rows = member.select("c", "_k", F.coalesce("root", F.lit("")).alias("root"), F.coalesce("own", F.lit("")).alias("own"), "named", "shingles", F.xxhash64("named").alias("v"))
    file = F.col("_k").isNotNull()
    nodes = rows.groupBy("c", "v").agg(
        F.first("named").alias("named"),
        F.min(F.when(file, F.col("root"))).alias("lo"),
        F.max(F.when(file, F.col("root"))).alias("hi"),
        F.max(~file).alias("cat"),
        F.max(F.col("own") == "vendored").alias("ven"),
        F.max(F.col("own") == "generated").alias("gen"),
    )
    nodes = materialised(nodes)
    told = (F.min("lo") != F.max("hi")) | F.max("cat") | F.max("ven") | F.max("gen")
    some = nodes.groupBy("c").agg(F.count(F.lit(1)).alias("n"), told.alias("told")).where("n > 1 and told").select("c")  # else there is nothing to learn
    each = nodes.join(some, "c").mapInArrow(keys, "c bigint, v bigint, named binary, lo string, hi string, cat boolean, ven boolean, gen boolean, band bigint")
    buckets = each.groupBy("c", "band").agg(F.count(F.lit(1)).alias("n"), told.alias("told"))
    buckets = buckets.where("n > 1 and told").select("c", "band", F.ceil(F.col("n") / cell_rows).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("v", F.lit(1)), F.col("blocks")).cast("int")
    cells = each.join(buckets, ["c", "band"]).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("c", "band", F.least("block", "other"), F.greatest("block", "other"))
    cells = cells.select(cell.alias("cell"), (F.col("block") != F.col("other")).alias("two"), (F.col("block") > F.col("other")).alias("second"), "c", "v", "named", *knows)
    cells = cells.repartition("cell").sortWithinPartitions("cell", "second")
    learnt = cells.mapInArrow(compared, "c bigint, v bigint, lo string, hi string, cat boolean, ven boolean, gen boolean")
    known = nodes.select("c", "v", *knows, F.col("cat").alias("equal")).unionByName(learnt.withColumn("equal", F.lit(False)))
    known = known.groupBy("c", "v").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.max(x).alias(x) for x in (*knows[2:], "equal")])
    enough, others = F.col("shingles") >= LEAST_SHINGLES, (F.col("lo") != F.col("root")) | (F.col("hi") != F.col("root"))
    found = rows.where(file).join(known, ["c", "v"]).select("_k", (F.col("equal") | enough & (F.col("cat") | F.col("ven") | others)).alias("foreign"), (enough & F.col("gen")).alias("tool"))
    return found.groupBy("_k").agg(F.max("foreign").alias("foreign"), F.max("tool").alias("tool"))


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``c, v, lo, hi, cat, ven, gen``: what each node learns from the nodes of its cell that it agrees with.

    Rows come by cell; one of two blocks has the first block's rows first, and pairs across the two alone count.
    """
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        cell = t["cell"].to_numpy()
        whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
        rest = t.slice(whole)
        if whole:
            yield from _learnt(t.slice(0, whole))
    if rest is not None and rest.num_rows:
        yield from _learnt(rest)


def _learnt(t: pa.Table) -> Iterator[pa.RecordBatch]:
    n = t.num_rows
    cell, two, second = (t[x].to_numpy() for x in ("cell", "two", "second"))
    sig = stacked(t["named"])
    roots = sorted({x for c in ("lo", "hi") for x in t[c].unique().to_pylist() if x is not None})
    number = {x: i for i, x in enumerate(roots)}
    lo = np.array([number.get(x, len(roots)) for x in t["lo"].to_pylist()])
    hi = np.array([number.get(x, -1) for x in t["hi"].to_pylist()])
    flags = [t[x].to_numpy() for x in ("cat", "ven", "gen")]
    end = np.searchsorted(cell, cell, side="right")
    of = np.unique(cell, return_inverse=True)[1]
    middle = np.searchsorted(cell, cell) + np.bincount(of, ~second).astype(np.int64)[of]
    start = np.where(two, middle, np.arange(n) + 1)
    pairs = np.where(two & second, 0, end - start)
    low, high, seen, any_of = lo.copy(), hi.copy(), np.zeros(n, bool), [f.copy() for f in flags]
    upto = np.cumsum(pairs)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + 200_000, side="right")))
        left = np.repeat(np.arange(i, j), pairs[i:j])
        right = np.arange(len(left)) - np.repeat(upto[i:j] - pairs[i:j] - (upto[i - 1] if i else 0), pairs[i:j]) + start[left]
        ok = (sig[left] == sig[right]).sum(axis=1) >= NAMED_AGREE * sig.shape[1]
        for a, z in ((left[ok], right[ok]), (right[ok], left[ok])):
            seen[a] = True
            np.minimum.at(low, a, lo[z])
            np.maximum.at(high, a, hi[z])
            for f, every in zip(flags, any_of):
                every[a[f[z]]] = True
        i = j
    at = np.flatnonzero(seen)
    names = np.array([*roots, None], object)
    columns = [t["c"].to_numpy()[at], t["v"].to_numpy()[at]]
    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(names[low[at]], pa.string()), pa.array(names[high[at]], pa.string()), *(pa.array(x[at]) for x in any_of)], ["c", "v", "lo", "hi", "cat", "ven", "gen"])


def judged(stats: DataFrame, member: DataFrame, copied: DataFrame) -> DataFrame:
    """``_k, own, reason, c, files`` of the members that the verdict on their cluster holds for."""
    own = F.coalesce("own", F.lit(""))
    reason = (
        F.when((F.col("literal") >= LITERAL) & (own == "data"), "data")
        .when((F.col("generated") >= MARKED) & ((own == "generated") | F.col("tool")), "generated")
        .when((F.col("minified") >= MARKED) & (own == "minified"), "minified")
        .when((F.col("generated") + F.col("minified") + F.col("data") >= MARKED) & own.isin("generated", "minified", "data"), own)
        .when(F.col("foreign") & (F.col("literal") < LITERAL), F.when(own.isin("generated", "minified", "data"), own).otherwise("vendored"))
        .when(F.col("tool"), "generated")
    )
    rows = member.where("_k is not null").join(stats, "c").join(copied, "_k", "left").withColumn("foreign", F.coalesce("foreign", F.lit(False))).withColumn("tool", F.coalesce("tool", F.lit(False)))
    return rows.select("_k", "own", reason.alias("reason"), "c", "files").where("reason is not null")
