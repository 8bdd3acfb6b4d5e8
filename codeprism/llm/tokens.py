"""Encoding with a public byte-level BPE vocabulary.

Words are cut with the vocabulary's own pattern. A short word is merged with a contiguous rank array:
the boundaries of its parts and, beside them, the rank of each adjacent pair; the lowest rank is found
by a scan, the boundary between the pair is deleted, and the two neighbouring ranks are looked up
again. A long word (no blanks for hundreds of bytes) keeps the same ranks in a heap, since repeated
scans would take quadratic time. Words repeat, so their ids are kept in a bounded table per worker.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_RANK = 1 << 60
#: Bytes up to which a word is merged by scans, and up to which its ids are kept.
SCAN_BYTES, KEPT_CHARS, KEPT_WORDS = 128, 48, 150_000


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def scan_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``word`` by the contiguous rank array."""
    bounds = list(range(len(word) + 1))
    get = ranks.get
    pair = [get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pair:
        low = min(pair)
        if low == NO_RANK:
            break
        i = pair.index(low)
        del bounds[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(word[bounds[i] : bounds[i + 2]], NO_RANK)
        if i:
            pair[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long ``word``: the same merges, lowest rank first and leftmost among equals."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once the start is merged away
    before = list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


class _Words(dict):
    """Ids by word, bounded: when it is full it starts anew."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8", "surrogatepass")
        if (whole := self.ranks.get(data)) is not None:
            ids: tuple[int, ...] = (whole,)
        else:
            ids = tuple((scan_merge if len(data) <= SCAN_BYTES else heap_merge)(data, self.ranks))
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cut = regex.compile(pattern).findall
        self.words = _Words(self.ranks)

    def ids(self, text: str | None) -> list[int]:
        """The ids of ``text``; an empty and a null text both have the empty list."""
        return list(chain.from_iterable(map(self.words.__getitem__, self.cut(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.words.__getitem__, self.cut(text)))) if text else 0


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str | None = None) -> Encoder:
    """One encoder per worker and vocabulary."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    return Encoder(path, pattern)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key, ids``: the token ids of every row, without special tokens.

    Strings that look like special tokens are ordinary text. Empty and null texts get the empty list,
    an unpaired surrogate cannot occur in a Spark string. Rows are kept as they are: repeats stay.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            lists = [enc.ids(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("_t")).mapInArrow(run, f"{key} {kind}, ids array<int>")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key, n_tokens``: the size of every row in tokens; 0 for empty and null texts."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.count(t) for t in b.column(1).to_pylist()], pa.int64())], [key, "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("_t")).mapInArrow(run, f"{key} {kind}, n_tokens bigint")
