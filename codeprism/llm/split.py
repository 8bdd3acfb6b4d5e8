"""Oversized chunks cut into pieces at natural boundaries, by dynamic programming.

Boundary positions are the starts of lines, and inside a line that alone is over the limit also the
places after spaces and punctuation, failing these any character. For every position the cheapest
way to end a piece there is kept: the cost of a cut is small at blank lines, at the start of a
top-level definition and at shallow indentation, and large inside a line; the cost of a piece is the
square of its distance from the even size. A piece is at most ``max_lines`` lines and ``max_chars``
characters, its overlap with the piece before it included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPENS = re.compile(r"\s*(?:export|public|private|protected|static|async|pub|def|class|func|fn|function|impl|interface|struct|enum|type|const|let|var|@|#\[|//|/\*|#)")
SOFT = re.compile(r"(?<=[\s,;:(){}\[\]])")


def lines_of(text: str) -> list[str]:
    """Lines with their ends (LF or CRLF); an end at the very end opens no further line."""
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def units(lines: list[str], room: int) -> list[tuple[int, str, float]]:
    """Pieces that are never cut: (line, text, cost of a cut in front of it)."""
    out, above, before = [], 0, ""
    for n, line in enumerate(lines):
        bare = line.strip()
        deep = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
        cost = 1.0 + 0.5 * (deep // 2) + (0 if before == "" and n else 1.5) - (1.0 if bare and OPENS.match(line) else 0) + (3.0 if bare[:1] in ")}]" else 0)
        if before.endswith(("}", "end", "};")) and bare:
            cost -= 0.5
        before = bare
        if len(line) <= room:
            out.append((n, line, max(cost, 0.1)))
            continue
        start = 0
        while start < len(line):  # an overlong line: cut after the last soft place, else hard
            stop = min(len(line), start + room)
            if stop < len(line):
                soft = [m.start() for m in SOFT.finditer(line, start + room // 2, stop)]
                if soft and soft[-1] > start:
                    stop = soft[-1]
                elif line[stop - 1 : stop + 1] == "\r\n":
                    stop -= 1
            out.append((n, line[start:stop], max(cost, 0.1) if not start else 12.0))
            start = stop
    return out


def pieces(text: str, max_lines: int = 75, max_chars: int = 2000, overlap_lines: int = 10, overlap_chars: int = 200) -> list[tuple[int, int, int, int]]:
    """``(first line, last line, start, stop)`` of every piece, in characters of ``text``.

    The pieces cover the text. Each but the first begins with whole units of the end of the piece
    before it: as many as fit in ``overlap_lines`` lines and ``overlap_chars`` characters, so an
    overlap ends where a line is too long for it. A text within the limits is one piece.
    """
    lines = lines_of(text)
    if not lines:
        return [(0, 0, 0, len(text))]
    if len(lines) <= max_lines and len(text) <= max_chars:
        return [(0, len(lines) - 1, 0, len(text))]
    parts = units(lines, min(overlap_chars, max_chars // 4) if len(text) / len(lines) > max_chars / 4 else max_chars - overlap_chars)
    at = np.concatenate(([0], np.cumsum([len(p[1]) for p in parts]))).tolist()
    line = [p[0] for p in parts]
    n = len(parts)
    back = [0] * n  # where a piece that is cut in front of unit i really starts
    j = 0
    for i in range(n):
        while at[i] - at[j] > overlap_chars or line[i] - line[j] > overlap_lines:
            j += 1
        back[i] = j
    even_lines, even_chars = max_lines - overlap_lines, max_chars - overlap_chars
    count = max(1, -(-len(text) // even_chars), -(-len(lines) // even_lines))
    goal_chars, goal_lines = len(text) / count, len(lines) / count
    best, prior = [float("inf")] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    low = 0
    for stop in range(1, n + 1):
        while low < stop and (at[stop] - at[back[low]] > max_chars or line[stop - 1] - line[back[low]] + 1 > max_lines):
            low += 1
        for i in range(low, stop):
            size = max((at[stop] - at[i]) / goal_chars, (line[stop - 1] - line[i] + 1) / goal_lines)
            cost = best[i] + 2.0 + 6.0 * (size - 1) ** 2 + (parts[stop][2] if stop < n else 0)
            if stop < n and back[stop] <= back[i]:
                cost += 1000.0  # the next piece would repeat all of this one
            if cost < best[stop]:
                best[stop], prior[stop] = cost, i
    cuts, i = [], n
    while i:
        cuts.append((prior[i], i))
        i = prior[i]
    return [(line[back[a]], line[b - 1], at[back[a]], at[b]) for a, b in reversed(cuts)]


def oversized(chunks: DataFrame, max_lines: int = 75, max_chars: int = 2000) -> DataFrame:
    """Chunks over a limit; the test stays in the JVM. A null content is never over it."""
    body = F.regexp_replace("content", r"\n\z", "")
    lines = F.when(F.length("content") == 0, 0).otherwise(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1)
    return chunks.where((F.length("content") > max_chars) | (lines > max_lines))


def split_chunks(chunks: DataFrame, max_lines: int = 75, max_chars: int = 2000, overlap_lines: int = 10, overlap_chars: int = 200) -> DataFrame:
    """``chunk_id, piece, start_line, end_line, start_char, n_chars, content`` of the oversized chunks.

    Lines count from the chunk's own start (``start_line`` where that is a line number, else 0),
    0-based and both ends inclusive. A repeated chunk is cut once; null ids are left out.
    """
    names = ["chunk_id", "piece", "start_line", "end_line", "start_char", "n_chars", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, first, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                for p, (a, z, start, stop) in enumerate(pieces(text, max_lines, max_chars, overlap_lines, overlap_chars)):
                    rows.append((key, p, first + a, first + z, start, stop - start, text[start:stop]))
            cols = [*zip(*rows)] or [[]] * 7
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    first = F.when(F.col("start_line") >= 0, F.col("start_line")).otherwise(0)
    large = oversized(chunks.select(F.col("id").cast("string").alias("id"), first.cast("int").alias("first"), "content"), max_lines, max_chars).where("id is not null").dropDuplicates(["id"])
    return large.mapInArrow(run, "chunk_id string, piece int, start_line int, end_line int, start_char int, n_chars int, content string")
