"""The search filter as one Column, so that what can be pushed reaches the Parquet scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any(columns) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def has(array: str, value: str) -> Column:
    """Membership that is false, not null, for null lists."""
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def names(value) -> list[str]:
    """A list from a list or from comma-separated text."""
    if value is None:
        return []
    return [x.strip() for x in (value.split(",") if isinstance(value, str) else value) if x and x.strip()]


@dataclass
class SearchFilter:
    prefix: str | None = None
    file: str | None = None
    exclude: str | None = None
    language: str | None = None
    role: str | None = None
    definition: str | None = None
    reference: str | None = None  # called
    used: str | None = None  # called or named as a type
    mention: str | None = None
    importer_of: str | None = None
    intent: str | None = None
    in_prefixes: list[str] = field(default_factory=list)
    exclude_prefixes: list[str] = field(default_factory=list)
    project_roots: list[str] | None = None
    legacy_roots: str | None = None
    legacy_excluded_roots: str | None = None
    anchors_only: bool = False
    defining_only: bool = False
    least_content: int | None = None

    def condition(self) -> Column:
        """All parts with AND. An empty list of roots admits nothing; None means no such part."""
        path, parts = F.col("path"), [F.lit(True)]
        if self.prefix:
            parts.append(path.startswith(self.prefix))
        if self.file:
            parts.append(path.endswith("/" + self.file))  # literal: no wildcards in the name
        if self.exclude:
            parts.append(~path.startswith((self.prefix or "") + self.exclude))
        parts += [~path.startswith(p) for p in self.exclude_prefixes]
        if self.in_prefixes:
            parts.append(_any(path.startswith(p) for p in self.in_prefixes))
        if self.language:
            parts.append(path.endswith(self.language if self.language.startswith(".") else "." + self.language))
        if self.role:
            parts.append(F.coalesce(F.col("role") == self.role, F.lit(False)))
        if self.project_roots is not None:
            parts.append(_any(path.startswith(r.rstrip("/") + "/") for r in self.project_roots))
        if roots := names(self.legacy_roots):
            parts.append(_any(path.startswith(r) for r in roots))
        parts += [~path.startswith(r) for r in names(self.legacy_excluded_roots)]
        if self.definition:
            parts.append(has("defined_symbols", self.definition))
        elif self.intent == "DEFINITION":
            parts.append(F.coalesce(F.col("role") == "DEFINITION", F.lit(False)) | (F.coalesce(F.size("defined_symbols"), F.lit(0)) > 0))
        if self.reference:
            parts.append(has("referenced_symbols", self.reference))
        if self.used:
            parts.append(has("referenced_symbols", self.used) | has("type_referenced_symbols", self.used))
        if self.mention:
            parts.append(F.coalesce(F.col("content").contains(self.mention), F.lit(False)))
        if self.importer_of:
            parts.append(F.coalesce(F.col("content").like(f"%import%{self.importer_of}%"), F.lit(False)))
        if self.anchors_only:
            parts.append(F.coalesce(F.col("is_anchor"), F.lit(False)))
        if self.defining_only:
            parts.append(F.coalesce(F.size("defined_symbols"), F.lit(0)) > 0)
        if self.least_content is not None:
            parts.append(F.coalesce(F.length("content") > self.least_content, F.lit(False)))
        return reduce(lambda a, b: a & b, parts)


def resolve_scope(root: str, scope_in=None, exclude=None) -> SearchFilter:
    """``in`` and ``exclude`` relative to a root; a single ``in`` becomes the prefix."""
    base = root.rstrip("/") + "/"
    inside = [base + x.strip("/") + "/" for x in names(scope_in)]
    outside = [base + x.strip("/") + "/" for x in names(exclude)]
    if len(inside) == 1:
        return SearchFilter(prefix=inside[0], exclude_prefixes=outside)
    return SearchFilter(prefix=base, in_prefixes=inside, exclude_prefixes=outside)


def defines_matching(pattern: str) -> Column:
    """Any defined symbol matches, without regard to case; an invalid pattern filters nothing."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        return F.lit(True)
    return F.coalesce(F.exists("defined_symbols", lambda s: s.rlike("(?i)" + pattern)), F.lit(False))
