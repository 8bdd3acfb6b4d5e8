"""Pieces of DuckDB SQL that several oracles share. They are written apart from the Spark operators."""

from __future__ import annotations

from ..functions.text import BUILTINS, EVAL_PATTERNS, FAMILIES, TEST_PATTERNS

#: The chunk corpus: one row an id, lists never null.
CORPUS = """c AS (
  SELECT id, any_value(coalesce(project_root, '')) AS project_root, any_value(path) AS path, any_value(content) AS content, any_value(docstring) AS docstring,
         any_value(start_line) AS start_line, any_value(end_line) AS end_line, any_value(chunk_index) AS chunk_index, any_value(is_anchor) AS is_anchor, any_value(chunk_type) AS chunk_type,
         any_value(complexity) AS complexity, coalesce(any_value(is_exported), false) AS is_exported, any_value(role) AS role, any_value(parent_symbol) AS parent_symbol, any_value(vec_id) AS vec_id,
         coalesce(any_value(defined_symbols), []) AS defs, coalesce(any_value(referenced_symbols), []) AS calls, coalesce(any_value(type_referenced_symbols), []) AS types,
         coalesce(any_value(member_referenced_symbols), []) AS members, coalesce(any_value(imports), []) AS imports
  FROM chunks GROUP BY id)"""
DEFS = "d AS (SELECT project_root, path, coalesce(start_line, 0) AS start_line, is_exported, unnest(list_distinct(defs)) AS symbol FROM c)"
REFS = "r AS (SELECT id, project_root, path, unnest(list_distinct(list_concat(calls, types))) AS symbol FROM c)"
FIRST = "f AS (SELECT project_root, symbol, min((path, start_line)) AS k, count(DISTINCT path) AS def_files FROM d GROUP BY ALL)"
BASE = f"WITH RECURSIVE {CORPUS}, {DEFS}, {REFS}"
BUILTIN = "(" + ", ".join(f"'{b}'" for b in BUILTINS) + ")"


def regex(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


def is_test(column: str) -> str:
    return regex(column, TEST_PATTERNS)


def is_eval(column: str) -> str:
    return regex(column, EVAL_PATTERNS)


def family(column: str) -> str:
    ext = rf"lower(regexp_extract({column}, '(\.[^./]*)$', 1))"
    return "(CASE " + " ".join(f"WHEN {ext} IN ({', '.join(repr(e) for e in exts)}) THEN '{n}'" for n, exts in FAMILIES.items()) + " END)"


def distance(a: str, b: str) -> str:
    return f"round(list_sum(list_transform(generate_series(1, len({a})), lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE))), 6)"
