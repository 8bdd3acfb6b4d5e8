"""DuckDB statements for those queries of this package that SQL can express."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": r"""
            SELECT DISTINCT id AS chunk_id FROM chunks
            WHERE length(content) > 2000
               OR len(string_split(regexp_replace(content, '\n$', ''), chr(10))) > 75""",
    }
