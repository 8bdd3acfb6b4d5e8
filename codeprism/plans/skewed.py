"""Queries of per-key totals over skewed keys."""

from __future__ import annotations

from ..operators import skew
from ..session import table


def p7_found(spark, d):
    return skew.hot_symbols(table(spark, d, "chunks"))


def p7_totals(spark, d):
    return skew.symbol_totals(table(spark, d, "chunks"))


def queries():
    return {f.__name__: f for f in (p7_found, p7_totals)}


REFS = "SELECT id, any_value(path) AS path, any_value(referenced_symbols) AS refs FROM chunks WHERE id IS NOT NULL GROUP BY id"


def oracle_sql():
    return {
        "p7_totals": f"""
            SELECT symbol, count(*) AS total_refs, count(DISTINCT path) AS inbound_files
            FROM (SELECT path, unnest(refs) AS symbol FROM ({REFS})) WHERE symbol IS NOT NULL GROUP BY symbol""",
        "p7_found": f"""
            SELECT symbol FROM (SELECT unnest(refs) AS symbol FROM ({REFS})) GROUP BY symbol
            HAVING count(*) >= 0.025 * (SELECT sum(len(refs)) FROM ({REFS}))""",
    }
