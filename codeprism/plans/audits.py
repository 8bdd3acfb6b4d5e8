"""Queries of the symbol and file graphs, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, audit, graph, symbols
from ..session import materialised, table
from . import sqlparts as S

SYMBOL = "dropHeader"


def corpus(spark, d, *columns):
    return symbols.corpus(table(spark, d, "chunks"), *columns)


LIGHT = ("project_root", "path", "start_line", "is_exported", "defined_symbols", "referenced_symbols", "type_referenced_symbols")
MEMBERS = (*LIGHT, "member_referenced_symbols", "parent_symbol")


def god_nodes(spark, d):
    return audit.god_nodes(corpus(spark, d, *LIGHT))


def hub_files(spark, d):
    return audit.hub_files(corpus(spark, d, *LIGHT))


def dead_candidates(spark, d):
    return audit.dead_candidates(corpus(spark, d, *LIGHT))


def dead_status(spark, d):
    return analytics.dead_status(corpus(spark, d, *LIGHT))


def file_edges(spark, d):
    return audit.file_edges(corpus(spark, d, *LIGHT))


def file_cycles(spark, d):
    return audit.file_cycles(corpus(spark, d, *LIGHT)).withColumn("files", F.array_join("files", ","))


def symbol_edges(spark, d):
    e = symbols.edges(corpus(spark, d, *MEMBERS))
    return e.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("chunks"))


def callers(spark, d):
    return symbols.callers(corpus(spark, d, *MEMBERS), SYMBOL).select("id", "src", "path", "kind", "confidence", "tier")


def callees(spark, d):
    return symbols.callees(corpus(spark, d, *LIGHT), SYMBOL)


def trace_groups(spark, d):
    return graph.trace_groups(corpus(spark, d, *MEMBERS), SYMBOL).withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


def call_sites(spark, d):
    return graph.call_sites(corpus(spark, d, *MEMBERS, "content"), SYMBOL)


def caller_tree(spark, d):
    return graph.caller_tree(corpus(spark, d, *MEMBERS), SYMBOL)


def neighbours(spark, d):
    return graph.neighbours(graph.call_graph(corpus(spark, d, *LIGHT)), SYMBOL, 3)


def shortest_path(spark, d):
    g = materialised(graph.call_graph(corpus(spark, d, *LIGHT)))
    far = graph.neighbours(g, SYMBOL, 3).orderBy(F.desc("hops"), "symbol").limit(1).collect()
    return graph.shortest_path(g, SYMBOL, far[0]["symbol"] if far else SYMBOL).select(F.array_join("path", ">").alias("path"), F.size("path").alias("nodes"))


def file_subgraph(spark, d):
    c = corpus(spark, d, *LIGHT)
    path = c.where(F.array_contains("defined_symbols", SYMBOL)).agg(F.min("path")).first()[0]
    return graph.file_subgraph(c, [path] if path else [])


def pagerank_5(spark, d):
    c = corpus(spark, d, *LIGHT)
    nodes = c.select(F.explode("defined_symbols").alias("node"))
    return graph.pagerank(nodes, graph.call_graph(c), rounds=5, tolerance=0).select("node", F.round("score", 6).alias("score"))


def pagerank_boost(spark, d):
    c = corpus(spark, d, *LIGHT)
    ranks = graph.pagerank(c.select(F.explode("defined_symbols").alias("node")), graph.call_graph(c))
    return graph.page_rank_boost(c, ranks).select("id", F.round("boost", 6).alias("boost"))


def find_tests(spark, d):
    out = graph.tests_reaching(corpus(spark, d, *LIGHT, "content"), [SYMBOL, "dropEdge"])
    return out.withColumn("via", F.array_join("via", ","))


def dependents(spark, d):
    return analytics.dependents(corpus(spark, d, *LIGHT), [SYMBOL, "dropEdge"]).withColumn("symbols", F.array_join("symbols", ","))


def related_files(spark, d):
    c = corpus(spark, d, *LIGHT)
    path = c.where(F.array_contains("defined_symbols", SYMBOL)).agg(F.min("path")).first()[0]
    return analytics.related_files(c, path or "")


def importers(spark, d):
    return analytics.importers(corpus(spark, d, "path", "content"), SYMBOL)


def impact_rollup(spark, d):
    return analytics.impact_rollup(corpus(spark, d, *LIGHT))


def risk_table(spark, d):
    return analytics.risk_table(corpus(spark, d, *LIGHT), table(spark, d, "change_feed"))


def symbols_top(spark, d):
    return analytics.symbol_list(corpus(spark, d, *LIGHT), "index").orderBy(F.desc("count"), "symbol").limit(50)


def symbols_all(spark, d):
    return analytics.symbol_list(corpus(spark, d, *LIGHT))


def summary_extensions(spark, d):
    return analytics.extension_counts(corpus(spark, d, "project_root", "path"))


def summary_directories(spark, d):
    return analytics.directory_counts(corpus(spark, d, "project_root", "path"))


def summary_roles(spark, d):
    return analytics.role_counts(corpus(spark, d, "project_root", "role"))


def summary_key_symbols(spark, d):
    return analytics.key_symbols(corpus(spark, d, *LIGHT))


def summary_entry_points(spark, d):
    return analytics.entry_points(corpus(spark, d, "project_root", "path", "is_exported", "role", "complexity", "defined_symbols"))


def project_status(spark, d):
    return analytics.project_status(corpus(spark, d, "path"), table(spark, d, "projects"))


def project_longest_prefix(spark, d):
    return analytics.project_of(corpus(spark, d, "path"), table(spark, d, "projects")).select("id", "root")


QUERIES = (god_nodes, hub_files, dead_candidates, dead_status, file_edges, file_cycles, symbol_edges, callers, callees, trace_groups, call_sites, caller_tree, neighbours, shortest_path, file_subgraph, pagerank_5, pagerank_boost, find_tests, dependents, related_files, importers, impact_rollup, risk_table, symbols_top, symbols_all, summary_extensions, summary_directories, summary_roles, summary_key_symbols, summary_entry_points, project_status, project_longest_prefix)


def queries():
    return {f.__name__: f for f in QUERIES}


EDGES = """e AS (
  SELECT id, path, start_line, project_root, coalesce(defs[1], nullif(parent_symbol, ''), 'unknown') AS src, dst,
         CASE WHEN list_contains(members, dst) THEN 'member' WHEN list_contains(calls, dst) THEN 'free' ELSE 'type' END AS kind
  FROM (SELECT *, unnest(list_distinct(list_concat(calls, types, members))) AS dst FROM c))"""
GRAPH = "g AS (SELECT DISTINCT src, dst FROM (SELECT src, unnest(list_concat(calls, types)) AS dst FROM (SELECT unnest(defs) AS src, calls, types FROM c)) WHERE src <> dst)"
FEDGES = f"""fe AS (SELECT DISTINCT r.project_root, r.path AS src, (f.k)[1] AS dst FROM r JOIN f USING (project_root, symbol)
  WHERE f.def_files = 1 AND symbol NOT IN {S.BUILTIN} AND r.path <> (f.k)[1])"""
HOPS = f"""h(symbol, hops, seen) AS (
  SELECT '{SYMBOL}', 0, ['{SYMBOL}'] UNION
  SELECT g.dst, h.hops + 1, list_append(h.seen, g.dst) FROM h JOIN g ON g.src = h.symbol WHERE h.hops < 3 AND NOT list_contains(h.seen, g.dst))"""
REL = "CASE WHEN starts_with(path, project_root || '/') THEN substr(path, length(project_root) + 2) ELSE path END"


def pagerank_sql(rounds: int) -> str:
    parts = [S.BASE, GRAPH, "n AS (SELECT DISTINCT unnest(defs) AS node FROM c)", "k AS (SELECT count(*)::DOUBLE AS n FROM n)", "w AS (SELECT g.src, g.dst, count(*) OVER (PARTITION BY g.src) AS o FROM g JOIN n a ON a.node = g.src JOIN n b ON b.node = g.dst)", "p0 AS (SELECT node, 1 / n AS score FROM n, k)"]
    for i in range(rounds):
        parts.append(
            f"p{i + 1} AS (SELECT n.node, 0.15 / k.n + 0.85 * (coalesce(x.s, 0) + l.s / k.n) AS score FROM n CROSS JOIN k CROSS JOIN (SELECT coalesce(sum(score), 0) AS s FROM p{i} WHERE node NOT IN (SELECT src FROM w)) l"
            f" LEFT JOIN (SELECT w.dst, sum(p.score / w.o) AS s FROM w JOIN p{i} p ON p.node = w.src GROUP BY 1) x ON x.dst = n.node)"
        )
    return ", ".join(parts) + f" SELECT node, round(score, 6) AS score FROM p{rounds}"


def oracle_sql():
    base, first = S.BASE, f"{S.BASE}, {S.FIRST}"
    return {
        "god_nodes": f"""{first} SELECT project_root, symbol, (k)[1] AS file, (k)[2] AS line, count(DISTINCT r.path) AS inbound_files, count(*) AS total_refs, def_files
            FROM r JOIN f USING (project_root, symbol) WHERE r.path <> (k)[1] AND length(symbol) >= 3 AND symbol NOT IN {S.BUILTIN} GROUP BY project_root, symbol, k, def_files""",
        "hub_files": f"""{base}, x AS (SELECT DISTINCT project_root, symbol, path FROM d)
            SELECT a.project_root, a.path AS file, count(DISTINCT r.path) AS dependents, any_value(n.defines) AS defines, coalesce(any_value(o.fan_out), 0) AS fan_out
            FROM x a JOIN r ON r.project_root = a.project_root AND r.symbol = a.symbol AND r.path <> a.path
            JOIN (SELECT project_root, path, count(*) AS defines FROM x GROUP BY ALL) n ON n.project_root = a.project_root AND n.path = a.path
            LEFT JOIN (SELECT r.project_root, r.path, count(DISTINCT r.symbol) AS fan_out FROM r SEMI JOIN x USING (project_root, symbol) GROUP BY ALL) o ON o.project_root = a.project_root AND o.path = a.path
            GROUP BY a.project_root, a.path""",
        "dead_candidates": f"{base} SELECT DISTINCT project_root, symbol, path, start_line FROM d ANTI JOIN r USING (project_root, symbol) WHERE NOT is_exported",
        "dead_status": f"""{base} SELECT project_root, symbol, CASE WHEN users > 0 THEN 'LIVE' WHEN exported THEN 'PUBLIC_EXPORT' ELSE 'DEAD' END AS status, users
            FROM (SELECT project_root, symbol, exported, coalesce(n, 0) AS users FROM (SELECT project_root, symbol, max(is_exported) AS exported FROM d GROUP BY ALL)
            LEFT JOIN (SELECT project_root, symbol, count(*) AS n FROM r GROUP BY ALL) USING (project_root, symbol))""",
        "file_edges": f"{first}, {FEDGES} SELECT * FROM fe",
        "file_cycles": f"""{first}, {FEDGES}, q(a, b) AS (SELECT src, dst FROM fe UNION SELECT q.a, fe.dst FROM q JOIN fe ON fe.src = q.b),
            m AS (SELECT x.a AS node, max(x.b) AS component FROM q x JOIN q y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
            s AS (SELECT component, string_agg(node, ',' ORDER BY node) AS files, count(*) AS file_count FROM m GROUP BY component HAVING count(*) > 1)
            SELECT fe.project_root, s.files, s.file_count, count(*) AS edge_count FROM fe JOIN m a ON a.node = fe.src JOIN m b ON b.node = fe.dst AND a.component = b.component JOIN s ON s.component = a.component GROUP BY ALL""",
        "symbol_edges": f"{base}, {EDGES} SELECT src, dst, kind, count(*) AS chunks FROM e GROUP BY ALL",
        "callers": f"""{base}, {EDGES}, a AS (SELECT (min((path, start_line)))[1] AS p FROM d WHERE symbol = '{SYMBOL}')
            SELECT id, src, path, kind, CASE kind WHEN 'free' THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, CASE kind WHEN 'free' THEN 0 WHEN 'member' THEN 1 ELSE 2 END AS tier
            FROM e, a WHERE dst = '{SYMBOL}' AND ({S.family('path')} IS NULL OR {S.family('p')} IS NULL OR {S.family('path')} = {S.family('p')})""",
        "callees": f"""{base}, h AS (SELECT path AS home, list_distinct(list_concat(calls, types)) AS refs FROM c WHERE list_contains(defs, '{SYMBOL}') ORDER BY path, coalesce(start_line, 0), id LIMIT 1),
            n AS (SELECT home, unnest(refs) AS symbol FROM h)
            SELECT symbol, path, start_line FROM (SELECT n.symbol, d.path, d.start_line, row_number() OVER (PARTITION BY n.symbol ORDER BY coalesce(d.path = home, false) DESC, coalesce({S.family('d.path')} = {S.family('home')}, false) DESC, d.path, d.start_line) AS k
            FROM n LEFT JOIN d ON d.symbol = n.symbol WHERE n.symbol <> '{SYMBOL}') WHERE k = 1 AND (path IS NOT NULL OR symbol NOT IN {S.BUILTIN})""",
        "trace_groups": f"""{base}, {EDGES} SELECT src, path, array_to_string(list_sort(list(DISTINCT coalesce(start_line, 0) + 1)), ',') AS lines FROM e WHERE dst = '{SYMBOL}' AND src <> dst GROUP BY src, path""",
        "call_sites": f"""{base}, {EDGES}, u AS (SELECT DISTINCT id, src FROM e WHERE dst = '{SYMBOL}'),
            l AS (SELECT path, src, coalesce(start_line, 0) AS s, list_transform(string_split_regex(coalesce(content, ''), '\\r?\\n'), lambda x: regexp_matches(x, '(^|[^A-Za-z0-9_]){SYMBOL}([^A-Za-z0-9_]|$)')) AS m FROM c JOIN u USING (id))
            SELECT path, s + CASE WHEN coalesce(list_position(m, true), 0) > 0 THEN list_position(m, true) ELSE 1 END AS line, min(src) AS src FROM l GROUP BY ALL""",
        "caller_tree": f"""{base}, {EDGES}, x AS (SELECT DISTINCT src, dst FROM e WHERE src <> 'unknown' AND src <> dst),
            a AS (SELECT src AS symbol, '{SYMBOL}' AS parent, 1 AS hops FROM x WHERE dst = '{SYMBOL}'),
            b AS (SELECT src AS symbol, min(dst) AS parent, 2 AS hops FROM x WHERE dst IN (SELECT symbol FROM a) AND src NOT IN (SELECT symbol FROM a) AND src <> '{SYMBOL}' GROUP BY src),
            b3 AS (SELECT src AS symbol, min(dst) AS parent, 3 AS hops FROM x WHERE dst IN (SELECT symbol FROM b) AND src NOT IN (SELECT symbol FROM a) AND src NOT IN (SELECT symbol FROM b) AND src <> '{SYMBOL}' GROUP BY src)
            SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM b3""",
        "neighbours": f"{base}, {GRAPH}, {HOPS} SELECT symbol, min(hops) AS hops FROM h WHERE symbol <> '{SYMBOL}' GROUP BY symbol",
        "shortest_path": f"""{base}, {GRAPH}, {HOPS}, m AS (SELECT symbol, min(hops) AS hops FROM h GROUP BY symbol), t AS (SELECT symbol, hops FROM m ORDER BY hops DESC, symbol LIMIT 1)
            SELECT array_to_string(p, '>') AS path, len(p) AS nodes FROM (SELECT h.seen AS p FROM h JOIN t ON t.symbol = h.symbol AND t.hops = h.hops ORDER BY p LIMIT 1)""",
        "file_subgraph": f"""{base}, o AS (SELECT * FROM c WHERE path = (SELECT min(path) FROM c WHERE list_contains(defs, '{SYMBOL}'))), s AS (SELECT DISTINCT unnest(defs) AS a FROM o),
            p AS (SELECT DISTINCT src, dst FROM (SELECT src, unnest(list_concat(calls, types)) AS dst FROM (SELECT unnest(defs) AS src, calls, types FROM o)) WHERE src <> dst)
            SELECT 'symbol' AS part, a, '' AS b FROM s UNION ALL SELECT 'internal', src, dst FROM p WHERE dst IN (SELECT a FROM s) UNION ALL SELECT DISTINCT 'external', dst, '' FROM p WHERE dst NOT IN (SELECT a FROM s)""",
        "pagerank_5": pagerank_sql(5),
        "find_tests": f"""{base}, y AS (SELECT r.path, r.symbol, coalesce(c.start_line, 0) AS line, c.defs[1] AS own FROM r JOIN c USING (id)), t AS (SELECT unnest(['{SYMBOL}', 'dropEdge']) AS symbol),
            u AS (SELECT y.* FROM y JOIN t USING (symbol)), v AS (SELECT DISTINCT own AS symbol FROM u WHERE own IS NOT NULL AND own NOT IN (SELECT symbol FROM t)), w AS (SELECT y.* FROM y JOIN v USING (symbol)),
            v2 AS (SELECT DISTINCT own AS symbol FROM w WHERE own IS NOT NULL AND own NOT IN (SELECT symbol FROM t) AND own NOT IN (SELECT symbol FROM v)), w2 AS (SELECT y.* FROM y JOIN v2 USING (symbol)),
            k AS (SELECT path, 0 AS hops, line, symbol AS via FROM u WHERE {S.is_test('path')} UNION ALL SELECT path, 1, line, symbol FROM w WHERE {S.is_test('path')} UNION ALL SELECT path, 2, line, symbol FROM w2 WHERE {S.is_test('path')}),
            z AS (SELECT * FROM k UNION ALL SELECT c.path, -1, coalesce(c.start_line, 0), t.symbol FROM c, t WHERE {S.is_test('c.path')} AND contains(c.content, t.symbol) AND NOT EXISTS (SELECT 1 FROM k)),
            q AS (SELECT path, via, min(hops) AS h FROM z GROUP BY ALL)
            SELECT path, (min((hops, line)))[1] AS hops, (min((hops, line)))[2] AS line, (SELECT string_agg(via, ',' ORDER BY h, via) FROM q WHERE q.path = z.path) AS via FROM z GROUP BY path""",
        "dependents": f"""{base} SELECT path, count(DISTINCT symbol) AS shared, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM r
            WHERE symbol IN ('{SYMBOL}', 'dropEdge') AND path NOT IN (SELECT path FROM d WHERE symbol IN ('{SYMBOL}', 'dropEdge')) GROUP BY path""",
        "related_files": f"""{base}, p AS (SELECT min(path) AS path FROM c WHERE list_contains(defs, '{SYMBOL}')), o AS (SELECT c.* FROM c JOIN p USING (path)),
            n AS (SELECT DISTINCT s FROM (SELECT defs, unnest(list_concat(calls, types)) AS s FROM o) WHERE NOT list_contains(defs, s)), m AS (SELECT DISTINCT unnest(defs) AS s FROM o)
            SELECT 'dependency' AS direction, d.path, count(DISTINCT symbol) AS n FROM d JOIN n ON s = symbol WHERE d.path <> (SELECT path FROM p) GROUP BY d.path
            UNION ALL SELECT 'dependent', r.path, count(DISTINCT symbol) FROM r JOIN m ON s = symbol WHERE r.path <> (SELECT path FROM p) GROUP BY r.path""",
        "importers": f"{base} SELECT DISTINCT path FROM c WHERE content LIKE '%import%{SYMBOL}%'",
        "impact_rollup": f"""{base}, x AS (SELECT DISTINCT project_root, symbol, path AS home FROM d WHERE is_exported), u AS (SELECT DISTINCT r.project_root, r.symbol, r.path FROM r JOIN x USING (project_root, symbol) WHERE r.path <> x.home),
            v AS (SELECT *, list_filter(string_split({REL}, '/'), lambda q: q <> '') AS p FROM u)
            SELECT project_root, CASE WHEN p[1] = 'packages' AND len(p) > 1 THEN p[1] || '/' || p[2] ELSE p[1] END AS bucket, count(DISTINCT path) AS dependents, count(DISTINCT symbol) AS symbols FROM v GROUP BY 1, 2""",
        "risk_table": f"""{first}, n AS (SELECT project_root, symbol, count(*) AS n, max({S.is_test('path')}) AS t FROM r GROUP BY ALL), k AS (SELECT path, count(DISTINCT ts) AS k FROM change_feed WHERE event = 'change' AND ts IS NOT NULL GROUP BY path),
            w AS (SELECT project_root, symbol, (f.k)[1] AS path, coalesce(n.n, 0) AS caller_count, coalesce(n.t, false) AS has_tests FROM f LEFT JOIN n USING (project_root, symbol))
            SELECT project_root, symbol, path, caller_count, coalesce(k.k, 0) AS churn, has_tests, round((caller_count + 1) * CASE WHEN has_tests THEN 1 ELSE 2 END * (1 + log2(coalesce(k.k, 0) + 1)), 2) AS score FROM w LEFT JOIN k USING (path)""",
        "symbols_top": f"""{base} SELECT symbol, count(*) AS count, (min((path, start_line)))[1] AS path, (min((path, start_line)))[2] + 1 AS line FROM d WHERE contains(lower(symbol), 'index') GROUP BY symbol ORDER BY count DESC, symbol LIMIT 50""",
        "symbols_all": f"{base} SELECT symbol, count(*) AS count, (min((path, start_line)))[1] AS path, (min((path, start_line)))[2] + 1 AS line FROM d GROUP BY symbol",
        "summary_extensions": rf"{base} SELECT project_root, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS ext, count(*) AS chunks FROM c GROUP BY ALL",
        "summary_directories": f"""{base}, x AS (SELECT project_root, path, list_filter(string_split({REL}, '/'), lambda q: q <> '') AS p FROM c)
            SELECT project_root, CASE WHEN len(p) <= 1 THEN '.' ELSE array_to_string(p[1:least(2, len(p) - 1)], '/') END AS dir, count(DISTINCT path) AS files, count(*) AS chunks FROM x GROUP BY 1, 2""",
        "summary_roles": f"{base} SELECT project_root, coalesce(role, '') AS role, count(*) AS chunks, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY project_root), 6) AS percent FROM c GROUP BY 1, 2",
        "summary_key_symbols": f"""{base} SELECT project_root, symbol, refs FROM (SELECT project_root, symbol, count(*) AS refs, row_number() OVER (PARTITION BY project_root ORDER BY count(*) DESC, symbol) AS k
            FROM r SEMI JOIN d USING (project_root, symbol) WHERE symbol NOT IN {S.BUILTIN} GROUP BY project_root, symbol) WHERE k <= 8""",
        "summary_entry_points": f"{base} SELECT DISTINCT project_root, unnest(defs) AS symbol, path FROM c WHERE is_exported AND role = 'ORCHESTRATION' AND complexity >= 5",
        "project_status": f"""{base}, o AS (SELECT c.id, c.path, (SELECT root FROM projects p WHERE starts_with(c.path, p.root || '/') ORDER BY length(root) DESC LIMIT 1) AS root FROM c), n AS (SELECT root, count(*) AS k, count(DISTINCT path) AS fs FROM o GROUP BY root)
            SELECT p.root, p.name, coalesce(k, 0) AS chunks, coalesce(fs, 0) AS files, chunk_count AS registered,
            CASE WHEN coalesce(k, 0) = 0 THEN 'empty' WHEN chunk_count IS NULL OR k <> chunk_count THEN 'stale' ELSE coalesce(status, 'unknown') END AS state FROM projects p LEFT JOIN n ON n.root = p.root""",
        "project_longest_prefix": f"""{base} SELECT c.id, (SELECT root FROM projects p WHERE starts_with(c.path, p.root || '/') ORDER BY length(root) DESC LIMIT 1) AS root FROM c""",
    }
