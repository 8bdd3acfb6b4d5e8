"""Queries of chunking, change detection and index upkeep, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import complexity, is_eval_path, is_test_path
from ..operators import analytics, audit, chunking, incremental, symbols
from ..session import table
from ..sources import files as sources
from . import sqlparts as S


def corpus(spark, d, *columns):
    return symbols.corpus(table(spark, d, "chunks"), *columns)


def listing(spark, d):
    """The newest delivery of each source file."""
    s = table(spark, d, "source_files").where("path is not null")
    return s.groupBy("path").agg(F.max_by(F.struct("mtime_ms", "size", "hash", "hash_version", "has_vectors"), "scanned_at").alias("m")).select("path", "m.*")


def chunk_windows(spark, d):
    return chunking.line_windows(table(spark, d, "source_files").select("file_id", "content").dropDuplicates(["file_id"]))


def prev_next_context(spark, d):
    return chunking.with_context(corpus(spark, d, "path", "chunk_index"))


def chunk_texts(spark, d):
    return chunking.chunk_texts(corpus(spark, d))


def signature_lines(spark, d):
    return chunking.signature_lines(corpus(spark, d, "content", "defined_symbols").where(F.size("defined_symbols") > 0))


def skeletons(spark, d):
    s = chunking.skeletons(corpus(spark, d, "path", "start_line", "defined_symbols", "referenced_symbols", "complexity", "role"))
    return s.select("path", F.size("entries").alias("symbols"), F.array_join(F.transform("entries", lambda x: F.substring_index(x, " |", 1)), ";").alias("outline"))


def sql_tables(spark, d):
    return chunking.sql_tables(corpus(spark, d, "content")).groupBy("operation", "table_name").agg(F.count(F.lit(1)).alias("chunks"))


def code_complexity(spark, d):
    return corpus(spark, d, "content").where("content is not null").select("id", complexity("content").alias("complexity"))


def import_lines(spark, d):
    return chunking.import_lines(table(spark, d, "source_files").select("file_id", "content").dropDuplicates(["file_id"]))


def budget_pack(spark, d):
    """A request for each twenty documents in a row: what of them fits 1,500 tokens."""
    rows = table(spark, d, "documents").where("text is not null")
    c = rows.select(F.floor(F.col("doc_id") / 20).alias("grp"), (F.col("doc_id") % 20).cast("int").alias("idx"), F.ceil(F.length("text") / 4).alias("tokens"), (F.col("doc_id") * 37 % 100 / 100).alias("score"))
    return chunking.budget_pack(c, 1500).select("grp", F.size("picked").alias("picked"), "used", "dropped")


def latest_event(spark, d):
    return incremental.latest_events(table(spark, d, "change_feed"))


def feed_totals(spark, d):
    f = incremental.distinct_changes(table(spark, d, "change_feed"))
    return f.groupBy("project_root", "event").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("path").alias("paths"))


def change_ladder(spark, d):
    """The newest listing against an older index, in which every fifth entry has another time and every seventh another hash."""
    now = listing(spark, d)
    h = F.pmod(F.length("path"), F.lit(35))
    old = now.where(h != 3).select("path", F.when(h % 5 == 0, F.col("mtime_ms") - 1000).otherwise(F.col("mtime_ms")).alias("mtime_ms"), F.when(h % 11 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(h % 7 == 0, F.lit("0")).otherwise(F.col("hash")).alias("hash"))
    return incremental.change_ladder(now.where(h != 9), old)


def coherence_state(spark, d):
    return incremental.coherence(listing(spark, d), corpus(spark, d, "path", "vec_id").where("vec_id is not null"))


def stale_paths(spark, d):
    return incremental.stale_paths(corpus(spark, d, "path"), table(spark, d, "source_files"))


def replace_by_path(spark, d):
    c = corpus(spark, d, "path", "start_line")
    last = incremental.latest_events(table(spark, d, "change_feed"))
    fresh = last.where("event = 'change'").select(F.concat(F.lit("new:"), "path").alias("id"), "path", F.lit(0).alias("start_line"))
    return incremental.replaced(c, fresh, last.where("event = 'unlink'").select("path")).select("id", "path")


def delete_prefix(spark, d):
    return incremental.without_prefix(corpus(spark, d, "path"), "/srv/repos/amber").select("id", "path")


def update_rows(spark, d):
    c = corpus(spark, d, "path", "role")
    new = c.where(F.col("path").endswith(".go")).select("id", F.when(F.length("path") % 2 == 0, "DOCS").alias("role"))
    return incremental.updated(c.select("id", "role"), new, "role")


def retry_plan(spark, d):
    return incremental.retry_plan(table(spark, d, "change_feed").where("path is not null").select("path"))


def fnv_sample(spark, d):
    return incremental.sampled(corpus(spark, d, "path"), "id", 200).select("id", "h")


def index_totals(spark, d):
    c = corpus(spark, d, "project_root", "path")
    return c.groupBy("project_root").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("path").alias("files"))


def path_classes(spark, d):
    paths = corpus(spark, d, "path").select("path").distinct()
    return paths.select("path", is_test_path("path").alias("test"), is_eval_path("path").alias("eval"))


def policy_admitted(spark, d):
    return sources.admitted(listing(spark, d).select("path", "size"))


def surprise_pairs(spark, d):
    """Pairs of chunks of different files with the same first symbol words, by how many they share."""
    c = corpus(spark, d, "project_root", "path", "content", "defined_symbols", "referenced_symbols", "type_referenced_symbols", "start_line", "is_exported")
    one = c.where(F.size("defined_symbols") > 0).select("id", F.col("defined_symbols")[0].alias("s"))
    words = one.select("id", "s", F.array_join(F.array_sort(analytics.symbol_tokens("s")), " ").alias("w")).where("w <> ''")
    rep = words.groupBy("w").agg(F.min("id").alias("a"))  # each class against its least member
    pairs = words.join(rep, "w").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return analytics.surprising_pairs(c, pairs, audit.file_edges(c)).select("a", "b", F.coalesce("reason", F.lit("kept")).alias("reason"))


def filter_funnel(spark, d):
    return surprise_pairs(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("pairs"))


def shape_similarity(spark, d):
    """How alike the first two symbols of a chunk are."""
    c = corpus(spark, d, "defined_symbols").where(F.size("defined_symbols") > 1)
    return c.select("id", F.round(analytics.shape_similarity(F.col("defined_symbols")[0], F.col("defined_symbols")[1]), 6).alias("similarity"))


def vector_width_check(spark, d):
    """How many vectors have which width, and how many cannot be inserted."""
    v = table(spark, d, "embeddings")
    return v.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("vectors"), F.sum((F.size("embedding") != 64).cast("bigint")).alias("refused"))


def registry_gaps(spark, d):
    """Registered projects whose recorded width differs from the one that their vectors most often have."""
    r = table(spark, d, "embed_responses").where("vec_ids is not null").select(F.explode(F.arrays_zip("vec_ids", "vectors")).alias("z")).select(F.col("z.vec_ids").alias("vec_id"), F.size("z.vectors").alias("w")).where("w > 0")
    c = corpus(spark, d, "project_root", "vec_id").select("project_root", "vec_id")
    n = c.join(r.distinct(), "vec_id").groupBy("project_root", "w").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("project_root").agg(F.max(F.struct("n", "w")).alias("b"))
    p = table(spark, d, "projects").select("root", "vector_dim")
    return p.join(best, F.col("root") == F.col("project_root")).where(~F.col("vector_dim").eqNullSafe(F.col("b.w"))).select("root", "vector_dim", F.col("b.w").alias("used_dim"))


QUERIES = (chunk_windows, prev_next_context, chunk_texts, signature_lines, skeletons, sql_tables, code_complexity, import_lines, budget_pack, latest_event, feed_totals, change_ladder, coherence_state, stale_paths, replace_by_path, delete_prefix, update_rows, retry_plan, fnv_sample, index_totals, path_classes, policy_admitted, surprise_pairs, filter_funnel, shape_similarity, vector_width_check, registry_gaps)


def queries():
    return {f.__name__: f for f in QUERIES}


LISTING = "n AS (SELECT path, arg_max(mtime_ms, scanned_at) AS mtime_ms, arg_max(size, scanned_at) AS size, first(hash ORDER BY scanned_at DESC NULLS LAST) AS hash, first(hash_version ORDER BY scanned_at DESC NULLS LAST) AS hash_version, first(has_vectors ORDER BY scanned_at DESC NULLS LAST) AS has_vectors FROM source_files WHERE path IS NOT NULL GROUP BY path)"
LAST = "l AS (SELECT path, event, ts FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY coalesce(ts, TIMESTAMP '1970-01-01') DESC, coalesce(received_at, TIMESTAMP '1970-01-01') DESC, event DESC) AS k FROM change_feed WHERE path IS NOT NULL AND event IS NOT NULL) WHERE k = 1)"
FILES = "s AS (SELECT file_id, any_value(content) AS content FROM source_files GROUP BY file_id)"


def _words_sql(symbol):
    return rf"list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace({symbol}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_-]+', ' ', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 1))"


SQL_FORMS = {
    "select": r"(?i)\bselect\b[^;\"'']*?\bfrom\s+([A-Za-z_][\w.]*)",
    "insert": r"(?i)\binsert\s+into\s+([A-Za-z_][\w.]*)",
    "update": r"(?i)\bupdate\s+([A-Za-z_][\w.]*)\s+set\b",
    "delete": r"(?i)\bdelete\s+from\s+([A-Za-z_][\w.]*)",
    "merge": r"(?i)\bmerge\s+into\s+([A-Za-z_][\w.]*)",
    "create": r"(?i)\bcreate\s+table\s+([A-Za-z_][\w.]*)",
    "alter": r"(?i)\balter\s+table\s+([A-Za-z_][\w.]*)",
    "drop": r"(?i)\bdrop\s+table\s+([A-Za-z_][\w.]*)",
    "truncate": r"(?i)\btruncate\s+table\s+([A-Za-z_][\w.]*)",
}


def oracle_sql():
    base = S.BASE
    return {
        "chunk_windows": f"""WITH {FILES}, x AS (SELECT file_id, string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) AS l FROM s WHERE content IS NOT NULL), y AS (SELECT *, len(l) AS n FROM x),
            z AS (SELECT *, unnest(generate_series(0, n - 1, 65)) AS start_line FROM y)
            SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY start_line) - 1)::INT AS chunk_index, start_line, least(start_line + 75, n) - 1 AS end_line, length(array_to_string(l[start_line + 1:least(start_line + 75, n)], chr(10))) AS n_chars FROM z""",
        "prev_next_context": f"{base} SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM c WINDOW w AS (PARTITION BY path ORDER BY chunk_index NULLS FIRST, id)",
        "chunk_texts": f"""{base}, t AS (SELECT id, concat_ws(chr(10), 'File: ' || path, CASE WHEN len(imports) > 0 THEN 'Imports: ' || array_to_string(imports, ', ') END,
            CASE WHEN coalesce(parent_symbol, '') <> '' THEN parent_symbol || ' > ' || coalesce(defs[1], '') END, content, docstring) AS t FROM c)
            SELECT id, length(t) AS n_chars, ceil(length(t) / 4)::BIGINT AS tokens, sha256(t) AS digest FROM t""",
        "signature_lines": rf"""{base} SELECT id, regexp_replace(trim(l[1]), '[ \t]*[{{:]$', '') AS signature FROM (SELECT id, list_filter(string_split_regex(content, '\r?\n'), lambda x: contains(x, defs[1])) AS l FROM c WHERE len(defs) > 0 AND content IS NOT NULL) WHERE len(l) > 0""",
        "import_lines": rf"""WITH {FILES} SELECT file_id, len(regexp_extract_all(content, '(?m)^[ \t]*(?:import\b|from[ \t]+\S+[ \t]+import\b|use[ \t]+[\w:]+|(?:const|let|var)[ \t]+\S+[ \t]*=[ \t]*require\()')) AS imports FROM s WHERE content IS NOT NULL""",
        "shape_similarity": f"""{base}, w AS (SELECT id, {_words_sql('defs[1]')} AS a, {_words_sql('defs[2]')} AS b FROM c WHERE len(defs) > 1)
            SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM w""",
        "policy_admitted": f"""WITH {LISTING}, x AS (SELECT path, size, string_split(path, '/') AS p FROM n) SELECT path, size FROM x
            WHERE len(list_intersect(p[1:len(p) - 1], {sources.IGNORED_NAMES!r})) = 0 AND NOT ({" OR ".join(f"p[-1] GLOB '{g}'" for g in sources.IGNORED_FILES)})
            AND list_contains({sources.EXTENSIONS!r}, lower(regexp_extract(p[-1], '(\\.[^.]*)$', 1))) AND size > 0 AND size <= {sources.MOST_BYTES}""",
        "latest_event": f"WITH {LAST} SELECT * FROM l",
        "feed_totals": "SELECT project_root, event, count(*) AS events, count(DISTINCT path) AS paths FROM (SELECT DISTINCT * FROM change_feed) GROUP BY ALL",
        "change_ladder": f"""WITH {LISTING}, o AS (SELECT path, CASE WHEN length(path) % 35 % 5 = 0 THEN mtime_ms - 1000 ELSE mtime_ms END AS mtime_ms, CASE WHEN length(path) % 35 % 11 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN length(path) % 35 % 7 = 0 THEN '0' ELSE hash END AS hash FROM n WHERE length(path) % 35 <> 3),
            a AS (SELECT * FROM n WHERE length(path) % 35 <> 9)
            SELECT coalesce(a.path, o.path) AS path, CASE WHEN a.path IS NULL THEN 'gone' WHEN o.path IS NULL THEN 'new' WHEN floor(a.mtime_ms) = floor(o.mtime_ms) AND a.size = o.size THEN 'skip' WHEN a.size = o.size AND lower(a.hash) = lower(o.hash) THEN 'refresh' ELSE 'process' END AS action FROM a FULL JOIN o ON a.path = o.path""",
        "coherence_state": f"""{base}, {LISTING}, v AS (SELECT DISTINCT path FROM c WHERE vec_id IS NOT NULL), x AS (SELECT coalesce(n.path, v.path) AS path, n.path IS NULL AS no, v.path IS NOT NULL AS there, hash_version AS hv, has_vectors AS has FROM n FULL JOIN v ON n.path = v.path),
            y AS (SELECT *, CASE WHEN has IS NULL THEN NOT there ELSE has <> there END AS clash FROM x)
            SELECT path, CASE WHEN no OR clash THEN 'reprocess' WHEN hv IS NOT NULL AND hv <> 2 THEN 'reprocess' WHEN hv IS NULL AND regexp_matches(lower(path), '\\.mdx?$') THEN 'reprocess' WHEN hv IS NULL OR has IS NULL THEN 'stamp' ELSE 'current' END AS action, CASE WHEN no THEN there ELSE clash END AS rewrite FROM y""",
        "stale_paths": f"{base} SELECT DISTINCT path FROM c WHERE path NOT IN (SELECT path FROM source_files WHERE path IS NOT NULL)",
        "replace_by_path": f"{base}, {LAST} SELECT id, path FROM c ANTI JOIN l USING (path) UNION ALL SELECT 'new:' || path, path FROM l WHERE event = 'change'",
        "delete_prefix": f"{base} SELECT id, path FROM c WHERE NOT starts_with(path, '/srv/repos/amber/')",
        "update_rows": f"{base} SELECT id, CASE WHEN ends_with(path, '.go') THEN CASE WHEN length(path) % 2 = 0 THEN 'DOCS' ELSE '' END ELSE role END AS role FROM c",
        "retry_plan": "SELECT path, count(*) AS tries, least(30000, 2000 * 2 ** (count(*) - 1))::BIGINT AS wait_ms, count(*) >= 5 AS terminal FROM change_feed WHERE path IS NOT NULL GROUP BY path",
        "fnv_sample": f"""{base} SELECT id, h FROM (SELECT id, list_reduce(list_transform(string_split(id, ''), lambda x: ascii(x)::BIGINT), lambda a, x: (xor(a, x) * 16777619) % 4294967296, 2166136261::BIGINT) AS h FROM c) ORDER BY h, id LIMIT 200""",
        "budget_pack": """WITH RECURSIVE t AS (SELECT doc_id // 20 AS grp, (doc_id % 20)::INT AS idx, ceil(length(text) / 4)::BIGINT AS tokens, doc_id * 37 % 100 / 100.0::DOUBLE AS score FROM documents WHERE text IS NOT NULL),
            o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score / 0.02) DESC, tokens, idx) AS k, count(*) OVER (PARTITION BY grp) AS n FROM t),
            p(grp, k, n, picked, used) AS (SELECT DISTINCT grp, 0::BIGINT, n, 0, 0::BIGINT FROM o
                UNION ALL SELECT p.grp, o.k, p.n, p.picked + (p.used + o.tokens <= 1500)::INT, p.used + CASE WHEN p.used + o.tokens <= 1500 THEN o.tokens ELSE 0 END FROM p JOIN o ON o.grp = p.grp AND o.k = p.k + 1)
            SELECT p.grp, greatest(picked, 1) AS picked, CASE WHEN picked = 0 THEN f.tokens ELSE used END AS used, n - greatest(picked, 1) AS dropped
            FROM p JOIN (SELECT grp, arg_max(tokens, (score, -idx)) AS tokens FROM t GROUP BY grp) f ON f.grp = p.grp WHERE k = n""",
        "skeletons": f"""{base} SELECT path, count(*) AS symbols, string_agg((coalesce(start_line, 0) + 1) || ' ' || defs[1], ';' ORDER BY coalesce(start_line, 0), id) AS outline FROM c WHERE len(defs) > 0 GROUP BY path""",
        "code_complexity": rf"""{base}, b AS (SELECT id, regexp_replace(regexp_replace(content, '\\.', '', 'g'), '(?s)"[^"\n]*"|''[^''\n]*''|//[^\n]*|/\*.*?\*/', ' ', 'g') AS code FROM c WHERE content IS NOT NULL)
            SELECT id, 1 + len(regexp_extract_all(code, '\b(?:if|for|while|case|catch|except|elif)\b|&&|\|\||\?\?')) AS complexity FROM b""",
        "sql_tables": f"""{base}, f AS ({" UNION ".join(f"SELECT id, '{o}' AS operation, lower(unnest(regexp_extract_all(content, '{p}', 1))) AS table_name FROM c" for o, p in SQL_FORMS.items())})
            SELECT operation, table_name, count(DISTINCT id) AS chunks FROM f GROUP BY ALL""",
        "index_totals": f"{base} SELECT project_root, count(*) AS chunks, count(DISTINCT path) AS files FROM c GROUP BY ALL",
        "path_classes": f"{base} SELECT DISTINCT path, {S.is_test('path')} AS test, {S.is_eval('path')} AS eval FROM c",
        "vector_width_check": "SELECT len(embedding) AS width, count(*) AS vectors, sum((len(embedding) <> 64)::INT) AS refused FROM embeddings GROUP BY 1",
        "registry_gaps": f"""{base}, z AS (SELECT unnest(vec_ids) AS vec_id, unnest(vectors) AS v FROM embed_responses WHERE vec_ids IS NOT NULL), rr AS (SELECT DISTINCT vec_id, len(v) AS w FROM z WHERE len(v) > 0),
            n AS (SELECT project_root, w, count(*) AS n FROM c JOIN rr USING (vec_id) GROUP BY ALL), b AS (SELECT project_root, (max((n, w)))[2] AS used_dim FROM n GROUP BY project_root)
            SELECT root, vector_dim, used_dim FROM projects JOIN b ON root = project_root WHERE vector_dim IS DISTINCT FROM used_dim""",
    }
