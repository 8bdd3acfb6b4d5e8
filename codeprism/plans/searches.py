"""Queries of ranked retrieval over vectors and texts, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, chunking, retrieval, symbols
from ..operators.predicates import SearchFilter, defines_matching, resolve_scope
from ..session import table
from . import sqlparts as S

QUERY = "registry cache index after the last page"
ROOT = "/srv/repos/lantern-mono"


def vectors(spark, d):
    return table(spark, d, "embeddings")


def own(spark, d, vec=0):
    return vectors(spark, d).where(F.col("vec_id") == vec).select(F.col("embedding").alias("_q")).limit(1)


def knn_exact(spark, d):
    v = vectors(spark, d).crossJoin(F.broadcast(own(spark, d)))
    return retrieval.nearest(v, F.col("_q"), 10)


def knn_similar_to(spark, d):
    return retrieval.nearest_to(vectors(spark, d), 7, 10)


def knn_threshold(spark, d):
    return retrieval.nearest_to(vectors(spark, d), 3, 50, least=0.35)


def knn_scoped(spark, d):
    docs = table(spark, d, "documents").where(F.col("source").startswith("issues:")).select(F.col("doc_id").alias("vec_id"))
    v = vectors(spark, d).join(docs, "vec_id", "left_semi").crossJoin(F.broadcast(own(spark, d)))
    return retrieval.nearest(v, F.col("_q"), 10)


def fts_bm25(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), QUERY, 20)


def fts_scoped(spark, d):
    return retrieval.bm25(table(spark, d, "documents").where(F.col("source").startswith("docs:")), QUERY, 20)


def doc_freq(spark, d):
    return retrieval.document_frequency(table(spark, d, "documents"))


def postings(spark, d):
    return retrieval.postings(table(spark, d, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("tf"), F.max("tf").alias("most"))


def _lists(spark, d, k=100):
    v = vectors(spark, d).crossJoin(F.broadcast(own(spark, d)))
    near = retrieval.ranked(retrieval.nearest(v, F.col("_q"), k), "distance", "vec_id").select(F.col("vec_id").alias("doc_id"), "rank")
    text = retrieval.ranked(retrieval.bm25(table(spark, d, "documents"), QUERY, k), F.desc("score"), "doc_id").select("doc_id", "rank")
    return [near, text]


def rrf_hybrid(spark, d):
    return retrieval.fuse(_lists(spark, d), "doc_id").orderBy(F.desc("score"), "doc_id").limit(20)


def seeded_hybrid(spark, d):
    fused = retrieval.fuse(_lists(spark, d), "doc_id")
    rows = fused.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    none = F.array().cast("array<string>")
    bonus = retrieval.seed_bonus(F.col("source"), none, none, F.col("best_rank"), files=["lantern-mono"])
    return rows.select("doc_id", F.round(F.col("score") + bonus, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def _hits(spark, d):
    """A ranked list of hits: chunks that speak of a word, scored by their structure and length."""
    c = symbols.corpus(table(spark, d, "chunks")).where(F.col("content").contains("format"))
    base = F.least(F.lit(1.0), F.length("content") / 4000)
    return c.withColumn("score", F.round(base * retrieval.structure_boost("FLOW"), 6)).select("id", "path", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), "score")


def structure_boost(spark, d):
    c = symbols.corpus(table(spark, d, "chunks"))
    return c.select("id", F.round(retrieval.structure_boost("DEFINITION"), 6).alias("boost"))


def confidence_bands(spark, d):
    h = _hits(spark, d)
    top = h.agg(F.max("score").alias("m"))
    n = F.round(F.col("score") / F.col("m"), 6)
    return h.crossJoin(F.broadcast(top)).select("id", n.alias("normalized"), retrieval.confidence(n).alias("confidence"))


def per_file_cap(spark, d):
    return retrieval.diversified(_hits(spark, d), 3, 100).select("id", "path", "score")


def concentration(spark, d):
    return retrieval.concentration(_hits(spark, d))


def overlap_dedup(spark, d):
    return retrieval.without_overlap(_hits(spark, d)).select("id", "path", "score")


def line_stitching(spark, d):
    return retrieval.stitched(_hits(spark, d).where("end_line >= start_line"))


def maxsim(spark, d):
    v = vectors(spark, d)
    query = v.where("vec_id < 4").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return retrieval.max_sim(query, v.select(F.col("label").alias("doc"), F.col("embedding").alias("v")))


def pooled_cosine_stage(spark, d):
    v = vectors(spark, d).crossJoin(F.broadcast(own(spark, d)))
    zero = F.forall("embedding", lambda x: x == 0)
    score = F.when(F.col("embedding").isNull() | (F.size("embedding") < 48) | zero, -1.0).otherwise(F.round(retrieval.dot("embedding", "_q"), 6))
    return v.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(40)


def quantised_tokens(spark, d):
    q = retrieval.quantised(vectors(spark, d).where("embedding is not null"), "embedding")
    return q.select("vec_id", F.round("scale", 5).alias("scale"), F.aggregate("codes", F.lit(0), lambda a, x: a + F.abs(x)).cast("bigint").alias("mass"))


def hybrid_search(spark, d):
    """The whole search, over the chunk corpus and its first model's vectors."""
    c = symbols.corpus(table(spark, d, "chunks"))
    r = table(spark, d, "embed_responses")  # the lists tell the width, dim does not
    v = r.select(F.explode(F.arrays_zip("vec_ids", "vectors")).alias("z")).select(F.col("z.vec_ids").alias("vec_id"), F.col("z.vectors").alias("embedding")).where(F.size("embedding") == 64).where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))).dropDuplicates(["vec_id"])
    return retrieval.search(c, v, "where is formatSpan", [1.0] + [0.0] * 63, SearchFilter(prefix="/srv/repos/"), 20, symbols=("dropHeader",))


FILTERS = {
    "prefix": SearchFilter(prefix=ROOT + "/"),
    "negated_prefix": SearchFilter(exclude_prefixes=[ROOT + "/", "/srv/repos/amber/"]),
    "in_prefixes": SearchFilter(in_prefixes=[ROOT + "/src/", ROOT + "/lib/"]),
    "extension": SearchFilter(language="ts"),
    "role": SearchFilter(role="ORCHESTRATION"),
    "def": SearchFilter(definition="dropHeader"),
    "ref": SearchFilter(reference="dropHeader"),
    "used": SearchFilter(used="dropHeader"),
    "exclude": SearchFilter(prefix=ROOT + "/", exclude="src/"),
    "mention": SearchFilter(mention="dropHeader"),
    "importer": SearchFilter(importer_of="Label"),
    "roots": SearchFilter(project_roots=[ROOT, "/srv/repos/amber"]),
    "empty_roots": SearchFilter(project_roots=[]),
    "legacy_roots": SearchFilter(legacy_roots=ROOT + "/, /srv/repos/amber/", legacy_excluded_roots=ROOT + "/src/"),
    "definition_intent": SearchFilter(intent="DEFINITION"),
    "anchors": SearchFilter(anchors_only=True, defining_only=True),
    "long_content": SearchFilter(least_content=1500),
    "scope": resolve_scope(ROOT, "src,lib", "src/graph"),
}
IN_SQL = {
    "prefix": f"starts_with(path, '{ROOT}/')",
    "negated_prefix": f"NOT starts_with(path, '{ROOT}/') AND NOT starts_with(path, '/srv/repos/amber/')",
    "in_prefixes": f"(starts_with(path, '{ROOT}/src/') OR starts_with(path, '{ROOT}/lib/'))",
    "extension": "path LIKE '%.ts'",
    "role": "role = 'ORCHESTRATION'",
    "def": "list_contains(defs, 'dropHeader')",
    "ref": "list_contains(calls, 'dropHeader')",
    "used": "(list_contains(calls, 'dropHeader') OR list_contains(types, 'dropHeader'))",
    "exclude": f"starts_with(path, '{ROOT}/') AND NOT starts_with(path, '{ROOT}/src/')",
    "mention": "contains(content, 'dropHeader')",
    "importer": "content LIKE '%import%Label%'",
    "roots": f"(starts_with(path, '{ROOT}/') OR starts_with(path, '/srv/repos/amber/'))",
    "empty_roots": "false",
    "legacy_roots": f"(starts_with(path, '{ROOT}/') OR starts_with(path, '/srv/repos/amber/')) AND NOT starts_with(path, '{ROOT}/src/')",
    "definition_intent": "(role = 'DEFINITION' OR len(defs) > 0)",
    "anchors": "is_anchor AND len(defs) > 0",
    "long_content": "length(content) > 1500",
    "scope": f"starts_with(path, '{ROOT}/') AND (starts_with(path, '{ROOT}/src/') OR starts_with(path, '{ROOT}/lib/')) AND NOT starts_with(path, '{ROOT}/src/graph/')",
}


def _predicate(name):
    def run(spark, d):
        c = symbols.corpus(table(spark, d, "chunks").where(FILTERS[name].condition()), "path")  # below the shuffle, into the scan
        return c.select("id", "path")

    return run


def predicate_file(spark, d):
    c = symbols.corpus(table(spark, d, "chunks"), "path")
    name = c.agg(F.min(F.substring_index("path", "/", -1))).first()[0]
    return c.where(SearchFilter(file=name).condition()).select("id", "path")


def predicate_name_regex(spark, d):
    return symbols.corpus(table(spark, d, "chunks"), "path", "defined_symbols").where(defines_matching("^drop.*(Edge|Header)$")).select("id", "path")


def changed_files(spark, d):
    """Chunks of files that the feed changed last, before any ranking."""
    from ..operators.incremental import latest_events

    changed = latest_events(table(spark, d, "change_feed")).where("event = 'change'").select("path")
    return symbols.corpus(table(spark, d, "chunks"), "path").join(changed, "path", "left_semi").select("id", "path")


def group_by_project(spark, d):
    h = retrieval.ranked(_hits(spark, d).orderBy(F.desc("score"), "id").limit(200), F.desc("score"), "id")
    roots = analytics.project_of(h.select("id", "path"), table(spark, d, "projects"))
    rows = h.join(roots.select("id", "root"), "id").select(F.coalesce("root", F.lit("")).alias("project"), "rank")
    return analytics.by_project(rows)


def hint_lines(spark, d):
    return chunking.hint_lines(symbols.corpus(table(spark, d, "chunks"), "content"), "return header item")


def sim_stats(spark, d):
    v = vectors(spark, d).crossJoin(F.broadcast(own(spark, d))).where("vec_id > 0")
    return analytics.similarity_stats(v.select(F.round(retrieval.dot("embedding", "_q"), 6).alias("s")), "s")


def eval_metrics(spark, d):
    """Known-item search: each vector's first neighbour is the right answer, the ranking is by another vector."""
    v = vectors(spark, d)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("case"), F.col("embedding").alias("_q"), F.col("label").alias("want"))
    dist = F.round(retrieval.squared_distance("embedding", "_q"), 6)
    from pyspark.sql import Window

    best = v.crossJoin(F.broadcast(q)).where("vec_id <> case").select("case", "want", "label", F.row_number().over(Window.partitionBy("case").orderBy(dist, "vec_id")).alias("r")).where("r <= 20")
    ranks = best.groupBy("case").agg(F.min(F.when(F.col("label") == F.col("want"), F.col("r"))).alias("rank"))
    return analytics.eval_metrics(ranks)


SINGLE = (knn_exact, knn_similar_to, knn_threshold, knn_scoped, fts_bm25, fts_scoped, doc_freq, postings, rrf_hybrid, seeded_hybrid, structure_boost, confidence_bands, per_file_cap, concentration, overlap_dedup, line_stitching, maxsim, pooled_cosine_stage, quantised_tokens, hybrid_search, predicate_file, predicate_name_regex, changed_files, group_by_project, hint_lines, sim_stats, eval_metrics)


def queries():
    return {f.__name__: f for f in SINGLE} | {f"predicate_{n}": _predicate(n) for n in FILTERS}


V = "v AS (SELECT vec_id, embedding AS e, label FROM embeddings WHERE embedding IS NOT NULL)"


def _dot(a, b):
    return f"round(list_sum(list_transform(generate_series(1, len({a})), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)), 6)"


def _knn(where, target, k, more=""):
    return f"""WITH {V}, q AS (SELECT e AS q FROM v WHERE vec_id = {target}), x AS (SELECT vec_id, {S.distance('e', 'q')} AS distance FROM v, q WHERE {where} ORDER BY distance, vec_id LIMIT {k})
        SELECT vec_id, distance, round(1 / (1 + greatest(0, distance)), 6) AS similarity FROM x {more}"""


TOKENS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


def _bm25(where, k):
    terms = ", ".join(f"('{t}')" for t in sorted(set(QUERY.split())))
    return f"""w AS (SELECT doc_id, {TOKENS} AS w FROM documents WHERE text IS NOT NULL AND {where}), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w), t(term) AS (VALUES {terms}),
        o AS (SELECT doc_id, term, len(list_filter(w, lambda x: x = term)) AS tf, len(w) AS dl FROM w, t), g AS (SELECT term, count(*) AS df FROM o WHERE tf > 0 GROUP BY term),
        b AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / a))), 6) AS score FROM o JOIN g USING (term), s WHERE tf > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k})"""


RRF = f"""{V}, q AS (SELECT e AS q FROM v WHERE vec_id = 0), a AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM (SELECT vec_id, {S.distance('e', 'q')} AS distance FROM v, q ORDER BY distance, vec_id LIMIT 100)),
    {_bm25('true', 100)}, l AS (SELECT * FROM a UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) FROM b),
    u AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(rank) AS best_rank FROM l GROUP BY doc_id)"""


def _boost(intent):
    role = "coalesce(role, '')"
    more = {"DEFINITION": f"CASE WHEN {role} = 'DEFINITION' THEN 1.2::DOUBLE ELSE 1 END", "FLOW": f"CASE WHEN {role} = 'ORCHESTRATION' THEN 1.4::DOUBLE ELSE 1 END"}[intent]
    return rf"""(CASE WHEN coalesce(is_anchor, false) THEN 0.99::DOUBLE WHEN chunk_type IN ('function', 'class', 'method', 'interface', 'type_alias') THEN 1.1::DOUBLE
        * CASE {role} WHEN 'ORCHESTRATION' THEN 1.5::DOUBLE WHEN 'DEFINITION' THEN 1.2::DOUBLE WHEN 'IMPLEMENTATION' THEN 1.1::DOUBLE ELSE 1 END
        * CASE WHEN len(calls) > 5 THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN len(calls) > 15 THEN 1.25::DOUBLE ELSE 1 END * {more} ELSE 1 END
        * CASE WHEN regexp_matches(lower(path), '(^|/)(__tests__|tests?|specs?|benchmark)(/|$)') OR regexp_matches(lower(path), '\.(test|spec)\.[cm]?[jt]sx?$') THEN 0.5::DOUBLE ELSE 1 END
        * CASE WHEN {role} = 'DOCS' OR regexp_matches(lower(path), '\.(md|mdx|txt|json|lock)$') OR contains(lower(path), '/docs/') THEN 0.6::DOUBLE ELSE 1 END
        * CASE WHEN length(coalesce(content, '')) < 50 AND NOT is_exported THEN 0.9::DOUBLE ELSE 1 END)"""


HITS = f"""{S.BASE}, h AS (SELECT id, path, coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line, round(least(1.0::DOUBLE, length(content) / 4000::DOUBLE) * {_boost('FLOW')}, 6) AS score FROM c WHERE contains(content, 'format'))"""


def oracle_sql():
    out = {f"predicate_{n}": f"{S.BASE} SELECT id, path FROM c WHERE {IN_SQL[n]}" for n in FILTERS}
    out |= {
        "predicate_file": f"{S.BASE} SELECT id, path FROM c WHERE ends_with(path, '/' || (SELECT min(string_split(path, '/')[-1]) FROM c))",
        "predicate_name_regex": f"{S.BASE} SELECT id, path FROM c WHERE len(list_filter(defs, lambda x: regexp_matches(x, '(?i)^drop.*(Edge|Header)$'))) > 0",
        "knn_exact": _knn("true", 0, 10),
        "knn_similar_to": _knn("vec_id <> 7", 7, 10),
        "knn_threshold": _knn("vec_id <> 3", 3, 50, "WHERE round(1 / (1 + greatest(0, distance)), 6) >= 0.35"),
        "knn_scoped": _knn("vec_id IN (SELECT doc_id FROM documents WHERE starts_with(source, 'issues:'))", 0, 10),
        "fts_bm25": f"WITH {_bm25('true', 20)} SELECT * FROM b",
        "fts_scoped": f"WITH {_bm25(chr(115) + 'tarts_with(source, ' + repr('docs:') + ')', 20)} SELECT * FROM b",
        "doc_freq": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS})) AS term FROM documents) GROUP BY term",
        "postings": f"SELECT term, count(*) AS docs, sum(tf) AS tf, max(tf) AS most FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
        "rrf_hybrid": f"WITH {RRF} SELECT doc_id, score, best_rank FROM u ORDER BY score DESC, doc_id LIMIT 20",
        "seeded_hybrid": f"WITH {RRF} SELECT doc_id, round(score + CASE WHEN best_rank <= 8 AND ends_with(lower(source), 'lantern-mono') THEN 0.02::DOUBLE ELSE 0 END, 6) AS score FROM u JOIN documents USING (doc_id) ORDER BY 2 DESC, doc_id LIMIT 20",
        "structure_boost": f"{S.BASE} SELECT id, round({_boost('DEFINITION')}, 6) AS boost FROM c",
        "confidence_bands": f"{HITS}, n AS (SELECT id, round(score / (SELECT max(score) FROM h), 6) AS normalized FROM h) SELECT id, normalized, CASE WHEN normalized > 0.8 THEN 'High' WHEN normalized > 0.5 THEN 'Medium' ELSE 'Low' END AS confidence FROM n",
        "per_file_cap": f"{HITS} SELECT id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS k FROM h) WHERE k <= 3 ORDER BY score DESC, id LIMIT 100",
        "concentration": f"{HITS} SELECT round(max(n) / sum(n), 6) AS share FROM (SELECT path, count(*) AS n FROM (SELECT * FROM h ORDER BY score DESC, id LIMIT 10) GROUP BY path)",
        "line_stitching": f"""{HITS}, m AS (SELECT *, CASE WHEN start_line > lag(end_line) OVER w + 10 THEN 1 ELSE 0 END AS b FROM h WHERE end_line >= start_line WINDOW w AS (PARTITION BY path ORDER BY start_line, end_line)),
            n AS (SELECT *, sum(b) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS g FROM m)
            SELECT path, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS parts FROM n GROUP BY path, g""",
        "maxsim": f"WITH {V} SELECT doc, round(sum(m), 6) AS score FROM (SELECT a.label AS doc, b.vec_id, max({_dot('a.e', 'b.e').replace('round(', '', 1).rsplit(', 6)', 1)[0]}) AS m FROM v a, v b WHERE b.vec_id < 4 GROUP BY 1, 2) GROUP BY doc",
        "pooled_cosine_stage": f"WITH {V}, q AS (SELECT e AS q FROM v WHERE vec_id = 0) SELECT vec_id, CASE WHEN len(e) < 48 OR len(list_filter(e, lambda x: x <> 0)) = 0 THEN -1 ELSE {_dot('e', 'q')} END AS score FROM v, q ORDER BY score DESC, vec_id LIMIT 40",
        "quantised_tokens": f"""WITH {V}, n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM v), u AS (SELECT vec_id, list_transform(e, lambda x: x::DOUBLE / CASE WHEN n > 0 THEN n ELSE 1 END) AS u FROM n),
            s AS (SELECT vec_id, u, list_max(list_transform(u, lambda x: abs(x))) AS s FROM u)
            SELECT vec_id, round(s, 5) AS scale, list_sum(list_transform(u, lambda x: abs(round(x / CASE WHEN s > 0 THEN s ELSE 1 END * 127))))::BIGINT AS mass FROM s""",
        "changed_files": f"{S.BASE}, l AS (SELECT path, event FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY coalesce(ts, TIMESTAMP '1970-01-01') DESC, coalesce(received_at, TIMESTAMP '1970-01-01') DESC, event DESC) AS k FROM change_feed WHERE path IS NOT NULL AND event IS NOT NULL) WHERE k = 1) SELECT id, path FROM c SEMI JOIN (SELECT path FROM l WHERE event = 'change') USING (path)",
        "group_by_project": f"""{HITS}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM h ORDER BY score DESC, id LIMIT 200)
            SELECT coalesce((SELECT root FROM projects p WHERE starts_with(k.path, p.root || '/') ORDER BY length(root) DESC LIMIT 1), '') AS project, count(*) AS hits, min(rank) AS first_rank FROM k GROUP BY 1""",
        "hint_lines": f"""{S.BASE}, l AS (SELECT id, unnest(string_split_regex(content, '\\r?\\n')) AS t, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) AS line FROM c),
            m AS (SELECT id, line, contains(lower(t), 'return')::INT + contains(lower(t), 'header')::INT + contains(lower(t), 'item')::INT AS hits, regexp_matches(trim(t), '^(//|/\\*|\\*|#)')::INT AS com FROM l)
            SELECT id, line, hits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, com, line) AS k FROM m WHERE hits > 0) WHERE k = 1""",
        "sim_stats": f"WITH {V}, q AS (SELECT e AS q FROM v WHERE vec_id = 0), s AS (SELECT {_dot('e', 'q')} AS s FROM v, q WHERE vec_id > 0) SELECT round(min(s), 3) AS least, round(quantile_cont(s, 0.5), 3) AS p50, round(quantile_cont(s, 0.9), 3) AS p90, round(max(s), 3) AS most, round(avg(s), 3) AS mean FROM s",
        "eval_metrics": f"""WITH {V}, q AS (SELECT vec_id AS c, e AS q, label AS want FROM v WHERE vec_id % 50 = 0), b AS (SELECT c, want, label, row_number() OVER (PARTITION BY c ORDER BY {S.distance('e', 'q')}, vec_id) AS r FROM v, q WHERE vec_id <> c),
            k AS (SELECT c, min(CASE WHEN label = want THEN r END) AS rank FROM b WHERE r <= 20 GROUP BY c)
            SELECT count(*) AS cases, count(rank) AS found, sum((rank = 1)::INT) AS hits_at_1, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(coalesce((rank <= 10)::INT::DOUBLE, 0)), 6) AS recall_at_10 FROM k""",
    }
    return out
