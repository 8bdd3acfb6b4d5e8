import random

from pyspark.sql import functions as F

from codeprism.functions.text import is_test_path
from codeprism.operators import analytics, audit, graph, symbols
from codeprism.plans import audits

SCHEMA = "id string, project_root string, path string, start_line int, is_exported boolean, defined_symbols array<string>, referenced_symbols array<string>, type_referenced_symbols array<string>, member_referenced_symbols array<string>, parent_symbol string"


def corpus(spark, rows):
    return symbols.corpus(spark.createDataFrame([(f"c{i}", "/p", f"/p/{p}", line, e, d, r, t, m, None) for i, (p, line, e, d, r, t, m) in enumerate(rows)], SCHEMA))


def chunk(path, defs=(), refs=(), line=0, exported=False, types=(), members=()):
    return path, line, exported, list(defs) or None, list(refs) or None, list(types) or None, list(members) or None


def test_god_node_counts_other_files_only(spark):
    c = corpus(spark, [chunk("core", ["BigThing"]), chunk("a", refs=["BigThing"]), chunk("b", refs=["BigThing"]), chunk("c", refs=["BigThing"]), chunk("c", refs=["BigThing"], line=9), chunk("d", ["own"], ["own", "id"]), chunk("e", ["id"])])
    got = audit.god_nodes(c).collect()
    assert [(r["symbol"], r["file"], r["inbound_files"], r["total_refs"]) for r in got] == [("BigThing", "/p/core", 3, 4)]


def test_hub_files_and_fan_out(spark):
    c = corpus(spark, [chunk("hub", ["util"]), chunk("x", refs=["util", "outside"]), chunk("y", refs=["util"]), chunk("leaf", ["q"], ["util"])])
    got = {r["file"]: (r["dependents"], r["defines"], r["fan_out"]) for r in audit.hub_files(c).collect()}
    assert got == {"/p/hub": (3, 1, 0)}


def test_cycles(spark):
    c = corpus(spark, [chunk("a", ["fa"], ["fb"]), chunk("b", ["fb"], ["fc"]), chunk("c", ["fc"], ["fa"]), chunk("leaf", ["fl"], ["fa"])])
    got = audit.file_cycles(c).collect()
    assert [(r["files"], r["edge_count"]) for r in got] == [(["/p/a", "/p/b", "/p/c"], 3)]
    assert audit.file_cycles(corpus(spark, [chunk("a", ["x"], ["map"]), chunk("b", ["map", "x"], ["x"])])).count() == 0


def test_components_match_tarjan_on_random_graphs(spark):
    rnd = random.Random(5)
    edges = {(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(60)}
    reach = {a: {a} for e in edges for a in e}
    for _ in range(40):
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {}
    for a in reach:
        own = {b for b in reach[a] if a in reach[b]}
        if len(own) > 1:
            want[a] = max(own)
    got = {r["node"]: r["component"] for r in audit.components(spark.createDataFrame(sorted(edges), "src string, dst string")).collect()}
    assert got == want


def test_dead_and_status(spark):
    c = corpus(spark, [chunk("a", ["unusedPrivate"]), chunk("a", ["unusedPublic"], exported=True), chunk("a", ["usedPrivate"]), chunk("b", ["caller"], ["usedPrivate"])])
    assert {r["symbol"] for r in audit.dead_candidates(c).collect()} == {"unusedPrivate", "caller"}
    assert {r["symbol"]: r["status"] for r in analytics.dead_status(c).collect()} == {"unusedPrivate": "DEAD", "unusedPublic": "PUBLIC_EXPORT", "usedPrivate": "LIVE", "caller": "DEAD"}


def test_walks(spark):
    g = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("c", "e"), ("d", "f")], "src string, dst string")
    assert {(r["symbol"], r["hops"]) for r in graph.neighbours(g, "a", 2).collect()} == {("b", 1), ("c", 1), ("d", 2), ("e", 2)}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert {r["symbol"] for r in graph.neighbours(ring, "a", 5).collect()} == {"b", "c"}
    way = spark.createDataFrame([("a", "b"), ("a", "x"), ("b", "c"), ("c", "target")], "src string, dst string")
    assert graph.shortest_path(way, "a", "target").first()["path"] == ["a", "b", "c", "target"]
    assert graph.shortest_path(way, "a", "target", 2).count() == 0
    assert graph.shortest_path(way, "a", "a").first()["path"] == ["a"]


def test_pagerank(spark):
    def ranks(nodes, edges):
        n = spark.createDataFrame([(x,) for x in nodes], "node string")
        g = spark.createDataFrame(edges, "src string, dst string")
        return {r["node"]: r["score"] for r in graph.pagerank(n, g).collect()}

    ring = ranks("ABCD", [("A", "B"), ("B", "C"), ("C", "D"), ("D", "A")])
    assert all(abs(v - 0.25) < 1e-6 for v in ring.values())
    r = ranks("ABCD", [("A", "B"), ("A", "C"), ("B", "C"), ("C", "A"), ("D", "C")])
    assert r["C"] > r["A"] > r["B"] > r["D"] and abs(r["D"] - 0.0375) < 1e-6 and abs(sum(r.values()) - 1) < 1e-6
    assert abs(sum(ranks("AB", [("A", "B")]).values()) - 1) < 1e-9
    assert abs(ranks("A", [("A", "outside")])["A"] - 1) < 1e-9


def test_subgraph_and_edges(spark):
    c = corpus(spark, [chunk("f", ["funcA"], ["funcB", "lodashThing"]), chunk("f", ["funcB"], ["externalApi", "funcB"])])
    got = {(r["part"], r["a"], r["b"]) for r in graph.file_subgraph(c, ["/p/f"]).collect()}
    assert got == {("symbol", "funcA", ""), ("symbol", "funcB", ""), ("internal", "funcA", "funcB"), ("external", "externalApi", ""), ("external", "lodashThing", "")}
    e = {(r["dst"], r["kind"]) for r in symbols.edges(corpus(spark, [chunk("f", ["a"], ["free", "both"], types=["T"], members=["both", "m"])])).collect()}
    assert e == {("free", "free"), ("both", "member"), ("T", "type"), ("m", "member")}


def test_callees_prefer_the_same_file_then_the_same_family(spark):
    c = corpus(spark, [chunk("a.ts", ["go"], ["x", "y", "map", "gone"]), chunk("a.ts", ["x"], line=5), chunk("b.py", ["x", "y"]), chunk("z.tsx", ["y"])])
    got = {r["symbol"]: r["path"] for r in symbols.callees(c, "go").collect()}
    assert got == {"x": "/p/a.ts", "y": "/p/z.tsx", "gone": None}


def test_risk_dependents_and_tests(spark):
    rows = spark.createDataFrame([("a", 1, 0, True), ("b", 20, 0, True), ("c", 5, 0, True), ("d", 1, 0, False)], "symbol string, caller_count int, churn int, has_tests boolean")
    s = {r["symbol"]: r["score"] for r in analytics.risk(rows).collect()}
    assert s["b"] > s["c"] > s["a"] and s["d"] == 2 * s["a"]
    c = corpus(spark, [chunk("def", ["Foo", "Bar"]), chunk("both", refs=["Foo", "Bar"]), chunk("one", refs=["Foo"])])
    got = [(r["path"], r["shared"]) for r in analytics.dependents(c, ["Foo", "Bar"]).orderBy(F.desc("shared")).collect()]
    assert got == [("/p/both", 2), ("/p/one", 1)]
    t = corpus(spark, [chunk("src/a", ["f"]), chunk("src/b", ["g"], ["f"]), chunk("tests/t1", ["t"], ["f"]), chunk("tests/t2", ["u"], ["g"])]).withColumn("content", F.lit(""))
    hits = {r["path"]: (r["hops"], r["via"]) for r in graph.tests_reaching(t, ["f"]).collect()}
    assert hits == {"/p/tests/t1": (0, ["f"]), "/p/tests/t2": (1, ["g"])}


def test_project_of_takes_the_longest_root_and_no_sibling(spark):
    p = spark.createDataFrame([("/work/api",), ("/work/api-extra",), ("/work",)], "root string")
    rows = spark.createDataFrame([("1", "/work/api/x.ts"), ("2", "/work/api-extra/y.ts"), ("3", "/other/z.ts"), ("4", "/work/apix/z.ts")], "id string, path string")
    assert {r["id"]: r["root"] for r in analytics.project_of(rows, p).collect()} == {"1": "/work/api", "2": "/work/api-extra", "3": None, "4": "/work"}


def test_tests_by_mention_only_where_none_is_reached(spark):
    cols = "id string, project_root string, path string, start_line int, defined_symbols array<string>, referenced_symbols array<string>, type_referenced_symbols array<string>, member_referenced_symbols array<string>, parent_symbol string, content string"
    rows = [("1", "/r", "/r/src/a.ts", 0, ["a"], [], [], [], None, "a"), ("2", "/r", "/r/tests/a.test.ts", 3, [], ["a"], [], [], None, "a()"), ("3", "/r", "/r/tests/b.test.ts", 4, [], [], [], [], None, "// tells of a and $b"), ("4", "/r", "/r/src/c.ts", 9, ["c"], ["$b"], [], [], None, "x\n" * 250 + "y = $b(1)")]
    c = spark.createDataFrame(rows, cols)
    assert {r["path"]: r["hops"] for r in graph.tests_reaching(c, ["a"]).collect()} == {"/r/tests/a.test.ts": 0}
    assert {r["path"]: r["hops"] for r in graph.tests_reaching(c, ["$b"]).collect()} == {"/r/tests/b.test.ts": -1}
    assert [r["line"] for r in graph.call_sites(c, "$b").collect()] == [9 + 251]


def test_a_long_cycle_is_found_whole(spark):
    from codeprism.operators import audit

    n = 90
    edges = spark.createDataFrame([(f"n{i:03}", f"n{(i + 1) % n:03}") for i in range(n)] + [("n000", "x"), ("y", "n001")], "src string, dst string")
    got = audit.components(edges).collect()
    assert len(got) == n and {r["component"] for r in got} == {"n089"}


def test_registered_walks_go_to_the_third_level(spark):
    d = "/root/testdata/sf0.1"
    q = audits.queries()
    calls = {(r["src"], r["dst"]) for r in symbols.edges(audits.corpus(spark, d, *audits.MEMBERS)).where("src <> 'unknown' and src <> dst").select("src", "dst").collect()}
    level, seen, want = {audits.SYMBOL}, {audits.SYMBOL}, set()
    for hops in (1, 2, 3):
        up = {}
        for s, t in calls:
            if t in level and s not in seen:
                up[s] = min(t, up.get(s, t))
        want |= {(s, t, hops) for s, t in up.items()}
        level = set(up)
        seen |= level
    got = {(r["symbol"], r["parent"], r["hops"]) for r in q["caller_tree"](spark, d).collect()}
    assert got == want and any(h == 3 for _, _, h in got)

    c = audits.corpus(spark, d, *audits.LIGHT)
    refs = [(r["path"], r["symbol"], (r["defined_symbols"] or [None])[0]) for r in symbols.references(c).join(c.select("id", "defined_symbols"), "id").collect()]
    tests = {r["path"] for r in c.select("path").distinct().where(is_test_path("path")).collect()}
    level, seen, want = {audits.SYMBOL, "dropEdge"}, {audits.SYMBOL, "dropEdge"}, {}
    for hops in range(3):
        users = [x for x in refs if x[1] in level]
        for path, _, _ in users:
            if path in tests:
                want.setdefault(path, hops)
        level = {own for _, _, own in users if own} - seen
        seen |= level
    got = {r["path"]: r["hops"] for r in q["find_tests"](spark, d).where("hops >= 0").collect()}
    assert got == want and 2 in got.values()
