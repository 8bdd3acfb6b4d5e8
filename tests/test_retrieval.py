from pyspark.sql import functions as F

from codeprism.functions import text
from codeprism.operators import chunking, retrieval
from codeprism.operators.predicates import SearchFilter, defines_matching, resolve_scope


def test_nearest_and_threshold(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [3.0, 4.0])], "vec_id long, embedding array<float>")
    got = [(r["vec_id"], r["distance"]) for r in retrieval.nearest(v, [0.0, 0.0], 3).collect()]
    assert got == [(0, 0.0), (1, 1.0), (2, 1.0)]
    assert [r["vec_id"] for r in retrieval.nearest_to(v, 0, 5, least=0.5).collect()] == [1, 2]


def test_fusion_seed_and_bands(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank int")
    got = {r["id"]: (r["score"], r["best_rank"]) for r in retrieval.fuse([a, b], "id").collect()}
    assert got["y"] == (round(1 / 61 + 1 / 62, 6), 1) and got["z"][1] == 2
    rows = spark.createDataFrame([(1, "a/B.ts", ["s"], []), (8, "a/b.ts", [], ["s"]), (9, "a/b.ts", ["s"], [])], "rank int, path string, d array<string>, r array<string>")
    s = retrieval.seed_bonus(F.col("path"), F.col("d"), F.col("r"), F.col("rank"), ["b.ts"], ["s"])
    assert [round(r["s"], 4) for r in rows.select("rank", s.alias("s")).orderBy("rank").collect()] == [0.04, 0.026, 0.0]


def test_overlap_keeps_the_better_and_never_drops_single_lines(spark):
    h = spark.createDataFrame([("a", "f", 0, 10, 0.9), ("b", "f", 4, 12, 0.8), ("c", "f", 9, 20, 0.7), ("d", "f", 5, 5, 0.6), ("e", "g", 0, 10, 0.5)], "id string, path string, start_line int, end_line int, score double")
    assert {r["id"] for r in retrieval.without_overlap(h).collect()} == {"a", "c", "d", "e"}
    assert [r["id"] for r in retrieval.diversified(h, 1, 5).collect()] == ["a", "e"]
    s = {(r["path"], r["start_line"], r["end_line"], r["parts"]) for r in retrieval.stitched(h).collect()}
    assert s == {("f", 0, 20, 4), ("g", 0, 10, 1)}


def test_max_sim_and_bm25(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "q int, v array<float>")
    d = spark.createDataFrame([("x", [1.0, 0.0]), ("x", [0.0, 0.5]), ("y", [0.6, 0.8])], "doc string, v array<float>")
    assert {r["doc"]: r["score"] for r in retrieval.max_sim(q, d).collect()} == {"x": 1.5, "y": 1.4}
    docs = spark.createDataFrame([(1, "index the index"), (2, "a cache"), (3, None), (4, "")], "doc_id long, text string")
    got = retrieval.bm25(docs, "INDEX cache").collect()
    assert {r["doc_id"] for r in got} == {1, 2} and retrieval.bm25(docs.limit(0), "x").count() == 0


def test_budget(spark):
    def pack(items, budget):
        rows = spark.createDataFrame([("g", i, t, s) for i, (t, s) in enumerate(items)], "grp string, idx int, tokens long, score double")
        r = chunking.budget_pack(rows, budget).first()
        return list(r["picked"]), r["used"], r["dropped"]

    assert pack([(256, 1.0), (624, 0.9), (634, 0.8), (271, 0.7), (344, 0.6)], 1500) == ([0, 1, 3, 4], 1495, 1)
    assert pack([(800, 0.9), (200, 0.895), (400, 0.5)], 1000) == ([0, 1], 1000, 1)
    assert pack([(5000, 0.9), (4000, 1.0)], 1000) == ([1], 4000, 1)
    assert pack([(5000, 0.905), (4000, 0.9)], 1000) == ([0], 5000, 1)  # the highest score itself, not its step
    assert pack([(5000, 0.9), (4000, 0.9)], 1000) == ([0], 5000, 1)


def test_windows(spark):
    f = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(220))), (2, "x\r\n"), (3, None), (4, ""), (5, "\n".join("l" * 70))], "file_id long, content string")
    got = [(r["file_id"], r["start_line"], r["end_line"]) for r in chunking.line_windows(f).orderBy("file_id", "chunk_index").collect()]
    assert got == [(1, 0, 74), (1, 65, 139), (1, 130, 204), (1, 195, 219), (2, 0, 0), (4, 0, 0), (5, 0, 69), (5, 65, 69)]


def test_filters(spark):
    rows = spark.createDataFrame([("1", "/r/a/x.ts", ["s"], None, None), ("2", "/r/b/y.py", None, ["s"], "DOCS"), ("3", "/r2/a/x.ts", [], [], None)], "id string, path string, defined_symbols array<string>, referenced_symbols array<string>, role string").withColumn("type_referenced_symbols", F.lit(None).cast("array<string>"))
    ids = lambda f: {r["id"] for r in rows.where(f.condition()).collect()}
    assert ids(SearchFilter(project_roots=["/r"])) == {"1", "2"} and ids(SearchFilter(project_roots=[])) == set()
    assert ids(SearchFilter(definition="s")) == {"1"} and ids(SearchFilter(reference="s")) == {"2"} == ids(SearchFilter(used="s")) and ids(SearchFilter(role="DOCS")) == {"2"}
    assert ids(resolve_scope("/r", "a")) == {"1"} and ids(resolve_scope("/r", None, "a")) == {"2"} and ids(SearchFilter(file="x.ts")) == {"1", "3"}
    assert {r["id"] for r in rows.where(defines_matching("(")).collect()} == {"1", "2", "3"}


def test_text_functions(spark):
    rows = spark.createDataFrame([("a",), ("foobar",), ("",)], "t string")
    assert [r[0] for r in rows.select(text.fnv1a("t")).collect()] == [0xE40C292C, 0xBF9CF968, 0x811C9DC5]
    assert text.agreed_intent("Where is the walker") == "DEFINITION" and text.agreed_intent("hello") == "GENERAL"
    assert text.is_symbol_query(" fooBar ") and not text.is_symbol_query("foo bar")
    paths = spark.createDataFrame([("src/tests/a.ts",), ("src/a.test.tsx",), ("AppTests/x.swift",), ("latest/a.ts",)], "p string")
    assert [r[0] for r in paths.select(text.is_test_path("p")).collect()] == [True, True, True, False]
