import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from codeprism.llm import similar, split, tree

SCHEMA = "model string, vec_ids array<long>, vectors array<array<float>>, dim int, id string"


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 5, width))
    return np.concatenate([c + rng.normal(size=(5, width)) * 0.25 for c in centres]).astype(np.float32)


def brute(ids, x, floor, k):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    out = set()
    for i in range(len(ids)):
        for j in np.argsort(-s[i])[:k]:
            if s[i, j] >= floor:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def responses(spark, ids, x, per=40):
    rows = [("m", ids[i : i + per].tolist(), [list(map(float, v)) for v in x[i : i + per]], None, "clash") for i in range(0, len(ids), per)]
    return spark.createDataFrame(rows, SCHEMA)


def test_recall_against_brute_force(spark):
    x = clustered(3000, 32, 1)
    ids = np.arange(1000, 1000 + len(x))
    want = brute(ids, x, 0.83, 10)
    got = {(r[0], r[1]) for r in similar.similar_pairs(responses(spark, ids, x), leaf_rows=200, split_rows=100).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_general_neighbours_without_a_floor(spark):
    x = clustered(600, 16, 2)
    ids = np.arange(len(x))
    near = similar.neighbours(responses(spark, ids, x), k=5, leaf_rows=100, recall=0.95).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    truth = {(i, j) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    assert len(truth & set(zip(near.id, near.neighbour))) >= 0.9 * len(truth)
    assert near.groupby("id").size().max() <= 5


def test_unusable_vectors_repeats_and_copies(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [
        ("m", [1, 2, 3, 4, 5, 6, 7, 8], [v, [x * 50 for x in v], None, [0.0] * 4, [1.0, 2.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [None, 1.0, 1.0, 1.0]], 4, "x"),
        ("m", [1, 2], [v, [x * 50 for x in v]], 4, "x"),
        ("other", [1, 9], [[1.0, 0.0], [0.0, 1.0]], None, "x"),
        (None, [10], [v], 4, None),
        ("m", None, [v], 4, None),
        ("m", [11], None, 4, None),
    ] + [("m", list(range(100, 140)), [[4.0, -3.0, 2.0, -1.0]] * 40, 4, "copies")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r[0], r[1]) for r in similar.similar_pairs(df).collect()}
    assert (1, 2) in got and not any(a < 100 and (a, b) != (1, 2) for a, b in got)
    reached = {x for p in got for x in p}
    assert reached >= set(range(100, 140))
    assert similar.similar_pairs(df.limit(0)).count() == 0


def test_a_hot_leaf_is_cut_into_cells_of_bounded_size():
    rng = np.random.default_rng(4)
    ids = np.arange(50_000) * 3
    leaf, home = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
    by_row, by_visit = np.array([25]), np.array([25])  # of 2,000 rows and visits each
    at, r, q, base, asks = similar.grid(ids, leaf, home, by_row, by_visit)
    load = np.zeros((25, 25), int)
    np.add.at(load, (r, q), 1)
    assert load.max() <= 2 * 2200
    assert np.bincount(at[base], minlength=len(ids)).tolist() == [25] * len(ids) and np.bincount(at[asks], minlength=len(ids)).tolist() == [25] * len(ids)
    # each row meets each visit in exactly one cell
    for i, j in rng.integers(0, len(ids), (40, 2)):
        bases = set(zip(r[(at == i) & base].tolist(), q[(at == i) & base].tolist()))
        visits = set(zip(r[(at == j) & asks].tolist(), q[(at == j) & asks].tolist()))
        assert len(bases & visits) == 1


def test_copies_in_a_hot_leaf_are_found_across_its_cells(spark):
    x = clustered(200, 16, 6)
    x = np.concatenate([x, np.repeat(x[:1], 300, axis=0)])
    ids = np.arange(len(x))
    near = similar.neighbours(responses(spark, ids, x), k=5, floor=0.99, leaf_rows=50, split_rows=40).toPandas()
    got = near[near.id >= 200].groupby("id").neighbour.apply(sorted)
    # of equal cosines the smallest ids win, each row's own left out
    assert len(got) == 300 and all(len(v) == 5 for v in got) and near.groupby("id").size().max() <= 5
    assert near.cosine.min() >= 0.99 and not (near.id == near.neighbour).any()


def test_tree_visits_in_order_and_reaches_all_leaves():
    x = tree.unit(clustered(2000, 8, 3))
    t = tree.grow(x, 30, branch=6)
    rows, leaves, width = t.visits(x[:50], 10.0)
    assert t.leaves > 5 and all(len(set(leaves[rows == i])) == t.leaves for i in range(50))
    assert (np.bincount(t.home(x), minlength=t.leaves) > 0).sum() == t.leaves


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab {}();\n\r\t", max_size=4000), st.integers(20, 300), st.integers(2, 30))
def test_pieces_cover_the_text_within_the_limits(text, chars, lines):
    out = split.pieces(text, lines, chars, max(1, lines // 5), chars // 10)
    assert out[0][2] == 0 and out[-1][3] == len(text)
    before = None
    for first, last, start, stop in out:
        assert stop - start <= chars and last - first + 1 <= lines
        if before:
            assert before[2] < start <= before[3] < stop
        before = (first, last, start, stop)


def test_split_chunks(spark):
    body = "\n".join(["def f():"] + ["    x = 1"] * 30) + "\n\n"
    rows = [("big", body * 6, -3, "p"), ("big", body * 6, -3, "p"), ("line", "x" * 5000, None, "p"), ("crlf", "a\r\n" * 75, 10, "p"), ("over", "a\r\n" * 76, 10, "p"), ("edge", "y" * 2000, 1, "p"), ("none", None, 1, "p"), ("empty", "", 1, "p"), (None, "z" * 9000, 1, "p"), ("wide", "é" * 2001, 0, "p")]
    df = spark.createDataFrame(rows, "id string, content string, start_line int, piece string")
    out = split.split_chunks(df).toPandas()
    assert set(out.chunk_id) == {"big", "line", "over", "wide"}
    assert (out.n_chars <= 2000).all() and (out.end_line - out.start_line < 75).all()
    over = out[out.chunk_id == "over"].sort_values("piece")
    assert over.start_line.iloc[0] == 10 and over.end_line.iloc[-1] == 85 and over.start_line.iloc[1] <= over.end_line.iloc[0]
    assert split.split_chunks(df.limit(0)).count() == 0


def test_surprises_come_from_vectors(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from codeprism.llm import queries
    from codeprism.operators import analytics

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/embed_responses.parquet").select("vec_ids", "vectors").collect()
    vecs = {i: np.array(v, float) for r in rows for i, v in zip(r["vec_ids"] or [], r["vectors"] or []) if v and len(v) in (64, 96) and np.isfinite(v).all() and np.any(v)}
    at = {r["id"]: r["vec_id"] for r in spark.read.parquet(f"{d}/chunks.parquet").where("vec_id is not null").select("id", "vec_id").collect()}
    got = queries.surprise_vectors(spark, d).collect()
    assert len(got) > 100 and {"kept", "below"} <= {r["reason"] for r in got}
    for r in got:
        x, y = vecs[at[r["a"]]], vecs[at[r["b"]]]
        assert abs(r["similarity"] - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) < 1e-4
        assert r["reason"] != "kept" or r["similarity"] >= 0.83
    assert sum(r["pairs"] for r in queries.surprise_findings(spark, d).collect()) == sum(r["reason"] == "kept" for r in got)
    p = spark.createDataFrame([("1", "2", "/f", "/g", 0.9, None), ("3", "4", "/g", "/f", 0.8, None), ("5", "6", "/f", "/g", 1.0, "tests")], "a string, b string, a_path string, b_path string, similarity double, reason string")
    assert [tuple(r) for r in analytics.file_pair_findings(p).withColumn("examples", F.array_join("examples", ",")).drop("similarities").collect()] == [("/f", "/g", 2, 0.9, 0.85, "1~2,3~4")]


def test_memory_of_a_worker_does_not_grow_with_batches_and_hits():
    n, width = 40_000, 64
    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(np.random.default_rng(1).normal(size=n * width).astype(np.float32)))
    batch = pa.RecordBatch.from_arrays([pa.array(["m"] * n), pa.array(np.arange(n)), rows], ["model", "id", "v"])
    parts = [len(ids) for _, ids, _ in similar.usable(batch, {"m": width})]
    assert sum(parts) == n and max(parts) * width * 4 <= similar.SLICE
    # every tile is full of hits, of which no more than a few tiles' are held
    rng, best, s = np.random.default_rng(2), similar.Best(500, 10, None), []
    for i in range(60):
        s.append(rng.random((500, 1000), np.float32))
        r, c = similar.above(s[-1], best.over, 10)
        best.add(r, c + 1000 * i, s[-1][r, c])
        assert best.size <= 1 << 18
    want = np.argsort(-np.concatenate(s, axis=1), axis=1, kind="stable")[:, :10]
    assert best.trim()[1].reshape(500, 10).tolist() == want.tolist()


def test_a_response_of_many_vectors_is_a_row_for_each(spark):
    rows = [("m", [1, None, 3, 4], [[1.0], [2.0], None], None, "x"), ("m", None, [[1.0]], None, "x"), (None, [5], [[1.0]], None, "x"), ("m", list(range(10, 3010)), [[1.0, 2.0]] * 3000, None, "x")]
    got = similar.one_a_row(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 3001 and got.where("id = 1").first()["v"] == [1.0]


def test_without_a_floor_all_pairs_are_compared_in_cells_of_bounded_size(spark):
    x = np.random.default_rng(9).normal(size=(1500, 64)).astype(np.float32)  # no clusters: neighbours lie everywhere
    ids = np.arange(len(x)) * 7
    near = similar.neighbours(responses(spark, ids, x), k=20, leaf_rows=100, split_rows=400).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    truth = {(i * 7, j * 7) for i in range(len(x)) for j in np.argsort(-s[i])[:20]}
    got = set(zip(near.id, near.neighbour))
    assert len(near) == len(got) == len(truth) and len(got & truth) >= len(truth) - 2  # rounding
    # each pair of rows meets in one cell, and a cell holds two blocks at most
    at, r, q, _, base, asks = similar.paired(ids, 4)
    assert np.unique(r * 4 + q, return_counts=True)[1].max() < 1000
    for i, j in np.random.default_rng(3).integers(0, len(ids), (50, 2)):
        cells = [{(a, b) for a, b, on in zip(r[at == n], q[at == n], of[at == n]) if on} for n, of in ((i, base), (j, asks), (j, base), (i, asks))]
        assert len(cells[0] & cells[1] | cells[2] & cells[3]) == 1
