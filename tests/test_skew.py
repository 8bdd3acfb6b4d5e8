from collections import Counter, defaultdict

from codeprism.operators import skew

SCHEMA = "id string, path string, referenced_symbols array<string>, symbol string, chunk int, place int"


def rows():
    out = []
    for i in range(300):
        refs = ["hot"] * (i % 4) + [f"s{i % 17}"]
        out.append((f"c{i}", f"f{i % 40}", refs, "clash", 1, 1))
    out += [out[3], out[4], ("n1", None, ["hot", "hot"], None, None, None), ("n2", "f1", None, None, None, None), (None, "f1", ["hot"], None, None, None), ("n3", "f2", [], None, None, None)]
    return out


def brute(data):
    seen, total, files = set(), Counter(), defaultdict(set)
    for i, path, refs, *_ in data:
        if i is None or i in seen:
            continue
        seen.add(i)
        for s in refs or []:
            total[s] += 1
            if path is not None:
                files[s].add(path)
    return {s: (n, len(files[s])) for s, n in total.items()}


def test_totals_match_brute_force_at_any_chunk_size(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    want = brute(rows())
    for size in (1, 7, 50_000):
        got = {r["symbol"]: (r["total_refs"], r["inbound_files"]) for r in skew.symbol_totals(df, size).collect()}
        assert got == want


def test_boundary_states_join_items_that_are_cut(spark):
    pairs = spark.createDataFrame([("k", f"i{n % 5}", 1) for n in range(50)] + [(None, "x", 1), ("k", None, 2)], "key string, item string, n long")
    got = skew.keyed_totals(pairs, 1).collect()
    assert [(r["key"], r["total"], r["items"]) for r in got] == [("k", 52, 5)]


def test_hot_symbols_and_empty_input(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    want = brute(rows())
    all_ = sum(n for n, _ in want.values())
    assert {r["symbol"] for r in skew.hot_symbols(df).collect()} == {s for s, (n, _) in want.items() if n >= 0.025 * all_}
    assert skew.hot_symbols(df.limit(0)).count() == 0
    assert skew.symbol_totals(df.limit(0)).count() == 0


def test_numbers_are_exact(spark):
    df = spark.createDataFrame([(f"k{i % 9}", f"i{i}") for i in range(200)], "key string, item string")
    got = [r["place"] for r in skew.numbered(df, "key", "item").orderBy("key", "item").collect()]
    assert got == list(range(200))
