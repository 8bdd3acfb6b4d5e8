import datetime as dt

import pytest
from pyspark.sql import functions as F

from codeprism.operators import incremental
from codeprism.sources import files
from codeprism.sources.store import Store, append_log
from codeprism.streaming import changes

T = dt.datetime(2031, 1, 1)


def test_latest_event_ignores_order_and_repeats(spark):
    feed = spark.createDataFrame([("p", "a", "change", T, T), ("p", "a", "unlink", T + dt.timedelta(1), T), ("p", "a", "change", None, T + dt.timedelta(9)), ("p", "a", "change", T, T), ("p", None, "change", T, T)], changes.FEED)
    assert [(r["path"], r["event"]) for r in incremental.latest_events(feed).collect()] == [("a", "unlink")]


def test_ladder_and_coherence(spark):
    cols = "path string, mtime_ms double, size long, hash string"
    now = spark.createDataFrame([("same", 1.2, 5, "H"), ("touched", 9.0, 5, "h"), ("edited", 9.0, 6, "x"), ("new", 1.0, 1, "n")], cols)
    old = spark.createDataFrame([("same", 1.9, 5, "z"), ("touched", 1.0, 5, "H"), ("edited", 1.0, 5, "h"), ("gone", 1.0, 1, "g")], cols)
    assert {r["path"]: r["action"] for r in incremental.change_ladder(now, old).collect()} == {"same": "skip", "touched": "refresh", "edited": "process", "new": "new", "gone": "gone"}
    meta = spark.createDataFrame([("ok", 2, True), ("lost", 2, True), ("legacy", None, None), ("legacy_lost", None, None), ("older", 1, True), ("old.MD", None, True), ("new.md", 2, True)], "path string, hash_version int, has_vectors boolean")
    vec = spark.createDataFrame([("ok",), ("legacy",), ("older",), ("orphan",), ("old.MD",), ("new.md",)], "path string")
    got = {r["path"]: (r["action"], r["rewrite"]) for r in incremental.coherence(meta, vec).collect()}
    assert got == {"ok": ("current", False), "lost": ("reprocess", True), "legacy": ("stamp", False), "legacy_lost": ("reprocess", True), "older": ("reprocess", False), "old.MD": ("reprocess", False), "new.md": ("current", False), "orphan": ("reprocess", True)}


def test_stale_paths_below_protected_stay(spark):
    known = spark.createDataFrame([("/a/x",), ("/b/y",), ("/c/z",)], "path string")
    seen = spark.createDataFrame([("/a/x",)], "path string")
    closed = spark.createDataFrame([("/b",)], "root string")
    assert {r[0] for r in incremental.stale_paths(known, seen).collect()} == {"/b/y", "/c/z"}
    assert {r[0] for r in incremental.stale_paths(known, seen, closed).collect()} == {"/c/z"}


def test_insert_checks_the_width(spark):
    rows = spark.createDataFrame([("1", None, [1.0, 2.0], None)], "id string, role string, vector array<float>, imports array<string>")
    r = incremental.checked_insert(rows, 2).first()
    assert r["role"] == "" and r["imports"] == []
    with pytest.raises(Exception, match="has not 3 places"):
        incremental.checked_insert(rows, 3).collect()


def test_store_replaces_prunes_and_skips_known_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    assert store.read() is None
    store.replace_paths(spark.createDataFrame([("1", "/a"), ("2", "/b"), ("3", "/ab")], "id string, path string"))
    store.replace_paths(spark.createDataFrame([("9", "/a")], "id string, path string"), spark.createDataFrame([("/b",)], "path string"), batch=4)
    store.replace_paths(spark.createDataFrame([("7", "/a")], "id string, path string"), batch=4)
    assert {(r["id"], r["path"]) for r in store.read().collect()} == {("9", "/a"), ("3", "/ab")}
    store.compact(1)
    store.delete_prefix("/a")
    assert store.read().count() == 2 and store.prune(1) > 0 and store.read().count() == 2
    append_log(spark.createDataFrame([("q",)], "query string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    store.drop()
    assert store.read() is None


def test_stream_applies_the_feed(spark, tmp_path):
    feed = spark.createDataFrame([("p", "/p/a", "change", T, T), ("p", "/p/b", "change", T, T), ("p", "/p/b", "unlink", T + dt.timedelta(1), T)], changes.FEED)
    feed.write.parquet(str(tmp_path / "feed"))
    store = Store(spark, str(tmp_path / "index"))
    store.write(spark.createDataFrame([("old", "/p/b"), ("keep", "/p/c")], "id string, path string"))
    q = changes.run(spark, str(tmp_path / "feed"), store, lambda paths: paths.select(F.concat(F.lit("n:"), "path").alias("id"), "path"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    assert {(r["id"], r["path"]) for r in store.read().collect()} == {("n:/p/a", "/p/a"), ("keep", "/p/c")}


def test_walk_policy_and_text(spark, tmp_path):
    for name, data in (("src/a.ts", b"x\n"), ("src/empty.ts", b""), ("node_modules/b.ts", b"x"), ("src/c.min.js", b"x"), ("src/d.bin", b"\0"), ("src/e.py", b"\0\1binary"), ("Makefile", b"all:")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = files.decoded(files.admitted(files.walk(spark, str(tmp_path))))
    assert {r["path"].rsplit("/", 1)[1] for r in got.collect()} == {"a.ts", "Makefile"}
    (tmp_path / "registry.json").write_text('[{"root": "/a", "vectorDim": 64}]')
    assert files.registry(spark, str(tmp_path / "registry.json")).first()["vectorDim"] == 64
    (tmp_path / "bad.json").write_text('[{"root": "/a", "vectorDim": "wide"}]')
    with pytest.raises(Exception):
        files.registry(spark, str(tmp_path / "bad.json")).collect()


def test_commits(spark):
    log = "\x1eh1\x1fann\x1f2031\x1fsubject\x1f\n3\t1\ta.ts\n-\t-\tb.bin\n\x1eh2\x1fbob\x1f2031\x1fnone\x1f\n1\t0\ta.ts\n"
    c = files.commits(spark.createDataFrame([(log,)], "value string"))
    assert [(r["hash"], r["files_changed"], r["insertions"], r["deletions"]) for r in c.orderBy("hash").collect()] == [("h1", 2, 3, 1), ("h2", 1, 1, 0)]
    assert {r["path"]: r["commits"] for r in files.churn(c).collect()} == {"a.ts": 2, "b.bin": 1}
    assert files.touched(c, ["b.bin"]).count() == 1


def test_retries(spark):
    rows = spark.createDataFrame([("a",)] * 5 + [("b",)], "path string")
    assert {r["path"]: (r["wait_ms"], r["terminal"]) for r in incremental.retry_plan(rows).collect()} == {"a": (30000, True), "b": (2000, False)}
