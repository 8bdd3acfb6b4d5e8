import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from codeprism.llm import packing, tokens  # noqa: E402


def reference_encoder():
    with open(tokens.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


REFERENCE = reference_encoder()
TEXTS = ["", None, " ", "hello world", "a" * 3000, "漢字かな" * 500, "<|endoftext|>", "naïve café 👩‍💻\r\n\ttabs", "\u200b‮x", "=" * 700]


def test_every_text_has_the_ids_of_the_vocabulary(spark):
    rows = [(i, t, i, "clash") for i, t in enumerate(TEXTS)] + [(0, "", 1, "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long, n_tokens string")
    got = [(r["doc_id"], r["ids"]) for r in tokens.encoded(df).collect()]
    assert len(got) == len(rows)
    for i, ids in got:
        assert ids == (REFERENCE.encode_ordinary(TEXTS[i]) if TEXTS[i] else [])
    assert tokens.encoded(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_the_reference(text):
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.encoder(tokens.vocabulary_path()).ids(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=200))
def test_scan_and_heap_merge_alike(word):
    ranks = tokens.encoder(tokens.vocabulary_path()).ranks
    assert tokens.scan_merge(word, ranks) == tokens.heap_merge(word, ranks)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_a_plan_uses_each_document_once_within_the_capacity(histogram):
    plan = packing.kinds(histogram, 64)
    used: dict = {}
    for n, content in plan:
        assert sum(s * m for s, m in content) <= 64
        for s, m in content:
            used[s] = used.get(s, 0) + n * m
    assert used == histogram


def test_containers(spark):
    texts = [("word " * n).strip() for n in (1, 5, 9, 30, 31, 64, 65, 200, 3, 3, 3)] + ["", None]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    out = packing.packed(df, 64, buckets=4).collect()
    sizes = {i: len(REFERENCE.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    total: dict = {}
    for r in out:
        assert (r["container_id"] is None) == (r["n_tokens"] == 0)
        total[r["container_id"]] = total.get(r["container_id"], 0) + r["n_tokens"]
    assert max(v for k, v in total.items() if k is not None) <= 64
    for i, n in sizes.items():
        own = sorted((r["piece"], r["start_token"], r["n_tokens"]) for r in out if r["doc_id"] == i)
        assert sum(x[2] for x in own) == n and (len(own) == 1 or n > 64)
    assert packing.packed(df.limit(0), 64).count() == 0


def test_one_size_with_most_documents(spark):
    df = spark.createDataFrame([(i, "same text here") for i in range(500)], "doc_id long, text string")
    n = len(REFERENCE.encode_ordinary("same text here"))
    out = packing.packed(df, 10 * n, buckets=8).groupBy("container_id").count().collect()
    assert len(out) == 50 and all(r["count"] == 10 for r in out)


def test_plain_harmonic_packing_holds_k_of_a_class(spark):
    df = spark.createDataFrame([(i, "a " * (i % 40)) for i in range(300)] + [(900, None), (901, "")], "doc_id long, text string")
    out = packing.packed(df, 64, buckets=4, fill=False).collect()
    full = {}
    for r in out:
        if r["n_tokens"]:
            full.setdefault(r["container_id"], []).append(r["n_tokens"])
    assert all(sum(v) <= 64 and len({64 // n for n in v}) == 1 and len(v) <= 64 // max(v) for v in full.values())
    assert {r["doc_id"] for r in out} == set(range(300)) | {900, 901} and len(full) >= len({r["container_id"] for r in packing.packed(df, 64, buckets=4).collect()} - {None})
