"""The pipeline's stages against plain Python on the smallest tables."""

from __future__ import annotations

from collections import defaultdict

import pytest

from tests.llm import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], DATA).cache())
    return out


def test_stages(spark, stages):
    from panelwright.llm.toxicity import toxicity

    raw, clean, single, apart, private, packed = stages
    assert all(s.columns == raw.columns and s.schema["doc_id"] == raw.schema["doc_id"] for s in stages[1:5])
    scores = {r.doc_id: r.predicted for r in toxicity(raw, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert set(texts) == {i for i, p in scores.items() if not p}
    want = brute.near_components(texts, 5, 80)
    left = {r.doc_id: r.text for r in single.collect()}
    assert set(left) == {i for i, (_, c) in want.items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    free = {r.doc_id: r.text for r in apart.collect()}
    assert set(free) == {i for i, t in left.items() if not brute.hits(t, items)[1]}
    hidden = {r.doc_id: r for r in private.collect()}
    assert set(hidden) == set(free)
    for i, r in hidden.items():
        assert not any(brute.pii(r.text).values()) and r.n_chars == len(r.text)
        if not any(brute.pii(free[i]).values()) and "[" not in r.text:
            assert r.text == free[i]
    tokens = defaultdict(int)
    for r in packed.collect():
        tokens[r.doc_id] += r.length
        total = r.doc_tokens
        assert len(r.ids) == r.length and tokens[r.doc_id] <= total
    assert set(tokens) == set(free)


def test_run(spark, stages):
    import corpus_pipeline

    key = ["doc_id", "start", "length", "ids_crc32"]
    got, want = corpus_pipeline.run(spark, DATA).select(key), stages[-1].select(key)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
