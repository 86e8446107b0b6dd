"""The pipeline's stages, each on what the one before kept."""

import collections

import corpus_pipeline
import pytest

from cytoloom.llm import pii, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages_keep_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_each_stage(spark, steps):
    docs, good, lone, clean, mixed, packed = steps
    scores = quality.score_documents(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r[0] for r in good.select("doc_id").collect()} == {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    comp = {i: i for i in sets}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in lone.collect()} == {i for i in comp if find(i) == i}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {r["doc_id"]: pii.redact(r["text"]) for r in lone.collect()}
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 2 and set(copies) <= {r["doc_id"] for r in clean.collect()}
    assert collections.Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == copies


def test_run_gives_the_last_stage(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[-1].count()
