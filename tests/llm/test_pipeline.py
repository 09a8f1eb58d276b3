"""The pipeline stage by stage: columns, what goes and what stays, and the last stage's digests."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from docquarry.llm import bpe, common, decontaminate, ngram_join, quality

from test_line_dedup import deduped
from test_ngram_join import expected


@pytest.fixture(scope="module")
def stages(spark, tiny):
    docs = common.table(spark, tiny, "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(common.written(stage(spark, seen[-1], tiny)))
    return seen


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert stages[5].columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_quality_stage(spark, tiny, stages):
    weights = quality.train(stages[0], common.table(spark, tiny, "labels"))
    scores = {r.doc_id: r.score for r in quality.with_score(stages[0], weights).collect()}
    assert {i for i, _ in pairs(stages[1])} == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    assert dict(pairs(stages[1])).items() <= dict(pairs(stages[0])).items()


def test_line_stage(stages):
    wanted = {k for k in deduped(pairs(stages[1])) if k[1].strip()}
    assert set(pairs(stages[2])) == wanted


def test_near_copies_stage(stages):
    groups = expected(pairs(stages[2]), 5, 80)
    assert {i for i, _ in pairs(stages[3])} == {i for i, _, c in groups if i == c}


def test_benchmark_stage(spark, tiny, stages):
    items = common.table(spark, tiny, "benchmark")
    before, after = dict(pairs(stages[3])), dict(pairs(stages[4]))
    hits = {r.doc_id for r in decontaminate.report(stages[3], items).where("contaminated").collect()}
    assert all(after[i] == t for i, t in before.items() if i not in hits)
    left = decontaminate.report(stages[4], items)
    assert left.where("n_hit > 0").count() == 0


def test_token_stage(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(common.tokenizer_path(bpe.VOCABULARY))
    texts = dict(pairs(stages[4]))
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run(spark, tiny, stages):
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, tiny).collect())
    assert got == sorted((r.doc_id, r.ids_sha256) for r in stages[5].collect())


def test_stages_take_empty_tables(spark, tiny, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, tiny))
    assert docs.count() == 0


def test_stages_take_odd_rows(spark, tiny, edge):
    docs = edge
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, tiny)
        assert docs.columns == edge.columns
        docs = common.written(docs)
    assert ngram_join.components(docs).count() == docs.count()


def test_tables_on_the_way_are_removed(spark):
    from docquarry.llm import common
    from docquarry.sources import folders

    ways = []

    def make():
        one = common.written(spark.range(10))
        two = common.written(one.selectExpr("id + 1 AS id"))
        ways.extend(common._tables[-2:])
        return one.unionByName(two)

    found = common.written_alone(make, spark)
    assert found.count() == 20 and common._tables[-1] not in ways
    assert not any(folders.exists(spark, w) for w in ways)
