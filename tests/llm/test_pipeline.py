import random

import corpus_pipeline
from symatlas.llm import common


def test_stages(spark, small):
    docs = common.table(spark, small, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, small), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == before


def test_empty_table(spark, small):
    docs = common.table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def test_planted_cases(spark, docs, prose, small):
    benchmark = [r["text"] for r in common.table(spark, small, "benchmark").limit(3).collect()]

    def good(seed):
        rng = random.Random(seed)
        return " ".join(w if i % 3 else f"{w} {rng.choice('the of and to in is that it'.split())}" for i, w in enumerate(prose(seed, 150).split()))

    shared = prose(99, 80)
    texts = [good(1), good(1), good(2), good(3) + " " + shared, good(4) + " " + shared, benchmark[0] + ". " + good(6)[:300], "### " * 200, None]
    frame = docs(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = common.written(stage(spark, frame, small), name)
    out = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert out.keys() == {0, 2, 3, 4}
    assert shared not in out[3] and shared not in out[4] and out[0] == texts[0]


def test_planted_passage_of_51_words(spark, docs, prose, small):
    def good(seed):
        rng = random.Random(seed)
        return " ".join(w if i % 3 else f"{w} {rng.choice('the of and to in is that it'.split())}" for i, w in enumerate(prose(seed, 150).split()))

    shared = prose(99, 51)
    assert len(shared) < 400
    frame = docs([good(3) + " " + shared + " " + good(5), good(4) + " " + shared + " " + good(6)])
    for name, stage in corpus_pipeline.STAGES[:3]:
        frame = common.written(stage(spark, frame, small), name)
    out = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert out.keys() == {0, 1}
    assert all(shared not in t for t in out.values())


def test_columns_of_any_name_and_repeated_ids(spark, docs, prose, small):
    def good(seed):
        rng = random.Random(seed)
        return " ".join(w if i % 3 else f"{w} {rng.choice('the of and to in is that it'.split())}" for i, w in enumerate(prose(seed, 150).split()))

    frame = docs([(1, good(1)), (1, good(1)), (1, good(2)), (2, good(2)), (None, good(3)), (None, good(4)), (4, good(5))])
    frame = frame.selectExpr("*", "doc_id AS z", "2 AS name", "3 AS `a.b`", "4 AS c0", "5 AS first", "6 AS __hit_spans", "7 AS tag", "8 AS doc", "9 AS n_words")
    columns = frame.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, small)
        assert frame.columns == columns
    rows = frame.collect()
    assert {(r["z"], r["text"]) for r in rows} == {(1, good(1)), (1, good(2)), (None, good(3)), (None, good(4)), (4, good(5))}
    assert len(rows) == 5 and all((r["a.b"], r["first"], r["n_words"]) == (3, 5, 9) for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, frame, small).select("doc_id").distinct().count() == 3
