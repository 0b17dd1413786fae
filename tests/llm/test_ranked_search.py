import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from symatlas.llm import oracles, ranked_search


def brute(docs, items, top=10):
    """(item, rank, doc_id, score) by scoring every document, item as its place."""
    terms = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    n_docs, n_terms = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for ts in terms for t in set(ts))
    out = []
    for item, text in enumerate(items):
        asked = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found = []
        for (doc_id, _), ts in zip(docs, terms):
            tf, score = Counter(ts), 0
            for t in asked:
                if tf[t]:
                    score += ranked_search.weight(n_docs, df[t]) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * (25 + 75 * len(ts) * n_docs // n_terms)))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda r: r[:3])[:top])]
    return out


@pytest.fixture()
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "Ça", "漢字"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(700)]
    docs += [(i, "same text of all Copies") for i in range(700, 900)] + [(7, docs[7][1]), (None, "same text of all copies"), (None, None), (901, None), (902, ""), (903, " -- \x7f"), (904, "w1 " * 70000)]
    items = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(25)] + ["copies of all", "w1", "W1;w1 w1", None, "", "...", "nowhere", "nowhere same"]
    return docs, items


def test_search_equals_brute_force(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK", 16)
    table = docs(corpus[0]).repartition(3)
    n_docs, n_terms = ranked_search.statistics(table)
    index = ranked_search.index_of(table, n_docs, n_terms)
    got = sorted(map(tuple, ranked_search.search(index, n_docs, corpus[1]).collect()))
    assert got == sorted(brute(*corpus))


def test_sets_of_queries_and_repeats(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", 200)
    texts = [*corpus[1][:6], corpus[1][0], None]
    items = spark.createDataFrame([(i % 6, t, 1) for i, t in enumerate(texts)], "item_id int, text string, doc_id int")
    assert len(list(ranked_search.query_sets(items, 200))) > 2
    got = sorted(map(tuple, ranked_search.searched(docs(corpus[0]), items).collect()))
    assert got == sorted((i % 6, *r) for i, *r in brute(corpus[0], texts))


def test_empty_tables(spark, docs, corpus):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked_search.searched(docs([]), items).count() == 0
    assert ranked_search.searched(docs([None, ""]), items).count() == 0
    assert ranked_search.searched(docs(corpus[0][:20]), items.limit(0)).count() == 0


def test_bounds_hold_and_prune(corpus):
    docs, items = corpus
    queries = ranked_search.Queries(items)
    queries.weighted(900, {int(t): 5 for t in queries.terms})
    block = ranked_search.Block()
    for doc_id, text in docs[:60]:
        block.add(doc_id, Counter(ranked_search.terms_of(text.encode())), 900, 18000)
    row = dict(zip(("terms", "ends", "maxima", "docs", "impacts", "ids"), block.row()))
    upper = ranked_search.bounds(queries, np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["maxima"], np.uint32))
    opened = ranked_search.Opened(queries, row)
    for q in range(queries.n):
        scores = opened.scores(q)
        assert scores.max() <= upper[q] and (upper[q] == 0) == (scores.max() == 0)


def test_oracle(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = sorted(con.sql(oracles.RANKED_SEARCH).fetchall())
    assert sorted(map(tuple, ranked_search.op13(spark, small).collect())) == want
