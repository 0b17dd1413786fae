import itertools

import numpy as np
import pytest

from symatlas.llm import graph, near_dedup as N


def brute(rows, size, percent=80):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        k = min(size, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[i]), min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))) for i, (d, _) in enumerate(rows)}


def edited(text, every, start=0):
    words = text.split()
    for i in range(start, len(words), every):
        words[i] = f"edit{start}{i}"
    return " ".join(words)


@pytest.fixture()
def family(prose):
    base = prose(1, 400)
    rows = [base, base.upper(), edited(base, 130), edited(base, 60), edited(base, 40), edited(base, 200, 7), edited(base, 25), prose(2, 300), prose(3, 9), prose(3, 9), "one two", "One  two", "one", "", None, "\x00  ", "Ä ä"]
    # chains: each text is close to the next only
    for k in range(12):
        words = base.split()
        rows.append(" ".join(words[k * 12 :] + prose(50, 300).split()[: k * 12]))
    return list(enumerate(rows))


@pytest.mark.parametrize("size", [4, 5])
def test_brute_force(docs, family, size):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.components_of(docs(family), size).collect()}
    assert got == brute(family, size)


def test_blocks(docs, family, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "_COLUMNS", 64)
    got = {r["doc_id"]: r["component_id"] for r in N.components_of(docs(family), 4).collect()}
    assert got == {d: c for d, (_, c) in brute(family, 4).items()}


def test_keep_first(docs, prose):
    a, b = prose(1), prose(2)
    frame = docs([(3, a), (1, a), (1, a), (2, b), (4, None), (5, ""), (None, a)])
    kept = N.keep_first(frame, 5)
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "5", "None"]
    assert N.keep_first(docs([]), 5).count() == 0


def test_keep_first_of_repeated_ids(docs, prose):
    a, b, c, d = (prose(i, 200) for i in range(1, 5))
    # under id 1 stand a, a close copy of it and b; c under id 2 is close to a text of id 0, whose other text stays too
    rows = [(1, a), (1, edited(a, 130)), (1, b), (5, b), (2, c), (0, edited(c, 130)), (2, d), (None, a), (None, prose(5)), (None, None), (1, a), (4, None), (4, None)]
    kept = [(r["doc_id"], r["text"]) for r in N.keep_first(docs(rows), 5).collect()]
    of_a = [k for k in kept if k in rows[:2]]
    assert len(of_a) == 1
    want = [(1, b), (0, edited(c, 130)), (2, d), (None, a), (None, prose(5)), (None, None), (4, None)]
    assert sorted(map(str, kept)) == sorted(map(str, want + of_a))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.9):
        n = 4000
        same = rng.integers(0, 2**63, int(2 * n * share / (1 + share)), np.uint64)
        a, b = (np.unique(np.concatenate([same, rng.integers(0, 2**63, n - len(same), np.uint64)])) for _ in range(2))
        assert abs((N.signature(N.common.mix64(a)) == N.signature(N.common.mix64(b))).mean() - share) < 0.15


def test_joining_leaves_no_link_out():
    sets = [np.arange(100), np.arange(5, 105), np.arange(10, 110), np.arange(500, 600)]
    assert len(N.joining([1, 2, 3, 4], sets, 80)) == 2


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (5, 5), (100, 1)], "a long, b long")
    assert {r["node"]: r["component"] for r in graph.components(edges).collect()} == {2: 1, 3: 1, 4: 1, 100: 1, 9: 8, 10: 8}
    assert graph.components(edges.limit(0)).count() == 0
