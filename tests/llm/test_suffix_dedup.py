import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from symatlas.llm import suffix_dedup as S


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + S.LENGTH] for b in raw for i in range(len(b) - S.LENGTH + 1))
    out = []
    for b in raw:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - S.LENGTH + 1):
            if seen[b[i : i + S.LENGTH]] > 1:
                hit[i : i + S.LENGTH] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], hit.view(np.int8)])) == 1))
        out.append((len(b), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cases(prose):
    a, b, shared = prose(1, 300), prose(2, 300), prose(3, 90)
    long = prose(4, 4000)
    texts = [a, a, b, b[:900] + "X" + b[901:], prose(5, 100) + shared + prose(6, 100), prose(7, 50) + shared + prose(8), shared, None, "", "short", "short"]
    passage = prose(11, 51)
    texts += [f"{prose(12, 60)} {passage} {prose(13, 60)}", f"{prose(14, 60)}\n{passage.replace(' ', '  ')} {prose(15, 60)}", "a b " * 60, prose(16, 50), prose(16, 50)]
    texts += ["é" * 500, "x" + "é" * 400 + "y", "a" * 1000, "a" * 399, "ab" * 300, long, long[3000:9000] + prose(9), a[:399], a[:400], a[1:401]]
    return texts


def check(frame, texts):
    rows = S.removed(frame).collect()
    assert {r["doc_id"]: tuple(r)[1:5] for r in rows} == dict(enumerate(brute(texts)))
    passages = brute_passages(texts)
    assert {r["doc_id"]: (r["n_passages"], r["has_passage"]) for r in rows} == {i: (n, n > 0) for i, n in enumerate(passages)}


def brute_passages(texts):
    words = [(t or "").encode().split() for t in texts]
    windows = [[tuple(w[i : i + S.PASSAGE]) for i in range(len(w) - S.PASSAGE + 1)] for w in words]
    seen = collections.Counter(x for own in windows for x in own)
    out = []
    for w, own in zip(words, windows):
        hit = np.zeros(len(w) + 1, bool)
        for i, x in enumerate(own):
            if seen[x] > 1:
                hit[i : i + S.PASSAGE] = True
        out.append(int(np.count_nonzero(np.diff(np.concatenate([[0], hit.view(np.int8)])) == 1)))
    return out


def test_brute_force(docs, prose):
    texts = cases(prose)
    check(docs(texts), texts)


def test_hot_cores_and_segments(docs, prose, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 700)
    monkeypatch.setattr(S, "GROUP", 1)
    texts = cases(prose)
    check(docs(texts), texts)


def test_repeated_rows_null_ids_and_empty_table(spark, docs, prose):
    a = prose(1, 200)
    frame = docs([(1, a), (1, a), (None, a), (None, prose(2, 200)), (1, prose(3, 200))])
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in S.removed(frame).collect())
    assert got == sorted([("1", len(a)), ("1", len(a)), ("None", len(a)), ("None", 0), ("1", 0)])
    assert S.removed(docs([])).count() == 0
    assert S.strip(docs([])).count() == 0


def test_strip_keeps_columns_and_whole_characters(docs, prose):
    passage = prose(1, 100)[:401]
    frame = docs(["ä" + passage + "ö end", "ü" + passage + " other", None])
    out = {r["doc_id"]: r for r in S.strip(frame).collect()}
    assert out[0].asDict().keys() == set(frame.columns)
    assert (out[0]["text"], out[1]["text"], out[2]["text"]) == ("äö end", "ü other", None)
    assert out[0]["n_chars"] == 6


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4))
def test_prefix_ranks_order_like_bytes(seed, letters):
    rng = random.Random(seed)
    raw = bytes(rng.choice(b"abcd"[:letters]) for _ in range(S.LENGTH + 60))
    rank = S.prefix_ranks(np.frombuffer(raw, np.uint8))
    prefixes = [raw[i : i + S.LENGTH] for i in range(len(raw) - S.LENGTH + 1)]
    order = {p: k for k, p in enumerate(sorted(set(prefixes)))}
    dense = np.unique(rank[: len(prefixes)], return_inverse=True)[1]
    assert dense.tolist() == [order[p] for p in prefixes]


@pytest.mark.parametrize("spans,want,runs", [([], b"abcdef", 0), ([(0, 2)], b"cdef", 1), ([(1, 3), (2, 4)], b"aef", 1), ([(0, 2), (2, 4)], b"ef", 1), ([(5, 6), (0, 1)], b"bcde", 2), ([(0, 6)], b"", 1)])
def test_cut(spans, want, runs):
    found = S.joined([{"words": False, "start": a, "end": b} for a, b in spans] + [{"words": True, "start": 0, "end": 1}])
    assert (S.cut(b"abcdef", found), len(found)) == (want, runs)


def test_columns_of_any_name(docs, prose):
    text = f"{prose(1, 60)} {prose(2, 60)}"
    frame = docs([text, text, None]).selectExpr("*", "1 AS z", "2 AS __doc", "3 AS c0", "4 AS `a.b`", "5 AS tag", "6 AS doc")
    out = S.strip(frame)
    assert out.columns == frame.columns
    assert sorted((r["doc_id"], r["text"], r["z"], r["__doc"], r["c0"], r["a.b"]) for r in out.collect()) == [(0, "", 1, 2, 3, 4), (1, "", 1, 2, 3, 4), (2, None, 1, 2, 3, 4)]


def test_strip_by_words(docs, prose):
    long, short, tiny = prose(1, 51), prose(2, 40), " ".join("abcdefghijklmnopqrstuvwxyz"[i % 26] for i in range(51))
    unspaced = prose(3, 200).replace(" ", "")[:450]
    assert len(long) < S.LENGTH and len(short) < S.LENGTH and len(tiny) == 101
    frame = docs([f"{prose(10 + i, 60)} {p} {prose(30 + i, 60)}" for i, p in enumerate(p for p in (long, short, tiny, unspaced) for _ in range(2))])
    out = {r["doc_id"]: r["text"] for r in S.strip(frame).collect()}
    for at, (passage, goes) in enumerate([(long, True), (short, False), (tiny, True), (unspaced, True)]):
        for i in range(2):
            assert (passage not in out[2 * at + i]) == goes


@pytest.mark.parametrize("length", [45, 101, 400, 1000])
def test_brute_force_of_other_lengths(docs, prose, monkeypatch, length):
    texts = cases(prose)
    frame = docs(texts)
    spans = {r["doc"]: r["spans"] for r in S.repeated(frame, S.packed(frame), (length, 0)).collect()}
    got = [S.cut((t or "").encode(), S.joined(spans.get(i))) for i, t in enumerate(texts)]
    monkeypatch.setattr(S, "LENGTH", length)
    assert [hashlib.sha256(g).hexdigest() for g in got] == [w[3] for w in brute(texts)]


def test_last_round_orders_only_the_strings_of_the_entries(monkeypatch):
    """The places that ranks are wanted for, not every suffix, are what the last round of doubling orders."""
    rng = random.Random(5)
    raw = bytes(rng.choice(b"ab") for _ in range(30)) * 400
    starts = np.arange(0, len(raw) - S.LENGTH, 97)
    sizes, ranked = [], S.ranked
    monkeypatch.setattr(S, "ranked", lambda key, *more: sizes.append(len(key)) or ranked(key, *more))
    rank = S.prefix_ranks(np.frombuffer(raw, np.uint8), starts=starts)
    prefixes = [raw[i : i + S.LENGTH] for i in starts]
    order = {p: k for k, p in enumerate(sorted(set(prefixes)))}
    assert np.unique(rank, return_inverse=True)[1].tolist() == [order[p] for p in prefixes]
    assert sizes[-1] == len(starts) and sizes[-2] <= 6 * len(starts)


@pytest.mark.parametrize("size", [50, 3000, 300_000, 2_200_000])
def test_prefix_ranks_of_any_size(size):
    """Places of 6, 12, 19 and 22 bits: ranks and places share a number, or no longer do."""
    rng = np.random.default_rng(size)
    raw = rng.integers(97, 99, size).astype(np.uint8)
    raw[size // 2 :] = raw[: size - size // 2]
    starts = rng.integers(0, size - 40, 200)
    rank = S.prefix_ranks(raw, 40, starts=starts)
    text = raw.tobytes()
    prefixes = [text[i : i + 40] for i in starts]
    order = {p: k for k, p in enumerate(sorted(set(prefixes)))}
    assert np.unique(rank, return_inverse=True)[1].tolist() == [order[p] for p in prefixes]


def test_short_texts_are_parsed_together(prose, monkeypatch):
    """Many short texts make a few blocks, and have the runs that each has alone."""
    texts = [prose(i, 150) for i in range(60)] + ["", "short", "ä" * 900]
    texts = [t.encode() for t in texts]
    calls, runs_of = [], S.runs_of
    monkeypatch.setattr(S, "runs_of", lambda *a: calls.append(1) or runs_of(*a))
    for which, length in enumerate((S.LENGTH, S.PASSAGE)):
        calls.clear()
        text, *columns = S.runs(texts, length, which)
        assert len(calls) <= 1 + sum(map(len, texts)) // S.BLOCK
        for i, t in enumerate(texts):
            alone = S.runs([t], length, which)[1:]
            assert [c[text == i].tolist() for c in columns] == [a.tolist() for a in alone]


def test_word_hashes():
    words = [b"a", b"b", b"a\0", b"\0a", b"\0", b"12345678", b"123456789", b"12345678\0", b"x" * 16, b"x" * 17, b"x" * 31, b"x" * 32, b"x" * 33, b"x" * 5000, b"y" + b"x" * 32, "ä".encode(), b"\xc2\xa0"]
    texts = [b" \t\n\v\f\r".join(words), b"", b" ", b"a", b"\na b\r", words[-4], b"b"]
    got = S.Words.several(texts)
    assert [len(g) for g in got] == [len(t.split()) for t in texts]
    assert len(set(got[0].tolist())) == len(words)
    by_word = dict(zip(words, got[0].tolist()))
    for t, g in zip(texts, got):
        assert g.tolist() == [by_word[w] for w in t.split()] == S.Words.symbols(t).tolist()
    assert [len(g) for g in S.Words.several([b""])] == [0]


def test_spans_of_a_batch_are_merged_like_those_of_each_row():
    rng = random.Random(3)
    rows = [None, []] + [[{"words": rng.random() < 0.5, "start": a, "end": a + rng.randrange(1, 9)} for a in (rng.randrange(60) + rng.choice([0, (1 << 32) - 70]) for _ in range(rng.randrange(12)))] for _ in range(50)]
    for row, got in zip(rows, S.merged(pa.array(rows, S._SPANS))):
        for words in (False, True):
            own = [(s["start"], s["end"]) for s in row or () if s["words"] == words]
            hit = sorted({i for a, b in own for i in range(a, b)})
            starts = [i for i in hit if i - 1 not in set(hit)]
            ends = [i + 1 for i in hit if i + 1 not in set(hit)]
            assert got[words] == list(zip(starts, ends)) == S.joined(row, words)
