"""Queries that SQL cannot express, against plain recomputation."""

import bisect
import collections
import math
import zlib

import numpy as np
import pytest
import xxhash

from symatlas.llm import decontaminate, html_extract, language_id, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, suffix_dedup, url_filter


def softmax(z):
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def slow_posteriors(counts):
    """Expectation-maximisation of two classes and independent three-way votes, one pattern and rule at a time."""
    digits = {c: quality_rules.votes(c) for c in counts}
    rules = range(len(quality_rules.RULES))
    good = {c: 1 / (1 + math.exp(1.5 * d.count(0) - 2.0)) for c, d in digits.items()}
    for _ in range(quality_rules.ROUNDS):
        mass = [1.0 + sum(n * (1 - good[c]) for c, n in counts.items()), 1.0 + sum(n * good[c] for c, n in counts.items())]
        chance = []
        for label, lean in ((0, (2.0, 1.0, 1.0)), (1, (1.0, 1.0, 2.0))):
            table = [list(lean) for _ in rules]
            for c, n in counts.items():
                for r in rules:
                    table[r][digits[c][r]] += n * (good[c] if label else 1 - good[c])
            chance.append([[x / sum(row) for x in row] for row in table])
        fresh = {}
        for c, d in digits.items():
            odds = [math.log(mass[k] / sum(mass)) + sum(math.log(chance[k][r][d[r]]) for r in rules) for k in (0, 1)]
            fresh[c] = softmax(odds)[1]
        moved, good = max(abs(fresh[c] - good[c]) for c in counts), fresh
        if moved < 1e-9:
            break
    return good


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_posteriors(seed):
    rng = np.random.default_rng(seed)
    counts = collections.Counter()
    for good in rng.random(3000) < 0.7:
        votes = rng.choice(3, len(quality_rules.RULES), p=[0.05, 0.25, 0.7] if good else [0.5, 0.3, 0.2])
        counts[int(sum(v * 3**k for k, v in enumerate(votes)))] += 1
    fitted, slow = quality_rules.fit(counts), slow_posteriors(counts)
    assert fitted.keys() == slow.keys() and max(abs(fitted[c] - slow[c]) for c in counts) < 1e-6


def test_quality_verdicts(spark, small):
    counts = quality_rules.pattern_counts(quality_rules.features(spark.read.parquet(f"{small}/documents.parquet")))
    slow = slow_posteriors(counts)
    codes = {r["doc_id"]: r for r in quality_rules.features(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    for r in quality_rules.op2(spark, small).collect():
        own = codes[r["doc_id"]]
        assert r["kept"] == (not own["base_failed"] and slow[own["votes"]] >= quality_rules.THRESHOLD)


def test_lm_scores_word_by_word(docs, prose):
    texts = [prose(i % 7, 40 + i) + " " + "THE of " * (i % 5) for i in range(60)] + [None, ""]
    frame = docs(texts).coalesce(1)
    words = [(t or "").encode().lower().split() for t in texts]
    counts = collections.Counter(w for own in words for w in own)
    top = sorted(counts, key=lambda w: (-counts[w], w))[: lm_scoring.WORDS]
    vocabulary = lm_scoring.Vocabulary(top)
    net = lm_scoring.Network(lm_scoring.trained(frame.select("text"), vocabulary))
    rest = vocabulary.rest
    slot = lambda w: xxhash.xxh3_64_intdigest(w) % len(rest)
    totals = collections.Counter()
    for w, n in counts.items():
        if w not in vocabulary.places:
            totals[slot(w)] += n
    got = {r["doc_id"]: r for r in lm_scoring.score(frame).collect()}
    for i, own in enumerate(words):
        places = [lm_scoring.EDGE] * lm_scoring.SIDE
        places += [vocabulary.places[w] if w in vocabulary.places else rest[slot(w)] for w in own] + [lm_scoring.EDGE] * lm_scoring.SIDE
        want = 0.0
        for k, w in enumerate(own):
            at = k + lm_scoring.SIDE
            around = [places[at + d] for d in (*range(-lm_scoring.SIDE, 0), *range(1, lm_scoring.SIDE + 1))]
            hidden = np.tanh(sum(net.context[j][p].astype(float) for j, p in enumerate(around)))
            group, member = divmod(places[at], lm_scoring.MEMBERS)
            p = softmax((net.classes @ hidden + net.class_bias).tolist())[group]
            q = softmax((net.members[group] @ hidden + net.member_bias[group]).tolist())[member]
            want += math.log(p + 1e-12) + math.log(q + 1e-12) + (0.0 if w in vocabulary.places else math.log(counts[w] / totals[slot(w)]))
        assert got[i]["n_words"] == len(own)
        assert abs(got[i]["log_likelihood"] - want) <= 1e-4 * max(1, abs(want))


def slow_rule(host, path):
    fits = [(len(rule), rule, verdict) for rule, verdict in url_filter.RULES if (host == (at := rule.split("/", 1)[0]) or host.endswith("." + at)) and path.startswith("/" + rule.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def test_url_verdicts(spark, small):
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()]
    parts = {p: url_filter.parts(u) for p, u in pages}
    rules = {p: slow_rule(*parts[p]) for p, _ in pages}
    learned = sorted(((u, *parts[p], int(rules[p][1] == "allow")) for p, u in pages if rules[p][0]), key=lambda r: r[0])
    model = url_filter.Model(learned)

    def walk(tree, row):
        return tree if not isinstance(tree, tuple) else walk(tree[2] if row[tree[0]] <= tree[1] else tree[3], row)

    got = {r["page_id"]: r for r in url_filter.op5(spark, small).collect()}
    assert len(got) == len(pages) and any(not r[0] for r in rules.values())
    for p, url in pages:
        host, path = parts[p]
        row = got[p]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rules[p][0])
        if rules[p][0]:
            assert row["verdict"] == rules[p][1] and row["allow_chance"] is None
            continue
        values = url_filter.lexical(url, host, path) + [rate.get(key, model.prior) for rate, key in zip(model.rates, url_filter.endings(host, path))]
        bins = [bisect.bisect_right(edges.tolist(), x) for edges, x in zip(model.edges, values)]
        chance = 1 / (1 + math.exp(-(model.start + sum(url_filter.RATE * walk(t, bins) for t in model.trees))))
        assert abs(row["allow_chance"] - chance) < 1e-9 and row["verdict"] == ("allow" if chance >= 0.5 else "block")


def test_language_kernel(spark, small):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.learned(frame.select("doc_id", "text", "lang"))

    def grams(text):
        raw = text.encode().lower()
        return {raw[i : i + n] for n in range(1, language_id.ORDER + 1) for i in range(len(raw) - n + 1)}

    rows = [r for r in frame.filter("lang is not null and text is not null").collect()]
    got = {r["doc_id"]: r for r in language_id.op6(spark, small).collect()}
    known = {bytes(int(c) // 256 ** (n - k) % 256 for k in range(n + 1)) for n, codes in enumerate(model.kernel.codes) for c in codes}
    marks = [{g for g, hit in zip(sorted_grams(model), row) if hit} for row in model.kernel.landmarks > 0]
    for r in rows[:40]:
        own = grams(r["text"]) & known
        kernel = [len(own & m) / math.sqrt(max(1, len(own)) * max(1, len(m))) for m in marks]
        chance = softmax([language_id.SHARPNESS * (sum(k * w for k, w in zip(kernel, column)) + o) for column, o in zip(model.weights.T.astype(float), np.ravel(model.offset))])
        best = max(range(len(chance)), key=chance.__getitem__)
        assert got[r["doc_id"]]["lang_pred"] == model.languages[best] and abs(got[r["doc_id"]]["score"] - chance[best]) < 1e-3
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())


def sorted_grams(model):
    return [bytes(int(c) // 256 ** (n - k) % 256 for k in range(n + 1)) for n, codes in enumerate(model.kernel.codes) for c in codes]


def test_language_of_long_texts_only(docs, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 200)
    rows = [(i, ("der und die das " if i % 2 else "the and of it is ") * (5 if i % 2 else 40 + i)) for i in range(40)]
    frame = docs(rows).selectExpr("doc_id", "text", "case when doc_id % 2 = 1 then 'de' else 'en' end AS lang")
    assert {(r["doc_id"] % 2, r["lang_pred"]) for r in language_id.identify(frame).collect()} == {(1, "de"), (0, "en")}


def test_quality_scores(spark, small):
    frame, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.learned(frame, labels)
    got = {r["doc_id"]: r for r in quality_classifier.op8(spark, small).collect()}
    for r in frame.collect():
        words = (r["text"] or "").encode().split()
        pairs = list(zip(words, words[1:]))
        rows = [quality_classifier.AGAIN] * (quality_classifier.AGAIN_WEIGHT * (len(pairs) - len(set(pairs))))
        for w in words:
            marked = b"<" + w + b">"
            parts = [b"=" + w] + [marked[i : i + k] for k in range(quality_classifier.SHORTEST, quality_classifier.LONGEST + 1) for i in range(len(marked) - k + 1)]
            rows += [zlib.crc32(x) % (quality_classifier.BUCKETS - 1) for x in parts]
        mean = sum(float(model.shares[x]) for x in rows) / max(1, len(rows))
        want = 1 / (1 + math.exp(-max(-500.0, min(500.0, model.bias + mean))))
        own = got[r["doc_id"]]
        assert abs(own["score"] - want) < 1e-6 and own["predicted"] == (own["score"] >= 0.7) and own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_extraction_passes(spark, small):
    """Density, length and links decide most blocks that are not in boilerplate places; short ones follow their neighbours."""
    counts = collections.Counter()
    for r in spark.read.parquet(f"{small}/pages.parquet").limit(100).collect():
        for b in html_extract.blocks(r["html"] or ""):
            if not b.place.bad:
                counts[html_extract.first_label(b, set())] += 1
    assert counts[1] > 0.5 * sum(counts.values()) and counts[None] > 0


TEXT_OPERATORS = {
    "op1": suffix_dedup.removed, "op2": quality_rules.score, "op3": lm_scoring.score, "op4": packing.pack, "op10": lambda d: near_dedup.components_of(d, 4),
    "op6": language_id.identify, "op7": lambda d: decontaminate.search(d, d.selectExpr("cast(doc_id as string) AS item_id", "text").limit(1)),
    "op8": lambda d: quality_classifier.score(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")),
}
CLASHING = "1 AS score, 2 AS kept, 3 AS n_words, 'x' AS held_out, 4 AS z, 5 AS node, 6 AS component, 7 AS tag, 8 AS core, 9 AS `row`, 10 AS start".split(", ")


@pytest.mark.parametrize("name", TEXT_OPERATORS)
def test_further_columns_and_repeated_rows(docs, prose, name):
    operator = TEXT_OPERATORS[name]
    rows = [(i, prose(i, 70)) for i in range(4)] + [(None, prose(9, 70)), (5, None), (6, ""), (7, "ß " * 30000)]
    frame = docs(rows + rows)
    plain = sorted(map(repr, map(tuple, operator(frame.select("doc_id", "text", "lang").coalesce(1)).collect())))
    more = sorted(map(repr, map(tuple, operator(frame.selectExpr("doc_id", "text", "lang", *CLASHING).coalesce(1)).collect())))
    assert plain == more
    if name != "op4":
        assert len(plain) == 2 * len(rows) and plain[::2] == plain[1::2]


@pytest.mark.parametrize("operator", [url_filter.judge, html_extract.main_text])
def test_further_columns_and_repeated_pages(spark, operator):
    rows = [(1, "http://a.org/x", "<p>text</p>"), (1, "http://a.org/x", "<p>text</p>"), (None, None, None), (None, None, None), (3, "http://b.net/" + "y" * 100000, "<p>" + "the and of " * 50000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = sorted(map(repr, map(tuple, operator(frame).collect())))
    more = sorted(map(repr, map(tuple, operator(frame.selectExpr("*", "'x' AS host", "'y' AS path", "'z' AS rule", "'w' AS verdict", "'v' AS text", "1 AS n_chars")).collect())))
    assert plain == more and len(plain) == 5
