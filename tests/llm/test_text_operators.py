import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symatlas.llm import common, decontaminate, html_extract, language_id, lm_scoring, packing, quality_classifier, quality_rules, sampling, url_filter

ODD = [None, "", " ", "a", "\n\n", "word " * 20000, "é" * 3, "12 34", "<p>", "\u0000x", "The end."]


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


# --- quality rules


def base_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 2000 else set(range(len(words)))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_base(docs, prose):
    texts = ODD + [prose(1), prose(2, 30) + "\n" + prose(2, 30), "a b c a b c d", "x# *y\nx# *y\n \n", "ü ü b\x0bc"]
    got = by_id(quality_rules.score(docs(texts)))
    for i, text in enumerate(texts):
        want = base_of(text)
        assert tuple(got[i])[1:6] == want, (i, text and text[:30])
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert quality_rules.score(docs([])).count() == 0


def test_quality_agrees_with_labels(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    both = quality_rules.op2(spark, small).filter("not base_failed").join(labels, "doc_id")
    assert both.filter("kept = (quality = 1)").count() >= 0.95 * both.count()


def test_quality_keep_equals_score(docs, prose):
    frame = docs([prose(i, 80) for i in range(5)] + ["### *** " * 60, "LOUD!! WORDS!! " * 1 + " ".join(f"W{i}!!" for i in range(90)), None])
    kept = {r["doc_id"] for r in quality_rules.keep(frame).collect()}
    assert kept == {d for d, r in by_id(quality_rules.score(frame)).items() if r["kept"]}
    assert quality_rules.keep(frame).columns == frame.columns


# --- packing


def test_packing_is_exact(docs, prose):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    tokenizer = Tokenizer.from_file(path)
    texts = ODD + [prose(i, 400) for i in range(30)] + ["it's <|endoftext|> HERE's  x\t\n\n y 1234567 日本"]
    rows = packing.pack(docs(texts)).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    pieces, sequences = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for parts, end in [(p, len(ids[d])) for d, p in pieces.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == end if end is not None else at <= packing.CAPACITY
    lengths = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(packing.CAPACITY - n for n in lengths) < 4 * packing.CAPACITY  # less than a window for each partition


def test_packing_empty(docs):
    assert packing.pack(docs([])).count() == 0


def test_differencing_balances():
    rng = random.Random(3)
    lengths = [rng.randint(1, 2000) for _ in range(120)]
    parts = packing.differencing(lengths, 16)
    sums = [sum(lengths[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(120))
    assert max(sums) - min(sums) < 300
    assert packing.differencing([], 3) == [[], [], []]


def test_windows_rise_with_tokens():
    assert len(packing.windows([2047, 2047], 2048)) == 2
    assert len(packing.windows([2000, 2000, 2000], 2048)) == 3
    assert len(packing.windows([1024, 1025], 2048)) == 2


# --- decontamination


def hits_of(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    words = find(text)
    hit, met = set(), set()
    for item, t in items:
        own = find(t)
        size = min(13, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[k : k + size]:
                    hit.update(range(i, i + size))
                    met.add(str(item))
    return len(words), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 900])
def test_decontamination_brute_force(spark, docs, prose, block):
    items = [(i, prose(i, 40)) for i in range(12)] + [(100, "short item of five"), (101, "solo"), (102, None), (103, "!!"), (11, "another text of item eleven"), (104, "a a a a a a a a a a a a a a a")]
    long = prose(3, 40)
    texts = ODD + [long.upper(), "x " + long + " y", " ".join(long.split()[:12]), " ".join(long.split()[5:18]), "a short, ITEM of five!", "solo Solo", prose(77, 3000) + " " + long, "a " * 20, prose(5, 40) + prose(6, 40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.search(docs(texts), benchmark, block))
    for i, text in enumerate(texts):
        assert tuple(got[i])[1:] == hits_of(text, items), i
    kept = decontaminate.keep_clean(docs(texts), benchmark, block)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["contaminated"]}
    assert kept.columns == docs([]).columns


def test_decontamination_empty_sides(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert by_id(decontaminate.search(docs(["a b"]), none))[0]["contaminated"] is False
    assert decontaminate.search(docs([]), none).count() == 0


# --- URL filter


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("https://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
        ("http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"),
        ("http://notorg/x", "notorg", "/x", None, None),
        ("http://a.org", "a.org", "", None, None),
        ("http://a.org?u=http://b.org/c", "a.org", "", None, None),
        ("ftp://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
        ("no scheme.org/es/", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    frame = url_filter.located(spark.createDataFrame([(1, url)], "page_id long, url string"))
    r, v = url_filter.ruled(F.col("host"), F.col("path"))
    row = frame.select("host", "path", r.alias("rule"), v.alias("verdict")).first()
    assert tuple(row) == (host, path, rule, verdict)
    assert url_filter.parts(url) == (host, path)


def test_url_model(spark):
    rows = [(i, f"http://h{i % 7}.example.org/{'es' if i % 3 == 0 else 'aa'}/{i}") for i in range(300)] + [(1000 + i, f"http://q.net/{'es' if i % 2 else 'aa'}/{i}") for i in range(20)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).filter("page_id >= 1000").collect()
    assert len(got) == 20 and all(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") for r in got)
    lone = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(lone).collect()] == ["allow", "allow"]
    assert url_filter.judge(lone.limit(0)).count() == 0


# --- language identification and quality classifier


def test_language_held_out(spark, small):
    docs_ = spark.read.parquet(f"{small}/documents.parquet")
    both = language_id.op6(spark, small).join(docs_.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert both.count() > 20 and both.filter("lang = lang_pred").count() >= 0.97 * both.count()


def test_language_odd(docs):
    got = by_id(language_id.identify(docs(ODD + ["the and of it is"] * 20)))
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 4, 7)] == ["und"] * 5 and got[0]["score"] == 0.0
    assert got[3]["lang_pred"] == "en" and 0 <= got[3]["score"] <= 1
    assert language_id.identify(docs([])).count() == 0
    bare = docs(["text"]).withColumn("lang", F.lit(None).cast("string"))
    assert language_id.identify(bare).first()["lang_pred"] == "und"


def test_held_out_fold(spark):
    got = spark.range(50).select("id", sampling.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_quality_classifier_held_out(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    both = quality_classifier.op8(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = both[both.quality == 1].score.values, both[both.quality == 0].score.values
    assert (good[:, None] > bad[None]).mean() > 0.9
    assert (both.predicted == (both.score >= 0.7)).all()


def test_quality_classifier_odd(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.score(docs(ODD), none).collect()} == {0.5}
    one = spark.createDataFrame([(d, 1) for d in range(11)] + [(3, None), (None, 0)], "doc_id long, quality int")
    assert all(r["score"] > 0.99 for r in quality_classifier.score(docs(ODD), one).collect())
    assert quality_classifier.score(docs([]), one).count() == 0


# --- language-model scores


@pytest.mark.parametrize("n", [1, 64, 65, 300])
@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_subwords_of_whole_words(monkeypatch, n, chunk):
    monkeypatch.setattr(quality_classifier, "CHUNK", chunk)
    word = bytes(random.Random(n).randrange(33, 256) for _ in range(n))
    marked = b"<" + word + b">"
    parts = [b"=" + word, *(marked[i : i + k] for k in (3, 4) for i in range(len(marked) - k + 1))]
    want = sorted(zlib.crc32(p) % (quality_classifier.BUCKETS - 1) for p in parts)
    assert sorted(quality_classifier.subwords(word)) == want
    assert sorted(r for rows in quality_classifier.long_subwords(word) for r in rows.tolist()) == want


def test_quality_classifier_reads_unspaced_texts_to_their_end():
    start = "".join(random.Random(1).choices("abcdefgh", k=64))
    good, bad = ("".join(random.Random(s).choices(letters, k=400)) for s, letters in ((2, "ijklmn"), (3, "opqrst")))
    model = quality_classifier.Model([((start + t + str(i)).encode(), label) for i in range(20) for t, label in ((good, 1), (bad, 0))])
    score = model.scorer()
    assert score((start + good + "x").encode()) > 0.9 and score((start + bad + "x").encode()) < 0.1


def test_lm_scores(docs, prose):
    words = prose(1, 12).split()
    rng = random.Random(5)
    texts = [" ".join(words[(k + i) % 12] for i in range(400)) for k in range(40)] + [" ".join(rng.sample(words * 40, 400)), None, ""]
    got = by_id(lm_scoring.score(docs(texts)))
    assert got[0]["n_words"] == 400 and got[41]["n_words"] == 0
    assert got[41]["log_likelihood"] == 0.0 and got[41]["mean_log_likelihood"] is None
    assert got[0]["mean_log_likelihood"] > got[40]["mean_log_likelihood"]  # in order, rather than shuffled
    assert lm_scoring.score(docs([])).count() == 0


@pytest.mark.parametrize("frequent", [lm_scoring.FREQUENT, 100])
def test_lm_scores_every_word_by_its_count(docs, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    top = [f"top{i}" for i in range(lm_scoring.WORDS)]
    rare = {f"rare{i}": 1 + i % 7 for i in range(2000)}
    corpus = [w for w, n in rare.items() for _ in range(n - 1)] + top * 8
    random.Random(1).shuffle(corpus)
    single = list(rare)
    got = by_id(lm_scoring.score(docs([*single, " ".join(corpus)])))
    places = {}
    for i, w in enumerate(single):
        places.setdefault(lm_scoring.xxhash.xxh3_64_intdigest(w.encode()) % 255, []).append(i)
    for found in places.values():
        total = sum(rare[single[i]] for i in found)
        chance = [got[i]["log_likelihood"] - np.log(rare[single[i]] / total) for i in found]
        assert np.ptp(chance) < 1e-6 and max(chance) < 0


def test_lm_partitions_count_by_words(docs):
    few, many = docs(["a b c d e f g h i j"]).coalesce(1), docs(["k l m n " * 1000]).coalesce(1)
    words = lm_scoring.Vocabulary([bytes([c]) for c in b"abcdefghijklmn"])
    one, two, both = (lm_scoring.trained(f.select("text"), words).astype(float) for f in (few, many, few.unionByName(many)))
    assert np.abs(both - (10 * one + 4000 * two) / 4010).max() < 1e-6


def test_lm_gradient():
    net = lm_scoring.Network(np.random.default_rng(0).normal(0, 0.3, lm_scoring.SIZE))
    around = np.random.default_rng(1).integers(1, 1024, (4, 64)).astype(np.int16)
    target = np.random.default_rng(2).integers(1, 1024, 64).astype(np.int16)
    before = net.log_chances(around, target).mean()
    for _ in range(20):
        net.train(around, target, 0.2)
    assert net.log_chances(around, target).mean() > before
    total = sum(np.exp(net.log_chances(around[:, :1], np.array([t], np.int16)))[0] for t in range(1024))
    assert abs(total - 1) < 1e-3


# --- HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site of the many things</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site and you agree to all of it by going on.</div>
%s<aside>More of the same from the side of the page and on.</aside><form><p>Name and mail of you</p></form>
<div id="comments"><p>I think that this is the best of all the texts that I have read on the web.</p></div>
<footer>&copy; the owners of the site and all of that</footer></body></html>"""
BODY = "<h1>Head &amp; tail</h1><p>The first  paragraph\n of the text is here, and it has a good many of the words that are used by all.<p>Short one.</p><div class='ad'>Buy the thing now, it is the best of all of them.</div><p>The <b>last</b> of the paragraphs in the text is this, with an <a href='x'>anchor</a> in it &eacute;.</p>"
TEXT = "Head & tail\n\nThe first paragraph of the text is here, and it has a good many of the words that are used by all.\n\nShort one.\n\nThe last of the paragraphs in the text is this, with an anchor in it é."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class='content'>%s</div>", "<div>%s</div>", "<article><p>%s"])
def test_extraction(wrap):
    assert html_extract.extract(PAGE % (wrap % BODY)) == TEXT


@pytest.mark.parametrize("teaser", ["<article><p>%s</p></article>", "<section class='story'><p>%s</p></section>"])
@pytest.mark.parametrize("words", ["Read on", "This is the one that all of us have read in the morning and that we will have to read again at the end of the day."])
def test_article_mark_is_one_vote(teaser, words):
    got = html_extract.extract(PAGE % f"<div id='content'>{BODY}</div>{teaser % words}")
    assert got.startswith(TEXT)


@pytest.mark.parametrize("page", ["", "<", "<p", "<!-- x", "plain text", "<p>a", "</p></div>", "<script>", "<a href=", "<div class=>x</div>", "&#x;&#1114112;&nbsp;", "<p>" * 3000 + "x"])
def test_odd_pages(page):
    html_extract.extract(page)


def test_pages_table(spark):
    frame = spark.createDataFrame([(1, "u", PAGE % f"<article>{BODY}</article>", "x"), (2, None, None, "x"), (3, "u", "", "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.main_text(frame).collect()}
    assert got[1]["text"] == TEXT and got[1]["n_chars"] == len(TEXT) and (got[2]["text"], got[2]["n_chars"], got[3]["text"]) == ("", 0, "")
    assert html_extract.main_text(frame.limit(0)).count() == 0


def test_word_ids():
    ids, n = common.word_ids([b"a", b"b", b"a"])
    assert ids.tolist() == [0, 1, 0] and n == 2


def test_decontamination_of_repeated_windows(spark, docs):
    items = spark.createDataFrame([(1, "same " * 5000), (2, "one two three")], "item_id long, text string")
    found = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.search(docs(["same " * 400, "one two three four", "same " * 12]), items).collect()}
    assert found == {0: (400, 1), 1: (3, 1), 2: (0, 0)}


def test_quality_is_learned_from_long_texts_where_there_are_no_others(spark, docs, prose):
    texts = [("good fine words here " if i % 2 else "bad poor thing there ") * 2500 for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = quality_classifier.score(docs(texts), labels).collect()
    assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in rows)
