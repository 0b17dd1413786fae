import threading

import pytest
from pyspark.sql import functions as F

from symatlas.operators import grams, lookup
from symatlas.sources import files, store


def relations(spark, rows):
    """files and symbols from (uri, names)."""
    return {
        "files": spark.createDataFrame([(u, "kotlin") for u, _ in rows], "uri string, lang string"),
        "symbols": spark.createDataFrame([(u, n, i) for u, names in rows for i, n in enumerate(names)], "uri string, name string, ordinal int"),
    }


def symbols(frame):
    return sorted((r["uri"], r["name"]) for r in frame.collect())


def test_refresh_where_it_lies(spark, tmp_path):
    folder = str(tmp_path / "index")
    held = store.Store(spark, folder, 4)
    assert held.version() is None
    assert held.write(relations(spark, [("a", ["x", "y"]), ("b", ["z"]), ("c", [])]))
    before = held.read("symbols")
    # what is written comes from the index itself
    fresh = {"files": held.read("files").filter("uri = 'a'"), "symbols": held.read("symbols").filter("uri = 'a'").withColumn("name", F.concat("name", F.lit("2")))}
    assert files.refresh_index(spark, folder, spark.createDataFrame([("a",), ("b",)], "uri string"), fresh) == 2
    assert symbols(held.read("symbols")) == [("a", "x2"), ("a", "y2")]
    assert sorted(r["uri"] for r in held.read("files").collect()) == ["a", "c"]
    # a reader that began before sees the old version, by name and through the frame it has
    assert symbols(before) == symbols(held.read("symbols", 1)) == [("a", "x"), ("a", "y"), ("b", "z")]
    assert held.version()["files"] == 2


def test_many_replacements_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MANY_LAYERS", 3)
    held = store.Store(spark, str(tmp_path), 4)
    held.write(relations(spark, [("a", ["a0"]), ("b", ["b0"])]))
    for i in range(1, 4):
        held.replace(spark.createDataFrame([("a",)], "uri string"), relations(spark, [("a", [f"a{i}"])]))
    assert symbols(held.read("symbols")) == [("a", "a3"), ("b", "b0")]
    assert len(held.version()["layers"]) == 1 and held.version()["number"] == 5
    assert len(held.unread()) == 4 and held.unread(5) == []
    assert symbols(held.files(spark.createDataFrame([("b",)], "uri string"), "symbols")) == [("b", "b0")]


def test_killed_and_concurrent_writes(spark, tmp_path):
    held = store.Store(spark, str(tmp_path), 4)
    held.write(relations(spark, [("a", ["x"])]))

    @F.udf("string")
    def dies(value):
        raise RuntimeError("lost")

    broken = relations(spark, [("a", ["y"])])
    broken["symbols"] = broken["symbols"].withColumn("name", dies("name"))
    with pytest.raises(Exception, match="lost"):
        held.replace(spark.createDataFrame([("a",)], "uri string"), broken)
    assert symbols(held.read("symbols")) == [("a", "x")] and held.version()["number"] == 1

    outcomes = []

    def put(name):
        try:
            outcomes.append((name, store.Store(spark, str(tmp_path), 4).replace(spark.createDataFrame([("a",)], "uri string"), relations(spark, [("a", [name])]))))
        except store.Conflict:
            outcomes.append((name, None))

    threads = [threading.Thread(target=put, args=(n,)) for n in ("p", "q")]
    [t.start() for t in threads], [t.join() for t in threads]
    done = {name for name, number in outcomes if number}
    assert done and {n for _, n in symbols(held.read("symbols"))} <= done


def test_incomplete_does_not_replace(spark, tmp_path):
    held = store.Store(spark, str(tmp_path))
    held.write(relations(spark, [("a", ["x"]), ("b", [])]))
    assert not held.write(relations(spark, [("a", ["y"])]), complete=False)
    assert held.write(relations(spark, [("a", ["y"])]), complete=True)
    assert symbols(held.read("symbols")) == [("a", "y")]
    with pytest.raises(FileNotFoundError):
        held.read("nothing")


def test_library_is_read_for_misses_only(spark, tmp_path):
    library = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("name"), F.col("id").alias("line"))
    folder = str(tmp_path / "library")
    store.write_by_name(library, folder, 64)
    own = spark.createDataFrame([("n1", -1), ("mine", -2)], "name string, line long")

    def scanned(names):
        found = store.lookup_lazily(spark.createDataFrame([(n,) for n in names], "name string"), own, folder, 64)
        rows = sorted((r["name"], r["line"], r["origin"]) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
        return rows, plan

    rows, plan = scanned(["n1", "n7", "nobody"])
    assert rows == [("n1", -1, "workspace"), ("n7", 7, "library")]
    assert "dynamicpruning" in plan
    rows, plan = scanned(["n1", "mine"])
    assert rows == [("mine", -2, "workspace"), ("n1", -1, "workspace")]
    assert "FileScan parquet" not in plan.split("== Initial Plan ==")[0]


def test_trigram_search_equals_scan(spark, tmp_path):
    texts = [f"line {i} of text {i % 7}" for i in range(300)] + ["The License\nof License_2", "license", None, "", "ab", "İstanbul LICENSE", "x" * 50]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    path = str(tmp_path / "grams")
    grams.write_grams(frame, path)
    for needle in ("License", "text 3", "ab", "x", "nowhere", "xxxx", "line 12 of text 5 and more words behind it"):
        want = sorted(i for i, t in enumerate(texts) if t is not None and needle.lower() in t.lower())
        got = grams.rows_with(spark, path, needle).filter(F.lower("text").contains(needle.lower()))
        assert sorted(r["id"] for r in got.collect()) == want
    assert lookup.text_lines(spark, path, "License").select("id", "line_no").collect() == [(300, 0)]
    assert [r["id"] for r in lookup.text_documents(spark, path, "license").orderBy("id").collect()] == [300, 301, 305]


def test_stored_index_outlives_what_built_it(spark, tmp_path, monkeypatch):
    from symatlas.plans import tables

    spark.createDataFrame([(1, "a b a", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    folder = tables.search_index(spark, str(tmp_path))
    assert sorted(tuple(r) for r in spark.read.parquet(f"{folder}/postings").collect()) == [(1, "a", 2, 3), (1, "b", 1, 3)]

    def never(path):
        raise AssertionError("built again")

    assert tables.stored(spark, str(tmp_path), "documents", "search", never) == folder
    spark.createDataFrame([(2, "c", "en", "s")], "doc_id long, text string, lang string, source string").write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    with pytest.raises(AssertionError, match="built again"):
        tables.stored(spark, str(tmp_path), "documents", "search", never)


def test_chains_of_many_links_and_first_files(spark):
    from symatlas.operators import graph, index, resolve

    long = "A.m." + ".".join(f"n{i}" for i in range(20)) + ".end"
    returns = [("A.m", "T0<X>", 1)] + [(f"T{i}.n{i}", f"T{i + 1}", 1) for i in range(20)] + [("A.u", "Unit", 1)]
    edges = spark.createDataFrame([("c", long), ("c", "A.m.end"), ("c", "A.u.end"), ("c", "B.x.y.end"), ("c", "A.m"), ("c", "plain")], "caller string, callee string")
    got = {r["callee"]: r["resolved"] for r in graph.chained_callees(edges, spark.createDataFrame(returns, "key string, type string, seq int")).collect()}
    assert got == {long: "T20.end", "A.m.end": "T0.end", "A.u.end": "end", "B.x.y.end": "end", "A.m": "A.m", "plain": "plain"}

    placed = spark.createDataFrame([("f1", "p"), ("f2", "p"), ("f3", "p"), ("g", "q")], "file string, package string")
    definitions = spark.createDataFrame([("f1", "x", 9), ("f1", "x", 4), ("f2", "x", 2), ("f3", "x", 1), ("f3", "only", 5)], "file string, name string, line int")
    requests = spark.createDataFrame([(1, "f1", "x"), (2, "f2", "x"), (3, "f3", "only"), (4, "g", "x"), (5, "f1", "only")], "req int, file string, name string")
    assert sorted(tuple(r) for r in resolve.same_package(placed, definitions, requests).collect()) == [(1, "f2", 2), (2, "f1", 4), (5, "f3", 5)]

    spans = [("u", "A", 1, 9), ("u", "same", 1, 9), ("u", "in", 1, 5), ("u", "B", 9, 12), ("u", "late", 10, 10), ("u", "C", 12, 14), ("v", "D", 2, 2)]
    top = index.top_level(spark.createDataFrame(spans, "uri string, name string, start_line int, end_line int"))
    assert top.columns == ["uri", "name", "start_line", "end_line"]
    assert sorted(r["name"] for r in top.collect()) == ["A", "B", "C", "D", "same"]


def test_batch_tells_requests_of_one_number_apart(spark):
    requests = spark.createDataFrame([(1, "definition", "a"), (1, "definition", "b"), (1, "callers", "a"), (2, None, "a"), (3, "definition", None)], "req_id int, type string, name string")
    places = spark.createDataFrame([("a", "A:1"), ("b", "B:1")], "k string, at string")
    calls = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z")], "callee string, caller string")
    got = lookup.batch(requests, {"definition": (places, "k", F.col("at"), None), "callers": (calls, "callee", F.col("caller"), 2)})
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "callers", "x"), (1, "callers", "y"), (1, "definition", "A:1"), (1, "definition", "B:1"), (2, None, "unknown request null"), (3, "definition", "not found")]
