import random
from functools import lru_cache

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from symatlas.operators import complete, graph, index, infer, lookup, resolve, search, stats
from symatlas.sources import files


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_reach_cycle_target_and_leaf(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "caller string, callee string")
    assert [r["path"] for r in graph.reach(spark, edges, "a").collect()] == ["a > b > c", "a > d"]
    assert [r["path"] for r in graph.reach(spark, edges, "a", "c").collect()] == ["a > b > c"]
    assert graph.reach(spark, edges, "a", depth=1).count() == 2
    one = graph.reach(spark, edges, "a", limit=1).collect()
    assert [(r["path"], r["truncated"]) for r in one] == [("a > b > c", True)]
    assert [(r["path"], r["truncated"]) for r in graph.reach(spark, edges, "a", limit=2).collect()] == [("a > b > c", False), ("a > d", False)]


def simple_paths(edges, entry, target, depth):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def walk(path):
        more = [n for n in sorted(out.get(path[-1], ())) if n not in path]
        if target is not None:
            if path[-1] == target:
                yield path
                return
        elif not more or len(path) > depth:
            yield path
            return
        if len(path) <= depth:
            for n in more:
                yield from walk([*path, n])

    return [" > ".join(p) for p in walk([entry])]


@pytest.mark.parametrize("target", [None, "c", "z"])
def test_reach_as_by_brute_force(spark, target):
    rng = random.Random(3)
    edges = sorted({(rng.choice("abcdef"), rng.choice("abcdefg")) for _ in range(16)})
    frame = spark.createDataFrame(edges, "caller string, callee string")
    for depth, limit in ((3, 1000), (6, 1000), (6, 5)):
        want = simple_paths(edges, "a", target, depth)
        got = graph.reach(spark, frame, "a", target, depth, limit).collect()
        assert [r["path"] for r in got] == want[:limit]
        assert all(r["truncated"] == (len(want) > limit) for r in got)


def test_reach_in_a_complete_graph(spark):
    names = [f"n{i:02d}" for i in range(12)]
    edges = spark.createDataFrame([(a, b) for a in names for b in names if a != b], "caller string, callee string")
    got = graph.reach(spark, edges, "n00").collect()
    assert len(got) == 1000 and all(r["truncated"] and r["length"] == 8 for r in got)
    assert got[0]["path"] == " > ".join(names[:9])


def test_call_tree_marks_cycles(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("a", "c", 2)], "caller string, callee string, seq int")
    assert [(r["name"], r["cycle"]) for r in graph.call_tree(spark, edges, "a", 5).orderBy("path_seq").collect()] == [("a", False), ("b", False), ("a", True), ("c", False)]


def test_hierarchy_ends_on_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c")], "sub string, super string")
    assert rows(graph.hierarchy(edges, "a", 4)) == [("b", 1), ("c", 2)]


def test_resolve_entry(spark):
    keys = spark.createDataFrame([("A.run",), ("B.run",), ("C.stop",)], "key string")
    assert rows(graph.resolve_entry(keys, "stop")) == [("C.stop", "found")]
    assert rows(graph.resolve_entry(keys, "run")) == [("A.run", "ambiguous"), ("B.run", "ambiguous")]
    assert rows(graph.resolve_entry(keys, "A.run")) == [("A.run", "found")]


def test_alignment_removes_first():
    assert graph.aligned(["a", "b", "c"], ["a", "x", "c"]) == [("same", "a"), ("removed", "b"), ("added", "x"), ("same", "c")]
    assert graph.aligned([], ["a"]) == [("added", "a")]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_alignment_by_brute_force(before, after):
    @lru_cache(None)
    def longest(i, j):
        if i == len(before) or j == len(after):
            return 0
        return longest(i + 1, j + 1) + 1 if before[i] == after[j] else max(longest(i + 1, j), longest(i, j + 1))

    want, i, j = [], 0, 0
    while i < len(before) or j < len(after):
        if i < len(before) and j < len(after) and before[i] == after[j]:
            want.append(("same", before[i]))
            i, j = i + 1, j + 1
        elif i < len(before) and (j == len(after) or longest(i + 1, j) >= longest(i, j + 1)):
            want.append(("removed", before[i]))
            i += 1
        else:
            want.append(("added", after[j]))
            j += 1
    assert graph.aligned(list(before), list(after)) == want


def test_version_diff(spark):
    before = spark.createDataFrame([("e", ["a", "b"]), ("gone", ["x"])], "entry string, steps array<string>")
    after = spark.createDataFrame([("e", ["b", "c"])], "entry string, steps array<string>")
    assert rows(graph.version_diff(before, after)) == [("e", 0, "removed", "a"), ("e", 1, "same", "b"), ("e", 2, "added", "c"), ("gone", 0, "removed", "x")]


def test_chained_callees(spark):
    edges = spark.createDataFrame([("f", "A.b.c"), ("f", "A.x.c"), ("f", "plain"), ("f", "A.b.c.d")], "caller string, callee string")
    returns = spark.createDataFrame([("A.b", "B", 1), ("B.c", "C", 1), ("A.x", "Unit", 1)], "key string, type string, seq int")
    got = {r["callee"]: r["resolved"] for r in graph.chained_callees(edges, returns).collect()}
    assert got == {"A.b.c": "B.c", "A.x.c": "c", "plain": "plain", "A.b.c.d": "C.d"}


def test_long_chains_and_type_arguments(spark):
    edges = spark.createDataFrame([("f", "A.b.c.d.e.f.g.h"), ("f", "A.l.m")], "caller string, callee string")
    chain = [("A.b", "B", 1), ("B.c", "C", 1), ("C.d", "D<Int>", 1), ("D.e", "E", 1), ("E.f", "F", 1), ("F.g", "G", 1), ("A.l", "List<Thing>", 1)]
    returns = spark.createDataFrame(chain, "key string, type string, seq int")
    assert {r["resolved"] for r in graph.chained_callees(edges, returns).collect()} == {"G.h", "List.m"}


def test_identity_is_not_merged(spark):
    edges = spark.createDataFrame([("A.f", "g", "x.kt"), ("A.f", "h", "y.kt")], "caller string, callee string, file string")
    assert rows(graph.callees(edges, "A.f", "x.kt")) == [("g",)]


def test_first_tier(spark):
    one = spark.createDataFrame([(1, "a")], "q int, hit string")
    two = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "q int, hit string")
    assert rows(resolve.first_tier([one, two], "q")) == [(1, 1, "a"), (2, 2, "c"), (2, 2, "d")]


def test_missing_imports(spark):
    names = spark.createDataFrame([("f", "A"), ("f", "B"), ("f", "C"), ("f", "A")], "file string, name string")
    fqns = spark.createDataFrame([("A", "x.A"), ("B", "x.B"), ("B", "y.B")], "name string, fqn string")
    assert {(r["name"], r["status"], r["fqn"]) for r in resolve.missing_imports(names, fqns).collect()} == {("A", "unique", "x.A"), ("B", "ambiguous", None), ("C", "unknown", None)}


def test_reference_kinds(spark):
    frame = spark.createDataFrame([(["call", "import"],), (["write"],), ([],)], "ctx array<string>")
    assert [r[0] for r in frame.select(resolve.classified(F.col("ctx"))).collect()] == ["import", "write", "read"]


def test_risk(spark):
    frame = spark.createDataFrame([(5, 0), (6, 0), (51, 0), (5, 11), (6, 11), (0, 0)], "t int, c int")
    assert [r[0] for r in frame.select(stats.risk(F.col("t"), F.col("c"))).collect()] == ["low", "medium", "high", "medium", "high", "low"]


def test_replace_purges_stale_rows(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "uri string, v int")
    fresh = spark.createDataFrame([("a", 9)], "uri string, v int")
    assert rows(index.replaced(old, fresh, fresh)) == [("a", 9), ("b", 2)]


def test_top_level_and_importable(spark):
    symbols = spark.createDataFrame([("u", "A", 0, 9), ("u", "m", 2, 3), ("u", "B", 0, 9), ("v", "A", 0, 1)], "uri string, name string, start_line int, end_line int")
    files = spark.createDataFrame([("u", "p"), ("v", None)], "uri string, package string")
    assert rows(index.importable(symbols, files)) == [("A", ["p.A"]), ("B", ["p.B"])]


def test_latest_artifact(spark):
    frame = spark.createDataFrame([("g", "a", "1.9.0"), ("g", "a", "1.10.0"), ("g", "b", "2.0-alpha"), ("g", "b", "2.0-1")], "group string, artifact string, version string")
    assert rows(index.latest_artifacts(frame)) == [("g", "a", "1.10.0"), ("g", "b", "2.0-1")]


def test_completion_rules(spark):
    rows_ = [("userName", "property", 0, ""), ("UserRepo", "class", 0, ""), ("userName", "property", 3, ""), ("USER_ID", "constant", 3, ""), ("theuser", "property", 1, "")]
    frame = spark.createDataFrame(rows_, "name string, kind string, tier int, fqn string")
    assert [(r["name"], r["tier"]) for r in complete.complete(frame, "user").collect()] == [("userName", 0), ("USER_ID", 3)]
    assert [r["name"] for r in complete.complete(frame, "User").collect()] == ["UserRepo", "userName"][:1] + ["userName"]


def test_stored_index_gives_the_same_scores(spark, tmp_path):
    texts = ["red ring red", "ring bolt", "blue bolts and rings", "red", ""]
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", t.split()) for i, t in enumerate(texts)], "id int, kind string, tokens array<string>")
    search.write_index(docs, str(tmp_path))
    for words in (["red"], ["ring", "bo"], ["red", "red", "r"], ["none"]):
        for kept in (None, F.col("kind") == "b"):
            want = rows(search.bm25(docs if kept is None else docs.filter(kept), words).withColumn("score", F.round("score", 9)))
            assert rows(search.bm25_stored(spark, str(tmp_path), words, kept).withColumn("score", F.round("score", 9))) == want


def test_excluded_folders(spark, tmp_path):
    root = tmp_path / "build" / "w"
    for name in ("src/A.kt", "build/B.kt", "x/.cxx/C.kt", ".claude/plans/D.kt", ".claude/commands/E.kt", "dist/F.java", "vendor/G.swift"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("class X")
    want = {"A.kt", "F.java", "G.swift"}  # E.kt is in a hidden folder
    assert {r["uri"].rpartition("/")[2] for r in files.texts(spark, str(root)).collect()} == want
    assert {r["path"].rpartition("/")[2] for r in files.listing(spark, str(root)).collect()} == want
    assert files.texts(spark, str(root), exclude=False).count() == 4


def test_first_fact_wins(spark):
    declared = spark.createDataFrame([], "key string, type string")
    facts = spark.createDataFrame([("x", "Zeta", 1), ("x", "Alpha", 2)], "key string, type string, seq int")
    calls = spark.createDataFrame([], "key string, receiver string, method string")
    returns = spark.createDataFrame([], "owner string, method string, type string")
    assert rows(infer.variable_types(declared, facts, calls, returns)) == [("x", "Zeta")]


def test_lookups(spark):
    symbols = spark.createDataFrame([("u", "readFile", "method", "Io", "m/a", "Reads it. Version two", 3), ("u", "Io", "class", None, "m/a", None, 1)], "uri string, name string, kind string, owner string, module string, documentation string, sel_line int")
    assert [r["name"] for r in lookup.find(symbols, "readFile", owner="x.Io", kinds=["METHOD"], module="m/").collect()] == ["readFile"]
    assert lookup.find(symbols, part="READ").count() == 1 and lookup.find(symbols, kinds=["class"], module="q").count() == 0
    assert [r["name"] for r in lookup.documented(symbols, "version").collect()] == ["readFile"]
    lines = spark.createDataFrame([("Io()",), ("Iox",), ("x.Io",)], "text string")
    assert lookup.word_lines(lines, "Io").count() == 2
    assert rows(lookup.known_names(symbols, symbols.filter("kind = 'class'"))) == [("Io",)]
    imports = spark.createDataFrame([("u", "a.B"), ("u", "a.B"), ("v", "a.B"), ("v", "c")], "uri string, full_path string")
    assert rows(lookup.importers(imports)) == [("a.B", 2, 3), ("c", 1, 1)] and rows(lookup.imports_of(imports, "a.")) == [("u",), ("v",)]
    assert rows(lookup.with_library(symbols.select("name"), symbols.filter("sel_line = 1").select("name"))) == [("Io", "library"), ("Io", "workspace"), ("readFile", "workspace")]
    assert tuple(stats.cache_statistics(symbols.withColumn("detail", F.lit(""))).first()) == (2, 1, 0, 1)


def test_implementors_are_added_without_a_shuffle_of_them(spark):
    edges = [("c", "I.run"), ("c", "J.run"), ("c", "A.run"), ("c", "I.run"), ("d", "I.stop"), ("d", "K.run"), (None, "I.run"), (None, "A.run"), ("e", "plain"), ("e", "I.x.run"), ("c", None), ("d", "AB.run")]
    implementors = [("I", "A"), ("I", "B"), ("J", "AB"), ("I", "AB"), ("I", "B"), ("plain", "p.q"), ("K", None), ("I", None)]
    bodies = [("I.stop",)]
    got = graph.with_implementors(*(spark.createDataFrame(t, s) for t, s in ((edges, "caller string, callee string"), (bodies, "key string"), (implementors, "super string, sub string"))))
    want = set(edges)
    for caller, callee in edges:
        if callee is not None and (callee,) not in bodies:
            parts = callee.split(".")
            want |= {(caller, ".".join(x for x in (sub, parts[-1]) if x is not None)) for sup, sub in implementors if sup == parts[0]}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    # what is made distinct are edges and implementors, not all that is added
    many = spark.range(300).selectExpr("concat('c', id) AS caller", "'I.run' AS callee")
    types = spark.range(300).selectExpr("'I' AS super", "concat('s', id) AS sub")
    added = graph.with_implementors(many, spark.createDataFrame([], "key string"), types)
    assert added.count() == 300 + 300 * 300
    plan = added._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith("Aggregate")


def test_added_edges_come_from_lists_and_edges_are_read_once(spark, monkeypatch):
    edges = [(None if i == 3 else f"c{i % 9}", f"T{i % 4}.m{i % 5}") for i in range(400)] + [("c1", "s1.m1"), (None, "s7.m3"), ("c2", "s11.x"), ("c2", "s4.m1"), ("c0", None)]
    implementors = [(f"T{i % 4}", f"s{i}") for i in range(40)] + [("T1", "s4"), ("T2", None)]
    want = set(edges) | {(c, f"{sub}.{e.split('.')[1]}" if sub else e.split(".")[1]) for c, e in edges if e for sup, sub in implementors if e.split(".")[0] == sup and e != "T2.m2"}
    tables = [spark.createDataFrame(t, s) for t, s in ((edges, "caller string, callee string"), ([("T2.m2",)], "key string"), (implementors, "super string, sub string"))]
    for most, sent in ((1 << 10, 1 << 20), (3, 0)):
        monkeypatch.setattr(graph, "LIST", most, raising=False)
        monkeypatch.setattr(graph, "SENT", sent, raising=False)
        got = graph.with_implementors(*tables)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    # before, each use of the edges read the calls again, and each added edge was made by itself
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "LogicalRDD" not in plan
