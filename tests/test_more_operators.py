import time

import pytest
from pyspark.sql import functions as F

from symatlas.operators import complete, diagnose, edits, graph, index, infer, lookup, output, resolve
from symatlas.functions import standard
from symatlas.sources import files
from symatlas.streaming import changes
from symatlas.streaming.progress import Progress


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def edit(a, b, c, d, new="X"):
    return {"start_line": a, "start_col": b, "end_line": c, "end_col": d, "new_text": new}


@pytest.mark.parametrize(
    "text,list_,want",
    [
        ("abc", [edit(0, 1, 0, 2)], ("aXc", None)),
        ("a\nb", [edit(0, 1, 1, 0, "")], ("ab", None)),
        ("a😀b", [edit(0, 3, 0, 4)], ("a😀X", None)),
        ("a😀b", [edit(0, 2, 0, 3)], (None, "no place 0:2")),
        ("abc", [edit(0, 0, 0, 2), edit(0, 1, 0, 3)], (None, "overlapping ranges")),
        ("abc", [edit(0, 2, 0, 1)], (None, "reversed range")),
        ("abc", [edit(3, 0, 3, 0)], (None, "no place 3:0")),
        ("abc", [edit(0, 1, 0, 1), edit(0, 1, 0, 2, "Y")], ("aXYc", None)),
        ("", [edit(0, 0, 0, 0)], ("X", None)),
    ],
)
def test_edits(text, list_, want):
    assert edits.applied(text, list_) == want


def test_preview(spark):
    texts = spark.createDataFrame([("u", "val a = a\n")], "uri string, text string")
    changes = spark.createDataFrame([("u", 0, 4, 0, 5, "b")], "uri string, start_line int, start_col int, end_line int, end_col int, new_text string")
    got = edits.preview(texts, changes).first()
    assert got["text"] == "val b = a\n" and got["error"] is None and "-val a = a" in got["diff"]


def test_when_and_self_initialisers(spark):
    text = "fun f() {\n when (x) {\n  1 -> a()\n }\n when (y) { else -> b() }\n val q = q\n val r = s\n}"
    texts = spark.createDataFrame([("u", text)], "uri string, text string")
    assert rows(diagnose.when_without_else(texts)) == [("u", "x")]
    lines = texts.select("uri", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    assert [r["line_no"] for r in diagnose.self_initialised(lines).collect()] == [5]


def test_inputs(spark):
    listing = spark.createDataFrame([("/a/b/c.kt",)], "path string")
    inputs = spark.createDataFrame([("/a/b/c.kt",), ("/a/b",), ("/a/x",)], "path string")
    assert rows(diagnose.requested(inputs, listing)) == [("/a/b", False), ("/a/b/c.kt", False), ("/a/x", True)]


def test_islands(spark):
    lines = spark.createDataFrame([("u", i, t) for i, t in enumerate("xx.xxx.x")], "uri string, line_no int, text string")
    assert rows(diagnose.islands(lines, F.col("text") == "x")) == [("u", 0, 1), ("u", 3, 5)]


def test_types_follow_calls(spark):
    declared = spark.createDataFrame([("a", "A")], "key string, type string")
    facts = spark.createDataFrame([("a", "Z"), ("b", "B")], "key string, type string")
    calls = spark.createDataFrame([("c", "a", "m"), ("d", "c", "n"), ("e", "Util", "k")], "key string, receiver string, method string")
    returns = spark.createDataFrame([("A", "m", "List<C>"), ("List", "n", "D"), ("Util", "k", "U")], "owner string, method string, type string")
    assert rows(infer.variable_types(declared, facts, calls, returns)) == [("a", "A"), ("b", "B"), ("c", "List<C>"), ("d", "D"), ("e", "U")]


def test_highlights_and_hints(spark):
    tokens = spark.createDataFrame([("u", 0, 4, "x", ["declaration"]), ("u", 1, 0, "x", []), ("u", 2, 0, "x", ["write"])], "uri string, line int, col int, text string, ctx array<string>")
    assert [r[3] for r in rows(infer.highlights(tokens, "x"))] == ["write", "read", "write"]
    symbols = spark.createDataFrame([("u", "x", "property", None, 0, 5), ("u", "y", "property", "Int", 1, 5)], "uri string, name string, kind string, return_type string, sel_line int, sel_end_col int")
    types = spark.createDataFrame([("u", "x", "Foo"), ("u", "y", "Int")], "uri string, var string, type string")
    assert rows(infer.hints(symbols, types)) == [("u", 0, 5, ": Foo")]


def test_json_leaves_empty_fields_out(spark):
    frame = spark.createDataFrame([("a", "", None, 0)], "name string, kind string, doc string, line int")
    assert output.as_json(frame).first()["json"] == '{"name":"a","line":0}'


def test_enriched_signature(spark):
    symbols = spark.createDataFrame([(1, "fun get(k: K): V", ["K", "V"])], "symbol_id long, detail string, type_params array<string>")
    arguments = spark.createDataFrame([(1, ["String", "Int"])], "symbol_id long, args array<string>")
    assert infer.enriched(symbols, arguments).first()["signature"] == "fun get(k: String): Int"


def test_declarations_and_types_in_text(spark):
    lines = spark.createDataFrame([("u", i, t) for i, t in enumerate(["import a.Box", "// Box", "private enum Box {", "val x: Box = Box()", "class Tin : Box()", "fun Jar.Box() = List(1)"])], "uri string, line_no int, text string")
    assert sorted((r["line_no"], r["kind"]) for r in lookup.declared_lines(lines, "Box").collect()) == [(2, "enum"), (5, "function")]
    assert [r["line_no"] for r in lookup.implementor_lines(lines, "Box").collect()] == [4]
    assert sorted((r["name"], r["line"], r["uses"]) for r in lookup.used_types(lines, [], 3).collect()) == [("Box", 3, 5), ("Jar", 6, 1), ("Tin", 5, 1)]
    symbols = spark.createDataFrame([("Box", "v", 0, "enum Box")], "name string, uri string, ordinal int, detail string")
    assert [(r["name"], r["signature"]) for r in lookup.injected(lines, symbols, [], 2).collect()] == [("Box", "enum Box"), ("Tin", "")]
    assert (lookup.mode("auto", True), lookup.mode("auto", False), lookup.mode("fast", True)) == ("smart", "fast", "fast")


def test_import_tier(spark):
    imports = spark.createDataFrame([("f", 0, "a.b.Outer.Event", "Event", False), ("f", 1, "c.Event", "Event", False), ("g", 0, "c.Event", "Event", False), ("g", 1, "a.*", "*", True)], "file string, seq int, path string, local_name string, is_star boolean")
    qualified = spark.createDataFrame([("c.Event", "c.kt", 1)], "fqn string, def_file string, line int")
    definitions = spark.createDataFrame([("Event", "a.b", "outer.kt", 2), ("Event", "a.b.inner", "inner.kt", 3), ("Event", "a.bc", "other.kt", 4)], "name string, package string, def_file string, line int")
    requests = spark.createDataFrame([(1, "f", "Event"), (2, "g", "Event"), (3, "h", "Event")], "req int, file string, name string")
    assert sorted(map(tuple, resolve.via_imports(imports, qualified, definitions, requests).collect())) == [(1, "inner.kt", 3), (1, "outer.kt", 2), (2, "c.kt", 1)]


def test_scoped_references(spark):
    texts = {"a": ["package p", "class Box { fun open() {} }", "open()"], "b": ["import p.Box.open", "open()"], "c": ["Tin.open()", "Box.open()"], "d": ["package p", "open()"], "e": ["import p.*", "open()"]}
    lines = spark.createDataFrame([(f, i, t) for f, ts in texts.items() for i, t in enumerate(ts)], "file string, line int, text string")
    tokens = spark.createDataFrame([(f, i, t.index("open"), "open") for f, ts in texts.items() for i, t in enumerate(ts) if "open" in t], "file string, line int, col int, text string")
    imports = spark.createDataFrame([("b", "p.Box.open", False), ("e", "p", True)], "file string, path string, is_star boolean")
    files = spark.createDataFrame([("a", "p"), ("d", "p"), ("b", None), ("c", None), ("e", None)], "file string, package string")
    found = lambda **more: [(r["file"], r["line"]) for r in resolve.scoped_references(tokens, lines, imports, files, "open", **more).collect()]
    assert found() == [("a", 1), ("a", 2), ("b", 1), ("c", 0), ("c", 1), ("d", 1), ("e", 1)]
    assert found(parent="Box", declared_in=files.filter("file = 'a'")) == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]
    assert found(package="p") == [("a", 1), ("a", 2), ("d", 1), ("e", 1)]
    assert found(package="p", origin="a") == [("a", 2), ("d", 1), ("e", 1)]


def test_call_hierarchy_refuses_ambiguity(spark):
    catalog = spark.createDataFrame([("A.run", "run", "a"), ("B.run", "run", "b"), ("A.go", "go", "a")], "key string, name string, file string")
    edges = spark.createDataFrame([("A.go", "A.run", "a"), ("X.y", "go", "x"), ("A.go", "B.run", "other")], "caller string, callee string, file string")
    asked = lambda *a: [tuple(r) for r in graph.call_hierarchy(catalog, edges, *a).collect()]
    assert asked("run") == [("ambiguous", "A.run"), ("ambiguous", "B.run")] and asked("none") == [("unknown", "none")]
    assert asked("A.run") == [("found", "A.go")] and asked("go") == [("found", "X.y")] and asked("A.go", False) == [("found", "A.run")]


def test_implementations_and_supers(spark):
    types = spark.createDataFrame([(f"T{i + 1}", f"T{i}") for i in range(12)], "sub string, super string")
    assert graph.implementations(types, "T0").count() == 12
    lines = spark.createDataFrame([("u", 4, "class Q : T12 {")], "uri string, line_no int, text string")
    assert [r["name"] for r in graph.implementations(types, "T12", lines).collect()] == ["u:5"]
    symbols = spark.createDataFrame([("T1", None, "u", 3), ("run", "T1", "u", 5)], "name string, owner string, uri string, sel_line int")
    assert [tuple(r) for r in graph.super_members(symbols, types, "T2").collect()] == [("T1", "u", 3)]
    assert [tuple(r) for r in graph.super_members(symbols, types, "T2", "run").collect()] == [("T1", "u", 5)]


def test_when_blocks_with_nested_braces(spark):
    texts = ["when (x) { 1 -> { if (a) { b { c() } } } }", "when (x) { 1 -> { a() }\n else -> b() }", "when (x) { 1 -> a()\n 2 -> b() }", "when { a -> b }"]
    frame = spark.createDataFrame(list(enumerate(texts)), "uri int, text string")
    assert [(r["uri"], r["subject"]) for r in diagnose.when_without_else(frame).collect()] == [(0, "x")]


def test_cross_package_gate(spark):
    frame = spark.createDataFrame([("UserRepo", 2, "a.UserRepo"), ("userName", 2, "a.userName"), ("MyUserRepo", 2, "a.MyUserRepo")], "name string, tier int, fqn string")
    names = lambda p: [r["name"] for r in complete.complete(frame, p).collect()]
    assert names("Us") == ["UserRepo"] and names("us") == [] and names("U") == []


@pytest.mark.parametrize(
    "text,want",
    [("f(", ("f", 0)), ("f(a, g(b, c), ", ("f", 2)), ("f(a, g(b, ", ("g", 1)), ('f("x, (", ', ("f", 1)), ("f(a) ", None), ("x = [1, ", None), ("map<Int>(", ("map", 0)), ("f(a, [1, 2], ", ("f", 2)), ("f(1) { g ", None), ("", None)],
)
def test_active_call(text, want):
    assert infer.active_call(text) == want


def test_signature_help_labels_and_phases(spark):
    kind = "uri string, ordinal int, name string, kind string, detail string, deprecated boolean, return_type string, sel_line int, sel_col int, start_line int, end_line int, parameters array<struct<name:string,type:string>>"
    symbols = spark.createDataFrame([("u", 0, "send", "method", "suspend fun send(a: Int, b: Text): Unit", False, "Unit", 1, 12, 1, 3, [("a", "Int"), ("b", "Text")]), ("u", 1, "size", "property", "val size: Int", True, "Int", 5, 4, 5, 5, [])], kind)
    requests = spark.createDataFrame([(1, "x.send(1, "), (2, "nothing"), (3, None)], "req int, before string")
    assert [tuple(r) for r in infer.signature_help(requests, symbols).select("req", "active", "parameter").collect()] == [(1, 1, "b")]
    labels = {r["name"]: (r["label_detail"], r["label_type"]) for r in infer.label_details(symbols).collect()}
    assert labels == {"send": ("(a: Int, b: Text)", "Unit"), "size": ("", "Int")}
    tokens = spark.createDataFrame([("u", 1, 12, "send"), ("u", 2, 4, "a"), ("u", 4, 4, "a"), ("u", 9, 0, "size")], "uri string, line int, col int, text string")
    got = {(r["line"], r["text"]): (r["type"], r["modifiers"]) for r in infer.token_phases(tokens, symbols).collect()}
    assert got == {(1, "send"): ("method", 1 | 16), (2, "a"): ("parameter", 0), (5, "size"): ("property", 1 | 2 | 32), (9, "size"): ("property", 2 | 32)}


def test_argument_and_lambda_types(spark):
    symbols = spark.createDataFrame([("f", "u", 0, [("a", "Int"), ("b", "Text")])], "name string, uri string, ordinal int, parameters array<struct<name:string,type:string>>")
    arguments = spark.createDataFrame([(1, "f", 1, None), (2, "f", 0, "b"), (3, "f", 7, None)], "call int, callee string, position int, label string")
    assert sorted((r["call"], r["type"]) for r in infer.argument_types(arguments, symbols).collect()) == [(1, "Text"), (2, "Text")]
    types = spark.createDataFrame([("u", "xs", "List<Product>"), ("u", "n", "Int?")], "uri string, var string, type string")
    calls = spark.createDataFrame([("u", "xs", "map"), ("u", "xs", "apply"), ("u", "n", "let"), ("u", "n", "map")], "uri string, receiver string, method string")
    assert sorted((r["receiver"], r["method"], r["word"], r["type"]) for r in infer.lambda_types(calls, types).collect()) == [("n", "let", "it", "Int"), ("xs", "apply", "this", "List<Product>"), ("xs", "map", "it", "Product")]


def test_documentation_and_roots(spark):
    text = "Sends it, see {@link Box} and [Tin].\n@param a the first\n@return nothing\n@throws Oops never\n@since 2"
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(output.rendered_documentation(F.col("t"))).first()[0] == "Sends it, see `Box` and `Tin`.\n- `a`: the first\n- returns nothing\n- throws `Oops`: never\n- since 2"
    assert files.source_roots(["/w/"], [], ["/l", "/w"]) == [("/w", False), ("/l", True)] and files.source_roots(["/w"], ["/c"], ["/l"], False) == [("/c", False)]
    assert (files.max_files("12"), files.max_files("x", 3), files.max_files(None)) == (12, 3, None)


def test_warm_paths_and_progress(spark, tmp_path):
    listing = spark.createDataFrame([("a", 5), ("b", 9), ("c", 8), ("d", 7)], "path string, mtime_secs long")
    manifest = spark.createDataFrame([("a",), ("gone",), ("b",)], "path string")
    assert sorted(r["path"] for r in index.warm(manifest, listing, 10).collect()) == ["a", "b", "c"]
    seen = Progress()
    spark.streams.addListener(seen)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"uri": "u", "ts": "2024-01-01T00:00:00", "op": "change", "text": "A", "generation": 1}\n')
    query = changes.change_files(spark, str(tmp_path / "in")).writeStream.format("noop").queryName("ticks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    for _ in range(100):
        if seen.counters.get("ticks", {}).get("state") == "ended":
            break
        time.sleep(0.1)
    spark.streams.removeListener(seen)
    assert seen.counters["ticks"]["rows"] == 1 and seen.counters["ticks"]["state"] == "ended"


def test_sdk_and_namespaces(spark, tmp_path):
    for level in ("android-9", "android-34", "android-x"):
        (tmp_path / "sdk/sources" / level).mkdir(parents=True)
    (tmp_path / "local.properties").write_text(f"a=b\nsdk.dir = {tmp_path}/sdk\n")
    assert files.sdk_sources(str(tmp_path), {}).endswith("android-34") and files.sdk_sources(str(tmp_path / "sdk"), {}) is None
    assert files.sdk_sources(str(tmp_path / "sdk"), {"ANDROID_HOME": f"{tmp_path}/sdk"}).endswith("android-34")
    rows_ = [("/m/src/main/AndroidManifest.xml", '<manifest package="a.b">'), ("/m/build.gradle.kts", 'namespace = "c.d"'), ("/n/build.gradle.kts", ' android {\n  namespace = "e.f"'), ("/o/AndroidManifest.xml", "<manifest>")]
    assert rows(files.namespaces(spark.createDataFrame(rows_, "path string, text string"))) == [("/m", "a.b"), ("/n", "e.f")]


def test_qualified_access(spark):
    symbols = spark.createDataFrame([("App", "client", "a", 1, "Client"), ("Client", "send", "c", 2, "Reply<Int>?"), ("Reply", "code", "r", 3, "Int"), ("Base", "close", "b", 4, None), ("App", "close", "a", 5, None)], "owner string, name string, uri string, sel_line int, return_type string")
    supers = spark.createDataFrame([("App", "Base")], "sub string, super string")
    types = spark.createDataFrame([("f", "x", "net.Client")], "uri string, var string, type string")
    asked = [(1, "this", "client"), (2, "super", "close"), (3, "Client", "send"), (4, "x", "send"), (5, "client.send", "code"), (6, "y", "send"), (7, "this", "close"), (8, "this.client.send", "code")]
    requests = spark.createDataFrame([(r, "f", "App", q, n) for r, q, n in asked], "req int, file string, owner string, qualifier string, name string")
    assert rows(resolve.qualified_access(requests, symbols, supers, types)) == [(1, "a", 1), (2, "b", 4), (3, "c", 2), (4, "c", 2), (5, "r", 3), (7, "a", 5), (8, "r", 3)]


def test_standard_members(spark):
    found = standard.members_of(spark.createDataFrame([("List<Int>",), ("kotlin.String?",), ("Box",)], "type string"))
    names = lambda t: {r["name"] for r in found.filter(F.col("type") == t).collect()}
    assert {"map", "let", "size"} <= names("List<Int>") and {"trim", "let", "length"} <= names("kotlin.String?") and "let" in names("Box") and "map" not in names("Box")
    table = {(r["receiver"], r["name"]): (r["kind"], r["return_type"]) for r in standard.members(spark).collect()}
    assert table["collection", "size"] == ("property", "Int") and table["collection", "groupBy"][1] == "Map<K, List<T>>" and len(table) == len(standard.ANY + standard.COLLECTION + standard.STRING)
