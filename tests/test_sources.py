import pytest

from symatlas.sources import extract, files
from symatlas.sources.scanner import Scan

KOTLIN = '''package demo.app

import demo.net.Socket
import demo.text.*
import demo.model.User as Person

/** Keeps sessions. */
@Deprecated("use Pool")
class Sessions(private val socket: Socket) : Store<Person>(), Closable {
    private val cache = Cache<String>(8)
    override fun open(id: String, tries: Int = 2): List<Person> {
        val s = Socket("}")
        s.send(id) // not { a(call)
        return wrap(cache.all())
    }
    fun <T> List<T>.third(): T = get(2)
}
data class Pair2(val a: Int, val b: Int)
'''
JAVA = """package demo;
import java.util.Map;
public class Service<T> extends Base<T> implements Runnable {
  static final int MAX = 3;
  public Service(int a) { setup(a); }
  @Override public void run() { Helper h = new Helper(); h.go(); }
  protected Map<String, T> find(String key) { return null; }
}
"""
SWIFT = """import Foundation
/// A box.
struct Box: Shape {
  let size: Int
  init(size: Int) { self.size = size }
  func grow(by n: Int) -> Int { return add(size, n) }
}
protocol Shape { func area() -> Double }
"""


def test_kotlin():
    s = Scan("A.kt", KOTLIN)
    assert s.package == "demo.app"
    assert [(i["full_path"], i["local_name"], i["is_star"]) for i in s.imports] == [("demo.net.Socket", "Socket", False), ("demo.text", "*", True), ("demo.model.User", "Person", False)]
    found = {x["name"]: x for x in s.symbols}
    assert {n: x["kind"] for n, x in found.items()} == {"Sessions": "class", "socket": "property", "cache": "property", "open": "method", "third": "method", "Pair2": "class", "copy": "method", "a": "property", "b": "property"}
    assert found["Sessions"]["deprecated"] and found["Sessions"]["documentation"] == "Keeps sessions."
    assert found["open"]["return_type"] == "List<Person>" and found["open"]["parameters"] == [{"name": "id", "type": "String"}, {"name": "tries", "type": "Int"}]
    assert found["third"]["extension_receiver"] == "List" and found["third"]["type_params"] == ["T"]
    assert found["cache"]["visibility"] == "private" and found["open"]["owner"] == "Sessions" and found["open"]["parent_fq_name"] == "demo.app.Sessions"
    assert found["Sessions"]["end_line"] == 16
    assert [(x["super_name"], x["type_args"]) for x in s.supers] == [("Store", ["Person"]), ("Closable", [])]
    assert {(c["caller_key"], c["callee_key"]) for c in s.calls} >= {("Sessions.open", "Socket"), ("Sessions.open", "Socket.send"), ("Sessions.open", "wrap"), ("Sessions.third", "get")}
    assert not any(c["callee_key"] in ("a", "call") for c in s.calls) and not s.errors


def names(source, path="a.kt"):
    return [(x["name"], x["kind"], x["owner"]) for x in Scan(path, source).symbols]


def calls(source, path="a.kt"):
    return {(c["caller_key"], c["callee_key"]) for c in Scan(path, source).calls}


def test_enum_entries():
    assert names("enum class Mode { FAST, SLOW }") == [("Mode", "enum", None), ("FAST", "enum_member", "Mode"), ("SLOW", "enum_member", "Mode")]
    source = "private enum class Mode(val code: Int) : Kind {\n  @Old FAST(1),\n  SLOW(f { 2 }) { override fun go() = run(3) };\n  companion object { fun of(x: Int) = pick(x) }\n  fun go() {}\n}"
    assert [n[:2] for n in names(source)] == [("Mode", "enum"), ("code", "property"), ("FAST", "enum_member"), ("SLOW", "enum_member"), ("go", "method"), ("of", "method"), ("go", "method")]
    assert [x["detail"] for x in Scan("a.kt", source).symbols][1:4] == ["val code: Int", "FAST(1)", "SLOW(f { 2 })"]
    assert calls(source) == {("Mode.go", "run"), ("Mode.of", "pick")}
    java = "enum Color { RED(1), GREEN { void f() { x(); } }; private int a, b = g(); Color(int c) {} int h() { return new Foo(1).bar(); } }"
    assert [n[:2] for n in names(java, "A.java")] == [("Color", "enum"), ("RED", "enum_member"), ("GREEN", "enum_member"), ("f", "method"), ("a", "field"), ("b", "field"), ("Color", "constructor"), ("h", "method")]
    swift = "enum S: Int {\n case a, b(Int)\n case c = 3\n func f() { switch self { case .a: go()\n default: stop() } }\n}"
    assert [n[:2] for n in names(swift, "a.swift")] == [("S", "enum"), ("a", "enum_member"), ("b", "enum_member"), ("c", "enum_member"), ("f", "method")]


def test_constructor_properties():
    source = 'data class User(val name: String, private var age: Int = 3, other: Map<String, Int>, @Json("x") val z: List<Pair<Int, Int>>)'
    found = {x["name"]: x for x in Scan("a.kt", source).symbols}
    assert list(found) == ["User", "copy", "name", "age", "z"]
    assert [(found[n]["detail"], found[n]["return_type"], found[n]["visibility"], found[n]["owner"]) for n in ("name", "age", "z")] == [
        ("val name: String", "String", "public", "User"), ("private var age: Int", "Int", "private", "User"), ("val z: List<Pair<Int, Int>>", "List<Pair<Int, Int>>", "public", "User")]
    assert {"symbol_name": "z", "annotation": "Json"} in Scan("a.kt", source).annotations
    assert [n[0] for n in names("class A internal constructor(val a: (Int, Int) -> Unit = { x, y -> f(x) }, val b: Int) : B({ 3 }) { val c = 1 }")] == ["A", "a", "b", "c"]


def test_bounds_are_no_return_type():
    found = Scan("a.kt", "fun <T> f(): List<T> where T : Comparable<T> { }\nfun <T> g(x: T) where T : A, T : B = h(x)").symbols
    assert [x["return_type"] for x in found] == ["List<T>", None]


def test_calls_by_trailing_lambda_alone():
    assert calls("fun f() { go { x -> y(x) }\n launch<X> { z() }\n listOf<Int>(1).map { it }\n if (a) { b() } else { c { d() } } }") == {("f", n) for n in ("go", "y", "z", "b", "c", "d", "listOf", "map")}
    assert calls("fun f() = when (x) {\n  1 -> a()\n  else -> b {\n c() }\n}\nfun g() = q()\n  .r()\nval no = s()") == {("f", "a"), ("f", "b"), ("f", "c"), ("g", "q"), ("g", "r")}
    assert calls("class V { func f() { if ready { start() }\n for x in items { use(x) }\n run { stop() } } }", "a.swift") == {("V.f", n) for n in ("start", "use", "run", "stop")}
    assert calls("class A { val o = object : B(c()) { override fun d() { e() } } }") == {("A.d", "e")}


def test_recovery_from_broken_headers():
    assert [n[0] for n in names("fun broken( {\nfun next() { a() }\nclass B { val c = 1 }")] == ["broken", "next", "B", "c"]
    source = "class A {\n  fun broken( {\n    val x = 1\n  fun next() { call() }\n  val y = 3\n}\nfun half(a: Int\nfun top() = when (x) {\n 1 -> a()\n}\nclass Open {\n  fun m() {\nclass Last"
    assert names(source) == [("A", "class", None), ("broken", "method", "A"), ("next", "method", "A"), ("y", "property", "A"), ("half", "function", None), ("top", "function", None), ("Open", "class", None), ("m", "method", "Open"), ("Last", "class", None)]
    assert {e["message"] for e in Scan("a.kt", source).errors} == {"unclosed {", "unclosed ("}
    assert calls(source) == {("A.next", "call"), ("top", "a")}
    assert names("class A {\nfun f() {\nval x = 1\n}\nval y = 2\n}") == [("A", "class", None), ("f", "method", "A"), ("y", "property", "A")]


def test_very_deep_and_long_sources():
    deep = "fun f() { a()\n" + "{ " * 3000 + "}" * 3000 + "}\nfun g() {}"
    assert [n[0] for n in names(deep)] == ["f", "g"]
    wide = "class A {\n" + "".join(f"  fun f{i}() {{ g{i}() }}\n" for i in range(3000)) + "}"
    assert len(names(wide)) == 3001 and len(calls(wide)) == 3000


def test_java():
    s = Scan("S.java", JAVA)
    assert [(x["name"], x["kind"]) for x in s.symbols] == [("Service", "class"), ("MAX", "constant"), ("Service", "constructor"), ("run", "method"), ("find", "method")]
    assert [(x["super_name"], x["super_kind"]) for x in s.supers] == [("Base", "extends"), ("Runnable", "implements")]
    assert s.symbols[4]["return_type"] == "Map<String, T>" and s.symbols[4]["visibility"] == "protected"
    assert ("Service.Service", "setup") in {(c["caller_key"], c["callee_key"]) for c in s.calls}


def test_swift():
    s = Scan("B.swift", SWIFT)
    assert [(x["name"], x["kind"]) for x in s.symbols] == [("Box", "struct"), ("size", "property"), ("init", "constructor"), ("grow", "method"), ("Shape", "interface"), ("area", "method")]
    assert s.symbols[3]["return_type"] == "Int" and s.symbols[0]["documentation"] == "A box."


@pytest.mark.parametrize("source", ["", "{", "}", "class", "fun", "fun (", "class A {", '"', "/*", "import", "val", "class A<", "fun f(a: (Int", "😀 class Z"])
def test_odd_sources_do_not_crash(source):
    for path in ("a.kt", "a.java", "a.swift"):
        Scan(path, source).tokens()


def test_errors():
    assert [e["message"] for e in Scan("a.kt", "class A {\n}\n}").errors] == ["unexpected }"]
    assert {e["message"] for e in Scan("a.kt", 'fun f() {\n val x = "a').errors} == {"unclosed {", "unterminated string"}


def test_utf16_columns():
    s = Scan("a.kt", "/* 😀 */ class Zed")
    assert s.symbols[0]["sel_col"] == 15


def test_tree_to_index(spark, tmp_path):
    for name, text in (("app/src/main/kotlin/A.kt", KOTLIN), ("app/src/main/java/S.java", JAVA), ("B.swift", SWIFT), ("build/G.kt", KOTLIN)):
        (tmp_path / "w" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / name).write_text(text)
    root = str(tmp_path / "w")
    found = files.listing(spark, root)
    assert found.count() == 3 and files.capped(found, 1).first()["path"].endswith("B.swift")
    assert files.layout_roots(found).count() == 2
    texts = files.texts(spark, root).join(found.select(found["path"].alias("uri")), "uri", "left_semi")
    scan = extract.scanned(texts).cache()
    symbols = extract.relation(scan, "symbols")
    assert symbols.count() == 20 and symbols.select("symbol_id").distinct().count() == 20
    relations = {"files": extract.files(scan, texts), "symbols": symbols}
    assert files.write_index(relations, str(tmp_path / "i"))
    assert not files.write_index({"files": extract.files(scan, texts).limit(1), "symbols": symbols}, str(tmp_path / "i"), complete=False)
    assert files.read_index(spark, str(tmp_path / "i"), "files")["files"].count() == 3


def test_jars(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x-1.0-sources.jar", "w") as jar:
        jar.writestr("p/A.kt", KOTLIN)
        jar.writestr("p/readme.txt", "no")
    assert [r["uri"].rsplit("!", 1)[1] for r in files.jar_texts(spark, str(tmp_path)).collect()] == ["/p/A.kt"]


def test_build_files(spark):
    script = 'plugins { id("org.x") }\ndependencies {\n implementation("a.b:c:1.0")\n api(libs.some.lib)\n testImplementation(project(":core"))\n}'
    builds = spark.createDataFrame([("b", script)], "path string, text string")
    dependencies = files.gradle_dependencies(builds)
    catalog = spark.createDataFrame(files.version_catalog('[versions]\nv="2"\n[libraries]\nsome-lib={module="g:h",version.ref="v"}'), "alias string, group string, artifact string, version string")
    got = {(r["kind"], r["coordinates"]) for r in files.resolved_dependencies(dependencies, catalog).collect()}
    assert got == {("external", "a.b:c:1.0"), ("catalog", "g:h:2"), ("project", None), ("plugin", None)}


def test_manifest_actions_do_not_carry_over(spark):
    text = '<activity android:name=".A" android:exported="false"><intent-filter><action android:name="VIEW"/></intent-filter></activity><activity android:name=".B"/>'
    got = files.manifest_activities(spark.createDataFrame([("m", text)], "path string, text string"))
    assert [tuple(r)[1:] for r in got.collect()] == [(".A", False, ["VIEW"]), (".B", True, [])]


def test_imported_from(spark):
    texts = spark.createDataFrame(
        [("/w/x/a/b/Outer.kt", "package a.b\nclass Outer { class Event }"), ("/w/y/Event.kt", "package q\nclass Event"), ("/w/z/Event.kt", "package c.d\n\nclass Event"), ("/w/Other.kt", "package a.b\nclass Event")], "uri string, text string"
    )
    at = lambda *a: [tuple(r) for r in extract.imported_from(texts, *a).collect()]
    assert at("a.b.Outer.Event", "Event") == [("/w/x/a/b/Outer.kt", 1, "class")]
    assert at("c.d.Event", "Event") == [("/w/z/Event.kt", 2, "class")] and at("q.Event", "Event") == [("/w/y/Event.kt", 1, "class")]
    assert at("c.d.Nope", "Nope") == [] and at("c.d", "d") == []


def test_lambdas():
    source = "class A : B({ 1 }) {\n fun f(g: () -> Unit = {}) {\n  rows?.map { row -> row.let { it.x() } }\n  with(row) { run { a() } }\n  if (b) { c() } else { d() }\n  m.forEach { (k, v) -> e(k) }\n  a.b.c().also { q, r -> z() }\n }\n val h by lazy { 3 }\n init { x() }\n fun List<Int>.each() { y() }\n}"
    found = [(x["method"], x["receiver"], x["names"], len(x["ancestors"])) for x in Scan("a.kt", source).lambdas()]
    assert found == [("map", "rows", ["row"], 0), ("let", "row", [], 1), ("with", "row", [], 0), ("run", None, [], 1), ("forEach", "m", [], 0), ("also", None, ["q", "r"], 0), ("lazy", None, [], 0)]
