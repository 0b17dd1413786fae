"""Extraction in three languages, index maintenance and text functions, as queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from symatlas.functions import identifiers as ids, paths
from symatlas.operators import complete, diagnose, edits, index, infer, output
from symatlas.sources import extract

from .tables import query, read

_KOTLIN = """package n{n}
import n{m}.Nation{m}
/**
 * Delivers part {p}.
 */
@Deprecated("old")
class Supplier{s}(val id: Int) : Nation{n}() {{
    @Keep{p}
    suspend fun <T> List<T>.run(x: Int, y: Text{p} = Text()): Map<Int, T> {{ return part{p}("}}", x) }}
    private val made = Box{p}(3)
    fun go(b: Box{p}) {{
        val local = Tin()
        if (b.ready()) {{ b.open() }} else {{ run(1) }}
    }}
}}
"""
_JAVA = """package n{n};
import n{m}.Nation{m};
public class Supplier{s} extends Nation{n} implements Part{p} {{
    /** Size of it. */
    private static final int SIZE = 3;
    @Override
    public String run(int x, List<Part{p}> y) {{ return part2.find(x); }}
}}
"""
_SWIFT = """import n{m}
struct Supplier{s}: Nation{n} {{
    let size: Int
    private func run(x: Int) -> Part{p} {{ return part2(x) }}
}}
"""


def _filled(template: str):
    values = {"s": F.col("s_suppkey"), "n": F.col("s_nationkey"), "m": (F.col("s_nationkey") + 1) % 25, "p": F.col("s_suppkey") % 7}
    text = F.lit(template.replace("{{", "\x01").replace("}}", "\x02"))
    for key, value in values.items():
        text = F.replace(text, F.lit("{" + key + "}"), value.cast("string"))
    return F.translate(text, "\x01\x02", "{}")


def _texts(spark, sf_dir, template, ending):
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey", F.lit(ending)).alias("uri"), _filled(template).alias("text"))


def _relation(spark, sf_dir, template, ending, name):
    return extract.relation(extract.scanned(_texts(spark, sf_dir, template, ending), name), name)


_K, _S = "'S' || s_suppkey || '.kt'", "'Supplier' || s_suppkey"


def _details(rows):
    parameters = F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["type"])), ",")
    return rows.select("uri", "name", "kind", "visibility", "detail", "owner", F.col("extension_receiver").alias("receiver"), F.col("return_type").alias("returns"), parameters.alias("parameters"), "documentation", "deprecated", F.col("sel_line").alias("line"))


@query("extract_kotlin", f"""SELECT {_K} AS uri, {_S} AS name, 'class' AS kind, 'public' AS visibility, 'class Supplier' || s_suppkey || '(val id: Int) : Nation' || s_nationkey || '()' AS detail, NULL AS owner, NULL AS receiver, NULL AS returns,
  'id:Int' AS parameters, 'Delivers part ' || s_suppkey % 7 || '.' AS documentation, true AS deprecated, 6 AS line FROM supplier
UNION ALL SELECT {_K}, 'id', 'property', 'public', 'val id: Int', {_S}, NULL, 'Int', '', NULL, false, 6 FROM supplier
UNION ALL SELECT {_K}, 'run', 'method', 'public', 'suspend fun <T> List<T>.run(x: Int, y: Text' || s_suppkey % 7 || ' = Text()): Map<Int, T>', {_S}, 'List', 'Map<Int, T>', 'x:Int,y:Text' || s_suppkey % 7, NULL, false, 8 FROM supplier
UNION ALL SELECT {_K}, 'made', 'property', 'private', 'private val made = Box' || s_suppkey % 7 || '(3)', {_S}, NULL, NULL, '', NULL, false, 9 FROM supplier
UNION ALL SELECT {_K}, 'go', 'method', 'public', 'fun go(b: Box' || s_suppkey % 7 || ')', {_S}, NULL, NULL, 'b:Box' || s_suppkey % 7, NULL, false, 10 FROM supplier""")
def extract_kotlin(spark, sf_dir):
    return _details(_relation(spark, sf_dir, _KOTLIN, ".kt", "symbols"))


@query("extract_java", f"""SELECT 'S' || s_suppkey || '.java' AS uri, {_S} AS name, 'class' AS kind, 'public' AS visibility, 'public class Supplier' || s_suppkey || ' extends Nation' || s_nationkey || ' implements Part' || s_suppkey % 7 AS detail, NULL AS owner, NULL::VARCHAR AS receiver, NULL AS returns,
  '' AS parameters, NULL AS documentation, false AS deprecated, 2 AS line FROM supplier
UNION ALL SELECT 'S' || s_suppkey || '.java', 'SIZE', 'constant', 'private', 'private static final int SIZE = 3', {_S}, NULL, NULL, '', 'Size of it.', false, 4 FROM supplier
UNION ALL SELECT 'S' || s_suppkey || '.java', 'run', 'method', 'public', 'public String run(int x, List<Part' || s_suppkey % 7 || '> y)', {_S}, NULL, 'String', 'x:int,y:List<Part' || s_suppkey % 7 || '>', NULL, false, 6 FROM supplier""")
def extract_java(spark, sf_dir):
    return _details(_relation(spark, sf_dir, _JAVA, ".java", "symbols"))


@query("extract_swift", f"""SELECT 'S' || s_suppkey || '.swift' AS uri, {_S} AS name, 'struct' AS kind, 'internal' AS visibility, 'struct Supplier' || s_suppkey || ': Nation' || s_nationkey AS detail, NULL AS owner, NULL::VARCHAR AS receiver, NULL AS returns,
  '' AS parameters, NULL::VARCHAR AS documentation, false AS deprecated, 1 AS line FROM supplier
UNION ALL SELECT 'S' || s_suppkey || '.swift', 'size', 'property', 'internal', 'let size: Int', {_S}, NULL, 'Int', '', NULL, false, 2 FROM supplier
UNION ALL SELECT 'S' || s_suppkey || '.swift', 'run', 'method', 'private', 'private func run(x: Int) -> Part' || s_suppkey % 7, {_S}, NULL, 'Part' || s_suppkey % 7, 'x:Int', NULL, false, 3 FROM supplier""")
def extract_swift(spark, sf_dir):
    return _details(_relation(spark, sf_dir, _SWIFT, ".swift", "symbols"))


@query("extract_supers_java", f"SELECT 'S' || s_suppkey || '.java' AS uri, {_S} AS sub_name, 'Nation' || s_nationkey AS super_name, 'extends' AS super_kind FROM supplier UNION ALL SELECT 'S' || s_suppkey || '.java', {_S}, 'Part' || s_suppkey % 7, 'implements' FROM supplier")
def extract_supers_java(spark, sf_dir):
    return _relation(spark, sf_dir, _JAVA, ".java", "supers").select("uri", "sub_name", "super_name", "super_kind")


@query("extract_annotations", f"SELECT {_K} AS uri, {_S} AS symbol_name, 'Deprecated' AS annotation FROM supplier UNION ALL SELECT {_K}, 'run', 'Keep' || s_suppkey % 7 FROM supplier")
def extract_annotations(spark, sf_dir):
    return _relation(spark, sf_dir, _KOTLIN, ".kt", "annotations").select("uri", "symbol_name", "annotation")


@query("extract_types", f"SELECT {_K} AS uri, 9 AS line, 'made' AS var, 'Box' || s_suppkey % 7 AS type FROM supplier UNION ALL SELECT {_K}, 11, 'local', 'Tin' FROM supplier")
def extract_types(spark, sf_dir):
    return _relation(spark, sf_dir, _KOTLIN, ".kt", "types").select("uri", "line", "var", "type")


@query("extract_receivers", f"""SELECT {_K} AS uri, {_S} || '.run' AS caller_key, 'part' || s_suppkey % 7 AS callee_key FROM supplier UNION ALL SELECT {_K}, {_S} || '.go', 'Tin' FROM supplier UNION ALL SELECT {_K}, {_S} || '.go', 'Box' || s_suppkey % 7 || '.ready' FROM supplier
UNION ALL SELECT {_K}, {_S} || '.go', 'Box' || s_suppkey % 7 || '.open' FROM supplier UNION ALL SELECT {_K}, {_S} || '.go', 'run' FROM supplier""")
def extract_receivers(spark, sf_dir):
    return _relation(spark, sf_dir, _KOTLIN, ".kt", "calls").select("uri", "caller_key", "callee_key")


@query("extract_steps", f"""SELECT {_K} AS uri, {_S} || '.run' AS caller_key, 0 AS seq, 0 AS depth, 'call' AS kind, 'part' || s_suppkey % 7 AS label FROM supplier
UNION ALL SELECT {_K}, {_S} || '.go', t.* FROM supplier, (VALUES (0, 0, 'call', 'new Tin'), (1, 0, 'branch', 'if'), (2, 0, 'call', 'ready'), (3, 1, 'call', 'open'), (4, 0, 'branch', 'else'), (5, 1, 'call', 'run')) t""")
def extract_steps(spark, sf_dir):
    return _relation(spark, sf_dir, _KOTLIN, ".kt", "steps").select("uri", "caller_key", "seq", "depth", "kind", "label")


@query("extract_errors", f"SELECT {_K} AS uri, s_suppkey % 3 > 0 AS broken FROM supplier")
def extract_errors(spark, sf_dir):
    s = F.col("s_suppkey")
    text = F.when(s % 3 == 0, _filled(_KOTLIN)).when(s % 3 == 1, F.concat(_filled(_KOTLIN), F.lit("}\n"))).otherwise(F.concat(_filled(_KOTLIN), F.lit("/* open")))
    scan = extract.scanned(read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), s, F.lit(".kt")).alias("uri"), text.alias("text")), "errors")
    return diagnose.syntax(extract.relation(scan, "errors"), scan).select("uri", (~F.col("ok")).alias("broken"))


@query("content_hashes", "SELECT count(DISTINCT s_suppkey) AS files, count(DISTINCT s_suppkey) AS hashes FROM supplier")
def content_hashes(spark, sf_dir):
    scan = extract.scanned(_texts(spark, sf_dir, _SWIFT, ".swift"))
    return scan.agg(F.countDistinct("uri").alias("files"), F.countDistinct("content_hash").alias("hashes"))


@query("deprecations", f"SELECT {_K} AS uri, 6 AS line, {_S} AS name FROM supplier")
def deprecations(spark, sf_dir):
    return diagnose.deprecations(_relation(spark, sf_dir, _KOTLIN, ".kt", "symbols")).select("uri", "line", "name")


@query("type_hints", f"SELECT {_K} AS uri, 9 AS line, 20 AS col, ': Box' || s_suppkey % 7 AS label FROM supplier")
def type_hints(spark, sf_dir):
    scan = extract.scanned(_texts(spark, sf_dir, _KOTLIN, ".kt"), "symbols", "types")
    return infer.hints(extract.relation(scan, "symbols"), extract.relation(scan, "types")).select("uri", "line", "col", "label")


@query("enriched_signatures", f"SELECT {_K} AS uri, 'suspend fun <Part> List<Part>.run(x: Int, y: Text' || s_suppkey % 7 || ' = Text()): Map<Int, Part>' AS signature FROM supplier")
def enriched_signatures(spark, sf_dir):
    symbols = _relation(spark, sf_dir, _KOTLIN, ".kt", "symbols").filter("size(type_params) > 0")
    return infer.enriched(symbols, symbols.select("symbol_id", F.array(F.lit("Part")).alias("args"))).select("uri", "signature")


@query("inspected_file", "SELECT 'S3.kt' AS uri, 5::BIGINT AS symbols, 'n' || (s_nationkey + 1) % 25 || '.Nation' || (s_nationkey + 1) % 25 AS imports, 0::BIGINT AS errors FROM supplier WHERE s_suppkey = 3")
def inspected_file(spark, sf_dir):
    scan = extract.scanned(_texts(spark, sf_dir, _KOTLIN, ".kt"))
    row = output.inspected(*(extract.relation(scan, n) for n in ("symbols", "imports", "errors")), "S3.kt")
    return row.select("uri", F.size("symbols").cast("long").alias("symbols"), F.array_join("imports", ",").alias("imports"), "errors")


@query("summarised_type", "SELECT 'S5.kt' AS uri, 'go,id,made,run' AS members, 'Int,Nation' || s_nationkey AS types FROM supplier WHERE s_suppkey = 5")
def summarised_type(spark, sf_dir):
    row = output.summarised(_relation(spark, sf_dir, _KOTLIN, ".kt", "symbols"), "Supplier5")
    return row.select("uri", F.array_join("members", ",").alias("members"), F.array_join("types", ",").alias("types"))


@query("highlighted", f"SELECT {_K} AS uri, 2::BIGINT AS places, 1::BIGINT AS written FROM supplier")
def highlighted(spark, sf_dir):
    found = infer.highlights(_relation(spark, sf_dir, _KOTLIN, ".kt", "tokens"), "run")
    return found.groupBy("uri").agg(F.count("*").alias("places"), F.count_if(F.col("kind") == "write").alias("written"))


@query("library_without_private", "SELECT p_partkey AS id FROM part WHERE NOT (p_size % 2 = 0 AND p_type IN ('ECONOMY', 'SMALL'))")
def library_without_private(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    visibility = F.when(F.col("p_type") == "ECONOMY", "private").when(F.col("p_type") == "SMALL", "internal").otherwise("public")
    symbols = part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("uri"), visibility.alias("visibility"))
    return index.without_private_library(symbols, part.select(F.col("p_partkey").alias("uri"), (F.col("p_size") % 2 == 0).alias("is_library"))).select("id")


@query("compacted_files", "SELECT l_orderkey AS uri, l_linenumber AS line FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1)")
def compacted_files(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uri"), F.col("l_linenumber").alias("line"))
    return index.compacted(rows, read(spark, sf_dir, "orders").filter("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("uri")))


@query("definition_rows", "SELECT DISTINCT p_name AS name, p_brand AS uri, p_size AS line FROM part")
def definition_rows(spark, sf_dir):
    symbols = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("uri"), F.col("p_size").alias("sel_line"), F.lit(0).alias("sel_col"))
    return index.definitions(symbols).select("name", "uri", "line")


@query("override_edges", "SELECT p_partkey AS uri, p_name AS method, p_brand AS class FROM part WHERE p_size % 3 = 0 AND p_type = 'SMALL'")
def override_edges(spark, sf_dir):
    symbols = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("uri"), F.col("p_name").alias("name"), F.col("p_brand").alias("parent_fq_name"), F.when(F.col("p_type") == "SMALL", "method").otherwise("property").alias("kind"),
        F.when(F.col("p_size") % 3 == 0, "override fun x()").otherwise("fun x()").alias("detail"),
    )
    return index.override_edges(symbols)


@query("kind_names", "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'property' WHEN 2 THEN 'interface' ELSE 'class' END AS kind FROM part")
def kind_names(spark, sf_dir):
    size = F.col("p_size") % 5
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), paths.kind(F.when(size == 0, "Fun").when(size == 1, "VAL").when(size == 2, "iface").otherwise("Class")).alias("kind"))


@query("ignored_paths", r"SELECT page_id, regexp_matches(path, '^(.*/)?es/[^/]*$') OR regexp_matches(path, '^x/.*$') OR regexp_matches(path, '^[^/]\.kt$') AS ignored FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'a.kt' ELSE regexp_replace(url, '^https?://', CASE WHEN page_id % 5 = 0 THEN 'x/' ELSE '' END) END AS path FROM pages)")
def ignored_paths(spark, sf_dir):
    path = F.when(F.col("page_id") % 9 == 0, "a.kt").when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "^https?://", "x/")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return read(spark, sf_dir, "pages").select("page_id", paths.ignored(path, ["**/es/*", "x/**", "?.kt"]).alias("ignored"))


@query("platform_imports", "SELECT p_partkey AS id, p_size % 4 < 2 AS platform FROM part")
def platform_imports(spark, sf_dir):
    size = F.col("p_size") % 4
    path = F.when(size == 0, "kotlin.collections.List").when(size == 1, "com.sun.x.Y").when(size == 2, "com.sunny.Y").otherwise("kotlinish.Z")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), paths.stdlib_package(path).alias("platform"))


@query("entry_points", "SELECT p_partkey AS id FROM part WHERE p_size % 3 = 0 AND p_type = 'SMALL'")
def entry_points(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 3 == 0, "MainActivity").otherwise("MainActivityHelper")
    return part.filter(paths.entry_point(name, F.when(F.col("p_type") == "SMALL", "class").otherwise("function"))).select(F.col("p_partkey").alias("id"))


@query("path_languages", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'kotlin' WHEN 1 THEN 'java' ELSE 'swift' END AS lang, 4 AS depth FROM part")
def path_languages(spark, sf_dir):
    size = F.col("p_size") % 3
    path = F.concat(F.lit("/a/b/X"), F.when(size == 0, ".kts").when(size == 1, ".java").otherwise(".swift"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), paths.language(path).alias("lang"), paths.depth(path).alias("depth"))


@query("element_types", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN 'a' END AS element, CASE p_size % 4 WHEN 0 THEN 'List' WHEN 1 THEN 'Flow' WHEN 2 THEN 'Map' ELSE p_type END AS leaf FROM part")
def element_types(spark, sf_dir):
    size = F.col("p_size") % 4
    raw = F.when(size == 0, F.concat(F.lit("List<"), "p_type", F.lit(">"))).when(size == 1, "kotlinx.Flow<out a>?").when(size == 2, "Map<a, b>").otherwise(F.concat(F.lit("x.y."), "p_type", F.lit("?")))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ids.collection_element(raw).alias("element"), ids.type_leaf(raw).alias("leaf"))


@query("self_initialised", "SELECT p_partkey AS id FROM part WHERE p_size % 3 = 0")
def self_initialised(spark, sf_dir):
    text = F.when(F.col("p_size") % 3 == 0, "  val size: Int = size // odd").when(F.col("p_size") % 3 == 1, "val size = sizes").otherwise("var a = b")
    return diagnose.self_initialised(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))).select("id")


@query("open_branches", "SELECT p_partkey AS uri, 'x' || p_size AS subject FROM part WHERE p_size % 3 = 0")
def open_branches(spark, sf_dir):
    size = F.col("p_size")
    body = F.when(size % 3 == 0, "1 -> { if (a) { b { c() } } }").when(size % 3 == 1, "1 -> a()\n else -> b()").otherwise("1 -> a()\n 2 -> b()")
    texts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("uri"), F.concat(F.lit("fun f() { when (x"), size, F.lit(") {\n "), body, F.lit("\n} }")).alias("text"))
    return diagnose.when_without_else(texts)


@query("applied_edits", "SELECT p_partkey AS uri, CASE WHEN p_size % 2 = 0 THEN 'a😀Xc' END AS text, CASE WHEN p_size % 2 = 1 THEN 'no place 0:2' END AS error FROM part")
def applied_edits(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    start = F.when(F.col("p_size") % 2 == 0, 3).otherwise(2)
    changes = part.select(F.col("p_partkey").alias("uri"), F.lit(0).alias("start_line"), start.alias("start_col"), F.lit(0).alias("end_line"), F.lit(4).alias("end_col"), F.lit("X").alias("new_text"))
    texts = part.select(F.col("p_partkey").alias("uri"), F.lit("a😀bc").alias("text"))
    done = edits.preview(texts.withColumn("uri", F.col("uri").cast("string")), changes.withColumn("uri", F.col("uri").cast("string")))
    return done.select(F.col("uri").cast("long").alias("uri"), "text", "error")


def _shaped(spark, sf_dir):
    """(uri, text, s): Kotlin sources of varying shape: an enum of 1 to 4 entries, with or without arguments; a data class of 1 to 3 properties; a function with bounds; calls nested to a varying depth; a broken header in every seventh."""
    s = F.col("s_suppkey")
    entry = lambda i: F.concat(F.lit("E"), i.cast("string"), F.when(s % 3 == 0, F.concat(F.lit("("), i.cast("string"), F.lit(")"))).otherwise(""))
    entries = F.array_join(F.transform(F.sequence(F.lit(1), s % 4 + 1), entry), ", ")
    prop = lambda i: F.concat(F.when(i % 2 == 0, "private val p").otherwise("var p"), i.cast("string"), F.lit(": T"), (s % 5).cast("string"))
    properties = F.array_join(F.transform(F.sequence(F.lit(1), s % 3 + 1), prop), ", ")
    opened = F.array_join(F.transform(F.sequence(F.lit(1), s % 6 + 1), lambda i: F.concat(F.lit("run"), i.cast("string"), F.when(i % 2 == 0, "(x) ").otherwise(" "), F.lit("{ "))), "")
    text = F.concat(
        F.lit("package q\n"), F.when(s % 7 == 0, "fun half(a: Int\n").otherwise(""), F.lit("enum class Mode"), s.cast("string"), F.lit(" { "), entries, F.when(s % 2 == 0, ";\n  fun all() = pick()\n}\n").otherwise(" }\n"),
        F.lit("data class User"), s.cast("string"), F.lit("("), properties, F.lit(")\nfun <T> only(x: T): Box<T> where T : Any { "), opened, F.repeat(F.lit("}"), (s % 6 + 1).cast("int")), F.lit(" }\n"),
    )
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), s, F.lit(".kt")).alias("uri"), text.alias("text"), s.alias("s"))


@query("extract_shapes", """SELECT s_suppkey AS s, t.* FROM supplier, LATERAL (
  SELECT 'Mode' || s_suppkey AS name, 'enum' AS kind, NULL::VARCHAR AS owner, NULL::VARCHAR AS returns, 'enum class Mode' || s_suppkey AS detail
  UNION ALL SELECT 'E' || i, 'enum_member', 'Mode' || s_suppkey, NULL, 'E' || i || CASE WHEN s_suppkey % 3 = 0 THEN '(' || i || ')' ELSE '' END FROM range(1, s_suppkey % 4 + 2) r(i)
  UNION ALL SELECT 'all', 'method', 'Mode' || s_suppkey, NULL, 'fun all() = pick()' WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'half', 'function', NULL, NULL, 'fun half(a: Int' WHERE s_suppkey % 7 = 0
  UNION ALL SELECT 'p' || i, 'property', 'User' || s_suppkey, 'T' || s_suppkey % 5, CASE WHEN i % 2 = 0 THEN 'private val p' ELSE 'var p' END || i || ': T' || s_suppkey % 5 FROM range(1, s_suppkey % 3 + 2) r(i)
  UNION ALL SELECT 'only', 'function', NULL, 'Box<T>', 'fun <T> only(x: T): Box<T> where T : Any') t""")
def extract_shapes(spark, sf_dir):
    texts = _shaped(spark, sf_dir)
    rows = extract.relation(extract.scanned(texts, "symbols"), "symbols").join(texts.select("uri", "s"), "uri")
    return rows.filter("kind != 'class' AND name != 'copy'").select("s", "name", "kind", "owner", F.col("return_type").alias("returns"), "detail")


@query("extract_nested_calls", """SELECT s_suppkey AS s, 'only' AS caller_key, 'run' || i AS callee_key FROM supplier, range(1, 7) r(i) WHERE i <= s_suppkey % 6 + 1
UNION ALL SELECT s_suppkey, 'Mode' || s_suppkey || '.all', 'pick' FROM supplier WHERE s_suppkey % 2 = 0""")
def extract_nested_calls(spark, sf_dir):
    texts = _shaped(spark, sf_dir)
    return extract.relation(extract.scanned(texts, "calls"), "calls").join(texts.select("uri", "s"), "uri").select("s", "caller_key", "callee_key")


@query("extract_broken", "SELECT s_suppkey AS s, 1 AS line, 8 AS col, 'unclosed (' AS message FROM supplier WHERE s_suppkey % 7 = 0")
def extract_broken(spark, sf_dir):
    texts = _shaped(spark, sf_dir)
    return extract.relation(extract.scanned(texts, "errors"), "errors").join(texts.select("uri", "s"), "uri").select("s", "line", "col", "message")


@query("lambda_scopes", """WITH s AS (SELECT s_suppkey AS s, 'T' || s_suppkey % 5 AS t, s_suppkey % 4 AS d FROM supplier)
SELECT s, 0 AS id, 'row' AS name, 'List<' || t || '>' AS type FROM s UNION ALL SELECT s, 1, CASE WHEN s % 2 = 0 THEN 'cell' ELSE 'it' END, t FROM s WHERE d >= 1
UNION ALL SELECT s, 2, 'this', t FROM s WHERE d >= 2 UNION ALL SELECT s, 3, 'it', t FROM s WHERE d >= 3
UNION ALL SELECT s, 1 + d, 'i', 'Int' FROM s UNION ALL SELECT s, 1 + d, 'x', t FROM s""")
def lambda_scopes(spark, sf_dir):
    s, depth = F.col("s_suppkey"), F.col("s_suppkey") % 4
    t = F.concat(F.lit("T"), (s % 5).cast("string"))
    cell = F.when(s % 2 == 0, "cell").otherwise("it")
    inner = F.concat(F.when(depth >= 1, F.concat(F.lit("row.forEach { "), F.when(s % 2 == 0, "cell -> ").otherwise(""))).otherwise(""), F.when(depth >= 2, F.concat(F.lit("with("), cell, F.lit(") { "))).otherwise(""), F.when(depth >= 3, "this.let { go(it) } ").otherwise(""))
    closing = F.concat(F.when(depth >= 2, "} ").otherwise(""), F.when(depth >= 1, "}").otherwise(""))
    text = F.concat(F.lit("fun f() {\n val rows: List<List<"), t, F.lit(">> = read()\n val some: List<"), t, F.lit("> = read()\n rows.map { row -> "), inner, closing, F.lit(" }\n some.forEachIndexed { i, x -> put(i, x) }\n when (a) { 1 -> { b() } }\n}\n"))
    texts = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), s, F.lit(".kt")).alias("uri"), text.alias("text"), s.alias("s"))
    scan = extract.scanned(texts, "lambdas", "types")
    return infer.lambda_scopes(extract.relation(scan, "lambdas"), extract.relation(scan, "types")).join(texts.select("uri", "s"), "uri").select("s", "id", "name", "type")


@query("token_phases", """WITH s AS (SELECT s_suppkey AS s, s_suppkey % 3 AS k, length(s_suppkey::VARCHAR)::INT AS n FROM supplier)
SELECT s, t.* FROM s, LATERAL (SELECT 4 AS col, 'f' || s AS text, 'function' AS type WHERE k = 0 UNION ALL SELECT c, 'a', 'parameter' FROM (VALUES (6 + n), (16 + n), (22 + 2 * n)) v(c) WHERE k = 0
UNION ALL SELECT 20 + n, 'g' || s, 'function' WHERE k = 0 UNION ALL SELECT 6, 'J' || s, 'class' WHERE k = 1 UNION ALL SELECT 14 + n, 'h' || s, 'method' WHERE k = 1
UNION ALL SELECT c, 'q' || s, 'function' FROM (VALUES (5), (31 + n)) v(c) WHERE k = 2) t""")
def token_phases(spark, sf_dir):
    s = F.col("s_suppkey")
    text = F.when(s % 3 == 0, F.format_string("fun f%1$d(a: Int) = a + g%1$d(a)\nfun g%1$d(b: Int) = b\n", s)).when(s % 3 == 1, F.format_string("class J%1$d { int h%1$d(int c) { return c; } }\n", s)).otherwise(F.format_string("func q%1$d(d: Int) -> Int { return q%1$d(d: d) }\n", s))
    ending = F.when(s % 3 == 0, ".kt").when(s % 3 == 1, ".java").otherwise(".swift")
    texts = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), s, ending).alias("uri"), text.alias("text"), s.alias("s"))
    scan = extract.scanned(texts)
    found = infer.token_phases(extract.relation(scan, "tokens"), extract.relation(scan, "symbols"), (0, 0, 0, 1000))
    return found.join(texts.select("uri", "s"), "uri").select("s", "col", "text", "type")


@query("named_arguments", """WITH s AS (SELECT s_suppkey AS s, s_suppkey % 4 AS k, 'T' || s_suppkey % 7 AS t FROM supplier)
SELECT s AS req, 'first = ' AS label, 'Int' AS type, 0 AS position FROM s WHERE k = 0 UNION ALL SELECT s, 'second = ', t, 1 FROM s UNION ALL SELECT s, 'third = ', 'Int', 2 FROM s WHERE k < 3""")
def named_arguments(spark, sf_dir):
    s = F.col("s_suppkey")
    supplier = read(spark, sf_dir, "supplier")
    text = F.format_string("fun build%d(first: Int, second: T%d, third: Int = 0) {}\n", s, s % 7)
    symbols = extract.relation(extract.scanned(supplier.select(F.concat(F.lit("S"), s, F.lit(".kt")).alias("uri"), text.alias("text"))), "symbols")
    given = F.when(s % 4 == 0, "").when(s % 4 == 1, "g(1, x = 2), ").when(s % 4 == 2, "first = 1, ").otherwise("1, third = 2, ")
    requests = supplier.select(s.cast("long").alias("req"), F.concat(F.lit("val v = build"), s, F.lit("("), given).alias("before"))
    return complete.named_arguments(requests, symbols)
