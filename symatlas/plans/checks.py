"""Diagnostic, inference, edit and output queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from symatlas.operators import diagnose, edits, infer, output

from .sources import _scan
from .tables import query, read


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("uri"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


_LINES = "lines AS (SELECT doc_id AS uri, unnest(range(len(x))) AS line_no, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


@query("context_lines", f"WITH {_LINES}, p AS (SELECT uri, line_no AS line FROM lines WHERE contains(text, 'Licens')) SELECT p.uri, p.line, string_agg(l.text, chr(10) ORDER BY l.line_no) AS text FROM p JOIN lines l ON l.uri = p.uri AND abs(l.line_no - p.line) <= 1 GROUP BY p.uri, p.line")
def context_lines(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("line_no", F.col("line_no").cast("long"))
    return diagnose.context(lines, lines.filter(F.col("text").contains("Licens")).select("uri", F.col("line_no").alias("line")), 1)


@query("insertion_lines", f"WITH {_LINES} SELECT uri, coalesce(max(line_no + 1) FILTER (starts_with(ltrim(text), 'The ')), max(line_no + 1) FILTER (starts_with(ltrim(text), 'Of ')), 0) AS line FROM lines GROUP BY uri")
def insertion_lines(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumns({"text": F.regexp_replace(F.regexp_replace("text", r"^\s*The ", "import "), r"^\s*Of ", "package "), "line_no": F.col("line_no").cast("long")})
    return diagnose.insertion_line(lines)


@query("checked_inputs", "SELECT p_name AS path, p_name NOT IN (SELECT p_name FROM part WHERE p_size < 3) AS missing FROM (SELECT DISTINCT p_name FROM part)")
def checked_inputs(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("path", F.col("p_name"))
    return diagnose.requested(part.select("path").distinct(), part.filter("p_size < 3").select("path"))


@query("syntax_counts", "SELECT 'S' || s_suppkey || '.kt' AS uri, 0::BIGINT AS errors, true AS ok FROM supplier")
def syntax_counts(spark, sf_dir):
    from symatlas.sources import extract

    scan = _scan(spark, sf_dir)
    return diagnose.syntax(extract.relation(scan, "errors"), scan)


@query("argument_counts", "SELECT l_orderkey AS uri, l_linenumber AS line, 'P.f' || l_suppkey % 10 AS callee_key, l_linenumber AS arguments, 1 + l_suppkey % 10 % 3 AS expected FROM lineitem WHERE l_linenumber <> 1 + l_suppkey % 10 % 3")
def argument_counts(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    calls = li.select(F.col("l_orderkey").alias("uri"), F.col("l_linenumber").alias("line"), F.concat(F.lit("P.f"), F.col("l_suppkey") % 10).alias("callee_key"), F.col("l_linenumber").alias("arguments"))
    number = F.col("id") % 10
    symbols = spark.range(20).select(F.concat(F.lit("f"), number).alias("name"), F.col("id").alias("uri"), F.lit(0).alias("ordinal"), F.array_repeat(F.lit("p"), (1 + number % 3 + F.when(F.col("id") >= 10, 5).otherwise(0)).cast("int")).alias("parameters"))
    return diagnose.argument_counts(calls, symbols).select("uri", "line", "callee_key", "arguments", F.col("expected").cast("long").alias("expected"))


@query("nullable_receivers", "SELECT l_orderkey AS uri, l_partkey % 10 AS var, l_linenumber AS line, n_name || '?' AS type FROM lineitem JOIN nation ON n_nationkey = l_partkey % 10 WHERE n_nationkey % 2 = 0 AND n_regionkey = l_orderkey % 5")
def nullable_receivers(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    accesses = li.select(F.col("l_orderkey").alias("uri"), (F.col("l_partkey") % 10).alias("var"), F.col("l_linenumber").alias("line"))
    nation = read(spark, sf_dir, "nation").filter("n_nationkey < 10")
    types = li.select(F.col("l_orderkey").alias("uri")).distinct().join(nation, F.col("n_regionkey") == F.col("uri") % 5)
    types = types.select("uri", F.col("n_nationkey").cast("long").alias("var"), F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "?").otherwise("")).alias("type"))
    return diagnose.nullable_receivers(accesses, types).select("uri", "var", "line", "type")


@query("variable_types", """WITH d AS (SELECT o_orderkey AS key, 'T' || o_custkey % 5 AS type FROM orders WHERE o_orderkey % 4 = 0), f AS (SELECT o_orderkey, 'F' || o_custkey % 5 FROM orders WHERE o_orderkey % 4 IN (0, 1)),
k AS (SELECT * FROM d UNION ALL SELECT * FROM f WHERE o_orderkey NOT IN (SELECT key FROM d)), r AS (SELECT n_name AS owner, 'T' || n_regionkey AS t, n_nationkey AS m FROM nation),
c1 AS (SELECT o_orderkey AS key, max(CASE WHEN contains(k.type, 'T') THEN 'R' || substr(k.type, 2) END) AS type FROM orders JOIN k ON k.key = o_orderkey - 2 WHERE o_orderkey % 4 = 2 GROUP BY 1)
SELECT key, type FROM k UNION ALL SELECT key, type FROM c1 WHERE type IS NOT NULL""")
def variable_types(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    key, five = F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey") % 5
    declared = orders.filter("o_orderkey % 4 = 0").select(key, F.concat(F.lit("T"), five).alias("type"))
    facts = orders.filter("o_orderkey % 4 in (0, 1)").select(key, F.concat(F.lit("F"), five).alias("type"))
    calls = orders.filter("o_orderkey % 4 = 2").select(key, (F.col("o_orderkey") - 2).cast("string").alias("receiver"), F.lit("m").alias("method"))
    returns = spark.range(5).select(F.concat(F.lit("T"), "id").alias("owner"), F.lit("m").alias("method"), F.concat(F.lit("R"), "id").alias("type"))
    return infer.variable_types(declared, facts, calls, returns).select(F.col("key").cast("long").alias("key"), "type")


@query("semantic_tokens", "SELECT 'S' || s_suppkey || '.kt' AS uri, 4 AS line, 8 AS col, 'run' AS text, 'method' AS type, true AS declaration FROM supplier UNION ALL SELECT 'S' || s_suppkey || '.kt', 5, 16, 'size', 'property', true FROM supplier UNION ALL SELECT 'S' || s_suppkey || '.kt', 3, 19 + length(s_suppkey::VARCHAR)::INT, 'id', 'property', true FROM supplier UNION ALL SELECT 'S' || s_suppkey || '.kt', 3, 6, 'Supplier' || s_suppkey, 'class', true FROM supplier")
def semantic_tokens(spark, sf_dir):
    from symatlas.sources import extract

    scan = _scan(spark, sf_dir)
    return infer.semantic_tokens(extract.relation(scan, "tokens"), extract.relation(scan, "symbols"))


@query("token_round_trip", "SELECT l_orderkey AS uri, l_linenumber AS line, (l_partkey * 7 + l_suppkey)::BIGINT AS col FROM lineitem")
def token_round_trip(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uri"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") * 7 + F.col("l_suppkey")).alias("col"))
    encoded = infer.delta_encoded(rows)
    back = infer.delta_decoded(encoded.select("uri", "delta_line", "delta_col", F.col("line").alias("at_line"), F.col("col").alias("at_col")), "at_line", "at_col")
    return back.select("uri", F.col("line").cast("int").alias("line"), "col")


@query("rename_preview", "SELECT 'S' || s_suppkey || '.kt' AS uri, 2::BIGINT AS occurrences, true AS clean FROM supplier")
def rename_preview(spark, sf_dir):
    from symatlas.sources import extract

    texts = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey", F.lit(".kt")).alias("uri"), F.lit("fun size(): Int {\n  val b = size() // size\n}\n").alias("text"))
    tokens = extract.relation(extract.scanned(texts), "tokens")
    after = edits.preview(texts, edits.rename_edits(tokens, "size", "length"))
    return after.select("uri", F.size(F.regexp_extract_all("text", F.lit("(length)"), F.lit(1))).cast("long").alias("occurrences"), F.col("error").isNull().alias("clean"))


@query("edit_overlaps", "WITH e AS (SELECT l_orderkey AS uri, l_linenumber AS s, l_linenumber + (l_quantity::INT % 2) AS e, l_partkey, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linenumber + (l_quantity::INT % 2)) AS nxt FROM lineitem) SELECT DISTINCT uri FROM e WHERE nxt < e")
def edit_overlaps(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("uri"), F.col("l_linenumber").alias("start_line"), F.lit(0).alias("start_col"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 2).alias("end_line"), F.lit(0).alias("end_col"))
    return edits.overlapping(rows)


@query("flat_output", "SELECT p_brand || ':' || (p_size + 1) || ':' || (p_partkey + 1) || ': ' || p_type || ' ' || p_name AS text FROM part")
def flat_output(spark, sf_dir):
    return output.flat(read(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.col("p_partkey").alias("col"), F.col("p_type").alias("kind"), F.col("p_name").alias("name")))


@query("grouped_output", "SELECT p_brand AS file, p_brand || chr(10) || string_agg('  ' || (p_size + 1) || ':' || (p_partkey + 1) || ' ' || p_type || ' ' || p_name, chr(10) ORDER BY p_size, p_partkey) AS text FROM part GROUP BY p_brand")
def grouped_output(spark, sf_dir):
    return output.grouped(read(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.col("p_partkey").alias("col"), F.col("p_type").alias("kind"), F.col("p_name").alias("name")))


@query("json_output", """SELECT '{"name":"' || p_name || '"' || CASE WHEN p_size > 25 THEN ',"kind":"' || p_type || '"' ELSE '' END || ',"line":' || p_size || '}' AS json FROM part""")
def json_output(spark, sf_dir):
    return output.as_json(read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("").alias("kind"), F.col("p_size").alias("line")))


@query("snapshot_pairs", """SELECT DISTINCT * FROM (SELECT 'calls' AS relation, 'S' || l_suppkey AS a, 'P' || l_partkey % 20 AS b FROM lineitem UNION ALL SELECT 'extends', s_name, 'N' || s_nationkey FROM supplier
UNION ALL SELECT 'overrides', p_name, p_brand FROM part UNION ALL SELECT 'imports', c_mktsegment, 'n' || c_nationkey FROM customer)""")
def snapshot_pairs(spark, sf_dir):
    li, supplier, part, customer = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "part", "customer"))
    return output.snapshot(
        li.select(F.concat(F.lit("S"), "l_suppkey").alias("caller_key"), F.concat(F.lit("P"), F.col("l_partkey") % 20).alias("callee_key")),
        supplier.select(F.col("s_name").alias("sub_name"), F.concat(F.lit("N"), "s_nationkey").alias("super_name")),
        part.select(F.col("p_name").alias("method"), F.col("p_brand").alias("class")),
        customer.select(F.col("c_mktsegment").alias("uri"), F.concat(F.lit("n"), "c_nationkey").alias("full_path")),
    )


@query("workspace_overview", "SELECT n_name AS module, count(DISTINCT c_mktsegment || c_nationkey) AS files, count(*) AS symbols, count(*) FILTER (c_custkey % 10 = 0) AS entry_points FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_name)")
def workspace_overview(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    symbols = customer.select(F.concat("c_mktsegment", "c_nationkey").alias("uri"), F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("C"), "c_custkey", F.lit("Activity"))).otherwise("x").alias("name"), F.lit("class").alias("kind"))
    files = customer.join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat("c_mktsegment", "c_nationkey").alias("uri"), F.col("n_name").alias("module")).distinct()
    return output.overview(symbols, files)


@query("expect_actual", "WITH x AS (SELECT p_name, max(p_partkey) FILTER (p_size % 2 = 0) AS e, count(DISTINCT p_partkey) FILTER (p_size % 2 = 1) AS n FROM part GROUP BY 1) SELECT p_name AS name, e AS expect_uri, n AS actuals FROM x WHERE e IS NOT NULL")
def expect_actual(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    key = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    symbols = part.select(F.col("p_name").alias("name"), key.alias("uri"), F.lit(0).alias("ordinal"), F.when(F.col("p_size") % 2 == 0, "expect fun f()").otherwise("actual fun f()").alias("detail"))
    found = diagnose.expected_and_actual(symbols)
    return found.select("name", F.col("expect_uri").cast("long").alias("expect_uri"), F.when(F.col("actuals").isNull(), 0).otherwise(F.size("actuals")).cast("long").alias("actuals"))


@query("find_tests", "WITH f AS (SELECT p_partkey, 'm/src/' || CASE WHEN p_size % 2 = 0 THEN 'test' ELSE 'main' END || '/' || CASE p_size % 5 WHEN 0 THEN 'RingTest' WHEN 1 THEN 'TestRing' WHEN 2 THEN 'MyRingATest' ELSE 'Other' END || '.kt' AS path, contains(p_name, 'ring') AS t, p_size FROM part) SELECT path, CASE p_size % 5 WHEN 0 THEN 'name' WHEN 1 THEN 'prefix' WHEN 2 THEN 'contains' ELSE 'source set' END AS convention FROM f WHERE p_size % 5 < 3 OR (p_size % 2 = 0 AND t)")
def find_tests(spark, sf_dir):
    size = F.col("p_size")
    stem = F.when(size % 5 == 0, "RingTest").when(size % 5 == 1, "TestRing").when(size % 5 == 2, "MyRingATest").otherwise("Other")
    files = read(spark, sf_dir, "part").select(F.concat(F.lit("m/src/"), F.when(size % 2 == 0, "test").otherwise("main"), F.lit("/"), stem, F.lit(".kt")).alias("path"), F.when(F.col("p_name").contains("ring"), "uses Ring").otherwise("").alias("text"))
    return diagnose.tests_for(files, "Ring")


@query("argument_types", "SELECT l_orderkey AS call, 'f' || l_suppkey % 8 AS callee, l_linenumber - 1 AS position, 'p' || (l_linenumber - 1) AS parameter, 'T' || (l_linenumber - 1) AS type FROM lineitem WHERE l_linenumber - 1 <= l_suppkey % 8")
def argument_types(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("p"), F.col("l_linenumber") - 1))
    arguments = li.select(F.col("l_orderkey").alias("call"), F.concat(F.lit("f"), F.col("l_suppkey") % 8).alias("callee"), (F.col("l_linenumber") - 1).alias("position"), label.alias("label"))
    parameters = F.transform(F.sequence(F.lit(0), F.col("id")), lambda i: F.struct(F.concat(F.lit("p"), i).alias("name"), F.concat(F.lit("T"), i).alias("type")))
    symbols = spark.range(8).select(F.concat(F.lit("f"), "id").alias("name"), parameters.alias("parameters"), F.lit("u").alias("uri"), F.lit(0).alias("ordinal"))
    return infer.argument_types(arguments, symbols).select("call", "callee", "position", "parameter", "type")


@query("lambda_types", """WITH t AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'List<' || p_type || '>' ELSE p_type || '?' END AS type, p_type, p_size % 2 = 0 AS many, p_size % 3 AS k FROM part)
SELECT p_partkey AS uri, CASE k WHEN 0 THEN 'let' WHEN 1 THEN 'apply' ELSE 'map' END AS method, CASE WHEN k = 1 THEN 'this' ELSE 'it' END AS word, CASE WHEN k < 2 AND many THEN type ELSE p_type END AS type FROM t WHERE k < 2 OR many""")
def lambda_types(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    types = part.select(F.col("p_partkey").alias("uri"), F.lit("x").alias("var"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("List<"), "p_type", F.lit(">"))).otherwise(F.concat("p_type", F.lit("?"))).alias("type"))
    method = F.when(F.col("p_size") % 3 == 0, "let").when(F.col("p_size") % 3 == 1, "apply").otherwise("map")
    calls = part.select(F.col("p_partkey").alias("uri"), F.lit("x").alias("receiver"), method.alias("method"))
    return infer.lambda_types(calls, types).select("uri", "method", "word", "type")


@query("hover_text", """SELECT p_partkey AS line, '```kotlin' || chr(10) || 'val ' || p_name || chr(10) || '```' || CASE WHEN p_size % 5 = 0 THEN chr(10) || chr(10) || '*Deprecated*' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || p_type ELSE '' END AS markdown FROM part""")
def hover_text(spark, sf_dir):
    symbols = read(spark, sf_dir, "part").select(F.lit("a.kt").alias("uri"), F.col("p_partkey").alias("sel_line"), F.col("p_name").alias("name"), F.concat(F.lit("val "), "p_name").alias("detail"), (F.col("p_size") % 5 == 0).alias("deprecated"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("documentation"))
    return output.hover(symbols).select("line", "markdown")
