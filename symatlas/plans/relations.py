"""Index, resolution, containment, aggregation and change queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from symatlas.operators import complete, diagnose, index, infer, lookup, resolve, stats
from symatlas.streaming import changes

from .tables import PAGE_IMPORTS, page_imports, query, read, spread


@query("imports_of", f"WITH {PAGE_IMPORTS} SELECT DISTINCT file FROM imports WHERE contains(path, 'the')")
def imports_of(spark, sf_dir):
    return lookup.imports_of(page_imports(spark, sf_dir).select(F.col("file").alias("uri"), F.col("path").alias("full_path")), "the").withColumnRenamed("uri", "file")


@query("package_deps", f"WITH {PAGE_IMPORTS}, p AS (SELECT 'h' || (file % 7) AS package, left(local_name, 1) AS depends_on FROM imports) SELECT package, depends_on, count(*) AS imports FROM p WHERE package <> depends_on GROUP BY ALL")
def package_deps(spark, sf_dir):
    links = page_imports(spark, sf_dir)
    return stats.package_dependencies(links.select(F.concat(F.lit("h"), F.col("file") % 7).alias("package"), F.concat(F.left("local_name", F.lit(1)), F.lit(".x")).alias("path")))


_WORDS = "words AS (SELECT DISTINCT file, unnest(string_split(regexp_replace(regexp_replace(html, '<nav>.*</nav>', ' ', 's'), '<[^>]*>', ' ', 'g'), ' ')) AS word FROM links)"


def _page_words(spark, sf_dir):
    text = F.regexp_replace(F.regexp_replace("html", "(?s)<nav>.*</nav>", " "), "<[^>]*>", " ")
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.explode(F.split(text, " ")).alias("word")).distinct()


@query("unused_imports", f"WITH {PAGE_IMPORTS}, {_WORDS} SELECT file, path, seq FROM imports i WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.file = i.file AND w.word = i.local_name)")
def unused_imports(spark, sf_dir):
    links = page_imports(spark, sf_dir).withColumns({"is_star": F.lit(False), "seq": F.col("seq").cast("long")})
    return resolve.unused_imports(links, _page_words(spark, sf_dir)).select("file", "path", "seq")


@query("duplicate_imports", f"WITH {PAGE_IMPORTS} SELECT file, path, count(*) AS times FROM imports GROUP BY ALL HAVING count(*) > 1")
def duplicate_imports(spark, sf_dir):
    return resolve.duplicate_imports(page_imports(spark, sf_dir))


@query("organized_imports", f"WITH {PAGE_IMPORTS}, {_WORDS}, k AS (SELECT DISTINCT i.file, 'import ' || i.path AS s FROM imports i JOIN words w ON w.file = i.file AND w.word = i.local_name) SELECT file, string_agg(s, ';' ORDER BY s) AS statements FROM k GROUP BY file")
def organized_imports(spark, sf_dir):
    links = page_imports(spark, sf_dir).withColumn("is_star", F.lit(False))
    return resolve.organized(links, _page_words(spark, sf_dir)).select("file", F.array_join("statements", ";").alias("statements"))


@query("importable_unique", "SELECT p_name AS name, string_agg(DISTINCT p_brand || '.' || p_name, ',' ORDER BY p_brand || '.' || p_name) AS fqns, count(DISTINCT p_brand) AS n FROM part GROUP BY p_name")
def importable_unique(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    symbols = part.select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("name"), F.lit(0).alias("start_line"), F.col("p_size").alias("end_line"))
    found = index.importable(symbols, part.select(F.col("p_partkey").alias("uri"), F.col("p_brand").alias("package")))
    return found.select("name", F.array_join("fqns", ",").alias("fqns"), F.size("fqns").cast("long").alias("n"))


@query("missing_imports", """WITH fqns AS (SELECT p_name || p_size || p_type AS name, p_brand || '.' || p_name || p_size || p_type AS fqn FROM part),
n AS (SELECT DISTINCT s_suppkey AS file, CASE WHEN s_suppkey % 5 = 0 THEN p_name ELSE p_name || p_size || p_type END AS name FROM supplier JOIN part ON p_size = s_nationkey),
k AS (SELECT name, count(DISTINCT fqn) AS n, min(fqn) AS fqn FROM fqns GROUP BY name)
SELECT file, n.name, coalesce(k.n, 0) AS n, CASE WHEN k.n = 1 THEN fqn END AS fqn, CASE WHEN k.n = 1 THEN 'unique' WHEN k.n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status FROM n LEFT JOIN k ON k.name = n.name""")
def missing_imports(spark, sf_dir):
    part, name = read(spark, sf_dir, "part"), F.concat("p_name", "p_size", "p_type")
    fqns = part.select(name.alias("name"), F.concat_ws(".", F.col("p_brand"), name).alias("fqn"))
    # a file meets each name once, however many parts have it
    used = spread(part.select("p_size", "p_name", name.alias("name")).distinct(), "p_size", "p_name", "name")
    met = spread(read(spark, sf_dir, "supplier"), "s_suppkey").join(used, F.col("p_size") == F.col("s_nationkey"))
    names = met.select(F.col("s_suppkey").alias("file"), F.when(F.col("s_suppkey") % 5 == 0, F.col("p_name")).otherwise(F.col("name")).alias("name"))
    return resolve.missing_imports(names, fqns)


@query("auto_import_candidates", """WITH c AS (SELECT DISTINCT s_nationkey AS file, p_brand AS package, p_name AS fqn FROM supplier JOIN part ON p_size = s_nationkey),
i AS (SELECT n_nationkey AS file, 'red ' || CASE WHEN n_regionkey = 0 THEN 'ring' ELSE 'bolt' END AS path, false AS is_star FROM nation UNION ALL SELECT n_nationkey, 'Brand#' || n_regionkey, true FROM nation)
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE NOT is_star AND i.file = c.file AND i.path = c.fqn) AND NOT EXISTS (SELECT 1 FROM i WHERE is_star AND i.file = c.file AND i.path = c.package)""")
def auto_import_candidates(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    exact = nation.select(F.col("n_nationkey").alias("file"), F.concat(F.lit("red "), F.when(F.col("n_regionkey") == 0, "ring").otherwise("bolt")).alias("path"), F.lit(False).alias("is_star"))
    star = nation.select(F.col("n_nationkey").alias("file"), F.concat(F.lit("Brand#"), "n_regionkey").alias("path"), F.lit(True).alias("is_star"))
    files = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file")).distinct()
    declared = read(spark, sf_dir, "part").select("p_size", F.col("p_brand").alias("package"), F.col("p_name").alias("fqn")).distinct()
    candidates = files.join(declared, F.col("p_size") == F.col("file")).select("file", "package", "fqn")
    return resolve.visible(exact.unionByName(star), candidates).select("file", "package", "fqn")


@query("annotated_lookup", "SELECT p_name AS symbol, coalesce(min(p_partkey) FILTER (p_size > 10), 0) AS line FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_brand = 'Brand#7') GROUP BY p_name")
def annotated_lookup(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    annotations = part.select(F.lit("u").alias("uri"), F.col("p_name").alias("symbol_name"), F.col("p_brand").alias("annotation"))
    symbols = part.filter("p_size > 10").select(F.lit("u").alias("uri"), F.col("p_name").alias("name"), F.col("p_partkey").alias("sel_line"))
    return lookup.annotated(annotations, symbols, "Brand#7").select(F.col("name").alias("symbol"), "line")


_SCOPES = "scopes AS (SELECT l_orderkey AS k, l_partkey AS name, l_linenumber AS s, l_linenumber + (l_quantity::INT % 6) AS e FROM lineitem), probes AS (SELECT o_orderkey AS k, 1 + (o_orderkey % 9)::INT AS pos FROM orders)"


def _contained(spark, sf_dir, choose):
    probes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (1 + F.col("o_orderkey") % 9).cast("int").alias("pos"))
    li = read(spark, sf_dir, "lineitem")
    scopes = li.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("s"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 6).alias("e"))
    return resolve.contained(probes, scopes, "k", "pos", "s <= pos and pos <= e", choose)


@query("containment_innermost", f"WITH {_SCOPES} SELECT k, pos, arg_min(name, (e - s, s, name)) AS scope FROM probes JOIN scopes USING (k) WHERE s <= pos AND pos <= e GROUP BY k, pos")
def containment_innermost(spark, sf_dir):
    return _contained(spark, sf_dir, F.min_by("name", F.struct(F.expr("e - s"), "s", "name")))


@query("containment_nearest", f"WITH {_SCOPES} SELECT k, pos, arg_max(name, (s, name)) AS scope FROM probes JOIN scopes USING (k) WHERE s <= pos AND pos <= e GROUP BY k, pos")
def containment_nearest(spark, sf_dir):
    return _contained(spark, sf_dir, F.max_by("name", F.struct("s", "name")))


@query("containment_first", f"WITH {_SCOPES} SELECT k, pos, min(name) AS scope FROM probes JOIN scopes USING (k) WHERE s <= pos AND pos <= e GROUP BY k, pos")
def containment_first(spark, sf_dir):
    return _contained(spark, sf_dir, F.min("name"))


_SYMBOLS = "symbols AS (SELECT o_custkey AS uri, 'O' || o_orderkey AS name, (o_orderkey % 40)::INT AS s, (o_orderkey % 40 + floor(o_totalprice)::BIGINT % 9)::INT AS e FROM orders)"


@query("top_level_symbols", f"WITH {_SYMBOLS} SELECT uri, name FROM symbols x WHERE NOT EXISTS (SELECT 1 FROM symbols o WHERE o.uri = x.uri AND o.s <= x.s AND x.e <= o.e AND (o.s <> x.s OR o.e <> x.e))")
def top_level_symbols(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    start = (F.col("o_orderkey") % 40).cast("int")
    symbols = o.select(F.col("o_custkey").alias("uri"), F.concat(F.lit("O"), "o_orderkey").alias("name"), start.alias("start_line"), (start + F.floor("o_totalprice") % 9).cast("int").alias("end_line"))
    return index.top_level(symbols).select("uri", "name")


@query("references_sorted", "SELECT DISTINCT doc_id AS file, i AS line FROM (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS t FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS w FROM documents)) WHERE t = 'eran'")
def references_sorted(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    tokens = docs.select(F.col("doc_id").alias("file"), F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("line", "text"))
    found = resolve.references(tokens.withColumns({"col": F.lit(0), "line": F.col("line").cast("long")}), "eran")
    return found.select("file", "line")


@query("reference_kinds", """SELECT l_orderkey AS ref, l_linenumber AS line, CASE WHEN l_returnflag = 'A' THEN 'import' WHEN l_linestatus = 'O' AND l_quantity > 40 THEN 'call' WHEN l_discount > 0.05 THEN 'write' ELSE 'read' END AS kind FROM lineitem""")
def reference_kinds(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    context = F.array_compact(F.array(F.when(F.col("l_discount") > 0.05, "write"), F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40), "call"), F.when(F.col("l_returnflag") == "A", "import")))
    return li.select(F.col("l_orderkey").alias("ref"), F.col("l_linenumber").alias("line"), resolve.classified(context).alias("kind"))


@query("location_dedup", "SELECT DISTINCT l_partkey AS uri, l_linenumber AS line FROM lineitem ORDER BY 1, 2")
def location_dedup(spark, sf_dir):
    return resolve.sorted_locations(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("uri"), F.col("l_linenumber").alias("line")), "uri", "line")


_TIERS = """n AS (SELECT c_custkey AS q, s_suppkey AS s, 1 AS tier FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_suppkey % 3 = 0),
r AS (SELECT c_custkey, s_suppkey, 2 FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN supplier ON s_nationkey = b.n_nationkey WHERE s_suppkey % 5 = 0),
e AS (SELECT c_custkey, 0::BIGINT, 3 FROM customer), t AS (SELECT * FROM n UNION ALL SELECT * FROM r UNION ALL SELECT * FROM e)"""


@query("priority_resolution", f"WITH {_TIERS} SELECT q, tier, min(s) AS first, count(*) AS n FROM t WHERE (q, tier) IN (SELECT q, min(tier) FROM t GROUP BY q) GROUP BY q, tier")
def priority_resolution(spark, sf_dir):
    customer, supplier, nation = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    # candidates are counted by nation and region first, so that a customer meets a row of each and not all of them
    counts = F.min("s_suppkey").alias("first"), F.count("*").alias("n")
    own = customer.join(supplier.filter("s_suppkey % 3 = 0").groupBy("s_nationkey").agg(*counts), F.col("c_nationkey") == F.col("s_nationkey")).select(F.col("c_custkey").alias("q"), "first", "n")
    regional = supplier.filter("s_suppkey % 5 = 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(*counts)
    near = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey").join(regional, "n_regionkey").select(F.col("c_custkey").alias("q"), "first", "n")
    rest = customer.select(F.col("c_custkey").alias("q"), F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("n"))
    return resolve.first_tier([own, near, rest], "q").groupBy("q", "tier").agg(F.min("first").alias("first"), F.sum("n").alias("n"))


@query("same_package", """WITH d AS (SELECT s_suppkey AS f, s_nationkey AS p FROM supplier), q AS (SELECT f, p FROM d)
SELECT q.f AS req, min(d.f) AS def_file FROM q JOIN d ON d.p = q.p AND d.f <> q.f GROUP BY q.f""")
def same_package(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier")
    files = supplier.select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").alias("package"))
    definitions = supplier.select(F.lit("T").alias("name"), F.col("s_suppkey").alias("file"), F.lit(0).alias("line"))
    requests = supplier.select(F.col("s_suppkey").alias("req"), F.col("s_suppkey").alias("file"), F.lit("T").alias("name"))
    return resolve.same_package(files, definitions, requests).select("req", "def_file")


@query("star_import_tier", """WITH i AS (SELECT c_custkey AS file, n_nationkey AS package, (n_nationkey * 7 + c_custkey) % 25 AS seq FROM customer JOIN nation ON n_nationkey % 5 = c_custkey % 5),
m AS (SELECT i.file AS req, s_suppkey AS def_file, row_number() OVER (PARTITION BY i.file ORDER BY seq, s_suppkey) AS k FROM i JOIN supplier ON s_nationkey = package) SELECT req, def_file FROM m WHERE k = 1""")
def star_import_tier(spark, sf_dir):
    customer, nation, supplier = (read(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    imports = customer.join(nation, F.col("n_nationkey") % 5 == F.col("c_custkey") % 5).select(F.col("c_custkey").alias("file"), F.col("n_nationkey").alias("path"), ((F.col("n_nationkey") * 7 + F.col("c_custkey")) % 25).alias("seq"), F.lit(True).alias("is_star"))
    definitions = supplier.select(F.lit("T").alias("name"), F.col("s_suppkey").alias("file"), F.lit(0).alias("line"), F.col("s_nationkey").alias("package"))
    requests = customer.select(F.col("c_custkey").alias("req"), F.col("c_custkey").alias("file"), F.lit("T").alias("name"))
    return resolve.star_imports(imports, definitions, requests).select("req", "def_file")


@query("workspace_union_library", "SELECT split_part(text, ' ', 1) AS name, 'workspace' AS origin, doc_id AS id FROM documents UNION ALL SELECT split_part(text, ' ', 1), 'library', item_id FROM benchmark")
def workspace_union_library(spark, sf_dir):
    first = F.split_part("text", F.lit(" "), F.lit(1)).alias("name")
    own, library = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return lookup.with_library(own.select(first, F.col("doc_id").alias("id")), library.select(first, F.col("item_id").alias("id"))).select("name", "origin", "id")


@query("qualified_last_wins", "SELECT p_brand || '.' || p_name AS fqn, max(p_partkey) AS uri FROM part GROUP BY 1")
def qualified_last_wins(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    symbols = part.select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("name"), F.col("p_size").alias("sel_line"), F.lit(0).alias("ordinal"))
    files = part.select(F.col("p_partkey").alias("uri"), F.col("p_brand").alias("package"))
    return index.qualified(symbols, files).filter(~F.col("fqn").rlike(r"^[^.]*\.[0-9]+\.")).select("fqn", "uri")


@query("replaced_files", "SELECT l_orderkey AS uri, l_partkey AS name FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, -o_custkey FROM orders WHERE o_orderkey % 4 = 0")
def replaced_files(spark, sf_dir):
    old = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uri"), F.col("l_partkey").alias("name"))
    fresh = read(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("uri"), (-F.col("o_custkey")).alias("name"))
    return index.replaced(old.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uri")), "uri", "left_semi"), fresh, fresh)


@query("manifest_hits", "SELECT n.s_suppkey AS path, CASE WHEN o.s_suppkey IS NULL THEN 'parse' ELSE 'hit' END AS action FROM supplier n LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 1) o ON o.s_suppkey = n.s_suppkey AND o.s_nationkey = CASE WHEN n.s_suppkey % 7 = 0 THEN -1 ELSE n.s_nationkey END")
def manifest_hits(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier")
    manifest = supplier.filter("s_suppkey % 4 != 1").select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("mtime_secs"), F.lit(1).alias("size"))
    listing = supplier.select(F.col("s_suppkey").alias("path"), F.when(F.col("s_suppkey") % 7 == 0, -1).otherwise(F.col("s_nationkey")).alias("mtime_secs"), F.lit(1).alias("size"))
    hits, rest = index.unchanged(manifest, listing)
    return hits.select("path", F.lit("hit").alias("action")).unionByName(rest.select("path", F.lit("parse").alias("action")))


@query("latest_artifacts", """WITH a AS (SELECT p_type AS g, p_name AS a, p_size // 10 AS x, p_size % 10 AS y FROM part), m AS (SELECT g, a, max(x * 100 + y) AS v FROM a GROUP BY ALL)
SELECT g AS "group", a AS artifact, (v // 100)::VARCHAR || '.' || (v % 100)::VARCHAR AS version FROM m""")
def latest_artifacts(spark, sf_dir):
    size = F.col("p_size")
    rows = read(spark, sf_dir, "part").select(F.col("p_type").alias("group"), F.col("p_name").alias("artifact"), F.concat_ws(".", F.floor(size / 10), size % 10).alias("version"))
    return index.latest_artifacts(rows.distinct())


@query("bare_names", "SELECT DISTINCT p_name AS name FROM part ORDER BY 1")
def bare_names(spark, sf_dir):
    return index.bare_names(read(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query("summaries_last_wins", "SELECT p_brand || '::' || p_name AS key, arg_max(p_type, p_partkey) AS kind, max(p_partkey) AS last FROM part WHERE p_size > 5 GROUP BY 1")
def summaries_last_wins(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    symbols = part.select(F.col("p_brand").alias("uri"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("ordinal"), F.when(F.col("p_size") > 5, "public").otherwise("private").alias("visibility"), F.col("p_partkey").cast("string").alias("detail"))
    return index.summaries(symbols).select("key", "kind", F.col("detail").cast("long").alias("last"))


@query("impact_breakdown", """SELECT l_partkey AS part, count(*) FILTER (k = 'call') AS call, count(*) FILTER (k = 'read') AS read, count(*) FILTER (k = 'write') AS write, count(*) FILTER (k = 'import') AS import, count(*) FILTER (k = 'type_use') AS type_use, count(*) FILTER (k = 'other') AS other, count(*) AS total
FROM (SELECT l_partkey, CASE WHEN l_returnflag = 'A' THEN 'call' WHEN l_returnflag = 'N' THEN 'read' WHEN l_linestatus = 'O' THEN 'write' ELSE 'other' END AS k FROM lineitem) GROUP BY 1""")
def impact_breakdown(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "N", "read").when(F.col("l_linestatus") == "O", "write").otherwise("override")
    refs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), kind.alias("kind"))
    return stats.breakdown(refs, "part")


_RISK = "SELECT {k} AS key, count(*) AS total, count(DISTINCT l_suppkey) AS callers FROM lineitem GROUP BY 1"


@query("impact_risk", f"""WITH t AS ({_RISK.format(k="'p' || l_partkey")} UNION ALL {_RISK.format(k="'o' || l_orderkey")} UNION ALL {_RISK.format(k="'s' || l_suppkey")})
SELECT key, total, callers, CASE WHEN total > 50 OR (total > 5 AND callers > 10) THEN 'high' WHEN total > 5 OR callers > 10 THEN 'medium' ELSE 'low' END AS risk FROM t""")
def impact_risk(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.explode(F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("s"), "l_suppkey"))).alias("key"), "l_suppkey")
    counted = li.groupBy("key").agg(F.count("*").alias("total"), F.countDistinct("l_suppkey").alias("callers"))
    return counted.withColumn("risk", stats.risk(F.col("total"), F.col("callers")))


@query("kind_histogram", "SELECT lang AS kind, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def kind_histogram(spark, sf_dir):
    return stats.histogram(read(spark, sf_dir, "documents").select(F.col("lang").alias("kind")), "kind")


@query("module_rollup", "SELECT lang AS module, count(DISTINCT source) AS files, count(*) AS symbols FROM documents GROUP BY ROLLUP (lang)")
def module_rollup(spark, sf_dir):
    return stats.module_rollup(read(spark, sf_dir, "documents").select(F.col("lang").alias("module"), F.col("source").alias("uri")))


@query("cache_stats", "SELECT count(*) AS total, count(*) FILTER (contains(text, 'License')) AS with_doc, count(*) FILTER (n_chars > 1000) AS with_signature, count(DISTINCT source) AS files FROM documents")
def cache_stats(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    symbols = docs.select(F.when(F.col("text").contains("License"), F.col("text")).alias("documentation"), F.when(F.col("n_chars") > 1000, "x").otherwise("").alias("detail"), F.col("source").alias("uri"))
    return stats.cache_statistics(symbols)


@query("module_dependents", "SELECT n_name AS module, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'A') AS depends_on, count(DISTINCT l_orderkey) AS dependents FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def module_dependents(spark, sf_dir):
    nation, supplier, li = (read(spark, sf_dir, t) for t in ("nation", "supplier", "lineitem"))
    rows = li.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return stats.module_dependents(rows.select(F.col("n_name").alias("module"), F.when(F.col("l_returnflag") == "A", F.col("l_suppkey")).alias("depends_on"), F.col("l_orderkey").alias("dependent")))


@query("importers_of", f"WITH {PAGE_IMPORTS} SELECT path, count(DISTINCT file) AS files, count(*) AS imports FROM imports GROUP BY path")
def importers_of(spark, sf_dir):
    return lookup.importers(page_imports(spark, sf_dir).select(F.col("file").alias("uri"), F.col("path").alias("full_path"))).withColumnRenamed("full_path", "path")


_LAST = "SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events"


@query("debounce_sessions", f"""WITH e AS ({_LAST}), g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM e)
SELECT user_id AS uri, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", arg_max(props, ts) AS text, count(*) AS n FROM g GROUP BY user_id, burst""")
def debounce_sessions(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("uri"), "ts", F.col("props").alias("text"))
    return changes.debounced(rows, "30 minutes")


@query("hash_dedup_runs", "WITH e AS (SELECT user_id AS uri, event_id AS seq, event_type AS text, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT uri, seq, text FROM e WHERE text IS DISTINCT FROM before")
def hash_dedup_runs(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("uri"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("text"))
    return changes.changed_runs(rows).select("uri", "seq", "text")


@query("late_generation_filter", "SELECT user_id AS uri, event_id AS seq, event_id % 5 AS generation FROM events e WHERE event_id % 5 = (SELECT max(event_id % 5) FROM events x WHERE x.user_id = e.user_id)")
def late_generation_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("uri"), F.col("event_id").alias("seq"), (F.col("event_id") % 5).alias("generation"))
    return changes.current_generation(rows).select("uri", "seq", "generation")


@query("live_overlay", "SELECT coalesce(l.uri, b.uri) AS uri, coalesce(l.text, b.text) AS text FROM (SELECT s_suppkey AS uri, s_name AS text FROM supplier) b FULL JOIN (SELECT user_id AS uri, arg_max(event_type, (ts, event_id)) AS text FROM events GROUP BY 1) l ON l.uri = b.uri")
def live_overlay(spark, sf_dir):
    base = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uri"), F.col("s_name").alias("text"))
    live = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("uri")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("text"))
    return changes.overlaid(base, live)


@query("token_delta", """WITH t AS (SELECT l_orderkey AS file, l_linenumber AS line, (l_partkey % 80)::INT AS start, lag(l_linenumber) OVER w AS pl, lag((l_partkey % 80)::INT) OVER w AS ps
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 80, l_suppkey))
SELECT file, line, start, line - coalesce(pl, 0) AS delta_line, CASE WHEN line = pl THEN start - ps ELSE start END AS delta_start FROM t""")
def token_delta(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uri"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 80).cast("int").alias("col"))
    return infer.delta_encoded(rows).select(F.col("uri").alias("file"), "line", F.col("col").alias("start"), "delta_line", F.col("delta_col").alias("delta_start"))


@query("folding_ranges", """WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, length(unnest(x)) > 40 AS long FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM l WHERE long)
SELECT doc_id, min(i) AS start_line, max(i) AS end_line FROM g GROUP BY doc_id, island HAVING count(*) > 1""")
def folding_ranges(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("uri"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line_no", F.col("line_no").cast("long"))
    return diagnose.islands(lines, F.length("line") > 40).withColumnRenamed("uri", "doc_id")


@query("known_name_intersection", "SELECT name FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_brand = 'Brand#3' INTERSECT SELECT p_name FROM part WHERE p_type = 'SMALL')")
def known_name_intersection(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    part = part.withColumn("name", F.col("p_name"))
    return lookup.known_names(part.filter("p_brand = 'Brand#3'"), part.filter("p_type = 'SMALL'"))


@query("inherited_members", """WITH RECURSIVE edges AS (SELECT s_name AS sub, n_name AS super FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT 'Supplier#000000002' AS owner, 0 AS level UNION SELECT super, level + 1 FROM t JOIN edges ON sub = owner WHERE level < 4),
m AS (SELECT n_name AS owner, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'function' ELSE 'class' END AS kind, c_custkey AS ordinal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0)
SELECT name, kind, level FROM m JOIN t USING (owner)""")
def inherited_members(spark, sf_dir):
    from .tables import type_edges

    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("owner"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "function").otherwise("class").alias("kind"), F.col("c_custkey").alias("ordinal"), F.when(F.col("c_custkey") % 3 == 0, "private").otherwise("public").alias("visibility"))
    return complete.members(rows, type_edges(spark, sf_dir), "Supplier#000000002")


@query("batch_requests", """WITH q AS (SELECT c_custkey AS req, CASE c_custkey % 3 WHEN 0 THEN 'definition' WHEN 1 THEN 'subtypes' ELSE 'callers' END AS type, c_custkey % 60 AS key FROM customer),
a AS (SELECT req, type, p_name AS answer FROM q JOIN part ON p_partkey = key WHERE type = 'definition'
UNION ALL SELECT req, type, s_name FROM (SELECT req, type, s_name, row_number() OVER (PARTITION BY req ORDER BY s_name) AS k FROM q JOIN supplier ON s_nationkey = key WHERE type = 'subtypes') WHERE k <= 50
UNION ALL SELECT req, type, c FROM (SELECT req, type, c, row_number() OVER (PARTITION BY req ORDER BY c) AS k FROM (SELECT DISTINCT req, type, 'S' || l_suppkey AS c FROM q JOIN lineitem ON l_partkey = key WHERE type = 'callers')) WHERE k <= 20)
SELECT q.req, q.type, coalesce(answer, 'not found') AS answer FROM q LEFT JOIN (SELECT DISTINCT * FROM a) AS a USING (req) ORDER BY 1""")
def batch_requests(spark, sf_dir):
    kinds = F.when(F.col("c_custkey") % 3 == 0, "definition").when(F.col("c_custkey") % 3 == 1, "subtypes").otherwise("callers")
    requests = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("req_id"), kinds.alias("type"), (F.col("c_custkey") % 60).alias("name"))
    part, supplier, li = (read(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    relations = {"definition": (part, "p_partkey", F.col("p_name"), None), "subtypes": (supplier, "s_nationkey", F.col("s_name"), 50), "callers": (li, "l_partkey", F.concat(F.lit("S"), "l_suppkey"), 20)}
    return lookup.batch(requests, relations).withColumnRenamed("req_id", "req")


@query("warm_paths", "SELECT s_suppkey AS path FROM supplier WHERE s_suppkey % 4 <> 1 OR s_nationkey >= 18")
def warm_paths(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier")
    listing = supplier.select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("mtime_secs"))
    gone = supplier.select((-F.col("s_suppkey")).alias("path"))
    return index.warm(listing.filter("path % 4 != 1").select("path").unionByName(gone), listing, 20)


_CHANGED = "SELECT file, seq, path, p_name AS local_name FROM (SELECT s_suppkey AS file, p_partkey AS seq, lower(p_type) || '.' || p_name AS path, p_name FROM supplier JOIN part ON p_size = s_nationkey)"


@query("import_tier", f"""WITH i AS ({_CHANGED}), q AS (SELECT DISTINCT lower(p_type) || '.' || p_name AS path, p_brand AS def_file FROM part WHERE p_brand = 'Brand#3'),
r AS (SELECT file AS req, seq, 0 AS tier, def_file FROM i JOIN q USING (path) WHERE local_name = 'red ring'
UNION ALL SELECT file, seq, 1, 'sub' FROM i WHERE local_name = 'red ring' AND starts_with(path, 'small.')), b AS (SELECT req, min((seq, tier)) AS best FROM r GROUP BY req)
SELECT DISTINCT r.req, r.def_file FROM r JOIN b ON r.req = b.req AND (r.seq, r.tier) = b.best""")
def import_tier(spark, sf_dir):
    supplier, part = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "part")
    path = F.concat(F.lower("p_type"), F.lit("."), F.col("p_name"))
    # of a file's imports of one path the first is enough
    first = part.groupBy("p_size", path.alias("path"), F.col("p_name").alias("local_name")).agg(F.min("p_partkey").alias("seq"))
    imports = supplier.join(first, F.col("p_size") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("file"), "seq", "path", "local_name", F.lit(False).alias("is_star"))
    qualified = part.filter("p_brand = 'Brand#3'").select(path.alias("fqn"), F.col("p_brand").alias("def_file"), F.lit(0).alias("line")).distinct()
    definitions = spark.createDataFrame([("red ring", "small.inner", "sub", 0)], "name string, package string, def_file string, line int")
    requests = supplier.select(F.col("s_suppkey").alias("req"), F.col("s_suppkey").alias("file"), F.lit("red ring").alias("name"))
    return resolve.via_imports(imports, qualified, definitions, requests).select("req", "def_file")
