"""Search, ranking, name lookup and scalar-function queries over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from symatlas.functions import identifiers as ids, paths
from symatlas.operators import complete, lookup, search
from symatlas.session import shared_folder
from symatlas.sources.store import Store, lookup_lazily, write_by_name

from .tables import SEARCH_DOCS, query, read, search_docs, search_index, stored, text_index, tokens

_BM25 = """, stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM kept),
post AS (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM kept),
hits AS (SELECT * FROM post WHERE {where}),
tf AS (SELECT id, term, dl, count(*) AS tf FROM hits GROUP BY ALL),
df AS (SELECT term, count(DISTINCT id) AS df FROM hits GROUP BY term),
scored AS (SELECT id, sum(({weight}) * greatest(0.0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN df USING (term) CROSS JOIN stats GROUP BY id)"""


def _sql(words, keep="true"):
    where = " OR ".join(f"starts_with(term, '{w}')" for w in words)
    weight = " + ".join(f"CASE WHEN term = '{w}' THEN 1.0 WHEN starts_with(term, '{w}') THEN 0.5 ELSE 0.0 END" for w in words)
    return f"WITH {SEARCH_DOCS}, kept AS (SELECT * FROM docs WHERE {keep})" + _BM25.format(where=where, weight=weight)


def _top(spark, sf_dir, words, keep=None, limit=20):
    """From the stored index, which the first search over a table builds."""
    found = search.bm25_stored(spark, search_index(spark, sf_dir), words, keep).withColumn("score", F.round("score", 6))
    return found.orderBy(F.desc("score"), "id").limit(limit)


@query("search_bm25", _sql(["there", "thing"]) + " SELECT id, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY 2 DESC, 1 LIMIT 20")
def search_bm25(spark, sf_dir):
    return _top(spark, sf_dir, ["there", "thing"])


@query("search_prefix", _sql(["thin"]) + " SELECT id, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY 2 DESC, 1 LIMIT 20")
def search_prefix(spark, sf_dir):
    return _top(spark, sf_dir, ["thin"])


@query("search_kind_filter", _sql(["und", "die"], "kind = 'de'") + " SELECT id, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY 2 DESC, 1 LIMIT 20")
def search_kind_filter(spark, sf_dir):
    return _top(spark, sf_dir, ["und", "die"], search.passes(search.ParsedQuery(kinds=["de"])))


@query("search_path_filter", _sql(["the"], "contains(lower(file), 'src1')") + " SELECT id, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY 2 DESC, 1 LIMIT 20")
def search_path_filter(spark, sf_dir):
    return _top(spark, sf_dir, ["the"], search.passes(search.ParsedQuery(paths=["SRC1"])))


@query("search_filters_only", f"WITH {SEARCH_DOCS} SELECT id, name, file, 1.0::DOUBLE AS score FROM docs WHERE kind = 'fr' AND contains(lower(name), 'la') ORDER BY name, generated, file, line LIMIT 50")
def search_filters_only(spark, sf_dir):
    docs = search_docs(spark, sf_dir).filter(search.passes(search.ParsedQuery(kinds=["fr"], names=["LA"])))
    return search.listing(docs, 50).select("id", "name", "file", "score")


_DEFERRED = """, named AS (SELECT d.*, round(s.score, 6) AS score FROM docs d JOIN scored s USING (id) WHERE s.score > 0),
marked AS (SELECT *, generated AND max(CASE WHEN generated THEN 0 ELSE 1 END) OVER (PARTITION BY name) = 1 AS deferred FROM named),
top AS (SELECT * FROM marked ORDER BY deferred, score DESC, name, file, line LIMIT 40)
SELECT id, name, deferred, score, round(least(1.0, score / first_value(score) OVER (ORDER BY deferred, score DESC, name, file, line)), 6) AS relative FROM top"""


@query("generated_deferral", _sql(["licensed", "under"]) + _DEFERRED)
def generated_deferral(spark, sf_dir):
    docs = search_docs(spark, sf_dir)
    scored = search.bm25(docs, ["licensed", "under"]).withColumn("score", F.round("score", 6)).join(docs, "id")
    return search.ranked(scored, 40).select("id", "name", "deferred", "score", F.round("relative", 6).alias("relative"))


@query("term_df", "SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term")
def term_df(spark, sf_dir):
    return search.term_statistics(search_docs(spark, sf_dir))


@query("doc_tokens_count", f"WITH {SEARCH_DOCS} SELECT id, len(tokens)::BIGINT AS n_tokens, len(list_distinct(tokens))::BIGINT AS n_terms FROM docs")
def doc_tokens_count(spark, sf_dir):
    return search.sizes(search_docs(spark, sf_dir))


@query("average_length", f"WITH {SEARCH_DOCS} SELECT kind, count(*) AS docs, round(avg(len(tokens)), 6) AS avgdl FROM docs GROUP BY kind")
def average_length(spark, sf_dir):
    return search.average_lengths(search_docs(spark, sf_dir), "kind").withColumn("avgdl", F.round("avgdl", 6))


@query("search_truncated", f"WITH {SEARCH_DOCS}, hit AS (SELECT id, name FROM docs WHERE contains(lower(name), 'th')), page AS (SELECT *, count(*) OVER () > 25 AS truncated FROM hit) SELECT id, name, truncated FROM page ORDER BY name, id LIMIT 25")
def search_truncated(spark, sf_dir):
    docs = search_docs(spark, sf_dir).filter(F.lower("name").contains("th")).select("id", "name")
    return search.truncated(docs, 25, "name", "id").select("id", "name", "truncated")


@query("find_exact", "SELECT p_partkey, p_name, p_type FROM part WHERE p_name = 'red widget'")
def find_exact(spark, sf_dir):
    return lookup.find(read(spark, sf_dir, "part").withColumn("name", F.col("p_name")), "red widget").select("p_partkey", "p_name", "p_type")


@query("find_substring", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_brand), '#2') AND p_type IN ('ECONOMY', 'SMALL')")
def find_substring(spark, sf_dir):
    symbols = read(spark, sf_dir, "part").withColumns({"name": F.col("p_name"), "module": F.lower("p_brand"), "kind": F.lower("p_type")})
    return lookup.find(symbols, part="ring", kinds=["ECONOMY", "SMALL"], module="#2").select("p_partkey", "p_name", "p_brand")


@query("docs_substring", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'version')")
def docs_substring(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return lookup.documented(docs.withColumnRenamed("text", "documentation"), "version").select("doc_id", "source")


@query("line_word_search", r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)
SELECT doc_id, line_no, length(line)::BIGINT AS n FROM lines WHERE regexp_matches(' ' || line || ' ', '[^a-zA-Z0-9_]License[^a-zA-Z0-9_]')""")
def line_word_search(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lookup.word_lines(lines, "License").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("text").cast("long").alias("n"))


_STEM = """CASE WHEN strlen(w) <= 3 THEN w
 WHEN ends_with(w, 'ing') AND strlen(w) BETWEEN 6 AND 9 THEN CASE WHEN w[-4:-4] = w[-5:-5] THEN left(w, -4) ELSE left(w, -3) END
 WHEN ends_with(w, 'ed') AND strlen(w) > 4 THEN CASE WHEN w[-3:-3] = w[-4:-4] THEN left(w, -3) ELSE left(w, -2) END
 WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND strlen(w) BETWEEN 6 AND 9 THEN CASE WHEN ends_with(left(w, -1), 'e') AND length(w) > 3 THEN left(w, -2) ELSE left(w, -1) END
 WHEN ends_with(w, 'tion') AND strlen(w) BETWEEN 9 AND 14 THEN left(w, -3) || 'e'
 WHEN ends_with(w, 'ment') AND strlen(w) BETWEEN 6 AND 9 THEN left(w, -4)
 WHEN ends_with(w, 'ly') AND strlen(w) > 4 THEN left(w, -2)
 WHEN ends_with(w, 'ies') AND strlen(w) > 4 THEN left(w, -3) || 'y' ELSE w END"""


@query("stems", f"WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) SELECT w, {_STEM} AS stem FROM words")
def stems(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("w")).distinct()
    return words.select("w", ids.stem(F.col("w")).alias("stem"))


_STOPS = ", ".join(f"'{w}'" for w in ids.STOP_WORDS)


@query("query_words", rf"""WITH w AS (SELECT doc_id, unnest(range(len(l))) AS i, lower(regexp_replace(regexp_replace(unnest(l), '^[!-/:-@\[-^`{{-~]+', ''), '[!-/:-@\[-^`{{-~]+$', '')) AS w
FROM (SELECT doc_id, regexp_split_to_array(text, '[ \t\n\r\f\v]+') AS l FROM documents))
SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM w WHERE w <> '' AND w NOT IN ({_STOPS}) GROUP BY doc_id""")
def query_words(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.array_join(ids.query_words(F.col("text")), " ").alias("words"))
    return words.filter("words != ''")


@query("identifier_segments", r"""WITH names AS (SELECT c_custkey AS id, c_mktsegment || 'Html' || replace(c_name, '#', 'HTTPServer2x_') AS name FROM customer),
cut AS (SELECT id, name, string_split(trim(regexp_replace(regexp_replace(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), ' ') AS p FROM names)
SELECT id, array_to_string(list_transform(list_filter(p, lambda x: length(x) BETWEEN 2 AND 32 AND NOT regexp_matches(x, '^[0-9]+$')), lambda x: lower(x)), ' ') AS segments FROM cut""")
def identifier_segments(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    name = F.concat("c_mktsegment", F.lit("Html"), F.replace("c_name", F.lit("#"), F.lit("HTTPServer2x_")))
    return customer.select(F.col("c_custkey").alias("id"), F.array_join(ids.segments(name), " ").alias("segments"))


_FUZZY = """WITH n AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part),
s AS (SELECT name, lower(name) AS l FROM n WHERE regexp_matches(lower(name), 'r.*g')),
g AS (SELECT name, l, (length(l) - strpos(reverse(l), 'g')) - (strpos(l, 'r') - 1) AS span,
  strpos(l, 'r') AS p1, strpos(l, 'r') + strpos(substr(l, strpos(l, 'r') + 1), 'g') AS p2 FROM s)
SELECT name, round(least(1.0, 0.7 + 0.2 * (CASE WHEN span > 0 THEN 1 - (span - 2)::DOUBLE / (span + 1) ELSE 1 END) + 0.1 * (CASE WHEN p2 = p1 + 1 THEN 0.1 ELSE 0 END)), 9) AS score
FROM g ORDER BY 2 DESC, 1 LIMIT 30"""


@query("fuzzy_topk", _FUZZY)
def fuzzy_topk(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return search.fuzzy_top(names, "name", "rg", 30)


_MATCH = """WITH c AS (SELECT s_suppkey AS id, 'supplierNode' || s_nationkey AS name, 0 AS tier FROM supplier
UNION ALL SELECT c_custkey, c_mktsegment || '_SEG_' || c_nationkey, 1 FROM customer
UNION ALL SELECT p_partkey, regexp_replace(p_name, '^(.)(.*) (.)(.*)$', '\\1\\2Node\\3\\4') || p_size, 3 FROM part),
m AS (SELECT *, CASE WHEN starts_with(lower(name), 'sn') THEN 0
  WHEN regexp_matches(lower(array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '_+', ' ', 'g'), ' '), lambda x: x <> ''), lambda x: left(x, 1)), '')), '^.*s.*n.*$') THEN 1
  WHEN contains(lower(name), 'sn') THEN 2 END AS score FROM c),
f AS (SELECT * FROM m WHERE score IS NOT NULL AND (tier > 1 OR NOT regexp_matches(name, '^[A-Z]'))),
r AS (SELECT name, tier, score, row_number() OVER (PARTITION BY name ORDER BY tier, score) AS k FROM f)
SELECT name, tier, score FROM r WHERE k = 1 ORDER BY tier, score, lower(name), name LIMIT 150"""


@query("completion_match_tiers", _MATCH.replace("\\\\", "\\"))
def completion_match_tiers(spark, sf_dir):
    one = read(spark, sf_dir, "supplier").select(F.concat(F.lit("supplierNode"), "s_nationkey").alias("name"), F.lit(0).alias("tier"))
    two = read(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit("_SEG_"), "c_nationkey").alias("name"), F.lit(1).alias("tier"))
    three = read(spark, sf_dir, "part").select(F.concat(F.regexp_replace("p_name", "^(.)(.*) (.)(.*)$", "$1$2Node$3$4"), "p_size").alias("name"), F.lit(3).alias("tier"))
    both = one.unionByName(two).unionByName(three).withColumn("fqn", F.lit(""))
    return complete.complete(both, "sn").select("name", "tier", "score")


@query("workspace_symbols", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'bolt') AND contains(lower(p_brand || ' ' || p_type), 'small') ORDER BY p_partkey LIMIT 100")
def workspace_symbols(spark, sf_dir):
    symbols = read(spark, sf_dir, "part").withColumns({"name": F.col("p_name"), "container": F.concat_ws(" ", "p_brand", "p_type")})
    return lookup.workspace_symbols(symbols, "bolt", "small", 100, "p_partkey").select("p_partkey", "p_name", "p_brand")


@query("generated_flags", r"""SELECT page_id, regexp_matches(lower(url), '(\.pb\.kt|\.html)$') AS by_path,
len(list_filter(string_split(left(html, 8192), chr(10))[1:60], lambda l: regexp_matches(l, '^\s*(//|/\*|\*)') AND contains(lower(l), 'this file was generated'))) > 0 AS by_header FROM pages""")
def generated_flags(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    by_path = paths.generated_path(F.col("url")) | F.lower("url").endswith(".html")
    return pages.select("page_id", by_path.alias("by_path"), paths.generated_header(F.col("html")).alias("by_header"))


@query("url_modules", r"""WITH p AS (SELECT page_id, 'root/' || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || '/src/' || (page_id % 3) || '/X.kt' AS path FROM pages)
SELECT page_id, regexp_extract(path, '^(?:.*/)?src/([^/]+)/', 1) AS source_set, regexp_extract(regexp_replace(path, '^root/', ''), '^(.+)/src/', 1) AS module FROM p""")
def url_modules(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    place = F.concat(F.lit("root/"), F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), F.lit("/src/"), F.col("page_id") % 3, F.lit("/X.kt"))
    return pages.select("page_id", paths.source_set(place).alias("source_set"), paths.module(place, "root").alias("module"))


@query("type_substitution", r"""WITH s AS (SELECT p_partkey, 'fun <T> map' || p_size || '(x: T, y: U): List<T>' AS sig, 'T' AS a, p_type AS ta, 'U' AS b, 'T' AS tb FROM part)
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(sig, '[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+'), lambda t: CASE WHEN t = 'T' THEN ta WHEN t = 'U' THEN tb ELSE t END), '') AS signature FROM s""")
def type_substitution(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    signature = F.concat(F.lit("fun <T> map"), "p_size", F.lit("(x: T, y: U): List<T>"))
    mapping = F.create_map(F.lit("T"), "p_type", F.lit("U"), F.lit("T"))
    return part.select("p_partkey", ids.substituted(signature, mapping).alias("signature"))


@query("declared_lines", """SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 3 THEN 'extension' WHEN 4 THEN 'enum' END AS kind FROM part WHERE p_size % 6 NOT IN (2, 5)""")
def declared_lines(spark, sf_dir):
    kinds = F.col("p_size") % 6
    text = F.when(kinds == 0, "public open class Ring(val x: Int)").when(kinds == 1, "  fun a.b.C.Ring() {").when(kinds == 2, "val y = Ring()").when(kinds == 3, "extension Ring: P {").when(kinds == 4, "private enum Ring {").otherwise("class Rings")
    lines = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))
    return lookup.declared_lines(lines, "Ring").select("id", "kind")


@query("used_types", r"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
w AS (SELECT doc_id, line_no, unnest(range(len(x))) AS pos, unnest(x) AS name FROM (SELECT doc_id, line_no, regexp_extract_all(line, '[\p{L}\p{N}_]+') AS x FROM l WHERE NOT regexp_matches(ltrim(line), '^(import |package |//|/\*|\*)'))),
m AS (SELECT doc_id, name, min((line_no, pos)) AS first, count(*) AS uses FROM w WHERE regexp_matches(name, '^\p{Lu}') AND name NOT IN ('The', 'Of') GROUP BY ALL)
SELECT doc_id, name, line, uses FROM (SELECT doc_id, name, first[1] + 1 AS line, uses, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS place FROM m) WHERE place <= 5""")
def used_types(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("uri"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lookup.used_types(lines, ["The", "Of"], 5).select(F.col("uri").alias("doc_id"), "name", F.col("line").cast("long").alias("line"), "uses")


@query("indexed_documents", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')")
def indexed_documents(spark, sf_dir):
    return lookup.text_documents(spark, text_index(spark, sf_dir), "license").select(F.col("id").alias("doc_id"), "source")


@query("indexed_lines", r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)
SELECT doc_id, line_no, length(line)::BIGINT AS n FROM lines WHERE regexp_matches(' ' || line || ' ', '[^a-zA-Z0-9_]License[^a-zA-Z0-9_]')""")
def indexed_lines(spark, sf_dir):
    return lookup.text_lines(spark, text_index(spark, sf_dir), "License").select(F.col("id").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.length("text").cast("long").alias("n"))


@query("lazy_library", """WITH own AS (SELECT 'P' || p_partkey AS name, p_size AS line FROM part WHERE p_partkey % 3 = 0), asked AS (SELECT DISTINCT 'P' || l_partkey AS name FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 10)
SELECT name, line, 'workspace' AS origin FROM own WHERE name IN (SELECT name FROM asked)
UNION ALL SELECT 'P' || p_partkey, p_size + 100, 'library' FROM part WHERE 'P' || p_partkey IN (SELECT name FROM asked) AND p_partkey % 3 <> 0""")
def lazy_library(spark, sf_dir):
    named = read(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.col("p_partkey").alias("key"), F.col("p_size").alias("line"))
    folder = stored(spark, sf_dir, "part", "library", lambda path: write_by_name(named.select("name", (F.col("line") + 100).alias("line")), path))
    asked = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1 AND l_quantity < 10").select(F.concat(F.lit("P"), "l_partkey").alias("name"))
    return lookup_lazily(asked, named.filter("key % 3 = 0").select("name", "line"), folder).select("name", "line", "origin")


@query("refreshed_index", """WITH s AS (SELECT doc_id, 'd' || doc_id AS uri, split_part(text, ' ', 1) AS name FROM documents WHERE text IS NOT NULL)
SELECT uri, name, 1 AS version FROM s WHERE doc_id % 3 <> 0 UNION ALL SELECT uri, name || '2', 2 FROM s WHERE doc_id % 6 = 0""")
def refreshed_index(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("uri"), F.split_part("text", F.lit(" "), F.lit(1)).alias("name"), F.lit(1).alias("version"))
    index = Store(spark, f"{shared_folder(spark)}/symatlas-index-{uuid.uuid4().hex}")
    index.write({"files": docs.select("uri"), "symbols": docs.select("uri", "name", "version")})
    # every third document has changed, and every sixth is still there; the fresh rows come from the index itself
    kept = index.read("symbols").join(docs.filter("doc_id % 6 = 0").select("uri"), "uri", "left_semi")
    fresh = {"files": kept.select("uri"), "symbols": kept.select("uri", F.concat("name", F.lit("2")).alias("name"), (F.col("version") + 1).alias("version"))}
    index.replace(docs.filter("doc_id % 3 = 0"), fresh)
    return index.read("symbols").select("uri", "name", "version")
