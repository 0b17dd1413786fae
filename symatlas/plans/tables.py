"""The driver tables as the engine's relations, and the decorator that registers queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from symatlas.operators import grams, search
from symatlas.session import shared_folder, spread

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a plan (spark, sf_dir) -> DataFrame, and the DuckDB SQL that gives the same rows."""

    def put(plan):
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokens(text):
    """ASCII words of a text, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def search_docs(spark, sf_dir) -> DataFrame:
    """documents as search rows: the first word is the name, lang the kind, source the file."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.split_part("text", F.lit(" "), F.lit(1)).alias("name"), F.col("lang").alias("kind"), F.col("source").alias("file"), F.col("doc_id").alias("line"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("signature"), F.md5("text").alias("doc"), F.lower("text").contains("licen").alias("generated"), tokens(F.col("text")).alias("tokens"),
    )


SEARCH_DOCS = """docs AS (SELECT doc_id AS id, split_part(text, ' ', 1) AS name, lang AS kind, source AS file, doc_id AS line, split_part(text, chr(10), 1) AS signature,
  md5(text) AS doc, contains(lower(text), 'licen') AS generated, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM documents)"""


def stored(spark, sf_dir: str, table: str, name: str, build) -> str:
    """The folder of something that build(folder) stores for a table; built once for the table's files, by whichever application comes first.

    The folder's name is that of the files' paths, times and sizes, so a later application with the same shared folder
    finds it; a folder counts once the row behind it is written. Two applications that build at the same time each
    write their own, and the first by name counts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf_dir}/{table}.parquet").select("path", "modificationTime", "length")
    one, other = files.agg(F.bit_xor(F.xxhash64(*files.columns)), F.sum(F.xxhash64(F.lit(1), *files.columns).cast("decimal(38,0)"))).first()
    folder = f"{shared_folder(spark)}/symatlas-{name}/{one & (1 << 64) - 1:016x}{int(other or 0) & (1 << 64) - 1:016x}"

    def ready():
        try:
            row = spark.read.schema("folder string").option("recursiveFileLookup", True).parquet(f"{folder}/ready").orderBy("folder").first()
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return None
            raise
        return row[0] if row else None

    found = ready()
    if found is None:
        own = f"{folder}/{uuid.uuid4().hex}"
        build(own)
        spark.createDataFrame([(own,)], "folder string").coalesce(1).write.parquet(f"{folder}/ready/{uuid.uuid4().hex}")
        found = ready()
    return found


def search_index(spark, sf_dir) -> str:
    """The folder with the search index over documents."""
    return stored(spark, sf_dir, "documents", "search", lambda folder: search.write_index(search_docs(spark, sf_dir).select("id", "name", "kind", "file", "tokens"), folder))


def text_index(spark, sf_dir) -> str:
    """The folder with the trigram index over documents."""
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return stored(spark, sf_dir, "documents", "gram-lists", lambda folder: grams.write_grams(texts, folder))


def call_edges(spark, sf_dir) -> DataFrame:
    """Suppliers call the parts they deliver; the ship mode's place is the order's line."""
    return read(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("caller"), F.concat(F.lit("P"), "l_partkey").alias("callee"), F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("line"))


CALL_EDGES = "edges AS (SELECT 'S' || l_suppkey AS caller, 'P' || l_partkey AS callee, l_returnflag AS file, l_linenumber AS line FROM lineitem)"


def transitions(spark, sf_dir) -> DataFrame:
    """(caller, callee): event types that followed each other for a user, in alphabetical order, and one edge back."""
    from pyspark.sql import Window

    events = read(spark, sf_dir, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = events.select(F.col("event_type").alias("caller"), nxt.alias("callee")).filter("caller < callee").distinct()
    return pairs.unionByName(spark.createDataFrame([("view", "click")], "caller string, callee string"))


TRANSITIONS = """steps AS (SELECT event_type AS caller, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee FROM events),
edges AS (SELECT DISTINCT caller, callee FROM steps WHERE caller < callee UNION ALL SELECT 'view', 'click')"""


def type_edges(spark, sf_dir) -> DataFrame:
    """(sub, super): nations below regions, suppliers below nations."""
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("sub"), F.col("r_name").alias("super"))
    low = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("sub"), F.col("n_name").alias("super"))
    return up.unionByName(low)


TYPE_EDGES = """edges AS (SELECT n_name AS sub, r_name AS super FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def page_imports(spark, sf_dir) -> DataFrame:
    """(file, seq, path, local_name): the links of a page, in order, as its imports."""
    pages = read(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return pages.select(F.col("page_id").alias("file"), F.posexplode(links).alias("seq", "path")).withColumn("local_name", F.regexp_extract("path", "([^/]*)$", 1))


PAGE_IMPORTS = """links AS (SELECT page_id AS file, html, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages),
imports AS (SELECT file, unnest(range(len(l))) AS seq, unnest(l) AS path, regexp_extract(unnest(l), '([^/]*)$', 1) AS local_name FROM links)"""
