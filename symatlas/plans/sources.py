"""Extraction queries: sources written from the supplier table, scanned back to relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from symatlas.sources import extract

from .tables import query, read


def _scan(spark, sf_dir):
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    text = F.concat(
        F.lit("package n"), n, F.lit("\nimport n"), (n + 1) % 25, F.lit(".Nation"), (n + 1) % 25, F.lit("\n// class Not { fun at() {} }\nclass Supplier"), s, F.lit("(val id: Int) : Nation"), n, F.lit("() {\n    fun run(x: Int): Int { return part"), s % 7,
        F.lit('("}", x) }\n    private val size: Int = 3\n}\n'),
    )
    return extract.scanned(read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), s, F.lit(".kt")).alias("uri"), text.alias("text")))


@query("extract_symbols", """SELECT 'S' || s_suppkey || '.kt' AS uri, 'Supplier' || s_suppkey AS name, 'class' AS kind, 'public' AS visibility, 3 AS line, 6 AS col, NULL AS returns FROM supplier
UNION ALL SELECT 'S' || s_suppkey || '.kt', 'id', 'property', 'public', 3, 19 + length(s_suppkey::VARCHAR)::INT, 'Int' FROM supplier
UNION ALL SELECT 'S' || s_suppkey || '.kt', 'run', 'method', 'public', 4, 8, 'Int' FROM supplier UNION ALL SELECT 'S' || s_suppkey || '.kt', 'size', 'property', 'private', 5, 16, 'Int' FROM supplier""")
def extract_symbols(spark, sf_dir):
    rows = extract.relation(_scan(spark, sf_dir), "symbols")
    return rows.select("uri", "name", "kind", "visibility", F.col("sel_line").alias("line"), F.col("sel_col").alias("col"), F.col("return_type").alias("returns"))


@query("extract_calls", "SELECT 'S' || s_suppkey || '.kt' AS uri, 'Supplier' || s_suppkey || '.run' AS caller_key, 'part' || s_suppkey % 7 AS callee_key, 4 AS line FROM supplier")
def extract_calls(spark, sf_dir):
    return extract.relation(_scan(spark, sf_dir), "calls").select("uri", "caller_key", "callee_key", "line")


@query("extract_supers", "SELECT 'S' || s_suppkey || '.kt' AS uri, 'Supplier' || s_suppkey AS sub_name, 'Nation' || s_nationkey AS super_name FROM supplier")
def extract_supers(spark, sf_dir):
    return extract.relation(_scan(spark, sf_dir), "supers").select("uri", "sub_name", "super_name")


@query("extract_imports", "SELECT 'S' || s_suppkey || '.kt' AS uri, 'n' || s_nationkey AS package, 'n' || (s_nationkey + 1) % 25 || '.Nation' || (s_nationkey + 1) % 25 AS full_path, 'Nation' || (s_nationkey + 1) % 25 AS local_name FROM supplier")
def extract_imports(spark, sf_dir):
    scan = _scan(spark, sf_dir)
    return extract.relation(scan, "imports").join(scan.select("uri", "package"), "uri").select("uri", "package", "full_path", "local_name")
