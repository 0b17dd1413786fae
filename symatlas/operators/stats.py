"""Impact, package dependencies, histograms and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("call", "read", "write", "import", "type_use")


def breakdown(refs: DataFrame, key: str) -> DataFrame:
    """References (key, kind) counted by kind for each key; kinds that aren't listed count as other."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    return refs.groupBy(key).agg(*counts, F.count_if(~F.col("kind").isin(*KINDS)).alias("other"), F.count("*").alias("total"))


def risk(total: Column, callers: Column) -> Column:
    """low up to 5 references, medium up to 50, else high; more than 10 callers raise it by one."""
    many = callers > 10
    return F.when(total > 50, "high").when(total > 5, F.when(many, "high").otherwise("medium")).otherwise(F.when(many, "medium").otherwise("low"))


def package_dependencies(imports: DataFrame) -> DataFrame:
    """(package, depends_on, imports): how many imports lead from a package to a prefix of others."""
    prefix = F.regexp_replace("path", r"\.[^.]*$", "")
    return imports.select("package", prefix.alias("depends_on")).filter("package != depends_on").groupBy("package", "depends_on").agg(F.count("*").alias("imports"))


def histogram(rows: DataFrame, column: str, limit: int = 10) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


def module_rollup(symbols: DataFrame) -> DataFrame:
    """(module, files, symbols) for each module, and a row with a null module for all together."""
    return symbols.rollup("module").agg(F.countDistinct("uri").alias("files"), F.count("*").alias("symbols"))


def folder_statistics(files: DataFrame) -> DataFrame:
    """(extension, files, bytes) of a file listing."""
    return files.groupBy(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("extension")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def cache_statistics(symbols: DataFrame) -> DataFrame:
    """One row: symbols, those with documentation, those with a signature, and files."""
    given = lambda c: F.count_if(F.col(c) != "")
    return symbols.agg(F.count("*").alias("total"), given("documentation").alias("with_doc"), given("detail").alias("with_signature"), F.countDistinct("uri").alias("files"))


def module_dependents(links: DataFrame) -> DataFrame:
    """(module, depends_on, dependents): distinct others on either side of the links (module, depends_on, dependent); a null doesn't count."""
    return links.groupBy("module").agg(F.countDistinct("depends_on").alias("depends_on"), F.countDistinct("dependent").alias("dependents"))
