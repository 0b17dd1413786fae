"""Diagnostics over extracted relations: calls, initialisers, branches, tests, expected and actual declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from symatlas.functions import paths


def syntax(errors: DataFrame, files: DataFrame) -> DataFrame:
    """(uri, errors, ok) for every file, those without errors too."""
    counted = errors.groupBy("uri").agg(F.count("*").alias("errors"))
    found = files.select("uri").join(counted, "uri", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    return found.withColumn("ok", F.col("errors") == 0)


def requested(inputs: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, missing) of requested paths: a path that is listed, or a folder above a listed one, is there."""
    exact = inputs.join(listing.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    parts = listing.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("path")).distinct()
    folders = parts.withColumn("folder", F.lit(True))
    return exact.join(folders, "path", "left").select("path", (F.col("there").isNull() & F.col("folder").isNull()).alias("missing"))


def self_initialised(lines: DataFrame) -> DataFrame:
    """Lines (uri, line_no, text) such as `val x = x`."""
    return lines.filter(F.col("text").rlike(r"\b(?:val|var|let)\s+(\w+)\s*(?::[^=]*)?=\s*\1\s*(?:;|//.*)?$"))


def _braced(depth: int) -> str:
    """A regular expression for text with balanced braces, so many levels deep."""
    return r"[^{}]*+" if not depth else r"[^{}]*+(?:\{" + _braced(depth - 1) + r"\}[^{}]*+)*+"


#: Levels of braces that are followed inside a block.
NESTED = 8
_WHEN = r"(?s)\bwhen\s*\(([^()]*+(?:\([^()]*+\)[^()]*+)*+)\)\s*\{(" + _braced(NESTED) + r")\}"


def when_without_else(texts: DataFrame) -> DataFrame:
    """(uri, subject) of `when (subject)` blocks with one branch at most and no else; braces are followed NESTED levels deep."""
    blocks, bodies = (F.regexp_extract_all("text", F.lit(_WHEN), F.lit(k)) for k in (1, 2))
    rows = texts.select("uri", F.explode(F.arrays_zip(blocks.alias("subject"), bodies.alias("body"))).alias("w"))
    single = F.size(F.split("w.body", " -> ")) <= 2
    return rows.filter(~F.col("w.body").rlike(r"\belse\s*->") & single).select("uri", F.col("w.subject").alias("subject"))


def argument_counts(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (uri, line, callee_key, arguments) with another number of arguments than the callee's first definition takes."""
    first = symbols.groupBy("name").agg(F.min_by(F.size("parameters"), F.struct("uri", "ordinal")).alias("expected"))
    met = calls.withColumn("name", F.substring_index("callee_key", ".", -1)).join(first, "name")
    return met.filter((F.col("expected") > 0) & (F.col("expected") != F.col("arguments")))


def deprecations(symbols: DataFrame) -> DataFrame:
    return symbols.filter("deprecated").select("uri", F.col("sel_line").alias("line"), "name")


def nullable_receivers(accesses: DataFrame, types: DataFrame) -> DataFrame:
    """Plain accesses (uri, line, var, member) on variables whose inferred type (uri, var, type) may be null."""
    return accesses.join(types.filter(F.col("type").endswith("?")).select("uri", "var", "type"), ["uri", "var"])


def tests_for(files: DataFrame, symbol: str) -> DataFrame:
    """(path, convention) of test files of a symbol; of several conventions the first holds."""
    stem, source = paths.stem(F.col("path")), paths.source_set(F.col("path"))
    convention = (
        F.when(stem.isin(f"{symbol}Test", f"{symbol}Tests"), "name").when(stem == f"Test{symbol}", "prefix").when(stem.contains(symbol) & stem.contains("Test"), "contains")
        .when(source.isin("test", "androidTest", "commonTest") & F.col("text").contains(symbol), "source set")
    )
    return files.select("path", convention.alias("convention")).filter("convention is not null")


def expected_and_actual(symbols: DataFrame) -> DataFrame:
    """(name, expect_uri, actuals): expect declarations, the last one seen, with their actual ones by source set."""
    word = lambda w: F.col("detail").rlike(rf"\b{w}\b")
    expect = symbols.filter(word("expect")).groupBy("name").agg(F.max_by("uri", F.struct("uri", "ordinal")).alias("expect_uri"))
    actual = symbols.filter(word("actual")).groupBy("name").agg(F.array_sort(F.collect_set(F.struct(paths.source_set(F.col("uri")).alias("source_set"), "uri"))).alias("actuals"))
    return expect.join(actual, "name", "left")


def annotated_callables(annotations: DataFrame, calls: DataFrame, annotation: str) -> DataFrame:
    """(caller_key, callees): functions with an annotation and the functions with it that they call."""
    own = annotations.filter(F.col("annotation") == annotation).select(F.col("symbol_name").alias("name")).distinct()
    edges = calls.withColumns({"caller": F.substring_index("caller_key", ".", -1), "callee": F.substring_index("callee_key", ".", -1)})
    met = edges.join(own.select(F.col("name").alias("caller")), "caller", "left_semi").join(own.select(F.col("name").alias("callee")), "callee", "left_semi")
    return met.groupBy("caller_key").agg(F.array_sort(F.collect_set("callee")).alias("callees"))


def context(lines: DataFrame, places: DataFrame, around: int) -> DataFrame:
    """(uri, line, text) of the lines around each place, in one string."""
    met = lines.join(places, "uri").filter(F.abs(F.col("line_no") - F.col("line")) <= around)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return met.groupBy("uri", "line").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("text"))


def insertion_line(lines: DataFrame) -> DataFrame:
    """(uri, line): where a new import goes, after the last import, else after the package, else at the top."""
    text = F.ltrim("text")
    last = F.max(F.when(text.startswith("import "), F.col("line_no") + 1))
    package = F.max(F.when(text.startswith("package "), F.col("line_no") + 1))
    return lines.groupBy("uri").agg(F.coalesce(last, package, F.lit(0)).alias("line"))


def islands(lines: DataFrame, inside: Column) -> DataFrame:
    """(uri, start_line, end_line) of runs of two lines or more for which `inside` holds."""
    marked = lines.filter(inside).withColumn("island", F.col("line_no") - F.row_number().over(Window.partitionBy("uri").orderBy("line_no")))
    return marked.groupBy("uri", "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).filter("start_line < end_line").drop("island")
