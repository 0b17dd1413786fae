"""Result rows as text and JSON, snapshots of relations, the workspace overview."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from symatlas.functions import paths


def flat(rows: DataFrame) -> DataFrame:
    """path:line:col: kind name, with lines and columns from 1."""
    return rows.select(F.format_string("%s:%d:%d: %s %s", "file", F.col("line") + 1, F.col("col") + 1, "kind", "name").alias("text"))


def grouped(rows: DataFrame) -> DataFrame:
    """(file, text): a file's rows under its name, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "col", "kind", "name")))
    text = F.transform(ordered, lambda r: F.format_string("  %d:%d %s %s", r["line"] + 1, r["col"] + 1, r["kind"], r["name"]))
    return rows.groupBy("file").agg(F.concat_ws("\n", F.col("file"), F.array_join(text, "\n")).alias("text"))


def as_json(rows: DataFrame) -> DataFrame:
    """A compact object for each row; empty fields are left out."""
    empty = [F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c in rows.columns]
    return rows.select(F.to_json(F.struct(*empty), {"ignoreNullFields": "true"}).alias("json"))


def snapshot(calls: DataFrame, supers: DataFrame, overrides: DataFrame, imports: DataFrame) -> DataFrame:
    """(relation, a, b): the distinct pairs of four relations, sorted."""
    parts = [
        calls.select(F.lit("calls").alias("relation"), F.col("caller_key").alias("a"), F.col("callee_key").alias("b")),
        supers.select(F.lit("extends"), "sub_name", "super_name"),
        overrides.select(F.lit("overrides"), "method", "class"),
        imports.select(F.lit("imports"), "uri", "full_path"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct().orderBy("relation", "a", "b")


def overview(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(module, files, symbols, entry_points) for each module and for all together."""
    entry = paths.entry_point(F.col("name"), F.col("kind")) | ((F.col("name") == "main") & (F.col("kind") == "function"))
    both = symbols.join(files.select("uri", "module"), "uri")
    return both.rollup("module").agg(F.countDistinct("uri").alias("files"), F.count("*").alias("symbols"), F.count_if(entry).alias("entry_points"))


def inspected(symbols: DataFrame, imports: DataFrame, errors: DataFrame, uri: str) -> DataFrame:
    """One row for a file: its symbols, imports and number of errors."""
    own = lambda f: f.filter(F.col("uri") == uri)
    names = own(symbols).agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "name"))).alias("symbols"))
    used = own(imports).agg(F.array_sort(F.collect_list("full_path")).alias("imports"))
    # each side is one row
    return names.crossJoin(used).crossJoin(own(errors).agg(F.count("*").alias("errors"))).select(F.lit(uri).alias("uri"), "symbols", "imports", "errors")


def summarised(symbols: DataFrame, name: str) -> DataFrame:
    """The first definition of a name with its members and the types that its signature names."""
    first = symbols.filter(F.col("name") == name).orderBy("uri", "ordinal").limit(1)
    members = symbols.select(F.col("uri").alias("m_uri"), F.col("owner").alias("m_owner"), F.col("name").alias("member"))
    types = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all("detail", F.lit(r"\b([A-Z]\w*)\b"), F.lit(1)), lambda t: t != F.lit(name))))
    met = first.join(members, (F.col("uri") == F.col("m_uri")) & (F.col("m_owner") == F.col("name")), "left")
    return met.groupBy("uri", "name", "kind", "visibility", "detail", "documentation").agg(F.array_sort(F.collect_set("member")).alias("members")).withColumn("types", types)


def hover(symbols: DataFrame) -> DataFrame:
    """(uri, line, name, markdown): the signature as a code block, then the documentation and where it is deprecated."""
    language = paths.language(F.col("uri"))
    code = F.concat(F.lit("```"), language, F.lit("\n"), F.col("detail"), F.lit("\n```"))
    note = F.when(F.coalesce("deprecated", F.lit(False)), F.lit("*Deprecated*"))
    return symbols.select("uri", F.col("sel_line").alias("line"), "name", F.concat_ws("\n\n", code, note, F.nullif("documentation", F.lit(""))).alias("markdown"))


def rendered_documentation(text):
    """A documentation column with its tags as markdown: parameters and the like as a list, links as code."""
    linked = F.regexp_replace(F.regexp_replace(text, r"\{@(?:link|code|linkplain|literal)\s+([^}]*)\}", "`$1`"), r"\[([\w.]+)\](?!\()", "`$1`")
    named = F.regexp_replace(linked, r"(?m)^\s*@(?:param|property)\s+(\S+)[ \t]*", "- `$1`: ")
    thrown = F.regexp_replace(named, r"(?m)^\s*@(?:throws|exception)\s+(\S+)[ \t]*", "- throws `$1`: ")
    back = F.regexp_replace(thrown, r"(?m)^\s*@returns?[ \t]+", "- returns ")
    return F.regexp_replace(back, r"(?m)^\s*@(\w+)[ \t]*", "- $1 ")
