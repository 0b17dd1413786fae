"""Lookups by name: definitions, declarations in text, documentation, lines of words, annotations, imports, batches of requests."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from symatlas.functions import paths
from symatlas.operators import grams

#: Words before a declared name, modifiers that may precede them, and the words that name a type's declaration.
DECLARING = "class struct interface object protocol fun func val var let typealias".split()
DECLARING_MODIFIERS = "public private protected fileprivate open internal static abstract final".split()
TYPE_WORDS = "class struct interface enum extension".split()
_KINDS = {"fun": "function", "func": "function", "val": "property", "var": "property", "let": "property", "protocol": "interface"}


def declaration_pattern(name: str) -> str:
    """A regular expression for a line that declares a name: after a declaring word, as an extension function, or a type after modifiers."""
    words = "|".join(DECLARING) + r"|enum\s+class"
    modified = rf"(?:{'|'.join(DECLARING_MODIFIERS)}|\s)+(?:enum|class|struct|protocol)\s+"
    return rf"(?:(?:{words})\s+|fun\s+\w[\w.]*\.|{modified}|extension\s+){re.escape(name)}\b"


def declared_lines(lines: DataFrame, name: str) -> DataFrame:
    """Lines (text) that declare a name, with the kind that the first word other than a modifier says."""
    word = F.regexp_extract("text", rf"\b({'|'.join(DECLARING)}|enum|extension)\b", 1)
    kind = word
    for key, value in _KINDS.items():
        kind = F.when(word == key, value).otherwise(kind)
    return lines.filter(F.col("text").rlike(declaration_pattern(name))).withColumn("kind", kind)


def implementor_lines(lines: DataFrame, name: str) -> DataFrame:
    """Lines that name a type and declare another one: what subtypes look like where there is no index."""
    named = word_lines(lines, name)
    return named.filter(F.col("text").rlike(rf"\b(?:{'|'.join(TYPE_WORDS)})\b") & ~F.col("text").rlike(rf"\b(?:{'|'.join(TYPE_WORDS)})\s+{re.escape(name)}\b"))


def used_types(lines: DataFrame, keywords: list[str], limit: int) -> DataFrame:
    """(uri, name, line, uses): the capitalised words of each file outside imports, package and comment lines, the first `limit` in order of appearance."""
    plain = lines.filter(~F.ltrim("text").rlike(r"^(import |package |//|/\*|\*)"))
    words = plain.select("uri", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\p{Lu}[\p{L}\p{N}_]*|[\p{L}\p{N}_]+)"), F.lit(1))).alias("at", "name")).filter(F.col("name").rlike(r"^\p{Lu}") & ~F.col("name").isin(keywords))
    met = words.groupBy("uri", "name").agg(F.min(F.struct("line_no", "at")).alias("first"), F.count("*").alias("uses"))
    place = F.row_number().over(Window.partitionBy("uri").orderBy("first"))
    return met.withColumn("place", place).filter(F.col("place") <= limit).select("uri", "name", (F.col("first.line_no") + 1).alias("line"), "uses")


def injected(lines: DataFrame, symbols: DataFrame, keywords: list[str], limit: int) -> DataFrame:
    """(uri, name, line, signature, uses) of the types that each file uses, most used first; a type without a definition has an empty signature."""
    first = symbols.groupBy("name").agg(F.min_by("detail", F.struct("uri", "ordinal")).alias("signature"))
    met = used_types(lines, keywords, limit).join(first, "name", "left")
    return met.select("uri", "name", "line", F.coalesce("signature", F.lit("")).alias("signature"), "uses").orderBy("uri", F.desc("uses"), F.length("name"), "name")


def mode(requested: str, indexed: bool) -> str:
    """fast (text) or smart (index); auto is smart where there is an index."""
    return requested if requested in ("fast", "smart") else "smart" if indexed else "fast"


def find(symbols: DataFrame, name: str | None = None, part: str | None = None, owner: str | None = None, kinds: list[str] = (), module: str | None = None, source_sets: list[str] = ()) -> DataFrame:
    """Symbols that pass every test that is given: the name, a part of it in any case, the owner's last segment, kinds, a part of the module, source sets."""
    tests = []
    if name is not None:
        tests.append(F.col("name") == name)
    if part is not None:
        tests.append(F.lower("name").contains(part.lower()))
    if owner:
        tests.append(F.coalesce(F.col("owner"), F.lit("")).contains(owner.rpartition(".")[2]))
    if kinds:
        tests.append(F.col("kind").isin([paths.KIND_ALIASES.get(k.lower(), k.lower()) for k in kinds]))
    if module:
        tests.append(F.col("module").contains(module))
    if source_sets:
        tests.append(F.col("source_set").isin(list(source_sets)))
    return reduce(DataFrame.filter, tests, symbols)


def documented(symbols: DataFrame, part: str) -> DataFrame:
    """Symbols whose documentation holds a text in any case."""
    return symbols.filter(F.lower("documentation").contains(part.lower()))


def workspace_symbols(symbols: DataFrame, part: str, container: str, limit: int, *order: str) -> DataFrame:
    """Symbols whose name, and whose container, hold the parts in any case; the limit comes last."""
    return find(symbols, part=part).filter(F.lower("container").contains(container.lower())).orderBy(*order).limit(limit)


def word_lines(lines: DataFrame, word: str) -> DataFrame:
    """Lines (text) that hold a whole identifier."""
    return lines.filter(F.col("text").rlike(rf"(?:^|[^a-zA-Z0-9_]){re.escape(word)}(?:$|[^a-zA-Z0-9_])"))


def text_lines(spark, path: str, word: str) -> DataFrame:
    """(id, line_no, text): word_lines over the texts of a stored trigram index; only rows that hold the word's trigrams are split and searched."""
    found = grams.rows_with(spark, path, word).filter(F.col("text").contains(word))
    return word_lines(found.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")), word)


def text_declarations(spark, path: str, name: str) -> DataFrame:
    """(id, line_no, text, kind): declared_lines over the texts of a stored trigram index."""
    found = grams.rows_with(spark, path, name).filter(F.col("text").contains(name))
    return declared_lines(found.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")), name)


def text_documents(spark, path: str, part: str) -> DataFrame:
    """The rows of a stored trigram index whose text holds a part in any case."""
    return grams.rows_with(spark, path, part).filter(F.lower("text").contains(part.lower()))


def imports_of(imports: DataFrame, part: str) -> DataFrame:
    """(uri) of the files that import a path with a part."""
    return imports.filter(F.col("full_path").contains(part)).select("uri").distinct()


def importers(imports: DataFrame) -> DataFrame:
    """(full_path, files, imports): how many files import each path, and how often."""
    return imports.groupBy("full_path").agg(F.countDistinct("uri").alias("files"), F.count("*").alias("imports"))


def annotated(annotations: DataFrame, symbols: DataFrame, annotation: str) -> DataFrame:
    """(uri, name, line) of the symbols with an annotation, at the first symbol of that name in the file, or line 0."""
    first = symbols.groupBy("uri", "name").agg(F.min("sel_line").alias("line"))
    edges = annotations.filter(F.col("annotation") == annotation).select("uri", F.col("symbol_name").alias("name")).distinct()
    return edges.join(first, ["uri", "name"], "left").select("uri", "name", F.coalesce("line", F.lit(0)).alias("line"))


def known_names(*relations: DataFrame) -> DataFrame:
    """(name): the names that all relations have."""
    return reduce(DataFrame.intersect, (r.select("name") for r in relations))


def with_library(own: DataFrame, library: DataFrame) -> DataFrame:
    """Definitions of the workspace and of its libraries, with their origin; equal rows stay."""
    return own.withColumn("origin", F.lit("workspace")).unionByName(library.withColumn("origin", F.lit("library")))


def batch(requests: DataFrame, relations: dict[str, tuple[DataFrame, str, Column, int | None]]) -> DataFrame:
    """(req_id, type, answer) of requests (req_id, type, name), in their order.

    For each type there is a relation, the column that is looked up, the answer and the most answers to a
    request, the first in order. A request without an answer gets a row that says so. Requests of one req_id are
    told apart by type and name; equal ones get equal answers, which are looked up and ranked once for each name.
    """
    met = []
    for kind, (relation, key, answer, cap) in relations.items():
        asked = requests.filter(F.col("type") == kind).select("name").distinct()
        rows = asked.join(relation, asked["name"] == F.col(key)).select(F.lit(kind).alias("type"), asked["name"].alias("name"), answer.alias("answer")).distinct()
        if cap is not None:
            rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("answer"))).filter(F.col("place") <= cap).drop("place")
        met.append(rows)
    missing = F.when(F.col("type").isin(*relations), "not found").otherwise(F.concat(F.lit("unknown request "), F.coalesce("type", F.lit("null"))))
    answered = requests.join(reduce(DataFrame.unionByName, met), ["type", "name"], "left")
    return answered.select("req_id", "type", F.coalesce("answer", missing).alias("answer")).orderBy("req_id", "answer")
