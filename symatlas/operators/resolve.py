"""Lookups: priority tiers, containment, references, imports."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from symatlas.functions import identifiers as ids
from symatlas.operators import trees
from symatlas.session import shared_folder

#: Segments of qualifiers that are followed in one plan.
SEGMENTS = 3


def first_tier(tiers: list[DataFrame], key: str) -> DataFrame:
    """Of the candidates for each key, those of the first tier that has any; tiers come in order of priority."""
    marked = [t.withColumn("tier", F.lit(i + 1)) for i, t in enumerate(tiers)]
    both = reduce(DataFrame.unionByName, marked)
    best = both.groupBy(key).agg(F.min("tier").alias("tier"))
    return both.join(best, [key, "tier"])


def contained(probes: DataFrame, scopes: DataFrame, key: str, by: str, inside: str, choose: Column) -> DataFrame:
    """For each probe (key, by) the chosen one of the scopes of the same key for which `inside` holds.

    An equi-join with a range residual, then an aggregation: never a range join over all pairs. `choose`
    is an aggregate such as min_by over a struct that ends ties.
    """
    return probes.join(scopes, key).filter(inside).groupBy(key, by).agg(choose.alias("scope"))


def sorted_locations(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.dropDuplicates(list(columns)).orderBy(*columns)


def visible(imports: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (file, fqn, package) that no import (file, path, is_star) of the file makes visible.

    The two ways of being visible are two anti-joins rather than one with an OR, so both hash.
    """
    exact = imports.filter("not is_star").select("file", F.col("path").alias("fqn")).distinct()
    star = imports.filter("is_star").select("file", F.col("path").alias("package")).distinct()
    return candidates.join(exact, ["file", "fqn"], "left_anti").join(star, ["file", "package"], "left_anti")


def missing_imports(names: DataFrame, fqns: DataFrame) -> DataFrame:
    """(file, name, n, fqn, status): unique, ambiguous or unknown by the number of qualified names of each used name."""
    per_name = fqns.groupBy("name").agg(F.countDistinct("fqn").alias("n"), F.min("fqn").alias("fqn"))
    found = names.select("file", "name").distinct().join(per_name, "name", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("unknown")
    return found.select("file", "name", n.alias("n"), F.when(n == 1, F.col("fqn")).alias("fqn"), status.alias("status"))


def unused_imports(imports: DataFrame, words: DataFrame) -> DataFrame:
    """Imports (file, path, local_name, is_star) whose local name is no word (file, word) of the file."""
    used = words.select("file", F.col("word").alias("local_name")).distinct()
    return imports.filter("not is_star").join(used, ["file", "local_name"], "left_anti")


def duplicate_imports(imports: DataFrame) -> DataFrame:
    return imports.groupBy("file", "path").agg(F.count("*").alias("times")).filter("times > 1")


def organized(imports: DataFrame, words: DataFrame) -> DataFrame:
    """(file, statements): star imports and used ones, once each, sorted."""
    used = words.select("file", F.col("word").alias("local_name")).distinct()
    kept = imports.filter("is_star").unionByName(imports.filter("not is_star").join(used, ["file", "local_name"], "left_semi").select(imports.columns))
    statement = F.concat(F.lit("import "), F.col("path"), F.when(F.col("is_star"), ".*").otherwise(""))
    return kept.groupBy("file").agg(F.array_sort(F.collect_set(statement)).alias("statements"))


def references(tokens: DataFrame, name: str, imports: DataFrame | None = None) -> DataFrame:
    """Sorted distinct places (file, line, col) of a whole identifier; those on lines of `imports` are left out."""
    found = tokens.filter(F.col("text") == name).select("file", "line", "col")
    if imports is not None:
        found = found.join(imports.select("file", "line").distinct(), ["file", "line"], "left_anti")
    return sorted_locations(found, "file", "line", "col")


def classified(context: Column) -> Column:
    """The kind of a reference by its token's context flags, in order of precedence; read where nothing else holds."""
    order = ("import", "declaration", "override", "call", "write", "type-use")
    out = F.lit("read")
    for kind in reversed(order):
        out = F.when(F.array_contains(context, kind), kind).otherwise(out)
    return out


def same_package(files: DataFrame, definitions: DataFrame, requests: DataFrame) -> DataFrame:
    """For requests (req, file, name): the first definition in another file of the same package.

    Of each (package, name) only the definitions in the first two files are kept, the second for requests
    from the first, so that a request meets two rows however many files define a name.
    """
    placed = definitions.join(files.select("file", "package"), "file").groupBy("package", "name", "file").agg(F.min("line").alias("line"))
    at = F.min(F.struct("file", "line"))
    first = placed.groupBy("package", "name").agg(at.alias("first"))
    second = placed.join(first, ["package", "name"]).filter(F.col("file") != F.col("first.file")).groupBy("package", "name").agg(at.alias("second"))
    met = requests.join(files.select("file", "package"), "file").join(first, ["package", "name"]).join(second, ["package", "name"], "left")
    found = F.when(F.col("first.file") != F.col("file"), F.col("first")).otherwise(F.col("second"))
    rows = met.groupBy("req").agg(F.min(found).alias("found")).filter("found IS NOT NULL")
    return rows.select("req", F.col("found.file").alias("def_file"), F.col("found.line").alias("line"))


def star_imports(imports: DataFrame, definitions: DataFrame, requests: DataFrame) -> DataFrame:
    """For requests (req, file, name): the definition in the first star-imported package (by seq) that has the name."""
    first = definitions.groupBy("package", "name").agg(F.min(F.struct(F.col("file").alias("def_file"), "line")).alias("at"))
    met = requests.join(imports.filter("is_star").select("file", "seq", F.col("path").alias("package")), "file").join(first, ["package", "name"])
    return met.groupBy("req").agg(F.min(F.struct("seq", "at.def_file", "at.line")).alias("found")).select("req", "found.def_file", "found.line")


def local(symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """For requests (req, file, name): the definitions of the name in the same file."""
    own = symbols.select(F.col("uri").alias("file"), "name", F.col("sel_line").alias("line"))
    return requests.join(own, ["file", "name"]).select("req", F.col("file").alias("def_file"), "line")


def via_imports(imports: DataFrame, qualified: DataFrame, definitions: DataFrame, requests: DataFrame) -> DataFrame:
    """For requests (req, file, name): what the first fitting import (file, seq, path, local_name, is_star) leads to.

    An import leads to its path in the qualified names (fqn, def_file, line), else to definitions (name, package, def_file,
    line) of its last segment in the package that the path's segments in small letters name, or in one below it.
    """
    met = requests.join(imports.filter("not is_star").withColumnRenamed("local_name", "name").select("file", "name", "seq", "path"), ["file", "name"])
    exact = met.join(qualified.withColumnRenamed("fqn", "path"), "path").select("req", "seq", F.lit(0).alias("tier"), "def_file", "line")
    prefix = F.regexp_extract("path", r"^((?:[\p{Ll}][^.]*\.)*)", 1)
    short = met.select("req", "seq", F.substring_index("path", ".", -1).alias("name"), prefix.alias("prefix"))
    inside = F.startswith(F.concat("package", F.lit(".")), "prefix") & (F.col("prefix") != "")
    nested = short.join(definitions, "name").filter(inside).select("req", "seq", F.lit(1).alias("tier"), "def_file", "line")
    both = exact.unionByName(nested)
    best = both.groupBy("req").agg(F.min(F.struct("seq", "tier")).alias("best"))
    return both.join(best, "req").filter(F.struct("seq", "tier") == F.col("best")).select("req", "def_file", "line").distinct()


#: Words that say that a line declares something.
DECLARATION_WORDS = ("class ", "interface ", "object ", "fun ", "val ", "var ", "typealias ", "enum class ", "enum ", "struct ", "protocol ", "func ", "let ", "extension ")


def scoped_references(tokens: DataFrame, lines: DataFrame, imports: DataFrame, files: DataFrame, name: str, parent: str | None = None, package: str | None = None, declared_in: DataFrame | None = None, origin: str | None = None) -> DataFrame:
    """(file, line, col) of a name as the declaration's scope allows: tokens (file, line, col, text), lines (file, line, text), imports (file, path, is_star), files (file, package).

    With a parent type: where it stands as Parent.name, and anywhere in files that import Parent.name or all of
    Parent, or that declare it (declared_in). Else with a package: in files of the package, and in those that import the name, or all, of it. Else everywhere.
    Lines of imports and packages don't count, nor do lines of the file `origin` that declare something.
    """
    hits = tokens.filter(F.col("text") == name).select("file", "line", "col").join(lines.withColumnRenamed("text", "content"), ["file", "line"])
    hits = hits.filter(~F.ltrim("content").rlike("^(import|package) "))
    if parent is not None:
        leads = F.when(F.col("is_star"), F.col("path").rlike(rf"(^|\.){re.escape(parent)}$")).otherwise(F.col("path").rlike(rf"(^|\.){re.escape(parent)}\.{re.escape(name)}$"))
        candidates = imports.filter(leads).select("file")
        candidates = candidates if declared_in is None else candidates.unionByName(declared_in.select("file"))
        hits = hits.filter(F.col("content").rlike(rf"\b{re.escape(parent)}\.{re.escape(name)}\b")).unionByName(hits.join(candidates.distinct(), "file", "left_semi"))
    elif package is not None:
        leads = F.when(F.col("is_star"), F.col("path") == package).otherwise(F.col("path") == f"{package}.{name}")
        candidates = imports.filter(leads).select("file").unionByName(files.filter(F.col("package") == package).select("file"))
        hits = hits.join(candidates.distinct(), "file", "left_semi")
    if origin is not None:
        hits = hits.filter(~((F.col("file") == origin) & reduce(lambda a, b: a | b, (F.col("content").contains(w) for w in DECLARATION_WORDS))))
    return sorted_locations(hits.select("file", "line", "col"), "file", "line", "col")


def qualified_access(requests: DataFrame, symbols: DataFrame, supers: DataFrame, types: DataFrame) -> DataFrame:
    """For requests (req, file, owner, qualifier, name): the members of that name of what the qualifier means.

    this is the owner, super its supertypes, a capitalised first segment a type, and any other a variable of the file
    (types: uri, var, type) or else a member of the owner. Further segments are followed through the types of members. A member that a type itself lacks is looked for in its direct supertypes.
    """
    members = symbols.select("owner", "name", F.col("uri").alias("def_file"), F.col("sel_line").alias("line"), ids.type_leaf(F.col("return_type")).alias("leads"))
    inherited = supers.select("sub", F.col("super").alias("owner")).join(members, "owner").select(F.col("sub").alias("owner"), "name", "def_file", "line", "leads")
    both = members.withColumn("level", F.lit(0)).unionByName(inherited.withColumn("level", F.lit(1)))
    parts = requests.withColumn("parts", F.split("qualifier", r"\."))
    head = F.col("parts")[0]
    known = types.groupBy(F.col("uri").alias("file"), F.col("var").alias("head")).agg(F.min("type").alias("var_type"))
    step = members.groupBy("owner", F.col("name").alias("segment")).agg(F.min("leads").alias("leads"))
    at = parts.withColumn("head", head).join(known, ["file", "head"], "left").join(step.withColumnRenamed("segment", "head").withColumnRenamed("leads", "own_type"), ["owner", "head"], "left")
    up = at.filter(head == "super").join(supers.select(F.col("sub").alias("owner"), "super"), "owner").withColumn("at", F.col("super")).drop("super")
    plain = F.when(head == "this", F.col("owner")).when(head.rlike(r"^\p{Lu}"), head).otherwise(ids.type_leaf(F.coalesce("var_type", "own_type")))
    at = at.filter(head != "super").withColumn("at", plain).unionByName(up).select("req", "name", "parts", "at")
    # some segments in a round, by tables in the shared folder; qualifiers that have ended leave
    folder = f"{shared_folder(requests.sparkSession)}/symatlas-qualifiers-{uuid.uuid4().hex}"
    step = trees.table_of(requests.sparkSession, step, f"{folder}/members")
    state = trees.table_of(requests.sparkSession, at.withColumn("k", F.lit(1)), f"{folder}/0")
    more, at, round_ = F.size("parts") > F.col("k"), state.filter(F.size("parts") <= F.col("k")), 0
    while not state.filter(more).isEmpty():
        round_ += 1
        live = state.filter(more)
        for _ in range(SEGMENTS):
            here = F.get("parts", F.col("k"))
            moved = live.withColumn("segment", here).join(step.withColumnRenamed("owner", "at"), ["at", "segment"], "left")
            live = moved.select("req", "name", "parts", F.when(here.isNull(), F.col("at")).when(F.col("leads").isNull() & here.rlike(r"^\p{Lu}"), here).otherwise(F.col("leads")).alias("at"), (F.col("k") + 1).alias("k"))
        state = trees.table_of(requests.sparkSession, live, f"{folder}/{round_}")
        at = at.unionByName(state.filter(~more))
    met = at.select("req", "name", F.col("at").alias("owner")).join(both, ["owner", "name"])
    best = met.groupBy("req").agg(F.min("level").alias("level"))
    return met.join(best, ["req", "level"]).select("req", "def_file", "line").distinct()
