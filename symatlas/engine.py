"""A workspace: the relations of a source tree, and the questions that are asked of them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from symatlas.functions import identifiers as ids, paths
from symatlas.operators import diagnose, graph, index, infer, lookup, output, resolve, search, stats, trees
from symatlas.sources import archives, extract, files
from symatlas.sources.scanner import KEYWORDS

CALLERS_CAP, SUBTYPES_CAP = 20, 50


class Workspace:
    """Relations of the sources below a folder; every answer is a DataFrame."""

    def __init__(self, spark: SparkSession, root: str, texts: DataFrame | None = None):
        self.spark, self.root = spark, root
        self.texts = files.texts(spark, root) if texts is None else texts
        self.scan = extract.scanned(self.texts).cache()
        self.search_index: str | None = None

    def close(self) -> None:
        """Release the cached scan."""
        self.scan.unpersist()

    @cached_property
    def files(self) -> DataFrame:
        path = F.regexp_replace("uri", "^file:", "")
        return extract.files(self.scan, self.texts).withColumns({"module": paths.module(path, self.root), "source_set": paths.source_set(path)})

    def relation(self, name: str) -> DataFrame:
        return extract.relation(self.scan, name)

    @property
    def symbols(self) -> DataFrame:
        return self.relation("symbols")

    @cached_property
    def edges(self) -> DataFrame:
        return self.relation("calls").select(F.col("caller_key").alias("caller"), F.col("callee_key").alias("callee"), F.col("uri").alias("file"), "line")

    @cached_property
    def types(self) -> DataFrame:
        return self.relation("supers").select(F.col("sub_name").alias("sub"), F.col("super_name").alias("super"), "uri", "super_kind")

    def find(self, name: str, kinds: list[str] = (), module: str | None = None, source_sets: list[str] = (), limit: int | None = None) -> DataFrame:
        """Definitions of a name or Owner.name: by module substring, kinds and source sets; the limit comes last."""
        owner, _, bare = name.rpartition(".")
        found = lookup.find(self.symbols.join(self.files.select("uri", "module", "source_set"), "uri"), bare, None, owner, kinds, module, source_sets)
        rows = found.select(F.col("uri").alias("file"), F.col("sel_line").alias("line"), F.col("sel_col").alias("col"), "kind", "name", "owner", "module", "source_set").orderBy("file", "line", "col")
        return rows if limit is None else rows.limit(limit)

    def fuzzy(self, query: str, limit: int = 20) -> DataFrame:
        return search.fuzzy_top(self.symbols, "name", query, limit)

    def search(self, raw: str, limit: int = 20) -> DataFrame:
        """Ranked search over names, signatures and docs, with kind:, lang:, path: and name: filters applied before the statistics."""
        query = search.parse_query(raw)
        docs = self.search_documents.filter(search.passes(query))
        words = ids.words_of_query(query.text)
        if not words:
            return search.listing(docs.drop("tokens", "id"), limit)
        stems = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(ids.stem(F.col("w"))).collect()]
        parts = self.spark.createDataFrame([(w,) for w in words], "w string").select(F.explode(ids.segments(F.col("w")))).collect()
        tokens = stems + [p for p in dict.fromkeys(r[0] for r in parts) if p not in stems]
        scored = search.bm25(docs, tokens) if self.search_index is None else search.bm25_stored(self.spark, self.search_index, tokens, search.passes(query))
        return search.ranked(scored.join(docs, "id").drop("tokens", "id"), limit)

    @cached_property
    def search_documents(self) -> DataFrame:
        """A row for each symbol with its search tokens: segments of the name, signature, return type and parameter types, and the words of its documentation."""
        flags = self.files.select("uri", "generated")
        named = F.flatten(F.transform(F.array("name", "detail", F.coalesce("return_type", F.lit(""))), ids.segments))
        types = F.flatten(F.transform(F.coalesce("parameters", F.array().cast("array<struct<name:string,type:string>>")), lambda p: ids.segments(F.coalesce(p["type"], F.lit("")))))
        return self.symbols.join(flags, "uri").select(
            F.xxhash64("symbol_id", "ordinal").alias("id"), "name", "kind", F.col("uri").alias("file"), F.col("sel_line").alias("line"), F.col("detail").alias("signature"), F.col("documentation").alias("doc"), "generated",
            F.concat(named, ids.query_words(F.coalesce("documentation", F.lit(""))), types).alias("tokens"),
        )

    def build_search_index(self, path: str) -> None:
        """Store the search index; searches read it from then on."""
        search.write_index(self.search_documents, path)
        self.search_index = path

    def imported(self) -> DataFrame:
        """(file, path, local_name, is_star) of every import."""
        return self.relation("imports").select(F.col("uri").alias("file"), F.col("full_path").alias("path"), "local_name", "is_star")

    def words(self) -> DataFrame:
        """(file, word) of the identifiers outside lines of imports."""
        tokens, imports = self.relation("tokens"), self.relation("imports").select("uri", "line").distinct()
        return tokens.join(imports, ["uri", "line"], "left_anti").select(F.col("uri").alias("file"), F.col("text").alias("word"))

    def references(self, name: str, kind: str | None = None, include_imports: bool = True, limit: int | None = None) -> DataFrame:
        """Places of a name with the kind of each; the limit comes after the filter by kind."""
        tokens = self.relation("tokens").select(F.col("uri").alias("file"), "line", "col", "text", "ctx")
        lines = None if include_imports else self.relation("imports").select(F.col("uri").alias("file"), "line")
        places = resolve.references(tokens, name, lines)
        found = places.join(tokens, ["file", "line", "col"]).withColumn("kind", resolve.classified(F.col("ctx"))).select("file", "line", "col", "kind")
        if kind:
            found = found.filter(F.col("kind") == kind)
        rows = found.orderBy("file", "line", "col")
        return rows if limit is None else rows.limit(limit)

    def find_anywhere(self, name: str, library: DataFrame | None = None) -> DataFrame:
        """(file, line, kind, tier): definitions in the index, else in a library's symbols, else lines that declare the name."""
        place = lambda s: s.filter(F.col("name") == name).select(F.lit(0).alias("k"), F.col("uri").alias("file"), F.col("sel_line").alias("line"), "kind")
        tiers = [place(self.symbols)] + ([] if library is None else [place(library)])
        lines = lookup.declared_lines(extract.lines(self.texts), name)
        return resolve.first_tier([*tiers, lines.select(F.lit(0).alias("k"), F.col("uri").alias("file"), F.col("line_no").alias("line"), "kind")], "k").drop("k").orderBy("file", "line")

    def symbols_like(self, query: str, limit: int = 512) -> DataFrame:
        """(name, kind, file, line, container) of symbols whose name, and owner for Owner.name, hold the query in any case; where there is none, of the lines that declare the name."""
        owner, _, bare = query.rpartition(".")
        found = lookup.find(self.symbols, part=bare)
        if owner:
            found = found.filter(F.lower("owner").contains(owner.lower()))
        rows = found.select("name", "kind", F.col("uri").alias("file"), F.col("sel_line").alias("line"), F.col("detail").alias("container")).orderBy("name", "file", "line").limit(limit)
        if not bare or not rows.isEmpty():
            return rows
        lines = lookup.declared_lines(extract.lines(self.texts), bare)
        return lines.select(F.lit(bare).alias("name"), F.lit("file").alias("kind"), F.col("uri").alias("file"), F.col("line_no").alias("line"), F.lit("text").alias("container")).orderBy("file", "line").limit(limit)

    def scope_at(self, file: str, line: int, col: int) -> tuple[str, str | None, str | None] | None:
        """The identifier at a place, and its declaration's parent type and package, as far as they are known."""
        tokens = self.relation("tokens").filter((F.col("uri") == file) & (F.col("line") == line) & (F.col("col") <= col) & (F.col("col") + F.length("text") > col))
        token = tokens.select("text").first()
        if token is None:
            return None
        own = self.symbols.filter(F.col("name") == token["text"]).join(self.files.select("uri", "package"), "uri")
        # the declaration at the place, else the first there is
        found = own.orderBy((F.col("uri") != file) | (F.col("sel_line") != line), "uri", "ordinal").select("owner", "package").first()
        return (token["text"], found["owner"], found["package"]) if found else (token["text"], None, None)

    def references_at(self, file: str, line: int, col: int) -> DataFrame:
        """References of the identifier at a place, within the scope of its declaration."""
        name, parent, package = self.scope_at(file, line, col) or ("", None, None)
        tokens = self.relation("tokens").select(F.col("uri").alias("file"), "line", "col", "text")
        lines = extract.lines(self.texts).select(F.col("uri").alias("file"), F.col("line_no").alias("line"), "text")
        imports = self.relation("imports").select(F.col("uri").alias("file"), F.col("full_path").alias("path"), "is_star")
        declared = self.symbols.filter((F.col("name") == name) & F.col("owner").eqNullSafe(F.lit(parent))).select(F.col("uri").alias("file")).distinct()
        return resolve.scoped_references(tokens, lines, imports, self.files.select(F.col("uri").alias("file"), "package"), name, parent, package, declared)

    def call_hierarchy(self, query: str, incoming: bool = True) -> DataFrame:
        """Callers or callees of one callable; a name of several gives its candidates."""
        callables = self.symbols.filter(F.col("kind").isin("function", "method", "constructor"))
        return graph.call_hierarchy(callables.select(F.concat_ws(".", "owner", "name").alias("key"), "name", F.col("uri").alias("file")), self.edges, query, incoming)

    def inject(self, file: str, limit: int = 50) -> DataFrame:
        """The types that a file uses, with their signatures."""
        lines = extract.lines(self.texts.filter(F.col("uri") == file))
        return lookup.injected(lines, self.symbols, sorted(KEYWORDS), limit)

    def hover(self, name: str) -> DataFrame:
        return output.hover(self.symbols.filter(F.col("name") == name))

    def implementations(self, name: str) -> DataFrame:
        return graph.implementations(self.types, name, extract.lines(self.texts))

    def prewarm(self, file: str) -> int:
        """Hold the symbols of the types that a file uses in memory, for completion; their number."""
        names = lookup.used_types(extract.lines(self.texts.filter(F.col("uri") == file)), sorted(KEYWORDS), 1 << 20).select(F.col("name").alias("owner"))
        self.warm = self.symbols.join(names, "owner", "left_semi").cache()
        return self.warm.count()

    def callers(self, name: str) -> DataFrame:
        return self.edges.filter((F.col("callee") == name) | F.col("callee").endswith("." + name)).select("caller", "file").distinct()

    def callees(self, name: str) -> DataFrame:
        return self.edges.filter((F.col("caller") == name) | F.col("caller").endswith("." + name)).select("callee").distinct()

    def hierarchy(self, name: str, down: bool = True, depth: int = 4) -> DataFrame:
        return graph.hierarchy(self.types, name, depth, down)

    def reach(self, entry: str, target: str | None = None, depth: int = graph.MAX_DEPTH) -> DataFrame:
        """Call paths from an entry with the first definition of each node; an ambiguous entry gives its candidates instead."""
        keys = graph.resolve_entry(self.edges.select(F.col("caller").alias("key")), entry).collect()
        if len(keys) != 1:
            return self.spark.createDataFrame([(r["key"], "ambiguous") for r in keys], "key string, status string")
        found = graph.reach(self.spark, self.walkable, keys[0]["key"], target, depth)
        place = F.col("uri").alias("file"), F.col("sel_line").alias("line")
        sites = self.symbols.select(F.concat_ws(".", "owner", "name").alias("name"), *place).unionByName(self.symbols.filter("owner IS NOT NULL").select("name", *place))
        return graph.definition_sites(found, sites)

    @cached_property
    def walkable(self) -> DataFrame:
        """The calls that walks take: chains by return types, bare and abstract callees by what they stand for, languages apart."""
        returns = self.symbols.filter("owner IS NOT NULL AND return_type IS NOT NULL").select(F.concat_ws(".", "owner", "name").alias("key"), F.col("return_type").alias("type"), F.col("ordinal").alias("seq"))
        chained = graph.chained_callees(self.edges.select("caller", "callee", "file"), returns)
        return graph.walkable(chained.select("caller", F.col("resolved").alias("callee"), "file"), self.types.select("super", "sub").distinct())

    def tree(self, entry: str, depth: int = graph.MAX_DEPTH, limit: int = trees.MAX_NODES) -> DataFrame:
        """(entry, path, line): the call tree of a function, branches kept, as indented lines."""
        nodes = trees.expanded(trees.with_parents(self.relation("steps")), self.spark.createDataFrame([(entry,)], "entry string"), depth, limit)
        return trees.rendered(nodes).orderBy("path")

    def tree_changes(self, before: str, after: str = "", depth: int = graph.MAX_DEPTH, below: str = "") -> DataFrame:
        """(entry, place, line): marked lines of the call trees that differ between two versions of the root under version control; an empty ref is the working tree."""
        both, sides = archives.snapshots(self.spark, self.root, before, after, below), []
        for side in ("before", "after"):
            scan = extract.scanned(both.filter(F.col("side") == side).select(F.col("path").alias("uri"), "text"))
            functions = extract.relation(scan, "symbols").filter(F.col("kind").isin("function", "method", "constructor")).select(F.concat_ws(".", "owner", "name").alias("key"), (F.col("visibility") == "public").alias("exported"))
            sides.append((trees.with_parents(extract.relation(scan, "steps")), functions.withColumn("label", F.col("key"))))
        entries = trees.inferred_entries(*sides, depth)
        found = [trees.expanded(steps, entries.join(functions.select(F.col("key").alias("entry")), "entry", "left_semi"), depth) for steps, functions in sides]
        return trees.diff_lines(trees.changed_trees(trees.tree_diff(*found))).orderBy("entry", "place")

    def lambda_types(self) -> DataFrame:
        """(uri, id, name, type): what `it`, `this` and named parameters are in lambdas; variables are parameters and locals with a known type."""
        parameters = self.symbols.select("uri", F.explode("parameters").alias("p")).select("uri", F.col("p.name").alias("var"), F.col("p.type").alias("type"))
        return infer.lambda_scopes(self.relation("lambdas"), self.relation("types").select("uri", "var", "type").unionByName(parameters))

    def _stored(self, uris: DataFrame | None = None) -> dict[str, DataFrame]:
        found = {"files": self.files, **{n: self.relation(n) for n in ("symbols", "imports", "supers", "calls", "annotations", "types", "errors", "steps", "lambdas")}}
        return found if uris is None else {n: f.join(uris, "uri", "left_semi") for n, f in found.items()}

    def save(self, folder: str) -> bool:
        """Store the relations as a new version of the index in a folder."""
        return files.write_index(self._stored(), folder)

    def refresh(self, folder: str, changed: DataFrame) -> int:
        """Put this workspace's rows of the changed files (uri) in the index in a folder; files that are gone from the workspace go. The new version's number."""
        return files.refresh_index(self.spark, folder, changed.select("uri").distinct(), self._stored(changed.select("uri").distinct()))

    def impact(self, name: str) -> DataFrame:
        refs = self.references(name).withColumn("key", F.lit(name)).select("key", F.regexp_replace("kind", "-", "_").alias("kind"))
        callers = self.callers(name).agg(F.count("*").alias("callers"))
        # one row of counts on the right side
        return stats.breakdown(refs, "key").crossJoin(callers).withColumn("risk", stats.risk(F.col("total"), F.col("callers")))

    def check(self) -> DataFrame:
        return diagnose.syntax(self.relation("errors"), self.scan)

    def imports_of(self, name: str) -> DataFrame:
        return lookup.imports_of(self.relation("imports"), name)

    def annotated(self, annotation: str) -> DataFrame:
        return lookup.annotated(self.relation("annotations"), self.symbols, annotation)

    def documented(self, part: str) -> DataFrame:
        return lookup.documented(self.symbols, part)

    def lines_with(self, word: str) -> DataFrame:
        """(uri, line_no, text) of the lines that hold a whole identifier."""
        return lookup.word_lines(extract.lines(self.texts), word)

    def statistics(self) -> DataFrame:
        return stats.cache_statistics(self.symbols)

    def summary(self, name: str) -> DataFrame:
        return output.summarised(self.symbols, name)

    def snapshot(self) -> DataFrame:
        return output.snapshot(self.relation("calls"), self.relation("supers"), index.override_edges(self.symbols), self.relation("imports"))

    def batch(self, requests: DataFrame) -> DataFrame:
        """(req_id, type, answer) of requests (req_id, type, name): definition, references, callers, callees, subtypes, supertypes; the order of requests is kept."""
        symbols = self.symbols.select(F.col("name").alias("k"), F.format_string("%s:%d:%d", "uri", F.col("sel_line") + 1, F.col("sel_col") + 1).alias("at"))
        tokens = self.relation("tokens").select(F.col("text").alias("k"), F.format_string("%s:%d:%d", "uri", F.col("line") + 1, F.col("col") + 1).alias("at"))
        return lookup.batch(
            requests,
            {
                "definition": (symbols, "k", F.col("at"), None), "references": (tokens, "k", F.col("at"), None), "callers": (self.edges, "callee", F.col("caller"), CALLERS_CAP),
                "callees": (self.edges, "caller", F.col("callee"), None), "subtypes": (self.types, "super", F.col("sub"), SUBTYPES_CAP), "supertypes": (self.types, "sub", F.col("super"), None),
            },
        )

    def register_views(self) -> None:
        """The relations as temporary views for SQL."""
        for name in ("symbols", "imports", "supers", "calls", "annotations", "types", "errors", "steps", "tokens"):
            self.relation(name).createOrReplaceTempView(name)
        self.files.createOrReplaceTempView("files")
        self.edges.createOrReplaceTempView("call_edges")
