"""Command line: python -m symatlas COMMAND ROOT [NAME] [--json] ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from symatlas.engine import Workspace
from symatlas.operators import diagnose, graph, infer, lookup, output, resolve, stats, trees
from symatlas.sources import archives, files

COMMANDS = {
    "find": lambda w, a: w.find(a.name, a.kind or (), a.module, a.source_set or (), a.limit),
    "fuzzy": lambda w, a: w.fuzzy(a.name, a.limit or 20),
    "search": lambda w, a: w.search(a.name, a.limit or 20),
    "refs": lambda w, a: w.references(a.name, a.ref_kind, not a.no_imports, a.limit),
    "callers": lambda w, a: w.callers(a.name),
    "callees": lambda w, a: w.callees(a.name),
    "subtypes": lambda w, a: w.hierarchy(a.name, True, a.depth),
    "supertypes": lambda w, a: w.hierarchy(a.name, False, a.depth),
    "reach": lambda w, a: w.reach(a.name, a.target, a.depth),
    "impact": lambda w, a: w.impact(a.name),
    "imports-of": lambda w, a: w.imports_of(a.name),
    "annotated": lambda w, a: w.annotated(a.name),
    "summarize": lambda w, a: w.summary(a.name),
    "check": lambda w, a: w.check(),
    "snapshot": lambda w, a: w.snapshot(),
    "anywhere": lambda w, a: w.find_anywhere(a.name),
    "documented": lambda w, a: w.documented(a.name),
    "lines": lambda w, a: w.lines_with(a.name),
    "refs-at": lambda w, a: w.references_at(a.name, a.line, a.col),
    "incoming": lambda w, a: w.call_hierarchy(a.name),
    "outgoing": lambda w, a: w.call_hierarchy(a.name, False),
    "implementations": lambda w, a: w.implementations(a.name),
    "hover": lambda w, a: w.hover(a.name),
    "inject": lambda w, a: w.inject(a.name, a.limit or 50),
    "statistics": lambda w, a: w.statistics(),
    "files": lambda w, a: w.files,
    "symbols": lambda w, a: w.symbols.select("uri", "name", "kind", "owner", "detail", "sel_line").orderBy("uri", "sel_line", "name"),
    "kinds": lambda w, a: stats.histogram(w.symbols, "kind", a.limit or 10),
    "overview": lambda w, a: output.overview(w.symbols, w.files),
    "modules": lambda w, a: stats.module_rollup(w.symbols.join(w.files.select("uri", "module"), "uri")),
    "packages": lambda w, a: stats.package_dependencies(w.relation("imports").join(w.files.select("uri", "package"), "uri").select("package", F.col("full_path").alias("path"))),
    "importers": lambda w, a: lookup.importers(w.relation("imports")),
    "unused-imports": lambda w, a: resolve.unused_imports(w.imported(), w.words()),
    "duplicate-imports": lambda w, a: resolve.duplicate_imports(w.imported()),
    "organized-imports": lambda w, a: resolve.organized(w.imported(), w.words()),
    "deprecated": lambda w, a: diagnose.deprecations(w.symbols),
    "when": lambda w, a: diagnose.when_without_else(w.texts),
    "tests": lambda w, a: diagnose.tests_for(w.texts.select(F.col("uri").alias("path"), "text"), a.name),
    "expect-actual": lambda w, a: diagnose.expected_and_actual(w.symbols),
    "supers-of": lambda w, a: graph.super_members(w.symbols, w.types, a.name),
    "steps": lambda w, a: w.relation("steps").filter(F.col("caller_key") == a.name).orderBy("seq"),
    "tokens": lambda w, a: infer.token_phases(w.relation("tokens"), w.symbols).orderBy("uri", "line", "col"),
    "hints": lambda w, a: infer.hints(w.symbols, w.relation("types")),
    "symbols-like": lambda w, a: w.symbols_like(a.name, a.limit or 512),
    "tree": lambda w, a: w.tree(a.name, a.depth, a.limit or trees.MAX_NODES),
    "changes": lambda w, a: w.tree_changes(a.name or "HEAD", a.target or "", a.depth),
    "lambdas": lambda w, a: w.lambda_types().orderBy("uri", "id", "name"),
    "index": lambda w, a: w.spark.createDataFrame([(w.save(a.name),)], "written boolean"),
    "refresh": lambda w, a: w.spark.createDataFrame([(w.refresh(a.name, w.spark.createDataFrame([(u,) for u in a.changed or ()], "uri string")),)], "version long"),
    "extract-sources": lambda w, a: archives.extract_sources(w.spark, w.root, a.name, tuple(a.pattern or ())),
    "doctor": lambda w, a: stats.folder_statistics(files.listing(w.spark, w.root, exclude=False)),
    "capabilities": lambda w, a: capabilities(w.spark),
}


def capabilities(spark: SparkSession) -> DataFrame:
    """(command, flags): what this command line can be asked."""
    flags = sorted(o for action in parser()._actions for o in action.option_strings if o.startswith("--"))
    return spark.createDataFrame([(c, flags) for c in sorted(COMMANDS)], "command string, flags array<string>")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="symatlas", description=__doc__)
    out.add_argument("command", choices=sorted(COMMANDS))
    out.add_argument("root")
    out.add_argument("name", nargs="?", default="")
    out.add_argument("--json", action="store_true", help="one object for each row")
    out.add_argument("--limit", type=int)
    out.add_argument("--depth", type=int, default=8)
    out.add_argument("--kind", action="append")
    out.add_argument("--module")
    out.add_argument("--source-set", action="append")
    out.add_argument("--line", type=int, default=0)
    out.add_argument("--col", type=int, default=0)
    out.add_argument("--target")
    out.add_argument("--ref-kind")
    out.add_argument("--no-imports", action="store_true")
    out.add_argument("--changed", action="append", help="uri of a file to put into the index anew")
    out.add_argument("--pattern", action="append")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = COMMANDS[args.command](Workspace(spark, args.root), args)
    text = output.as_json(rows) if args.json else rows.select([c for c in rows.columns])
    for row in text.toLocalIterator():
        print(row[0] if args.json else "\t".join("" if v is None else str(v) for v in row))


if __name__ == "__main__":
    main()
