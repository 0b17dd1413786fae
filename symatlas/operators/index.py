"""Index maintenance: what files contribute, replacing files, derived name tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from symatlas.functions import paths

#: Words of a signature that are modifiers.
MODIFIERS = (
    "public private protected internal abstract final open sealed data inline suspend override static const lateinit operator infix tailrec"
).split()


def definitions(symbols: DataFrame) -> DataFrame:
    """(name, uri, line, col) of every symbol, once each."""
    return symbols.select("name", "uri", F.col("sel_line").alias("line"), F.col("sel_col").alias("col")).distinct()


def qualified(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(fqn, uri, line): package.Symbol and package.FileStem.Symbol; of equal names the last loaded wins."""
    both = symbols.join(files.select("uri", "package"), "uri").filter(F.col("package").isNotNull())
    stem = paths.stem(F.col("uri"))
    short = F.concat_ws(".", "package", "name")
    long = F.when(stem != F.col("name"), F.concat_ws(".", F.col("package"), stem, F.col("name")))
    rows = both.select(F.explode(F.array_compact(F.array(short, long))).alias("fqn"), "uri", F.col("sel_line").alias("line"), "ordinal")
    return rows.groupBy("fqn").agg(F.max_by(F.struct("uri", "line"), F.struct("uri", "ordinal")).alias("at")).select("fqn", "at.*")


def override_edges(symbols: DataFrame) -> DataFrame:
    """(uri, method, class) of methods whose signature says override."""
    return symbols.filter((F.col("kind") == "method") & F.col("detail").contains("override")).select("uri", F.col("name").alias("method"), F.col("parent_fq_name").alias("class"))


def replaced(relation: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The relation with all rows of the changed files (uri) gone and the fresh rows put in."""
    return relation.join(changed.select("uri").distinct(), "uri", "left_anti").unionByName(fresh)


def unchanged(manifest: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cache hits, with equal path, time and size, and the files to parse again."""
    keys = ["path", "mtime_secs", "size"]
    return listing.join(manifest.select(keys), keys, "left_semi"), listing.join(manifest.select(keys), keys, "left_anti")


def warm(manifest: DataFrame, listing: DataFrame, written_secs: int) -> DataFrame:
    """(path) to look at when an index of some age is there: its files that still exist, and those changed since it was written, less two seconds."""
    kept = manifest.select("path").join(listing.select("path"), "path", "left_semi")
    return kept.unionByName(listing.filter(F.col("mtime_secs") >= written_secs - 2).select("path")).dropDuplicates(["path"])


def compacted(relation: DataFrame, listing: DataFrame) -> DataFrame:
    """Without the rows of files that are gone."""
    return relation.join(listing.select("uri").distinct(), "uri", "left_semi")


def bare_names(symbols: DataFrame) -> DataFrame:
    return symbols.select("name").distinct().orderBy("name")


def top_level(symbols: DataFrame) -> DataFrame:
    """Symbols that no other symbol of the file with another span of lines contains.

    In the order of starts, and of ends from the last, a span lies in another one just when an end before it reaches its own.
    """
    spans = symbols.select("uri", "start_line", "end_line").distinct()
    before = Window.partitionBy("uri").orderBy("start_line", F.desc("end_line")).rowsBetween(Window.unboundedPreceding, -1)
    outer = spans.withColumn("reached", F.max("end_line").over(before)).filter("reached IS NULL OR reached < end_line").drop("reached")
    return symbols.join(outer, ["uri", "start_line", "end_line"], "left_semi").select(*symbols.columns)


def importable(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(name, fqns): the sorted qualified names that top-level symbols of each name can be imported by."""
    both = top_level(symbols).join(files.select("uri", "package"), "uri").filter(F.col("package").isNotNull())
    return both.groupBy("name").agg(F.array_sort(F.collect_set(F.concat_ws(".", "package", "name"))).alias("fqns"))


def without_private_library(symbols: DataFrame, files: DataFrame) -> DataFrame:
    both = symbols.join(files.select("uri", "is_library"), "uri")
    return both.filter(~(F.col("is_library") & F.col("visibility").isin("private", "internal"))).select(symbols.columns)


def summaries(symbols: DataFrame) -> DataFrame:
    """(key, name, kind, modifiers, detail) of symbols that aren't private; of equal uri::name the last wins."""
    words = F.filter(F.array(*[F.lit(m) for m in MODIFIERS]), lambda m: F.contains(F.lower("detail"), m))
    open_ = symbols.filter("visibility != 'private'").select(F.concat_ws("::", "uri", "name").alias("key"), "name", "kind", "ordinal", words.alias("modifiers"), "detail")
    return open_.groupBy("key").agg(F.max_by(F.struct("name", "kind", "modifiers", "detail"), "ordinal").alias("s")).select("key", "s.*")


def statistics(relations: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(relation, keys): the distinct keys of each relation."""
    out = None
    for name, (frame, key) in relations.items():
        one = frame.agg(F.countDistinct(key).alias("keys")).select(F.lit(name).alias("relation"), "keys")
        out = one if out is None else out.unionByName(one)
    return out


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """(group, artifact, version): the newest version of each, numbers before texts, part by part."""
    parts = F.transform(F.split("version", r"[.\-_+]"), lambda p: F.struct(p.rlike("^[0-9]+$").cast("int").alias("numeric"), F.coalesce(p.try_cast("long"), F.lit(-1)).alias("n"), p.alias("text")))
    newest = F.max(F.struct(parts.alias("parts"), "version")).alias("newest")
    return artifacts.groupBy("group", "artifact").agg(newest).select("group", "artifact", F.col("newest.version").alias("version"))
