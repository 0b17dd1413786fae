"""Common members of the standard library, for completion and hover where its sources aren't indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .identifiers import COLLECTIONS, type_leaf

#: Signatures of common members, by the receivers that have them.
ANY = (
    "fun let(block: (T) -> R): R", "fun run(block: T.() -> R): R", "fun also(block: (T) -> Unit): T", "fun apply(block: T.() -> Unit): T",
    "fun takeIf(predicate: (T) -> Boolean): T?", "fun takeUnless(predicate: (T) -> Boolean): T?", "fun toString(): String", "fun equals(other: Any?): Boolean", "fun hashCode(): Int",
)
COLLECTION = (
    "fun map(transform: (T) -> R): List<R>", "fun mapNotNull(transform: (T) -> R?): List<R>", "fun flatMap(transform: (T) -> Iterable<R>): List<R>", "fun filter(predicate: (T) -> Boolean): List<T>",
    "fun filterNot(predicate: (T) -> Boolean): List<T>", "fun filterNotNull(): List<T>", "fun forEach(action: (T) -> Unit): Unit", "fun forEachIndexed(action: (Int, T) -> Unit): Unit",
    "fun first(): T", "fun firstOrNull(): T?", "fun last(): T", "fun lastOrNull(): T?", "fun find(predicate: (T) -> Boolean): T?", "fun any(predicate: (T) -> Boolean): Boolean", "fun all(predicate: (T) -> Boolean): Boolean",
    "fun none(predicate: (T) -> Boolean): Boolean", "fun count(): Int", "fun groupBy(keySelector: (T) -> K): Map<K, List<T>>", "fun associateBy(keySelector: (T) -> K): Map<K, T>", "fun sortedBy(selector: (T) -> R?): List<T>",
    "fun distinct(): List<T>", "fun fold(initial: R, operation: (R, T) -> R): R", "fun reduce(operation: (S, T) -> S): S", "fun zip(other: Iterable<R>): List<Pair<T, R>>", "fun take(n: Int): List<T>", "fun drop(n: Int): List<T>",
    "fun joinToString(separator: CharSequence): String", "fun toList(): List<T>", "fun toSet(): Set<T>", "fun isEmpty(): Boolean", "fun isNotEmpty(): Boolean", "fun contains(element: T): Boolean", "val size: Int",
)
STRING = (
    "fun trim(): String", "fun split(delimiters: String): List<String>", "fun startsWith(prefix: String): Boolean", "fun endsWith(suffix: String): Boolean", "fun contains(other: CharSequence): Boolean",
    "fun replace(oldValue: String, newValue: String): String", "fun substring(startIndex: Int): String", "fun lowercase(): String", "fun uppercase(): String", "fun toInt(): Int", "fun toIntOrNull(): Int?",
    "fun isBlank(): Boolean", "fun isNotBlank(): Boolean", "fun isEmpty(): Boolean", "fun lines(): List<String>", "val length: Int",
)


def members(spark: SparkSession) -> DataFrame:
    """(receiver, name, kind, signature, return_type) of the common members; receiver is any, collection or string."""
    rows = [(r, s) for r, table in (("any", ANY), ("collection", COLLECTION), ("string", STRING)) for s in table]
    frame = spark.createDataFrame(rows, "receiver string, signature string")
    name = F.regexp_extract("signature", r"^(?:fun|val) (\w+)", 1)
    kind = F.when(F.col("signature").startswith("val "), "property").otherwise("method")
    return frame.select("receiver", name.alias("name"), kind.alias("kind"), "signature", F.regexp_extract("signature", r": ([^:]*)$", 1).alias("return_type"))


def receiver_group(type_text: Column) -> Column:
    """collection, string or any: which members a type has beside its own."""
    leaf = type_leaf(type_text)
    return F.when(leaf.isin(COLLECTIONS), "collection").when(leaf == "String", "string").otherwise("any")


def members_of(types: DataFrame) -> DataFrame:
    """(type, name, kind, signature) of the common members of each type (type); those of any type too."""
    grouped = types.select("type").distinct().select("type", F.explode(F.array_distinct(F.array(receiver_group(F.col("type")), F.lit("any")))).alias("receiver"))
    return grouped.join(F.broadcast(members(types.sparkSession)), "receiver").select("type", "name", "kind", "signature")
