"""Ranked search: postings, BM25 with prefix matches, field filters, fuzzy ranking."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from symatlas.functions import identifiers as ids, paths

K1, B = 1.2, 0.75
PREFIX_WEIGHT = 0.5
#: Postings that a Python worker holds at a time, but for those of one row.
ROWS = 1 << 14
#: Kinds and languages that a field filter accepts.
KINDS = frozenset(
    "file module namespace package class method property field constructor enum interface function variable constant string number boolean "
    "array object key null enum_member struct event operator type_parameter typealias".split()
)
LANGUAGES = frozenset(("kotlin", "java", "swift"))


@dataclass
class ParsedQuery:
    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def parse_query(raw: str, kinds=KINDS, languages=LANGUAGES) -> ParsedQuery:
    """Split kind:, lang:, path: and name: filters off a query; what is not a known filter stays text."""
    import re

    out, text = ParsedQuery(), []
    for whole, key, quoted, plain in re.findall(r'((?:(\w+):)?(?:"([^"]*)"|(\S+)))', raw):
        value = quoted or plain
        name = key.lower()
        if name == "kind" and (k := paths.KIND_ALIASES.get(value.lower(), value.lower())) in kinds:
            out.kinds.append(k)
        elif name in ("lang", "language") and value.lower() in languages:
            out.languages.append(value.lower())
        elif name == "path" and value:
            out.paths.append(value)
        elif name == "name" and value:
            out.names.append(value)
        else:
            text.append(whole)
    out.text = " ".join(text)
    return out


def passes(query: ParsedQuery) -> Column:
    """All fields must pass; within a field one value is enough; paths and names by substring, ignoring case."""
    tests = []
    if query.kinds:
        tests.append(F.lower("kind").isin(query.kinds))
    if query.languages:
        tests.append(paths.language(F.col("file")).isin(query.languages))
    for column, values in (("file", query.paths), ("name", query.names)):
        if values:
            tests.append(reduce(or_, (F.lower(column).contains(v.lower()) for v in values)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _counter(schema: pa.Schema):
    """What turns batches (id, tokens) into batches of postings, ROWS and those of a row at most."""

    def run(batches):
        out = ids, terms, tfs, dls = [], [], [], []

        def ready():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for own, row in zip(batch.column("id"), batch.column("tokens")):
                tokens = row.as_py() or ()
                counts = Counter(tokens)
                ids += [own.as_py()] * len(counts)
                terms += counts.keys()
                tfs += counts.values()
                dls += [len(tokens)] * len(counts)
                if len(ids) >= ROWS:
                    yield ready()
        yield ready()

    return run


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf, dl) from (id, tokens): the tokens of a row are counted where they lie, so nothing is shuffled; rows of one id count apart."""
    held = docs.select("id", "tokens")
    kind = to_arrow_schema(held.select("id").schema).field(0)
    schema = pa.schema([kind, ("term", pa.string()), ("tf", pa.int64()), ("dl", pa.int32())])

    return held.mapInArrow(_counter(schema), f"id {held.schema['id'].dataType.simpleString()}, term string, tf long, dl int")


def term_statistics(docs: DataFrame) -> DataFrame:
    """(term, df, tf): in how many documents each term is, and how often."""
    return postings(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def sizes(docs: DataFrame) -> DataFrame:
    """(id, n_tokens, n_terms) of every document."""
    return docs.select("id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_terms"))


def average_lengths(docs: DataFrame, by: str) -> DataFrame:
    """(by, docs, avgdl): documents and tokens of a document, on average, for each value of a column."""
    return docs.groupBy(by).agg(F.count("*").alias("docs"), F.avg(F.size("tokens")).alias("avgdl"))


def write_index(docs: DataFrame, path: str) -> None:
    """Store documents (id, tokens and what filters read) for searches: postings in the order of their terms, and the rest with the length.

    A search reads only the row groups of its terms; a very frequent term is spread by id. Postings are counted
    once and written; what is sampled for the ranges, and sorted, is what was written.
    """
    spark = docs.sparkSession
    postings(docs).write.mode("overwrite").parquet(f"{path}/counted")
    counted = spark.read.parquet(f"{path}/counted")
    counted.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    docs.withColumn("dl", F.size("tokens")).drop("tokens").write.mode("overwrite").parquet(f"{path}/documents")


def bm25_stored(spark, path: str, tokens: list[str], kept: Column | None = None) -> DataFrame:
    """bm25 over the index of write_index; with a filter on the documents, statistics are those of the documents that pass."""
    docs, found = spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/postings").filter(_wanted(tokens))
    if kept is not None:
        docs = docs.filter(kept)
        found = found.join(docs.select("id"), "id", "left_semi")
    return _scored(found, docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), tokens)


def bm25(docs: DataFrame, tokens: list[str]) -> DataFrame:
    """(id, score) of documents (id, tokens) for query tokens; a repeated token counts again.

    Terms that only begin with a token weigh half. Only matching terms are kept before the aggregation,
    so postings of other terms are never shuffled.
    """
    mine = F.filter("tokens", lambda t: reduce(or_, (t.startswith(x) for x in set(tokens)), F.lit(False)))
    matched = docs.select("id", F.size("tokens").alias("dl"), F.explode(mine).alias("term"))
    return _scored(matched.groupBy("id", "term", "dl").agg(F.count("*").alias("tf")), docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl")), tokens)


def _wanted(tokens: list[str]) -> Column:
    return reduce(or_, (F.col("term").startswith(t) for t in sorted(set(tokens))), F.lit(False))


def _scored(found: DataFrame, sizes: DataFrame, tokens: list[str]) -> DataFrame:
    """(id, score) from the matching postings and one row of statistics."""
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weight = reduce(lambda a, t: a + F.when(F.col("term") == t, 1.0).when(F.col("term").startswith(t), PREFIX_WEIGHT).otherwise(0.0), tokens, F.lit(0.0))
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # the statistics are one row
    scored = found.join(df, "term").crossJoin(F.broadcast(sizes))
    return scored.groupBy("id").agg(F.sum(weight * idf * norm).alias("score")).filter("score > 0")


IDENTITY = ("name", "file", "line", "signature", "kind", "doc", "generated")


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """Rank rows with a score and the identity columns: deferred generated rows last, then score, then identity.

    A generated row is deferred where a row of the same name that isn't generated exists. Scores are
    divided by the first returned row's, and capped at 1. Only generated rows are shuffled, to the names of
    the others, so a name that very many rows have is no hot key.
    """
    real = scored.filter(~F.col("generated")).select("name").distinct().withColumn("deferred", F.lit(True))
    made = scored.filter("generated").join(real, "name", "left").withColumn("deferred", F.coalesce("deferred", F.lit(False)))
    marked = scored.filter(~F.col("generated")).withColumn("deferred", F.lit(False)).unionByName(made)
    top = marked.orderBy("deferred", F.desc("score"), *[F.asc_nulls_first(c) for c in IDENTITY]).limit(limit)
    first = F.first("score").over(Window.orderBy("deferred", F.desc("score"), *[F.asc_nulls_first(c) for c in IDENTITY]))
    return top.withColumn("relative", F.least(F.lit(1.0), F.col("score") / first))


def listing(docs: DataFrame, limit: int) -> DataFrame:
    """A search by filters alone: by name, generated last, then identity; every score is 1."""
    return docs.withColumn("score", F.lit(1.0)).orderBy("name", "generated", *[F.asc_nulls_first(c) for c in IDENTITY[1:]]).limit(limit)


def query_tokens(text: str, stemmed) -> list[str]:
    """Stemmed words, then the words' segments in order, the latter only once."""
    return stemmed(ids.words_of_query(text))


def fuzzy_top(names: DataFrame, column: str, query: str, limit: int) -> DataFrame:
    """Distinct names by fuzzy score, to nine digits, then name."""
    scored = names.select(column).distinct().withColumn("score", F.round(ids.fuzzy_score(F.col(column), query), 9))
    return scored.filter("score > 0").orderBy(F.desc("score"), column).limit(limit)


def truncated(rows: DataFrame, limit: int, *order) -> DataFrame:
    """The first `limit` rows and whether there are more: one row beyond the limit is fetched as proof."""
    extra = rows.orderBy(*order).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*order))
    more = F.count("*").over(Window.partitionBy()) > limit
    return extra.withColumns({"place": place, "truncated": more}).filter(F.col("place") <= limit)
