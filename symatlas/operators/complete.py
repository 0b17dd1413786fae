"""Completion candidates: match scores, tiers, visibility by case, members of a type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from symatlas.functions import identifiers as ids
from symatlas.operators import infer

CAP = 150
#: Calls within calls whose arguments are left out of an argument list.
NESTED = 8
_FULL_PREFIX = 4


def complete(candidates: DataFrame, prefix: str, cap: int = CAP) -> DataFrame:
    """Rank candidates (name, kind, tier, fqn) for a prefix: the first tier wins for each name.

    A small-letter prefix hides capitalised names in the local tiers (0, 1), and the other way round; a
    camel-case prefix hides names in capitals. From four letters on, local substring matches fall away.
    Names of other packages (tier 2) come only for a prefix of two letters or more that doesn't begin in a small letter,
    and then those that begin in a capital and match by prefix or acronym.
    """
    score = ids.match_score(F.col("name"), prefix)
    local = F.col("tier") <= 1
    found = candidates.withColumn("score", score).filter("score is not null")
    gate = (F.col("score") <= 1) & F.col("name").rlike(r"^[^\p{Ll}]")
    found = found.filter((F.col("tier") != 2) | gate) if len(prefix) >= 2 and not prefix[0].islower() else found.filter("tier != 2")
    if prefix:
        capital = F.col("name").rlike(r"^\p{Lu}")
        found = found.filter(~local | (capital if prefix[0].isupper() else ~capital))
        if prefix[0].isupper() and any(c.islower() for c in prefix):
            found = found.filter(~ids.is_screaming_snake(F.col("name")))
        if len(prefix.encode()) >= _FULL_PREFIX:
            found = found.filter(~local | (F.col("score") <= 1))
    key = F.when(F.col("tier") == 2, F.concat_ws(":", "name", "fqn")).otherwise(F.col("name"))
    first = F.row_number().over(Window.partitionBy(key).orderBy("tier", "score", "fqn"))
    best = found.withColumn("place", first).filter("place = 1").drop("place")
    return best.orderBy("tier", "score", F.lower("name"), "name", "fqn").limit(cap)


def members(symbols: DataFrame, supers: DataFrame, receiver: str, depth: int = 4) -> DataFrame:
    """(name, kind, level): open members of a type, then inherited ones; the nearest of each name, by kind."""
    spark = symbols.sparkSession
    types = spark.createDataFrame([(receiver, 0)], "owner string, level int")
    frontier = types
    for level in range(1, depth + 1):
        frontier = frontier.join(supers.select(F.col("sub").alias("owner"), "super"), "owner").select(F.col("super").alias("owner")).distinct().join(types, "owner", "left_anti").withColumn("level", F.lit(level))
        types = types.unionByName(frontier)
    own = symbols.filter(~F.col("visibility").isin("private", "protected")).join(types, "owner")
    first = F.row_number().over(Window.partitionBy("name").orderBy("level", "ordinal"))
    return own.withColumn("place", first).filter("place = 1").orderBy("level", kind_rank(F.col("kind")), "ordinal").select("name", "kind", "level")


def named_arguments(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(req, label, type, position) for requests (req, before), the text before a cursor: the parameters of the call it is in that can still be given by name, of every definition.

    Those are the parameters behind the arguments given by place whose name, followed by an equals sign, isn't in the open argument list.
    """
    calls = infer.open_calls(requests).join(requests.select(F.col("req").cast("long"), "before"), "req")
    own = symbols.filter(F.col("kind").isin("function", "method", "constructor", "class", "struct")).select("name", F.posexplode("parameters").alias("position", "p"))
    given = F.regexp_extract_all("inside", F.lit(r"(\w+)\s*=(?!=)"), F.lit(1))
    inside = F.expr("substring_index(before, concat(name, '('), -1)")
    for _ in range(NESTED):  # arguments of other calls don't name parameters of this one
        inside = F.regexp_replace(inside, r"\([^()]*\)", "")
    met = calls.withColumn("inside", inside).join(own, "name")
    left = met.filter((F.col("position") >= F.col("active") - F.size(given)) & ~F.array_contains(given, F.col("p.name")))
    return left.select("req", F.concat(F.col("p.name"), F.lit(" = ")).alias("label"), F.col("p.type").alias("type"), "position").distinct()


def kind_rank(kind):
    """Functions, then variables, then others, then types."""
    return F.when(kind.isin("function", "method", "constructor"), 0).when(kind.isin("property", "field", "variable", "constant"), 1).when(kind.isin("class", "interface", "enum", "struct", "object"), 3).otherwise(2)
