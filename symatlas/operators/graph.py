"""Edges, hierarchies, path enumeration, call trees and their differences."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from symatlas.operators import lookup, trees
from symatlas.session import SPREAD, shared_folder

MAX_DEPTH, MAX_PATHS = 8, 1000
#: Open paths that the first round of a walk to a target takes, and the most that a round takes.
AT_ONCE, MOST_AT_ONCE = 1 << 14, 1 << 20
#: Links of chained calls that are resolved in one plan.
LINKS = 4
#: Candidates that an ambiguous name shows.
CANDIDATES = 100
#: Callees of implementors in one list, and those that are sent whole to every executor; of more, lists and callers are sorted.
LIST, SENT = 1 << 10, 1 << 21


def callers(edges: DataFrame, callee: str) -> DataFrame:
    return edges.filter(F.col("callee") == callee).select("caller", "file").distinct()


def call_edges(edges: DataFrame) -> DataFrame:
    """(callee, file, caller): calls as a set."""
    return edges.select("callee", "file", "caller").distinct()


def caller_counts(edges: DataFrame) -> DataFrame:
    """(callee, callers, calls): distinct callers and calls of every callee."""
    return edges.groupBy("callee").agg(F.countDistinct("caller").alias("callers"), F.count("*").alias("calls"))


def subtype_counts(edges: DataFrame) -> DataFrame:
    """(super, subtypes, first): how many direct subtypes each type has, and the first of them."""
    return edges.groupBy("super").agg(F.countDistinct("sub").alias("subtypes"), F.min("sub").alias("first"))


def callees(edges: DataFrame, caller: str, file: str | None = None) -> DataFrame:
    own = F.col("caller") == caller
    return edges.filter(own if file is None else own & (F.col("file") == file)).select("callee").distinct()


def resolve_entry(keys: DataFrame, entry: str) -> DataFrame:
    """(key, status): the exact key, else the only one that ends in .entry, else up to five candidates."""
    exact = keys.filter(F.col("key") == entry)
    ends = keys.filter(F.col("key").endswith("." + entry)).distinct()
    both = exact.select("key", F.lit(0).alias("tier")).unionByName(ends.select("key", F.lit(1).alias("tier"))).distinct()
    # partial aggregation: counts of both tiers are one row, beside the five first keys of each
    counts = both.agg(F.min("tier").alias("best"), F.count_if(F.col("tier") == 1).alias("n"))
    top = both.filter("tier = 0").limit(1).unionByName(both.filter("tier = 1").orderBy("key").limit(5))
    found = F.when((F.col("tier") == 0) | (F.col("n") == 1), "found").otherwise("ambiguous")
    return top.crossJoin(F.broadcast(counts)).filter("tier = best").select("key", found.alias("status")).orderBy("key")


def hierarchy(edges: DataFrame, start: str, depth: int, down: bool = True) -> DataFrame:
    """(name, depth) of the transitive sub- or supertypes of a name, each at its least depth, over (sub, super)."""
    near, far = ("super", "sub") if down else ("sub", "super")
    steps = edges.select(F.col(near).alias("caller"), F.col(far).alias("callee"))
    return callees_once(steps, start, depth).filter("depth > 0")


def implementations(types: DataFrame, name: str, lines: DataFrame | None = None) -> DataFrame:
    """(name, depth) of all subtypes of a type, however deep; where there are none, lines (uri, line_no, text) that look like them as (name, depth) with the place as name."""
    found = hierarchy(types, name, 1 << 20)
    if lines is None or not found.isEmpty():
        return found
    return lookup.implementor_lines(lines, name).select(F.format_string("%s:%d", "uri", F.col("line_no") + 1).alias("name"), F.lit(1).alias("depth"))


def super_members(symbols: DataFrame, types: DataFrame, owner: str, member: str | None = None) -> DataFrame:
    """(super, uri, line): the direct supertypes of a class, or their members of a name, with their definitions."""
    up = types.filter(F.col("sub") == owner).select("super").distinct()
    if member is None:
        return up.join(symbols.select(F.col("name").alias("super"), "uri", F.col("sel_line").alias("line")), "super", "left")
    return up.join(symbols.filter(F.col("name") == member).select(F.col("owner").alias("super"), "uri", F.col("sel_line").alias("line")), "super")


def call_hierarchy(catalog: DataFrame, edges: DataFrame, query: str, incoming: bool = True) -> DataFrame:
    """(status, key): the callers, or callees, of the one callable (key, name, file) that a name or Owner.name means.

    A query that means several gives its candidates with the status ambiguous, and one that means none a row
    with the status unknown. Callers by the bare name count where only one callable has it; callees
    are those of the callable's own file.
    """
    candidates = catalog.filter((F.col("name") == query) | (F.col("key") == query)).select("key", "name", "file").distinct()
    found = candidates.orderBy("key", "file").limit(CANDIDATES).collect()  # a bounded number of candidates
    spark = catalog.sparkSession
    if len(found) != 1:
        rows = [("ambiguous", r["key"]) for r in found] or [("unknown", query)]
        return spark.createDataFrame(rows, "status string, key string").distinct().orderBy("key")
    key, name, file = found[0]
    if not incoming:
        return edges.filter((F.col("caller") == key) & (F.col("file") == file)).select(F.lit("found").alias("status"), F.col("callee").alias("key")).distinct().orderBy("key")
    alone = catalog.filter(F.col("name") == name).select("key", "file").distinct().limit(2).count() == 1
    own = (F.col("callee") == key) | (F.col("callee") == name) if alone else F.col("callee") == key
    return edges.filter(own).select(F.lit("found").alias("status"), F.col("caller").alias("key")).distinct().orderBy("key")


def walkable(edges: DataFrame, implementors: DataFrame | None = None) -> DataFrame:
    """(caller, callee, lang, mixed): what a walk over calls (caller, callee, file) can take from a node.

    A callee that calls nothing by its own name stands for the one caller whose name ends in .callee, if
    there is one; else, as Type.method, for the same method of the type's implementors (super, sub). lang is
    the suffix of the call's file, and mixed says that the node's calls are in several languages.
    """
    lang = F.regexp_extract("file", r"\.(kt|java|swift)$", 1)
    calls = edges.select("caller", "callee", F.when(lang != "", lang).alias("lang")).distinct()
    keys = calls.select(F.col("caller").alias("key")).distinct()
    open_ = calls.select(F.col("callee").alias("name")).distinct().join(keys, F.col("name") == F.col("key"), "left_anti")
    parts = F.split("key", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    ended = keys.filter(F.size(parts) > 1).select("key", F.explode(ends).alias("name")).groupBy("name").agg(F.min("key").alias("key"), F.count("*").alias("n")).filter("n = 1")
    alone = open_.join(ended, "name").select("name", "key")
    stands = [keys.select(F.col("key").alias("name"), "key"), alone]
    if implementors is not None:
        rest = open_.join(alone.select("name"), "name", "left_anti").filter(F.col("name").contains("."))
        typed = rest.select("name", F.substring_index("name", ".", 1).alias("super"), F.expr("substring(name, instr(name, '.'))").alias("method"))
        stands.append(typed.join(implementors.select("super", "sub").distinct(), "super").select("name", F.concat("sub", "method").alias("key")))
    names = stands[0]
    for more in stands[1:]:
        names = names.unionByName(more)
    found = names.join(calls.withColumnRenamed("caller", "key"), "key").select(F.col("name").alias("caller"), "callee", "lang").distinct()
    mixed = found.groupBy("caller").agg((F.min("lang") != F.max("lang")).alias("mixed"))
    return found.join(mixed, "caller").select("caller", "callee", "lang", F.coalesce("mixed", F.lit(False)).alias("mixed"))


_PATHS = "path array<string>, done boolean"


def reach(spark, edges: DataFrame, entry: str, target: str | None = None, depth: int = MAX_DEPTH, limit: int = MAX_PATHS) -> DataFrame:
    """(path, length, terminal, truncated): simple call paths from an entry over (caller, callee), the first `limit` in order.

    A path ends at the target; without one it ends at a leaf, at the depth bound, or where all callees
    are on the path already. truncated says whether a walk in order had anything left to visit when it
    had found the last path. With lang and mixed, as walkable() gives them, a node of several languages
    is left in the language of the entry only.

    The walk is a depth-first search that takes many steps at once: the open paths are tables in the shared
    folder, a round takes the first of them in order, replaces each by its continuations, and ends when no
    open path comes before the last path asked for. Dead ends only go, so no path is lost, however many
    there are. Only counts reach the driver.
    """
    folder = f"{shared_folder(spark)}/symatlas-reach-{uuid.uuid4().hex}"
    language = [c for c in ("lang", "mixed") if c in edges.columns]
    edges.select("caller", "callee", *language).filter("caller IS NOT NULL AND callee IS NOT NULL").distinct().write.parquet(f"{folder}/steps")
    steps = spark.read.parquet(f"{folder}/steps")
    if len(language) == 2:
        own = steps.filter(F.col("caller") == entry).agg(F.min("lang")).first()[0]
        kept = ~F.col("mixed") if own is None else ~F.col("mixed") | F.col("lang").eqNullSafe(F.lit(own))
        steps = (steps if own is None else steps.filter(kept)).select("caller", "callee").distinct()
    last = F.element_at("path", -1)
    free = (F.col("at") == F.col("caller")) & ~F.array_contains("path", F.col("callee"))
    if target is None:
        joined, out_of = "left", steps
    else:  # only nodes from which a walk of the calls that are left gets to the target
        near = callees_once(steps.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")), target, depth)
        out_of = steps.join(near.select(F.col("name").alias("callee"), F.col("depth").alias("far")), "callee")
        free = free & (F.col("far") <= depth - F.size("path"))
        joined = "inner"

    def table(name: str, frame: DataFrame) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(_PATHS).parquet(f"{folder}/{name}")

    done = target == entry or depth == 0 and target is None
    grown = [table("0", spark.createDataFrame([([entry], done)], _PATHS))]
    open_, n_open, at_once, round_ = grown[0].filter("NOT done"), int(not done and depth > 0), AT_ONCE if target else limit + 1, 0
    while n_open and limit:
        round_ += 1
        rest = None
        first = open_
        if n_open > at_once:
            first = table(f"{round_}-first", open_.orderBy("path").limit(at_once))
            if target is not None:  # without a target every open path gives a path, so those behind the first are never asked for
                rest = open_.crossJoin(F.broadcast(first.agg(F.max("path").alias("bound")))).filter("path > bound").select("path", "done")
                at_once = min(2 * at_once, MOST_AT_ONCE)
        ahead = first.withColumn("at", last).join(out_of, free, joined)
        path = F.when(F.col("callee").isNull(), F.col("path")).otherwise(F.concat("path", F.array("callee")))
        ended = F.size("path") > depth if target is None else last == target
        ahead = ahead.select(path.alias("path"), "callee").select("path", (F.col("callee").isNull() | ended if target is None else ended).alias("done"))
        grown.append(table(str(round_), ahead))
        open_ = grown[-1].filter("NOT done")
        if rest is not None:
            open_ = table(f"{round_}-open", open_.unionByName(rest))
        n_open, least = open_.agg(F.count("*"), F.min("path")).first()
        if n_open:
            ends = _ends(grown)
            before = ends.crossJoin(F.broadcast(spark.createDataFrame([(least,)], "least array<string>"))).filter("path < least").limit(limit).count()
            if before >= limit:
                break
    paths = table("paths", _ends(grown).orderBy("path").limit(limit))
    # what the walk would visit next: an unvisited callee behind the one that the last path takes, anywhere on it
    final = paths.agg(F.count("*").alias("n"), F.max("path").alias("path")).filter(F.col("n") >= limit)
    places = final.select("path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("i")).filter("i < size(path)") if limit else None
    if places is None:
        more = spark.createDataFrame([(True,)], "truncated boolean")
    else:
        later = places.join(steps, F.col("caller") == F.element_at("path", F.col("i"))).filter((F.col("callee") > F.element_at("path", F.col("i") + 1)) & ~F.array_contains(F.slice("path", F.lit(1), F.col("i")), F.col("callee")))
        more = later.agg((F.count("*") > 0).alias("truncated"))
    # one row on the right side
    rows = paths.crossJoin(F.broadcast(more)).orderBy("path")
    return rows.select(F.array_join("path", " > ").alias("path"), (F.size("path") - 1).alias("length"), F.element_at("path", -1).alias("terminal"), "truncated")


def _ends(grown: list[DataFrame]) -> DataFrame:
    out = grown[0]
    for more in grown[1:]:
        out = out.unionByName(more)
    return out.filter("done")


def call_tree(spark, edges: DataFrame, entry: str, depth: int, limit: int = trees.MAX_NODES) -> DataFrame:
    """(path_seq, name, depth, cycle, truncated): the tree of ordered calls (caller, seq, callee) under an entry; a node on its own path is a marked leaf.

    At most the first `limit` nodes are given, in the order of the tree, and truncated says whether there are more.
    """
    steps = edges.select("caller", F.lit(trees.BODY).alias("parent"), "seq", F.lit("call").alias("kind"), F.col("callee").alias("name"))
    nodes = trees.expanded(steps, spark.createDataFrame([(entry,)], "entry string"), depth, limit, mark_last=True)
    place = F.aggregate(F.slice("path", 2, F.size("path")), F.lit(""), lambda text, i: F.concat(text, F.lit("."), F.lpad(i.cast("string"), 6, "0")))
    return nodes.select(place.alias("path_seq"), "name", "depth", "cycle", "truncated")


def callees_once(edges: DataFrame, entry: str, depth: int) -> DataFrame:
    """(name, depth) by breadth first search: each node once, at its least depth.

    Every level is a table in the shared folder, so a level neither runs the levels before it again nor is
    collected, and a lost executor costs a retry; the walk ends with the last new node.
    """
    spark = edges.sparkSession
    steps = edges.select("caller", "callee").distinct().persist()
    folder = f"{shared_folder(spark)}/symatlas-levels-{uuid.uuid4().hex}"
    levels = [f"{folder}/0"]
    spark.createDataFrame([(entry, 0)], "name string, depth int").write.parquet(levels[0])
    for level in range(1, depth + 1):
        last, seen = (spark.read.schema("name string, depth int").parquet(*x) for x in (levels[-1:], levels))
        step = last.select(F.col("name").alias("caller")).join(steps, "caller").select(F.col("callee").alias("name")).distinct()
        step.join(seen, "name", "left_anti").withColumn("depth", F.lit(level)).write.parquet(f"{folder}/{level}")
        if spark.read.schema("name string, depth int").parquet(f"{folder}/{level}").isEmpty():
            break
        levels.append(f"{folder}/{level}")
    steps.unpersist()
    return spark.read.schema("name string, depth int").parquet(*levels)


def chained_callees(edges: DataFrame, returns: DataFrame) -> DataFrame:
    """Rewrite callees A.b.c by the return types (key `Type.method`, type): A.b's type, without its arguments, takes the place of A.b.

    A chain whose type is unknown, or is Unit or Nothing, becomes the bare method. Chains are resolved once
    each, some links in a round, by tables in the shared folder: a plan is as long as a round, and chains that have
    ended leave.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/symatlas-chains-{uuid.uuid4().hex}"
    plain = F.trim(F.substring_index("type", "<", 1))
    types = returns.groupBy("key").agg(F.max_by("type", "seq").alias("type")).select("key", plain.alias("type")).filter(~F.col("type").isin("Unit", "Nothing", ""))
    known = trees.table_of(spark, types, f"{folder}/types")
    parts = F.split("callee", r"\.")
    chains = edges.select("callee").distinct().withColumn("parts", parts).filter(F.size("parts") > 2)
    # own: the type so far, null once it is unknown
    live = trees.table_of(spark, chains.select("callee", "parts", F.col("parts")[0].alias("own"), F.lit(1).alias("at")), f"{folder}/0")
    last, done, round_ = F.get("parts", F.size("parts") - 1), [], 0
    while not live.isEmpty():
        round_ += 1
        for _ in range(LINKS):
            more = F.col("own").isNotNull() & (F.size("parts") - F.col("at") > 1)
            live = live.withColumn("key", F.when(more, F.concat_ws(".", "own", F.get("parts", F.col("at"))))).join(known, "key", "left")
            live = live.withColumns({"own": F.when(more, F.col("type")).otherwise(F.col("own")), "at": F.col("at") + F.when(more, 1).otherwise(0)}).drop("key", "type")
        ended = F.col("own").isNull() | (F.size("parts") - F.col("at") <= 1)
        state = trees.table_of(spark, live.withColumn("ended", ended), f"{folder}/{round_}")
        done.append(state.filter("ended").select("callee", F.when(F.col("own").isNull(), last).otherwise(F.concat_ws(".", "own", last)).alias("chained")))
        live = state.filter("NOT ended").drop("ended")
    if not done:
        return edges.withColumn("resolved", F.col("callee"))
    resolved = done[0]
    for rows in done[1:]:
        resolved = resolved.unionByName(rows)
    return edges.join(resolved, "callee", "left").withColumn("resolved", F.coalesce("chained", "callee")).select(*edges.columns, "resolved")


def with_implementors(edges: DataFrame, bodies: DataFrame, implementors: DataFrame) -> DataFrame:
    """Add, for callees `Type.method` without a body, edges to the same method of the type's implementors; every edge once.

    The added edges are as many as callers times implementors, so they are neither shuffled nor made one by one. An
    implementor of one type gives no edge twice: callers, ordered by what they call, meet lists of ready callees, from which
    go those that a caller has anyway. Implementors of several types are made distinct with the edges. What
    all this reads (distinct edges, types, lists) is written to the shared folder once.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/symatlas-implementors-{uuid.uuid4().hex}"
    known = bodies.select(F.col("key").alias("callee"), F.lit(True).alias("body")).distinct()
    whole = trees.table_of(spark, edges.select("caller", "callee").distinct().join(known, "callee", "left"), f"{folder}/edges")
    types = implementors.select(F.col("super").alias("type"), "sub").distinct().withColumn("types", F.count("*").over(Window.partitionBy("sub")))
    types = trees.table_of(spark, types, f"{folder}/types")
    method = F.substring_index("callee", ".", -1).alias("method")
    split = whole.filter("body IS NULL AND callee IS NOT NULL").select("caller", F.substring_index("callee", ".", 1).alias("type"), method).distinct()
    callee = F.concat_ws(".", "sub", "method").alias("callee")
    one = F.col("sub").isNotNull() & (F.col("types") == 1)
    single, several = types.filter(one).select("type", "sub"), types.filter(~one).select("type", "sub")
    own = whole.select("caller", "callee")
    if not several.isEmpty():
        own = own.unionByName(split.join(several, "type").select("caller", callee)).distinct()
    before = own.filter("callee LIKE '%.%'").withColumn("method", method).withColumn("sub", F.expr("left(callee, length(callee) - length(method) - 1)"))
    held = before.join(single, "sub").groupBy(F.col("caller").alias("c"), F.col("type").alias("t"), F.col("method").alias("m")).agg(F.collect_list("callee").alias("held"))
    held = trees.table_of(spark, held, f"{folder}/held")
    left = F.col("callees")
    if not held.isEmpty():
        split = split.join(held, F.col("caller").eqNullSafe(F.col("c")) & (F.col("type") == F.col("t")) & (F.col("method") == F.col("m")), "left").drop("c", "t", "m")
        left = F.when(F.col("held").isNull(), left).otherwise(F.array_except("callees", "held"))
    cut = single.join(single.groupBy("type").agg(F.ceil(F.count("*") / LIST).alias("lists")), "type").withColumn("list", F.pmod(F.xxhash64("sub"), "lists"))
    lists = split.select("type", "method").distinct().join(cut, "type").groupBy("type", "method", "list").agg(F.collect_list(callee).alias("callees"))
    lists = trees.table_of(spark, lists, f"{folder}/lists")
    if (lists.agg(F.sum(F.size("callees"))).first()[0] or 0) <= SENT:
        lists = F.broadcast(lists)
    ordered = split.repartitionByRange(SPREAD * spark.sparkContext.defaultParallelism, "type", "method", "caller")
    return own.unionByName(ordered.join(lists, ["type", "method"]).select("caller", F.explode(left).alias("callee")))


def definition_sites(paths: DataFrame, definitions: DataFrame) -> DataFrame:
    """(path, pos, name, file, line) of the nodes on paths; the first definition of each, line 0 if there is none."""
    first = definitions.groupBy("name").agg(F.min(F.struct("file", "line")).alias("at"))
    nodes = paths.select("path", F.posexplode(F.split("path", " > ")).alias("pos", "name"))
    return nodes.join(first, "name", "left").select("path", "pos", "name", "at.file", F.coalesce("at.line", F.lit(0)).alias("line"))


def aligned(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    """(status, name) rows of a longest common subsequence alignment; at a tie what goes comes before what is new."""
    return [(status, before[i] if i >= 0 else after[j]) for status, i, j in trees.aligned(before, after)]


def version_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(entry, pos, status, name): the aligned differences of two versions of steps (entry, pos, name), or of (entry, steps) with arrays."""
    b, a = (t.select("entry", F.posexplode("steps").alias("pos", "name")) if "steps" in t.columns else t for t in (before, after))
    return trees.aligned_rows(b, a, "entry").select("entry", "pos", "status", "name")


def changed_entries(before: DataFrame, after: DataFrame) -> DataFrame:
    """(entry, status): keys of two versions whose rendered text differs, or that only one has."""
    both = before.select("entry", F.col("text").alias("b")).join(after.select("entry", F.col("text").alias("a")), "entry", "full")
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return both.select("entry", status.alias("status"))


def version_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """(entry): the keys that either version has."""
    return before.select("entry").union(after.select("entry")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """(name, calls, called): distinct neighbours of every node."""
    out = edges.groupBy(F.col("caller").alias("name")).agg(F.countDistinct("callee").alias("calls"))
    into = edges.groupBy(F.col("callee").alias("name")).agg(F.countDistinct("caller").alias("called"))
    return out.join(into, "name", "full").select("name", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("called", F.lit(0)).alias("called"))


def rendered(status: Column, depth: Column, name: Column) -> Column:
    sign = F.when(status == "added", "+").when(status == "removed", "-").otherwise(" ")
    return F.concat(sign, F.repeat(F.lit("  "), depth), name)
