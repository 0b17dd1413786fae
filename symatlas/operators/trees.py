"""Branch-aware call trees of two versions: expansion, inference of changed entries, differences.

A body is a table of steps (caller, parent, seq, kind, name): calls and branches in the order seq, parent
the seq of the branch that encloses a step, or BODY. Trees are tables of nodes, a row for each, whose
path holds the seqs from the entry down and so orders them.
"""

from __future__ import annotations

import itertools
import operator
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType

from symatlas.session import shared_folder, shipped

BODY = -1
#: Nodes of a tree that are given at most, unless more are asked for.
MAX_NODES = 1 << 17
#: Rows of a batch of alignments.
ROWS = 10000
#: Cells of an alignment whose choices are held at once, as bits.
CELLS = 1 << 22
#: Nodes of one version of a tree that are compared in one task; larger trees are compared level by level.
WHOLE = MAX_NODES
#: Nodes of trees that a task compares at once, and the last tree's beyond.
AT_ONCE = 1 << 16


def with_parents(steps: DataFrame) -> DataFrame:
    """(caller, parent, seq, kind, name, line) of scanned steps (caller_key, seq, depth, kind, label, line).

    A step's parent is the last branch one level up before it, by a window over each level of a body.
    """
    own = steps.select(F.col("caller_key").alias("caller"), F.col("depth").alias("level"), "seq", "kind", F.col("label").alias("name"), "line", F.lit(None).cast("int").alias("mark"))
    marks = own.filter("kind = 'branch'").withColumns({"level": F.col("level") + 1, "mark": F.col("seq")})
    before = Window.partitionBy("caller", "level").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    both = own.withColumn("own", F.lit(True)).unionByName(marks.withColumn("own", F.lit(False)))
    found = both.withColumn("parent", F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(BODY)))
    return found.filter("own").select("caller", "parent", "seq", "kind", "name", "line")


_NODE = "entry string, path array<int>, key string, at int, kind string, name string, depth int, names array<string>, cycle boolean"


def expanded(steps: DataFrame, entries: DataFrame, depth: int, limit: int = MAX_NODES, mark_last: bool = False) -> DataFrame:
    """(entry, path, depth, kind, name, cycle, truncated): the call trees of entries (entry), branches kept.

    A call expands to the steps of its body unless it is on its own path, then it is a leaf with cycle;
    depth counts calls, a branch is as deep as the call whose body it is in, its steps one deeper. Nodes at the
    depth bound are leaves, without a cycle mark but with mark_last. Each tree gives its first `limit` nodes in
    order, and truncated says that a tree has more. A round expands one level, written to the shared folder; as a
    level only adds nodes, those behind the limit never come back and aren't expanded.
    """
    spark = steps.sparkSession
    folder = f"{shared_folder(spark)}/symatlas-trees-{uuid.uuid4().hex}"
    steps.select("caller", "parent", "seq", "kind", "name").write.parquet(f"{folder}/steps")
    body = spark.read.parquet(f"{folder}/steps")
    roots = entries.select("entry").distinct().select(
        "entry", F.array(F.lit(0)).alias("path"), F.col("entry").alias("key"), F.lit(BODY).alias("at"), F.lit("call").alias("kind"), F.col("entry").alias("name"),
        F.lit(0).alias("depth"), F.array("entry").alias("names"), F.lit(False).alias("cycle"),
    )

    def table(name: str, frame: DataFrame) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(_NODE).parquet(f"{folder}/{name}")

    levels = [table("0", roots)]
    bounds = None
    while True:
        live = _within(levels[-1], bounds).filter(f"NOT cycle AND (kind = 'branch' OR depth < {depth})")
        below = live.drop("kind", "name", "cycle").join(body.select(F.col("caller").alias("key"), F.col("parent").alias("at"), "seq", "kind", "name"), ["key", "at"])
        call = F.col("kind") == "call"
        child = F.col("depth") + F.when(F.col("at") == BODY, 1).otherwise(0)  # below a branch the depth has been counted
        on_path = call & F.array_contains("names", F.col("name")) & (F.lit(mark_last) | (child < depth))
        level = below.select(
            "entry", F.concat("path", F.array("seq")).alias("path"), F.when(call, F.col("name")).otherwise(F.col("key")).alias("key"), F.when(call, F.lit(BODY)).otherwise(F.col("seq")).alias("at"),
            "kind", "name", child.alias("depth"), F.when(call, F.array_append("names", F.col("name"))).otherwise(F.col("names")).alias("names"), on_path.alias("cycle"),
        )
        levels.append(table(str(len(levels)), level))
        if levels[-1].isEmpty():
            break
        nodes = _within(_all(levels), bounds)
        large = nodes.groupBy("entry").count().filter(F.col("count") > limit).select("entry")
        if large.isEmpty():
            continue
        # the last node that is kept of each tree that is too large
        place = F.row_number().over(Window.partitionBy("entry").orderBy("path"))
        last = nodes.join(large, "entry", "left_semi").withColumn("place", place).filter(F.col("place") <= limit).groupBy("entry").agg(F.max("path").alias("bound"))
        bounds = _bounds(table_of(spark, last, f"{folder}/{len(levels)}-bounds"), bounds)
    cut = _within(_all(levels), bounds)
    over = F.lit(False)
    if bounds is not None:
        cut = cut.join(bounds.select("entry", F.lit(True).alias("over")), "entry", "left")
        over = F.coalesce("over", F.lit(False))
    return cut.select("entry", "path", "depth", "kind", "name", "cycle", over.alias("truncated"))


def table_of(spark, frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return spark.read.parquet(path)


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def _within(nodes: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """The nodes that don't lie behind their tree's bound."""
    if bounds is None:
        return nodes
    return nodes.join(bounds, "entry", "left").filter("bound IS NULL OR path <= bound").drop("bound")


def _bounds(new: DataFrame, old: DataFrame | None) -> DataFrame:
    both = new if old is None else old.unionByName(new)
    return both.groupBy("entry").agg(F.min("bound").alias("bound"))


def rendered(nodes: DataFrame) -> DataFrame:
    """(entry, path, line): an indented line for each node; a cycle ends in a mark."""
    return nodes.select("entry", "path", F.concat(F.repeat(F.lit("  "), F.size("path") - 1), "name", F.when(F.col("cycle"), " ⇄").otherwise("")).alias("line"))


def fingerprints(steps: DataFrame, functions: DataFrame, depth: int) -> DataFrame:
    """(key, low, high): a 128-bit name of each function's call tree down to a depth, over steps and functions (key, label).

    No tree is expanded: a round names all trees one level deeper from the names of the last round, each
    step with its place, and a body's steps are combined without order, so a large body is summed in parts.
    Trees are unrolled, not cut at cycles. Two functions have equal unrolled trees just when they have equal
    trees with cut cycles: a cut tree holds the body of every function on it at its first, uncut place.
    """
    spark = steps.sparkSession
    folder = f"{shared_folder(spark)}/symatlas-names-{uuid.uuid4().hex}"
    body = table_of(spark, steps.select("caller", "parent", "seq", "kind", "name"), f"{folder}/steps")
    labels = table_of(spark, functions.groupBy("key").agg(F.min("label").alias("label")), f"{folder}/labels")
    names = labels.select("key", F.xxhash64("label").alias("low"), F.xxhash64(F.lit(1), "label").alias("high"))
    place = ("parent", "seq", "kind", "name")
    for level in range(depth):
        met = body.join(names.withColumnRenamed("key", "callee"), (F.col("kind") == "call") & (F.col("name") == F.col("callee")), "left")
        rows = met.select("caller", *(F.xxhash64(F.lit(k), *place, F.coalesce("low", F.lit(0)), F.coalesce("high", F.lit(0))).alias(n) for k, n in enumerate(("a", "b"))))
        bodies = rows.groupBy("caller").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
        found = labels.join(bodies, F.col("key") == F.col("caller"), "left").select("key", F.xxhash64("label", "a", "b").alias("low"), F.xxhash64(F.lit(1), "label", "a", "b").alias("high"))
        names = table_of(spark, found, f"{folder}/{level}")
    return names


def inferred_entries(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], depth: int) -> DataFrame:
    """(entry): the exported functions whose call trees differ between two versions (steps, functions (key, label, exported)); if there is none, all whose trees differ."""
    b, a = (fingerprints(steps, functions, depth).select("key", *(F.col(c).alias(f"{c}_{v}") for c in ("low", "high"))) for v, (steps, functions) in (("b", before), ("a", after)))
    exported = before[1].unionByName(after[1]).groupBy("key").agg(F.max("exported").alias("exported"))
    both = b.join(a, "key", "full").filter(~(F.col("low_b").eqNullSafe(F.col("low_a")) & F.col("high_b").eqNullSafe(F.col("high_a"))) & ~F.col("key").startswith("new "))
    changed = both.join(exported, "key").select("key", F.coalesce("exported", F.lit(False)).alias("exported"))
    some = changed.agg(F.coalesce(F.max("exported"), F.lit(False)).alias("some"))
    # one row on the right side
    return changed.crossJoin(F.broadcast(some)).filter("exported OR NOT some").select(F.col("key").alias("entry")).orderBy("entry")


def aligned(before: list[str], after: list[str], cells: int | None = None) -> list[tuple[str, int, int]]:
    """(status, place before, place after) rows of a longest common subsequence; equal heads match, and at a tie what goes comes before what is new.

    Space is linear: a problem of more than CELLS cells is halved where the one path that these rules choose
    crosses the middle row. Lengths go up from the last row, and with them, from the middle up, the crossing.
    """
    shared = [set(xs) for xs in (after, before)]
    common = [[i for i, x in enumerate(xs) if x in others] for xs, others in zip((before, after), shared)]
    kept = [before[i] for i in common[0]]
    if len(set(kept)) == len(kept) and kept == [after[j] for j in common[1]]:
        # what is in both is there once and in one order
        rows, i, j = [], 0, 0
        for x, y in zip([*common[0], len(before)], [*common[1], len(after)]):
            rows += [("removed", k, -1) for k in range(i, x)] + [("added", -1, k) for k in range(j, y)] + [("same", x, y)]
            i, j = x + 1, y + 1
        return rows[:-1]
    most = CELLS if cells is None else cells
    numbers: dict[str, int] = {}
    a, b = (np.array([numbers.setdefault(x, len(numbers)) for x in xs], np.int64) for xs in (before, after))
    out: list[tuple[str, int, int]] = []

    def lengths(below, x, ys):
        """The row of suffix lengths above `below`: the best of a match, of what is below, and of what is to the right."""
        own = np.zeros(len(ys) + 1, np.int32)
        own[:-1] = np.maximum.accumulate(np.where(ys == x, below[1:] + 1, below[:-1])[::-1])[::-1]
        return own

    def crossing(i0, i1, j0, j1):
        """The column at which the path from (i0, j0) to (i1, j1) first meets the middle row."""
        middle, ys, m = (i0 + i1) // 2, b[j0:j1], j1 - j0
        below, cross = np.zeros(m + 1, np.int32), None
        for i in range(i1 - 1, i0 - 1, -1):
            if i == middle - 1:
                cross = np.arange(m + 1)
            own = lengths(below, a[i], ys)
            if cross is not None:
                match = ys == a[i]
                goes = np.append(~match & (below[:-1] >= own[1:]), True)
                steady = np.append(match, False) | goes
                moved = np.where(np.append(match, False), np.append(cross[1:], 0), cross)
                # a new step leads to the next column of this row: to the next that matches or goes
                nearest = np.minimum.accumulate(np.where(steady, np.arange(m + 1), m)[::-1])[::-1]
                cross = moved[nearest]
            below = own
        return middle, j0 + int(cross[0])

    def block(i0, i1, j0, j1):
        ys, n, m = b[j0:j1], i1 - i0, j1 - j0
        below, goes = np.zeros(m + 1, np.int32), [b""] * n
        for i in range(n - 1, -1, -1):
            own = lengths(below, a[i0 + i], ys)
            goes[i] = np.packbits(below[:-1] >= own[1:]).tobytes()
            below = own
        i = j = 0
        while i < n or j < m:
            if i < n and j < m and a[i0 + i] == ys[j]:
                out.append(("same", i0 + i, j0 + j))
                i, j = i + 1, j + 1
            elif j == m or i < n and goes[i][j >> 3] >> (7 - (j & 7)) & 1:
                out.append(("removed", i0 + i, -1))
                i += 1
            else:
                out.append(("added", -1, j0 + j))
                j += 1

    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        out.append(("same", same, same))
        same += 1
    todo = [(same, len(a), same, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if (i1 - i0) * (j1 - j0) <= most or i1 - i0 < 2:
            block(i0, i1, j0, j1)
        else:
            middle, j = crossing(i0, i1, j0, j1)
            todo += [(middle, i1, j, j1), (i0, middle, j0, j)]
    return out


def aligned_rows(before: DataFrame, after: DataFrame, *by: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(*by, pos, status, name, pos_before, pos_after, *carry): two versions of lists (*by, pos, name), a row for each item, aligned list by list.

    carry are further columns of the items, of the later version where an item is in both. Lists lie in order in their tasks and are read as they come. A list is sequential: its task holds its names,
    and a linear number of further values.
    """
    shipped(before.sparkSession)
    cols = [*by, "pos", "name", *carry]
    both = before.select(*cols, F.lit(0).alias("side")).unionByName(after.select(*cols, F.lit(1).alias("side")))
    ordered = both.select(*by, "side", F.col("pos").cast("long").alias("pos"), "name", *carry).repartition(*by).sortWithinPartitions(*by, "side", "pos")
    made = {"pos": pa.int32(), "status": pa.string(), "name": pa.string(), "pos_before": pa.int64(), "pos_after": pa.int64()}
    field = lambda k: to_arrow_schema(ordered.select(k).schema).field(0)
    schema = pa.schema([*map(field, by), *(pa.field(n, t) for n, t in made.items()), *map(field, carry)])

    def run(batches):
        key, held, out = None, ([], []), [[] for _ in schema]

        def flush(key, b, a):
            for i, (status, x, y) in enumerate(aligned([r[1] for r in b], [r[1] for r in a])):
                row = (*key, i, status, b[x][1] if x >= 0 else a[y][1], b[x][0] if x >= 0 else None, a[y][0] if y >= 0 else None, *(a[y] if y >= 0 else b[x])[2:])
                for column, value in zip(out, row):
                    column.append(value)

        def ready():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*by, "side", "pos", "name", *carry))):
                own, side, item = row[: len(by)], row[len(by)], row[len(by) + 1 :]
                if own != key:
                    if key is not None:
                        flush(key, *held)
                    if len(out[0]) >= ROWS:
                        yield ready()
                    key, held = own, ([], [])
                held[side].append(item)
        if key is not None:
            flush(key, *held)
        yield ready()

    types, more = (", ".join(f"{k} {before.schema[k].dataType.simpleString()}" for k in ks) for ks in (by, carry))
    return ordered.mapInArrow(run, f"{types}, pos int, status string, name string, pos_before long, pos_after long" + (f", {more}" if more else ""))


def _lists(trees: DataFrame) -> DataFrame:
    """(entry, path or places, at, names, kinds): nodes as lists of siblings, path is their parent's; those of one parent may lie in several lists."""
    if "names" in trees.columns:
        if "kinds" in trees.columns:
            return trees
        names = "names" if isinstance(trees.schema["names"].dataType, ArrayType) else _SPLIT
        return trees.withColumn("kinds", F.expr(f"transform({names}, x -> string(null))"))
    nodes = trees.filter("size(path) > 0").withColumn("path", F.col("path").cast("array<int>"))
    return nodes.select("entry", F.slice("path", 1, F.size("path") - 1).alias("path"), F.array(F.element_at("path", -1)).alias("at"), F.array("name").alias("names"), F.array("kind").alias("kinds"))


#: The names of a list that is a text.
_SPLIT = "IF(names = '', array(), split(names, '\n'))"


def _placed(before: DataFrame, after: DataFrame | None) -> DataFrame:
    """(entry, places, at, names, kinds): the lists of both versions, with the versions and paths at which they are."""
    if after is None:
        both = _lists(before)
    else:
        sides = [_lists(t).withColumn("places", F.array(F.struct(F.lit(side).alias("side"), F.col("path").cast("array<int>").alias("path")))) for side, t in enumerate((before, after))]
        both = sides[0].select("entry", "places", "at", "names", "kinds").unionByName(sides[1].select("entry", "places", "at", "names", "kinds"))
    # a null entry matches nothing, so only its roots count
    return both.withColumn("places", F.expr("IF(entry IS NULL, filter(places, p -> size(p.path) = 0), places)")).filter("size(places) > 0")


def _nodes(both: DataFrame, side: int) -> DataFrame:
    """(entry, path, kind, name): a row for each node of a version."""
    if not isinstance(both.schema["names"].dataType, ArrayType):
        both = both.withColumn("names", F.expr(_SPLIT))
    places = F.expr("IF(size(at) > 0, at, transform(names, (x, i) -> i))").alias("at")
    lists = both.select("entry", places, "names", "kinds", F.inline("places")).filter(F.col("side") == side)
    nodes = lists.select("entry", "path", F.explode(F.arrays_zip("at", "names", "kinds")).alias("node"))
    return nodes.select("entry", F.concat("path", F.array("node.at")).alias("path"), F.col("node.kinds").alias("kind"), F.col("node.names").alias("name"))


def _text(strings) -> tuple[np.ndarray, np.ndarray]:
    """Lengths in bytes, -1 for null, and the bytes of an array of strings."""
    strings = strings.cast(pa.large_string())
    lengths = pc.fill_null(pc.binary_length(strings), -1).to_numpy(zero_copy_only=False)
    size = int(np.maximum(lengths, 0).sum())
    if not size:
        return lengths, np.zeros(0, np.uint8)
    if strings.null_count:
        strings = strings.drop_null()
    data = np.frombuffer(strings.buffers()[2], np.uint8)
    first = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset]
    return lengths, data[first : first + size]


def _strings(lengths: np.ndarray, data: np.ndarray):
    ends = np.concatenate(([0], np.maximum(lengths, 0).cumsum(dtype=np.int64)))
    valid = pa.py_buffer(np.packbits(lengths >= 0, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


#: Types of the columns of a pack: lengths of paths, their steps, lengths of lists, places in them, lengths and bytes of names and kinds.
_COLUMNS = (np.int32, np.int32, np.int32, np.int32, np.int32, np.uint8, np.int32, np.uint8)
_WIDTHS = [(np.dtype(t), np.dtype(t).itemsize) for t in _COLUMNS]


def packed(both: DataFrame) -> DataFrame:
    """(entry, side, n, size, z): runs of lists of one version of a tree, as they come, of n nodes together, compressed for a shuffle.

    Places are differences to that of the node before, as neighbours have nearly the same.
    """
    held = both.select("entry", "places", F.col("at").cast("array<int>").alias("at"), "names", "kinds")
    schema = pa.schema([to_arrow_schema(held.select("entry").schema).field(0), ("side", pa.int32()), ("n", pa.int64()), ("size", pa.int64()), ("z", pa.binary())])

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            out, start = [[] for _ in schema], 0
            entries = batch.column(0).to_pylist()
            # a list for each place where it is, those of one tree and version together
            tree = np.cumsum([0] + [x != y for x, y in itertools.pairwise(entries)])
            which = np.repeat(np.arange(len(entries)), pc.list_value_length(batch.column(1)).to_numpy())
            sides, path = batch.column(1).flatten().flatten()
            order = np.lexsort((sides.to_numpy(), tree[which]))
            which, sides, path = which[order], sides.to_numpy()[order].tolist(), path.take(pa.array(order))
            at, names, kinds = (batch.column(i).take(pa.array(which)) for i in (2, 3, 4))
            if not pa.types.is_list(names.type):
                names = pc.if_else(pc.equal(names, ""), pa.scalar([], pa.list_(names.type)), pc.split_pattern(names, "\n"))
            numbers, given = np.array(pc.list_value_length(names)), np.array(pc.fill_null(pc.list_value_length(at), 0)) > 0
            if (numbers[~given] > 0).any():
                # places count up from 0 where there are none
                flat = _runs(numbers)[1].astype(np.int32)
                flat[np.repeat(given, numbers)] = at.flatten().to_numpy()
                at = pa.ListArray.from_arrays(pa.array(np.append(0, numbers.cumsum()), pa.int32()), pa.array(flat))
            depths, counts = (pc.list_value_length(x).to_numpy().astype(np.int32) for x in (path, at))
            steps, flat = path.flatten().to_numpy(), at.flatten().to_numpy()
            (lengths, data), (kind_lengths, kind_data) = _text(names.flatten()), _text(kinds.flatten())
            below, nodes = (np.concatenate(([0], x.cumsum(dtype=np.int64))) for x in (depths, counts))
            ends, kind_ends = (np.concatenate(([0], np.maximum(x, 0).cumsum(dtype=np.int64))) for x in (lengths, kind_lengths))
            change = np.diff(flat, prepend=np.int32(0))
            for (number, side), rows in itertools.groupby(zip(tree[which].tolist(), sides)):
                i, j = start, start + sum(1 for _ in rows)
                start, first, last = j, int(nodes[i]), int(nodes[j])
                if first == last:
                    continue
                change[first] = flat[first]
                columns = [depths[i:j], steps[below[i] : below[j]], counts[i:j], change[first:last], lengths[first:last], data[ends[first] : ends[last]]]
                columns += [kind_lengths[first:last], kind_data[kind_ends[first] : kind_ends[last]]] if len(kind_lengths) else [(), ()]
                columns = [np.ascontiguousarray(c, t) for c, t in zip(columns, _COLUMNS)]
                raw = b"".join([np.array([len(c) for c in columns], np.int64).tobytes(), *(c.tobytes() for c in columns)])
                for column, value in zip(out, (entries[which[i]], side, last - first, len(raw), codec.compress(raw, asbytes=True))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return held.mapInArrow(run, f"entry {held.schema['entry'].dataType.simpleString()}, side int, n long, size long, z binary")


def _unpacked(codec, size: int, z: bytes) -> list[np.ndarray]:
    """The columns of a pack, as they are in it."""
    raw = codec.decompress(z, size)
    at, columns = 8 * len(_COLUMNS), []
    for n, (kind, width) in zip(np.frombuffer(raw, np.int64, len(_COLUMNS)).tolist(), _WIDTHS):
        columns.append(np.frombuffer(raw, kind, n, at))
        at += n * width
    return columns


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which run, and which place in it, each item of runs of these lengths is."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(counts.cumsum() - counts, counts)


def _key(lists: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (lists.astype(np.int64) << 32) + (places.astype(np.int64) + (1 << 31))


class _Forest:
    """Trees of one version: nodes in the order of their lists and places, and for each level of lists what they are below.

    order, places, starts and sizes are those of nodes and lists; keys[k], ascending, are the list and place above
    the lists of level k, whose numbers go up from firsts[k]. The lists of level 0 are roots, and lie below trees.
    """

    def __init__(self, tree: np.ndarray, depths: np.ndarray, steps: np.ndarray, counts: np.ndarray, at: np.ndarray, names: np.ndarray):
        own = np.full(len(depths), -1, np.int64)
        begins = depths.cumsum(dtype=np.int64) - depths
        self.keys, self.firsts, total = [], [], 0
        for level in range(int(depths.max(initial=-1)) + 1):
            which = np.flatnonzero(depths == level)
            key = tree[which].astype(np.int64)
            for k in range(level):
                above = self.below(k, key)
                which, above = which[above >= 0], above[above >= 0]
                key = _key(above, steps[begins[which] + k])
            found, numbers = np.unique(key, return_inverse=True)
            self.keys.append(found)
            self.firsts.append(total)
            own[which] = total + numbers
            total += len(found)
        of_node = np.repeat(own, counts)
        key = _key(of_node, at)
        self.order = np.arange(len(key)) if (key[1:] >= key[:-1]).all() else key.argsort(kind="stable")
        self.order = self.order[np.count_nonzero(of_node < 0) :]  # lists below no node come first
        self.places, self.list = at[self.order], of_node[self.order]
        roots = len(self.keys[0]) if self.keys else 0
        if np.count_nonzero(self.list < roots) > roots:
            seen: set = set()
            found = [(x := (int(self.list[i]), int(self.places[i]), int(names[self.order[i]]))) not in seen and not seen.add(x) for i in range(self.list.searchsorted(roots))]
            once = np.append(found, np.ones(len(self.list) - len(found), bool)).astype(bool)
            self.order, self.places, self.list = self.order[once], self.places[once], self.list[once]
        self.sizes = np.bincount(self.list, minlength=total).astype(np.int64)
        self.starts = self.sizes.cumsum() - self.sizes

    def below(self, level: int, key: np.ndarray) -> np.ndarray:
        """The lists of a level below these places, -1 where there is none."""
        if level >= len(self.keys) or not len(self.keys[level]):
            return np.full(len(key), -1, np.int64)
        found = self.keys[level].searchsorted(key)
        found[found == len(self.keys[level])] = 0
        return np.where(self.keys[level][found] == key, self.firsts[level] + found, -1)

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The lists of a level below these nodes, -1 where there is none; node -1 has none."""
        out = np.full(len(nodes), -1, np.int64)
        real = np.flatnonzero(nodes >= 0)
        out[real] = self.below(level, _key(self.list[nodes[real]], self.places[nodes[real]]))
        return out

    def size(self, lists: np.ndarray) -> np.ndarray:
        return np.where(lists >= 0, self.sizes[lists], 0) if len(self.sizes) else np.zeros(len(lists), np.int64)


STATUSES = ("same", "removed", "added")


def _compared(trees: int, before: _Forest, after: _Forest, names: tuple[np.ndarray, np.ndarray]):
    """Levels (row of the parent in the level above, tree, status, place, node before, node after) of two versions of trees 0 to trees - 1; a node is -1 where there is none."""
    b, a, tree = *(f.below(0, np.arange(trees)) for f in (before, after)), np.arange(trees)
    n_b, n_a = before.size(b), after.size(a)
    which, k = _runs(np.where((n_b > 0) & (n_a > 0), n_b * n_a, n_b + n_a))
    n_b, n_a, b, a = n_b[which], n_a[which], b[which], a[which]
    both = (n_b > 0) & (n_a > 0)
    node_b = np.where(n_b > 0, (before.starts[b] if len(before.starts) else 0) + np.where(both, k // np.maximum(n_a, 1), k), -1)
    node_a = np.where(n_a > 0, (after.starts[a] if len(after.starts) else 0) + np.where(both, k % np.maximum(n_a, 1), k), -1)
    rows = [np.zeros(len(which), np.int64), tree[which], np.where(both, 0, np.where(n_b > 0, 1, 2)), np.zeros(len(which), np.int64), node_b, node_a]
    level = 0
    while len(rows[0]):
        yield rows
        level += 1
        _, tree, status, _, node_b, node_a = rows
        b, a = before.children(level, node_b), after.children(level, node_a)
        n_b, n_a = before.size(b), after.size(a)
        out = []
        # what is in one version only: below what goes or is new places stay, elsewhere they are counted
        lone = np.flatnonzero((n_b > 0) != (n_a > 0))
        which, k = _runs(n_b[lone] + n_a[lone])
        which = lone[which]
        old = n_b[which] > 0
        node_b, node_a = np.full(len(which), -1, np.int64), np.full(len(which), -1, np.int64)
        node_b[old], node_a[~old] = before.starts[b[which[old]]] + k[old], after.starts[a[which[~old]]] + k[~old]
        place = k.copy()
        kept = old & (status[which] != 0)
        place[kept] = before.places[node_b[kept]]
        kept = ~old & (status[which] != 0)
        place[kept] = after.places[node_a[kept]]
        out.append((which, tree[which], np.where(old, 1, 2), place, node_b, node_a))
        # lists that are equal
        pairs = np.flatnonzero((n_b > 0) & (n_a > 0))
        even = pairs[n_b[pairs] == n_a[pairs]]
        which, k = _runs(n_b[even])
        node_b, node_a = before.starts[b[even]][which] + k, after.starts[a[even]][which] + k
        differs = np.zeros(len(even), bool)
        differs[which[names[0][node_b] != names[1][node_a]]] = True
        equal = ~differs[which]
        which = even[which[equal]]
        out.append((which, tree[which], np.zeros(len(which), np.int64), k[equal], node_b[equal], node_a[equal]))
        # and those that must be aligned
        for row in np.concatenate((pairs[n_b[pairs] != n_a[pairs]], even[differs])).tolist():
            i, j = before.starts[b[row]], after.starts[a[row]]
            found = aligned(names[0][i : i + n_b[row]].tolist(), names[1][j : j + n_a[row]].tolist())
            x, y = (np.array([r[k] for r in found], np.int64) for k in (1, 2))
            n = len(found)
            out.append((np.full(n, row), np.full(n, tree[row]), np.where((x >= 0) & (y >= 0), 0, np.where(x >= 0, 1, 2)), np.arange(n), np.where(x >= 0, x + i, -1), np.where(y >= 0, y + j, -1)))
        rows = [np.concatenate(c) for c in zip(*out)]


def tree_diff(before: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """(entry, place, depth, status, kind, name): two versions of trees (entry, path, kind, name) as one, children aligned node by node.

    Roots match. The children of two matched nodes are aligned, those that match are compared in turn, and
    what goes or is new takes all below it along. place orders the rows. Both versions of a tree, packed, meet in one
    task; trees of more than WHOLE nodes are compared level by level. Versions may also be lists of siblings (entry, path of
    the parent, at, names, and kinds if they have any), at the last steps of their paths, from 0 if empty; names may be a
    text with a line for each. Or both come as one table of lists with places (side: 0 or 1, path) in place of path, so
    that what is in both is made once. A root that comes again with its place and name is one.
    """
    return _diff(before, after, False)


def diff_counts(before: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """(entry, status, depth, nodes): how many rows tree_diff has, counted where trees are compared."""
    return _diff(before, after, True)


def _diff(before: DataFrame, after: DataFrame | None, count: bool) -> DataFrame:
    spark = before.sparkSession
    shipped(spark)
    folder = f"{shared_folder(spark)}/symatlas-diffs-{uuid.uuid4().hex}"
    both = _placed(before, after)
    # nothing counts kinds; they are empty, as lists that are null take Spark's writer the square of a batch
    packs = table_of(spark, packed(both.withColumn("kinds", F.array().cast("array<string>")) if count else both), f"{folder}/packed")
    sizes = packs.filter("entry IS NOT NULL").groupBy("entry", "side").agg(F.sum("n").alias("n"))
    large = table_of(spark, sizes.filter(F.col("n") > WHOLE).select("entry").distinct(), f"{folder}/large")
    if large.isEmpty():
        return _whole_diff(packs, count)
    held = both.join(large, "entry", "left_semi")
    by_level = _level_diff(_nodes(held, 0), _nodes(held, 1), folder)
    if count:
        by_level = by_level.groupBy("entry", "status", "depth").agg(F.count("*").alias("nodes"))
    return _whole_diff(packs.join(large, "entry", "left_anti"), count).unionByName(by_level)


def _whole_diff(packs: DataFrame, count: bool) -> DataFrame:
    """tree_diff of packed trees, or its counts, each tree in one task; a task compares about AT_ONCE nodes at once."""
    ordered = packs.select("entry", "side", "n", "size", "z").repartition("entry").sortWithinPartitions("entry", "side")
    entry = to_arrow_schema(packs.select("entry").schema).field(0)
    if count:
        schema = pa.schema([entry, ("status", pa.string()), ("depth", pa.int32()), ("nodes", pa.int64())])
    else:
        schema = pa.schema([entry, ("place", pa.list_(pa.int32())), ("depth", pa.int32()), ("status", pa.string()), ("kind", pa.string()), ("name", pa.string())])
    labels = pa.array(STATUSES)

    def compared(entries, packs):
        columns = [[np.concatenate([p[i] for _, p in side] + [np.zeros(0, t)]) for i, t in enumerate(_COLUMNS)] for side in packs]
        for side, own in zip(packs, columns):
            # differences start anew in each pack
            sums, sizes = own[3].cumsum(dtype=np.int64), [len(p[3]) for _, p in side]
            ends = np.cumsum(sizes, dtype=np.int64)
            own[3] = (sums - np.repeat(np.append(0, sums)[ends - sizes], sizes)).astype(np.int32) if sizes else own[3]
        strings = _strings(*(np.concatenate([own[i] for own in columns]) for i in (4, 5)))
        ids = strings.dictionary_encode(null_encoding="encode").indices.to_numpy()
        cut = len(columns[0][4])
        trees = [np.repeat(*(np.array(x, np.int64) for x in ([t for t, _ in side], [len(p[0]) for _, p in side]))) for side in packs]
        forests = [_Forest(of, *own[:4], number) for of, own, number in zip(trees, columns, (ids[:cut], ids[cut:]))]
        names = ids[:cut][forests[0].order], ids[cut:][forests[1].order]
        keys = pa.array(entries, entry.type)
        kinds = None if count else _strings(*(np.concatenate([own[i] for own in columns]) for i in (6, 7)))
        places = None
        for depth, (above, tree, status, place, b, a) in enumerate(_compared(len(entries), *forests, names)):
            if count:
                nodes = np.bincount(tree * 3 + status)
                found = np.flatnonzero(nodes)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(found // 3)), labels.take(pa.array(found % 3)), pa.array(np.full(len(found), depth, np.int32)), pa.array(nodes[found].astype(np.int64))], schema=schema)
                continue
            places = np.zeros((len(tree), 1), np.int32) if places is None else np.column_stack((places[above], place)).astype(np.int32)
            old, new = (pa.array(np.append(f.order + more, 0)[n], mask=n < 0) for f, n, more in zip(forests, (b, a), (0, cut)))
            # of matched roots the earlier one stands in for what the later one lacks
            node = pc.coalesce(new, old)
            taken = [pc.coalesce(x.take(node), x.take(old)) if depth == 0 else x.take(node) for x in (kinds, strings)]
            starts = pa.array(np.arange(0, places.size + 1, depth + 1, dtype=np.int32))
            held = [keys.take(pa.array(tree)), pa.ListArray.from_arrays(starts, pa.array(places.ravel())), pa.array(np.full(len(tree), depth, np.int32)), labels.take(pa.array(status)), *(x.cast(pa.string()) for x in taken)]
            yield pa.RecordBatch.from_arrays(held, schema=schema)

    def run(batches):
        entries, packs, nodes, last, codec = [], ([], []), 0, None, pa.Codec("zstd")
        for batch in batches:
            for own, side, n, size, z in zip(*(c.to_pylist() for c in batch.columns)):
                if not entries or own != last:
                    if nodes >= AT_ONCE:
                        yield from compared(entries, packs)
                        entries, packs, nodes = [], ([], []), 0
                    entries.append(own)
                    last = own
                elif own is None and side == 1 and packs[0] and packs[0][-1][0] == len(entries) - 1:
                    entries.append(own)
                packs[side].append((len(entries) - 1, _unpacked(codec, size, z)))
                nodes += n
        if entries:
            yield from compared(entries, packs)

    types = "status string, depth int, nodes long" if count else "place array<int>, depth int, status string, kind string, name string"
    return ordered.mapInArrow(run, f"entry {packs.schema['entry'].dataType.simpleString()}, {types}")


def _level_diff(before: DataFrame, after: DataFrame, folder: str) -> DataFrame:
    """tree_diff by rounds: each aligns one level of all trees, written to the shared folder."""
    spark = before.sparkSession
    cols = ("entry", "path", "kind", "name")
    b, a = (table_of(spark, t.select(*cols), f"{folder}/{n}") for n, t in (("before", before), ("after", after)))
    root = F.size("path") == 1
    roots = [t.filter(root).select("entry", F.col("path").alias(f"path_{v}"), "kind", "name").dropDuplicates(["entry", f"path_{v}", "name"]) for v, t in (("b", b), ("a", a))]
    met = roots[0].withColumnsRenamed({"kind": "kind_b", "name": "name_b"}).join(roots[1], "entry", "full").select(
        "entry", F.array(F.lit(0)).alias("place"), "path_b", "path_a", F.when(F.col("path_b").isNull(), "added").when(F.col("path_a").isNull(), "removed").otherwise("same").alias("status"),
        F.coalesce("kind", "kind_b").alias("kind"), F.coalesce("name", "name_b").alias("name"),
    )
    levels = [table_of(spark, met, f"{folder}/0")]
    while True:
        last, depth = levels[-1], len(levels) + 1
        up = F.slice("path", 1, depth - 1)
        kids = {v: t.filter(F.size("path") == depth).select("entry", up.alias(f"path_{v}"), F.element_at("path", -1).alias("pos"), F.col("path"), "kind", "name") for v, t in (("b", b), ("a", a))}
        pairs = last.filter("status = 'same'").select("entry", "place", "path_b", "path_a")
        lists = [pairs.join(kids[v], ["entry", f"path_{v}"]).select("entry", "place", "path_b", "path_a", "pos", "name", "kind") for v in ("b", "a")]
        rows = aligned_rows(*lists, "entry", "place", "path_b", "path_a", carry=("kind",))
        paths = [F.when(F.col(f"pos_{w}").isNotNull(), F.concat(v, F.array(F.col(f"pos_{w}").cast("int")))).alias(v) for v, w in (("path_b", "before"), ("path_a", "after"))]
        out = rows.select("entry", F.concat("place", F.array("pos")).alias("place"), *paths, "status", "kind", "name")
        for v, w, status in (("b", "a", "removed"), ("a", "b", "added")):
            below = last.filter(F.col("status") == status).select("entry", "place", f"path_{v}", "status").join(kids[v], ["entry", f"path_{v}"])
            paths = {v: F.col("path"), w: F.lit(None).cast("array<int>")}
            out = out.unionByName(below.select("entry", F.concat("place", F.array("pos")).alias("place"), paths["b"].alias("path_b"), paths["a"].alias("path_a"), "status", "kind", "name"))
        levels.append(table_of(spark, out, f"{folder}/{len(levels)}"))
        if levels[-1].isEmpty():
            break
    found = _all(levels[:-1])
    return found.select("entry", "place", (F.size("place") - 1).alias("depth"), "status", "kind", "name")


def changed_trees(diff: DataFrame) -> DataFrame:
    """The rows of the trees that differ anywhere."""
    return diff.join(diff.filter("status != 'same'").select("entry").distinct(), "entry", "left_semi")


def diff_lines(diff: DataFrame) -> DataFrame:
    """(entry, place, line): a marked line for each node of a difference, indented by its depth."""
    sign = F.when(F.col("status") == "added", "+").when(F.col("status") == "removed", "-").otherwise(" ")
    return diff.select("entry", "place", F.concat(sign, F.lit(" "), F.repeat(F.lit("  "), F.col("depth")), "name").alias("line"))
