"""Near-duplicate documents by circulant MinHash (operator 10).

A document's shingles are hashed into a circle of 2**32 places by one permutation; the k-th signature
coordinate is the least value of a second permutation, circularly shifted k steps, over those places.
The coordinates are banded; documents that share a band are candidates, and every candidate link is
confirmed on the full shingle sets.

Copies with the same set form a class, and only its smallest doc_id (its node) takes part. The members
of a bucket are first compared with one pivot, the member that shares most bands with others; confirmed
links are joined to components. Buckets that still hold several components are joined to groups, and a
group's components are compared in blocks of about BLOCK nodes: a task intersects the full sets of two
blocks by matrix products and returns only links that join components. So a bucket of thousands of
copies costs a link each, pairs are never listed, and no link between components is lost.

BANDS and ROWS miss a pair at similarity 0.8 in all bands with a probability below 1e-7.

Defined results: null texts and texts without words have an empty set, n_shingles 0, and are linked
with nothing; a text of fewer words than a shingle is one shingle; repeated rows are copies of each
other; rows of one doc_id with different texts are separate documents of the same name, and a null
doc_id is linked with nothing by name but counts as its own component (null); an empty table gives an
empty result; further columns are ignored by components_of() and returned unchanged by keep_first().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common, graph

BANDS, ROWS = 32, 4
PERCENT = 80
#: Nodes of a block, and shingles of their sets; pairs of one node that are confirmed together.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
SHARE = 256
_COLUMNS = 4096
_CHUNK = 1 << 11

_U32, _U64 = np.uint32, np.uint64
#: The circular shift of each coordinate.
_SHIFTS = (np.arange(BANDS * ROWS, dtype=np.uint64) * _U64(0x9E3779B1)).astype(_U32)
_BAND_SEEDS = common.mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles of `size` words, A-Z lower-cased, in order."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, _U64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U64, n)
    if n < size:
        size = n
    out = hashes[: n - size + 1]
    for i in range(1, size):
        out = common.mix64(out * _U64(3)) + hashes[i : n - size + 1 + i]
    return np.unique(common.mix64(out ^ _U64(size)))


def signature(found: np.ndarray) -> np.ndarray:
    """Circulant MinHash coordinates of a non-empty set of hashes."""
    places = (found >> _U64(32)).astype(_U32)
    best = np.full(len(_SHIFTS), 0xFFFFFFFF, _U32)
    for at in range(0, len(places), _CHUNK):
        z = places[None, at : at + _CHUNK] + _SHIFTS[:, None]
        z ^= z >> _U32(16)
        z *= _U32(0x85EBCA6B)
        z ^= z >> _U32(13)
        z *= _U32(0xC2B2AE35)
        np.minimum(best, z.min(1), out=best)
    return best


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    grid = sig.reshape(BANDS, ROWS).astype(_U64)
    key = _BAND_SEEDS
    for j in range(ROWS):
        key = common.mix64(key * _U64(5) + grid[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set (s1, s2) and the band keys (null for an empty set)."""

    def make():
        def step(batch):
            counts, s1, s2, keys, offsets = [], [], [], [], [0]
            for text in common.texts(batch):
                found = shingles(text, size)
                name = xxhash.xxh3_128_digest(found.tobytes())
                counts.append(len(found))
                s1.append(int.from_bytes(name[:8], "little", signed=True))
                s2.append(int.from_bytes(name[8:], "little", signed=True))
                if len(found):
                    keys.append(bands(signature(found)))
                offsets.append(offsets[-1] + BANDS * bool(len(found)))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            return {"doc_id": batch.column("doc_id"), "n_shingles": counts, "s1": s1, "s2": s2, "bands": lists}

        return step

    kinds = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))]
    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>", kinds)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; texts: (node, z).

    Compressed texts cross the shuffle rather than sets of hashes, which are several times larger. The b of one a
    are dealt in shares of about SHARE, and each share gets the text of a once, however many pairs it is in.
    """
    scratch = common.Scratch()
    shares = scratch.written(pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("shares")), "shares")
    right = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), "shares").alias("share"), "b").join(texts.withColumnRenamed("node", "b").hint("merge"), "b")
    left = shares.join(texts.withColumnRenamed("node", "a").hint("merge"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"), "z")
    dealt = left.unionByName(right).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first()).select("a", "b", "z")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        hub = np.empty(0, _U64)
        for batch in batches:
            out = ([], [])
            for a, b, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = shingles(common.unpressed([z.as_py()])[0], size)
                if b is None:
                    hub = found
                elif 100 * min(len(hub), len(found)) >= percent * max(len(hub), len(found)):
                    shared = len(np.intersect1d(hub, found, assume_unique=True))
                    if 100 * shared >= percent * (len(hub) + len(found) - shared):
                        out[0].append(a)
                        out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()) for n in out], schema=schema)

    links = common.written(dealt.mapInArrow(run, "a long, b long"), "links")
    scratch.drop()
    return links


def components_of(docs: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable) of every document."""
    scratch = common.Scratch()
    found = scratch.written(signatures(docs, size), "signatures")
    classes = found.filter("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
    classes = scratch.written(classes, "classes")
    # rows of one doc_id with different sets are one node, of all their bands
    nodes = scratch.written(found.join(classes, ["s1", "s2"]).filter("doc_id = node").select("node", "bands", "n_shingles"), "nodes")
    entries = nodes.select("node", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n")).filter("first < last").select("key", "n")
    # tables of counts and minima are written before they are joined: a join above two plain exchanges can split a hot key
    buckets = scratch.written(buckets, "buckets")
    members = scratch.written(entries.join(buckets, "key").select("key", "node", "n").distinct(), "members")
    shared = scratch.written(members.groupBy("node").agg(F.sum("n").alias("shared")), "shared")
    # joined by merging at every size: neither texts nor what grows with them is ever broadcast
    texts = common.pressed(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), ["node"]).join(shared.hint("merge"), "node", "left_semi")
    texts = scratch.written(texts, "texts")

    named = scratch.written(members.join(shared, "node").select("key", "node", "shared"), "members")
    # which of equally central members becomes the pivot doesn't change the components
    pivots = scratch.written(named.groupBy("key").agg(F.max_by("node", "shared").alias("pivot")), "pivots")
    pairs = named.join(pivots, "key").filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    component = graph.components(confirmed(scratch.written(pairs, "pairs"), texts, size, percent))
    weights = nodes.groupBy("node").agg(F.max("n_shingles").alias("weight"))
    joined = graph.components(_between(scratch, named, component, weights, texts, size, percent))
    scratch.drop(found, classes)  # the components are tables of their own
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return (
        found.join(classes, ["s1", "s2"], "left")
        .join(component, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .join(joined, "component", "left")
        .select("doc_id", "n_shingles", F.coalesce("joined", "component", "doc_id").alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id")))
    )


def _between(scratch: common.Scratch, members: DataFrame, component: DataFrame, weights: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components that meet in a bucket (key, node)."""
    labelled = members.select("key", "node").join(component, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    labelled = scratch.written(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("node").alias("first")).filter("c0 < c1").select("key", "first")
    mixed = scratch.written(mixed, "mixed")
    alive = scratch.written(labelled.join(mixed, "key").select("node", "component", "first"), "alive")
    group = graph.components(scratch.written(alive.select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), "meets"))
    nodes = alive.select("node", "component").distinct().join(group.withColumnRenamed("component", "group"), "node", "left")
    nodes = scratch.written(nodes.join(weights.hint("merge"), "node").select("node", "component", "weight", F.coalesce("group", "node").alias("group")), "groups")
    # a large component has blocks of its own, which are not compared with each other; small ones share blocks
    # sizes are in blocks: of nodes or of shingles, whichever fill more
    sizes = nodes.groupBy("group", "component").agg(F.greatest(F.count("*") / BLOCK, F.sum("weight") / BLOCK_SHINGLES).alias("blocks")).withColumn("large", F.col("blocks") >= 0.5)
    small = sizes.filter("not large").groupBy("group").agg(F.ceil(F.sum("blocks")).alias("shares"))
    parts = F.when(F.col("large"), F.pmod(F.xxhash64("node"), F.ceil("blocks"))).otherwise(F.pmod(F.xxhash64("component"), F.col("shares")))
    blocked = nodes.join(sizes, ["group", "component"]).join(small, "group", "left")
    blocked = blocked.select("group", "node", "component", F.when(F.col("large"), F.col("component")).alias("own"), parts.alias("part"))
    blocked = scratch.written(blocked.withColumn("block", F.xxhash64("group", F.coalesce("own", F.lit(-1)), F.col("own").isNull(), "part")), "blocked")
    blocks = blocked.select("group", "block", "own").distinct()
    other = blocks.select("group", F.col("block").alias("other"), F.col("own").alias("other_own"))
    met = blocks.join(other, "group").filter("block <= other and (own is null or other_own is null or own != other_own)")
    met = met.select(F.xxhash64("block", "other").alias("meeting"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    dealt = blocked.select("block", "node", "component").join(met, "block").join(texts.hint("merge"), "node").select("meeting", "component", "z")
    dealt = dealt.repartition("meeting").sortWithinPartitions("meeting")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        at, names, held = None, [], []
        for batch in batches:
            for meeting, name, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if meeting != at:
                    yield links(names, held)
                    at, names, held = meeting, [], []
                names.append(name)
                held.append(shingles(common.unpressed([z.as_py()])[0], size))
        yield links(names, held)

    def links(names, held):
        found = joining(names, held, percent) if len(set(names)) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], schema=schema)

    return scratch.written(dealt.mapInArrow(run, "a long, b long"), "joining")


def joining(names: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of component names that links between their members' sets join; no pair follows from others."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    many = (counts > 1)[inverse]
    rows, columns = owner[many], column[inverse[many]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, _COLUMNS):
        a, b = np.searchsorted(columns, [start, start + _COLUMNS])
        used, local = np.unique(rows[a:b], return_inverse=True)
        grid = np.zeros((len(used), _COLUMNS), np.float32)
        grid[local, columns[a:b] - start] = 1
        shared[np.ix_(used, used)] += grid @ grid.T
    close = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    out = []
    for i, j in zip(*np.nonzero(np.triu(close, 1))):
        x, y = sorted((find(names[i]), find(names[j])))
        if x != y:
            root[y] = x
            out.append((x, y))
    return out


def keep_first(docs: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all columns; rows without a doc_id stay.

    Where a doc_id occurs again, documents are told apart by a 64-bit hash of doc_id and text, so that different
    texts under one doc_id are grouped, kept or dropped each on their own, and identical rows become one.
    """
    docs, named = common.numbered(docs, "doc_id", "text")
    ids = docs.filter("doc_id is not null").groupBy("doc_id").count()
    if not ids.filter("count > 1").limit(1).count():
        found = common.written(components_of(docs, size, percent), "components")
        return named(docs.join(found.filter("doc_id <=> component_id").select(F.col("doc_id").alias("first")).distinct(), docs["doc_id"].eqNullSafe(F.col("first")), "left_semi"))
    keyed = docs.withColumn("name", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.col("text").isNull(), "text")))
    found = components_of(keyed.filter("name is not null").select(F.col("name").alias("doc_id"), "text"), size, percent)
    found = common.written(found.select(F.col("doc_id").alias("name"), "component_id").distinct(), "components")
    names = keyed.filter("name is not null").select("doc_id", "name").distinct()
    kept = found.join(names, "name").groupBy("component_id").agg(F.min(F.struct("doc_id", "name")).alias("least")).select("least.name")
    first = keyed.join(common.written(kept, "kept"), "name", "left_semi").dropDuplicates(["doc_id", "name"])
    return named(first.unionByName(keyed.filter("name is null")))


def op10(spark, sf_dir):
    found = components_of(common.table(spark, sf_dir, "documents", "doc_id", "text"), 4)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
