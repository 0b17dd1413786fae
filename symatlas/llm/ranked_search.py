"""Ranked lexical search with block-max pruning over a stored index (operator 13).

The index is a table of blocks of BLOCK documents as they are read. A block holds its documents, and by
term the documents of the block that hold it with the term's integer impact there (the forward index),
beside the greatest impact of each term (the block maxima). Impacts need the number of documents and of
terms of the whole table, which a pass before counts.

A search gathers the document frequencies of the query's terms, and by block the upper bound of every
query: its term weights times the block's maxima. A first pass reads the maxima alone, keeps for each
query the block of the greatest bound and scores these, which gives every query a score that its last
result must reach. A second pass reads all blocks: in each batch a query's blocks are sorted by bound and
scored until a bound drops below what the last result must reach, the greater of the first pass's score
and the task's own last result so far. The tasks' results are ranked by query. So no posting is shuffled;
a task sends at most TOP rows of a query.

Queries are searched in sets of at most QUERY_BYTES, so that what a task gets is bounded; their results
are a union. Terms are named by 64-bit hashes.

Defined results: a null text, or one without terms, is not counted as a document and never found; a null,
empty or wordless query finds nothing; repeated documents and queries count and are answered one by one;
of equal scores the smaller doc_id comes first, null doc_ids last; empty tables give an empty result; a
very long text is one document of its block; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import common

TOP = 10
#: Documents of a block, and postings after which it is closed.
BLOCK, BLOCK_TERMS = 64, 1 << 17
#: Bytes of queries that are searched together.
QUERY_BYTES = 8 << 20
#: Blocks of the index that a search sorts together, and bytes of a row group of the stored index, which a task reads at once.
BATCH, ROW_GROUP = 64, 16 << 20

#: A-Z lower-cased; ASCII letters, digits and everything beyond ASCII belong to terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def hashed(terms) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: int, length: int, n_docs: int, n_terms: int) -> int:
    """A term's share of a score before its weight, for a document of `length` terms."""
    m = 100 - 75 + 75 * length * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def statistics(docs: DataFrame) -> tuple[int, int]:
    """(documents with terms, terms with repeats) of the table."""

    def step(batch):
        sizes = [len(terms_of(t)) for t in common.texts(batch)]
        return {"docs": [sum(map(bool, sizes))], "terms": [sum(sizes)]}

    counts = common.map_batches(docs.select("text"), lambda: step, "docs long, terms long", [("docs", pa.int64()), ("terms", pa.int64())])
    found = counts.agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


class Block:
    """Documents that are indexed together."""

    def __init__(self):
        self.ids: list = []
        self.docs: list[np.ndarray] = []
        self.terms: list[np.ndarray] = []
        self.impacts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, counts: Counter, n_docs: int, n_terms: int) -> None:
        length = sum(counts.values())
        by_tf = {tf: impact(tf, length, n_docs, n_terms) for tf in set(counts.values())}
        self.docs.append(np.full(len(counts), len(self.ids), np.uint16))
        self.terms.append(hashed(counts))
        self.impacts.append(np.fromiter(map(by_tf.__getitem__, counts.values()), np.uint32, len(counts)))
        self.ids.append(doc_id)
        self.size += len(counts)

    def row(self) -> tuple:
        """Terms in order of their hashes with the end of each one's postings and its greatest impact; the postings; the documents."""
        terms, impacts, docs = (np.concatenate(x) for x in (self.terms, self.impacts, self.docs))
        order = np.argsort(terms, kind="stable")
        terms, impacts, docs = terms[order], impacts[order], docs[order]
        starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
        ends = np.concatenate([starts[1:], [len(terms)]]).astype(np.uint32)
        return terms[starts].tobytes(), ends.tobytes(), np.maximum.reduceat(impacts, starts).tobytes(), docs.tobytes(), impacts.tobytes(), self.ids


_INDEX = "block long, terms binary, ends binary, maxima binary, docs binary, impacts binary, ids array<long>"
_PARTS = ("terms", "ends", "maxima", "docs", "impacts")


def index_of(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """A row for each block of documents (doc_id, text); block numbers hold the partition in their upper bits."""
    common.tuned(docs.sparkSession)
    schema = pa.schema([("block", pa.int64()), *((p, pa.binary()) for p in _PARTS), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        number, block = TaskContext.get().partitionId() << 32, Block()

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([v], f.type) for v, f in zip(block.row(), list(schema)[1:]))], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch)):
                counts = Counter(terms_of(text))
                if counts:
                    block.add(doc_id, counts, n_docs, n_terms)
                    if len(block.ids) == BLOCK or block.size >= BLOCK_TERMS:
                        yield closed()
                        number, block = number + 1, Block()
        if block.ids:
            yield closed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _INDEX)


class Queries:
    """A set of queries as term hashes with their repeats; `by` holds the (query, repeats) entries of each term."""

    def __init__(self, texts: list[str | None]):
        counts = [Counter(terms_of((t or "").encode())) for t in texts]
        self.n = len(texts)
        query = np.repeat(np.arange(self.n), [len(c) for c in counts])
        terms = np.concatenate([hashed(c) for c in counts] or [np.empty(0, np.uint64)])
        times = np.fromiter((x for c in counts for x in c.values()), np.int64, len(terms))
        order = np.argsort(terms, kind="stable")
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.query, self.times = query[order], times[order]
        self.ends = np.append(self.starts[1:], len(order))
        self.weights = self.times

    def weighted(self, n_docs: int, df: dict[int, int]) -> None:
        own = np.array([weight(n_docs, df[int(t)]) if int(t) in df else 0 for t in self.terms], np.int64)
        self.weights = self.times * np.repeat(own, self.ends - self.starts)


def _numbers(value: bytes, kind) -> np.ndarray:
    return np.frombuffer(value, kind)


def _met(queries: Queries, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the queries' terms, places in the block's terms) of the terms that both have."""
    if not len(queries.terms) or not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(terms, queries.terms), len(terms) - 1)
    own = np.flatnonzero(terms[at] == queries.terms)
    return own, at[own]


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of every place of the ranges."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(starts)), sizes)
    return which, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which]


def bounds(queries: Queries, terms: np.ndarray, maxima: np.ndarray) -> np.ndarray:
    """The greatest score that a document of the block can have, by query."""
    own, at = _met(queries, terms)
    which, place = _spread(queries.starts[own], queries.ends[own])
    out = np.zeros(queries.n, np.int64)
    np.add.at(out, queries.query[place], queries.weights[place] * maxima[at].astype(np.int64)[which])
    return out


class Opened:
    """A block of the index with the postings of the terms that some query has."""

    def __init__(self, queries: Queries, row: dict):
        terms, ends = _numbers(row["terms"], np.uint64), _numbers(row["ends"], np.uint32).astype(np.int64)
        own, at = _met(queries, terms)
        starts = np.concatenate([[0], ends])[at]
        self.docs, self.impacts, self.ids = _numbers(row["docs"], np.uint16), _numbers(row["impacts"], np.uint32), row["ids"]
        which, place = _spread(queries.starts[own], queries.ends[own])
        order = np.argsort(queries.query[place], kind="stable")
        self.query, self.weights = queries.query[place][order], queries.weights[place][order]
        self.first, self.last = starts[which][order], ends[at][which][order]

    def scores(self, query: int) -> np.ndarray:
        """The scores of all documents of the block for a query."""
        low, high = np.searchsorted(self.query, [query, query + 1])
        which, place = _spread(self.first[low:high], self.last[low:high])
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.docs[place], self.weights[low:high][which] * self.impacts[place].astype(np.int64))
        return out


class Best:
    """The results of a query so far."""

    def __init__(self, top: int, floor: int = 1):
        self.top, self.floor, self.rows = top, max(1, floor), []

    def add(self, scores: np.ndarray, ids: list) -> None:
        new = [(int(scores[i]), ids[i]) for i in np.flatnonzero(scores >= self.floor)]
        if new:
            self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.top]
            if len(self.rows) == self.top:
                self.floor = max(self.floor, self.rows[-1][0])


_FOUND = "query int, score long, doc_id long"


def _searched(blocks: DataFrame, queries: Queries, floors: np.ndarray, top: int) -> DataFrame:
    """(query, score, doc_id): each task's best documents of every query; floors are the scores that a query's last result must reach."""
    schema = pa.schema([("query", pa.int32()), ("score", pa.int64()), ("doc_id", pa.int64())])

    def run(batches):
        best = [Best(top, int(f)) for f in floors]
        for batch in batches:
            rows = batch.to_pylist()
            upper = np.stack([bounds(queries, _numbers(r["terms"], np.uint64), _numbers(r["maxima"], np.uint32)) for r in rows])
            opened: dict[int, Opened] = {}
            need = np.array([b.floor for b in best], np.int64)
            for q in np.flatnonzero((upper >= need).any(0)):
                for k in np.argsort(-upper[:, q], kind="stable"):
                    if upper[k, q] < best[q].floor:
                        break
                    if k not in opened:
                        opened[k] = Opened(queries, rows[k])
                    best[q].add(opened[k].scores(q), opened[k].ids)
        out = [(q, score, doc_id) for q, b in enumerate(best) for score, doc_id in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ((), (), ()), schema)], schema=schema)

    blocks.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return blocks.mapInArrow(run, _FOUND)


def frequencies(blocks: DataFrame, queries: Queries) -> dict[int, int]:
    """The number of documents that hold each of the queries' terms, by the term's hash."""
    terms = queries.terms

    def step(batch):
        n = np.zeros(len(terms), np.int64)
        for own, ends in zip(batch.column("terms").to_pylist(), batch.column("ends").to_pylist()):
            ends = _numbers(ends, np.uint32).astype(np.int64)
            place, at = _met(queries, _numbers(own, np.uint64))
            n[place] += np.diff(ends, prepend=0)[at]
        some = np.flatnonzero(n)
        return {"place": some, "n": n[some]}

    counts = common.map_batches(blocks.select("terms", "ends"), lambda: step, "place int, n long", [("place", pa.int32()), ("n", pa.int64())])
    return {int(terms[p]): n for p, n in counts.groupBy("place").agg(F.sum("n")).collect()}  # at most a row for each term of a bounded set of queries


def _seeds(blocks: DataFrame, queries: Queries) -> list[int]:
    """The blocks with the greatest bound of each query, by the maxima alone."""

    def run(batches):
        most, where = np.zeros(queries.n, np.int64), np.zeros(queries.n, np.int64)
        for batch in batches:
            for block, own, maxima in zip(*(batch.column(c).to_pylist() for c in ("block", "terms", "maxima"))):
                upper = bounds(queries, _numbers(own, np.uint64), _numbers(maxima, np.uint32))
                better = upper > most
                most[better], where[better] = upper[better], block
        some = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(most[some]), pa.array(where[some])], names=["query", "bound", "block"])

    found = blocks.select("block", "terms", "maxima").mapInArrow(run, "query int, bound long, block long")
    # at most one block of each query of a bounded set
    return sorted({r[0] for r in found.groupBy("query").agg(F.max_by("block", F.struct("bound", "block")).alias("block")).select("block").distinct().collect()})


def search(blocks: DataFrame, n_docs: int, texts: list[str | None], top: int = TOP) -> DataFrame:
    """(query, rank, doc_id, score) of a bounded set of queries over a stored index of n_docs documents; query is the place in `texts`."""
    spark = blocks.sparkSession
    queries = Queries(texts)
    queries.weighted(n_docs, frequencies(blocks, queries))
    floors = np.ones(queries.n, np.int64)
    seeds = _seeds(blocks, queries)
    if seeds:
        first = blocks.join(F.broadcast(spark.createDataFrame([(b,) for b in seeds], "block long")), "block", "left_semi").select(*blocks.columns)
        lasts = ranked(_searched(first, queries, floors, top), top).filter(F.col("rank") == top).select("query", "score")
        for query, score in lasts.collect():  # at most a row for each query of a bounded set
            floors[query] = max(1, score)
    return ranked(_searched(blocks, queries, floors, top), top)


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query", "rank", "doc_id", "score")


def query_sets(items: DataFrame, most: int = QUERY_BYTES):
    """Lists of (item_id, text) of at most `most` bytes, or one item, in turn; the driver holds one partition of the items at a time."""
    held, size = [], 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        n = len((text or "").encode()) + 64
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += n
    if held:
        yield held


def searched(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents (doc_id, text) of every item (item_id, text)."""
    spark = common.tuned(docs.sparkSession)
    scratch = common.Scratch()
    kind = items.schema["item_id"].dataType.simpleString()
    out, kept = [], []
    n_docs, n_terms = statistics(docs)
    if n_docs:
        blocks = scratch.written(index_of(docs, n_docs, n_terms), "blocks", **{"parquet.block.size": str(ROW_GROUP)})
        for held in query_sets(items):
            names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(held)], f"query int, item_id {kind}")
            kept.append(scratch.written(search(blocks, n_docs, [r[1] for r in held], top), "ranked"))
            out.append(kept[-1].join(names, "query").select("item_id", "rank", "doc_id", "score"))
            common.tuned(spark)
        scratch.drop(*kept)  # the index, once all queries are answered
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, out)


def op13(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    items = common.table(spark, sf_dir, "benchmark", "item_id", "text")
    return searched(docs, items)
