"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 7).

Patterns are the 13-word windows of the benchmark items (a shorter item is one pattern). For each
pattern length there is a shift table on blocks of two words: it says how far the search may jump when
a text block ends no pattern. Blocks with shift 0 lead to a bucket of patterns with that suffix, and a
direct comparison of all the words confirms an occurrence.

The benchmark is broadcast in blocks of at most BLOCK_BYTES of text; every block is one more mapping
step over the documents, so nothing is shuffled and no benchmark is too large.

Defined results: null or empty texts have no words, no hits and are not contaminated; repeated items
count by item_id; items with a null item_id mark words but are not counted; repeated documents are
judged one by one; an empty benchmark contaminates nothing; further columns are ignored by search()
and returned unchanged by keep_clean().
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

WINDOW = 13
BLOCK_BYTES = 8 << 20

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then runs of ASCII letters, digits and bytes beyond ASCII."""
    return text.translate(_WORD).split()


class Searcher:
    """Shift tables and suffix buckets for the windows of some items.

    Patterns are places in one array of all items' word numbers. A bucket has the windows whose suffix block and
    words before it hash alike, and lists where they begin.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.ids = array("i")
        self.names: list[str | None] = []
        self.starts: list[int] = []
        tables: dict[int, tuple[dict, dict]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            if ids:
                self.names.append(item)
                self.starts.append(len(self.ids))
                size = min(window, len(ids))
                self._enter(ids, size, *tables.setdefault(size, ({}, {})))
                self.ids.extend(ids)
        self.tables = [(size, *found) for size, found in sorted(tables.items())]

    def _enter(self, ids: list[int], size: int, shift: dict[int, int], bucket: dict[int, list[int]]) -> None:
        """Add one item's windows: the shift of each block (a pair of words, or one word for patterns of one), and the buckets."""
        base = len(self.ids)
        if size == 1:
            bucket.setdefault(ids[0], []).append(base)
            return
        for end, block in enumerate((a << 32 | b for a, b in zip(ids, ids[1:])), 1):
            rest = max(0, size - 1 - end)  # in the window that has the fewest words after the block
            if rest < shift.get(block, size):
                shift[block] = rest
        seen: set[tuple] = set()  # a window that an item repeats has one place
        for i in range(len(ids) - size + 1):
            key = tuple(ids[i : i + size])
            if key not in seen:
                seen.add(key)
                bucket.setdefault(hash(key), []).append(base + i)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Half-open spans of the occurrences, and the items they belong to."""
        ids = list(map(self.numbers.get, words))
        spans: list[tuple[int, int]] = []
        items: set = set()
        n = len(ids)
        for size, shift, bucket in self.tables:
            if size == 1:
                for i, word in enumerate(ids):
                    if word in bucket:
                        spans.append((i, i + 1))
                        items.update(map(self._item, bucket[word]))
                continue
            at = size - 1
            while at < n:
                last = ids[at]
                if last is None:
                    at += size
                    continue
                before = ids[at - 1]
                jump = size - 1 if before is None else shift.get(before << 32 | last, size - 1)
                if jump:
                    at += jump
                    continue
                own = ids[at - size + 1 : at + 1]
                found = [x for x in bucket.get(hash(tuple(own)), ()) if self.ids[x : x + size].tolist() == own]
                if found:
                    items.update(map(self._item, found))
                    spans.append((at - size + 1, at + 1))
                at += 1
        return spans, items

    def _item(self, at: int) -> str | None:
        """The item that the word at a place belongs to."""
        return self.names[bisect_right(self.starts, at) - 1]


def covered(spans: list[tuple[int, int]]) -> int:
    total = end = 0
    for a, b in sorted(spans):
        if b > end:
            total += b - max(a, end)
            end = b
    return total


def digest(items: set) -> tuple[int, str]:
    named = sorted(str(i) for i in items if i is not None)
    return len(named), hashlib.sha256(",".join(named).encode()).hexdigest()


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Collect the benchmark in blocks of about block_bytes of text, one at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = -(-size // block_bytes) or 1
    for block in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield [(r["item_id"], r["text"].encode()) for r in part.collect()]


#: The search tables of a worker's last block, kept for its next task.
_BUILT: dict[str, Searcher] = {}


def _searcher(key: str, shared) -> Searcher:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Searcher(shared.value)
    return _BUILT[key]


_RESULT = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]
_SPANS, _ITEMS = "__hit_spans", "__hit_items"


def _annotated(docs: DataFrame, items: list, first: bool, last: bool, result: bool, keep_text: bool) -> DataFrame:
    """One block's search. Spans and items of earlier blocks come in, and go out unless this is the last."""
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex
    names = [c for c in docs.columns if c not in (_SPANS, _ITEMS) and (keep_text or not last or c != "text")]
    fields = ", ".join(f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in names)
    more = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if last and result else "" if last else f"{_SPANS} array<long>, {_ITEMS} array<string>"

    def run(batches):
        searcher = _searcher(key, shared)
        for batch in batches:
            found = []
            for i, text in enumerate(common.texts(batch)):
                words = words_of(text)
                spans, hits = searcher.find(words)
                if not first:
                    spans += [(x >> 32, x & 0xFFFFFFFF) for x in batch.column(_SPANS)[i].as_py()]
                    hits |= set(batch.column(_ITEMS)[i].as_py())
                found.append((len(words), spans, hits))
            kept = [batch.column(c) for c in names]
            if not last:
                new = [pa.array([[a << 32 | b for a, b in s] for _, s, _ in found], pa.list_(pa.int64())), pa.array([list(h) for _, _, h in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(kept + new, names=[*names, _SPANS, _ITEMS])
                continue
            rows = [(n, hit := covered(s), *digest(h), hit > 0 and 20 * hit >= n) for n, s, h in found]
            if result:
                new = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_RESULT)]
                yield pa.RecordBatch.from_arrays(kept + new, names=[*names, *(f[0] for f in _RESULT)])
            else:
                yield pa.RecordBatch.from_arrays(kept, names=names).filter(pa.array([not r[4] for r in rows]))

    return docs.mapInArrow(run, ", ".join(x for x in (fields, more) if x))


def _searched(docs: DataFrame, benchmark: DataFrame, result: bool, keep_text: bool, block_bytes: int) -> DataFrame:
    common.tuned(docs.sparkSession)
    blocks = item_blocks(benchmark, block_bytes)
    here, following = next(blocks), next(blocks, None)
    first = True
    while True:
        docs = _annotated(docs, here, first, following is None, result, keep_text)
        if following is None:
            return docs
        docs = common.written(docs, "decontaminate")
        here, following, first = following, next(blocks, None), False


def search(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    return _searched(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, True, False, block_bytes)


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    docs, named = common.numbered(docs, "text")
    return named(_searched(docs, benchmark, False, True, block_bytes))


def op7(spark, sf_dir):
    return search(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
