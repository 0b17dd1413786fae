"""Packing of token sequences by Karmarkar-Karp multiway differencing (operator 4).

Documents become token ids; each partition packs its own stream of documents, block by block, so
nothing is shuffled and a task holds one block of at most BLOCK_WINDOWS windows. Whole windows are
taken off long documents first. The rest of a block is dealt to windows by largest differencing:
partial partitions with opposing imbalances merge until one near-equal partition is left. The number
of windows is what the tokens need, and rises when they exceed the capacity of those there are; what
a near-equal window has over its capacity is cut off and put where there is room. All windows are full
but those of a partition's last block, whose padding together is less than a window.

Defined results: null or empty texts are the end token alone; repeated rows are packed one by one; an
empty table gives no pieces; a null doc_id stays null; further columns are ignored. sequence_id holds
the partition in its upper bits, so it is unique but not consecutive.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common

CAPACITY = 2048
END_ID = 1
BLOCK_WINDOWS = 16
TOKENIZER = "byte_bpe_50k.json"

#: Fixed value: how the byte-level vocabulary splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """Bytes by the printable characters that stand for them in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """Text to ids as the tokenizers library gives them for the vocabulary file at path.

    The vocabulary's ids are merge ranks, which the faster library takes as they are. A text that
    holds the string of a special token goes to the tokenizers library itself.
    """
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    special = [t["content"] for t in spec.get("added_tokens", [])]
    letters = byte_of()
    ranks = {bytes(letters[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(path))
            return slow[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def vocabulary_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def differencing(lengths: list[int], ways: int) -> list[list[int]]:
    """Indexes of the lengths in `ways` parts with near-equal sums, by multiway Karmarkar-Karp."""
    if ways == 1:
        return [list(range(len(lengths)))]
    # A partial partition: (-spread, tie, sums in ascending order less the smallest, their parts)
    heap = [(-n, i, [0] * (ways - 1) + [n], [[] for _ in range(ways - 1)] + [[i]]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    tie = len(lengths)
    while len(heap) > 1:
        _, _, sums, parts = heapq.heappop(heap)
        _, _, others, more = heapq.heappop(heap)
        joined = sorted(((a + b, k) for k, (a, b) in enumerate(zip(sums, reversed(others)))))
        lowest = joined[0][0]
        both = [p + q for p, q in zip(parts, reversed(more))]
        heapq.heappush(heap, (lowest - joined[-1][0], tie, [s - lowest for s, _ in joined], [both[k] for _, k in joined]))
        tie += 1
    return heap[0][3] if heap else [[] for _ in range(ways)]


def windows(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """(item, start, length) pieces of each window; no window holds more than the capacity."""
    ways = max(1, -(-sum(lengths) // capacity))
    out, room, excess = [], [], []
    for part in differencing(lengths, ways):
        pieces, used = [], 0
        for item in part:
            take = min(lengths[item], capacity - used)
            if take:
                pieces.append((item, 0, take))
                used += take
            if take < lengths[item]:
                excess.append((item, take, lengths[item] - take))
        out.append(pieces)
        room.append(capacity - used)
    at = 0
    for item, start, length in excess:
        while length:
            while not room[at]:
                at += 1
            take = min(length, room[at])
            out[at].append((item, start, take))
            room[at] -= take
            start, length = start + take, length - take
    return [w for w in out if w]


class Packer:
    """Packs one partition's stream of documents."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.next, self.held, self.tokens = capacity, first_sequence, [], 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: array) -> None:
        n, start = len(ids), 0
        while n - start >= self.capacity:
            self._sequence([(doc_id, ids, start, self.capacity)])
            start += self.capacity
        if start < n:
            self.held.append((doc_id, ids, start, n - start))
            self.tokens += n - start
            if self.tokens >= BLOCK_WINDOWS * self.capacity:
                self._deal()

    def _deal(self) -> None:
        """Pack a block; what is over whole windows waits for the next block."""
        over = self.tokens % self.capacity
        doc_id, ids, start, length = self.held.pop()
        if over < length:
            self.held.append((doc_id, ids, start, length - over))
            rest = [(doc_id, ids, start + length - over, over)] if over else []
        else:
            self.held.append((doc_id, ids, start, length))
            rest = []
        self._flush()
        self.held, self.tokens = rest, sum(r[3] for r in rest)

    def _flush(self) -> None:
        for window in windows([h[3] for h in self.held], self.capacity):
            self._sequence([(self.held[i][0], self.held[i][1], self.held[i][2] + a, n) for i, a, n in window])

    def finish(self) -> None:
        if self.held:
            self._flush()
        self.held, self.tokens = [], 0

    def _sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, ids, start, length in pieces:
            self.rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), self.next, offset))
            offset += length
        self.next += 1


_FIELDS = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: which ids of which document lie where in which sequence."""
    common.tuned(docs.sparkSession)
    schema = pa.schema(_FIELDS)

    def run(batches):
        encode = encoder(path or vocabulary_path())
        packer = Packer(TaskContext.get().partitionId() << 32, capacity)

        def ready():
            columns = list(zip(*packer.rows)) or [()] * len(_FIELDS)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = array("I", encode(text) if text else [])
                ids.append(END_ID)
                packer.add(doc_id, ids)
            yield ready()
        packer.finish()
        yield ready()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{n} long" for n, _ in _FIELDS))


def op4(spark, sf_dir):
    return pack(common.table(spark, sf_dir, "documents", "doc_id", "text"))
