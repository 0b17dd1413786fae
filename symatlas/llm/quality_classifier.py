"""Quality classifier on supervised subword embeddings (operator 8).

A document is the average of learned vectors of its words, of the words' character n-grams and of a
mark for every pair of words that the text has had before, all hashed into BUCKETS rows; a softmax over two classes is its output. Numpy stochastic gradient descent
(with per-coordinate step sizes) fits vectors and output on a bounded sample of labelled documents
(SAMPLE of each label, of at most SAMPLE_BYTES, or the LONG_TEXTS shortest where a label has only longer ones). Output and average are linear, so a word's share of
the score is computed once and remembered.

Defined results: a null or empty text, or one without words, gets the score of the output's bias alone;
without labels every score is 0.5; rows of labels without a quality are not learned from; repeated rows
are scored alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, sampling

BUCKETS = 1 << 17
SIZE = 12
SHORTEST, LONGEST = 3, 4
SAMPLE = 1200
SAMPLE_BYTES = 1 << 15
#: Longer texts that a label is learned from where it has no others.
LONG_TEXTS = 8
EPOCHS = 5
RATE = 0.3
THRESHOLD = 0.7
#: The row of the mark for pairs had before, and how often one mark counts beside a word's n-grams.
AGAIN, AGAIN_WEIGHT = BUCKETS - 1, 8
REMEMBERED = 400_000
#: Words of more bytes are hashed in arrays, CHUNK n-grams at a time, and are not remembered.
SHORT = 64
CHUNK = 1 << 16

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


def subwords(word: bytes) -> list[int]:
    """Rows of the word itself and of its character n-grams with boundary marks."""
    if len(word) > SHORT:
        return [int(r) for rows in long_subwords(word) for r in rows]
    marked = b"<" + word + b">"
    n = len(marked)
    parts = [marked[i : i + k] for k in range(SHORTEST, LONGEST + 1) for i in range(n - k + 1)]
    return [crc32(p) % (BUCKETS - 1) for p in (b"=" + word, *parts)]


def long_subwords(word: bytes) -> Iterator[np.ndarray]:
    """The same rows of a word of any length, in arrays of CHUNK at most."""
    yield np.array([crc32(word, crc32(b"=")) % (BUCKETS - 1)], np.int64)
    marked = np.frombuffer(b"<" + word + b">", np.uint8)
    for k in range(SHORTEST, LONGEST + 1):
        for at in range(0, len(marked) - k + 1, CHUNK):
            yield crc_rows(marked[at : at + CHUNK + k - 1], k)


def crc_rows(raw: np.ndarray, k: int) -> np.ndarray:
    """The rows of all n-grams of k bytes."""
    crc = np.full(max(0, len(raw) - k + 1), 0xFFFFFFFF, np.uint32)
    for i in range(k):
        crc = _CRC[(crc ^ raw[i : i + len(crc)]) & np.uint32(0xFF)] ^ crc >> np.uint32(8)
    return (~crc).astype(np.int64) % (BUCKETS - 1)


def pairs_again(words: list[bytes]) -> int:
    """How many pairs of successive words the text has had before."""
    return max(0, len(words) - 1 - len(set(zip(words, words[1:]))))


def features(text: bytes, known: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a text and their counts."""
    words = text.split()
    rows: list[int] = [AGAIN] * (AGAIN_WEIGHT * pairs_again(words))
    for word in words:
        if len(word) > SHORT:
            rows += subwords(word)
            continue
        if word not in known:
            known[word] = subwords(word)
        rows += known[word]
    return np.unique(np.array(rows, np.int64), return_counts=True)


class Model:
    def __init__(self, documents: list[tuple[bytes, int]]):
        self.shares = np.zeros(BUCKETS, np.float32)
        self.bias = 0.0
        if len({label for _, label in documents}) < 2:
            if documents:
                self.bias = 20.0 if documents[0][1] else -20.0
            return
        rng = np.random.default_rng(7)
        vectors = ((rng.random((BUCKETS, SIZE), np.float32) - 0.5) / SIZE).astype(np.float32)
        steps = np.full((BUCKETS, SIZE), 1e-8, np.float32)
        output, output_steps = np.zeros((2, SIZE)), np.full((2, SIZE), 1e-8)
        share = np.mean([label for _, label in documents])
        bias = np.log([1 - share, share])
        known: dict[bytes, list[int]] = {}
        ready = []
        for text, label in documents:
            rows, counts = features(text, known)
            if len(rows):
                ready.append((rows, (counts / counts.sum()).astype(np.float32), label))
        del known
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for k in rng.permutation(len(ready)):
                rows, weights, label = ready[k]
                own = vectors[rows]
                mean = weights @ own
                z = output @ mean + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label] -= 1
                slope = np.outer(p, mean)
                back = np.outer(weights, p @ output).astype(np.float32)
                output_steps += slope**2
                output -= rate * slope / np.sqrt(output_steps)
                grown = steps[rows] + back**2
                steps[rows] = grown
                vectors[rows] = own - rate * 0.1 * back / np.sqrt(grown)
        difference = output[1] - output[0]
        self.bias = float(bias[1] - bias[0])
        self.shares = (vectors @ difference).astype(np.float32)

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Known(dict):
    """The sum of the shares of a word's rows, and how many they are, as real and imaginary part; forgotten when there are many."""

    def __init__(self, shares: np.ndarray):
        super().__init__()
        self.shares = shares

    def __missing__(self, word: bytes) -> complex:
        if len(word) > SHORT:
            return sum((complex(float(self.shares[rows].sum(dtype=np.float64)), len(rows)) for rows in long_subwords(word)), 0j)
        self.learn([word])
        return self[word]

    def learn(self, words: list[bytes]) -> None:
        """Enter words of at most SHORT bytes: the n-grams of all are hashed together, and those across two words left out."""
        size = np.array([len(w) + 2 for w in words])
        marked = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)
        first = np.cumsum(size) - size
        left = np.repeat(first + size, size) - np.arange(len(marked))  # bytes from a place to the end of its word
        total = self.shares[[crc32(w, crc32(b"=")) % (BUCKETS - 1) for w in words]].astype(np.float64)
        count = np.ones(len(words))
        for k in range(SHORTEST, LONGEST + 1):
            inside = np.zeros(len(marked))
            at = np.flatnonzero(left >= k)
            inside[at] = self.shares[crc_rows(marked, k)[at]]
            total += np.add.reduceat(inside, first)
            count += np.maximum(0, size - k + 1)
        self.update(zip(words, (total + 1j * count).tolist()))


class Scorer:
    """Scores of texts, by a model's shares."""

    def __init__(self, model: Model):
        self.known, self.again, self.bias = Known(model.shares), float(model.shares[AGAIN]), model.bias

    def __call__(self, text: bytes) -> float:
        return self._of(text.split())

    def batch(self, texts: list[bytes]) -> list[float]:
        split = [t.split() for t in texts]
        known = self.known
        short = [w for w in set().union(*split) if len(w) <= SHORT]
        fresh = [w for w in short if w not in known]
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = short
        for at in range(0, len(fresh), CHUNK):
            known.learn(fresh[at : at + CHUNK])
        return [self._of(own) for own in split]

    def _of(self, words: list[bytes]) -> float:
        marks = AGAIN_WEIGHT * pairs_again(words)
        both = sum(map(self.known.__getitem__, words), complex(marks * self.again, marks))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.bias + both.real / max(1.0, both.imag)))))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from a bounded sample of the labelled rows that are not held out."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    chosen = sampling.by_label(rows.filter(~sampling.held_out(F.col("doc_id"))), "quality", SAMPLE, "doc_id")
    # the sample holds at most 4 * SAMPLE rows, so it may be broadcast; the limit after the join is for repeated documents
    texts = docs.filter(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").orderBy("doc_id", F.xxhash64("text"), "quality").limit(4 * SAMPLE).collect()
    for label in {0, 1} - {r["quality"] for r in texts}:  # a label that only long texts have is learned from the shortest of them
        size = F.octet_length("text")
        texts += docs.filter(size > SAMPLE_BYTES).join(F.broadcast(chosen.filter(F.col("quality") == label)), "doc_id").orderBy(size, "doc_id", F.xxhash64("text")).limit(LONG_TEXTS).select("doc_id", "text", "quality").collect()
    return Model([(r["text"].encode(), r["quality"]) for r in sorted(texts, key=lambda r: (r["doc_id"], r["text"], r["quality"]))])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    common.tuned(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))

    def make():
        rate = shared.value.scorer()

        def step(batch):
            scores = rate.batch(common.texts(batch))
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

        return step

    kinds = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]
    return common.map_batches(docs.select("doc_id", sampling.held_out(F.col("doc_id")).alias("held_out"), "text"), make, "doc_id long, held_out boolean, score double, predicted int", kinds)


def op8(spark, sf_dir):
    return score(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "labels", "doc_id", "quality"))
