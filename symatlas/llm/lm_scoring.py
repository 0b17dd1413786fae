"""Language-model scores by masked pseudo-likelihood (operator 3).

A bidirectional window network predicts every word from the SIDE words before and after it: the sum of
their position-wise vectors goes through tanh into a two-level softmax (class, then word of the class).
A document's score is the sum of its words' conditional log-probabilities given both sides.

Everything is gathered from the whole corpus. The vocabulary is a table of all words and their counts. The
network predicts places: the WORDS most frequent words have their own, all others share hashed ones, where a
word's chance is that of the place times its share of the place's words. Counts of the most frequent words, FREQUENT
of them at most, are sent to the tasks; those of all others are joined. Every partition trains a copy of the network on all its words in
numpy, from the same start; the copies' weights, quantised so that sums are exact and repeatable, are
averaged by their numbers of words in one aggregation. A window never crosses documents.

Defined results: null and empty texts have no words, log-likelihood 0 and a null mean; repeated rows
count, and are scored, one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common

CLASSES, MEMBERS = 32, 32
WORDS = 768  # the places beyond these, but the edge's, are for hashed words
SIDE = 2
HIDDEN = 16
BATCH, SCORED = 4096, 16384
RATE = 2.0
EDGE = 0
FREQUENT = 1 << 18
#: Places of other words that a task remembers.
REMEMBERED = 1 << 17
_PLACES = CLASSES * MEMBERS
_SCALE = 1 << 24
_LOG_SCALE = 1 << 32
_SHAPES = (("context", (2 * SIDE, _PLACES, HIDDEN)), ("classes", (CLASSES, HIDDEN)), ("class_bias", (CLASSES,)), ("members", (CLASSES, MEMBERS, HIDDEN)), ("member_bias", (CLASSES, MEMBERS)))
SIZE = sum(int(np.prod(s)) for _, s in _SHAPES)


class Places(dict):
    """The places of frequent words, and those of other words as they are met; the latter are forgotten when there are many."""

    def __init__(self, own: dict[bytes, int], rest: list[int]):
        super().__init__(own)
        self.own, self.rest = own, rest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
            self.update(self.own)
        place = self[word] = self.rest[xxhash.xxh3_64_intdigest(word) % len(self.rest)]
        return place


class Vocabulary:
    """Places of words: the frequent ones their own, dealt over the classes by rank; others hashed."""

    def __init__(self, frequent: list[bytes]):
        order = np.arange(1, _PLACES).reshape(-1)
        spread = (order % CLASSES) * MEMBERS + order // CLASSES
        self.places = {w: int(spread[i]) for i, w in enumerate(frequent[:WORDS])}
        self.rest = spread[WORDS:].tolist()

    def encoder(self):
        """A function from lists of words to their places, with SIDE edges around each document."""
        place = Places(self.places, self.rest).__getitem__

        def encode(documents: list[list[bytes]]) -> np.ndarray:
            flat: list[int] = [EDGE] * SIDE
            for words in documents:
                flat.extend(map(place, words))
                flat += [EDGE] * SIDE
            return np.array(flat, np.int16)

        return encode


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _soft(z: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place; hidden units lie within 1, so z stays far below the bound of float32's exp."""
    np.exp(np.minimum(z, 80, out=z), out=z)
    z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
    return z


class Network:
    def __init__(self, weights: np.ndarray | None = None):
        if weights is None:
            weights = np.zeros(SIZE, np.float32)
            n = 2 * SIDE * _PLACES * HIDDEN
            weights[: n + CLASSES * HIDDEN] = np.random.default_rng(11).normal(0, 0.1, n + CLASSES * HIDDEN)
        self.flat = weights.astype(np.float32)
        at = 0
        for name, shape in _SHAPES:
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size

    def _forward(self, around: np.ndarray):
        """Hidden units and class probabilities."""
        total = self.context[0][around[0]]
        for k in range(1, 2 * SIDE):
            total += self.context[k][around[k]]
        hidden = np.tanh(total, out=total)
        return hidden, _soft(hidden @ self.classes.T + self.class_bias)

    def _members(self, hidden: np.ndarray, k: int) -> np.ndarray:
        return _soft(hidden @ self.members[k].T + self.member_bias[k])

    @staticmethod
    def _by_class(target: np.ndarray):
        order = np.argsort(target // MEMBERS, kind="stable")
        bounds = np.searchsorted(target[order] // MEMBERS, np.arange(CLASSES + 1))
        return order, bounds

    def train(self, around: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step on the mean loss of a batch; around: (2 * SIDE, n)."""
        order, bounds = self._by_class(target)
        around, target = around[:, order], target[order]
        n = len(target)
        hidden, p = self._forward(around)
        p[np.arange(n), target // MEMBERS] -= 1
        back = p @ self.classes
        member_steps = []
        for k in range(CLASSES):
            a, b = bounds[k], bounds[k + 1]
            if a == b:
                continue
            h = hidden[a:b]
            q = self._members(h, k)
            q[np.arange(b - a), target[a:b] % MEMBERS] -= 1
            back[a:b] += q @ self.members[k]
            member_steps.append((k, q.T @ h, q.sum(0)))
        step = rate / n
        self.classes -= step * (p.T @ hidden)
        self.class_bias -= step * p.sum(0)
        for k, w, c in member_steps:
            self.members[k] -= step * CLASSES**0.5 * w
            self.member_bias[k] -= step * CLASSES**0.5 * c
        back *= 1 - hidden**2
        back *= rate / n * 16  # a place is met in a small share of the windows only
        for k in range(2 * SIDE):
            sort = np.argsort(around[k], kind="stable")
            ranked = around[k][sort]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            self.context[k][ranked[first]] -= np.add.reduceat(back[sort], first, axis=0)

    def log_chances(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, bounds = self._by_class(target)
        around, own = around[:, order], target[order]
        hidden, p = self._forward(around)
        out = np.log(p[np.arange(len(own)), own // MEMBERS] + 1e-12)
        for k in range(CLASSES):
            a, b = bounds[k], bounds[k + 1]
            if a < b:
                out[a:b] += np.log(self._members(hidden[a:b], k)[np.arange(b - a), own[a:b] % MEMBERS] + 1e-12)
        back = np.empty(len(own), np.float64)
        back[order] = out
        return back


def windows_of(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words, and the places around each: (2 * SIDE, n)."""
    at = np.flatnonzero(flat != EDGE)
    around = np.stack([flat[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))]) if len(at) else np.empty((2 * SIDE, 0), np.int16)
    return at, around


def counted(docs: DataFrame) -> DataFrame:
    """Every word of all texts: word, h (its hash less 2**63) and n, how often it stands in the corpus."""

    def make():
        def step(batch):
            counts: dict[bytes, int] = {}
            for text in common.texts(batch):
                for word in words_of(text):
                    counts[word] = counts.get(word, 0) + 1
            return {"word": pa.array(list(counts), pa.binary()), "h": [hash_of(w) for w in counts], "n": pa.array(list(counts.values()), pa.int64())}

        return step

    rows = common.map_batches(docs, make, "word binary, h long, n long", [("word", pa.binary()), ("h", pa.int64()), ("n", pa.int64())])
    return rows.groupBy("word", "h").agg(F.sum("n").alias("n"))


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The places of the most frequent words of all texts, from their counts."""
    top = counts.select("word", "n").orderBy(F.desc("n"), "word").limit(WORDS).collect()
    return Vocabulary([bytes(r["word"]) for r in top])


class Shares:
    """Logarithms of the shares that words have of the words of their places."""

    def __init__(self, counts: DataFrame, words: Vocabulary):
        self.size = len(words.rest)
        step = F.floor(F.log("n") * 64)
        met, least = 0, None  # the least step from which on there are FREQUENT words at most
        for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
            met += r["count"]
            if met > FREQUENT:
                break
            least = r["step"]
        slot = F.pmod(F.pmod("h", F.lit(self.size)) + (1 << 63) % self.size, F.lit(self.size)).cast("int")
        totals = {r["slot"]: r["n"] for r in counts.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).collect()}
        often = step >= F.lit(least) if least is not None else F.lit(False)
        top = counts.filter(often).select("word", "n").toArrow()
        frequent = dict(zip(top["word"].to_pylist(), top["n"].to_pylist()))
        own = {bytes(r["word"]): r["n"] for r in counts.select("word", "n").orderBy(F.desc("n"), "word").limit(WORDS).collect()}
        for word, n in own.items():
            totals[self.slot(hash_of(word))] -= n
        self.totals = [float(np.log(max(1, totals.get(k, 0)))) for k in range(self.size)]
        self.logs = {w: float(np.log(n)) - self.totals[self.slot(hash_of(w))] for w, n in frequent.items()} | dict.fromkeys(own, 0.0)
        #: The words that are not in logs, and whose counts' logarithms are not 0.
        self.rest = counts.filter((F.col("n") >= 2) & ~often).select("h", F.round(F.log("n") * _LOG_SCALE).cast("long").alias("log"))

    def slot(self, h: int) -> int:
        return (h + (1 << 63)) % self.size

    def sender(self):
        """A function from words to the sum of their logarithms, and the hashes of words whose counts it lacks."""
        logs, totals, size = self.logs, self.totals, self.size

        def of(words: list[bytes]) -> tuple[float, list[int]]:
            found = list(map(logs.get, words))
            if None not in found:
                return sum(found), []
            lacking = [hash_of(w) for w, x in zip(words, found) if x is None]
            return sum(x for x in found if x is not None) - sum(totals[(h + (1 << 63)) % size] for h in lacking), lacking

        return of

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rest"}


def trained(docs: DataFrame, words: Vocabulary) -> np.ndarray:
    """The average of the partitions' networks, weighted by their numbers of words."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        encode, network, seen, held = shared.value.encoder(), Network(), 0, []

        def step(flat):
            at, around = windows_of(flat)
            target = flat[at]
            for i in range(0, len(target), BATCH):
                network.train(around[:, i : i + BATCH], target[i : i + BATCH], RATE)
            return len(target)

        for batch in batches:
            held.append(encode([words_of(t) for t in common.texts(batch)]))
            if sum(map(len, held)) >= 4 * BATCH:
                seen += step(np.concatenate(held))
                held = []
        if held:
            seen += step(np.concatenate(held))
        if seen:
            weights = np.round(network.flat.astype(np.float64) * _SCALE).astype(np.int64) * seen
            for i in range(0, SIZE, 1 << 15):
                part = weights[i : i + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part), pa.array(np.full(len(part), seen))], names=["i", "w", "n"])

    sums = docs.mapInArrow(run, "i int, w long, n long").groupBy("i").agg((F.sum(F.col("w").cast("decimal(20,0)")).cast("double") / F.sum("n")).alias("w")).toArrow()
    if not sums.num_rows:
        return Network().flat
    out = np.zeros(SIZE)
    out[sums["i"].to_numpy()] = sums["w"].to_numpy() / _SCALE
    return out.astype(np.float32)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_likelihood (the sum over words) and mean_log_likelihood of every document."""
    common.tuned(docs.sparkSession)
    scratch = common.Scratch()
    texts = docs.select("text")
    counts = scratch.written(counted(texts), "words")
    words = vocabulary(counts)
    weights = trained(texts, words)
    shares = Shares(counts, words)
    shared = docs.sparkSession.sparkContext.broadcast((words, weights, shares))

    def make():
        vocabulary, flat_weights, shares = shared.value
        network, encode, sent = Network(flat_weights), vocabulary.encoder(), shares.sender()
        row = TaskContext.get().partitionId() << 40

        def step(batch):
            nonlocal row
            found = [words_of(t) for t in common.texts(batch)]
            flat, counts = encode(found), np.array(list(map(len, found)))
            at, around = windows_of(flat)
            target = flat[at]
            parts = [network.log_chances(around[:, i : i + SCORED], target[i : i + SCORED]) for i in range(0, len(target), SCORED)]
            running = np.concatenate([[0.0], np.cumsum(np.concatenate(parts))]) if parts else np.zeros(1)
            ends = np.cumsum(counts)
            more, lacking = zip(*map(sent, found))
            rows = np.arange(row, row + len(found))
            row += len(found)
            return {"row": rows, "doc_id": batch.column("doc_id"), "n_words": counts, "known": running[ends] - running[ends - counts] + more, "lacking": list(lacking)}

        return step

    kinds = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("known", pa.float64()), ("lacking", pa.list_(pa.int64()))]
    known = common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "row long, doc_id long, n_words long, known double, lacking array<long>", kinds)
    known = scratch.written(known, "known")
    joined = known.select("row", F.explode("lacking").alias("h")).join(shares.rest, "h").groupBy("row").agg(F.sum("log").alias("log"))
    scores = known.select("row", "doc_id", "n_words", "known").join(joined, "row", "left")
    scores = scores.withColumn("log_likelihood", F.col("known") + F.coalesce(F.col("log") / _LOG_SCALE, F.lit(0.0)))
    scores = scores.select("doc_id", "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_likelihood"))
    return scores


def op3(spark, sf_dir):
    return score(common.table(spark, sf_dir, "documents", "doc_id", "text"))
