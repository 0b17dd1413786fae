"""Language identification with string kernels (operator 6).

The kernel of two texts is the number of byte n-grams (1 to ORDER long, A-Z lower-cased) present in
both, over the root of the product of how many each has: a blended-spectrum presence kernel, over the
n-grams that occur in the landmarks. LANDMARKS texts of each language serve as Nystroem landmarks;
kernel ridge regression on the Nystroem features, one language against the rest, is fitted on a bounded
sample: PER_LANGUAGE texts, of at most SAMPLE_BYTES, of each of the LANGUAGES most frequent languages, fewer
of each where that would be over SAMPLE texts or ALL_LANDMARKS landmarks. A language that has longer texts
only is learned from its shortest. Batches of texts are scored by
matrix products: presence by landmarks, then by the regression.

Defined results: a null text, or one without a letter, is "und" with score 0, and so is every text if
no row can be learned from; repeated rows are judged alike; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, sampling

ORDER = 3
LANDMARKS = 48
PER_LANGUAGE = 400
LANGUAGES, SAMPLE, ALL_LANDMARKS = 512, 4096, 1024
SAMPLE_BYTES = 1 << 16
RIDGE = 1e-3
SHARPNESS = 4.0
UNKNOWN = "und"
_ROWS = 128
_LETTER = re.compile(r"[^\W\d_]")


def grams(text: bytes) -> list[np.ndarray]:
    """Codes of the text's byte n-grams for n = 1 .. ORDER, with repeats."""
    raw = np.frombuffer(text.lower(), np.uint8).astype(np.int32)
    out, code = [], raw
    for n in range(1, ORDER + 1):
        if n > 1:
            code = code[:-1] * 256 + raw[n - 1 :]
        out.append(code)
    return out


class Kernel:
    """Presence vectors over the landmarks' n-grams."""

    def __init__(self, landmarks: list[bytes]):
        found = [np.unique(np.concatenate([g[n] for g in map(grams, landmarks)] or [np.empty(0, np.int32)])) for n in range(ORDER)]
        self.codes = found
        self.size = sum(map(len, found))
        self._tables = None
        self.landmarks = self.presence(landmarks)
        self.landmarks /= np.sqrt(np.maximum(1, self.landmarks.sum(1, keepdims=True)))

    def __getstate__(self):
        return {**self.__dict__, "_tables": None}

    def tables(self) -> list[np.ndarray]:
        """Column of each n-gram code, size for none; built once in each worker."""
        if self._tables is None:
            self._tables, at = [], 0
            for n, codes in enumerate(self.codes):
                table = np.full(256 ** (n + 1), self.size, np.int32)
                table[codes] = np.arange(at, at + len(codes))
                at += len(codes)
                self._tables.append(table)
        return self._tables

    def presence(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.size + 1), np.float32)
        for row, text in zip(out, texts):
            for table, codes in zip(self.tables(), grams(text)):
                row[table[codes]] = 1
        return out[:, : self.size]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        x = self.presence(texts)
        return (x @ self.landmarks.T) / np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))


class Model:
    def __init__(self, rows: list[tuple[str, bytes]]):
        self.languages = sorted({lang for lang, _ in rows})
        if not rows:
            return
        chosen, seen = [], dict.fromkeys(self.languages, 0)
        each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(self.languages)))
        for lang, text in rows:
            if seen[lang] < each:
                seen[lang] += 1
                chosen.append(text)
        self.kernel = Kernel(chosen)
        own = self.kernel(chosen).astype(float)
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        good = values > 1e-6 * values[-1]
        mapping = vectors[:, good] / np.sqrt(values[good])
        x = np.concatenate([self.kernel([t for _, t in rows[i : i + _ROWS]]) for i in range(0, len(rows), _ROWS)]) @ mapping
        y = np.array([[1.0 if lang == other else -1.0 for other in self.languages] for lang, _ in rows])
        weight = np.array([1.0 / sum(lang == r[0] for r in rows) for lang in self.languages])
        w = weight[[self.languages.index(lang) for lang, _ in rows]][:, None]
        self.offset = (w * y).sum(0) / w.sum()
        fitted = np.linalg.solve(x.T @ (w * x) + RIDGE * np.eye(x.shape[1]), x.T @ (w * (y - self.offset)))
        self.weights = (mapping @ fitted).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        for at in range(0, len(known), _ROWS):
            part = known[at : at + _ROWS]
            margin = SHARPNESS * (self.kernel([texts[i].encode() for i in part]) @ self.weights + self.offset)
            chance = np.exp(margin - margin.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            for i, best, row in zip(part, chance.argmax(1), chance):
                names[i], scores[i] = self.languages[best], float(row[best])
        return names, scores


def learned(docs: DataFrame) -> Model:
    """The model from a bounded sample of the rows with a language that are not held out."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~sampling.held_out(F.col("doc_id")))
    size = F.octet_length("text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(size <= SAMPLE_BYTES).alias("short")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return Model([])
    h = F.xxhash64("doc_id", "text").alias("h")
    short, long = ([r["lang"] for r in counts if bool(r["short"]) == wanted] for wanted in (True, False))
    sample = sampling.by_label(rows.filter(F.col("lang").isin(short) & (size <= SAMPLE_BYTES)), "lang", min(PER_LANGUAGE, SAMPLE // len(counts)), "doc_id", "text").select("lang", "text", h).collect()
    if long:
        sample += rows.filter(F.col("lang").isin(long)).groupBy("lang").agg(F.min_by(F.struct("text", h), F.struct(size, h)).alias("s")).select("lang", "s.*").collect()
    return Model([(r["lang"], r["text"].encode()) for r in sorted(sample, key=lambda r: (r["h"], r["text"])) if _LETTER.search(r["text"])])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; doc_id, text and lang come in."""
    common.tuned(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs))

    def make():
        model = shared.value

        def step(batch):
            names, scores = model.predict(batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": names, "score": scores}

        return step

    kinds = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
    return common.map_batches(docs.select("doc_id", sampling.held_out(F.col("doc_id")).alias("held_out"), "text"), make, "doc_id long, held_out boolean, lang_pred string, score double", kinds)


def op6(spark, sf_dir):
    return identify(common.table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
