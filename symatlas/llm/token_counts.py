"""Token counts of whole texts (operator 11).

Texts are encoded in Arrow batches and only lengths leave a worker. A text is cut at safe boundaries,
places where the vocabulary's pre-tokenisation always starts anew, so that the lengths of the pieces add
up to the length of the text. Equal pieces of a batch are encoded once, in batches that are balanced by
bytes, and the lengths of short pieces are remembered in a worker. Nothing is shuffled or collected;
a worker holds GATHER characters of pieces, the ids of BATCH bytes, and at most REMEMBERED lengths.

Boundaries are known for byte-level vocabularies without a normaliser: between a character that is no
white space and ASCII white space, between ASCII letters and digits, and before punctuation that follows
a letter. A special token's string holds none of them, so it stays in one piece and counts as the library
counts it. With any other vocabulary texts are encoded whole.

Defined results: null is empty, no bytes and no tokens; repeated rows are counted one by one; a text
without any safe boundary is encoded whole, however long; an empty table gives an empty result; a null
doc_id stays null; further columns are ignored by op11 and returned unchanged by counted(), where a
column of an output's name is replaced.
"""

from __future__ import annotations

import heapq
import json
import os
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common
from .packing import vocabulary_path

LIMIT = 512
#: Bytes of texts that are encoded together; characters of pieces held before they are encoded.
BATCH, GATHER = 1 << 18, 1 << 22
#: Characters after which a long text is cut at the next boundary.
LONG = 1 << 20
#: Lengths that a worker remembers, and their characters.
REMEMBERED, REMEMBERED_CHARS = 1 << 19, 1 << 24

#: Before ASCII white space that follows a character that is no white space.
SPACED = re.compile(r"(?<=\S)(?=[ \t-\r])")
#: These, before punctuation after an ASCII letter, and between ASCII letters and digits.
SAFE = re.compile(r"(?<=\S)(?=[ \t-\r])|(?<=[A-Za-z])(?=[.,;:!?0-9])|(?<=[0-9])(?=[A-Za-z.,;:!?])")


def chunks(text: str, long: int = LONG):
    """The text in parts of about `long` characters that end at safe boundaries."""
    start = 0
    while len(text) - start > long:
        found = SPACED.search(text, start + long) or SAFE.search(text, start + long)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def balanced(pieces: list[str], most: int = BATCH) -> list[list[str]]:
    """The pieces in batches of near-equal bytes: the longest first, each to the batch with fewest so far."""
    sizes = [len(p.encode()) for p in pieces]
    n = max(1, -(-sum(sizes) // most))
    out: list[list[str]] = [[] for _ in range(n)]
    heap = [(0, i) for i in range(n)]
    for k in sorted(range(len(pieces)), key=sizes.__getitem__, reverse=True):
        held, i = heap[0]
        out[i].append(pieces[k])
        heapq.heapreplace(heap, (held + sizes[k], i))
    return [b for b in out if b]


def splittable(spec: dict) -> bool:
    """Whether the boundaries hold for a vocabulary file: byte-level pre-tokenisation by its own pattern, nothing added or normalised."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    whole = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) and not SAFE.search(t["content"]) for t in spec.get("added_tokens", []))
    return plain and whole and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))


def lengths_of(path: str):
    """(texts to numbers of tokens, whether texts may be cut at safe boundaries) for a vocabulary file of either library."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: list(map(len, tokenizer.encode_batch_fast(texts, add_special_tokens=False))), splittable(json.load(open(path, encoding="utf-8")))


class Counter:
    """Counts the tokens of texts with one vocabulary; keeps the lengths of short pieces from batch to batch."""

    def __init__(self, path: str):
        self.encode, self.cut = lengths_of(path)
        self.known: dict[str, int] = {}
        self.chars = 0

    def __call__(self, texts: list[str | None]) -> list[int]:
        out, held, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            for chunk in chunks(text) if self.cut and text else (text or "",):
                held.append((i, SAFE.split(chunk) if self.cut else [chunk]))
                size += len(chunk)
                if size >= GATHER:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, list[str]]], out: list[int]) -> None:
        known = self.known
        fresh = list(dict.fromkeys(p for _, pieces in held for p in pieces if p not in known))
        for batch in balanced(fresh):
            known.update(zip(batch, self.encode(batch)))
        for i, pieces in held:
            out[i] += sum(map(known.__getitem__, pieces))
        self.chars += sum(map(len, fresh))
        if len(known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            known.clear()
            self.chars = 0


#: Counters of this worker by vocabulary file; a worker that serves several tasks loads a file once.
_COUNTERS: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


_OUT = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]


def counted(docs: DataFrame, path: str | None = None, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """The rows with n_bytes, n_tokens and over_limit of their texts by the vocabulary file at `path` (.json or .model)."""
    common.tuned(docs.sparkSession)
    docs = docs.drop(*(n for n, _ in _OUT if n != text))
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.columns.index(text)
    held = docs.toDF(*names)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))

    def run(batches):
        count = _counter(path or vocabulary_path())
        for batch in batches:
            column = batch.column(own)
            n_bytes = pc.fill_null(pc.binary_length(column.cast(pa.binary())).cast(pa.int64()), 0)
            n = pa.array(count(column.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n_bytes, n, pc.greater(n, limit)], names=[*names, *(k for k, _ in _OUT)])

    return held.mapInArrow(run, f"{schema}, n_bytes long, n_tokens long, over_limit boolean").toDF(*docs.columns, *(k for k, _ in _OUT))


def op11(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return counted(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")
