import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from symatlas.llm import token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


PARTS = ["word", "Word's", "don't", "I'LL", "'s", "'", " ", "  ", "\n", "\t", "\r\n", " \n ", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "a1b2", "3.14", "9th", ".", "...", "!?", "<|endoftext|>", "<|end", "oftext|>", "|", "<",
         "ñezll", "été", "漢字かな", "。", "🙂", "é", "_x_", "x" * 50, "​", "0", "٣", "Ⅷ", "﻿", ";", "a,b"]


def test_pieces_add_up(library):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert token_counts.Counter(PATH)(texts) == [library(t) for t in texts]


def test_long_texts_are_cut_at_boundaries(library, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG", 100)
    monkeypatch.setattr(token_counts, "GATHER", 300)
    monkeypatch.setattr(token_counts, "REMEMBERED", 20)
    rng = random.Random(8)
    texts = ["".join(rng.choice(PARTS) for _ in range(400)) for _ in range(40)] + ["x" * 5000, " " * 5000, "ab12" * 1000, None, ""]
    assert all("".join(token_counts.chunks(t, 100)) == t for t in texts if t)
    assert token_counts.Counter(PATH)(texts) == [library(t) if t else 0 for t in texts]


def test_balanced_batches():
    rng = random.Random(9)
    pieces = ["é" * rng.randint(1, 40) for _ in range(2000)]
    batches = token_counts.balanced(pieces, 4096)
    sizes = [sum(len(p.encode()) for p in b) for b in batches]
    assert sorted(p for b in batches for p in b) == sorted(pieces)
    assert max(sizes) <= 4096 + 80 and max(sizes) - min(sizes) <= 80
    assert token_counts.balanced([]) == []


def test_counted_keeps_columns(spark, docs, library):
    texts = ["one two", None, "", "tail <|endoftext|> x", "w " * 600, "one two"]
    frame = docs([(None if i == 3 else i, t) for i, t in enumerate(texts)]).withColumnRenamed("spans", "n_tokens")
    got = token_counts.counted(frame, PATH).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "n_bytes", "n_tokens", "over_limit"}
    assert [(r["text"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got] == [(t, len(t or ""), library(t) if t else 0, t is not None and len(t) > 1000) for t in texts]
    assert token_counts.counted(frame.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_are_encoded_whole(name):
    path = str(public_tokenizers.path(name))
    texts = ["One two, three  four", "été 12ab", "", None]
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(model.encode(t)) if t else 0 for t in texts]
    else:
        tokenizer = Tokenizer.from_file(path)
        want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert token_counts.Counter(path)(texts) == want


def test_op11(spark, library):
    got = {r["doc_id"]: r for r in token_counts.op11(spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(texts)
    for r in texts:
        n = library(r["text"] or "")
        assert got[r["doc_id"]][1:] == (len((r["text"] or "").encode()), n, n > 512)
