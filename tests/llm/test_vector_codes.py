import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from symatlas.llm import oracles, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def brute(rows, entries=256):
    """({vec_id: (code, error, label_error)}, digest) in unbounded integers, entry by entry."""
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][1]) // 4
    parts = [[r[1][k * width : (k + 1) * width] for r in kept] for k in range(4)]
    books = [p[:entries] for p in parts]

    def assigned():
        return [[min((sum((x - y) ** 2 for x, y in zip(v, e)), j) for j, e in enumerate(book)) for v in p] for p, book in zip(parts, books)]

    for _ in range(4):
        for k, found in enumerate(assigned()):
            for j in range(len(books[k])):
                own = [v for v, (_, at) in zip(parts[k], found) if at == j]
                if own:
                    books[k][j] = [sum(c) // len(own) for c in zip(*own)]
    found = assigned()
    errors = [sum(f[n][0] for f in found) for n in range(len(kept))]
    out = {}
    for n, (vec_id, _, label) in enumerate(kept):
        out[vec_id] = ("".join(f"{f[n][1]:02x}" for f in found), errors[n], min((1 << 63) - 1, sum(e for e, r in zip(errors, kept) if r[2] == label)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def coded(spark, tmp_path, rows):
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3).write.parquet(path)
    got = vector_codes.op12(spark, str(tmp_path)).collect()
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got}, {r["codebooks_sha256"] for r in got}


@pytest.mark.parametrize("scale", [1.0, 6e4])
def test_op12_equals_brute_force(spark, tmp_path, monkeypatch, scale):
    monkeypatch.setattr(vector_codes, "ENTRIES", 20)
    rng = random.Random(5)
    rows = [(i * 3, [rng.choice([-2.5, -0.3, 0.0, 0.1, 1.7, rng.gauss(0, 1)]) * scale for _ in range(12)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(1000 + i, rows[4][1], 2) for i in range(30)]
    bad = [(-5, None, 1), (-4, [None] + [0.0] * 11, 1), (-3, [float("nan")] * 12, 1), (-2, [float("inf")] * 12, None)]
    want, digest = brute(rows, 20)
    got, digests = coded(spark, tmp_path, rows + bad)
    assert got == want and digests == {digest}


def test_few_uneven_and_no_vectors(spark, tmp_path):
    rows = [(2, [1.0, 2.0, 3.0, 4.0], 1), (1, [0.0, 0.0, 0.5, 0.5], 1), (None, [9.0, 9.0, 9.0, 9.0], None), (5, [1.0], 7), (6, [], 7)]
    got, _ = coded(spark, tmp_path / "few", rows)
    assert got == {1: ("00000000", 0, 0), 2: ("01010101", 0, 0), None: ("02020202", 0, 0), 5: (None, None, 0), 6: (None, None, 0)}
    assert coded(spark, tmp_path / "none", [(1, None, 1)]) == ({}, set())
    assert coded(spark, tmp_path / "odd", [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1)])[0] == {1: ("00000000", 0, 0)}


def test_huge_components(spark, tmp_path):
    rows = [(i, [x * 1e300 for x in (1.0, -1.0, 0.5, i)], 1) for i in range(4)]
    got, _ = coded(spark, tmp_path, rows)
    assert {k: v[1] for k, v in got.items()} == dict.fromkeys(range(4), 0)


def test_search_equals_full_scan():
    rng = np.random.default_rng(1)
    entries = rng.integers(-50, 50, (64, 5))
    entries[10] = entries[3]
    parts = rng.integers(-60, 60, (3000, 5))
    book = vector_codes.Codebook(entries)
    full = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    for start in (np.zeros(3000, np.int64), rng.integers(0, 64, 3000), full.argmin(1)):
        best, least = book.nearest(parts, start)
        assert (best == full.argmin(1)).all() and (least == full.min(1)).all()
    wide = vector_codes.Codebook(entries.astype(object) * 10**200).nearest(parts.astype(object) * 10**200, np.zeros(3000, np.int64))
    assert (wide[0] == full.argmin(1)).all()


def test_packed_round_trip():
    for row in ([0], [-128, 127], [128], [-40000, 5], [1 << 25], []):
        assert vector_codes.unpacked(vector_codes.packed(np.array(row, np.int64))).tolist() == row
    big = np.array([10**30, -7], dtype=object)
    assert vector_codes.unpacked(vector_codes.packed(big)).tolist() == [10**30, -7]


def test_oracle(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    assert sorted(map(tuple, vector_codes.op12(spark, small).collect())) == sorted(con.sql(oracles.VECTOR_CODES).fetchall())
