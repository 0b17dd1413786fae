"""Bounded samples of labelled rows, drawn by hash so that they are the same at every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HELD_OUT = 2
FOLDS = 4


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves the remainder that is kept for testing; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _chance(*keys: str) -> Column:
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / float(1 << 40)).cast("double")


def by_label(rows: DataFrame, label: str, per_label: int, *keys: str) -> DataFrame:
    """About per_label rows (a tenth and a little more) of each label: those whose hash falls below the label's rate.

    One counting aggregation gives the rates; the labels must be few, as they are collected. Rows that
    are alike in all keys have one hash, so twice the rows aimed at are the bound whatever the keys; those of
    the least hashes are taken then, which is the same sample at every run.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    rate = F.lit(0.0)
    for value, count in sorted(counts.items(), key=str):
        rate = F.when(F.col(label) == value, min(1.0, (1.1 * per_label + 20) / count)).otherwise(rate)
    chance = _chance(*keys)
    return rows.filter(chance < rate).orderBy(chance, *keys).limit(max(1, 2 * per_label * len(counts)))


def by_hash(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """About `size` of the rows, twice as many at most, in the proportions of the labels."""
    count = rows.count()
    chance = _chance(*keys)
    return rows.filter(chance < (1.1 * size + 20) / max(1, count)).orderBy(chance, *keys).limit(2 * size)
