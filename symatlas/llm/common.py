"""Shared helpers: table access, Arrow batches, tables written to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from symatlas.session import shared_folder, shipped

#: Rows and bytes of one Arrow batch that a Python worker holds at a time.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Ship the package and bound the Arrow batches, so that very long texts don't meet in one batch."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def map_batches(frame: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Apply make()(batch) to each Arrow batch; it returns one list or array for each field."""
    tuned(frame.sparkSession)
    out = pa.schema([pa.field(name, kind) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                columns = step(batch)
                yield pa.RecordBatch.from_arrays([_array(columns[name], kind) for name, kind in fields], schema=out)

    return frame.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null is empty."""
    return [x if x is not None else b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def numbered(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with numbers as the names of all columns but `own`, and a function that gives the names back.

    Further columns may so have any names, those that an operator uses itself or that hold dots included.
    """
    names = [c if c in own else f"c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda frame: frame.select(*names).toDF(*docs.columns)


def pressed(frame: DataFrame, names: list[str], level: int = 3) -> DataFrame:
    """The frame with its text column as a binary column z, compressed for a shuffle; null stays null."""
    import zstandard

    tuned(frame.sparkSession)
    fields = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        press = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            z = [press.compress(t) if t is not None else None for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(z, pa.binary())], names=[*names, "z"])

    return frame.select(*names, "text").mapInArrow(run, f"{fields}, z binary")


def unpressed(values: list) -> list[bytes]:
    """Texts of a column z; null is empty."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    return [press.decompress(z, max_output_size=1 << 31) if z is not None else b"" for z in values]


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it again: cuts the lineage, survives lost executors."""
    return Scratch().written(frame, name)


class Scratch:
    """Tables in the shared folder that go when they have been used."""

    def __init__(self):
        self.tables: list[tuple[DataFrame, str]] = []

    def written(self, frame: DataFrame, name: str, **options: str) -> DataFrame:
        spark = frame.sparkSession
        path = f"{shared_folder(spark)}/symatlas/{name}-{uuid.uuid4().hex}"
        frame.write.options(**options).parquet(path)
        out = spark.read.schema(frame.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *keep: DataFrame) -> None:
        """Delete all tables but those that something still reads."""
        rest = []
        for frame, path in self.tables:
            if any(frame is k for k in keep):
                rest.append((frame, path))
                continue
            context = frame.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        self.tables = rest


def word_ids(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Numbers of the words by first appearance, and how many differ."""
    seen = dict.fromkeys(words)
    for i, word in enumerate(seen):
        seen[word] = i
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words)), len(seen)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
