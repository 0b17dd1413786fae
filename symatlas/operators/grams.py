"""A trigram index: text searches look at the rows that hold all trigrams of what they search, and at nothing else.

Trigrams are of the lower-cased text, so the index serves searches in any case; what it leaves is checked
against the text itself. Texts lie in the order of their ids, trigrams in their own order, a frequent one
spread by id, so that a search reads the row groups of its trigrams, and those of the ids that are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

N = 3
#: Trigrams of a search that are looked up: all must be there, and so many leave few other rows.
LOOKED_UP = 12
#: Characters of texts whose trigrams are gathered at once, but for those of one text.
CHARS = 1 << 20
#: No ASCII character.
BETWEEN = "\uffff"


def grams_of(text: str) -> list[str]:
    """Trigrams of a text to search, spread over it; of ASCII letters only, as others are lower-cased by what stands beside them."""
    low = text.lower()
    found = [g for g in dict.fromkeys(low[i : i + N] for i in range(len(low) - N + 1)) if g.isascii()]
    step = max(1, -(-len(found) // LOOKED_UP))
    return found[::step]


def write_grams(texts: DataFrame, path: str) -> None:
    """Store (id, text, further columns) with the ASCII trigrams of every text; null texts have none.

    A row is a trigram with the ids of some texts that hold it.
    """
    held = texts.select("id", F.lower("text").alias("low"))
    schema = pa.schema([("gram", pa.string()), ("ids", pa.list_(to_arrow_schema(held.select("id").schema).field(0).type))])

    def gathered(ids, lows):
        """The texts' trigrams with the ids that have them; no trigram holds the mark between two texts, as it is none of ASCII."""
        codes = np.frombuffer(BETWEEN.join(lows).encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(lows)), [len(low) + 1 for low in lows])[: len(codes)]
        ascii_ = codes < 128
        whole = ascii_[:-2] & ascii_[1:-1] & ascii_[2:]
        keys = np.unique(((codes[:-2] << 14 | codes[1:-1] << 7 | codes[2:]) << 32 | row[: max(0, len(row) - 2)])[whole])
        found, starts = np.unique(keys >> 32, return_index=True)
        text = [chr(g >> 14) + chr(g >> 7 & 127) + chr(g & 127) for g in found.tolist()]
        held = ids.take(pa.array(keys & 0xFFFFFFFF))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), held).cast(schema.field(1).type)
        return pa.RecordBatch.from_arrays([pa.array(text, pa.string()), lists], schema=schema)

    def run(batches):
        for batch in batches:
            lows, start, size = batch.column("low"), 0, 0
            for i, n in enumerate(pc.coalesce(pc.utf8_length(lows), 0).to_pylist()):
                size += n + 1
                if size >= CHARS or i + 1 == len(lows):
                    part = slice(start, i + 1)
                    yield gathered(batch.column("id")[part], [low or "" for low in lows[part].to_pylist()])
                    start, size = i + 1, 0

    held.mapInArrow(run, f"gram string, ids array<{held.schema['id'].dataType.simpleString()}>").write.mode("overwrite").parquet(f"{path}/found")
    rows = texts.sparkSession.read.parquet(f"{path}/found").withColumn("first", F.get("ids", F.lit(0)))
    rows.repartitionByRange("gram", "first").sortWithinPartitions("gram", "first").drop("first").write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(f"{path}/grams")
    texts.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(f"{path}/texts")


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame | None:
    """(id) of the rows that hold all looked-up trigrams of a text; None where it has no trigram, so that any row may hold it."""
    wanted = grams_of(needle)
    if not wanted:
        return None
    found = spark.read.parquet(f"{path}/grams").filter(F.col("gram").isin(wanted)).select("gram", F.explode("ids").alias("id"))
    return found if len(wanted) == 1 else found.groupBy("id").agg(F.countDistinct("gram").alias("n")).filter(F.col("n") == len(wanted))


def rows_with(spark: SparkSession, path: str, needle: str, *more: Column) -> DataFrame:
    """The stored rows that may hold a text, and pass further conditions: the text itself is still to be checked."""
    texts, ids = spark.read.parquet(f"{path}/texts"), candidates(spark, path, needle)
    for condition in more:
        texts = texts.filter(condition)
    return texts if ids is None else texts.join(ids.select("id"), "id", "left_semi")
