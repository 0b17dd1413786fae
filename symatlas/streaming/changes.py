"""Live document changes as streams: debounce, content-hash state, tombstones, overlays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from symatlas.session import shipped

DEBOUNCE = "300 milliseconds"


def debounced(changes: DataFrame, gap: str = DEBOUNCE, lateness: str = "10 seconds") -> DataFrame:
    """(uri, start, end, text, n): the last text of each burst of changes (uri, ts, text).

    On a stream a burst is closed, and put out, when the watermark passes it.
    """
    marked = changes.withWatermark("ts", lateness) if changes.isStreaming else changes
    grouped = marked.groupBy("uri", F.session_window("ts", gap).alias("burst"))
    return grouped.agg(F.max_by("text", "ts").alias("text"), F.count("*").alias("n")).select("uri", "burst.start", "burst.end", "text", "n")


def _unseen(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = []
    for frame in frames:
        for ts, op, text in sorted(zip(frame["ts"], frame["op"], frame["text"]), key=lambda r: (r[0], r[1])):
            if op == "close":
                last = None
                rows.append((key[0], ts, "close", None))
            elif op == "delete":
                last = None
                rows.append((key[0], ts, "tombstone", None))
            elif (name := hashlib.md5((text or "").encode()).hexdigest()) != last:
                last = name
                rows.append((key[0], ts, "index", text))
    if last is None:
        state.remove() if state.exists else None
    else:
        state.update((last,))
    yield pd.DataFrame(rows, columns=["uri", "ts", "op", "text"])


def changed_content(changes: DataFrame) -> DataFrame:
    """Changes (uri, ts, op, text) whose text differs from the last one seen; A, B, A gives three rows.

    The state of a document is a 128-bit hash of its text; a null text is an empty one.

    op is change, delete (a tombstone comes out and the state goes) or close.
    """
    shipped(changes.sparkSession)
    keyed = changes.select("uri", "ts", "op", "text").groupBy("uri")
    return keyed.applyInPandasWithState(_unseen, "uri string, ts timestamp, op string, text string", "last string", "append", GroupStateTimeout.NoTimeout)


def changed_runs(changes: DataFrame) -> DataFrame:
    """changed_content for a batch, by a window: the rows that differ from the row before."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("uri").orderBy("ts", "seq"))
    return changes.withColumn("before", before).filter(~F.col("text").eqNullSafe(F.col("before"))).drop("before")


def current_generation(rows: DataFrame) -> DataFrame:
    """Results of the newest generation of each uri; late ones of older generations go."""
    newest = rows.groupBy("uri").agg(F.max("generation").alias("generation"))
    return rows.join(newest, ["uri", "generation"])


def overlaid(base: DataFrame, live: DataFrame) -> DataFrame:
    """(uri, text) with unsaved text before indexed text."""
    return base.withColumnRenamed("text", "base").join(live.withColumnRenamed("text", "live"), "uri", "full").select("uri", F.coalesce("live", "base").alias("text"))


def change_files(spark, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of change rows from JSON files that appear in a folder; the first files come first."""
    schema = "uri string, ts timestamp, op string, text string, generation long"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)
