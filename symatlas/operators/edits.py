"""Text edits: strict UTF-16 ranges, rename, unified differences."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from symatlas.session import shipped


def offset(line: str, column: int) -> int | None:
    """Index of a UTF-16 column in a line; None beyond the line or inside a character of two units."""
    units = 0
    for i, c in enumerate(line):
        if units == column:
            return i
        units += 2 if c > "￿" else 1
        if units > column:
            return None
    return len(line) if units == column else None


def applied(text: str, edits: list[dict]) -> tuple[str | None, str | None]:
    """The edited text, or what is wrong: a range outside the text, reversed, or overlapping another."""
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    ranges = []
    for e in edits:
        ends = []
        for l, c in ((e["start_line"], e["start_col"]), (e["end_line"], e["end_col"])):
            at = offset(lines[l], c) if 0 <= l < len(lines) else None
            if at is None:
                return None, f"no place {l}:{c}"
            ends.append(starts[l] + at)
        if ends[0] > ends[1]:
            return None, "reversed range"
        ranges.append((*ends, e["new_text"]))
    ranges.sort(key=lambda r: r[:2])
    if any(b[0] < a[1] for a, b in zip(ranges, ranges[1:])):
        return None, "overlapping ranges"
    for start, end, new in reversed(ranges):
        text = text[:start] + new + text[end:]
    return text, None


def preview(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """(uri, text, error, diff): each file (uri, text) with its edits applied together; nothing is written."""
    shipped(texts.sparkSession)
    per_file = edits.groupBy("uri").agg(F.collect_list(F.struct("start_line", "start_col", "end_line", "end_col", "new_text")).alias("edits"))
    schema = pa.schema([(n, pa.string()) for n in ("uri", "text", "error", "diff")])

    def run(batches):
        for batch in batches:
            rows = []
            for uri, text, list_ in zip(*(batch.column(k).to_pylist() for k in range(3))):
                new, error = applied(text or "", list_)
                rows.append((uri, new, error, unified(text or "", new, uri) if new is not None else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ((),) * 4)], schema=schema)

    return texts.select("uri", "text").join(per_file, "uri").mapInArrow(run, "uri string, text string, error string, diff string")


def unified(before: str, after: str, label: str) -> str:
    return "\n".join(difflib.unified_diff(before.split("\n"), after.split("\n"), f"a/{label}", f"b/{label}", lineterm=""))


def rename_edits(tokens: DataFrame, name: str, new_name: str, scope: DataFrame | None = None) -> DataFrame:
    """Edits that replace every whole occurrence of a name, in the files of a scope (uri) if one is given."""
    found = tokens.filter(F.col("text") == name)
    if scope is not None:
        found = found.join(scope.select("uri").distinct(), "uri", "left_semi")
    return found.select("uri", F.col("line").alias("start_line"), F.col("col").alias("start_col"), F.col("line").alias("end_line"), (F.col("col") + len(name)).alias("end_col"), F.lit(new_name).alias("new_text"))


def overlapping(edits: DataFrame) -> DataFrame:
    """Files with edits that overlap, by a look at the next edit."""
    w = Window.partitionBy("uri").orderBy("start_line", "start_col", "end_line", "end_col")
    nxt = F.lead(F.struct("start_line", "start_col")).over(w)
    return edits.withColumn("next", nxt).filter(F.col("next") < F.struct(F.col("end_line").alias("start_line"), F.col("end_col").alias("start_col"))).select("uri").distinct()
