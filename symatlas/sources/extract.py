"""Source text to relations: one Arrow pass over the files, then plain projections."""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from symatlas.functions import paths
from symatlas.session import shipped, spread

from .scanner import Scan

_INT, _TEXT, _BOOL = pa.int32(), pa.string(), pa.bool_()
_PARAMETER = pa.struct([("name", _TEXT), ("type", _TEXT)])
_SYMBOL = pa.struct(
    [(n, _INT) for n in ("ordinal", "start_line", "start_col", "end_line", "end_col", "sel_line", "sel_col", "sel_end_col")]
    + [(n, _TEXT) for n in ("name", "kind", "visibility", "detail", "extension_receiver", "parent_fq_name", "owner", "return_type", "documentation")]
    + [(n, _BOOL) for n in ("deprecated", "is_sealed", "is_typealias")]
    + [("type_params", pa.list_(_TEXT)), ("parameters", pa.list_(_PARAMETER))]
)
_TABLES = {
    "symbols": _SYMBOL,
    "imports": pa.struct([("seq", _INT), ("line", _INT), ("full_path", _TEXT), ("local_name", _TEXT), ("is_star", _BOOL)]),
    "supers": pa.struct([("line", _INT), ("sub_name", _TEXT), ("super_name", _TEXT), ("type_args", pa.list_(_TEXT)), ("super_kind", _TEXT)]),
    "calls": pa.struct([("caller_key", _TEXT), ("callee_key", _TEXT), ("line", _INT)]),
    "annotations": pa.struct([("symbol_name", _TEXT), ("annotation", _TEXT)]),
    "types": pa.struct([("line", _INT), ("var", _TEXT), ("type", _TEXT)]),
    "errors": pa.struct([("line", _INT), ("col", _INT), ("message", _TEXT)]),
    "steps": pa.struct([("caller_key", _TEXT), ("seq", _INT), ("depth", _INT), ("kind", _TEXT), ("label", _TEXT), ("line", _INT)]),
    "lambdas": pa.struct([(n, _INT) for n in ("id",)] + [("ancestors", pa.list_(_INT))] + [(n, _INT) for n in ("line", "col", "end_line", "end_col")] + [("receiver", _TEXT), ("method", _TEXT), ("names", pa.list_(_TEXT))]),
    "tokens": pa.struct([("line", _INT), ("col", _INT), ("text", _TEXT), ("ctx", pa.list_(_TEXT))]),
}


#: Files whose relations a Python worker holds at a time.
FILES = 128


def scanned(files: DataFrame, *only: str) -> DataFrame:
    """A row for each file (uri, text) with its package and an array of rows for each relation, or for those that are named.

    Files are spread over all cores, as parsing takes much longer than reading.
    """
    shipped(files.sparkSession)
    tables = {n: t for n, t in _TABLES.items() if not only or n in only}
    schema = pa.schema([("uri", _TEXT), ("lang", _TEXT), ("package", _TEXT), ("content_hash", pa.int64()), *((n, pa.list_(t)) for n, t in tables.items())])

    def run(batches):
        for batch in (b.slice(i, FILES) for b in batches for i in range(0, b.num_rows, FILES)):
            scans = [Scan(u or "", t or "") for u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = [batch.column(0), pa.array([s.language for s in scans], _TEXT), pa.array([s.package for s in scans], _TEXT), batch.column(2)]
            for name, kind in tables.items():
                rows = [getattr(s, name)() if name in ("steps", "lambdas", "tokens") else getattr(s, name) for s in scans]
                columns.append(pa.array(rows, pa.list_(kind)))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    from pyspark.sql.pandas.types import from_arrow_schema

    return spread(files.select("uri", "text"), "uri").select("uri", "text", F.xxhash64("text")).mapInArrow(run, from_arrow_schema(schema))


def files(scan: DataFrame, texts: DataFrame) -> DataFrame:
    flags = texts.select("uri", paths.generated(F.col("uri"), F.col("text")).alias("generated"))
    return scan.select("uri", "lang", "package", "content_hash").join(flags, "uri")


def relation(scan: DataFrame, name: str) -> DataFrame:
    """symbols, imports, supers, calls, annotations, types, errors, steps or tokens, with the file's uri."""
    out = scan.select("uri", F.explode(name).alias("r")).select("uri", "r.*")
    if name == "symbols":
        out = out.withColumn("symbol_id", F.xxhash64("uri", "sel_line", "sel_col", "name"))
    return out


def lines(texts: DataFrame) -> DataFrame:
    return texts.select("uri", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def checked(scan: DataFrame) -> DataFrame:
    """(uri, errors): how many syntax errors each file has."""
    return scan.select("uri", F.size("errors").alias("errors"))


def imported_from(texts: DataFrame, full_path: str, name: str) -> DataFrame:
    """(uri, line, kind): where a name that is imported by a path is declared, found by file names; only files that may hold it are scanned.

    Files are named after the path's last capitalised segment but one, or its last, below the folders of its package, else
    anywhere; the first of these ways that leads to the name counts, and in it files of the package come before others.
    """
    segments = full_path.split(".")
    package = list(itertools.takewhile(lambda s: s[:1].islower(), segments))
    stems = [s for s in segments if s[:1].isupper()][-2:]
    ways = [F.when(F.col("uri").rlike(rf"(^|/){prefix}{re.escape(stem)}\.(kt|java|swift)$"), 2 * i + k) for i, stem in enumerate(stems) for k, prefix in enumerate(("/".join(map(re.escape, package)) + "/" if package else "", ""))]
    if not ways:
        return texts.select("uri", F.lit(0).alias("line"), F.lit("").alias("kind")).limit(0)
    near = texts.withColumn("way", F.coalesce(*ways)).filter("way is not null")
    scan = scanned(near)
    found = relation(scan, "symbols").filter(F.col("name") == name).join(scan.select("uri", "package"), "uri").join(near.select("uri", "way"), "uri")
    other = ~F.col("package").eqNullSafe(F.lit(".".join(package) or None))
    rank = F.struct("way", other.alias("other"), "uri", "sel_line")
    best = found.agg(F.min_by(F.struct("uri", F.col("sel_line").alias("line"), "kind"), rank).alias("best"))
    return best.filter("best is not null").select("best.*")
