"""Data sources for Spark's reader and writer: snapshots of a version-controlled tree, entries of source archives, files written from rows.

    register(spark)
    spark.read.format("symatlas_snapshot").option("ref", "HEAD~1").load("/repo")     # version, path, text
    spark.read.format("symatlas_archive").load("/caches/files-2.1")                  # archive, artifact, entry, content
    rows.write.format("symatlas_files").mode("append").save("/sources")              # from artifact, entry, content

Paths are read where the tasks run, so on a cluster they lie in a folder that all machines share.
"""

from __future__ import annotations

import os
import subprocess
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from symatlas.operators import index
from symatlas.session import shipped

#: Files of a snapshot, and bytes of archives, that a task reads.
FILES, BYTES = 256, 64 << 20
SUFFIXES = (".kt", ".java", ".swift")


def _git(folder: str, *args: str, **more) -> bytes:
    """The output of git in a folder, without what an outer git may have left in the environment."""
    own = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")}
    done = subprocess.run(["git", "-C", folder, *args], capture_output=True, env=own, **more)
    if done.returncode:
        raise ValueError(f"git {' '.join(args)}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


@dataclass
class Files(InputPartition):
    version: str
    paths: list[str]


class SnapshotReader(DataSourceReader):
    """A commit, by its hash so that a task that runs again reads the same, or the working tree with its untracked files."""

    def __init__(self, options: dict):
        self.folder, self.ref = options["path"], options.get("ref", "")
        self.suffixes = tuple(options.get("suffixes", ",".join(SUFFIXES)).split(","))
        self.filters = [f.removeprefix("./").rstrip("/") for f in options.get("below", "").split(",") if f]

    def partitions(self) -> list[InputPartition]:
        commit = _git(self.folder, "rev-parse", "--verify", f"{self.ref}^{{commit}}").decode().strip() if self.ref else ""
        listed = _git(self.folder, "ls-tree", "-r", "-z", "--name-only", commit) if commit else _git(self.folder, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
        found = sorted({p for p in listed.decode("utf-8", "surrogateescape").split("\0") if p.endswith(self.suffixes) and self._wanted(p)})
        return [Files(commit, found[i : i + FILES]) for i in range(0, len(found), FILES)] or [Files(commit, [])]

    def _wanted(self, path: str) -> bool:
        return not self.filters or any(path == f or path.startswith(f + "/") or path.endswith(f) for f in self.filters)

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            if partition.version:
                content = _git(self.folder, "cat-file", "blob", f"{partition.version}:{path}")
            else:
                try:
                    content = (Path(self.folder) / path).read_bytes()
                except OSError:  # listed, but gone from the tree
                    continue
            yield partition.version or "worktree", path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), content.decode("utf-8", "replace")


class Snapshot(DataSource):
    @classmethod
    def name(cls) -> str:
        return "symatlas_snapshot"

    def schema(self) -> str:
        return "version string, path string, text string"

    def reader(self, schema) -> DataSourceReader:
        return SnapshotReader(dict(self.options))


@dataclass
class Archives(InputPartition):
    paths: list[str]


class ArchiveReader(DataSourceReader):
    """The sources in archives, an entry at a time: a task holds one entry, whatever the size of its archive."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.ending = options.get("ending", "-sources.jar")
        self.suffixes = tuple(options.get("suffixes", ".kt,.java").split(","))

    def partitions(self) -> list[InputPartition]:
        found = sorted((os.path.join(d, n), os.path.getsize(os.path.join(d, n))) for d, _, names in os.walk(self.folder) for n in names if n.endswith(self.ending) and not n.endswith("-samples-sources.jar"))
        out, held, size = [], [], 0
        for path, n in found:
            if held and size + n > BYTES:
                out.append(Archives(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Archives(held)]

    def read(self, partition: Archives) -> Iterator[tuple]:
        for path in partition.paths:
            with zipfile.ZipFile(path) as archive:
                for entry in archive.infolist():
                    if not entry.is_dir() and entry.filename.endswith(self.suffixes):
                        yield path, artifact_of(path), entry.filename, archive.read(entry)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "symatlas_archive"

    def schema(self) -> str:
        return "archive string, artifact string, entry string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def artifact_of(path: str) -> str:
    """group.artifact-version of an archive in a cache of downloaded modules, else its name."""
    parts = path.replace("\\", "/").partition("files-2.1")[2].strip("/").split("/")
    if len(parts) >= 3:
        return f"{parts[0]}.{parts[1]}-{parts[2]}"
    name = path.rsplit("/", 1)[-1]
    return name.removesuffix("-sources.jar").removesuffix(".jar")


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceWriter):
    """Each file is written beside its place and moved there, so that a file is whole or absent; a task that runs again leaves the same files."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> WriterCommitMessage:
        count = 0
        for row in rows:
            entry = row["entry"]
            if not safe(entry) or not safe(row["artifact"] or ""):
                continue
            place = Path(self.folder, row["artifact"] or "", entry)
            place.parent.mkdir(parents=True, exist_ok=True)
            beside = place.parent / f".{place.name}.{uuid.uuid4().hex}"
            try:
                beside.write_bytes(row["content"] or b"")
                os.replace(beside, place)
            finally:
                beside.unlink(missing_ok=True)
            count += 1
        return Written(count)

    def commit(self, messages: list) -> None:
        marker = Path(self.folder, "_SUCCESS")
        marker.parent.mkdir(parents=True, exist_ok=True)
        marker.write_text(str(sum(m.files for m in messages if m is not None)))

    def abort(self, messages: list) -> None:
        """Files that are in place are whole and stay; a later write puts the same ones there."""


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "symatlas_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"])


def safe(entry: str) -> bool:
    """Whether a path stays below the folder that it is put in."""
    return not (entry.startswith(("/", "\\")) or ".." in entry)


def register(spark: SparkSession) -> SparkSession:
    for source in (Snapshot, ArchiveSource, FileSink):
        shipped(spark).dataSource.register(source)
    return spark


def snapshots(spark: SparkSession, folder: str, before: str, after: str = "", below: str = "") -> DataFrame:
    """(side, version, path, text) of two versions of a tree; an empty ref is the working tree."""
    register(spark)
    load = lambda ref: spark.read.format("symatlas_snapshot").options(ref=ref, below=below).load(folder)
    return load(before).withColumn("side", F.lit("before")).unionByName(load(after).withColumn("side", F.lit("after")))


def extract_sources(spark: SparkSession, caches: str, folder: str, patterns: tuple[str, ...] = ()) -> DataFrame:
    """Write the sources of the newest version of every artifact below a cache of modules to folder/artifact/entry; (artifact, files) written."""
    register(spark)
    rows = spark.read.format("symatlas_archive").load(caches)
    for pattern in patterns[:1]:
        wanted = F.col("archive").contains(pattern)
        for more in patterns[1:]:
            wanted = wanted | F.col("archive").contains(more)
        rows = rows.filter(wanted)
    meta = F.split(F.ltrim(F.regexp_extract("archive", r"files-2\.1(.*)$", 1), F.lit("/")), "/")
    named = rows.withColumns({"group": F.get(meta, F.lit(0)), "module": F.get(meta, F.lit(1)), "version": F.get(meta, F.lit(2))})
    versions = named.filter("version IS NOT NULL").select("group", F.col("module").alias("artifact"), "version").distinct()
    newest = index.latest_artifacts(versions).withColumnRenamed("artifact", "module")
    kept = named.join(newest, ["group", "module", "version"], "left_semi").unionByName(named.filter("version IS NULL"))
    kept.select("artifact", "entry", "content").write.format("symatlas_files").mode("append").save(folder)
    return kept.groupBy("artifact").agg(F.count("*").alias("files"))
