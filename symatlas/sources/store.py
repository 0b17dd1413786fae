"""A stored index that is refreshed where it lies: versions, replaced files as layers, merged on read.

    <folder>/data/<layer>/<relation>/bucket=<n>/    rows of a layer, files spread over buckets by the hash of their uri
    <folder>/data/<layer>/gone/bucket=<n>/          (uri) of the files whose rows in earlier layers are no longer valid
    <folder>/versions/<number>/                     one row: the layers of a version, in order

A version counts once its row is there, which a job's commit puts in place by one rename; whoever reads
holds the layers of the version that was current when the reading began, and layers are never changed. So a
reader sees the old version while a new one is written, and a write that is killed leaves folders that no
version names. Two writers of one number both leave a row; the one with the smaller name has won, and the
other fails without having changed anything.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.utils import AnalysisException

BUCKETS = 16
#: Layers of a version after which a replacement merges them.
MANY_LAYERS = 8
_VERSION = "number long, writer string, complete boolean, files long, buckets int, layers array<struct<name:string, relations:map<string,string>>>"


class Conflict(RuntimeError):
    """Another writer has made the version first."""


class Store:
    """The index in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def version(self, number: int | None = None):
        """The row of a version, the current one by default; None where there is no index."""
        try:
            rows = self.spark.read.schema(_VERSION).option("recursiveFileLookup", True).parquet(f"{self.folder}/versions")
            if number is not None:
                rows = rows.filter(F.col("number") == number)
            found = rows.orderBy(F.desc("number"), "writer").first()
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return None
            raise
        if found is not None:
            self.buckets = found["buckets"]  # those of the index that is there
        return found

    def write(self, relations: dict[str, DataFrame], complete: bool = True) -> bool:
        """Put the relations (with uri, "files" among them) in place of all there is. A larger complete index is not replaced by a smaller incomplete one."""
        old = self.version()
        layer = self._layer(relations)
        count = self._layer_rows(layer, "files").count()
        if old and not complete and old["complete"] and old["files"] > count:
            return False
        self._commit(old, complete, count, [layer])
        return True

    def replace(self, changed: DataFrame, fresh: dict[str, DataFrame]) -> int:
        """Put fresh rows in place of those of the changed files (uri); a changed file without fresh rows is gone. The new version's number."""
        old = self._current()
        layer = self._layer({**fresh, "gone": changed.select("uri").distinct()})
        layers = [*old["layers"], layer]
        number = self._commit(old, old["complete"], self._merged(layers, "files").count(), layers)
        return self.compact() if len(layers) > MANY_LAYERS else number

    def compact(self) -> int:
        """Merge the layers of the current version into one; the new version's number."""
        old = self._current()
        names = sorted({r for layer in old["layers"] for r in layer["relations"]} - {"gone"})
        return self._commit(old, old["complete"], old["files"], [self._layer({n: self._merged(old["layers"], n) for n in names})])

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """The rows of a relation in a version."""
        found = self.version(number)
        if found is None:
            raise FileNotFoundError(f"no index in {self.folder}")
        return self._merged(found["layers"], name)

    def files(self, uris: DataFrame, name: str) -> DataFrame:
        """The rows of some files (uri): only their buckets are read."""
        wanted = uris.select("uri", self._bucket().alias("bucket")).distinct()
        return self._merged(self._current()["layers"], name, keep_bucket=True).join(F.broadcast(wanted) if self._few(wanted) else wanted, ["bucket", "uri"], "left_semi").drop("bucket")

    def unread(self, keep: int = 1) -> list[str]:
        """Folders of layers that none of the last `keep` versions reads, for the caller to delete."""
        rows = self.spark.read.schema(_VERSION).option("recursiveFileLookup", True).parquet(f"{self.folder}/versions")
        layers = rows.select("number", F.explode("layers.name").alias("name")).distinct()
        last = rows.select("number").distinct().orderBy(F.desc("number")).limit(keep)
        held = layers.join(last, "number", "left_semi").select("name")
        return sorted(f"{self.folder}/data/{r['name']}" for r in layers.select("name").distinct().join(held, "name", "left_anti").collect())  # a name for each write since the last clearing

    def _current(self):
        found = self.version()
        if found is None:
            raise FileNotFoundError(f"no index in {self.folder}")
        return found

    def _few(self, frame: DataFrame, most: int = 10000) -> bool:
        return frame.limit(most + 1).count() <= most

    def _bucket(self):
        return F.pmod(F.xxhash64("uri"), F.lit(self.buckets)).cast("int")

    def _layer(self, relations: dict[str, DataFrame]):
        """Write relations as a layer; its name and the schema of each relation."""
        name = uuid.uuid4().hex
        for relation, frame in relations.items():
            # the files of a bucket go to a few tasks, sorted, so that a file's rows lie together
            spread = frame.withColumn("bucket", self._bucket()).repartition("bucket", F.pmod(F.xxhash64("uri"), F.lit(8 * self.buckets)))
            spread.sortWithinPartitions("bucket", "uri").write.partitionBy("bucket").parquet(self._path(name, relation))
        return {"name": name, "relations": {r: f.schema.json() for r, f in relations.items()}}

    def _path(self, layer: str, relation: str) -> str:
        return f"{self.folder}/data/{layer}/{relation}"

    def _layer_rows(self, layer, relation: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(layer["relations"][relation]))
        return self.spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(self._path(layer["name"], relation))

    def _merged(self, layers, relation: str, keep_bucket: bool = False) -> DataFrame:
        """The layers' rows less those of files that a later layer replaces."""
        out, gone = None, None
        for layer in reversed(layers):
            if relation in layer["relations"]:
                rows = self._layer_rows(layer, relation)
                if gone is not None:
                    rows = rows.join(gone, ["bucket", "uri"], "left_anti")
                out = rows if out is None else rows.unionByName(out, allowMissingColumns=True)
            if "gone" in layer["relations"]:
                later = self._layer_rows(layer, "gone")
                gone = later if gone is None else gone.unionByName(later).distinct()
        if out is None:
            raise FileNotFoundError(f"no relation {relation} in {self.folder}")
        return out if keep_bucket else out.drop("bucket")

    def _commit(self, old, complete: bool, files: int, layers) -> int:
        number, writer = (old["number"] + 1 if old else 1), uuid.uuid4().hex
        row = (number, writer, complete, files, self.buckets, [(x["name"], dict(x["relations"])) for x in layers])
        try:
            self.spark.createDataFrame([row], _VERSION).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/versions/{number:020d}")
        except AnalysisException as taken:
            raise Conflict(f"version {number} of {self.folder} exists") from taken
        if self.version(number)["writer"] != writer:
            raise Conflict(f"version {number} of {self.folder} was written by another at the same time")
        return number


def write_by_name(relation: DataFrame, folder: str, buckets: int = 64) -> None:
    """Store a library's relation (name, ..) for lookups by name: folders by the hash of the name, in order of names below."""
    spread = relation.withColumn("name_bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int"))
    spread.repartition(buckets, "name_bucket", F.pmod(F.xxhash64("name"), F.lit(64))).sortWithinPartitions("name_bucket", "name").write.partitionBy("name_bucket").mode("overwrite").parquet(folder)


def lookup_lazily(names: DataFrame, own: DataFrame, folder: str, buckets: int = 64) -> DataFrame:
    """Rows of some names (name) with their origin: the workspace's (name, ..), and a stored library's for names that the workspace lacks.

    The names that miss meet the library by folder and name, so that Spark reads at run time only the folders
    that they are in, and nothing if no name misses.
    """
    spark = names.sparkSession
    asked = names.select("name").distinct()
    found = own.join(asked, "name", "left_semi").withColumn("origin", F.lit("workspace"))
    bucket = F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int")
    missing = asked.filter("name > ''").join(own.select("name"), "name", "left_anti").withColumn("name_bucket", bucket)
    library = spark.read.parquet(folder).join(missing, ["name_bucket", "name"], "left_semi").drop("name_bucket")
    return found.unionByName(library.withColumn("origin", F.lit("library")), allowMissingColumns=True)

