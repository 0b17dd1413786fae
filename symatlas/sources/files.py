"""Reading source trees, archives and build files; writing and refreshing the index."""

from __future__ import annotations

import io
import re
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from symatlas.functions import paths
from symatlas.session import shipped

from .store import Store

#: Folders that hold no sources of the workspace, by name at any depth, and by path.
EXCLUDED = (
    ".git build target .gradle .build DerivedData Generated .kotlin .idea .fleet .vscode node_modules .cache captures .externalNativeBuild .cxx xcuserdata Pods"
).split()
EXCLUDED_PATHS = (".claude/worktrees", ".claude/projects", ".claude/plans")
GLOB = "*.{kt,java,swift}"


def excluded(path: Column, root: str) -> Column:
    """Whether a file lies in a folder, below the root, that holds no sources of the workspace.

    Spark's reader itself passes over folders whose names begin with a dot or an underscore.
    """
    inner = paths.relative(F.regexp_replace(path, "^file:(//)?", ""), re.sub("^file:(//)?", "", root))
    return inner.rlike("(^|/)(" + "|".join(re.escape(x) for x in (*EXCLUDED, *EXCLUDED_PATHS)) + ")/")


def listing(spark: SparkSession, root: str, exclude: bool = True, newer_than: str | None = None, ignore: list[str] = ()) -> DataFrame:
    """(path, mtime_secs, size, lang) of the source files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", True)
    if newer_than:
        reader = reader.option("modifiedAfter", newer_than)
    found = reader.load(root).select("path", F.unix_timestamp("modificationTime").alias("mtime_secs"), F.col("length").alias("size"))
    if exclude:
        found = found.filter(~excluded(F.col("path"), root))
    if ignore:
        found = found.filter(~paths.ignored(paths.relative(F.regexp_replace("path", "^file:", ""), root), list(ignore)))
    return found.withColumn("lang", paths.language(F.col("path")))


def capped(found: DataFrame, limit: int | None) -> DataFrame:
    """The shallowest files, if there are more than the limit."""
    return found if limit is None else found.orderBy(paths.depth(F.col("path")), "path").limit(limit)


def texts(spark: SparkSession, root: str, exclude: bool = True) -> DataFrame:
    """(uri, text) of the source files below a folder."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", True)
    found = reader.load(root)
    if exclude:
        found = found.filter(~excluded(F.col("path"), root))
    return found.select(F.col("path").alias("uri"), F.decode("content", "UTF-8").alias("text"))


def jar_texts(spark: SparkSession, root: str) -> DataFrame:
    """(uri, text) of the sources inside *-sources.jar archives; the uri is archive!/entry."""
    shipped(spark)
    jars = spark.read.format("binaryFile").option("pathGlobFilter", "*-sources.jar").option("recursiveFileLookup", True).load(root)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as jar:
                    for name in sorted(jar.namelist()):
                        if name.endswith((".kt", ".java", ".swift")):
                            rows.append((f"{path}!/{name}", jar.read(name).decode("utf-8", "replace")))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["uri", "text"])

    return jars.select("path", "content").mapInArrow(run, "uri string, text string")


def workspace_roots(spark: SparkSession, path: str) -> DataFrame:
    """(module, root) from a workspace.json of modules with content roots and source roots."""
    schema = "modules array<struct<name string, contentRoots array<struct<path string, sourceRoots array<struct<path string>>>>>>, sourcePaths array<string>"
    found = spark.read.schema(schema).option("multiLine", True).json(path)
    roots = found.select(F.explode("modules").alias("m")).select(F.col("m.name").alias("module"), F.explode("m.contentRoots").alias("c"))
    listed = roots.select("module", F.explode("c.sourceRoots").alias("s")).select("module", F.col("s.path").alias("root"))
    return listed.unionByName(found.select(F.lit(None).cast("string").alias("module"), F.explode("sourcePaths").alias("root"))).distinct()


def layout_roots(found: DataFrame) -> DataFrame:
    """Source roots src/<set>/{kotlin,java} that a listing shows."""
    root = F.regexp_extract("path", r"^(.*/src/[^/]+/(?:kotlin|java))/", 1)
    return found.select(root.alias("root")).filter("root != ''").distinct()


def version_catalog(toml: str) -> list[tuple[str, str, str, str | None]]:
    """(alias, group, artifact, version) of a version catalogue's libraries; version.ref is looked up."""
    import tomllib

    spec = tomllib.loads(toml)
    versions = spec.get("versions", {})
    out = []
    for alias, value in spec.get("libraries", {}).items():
        if isinstance(value, str):
            group, artifact, *version = value.split(":")
            out.append((alias, group, artifact, version[0] if version else None))
            continue
        group, artifact = value["module"].split(":") if "module" in value else (value.get("group"), value.get("name"))
        version = value.get("version")
        if isinstance(version, dict):
            version = versions.get(version.get("ref")) if "ref" in version else version.get("strictly") or version.get("require")
        out.append((alias, group, artifact, version))
    return out


def gradle_dependencies(builds: DataFrame) -> DataFrame:
    """(path, kind, configuration, target) of build scripts (path, text): external, catalogue, project and plugin references."""
    text = F.regexp_replace("text", r"(?m)//.*$", "")
    configuration = r"(\w*(?:[iI]mplementation|[aA]pi|[cC]ompileOnly|[rR]untimeOnly|kapt|ksp))"
    patterns = {
        "external": configuration + r"""\s*\(?\s*["']([\w.\-]+:[\w.\-]+:?[\w.\-]*)["']""",
        "catalog": configuration + r"\s*\(?\s*libs\.([\w.]+)",
        "project": configuration + r"""\s*\(?\s*project\(\s*["']([\w:\-]+)["']""",
        "plugin": r"""\b(id|kotlin|alias)\s*\(\s*["']?([\w.\-]+)["']?\s*\)""",
    }
    out = None
    for kind, pattern in patterns.items():
        both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("configuration"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("target"))
        rows = builds.select("path", F.explode(both).alias("d")).select("path", F.lit(kind).alias("kind"), F.col("d.configuration").alias("configuration"), F.col("d.target").alias("target"))
        out = rows if out is None else out.unionByName(rows)
    return out


def resolved_dependencies(dependencies: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue references get the coordinates of their alias; dots and dashes of an alias are one."""
    keyed = catalog.select(F.regexp_replace("alias", "[-_]", ".").alias("target"), F.concat_ws(":", "group", "artifact", "version").alias("coordinates"))
    return dependencies.join(keyed, "target", "left").withColumn("coordinates", F.when(F.col("kind") == "external", F.col("target")).otherwise(F.col("coordinates")))


def manifest_activities(manifests: DataFrame) -> DataFrame:
    """(path, name, exported, actions) of manifests (path, text); exported is true unless said otherwise."""
    blocks = manifests.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(<activity\b.*?(?:/>(?!.*?</activity>)|</activity>|/>))"), F.lit(1))).alias("b"))
    head = F.regexp_extract("b", r"(?s)^(<activity\b[^>]*>)", 1)
    return blocks.select(
        "path", F.regexp_extract(head, r'android:name="([^"]+)"', 1).alias("name"), (F.regexp_extract(head, r'android:exported="(\w+)"', 1) != "false").alias("exported"),
        F.regexp_extract_all("b", F.lit(r'<action\s+android:name="([^"]+)"'), F.lit(1)).alias("actions"),
    )


def write_index(relations: dict[str, DataFrame], folder: str, complete: bool = True) -> bool:
    """Write the relations as a new version of the index in a folder. A larger complete index is not replaced by a smaller incomplete one."""
    return Store(next(iter(relations.values())).sparkSession, folder).write(relations, complete)


def refresh_index(spark: SparkSession, folder: str, changed: DataFrame, fresh: dict[str, DataFrame]) -> int:
    """Put fresh rows in place of those of the changed files (uri), in the index where it lies; the new version's number."""
    return Store(spark, folder).replace(changed, fresh)


def read_index(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    store = Store(spark, folder)
    return {n: store.read(n) for n in names}


def max_files(value: str | None, default: int | None = None) -> int | None:
    """A cap on files from a setting: its number, or the default where it is none."""
    return int(value) if value is not None and re.fullmatch(r"\+?\d+", value) else default


def source_roots(workspace: list[str], configured: list[str], library: list[str], use_library: bool = True) -> list[tuple[str, bool]]:
    """(root, is_library) of the folders whose sources join the index: the configured ones in place of the workspace's, and libraries unless they are left out; each once."""
    found = [(r.rstrip("/"), False) for r in (configured or workspace)] + [(r.rstrip("/"), True) for r in (library if use_library else [])]
    once: dict[str, bool] = {}
    for root, flag in found:
        once.setdefault(root, flag)
    return list(once.items())


def all_texts(spark: SparkSession, roots: list[tuple[str, bool]]) -> DataFrame:
    """(uri, text, is_library) of the sources below several roots; a file below two of them counts once, as the workspace's if it is that."""
    out = None
    for root, flag in roots:
        one = texts(spark, root).withColumn("is_library", F.lit(flag))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("uri").agg(F.first("text").alias("text"), F.min("is_library").alias("is_library"))


def sdk_sources(root: str, environment: dict[str, str]) -> str | None:
    """The platform sources of the highest level in the SDK that local.properties, or else the environment, names; a probe of the driver's machine."""
    properties = Path(root) / "local.properties"
    named = [v.strip() for k, found, v in (line.partition("=") for line in (properties.read_text().splitlines() if properties.is_file() else ())) if found and k.strip() == "sdk.dir"]
    sdk = next((v for v in (*named[:1], environment.get("ANDROID_HOME"), environment.get("ANDROID_SDK_ROOT")) if v), None)
    if sdk is None or not Path(sdk).is_dir():
        return None
    levels = {int(m[1]): p for p in Path(sdk, "sources").glob("android-*") if p.is_dir() and (m := re.fullmatch(r"android-(\d+)", p.name))}
    return str(levels[max(levels)]) if levels else None


def namespaces(build_files: DataFrame) -> DataFrame:
    """(root, namespace) of modules from their files (path, text): the manifest's package, that below src/main first, else the build script's namespace."""
    name, folder = F.substring_index("path", "/", -1), F.regexp_replace("path", "(/src/main)?/[^/]+$", "")
    manifest = F.regexp_extract("text", r'package="([^"]+)"', 1)
    script = F.regexp_extract("text", r'(?m)^\s*namespace\s*=?\s*"([^"]+)"', 1)
    found = build_files.select(
        folder.alias("root"), F.when(name == "AndroidManifest.xml", manifest).when(name == "build.gradle.kts", script).alias("namespace"),
        F.when(name == "build.gradle.kts", 2).when(F.col("path").endswith("/src/main/AndroidManifest.xml"), 0).otherwise(1).alias("tier"),
    )
    return found.filter("namespace != ''").groupBy("root").agg(F.min_by("namespace", "tier").alias("namespace"))
