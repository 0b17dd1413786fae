import os
import subprocess
import zipfile

import pytest

from symatlas.sources import archives


@pytest.fixture()
def repository(tmp_path):
    folder = tmp_path / "tree"
    (folder / "src").mkdir(parents=True)
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")} | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"}
    git = lambda *args: subprocess.run(["git", "-C", str(folder), *args], check=True, capture_output=True, env=env)
    git("init", "-q")
    (folder / "src/A.kt").write_text("fun a() { b() }\n")
    (folder / "src/é x.kt").write_text("fun e() {}\n")
    (folder / "notes.txt").write_text("no")
    git("add", "-A"), git("commit", "-qm", "one")
    (folder / "src/A.kt").write_text("fun a() { c() }\n")
    (folder / "src/é x.kt").unlink()
    git("add", "-A"), git("commit", "-qm", "two")
    (folder / "src/New.kt").write_text("fun n() {}\n")
    (folder / ".gitignore").write_text("build/\n")
    (folder / "build").mkdir()
    (folder / "build/G.kt").write_text("fun g() {}\n")
    return str(folder)


def test_snapshots(spark, repository, monkeypatch):
    monkeypatch.setattr(archives, "FILES", 1)
    archives.register(spark)
    read = lambda **o: {(r["path"], r["text"]) for r in spark.read.format("symatlas_snapshot").options(**o).load(repository).collect()}
    assert read(ref="HEAD~1") == {("src/A.kt", "fun a() { b() }\n"), ("src/é x.kt", "fun e() {}\n")}
    assert read(ref="HEAD") == {("src/A.kt", "fun a() { c() }\n")}
    assert read() == {("src/A.kt", "fun a() { c() }\n"), ("src/New.kt", "fun n() {}\n")}
    assert read(below="src/New.kt") == {("src/New.kt", "fun n() {}\n")} and read(ref="HEAD", below="nowhere") == set()
    with pytest.raises(Exception, match="rev-parse"):
        read(ref="no-such-ref")


def test_call_trees_of_two_versions(spark, repository):
    from pyspark.sql import functions as F

    from symatlas.operators import trees
    from symatlas.sources import extract

    both = archives.snapshots(spark, repository, "HEAD~1", "HEAD")
    sides = []
    for side in ("before", "after"):
        scan = extract.scanned(both.filter(F.col("side") == side).select(F.col("path").alias("uri"), "text"))
        steps = trees.with_parents(extract.relation(scan, "steps"))
        functions = extract.relation(scan, "symbols").select(F.col("name").alias("key"), F.col("name").alias("label"), (F.col("visibility") == "public").alias("exported"))
        sides.append((steps, functions))
    assert [r["entry"] for r in trees.inferred_entries(*sides, 4).collect()] == ["a", "e"]
    entries = spark.createDataFrame([("a",)], "entry string")
    diff = trees.tree_diff(*(trees.expanded(steps, entries, 4) for steps, _ in sides))
    assert [r["line"] for r in trees.diff_lines(diff).orderBy("place").collect()] == ["  a", "-   b", "+   c"]


def test_extracted_sources(spark, tmp_path):
    caches = tmp_path / "modules-2/files-2.1"
    for version, body in (("1.9", b"old"), ("1.10", b"new")):
        folder = caches / "org.x" / "lib" / version / "hash"
        folder.mkdir(parents=True)
        with zipfile.ZipFile(folder / f"lib-{version}-sources.jar", "w") as jar:
            jar.writestr("p/A.kt", body)
            jar.writestr("p/B.java", b"b")
            jar.writestr("p/readme.txt", b"no")
            jar.writestr("../evil.kt", b"no")
    with zipfile.ZipFile(tmp_path / "modules-2/alone-sources.jar", "w") as jar:
        jar.writestr("Q.kt", b"q")
    out = tmp_path / "out"
    for _ in range(2):  # a second run leaves the same
        archives.extract_sources(spark, str(tmp_path / "modules-2"), str(out))
        files = {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file() and p.name != "_SUCCESS" and not p.name.endswith(".crc")}
        assert files == {"org.x.lib-1.10/p/A.kt": b"new", "org.x.lib-1.10/p/B.java": b"b", "alone/Q.kt": b"q"}
    assert not (tmp_path / "evil.kt").exists()


def test_writer_after_a_lost_task(tmp_path):
    writer = archives.FileWriter(str(tmp_path))
    rows = [{"artifact": "a", "entry": f"{i}.kt", "content": b"x" * i} for i in range(5)]

    def lost():
        yield from rows[:3]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(lost())
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["0.kt", "1.kt", "2.kt"]
    writer.commit([writer.write(iter(rows))])
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == [f"{i}.kt" for i in range(5)]
    assert (tmp_path / "_SUCCESS").read_text() == "5"
