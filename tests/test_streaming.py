import datetime as dt
import json

from pyspark.sql import functions as F

from symatlas.streaming import changes

T = dt.datetime(2024, 1, 1)


def test_debounce_batch(spark):
    rows = [("u", T + dt.timedelta(milliseconds=ms), t) for ms, t in ((0, "a"), (100, "b"), (250, "c"), (900, "d"))]
    frame = spark.createDataFrame(rows, "uri string, ts timestamp, text string")
    assert sorted((r["text"], r["n"]) for r in changes.debounced(frame).collect()) == [("c", 3), ("d", 1)]


def test_state_keeps_a_b_a(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("u", 1, "change", "A"), ("u", 2, "change", "A"), ("u", 3, "change", "B"), ("u", 4, "change", "A"), ("v", 1, "change", "A"), ("v", 2, "delete", None), ("v", 3, "change", "A")]
    with open(tmp_path / "in/a.json", "w") as out:
        for u, s, op, text in rows:
            out.write(json.dumps({"uri": u, "ts": f"2024-01-01T00:00:0{s}", "op": op, "text": text, "generation": 1}) + "\n")
    stream = changes.changed_content(changes.change_files(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["uri"], r["ts"].second, r["op"]) for r in spark.table("kept").collect())
    assert got == [("u", 1, "index"), ("u", 3, "index"), ("u", 4, "index"), ("v", 1, "index"), ("v", 2, "tombstone"), ("v", 3, "index")]


def test_batch_equals_state(spark):
    frame = spark.createDataFrame([("u", T, 1, "A"), ("u", T, 2, "A"), ("u", T, 3, "B"), ("u", T, 4, "A")], "uri string, ts timestamp, seq int, text string")
    assert [r["seq"] for r in changes.changed_runs(frame).orderBy("seq").collect()] == [1, 3, 4]


def test_overlay_and_generation(spark):
    base = spark.createDataFrame([("a", "old"), ("b", "kept")], "uri string, text string")
    live = spark.createDataFrame([("a", "new")], "uri string, text string")
    assert sorted(tuple(r) for r in changes.overlaid(base, live).collect()) == [("a", "new"), ("b", "kept")]
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "uri string, generation int")
    assert changes.current_generation(rows).agg(F.sum("generation")).first()[0] == 3
