import datetime as dt
import json

import pytest

from symatlas.streaming import changes, live


def ran(spark, tmp_path, batches, **options):
    """The output rows (batch of input, uri, op, text) of a stream over JSON files, a batch for each."""
    folder = tmp_path / "in"
    folder.mkdir()
    start = dt.datetime(2024, 1, 1)
    for n, rows in enumerate(batches):
        with open(folder / f"{n:03d}.json", "w") as out:
            for uri, ms, op, text, generation in rows:
                out.write(json.dumps({"uri": uri, "ts": (start + dt.timedelta(milliseconds=ms)).isoformat(), "op": op, "text": text, "generation": generation}) + "\n")
        stamp = 1_700_000_000 + n
        __import__("os").utime(folder / f"{n:03d}.json", (stamp, stamp))
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        stream = live.live_documents(changes.change_files(spark, str(folder), 1), **options)
        name = tmp_path.name.replace("-", "_")
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        rows = [(r["uri"], int((r["ts"] - start).total_seconds() * 1000), r["op"], r["text"]) for r in spark.table(name).collect()]
        state = query.lastProgress["stateOperators"][0]
        return rows, state
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def test_debounce_close_hash_and_generations(spark, tmp_path):
    batches = [
        [("u", 0, "change", "a", 1), ("u", 100, "change", "b", 1), ("u", 250, "change", "c", 1), ("v", 0, "change", "x", 1), ("v", 100, "close", None, 1), ("w", 0, "open", "at once", 1)],
        [("tick", 5000, "change", "", 1)],  # the watermark passes the wait of u
        [("u", 6000, "change", "c", 1), ("v", 6000, "change", "y", 2), ("w", 6000, "change", "z", 1)],
        [("tick", 12000, "change", "t", 1)],  # u's text is the last one
        [("u", 13000, "change", "d", 3), ("u", 13100, "change", "older", 2), ("w", 13000, "change", "lost", 1), ("late", 1, "change", "late", 1)],
        [("w", 13200, "close", None, 1), ("tick", 14100, "change", "s", 1)],
        [("tick", 20000, "change", "r", 1)],
        [("u", 21000, "delete", None, 3), ("u", 22000, "save", "d", 3), ("tick", 30000, "change", "q", 1)],
        [("tick", 40000, "change", "p", 1)],
    ]
    rows, _ = ran(spark, tmp_path, batches)
    found = [r for r in rows if r[0] != "tick"]
    assert sorted(r for r in found if r[0] == "u") == [("u", 250, "index", "c"), ("u", 13000, "index", "d"), ("u", 21000, "tombstone", None), ("u", 22000, "index", "d")]
    assert sorted(r for r in found if r[0] == "v") == [("v", 100, "close", None), ("v", 6000, "index", "y")]
    assert sorted(r for r in found if r[0] == "w") == [("w", 0, "index", "at once"), ("w", 6000, "index", "z"), ("w", 13200, "close", None)]
    assert not [r for r in found if r[0] == "late"]


def test_idle_documents_are_forgotten(spark, tmp_path):
    batches = [[(f"u{i}", i, "change", "a", 1) for i in range(20)], [("tick", 5000, "change", "", 1)], [("tick", 60000, "change", "x", 1)], [("u3", 61000, "change", "a", 1)], [("tick", 70000, "change", "y", 1)], [("tick", 75000, "change", "z", 1)]]
    rows, state = ran(spark, tmp_path, batches, kept=10000)
    # a document that was forgotten is put out again; its text is no longer known
    assert [r for r in rows if r[0] == "u3"] == [("u3", 3, "index", "a"), ("u3", 61000, "index", "a")]
    assert sum(r[0].startswith("u") for r in rows) == 21
    assert state["numRowsTotal"] < 20


@pytest.mark.parametrize("rows", [[("u", 0, "change", None, None)], []])
def test_null_text_and_generation(spark, tmp_path, rows):
    out, _ = ran(spark, tmp_path, [rows + [("t", 0, "change", "x", 1)], [("t", 9000, "change", "y", 1)], [("t", 19000, "change", "z", 1)]])
    assert [r for r in out if r[0] == "u"] == [("u", 0, "index", "")] * len(rows)
