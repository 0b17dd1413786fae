"""Steps that keep the work of a query in proportion to its tables: what is counted or made distinct before a join, and sorted once."""

import pyarrow as pa
from pyspark.sql import functions as F

from symatlas.operators import grams, infer, lookup, search
from symatlas.plans import registry
from symatlas.sources import extract


def below(frame, join):
    """The optimized plan below the join whose condition has a text."""
    lines = frame._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if "Join" in line and join in line)
    rest = lines[at + 1 :]
    end = next((i for i, line in enumerate(rest) if depth(line) <= depth(lines[at])), len(rest))
    return "\n".join(rest[:end])


def test_missing_imports_meets_each_name_once(spark, small):
    assert "Aggregate [p_size" in below(registry.QUERIES["missing_imports"](spark, small), "p_size")


def test_priority_resolution_counts_before_it_joins(spark, small):
    frame = registry.QUERIES["priority_resolution"](spark, small)
    assert "Aggregate [s_nationkey" in below(frame, "c_nationkey") and "Aggregate [n_regionkey" in below(frame, "n_regionkey")


def test_auto_import_candidates_are_distinct_before_they_meet_files(spark, small):
    plan = below(registry.QUERIES["auto_import_candidates"](spark, small), "p_size")
    assert "Aggregate [p_size" in plan and "Aggregate [file" in plan


def test_batch_ranks_answers_once_for_each_name(spark):
    requests = spark.range(200).selectExpr("id AS req_id", "'callers' AS type", "id % 2 AS name")
    calls = spark.range(60).selectExpr("id % 2 AS callee", "concat('S', id) AS caller")
    got = lookup.batch(requests, {"callers": (calls, "callee", F.col("caller"), 3)})
    assert got.count() == 600 and "req_id" not in got.filter("answer > ''")._jdf.queryExecution().optimizedPlan().toString().split("Window [")[1].split("\n")[0]


def test_import_tier_keeps_the_first_import_of_a_path(spark, small):
    assert "Aggregate [p_size" in below(registry.QUERIES["import_tier"](spark, small), "p_size")


def test_tokens_are_sorted_once_to_encode_and_decode_them(spark, small):
    frame = registry.QUERIES["token_round_trip"](spark, small)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Sort [") == 1
    # a line that comes again in another file, the first line, and equal places
    rows = [("a", 0, 3), ("a", 0, 7), ("a", 2, 7), ("a", 2, 7), ("a", 2, 9), ("b", 2, 1), ("b", 9, 0), ("c", 0, 0)]
    encoded = infer.delta_encoded(spark.createDataFrame(rows, "uri string, line int, col int")).withColumns({"at": F.col("line"), "then": F.col("col")})
    back = infer.delta_decoded(encoded.select("uri", "delta_line", "delta_col", "at", "then"), "at", "then")
    assert sorted(tuple(r) for r in back.select("uri", "line", "col").collect()) == sorted(rows)


def test_files_are_parsed_on_all_cores_and_only_for_what_is_asked(spark):
    texts = spark.range(64).selectExpr("concat('f', id, '.kt') AS uri", "concat('class A', id, ' { fun go() {} }') AS text").coalesce(1)
    scan = extract.scanned(texts, "symbols")
    assert scan.columns == ["uri", "lang", "package", "content_hash", "symbols"]
    assert scan.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert extract.relation(scan, "symbols").count() == 128


def test_trigrams_are_stored_with_lists_of_ids(spark, tmp_path):
    texts = ["abcabc", "xabcx", None, "", "ab", "zz￿abc", "aé bc"] + [f"row {i}" for i in range(200)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, "abc again")], "id long, text string").coalesce(1)
    grams.write_grams(frame, str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/grams").collect()
    found = {(r["gram"], i) for r in rows for i in r["ids"]}
    assert found == {(t[k : k + 3], i) for i, t in [*enumerate(texts), (1, "abc again")] if t for k in range(len(t) - 2) if t[k : k + 3].isascii()}
    assert len(rows) == len({g for g, _ in found})  # a row for each trigram of a batch, not for each text that holds it
    assert sorted(r["id"] for r in grams.rows_with(spark, str(tmp_path), "abc a").collect()) == [1, 1]


def test_postings_of_many_rows_leave_a_worker_in_parts():
    schema = pa.schema([("id", pa.int64()), ("term", pa.string()), ("tf", pa.int64()), ("dl", pa.int32())])
    docs = pa.RecordBatch.from_pydict({"id": pa.array(range(1000), pa.int64()), "tokens": pa.array([[f"t{i % 90}" for i in range(100)]] * 999 + [None], pa.list_(pa.string()))})
    parts = list(search._counter(schema)([docs]))
    assert sum(p.num_rows for p in parts) == 999 * 90 and max(p.num_rows for p in parts) < search.ROWS + 90
    assert sum(sum(p.column("tf").to_pylist()) for p in parts) == 999 * 100
