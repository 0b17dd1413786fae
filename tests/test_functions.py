from pyspark.sql import functions as F

from symatlas.functions import identifiers as ids, paths
from symatlas.operators import search


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_segments(spark):
    names = ["LoginViewModel", "HTMLParser", "user_repository_impl", "base64Encode", "x", "123", "a1_2", None]
    got = values(spark, names, ids.segments(F.col("x")))
    assert got == [["login", "view", "model"], ["html", "parser"], ["user", "repository", "impl"], ["base64", "encode"], [], [], ["a1"], None]


def test_segments_are_capped(spark):
    assert len(values(spark, ["Ab" * 20], ids.segments(F.col("x")))[0]) == 12


def test_stem(spark):
    words = ["running", "stopped", "models", "tokens", "class", "option", "resolution", "shipment", "quickly", "dependencies", "queries", "is"]
    assert values(spark, words, ids.stem(F.col("x"))) == ["run", "stop", "model", "token", "class", "option", "resolute", "ship", "quick", "dependency", "queri", "is"]


def test_query_words():
    assert ids.words_of_query('find the "User_Repo"!! (by id)') == ["find", "user_repo", "id"]


def test_match_score(spark):
    assert values(spark, ["ColumnButton", "coolBar", "CoolBar", "CBX", "xcbx", "zzz"], ids.match_score(F.col("x"), "CB")) == [1, 1, 1, 0, 2, None]


def test_fuzzy(spark):
    exact, sub, none = values(spark, ["login", "LoginRepository", "zz"], ids.fuzzy_score(F.col("x"), "login"))
    assert exact > 0.9 and sub > 0.5 and none == 0.0
    assert values(spark, ["LoginRepository"], ids.fuzzy_score(F.col("x"), ""))[0] == 0.0
    two = values(spark, ["LoginRepository", "LoginView"], ids.fuzzy_score(F.col("x"), "login repo"))
    assert two[0] > 0.5 and two[1] == 0.0


def test_substitution_is_one_pass(spark):
    frame = spark.createDataFrame([("fun f(a: T, b: U): Map<T, U>",)], "x string")
    mapping = F.create_map(F.lit("T"), F.lit("U"), F.lit("U"), F.lit("V"))
    assert frame.select(ids.substituted(F.col("x"), mapping)).first()[0] == "fun f(a: U, b: V): Map<U, V>"


def test_collection_element(spark):
    assert values(spark, ["List<Product>", "Flow<out a.B>", "Box<T>", "Int"], ids.collection_element(F.col("x"))) == ["Product", "a.B", None, None]


def test_paths(spark):
    rows = ["/r/app/core/src/main/kotlin/A.kt", "/r/src/test/A.java", "/r/A.swift", "/r/x/src/a/src/b/C.kt"]
    assert values(spark, rows, paths.source_set(F.col("x"))) == ["main", "test", None, "b"]
    assert values(spark, rows, paths.module(F.col("x"), "/r")) == ["app/core", None, None, "x/src/a"]
    assert values(spark, rows, paths.language(F.col("x"))) == ["kotlin", "java", "swift", "kotlin"]
    assert values(spark, ["/a/B.kt", "C", "x.tar.gz"], paths.stem(F.col("x"))) == ["B", "C", "x.tar"]


def test_generated(spark):
    assert values(spark, ["a/X.pb.kt", "FooGrpc.java", "A.kt"], paths.generated_path(F.col("x"))) == [True, True, False]
    texts = ["// Code generated by x. DO NOT EDIT.\nclass A", 'val s = "Code generated. DO NOT EDIT"', "/* AUTO-GENERATED FILE. DO NOT MODIFY. */", "\n" * 70 + "// this file was generated", None]
    assert values(spark, texts, paths.generated_header(F.col("x"))) == [True, False, True, False, False]


def test_globs(spark):
    assert values(spark, ["a/b/c.kt", "c.kt", "a/x/y"], paths.ignored(F.col("x"), ["**/c.kt", "a/*/z"])) == [True, True, False]


def test_parse_query():
    q = search.parse_query('kind:fun lang:java path:"my app" name:Foo foo:bar kind:nope login')
    assert (q.kinds, q.languages, q.paths, q.names) == (["function"], ["java"], ["my app"], ["Foo"])
    assert q.text == "foo:bar kind:nope login"


def test_ranked_defers_generated(spark):
    rows = [("A", "f1", 1, "s", "class", None, True, 9.0), ("A", "f2", 1, "s", "class", None, False, 4.0), ("B", "f3", 1, "s", "class", None, True, 2.0)]
    frame = spark.createDataFrame(rows, "name string, file string, line int, signature string, kind string, doc string, generated boolean, score double")
    assert [(r["file"], r["relative"]) for r in search.ranked(frame, 10).collect()] == [("f2", 1.0), ("f3", 0.5), ("f1", 1.0)]
