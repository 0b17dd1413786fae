import json

import pytest

from symatlas.__main__ import COMMANDS, main, parser
from symatlas.engine import Workspace
from symatlas.sources.scanner import Scan

FILES = {
    "app/src/main/kotlin/Login.kt": "package app\nimport net.Client\nclass LoginScreen : Screen() {\n  fun open(c: Client) {\n    if (c.ready()) {\n      c.send()\n    } else {\n      retry { hidden() }\n    }\n    val v = Token()\n  }\n  fun retry(n: Int) { open(n) }\n}\nopen class Screen { override fun close() {} }\n",
    "net/src/main/kotlin/Client.kt": "package net\n@Keep\nclass Client {\n  /** Sends the login request. */\n  fun send() { flush() }\n  fun flush() {}\n  fun ready(): Boolean = true\n}\n",
    "net/src/test/kotlin/ClientTest.kt": "package net\nclass ClientTest { fun send() { } }\n",
}


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("w")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return Workspace(spark, str(root))


def test_find(workspace):
    assert [(r["module"], r["source_set"], r["owner"]) for r in workspace.find("send").collect()] == [("net", "main", "Client"), ("net", "test", "ClientTest")]
    assert workspace.find("Client.send", source_sets=["main"]).count() == 1
    assert workspace.find("send", kinds=["class"]).count() == 0 and workspace.find("send", module="app").count() == 0
    assert workspace.find("send", limit=1).count() == 1


def test_search(workspace):
    top = workspace.search("login request kind:method").collect()
    assert top[0]["name"] == "send" and top[0]["relative"] == 1.0
    assert {r["kind"] for r in workspace.search("kind:class").collect()} == {"class"}
    assert workspace.fuzzy("lgscr").first()["name"] == "LoginScreen"


def test_search_tokens_and_stored_index(workspace, tmp_path):
    tokens = {r["name"]: r["tokens"] for r in workspace.search_documents.collect() if "Test" not in r["file"]}
    assert tokens["send"][-3:] == ["sends", "login", "request"] and "client" in tokens["open"]
    before = [(r["name"], round(r["score"], 9)) for r in workspace.search("login request send").collect()]
    workspace.build_search_index(str(tmp_path / "index"))
    assert [(r["name"], round(r["score"], 9)) for r in workspace.search("login request send").collect()] == before
    workspace.search_index = None


def test_references_and_impact(workspace):
    kinds = [r["kind"] for r in workspace.references("Client").collect()]
    assert sorted(kinds) == ["declaration", "import", "type-use"]
    assert workspace.references("Client", include_imports=False).count() == 2
    assert workspace.references("Client", kind="import", limit=1).count() == 1
    row = workspace.impact("send").first()
    assert (row["call"], row["callers"], row["risk"]) == (1, 1, "low")


def test_graph(workspace):
    assert {r["caller"] for r in workspace.callers("Client.send").collect()} == {"LoginScreen.open"}
    assert {r["callee"] for r in workspace.callees("Client.send").collect()} == {"flush"}
    assert [r["name"] for r in workspace.hierarchy("Screen").collect()] == ["LoginScreen"]
    nodes = {(r["name"], r["line"]) for r in workspace.reach("LoginScreen.open", "Client.send").collect()}
    assert nodes == {("LoginScreen.open", 3), ("Client.send", 4), ("retry", 11), ("open", 3)}  # and by retry, which calls open by its bare name


def test_other_lookups(workspace, spark):
    assert workspace.annotated("Keep").first()["name"] == "Client"
    assert workspace.imports_of("net.").count() == 1
    assert workspace.check().filter("not ok").count() == 0
    assert workspace.summary("Client").first()["members"] == ["flush", "ready", "send"]
    assert workspace.snapshot().filter("relation = 'extends'").count() == 1
    requests = spark.createDataFrame([(1, "definition", "Client"), (2, "callers", "flush"), (3, "definition", "Nope"), (4, "odd", "x"), (5, "subtypes", "Screen")], "req_id int, type string, name string")
    got = [(r["req_id"], r["answer"]) for r in workspace.batch(requests).collect()]
    assert [i for i, _ in got] == [1, 2, 3, 4, 5] and got[1][1] == "Client.send" and got[2][1] == "not found" and got[3][1] == "unknown request odd" and got[4][1] == "LoginScreen"
    workspace.register_views()
    assert spark.sql("SELECT count(*) FROM symbols JOIN files USING (uri) WHERE kind = 'class'").first()[0] == 4


def test_steps():
    steps = [(s["caller_key"], s["depth"], s["kind"], s["label"]) for s in Scan("Login.kt", FILES["app/src/main/kotlin/Login.kt"]).steps()]
    assert steps == [
        ("LoginScreen.open", 0, "branch", "if"), ("LoginScreen.open", 0, "call", "ready"), ("LoginScreen.open", 1, "call", "send"), ("LoginScreen.open", 0, "branch", "else"), ("LoginScreen.open", 1, "call", "retry"),
        ("LoginScreen.open", 0, "call", "new Token"), ("LoginScreen.retry", 0, "call", "open"),
    ]


def test_command_line(workspace, spark, capsys):
    main(["find", workspace.root, "send", "--source-set", "main", "--json"], spark)
    assert json.loads(capsys.readouterr().out)["owner"] == "Client"
    main(["callers", workspace.root, "flush"], spark)
    assert capsys.readouterr().out.startswith("Client.send\t")


def test_places_and_scopes(workspace, capsys, spark):
    client = next(r["uri"] for r in workspace.files.select("uri").collect() if r["uri"].endswith("/Client.kt"))
    assert {r["tier"] for r in workspace.find_anywhere("send").collect()} == {1} and workspace.find_anywhere("nope").count() == 0
    assert workspace.scope_at(client, 4, 8)[:2] == ("send", "Client") and workspace.scope_at(client, 0, 200) is None
    places = {(r["file"].rpartition("/")[2], r["line"]) for r in workspace.references_at(client, 2, 6).collect()}
    assert ("Client.kt", 2) in places and all(name != "ClientTest.kt" for name, _ in places)
    assert [r["status"] for r in workspace.call_hierarchy("send").collect()] == ["ambiguous", "ambiguous"]
    assert [r["key"] for r in workspace.call_hierarchy("Client.send").collect()] == ["LoginScreen.open"]
    login = next(r["uri"] for r in workspace.files.select("uri").collect() if r["uri"].endswith("/Login.kt"))
    assert {r["name"] for r in workspace.inject(login).collect()} >= {"Client", "Screen", "LoginScreen"}
    assert workspace.hover("Client").first()["markdown"].startswith("```kotlin\n") and workspace.implementations("Screen").count() == 1
    assert workspace.prewarm(login) > 0 and workspace.documented("LOGIN").count() == 1 and workspace.lines_with("retry").count() == 2
    main(["capabilities", workspace.root], spark)
    assert "incoming" in capsys.readouterr().out


@pytest.mark.parametrize("command", sorted(COMMANDS))
def test_every_command(workspace, spark, command, tmp_path):
    folder = str(tmp_path / "out") if command in ("index", "refresh", "extract-sources") else "send"
    args = parser().parse_args([command, workspace.root, folder])
    if command == "refresh":
        workspace.save(folder)
    if command == "changes":  # the root is under no version control
        with pytest.raises(Exception, match="rev-parse"):
            COMMANDS[command](workspace, args)
    else:
        COMMANDS[command](workspace, args).limit(1).collect()


def test_trees_and_lambdas(workspace):
    lines = [r["line"].strip() for r in workspace.tree("LoginScreen.open").collect()]
    assert lines[0] == "LoginScreen.open" and {"if", "ready", "send", "else", "retry", "new Token"} <= set(lines)
    assert workspace.lambda_types().columns == ["uri", "id", "name", "type"]


def test_index_is_saved_and_refreshed(spark, tmp_path):
    root, folder = tmp_path / "src", str(tmp_path / "index")
    root.mkdir()
    (root / "A.kt").write_text("class A { fun one() {} }\n")
    (root / "B.kt").write_text("class B\n")
    first = Workspace(spark, str(root))
    assert first.save(folder)
    uris = {r["uri"].rsplit("/", 1)[1]: r["uri"] for r in first.files.select("uri").collect()}
    first.close()
    (root / "A.kt").write_text("class A { fun two() {} }\n")
    (root / "B.kt").unlink()
    second = Workspace(spark, str(root))
    assert second.refresh(folder, spark.createDataFrame([(u,) for u in uris.values()], "uri string")) == 2
    from symatlas.sources import files

    assert sorted(r["name"] for r in files.read_index(spark, folder, "symbols")["symbols"].collect()) == ["A", "two"]
    second.close()


def test_symbols_like_falls_back_to_text(workspace, spark, tmp_path):
    assert {r["name"] for r in workspace.symbols_like("client.sen").collect()} == {"send"}
    (tmp_path / "w").mkdir()
    (tmp_path / "w/A.kt").write_text("/* text only:\n  class Hidden\n*/\nclass Shown\n")
    other = Workspace(spark, str(tmp_path / "w"))
    assert [(r["name"], r["line"], r["container"]) for r in other.symbols_like("Hidden").collect()] == [("Hidden", 1, "text")]
    assert [r["kind"] for r in other.symbols_like("shown").collect()] == ["class"] and other.symbols_like("Nowhere").count() == 0
    other.close()
