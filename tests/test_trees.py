import collections
import random
from functools import lru_cache

import pytest
from hypothesis import given, settings, strategies as st

from symatlas.operators import graph, trees

STEPS = "caller string, parent int, seq int, kind string, name string"


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_reach_behind_many_dead_ends(spark):
    edges = [("S", f"c{i:05d}") for i in range(20000)] + [(f"c{i:05d}", "S") for i in range(20000)] + [("S", "z"), ("z", "T")]
    frame = spark.createDataFrame(edges, "caller string, callee string")
    assert [tuple(r) for r in graph.reach(spark, frame, "S", "T").collect()] == [("S > z > T", 2, "T", False)]


@pytest.mark.parametrize("seed", range(3))
def test_reach_in_small_rounds(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "AT_ONCE", 3)
    rng = random.Random(seed)
    edges = sorted({(rng.choice("abcdefg"), rng.choice("abcdefgh")) for _ in range(20)})
    out = {a: sorted(y for x, y in edges if x == a) for a, _ in edges}
    visited = []

    def walk(path, target, depth, limit, found):
        if len(found) >= limit:
            visited.append(1)
            return
        if path[-1] == target:
            found.append(path)
            return
        if len(path) > depth:
            if target is None:
                found.append(path)
            return
        free = [n for n in out.get(path[-1], ()) if n not in path]
        for n in free:
            walk([*path, n], target, depth, limit, found)
        if not free and target is None:
            found.append(path)

    frame = spark.createDataFrame(edges, "caller string, callee string")
    for target, depth, limit in (("h", 6, 1000), ("h", 6, 4), (None, 5, 7), ("b", 3, 2)):
        found, visited[:] = [], []
        walk(["a"], target, depth, limit, found)
        got = graph.reach(spark, frame, "a", target, depth, limit).collect()
        assert [r["path"] for r in got] == [" > ".join(p) for p in found]
        assert all(r["truncated"] == bool(visited) for r in got)


def test_reach_of_unknown_entry_and_no_limit(spark):
    edges = spark.createDataFrame([("a", "b"), (None, "c"), ("a", None)], "caller string, callee string")
    assert rows(graph.reach(spark, edges, "nobody")) == [("nobody", 0, "nobody", False)]
    assert graph.reach(spark, edges, "a", limit=0).count() == graph.reach(spark, edges, "a", "nobody").count() == 0
    assert rows(graph.reach(spark, edges, "a", "a")) == [("a", 0, "a", False)]


def test_walkable_languages_names_and_implementors(spark):
    edges = [("entry", "shared", "A.kt"), ("shared", "kotlinLeaf", "A.kt"), ("shared", "swiftLeaf", "B.swift"), ("swiftEntry", "shared", "B.swift"), ("entry", "send", "A.kt"),
             ("Client.send", "log", "A.kt"), ("entry", "Api.get", "A.kt"), ("HttpApi.get", "fetch", "A.kt"), ("x", "run", "A.kt"), ("A.run", "p", "A.kt"), ("B.run", "q", "A.kt")]
    steps = graph.walkable(spark.createDataFrame(edges, "caller string, callee string, file string"), spark.createDataFrame([("Api", "HttpApi")], "super string, sub string"))
    got = [r["path"] for r in graph.reach(spark, steps, "entry").collect()]
    assert got == ["entry > Api.get > fetch", "entry > send > log", "entry > shared > kotlinLeaf"]
    assert [r["path"] for r in graph.reach(spark, steps, "swiftEntry").collect()] == ["swiftEntry > shared > swiftLeaf"]
    assert [r["path"] for r in graph.reach(spark, steps, "x").collect()] == ["x > run"]
    assert graph.reach(spark, steps, "entry", "swiftLeaf").count() == 0


def bodies(seed, names="abcdef", unknown="uv"):
    """Random bodies (caller, parent, seq, kind, name) with nested branches."""
    rng, out = random.Random(seed), []
    for caller in names:
        open_ = [-1]
        for seq in range(rng.randint(0, 5)):
            parent = rng.choice(open_)
            if rng.random() < 0.3:
                out.append((caller, parent, seq, "branch", rng.choice(["if", "else"])))
                open_.append(seq)
            else:
                out.append((caller, parent, seq, "call", rng.choice(names + unknown)))
    return out


def tree(steps, key, most, mark_last=False):
    """Nested (path, depth, kind, name, cycle) nodes, in order."""
    known = {s[0] for s in steps}
    out = []

    def call(key, path, depth, names):
        cycle = key in names and (depth < most or mark_last) and key in known
        out.append((path, depth, "call", key, cycle))
        if depth < most and not cycle:
            below(key, -1, path, depth + 1, names | {key})

    def below(key, parent, path, depth, names):
        for _, p, seq, kind, name in [s for s in steps if s[0] == key and s[1] == parent]:
            if kind == "call":
                call(name, [*path, seq], depth, names)
            else:
                out.append(([*path, seq], depth, "branch", name, False))
                below(key, seq, [*path, seq], depth, names)

    call(key, [0], 0, set())
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_expanded_by_brute_force(spark, seed):
    steps = bodies(seed)
    frame = spark.createDataFrame(steps, STEPS)
    entries = spark.createDataFrame([("a",), ("b",), ("nobody",)], "entry string")
    for limit in (10000, 7):
        got = trees.expanded(frame, entries, 4, limit).collect()
        for entry in ("a", "b", "nobody"):
            want = tree(steps, entry, 4)
            own = sorted((r["path"], r["depth"], r["kind"], r["name"], r["cycle"]) for r in got if r["entry"] == entry)
            assert own == want[:limit]
            assert {r["truncated"] for r in got if r["entry"] == entry} == {len(want) > limit}


def test_call_tree_of_a_complete_graph_is_bounded(spark):
    names = [f"n{i:02d}" for i in range(12)]
    edges = spark.createDataFrame([(a, b, k) for a in names for k, b in enumerate(names) if a != b], "caller string, callee string, seq int")
    got = graph.call_tree(spark, edges, "n00", 8, limit=5000).orderBy("path_seq").collect()
    assert len(got) == 5000 and all(r["truncated"] for r in got)
    assert [r["name"] for r in got[:9]] == ["n00", "n01", "n00", "n02", "n00", "n01", "n03", "n00", "n01"]


def test_scanned_steps_get_parents(spark):
    scanned = [("f", 0, 0, "call", "a"), ("f", 1, 0, "branch", "if"), ("f", 2, 1, "call", "b"), ("f", 3, 1, "branch", "when"), ("f", 4, 2, "call", "c"), ("f", 5, 0, "branch", "else"), ("f", 6, 1, "call", "d"), ("f", 7, 0, "call", "e"), ("g", 0, 0, "call", "a")]
    frame = spark.createDataFrame([(*s, 1) for s in scanned], "caller_key string, seq int, depth int, kind string, label string, line int")
    got = {(r["caller"], r["seq"]): r["parent"] for r in trees.with_parents(frame).collect()}
    assert got == {("f", 0): -1, ("f", 1): -1, ("f", 2): 1, ("f", 3): 1, ("f", 4): 3, ("f", 5): -1, ("f", 6): 5, ("f", 7): -1, ("g", 0): -1}


@pytest.mark.parametrize("seed", range(4))
def test_inferred_entries_by_brute_force(spark, seed):
    rng = random.Random(seed)
    before = bodies(seed)
    after = [s for s in before if rng.random() > 0.1 or s[3] == "branch"] + [("g", -1, 0, "call", "a"), ("new b", -1, 0, "call", "c")] * (seed % 2)
    names = [sorted({s[0] for s in v}) for v in (before, after)]
    for exported in ("", "abcdefg", "f"):
        frames = [(spark.createDataFrame(v, STEPS), spark.createDataFrame([(n, n + "()", n in exported) for n in own] or [("zz", "zz", False)], "key string, label string, exported boolean")) for v, own in zip((before, after), names)]
        differ = [k for k in sorted(set(names[0]) | set(names[1])) if not k.startswith("new ") and (tree(before, k, 3) if k in names[0] else None) != (tree(after, k, 3) if k in names[1] else None)]
        want = [k for k in differ if k in exported] or differ
        assert [r["entry"] for r in trees.inferred_entries(*frames, 3).collect()] == want


def brute_alignment(before, after):
    @lru_cache(None)
    def longest(i, j):
        if i == len(before) or j == len(after):
            return 0
        return longest(i + 1, j + 1) + 1 if before[i] == after[j] else max(longest(i + 1, j), longest(i, j + 1))

    out, i, j = [], 0, 0
    while i < len(before) or j < len(after):
        if i < len(before) and j < len(after) and before[i] == after[j]:
            out.append(("same", i, j))
            i, j = i + 1, j + 1
        elif i < len(before) and (j == len(after) or longest(i + 1, j) >= longest(i, j + 1)):
            out.append(("removed", i, -1))
            i += 1
        else:
            out.append(("added", -1, j))
            j += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=14), st.text("abcd", max_size=14), st.sampled_from([1, 6, 30]))
def test_alignment_in_halves(before, after, cells):
    assert trees.aligned(list(before), list(after), cells) == brute_alignment(before, after)


def nested(rows_):
    """(path, name) rows as (name, children)."""
    def node(path):
        own = next(n for p, n in rows_ if p == path)
        return own, [node(p) for p, _ in sorted(rows_) if len(p) == len(path) + 1 and p[:-1] == path]

    return node([0])


def brute_diff(b, a):
    out = []

    def mark(n, status, depth):
        out.append((depth, status, n[0]))
        for c in n[1]:
            mark(c, status, depth + 1)

    def both(x, y, depth):
        out.append((depth, "same", y[0]))
        for status, i, j in brute_alignment(tuple(c[0] for c in x[1]), tuple(c[0] for c in y[1])):
            if status == "same":
                both(x[1][i], y[1][j], depth + 1)
            else:
                mark(x[1][i] if i >= 0 else y[1][j], status, depth + 1)

    both(b, a, 0)
    return out


def test_tree_diff_by_brute_force(spark):
    rng, tables, want = random.Random(2), ([], []), {}

    def grow(path, depth):
        yield path, rng.choice("abc") if depth else "root"
        for k in range(rng.randint(0, 4) if depth < 4 else 0):
            yield from grow([*path, k * 2], depth + 1)

    for entry in range(6):
        trees_ = [list(grow([0], 0)) for _ in range(2)]
        want[entry] = brute_diff(*map(nested, trees_))
        for table, t in zip(tables, trees_):
            table += [(entry, p, "call", n) for p, n in t]
    tables[0].append((8, [0], "call", "gone"))
    tables[1].extend([(9, [0], "call", "new"), (9, [0, 1], "call", "below")])
    want[8], want[9] = [(0, "removed", "gone")], [(0, "added", "new"), (1, "added", "below")]
    before, after = (spark.createDataFrame(t, "entry int, path array<int>, kind string, name string") for t in tables)
    diff = trees.tree_diff(before, after)
    got = diff.orderBy("entry", "place").collect()
    for entry in want:
        assert [(r["depth"], r["status"], r["name"]) for r in got if r["entry"] == entry] == want[entry]
    lines = [r["line"] for r in trees.diff_lines(diff).filter("entry = 9").orderBy("place").collect()]
    assert lines == ["+ new", "+   below"]
    assert 9 in {r["entry"] for r in trees.changed_trees(diff).select("entry").collect()}


def test_tree_diff_packs_trees_and_takes_large_ones_by_level(spark, tmp_path, monkeypatch):
    nodes = spark.range(40).selectExpr("id AS entry", "explode(sequence(0, 40)) AS line").selectExpr("entry", "line", "explode(sequence(0, IF(entry = 3, 90, 20))) AS at")

    def version(k):
        root = nodes.selectExpr("entry", "array(0) AS path", "'call' AS kind", "'r' AS name").distinct()
        lines = nodes.selectExpr("entry", "array(0, line) AS path", "'branch' AS kind", f"md5(string(line + IF(line % 5 = {k}, 100, 0))) AS name").distinct()
        return root.union(lines).union(nodes.selectExpr("entry", "array(0, line, at) AS path", "'call' AS kind", f"concat('w', (at * 7 + line) % 50, IF(line % 9 = {k}, 'x', '')) AS name"))

    before, after = version(0), version(1)
    monkeypatch.setattr(trees, "shared_folder", lambda spark: str(tmp_path / "a"))
    whole = sorted(map(tuple, trees.tree_diff(before, after).collect()))
    stored = sum(f.stat().st_size for f in (tmp_path / "a").rglob("*.parquet"))
    assert stored < 8 * before.count()  # with a table of each version and level it was 10.9 times as many bytes
    monkeypatch.setattr(trees, "shared_folder", lambda spark: str(tmp_path / "b"))
    monkeypatch.setattr(trees, "WHOLE", 1000)  # only entry 3 is larger
    assert sorted(map(tuple, trees.tree_diff(before, after).collect())) == whole
    monkeypatch.setattr(trees, "WHOLE", 1)
    assert sorted(map(tuple, trees.tree_diff(before, after).collect())) == whole


def test_tree_diff_counts_and_lists(spark, tmp_path, monkeypatch):
    rng, tables = random.Random(5), ([], [])

    def grow(path, depth):
        yield path, rng.choice(["a", "b", "c", "", "zwölf", None]) if depth else "root"
        for k in range(rng.randint(0, 4) if depth < 3 else 0):
            yield from grow([*path, k * 3 - 2], depth + 1)

    for entry in [*range(40), None]:
        for table in tables:
            nodes = [(entry, p, rng.choice(["call", None]), n) for p, n in grow([0], 0)]
            rng.shuffle(nodes)
            table.extend(nodes)
    tables[0].append((100, [0], "call", "gone"))
    tables[1].extend([(101, [0], "call", "new"), (101, [0, 7], "call", "below"), (102, [0, 1], "call", "below nothing")])
    sides = [spark.createDataFrame(t, "entry int, path array<int>, kind string, name string") for t in tables]
    monkeypatch.setattr(trees, "shared_folder", lambda spark: str(tmp_path))

    def lists(nodes, side):
        groups = {}
        for entry, path, kind, name in nodes:
            groups.setdefault((entry, tuple(path[:-1])), []).append((path[-1], name, kind))
        return [(e, [(side, list(p))], [x[0] for x in g], [x[1] for x in g], [x[2] for x in g]) for (e, p), g in groups.items()]

    both = spark.createDataFrame(lists(tables[0], 0) + lists(tables[1], 1), "entry int, places array<struct<side: int, path: array<int>>>, at array<int>, names array<string>, kinds array<string>")
    diff = sorted(map(tuple, trees.tree_diff(*sides).collect()), key=repr)
    assert sorted(map(tuple, trees.tree_diff(both).collect()), key=repr) == diff
    want = collections.Counter((entry, status, depth) for entry, _, depth, status, _, _ in diff)
    assert {tuple(r)[:3]: r["nodes"] for r in trees.diff_counts(*sides).collect()} == want
    monkeypatch.setattr(trees, "WHOLE", 12)  # some trees are larger
    assert {tuple(r)[:3]: r["nodes"] for r in trees.diff_counts(both).collect()} == want
    assert sorted(map(tuple, trees.tree_diff(*sides).collect()), key=repr) == diff
    assert {r[3] for r in diff if r[0] is None} == {"removed", "added"} and all(r[0] != 102 for r in diff)


def test_lists_of_both_versions_are_made_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "shared_folder", lambda spark: str(tmp_path))
    lists = [(1, [(0, []), (1, [])], [0], "r"), (1, [(0, []), (1, [])], [0], "r"), (1, [(0, [0])], [1, 2], "x\ny"), (1, [(1, [0])], [6, 4], "y\nz"), (1, [(0, [0, 1]), (0, [0, 2]), (1, [0, 6])], None, "u\nv\nw"), (1, [(1, [0, 4])], None, "")]
    both = spark.createDataFrame(lists, "entry int, places array<struct<side: int, path: array<int>>>, at array<int>, names string")
    want = {("same", 0, 1), ("removed", 1, 1), ("removed", 2, 3), ("same", 1, 1), ("same", 2, 3), ("added", 1, 1)}
    for whole in (trees.WHOLE, 1):
        monkeypatch.setattr(trees, "WHOLE", whole)
        assert {tuple(r)[1:] for r in trees.diff_counts(both).collect()} == want


def test_alignment_of_names_that_are_there_once():
    rng = random.Random(7)
    for _ in range(300):
        names = rng.sample(range(30), rng.randint(0, 8))
        lists = [[x for x in names if rng.random() < 0.7] for _ in range(2)]
        for own, low in zip(lists, (100, 200)):
            for _ in range(rng.randint(0, 4)):
                own.insert(rng.randint(0, len(own)), low + rng.randint(0, 2))
        assert trees.aligned(*lists) == brute_alignment(*map(tuple, lists))
