"""What is folded, cut, drawn, peeled, stored and walked in pieces, against plain loops."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import jsons
from lodestone.operators import insights, snapshots, substrings
from lodestone.sources import records, tree, walk
from lodestone.sources.store import Store


@pytest.mark.parametrize("chunk", [1, 100, 1 << 20])
def test_signatures_of_ordered_members(spark, monkeypatch, chunk):
    monkeypatch.setattr(snapshots, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(f"{'/'.join(rng.choice('abc') for _ in range(rng.randrange(4)))}/f{i}é".lstrip("/"), None if i % 50 == 7 else f"h{i}") for i in range(400)]
    frame = spark.createDataFrame(rows + rows[:3], "path string, hash string").repartition(7)
    own, below = {}, {}
    for path, h in rows + rows[:3]:
        parts = path.split("/")[:-1]
        own.setdefault("/".join(parts) or ".", []).append((path, h))
        for n in range(len(parts) + 1):
            below.setdefault("/".join(parts[:n]) or ".", []).append((path, h))
    want = lambda groups: {d: hashlib.sha256(b"".join(f"{p}:{h}\0".encode() for p, h in sorted(x for x in m if x[1]))).hexdigest() for d, m in groups.items()}
    assert {r["dir"]: r["sig"] for r in snapshots.subtree_signatures(frame).collect()} == want(below)
    by_member = lambda groups: {d: hashlib.sha256(b"".join(m.encode() + b"\0" for m in sorted(f"{p}:{h}" for p, h in x if h))).hexdigest() for d, x in groups.items()}
    assert {r["dir"]: r["sig"] for r in snapshots.dir_signatures(frame).collect()} == by_member(own)
    assert snapshots.subtree_signatures(frame.limit(0)).count() == 0


def test_contained(spark):
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abé/") for _ in range(rng.randrange(most)))
    needles, texts = [word(6) for _ in range(120)] + ["", None, "ab", "ab"], [word(14) for _ in range(200)] + ["", None, "a"]
    n, t = spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in texts], "text string")
    got = substrings.contained(n, t)
    want = {(a, b) for a in needles for b in texts if a is not None and b is not None and a in b}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoop", "Cartesian"))
    both = {(a, b) for a in needles for b in texts if a is not None and b is not None and (a in b or b in a)}
    assert sorted(map(tuple, substrings.overlapping(n, t).collect())) == sorted(both)
    assert substrings.contained(n.limit(0), t).count() == substrings.contained(n, t.limit(0)).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 30, 31, 500, 10**6])
def test_blocks_keep_to_their_budget(spark, budget):
    rng = random.Random(budget)
    rows = [(rng.randrange(9), i, "é" * rng.randrange(12)) for i in range(150)]
    df = spark.createDataFrame(rows, "rank int, i int, line string").repartition(5)
    got = insights.block(df, "### T", F.col("line"), -F.col("rank"), F.col("i"), budget=budget).first()["text"]
    lines = "".join(f"{x}\n" for _, _, x in sorted(rows, key=lambda r: (-r[0], r[1])))
    assert got == f"### T\n```markdown\n{lines}```\n"[:budget]
    assert insights.block(df.limit(0), "### T", F.col("line"), F.col("i")).first()["text"] == "### T\n```markdown\n```\n"


def test_levels_and_cycles(spark):
    needs = {"a": [], "b": ["a", "gone"], "c": ["a", "b"], "x": ["y"], "y": ["z", "a"], "z": ["x"], "behind": ["x"], "feeds": ["a"], "self": ["self"], "z2": ["feeds"], "between": ["x"], "p": ["q", "between"], "q": ["p"]}
    rows = [(k, v) for k, x in needs.items() for v in x]
    got = insights.levels(spark.createDataFrame([(k,) for k in needs], "name string"), spark.createDataFrame(rows + rows[:2], "name string, need string"))
    level = {r["name"]: r["level"] for r in got.collect()}
    assert {k: v for k, v in level.items() if v is not None} == {"a": 0, "b": 1, "c": 2, "feeds": 1, "z2": 2}
    assert {r["name"] for r in got.where("cyclic").collect()} == {"x", "y", "z", "self", "p", "q", "between"} and len(level) == len(needs)
    plain = insights.topo_levels({k: v for k, v in needs.items() if k in ("a", "b", "c", "feeds", "z2")})
    assert {n: i for i, x in enumerate(plain) for n in x} == {k: v for k, v in level.items() if v is not None}
    nothing = spark.createDataFrame([], "name string, need string")
    assert insights.levels(nothing.select("name"), nothing).count() == 0


def drawn(listed, files=True):
    root: dict = {}
    for p in listed:
        at = root
        for part in p.split("/"):
            at = at.setdefault(part, {})
    out = []

    def down(node, ahead):
        named = sorted(node.items(), key=lambda x: (files and not x[1], x[0]))
        for i, (name, inner) in enumerate(named):
            last = i == len(named) - 1
            out.append(ahead + ("└── " if last else "├── ") + name + ("" if files and not inner else "/"))
            down(inner, ahead + ("    " if last else "│   "))

    down(root, "")
    return out


@pytest.mark.parametrize(("n", "files"), [(0, True), (60, True), (60, False), (100_000, True)])
def test_tree_lines(spark, n, files):
    rng = random.Random(n)
    listed = sorted({"/".join([f"d{rng.randrange(8)}" for _ in range(rng.randrange(5))] + [f"f{i}-é"]) for i in range(n)} | ({"a", "b/c", "b-x"} if n else set()))
    df = spark.createDataFrame([(p,) for p in listed], "path string").repartition(6)
    got = [r["line"] for r in insights.tree_lines(df, files).orderBy("order").collect()]
    assert got == drawn(listed, files)


def test_store_keeps_the_last(spark, tmp_path):
    store = Store(spark, str(tmp_path / "cache"))
    ask = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "key string, n int")
    put = lambda rows, version: store.put(spark.createDataFrame(rows, "key string, text string"), version)
    told = lambda s: sorted((r["n"], r["text"]) for r in s.get(ask).collect())
    assert told(store) == [(1, None), (2, None), (3, None), (4, None)]
    put([("a", "x"), ("b", "y"), ("b", "z")], 1)
    put([("a", "w")], 2)
    put([("a", "w")], 2)
    want = [(1, "w"), (2, "w"), (3, "z"), (4, None)]
    assert told(store) == want
    put([("b", "old")], 1)
    assert told(store)[2] == (3, "old")
    store.compact()
    assert told(store) == [(1, "w"), (2, "w"), (3, "old"), (4, None)] and store.all().count() == 2
    put([("c", "new")], 3)
    store.compact()
    assert told(store) == [(1, "w"), (2, "w"), (3, "old"), (4, "new")]
    os.makedirs(tmp_path / "cache" / "generation=9")  # a compaction that was broken off
    assert told(store)[3] == (4, "new")
    for off in (Store(spark, store.folder, disabled=True), Store(spark, store.folder, no_read=True)):
        off.put(spark.createDataFrame([("d", "x")], "key string, text string"), 7)
        assert {r["text"] for r in off.get(ask).collect()} == {None}
    assert {r["key"] for r in store.all().collect()} == {"a", "b", "c", "d"}  # no_read still writes
    with pytest.raises(ValueError):
        put([("a", "x")], 0)
    log = records.call_log(spark, str(tmp_path / "calls"))
    call = spark.createDataFrame([("r1-0", "t", "agent", "b", "m", 1, 0.5, "ok", 1, 1)], log.schema)
    log.put(call, 1)
    log.put(call, 1)
    log.put(call, 2)
    assert log.all().count() == 1


@pytest.fixture
def grove(tmp_path):
    files = {"a.rs": 10, "src/b.RS": 20, "src/deep/er/c.py": 30, "src/deep/big.rs": 5000, "target/x.rs": 1, "src/Target/y/z.rs": 1, ".git/k.rs": 1, "src/.hid/h.rs": 1, "src/none": 3, "src/.env": 2}
    for name, size in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    os.symlink(tmp_path / "src", tmp_path / "link")
    return tmp_path


def test_walk_prunes_before_it_descends(spark, grove, monkeypatch):
    opened = []
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(os.path.relpath(p, grove)) or real(p))
    for folders in ("1", "3", "1000"):
        opened.clear()
        reader = walk.WalkReader({"path": str(grove), "exclude": "TARGET,node_modules", "folders": folders})
        rows = [r for part in reader.partitions() for r in reader.read(part)]
        assert sorted(r[0] for r in rows) == ["a.rs", "src/b.RS", "src/deep/big.rs", "src/deep/er/c.py", "src/none"]
        assert set(opened) == {".", "src", "src/deep", "src/deep/er"}
    shallow = walk.WalkReader({"path": str(grove), "max_depth": "2", "hidden": "true"})
    assert {r[0] for part in shallow.partitions() for r in shallow.read(part)} == {"a.rs", "src/b.RS", "src/none", "src/.env", "target/x.rs", ".git/k.rs"}
    with pytest.raises(ValueError):
        walk.WalkReader({"path": str(grove / "nowhere")})


def test_walk_takes_filters_over(spark, grove):
    spark.dataSource.register(walk.TreeWalk)
    df = spark.read.format("tree_walk").option("exclude", "target").option("content", "true").load(str(grove))
    assert sorted((r["rel_path"], r["size"], len(r["content"])) for r in df.where("size <= 100 AND extension = 'rs'").collect()) == [("a.rs", 10, 10), ("src/b.RS", 20, 20)]
    assert {r["name"] for r in df.where("extension IN ('py', 'rs') AND size > 10 AND name <> 'big.rs'").collect()} == {"b.RS", "c.py"}
    reader = walk.WalkReader({"path": str(grove)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    left = list(reader.pushFilters([EqualTo(("extension",), "rs"), GreaterThan(("size",), 100), StringContains(("name",), "b")]))
    assert [type(f) for f in left] == [StringContains] and [r[0] for p in reader.partitions() for r in reader.read(p)] == ["src/deep/big.rs"]


def test_scan_of_a_walked_tree_equals_that_of_a_listed_one(spark, grove):
    found = lambda df: sorted((r["rel_path"], r["size"], r["content"]) for r in tree.scan(df, str(grove)).collect())
    (grove / "link").unlink()
    assert found(tree.walked(spark, str(grove))) == found(tree.raw(spark, str(grove))) != []


REPLIES = ['{"name":{"path":{"title":"deep"}}}', '{"name":"","id":9}', '{"x":{"name":"n"}}', "[1, \"a\", null, {\"b\":2,\"a\":[]}, \" \"]", '"\\u00e9"', "true", "1.25", "null", "", "{", None, "[" * 100_000, '{"name":' * 12 + '"far"' + "}" * 12]


def test_values_as_columns(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "i int, j string")
    got = {r["i"]: r for r in df.select("i", jsons.to_text(F.col("j")).alias("text"), jsons.to_strings(F.col("j")).alias("strings")).collect()}
    assert [got[i]["text"] for i in range(12)] == ["deep", "9", '{"x":{"name":"n"}}', '[1,"a",null,{"a":[],"b":2}," "]', "é", "true", "1.25", "", "", "", "", ""]
    assert json.loads(got[12]["text"])["name"]  # beyond DEPTH: as its JSON
    assert [got[i]["strings"] for i in (3, 4, 5, 7, 9)] == [["1", "a", '{"a":[],"b":2}'], ["é"], ["true"], [], []]
    assert jsons.find_json("[" * 100_000) is jsons.NOTHING and spark.createDataFrame([("[" * 100_000,)], "t string").select(jsons.extract("t")).first()[0] is None


def test_objects_as_columns(spark):
    one = lambda value, column: spark.createDataFrame([(value,)], "j string").select(column(jsons.variant(F.col("j"))).alias("x")).first()["x"]
    rows = one('[{"name":"a","n":1}, {"n":2}, {"name":null}, "s", 3, "", null, ["q"]]', lambda v: jsons.objects_of(v, "name string, n int", ("name",), "name"))
    assert [tuple(r) for r in rows] == [("a", 1), ("s", None), ("3", None), ('["q"]', None)]
    assert one('{"name":"a"}', lambda v: jsons.objects_of(v, "name string, n int")) == [("a", None)]
    assert one('["s"]', lambda v: jsons.objects_of(v, "name string")) == [] == one("7", lambda v: jsons.objects_of(v, "name string"))
    assert one('[{"name":"a","n":1}]', lambda v: jsons.fitting(v, "name string, n int", ("name",))) == ("a", 1)
    assert one('[{"name":"a"},{"name":"b"}]', lambda v: jsons.fitting(v, "name string")) is None and one('{"n":1}', lambda v: jsons.fitting(v, "name string", ("name",))) is None
    assert [tuple(r) for r in one('[{"step":4,"operation":"x"}, "go", " ", 7]', jsons.steps_of)] == [(4, "x"), (2, "go"), (4, "7")]
    assert [tuple(r) for r in one('[{"name":"a","param_type":1}, "x", {}]', jsons.parameters_of)] == [("a", ""), ("", "")]
    want = ("s", ["a"], ["b"])
    assert tuple(one('{"scope":"s","included_components":"a","excluded_components":["b",1]}', jsons.boundary_of)) == want
    assert tuple(one(json.dumps('{"scope":"s","included_components":["a"],"excluded_components":["b"]}'), jsons.boundary_of)) == want
    assert one('"no"', jsons.boundary_of) is None and one("[1]", jsons.boundary_of) is None
