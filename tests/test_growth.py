"""Steps whose cost must not outgrow their input: what a frame repeats is counted first, a plan does not grow with a search's depth, and frames that grow are never broadcast."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import drift, graph, resolve, snapshots
from lodestone.plans import catalog
from lodestone.plans.views import Views

PAIR = "from string, to string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def items(spark, tmp_path):
    """Two modules of parts, each line of a lineitem five times."""
    spark.range(800).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    rows = [(o, p, p % 7, o % 7 + 1) for o in range(5) for p in range(0, 800, 3) for _ in range(5)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    return Views(spark, str(tmp_path))


def test_an_edge_is_there_once_with_its_count(items):
    edges = items.file_edges()
    rows = edges.collect()
    assert len({tuple(r[c] for c in ("importer", "target", "kind", "test_only", "line")) for r in rows}) == len(rows)
    assert sum(r["n"] for r in rows) == items.read("lineitem").count()
    assert items.file_edges() is edges


def test_shortest_distance_does_not_run_its_hops_again(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(12)], PAIR)
    got = graph.shortest_distance(chain, 6)
    assert "Join" not in plan(got)
    assert {(r["from"], r["to"], r["hops"]) for r in got.collect()} == {(f"c{i}", f"c{j}", j - i) for i in range(13) for j in range(i + 1, min(i + 7, 13))}


def test_frames_that_grow_are_not_broadcast(spark):
    files = spark.createDataFrame([("a/x", "rust"), ("b/y", "rust"), ("c/z", "other")], "file string, lang string")
    claimed = spark.createDataFrame([("a", "dir"), ("b/y", "file")], "node_id string, ep string")
    file_node, nodes, counts = graph.build_nodes(claimed, files)
    assert {tuple(r) for r in file_node.collect()} == {("a/x", "a"), ("b/y", "b/y"), ("c/z", "c")}
    assert {tuple(r) for r in counts.collect()} == {("a", 1, 1), ("b/y", 1, 1), ("c", 0, 0)}
    edges = spark.createDataFrame([("a/x", "b/y", "Import", False, 1), ("a/x", "a/x", "Import", False, 1)], "importer string, target string, kind string, test_only boolean, line int")
    lifted = graph.lift(edges, file_node)
    stats = drift.node_stats(spark.createDataFrame([("a/x", 3, 1)], "importer string, total long, unresolved long"), file_node)
    for df in (file_node, nodes, counts, lifted, stats):
        assert "Broadcast" not in plan(df)
    assert [tuple(r) for r in lifted.collect()] == [("a", "b/y", "a/x", "b/y", "Import", False, 1)]
    assert [tuple(r) for r in stats.collect()] == [("a", 3, 1)]


def test_samples_take_the_first_of_each_part_before_they_meet(spark):
    rows = [("a", "b", f"f{i:03}", "t", i % 2) for i in range(200) for _ in range(3)]
    got = graph.samples(spark.createDataFrame(rows, f"{PAIR}, importer string, target string, line int"))
    assert "WindowGroupLimit" in plan(got)
    assert [(e["file"], e["line"]) for e in got.first()["evidence"]] == [("f000", 0), ("f001", 1), ("f002", 0)]


def test_searches_are_read_one_after_the_other(spark):
    pairs = [(f"s{i}", f"t{i % 3}") for i in range(300)] + [("t0", "t1"), ("t1", "s0")]
    got = graph.claim_distances(spark.createDataFrame(pairs, PAIR))
    assert "FlatMapGroups" not in plan(got)  # that costs about ten milliseconds a start
    rows = {(r["from"], r["to"]): r["hops"] for r in got.collect()}
    assert rows["s3", "t0"] == 1 and rows["s3", "t1"] == 2 and rows["s3", "s0"] == 3 and ("s1", "s3") not in rows
    assert len({f for f, _ in rows}) == 302


def test_imports_are_resolved_in_one_pass(spark, items):
    found = items.rust_imports()
    rows = [tuple(map(str, r)) for r in found.collect()]
    assert len(set(rows)) == len(rows) > 0
    assert len(rows) == items.read("lineitem").where("l_partkey % 40 <> 39").distinct().count()
    got = resolve.rust(found, items.rust_files())
    assert "Union" not in plan(got) and plan(got).count("explode(") == 2  # a path's prefixes and a file's two stems, each once
    told = {(r["tree"], r["importer"], r["seq"]) for r in got.collect()}
    assert len(told) == len(rows)


def test_sets_are_compared_in_one_grouping(spark):
    old = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", None), ("d", "e")], "importer string, target string")
    new = spark.createDataFrame([("c", None), ("a", "b"), ("f", "g"), ("f", "g"), (None, "h")], "importer string, target string")
    got = snapshots.set_changes(old, new)
    assert "Join" not in plan(got) and plan(got).count("Exchange") == 1
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([("d", "e", "removed"), ("f", "g", "added"), (None, "h", "added")], "importer string, target string, change string").collect()))


def test_edges_of_snapshots_are_compared_by_numbers(spark, items):
    docs = [(i, f"text {i}", "en", f"src{i % 5}", 6) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{items.dir}/documents.parquet")
    got = catalog.snapshot_significance(items).first()["reasons"]
    assert not items.made  # no edge was made into texts
    last = items.file_edges().groupBy("importer", "target").agg(F.max("line").alias("line"))
    removed = last.where("line % 2 = 1").count()
    assert removed > 0 and got.endswith(f"; import graph changed (+0 −{removed} edges)")
