import pytest
from pyspark.sql import functions as F

from lodestone.operators import drift, graph
from lodestone.plans import drift_check
from tests import trees


_DONE = {}


def analyzed(spark, tree, claims):
    """One analysis for each tree and set of claims."""
    key = (id(tree), id(claims))
    if key not in _DONE:
        _DONE[key] = drift_check.analyze(*trees.frames(spark, tree, claims))
    return _DONE[key]


def verdicts(outcome, column):
    return {(r["from"], r["to"]): r[column] for r in outcome.findings.collect() if r["class"] != "undocumented"}


@pytest.mark.parametrize(
    ("tree", "claims", "column"),
    [(trees.APP, trees.APP_CLAIMS, "class"), (trees.FLEET, trees.FLEET_CLAIMS, "reason"), (trees.BOARD, trees.BOARD_CLAIMS, "reason"), (trees.LEDGER, trees.LEDGER_CLAIMS, "reason")],
    ids=["app", "fleet", "board", "ledger"],
)
def test_verdicts(spark, tree, claims, column):
    outcome = analyzed(spark, tree, claims)
    assert verdicts(outcome, column) == {c[:2]: c[4] for c in claims}


def test_app_coverage_and_filters(spark):
    outcome = analyzed(spark, trees.APP, trees.APP_CLAIMS)
    assert drift.coverage(outcome.findings).first().asDict() == {"checked": 7, "total": 8, "ratio": 0.875}
    assert {r["filter"]: r["n"] for r in outcome.filtered.collect()} == {"u8_thin": 1}
    outcome = drift_check.analyze(*trees.frames(spark, trees.APP, trees.APP_CLAIMS), drift.Settings(min_imports=1))
    assert [(r["from"], r["to"]) for r in outcome.findings.where("class = 'undocumented'").collect()] == [("src/main.py", "src/storage.py")]


def test_app_baseline(spark):
    findings = analyzed(spark, trees.APP, trees.APP_CLAIMS).findings
    ids = [r["finding_id"] for r in drift.new_baseline(findings).collect()]
    assert ids == ["phantom:src/models.py->src/main.py", "reversed:src/models.py->src/api.py"]
    baseline = spark.createDataFrame([(ids[0],), ("phantom:gone->gone",)], "finding_id string")
    assert drift.baseline_info(findings, baseline).first().asDict() == {"known": 1, "new": 7, "stale": 1}
    assert drift.strict_failures(drift.with_baseline(findings, baseline)).count() == 1


def test_undocumented_edges_show_their_evidence(spark):
    outcome = drift_check.analyze(*trees.frames(spark, trees.FLEET, trees.FLEET_CLAIMS), drift.Settings(min_imports=2))
    (row,) = outcome.findings.where("class = 'undocumented'").collect()
    assert (row["from"], row["to"], row["detail"]) == ("fleet/depot", "fleet/geo.py", "2 import site(s)")
    assert [(e["file"], e["line"]) for e in row["evidence"]] == [("fleet/depot/doors.py", 1), ("fleet/depot/stock.py", 2)]
    assert drift.coverage(outcome.findings).first().asDict() == {"checked": 6, "total": 13, "ratio": round(6 / 13, 4)}


@pytest.mark.parametrize(("tree", "claims", "n"), [(trees.FLEET, trees.FLEET_CLAIMS, {"u2_containment": 3, "u8_thin": 3}), (trees.BOARD, trees.BOARD_CLAIMS, {"u8_thin": 2}), (trees.LEDGER, trees.LEDGER_CLAIMS, {"u3_weak_evidence": 3, "u8_thin": 3})])
def test_filtered_edges(spark, tree, claims, n):
    outcome = analyzed(spark, tree, claims)
    assert {r["filter"]: r["n"] for r in outcome.filtered.collect()} == n


def edges(spark, pairs, kind="Import"):
    return spark.createDataFrame([(a, b, f"{a}.py", f"{b}.py", kind, False, 1) for a, b in pairs], "from string, to string, importer string, target string, kind string, test_only boolean, line int")


def test_shortest_path_and_blocked_hub(spark):
    g = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "hub"), ("hub", "d")])
    wanted = spark.createDataFrame([("a", "d")], "from string, to string")
    none = spark.createDataFrame([], "node_id string")
    hub = spark.createDataFrame([("hub",)], "node_id string")
    assert graph.shortest_paths(g, wanted, none).first()["path"] == ["a", "hub", "d"]
    assert graph.shortest_paths(g, wanted, hub).first()["path"] == ["a", "b", "c", "d"]
    assert graph.shortest_paths(g, wanted, hub, 2).count() == 0


def test_hubs(spark):
    g = edges(spark, [(f"n{i}", "hot") for i in range(8)])
    nodes = lambda n: spark.range(n).select(F.col("id").cast("string").alias("node_id"))
    assert graph.hubs(g, nodes(10)).count() == 1
    assert graph.hubs(g, nodes(10), least=20).count() == 0
    assert graph.hubs(g, nodes(40)).count() == 0


def test_facade_closure(spark):
    rows = [("a.rs", "pkg/mod.rs", "Import", False, 3), ("pkg/mod.rs", "pkg/inner.rs", "ReExport", False, 1), ("pkg/mod.rs", "pkg/other.rs", "ReExport", False, 2)]
    df = spark.createDataFrame(rows, "importer string, target string, kind string, test_only boolean, line int")
    more = graph.facade_closure(df).where("kind = 'Facade'").collect()
    assert {(r["importer"], r["target"], r["line"]) for r in more} == {("a.rs", "pkg/inner.rs", 3), ("a.rs", "pkg/other.rs", 3)}


def test_claim_distance_is_that_of_discovery(spark):
    claims = spark.createDataFrame([("a", "c"), ("a", "d"), ("c", "b"), ("d", "e"), ("e", "b")], "from string, to string")
    found = {(r["from"], r["to"]): r["hops"] for r in graph.claim_distances(claims).collect()}
    assert found["a", "b"] == 3
    short = {(r["from"], r["to"]): r["hops"] for r in graph.shortest_distance(claims, 4).collect()}
    assert short["a", "b"] == 2


def test_dedupe_keeps_the_first_row_and_the_best_kind(spark):
    rows = [(0, "a", "b", "file", "file", "import", 2), (1, "a", "b", "file", "file", "module", 5), (2, "a", "b", "file", "file", "composition", 5)]
    df = spark.createDataFrame(rows, "ord int, from string, to string, from_ep string, to_ep string, kind string, importance int")
    assert drift.deduped(df).select("ord", "kind", "importance").first() == (0, "module", 5)


def test_normalized_endpoints(spark):
    files = [("src/agent/mod.rs", "file"), ("src/agent", "dir"), ("src/config.rs", "file"), ("lib/config.rs", "file"), ("src", "dir"), ("lib", "dir")]
    places = spark.createDataFrame(files, "path string, ep string")
    raw = ["`src/agent`", "./agent", "src (config.rs, cli.rs)", "  ", ".", "config.rs", "nowhere", "src/"]
    claims = spark.createDataFrame([(i, r, "src", "import", 1) for i, r in enumerate(raw)], "ord int, from string, to string, dependency_type string, importance int")
    got = {r["ord"]: (r["from"], r["from_ep"]) for r in drift.normalized(claims, places).collect()}
    assert [got[i] for i in range(8)] == [("src/agent", "dir"), ("src/agent", "dir"), ("src", "dir"), ("", "empty"), (".", "empty"), ("config.rs", "unknown"), ("nowhere", "unknown"), ("src", "dir")]


def test_settings_are_held_to_their_ranges():
    s = drift.Settings().merged({"max_depth": 0, "min_coverage": 7, "hub_ratio": -1, "min_imports": 0, "ignore_nodes": ["x"]})
    assert (s.max_depth, s.min_coverage, s.hub_ratio, s.min_imports, s.ignore_nodes) == (1, 1.0, 0.0, 1, ("x",))
