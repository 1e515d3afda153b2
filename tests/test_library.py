import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import govern, insights, render, resolve, snapshots
from lodestone.sources import records, tree
from lodestone.streaming import calls as streaming


def js_outcome(spark, paths, importer, spec):
    files = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    found = spark.createDataFrame([(importer, 0, "js", "Import", False, 1, None, 0, [], [], [], spec)], resolve.IMPORTS)
    return tuple(resolve.js(found, files).select("outcome", "target").first())


@pytest.mark.parametrize(
    ("spec", "want"),
    [("./b", ("internal", "src/b.ts")), ("./b.js", ("internal", "src/b.ts")), ("../lib", ("internal", "lib/index.tsx")), ("react", ("external", None)), ("@/b", ("unresolved", None)), ("./none", ("unresolved", None)), ("./user.service", ("internal", "src/user.ts"))],
)
def test_js_resolution(spark, spec, want):
    assert js_outcome(spark, ["src/a.ts", "src/b.ts", "lib/index.tsx", "src/user.ts"], "src/a.ts", spec) == want


def test_python_resolution(spark):
    files = ["pkg/__init__.py", "pkg/a.py", "pkg/sub/__init__.py", "pkg/sub/b.py", "x/util.py", "y/util.py"]
    cases = [
        ("pkg/a.py", 1, ["sub"], ["b", "c"], {("internal", "pkg/sub/b.py"), ("internal", "pkg/sub/__init__.py")}),
        ("pkg/a.py", 1, [], ["sub", "other"], {("internal", "pkg/sub/__init__.py"), ("internal", "pkg/__init__.py")}),
        ("pkg/sub/b.py", 2, ["a"], ["f"], {("internal", "pkg/a.py")}),
        ("pkg/a.py", 0, ["pkg", "sub", "b"], [], {("internal", "pkg/sub/b.py")}),
        ("pkg/a.py", 0, ["util"], [], {("unresolved", None)}),
        ("pkg/a.py", 0, ["os"], [], {("external", None)}),
        ("pkg/a.py", 4, ["q"], [], {("unresolved", None)}),
        ("pkg/a.py", 1, [], [], {("unresolved", None)}),
    ]
    rows = [(i, n, "python", "Import", False, 1, None, level, [], segs, names, None) for n, (i, level, segs, names, _) in enumerate(cases)]
    found = spark.createDataFrame(rows, resolve.IMPORTS)
    got = {}
    for r in resolve.python(found, spark.createDataFrame([(f,) for f in files], "rel_path string")).collect():
        got.setdefault(r["seq"], set()).add((r["outcome"], r["target"]))
    assert got == {n: c[4] for n, c in enumerate(cases)}


def snapshot(spark, files, edges):
    hashes = spark.createDataFrame(list(files.items()), "path string, hash string")
    return {"files": hashes, "dirs": snapshots.dir_signatures(hashes), "edges": spark.createDataFrame(edges, "importer string, target string")}


@pytest.mark.parametrize(
    ("files", "edges", "env", "want"),
    [
        ({"a/x": "1", "b/y": "9"}, [("a/x", "b/y")], False, ("cosmetic", [])),
        ({"a/x": "1", "b/y": "2", "b/z": "3"}, [("a/x", "b/y")], False, ("structural", ["file set changed (+1 −0)"])),
        ({"a/x": "1"}, [], False, ("structural", ["directory set changed (+0 −1)", "file set changed (+0 −1)", "import graph changed (+0 −1 edges)"])),
        ({"a/x": "1", "b/y": "2"}, [("a/x", "b/y")], True, ("structural", ["generation environment changed (language, prompts, models or scan config)"])),
    ],
)
def test_significance(spark, files, edges, env, want):
    old = snapshot(spark, {"a/x": "1", "b/y": "2"}, [("a/x", "b/y")])
    new = snapshot(spark, files, edges)
    diff = snapshots.snapshot_diff(old, new)
    assert tuple(snapshots.significance(diff, env).first()) == want


def test_cosmetic_dirs_and_doc_states(spark):
    changes = spark.createDataFrame([("src/a.py", "changed"), ("top.py", "changed"), ("new.py", "added")], "path string, change string")
    assert {r["dir"] for r in snapshots.cosmetic_dirs(changes).collect()} == {"src", "."}
    docs = spark.createDataFrame([("1.md", "global", True), ("2.md", "global", False), ("deep/Core.md", "deep", True), ("deep/Other.md", "deep", True)], "path string, kind string, there boolean")
    domains = spark.createDataFrame([("Core", "src"), ("Other", "lib")], "name string, code_path string")
    got = {r["path"]: r["state"] for r in snapshots.doc_states(docs, domains, changes.select("path"), False).collect()}
    assert got == {"1.md": "stale", "2.md": "missing", "deep/Core.md": "stale", "deep/Other.md": "fresh"}


def test_records(spark, tmp_path):
    shapes = [{"relationships": {"core_dependencies": [{"from": {"module": "reader"}, "to": "b", "importance": "4"}, "bare"]}}, {"core_dependencies": [{"from": "a", "to": "b"}]}]
    assert records.parse_claims(json.dumps(shapes[0])) == [(0, "reader", "b", "", 4, None)]
    assert records.parse_claims(json.dumps(shapes[1]))[0][1:3] == ("a", "b")
    with pytest.raises(ValueError):
        records.parse_claims("{}")
    research = tmp_path / "research.json"
    research.write_text(json.dumps(shapes[0] | {"more": 1}))
    assert records.export_claims(str(research), str(tmp_path / "out" / "claims.json")) == 2
    assert records.load_claims(spark, str(tmp_path / "out" / "claims.json")).count() == 1
    assert records.load_snapshot(spark, str(tmp_path / "none.json")) is None
    snap = snapshot(spark, {"a/x": "1"}, [("a/x", "b/y")])
    records.save_snapshot(str(tmp_path / "s.json"), snap, "env", "now")
    frames, facts = records.load_snapshot(spark, str(tmp_path / "s.json"))
    assert snapshots.snapshot_diff(snap, frames).count() == 0 and facts["env"] == "env"
    records.save_baseline(str(tmp_path / "b.json"), ["b", "a", "a"])
    assert [r[0] for r in records.load_baseline(spark, str(tmp_path / "b.json")).collect()] == ["a", "b"]
    assert records.load_baseline(spark, str(tmp_path / "no.json")) is None
    assert records.layered({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}, {"b": 1}) == {"a": {"x": 1, "y": 3}, "b": 1}


def test_settings_layers(tmp_path):
    (tmp_path / "g.toml").write_text('a = 1\n[drift]\nx = 1\n[profiles.fast]\na = 5\n')
    (tmp_path / "p.toml").write_text("[drift]\ny = 2\n")
    got = records.load_settings(str(tmp_path / "g.toml"), str(tmp_path / "p.toml"), profile="fast", said={"drift": {"x": 9}})
    assert got == {"a": 5, "drift": {"x": 9, "y": 2}}


def test_calls(spark, tmp_path):
    rows = [(f"2024-01-0{d}T00:0{m}:00Z", "a", "b", "m", 1, 1.0, "ok", None, None) for d in (1, 2) for m in range(3)]
    calls = spark.createDataFrame(rows, govern.CALLS)
    records.append_calls(calls, str(tmp_path / "calls"))
    back = records.load_calls(spark, str(tmp_path / "calls"))
    assert {r["date"]: r["n"] for r in govern.daily(back).collect()} == {"2024-01-01": 3, "2024-01-02": 3}
    assert govern.admitted(back, 2).where("admitted").count() == 4
    assert govern.audit(back).first()["calls"] == 6
    assert govern.worst(spark.createDataFrame([("ok",), ("warn",)], "status string")).first()[0] == "warn"
    lined = calls.withColumn("line", F.lit(1).cast("long"))
    assert govern.last_call(lined).first()["n"] == 6
    later = calls.limit(1).withColumn("ts", F.lit("2024-02-01T00:00:00Z"))  # closes the days before
    records.append_calls(later, str(tmp_path / "calls"))
    query = streaming.to_table(streaming.daily_counts(streaming.stream(spark, str(tmp_path / "calls"))), "daily_calls", str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert spark.table("daily_calls").agg(F.sum("n")).first()[0] == 6


def test_cache(spark):
    requests, entries = spark.createDataFrame([("k",), ("m",)], "key string"), spark.createDataFrame([("k", "hit")], "key string, text string")
    assert {r["key"]: r["text"] for r in govern.cached(requests, entries).collect()} == {"k": "hit", "m": None}
    assert govern.cached(requests, entries, no_read=True).where("text is not null").count() == 0


def test_scan(spark, tmp_path):
    for path, body in {"README.md": "hi", "src/a.py": "x=1", "src/.hidden": "x", "node_modules/m.js": "x", "img.png": "x", "bin": "a\0b", "Cargo.lock": "x", "docs/out.md": "x", "a/b/c.rs": "fn"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    root = str(tmp_path)
    got = tree.scan(tree.raw(spark, root), root, output="docs")
    assert {r["rel_path"] for r in got.collect()} == {"README.md", "src/a.py", "a/b/c.rs"}
    assert insights.readme(got).first()["rel_path"] == "README.md"
    tracked = spark.createDataFrame([("src/a.py",)], "rel_path string")
    assert [r["rel_path"] for r in tree.scan(tree.raw(spark, root), root, tracked=tracked).collect()] == ["src/a.py"]
    dirs = {r["dir"]: (r["n_files"], r["subdirectories"]) for r in insights.directories(got).collect()}
    assert dirs == {"": (1, 1), "src": (1, 0), "a/b": (1, 0)}


def test_insights(spark):
    rows = [("d1", 0, 0.5, "Api", "src/a.py", [("x",), ("y",)]), ("d1", 1, 0.9, "Dao", "src/b.sql", [("z",)]), ("d2", 0, 0.9, "Other", "lib/c.py", [])]
    df = spark.createDataFrame(rows, "dir string, idx int, importance_score double, purpose string, file_path string, interfaces array<struct<name:string>>")
    assert [r["file_path"] for r in insights.top(df, 2).collect()] == ["src/b.sql", "lib/c.py"]
    assert [r["file_path"] for r in insights.boundary(df).collect()] == ["src/a.py"]
    assert [r["file_path"] for r in insights.database(df).collect()] == ["src/b.sql"]
    assert [r["file_path"] for r in insights.key_module(df, spark.createDataFrame([("lib",)], "code_path string")).collect()] == ["lib/c.py"]
    assert {r["dir"]: r["names"] for r in insights.interfaces(df, 2).collect()}["d1"] == ["x", "y"]
    text = insights.block(df, "### T", F.concat(F.lit("- "), "file_path"), -F.col("importance_score"), F.col("dir")).first()["text"]
    assert text == "### T\n```markdown\n- src/b.sql\n- lib/c.py\n- src/a.py\n```\n"
    results = spark.createDataFrame([("b", "1", 0), ("a", "2", 1), ("b", "3", 2)], "key string, value string, ord int")
    assert insights.fan_in(results).first()["results"] == {"a": "2", "b": "3"}


def test_levels():
    assert insights.topo_levels({"a": [], "b": ["a", "gone"], "c": ["a", "b"]}) == [["a"], ["b"], ["c"]]
    with pytest.raises(ValueError):
        insights.topo_levels({"a": ["b"], "b": ["a"]})


def test_report_text():
    base = {"kind": None, "importance": None, "detail": None, "evidence": []}
    findings = [
        base | {"id": "confirmed:a->b", "class": "confirmed", "from": "a", "to": "b", "reason": "direct_evidence", "kind": "import", "importance": 5},
        base | {"id": "phantom:a->c", "class": "phantom", "from": "a", "to": "c", "reason": "phantom", "kind": "import", "importance": 2},
        base | {"id": "unverifiable:a->d", "class": "unverifiable", "from": "a", "to": "d", "reason": "unknown_endpoint"},
        base | {"id": "undocumented:e->f", "class": "undocumented", "from": "e", "to": "f", "reason": "undocumented", "detail": "4 import site(s)", "evidence": [{"file": "e/x.py", "target": "f/y.py", "line": 2}]},
    ]
    report = render.drift_report(findings, "claims.json", 3, ["h"], {"u8_thin": 1})
    assert report["coverage"] == {"checked": 2, "total": 3, "ratio": 0.6667}
    assert render.drift_text(report, True).split("\n") == [
        "claims: claims.json (3 edges)", "coverage: 2/3 claims checked (67%) — 1 unverifiable", "  ok   1 confirmed (1 direct_evidence)", " info  1 unverifiable", "        a -> d [unknown_endpoint]", "        (1 unknown_endpoint)",
        " warn  1 phantom", "        a -> c [import, importance 2]", " warn  1 undocumented", "        e -> f", "          e.g. e/x.py:2 (-> f/y.py)", "          4 import site(s)", "hubs: h", "filtered: u8_thin=1", "result: 1 finding(s) would fail under --strict", "",
    ]
    assert (render.exit_code(report, True), render.exit_code(report), render.exit_code(None)) == (1, 0, 2)


def test_registry(spark):
    from lodestone.operators import registry

    assert registry.tasks(spark).count() == 15
    assert registry.levels()[0] == ["dir_summary"] and registry.levels("compose")[0][0] == "overview"
    value = {"domain_modules": [{"name": "A", "x": 1}, {"name": "B"}]}
    assert registry.projected("key_module", "domain_modules", "A", value) == {"domain": {"name": "A", "x": 1}, "other_domains": ["B"]}
    assert registry.projected("overview", "domain_modules", None, value) == value
    assert registry.projected("deep_dive", "key_module", "A", {"A": 1, "B": 2}) == 1
    assert registry.inputs("dir_summary", "src", {"src": "s", ".": "all"}) == "s" and registry.inputs("workflow", None, {".": "all"}) == "all"
    assert registry.parsed({"a": int}, 'x {"a": 1}') == {"a": 1} and registry.parsed(None, " t ") == "t"
    with pytest.raises(ValueError):
        registry.parsed(None, "  ")
    assert sum(r["instances"] for r in registry.dry_run(["a", "b"], ["x"])) == 2 + 14


def test_documents(spark, tmp_path):
    from lodestone.sources import documents, git

    out, record, research = str(tmp_path / "out"), str(tmp_path / "state" / "written.json"), tmp_path / "research.json"
    research.write_text("{}")
    documents.write(out, {"1.Overview.md": "x", "4.Deep-Exploration/A.md": "a", "4.Deep-Exploration/B.md": "b"}, record)
    (tmp_path / "out" / "4.Deep-Exploration" / "own.md").write_text("mine")
    assert documents.reusable(out, str(research), record)
    documents.write(out, {"1.Overview.md": "y", "4.Deep-Exploration/A.md": "a"}, record)
    assert sorted(p.name for p in (tmp_path / "out" / "4.Deep-Exploration").iterdir()) == ["A.md", "own.md"]
    assert not documents.reusable(out, str(tmp_path / "none"), record)
    docs = spark.createDataFrame([("1.Overview.md", "```mermaid\nx\n```"), ("3.Workflow.md", "")], "path string, content string")
    got = {(r["path"], r["issue"]) for r in documents.verified(docs).collect()}
    assert ("2.Architecture.md", "missing") in got and ("3.Workflow.md", "empty") in got and ("4.Deep-Exploration/", "missing") in got and ("1.Overview.md", "line 1: unknown mermaid header `x`") in got
    assert documents.output_key("docs", str(tmp_path)) == documents.output_key("./x/../docs", str(tmp_path))
    assert documents.template("a.md", None, {"a.md": "t"}) == "t"
    assert documents.env_fingerprint(["a", "b"]) != documents.env_fingerprint(["ab", ""])
    assert git.head(str(tmp_path)) is None


def test_summary_and_documents_of_reports():
    from lodestone.functions import jsons

    body, text = render.summary({"generated_at": "now", "project": "p", "total_secs": 1.25, "cap": 9}, {"calls": 2, "hits": 1, "quota_used": 2}, [("2.md", "missing"), ("1.md", "line 1: x")], [("a", 0.5)])
    assert body["calls"] == 2 and "- Missing documents: 2.md" in text and "- 1.md: line 1: x" in text and "| a | 0.5 |" in text
    doc = render.database_doc({"tables": [{"name": "t", "schema": "s", "columns": [{"name": "id|x", "data_type": "int", "nullable": False}], "primary_key": ["id", "y"], "source_path": "a.sql"}], "views": [],
        "stored_procedures": [{"name": "p", "parameters": [{"name": "@a", "data_type": "int", "direction": "IN", "is_optional": True}], "referenced_tables": ["t", "u"]}], "database_functions": [{"schema": "s", "name": "f", "return_type": "int"}],
        "table_relationships": [{"from_table": "a-b", "from_columns": ["x", "y"], "to_table": "c", "to_columns": ["z"], "relationship_type": "FK"}], "data_flows": [{"name": "load", "source": "a", "destination": "b", "operations": ["read", "write"]}],
        "database_projects": [{"name": "db", "project_path": "p/db", "table_count": 2, "references": ["x"]}], "confidence_score": 7})
    assert doc.split("\n") == [
        "## Database Overview", "", "### Summary", "", "| Metric | Count |", "|---|---|", "| Database Projects | 1 |", "| Tables | 1 |", "| Views | 0 |", "| Stored Procedures | 1 |", "| Functions | 1 |", "| Relationships | 1 |", "",
        "### Database Projects", "", "#### `db`", "", "- Path: `p/db`", "- Objects: 2 tables, 0 views, 0 procedures, 0 functions", "- References: x", "",
        "### Tables", "", "#### `s.t`", "", "| Column | Type | Nullable | Identity | Default |", "|---|---|---|---|---|", "| id\\|x | int | false |  |  |", "", "**Primary key**: id, y", "", "**Source**: `a.sql`", "",
        "### Stored Procedures", "", "#### `p`", "", "**Parameters**:", "", "- `@a` int (IN, optional)", "", "**Tables**: t, u", "", "### Functions", "", "#### `s.f`", "", "**Returns**: `int`", "",
        "### Table Relationships", "", "```mermaid", "erDiagram", '    a_b ||--o{ c : "FK"', "```", "", "| From Table | From Columns | To Table | To Columns | Type |", "|---|---|---|---|---|", "| a-b | x, y | c | z | FK |", "",
        "### Data Flows", "", "#### load", "", "- a → b", "- Operations: read, write", "", "---", "", "**Analysis Confidence**: 7.0/10", "",
    ]
    doc = render.boundary_doc({"cli_boundaries": [{"command": "run", "description": "Runs.", "source_location": "m.rs", "arguments": [{"name": "path", "value_type": "string", "required": True, "description": "where"}],
        "options": [{"name": "--jobs", "short_name": "-j", "value_type": "int", "description": "how many", "default_value": 4}], "examples": ["run ."]}], "router_boundaries": [{"path": "/a", "params": [{"key": "id", "value_type": "int", "description": "which"}]}],
        "api_boundaries": [{"method": "GET", "endpoint": "/b", "authentication": "token"}], "integration_suggestions": [{"integration_type": "SDK", "description": "Use it.", "example_code": "x()", "best_practices": ["Retry"]}]})
    assert doc.split("\n")[4:] == [
        "## Command Line Interface (CLI)", "", "### run", "", "**Description**: Runs.", "", "**Source File**: `m.rs`", "", "**Arguments**:", "", "- `path` (string): required - where", "",
        "**Options**:", "", "- `--jobs, -j` (int): optional - how many (default: `4`)", "", "**Usage Examples**:", "", "```bash", "run .", "```", "", "## API Interfaces", "", "### GET /b", "", "**Authentication**: token", "",
        "## Router Routes", "", "### /a", "", "**Parameters**:", "", "- `id` (int): which", "", "## Integration Suggestions", "", "### SDK", "", "Use it.", "", "**Example Code**:", "", "```", "x()", "```", "", "**Best Practices**:", "", "- Retry", "",
        "---", "", "**Analysis Confidence**: 0.0/10", "",
    ]
    told = render.status_text({"project": "p", "manifest": "m.json", "manifest_written_at": "now", "manifest_git_head": "abc", "commits_since": 2, "research_age_secs": 7300, "classification": "cosmetic", "reasons": ["x"], "files": {"added": 1}, "docs": [{"path": "a.md", "state": "fresh", "age_secs": 90}]})
    assert told.split("\n") == ["status of p", "", "manifest: m.json (now)", "git: documented at abc, 2 commit(s) since", "research: 2h ago", "", "status: cosmetic", "  - x", "files: added 1", "  fresh   a.md (1m ago)", ""]
    assert "manifest: none" in render.status_text({"project": "p", "manifest_written_at": None, "research_age_secs": None, "classification": "full"}) and render.status_text({"classification": "full"}) == "status: full\n"
    assert jsons.system_boundary('{"scope": "s", "included_components": "a"}') == {"scope": "s", "included_components": ["a"], "excluded_components": []}
    with pytest.raises(ValueError):
        jsons.system_boundary("no")
    assert jsons.flow_steps([{"step": 4}, "go", " "]) == [{"step": 4}, {"step": 2, "operation": "go"}]
    assert jsons.parameters([{"name": "a", "param_type": 1}, "x"]) == [{"name": "a", "param_type": ""}]


def test_endpoints_that_exist_but_were_not_scanned(spark, tmp_path):
    from lodestone.operators import drift
    from lodestone.plans import drift_check

    for name in ("src/a.py", "assets/img/logo.png", "deep/src/b.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    places = drift_check.places(spark.createDataFrame([("src/a.py",), ("deep/src/b.py",)], "rel_path string"))
    claims = spark.createDataFrame([(0, "`assets/`", "src/a.py", "import", 1), (1, "./assets/img/logo.png", "a.py", "import", 1), (2, "assets/none", "", "import", 1)], "ord int, from string, to string, dependency_type string, importance int")
    told = lambda disk: {r["ord"]: (r["from"], r["from_ep"], r["to"], r["to_ep"]) for r in drift.normalized(claims, places, disk).collect()}
    assert told(tree.on_disk(spark, str(tmp_path))) == {0: ("assets", "dir", "src/a.py", "file"), 1: ("assets/img/logo.png", "file", "src/a.py", "file"), 2: ("assets/none", "unknown", "", "empty")}
    assert told(None)[0][1] == told(None)[1][1] == "unknown"
