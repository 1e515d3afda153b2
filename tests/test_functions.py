import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import importing, jsons, labels, paths
from lodestone.functions import text as texts
from lodestone.functions.sanitize import sanitize


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_paths(spark):
    assert values(spark, lambda X: paths.parent(X), ["a/b/c.py", "c.py"]) == ["a/b", ""]
    assert values(spark, lambda X: paths.extension(X), ["a/b.TS", "a/.env", "Makefile", "x.d.ts"]) == ["ts", None, None, "ts"]
    assert values(spark, lambda X: paths.ancestors(X), ["a/b/c.py", "c.py"]) == [["", "a", "a/b"], [""]]
    assert values(spark, lambda X: paths.suffixes(X), ["a/b/c.py", "c.py"]) == [["b/c.py", "c.py"], []]
    assert values(spark, lambda X: paths.lexical(X), ["a/./b/../c", "../x", "a//b"]) == ["a/c", "x", "a/b"]
    assert values(spark, lambda X: paths.human_age(X), [119, 120, 7200, 172_800], "long") == ["119s ago", "2m ago", "2h ago", "2d ago"]
    assert values(spark, lambda X: paths.sanitized_name(X), [' a/b:c*"d ']) == ["a-b-c--d"]
    assert values(spark, lambda X: paths.mermaid_id(X), ["dbo.Users-x"]) == ["dbo_Users_x"]
    assert values(spark, lambda X: paths.capped(X, 3), ["abcd", "abc"]) == ["abc\n[truncated]", "abc"]
    assert values(spark, lambda X: paths.rendered("Hi {{name}} {{other}}", {"name": X}), ["Bo"]) == ["Hi Bo {{other}}"]


def test_paths_sort_by_component(spark):
    df = spark.createDataFrame([("a-b/x",), ("a/b",), ("a",)], "p string").orderBy(paths.components(F.col("p")))
    assert [r["p"] for r in df.collect()] == ["a", "a/b", "a-b/x"]


def test_ancestry_needs_a_whole_component(spark):
    df = spark.createDataFrame([("src", "src/a"), ("src", "srcs/a"), ("", "a"), ("a", "a")], "a string, b string")
    assert [r[0] for r in df.select(paths.is_ancestor(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


@pytest.mark.parametrize(("glob", "path", "hit"), [("tests/**", "tests/a/b.py", True), ("**/error.*", "error.rs", True), ("**/error.*", "src/error.rs", True), ("**/error.*", "src/errors.rs", False), ("**/*_test.*", "x/a_test.go", True), ("*.lock", "Cargo.lock", True), ("**/utils/**", "a/utils/b.py", True)])
def test_globs(spark, glob, path, hit):
    assert values(spark, lambda X: paths.matches_any(X, (glob,)), [path]) == [hit]


def test_importance_is_capped(spark):
    df = spark.createDataFrame([("cmd/main/config/schema.rs", 2000, "rs"), ("notes.txt", 1, "txt")], "p string, s long, e string")
    assert [round(r[0], 6) for r in df.select(paths.importance(F.col("p"), F.col("s"), F.col("e"))).collect()] == [1.0, 0.0]


def test_labels(spark):
    assert values(spark, lambda X: labels.code_purpose(X), ["entry point", "???", "Agent Tool", "main", "mainly", "SQL"]) == ["Entry", "Other", "Agent", "Entry", "Other", "Database"]
    assert values(spark, lambda X: labels.directory_purpose(X), ["SRC", "app-config", "tests", "x"]) == ["Core", "Config", "Test", "Other"]
    assert values(spark, lambda X: labels.dependency_type(X), [" Import", "uses", "calls", "data flow", "data", ""]) == ["import", "module", "function_call", "data_flow", "module", "module"]
    assert values(spark, lambda X: labels.project_type(X), ["CLI", "web", "?"]) == ["CLITool", "FrontendApp", "Other"]
    assert values(spark, lambda X: labels.backend(X), ["opencode:openai/x#high", "Claude", "test:", "nope:x"]) == [("opencode", "openai/x#high"), ("claude", None), ("mock", None), (None, None)]


def test_lenient_scalars(spark):
    rows = ["4", '"4"', '" 8"', '"4.0"', "-3", "true", "null", '"1e3"', "300", '"yes"', "2.5", None]
    assert values(spark, lambda X: jsons.number(X), rows) == [4.0, 4.0, 0.0, 4.0, -3.0, 1.0, 0.0, 1000.0, 300.0, 0.0, 2.5, 0.0]
    assert values(spark, lambda X: jsons.size(X), rows) == [4, 4, 0, 0, 0, 1, 0, 0, 300, 0, 0, 0]
    assert values(spark, lambda X: jsons.byte(X), rows) == [4, 4, 0, 0, 0, 1, 0, 0, 255, 0, 0, 0]
    assert values(spark, lambda X: jsons.boolean(X), rows) == [True, False, False, False, True, True, False, False, True, True, False, False]


def test_lenient_structures(spark):
    assert values(spark, lambda X: jsons.to_text(X), ['{"module":"reader"}', '{"x":1}', "[1,2]", '"a"', "true", None]) == ["reader", '{"x":1}', "[1,2]", "a", "true", ""]
    assert values(spark, lambda X: jsons.to_strings(X), ['["a"," ",1]', '"x"', "null"]) == [["a", "1"], ["x"], []]
    assert jsons.objects([{"a": 1}, "b", 3, None], fallback=lambda t: {"t": t}) == [{"a": 1}, {"t": "b"}, {"t": "3"}]
    assert jsons.objects({"a": 1}) == [{"a": 1}]
    assert jsons.checked([{"a": 1}], {"a": int}) == {"a": 1}
    assert jsons.checked({"a": "x"}, {"a": int}) is None


@pytest.mark.parametrize(("text", "value"), [('{"a": 1}', {"a": 1}), ('x\n```json\n{"a": [1]}\n```', {"a": [1]}), ('so {"a": "}{\\"", "b": 2} end', {"a": '}{"', "b": 2}), ("none", jsons.NOTHING), ("{broken", jsons.NOTHING), ("null", None), ("NaN", jsons.NOTHING), ('{"a": Infinity}', jsons.NOTHING), ("```json\n[1] x\n```", [1]), ("```json\n{", jsons.NOTHING)])
def test_find_json(text, value):
    assert jsons.find_json(text) == value


def test_json_column(spark):
    assert json.loads(values(spark, lambda X: jsons.extract(X), ['see: [1, {"b": 2}]'])[0]) == [1, {"b": 2}]


def test_text_metrics(spark):
    assert values(spark, lambda X: texts.lines_of_code(X), ["a\n\n \t\nb\n", ""]) == [2, 0]
    assert values(spark, lambda X: texts.occurrences(X, "if "), ["if if if x", ""]) == [3, 0]
    assert values(spark, lambda X: texts.is_external(X), ["./a", "crate::x", "os", "selfish"]) == [False, False, True, False]
    assert values(spark, lambda X: texts.has_nul(X), [bytearray(b"a\x00"), bytearray(b"\x10\x01"), bytearray(b"x" * 5000 + b"\x00")], "binary") == [True, False, False]


def test_statics():
    got = texts.statics("py", "import os\nfrom a.b import c\n\nclass A:\n    def run(self):\n        if x:\n            pass\n    def run(self):\n        pass\n")
    assert (got["loc"], got["n_functions"], got["n_classes"], got["cyclomatic"]) == (8, 1, 1, 1.0)
    assert [d["name"] for d in got["dependencies"]] == ["os", "a.b"]
    assert [(i["name"], i["signature"]) for i in got["interfaces"]] == [("run", "def run(self):"), ("A", "class A:")]


def test_diagrams():
    assert texts.mermaid_issues("```mermaid\ngraph TD\nA-->B\n```\n") == []
    assert texts.mermaid_issues("```mermaid\nnope\nx\n```\n```mermaid\npie\n```\n```mermaid\ngraph") == ["line 1: unknown mermaid header `nope`", "line 5: empty diagram", "line 8: unterminated mermaid block"]


@pytest.mark.parametrize(
    ("language", "text", "clean"),
    [
        ("rust", "a // crate::x\nb", "a            \nb"),
        ("rust", "/* a /* b */ c */d", " " * 17 + "d"),
        ("rust", 'x("q\\"r") r#"s"t"# \'c\' &\'a T', "x(      )            " + "    &'a T"),
        ("python", 's = """a\nb"""  # c\n', "s =     \n         \n"),
        ("python", "x = 'a\ny", "x =   \ny"),
        ("js", "import 'a' // b\n`c`", "import 'a'     \n   "),
    ],
)
def test_sanitize(language, text, clean):
    got = sanitize(language, text)
    assert len(got) == len(text) and got.split() == clean.split() and [i for i, c in enumerate(got) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


def test_use_trees():
    assert importing.use_paths("crate::{a, b::{c, d as e}, f::*}") == [["crate", "a"], ["crate", "b", "c"], ["crate", "b", "d"], ["crate", "f", "*"]]


def test_python_imports():
    text = "from .a import b, c as d\nfrom ..p.q import (\n    x,\n    y,\n)\nimport m.n, o\nfrom . import z\n"
    got = [(f.levels, ".".join(f.segs), f.names, f.line) for f in importing.python(text, "pkg/x.py", False)]
    assert got == [(1, "a", ["b", "c"], 1), (2, "p.q", ["x", "y"], 2), (1, "", ["z"], 7), (0, "m.n", [], 6), (0, "o", [], 6)]
    assert [f.kind for f in importing.python("from .a import b\nimport c\n", "pkg/__init__.py", False)] == ["ReExport", "Import"]


def test_js_imports():
    text = "import a from './a';\nimport './b';\nexport * from './c';\nconst d = require('d');\nimport('./e');\n"
    assert [(f.spec, f.kind, f.line) for f in importing.js(text, False)] == [("./a", "Import", 1), ("./b", "Import", 2), ("./c", "ReExport", 3), ("d", "Import", 4), ("./e", "Import", 5)]


def test_rust_imports():
    text = "pub use crate::a::B;\nmod c;\n#[cfg(test)]\nmod tests {\n    use super::*;\n}\nfn f() { super::g::h(); }\n"
    got = [(f.kind, f.root, f.segs, f.test_only, f.line) for f in importing.rust(text, False)]
    assert got == [("ReExport", "crate", ["a", "B"], False, 1), ("Import", "super", ["*"], True, 5), ("InlinePath", "super", ["g", "h"], False, 7), ("ModDecl", "self", ["c"], False, 2)]


def test_many_uses_and_modules_take_time_in_proportion():
    import time

    from lodestone.functions import importing

    def took(n):
        text = "".join(f"mod m{i} {{ use super::a{i}::{{b, c}}; fn f() {{ crate::x::y(); }} }}\n" for i in range(n))
        began = time.process_time()
        found = list(importing.rust(text, False))
        assert len(found) == 3 * n and all(f.inline in ([], [f"m{i // 2}"]) for i, f in enumerate(found[: 2 * n]))
        return time.process_time() - began

    took(200)
    assert took(8000) < 12 * took(2000) + 0.2


def test_nested_modules_and_tests_of_a_rust_file():
    from lodestone.functions import importing

    text = "mod a { mod b { use super::x; } use super::y; }\n#[cfg(test)]\nmod tests { mod deep { use super::z; } }\nuse q::{r, s}; crate::t::u();"
    got = [(f.kind, f.inline, f.segs, f.test_only) for f in importing.rust(text, False)]
    assert got == [("Import", ["a", "b"], ["x"], False), ("Import", ["a"], ["y"], False), ("Import", ["tests", "deep"], ["z"], True), ("Import", [], ["q", "r"], False), ("Import", [], ["q", "s"], False), ("InlinePath", [], ["t", "u"], False)]
