"""Free-text labels to closed sets: ordered first-match rules, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in order of precedence: (purpose, substrings, whole labels).
CODE_PURPOSES = (
    ("SpecificFeature", ("specificfeature",), ("feature",)),
    ("Widget", ("frontenduicomponent",), ("widget",)),
    ("Page", ("frontenduipage",), ("page",)),
    ("Agent", ("agent",), ()),
    ("Entry", ("entry",), ("main", "cli")),
    ("Model", ("model", "entity"), ()),
    ("Types", ("type", "interface"), ()),
    ("Tool", ("tool",), ()),
    ("Util", ("util", "helper"), ()),
    ("Config", ("config", "setting"), ()),
    ("Middleware", ("middleware",), ()),
    ("Plugin", ("plugin", "extension"), ()),
    ("Router", ("router", "route"), ()),
    ("Database", ("database", "sql"), ("db",)),
    ("Dao", ("dao", "repository"), ()),
    ("Api", ("api", "endpoint"), ()),
    ("Controller", ("controller",), ()),
    ("Service", ("service",), ()),
    ("Command", ("command", "handler"), ()),
    ("Module", ("module",), ()),
    ("Lib", ("lib", "package"), ()),
    ("Test", ("test", "spec"), ()),
    ("Doc", ("doc",), ()),
    ("Context", ("context",), ()),
)

#: Fixed values: (purpose, substrings, whole names) of directories.
DIRECTORY_PURPOSES = (
    ("Core", (), ("src", "lib", "internal", "core", "pkg", "cmd", "main", "entry")),
    ("Config", ("config",), ("conf", "cfg")),
    ("Api", ("api",), ("rpc", "grpc")),
    ("Database", ("database", "migrations", "schema"), ("db",)),
    ("Frontend", (), ("frontend", "ui", "web", "client", "views")),
    ("Test", (), ("test", "tests", "spec", "__tests__")),
    ("Tool", (), ("scripts", "tools", "bin")),
    ("Docs", (), ("docs", "doc", "documentation")),
)

#: Fixed values: (type, substrings, whole labels) of dependencies; data flow needs both of its words.
DEPENDENCY_TYPES = (
    ("import", ("import",), ("use",)),
    ("function_call", ("function", "call"), ()),
    ("inheritance", ("inherit", "extend"), ()),
    ("composition", ("composition", "compose"), ()),
)

#: Labels of each project type.
PROJECT_TYPES = {
    "FrontendApp": ("frontendapp", "frontend", "frontend_app", "web"),
    "BackendService": ("backendservice", "backend", "backend_service", "service"),
    "FullStackApp": ("fullstackapp", "fullstack", "full_stack"),
    "ComponentLibrary": ("componentlibrary", "component_library", "library"),
    "Framework": ("framework",),
    "CLITool": ("clitool", "cli_tool", "cli"),
    "MobileApp": ("mobileapp", "mobile", "mobile_app"),
    "DesktopApp": ("desktopapp", "desktop", "desktop_app"),
}

#: Backends by their names.
BACKENDS = {"claude": ("claude",), "codex": ("codex",), "devin": ("devin",), "opencode": ("opencode",), "mock": ("mock", "test")}


def _first(label: Column, rules: tuple, rest: str) -> Column:
    out = F.when(F.lit(False), "")
    for name, parts, wholes in rules:
        test = label.isin(*wholes) if wholes else F.lit(False)
        for p in parts:
            test = test | F.contains(label, F.lit(p))
        out = out.when(test, name)
    return out.otherwise(rest)


def code_purpose(raw: Column) -> Column:
    return _first(F.regexp_replace(F.lower(raw), "[^a-z0-9]", ""), CODE_PURPOSES, "Other")


def directory_purpose(name: Column) -> Column:
    return _first(F.lower(name), DIRECTORY_PURPOSES, "Other")


def dependency_type(raw: Column) -> Column:
    label = F.lower(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    plain = _first(label, DEPENDENCY_TYPES, "")
    flow = F.contains(label, F.lit("data")) & F.contains(label, F.lit("flow"))
    return F.when(plain != "", plain).when(flow, "data_flow").otherwise("module")


def project_type(raw: Column) -> Column:
    label = F.lower(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    out = F.when(F.lit(False), "")
    for name, labels in PROJECT_TYPES.items():
        out = out.when(label.isin(*labels), name)
    return out.otherwise("Other")


def backend(spec: Column) -> Column:
    """``name`` or ``name:model`` to struct(backend, model); both null for an unknown name."""
    parts = F.split(F.trim(spec), ":", 2)
    name = F.lower(parts[0])
    known = F.when(F.lit(False), "")
    for kind, names in BACKENDS.items():
        known = known.when(name.isin(*names), kind)
    model = F.when(known.isNotNull() & (F.size(parts) > 1), F.nullif(parts[1], F.lit("")))
    return F.struct(known.alias("backend"), model.alias("model"))
