"""The task graph of document generation as a relation, its levels, and what instances of a task see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.functions import jsons
from lodestone.operators.insights import topo_levels

SCHEMA = "name string, template string, tier string, deps array<string>, fan_out string, materials array<string>, phase string, exec string"
_CONTEXT = ["system_context", "domain_modules"]
#: Name, template, tier, dependencies, fan-out, materials, phase, execution.
TASKS = [
    ("dir_summary", "dir_summary.md", "efficient", [], "dir", ["custom"], "research", "llm"),
    ("relationships", "relationships.md", "efficient", ["dir_summary"], None, ["custom"], "research", "llm"),
    ("system_context", "system_context.md", "efficient", ["dir_summary"], None, ["project_structure", "code_insights", "readme"], "research", "llm"),
    ("domain_modules", "domain_modules.md", "efficient", ["dir_summary", "system_context", "relationships"], None, ["code_insights", "project_structure"], "research", "llm"),
    ("database", "database.md", "efficient", ["dir_summary"], None, ["project_structure", "custom"], "research", "llm"),
    ("architecture", "architecture.md", "powerful", _CONTEXT, None, ["project_structure", "relationships"], "research", "llm"),
    ("workflow", "workflow.md", "powerful", _CONTEXT, None, ["code_insights"], "research", "llm"),
    ("key_module", "key_module.md", "efficient", _CONTEXT, "domain", ["custom"], "research", "llm"),
    ("boundary", "boundary.md", "efficient", ["system_context", "relationships"], None, ["project_structure", "custom"], "research", "llm"),
    ("overview", "editors/overview.md", "efficient", _CONTEXT, None, ["readme"], "compose", "llm"),
    ("architecture_doc", "editors/architecture_doc.md", "powerful", [*_CONTEXT, "architecture", "workflow"], None, [], "compose", "llm"),
    ("workflow_doc", "editors/workflow_doc.md", "powerful", [*_CONTEXT, "workflow"], None, ["code_insights"], "compose", "llm"),
    ("boundary_doc", "", "efficient", ["boundary"], None, [], "compose", "deterministic"),
    ("database_doc", "", "efficient", ["database"], None, [], "compose", "deterministic"),
    ("deep_dive", "editors/deep_dive.md", "powerful", [*_CONTEXT, "architecture", "workflow", "key_module"], "domain", ["custom"], "compose", "llm"),
]


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASKS, SCHEMA)


def levels(phase: str | None = None) -> list[list[str]]:
    """Names level by level; dependencies outside the phase count as done."""
    return topo_levels({t[0]: t[3] for t in TASKS if phase is None or t[6] == phase})


def projected(task: str, dep: str, target: str | None, value):
    """What an instance sees of a dependency: of a domain's tasks, its own entry and the others' names."""
    fan_out = next(t[4] for t in TASKS if t[0] == task)
    if fan_out != "domain" or target is None or not isinstance(value, dict):
        return value
    if dep != "domain_modules":
        return value.get(target, value)
    listed = [m for m in value.get("domain_modules") or [] if isinstance(m, dict)]
    own = next((m for m in listed if m.get("name") == target), None)
    return value if own is None else {"domain": own, "other_domains": [m["name"] for m in listed if m.get("name") not in (None, target)]}


def inputs(task: str, target: str | None, signatures: dict[str, str]) -> str:
    """The content fingerprint in an instance's cache key: its directory's subtree, else the whole tree. signatures: by directory, '.' for all."""
    fan_out = next(t[4] for t in TASKS if t[0] == task)
    return signatures.get(target or ".", "") if fan_out == "dir" else signatures.get(".", "")


def parsed(task_schema: dict | None, reply: str):
    """A reply by its contract: checked JSON, or text that is not blank. Raises where it fits neither."""
    if task_schema is None:
        if not reply.strip():
            raise ValueError("empty response")
        return reply.strip()
    value = jsons.checked(jsons.find_json(reply), task_schema)
    if value is None:
        raise ValueError(f"no valid JSON in response: {reply[-200:]}")
    return value


def dry_run(dirs: list[str], domains: list[str], cached: set[str] = frozenset()) -> list[dict]:
    """What a run would do: a row a task with its instances and those that are cached."""
    out = []
    for name, _, tier, _, fan_out, _, phase, how in TASKS:
        names = [f"{name}@{t}" for t in (dirs if fan_out == "dir" else domains)] if fan_out else [name]
        out.append({"task": name, "phase": phase, "tier": tier, "exec": how, "instances": len(names), "cached": sum(n in cached for n in names)})
    return out
