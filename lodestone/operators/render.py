"""Reports as text, from collected rows of bounded reports."""

from __future__ import annotations

import json
import re
from collections import Counter

from lodestone.operators.drift import CHECKED

REPORT_VERSION = 2


def drift_report(findings: list[dict], claims_source: str, claims_total: int, hubs: list[str], filtered: dict[str, int], baseline: dict | None = None) -> dict:
    """The machine-readable report."""
    counts = Counter(f["class"] for f in findings)
    total = sum(n for c, n in counts.items() if c != "undocumented")
    checked = sum(counts[c] for c in CHECKED)
    ratio = int(checked / total * 1e4 + 0.5) / 1e4 if total else 0.0
    out = {"schema_version": REPORT_VERSION, "claims_source": claims_source, "claims_total": claims_total, "counts": dict(sorted(counts.items())), "coverage": {"checked": checked, "total": total, "ratio": ratio}, "hubs": sorted(hubs), "filtered": dict(sorted(filtered.items())), "findings": sorted(findings, key=lambda f: f["id"])}
    return out | ({"baseline": baseline} if baseline else {})


def failures(report: dict) -> int:
    return sum(f["class"] in ("phantom", "reversed") and not f.get("in_baseline") for f in report["findings"])


def exit_code(report: dict | None, strict: bool = False) -> int:
    """0 fine, 1 findings fail under strict, 2 no report."""
    return 2 if report is None else int(strict and failures(report) > 0)


def _split(findings: list[dict]) -> str:
    return ", ".join(f"{n} {reason}" for reason, n in sorted(Counter(f["reason"] for f in findings).items()))


def drift_text(report: dict, verbose: bool = False) -> str:
    by = {c: [f for f in report["findings"] if f["class"] == c] for c in ("confirmed", "structural", "unverifiable", "phantom", "reversed", "undocumented")}
    cover = report["coverage"]
    out = [f"claims: {report['claims_source']} ({report['claims_total']} edges)"]
    out.append(f"coverage: {cover['checked']}/{cover['total']} claims checked ({int(cover['ratio'] * 100 + 0.5)}%) — {len(by['unverifiable'])} unverifiable")
    out.append(f"  ok   {len(by['confirmed'])} confirmed ({_split(by['confirmed'])})")
    for c in ("structural", "unverifiable"):
        if by[c]:
            out.append(f" info  {len(by[c])} {c}")
            for f in by[c] if verbose else ():
                out.append(f"        {f['from']} -> {f['to']} [{f['reason']}]" + (f" — {f['detail']}" if f.get("detail") else ""))
            out.append(f"        ({_split(by[c])})")
    for c in ("phantom", "reversed", "undocumented"):
        if by[c]:
            out.append(f" warn  {len(by[c])} {c}")
        for f in by[c]:
            out.append(f"        {f['from']} -> {f['to']}" + (f" [{f['kind']}, importance {f['importance']}]" if f.get("kind") else ""))
            out += [f"          e.g. {e['file']}:{e['line']} (-> {e['target']})" for e in f.get("evidence") or ()]
            out += [f"          {f['detail']}"] if f.get("detail") else []
    if report["hubs"]:
        out.append(f"hubs: {', '.join(report['hubs'])}")
    if report["filtered"]:
        out.append("filtered: " + " ".join(f"{k}={v}" for k, v in report["filtered"].items()))
    if b := report.get("baseline"):
        out.append(f"baseline: {b['path']} ({b['known']} known, {b['new']} new, {b['stale']} stale)")
    return "\n".join([*out, f"result: {failures(report)} finding(s) would fail under --strict"]) + "\n"


def age(seconds: float | None) -> str:
    """How long ago, in the largest whole unit."""
    if seconds is None:
        return "-"
    unit, name = next((u for u in ((86_400, "d"), (3600, "h"), (60, "m")) if seconds >= u[0]), (1, "s"))
    return f"{int(seconds // unit)}{name} ago"


def status_text(status: dict) -> str:
    """Freshness for people: what the documents rest on (project, manifest, git, research), the classification with counts of changes, and each document's state and age."""
    written, head, since = status.get("manifest_written_at"), status.get("manifest_git_head"), status.get("commits_since")
    out = [f"status of {status['project']}", ""] if status.get("project") else []
    if "manifest_written_at" in status:
        out.append(f"manifest: {status.get('manifest', '')} ({written})" if written else "manifest: none, so the next run is a full one")
    if head:
        out.append(f"git: documented at {head}" + (f", {since} commit(s) since" if since is not None else ""))
    if "research_age_secs" in status:
        out.append(f"research: {age(status['research_age_secs']) if status['research_age_secs'] is not None else 'missing'}")
    out += [""] if len(out) > 2 else []
    out += [f"status: {status['classification']}", *(f"  - {r}" for r in status.get("reasons", ()))]
    for entity in ("files", "dirs", "edges"):
        if entity in status:
            out.append(f"{entity}: " + ", ".join(f"{k} {v}" for k, v in status[entity].items()))
    out += [f"pending: {d}" for d in status.get("pending_cosmetic_dirs", ())]
    return "\n".join([*out, *(f"  {d['state']:<8}{d['path']}" + (f" ({age(d['age_secs'])})" if "age_secs" in d else "") for d in status.get("docs", ()))]) + "\n"


def tables_markdown(title: str, sections: dict[str, list[dict]]) -> str:
    """A document of one table a section; empty sections are left out."""
    out = [f"# {title}", ""]
    for name, rows in sections.items():
        if rows:
            head = list(rows[0])
            out += [f"## {name}", "", f"| {' | '.join(head)} |", f"|{'---|' * len(head)}", *(f"| {' | '.join(str(r.get(c, '')).replace('|', chr(92) + '|') for c in head)} |" for r in rows), ""]
    return "\n".join(out)


def dep_block(name: str, value) -> str:
    body = value if isinstance(value, str) else json.dumps(value, indent=2, ensure_ascii=False)
    return f"#### {name}\n```json\n{body}\n```\n"


def summary(facts: dict, stats: dict, issues: list[tuple[str, str]], timings: list[tuple[str, float]]) -> tuple[dict, str]:
    """A run's summary for machines and for people. facts: generated_at, project, total_secs, cap; stats: calls, hits, quota_used; issues: path and issue."""
    body = facts | stats | {"issues": [list(i) for i in issues], "timings": [list(t) for t in timings]}
    missing = [p for p, i in issues if i == "missing"]
    diagrams = [f"{p}: {i}" for p, i in issues if i not in ("missing", "empty")]
    out = ["# Run summary", "", f"- Generated: {facts['generated_at']}", f"- Project: `{facts['project']}`", f"- Total: {facts['total_secs']:.1f}s", f"- Calls: {stats['calls']}", f"- Cache hits: {stats['hits']}", f"- Quota used today: {stats['quota_used']}/{facts['cap']}"]
    out += [f"- Missing documents: {', '.join(missing)}"] if missing else []
    out += ["", "## Diagram issues", "", *(f"- {d}" for d in diagrams)] if diagrams else []
    return body, "\n".join([*out, "", "## Timings", "", "| Task | Seconds |", "|------|---------|", *(f"| {n} | {s:.1f} |" for n, s in timings)]) + "\n"


def _text(value) -> str:
    """A field as people read it: a list's items by commas, nothing for null."""
    return "" if value is None else ", ".join(map(_text, value)) if isinstance(value, list) else str(value).lower() if isinstance(value, bool) else str(value)


def _records(report: dict, key: str) -> list[dict]:
    return [r for r in report.get(key) or [] if isinstance(r, dict)]


def _facts(record: dict, facts: dict[str, str]) -> list[str]:
    """A paragraph for each fact that is there: its label, or the bare text for label ''; a label that ends in a backquote quotes."""
    out = []
    for label, name in facts.items():
        if told := _text(record.get(name)):
            told = f"`{told}`" if label.endswith("`") else told
            out += [f"**{label.rstrip('`')}**: {told}" if label else told, ""]
    return out


def _bullets(title: str, lines: list[str]) -> list[str]:
    return [f"**{title}**:", "", *(f"- {x}" for x in lines), ""] if lines else []


def _argument(a: dict) -> str:
    """A command's argument or option, with its short name, need and default."""
    name = "".join([_text(a.get("name")), f", {a['short_name']}" if a.get("short_name") else ""])
    default = f" (default: `{_text(a['default_value'])}`)" if a.get("default_value") is not None else ""
    return f"`{name}` ({_text(a.get('value_type'))}): {'required' if a.get('required') else 'optional'} - {_text(a.get('description'))}{default}"


def _confidence(report: dict) -> list[str]:
    return ["---", "", f"**Analysis Confidence**: {float(report.get('confidence_score') or 0):.1f}/10", ""]


#: The parts of a table's columns.
COLUMNS = {"Column": "name", "Type": "data_type", "Nullable": "nullable", "Identity": "is_identity", "Default": "default_value"}


def _grid(rows: list[dict], columns: dict[str, str]) -> list[str]:
    cell = lambda v: _text(v).replace("|", "\\|")
    return [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}", *(f"| {' | '.join(cell(r.get(c)) for c in columns.values())} |" for r in rows), ""] if rows else []


def database_doc(report: dict) -> str:
    """The database overview: counts, then projects, tables with columns and keys, views, procedures with parameters, functions, relationships as a diagram and a table, and flows;
    parts without entries are left out."""
    named = {"Database Projects": "database_projects", "Tables": "tables", "Views": "views", "Stored Procedures": "stored_procedures", "Functions": "database_functions", "Relationships": "table_relationships"}
    out = ["## Database Overview", "", "### Summary", "", *_grid([{"m": n, "c": len(_records(report, k))} for n, k in named.items()], {"Metric": "m", "Count": "c"})]

    def part(title: str, key: str, heading, body) -> None:
        for i, r in enumerate(_records(report, key)):
            out.extend([*(["### " + title, ""] if not i else []), f"#### {heading(r)}", "", *body(r)])

    full = lambda r: f"`{_text(r.get('schema'))}.{_text(r.get('name'))}`" if r.get("schema") else f"`{_text(r.get('name'))}`"
    objects = lambda r: ", ".join(f"{r.get(f'{k}_count') or 0} {n}" for k, n in (("table", "tables"), ("view", "views"), ("procedure", "procedures"), ("function", "functions")))
    part("Database Projects", "database_projects", lambda r: f"`{_text(r.get('name'))}`", lambda r: [f"- Path: `{_text(r.get('project_path'))}`", *([f"- Target platform: {r['target_platform']}"] if r.get("target_platform") else []), f"- Objects: {objects(r)}", *([f"- References: {_text(r['references'])}"] if r.get("references") else []), ""])
    part("Tables", "tables", full, lambda r: [*_facts(r, {"": "description"}), *_grid(_records(r, "columns"), COLUMNS), *_facts(r, {"Primary key": "primary_key", "Source`": "source_path"})])
    part("Views", "views", full, lambda r: _facts(r, {"": "description", "References": "referenced_tables", "Source`": "source_path"}))
    given = lambda a: f"`{_text(a.get('name'))}` {_text(a.get('data_type'))} ({_text(a.get('direction'))}{', optional' if a.get('is_optional') else ''})"
    part("Stored Procedures", "stored_procedures", full, lambda r: [*_facts(r, {"": "description"}), *_bullets("Parameters", [given(a) for a in _records(r, "parameters")]), *_facts(r, {"Tables": "referenced_tables"})])
    part("Functions", "database_functions", full, lambda r: _facts(r, {"Type": "function_type", "": "description", "Returns`": "return_type", "Source`": "source_path"}))
    if links := _records(report, "table_relationships"):
        safe = lambda name: re.sub("[^A-Za-z0-9_]", "_", _text(name))
        drawn = [f'    {safe(r.get("from_table"))} ||--o{{ {safe(r.get("to_table"))} : "{_text(r.get("relationship_type"))}"' for r in links]
        out += ["### Table Relationships", "", "```mermaid", "erDiagram", *drawn, "```", "", *_grid(links, {"From Table": "from_table", "From Columns": "from_columns", "To Table": "to_table", "To Columns": "to_columns", "Type": "relationship_type"})]
    ways = lambda r: [f"- {_text(r.get('source'))} → {_text(r.get('destination'))}", *(f"- {label}: {_text(r[k])}" for label, k in (("Operations", "operations"), ("Procedures", "procedures_involved")) if r.get(k)), ""]
    part("Data Flows", "data_flows", lambda r: _text(r.get("name")), ways)
    return "\n".join([*out, *_confidence(report)])


def boundary_doc(report: dict) -> str:
    """The boundary document: commands with arguments, options and examples, interfaces, routes with parameters, and integration advice; parts without entries are left out."""
    out = ["# System Boundary Interface Documentation", "", "This document describes how the system is called from outside: commands, interfaces, routes and other entry points.", ""]
    origin = {"Description": "description", "Source File`": "source_location"}

    def fenced(code: str, lang: str = "") -> list[str]:
        return [f"```{lang}", code, "```", ""]

    def command(r: dict) -> list[str]:
        shown = [line for x in r.get("examples") or [] for line in fenced(_text(x), "bash")]
        return [*_bullets("Arguments", [_argument(a) for a in _records(r, "arguments")]), *_bullets("Options", [_argument(a) for a in _records(r, "options")]), *(["**Usage Examples**:", "", *shown] if shown else [])]

    route = lambda p: f"`{_text(p.get('key'))}` ({_text(p.get('value_type'))}): {_text(p.get('description'))}"
    parts = (
        ("Command Line Interface (CLI)", "cli_boundaries", lambda r: _text(r.get("command")), lambda r: [*_facts(r, origin), *command(r)]),
        ("API Interfaces", "api_boundaries", lambda r: f"{_text(r.get('method'))} {_text(r.get('endpoint'))}".strip(), lambda r: _facts(r, origin | {"Request Format": "request_format", "Response Format": "response_format", "Authentication": "authentication"})),
        ("Router Routes", "router_boundaries", lambda r: _text(r.get("path")), lambda r: [*_facts(r, origin), *_bullets("Parameters", [route(p) for p in _records(r, "params")])]),
        ("Integration Suggestions", "integration_suggestions", lambda r: _text(r.get("integration_type")), lambda r: [*_facts(r, {"": "description"}), *(["**Example Code**:", "", *fenced(_text(r["example_code"]))] if r.get("example_code") else []), *_bullets("Best Practices", [_text(x) for x in r.get("best_practices") or []])]),
    )
    for title, key, heading, body in parts:
        for i, r in enumerate(_records(report, key)):
            out += [*([f"## {title}", ""] if not i else []), f"### {heading(r)}", "", *body(r)]
    return "\n".join([*out, *_confidence(report)])
