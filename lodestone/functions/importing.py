"""Import statements of sanitized source text, as rows of one wide shape for all languages."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: The four forms of JavaScript imports, in order; an export from another file is a re-export.
JS_FORMS = (
    (re.compile(r"""\bimport\s+(?:[A-Za-z0-9_{}*,\s]+\s+from\s+)?['"]([^'"]+)['"]"""), "Import"),
    (re.compile(r"""\bexport\s+[A-Za-z0-9_{}*,\s]+\s+from\s+['"]([^'"]+)['"]"""), "ReExport"),
    (re.compile(r"""\brequire\s*\(\s*['"]([^'"]+)['"]"""), "Import"),
    (re.compile(r"""\bimport\s*\(\s*['"]([^'"]+)['"]"""), "Import"),
)
#: Python's two forms.
PY_FROM = re.compile(r"(?m)^[ \t]*from\s+(\.*)([A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)*)\s+import\s+")
PY_IMPORT = re.compile(r"(?m)^[ \t]*import\s+([A-Za-z0-9_.]+(?:\s*,\s*[A-Za-z0-9_.]+)*)")
PY_LISTED = re.compile(r"[^\n\\]*(?:\\[\s\S]?[^\n]*)?")
PARENTHESIS = re.compile("[()]")
#: Rust's statements.
RS_MOD = re.compile(r"\bmod\s+([A-Za-z_][A-Za-z0-9_]*)\s*([{;])")
RS_TEST = re.compile(r"#\s*\[\s*cfg\s*\(\s*test\s*\)\s*\]")
RS_USE = re.compile(r"(?:pub(?:\s*\([^)]*\))?\s+)?use\s+")
RS_MARKS = re.compile(r"[{}()\[\];]")
RS_PATH = r"(?:::[A-Za-z_][A-Za-z0-9_]*)+"


@dataclass
class Found:
    """One import. root: crate, self, super or named (Rust); names: what a Python from-import lists; spec: a JavaScript specifier."""

    kind: str
    line: int
    test_only: bool
    root: str | None = None
    levels: int = 0
    inline: list[str] = field(default_factory=list)
    segs: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    spec: str | None = None


class Lines:
    def __init__(self, text: str):
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def at(self, position: int) -> int:
        return bisect.bisect_left(self.ends, position) + 1


def python(text: str, path: str, test: bool) -> Iterator[Found]:
    lines = Lines(text)
    kind = "ReExport" if path.rpartition("/")[2] == "__init__.py" else "Import"
    for m in PY_FROM.finditer(text):
        if text.startswith("(", m.end()):
            depth, stop = 0, len(text)
            for mark in PARENTHESIS.finditer(text, m.end()):
                depth += 1 if mark[0] == "(" else -1
                if not depth:
                    stop = mark.start()
                    break
            listed = text[m.end() + 1 : stop]
        else:
            listed = PY_LISTED.match(text, m.end())[0]
        words = [(part.split() or [""])[0] for part in listed.split(",")]
        names = [w for w in words if w and (w[0].isalpha() or w[0] == "_")]
        yield Found(kind, lines.at(m.start()), test, levels=len(m[1]), segs=[s for s in m[2].split(".") if s], names=names)
    for m in PY_IMPORT.finditer(text):
        for name in m[1].split(","):
            if segs := [s for s in name.strip().split(".") if s]:
                yield Found("Import", lines.at(m.start()), test, segs=segs)


def js(text: str, test: bool) -> Iterator[Found]:
    lines = Lines(text)
    for form, kind in JS_FORMS:
        for m in form.finditer(text):
            yield Found(kind, lines.at(m.start()), test, spec=m[1])


def use_paths(body: str) -> list[list[str]]:
    """A use tree's plain paths: ``a::{b, c::{d as e}}`` gives a::b and a::c::d."""
    tokens = re.findall(r"::|[{},]|[A-Za-z0-9_*]+", body)
    at = 0

    def tree(ahead: list[str]) -> list[list[str]]:
        nonlocal at
        path = list(ahead)
        while at < len(tokens) and tokens[at] not in ("}", ","):
            if tokens[at] == "{":
                at += 1
                return listed(path)
            if tokens[at] == "as":
                at += 2
                continue
            if tokens[at] != "::":
                path.append(tokens[at])
            at += 1
        return [path] if len(path) > len(ahead) else []

    def listed(ahead: list[str]) -> list[list[str]]:
        nonlocal at
        out = []
        while at < len(tokens) and tokens[at] != "}":
            if tokens[at] == ",":
                at += 1
            else:
                out += tree(ahead)
        at += 1
        return out

    return tree([])


def _rooted(path: list[str], inline: list[str]) -> dict:
    """Where a Rust path begins, and what follows."""
    head, rest = path[0], path[1:]
    if head == "super":
        more = next((i for i, s in enumerate(rest) if s != "super"), len(rest))
        return {"root": "super", "levels": 1 + more, "inline": inline, "segs": rest[more:]}
    if head in ("crate", "self"):
        return {"root": head, "inline": inline if head == "self" else [], "segs": rest}
    return {"root": "named", "segs": path}


def rust(text: str, test: bool, crate: str | None = None, cfg_test: bool = True) -> Iterator[Found]:
    lines = Lines(text)
    declared = [(m[1], m.start()) for m in RS_MOD.finditer(text) if m[2] == ";"]
    named = {m.end() - 1: m[1] for m in RS_MOD.finditer(text) if m[2] == "{"}
    bodies, open_ = [], []
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_ and (start := open_.pop()) in named:
            bodies.append((start, m.start(), named[start]))
    bodies.sort()
    starts, outer, open_ = [s for s, _, _ in bodies], [], []
    for i, (s, _, _) in enumerate(bodies):  # of each body, the one around it
        while open_ and bodies[open_[-1]][1] < s:
            open_.pop()
        outer.append(open_[-1] if open_ else -1)
        open_.append(i)

    def around(at: int) -> list[tuple[int, int, str]]:
        """The bodies that a place lies in, the outermost first: up from the last that begins before it."""
        i, found = bisect.bisect_left(starts, at) - 1, []
        while i >= 0:
            if bodies[i][1] > at:
                found.append(bodies[i])
            i = outer[i]
        return found[::-1]

    tests = set()
    for m in RS_TEST.finditer(text) if cfg_test else ():
        after = re.compile(r"(?:\s*#[^\]]*\])*\s*").match(text, m.end())
        mod = RS_MOD.match(text, after.end())
        if mod and mod[2] == "{":
            tests.add(mod.end() - 1)

    def in_test(at: int) -> bool:
        return test or any(s in tests for s, _, _ in around(at))

    def inline(at: int) -> list[str]:
        return [name for _, _, name in around(at)]

    def marked(at: int) -> bool:
        start = max(text.rfind(c, 0, at) for c in ";{}") + 1
        return cfg_test and bool(RS_TEST.search(text[start:at]))

    pieces, end = [], 0  # the text without what use statements say
    for m in RS_USE.finditer(text):
        depth, stop = 0, None
        for mark in RS_MARKS.finditer(text, m.end()):
            depth += 1 if mark[0] in "{([" else -1 if mark[0] in "})]" else 0
            if mark[0] == ";" and depth <= 0:
                stop = mark.start()
                break
        if stop is None:
            continue
        if stop + 1 > end:
            first = max(end, m.start())
            pieces += [text[end:first], re.sub(r"[^\n]", " ", text[first : stop + 1])]
            end = stop + 1
        kind = "ReExport" if m[0].startswith("pub") else "Import"
        for path in use_paths(text[m.end() : stop]):
            yield Found(kind, lines.at(m.start()), in_test(m.start()) or marked(m.start()), **_rooted(path, inline(m.start())))
    rest = "".join([*pieces, text[end:]])
    roots = ["crate", "self", "super", *([crate.replace("-", "_")] if crate else [])]
    for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, roots))}){RS_PATH}", rest):
        yield Found("InlinePath", lines.at(m.start()), in_test(m.start()), **_rooted(m[0].split("::"), inline(m.start())))
    for name, at in declared:
        yield Found("ModDecl", lines.at(at), in_test(at), root="self", inline=inline(at), segs=[name])


def extract(language: str, text: str, path: str, test: bool, crate: str | None = None, cfg_test: bool = True) -> list[Found]:
    if language == "python":
        return list(python(text, path, test))
    if language == "js":
        return list(js(text, test))
    if language == "rust":
        return list(rust(text, test, crate, cfg_test))
    return []
