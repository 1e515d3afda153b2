"""Source-text metrics as Column expressions, and the rule sets that insights read files by."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most matches of one pattern that count: functions, types, imports.
MOST = {"function": 60, "type": 40, "import": 40}


def lines_of_code(content: Column) -> Column:
    """Lines that are not blank."""
    return F.size(F.filter(F.split(content, "\n"), lambda line: line.rlike(r"\S")))


def occurrences(content: Column, token: str) -> Column:
    """Non-overlapping occurrences of a token."""
    return ((F.length(content) - F.length(F.replace(content, F.lit(token), F.lit("")))) / len(token)).cast("long")


def branches(content: Column, tokens: tuple[str, ...]) -> Column:
    out = F.lit(0).cast("long")
    for t in tokens:
        out = out + occurrences(content, t)
    return out


def is_external(name: Column) -> Column:
    return ~name.rlike(r"^(?:\.|crate|self|super)")


def has_nul(content: Column, first: int = 4096) -> Column:
    """A zero byte among the first bytes of binary content."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, first)), "(..)", "$1 ")) > 0


#: By extensions, the patterns of functions, types and imports, and the tokens that branch.
RULES = {
    "rs": {
        "function": (r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z0-9_]+)",),
        "type": (
            r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z0-9_]+)",
            r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+([A-Za-z0-9_]+)",
            r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+([A-Za-z0-9_]+)",
        ),
        "import": (r"(?m)^\s*use\s+([A-Za-z0-9_:]+)",),
        "branch": ("if ", "else if", "for ", "while ", "loop ", "match ", "?"),
    },
    "py pyw": {
        "function": (r"(?m)^\s*(?:async\s+)?def\s+([A-Za-z0-9_]+)", r"(?m)^\s*([A-Za-z0-9_]+)\s*=\s*lambda"),
        "type": (r"(?m)^\s*class\s+([A-Za-z0-9_]+)",),
        "import": (r"(?m)^\s*(?:from\s+([A-Za-z0-9_.]+)\s+)?import\s+([A-Za-z0-9_.*, ]+)",),
        "branch": ("if ", "elif ", "for ", "while ", "except", "with "),
    },
    "js mjs cjs jsx ts tsx": {
        "function": (
            r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z0-9_]+)",
            r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z0-9_]+)\s*=\s*(?:async\s+)?(?:\(|function)",
            r"(?m)^\s*(?:public|private|protected|static|async|\s)*\s*([A-Za-z0-9_]+)\s*\([^)]*\)\s*[:\w\[\]<>| ]*\{",
        ),
        "type": (
            r"(?m)^\s*(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z0-9_]+)",
            r"(?m)^\s*(?:export\s+)?interface\s+([A-Za-z0-9_]+)",
            r"(?m)^\s*(?:export\s+)?(?:type|enum)\s+([A-Za-z0-9_]+)",
        ),
        "import": (r"""(?m)import\s+.*?from\s+['"]([^'"]+)['"]""", r"""(?m)require\(\s*['"]([^'"]+)['"]\s*\)"""),
        "branch": ("if (", "if(", "for (", "for(", "while ", "case ", "catch", "?"),
    },
    "go": {
        "function": (r"(?m)^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z0-9_]+)",),
        "type": (r"(?m)^\s*type\s+([A-Za-z0-9_]+)\s+(?:struct|interface)",),
        "import": (r"""(?m)^\s*import\s+?(?:\(\s*)?["`]([^"`]+)["`]""", r"""(?m)^\s*["`]([a-z0-9_./~-]+)["`]\s*$"""),
        "branch": ("if ", "for ", "switch ", "case ", "select "),
    },
    "java kt scala": {
        "function": (r"(?m)^\s*(?:public|private|protected|static|final|suspend|override|\s)*\s*(?:fun\s+)?([A-Za-z0-9_]+)\s*\(",),
        "type": (r"(?m)^\s*(?:public|private|abstract|final|data|sealed|\s)*\s*(?:class|interface|enum|object)\s+([A-Za-z0-9_]+)",),
        "import": (r"(?m)^\s*import\s+([A-Za-z0-9_.*]+)",),
        "branch": ("if (", "for (", "while (", "case ", "catch", "when ("),
    },
    "c h cpp cc hpp cs": {
        "function": (r"(?m)^\s*(?:public|private|protected|static|virtual|async|internal|inline|\s)*\s*[A-Za-z0-9_<>\[\],:*& ]+\s+([A-Za-z0-9_]+)\s*\(",),
        "type": (r"(?m)^\s*(?:public|private|abstract|sealed|static|partial|\s)*\s*(?:class|struct|enum|interface|record)\s+([A-Za-z0-9_]+)",),
        "import": (r"""(?m)^\s*#include\s+[<"]([^>"]+)[>"]""", r"(?m)^\s*using\s+([A-Za-z0-9_.]+)"),
        "branch": ("if (", "for (", "while (", "case ", "catch", "switch ("),
    },
    "rb php swift dart m sh sql": {
        "function": (r"(?m)^\s*def\s+([A-Za-z0-9_!?]+)", r"(?m)^\s*(?:public\s+)?(?:static\s+)?function\s+([A-Za-z0-9_]+)", r"(?m)^\s*func\s+([A-Za-z0-9_]+)"),
        "type": (r"(?m)^\s*(?:class|module|struct|enum|protocol|extension)\s+([A-Za-z0-9_]+)", r"(?im)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW|PROCEDURE|FUNCTION)\s+([\w.\[\]]+)"),
        "import": (r"""(?m)^\s*(?:require|require_relative|include|use|using)\s+['"]?([A-Za-z0-9_./:]+)""",),
        "branch": ("if ", "elsif", "for ", "while ", "case ", "when ", "rescue"),
    },
    "*": {"function": (), "type": (), "import": (), "branch": ("if ", "for ", "while ", "case ")},
}
_BY_EXTENSION = {ext: rule for names, rule in RULES.items() for ext in names.split()}


def branch_words(ext: str) -> tuple[str, ...]:
    """What counts as a branch in files of an extension."""
    return tuple(_BY_EXTENSION.get(ext, _BY_EXTENSION["*"])["branch"])


def statics(ext: str, content: str) -> dict:
    """What insights hold of a file: interfaces, dependencies and metrics."""
    rule = _BY_EXTENSION.get(ext, _BY_EXTENSION["*"])
    out = {"interfaces": [], "dependencies": [], "loc": sum(bool(x.strip()) for x in content.split("\n")), "n_functions": 0, "n_classes": 0}
    seen: set[tuple[str, str]] = set()

    def line_at(at: int) -> str:
        start, end = content.rfind("\n", 0, at) + 1, content.find("\n", at)
        return content[start : end if end >= 0 else len(content)].strip()[:160]

    for group in ("function", "type", "import"):
        for pattern in rule[group]:
            for n, m in enumerate(re.compile(pattern, re.ASCII).finditer(content)):
                if n >= MOST[group]:
                    break
                name = next((g for g in m.groups() if g is not None), None)
                if group == "import":
                    name = re.sub(r"(?:\.\*)+$", "", name) if name else name
                if not name or (group, name) in seen:
                    continue
                seen.add((group, name))
                if group == "import":
                    out["dependencies"].append({"name": name, "dependency_type": "import", "is_external": not re.match(r"\.|crate|self|super", name)})
                elif group == "type" or len(name) > 1:
                    out["n_functions" if group == "function" else "n_classes"] += 1
                    out["interfaces"].append({"name": name, "interface_type": group, "signature": line_at(m.start(m.lastindex or 0))})
    out["cyclomatic"] = float(sum(content.count(t) for t in rule["branch"]))
    return out


def _row(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


STATICS = _row(
    interfaces=T.ArrayType(_row(name=T.StringType(), interface_type=T.StringType(), signature=T.StringType())),
    dependencies=T.ArrayType(_row(name=T.StringType(), dependency_type=T.StringType(), is_external=T.BooleanType())),
    loc=T.LongType(), n_functions=T.LongType(), n_classes=T.LongType(), cyclomatic=T.DoubleType(),
)


@F.pandas_udf(STATICS)
def extract_statics(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statics(e or "", c or "") for e, c in zip(ext, content, strict=True)], columns=["interfaces", "dependencies", "loc", "n_functions", "n_classes", "cyclomatic"])


def insights(files: DataFrame) -> DataFrame:
    """files (rel_path, extension, content) with ``statics``."""
    return files.select("rel_path", extract_statics("extension", "content").alias("statics"))


#: Words that may begin a diagram, in lower case.
DIAGRAMS = (
    "graph", "flowchart", "sequencediagram", "classdiagram", "statediagram", "statediagram-v2", "erdiagram", "journey", "gantt", "pie", "mindmap", "timeline", "gitgraph",
    "c4context", "c4container", "c4component", "sankey-beta", "xychart-beta", "block-beta", "packet-beta",
)


def mermaid_issues(text: str) -> list[str]:
    """What is wrong with a document's fenced diagrams: unknown header, fewer than two lines, or a fence left open."""
    issues, block, opened = [], None, 0
    for number, line in enumerate(text.split("\n"), 1):
        stripped = line.strip()
        if block is None:
            if stripped.startswith("```mermaid"):
                block, opened = [], number
        elif not stripped.startswith("```"):
            block.append(line)
        else:
            head = block[0].strip().lower() if block else ""
            if (head.split() or [""])[0] not in DIAGRAMS:
                issues.append(f"line {opened}: unknown mermaid header `{head}`")
            elif len(block) < 2:
                issues.append(f"line {opened}: empty diagram")
            block = None
    return issues + ([f"line {opened}: unterminated mermaid block"] if block is not None else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def lint_diagrams(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: mermaid_issues(t or ""))
