"""A written document tree: what a run writes, what it removes, and whether it is whole."""

from __future__ import annotations

import json
import os
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.functions import text as texts
from lodestone.sources.records import write_atomic

#: The top documents, and where deep ones are.
EXPECTED = ("1.Overview.md", "2.Architecture.md", "3.Workflow.md", "5.Boundary-Interfaces.md", "6.Database-Overview.md")
DEEP = "4.Deep-Exploration"


def written(record: str) -> list[str] | None:
    """The list of the last run that finished; None if it is missing or corrupt."""
    try:
        with open(record, encoding="utf-8") as f:
            got = json.load(f)
    except (OSError, ValueError):
        return None
    return got if isinstance(got, list) else None


def write(folder: str, docs: dict[str, str], record: str) -> list[str]:
    """Write docs by path, remove deep documents of the last run that are no more among them, and last of all record the list. Files that no run wrote stay."""
    before = written(record) or []
    for path, text in docs.items():
        write_atomic(os.path.join(folder, path), text)
    for path in before:
        if path.startswith(f"{DEEP}/") and path not in docs and os.path.isfile(os.path.join(folder, path)):
            os.remove(os.path.join(folder, path))
    write_atomic(record, json.dumps(list(docs), indent=2))
    return list(docs)


def reusable(folder: str, research: str, record: str) -> bool:
    """Whether all recorded documents are there and the record is not older than the research."""
    listed = written(record)
    if not listed or not os.path.isdir(folder) or not os.path.isfile(research) or os.path.getmtime(research) > os.path.getmtime(record):
        return False
    return all(os.path.isfile(os.path.join(folder, p)) for p in listed)


def verified(docs: DataFrame) -> DataFrame:
    """docs(path, content) to path and issue: expected documents that are missing or empty, and what is wrong with diagrams."""
    expected = docs.sparkSession.createDataFrame([(p,) for p in EXPECTED], "path string")
    held = expected.join(docs, "path", "left")
    gaps = held.select("path", F.when(F.col("content").isNull(), "missing").when(F.col("content") == "", "empty").alias("issue")).where("issue IS NOT NULL")
    lint = docs.where(F.col("path").endswith(".md")).select("path", F.explode(texts.lint_diagrams("content")).alias("issue"))
    deep = docs.where(F.startswith("path", F.lit(f"{DEEP}/"))).agg((F.count("*") == 0).alias("none")).where("none").select(F.lit(f"{DEEP}/").alias("path"), F.lit("missing").alias("issue"))
    return gaps.unionByName(lint).unionByName(deep)


def deep_path(domain: F.Column) -> F.Column:
    return F.concat(F.lit(f"{DEEP}/"), paths.sanitized_name(domain), F.lit(".md"))


def template(name: str, folder: str | None, embedded: dict[str, str]) -> str:
    """A prompt's template: a file of the folder if it is there, else the embedded one."""
    path = os.path.join(folder, name) if folder else ""
    if path and os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    return embedded[name]


def stable_abs(path: str, project: str) -> str:
    """An absolute path that is the same before and after its last parts exist."""
    return os.path.realpath(os.path.normpath(path if os.path.isabs(path) else os.path.join(project, path)))


def output_key(path: str, project: str) -> str:
    """Twelve digits for an output folder, in the names of its state files."""
    return sha256(stable_abs(path, project).encode()).hexdigest()[:12]


def env_fingerprint(parts: list[str]) -> str:
    """A digest of settings and prompts in order, each ended by a zero byte."""
    h = sha256()
    for p in parts:
        h.update(p.encode() + b"\0")
    return h.hexdigest()
