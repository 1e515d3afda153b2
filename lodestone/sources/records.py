"""Claims, snapshots, baselines, call logs and research results: JSON in, relations out, and back."""

from __future__ import annotations

import json
import os
import tempfile
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import jsons
from lodestone.operators import govern
from lodestone.sources.store import Store

SNAPSHOT_VERSION = 1
CLAIMS = "ord int, from string, to string, dependency_type string, importance int, description string"


def whole(spark: SparkSession, path: str) -> str:
    """A small JSON file's text, by any file system that Spark reads."""
    return spark.read.text(path, wholetext=True).first()["value"]


def parse_claims(text: str) -> list[tuple]:
    """Rows of any of the three shapes: a research map, its relationships alone, or bare core_dependencies. Raises where there are none."""
    value = json.loads(text)
    held = value.get("relationships") if isinstance(value.get("relationships"), dict) and "core_dependencies" in value["relationships"] else value
    if "core_dependencies" not in held:
        raise ValueError("no relationships.core_dependencies array")

    def row(item: dict) -> tuple:
        number = item.get("importance")
        text = number if isinstance(number, str) else str(int(number)) if isinstance(number, (int, bool)) else ""
        whole_number = int(text) if text.lstrip("+-").isdigit() else 0
        about = jsons.named(item.get("description"))
        return jsons.named(item.get("from")), jsons.named(item.get("to")), jsons.named(item.get("dependency_type")), min(max(whole_number, 0), 255), about if about.strip() else None

    return [(i, *r) for i, r in enumerate(jsons.objects(held["core_dependencies"], parse=row))]


def load_claims(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(parse_claims(whole(spark, path)), CLAIMS)


def claims_path(configured: str | None, root: str, internal: str, output: str, name: str = "claims.json") -> str:
    """Where claims are read from: as configured, else the research results, else the copy beside the documents, else (for the error) the first of these."""
    if configured:
        return configured if os.path.isabs(configured) else os.path.join(root, configured)
    research, committed = os.path.join(internal, "research.json"), os.path.join(output, name)
    return committed if not os.path.isfile(research) and os.path.isfile(committed) else research


def write_atomic(path: str, text: str) -> None:
    """A small report, whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)


def export_claims(research: str, target: str) -> int:
    """The relationships of a research map as a file of their own; returns the number of claims."""
    with open(research, encoding="utf-8") as f:
        value = json.load(f)
    if "relationships" not in value:
        raise ValueError("no relationships key")
    write_atomic(target, json.dumps({"relationships": value["relationships"]}, indent=2, ensure_ascii=False))
    listed = value["relationships"].get("core_dependencies")
    return len(listed) if isinstance(listed, list) else 0


def save_snapshot(path: str, snapshot: dict[str, DataFrame], env: str, created_at: str, git_head: str | None = None) -> None:
    """One tree's snapshot as JSON. For many trees write the frames as Parquet instead."""
    pairs = {k: [tuple(r) for r in snapshot[k].collect()] for k in ("files", "dirs", "edges")}
    body = {"version": SNAPSHOT_VERSION, "created_at": created_at, "env": env, "git_head": git_head, "files": dict(sorted(pairs["files"])), "dirs": dict(sorted(pairs["dirs"])), "edges": sorted(map(list, pairs["edges"]))}
    write_atomic(path, json.dumps(body, indent=2))


def load_snapshot(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict] | None:
    """Frames and facts; None if it is missing, corrupt or of another version."""
    try:
        with open(path, encoding="utf-8") as f:
            value = json.load(f)
        if value["version"] != SNAPSHOT_VERSION:
            return None
        frames = {
            "files": spark.createDataFrame(list(value["files"].items()), "path string, hash string"),
            "dirs": spark.createDataFrame(list(value["dirs"].items()), "dir string, sig string"),
            "edges": spark.createDataFrame([tuple(e) for e in value["edges"]], "importer string, target string"),
        }
    except (OSError, ValueError, KeyError, TypeError):
        return None
    return frames, {k: value.get(k) for k in ("created_at", "env", "git_head")}


def save_baseline(path: str, ids: list[str]) -> None:
    write_atomic(path, json.dumps({"schema_version": 1, "findings": sorted(set(ids))}, indent=2))


def load_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """finding_id; None if there is no file. A corrupt one is an error."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame([(i,) for i in json.load(f)["findings"]], "finding_id string")


def load_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(govern.CALLS).json(path)


def append_calls(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").json(path)


def call_log(spark: SparkSession, folder: str) -> Store:
    """The call log as a keyed store: a call is appended once, however often its batch is written. key: what tells calls apart (a run's id and the call's place in it, say)."""
    return Store(spark, folder, f"key string, {govern.CALLS}")


def answer_cache(spark: SparkSession, folder: str, disabled: bool = False, no_read: bool = False) -> Store:
    """Answers by cache key, with where they come from."""
    return Store(spark, folder, "key string, text string, agent string, backend string, model string, created_at string, secs double", disabled, no_read)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """key, value (JSON text) of a research map."""
    return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in json.loads(whole(spark, path)).items()], "key string, value string")


def typed(results: DataFrame, key: str, schema: str) -> DataFrame:
    """A key's value by a schema; null where it does not fit."""
    return results.where(F.col("key") == key).select(F.from_json("value", schema).alias("value"))


def stale_docs(previous: DataFrame, current: DataFrame, prefix: str) -> DataFrame:
    """Documents that an earlier run wrote under prefix and this one did not: path."""
    return previous.where(F.startswith("path", F.lit(prefix))).join(current, "path", "left_anti")


def layered(*layers: dict) -> dict:
    """Settings, later layers over earlier ones, table by table."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = layered(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_settings(*paths: str, profile: str | None = None, said: dict | None = None) -> dict:
    """TOML files in order (missing ones are empty), then a profile of theirs, then what the command said."""
    layers = []
    for p in paths:
        if os.path.isfile(p):
            with open(p, "rb") as f:
                layers.append(tomllib.load(f))
    merged = layered(*layers)
    profiles = merged.pop("profiles", {})
    if profile is not None and profile not in profiles:
        raise KeyError(f"no profile {profile!r}")
    return layered(merged, profiles.get(profile, {}), said or {})
