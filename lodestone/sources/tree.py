"""A source tree as a relation of files."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.functions import text as texts
from lodestone.sources import walk


@dataclass(frozen=True)
class ScanSettings:
    """Defaults of a scan. state_dir is this library's own folder in a tree."""

    max_depth: int = 10
    max_file_size: int = 512 * 1024
    git_tracked_only: bool = True
    include_hidden: bool = False
    state_dir: str = ".lodestone"
    always_excluded: tuple[str, ...] = (".git", ".hg", ".svn")
    excluded_dirs: tuple[str, ...] = (
        "target", "node_modules", "build", "dist", "venv", ".venv", "__pycache__", "__tests__", "__mocks__", "out", "coverage", "vendor", "deps", "_build", "bower_components", "Pods", "DerivedData",
        ".gradle", ".svelte-kit", ".next", ".nuxt", ".nx", ".turbo", ".output",
    )
    excluded_files: tuple[str, ...] = ("*.lock", "*.log", "*.tmp", "*.cache", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", ".env")
    binary_extensions: tuple[str, ...] = (
        "jpg", "jpeg", "png", "gif", "bmp", "ico", "svg", "mp3", "mp4", "avi", "mov", "pdf", "zip", "tar", "gz", "zst", "bz2", "xz", "7z", "exe", "dll", "so", "dylib", "a", "o", "obj", "class", "jar", "wasm",
        "woff", "woff2", "ttf", "otf", "eot", "pyc", "pyo", "db", "sqlite", "bin", "dat", "pack", "idx",
    )


def git_tracked(spark: SparkSession, root: str) -> DataFrame | None:
    """rel_path of the files git tracks; None where there is no repository."""
    got = subprocess.run(["git", "ls-files", "-z"], cwd=root, capture_output=True, check=False)
    names = [p for p in got.stdout.decode(errors="replace").split("\0") if p]
    return spark.createDataFrame([(n,) for n in names], "rel_path string") if got.returncode == 0 else None


def raw(spark: SparkSession, root: str) -> DataFrame:
    """path, length, content of all files below root, by any file system that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def walked(spark: SparkSession, root: str, settings: ScanSettings = ScanSettings()) -> DataFrame:
    """path, length, content of the files that scan() may keep, of a mounted tree: excluded folders are not opened, and files of other sizes are not read."""
    spark.dataSource.register(walk.TreeWalk)
    excluded = ",".join((*settings.always_excluded, settings.state_dir, *settings.excluded_dirs))
    read = spark.read.format("tree_walk").option("exclude", excluded).option("max_depth", settings.max_depth).option("hidden", str(settings.include_hidden).lower()).option("content", "true")
    found = read.load(root).where(F.col("size") <= settings.max_file_size)
    return found.select(F.concat(F.lit(root.rstrip("/") + "/"), "rel_path").alias("path"), F.col("size").alias("length"), "content")


def on_disk(spark: SparkSession, root: str) -> DataFrame:
    """path, ep (file, dir) of all that a mounted tree holds, scanned or not; of folders, those with a file below them."""
    spark.dataSource.register(walk.TreeWalk)
    found = spark.read.format("tree_walk").option("hidden", "true").option("max_depth", 1000).load(root).select("rel_path")
    dirs = found.select(F.explode(paths.ancestors(F.col("rel_path"))).alias("path")).where("path <> ''").distinct()
    return found.select(F.col("rel_path").alias("path"), F.lit("file").alias("ep")).union(dirs.withColumn("ep", F.lit("dir")))


def scan(found: DataFrame, root: str, settings: ScanSettings = ScanSettings(), tracked: DataFrame | None = None, output: str | None = None) -> DataFrame:
    """found (path, length, content) to rel_path, name, size, extension, importance_score, content. Cheap tests on names come first, the look into contents last."""
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace("\\", "\\\\").replace(".", r"\.") + "/", "")
    rows = found.select(rel.alias("rel_path"), F.col("length").alias("size"), "content").withColumn("name", paths.base_name(F.col("rel_path")))
    folders = F.slice(F.split("rel_path", "/"), F.lit(1), F.size(F.split("rel_path", "/")) - 1)
    never = [d.lower() for d in (*settings.always_excluded, settings.state_dir, *settings.excluded_dirs)]
    hidden = F.lit(False) if settings.include_hidden else F.exists(folders, lambda d: F.startswith(d, F.lit("."))) | F.startswith("name", F.lit("."))
    rows = rows.where(F.size(folders) < settings.max_depth).where(~F.exists(folders, lambda d: F.lower(d).isin(*never))).where(~hidden)
    rows = rows.where(~paths.matches_any(F.lower("name"), tuple(g.lower() for g in settings.excluded_files)))
    rows = rows.withColumn("extension", paths.extension(F.col("rel_path"))).where(~F.coalesce(F.col("extension").isin(*settings.binary_extensions), F.lit(False)))
    rows = rows.where(F.col("size") <= settings.max_file_size)
    if output:
        rows = rows.where(~F.startswith("rel_path", F.lit(output.rstrip("/") + "/")))
    if tracked is not None and not tracked.isEmpty():
        rows = rows.join(tracked, "rel_path", "left_semi")
    rows = rows.where(~texts.has_nul(F.col("content")))
    score = paths.importance(F.col("rel_path"), F.col("size"), F.col("extension"))
    return rows.select("rel_path", "name", "size", "extension", score.alias("importance_score"), F.decode("content", "UTF-8").alias("content"))
