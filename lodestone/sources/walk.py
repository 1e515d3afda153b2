"""A folder tree on a file system that all executors mount, as a Python data source: folders are listed in tasks, and excluded ones are never opened.

    spark.dataSource.register(walk.TreeWalk)
    spark.read.format("tree_walk").option("exclude", "target,node_modules").load("/repo").where("size <= 524288 AND extension = 'rs'")

Rows: rel_path, name, size, extension (lower case, null without one), modified, content (null unless option ``content`` is true). Options: exclude (folder names,
whatever their case), max_depth (files at most so many folders down, 10), hidden (true takes names that begin with a dot), folders (how many folders there should be before they are dealt
to tasks, 64). Links are not followed, and what cannot be read is left out. Filters on size, extension and name are taken over (where spark.sql.python.filterPushdown.enabled is
set) and tested on directory entries, before a file is opened. For stores that are not mounted there is tree.raw.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "rel_path string, name string, size long, extension string, modified timestamp, content binary"
_TESTS = {
    EqualTo: lambda a, b: a == b,
    In: lambda a, b: a in b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
}


@dataclass
class Folders(InputPartition):
    """Folders (relative to the root) that one task lists, and whether it goes down into them."""

    paths: tuple[str, ...]
    deep: bool = True


def extension(name: str) -> str | None:
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else None


class WalkReader(DataSourceReader):
    def __init__(self, options: dict):
        get = {k.lower(): v for k, v in options.items()}.get
        self.root = get("path")
        if not self.root or not os.path.isdir(self.root):
            raise ValueError(f"no folder: {self.root}")
        self.excluded = {n.strip().lower() for n in (get("exclude") or "").split(",") if n.strip()}
        self.depth, self.hidden, self.content = int(get("max_depth") or 10), get("hidden") == "true", get("content") == "true"
        self.folders = int(get("folders") or 64)
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("size",), ("extension",), ("name",)):
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f

    def entries(self, folder: str) -> tuple[list[str], list[os.DirEntry]]:
        """Folders to descend into, and files, of one folder, in order of name."""
        inner, files = [], []
        try:
            with os.scandir(os.path.join(self.root, folder) if folder else self.root) as found:
                for e in sorted(found, key=lambda e: e.name):
                    if e.name.startswith(".") and not self.hidden or e.is_symlink():
                        continue
                    if e.is_dir(follow_symlinks=False):
                        if e.name.lower() not in self.excluded:
                            inner.append(f"{folder}/{e.name}" if folder else e.name)
                    elif e.is_file(follow_symlinks=False):
                        files.append(e)
        except OSError:
            pass
        depth = folder.count("/") + 1 if folder else 0
        return (inner if depth + 1 < self.depth else []), files

    def partitions(self) -> list[Folders]:
        """Whole upper levels until there are enough folders: those passed are listed alone, those reached are descended into."""
        above, level = [], [""]
        while level and len(level) < self.folders:
            above += level
            level = [x for folder in level for x in self.entries(folder)[0]]
        each = -(-len(level) // self.folders) or 1
        deep = [Folders(tuple(level[k : k + each])) for k in range(0, len(level), each)]
        return deep + [Folders(tuple(above[k : k + 64]), False) for k in range(0, len(above), 64)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        tests = [(field, next(t for kind, t in _TESTS.items() if kind.__name__ == name), value) for field, name, value in self.tests]
        left = list(reversed(partition.paths))
        while left:
            folder = left.pop()
            inner, files = self.entries(folder)
            if partition.deep:
                left += reversed(inner)
            for e in files:
                try:
                    facts = e.stat(follow_symlinks=False)
                    row = {"name": e.name, "size": facts.st_size, "extension": extension(e.name)}
                    if any(row[field] is None or not test(row[field], value) for field, test, value in tests):
                        continue
                    content = None
                    if self.content:
                        with open(e.path, "rb") as f:
                            content = f.read()
                except OSError:
                    continue
                yield f"{folder}/{e.name}" if folder else e.name, e.name, facts.st_size, row["extension"], datetime.fromtimestamp(facts.st_mtime, UTC), content


class TreeWalk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WalkReader:
        return WalkReader(self.options)
