"""Snapshots of a tree: what changed between two, whether it matters, and how fresh derived documents are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import substrings
from lodestone.session import kept

#: Bytes of members that one row of a fold carries.
CHUNK = 1 << 20


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted members to rows of about CHUNK bytes a key: key, pid (the partition's place in the order), n, bytes."""
    pid, key, held, n = TaskContext.get().partitionId(), None, bytearray(), 0
    row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([pid], pa.int32()), pa.array([n], pa.int64()), pa.array([bytes(held)], pa.binary())], ["key", "pid", "n", "bytes"])
    for batch in batches:
        for k, member in zip(batch.column("key").to_pylist(), batch.column("member").to_pylist(), strict=True):
            if k != key or len(held) >= CHUNK:
                if key is not None:
                    yield row()
                key, n, held = k, n + 1 if k == key else 0, bytearray()
            if member is not None:
                held += member.encode() + b"\0"
    if key is not None:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to a digest a key; a key's state is carried from row to row."""
    key, state = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], ["key", "sig"])
    for batch in batches:
        for k, data in zip(batch.column("key").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    yield done()
                key, state = k, hashlib.sha256()
            state.update(data)
    if key is not None:
        yield done()


def ordered_signatures(members: DataFrame, *order: str) -> DataFrame:
    """members(key, member, order columns) to key, sig: SHA-256 over a key's members in order, each ended by a zero character; null members are left out.

    No key's members are ever together: range partitions by key and order are sorted and made into chunks of bytes in parallel, and only a key's chunks, a row a megabyte,
    go to one task, which hashes them as they come. The members are written first, as their ranges are sampled.
    """
    rows = kept(members.select("key", "member", *(o for o in order if o != "member")))
    rows = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).select("key", "member")
    chunks = rows.mapInArrow(_chunks, "key string, pid int, n long, bytes binary")
    return chunks.repartition("key").sortWithinPartitions("key", "pid", "n").select("key", "bytes").mapInArrow(_hashed, "key string, sig string")


def file_hashes(files: DataFrame) -> DataFrame:
    """path, hash of files(rel_path, content)."""
    return files.select(F.col("rel_path").alias("path"), F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


def dir_signatures(hashes: DataFrame) -> DataFrame:
    """dir, sig: of each directory's own files, '.' at the root."""
    home = paths.parent(F.col("path"))
    members = hashes.select(F.when(home == "", ".").otherwise(home).alias("key"), F.concat("path", F.lit(":"), "hash").alias("member"))
    return ordered_signatures(members, "member").withColumnRenamed("key", "dir")


def subtree_signatures(hashes: DataFrame) -> DataFrame:
    """dir, sig: of all files below each directory, in order of path; '.' holds all."""
    above = hashes.select("path", F.concat("path", F.lit(":"), "hash").alias("member"), F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    members = above.select(F.when(F.col("dir") == "", ".").otherwise(F.col("dir")).alias("key"), "path", "member")
    return ordered_signatures(members, "path", "member").withColumnRenamed("key", "dir")


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, changed) between path, hash frames."""
    both = old.select("path", F.col("hash").alias("o"), F.lit(True).alias("was")).join(new.select("path", F.col("hash").alias("n"), F.lit(True).alias("is")), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def set_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with change: added or removed, of two frames of the same columns as sets (nulls are equal). Both are grouped together once, by which of them hold a row."""
    sides = old.withColumn("change", F.lit(1)).unionByName(new.withColumn("change", F.lit(2))).groupBy(*new.columns).agg(F.bit_or("change").alias("change"))
    return sides.where("change < 3").withColumn("change", F.when(F.col("change") == 1, "removed").otherwise("added"))


def snapshot_diff(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """entity (file, dir, edge), key, change. Snapshots: files(path, hash), dirs(dir, sig), edges(importer, target)."""
    files = file_changes(old["files"], new["files"]).select(F.lit("file").alias("entity"), F.col("path").alias("key"), "change")
    dirs = set_changes(old["dirs"].select("dir"), new["dirs"].select("dir")).select(F.lit("dir").alias("entity"), F.col("dir").alias("key"), "change")
    edges = set_changes(old["edges"].select("importer", "target"), new["edges"].select("importer", "target"))
    return files.unionByName(dirs).unionByName(edges.select(F.lit("edge").alias("entity"), F.concat("importer", F.lit(" -> "), "target").alias("key"), "change"))


def significance(diff: DataFrame, env_changed: bool = False) -> DataFrame:
    """One row: significance (structural, cosmetic) and reasons. Anything but changed contents is structural."""
    n = lambda entity, change: F.count_if((F.col("entity") == entity) & (F.col("change") == change))
    row = diff.agg(*(n(e, c).alias(f"{e}_{c}") for e in ("dir", "file", "edge") for c in ("added", "removed")))

    def reason(entity: str, said: str, unit: str = "") -> Column:
        added, removed = F.col(f"{entity}_added"), F.col(f"{entity}_removed")
        return F.when(added + removed > 0, F.concat(F.lit(f"{said} (+"), added.cast("string"), F.lit(" −"), removed.cast("string"), F.lit(f"{unit})")))

    env = F.when(F.lit(env_changed), "generation environment changed (language, prompts, models or scan config)")
    reasons = F.filter(F.array(env, reason("dir", "directory set changed"), reason("file", "file set changed"), reason("edge", "import graph changed", " edges")), lambda r: r.isNotNull())
    return row.select(F.when(F.size(reasons) > 0, "structural").otherwise("cosmetic").alias("significance"), reasons.alias("reasons"))


def cosmetic_dirs(changes: DataFrame) -> DataFrame:
    """Directories of files whose contents alone changed."""
    home = paths.parent(F.col("path"))
    return changes.where("change = 'changed'").select(F.when(home == "", ".").otherwise(home).alias("dir")).distinct()


def doc_states(docs: DataFrame, domains: DataFrame, changes: DataFrame, structural: bool) -> DataFrame:
    """docs(path, kind: global or deep, there), domains(name, code_path), changes(path): path and state (missing, stale, fresh). A global document is stale after any
    change, a deep one after a structural change or one that touches its domain's paths."""
    any_change = changes.limit(1).agg((F.count("*") > 0).alias("any"))
    near = substrings.overlapping(changes.select("path"), domains.select("code_path")).select(F.col("b").alias("code_path")).distinct()
    touched = domains.join(near, "code_path").select(F.concat(paths.sanitized_name(F.col("name")), F.lit(".md")).alias("file")).distinct().withColumn("touched", F.lit(True))
    rows = docs.withColumn("file", paths.base_name(F.col("path"))).join(touched, "file", "left").crossJoin(any_change)
    stale = F.lit(structural) | F.when(F.col("kind") == "global", F.col("any")).otherwise(F.coalesce("touched", F.lit(False)))
    return rows.select("path", F.when(~F.col("there"), "missing").when(stale, "stale").otherwise("fresh").alias("state"))


def reusable(docs_there: bool, research_time: float | None, written_time: float | None) -> bool:
    """Whether a run may keep its documents: all are there and were written after the research they rest on."""
    return docs_there and research_time is not None and written_time is not None and written_time >= research_time
