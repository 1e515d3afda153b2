"""What the operators of this package share: cut lineage, text slices, row offsets, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import kept, shared_dir, ship


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor loses nothing."""
    return kept(df)


#: Rows that a Python worker gets at a time.
BATCH = 1000


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Inside, Python workers get so many rows at a time: for actions on rows that hold whole texts once or twice."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def table(df: DataFrame) -> DataFrame:
    """As cut(), but as compressed Parquet; for wide rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepared(spark: SparkSession) -> SparkSession:
    """spark, with this package in its workers, a shared folder, and batches for Python that suit rows of whole texts (unless the session says otherwise)."""
    ship(spark)
    shared_dir(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default
        spark.conf.set(name, str(BATCH))
    return spark


def release() -> None:
    """Give this process's unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which releases its worker's unused memory at a task's end: workers are used again, and stages of other kinds run beside idle ones."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def picked(docs: DataFrame, **roles: str) -> DataFrame:
    """Columns of docs by exact name as roles=name, whatever other columns there are (a name that differs in case alone, say)."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"c{names.index(name)}").alias(role) for role, name in roles.items()))


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to ``most`` or less; a row above that stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


#: Counters in one row of a dense table.
SLICE = 1 << 14


def packed_counts(counts: np.ndarray) -> bytes:
    """Counters (not negative) in as few bytes each as the largest needs, after that number of bytes."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpacked_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def dense_rows(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A partition's counters as rows of SLICE, those without a count left out: slice, pid, counts (see packed_counts)."""
    from pyspark import TaskContext

    context = TaskContext.get()
    for k in range(0, len(counts), SLICE):
        if counts[k : k + SLICE].any():
            yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([context.partitionId() if context else 0], pa.int32()), pa.array([packed_counts(counts[k : k + SLICE])], pa.binary())], ["slice", "pid", "counts"])


#: Rows of a slice that one task sums (16 to 128 KB each).
FAN = 1 << 10


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = functools.reduce(np.add, map(unpacked_counts, pdf["counts"]))
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "pid": pdf["pid"].iloc[:1] // FAN, "counts": [packed_counts(total)]})


def dense_sum(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all partitions' dense_rows on the driver: a table of fixed size, of which one row a slice arrives from up to FAN * FAN partitions."""
    schema = "slice int, pid int, counts binary"
    for _ in range(2):
        parts = parts.groupBy("slice", F.floor(F.col("pid") / FAN)).applyInPandas(_summed, schema)
    out = np.zeros(-(-size // SLICE) * SLICE, np.int64)
    for r in parts.collect():
        got = unpacked_counts(bytes(r["counts"]))
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(got)] += got
    release()
    return out[:size]


def text_parts(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, row after the last, texts) of pieces of a string column of about ``most`` characters; nulls are empty. Only one piece at a time is in Python's own strings."""
    sizes = np.asarray(pc.fill_null(pc.utf8_length(column), 0))
    for a, b in slices(sizes, most):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]


def partition_offsets(counted: DataFrame, *by: str) -> DataFrame:
    """counted: columns ``pid``, ``n`` and ``by``, one row for each partition (and key). Adds ``before``: the sum of n over
    smaller pids of the key, by doubling blocks of 1024 pids, so no task holds more than a key's 1024 blocks at a time."""
    from pyspark.sql import Window as W

    block = F.floor(F.col("pid") / 1024)
    counted = counted.withColumn("block", block)
    upper = counted.groupBy("block", *by).agg(F.sum("n").alias("n"))
    upper = upper.select("block", *by, (F.sum("n").over(W.partitionBy(*by).orderBy("block")) - F.col("n")).alias("above"))
    within = F.sum("n").over(W.partitionBy("block", *by).orderBy("pid")) - F.col("n")
    return counted.withColumn("within", within).join(upper, ["block", *by]).select("pid", *by, "n", (F.col("within") + F.col("above")).alias("before"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest node reachable, by alternating large and small stars.

    Only nodes with a link appear. Each step is a grouped minimum, cut, then an equi-join that adaptive execution can split on a hot node; the driver sees a count and a checksum.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs, seen = cut(pairs), None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == now:
            break
        seen = now
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
