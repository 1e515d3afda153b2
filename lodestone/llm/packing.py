"""Packing documents into fixed windows by non-negative least squares over shallow length combinations.

Every whole window of a document is a sequence of its own; what remains of a document (shorter than the window) is one piece. All
combinations of two or three lengths that fill a window are columns of a system whose right side is the histogram of the remainders;
its non-negative least-squares solution, rounded and held to what is there, says how often each combination is used. Remainders it leaves over are packed
greedily: longest first, end to end, cut where a window is full, so only the last sequence has padding.

A remainder finds its place without any group of rows meeting: its rank among the remainders of its length is its rank in its partition plus
a running sum over partitions, and the combination tables (bounded by the window) map ranks to sequences.

Cases: a null text is empty and has the end id alone; ids may repeat or be null and each row is packed; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import encoding
from lodestone.llm._base import lean, partition_offsets, picked, prepared, table, text_parts

WINDOW, ROUNDS = 1024, 400
#: Offsets of so many (partition, length) pairs are broadcast (under 50 MB); more are joined by shuffle.
BROADCAST_OFFSETS = 2_000_000


def combinations(window: int, lengths: np.ndarray) -> np.ndarray:
    """Rows of three lengths, ascending, 0 where there are two, that sum to the window and are all in lengths."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    there[0] = False
    i, j = np.meshgrid(np.arange(window), np.arange(window), indexing="ij")
    k = window - i - j
    ok = (i <= j) & (j <= k) & there[j] & there[np.maximum(k, 0)] & ((i == 0) | there[i])
    return np.stack([i[ok], j[ok], k[ok]], axis=1)


def solve(combos: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that brings A x near the histogram (A: how often a combination holds a length), by multiplicative updates, which keep x non-negative and
    never let the squared error rise."""
    goal = histogram.astype(np.float64)
    goal[0] = 0

    def across(y: np.ndarray) -> np.ndarray:
        return np.where(combos > 0, y[combos], 0.0).sum(axis=1)

    def along(x: np.ndarray) -> np.ndarray:
        y = np.bincount(combos.ravel(), np.repeat(x, 3), minlength=len(goal))
        y[0] = 0
        return y

    x, up = np.ones(len(combos)), across(goal)
    x *= goal.sum() / max(1.0, along(x).sum())
    for _ in range(rounds):
        x *= up / np.maximum(across(along(x)), 1e-12)
    return x


def allot(histogram: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(combinations used, how often): rounded solutions, largest first, held to the lengths still there."""
    combos = combinations(window, np.flatnonzero(histogram))
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    x = np.rint(solve(combos, histogram)).astype(np.int64)
    left, used, times = histogram.astype(np.int64).copy(), [], []
    for at in np.argsort(-x, kind="stable"):
        if not x[at]:
            break
        own, counts = np.unique(combos[at][combos[at] > 0], return_counts=True)
        if n := min(x[at], int((left[own] // counts).min())):
            left[own] -= n * counts
            used.append(combos[at])
            times.append(n)
    return np.array(used, np.int64).reshape(-1, 3), np.array(times, np.int64)


class Layout:
    """Where the k-th remainder of a length goes. Whole windows have sequences 0 to whole - 1, combinations come next, leftovers last."""

    def __init__(self, histogram: np.ndarray, whole: int, window: int = WINDOW):
        combos, times = allot(histogram, window)
        first = whole + np.cumsum(times) - times
        self.window, self.slots = window, {}
        for row, n, seq in zip(combos.tolist(), times.tolist(), first.tolist(), strict=True):
            offset = 0
            for length in row:
                if length:
                    self.slots.setdefault(length, []).append((n, seq, offset))
                    offset += length
        self.rank: dict[int, np.ndarray] = {}
        used = np.zeros(len(histogram), np.int64)
        for length, slots in self.slots.items():
            ends = np.cumsum([s[0] for s in slots])
            used[length], self.rank[length] = ends[-1], ends
        left = histogram.astype(np.int64) - used
        left[0] = 0
        total = left * np.arange(len(left))
        self.used, self.base = used, total[::-1].cumsum()[::-1] - total
        self.rest, self.left_tokens = whole + int(times.sum()), int(total.sum())

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset) of its pieces."""
        if rank < self.used[length]:
            at = int(np.searchsorted(self.rank[length], rank, side="right"))
            n, seq, offset = self.slots[length][at]
            return [(0, length, seq + rank - int(self.rank[length][at] - n), offset)]
        at, end, out = int(self.base[length]) + (rank - int(self.used[length])) * length, 0, []
        while end < length:
            size = min(length - end, self.window - at % self.window)
            out.append((end, size, self.rest + at // self.window, at % self.window))
            at, end = at + size, end + size
        return out


def _encode(path: str, end: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoding.encoder(path), [0] * window
        for batch in batches:
            for a, b, texts in text_parts(batch.column("text"), encoding.CHUNK):
                ids, sizes = enc.encode(texts, end)
                ranks, wholes = [], []
                for n in sizes.tolist():
                    wholes.append(seen[0])
                    seen[0] += n // window
                    ranks.append(seen[n % window] if n % window else 0)
                    if n % window:
                        seen[n % window] += 1
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("pid"), pa.array(sizes), pa.array(wholes, pa.int64()), pa.array(ranks, pa.int64()), encoding.rows_of(ids.view(np.uint8), np.cumsum(sizes) * enc.kind.itemsize)], ["key", "pid", "n", "whole", "rank", "ids"])

    return run


def _pieces(path: str, layout: Layout):
    window, names = layout.window, ("start", "length", "doc_tokens", "sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoding.encoder(path).kind
        for batch in batches:
            rows, out, ids = [], {c: [] for c in names}, []
            cols = zip(batch.column("n").to_pylist(), batch.column("whole").to_pylist(), batch.column("rank").to_pylist(), batch.column("ids"), strict=True)
            for row, (n, whole, rank, own) in enumerate(cols):
                own, full = np.frombuffer(own.as_buffer(), kind).astype("<u4"), n // window
                places = [(k * window, window, whole + k, 0) for k in range(full)]
                if n % window:
                    places += [(full * window + s, size, seq, at) for s, size, seq, at in layout.place(n % window, rank)]
                for start, size, seq, at in places:
                    for c, v in zip(names, (start, size, n, seq, at), strict=True):
                        out[c].append(v)
                    ids.append(own[start : start + size].tobytes())
                    rows.append(row)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), *(pa.array(out[c], pa.int64()) for c in names), pa.array(ids, pa.binary())], ["key", *names, "ids"])

    return run


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 0, window: int = WINDOW) -> DataFrame:
    """One row a piece: key, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit integers)."""
    prepared(docs.sparkSession)
    path = tokenizer or encoding.default_path("byte_bpe_50k.json")
    rows = picked(docs, key=key, text=text).withColumn("pid", F.spark_partition_id())
    kind = rows.schema["key"].dataType
    longs = [T.StructField(c, T.LongType()) for c in ("n", "whole", "rank")]
    encoded = table(rows.mapInArrow(lean(_encode(path, end, window)), T.StructType([T.StructField("key", kind), T.StructField("pid", T.IntegerType()), *longs, T.StructField("ids", T.BinaryType())])))
    rest = F.col("n") % window
    counted = encoded.groupBy("pid", rest.alias("rest")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("n") / window)).alias("w"))
    wholes = counted.groupBy("pid").agg(F.sum("w").alias("n")).select("pid", F.lit(0).cast("long").alias("rest"), "n")
    offsets = table(partition_offsets(counted.where("rest > 0").select("pid", "rest", "n").union(wholes), "rest"))
    histogram = np.zeros(window, np.int64)
    for r in offsets.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # as many rows as the window at most
        histogram[r["rest"]] = r["n"]
    whole, histogram[0] = int(histogram[0]), 0
    layout = Layout(histogram, whole, window)
    wide = offsets.where("rest = 0").select("pid", F.col("before").alias("w_before"))
    own = offsets.where("rest > 0").select("pid", "rest", F.col("before").alias("r_before"))
    if own.count() <= BROADCAST_OFFSETS:
        wide, own = F.broadcast(wide), F.broadcast(own)
    placed = encoded.withColumn("rest", rest).join(wide, "pid").join(own, ["pid", "rest"], "left")
    placed = placed.select("key", "n", (F.col("whole") + F.col("w_before")).alias("whole"), (F.col("rank") + F.coalesce("r_before", F.lit(0))).alias("rank"), "ids")
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    pieces = placed.mapInArrow(lean(_pieces(path, layout)), T.StructType([T.StructField("key", kind), *longs, T.StructField("ids", T.BinaryType())]))
    return pieces.withColumnRenamed("key", key)
