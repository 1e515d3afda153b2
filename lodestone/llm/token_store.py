"""Token ids on disk: frequency-ranked, in byte-aligned codes of one to four bytes, with separate control bytes.

A store is a folder of Parquet shards, one folder a range of keys (``shard=...``), rows ascending by key, one row a document: key, start (ids of all
documents before it), n_tokens, control (two bits an id, its code's length less one, four ids a byte) and data (the codes, little-endian).
The code of an id is its rank by frequency over all documents, so the 256 most frequent ids take one byte; ``ranks`` beside the shards
holds the ids by rank. Rows are read by table lookup: a control byte gives four lengths, their running sum the places.

Cases: a null text is empty and has the end id alone; null keys come first; rows that repeat a key follow each other, in order of their texts' hashes (so reruns agree), may lie in several shards, and count each;
an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import encoding
from lodestone.llm._base import cut, lean, partition_offsets, picked, prepared, shared_dir, slices, table, text_parts

#: Lengths of four codes by control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack_codes(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The codes of several documents, one after another, counts each: control bytes, where each document's end, code bytes, where each document's end."""
    codes = codes.astype("<u4", copy=False)
    sizes = 1 + (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    ends = np.cumsum(counts)
    control_ends = np.cumsum(-(-counts // 4))
    control = np.zeros(4 * int(control_ends[-1]) if len(counts) else 0, np.uint8)
    control[np.arange(len(codes)) + np.repeat(4 * (control_ends + (-counts // 4)) - (ends - counts), counts)] = sizes - 1
    control = control.reshape(-1, 4)
    control = control[:, 0] | control[:, 1] << 2 | control[:, 2] << 4 | control[:, 3] << 6
    place = np.cumsum(sizes, dtype=np.int64)
    data = np.empty(int(place[-1]) if len(place) else 0, np.uint8)
    data_ends = np.append(0, place)[ends]
    place -= sizes
    data[place] = codes & 0xFF
    for k in range(1, int(sizes.max(initial=1))):
        more = np.flatnonzero(sizes > k)
        data[place[more] + k] = codes[more] >> np.uint32(8 * k) & 0xFF
    return control, control_ends, data, data_ends


def unpack_codes(control: np.ndarray, counts: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The codes that pack_codes was given."""
    padded = -(-counts // 4) * 4
    sizes = LENGTHS[control].ravel()
    if (padded != counts).any():
        first = np.cumsum(padded) - padded
        sizes = sizes[np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)]
    at = np.cumsum(sizes, dtype=np.int64)
    at -= sizes
    codes = data[at].astype("<u4")
    for k in range(1, int(sizes.max(initial=1))):
        more = np.flatnonzero(sizes > k)
        codes[more] |= data[at[more] + k].astype("<u4") << np.uint32(8 * k)
    return codes


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes and offsets (from 0)."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start = encoding.encoder(path), 0
        for batch in batches:
            for a, b, texts in text_parts(batch.column("text"), encoding.CHUNK):
                ids, n = enc.encode(texts, end)
                part = batch.slice(a, b - a)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("shard"), pa.array(starts), pa.array(n), encoding.rows_of(ids.view(np.uint8), np.cumsum(n) * enc.kind.itemsize)], ["key", "shard", "local", "n_tokens", "ids"])

    return run


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(path)
        total = np.zeros(enc.tokenizer.get_vocab_size(), np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column("ids"))[0].view(enc.kind), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return run


def _code(path: str, ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoding.encoder(path).kind
        for batch in batches:
            counts = np.array(batch.column("n_tokens").to_pylist(), np.int64)
            data, offsets = flat(batch.column("ids"))
            for a, b in slices(counts, 1 << 20):
                control, control_ends, codes, ends = pack_codes(ranks[data[offsets[a] : offsets[b]].view(kind)], counts[a:b])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("shard", "key", "start", "n_tokens")), encoding.rows_of(control, control_ends), encoding.rows_of(codes, ends)], ["shard", "key", "start", "n_tokens", "control", "data"])

    return run


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 2) -> None:
    """Encode docs and write a store to folder, which executors and driver must share."""
    spark = prepared(docs.sparkSession)
    path = tokenizer or encoding.default_path("byte_bpe_50k.json")
    # rows of one key are in order of their texts' hashes; the last part of the order splits equal rows, which are alike in every order
    order = ("key", "tie", "row")
    rows = picked(docs, key=key, text=text).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "row")
    rows = rows.withColumn("shard", F.spark_partition_id())
    kind = rows.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("shard", T.IntegerType()), T.StructField("local", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    encoded = table(rows.mapInArrow(lean(_encode(path, end)), schema))
    counts = encoded.select("ids").mapInArrow(lean(_counts(path)), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = np.array([r["id"] for r in counts.orderBy(F.desc("n"), "id").select("id").collect()], np.int64)  # as many as the vocabulary at most
    ranks = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    before = partition_offsets(encoded.groupBy(F.col("shard").alias("pid")).agg(F.sum("n_tokens").alias("n")))
    before = cut(before.select(F.col("pid").alias("shard"), "before"))  # a row for each partition written
    placed = encoded.join(F.broadcast(before), "shard").select("shard", "key", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids").sortWithinPartitions("shard", "start")
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("key", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])
    placed.mapInArrow(lean(_code(path, ranks)), schema).sortWithinPartitions("shard", "start").write.partitionBy("shard").parquet(f"{folder}/shards")
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{folder}/ranks")


def _decode(by_rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array(batch.column("n_tokens").to_pylist(), np.int64)
            (control, control_at), (data, data_at) = flat(batch.column("control")), flat(batch.column("data"))
            for a, b in slices(counts, 1 << 20):
                ids = by_rank[unpack_codes(control[control_at[a] : control_at[b]], counts[a:b], data[data_at[a] : data_at[b]])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("key", "start", "n_tokens")), encoding.rows_of(ids.view(np.uint8), 4 * np.cumsum(counts[a:b]))], ["key", "start", "n_tokens", "ids"])

    return run


def read(spark: SparkSession, folder: str, key_type: T.DataType | None = None) -> DataFrame:
    """key, start, n_tokens, ids (little-endian unsigned 32-bit integers) of every document of a store."""
    prepared(spark)
    ranks = spark.read.schema("ids binary").parquet(f"{folder}/ranks").first()
    kind = key_type or T.LongType()
    fields = [T.StructField("key", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType())]
    rows = spark.read.schema(T.StructType([*fields, T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])).parquet(f"{folder}/shards")
    return rows.mapInArrow(lean(_decode(np.frombuffer(bytes(ranks["ids"]), "<u4"))), T.StructType([*fields, T.StructField("ids", T.BinaryType())]))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
