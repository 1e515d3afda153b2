"""Ranked lexical search over a bit-sliced impact index: bitmaps of impact bits per term, added by carry arithmetic; the best are found from the highest bit slice down.

Documents are indexed in blocks, in order of their keys. For each term of the queries a block has bitmaps: bit i of the impact of document d is bit d of the term's i-th
bitmap, kept as those 64-bit words that have any document. An impact is the term's whole part of a score, an exact integer. A query's scores are never held
as numbers: the bitmaps of its terms are added pairwise with exclusive-or and and, as an adder of one bit a document does, for all its documents and many queries at once. The best k
come from the sum's bitmaps: from the highest bit down, documents with the bit are split from those without until k are left; the last ties go to the smaller key.

Queries are taken in blocks of a bounded number of terms. For each block the documents are read twice: first as Parquet of key, length and occurrences of the queries' terms, with
document frequencies summed over partitions in a table as large as the block's vocabulary; then block by block against all queries. A task keeps no score but
each query's k-th so far, below which it reports nothing; what tasks report is ranked in two steps.

score = sum over the query's terms, once each, of w * ((10**9 * tf) div (1000 * tf + 8 * m)); w = floor(1000 * ln((2 N + 2) / (2 df + 1))); m = 10 + (90 * n * N) div L.

Cases: null texts have no terms; documents without terms count nowhere and are never found; keys may repeat or be null (each row is found by itself, null keys come last among ties);
rows of one query id are one query with all their terms; queries without terms, and those whose terms no document holds, have no rows; empty tables give an empty
result; other columns are not read. A very long text is split into terms a piece at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._base import cut, dense_rows, dense_sum, lean, picked, prepared, table
from lodestone.llm.terms import ALPHANUMERIC, terms, texts

TOP = 10
#: Terms (with repeats between queries) of a block of queries; one query with more is a block of its own.
QUERY_TERMS = 1 << 17
#: Documents of an index block, and occurrences (of a term in a document) after which a block ends.
BLOCK, POSTINGS = 4096, 1 << 20
#: 64-bit words of one bit slice in an addition.
CELLS = 1 << 16


def query_terms(text: Column) -> Column:
    """Distinct terms of a query."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"), F.lit(0))
    return F.array_distinct(F.coalesce(found, F.array()))


class Queries:
    """A block of queries: ids, and each one's terms as numbers in vocabulary."""

    def __init__(self, rows: list[tuple[object, list[str]]]):
        self.ids = [r[0] for r in rows]
        self.vocabulary: dict[bytes, int] = {}
        number = lambda term: self.vocabulary.setdefault(term.encode(), len(self.vocabulary))
        self.terms = [np.array([number(t) for t in r[1]], np.int64) for r in rows]


def query_blocks(queries: DataFrame, key: str, text: str) -> Iterator[Queries]:
    """All queries, by id; the driver holds one block at a time."""
    rows = picked(queries, key=key, text=text).select("key", F.explode(query_terms(F.col("text"))).alias("term")).distinct()
    block: list[tuple[object, list[str]]] = []
    size = 0
    for key_, term in cut(rows.orderBy("key", "term")).toLocalIterator():
        if not block or block[-1][0] != key_:
            if size >= QUERY_TERMS:
                yield Queries(block)
                block, size = [], 0
            block.append((key_, []))
        block[-1][1].append(term)
        size += 1
    if block:
        yield Queries(block)


def _forward(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, times = [], [], []
            for text in texts(batch.column("text")):
                found: Counter[bytes] = Counter()
                for part in terms(text, ALPHANUMERIC):
                    found.update(part)
                n.append(found.total())
                own = np.array([(vocabulary[t], c) for t, c in found.items() if t in vocabulary], np.int64).reshape(-1, 2)
                ids.append(own[:, 0].astype("<u4").tobytes())
                times.append(own[:, 1].astype("<u4").tobytes())
            out = pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(times, pa.binary())], ["key", "n", "ids", "times"])
            yield out.filter(pc.greater(out.column("n"), 0))

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                counts[np.frombuffer(ids.as_buffer(), "<u4")] += 1  # no id twice in a document
        yield from dense_rows(counts)

    return run


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of two numbers in bit slices, lowest first: a carry runs through them."""
    out, carry = [], np.zeros_like(a[0])
    for x, y in zip(a, b, strict=True):
        half = x ^ y
        out.append(half ^ carry)
        carry = (x & y) | (half & carry)
    return [*out, carry]


def total(slices: np.ndarray) -> list[np.ndarray]:
    """slices: (bits, numbers, terms, words), terms a power of two. The sums over terms, as slices of (numbers, words)."""
    own = list(slices)
    while own[0].shape[1] > 1:
        half = own[0].shape[1] // 2
        own = add([x[:, :half] for x in own], [x[:, half:] for x in own])
    return [x[:, 0] for x in own]


def best(slices: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, place) of the k largest positive scores of each number, the last ties by place."""
    tied = np.bitwise_or.reduce(slices)
    sure = np.zeros_like(tied)
    n_sure = np.zeros(len(tied), np.int64)
    for x in reversed(slices):
        having = tied & x
        n = n_sure + np.bitwise_count(having).sum(axis=1, dtype=np.int64)
        many = n > k
        sure |= np.where(many[:, None], 0, having)
        n_sure = np.where(many, n_sure, n)
        tied = np.where(many[:, None], having, tied & ~x)
    flags = lambda x: np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
    tied = flags(tied)
    rest = np.cumsum(tied, axis=1, dtype=np.int64) <= (k - n_sure)[:, None]
    return np.nonzero(flags(sure) | (tied & rest))


class Index:
    """Bitmaps of one block: postings (term, place, impact) sorted by term and place; places below n_docs."""

    def __init__(self, term: np.ndarray, place: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        self.words = -(-n_docs // 64)
        self.bits = int(impact.max(initial=0)).bit_length()
        cell = term * self.words + (place >> 6)
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
        bit = np.uint64(1) << (place & 63).astype(np.uint64)
        self.word = place[first] >> 6
        self.slices = np.zeros((self.bits, len(first)), np.uint64)
        for i in range(self.bits):
            if len(first):
                self.slices[i] = np.bitwise_or.reduceat(np.where((impact >> i) & 1, bit, np.uint64(0)), first)
        self.start = np.searchsorted(term[first], np.arange(n_terms + 1))

    def search(self, queries: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, place, score) of each query's k best, several queries at a time."""
        if not self.bits:
            return
        here = self.start[1:] > self.start[:-1]
        queries = [q[here[q]] for q in queries]
        order = sorted((len(q), i) for i, q in enumerate(queries) if len(q))
        at = 0
        while at < len(order):
            width, stop = 1, at
            while stop < len(order):
                wider = 1 << (order[stop][0] - 1).bit_length()
                if stop > at and (stop - at + 1) * wider * self.words > CELLS:
                    break
                width, stop = wider, stop + 1
            numbers = np.array([i for _, i in order[at:stop]])
            yield from self._together(numbers, [queries[i] for i in numbers], width, k)
            at = stop

    def _together(self, numbers: np.ndarray, own: list[np.ndarray], width: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        slot = np.concatenate([j * width + np.arange(len(q)) for j, q in enumerate(own)])
        term = np.concatenate(own)
        size = self.start[term + 1] - self.start[term]
        offset = np.repeat(self.start[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cells = np.zeros((self.bits, len(own) * width * self.words), np.uint64)
        cells[:, np.repeat(slot, size) * self.words + self.word[offset]] = self.slices[:, offset]
        sums = total(cells.reshape(self.bits, len(own), width, self.words))
        query, place = best(sums, k)
        score = np.zeros(len(query), np.int64)
        for i, x in enumerate(sums):
            score |= ((x[query, place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << i
        yield numbers[query], place, score


def _search(queries: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    def block(rows: pa.Table, least: np.ndarray) -> pa.RecordBatch:
        rows = rows.take(pc.sort_indices(rows, [("key", "ascending")], null_placement="at_end"))
        ids = [np.frombuffer(x.as_buffer(), "<u4") for c in rows.column("ids").chunks for x in c]
        times = [np.frombuffer(x.as_buffer(), "<u4") for c in rows.column("times").chunks for x in c]
        place = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        term, tf = (np.concatenate(x).astype(np.int64) for x in (ids, times))
        m = np.array([10 + 90 * n * n_docs // n_terms for n in rows.column("n").to_pylist()], np.int64)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[place]))
        order = np.argsort(term, kind="stable")
        out = [np.zeros(0, np.int64)] * 3
        for found in Index(term[order], place[order], impact[order], len(ids), len(weight)).search(queries, k):
            worth = found[2] >= least[found[0], 0]
            out = [np.concatenate([a, b[worth]]) for a, b in zip(out, found, strict=True)]
            for q in np.unique(found[0]).tolist():
                least[q] = np.sort(np.concatenate([least[q], found[2][found[0] == q]]))[-k:]
        key = rows.column("key").take(pa.array(out[1])).combine_chunks()
        key = key.chunk(0) if isinstance(key, pa.ChunkedArray) else key
        return pa.RecordBatch.from_arrays([pa.array(out[0].astype(np.int32)), key, pa.array(out[2])], ["query", "key", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.zeros((len(queries), k), np.int64)
        waiting, docs, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                waiting.append(part)
                docs, postings = docs + part.num_rows, postings + sum(len(x.as_buffer()) for x in part.column("ids")) // 4
                if docs + 256 > BLOCK or postings >= POSTINGS:
                    yield block(pa.Table.from_batches(waiting), least)
                    waiting, docs, postings = [], 0, 0
        if waiting:
            yield block(pa.Table.from_batches(waiting), least)

    return run


def search(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", top: int = TOP) -> DataFrame:
    """Each query's ``top`` documents with a score above 0: query_key, rank (from 1), key, score; equal scores by ascending key."""
    prepared(docs.sparkSession)
    rows = picked(docs, key=key, text=text)
    kind, query_kind = rows.schema["key"].dataType, queries.schema[query_key].dataType
    result = docs.sparkSession.createDataFrame([], T.StructType([T.StructField(query_key, query_kind), T.StructField("rank", T.IntegerType()), T.StructField(key, kind), T.StructField("score", T.LongType())]))
    for block in query_blocks(queries, query_key, query_text):
        found = _ranked(rows, block, top)
        ids = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), T.StructType([T.StructField("query", T.IntegerType()), T.StructField("id", query_kind)]))
        named = found.join(F.broadcast(ids), "query")  # as many rows as the block has queries
        result = result.union(named.select("id", "rank", "key", "score"))
    return result


def _ranked(rows: DataFrame, block: Queries, top: int) -> DataFrame:
    n_terms = len(block.vocabulary)
    schema = T.StructType([rows.schema["key"], T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("times", T.BinaryType())])
    forward = table(rows.mapInArrow(lean(_forward(block.vocabulary)), schema))
    n_docs, length = forward.agg(F.count("*"), F.sum("n")).first()
    df = dense_sum(forward.select("ids").mapInArrow(lean(_frequencies(n_terms)), "slice int, pid int, counts binary"), n_terms)
    schema = T.StructType([T.StructField("query", T.IntegerType()), rows.schema["key"], T.StructField("score", T.LongType())])
    found = forward.mapInArrow(lean(_search(block.terms, weights(df, n_docs), n_docs, length or 1, top)), schema)
    order = F.col("score").desc(), F.col("key").asc_nulls_last()
    near = W.partitionBy("query", F.floor(F.col("pid") / 1024)).orderBy(*order)
    found = found.withColumn("pid", F.spark_partition_id()).withColumn("near", F.row_number().over(near)).where(F.col("near") <= top)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)
