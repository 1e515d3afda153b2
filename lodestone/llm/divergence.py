"""Audit of how a language's sources differ in their words: smoothed shares of kept terms, compared between sources and with the whole language.

Terms are counted a partition at a time, by (language, source), and meet by (language, term): a row has the counts of all sources of its language. Terms in too few documents go. What is left is
sorted by language and term in range partitions, so a task reads sorted term arrays: a searched place in the array of kept terms is a term's id, ids follow UTF-8 order, and one bincount by
(source, id) makes dense vectors of a chunk of terms for all sources at once. Shares, divergences and the best terms of a group come from these vectors; sums over chunks add up, and ties of terms are ties of ids.
No dictionary is sent to all tasks: a task has the chunk it works on.

Languages are taken in batches of LIMIT (language, source) groups, or one language with more by itself: a batch's groups and their totals go to all tasks, less than
the pairs of sources which each language reports. Vectors are of at most SIDE sources by SIDE others at a time, whatever their number.

p = 1 + floor(10**9 * (count + 1) / (N + V)) by long division in 64 bits; f = floor((p - q)**2 / q).

Cases: null text, language and source are ''; texts without terms still make their group, with counts of 0; a language without kept terms has pair values of 0 and no
terms; rows may repeat and each counts; an empty table gives an empty result; other columns are not read. A very long text is split into terms a piece at a time.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm._base import cut, lean, partition_offsets, picked, prepared, table
from lodestone.llm.terms import LETTERS, terms, texts

SCALE_DIGITS = 9
#: Documents of a language that a kept term is in; terms reported of a group.
LEAST, TOP = 3, 200
#: Entries (a term in a group) that a task counts before it passes them on.
ENTRIES = 1 << 20
#: Sources on a side of a dense tile, and cells (sources by terms) of a side.
SIDE, CELLS = 128, 1 << 19
#: Groups of a batch of languages.
LIMIT = 50_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: defaultdict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in groups.items():
            size = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "df"])
        groups.clear()

    held = 0
    for batch in batches:
        keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for key, text in zip(keys, texts(batch.column("text")), strict=True):
            n, df = groups[key]
            held -= len(n)
            own: Counter[bytes] = Counter()
            for part in terms(text, LETTERS):
                own.update(part)
            n.update(own)
            df.update(own.keys())
            held += len(n)
            if held >= ENTRIES:
                yield from told()
                held = 0
    yield from told()


def share(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(10**SCALE_DIGITS * (count + 1) / size), exact: long division by decimal digits."""
    whole, rest = np.divmod(count + 1, size)
    for _ in range(SCALE_DIGITS):
        digit, rest = np.divmod(rest * 10, size)
        whole = whole * 10 + digit
    return 1 + whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Tile:
    """Sums and best terms of sources ``a`` against sources ``b`` of one language, over chunks of its sorted terms."""

    def __init__(self, lang: str, sources: list[str], totals: np.ndarray, n_terms: int, a: int, b: int):
        self.lang, self.sources, self.same = lang, sources, a == b
        self.first = a * SIDE, b * SIDE
        self.size = [np.array(totals[f : f + SIDE] + n_terms)[:, None] for f in self.first]
        self.whole = int(totals.sum()) + n_terms
        self.sums = np.zeros((len(self.size[0]), len(self.size[1])), np.int64)
        self.best: list[tuple[np.ndarray, ...]] = []

    def vectors(self, side: int, ids: np.ndarray, source: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
        """Counts of the chunk's terms (columns) in the side's sources (rows); sums below 2**53 are exact in bincount's weights."""
        rows = len(self.size[side])
        own = (source >= self.first[side]) & (source < self.first[side] + rows)
        cells = (source[own] - self.first[side]) * width + ids[own]
        return np.bincount(cells, n[own], rows * width).astype(np.int64).reshape(rows, width)

    def take(self, kept: np.ndarray, term: np.ndarray, source: np.ndarray, n: np.ndarray, all_n: np.ndarray) -> pa.RecordBatch | None:
        """kept: the chunk's sorted terms with counts all_n in the language; term, source, n: occurrences."""
        ids = np.searchsorted(kept, term)
        a = self.vectors(0, ids, source, n, len(kept))
        p = share(a, self.size[0])
        q = p if self.same else share(self.vectors(1, ids, source, n, len(kept)), self.size[1])
        for i in range(len(p)):
            self.sums[i] += divergence(p[i], q).sum(axis=1)
        if not self.same:
            return None
        whole = share(all_n, np.array(self.whole))
        value = divergence(p, whole)
        row, at = np.nonzero((a > 0) & (p > whole))
        order = np.lexsort((at, -value[row, at], row))
        row, at = row[order], at[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, at = row[place < TOP], at[place < TOP]
        return self._rows("term", row, kept[at].tolist(), value[row, at])

    def pairs(self) -> pa.RecordBatch:
        i, j = np.nonzero(np.ones_like(self.sums, bool))
        i, j = (x[i + self.first[0] != j + self.first[1]] for x in (i, j))
        return self._rows("pair", i, [self.sources[k + self.first[1]] for k in j.tolist()], self.sums[i, j])

    def _rows(self, part: str, row: np.ndarray, item: list, value: np.ndarray) -> pa.RecordBatch:
        source = [self.sources[k + self.first[0]] for k in row.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(source), pa.string()), pa.array(source, pa.string()), pa.array([part] * len(source), pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def _tiles(groups: dict[str, tuple[list[str], np.ndarray, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, now = None, None
        for batch in batches:
            langs, a, b = (batch.column(c).to_pylist() for c in ("lang", "a", "b"))
            keys = list(zip(langs, a, b, strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for start, stop in zip(edges, edges[1:], strict=False):
                if stop > start and keys[start] != now:
                    if tile is not None:
                        yield tile.pairs()
                    now = keys[start]
                    tile = Tile(now[0], *groups[now[0]], *now[1:])
                width = max(1, CELLS // SIDE)
                for at in range(start, stop, width):
                    yield from _chunk(tile, batch.slice(at, min(width, stop - at)))
        if tile is not None:
            yield tile.pairs()

    return run


def _chunk(tile: Tile, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    kept = np.array(part.column("term").cast(pa.binary()).to_pylist(), object)
    counts, all_n = part.column("counts"), part.column("n").to_numpy()
    sizes = np.diff(counts.offsets.to_numpy())
    own = counts.flatten()
    out = tile.take(kept, np.repeat(kept, sizes), own.field("source").to_numpy(), own.field("n").to_numpy(), all_n)
    if out is not None:
        yield out


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: how far each group is from the language's other sources, and the terms that set it apart."""
    spark = prepared(docs.sparkSession)
    rows = picked(docs, lang=lang, source=source, text=text).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    counted = table(rows.mapInArrow(lean(_count), "lang string, source string, term string, n long, df long"))
    groups = cut(_numbered(rows))
    number = groups.select("lang", "source", "number")
    terms_ = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    small = number.count() <= LIMIT
    terms_ = terms_.join(F.broadcast(number) if small else number, ["lang", "source"])
    terms_ = terms_.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.collect_list(F.struct(F.col("number").alias("source"), "n")).alias("counts"))
    kept = table(terms_.where(F.col("df") >= LEAST).select("lang", "term", "n", "counts"))  # a list has an entry a source at most
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("number")).agg(F.sum("c.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    groups = cut(groups.join(totals, ["lang", "number"], "left").join(sizes, "lang", "left").fillna(0, ["total", "n_terms"]))
    found = spark.createDataFrame([], "lang string, source string, part string, item string, value long")
    for r in groups.select("batch").distinct().orderBy("batch").toLocalIterator():
        own: dict[str, tuple[list[str], list[int], int]] = {}
        for g in groups.where(F.col("batch") == r["batch"]).orderBy("lang", "number").collect():  # LIMIT, or one language's
            own.setdefault(g["lang"], ([], [], g["n_terms"]))
            own[g["lang"]][0].append(g["source"])
            own[g["lang"]][1].append(g["total"])
        batch = {k: (v[0], np.array(v[1], np.int64), v[2]) for k, v in own.items()}
        blocks = spark.createDataFrame([(k, -(-len(v[0]) // SIDE)) for k, v in batch.items()], "lang string, blocks int")
        block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        tiled = kept.join(F.broadcast(blocks), "lang").withColumn("a", block).withColumn("b", block)  # a row a tile of the language's sources
        tiled = tiled.repartitionByRange("lang", "a", "b", "term").sortWithinPartitions("lang", "a", "b", "term").select("lang", "a", "b", "term", "n", "counts")
        found = found.union(tiled.mapInArrow(lean(_tiles(batch)), "lang string, source string, part string, item string, value long"))
    return _ranked(cut(found), number)


def _numbered(rows: DataFrame) -> DataFrame:
    """lang, source, number (of the source in its language, by code point), batch."""
    groups = rows.select("lang", "source").distinct().repartitionByRange("lang", "source").sortWithinPartitions("lang", "source")
    groups = cut(groups.withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    own = F.row_number().over(W.partitionBy("pid", "lang").orderBy("at")) - 1
    before = partition_offsets(groups.groupBy("pid", "lang").agg(F.count("*").alias("n")), "lang").select("pid", "lang", "before")
    numbered = groups.withColumn("own", own).join(before, ["pid", "lang"]).select("lang", "source", (F.col("own") + F.col("before")).alias("number"))
    langs = cut(numbered.groupBy("lang").agg(F.count("*").alias("n")).repartitionByRange("lang").withColumn("pid", F.spark_partition_id()))
    ahead = partition_offsets(langs.groupBy("pid").agg(F.sum("n").alias("n"))).select("pid", "before")
    within = F.sum("n").over(W.partitionBy("pid").orderBy("lang")) - F.col("n")
    batch = langs.withColumn("within", within).join(ahead, "pid").select("lang", F.floor((F.col("within") + F.col("before")) / LIMIT).alias("batch"))
    return numbered.join(batch, "lang")


def _ranked(found: DataFrame, groups: DataFrame) -> DataFrame:
    own = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    words = found.where("part = 'term'").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= TOP)
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    a, b = groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item"))
    pairs = a.join(b, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")  # the result itself has a row for each
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")).withColumn("rank", F.row_number().over(own))
    return pairs.union(words.select(*pairs.columns))
