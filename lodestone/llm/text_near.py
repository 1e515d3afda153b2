"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Weights: ``(1 + ln times) * (1 + IDF_SHARE * idf)``, where idf runs from 0 (in every text) to 1 and comes from a table of fixed size: over all documents Spark counts
in how many texts the shingles of each of 2**DF_BITS hash values occur, and takes off what others than the shingle itself add to its counter on average. Each text gets BANDS * ROWS consistent weighted samples: for a shingle of
weight w and draws r, c ~ Gamma(2, 1), b ~ U(0, 1) from its hash, t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1), and the
smallest a wins. As a is a function of the winner and its t, its bits stand for the sample, and two texts agree in one with the probability of
their weighted Jaccard similarity s; some band of ROWS agrees with 1 - (1 - s**ROWS)**BANDS, 0.9998 at 0.8.

Equal texts are one class. Texts that share a band are compared with two leaders of that band; what agrees is linked. In bands whose texts are not all
connected by then, all texts meet: first split by their whole weight (of two texts with a similarity of LEAST the lighter weighs at least LEAST of the heavier, so
they are in the same or in neighbouring classes of weight), then in tiles of bounded size. For a pair that is still unconnected, a bound comes first: the sum over SKETCH
buckets of the smaller of both texts' weights there is no less than the weight that they share, so a pair that it keeps below LEAST is dissimilar for certain.
The texts of the pairs left meet once more in such tiles, each pair in the first band that it shares, and are
compared unless links have connected them meanwhile. So every pair that shares a band is connected, compared, or surely dissimilar; none is capped,
and no task or frame holds a group's pairs. A link needs a weighted Jaccard similarity of LEAST, computed from the whole texts.

Cases: a null text is empty; texts without words link only with equal texts (all empty texts are equal); each distinct text is one node, whatever keys
its rows have, so a key with two texts may be in two classes; a null key gets its text's class but can name none; keys may be of any type that has an
order; an empty table gives an empty result. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._base import components, cut, dense_rows, dense_sum, lean, picked, prepared, small_batches, table
from lodestone.llm.shingles import distinct, shingles, text_slices

LEAST, BANDS, ROWS, DF_BITS, IDF_SHARE = 0.8, 12, 3, 18, 0.25
#: Buckets of the weights' sketch, and texts (or bytes of them) of a band and class of weight in one block of a tile.
SKETCH, BLOCK, BLOCK_BYTES = 128, 512, 1 << 24
TILE = ["band", "cell", "lo", "hi"]
#: So many ids or fewer are broadcast, with keys and hashes (about 100 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_rng = np.random.default_rng(5)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_gamma: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """2**16 quantiles of Gamma(2, 1), their inverses and logarithms."""
    if not _gamma:
        p = (np.arange(1 << 16) + 0.5) / (1 << 16)
        low, high = np.zeros(len(p)), np.full(len(p), 40.0)
        for _ in range(60):
            x = (low + high) / 2
            less = 1 - np.exp(-x) * (1 + x) < p
            low, high = np.where(less, x, low), np.where(less, high, x)
        _gamma.extend(v.astype(np.float32) for v in (x, 1 / x, np.log(x)))
    return _gamma


def idf_table(counts: np.ndarray, n: int) -> np.ndarray:
    """IDF from 0 to 1 by hash value, of n texts: a counter less what the other shingles put into one on average, 1 at least."""
    if not n:
        return np.zeros(len(counts))
    own = np.maximum(1, counts - (counts.sum() - counts) / max(1, len(counts) - 1))
    return np.log((1 + n) / np.minimum(1 + own, 1 + n)) / np.log((1 + n) / 2 if n > 1 else 2)


def weights(shingle: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(times)) * (1 + IDF_SHARE * idf[(shingle & np.uint64(len(idf) - 1)).astype(np.int64)])


def samples(shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS * ROWS samples (as bits of 32) of each text; starts: where its shingles begin."""
    r_of, inverse_of, log_of = _tables()
    log_w = np.log(weight).astype(np.float32)
    out = np.empty((len(starts), BANDS * ROWS), np.uint32)
    spread = shingle * np.uint64(0x9E3779B97F4A7C15)
    for k in range(BANDS * ROWS):
        z = (spread ^ _ADD[k]) * _MULTIPLY[k]
        z ^= z >> np.uint64(32)
        of_r = (z >> np.uint64(48)).astype(np.int32)
        of_c = ((z >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int32)
        b = (z & np.uint64(0xFFFFFFFF)).astype(np.float32)
        b *= np.float32(2.0**-32)
        t = log_w * inverse_of[of_r]
        t += b
        np.floor(t, out=t)
        t -= b
        t += np.float32(1)
        t *= r_of[of_r]
        np.subtract(log_of[of_c], t, out=t)
        out[:, k] = np.minimum.reduceat(t, starts).view(np.uint32)
    return out


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(1 << DF_BITS, np.int64), 0
    for batch in batches:
        for a, b, data, offsets in text_slices(batch.column(0)):
            _, shingle, _ = distinct(*shingles(data, offsets))
            total += np.bincount((shingle & np.uint64((1 << DF_BITS) - 1)).astype(np.int64), minlength=1 << DF_BITS)
            n += b - a
    yield from dense_rows(np.append(total, n))


def sketches(shingle: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Weights of each of n texts' shingles by bucket."""
    bucket = ((shingle * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % SKETCH
    return np.bincount(doc * SKETCH + bucket, weight, minlength=n * SKETCH).reshape(n, SKETCH).astype(np.float32)


def may_be_similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of sketches can be of texts with a similarity of least. Sums of neighbouring buckets bound it too, and come first."""
    maybe = np.arange(len(a))
    for buckets in (8, SKETCH):
        for k in range(0, len(maybe), 1 << 14):
            own = maybe[k : k + (1 << 14)]
            x, y = (v[own].reshape(len(own), buckets, -1).sum(axis=2) for v in (a, b))
            both, total = np.minimum(x, y).sum(axis=1), x.sum(axis=1) + y.sum(axis=1)
            maybe[k : k + (1 << 14)] = np.where(both * (1 + 1e-4) >= least * (total - both), own, -1)
        maybe = maybe[maybe >= 0]
    return maybe


def _banding(idf: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.log(1 / least) * (1 + 1e-5)
        for batch in batches:
            bands: list[bytes | None] = [None] * len(batch)
            weight, level = list(bands), np.zeros(len(batch), np.int32)
            for a, _, data, offsets in text_slices(batch.column("text")):
                doc, shingle, times = distinct(*shingles(data, offsets))
                if not len(doc):
                    continue
                starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                own = weights(shingle, times, idf)
                got, heavy = samples(shingle, own, starts), sketches(shingle, own, doc, int(doc[-1]) + 1)
                for row, marks in zip(doc[starts].tolist(), got, strict=True):
                    bands[a + row], weight[a + row] = marks.tobytes(), heavy[row].tobytes()
                level[a + doc[starts]] = np.floor(np.log(heavy[doc[starts]].sum(axis=1)) / width)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("hash"), batch.column("size"), pa.array(bands, pa.binary()), pa.array(weight, pa.binary()), pa.array(level)], ["key", "hash", "size", "samples", "sketch", "level"])

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tiles of rows that are sorted by TILE, one at a time; a tile has two blocks at most."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        key = [held.column(c).to_numpy() for c in TILE]
        new = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0))).tolist() if len(held) else []
        for start, end in zip(new[:-1], new[1:], strict=True):
            yield held.slice(start, end - start)
        held = held.slice(new[-1]) if new else held
    if held is not None and len(held):
        yield held


def _partners(tile: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of unconnected texts that may be similar and share no band before this one. Of the lighter class of weight in a cell, no two are paired."""
    own, lo, hi = (tile.column(c).to_numpy() for c in ("own", "lo", "hi"))
    component, at = tile.column("component").to_numpy(), int(tile.column("k")[0].as_py())
    marks = np.frombuffer(b"".join(tile.column("samples").to_pylist()), np.uint32).reshape(len(own), -1)
    light = tile.column("level").to_numpy() < tile.column("cell").to_numpy()
    left = np.flatnonzero(own == lo)
    right = left if lo[0] == hi[0] else np.flatnonzero(own == hi)
    open_ = (component[left][:, None] != component[right][None, :]) & ~(light[left][:, None] & light[right][None, :])
    if lo[0] == hi[0]:
        open_ = np.triu(open_, 1)
    for k in range(at if open_.any() else 0):
        band = open_.copy()
        for r in range(ROWS):
            band &= marks[left, k * ROWS + r][:, None] == marks[right, k * ROWS + r][None, :]
        open_ &= ~band
    i, j = np.nonzero(open_)
    if not len(i):
        return i, j
    heavy = np.frombuffer(b"".join(tile.column("sketch").to_pylist()), np.float32).reshape(len(own), -1)
    i, j = left[i], right[j]
    found = [np.zeros(0, np.int64)]
    for k in range(0, len(i), 1 << 16):
        found.append(k + may_be_similar(heavy[i[k : k + (1 << 16)]], heavy[j[k : k + (1 << 16)]], least))
    at = np.concatenate(found)
    return i[at], j[at]


def _with_partners(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of tiles that have a partner there."""
        for tile in _tiles(batches):
            if len(tile) > 1:
                i, j = _partners(tile, least)
                if len(i):
                    yield from tile.take(pa.array(np.union1d(i, j))).combine_chunks().to_batches()

    return run


def _linking(idf: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links that connect what is similar in each tile; pairs that they connect already are not compared."""
        for tile in _tiles(batches):
            i, j = _partners(tile, least)
            sets: list[tuple[np.ndarray, np.ndarray]] = []
            for s, e, data, offsets in text_slices(tile.column("text").combine_chunks()) if len(i) else ():
                doc, shingle, times = distinct(*shingles(data, offsets))
                w, cuts = weights(shingle, times, idf), np.searchsorted(doc, np.arange(e - s + 1))
                sets += [(shingle[a:b], w[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            root = list(range(len(tile)))

            def find(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            ids, found = tile.column("id").to_pylist(), []
            sums = [float(w.sum()) for _, w in sets]
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                x, y = find(a), find(b)
                if x != y and similar(*sets[a], *sets[b], sums[a] + sums[b], least):
                    root[max(x, y)] = min(x, y)
                    found.append((ids[a], ids[b]))
            yield pa.RecordBatch.from_arrays([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], ["a", "b"])

    return run


def similar(sa: np.ndarray, wa: np.ndarray, sb: np.ndarray, wb: np.ndarray, total: float, least: float) -> bool:
    """Whether two sets of ascending shingles with weights that sum to total have a weighted Jaccard similarity of least."""
    if not len(sa) or not len(sb):
        return False
    at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
    hit = sb[at] == sa
    both = float(np.minimum(wa[hit], wb[at[hit]]).sum())
    return both > 0 and both >= least * (total - both) * (1 - 1e-12)


#: Pairs whose texts are in arrays at a time.
PAIRS = 256


def _verifying(idf: np.ndarray, least: float):
    def compared(batch: pa.RecordBatch) -> list[bool]:
        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for name in ("a", "b"):
            keys = np.array(batch.column(name).to_pylist(), np.int64)
            _, at = np.unique(keys, return_index=True)
            at = at[[k not in sets for k in keys[at].tolist()]] if len(sets) else at
            for s, e, data, offsets in text_slices(batch.column(f"text_{name}").take(pa.array(at))):
                doc, shingle, times = distinct(*shingles(data, offsets))
                w = weights(shingle, times, idf)
                cuts = np.searchsorted(doc, np.arange(e - s + 1))
                for k in range(e - s):
                    sets[int(keys[at[s + k]])] = shingle[cuts[k] : cuts[k + 1]], w[cuts[k] : cuts[k + 1]]
        ok = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            (sa, wa), (sb, wb) = sets[a], sets[b]
            ok.append(similar(sa, wa, sb, wb, float(wa.sum()) + float(wb.sum()), least))
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [x for k in range(0, len(batch), PAIRS) for x in compared(batch.slice(k, PAIRS))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return run


def _moved(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts (id, text) of ids (id, of_key, of_hash; distinct); no others move. By a broadcast of the ids where these are few, else by shuffle. Rows that repeat key and text give one."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    own = texts.join(ids, (F.unhex("hash") == F.col("of_hash")) & F.col("key").eqNullSafe(F.col("of_key")))
    return cut(own.groupBy("id").agg(F.first("text").alias("text")))


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """pairs (a, b) with ``ok``."""
    pairs = cut(pairs)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    moved = _moved(cut(nodes.join(ids, "id")), texts)
    own = pairs.join(moved.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    full = own.join(moved.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    with small_batches(full.sparkSession):
        return cut(full.mapInArrow(lean(_verifying(idf, least)), "a long, b long, ok boolean"))


def _rest(label: DataFrame, equal: DataFrame, texts: DataFrame, nodes: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Links (a, b) between texts of one band and neighbouring classes of weight that label (k, band, id, component) has in different components."""
    placed = label.join(equal.select("id", "level", "size"), "id").withColumn("cell", F.explode(F.array("level", F.col("level") + 1)))
    heavy = F.max(F.col("level") == F.col("cell"))
    cells = placed.groupBy("band", "cell").agg(F.min("component").alias("low"), F.max("component").alias("high"), heavy.alias("some"), F.count("*").alias("n"), F.sum("size").alias("bytes"))
    mixed = cells.where("low < high AND some").select("band", "cell", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).alias("blocks"))
    tiles = placed.join(cut(mixed), ["band", "cell"]).join(equal.select("id", "samples", "sketch"), "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("k", "band", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "component", "level", "samples", "sketch")
    dealt = tiles.repartition(*TILE).sortWithinPartitions(*TILE)
    close = cut(dealt.mapInArrow(lean(_with_partners(least)), tiles.schema))
    moved = _moved(cut(nodes.join(close.select("id").distinct(), "id")), texts)
    close = close.join(moved, "id").select(*tiles.columns, "text").repartition(*TILE).sortWithinPartitions(*TILE)
    with small_batches(close.sparkSession):
        return cut(close.mapInArrow(lean(_linking(idf, least)), "a long, b long").distinct())


def _plain(docs: DataFrame, **roles: str) -> DataFrame:
    """Columns by role; a key that is a whole number is a long."""
    out = picked(docs, **roles)
    return out.withColumn("key", F.col("key").cast("long")) if isinstance(out.schema["key"].dataType, T.IntegralType) else out


def _numbered(equal: DataFrame) -> DataFrame:
    """equal (hash, key: the smallest, samples) with ``id``: the key, or where keys are no whole numbers or some text has none of its own, a number by key and hash."""
    if isinstance(equal.schema["key"].dataType, T.LongType):
        shared = equal.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        if equal.where("key is null").isEmpty() and shared.isEmpty():
            return equal.withColumn("id", F.col("key"))
    return cut(equal.orderBy(F.col("key").asc_nulls_last(), "hash").withColumn("id", F.monotonically_increasing_id()))


def _grouped(docs: DataFrame, key: str, text: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (key, hash of the text) and one row a distinct text: of (its hash), component, exact_id (smallest key), class_id (smallest key of its group)."""
    prepared(docs.sparkSession)
    plain = _plain(docs, key=key, text=text).select("key", F.coalesce("text", F.lit("")).alias("text"))
    counted = dense_sum(plain.select("text").mapInArrow(lean(_counting), "slice int, pid int, counts binary"), (1 << DF_BITS) + 1)
    idf = idf_table(counted[:-1], int(counted[-1])).astype(np.float32)
    hashed = plain.select("key", F.md5("text").alias("hash"), "text")
    kind, sized = plain.schema["key"].dataType, hashed.withColumn("size", F.octet_length("text").cast("long"))
    own = [("size", T.LongType()), ("samples", T.BinaryType()), ("sketch", T.BinaryType()), ("level", T.IntegerType())]
    schema = T.StructType([T.StructField("key", kind), T.StructField("hash", T.StringType()), *(T.StructField(*x) for x in own)])
    rows = table(sized.mapInArrow(lean(_banding(idf, least)), schema))
    equal = _numbered(table(rows.groupBy("hash").agg(F.min("key").alias("key"), *(F.first(c).alias(c) for c, _ in own))))
    nodes = equal.select("id", F.col("key").alias("of_key"), F.unhex("hash").alias("of_hash"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("samples", k * 4 * ROWS + 1, 4 * ROWS)))
    members = equal.where("samples is not null").select("id", F.posexplode(bands).alias("k", "band"))
    chosen = members.groupBy("band").agg(F.min("id").alias("first"), F.max_by("id", F.xxhash64("id", "band")).alias("other"), F.count("*").alias("n")).where("n > 1").drop("n")
    chosen = cut(chosen)
    members = cut(members.join(chosen.select("band"), "band", "left_semi"))
    met = cut(members.join(chosen, "band"))
    pair = lambda x: met.where(F.col(x) != F.col("id")).select(F.least("id", x).alias("a"), F.greatest("id", x).alias("b"))
    tried = _verified(pair("first").union(pair("other")).distinct(), hashed, nodes, idf, least)
    links = tried.where("ok").select("a", "b")
    group = cut(components(links)) if not links.isEmpty() else None
    label = members.withColumn("component", F.col("id")) if group is None else members.join(group, members["id"] == group["node"], "left").select("k", "band", "id", F.coalesce("component", "id").alias("component"))
    links = cut(links.union(_rest(cut(label), equal, hashed, nodes, idf, least)))
    group = components(links)
    own = equal.select("hash", "key", "id").join(group.withColumnRenamed("node", "id"), "id", "left")
    own = cut(own.select(F.col("hash").alias("of"), F.col("key").alias("exact_id"), F.coalesce("component", "id").alias("component")))
    smallest = own.groupBy("component").agg(F.min("exact_id").alias("class_id"))
    return rows.select("key", "hash"), cut(own.join(smallest, "component"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row a document: key, exact_id (smallest key of its equal texts), class_id (smallest key of its group) and kept."""
    rows, named = _grouped(docs, key, text, least)
    out = rows.join(named, F.col("hash") == F.col("of"))
    return out.select(F.col("key").alias(key), "exact_id", "class_id", F.coalesce(F.col("key") == F.col("class_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row of each group of docs: that with the smallest key (null keys last), then the smallest hash of the text; of rows that repeat both, any one."""
    rows, named = _grouped(docs, key, text, least)
    heads = named.groupBy("component").agg(F.min(F.struct(F.isnull("exact_id").alias("none"), "exact_id", "of")).alias("h")).select("h.exact_id", "h.of")
    counted = rows.groupBy("key", "hash").agg(F.count("*").alias("n"))
    judged = counted.join(heads, (F.col("hash") == F.col("of")) & F.col("key").eqNullSafe(F.col("exact_id")), "left")
    gone = cut(judged.where("of is null or n > 1").select(F.col("key").alias("_key"), F.unhex("hash").alias("_hash"), F.col("of").isNotNull().alias("_repeated")))
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key_at, text_at = F.col(f"c{names.index(key)}").cast(rows.schema["key"].dataType), f"c{names.index(text)}"

    def met(those: DataFrame, how: str) -> DataFrame:
        those = F.broadcast(those) if those.count() <= BROADCAST_IDS else those
        same = (F.unhex(F.md5(F.coalesce(text_at, F.lit("")))) == F.col("_hash")) & key_at.eqNullSafe(F.col("_key"))
        return plain.join(those, same, how)

    out = met(gone, "left_anti")
    again = gone.where("_repeated")
    if not again.isEmpty():
        one = cut(met(again, "inner").groupBy("_key", "_hash").agg(F.first(F.struct(*plain.columns)).alias("row")))
        out = out.union(one.select("row.*"))
    return out.toDF(*names)
