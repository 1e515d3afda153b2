"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length (powers of ``RATIO``); a bucket above ``BLOCK`` rows is dealt into blocks, so no task holds an unbounded
group. The longest rows give each query a first k-th score, and that the length a candidate must have at least. Queries that need alike lengths share a part, and
pairs of parts and blocks are chosen by these lengths before any vector moves. In a task, from the query's
k-th score and the block's longest row comes the cosine a candidate needs at least; above 1 the block is skipped for that query.
Otherwise the block prunes by length (a candidate must have length >= score / |query|) or, where the cosine needed is high, by the query's largest
coordinate (on which a unit vector with that cosine can only lie in a narrow range). What is left is verified by exact products.

Cases: vectors that are null, empty or hold null or non-finite components, and null ids, take no part; zero vectors do; rows that repeat an id
are candidates each, but never of a query of the same id, and queries that repeat an id share one ranking of all their scores; fewer than k candidates give fewer rows; ties go to the smaller id.
Vectors shorter than others count as padded by zeros.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm._base import cut, picked, prepared

BLOCK, QUERIES, RATIO = 4096, 2048, 1.05
#: From this cosine on, a block prunes by coordinate.
COORDINATE_FROM = 0.5


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by double arithmetic where no sum can leave its exact range, else by Python integers, cut to 64 bits."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    a = np.array([[int(x) for x in r] for r in q], object)
    b = np.array([[int(x) for x in r] for r in c], object)
    return np.clip(a @ b.T, -(2**63), 2**63 - 1).astype(np.int64)


def best(q_ids: np.ndarray, q: np.ndarray, need: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[list, list, list]:
    """Each query's k best candidates among those with at least the score in need (-inf: none known)."""
    order = np.lexsort((c_ids, -np.einsum("ij,ij->i", c, c)))
    c_ids, c = c_ids[order], c[order]
    c_len, q_len = np.sqrt(np.einsum("ij,ij->i", c, c)), np.sqrt(np.einsum("ij,ij->i", q, q))
    out: tuple[list, list, list] = ([], [], [])
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where((need > 0) & (q_len * c_len[0] > 0), need / (q_len * c_len[0]), np.where(need > 0, np.inf, -1.0))
    live = np.flatnonzero(cosine <= 1 + 1e-9)
    unit = c / np.maximum(c_len, 1e-300)[:, None] if (cosine[live] >= COORDINATE_FROM).any() else None
    plain = live[cosine[live] < COORDINATE_FROM]
    found = [(plain, None)] if len(plain) else []
    for i in live[cosine[live] >= COORDINATE_FROM]:
        at, u = int(np.abs(q[i]).argmax()), q[i] / q_len[i]
        room = np.sqrt(max(0.0, 1 - u[at] ** 2) * max(0.0, 1 - cosine[i] ** 2)) + 1e-9
        keep = np.flatnonzero(np.abs(unit[:, at] - u[at] * cosine[i]) <= room + abs(u[at]) * (1 - cosine[i]))
        found.append((np.array([i]), keep))
    for qs, keep in found:
        if keep is None:  # by length: rows are sorted by it
            with np.errstate(divide="ignore", invalid="ignore"):
                lengths = np.where(need[qs] > 0, need[qs] / q_len[qs], 0).min() * (1 - 1e-9)
            keep = np.arange(len(c) if lengths <= 0 else np.searchsorted(-c_len, -lengths, side="right"))
        if not len(keep):
            continue
        ids = c_ids[keep]
        for s in range(0, len(qs), 256):
            part = qs[s : s + 256]
            scores = products(q[part], c[keep])
            for row, i in enumerate(part):
                x = scores[row]
                ok = np.flatnonzero((x >= need[i]) & (ids != q_ids[i]))
                if len(ok) > 4 * k:
                    kth = np.partition(x[ok], len(ok) - k)[len(ok) - k]
                    ok = ok[x[ok] >= kth]
                ok = ok[np.lexsort((ids[ok], -x[ok]))[:k]]
                out[0].append(np.full(len(ok), q_ids[i]))
                out[1].append(ids[ok])
                out[2].append(x[ok])
    return out


def _task(k: int):
    def run(key: tuple, qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        if len(qs) and len(cs):
            width = max(qs["lv"].map(len).max(), cs["rv"].map(len).max())
            out = best(qs["lid"].to_numpy(), _matrix(qs["lv"], width), qs["need"].fillna(-np.inf).to_numpy(np.float64), cs["rid"].to_numpy(), _matrix(cs["rv"], width), k)
        return pd.DataFrame({n: np.concatenate(x) if x else np.zeros(0, np.int64) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


def _salted(rows: DataFrame, by: str, salt: str, most: int) -> DataFrame:
    """rows with ``salt``, so that (by, salt) has about ``most`` rows."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n"))
    return rows.join(sizes, by).withColumn(salt, F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / most))).drop("_n")


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0) -> DataFrame:
    """Rows where is_query (a condition on the key) holds against all rows but their own id: query_id, rank, vec_id, score; of vectors floor(scale * x)."""
    prepared(vectors.sparkSession)
    x = F.col("_vector")
    bad = F.coalesce(F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))), F.lit(True)) | F.col(key).isNull() | (F.size(x) < 1)
    whole = F.transform(x, lambda e: _floor(e, scale))
    rows = picked(vectors, **{key: key, "_vector": vector}).where(~bad).select(F.col(key).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), whole.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)
    rows = cut(rows.withColumn("norm", norm).withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log("norm") / 2 / F.log(F.lit(RATIO)))).otherwise(-1)))
    salted = cut(_salted(rows, "bucket", "salt", BLOCK))
    blocks = cut(salted.groupBy("bucket", "salt").agg(F.count("*").alias("n")))
    by_query = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def met(queries: DataFrame, tiles: DataFrame) -> DataFrame:
        """Both sides meet in one task for each of the tiles (least, part, bucket, salt): nothing moves but for these. The k best of each query."""
        left = queries.join(tiles, ["least", "part"]).select(F.struct("least", "part", "bucket", "salt").alias("lt"), F.col("id").alias("lid"), F.col("v").alias("lv"), "need")
        right = salted.join(tiles, ["bucket", "salt"]).select(F.struct("least", "part", "bucket", "salt").alias("rt"), F.col("id").alias("rid"), F.col("v").alias("rv"))
        found = left.groupBy("lt").cogroup(right.groupBy("rt")).applyInPandas(_task(k), "query_id long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)

    asking = salted.where("asks").select("id", "v", "norm")
    # the longest blocks that hold more than k rows together (k + 1 at most) give each query its first k-th score
    first, held = [], 0
    for r in blocks.orderBy(F.desc("bucket"), "salt").limit(k + 1).collect():
        if held <= k:
            first.append(F.struct(F.lit(r["bucket"]).alias("bucket"), F.lit(r["salt"]).alias("salt")))
            held += r["n"]
    everything = F.lit(-1).cast("long")
    parts = -(-asking.count() // QUERIES) or 1  # not by a join on a constant, which would be a product
    queries = asking.select("id", "v", F.lit(None).cast("double").alias("need"), everything.alias("least"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    start = F.explode(F.array(*first)) if first else F.explode(F.array().cast("array<struct<bucket:bigint,salt:bigint>>"))
    tiles = queries.select("least", "part").distinct().select("least", "part", start.alias("b")).select("least", "part", "b.bucket", "b.salt")
    kth = cut(met(queries, tiles).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("need")))
    asking = asking.join(kth, asking["id"] == kth["query_id"], "left").select("id", "v", "need", "norm")
    # no candidate shorter than need / |query| can come in; queries that need alike lengths share a part, and each part meets the blocks of its lengths
    length = F.col("need") / F.sqrt("norm") * (1 - 1e-9)
    least = F.when((F.col("need") > 0) & (F.col("norm") > 0) & (length >= 1), F.floor(F.log(length) / F.log(F.lit(RATIO)))).otherwise(everything)
    queries = cut(_salted(asking.select("id", "v", "need", least.alias("least")), "least", "part", QUERIES))
    most = blocks.agg(F.max("bucket")).first()[0]
    lengths = F.explode(F.sequence(F.col("least"), F.greatest("least", F.lit(-1 if most is None else most).cast("long"))))
    tiles = queries.select("least", "part").distinct().withColumn("bucket", lengths).join(blocks.select("bucket", "salt"), "bucket")
    return met(queries, cut(tiles)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _floor(e: Column, scale: float) -> Column:
    return F.floor(F.lit(scale) * e.cast("double")).cast("double")
