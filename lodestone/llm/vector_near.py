"""Near-duplicate vectors by int8 tile products with per-vector error bounds.

Vectors of one label are compared with each other. Equal vectors are one class, with a count. Classes are dealt into blocks
of bounded size within their label, and each pair of blocks is one task: unit vectors are quantised to int8 with their own scale, tile
products give the cosine up to ``|q_u| e_v + e_u``, where ``e`` is the length of what quantisation left out, and only pairs that may
reach the threshold are recomputed in double precision. A task returns link counts and a spanning star of its links, not its pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing;
equal vectors link with each other; rows that share an id are one node when components are formed; a null id gets a
null component and is not kept; an empty table gives an empty result. Vectors of different lengths never link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._base import components, cut, picked, prepared

#: Most classes in a block; a task holds two blocks.
BLOCK = 2048


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows to int8 rows, their scales, the lengths of scale * int8, and bounds on the lengths of what is left out."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    err = np.linalg.norm(unit - q * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), scale, np.linalg.norm(q, axis=1) * scale, err


def linked(left: np.ndarray, right: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with cosine >= least in double precision; i < j where left and right are the same block."""
    left, right = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) for v in (left, right))  # so that no square leaves the range of doubles
    norm_l, norm_r = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    ql, sl, nl, el = quantised(left / norm_l[:, None])
    qr, sr, _, er = quantised(right / norm_r[:, None])
    # float32 holds these integer sums exactly as long as 127 * 127 * length < 2**24
    kind = np.float32 if ql.shape[1] < 1040 else np.float64
    about = (ql.astype(kind) @ qr.astype(kind).T).astype(np.float64)
    about *= sl[:, None]
    about *= sr[None, :]
    about += nl[:, None] * er[None, :]
    about += el[:, None] + 1e-9
    i, j = np.nonzero(about >= least)
    if same:
        i, j = i[i < j], j[i < j]
    ok = [np.zeros(0, bool)]
    for k in range(0, len(i), 1 << 16):
        a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        ok.append(np.einsum("ij,ij->i", left[a], right[b]) / (norm_l[a] * norm_r[b]) >= least)
    ok = np.concatenate(ok)
    return i[ok], j[ok]


def _tile(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"rep": [], "links": [], "to": []}
        same = pdf["lo"].iat[0] == pdf["hi"].iat[0]
        for _, part in pdf.groupby(pdf["vector"].map(len)):
            a = part if same else part[part["own"] == part["lo"]]
            b = part if same else part[part["own"] == part["hi"]]
            if not len(a) or not len(b):
                continue
            va, vb = (np.array(x["vector"].tolist(), dtype=np.float64) for x in (a, b))
            ra, rb, na, nb = a["rep"].to_numpy(), b["rep"].to_numpy(), a["copies"].to_numpy(), b["copies"].to_numpy()
            i, j = linked(va, vb, least, same)
            if not len(i):
                continue
            reps = np.unique(np.concatenate([ra[i], rb[j]]))
            x, y = np.searchsorted(reps, ra[i]), np.searchsorted(reps, rb[j])
            links = np.zeros(len(reps), np.int64)
            np.add.at(links, x, nb[j])
            np.add.at(links, y, na[i])
            root = np.arange(len(reps))
            while True:  # the smallest index reachable
                was = root.copy()
                np.minimum.at(root, x, root[y])
                np.minimum.at(root, y, root[x])
                root = root[root]
                if (was == root).all():
                    break
            out["rep"].append(reps)
            out["links"].append(links)
            out["to"].append(reps[root])
        return pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()})

    return run


def near(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, block: int = BLOCK) -> DataFrame:
    """One row a vector: key, n_links, component_id, kept."""
    prepared(vectors.sparkSession)
    vectors = picked(vectors, vec=key, label=label, raw=vector)
    size = F.col("raw")
    bad = F.coalesce(F.exists(size, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(True)) | F.coalesce(F.forall(size, lambda x: x == 0), F.lit(True))
    plain = F.transform(size, lambda x: x.cast("double") + F.lit(0.0))  # makes -0.0 and 0.0 one value
    rows = vectors.select("vec", "label", F.when(~bad & F.col("label").isNotNull() & F.col("vec").isNotNull(), plain).alias("vector"))
    rows = cut(rows.withColumn("hash", F.when(F.col("vector").isNotNull(), F.sha2(F.concat(F.concat_ws(",", F.col("vector").cast("array<string>")), F.lit("|"), F.col("label").cast("string")), 256))))
    good = rows.where("vector is not null")
    classes = cut(good.groupBy("hash").agg(F.min("vec").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    blocks = classes.groupBy("label").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = classes.join(blocks, "label").withColumn("own", F.pmod(F.xxhash64("hash"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("label", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "copies", "vector")
    found = cut(dealt.groupBy("label", "lo", "hi").applyInPandas(_tile(least), "rep long, links long, to long"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    counted = cut(classes.select("hash", "rep", "copies").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left"))
    counted = counted.select(F.col("hash").alias("of"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(counted, rows["hash"] == counted["of"], "left")
    component = F.coalesce("component", "vec")
    return out.select(F.col("vec").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec"), F.lit(False)).alias("kept"))
