"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presences of hashed n-grams of the lower-cased text (orders 3 to 6 over code points, whole texts). Over all labelled training rows Spark counts in
how many texts of each class a feature occurs; the log ratio of the smoothed shares is the feature's scale, and a feature whose ratio is
within ``Z`` standard errors of 0 has scale 0; all others have a weight, however many they are. A logistic regression with L2 penalty is then fitted on the scaled features of a bounded sample
of the labelled rows (of each class ``FIT_ROWS`` at most, by hash of the key, and no further ones once they hold ``FIT_FEATURES`` features; both classes count alike in sum), and every text is scored by its features' sum. Orders, ``Z`` and the classes' balance
were chosen on a split of the training rows.

Cases: a null or empty text has no features and gets the score of the intercept; rows that repeat a key are scored alike; labelled rows whose label
or key is null, and texts without a label, are not learnt from; without rows of both classes every score is the share of label 1 (0 without rows);
an empty table gives an empty result; other columns are not read, whatever their names. Contradicting labels of one key count once each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._base import dense_rows, dense_sum, lean, picked, prepared, table, text_parts

ORDERS, BITS = (3, 4, 5, 6), 20
#: Bound of the fitting sample, rows of each class. All labelled rows count in the ratios.
FIT_ROWS = 3000
#: Bound of the fitting sample, features (presences) of each class, by the same order. A text has 2**BITS at most, so the task that fits holds that many more at most, however long texts are.
FIT_FEATURES = 1 << 24
#: So many labels or fewer are broadcast (under 50 MB); more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
#: Characters of texts worked on at a time; a longer text is worked on alone, in pieces of as many.
CHUNK = 1 << 18
#: Presences that the fit works on at a time.
PART = 1 << 22
Z, SMOOTHING, PENALTY, ROUNDS = 3.0, 1.0, 0.1, 12
_ODD = np.array([0x7FEB352D, 0x846CA68B, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def _hashed(low: list[str], bits: int) -> np.ndarray:
    """text number << bits | feature, distinct, ascending, of lower-cased texts."""
    size = np.fromiter(map(len, low), np.int64, len(low))
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(low), dtype=np.uint64), size)
    found = []
    for n in ORDERS:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint32)
        for k in range(n):
            h += code[k : k + len(h)] * _ODD[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
        inside = doc[: len(h)] == doc[n - 1 :]
        key = (doc[: len(h)] << np.uint64(bits)) | (h >> np.uint32(32 - bits)).astype(np.uint64)
        found.append(key[inside])
    keys = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature), distinct, ascending by text."""
    low = [f" {t.lower()} " if t else "" for t in texts]
    if len(low) == 1 and len(low[0]) > CHUNK:  # pieces that overlap, so that no n-gram is lost
        keys = np.zeros(0, np.uint64)
        for a in range(0, len(low[0]), CHUNK):
            keys = np.union1d(keys, _hashed([low[0][a : a + CHUNK + max(ORDERS) - 1]], bits))
    else:
        keys = _hashed(low, bits)
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)


def ratios(counts: np.ndarray, rows: np.ndarray, z: float = Z) -> np.ndarray:
    """Log ratio of the classes' smoothed shares by feature; 0 where it is within z standard errors of 0. counts: 2 x features, rows: texts of each class."""
    share = (counts + SMOOTHING) / (rows + 2 * SMOOTHING)[:, None]
    r = np.log(share[1] / share[0])
    error = np.sqrt(((1 - share) / (counts + SMOOTHING)).sum(axis=0))
    return np.where(np.abs(r) >= z * error, r, 0.0)


def _times(x: np.ndarray, size: int) -> np.ndarray:
    return sum((np.bincount(x[k : k + PART], minlength=size) for k in range(0, len(x), PART)), np.zeros(size, np.int64))


def by_feature(doc: np.ndarray, of: np.ndarray, n_features: int) -> np.ndarray:
    """doc in order of the features, of each feature in its own order. Sorted PART at a time, so that no index of all presences is made."""
    out = np.empty_like(doc)
    free = np.append(0, np.cumsum(_times(of, n_features)))[:-1]
    for k in range(0, len(of), PART):
        order = np.argsort(of[k : k + PART], kind="stable")
        own, times = of[k : k + PART][order], np.bincount(of[k : k + PART], minlength=n_features)
        out[np.arange(len(own)) + (free - np.cumsum(times) + times)[own]] = doc[k : k + PART][order]
        free += times
    return out


def _sums(value: np.ndarray, at: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of value[at] over runs of so many each, of PART or so at a time."""
    out, some = np.zeros(len(times)), np.flatnonzero(times)
    ends = np.cumsum(times[some])
    a = 0
    while a < len(some):
        start = ends[a] - times[some[a]]
        b = max(a + 1, int(np.searchsorted(ends, start + PART, side="right")))
        own = ends[a:b] - times[some[a:b]] - start
        out[some[a:b]] = np.add.reduceat(value.take(at[start : ends[b - 1]]), own)
        a = b
    return out


def fit(doc: np.ndarray, of: np.ndarray, scale: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty on the weights, by Newton steps whose systems conjugate gradients solve in part. Text doc[i] (ascending) has the feature of[i],
    whose value is scale[of[i]]; a text counts mass times; no array but these two is as long, as sums go over PART presences at a time."""
    n, n_features = len(y), len(scale)
    in_text, in_texts = _times(doc, n), _times(of, n_features)
    doc = by_feature(doc, of, n_features)

    def across(w: np.ndarray) -> np.ndarray:
        return _sums(w[:-1] * scale, of, in_text) + w[-1]

    def along(d: np.ndarray) -> np.ndarray:
        return np.append(_sums(d, doc, in_texts) * scale, d.sum())

    ridge = np.append(np.full(n_features, PENALTY), 1e-6)

    def loss(w: np.ndarray) -> float:
        return float((mass * np.logaddexp(0, across(w) * (1 - 2 * y))).sum() + (ridge * w * w).sum() / 2)

    w = np.append(np.zeros(n_features), np.log(((mass * y).sum() + 0.5) / ((mass * (1 - y)).sum() + 0.5)))
    now = loss(w)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(across(w), -35, 35)))
        grad, bend = along(mass * (p - y)) + ridge * w, mass * p * (1 - p)
        step, rest = np.zeros_like(w), -grad
        way, square = rest.copy(), float(rest @ rest)
        first = square
        for _ in range(20):
            if square <= 1e-4 * first:
                break
            turned = along(bend * (across(way))) + ridge * way
            size = square / float(way @ turned)
            step += size * way
            rest -= size * turned
            square, was = float(rest @ rest), square
            way = rest + square / was * way
        size = 1.0
        while size > 1e-3 and (then := loss(w + size * step)) > now:
            size /= 2
        if size <= 1e-3 or now - then < 1e-4 * now:
            break
        w, now = w + size * step, then
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Weight of each feature (its ratio included), and the intercept."""

    weights: np.ndarray
    intercept: float


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        y = np.array(batch.column("y").to_pylist(), np.int64)
        for a, b, texts in text_parts(batch.column("text"), CHUNK):
            doc, of = features(texts)
            for c in (0, 1):
                total[c] += np.bincount(of[y[a:b][doc] == c], minlength=1 << BITS)
                rows[c, 0] += int((y[a:b] == c).sum())
    yield from dense_rows(np.concatenate([total.ravel(), rows[:, 0]]))


def _sampled(kept: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_parts(batch.column("text"), CHUNK):
                doc, of = features(texts)
                at = kept[of]
                doc, at = doc[at >= 0], at[at >= 0].astype("<i4")
                cuts = np.searchsorted(doc, np.arange(b - a + 1)).tolist()
                own = [at[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                sizes = pa.array([len(x) // 4 for x in own], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(a, b - a), batch.column("y").slice(a, b - a), sizes, pa.array(own, pa.binary())], ["h", "y", "n", "at"])

    return run


def _fitting(scale: np.ndarray):
    """The fit over a sample's rows, in the one task that has them all, so that none of them goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sizes, y = [], [], []
        for batch in batches:
            for x in batch.column("at"):
                of.append(np.frombuffer(x.as_py(), "<i4"))
                sizes.append(len(of[-1]))
            y += batch.column("y").to_pylist()
        if not y:
            return
        doc, y = np.repeat(np.arange(len(y), dtype=np.int32), sizes), np.array(y, np.float64)
        mass = np.where(y == 1, (len(y) - y.sum()) / max(1.0, y.sum()), 1.0)
        w, b = fit(doc, np.concatenate(of), scale, y, mass)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], pa.binary()), pa.array([b])], ["weights", "intercept"])

    return run


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", training: Column | None = None, fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES) -> Model:
    """Learn from the labelled rows for which training (a condition on the key) holds."""
    spark = prepared(docs.sparkSession)
    rows = picked(labels, **{key: key, "_label": label})
    rows = (rows.where(training) if training is not None else rows).toDF("k", "y").where(F.col("y").isin(0, 1) & F.col("k").isNotNull()).select("k", F.col("y").cast("int"), F.xxhash64(F.lit(6), F.col("k")).alias("h"))
    plain = picked(docs, k=key, text=text)
    small = rows.count() <= BROADCAST_LABELS
    known = plain.join(F.broadcast(rows) if small else rows, "k")
    size = 2 << BITS
    counted = dense_sum(known.select("text", "y").mapInArrow(lean(_counting), "slice int, pid int, counts binary"), size + 2)
    counts, n = counted[:size].reshape(2, -1), counted[size:]
    if not n.all():
        return Model(np.zeros(1 << BITS, np.float32), float(np.clip(np.log(n[1] / n[0]) if n[0] and n[1] else (35 if n[1] else -35), -35, 35)))
    r = ratios(counts, n)
    chosen = np.flatnonzero(r)
    kept = np.full(1 << BITS, -1, np.int32)
    kept[chosen] = np.arange(len(chosen))
    sample = rows.where("y = 0").orderBy("h").limit(fit_rows).union(rows.where("y = 1").orderBy("h").limit(fit_rows))
    sample = plain.join(F.broadcast(sample), "k").select("text", "y", "h")  # 2 * fit_rows labels at most
    scale = r[chosen]
    del counted, counts, r
    found = table(sample.mapInArrow(lean(_sampled(kept)), "h long, y int, n long, at binary"))
    before = F.sum("n").over(W.partitionBy("y").orderBy("h").rangeBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")  # over fit_rows rows and the texts of their keys
    last = {r["y"]: r["h"] for r in found.select("h", "y", "n").withColumn("before", before).where(F.col("before") < fit_features).groupBy("y").agg(F.max("h").alias("h")).collect()}
    chosen_rows = F.lit(False)
    for c, h in last.items():
        chosen_rows = chosen_rows | ((F.col("y") == c) & (F.col("h") <= h))
    dealt = found.where(chosen_rows).select("h", "y", "at").repartition(1).sortWithinPartitions("h", "y")
    told = dealt.mapInArrow(lean(_fitting(scale)), "weights binary, intercept double").collect()
    weights, b = np.zeros(1 << BITS, np.float32), 0.0
    for row in told:  # one; none where no sampled label has a text
        weights[chosen], b = np.frombuffer(bytes(row["weights"]), "<f8") * scale, row["intercept"]
    return Model(weights, b)


def _scoring(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for a, b, texts in text_parts(batch.column(at), CHUNK):
                doc, of = features(texts)
                sums = np.bincount(doc, model.weights[of].astype(np.float64), minlength=b - a) + model.intercept
                out.append(1 / (1 + np.exp(-np.clip(sums, -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, "score"])

    return run


def _scored(docs: DataFrame, model: Model, columns: list[str], text: str) -> DataFrame:
    """The columns as c0, c1, ..., whatever their names, then the text where it is none of them, and score."""
    names = docs.columns
    wanted = [names.index(c) for c in columns]
    at = names.index(text)
    wanted += [] if at in wanted else [at]
    rows = docs.toDF(*(f"n{i}" for i in range(len(names)))).select(*(F.col(f"n{i}").alias(f"c{k}") for k, i in enumerate(wanted)))
    return rows.mapInArrow(lean(_scoring(model, wanted.index(at))), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def scored(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """columns of docs, and ``_score`` from 0 to 1."""
    out = _scored(docs, model, columns, text)
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)), F.col("score").alias("_score"))


def clean(docs: DataFrame, model: Model, text: str = "text", toxic: float = 0.7) -> DataFrame:
    """docs without the rows whose text scores at least ``toxic``."""
    names = docs.columns
    return _scored(docs, model, names, text).where(F.col("score") < toxic).drop("score").toDF(*names)
