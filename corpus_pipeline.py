"""A training-data pipeline over documents: each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, packing, pii, text_near, toxicity
from lodestone.llm._base import prepared, shared_dir
from lodestone.llm.queries import held_out
from lodestone.session import read

#: Documents that score at least this go.
TOXIC = 0.7
#: The last stage hashes ids and iterates to a fit; SQL does not express it.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents at hand (but the held-out third) and drop the toxic ones."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), training=~held_out())
    return toxicity.clean(docs, model, toxic=TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts stays: the one with the smallest id."""
    return text_near.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets; n_chars follows."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids in their sequences."""
    pieces = packing.packed(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    prepared(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
