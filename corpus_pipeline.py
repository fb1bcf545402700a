"""Documents to token ids in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwell.llm import classifier, secrets, simhash, templates
from clearwell.llm.byte_bpe import encode
from clearwell.llm.components import without, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled rows that op1 learns from, as far as they are in ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.accepted(docs, classifier.fit(docs, labels, usable=classifier.fold(3) != 1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates. Rows that share an id are one document; rows without one stay."""
    return without(docs, simhash.near_duplicates(docs).where(F.col("doc_id") != F.col("component_id")), "repeated")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or with its slots exchanged. Rows that share an id are judged by their own texts."""
    return templates.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shortest=1)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and ``n_chars`` counted anew."""
    return secrets.masked(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


#: Pieces in a worker's cache of the last stage. Workers live on through the other stages, beside an executor's heap that these have filled.
CACHED_PIECES = 100_000


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids``, ``n_tokens`` and whether decoding gave the text back."""
    coded = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, room=CACHED_PIECES)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("byte-level BPE", tokens),
]
#: Learned scores, 64-bit XXH64 fingerprints and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
