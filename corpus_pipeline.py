"""From raw documents to packed training batches.

Each stage takes the documents that the one before kept and returns documents, the last one
where each of them is packed.

1. Documents that the quality classifier rejects go.
2. Of documents that are nearly the same, the one with the least id stays.
3. Secrets, and parts of credentials that occur together, are masked in the texts.
4. Sources are mixed to their target weights: documents of some repeat, of others some go.
5. The result is packed into length buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payflux.llm import jaccard, mixing, packing, quality, secrets
from payflux.llm.common import materialised

#: A network that learns from labels can't be written in SQL.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, keep=["doc_id"])


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("secret scan", without_secrets),
    ("mixing", mix),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents; what each stage returns is checkpointed before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, materialised(docs) if k else docs, sf_dir)
    return docs
