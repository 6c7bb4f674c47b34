"""A training corpus from raw documents, in five stages.

Toxic documents go, of each group of near copies by SimHash one stays, documents that hold benchmark items go,
secrets are blacked out, and what is left is put in an order that follows the target weights of its
sources. Each stage gets what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnwise.config import ship_package, work_folder
from turnwise.llm.decontaminate import drop_contaminated
from turnwise.llm.mixing import mix_sources
from turnwise.llm.secrets import redact_secrets
from turnwise.llm.simhash import drop_near_copies
from turnwise.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones, does not call toxic."""
    ship_package(spark)
    return drop_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash (four-word shingles, four bits): that with the smallest doc_id."""
    ship_package(spark)
    return drop_near_copies(docs, n_words=4, radius=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by the name of their kind."""
    ship_package(spark)
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in the mixed order; weights are the square roots of the source sizes."""
    ship_package(spark)
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
]
# The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``; a row (doc_id and its place) per document that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = work_folder(spark, f"pipeline-{name}")
        result = stage(spark, docs, sf_dir)
        result.write.parquet(folder)
        docs = spark.read.schema(result.schema).parquet(folder)
    return docs
