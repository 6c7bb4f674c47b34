"""One registered query per operator of this subpackage, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from turnwise.config import ship_package
from turnwise.llm import oracles
from turnwise.llm.conversations import conversation_digests, damaged
from turnwise.llm.decontaminate import find_contaminated
from turnwise.llm.filter_audit import audit_filters
from turnwise.llm.language import fit_language, identify_language
from turnwise.llm.licenses import scan_licenses
from turnwise.llm.mixing import mix_sources
from turnwise.llm.pii import pseudonymise
from turnwise.llm.quality import score_quality
from turnwise.llm.secrets import find_secrets
from turnwise.llm.simhash import simhash_groups
from turnwise.llm.tokens import count_tokens
from turnwise.llm.toxicity import fit_toxicity, score_toxicity
from turnwise.llm.urls import judge_urls

# The key of the registered query only; a deployment passes its own secret.
PII_KEY = oracles.PII_KEY
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(oracles.LICENSES)
def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


@_query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document by the byte-level tokenizer with 50,257 ids."""
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model trained on the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


@_query()
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document over four-word shingles, and groups linked at four bits or fewer."""
    return simhash_groups(_table(spark, sf_dir, "documents"))


@_query(oracles.PERSONAL_DATA)
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms of the same format."""
    return pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY)


@_query(oracles.QUALITY)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ratios and verdict of every document."""
    return score_quality(_table(spark, sf_dir, "documents"))


@_query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model of the documents that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return identify_language(docs, fit_language(docs))


@_query(oracles.CONTAMINATION)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, as they are or with other values."""
    found = find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


@_query()
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in an order mixed by the square roots of the source sizes."""
    return mix_sources(_table(spark, sf_dir, "documents"))


@_query(oracles.SECRETS)
def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of every document, by one automaton for all rules."""
    return find_secrets(_table(spark, sf_dir, "documents"))


@_query(oracles.CONVERSATIONS)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with every conversation, with faults planted by a hash, and its cheapest repair."""
    rows = _table(spark, sf_dir, "conversations")
    return conversation_digests(damaged(rows), rows)


@_query(oracles.FILTER_AUDIT)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from the documents of each language, in every order."""
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query(oracles.URLS)
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    return judge_urls(_table(spark, sf_dir, "pages"))


@_query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of the corpus pipeline, one after the other."""
    return corpus_pipeline.run(spark, sf_dir)
