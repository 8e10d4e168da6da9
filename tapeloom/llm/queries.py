"""The registered queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_pipeline import ORACLE_SQL, run
from tapeloom.llm.common import documents, fold
from tapeloom.llm.fingerprints import fingerprint_documents
from tapeloom.llm.jaccard_join import jaccard_join
from tapeloom.llm.language_id import languages
from tapeloom.llm.lm_scoring import score_documents
from tapeloom.llm.merkle import merkle_manifest
from tapeloom.llm.mixing import mix_sources
from tapeloom.llm.oracle import MIXING_SQL, QUALITY_SQL, RESAMPLING_SQL, merkle_sql, url_trust_sql
from tapeloom.llm.packing import pack_documents
from tapeloom.llm.quality_classifier import score_quality
from tapeloom.llm.quality_rules import judge_quality
from tapeloom.llm.resampling import resample
from tapeloom.llm.simhash import simhash_components
from tapeloom.llm.token_counts import count_tokens
from tapeloom.llm.url_trust import UrlRule, judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(documents(spark, folder), tokenizer("byte_bpe_50k.json"), limit=512)


@query
def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(documents(spark, folder)).select("doc_id", "source", "size", "source_size", "target", "taken")


ORACLES["op5_source_mixing"] = MIXING_SQL

URL_RULES = [
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
]


@query
def op10_url_trust(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{folder}/pages.parquet"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op10_url_trust"] = url_trust_sql(URL_RULES)


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(documents(spark, folder))


ORACLES["op7_quality_rules"] = QUALITY_SQL


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages(documents(spark, folder), fold(F.col("doc_id"), 3, 1))


@query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder), tokenizer("word_bpe_49k.json"), capacity=2048, end=0)


@query
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_documents(documents(spark, folder))


@query
def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(documents(spark, folder), fold(F.col("doc_id"), 7, 2))


@query
def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(documents(spark, folder), width=4, percent=85)


@query
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return score_quality(documents(spark, folder), labels, fold(F.col("doc_id"), 4, 2), threshold=0.7)


@query
def op11_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_components(documents(spark, folder), width=4, most=4)


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest(documents(spark, folder))


ORACLES["op12_merkle_manifest"] = merkle_sql()


@query
def op13_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


ORACLES["op13_target_resampling"] = RESAMPLING_SQL

QUERIES["pipeline"] = run
if ORACLE_SQL:
    ORACLES["pipeline"] = ORACLE_SQL
