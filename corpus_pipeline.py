"""The corpus pipeline: quality rules, quality classifier, near duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and rereads it as the next stage's docs. All stages but the last return the columns
of ``documents``; packing returns a row per piece of a document with its place in a sequence.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import fold, fresh, staged
from tapeloom.llm.jaccard_join import jaccard_join
from tapeloom.llm.mixing import mix_sources
from tapeloom.llm.packing import pack_documents
from tapeloom.llm.quality_classifier import keep_predicted
from tapeloom.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. A null or empty text goes, whatever its id; repeated rows fare alike;
    an empty table stays empty; other columns pass through."""
    return keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.7 or more; it learns from their labels. A null text is scored as an
    empty one, a row without an id by its text; repeated rows fare alike; without labels a constant decides; an
    empty table stays empty; other columns pass through."""
    return keep_predicted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 4, 2), threshold=0.7)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one row: that with the smallest doc_id, rows
    without one last. Rows are told apart by all their columns, not by doc_id alone: rows that share an id and differ in
    text both stay, of rows equal in every column one does. A row without words is near no other."""
    # the id raised to a number without a sign, then what tells rows of equal ids apart
    number = (F.col("doc_id").cast("decimal(20,0)") + F.lit(Decimal(1 << 63))).cast("string")
    key = F.concat(F.coalesce(F.lpad(number, 20, "0"), F.lit("~")), F.lit(":"), F.hex(F.xxhash64(*docs.columns)))
    groups = jaccard_join(docs.select(key.alias("doc_id"), "text"), width=5, percent=80)
    row = fresh(docs, "jaccard_row")
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(row)).distinct()
    return docs.withColumn(row, key).join(first, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (a row per copy; none if it takes none). Rows that
    share an id, null included, take as many copies as the one with most. A text without words is never taken;
    an empty table stays empty; other columns pass through."""
    own, times = fresh(docs, "mixed_id"), fresh(docs, "mixed_copies")
    mixed = mix_sources(docs).filter("taken > 0").groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").cast("int").alias(times))
    taken = docs.join(mixed, docs["doc_id"].eqNullSafe(mixed[own]))
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(fresh(docs, "mixed_copy"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix packed into sequences of 2048 tokens: a row per piece. A null text is empty and holds the end token
    alone, a null id stays null, repeated rows are packed as often as they occur, an empty table gives no piece and
    other columns are left out."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("jaccard_dedup", jaccard_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier's training nor the packing; tests/llm compares the stages with
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
