"""From raw documents to packed training sequences, in five stages.

Each stage works on everything its predecessor kept, written as Parquet and read again.

Cases: a null text is an empty one, and the rules reject it; rows of one id are told apart by their texts, and rows that
repeat an id and its text stay or go together; a null id comes last where the smallest id of a group decides;
of equal keys of the classifier all stay; an empty table gives an empty result; extra columns pass the first four stages
and are not part of the last one's result, and names such as ``key`` or ``kept`` do not clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import ngram_rules, packing, resampling, secret_scan, vp_dedup
from flowloom.llm.inputs import bound_batches, table, written
from flowloom.llm.tokens import vocabulary
from flowloom.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling."""
    bound_batches(spark)
    return resampling.select(docs, resampling.fit(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio."""
    return ngram_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are similar by 0.8 or more."""
    ship_package(spark)
    bound_batches(spark)
    return vp_dedup.keep_one(docs, size=5, similarity=0.8)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` set anew where the text has changed."""
    bound_batches(spark)
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 ids."""
    ship_package(spark)
    bound_batches(spark)
    packed = packing.pack(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2, keep_memo=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

# Models and packing are not expressible in SQL; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
