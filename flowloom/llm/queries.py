"""Registered queries of the subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import (
    collocations,
    exact_topk,
    fingerprints,
    lexical_search,
    ngram_rules,
    packing,
    piece_dropout,
    resampling,
    secret_scan,
    token_counts,
    token_store,
    url_rules,
    vp_dedup,
)
from flowloom.llm.inputs import table
from flowloom.llm.tokens import vocabulary
from flowloom.session import scratch_folder

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[run.__name__] = run
    return run


@query
def op1_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piece_dropout.encode(docs, vocabulary("piece_bpe_32k.model"), rate=0.1, seed=1)


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


@query
def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=2)


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the quality rules that SQL can express."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@query
def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the secret scan that SQL can express."""
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


@query
def url_fixed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the URL rules that SQL can express; the verdict where a fixed rule gives it."""
    judged = op10_url_rules(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("fixed"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return resampling.score(docs, resampling.fit(docs, table(spark, sf_dir, "labels"))).drop("trusted")


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"), every=50, radius=3)


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), folder, end_id=2)
    return token_store.read_store(spark, folder)


@query
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


@query
def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, factor=256)


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"), k=10)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), least=30, covered=80, first=2000)
