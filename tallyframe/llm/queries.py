"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.centroid_clustering import centroid_clustering
from tallyframe.llm.common import read_table
from tallyframe.llm.decontaminate import benchmark_leaks
from tallyframe.llm.embedding_neardup import embedding_neardup
from tallyframe.llm.html_extraction import extract_main_text
from tallyframe.llm.licenses import license_scan
from tallyframe.llm.line_dedup import line_dedup
from tallyframe.llm.ngram_join import ngram_jaccard_join
from tallyframe.llm.oracle import SQL
from tallyframe.llm.packing import best_fit_packing
from tallyframe.llm.quality import quality_scores
from tallyframe.llm.substring_dedup import substring_dedup
from tallyframe.llm.suffix_dedup import suffix_dedup
from tallyframe.llm.token_alignment import align_tokenizers
from tallyframe.llm.toxicity import toxicity_scores

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read_table(spark, sf_dir, "documents"))


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup(read_table(spark, sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(read_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_dropped")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"), texts=False)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering(read_table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"), texts=False)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(read_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (
        op1_ngram_jaccard_join, op2_embedding_neardup, op3_quality_classifier, op4_best_fit_packing, op5_html_extraction,
        op6_toxicity, op7_benchmark_decontamination, op8_line_dedup, op9_license_scan, op10_substring_dedup,
        op11_centroid_clustering, op12_suffix_dedup, op13_token_alignment,
    )
    return {op.__name__: op for op in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
