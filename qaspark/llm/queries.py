"""The queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qaspark.llm import byte_bpe, exact_dedup, langid, line_dedup, ngram_join, packing, phrases, pii, quality, token_files, toxicity, vector_codes, warc
from qaspark.llm.common import documents


#: A key for these queries; who publishes texts passes a secret one to the operator.
PII_KEY = "key of the registered query"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; see the README for other places."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(documents(spark, sf_dir), with_text=False)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(spark, documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip_digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digests(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_hilbert_packing, op2_line_dedup, op3_exact_dedup, op4_toxicity, op5_pii, op6_language, op7_line_quality, op8_ngram_join,
           op9_token_files, op10_byte_bpe, op11_warc, op12_vector_codes, op13_phrases]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.ORACLE, "op7_line_quality": quality.ORACLE, "op11_warc": warc.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_phrases": phrases.ORACLE}
