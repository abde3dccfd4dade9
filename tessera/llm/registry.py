"""The thin opN queries over the driver tables and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    extract,
    fmindex,
    icws,
    lexicon,
    licenses,
    lzdedup,
    quality,
    rankbpe,
    ranked,
    secrets,
    sharding,
    tokenfile,
    variants,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op3_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.digests(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_icws_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icws.query(documents(spark, sf_dir))


def op6_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op7_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.query(spark, documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op8_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzdedup.digests(documents(spark, sf_dir))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(documents(spark, sf_dir))


def op11_reduced_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.query(documents(spark, sf_dir))


def op12_padded_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankbpe.digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op13_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_bpe_lexicon": op2_bpe_lexicon,
        "op3_fm_index": op3_fm_index,
        "op4_license_scan": op4_license_scan,
        "op5_icws_near_dedup": op5_icws_near_dedup,
        "op6_text_density": op6_text_density,
        "op7_huffman_tokens": op7_huffman_tokens,
        "op8_relative_lz": op8_relative_lz,
        "op9_two_pass_shuffle": sharding.query,
        "op10_secret_forest": op10_secret_forest,
        "op11_reduced_alphabet": op11_reduced_alphabet,
        "op12_padded_matrix": op12_padded_matrix,
        "op13_aho_corasick": op13_aho_corasick,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.ORACLE, "op3_fm_index": fmindex.ORACLE,
            "op4_license_scan": licenses.ORACLE, "op8_relative_lz": lzdedup.ORACLE,
            "op11_reduced_alphabet": variants.ORACLE, "op13_aho_corasick": ranked.ORACLE}
