"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm.common import table
from scoreloom.llm import line_dedup, minhash, ngram_join, periodic_runs, topk
from scoreloom.llm.fingerprints import fingerprint_documents
from scoreloom.llm.html_extract import extract_pages
from scoreloom.llm.license_scan import scan_licenses
from scoreloom.llm.mixing import mix_sources
from scoreloom.llm.packing import pack_documents
from scoreloom.llm.secret_scan import scan_secrets
from scoreloom.llm.toxicity import score_toxicity
from scoreloom.llm.whitening import whiten_vectors


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search_topk(vectors, vectors.where("vec_id % 100 = 0"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file; every machine has it in the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.selectExpr("doc_id", "n_lines", "n_removed", "coalesce(text, '') as text")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.selectExpr("doc_id", "source", "mix_block", "mix_slot", "char_length(coalesce(text, '')) as n_chars")


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup_minhash(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.detect_runs(table(spark, sf_dir, "documents"), rewrite=periodic_runs.planted)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_html_extract": op2_html_extract,
        "op3_toxicity": op3_toxicity,
        "op4_exact_topk": op4_exact_topk,
        "op5_ngram_join": op5_ngram_join,
        "op6_secret_scan": op6_secret_scan,
        "op7_packing": op7_packing,
        "op8_line_dedup": op8_line_dedup,
        "op9_fingerprints": op9_fingerprints,
        "op10_mixing": op10_mixing,
        "op11_minhash_dedup": op11_minhash_dedup,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_topk": topk.ORACLE_SQL,
        "op5_ngram_join": ngram_join.ORACLE_SQL,
        "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op11_minhash_dedup": minhash.ORACLE_SQL,
        "op12_periodic_runs": periodic_runs.ORACLE_SQL,
    }
