"""The registered queries of this subpackage: name to (query, check SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    jaccard_join,
    licence_scan,
    lm_scoring,
    merkle_manifest,
    packing,
    quality_model,
    quality_rules,
    secret_scan,
    spelling_variants,
    token_counts,
    token_files,
    url_filter,
)
from .check_sql import JACCARD_SQL, MERKLE_SQL, QUALITY_RULES_SQL, SPELLING_SQL, url_filter_sql
from .common import read_table, scratch_path
from .encoding import tokenizer_path

URL_RULES = "allow com/, block example.com/en/, allow www.example.com/en/, block net/es/, block net/fr/"


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.classify(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op4_licence_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licence_scan.scan_licences(read_table(spark, folder, "documents"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(read_table(spark, folder, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_files.with_checksum(token_files.read_tokens(spark, path))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.near_duplicates(read_table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    host, _ = url_filter.url_parts(F.col("url"))
    outcomes = pages.select(host.alias("host"), url_filter.html_outcome(F.col("html")).alias("good"))
    return url_filter.judge_urls(pages, outcomes, url_filter.parse_rules(URL_RULES))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.apply_rules(read_table(spark, folder, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "n_stop_words", "n_lines")


def op10_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    findings, _ = secret_scan.scan(read_table(spark, folder, "documents"))
    return findings


def op11_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.lm_scores(read_table(spark, folder, "documents"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.spelling_variants(read_table(spark, folder, "documents"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest.manifest(read_table(spark, folder, "documents"))


LLM_QUERIES = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_quality_classifier": (op2_quality_classifier, None),
    "op3_decontamination": (op3_decontamination, None),
    "op4_licence_scans": (op4_licence_scans, None),
    "op5_token_files": (op5_token_files, None),
    "op6_jaccard_join": (op6_jaccard_join, JACCARD_SQL),
    "op7_url_filter": (op7_url_filter, url_filter_sql(URL_RULES)),
    "op8_best_fit_packing": (op8_best_fit_packing, None),
    "op9_quality_rules": (op9_quality_rules, QUALITY_RULES_SQL),
    "op10_secret_scans": (op10_secret_scans, None),
    "op11_lm_scoring": (op11_lm_scoring, None),
    "op12_spelling_variants": (op12_spelling_variants, SPELLING_SQL),
    "op13_merkle_manifest": (op13_merkle_manifest, MERKLE_SQL),
}
