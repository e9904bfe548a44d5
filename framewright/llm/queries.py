"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framewright.llm import byte_bpe, centroids, fingerprints, html_tree, importance, licenses, line_dedup, ngram_join, packing, quality, telephony, toxicity, url_filters
from framewright.llm.common import table

#: Vocabulary files are parameters; these are the ones the queries use.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op5_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.digests(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_html_tree": op5_html_tree,
    "op6_ngram_join": op6_ngram_join,
    "op7_url_filters": op7_url_filters,
    "op8_telephony": op8_telephony,
    "op9_line_dedup": op9_line_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_quality": op11_quality,
    "op12_sort_means": op12_sort_means,
    "op13_importance": op13_importance,
}
SQL: dict[str, str] = {
    "op1_licenses": licenses.sql(),
    "op6_ngram_join": ngram_join.sql(),
    "op7_url_filters": url_filters.sql(),
    "op9_line_dedup": line_dedup.sql(),
    "op11_quality": quality.sql(),
    "op12_sort_means": centroids.sql(),
    "op13_importance": importance.sql(),
}
