"""Corpus pipeline over `documents`: drop toxic documents, remove repeated lines, keep one of each near-duplicate class, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are all that the next stage sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import line_dedup, ngram_join, packing, toxicity
from framewright.llm.common import cut, table
from framewright.llm.queries import WORD_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network accepts; it learns from the labels of these documents.

    A null or empty text is scored like any other (and accepted); rows with a null or repeated id are judged row by row."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text, and a document left without any text goes.

    Of equal or near lines the earliest by document and place stays; a null or empty text has no lines to lose and stays."""
    done = line_dedup.dedup(docs).where("n_removed IS NULL OR n_removed = 0 OR trim(text) <> ''")
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, Jaccard 0.8).

    Texts without a word share a class, null ones too; whatever ties, one row of a class stays."""
    return ngram_join.keep_one(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a null text is its end id alone."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [("toxicity", clean), ("line_dedup", lines), ("ngram_join", distinct), ("packing", packed)]

#: The network of the first stage has no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
