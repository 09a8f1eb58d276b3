"""The corpus pipeline: five operators one after the other, from raw documents to tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return
the columns of ``docs``; the last returns the tokens of every document that is left. ``run`` writes each stage's
rows as Parquet in the shared folder and reads them again, so a lost executor costs one stage at most; what a stage
wrote on its way is removed then.

Rows with null or empty texts go through every stage as the operators define; a quality score of a text without
words is the model's bias.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import bpe, common, decontaminate, line_dedup, ngram_join, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that a classifier trained on the labelled ones doesn't reject."""
    return quality.keep_good(docs, docs, common.table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated chunks of lines; documents of which nothing is left go."""
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five words, a similarity of 0.8 and more."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of the benchmark, and documents that mostly consist of them."""
    return decontaminate.remove_spans(docs, common.table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, and digests of them and of the text that they decode to."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: No stage but the fourth can be said in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.written_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark)
    return docs
