"""A corpus in five stages: reject poor documents, cut repeated lines, keep one of near copies, drop leaks, encode.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_lexicon, chosen_path, line_dedup, quality_qda, spaced_seeds
from tidemark.llm.support import stage, table

#: Share of its characters that a document must keep when repeated lines are cut.
LEAST_KEPT = 0.2


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the cut go."""
    return quality_qda.keep_good(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, the same or within two edits, are cut; so are documents with little else.

    What is left of a near copy once its equal lines are gone resembles nothing, so it goes here: a document
    that keeps less than a fifth of its characters is a copy of earlier text.
    """
    return line_dedup.dedup_lines(docs, least_kept=LEAST_KEPT)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies stays."""
    return chosen_path.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return spaced_seeds.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left, with the digests of the ids and of the text decoded from them."""
    return bpe_lexicon.encode(docs, bpe_lexicon.tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", token_ids),
]

#: A trained classifier, edit distances and BPE merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
