"""A corpus pipeline: five operators in a row over ``documents``, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerolith.llm import exact_dedup, mixing, ngram_join, piece_sampling, toxicity
from aerolith.llm.common import written
from aerolith.llm.queries import table, tokenizer_file


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the severity model rejects. The model is fitted on labelled rows of the same documents.

    Null and empty texts stay, rows that repeat stay or go together, and no documents give none.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the one with the largest doc_id.

    Null counts as the empty text. Of rows that tie one stays, always the same. No documents give none.
    """
    return exact_dedup.deduplicated(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest doc_id: five-word shingles, similarity 0.8.

    Documents without words and rows without doc_id stay; rows that repeat a doc_id stay or go together. No documents
    give none.
    """
    return ngram_join.one_of_each(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until sources stand in their target shares.

    A null source is a source, texts without words weigh nothing, rows that repeat a doc_id are taken alike. No
    documents give none.
    """
    return mixing.mixture(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document.

    Null is the empty text, which has no pieces; rows that repeat get the same pieces. No documents give none.
    """
    return piece_sampling.sampled_pieces(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: The first and last stages can't be put in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; every stage but the last is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
