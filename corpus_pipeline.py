"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of
documents. run() writes each stage's result to the shared folder and hands the reread rows to the next.

Defined results of every stage: an empty table gives an empty table; null and empty texts, very long ones, null and repeated ids and
repeated rows are handled each for itself as the stage's operator says; columns other than doc_id and text are handed on unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evgraph.llm import decontamination, ngram_join, pieces, quality_classifier, substring_dedup
from evgraph.llm.common import cut, table, tokenizer_path


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores at its threshold or above; a null text counts as empty."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: its smallest doc_id's (null if it has no other), of its texts with that id the one whose hash is least. Texts without words stay."""
    return ngram_join.keep_representatives(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that they repeat; a document that only repeats others is left out."""
    return substring_dedup.remove_repeats(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without those of whose words a twentieth or more stands in benchmark windows; a text without words is clean."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of every text; a null text has none."""
    return pieces.encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("ngram_join", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", remove_contaminated),
    ("sentencepiece", encode),
]

#: Training, components and encoding have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
