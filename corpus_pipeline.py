"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last
return the columns of documents. ``run`` writes each stage's rows to the shared folder and reads them
again, so a lost executor costs no earlier stage.

Defined cases: a null text counts as the empty text in every stage; rows without id are told apart by
their place in the first two stages and are never near copies; repeated rows of one id and text become
one; texts of any length pass whole; an empty table gives an empty result; further columns of documents
pass every stage but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notelens.llm import decontaminate, exact_dedup, jaccard_join, quality, sentencepiece_codec
from notelens.llm.queries import PIECES, QUALITY_FLOOR
from notelens.sources.tables import staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model scores at 0.3 or more."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.drop_below(docs, model, QUALITY_FLOOR)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; of repeated rows of it, one."""
    return exact_dedup.drop_copies(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest id."""
    found = jaccard_join.jaccard_components(spark, docs)
    gone = found.filter("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document left."""
    return sentencepiece_codec.encode(spark, docs.select("doc_id", "text"), PIECES).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding", token_ids),
]

#: A learned score is no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
