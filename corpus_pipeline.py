"""A training-data pipeline over `documents`: five stages, each over all that the one before kept.

Rows whose doc_id is null stay where they cannot be named (stages 2 and 3 decide by doc_id). All
stages but the last return the columns of documents; further columns of the input are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.common import small_batches, stored
from bazaarlens.llm.pii_crf import redact
from bazaarlens.llm.piece_codec import encode_pieces
from bazaarlens.llm.quality_cotrain import fit_quality, keep_good
from bazaarlens.llm.queries import piece_model_path, table
from bazaarlens.llm.template_leaks import find_leaks
from bazaarlens.llm.token_groups import jaccard_components


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier gives 0.5 or more."""
    small_batches(spark)
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")), 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id.

    Five-word shingles, Jaccard similarity of 0.8 or more. A doc_id names one document: if one of
    its rows is a copy of a document with a smaller doc_id, all go. Rows that repeat both doc_id and
    text are one row.
    """
    small_batches(spark)
    found = jaccard_components(docs, n=5, percent=80)
    gone = stored(
        found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "duplicates"
    )
    repeated = stored(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    kept = docs.join(gone, "doc_id", "left_anti")
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    small_batches(spark)
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    gone = stored(leaks.select("doc_id").distinct(), "leaking")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    small_batches(spark)
    return redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of all documents."""
    small_batches(spark)
    encoded = encode_pieces(docs, piece_model_path())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("pieces", pieces),
]

#: A trained classifier, a random field and merges by rank are no SQL; tests/llm holds brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
