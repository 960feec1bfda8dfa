"""Toxic text: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Each distinct n-gram (3 to 5 characters, hashed) of a text is a feature with the value of its log-count
ratio between toxic and other labelled texts; a logistic model with a squared penalty weighs them.
The classifier is fitted on a bounded sample of labelled rows (`fit_rows`, in the order of a hash of
doc_id; exact copies of a text count once). Every whole text is then scored inside its task.

Null text scores as empty text. Rows whose doc_id is null or repeated are scored like any other; a
doc_id that is repeated in the labels counts as toxic if one of its labels says so. Without labelled
rows of both kinds every score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.common import hash_first, stored, text_steps
from bazaarlens.llm.linear import char_ngrams, fit_logistic, sigmoid

SIZES = (3, 4, 5)
BITS = 20


@dataclass
class ToxicityModel:
    """weights: one number for each bucket (0: not used), ratio and logistic weight in one."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        owner, bucket = char_ngrams(texts, SIZES, BITS, self.weights)
        return sigmoid(np.bincount(owner, self.weights[bucket], minlength=len(texts)) + self.bias)


def is_held_out(doc_id: str | Column) -> Column:
    """The fold that is never learned from: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, fit_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most fit_rows labelled documents outside the held-out fold.

    Labels are a table of their own: repeated labels of a document give the largest. The sample is
    bounded by fit_rows, so the join can broadcast it. Exact copies of a text are left with one row.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~is_held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    chosen = hash_first(known, "doc_id", fit_rows)
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # one row for each document and then for each text; the least text and id decide, so runs agree
    return (
        rows.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("label").alias("label"))
        .groupBy("text")
        .agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    )


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    fit_rows: int = 6000,
    least_texts: int = 5,
    least_ratio: float = 2.0,
    n_features: int = 20_000,
) -> ToxicityModel:
    """Fit on a bounded sample. n_features buckets with the largest ratios are kept.

    A bucket must occur in least_texts texts, and its ratio must be least_ratio away from 0. The count is
    fixed, so a word of few toxic texts still weighs; what the sample says of it is smoothed by the ratio
    (one text is added to each side) and held back by the penalty.
    """
    sample = stored(labelled_sample(documents, labels, "toxic", fit_rows).repartition(8, "doc_id"), "toxicity-sample")
    counts = T.StructType([T.StructField(c, T.LongType()) for c in ("bucket", "toxic", "other")])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), np.int64)
        for rows, texts in text_steps(batches, "text"):
            owner, bucket = char_ngrams(texts, SIZES, BITS)
            toxic = rows.column("label").to_numpy(zero_copy_only=False)[owner] == 1
            held[0] += np.bincount(bucket[toxic], minlength=1 << BITS)
            held[1] += np.bincount(bucket[~toxic], minlength=1 << BITS)
        some = np.flatnonzero(held.any(0))
        for a in range(0, len(some), 100_000):
            b = some[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(held[0][b]), pa.array(held[1][b])], names=counts.names)

    totals = {r["label"]: r["count"] for r in sample.groupBy((F.col("label") == 1).alias("label")).count().collect()}
    n_toxic, n_other = totals.get(True, 0), totals.get(False, 0)
    weights = np.zeros(1 << BITS, np.float32)
    if not n_toxic or not n_other:
        return ToxicityModel(weights, 35.0 if n_toxic else -35.0)
    # at most n_features rows come to the driver
    ratio = F.log((F.col("toxic") + 1) / (n_toxic + 2)) - F.log((F.col("other") + 1) / (n_other + 2))
    kept = (
        sample.mapInArrow(count, counts)
        .groupBy("bucket")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where(F.col("toxic") + F.col("other") >= least_texts)
        .select("bucket", ratio.alias("ratio"))
        .where(F.abs("ratio") >= least_ratio)
        .orderBy(F.abs("ratio").desc(), "bucket")
        .limit(n_features)
        .toPandas()
    )
    ratios = np.zeros(1 << BITS, np.float32)
    ratios[kept["bucket"].to_numpy(np.int64)] = kept["ratio"].to_numpy(np.float32)

    found = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("buckets", T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_steps(batches, "text"):
            owner, bucket = char_ngrams(texts, SIZES, BITS, ratios)
            ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column("label"), lists], names=found.names)

    # bounded: fit_rows rows of at most n_features numbers
    rows = sample.orderBy("doc_id").select("label", "text").mapInArrow(encode, found).toArrow()
    labels_ = (rows.column("label").to_numpy() == 1).astype(float)
    lists = rows.column("buckets").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    cols = lists.flatten().to_numpy().astype(np.int64)
    at = np.zeros(1 << BITS, np.int64)
    used = np.flatnonzero(ratios)
    at[used] = np.arange(len(used))
    w, bias = fit_logistic(
        np.repeat(np.arange(len(sizes)), sizes), at[cols], ratios[cols], labels_, np.ones(len(sizes)), len(used)
    )
    weights[used] = w * ratios[used]
    return ToxicityModel(weights, bias)


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of `keep` and score, one row for each row. The model has a fixed size (4 MB)."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_steps(batches, "__text"):
            scores = pa.array(held.value.scores(texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), scores], names=schema.names)

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(run, schema)
