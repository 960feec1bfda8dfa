"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of bit masks holds a Bloom filter for every language: bit l of a slot belongs to language
l, so the bitwise and of an n-gram's slots names all languages whose filter holds it at once. The
n-grams of a text vote for their languages; each language's count is corrected for the share of
false positives its own filter gives, and the largest corrected count decides.

Filters are fitted on a bounded sample: of each language, the `fit_rows` documents outside the
held-out fold that come first in the order of a hash of doc_id. An n-gram enters the filter of a
language if it occurs in `least_share` of that language's sampled texts (and in two at least, where
there are ten). Every whole text is scored inside its task.

Null text, or text without a letter: und with score 0. Text with letters, but none of whose n-grams
is known: the most frequent learned language, score 0 (und if nothing was learned). Ties go to the
more frequent language, then to the first by name. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.common import code_points, mix64, stored, text_steps
from bazaarlens.llm.toxicity import is_held_out

SIZES = (3, 4)
BITS = 20
HASHES = 3
SLICE = 63

_LETTERS: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point: its lower-case letter, or a space where it is no letter."""
    global _LETTERS
    if _LETTERS is None:
        table = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _LETTERS = table
    return _LETTERS


def word_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of every n-gram inside a word (its ends count as one space), in text
    order for each size, and whether each text has a letter."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    points = letter_table()[code_points(" " + " ".join(texts) + " ")]
    ends = np.cumsum(sizes)
    letters = points != 32
    seen = np.r_[0, np.cumsum(letters)]
    bounds = np.r_[0, ends] + 1
    has = seen[np.minimum(bounds[1:], len(points))] > seen[bounds[:-1]]
    owners, hashes = [], []
    for n in SIZES:
        m = len(points) - n + 1
        if m <= 0:
            continue
        inner = letters[1 : m + 1].copy()
        for k in range(2, n - 1):
            inner &= letters[k : m + k]
        at = np.flatnonzero(inner)
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = (value << np.uint64(15)) ^ (value >> np.uint64(40)) ^ points[at + k].astype(np.uint64)
        owners.append(np.searchsorted(ends, at, "right"))
        hashes.append(mix64(value))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), has
    return np.concatenate(owners), np.concatenate(hashes), has


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    """Places of n-grams in the table, one array for each hash function."""
    return [((hashes >> np.uint64(BITS * k)) & np.uint64((1 << BITS) - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class LanguageFilters:
    """languages from most to least frequent, masks (one table for each 63 languages), and the most frequent language."""

    languages: list[str]
    masks: np.ndarray
    usual: str

    def __post_init__(self):
        filled = [
            np.count_nonzero(self.masks[i // SLICE] & np.uint64(1 << (i % SLICE))) / (1 << BITS)
            for i in range(len(self.languages))
        ]
        self.false_rate = np.array(filled) ** HASHES

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        owner, hashes, has = word_ngrams(texts)
        total = np.bincount(owner, minlength=len(texts))
        places = slots(hashes)
        counts = np.zeros((len(texts), max(1, len(self.languages))))
        for part in range(len(self.masks)):
            found = self.masks[part][places[0]]
            for p in places[1:]:
                found &= self.masks[part][p]
            some = np.flatnonzero(found)
            found, who = found[some], owner[some]
            for i in range(part * SLICE, min(len(self.languages), (part + 1) * SLICE)):
                hit = (found >> np.uint64(i % SLICE)) & np.uint64(1)
                counts[:, i] = np.bincount(who, hit, minlength=len(texts))
        if self.languages:
            room = 1 - self.false_rate  # a full filter says nothing: its count is 0
            counts = np.maximum(counts - total[:, None] * self.false_rate, 0) * (room > 0) / np.where(room > 0, room, 1)
        best = counts.argmax(1)
        score = counts.max(1) / np.maximum(counts.sum(1), 1e-12)
        names = [
            "und" if not h else self.languages[b] if c > 0 else self.usual
            for h, b, c in zip(has.tolist(), best.tolist(), counts.max(1).tolist())
        ]
        return names, np.where(has, score, 0.0)


def fit_languages(documents: DataFrame, fit_rows: int = 1000, least_share: float = 0.004) -> LanguageFilters:
    """Filters of all languages of `lang`. What reaches the driver is the table itself (2^20 slots)."""
    rows = documents.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id")
    ).select("doc_id", F.col("lang").cast("string").alias("lang"))
    # Only rows whose hash is small for the size of their language are ranked: some 4 * fit_rows of
    # each, so a language that holds most rows is no heavier than another.
    often = stored(rows.groupBy("lang").count(), "language-counts")
    place = (F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))).alias("place")
    first = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = (
        rows.select("doc_id", "lang", place)
        .join(often, "lang")
        .where(F.col("place") * F.col("count") <= 4 * fit_rows)
        .withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= fit_rows)
        .select("doc_id", "lang")
    )
    # least text of each document: one row for each, whatever was repeated
    sample = stored(
        documents.where(F.col("lang").isNotNull())
        .select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen.distinct()), ["doc_id", "lang"])
        .groupBy("doc_id", "lang")
        .agg(F.min("text").alias("text"))
        .repartition(8, "doc_id"),
        "language-sample",
    )
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    # the most frequent language comes first and wins ties
    languages = [r["lang"] for r in often.orderBy(F.desc("count"), "lang").collect() if r["lang"] in sizes]
    parts = max(1, -(-len(languages) // SLICE))
    masks = np.zeros((parts, 1 << BITS), np.uint64)
    if not languages:
        return LanguageFilters([], masks, "und")
    number = {name: i for i, name in enumerate(languages)}
    least = np.array([max(least_share * sizes[n], 2 if sizes[n] >= 10 else 1) for n in languages])

    grams = T.StructType([T.StructField(c, T.LongType()) for c in ("lang", "gram", "texts")])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_steps(batches, "text"):
            lang = np.array([number[x] for x in rows.column("lang").to_pylist()])
            owner, hashes, _ = word_ngrams(texts)
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            once = np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])][: len(owner)]
            lang, hashes = lang[owner[once]], hashes[once]
            order = np.lexsort((hashes, lang))
            lang, hashes = lang[order], hashes[order]
            start = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (hashes[1:] != hashes[:-1])][: len(lang)])
            times = np.diff(np.r_[start, len(lang)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang[start]), pa.array(hashes[start].view(np.int64)), pa.array(times)], names=grams.names
            )

    slot = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "slot", "mask")])

    def insert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((parts, 1 << BITS), np.uint64)
        for batch in batches:
            lang, gram, texts = (batch.column(c).to_numpy() for c in ("lang", "gram", "texts"))
            kept = texts >= least[lang]
            lang, gram = lang[kept], gram[kept].view(np.uint64)
            bit = np.uint64(1) << (lang % SLICE).astype(np.uint64)
            for p in slots(gram):
                np.bitwise_or.at(table, (lang // SLICE, p), bit)
        part, at = np.nonzero(table)
        for a in range(0, len(at), 100_000):
            p, s = part[a : a + 100_000], at[a : a + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p), pa.array(s), pa.array(table[p, s].view(np.int64))], names=slot.names
            )

    filled = (
        sample.mapInArrow(count, grams)
        .groupBy("lang", "gram")
        .agg(F.sum("texts").alias("texts"))
        .mapInArrow(insert, slot)
        .groupBy("part", "slot")
        .agg(F.bit_or("mask").alias("mask"))
        .toPandas()
    )
    masks[filled["part"], filled["slot"]] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    return LanguageFilters(languages, masks, languages[0])


def identify_language(
    df: DataFrame, filters: LanguageFilters, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns of `keep`, lang_pred and score, one row for each row. The filters have a fixed size."""
    schema = T.StructType(
        [df.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    held = df.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_steps(batches, "__text"):
            names, score = held.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                names=schema.names,
            )

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(run, schema)
