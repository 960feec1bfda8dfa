"""Quality by co-training: a text-content and a page-metadata classifier teach each other.

The content view sees relative frequencies of character trigrams (hashed). The metadata view sees
source, language and the page's layout: length, lines, cases, marks, digits, repeated words and
repeated lines, each cut into bins. (n_chars is the length of text, so it is not read.) Both start
from labelled rows. In every round each view scores all documents, and those it is surest of, in the
proportion of the classes, teach the other view. Then each view is calibrated on labelled rows kept
aside, and the calibrated log-odds are combined by a logistic model on the same rows. The combination
scores all documents.

Labelled rows are a bounded sample (`fit_rows`, in the order of a hash of doc_id; exact copies of a
text count once). The exchange has no bound: each round is one pass over all texts, whose tasks return
sums of a fixed size. The surest share is found in score bins counted over all documents (documents
of one bin go together, so ties do), the content view learns from trigram sums of each pseudo-class,
and the metadata view from gradients summed over all. Only bins, sums and weights reach the driver.
Labelled rows take part in the exchange like all others, without their labels. Pseudo-labels weigh
`trust` times the labelled rows, however many they are. Labels of the held-out fold are not learned from.

Null text counts as empty, null source or lang as values of their own, and rows without doc_id teach
like others. Rows are scored one by one, so repeated rows get equal scores. Without labels of both
kinds every score is 1 (nothing is rejected) or, where all labels are 0, 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.common import code_points, stored, task_of
from bazaarlens.llm.common import text_steps as steps_of
from bazaarlens.llm.linear import fit_logistic, sigmoid
from bazaarlens.llm.toxicity import labelled_sample

#: Characters that a task describes at once. Trigrams take some 40 bytes a character while they are made.
STEP_CHARS = 500_000
BITS = 15
SCALE = 300.0
STATS = ("chars", "lines", "line_chars", "upper", "marks", "digits", "other", "fresh_words", "fresh_lines", "word_chars", "echoes")
BINS = 12
SOURCES, LANGS = 64, 16
WIDTH = len(STATS) * BINS + SOURCES + LANGS

_KINDS: np.ndarray | None = None


def text_steps(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    task_of("quality")
    return steps_of(batches, column, STEP_CHARS)


def kind_table() -> np.ndarray:
    """For each code point: 0 white space, 1 lower, 2 upper, 3 digit, 4 mark (ASCII), 5 other."""
    global _KINDS
    if _KINDS is None:
        table = np.full(0x110000, 5, np.uint8)
        for cp in range(0x3000):
            c = chr(cp)
            table[cp] = 0 if c.isspace() else 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if cp < 128 else 5
        _KINDS = table
    return _KINDS


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of every trigram, and the number of trigrams of each text (at least 1).

    Both ends of a text count as a mark. No trigram spans two texts; an empty text has none.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    points = code_points("".join([f"\x01{t}\x01" for t in texts]))
    value = points[:-2] * np.uint32(0x9E3779B1)
    value = (value ^ points[1:-1]) * np.uint32(0x85EBCA6B)
    value = (value ^ points[2:]) * np.uint32(0xC2B2AE35)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[:-2]
    inside = np.ones(len(owner), bool)
    ends = np.cumsum(sizes)[:-1]
    inside[ends - 1] = inside[ends - 2] = False
    return owner[inside], (value >> np.uint32(32 - BITS))[inside], np.maximum(sizes - 2, 1)


def statistics(texts: list[str]) -> np.ndarray:
    """One row for each text, one column for each of STATS."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    kinds = kind_table()[code_points("".join(texts))]
    counts = np.bincount(owner * np.int64(6) + kinds, minlength=6 * n).reshape(n, 6).astype(float)
    solid = np.maximum(counts[:, 1:].sum(1), 1)
    out = np.zeros((n, len(STATS)))
    for i, text in enumerate(texts):
        words, lines = text.split(), text.split("\n")
        distinct = len(set(words))
        # the share of fresh words falls with length for any text, so it is taken on a log scale
        out[i, 7] = np.log1p(distinct) / np.log1p(len(words)) if words else 1.0
        out[i, 8] = len(set(lines)) / len(lines)
        out[i, 9] = solid[i] / max(1, len(words))
        out[i, 10] = sum(map(eq, words, islice(words, 1, None))) / len(words) if words else 0.0
        out[i, 1] = len(lines)
    out[:, 0] = np.log1p(sizes)
    out[:, 2] = np.log1p(sizes / out[:, 1])
    out[:, 1] = np.log1p(out[:, 1])
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    out[:, 3] = counts[:, 2] / letters
    for column, kind in ((4, 4), (5, 3), (6, 5)):
        out[:, column] = counts[:, kind] / solid
    return out


def bucket_of(value: str | None, width: int) -> int:
    return 0 if value is None else 1 + xxhash.xxh64_intdigest(value) % (width - 1)


@dataclass
class QualityModel:
    content: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    content_bias: float = 0.0
    meta: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    meta_bias: float = 0.0
    edges: np.ndarray = field(default_factory=lambda: np.zeros((len(STATS), BINS - 1)))
    #: slope and offset of the calibrated log-odds of each view, then weights of the combination
    calibration: np.ndarray = field(default_factory=lambda: np.array([[1.0, 0.0], [1.0, 0.0]]))
    mixture: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5, 0.0]))

    def meta_columns(self, stats: np.ndarray, sources: list, langs: list) -> np.ndarray:
        """The columns that are one for each row: a bin of each statistic, the source and the language."""
        bins = np.stack([np.searchsorted(e, s, "right") for e, s in zip(self.edges, stats.T)], 1)
        bins += np.arange(len(STATS)) * BINS
        base = len(STATS) * BINS
        named = [(base + bucket_of(s, SOURCES), base + SOURCES + bucket_of(x, LANGS)) for s, x in zip(sources, langs)]
        return np.concatenate([bins, np.array(named, np.int64).reshape(-1, 2)], 1)

    def scores(self, texts: list[str], sources: list, langs: list) -> np.ndarray:
        """Calibrated content and metadata scores and their combination, as columns."""
        owner, bucket, sizes = trigrams(texts)
        content = np.bincount(owner, self.content[bucket], minlength=len(texts)) * SCALE / sizes + self.content_bias
        meta = self.meta[self.meta_columns(statistics(texts), sources, langs)].sum(1) + self.meta_bias
        views = np.stack([content, meta], 1) * self.calibration[:, 0] + self.calibration[:, 1]
        views = np.clip(views, -12, 12)
        both = views @ self.mixture[:2] + self.mixture[2]
        return sigmoid(np.concatenate([views, both[:, None]], 1))


def _described(documents: DataFrame, labels: DataFrame, fit_rows: int) -> pa.Table:
    """The labelled rows, at most fit_rows, by doc_id: label, trigram counts, statistics, source, lang."""
    known = labelled_sample(documents, labels, "quality", fit_rows).select("doc_id", "label")
    rows = documents.select("doc_id", *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))
    sample = (
        rows.join(F.broadcast(known), "doc_id")
        .groupBy("doc_id")
        .agg(F.min(F.struct("text", "source", "lang", "label")).alias("row"))
        .select(F.col("doc_id").cast("long").alias("doc_id"), "row.*")
    )
    shape = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType())]
        + [T.StructField(c, T.ArrayType(k)) for c, k in (("bucket", T.IntegerType()), ("times", T.IntegerType()), ("stats", T.DoubleType()))]
        + [T.StructField(c, T.StringType()) for c in ("source", "lang")]
    )

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_steps(batches, "text"):
            owner, bucket, _ = trigrams(texts)
            keys, times = np.unique((owner.astype(np.int64) << BITS) | bucket, return_counts=True)
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(keys >> BITS, minlength=len(texts)))].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("label"),
                    pa.ListArray.from_arrays(ends, pa.array((keys & ((1 << BITS) - 1)).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                    pa.array(list(statistics(texts)), pa.list_(pa.float64())),
                    rows.column("source"),
                    rows.column("lang"),
                ],
                names=shape.names,
            )

    columns = sample.select("doc_id", "label", "text", "source", "lang")
    # the same rows in the same order on every run
    return columns.mapInArrow(describe, shape).toArrow().sort_by("doc_id")


def fit_quality(
    documents: DataFrame,
    labels: DataFrame,
    fit_rows: int = 4000,
    rounds: int = 4,
    share: float = 0.1,
    trust: float = 0.5,
) -> QualityModel:
    """Co-train over all documents. In round k a view passes on its surest k * `share` of them."""
    found = _described(documents, labels, fit_rows)
    label = found.column("label").to_numpy().astype(float)
    if len(set(label.tolist())) < 2:
        return QualityModel(mixture=np.array([0.0, 0.0, -35.0 if len(label) and label.max() < 1 else 35.0]))
    taught = _Labelled(found, label, trust)
    taught.fit_content(None)
    taught.fit_meta(None)
    prior = float(label[taught.train].mean())
    texts = documents.select(*(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))
    passed = stored(_one_pass(texts, taught.model, None), "quality-pass")
    for k in range(1, rounds + 1):
        rows = passed.where(F.col("layout").isNotNull())
        sure = _surest(_meta_odds(rows, taught.model), k * share, prior)
        # this pass sums what metadata teaches content, and scores content as it was before
        passed = stored(_one_pass(texts, taught.model, sure), "quality-pass")
        rows = passed.where(F.col("layout").isNotNull())
        sure = _surest(rows.select("odds"), k * share, prior)
        taught.fit_meta(lambda model: _gradient(rows, model, sure))
        taught.fit_content(_sums(passed))
    return taught.calibrated()


#: Frequencies and gradients are summed as whole multiples of 1 / GRAIN, so sums are exact in any order.
#: 63 bits hold those of 10^10 documents, and a text of 10^8 characters still counts.
GRAIN = 1 << 28
#: Score bins between -SPAN and SPAN.
SCORE_BINS, SPAN = 4096, 32.0
GRADIENT_STEPS = 4


def _classes(odds: np.ndarray, sure: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are surely of class 0 and of class 1. A pseudo-label must be on its own side of 0."""
    return (odds <= sure[0]) & (odds < 0), (odds >= sure[1]) & (odds > 0)


def _one_pass(texts: DataFrame, model: QualityModel, sure: tuple[float, float] | None) -> DataFrame:
    """Content log-odds and metadata columns of every row, and trigram sums of a task's pseudo-classes.

    Rows of the second kind have a bucket instead of a layout; bucket -1 counts the rows. Without
    `sure` (limits of the metadata log-odds) there are none.
    """
    held = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        sums = np.zeros((2, 1 << BITS), np.int64)
        counts = np.zeros(2, np.int64)
        for rows, texts in text_steps(batches, "text"):
            owner, bucket, sizes = trigrams(texts)
            odds = np.bincount(owner, model.content[bucket], minlength=len(texts)) * SCALE / sizes + model.content_bias
            layout = model.meta_columns(statistics(texts), rows.column("source").to_pylist(), rows.column("lang").to_pylist())
            nothing = pa.nulls(len(texts), pa.int64())
            packed = pa.array([z.tobytes() for z in layout.astype(np.int16)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(odds), packed, pa.nulls(len(texts), pa.int32()), nothing, nothing], names=PASS_SCHEMA.names
            )
            if sure is not None:
                grains = np.round(GRAIN / sizes)
                for k, chosen in enumerate(_classes(model.meta[layout].sum(1) + model.meta_bias, sure)):
                    inside = chosen[owner]
                    sums[k] += np.bincount(bucket[inside], grains[owner[inside]], minlength=1 << BITS).astype(np.int64)
                    counts[k] += chosen.sum()
        some = np.flatnonzero(sums.any(0)).astype(np.int32)
        if counts.any():
            cells = np.r_[np.int32(-1), some].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(cells), pa.float64()),
                    pa.nulls(len(cells), pa.binary()),
                    pa.array(cells),
                    *(pa.array(np.r_[counts[k], sums[k][some]]) for k in (0, 1)),
                ],
                names=PASS_SCHEMA.names,
            )

    return texts.mapInArrow(run, PASS_SCHEMA)


PASS_SCHEMA = T.StructType(
    [
        T.StructField("odds", T.DoubleType()),
        T.StructField("layout", T.BinaryType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("bad", T.LongType()),
        T.StructField("good", T.LongType()),
    ]
)


def _layouts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(len(column), -1).astype(np.int64)


def _meta_odds(rows: DataFrame, model: QualityModel) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast((model.meta, model.meta_bias))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for batch in batches:
            if batch.num_rows:
                odds = weights[_layouts(batch.column(0))].sum(1) + bias
                yield pa.RecordBatch.from_arrays([pa.array(odds)], names=["odds"])

    return rows.select("layout").mapInArrow(run, "odds double")


def _surest(odds: DataFrame, share: float, prior: float) -> tuple[float, float]:
    """Log-odds up to which, and from which on, lie the surest rows: `share` of all, by class.

    Whole bins are taken until the share is reached. At most SCORE_BINS rows come to the driver.
    """
    place = F.floor((F.greatest(F.least("odds", F.lit(SPAN)), F.lit(-SPAN)) + SPAN) * (SCORE_BINS / (2 * SPAN)))
    counts = np.zeros(SCORE_BINS + 1, np.int64)
    for row in odds.groupBy(place.cast("int").alias("place")).count().collect():
        counts[row["place"]] = row["count"]
    wanted = share * counts.sum()
    low = int(np.searchsorted(np.cumsum(counts), wanted * (1 - prior)))
    high = SCORE_BINS - int(np.searchsorted(np.cumsum(counts[::-1]), wanted * prior))
    step = 2 * SPAN / SCORE_BINS
    # the outermost bins hold what lies beyond the span
    return (low + 1) * step - SPAN, (high * step - SPAN if high else -np.inf)


def _sums(passed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each pseudo-class, and their summed trigram frequencies: one row a bucket to the driver."""
    found = (
        passed.where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .toArrow()
    )
    cells = found.column("bucket").to_numpy()
    both = np.stack([found.column(c).to_numpy() for c in ("bad", "good")])
    sums = np.zeros((2, 1 << BITS))
    sums[:, cells[cells >= 0]] = both[:, cells >= 0] / GRAIN
    return both[:, cells < 0].sum(1), sums


def _gradient(rows: DataFrame, model: QualityModel, sure: tuple[float, float]) -> tuple[int, np.ndarray]:
    """Number of pseudo-labelled rows, and the sum of their gradients of the metadata model (bias last)."""
    held = rows.sparkSession.sparkContext.broadcast((model.meta, model.meta_bias))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        sums, count = np.zeros(WIDTH + 1, np.int64), 0
        for batch in batches:
            bad, good = _classes(batch.column(0).to_numpy(), sure)
            use = bad | good
            if use.any():
                layout = _layouts(batch.column(1))[use]
                error = np.round((sigmoid(weights[layout].sum(1) + bias) - good[use]) * GRAIN)
                sums[:-1] += np.bincount(layout.ravel(), np.repeat(error, layout.shape[1]), minlength=WIDTH).astype(np.int64)
                sums[-1] += int(error.sum())
                count += int(use.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, WIDTH + 1), pa.int32()), pa.array(np.r_[count, sums])], names=["at", "total"]
        )

    parts = rows.select("odds", "layout").mapInArrow(run, "at int, total long")
    found = {r["at"]: r["total"] for r in parts.groupBy("at").agg(F.sum("total").alias("total")).collect()}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(WIDTH + 1)]) / GRAIN


class _Labelled:
    """The labelled sample on the driver, and the two views fitted to it and to sums over all documents."""

    def __init__(self, found: pa.Table, label: np.ndarray, trust: float) -> None:
        self.label, self.trust, self.model = label, trust, QualityModel()
        lists = found.column("bucket").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        # short numbers: these arrays are what the driver holds most of
        self.cols = lists.flatten().to_numpy()
        values = found.column("times").combine_chunks().flatten().to_numpy().astype(np.float32)
        self.rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        values *= (SCALE / np.maximum(np.bincount(self.rows, values, minlength=len(sizes)), 1)).astype(np.float32)[self.rows]
        self.values = values
        stats = np.array(found.column("stats").to_pylist())
        self.model.edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        self.layout = self.model.meta_columns(stats, found.column("source").to_pylist(), found.column("lang").to_pylist())
        # every fourth labelled row is kept aside to calibrate and combine
        self.aside = np.arange(len(label)) % 4 == 0
        self.train = ~self.aside
        if len(set(label[self.train].tolist())) < 2 or len(set(label[self.aside].tolist())) < 2:
            self.aside = self.train = np.ones(len(label), bool)

    def fit_content(self, pseudo: tuple[np.ndarray, np.ndarray] | None) -> None:
        """Naive Bayes log-ratios of labelled and pseudo-labelled sums, and what labelled rows correct of them."""
        inside = self.train[self.rows]
        rows, cols, values = (a[inside] for a in (self.rows, self.cols, self.values))
        good = self.label[rows] == 1
        sums = np.stack([np.bincount(cols[at], values[at], minlength=1 << BITS) for at in (~good, good)])
        if pseudo is not None and pseudo[0].sum():
            sums += pseudo[1] * (SCALE * self.trust * self.train.sum() / pseudo[0].sum())
        sums += 0.1
        ratio = np.log(sums / sums.sum(1, keepdims=True))
        ratio = ratio[1] - ratio[0]
        # the log-ratios' score of a row is one more column beside its trigrams
        n = len(self.label)
        score = np.bincount(rows, values * ratio[cols], minlength=n)
        scale = max(float(np.abs(score[self.train]).mean()), 1e-6)
        weights, self.model.content_bias = fit_logistic(
            np.concatenate([rows, np.flatnonzero(self.train).astype(np.int32)]),
            np.concatenate([cols, np.full(self.train.sum(), 1 << BITS, cols.dtype)]),
            np.concatenate([values, (score[self.train] / scale).astype(np.float32)]),
            self.label,
            self.train.astype(float),
            (1 << BITS) + 1,
            decay=0.3,
        )
        self.model.content = weights[:-1] + ratio * (weights[-1] / scale)

    def fit_meta(self, gradient, decay: float = 0.3) -> None:
        """Newton steps with the curvature of the labelled rows; `gradient` adds the sums over all documents."""
        ones = np.zeros((self.train.sum(), WIDTH + 1))
        ones[np.arange(len(ones))[:, None], self.layout[self.train]] = 1
        ones[:, -1] = 1
        keep = np.r_[np.full(WIDTH, decay), 1e-3]
        for _ in range(GRADIENT_STEPS if gradient else 12):
            weights = np.r_[self.model.meta, self.model.meta_bias]
            p = sigmoid(ones @ weights)
            slope = ones.T @ (p - self.label[self.train]) + keep * weights
            curve = (ones * np.maximum(p * (1 - p), 1e-3)[:, None]).T @ ones
            if gradient:
                count, others = gradient(self.model)
                if count:
                    slope += others * (self.trust * self.train.sum() / count)
                    curve *= 1 + self.trust
            weights = weights - np.linalg.solve(curve + np.diag(keep), slope)
            self.model.meta, self.model.meta_bias = weights[:-1], float(weights[-1])

    def calibrated(self) -> QualityModel:
        """The model, with each view's log-odds calibrated and both combined on the rows kept aside."""
        model, aside = self.model, self.aside
        content = np.bincount(self.rows, self.values * model.content[self.cols], minlength=len(self.label)) + model.content_bias
        odds = [content, model.meta[self.layout].sum(1) + model.meta_bias]
        y = self.label[aside]
        one = np.arange(aside.sum())
        views = []
        for view in (0, 1):
            x = odds[view][aside]
            scale = max(float(np.abs(x).mean()), 1e-6)
            w, bias = fit_logistic(one, np.zeros(len(one), np.int64), x / scale, y, np.ones(len(one)), 1, decay=0.01, rounds=400)
            model.calibration[view] = max(w[0], 0) / scale, bias
            views.append(np.clip(x * model.calibration[view, 0] + bias, -12, 12))
        w, bias = fit_logistic(
            np.tile(one, 2), np.repeat([0, 1], len(one)), np.concatenate(views), y, np.ones(len(one)), 2, decay=0.1, rounds=400
        )
        model.mixture = np.array([max(w[0], 0), max(w[1], 0), bias])
        return model


def score_quality(df: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of `keep`, content_score, metadata_score and score (each 0 to 1), one row for each row."""
    names = ("content_score", "metadata_score", "score")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.DoubleType()) for c in names])
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_steps(batches, "__text"):
            scores = held.value.scores(texts, rows.column("__source").to_pylist(), rows.column("__lang").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in keep), *(pa.array(s, pa.float64()) for s in scores.T)], names=schema.names
            )

    inputs = [F.col(c).cast("string").alias(f"__{c}") for c in ("text", "source", "lang")]
    return df.select(*keep, *inputs).mapInArrow(run, schema)


def keep_good(df: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows whose score is `least` or more, with all their columns and no others."""
    schema = df.schema
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_steps(batches, "text"):
            named = (rows.column(c).cast(pa.string()).to_pylist() for c in ("source", "lang"))
            scores = held.value.scores(texts, *named)[:, 2]
            yield rows.filter(pa.array(scores >= least))

    return df.mapInArrow(run, schema)
