"""Benchmark decontamination by templates: re-parameterised questions count as leaks.

Texts become sequences of words in which numbers, names and units are typed placeholders (runs of
numbers, and of names, are one). A number is a word of digits or a number word, a unit a unit word
right after a number, a name a capitalised word (not one in capitals). A word that starts a sentence may be a name
or not, and a copy may be in other case, so a text has three readings: no word is a name (CASELESS), capitalised
words inside sentences are (INNER), or those that start a sentence are too, unless they are function words (OPENING).
An item is looked for in CASELESS, and in each other reading that gives it further placeholders; windows meet windows
of their own reading only, and an item leaks if it does in one reading. Windows of `width`
places (a shorter item is one window) are hash-joined between documents and benchmark items. At one
alignment, equal items' values must always meet equal document values: windows with a slot that has neither the
item's own value nor the value that the item's meets most often there do not count.

A document leaks an item if consistent windows cover `least_share` of the item's windows, or if
`least_run` of them agree at one alignment. Windows need `least_words` literal words, so
that strings of placeholders match nothing. An item without such a window in any reading, however short, has one
exact window of all its words, numbers and names literal (EXACT): its verbatim copies are found, but not copies with
other parameters. Characters of scripts without spaces are words of their own.

Documents are scanned against a bit table of the items' windows, whose size is fixed (2^24 bits),
and only windows that pass it are joined, exactly, with the items. Items that are equal are represented by
the one with the least item_id.

Null texts are empty. Rows whose doc_id or item_id is null cannot be named and are left out of the
result; of the rows of a repeated doc_id or item_id each is judged by its own text, and one leak is enough.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.common import mix64, stored, task_of, text_steps

WIDTH = 8
LEAST_TOKENS = 5
FILTER_BITS = 24
#: Thai, Lao, Burmese, Khmer, kana and Han: scripts without spaces.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[^\W{UNSPACED}]+|[.!?:\n]|[{UNSPACED}]")
TOKENS_KEPT = 200_000
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half".split()
)
UNIT_WORDS = frozenset(
    "km m cm mm mile miles meter meters metre metres kilometer kilometers foot feet inch inches yard yards kg g mg gram "
    "grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec "
    "second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars euro "
    "euros cent cents usd eur percent degree degrees kmh mph kb mb gb tb hz khz mhz ghz w kw watt watts volt volts".split()
)
#: Words that are no names where they start a sentence.
FUNCTION_WORDS = frozenset(
    "a an the this that these those some any all both each every no i you he she it we they my your his her its our their "
    "what which who whom whose when where why how if then else and or but so because since while although though as at by "
    "for from in into of off on onto out over under to up with without within after before between during about above "
    "below is are was were be been am do does did has have had can could would shall should might must not there "
    "here let given suppose assume find calculate compute determine write explain name choose".split()
)
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
CASELESS, INNER, OPENING, EXACT = 0, 1, 2, 3
#: Hashes of the placeholders, by kind.
HOLDERS = np.array([0, 0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD], np.uint64)


class Tokens(dict):
    """Numbers of tokens, with what is known of each. Emptied when it holds too many."""

    def __init__(self):
        super().__init__()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.value = np.zeros(0, np.uint64)
        self.flags = np.zeros(0, np.uint8)
        self.fresh: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = at = len(self)
        self.fresh.append(token)
        return at

    def number(self, tokens: list[list[str]]) -> np.ndarray:
        if len(self) > TOKENS_KEPT:
            self.clear()
        count = sum(map(len, tokens))
        out = np.fromiter((i for t in tokens for i in map(self.__getitem__, t)), np.int32, count)
        if self.fresh:
            low = [t.lower() for t in self.fresh]
            value = np.fromiter((xxhash.xxh64_intdigest(t) for t in low), np.uint64, len(low))
            flags = np.fromiter(
                (
                    1 if t in ".!?:\n" else 2 if t[0].isdigit() or w in NUMBER_WORDS
                    else (4 if w in UNIT_WORDS else 0) + (8 if t[0].isupper() and not t[1:].isupper() else 0)
                    + (16 if w in FUNCTION_WORDS else 0)
                    for t, w in zip(self.fresh, low)
                ),
                np.uint8,
                len(low),
            )
            self.value, self.flags = np.concatenate([self.value, value]), np.concatenate([self.flags, flags])
            self.fresh = []
        return out


_TOKENS = Tokens()


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, value, flags and whether it starts a sentence, of every word of the texts."""
    split = [TOKEN.findall(t) for t in texts]
    index = _TOKENS.number(split)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, split), np.int64, len(split)))
    flags, value = _TOKENS.flags[index], _TOKENS.value[index]
    mark = flags == 1
    starts = np.r_[True, mark[:-1] | (owner[1:] != owner[:-1])][: len(owner)]
    keep = ~mark
    return owner[keep], value[keep], flags[keep], starts[keep]


def templates(words, reading: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, kind, template hash and value of every place of the texts' templates in a reading."""
    owner, value, flags, starts = words
    if reading == EXACT:
        return owner, np.zeros(len(owner), np.uint8), value, value
    kind = np.where(flags == 2, NUMBER, WORD).astype(np.uint8)
    if reading != CASELESS:
        name = flags & 8 > 0
        name &= ~starts | (flags & 16 == 0) if reading == OPENING else ~starts
        kind[name] = NAME
    same = np.r_[False, owner[1:] == owner[:-1]][: len(owner)]
    after = np.r_[0, kind[:-1]][: len(kind)].astype(np.uint8)
    kind[same & (flags & 4 > 0) & (after == NUMBER)] = UNIT
    # runs of numbers, and of names of one sentence, become one place, whose value is that of the whole run
    runs = same & (kind == after) & ((kind == NUMBER) | (kind == NAME) & ~starts)
    head = np.flatnonzero(~runs)
    if len(head):
        place = np.arange(len(kind)) - np.repeat(head, np.diff(np.r_[head, len(kind)]))
        rolled = np.where(place > 0, mix64(value + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), value)
        value = np.add.reduceat(rolled, head)
    owner, kind = owner[head], kind[head]
    return owner, kind, np.where(kind == WORD, value, HOLDERS[kind]), value


STEP = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def sums(template: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the hash of a window of any width is taken from: running sums, and the powers that shift them."""
    need = len(template) + 1
    if len(_POWERS[0]) < need:
        for k, base in enumerate((STEP, pow(STEP, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.r_[np.uint64(1), np.full(need, base, np.uint64)], dtype=np.uint64)
    total = np.zeros(need, np.uint64)
    np.cumsum(template * _POWERS[1][: len(template)], out=total[1:], dtype=np.uint64)
    return total, _POWERS[0]


def forget() -> None:
    """Drop what a worker remembers of the texts it has read."""
    _TOKENS.clear()
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def windows(owner: np.ndarray, kind: np.ndarray, summed, width: int, least_words: int, reading: int):
    """Starts and hashes of the windows of one width and reading that hold enough literal words."""
    m = len(owner) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = np.r_[0, np.cumsum(kind == WORD)]
    good = (owner[:m] == owner[width - 1 :]) & (words[width:] - words[:m] >= least_words)
    at = np.flatnonzero(good)
    total, power = summed
    value = (total[at + width] - total[at]) * power[at + width - 1]
    salt = (width + (reading << 32)) * 0xD6E8FEB86659FD93 % (1 << 64)
    return at, mix64(value + np.uint64(salt))


WINDOW = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.LongType()),
        T.StructField("reading", T.IntegerType()),
        T.StructField("place", T.LongType()),
        T.StructField("window", T.LongType()),
        T.StructField("slot", T.LongType()),
        T.StructField("slots", T.ArrayType(T.LongType())),
    ]
)


def _rows(ids: pa.Array, texts: list[str], reading: int, owner, kind, value, at, hashes, width: int) -> pa.RecordBatch:
    """Windows as rows: hash of the text, place in it, hash, number of the first slot, and the slots' values in order."""
    first = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1]
    base = np.zeros(len(ids), np.int64)
    base[owner[first]] = first
    slots = np.flatnonzero(kind != WORD)
    a, b = np.searchsorted(slots, at), np.searchsorted(slots, at + width)
    sizes = b - a
    mine, which = np.unique(owner[at], return_inverse=True)
    keys = np.fromiter((xxhash.xxh64_intdigest(texts[i]) for i in mine.tolist()), np.uint64, len(mine))
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(a, sizes)
    lists = pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(value[slots[inner]].view(np.int64))
    )
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(owner[at])).cast(pa.int64()),
            pa.array(keys[which].view(np.int64)),
            pa.array(np.full(len(at), reading, np.int32)),
            pa.array(at - base[owner[at]]),
            pa.array(hashes.view(np.int64)),
            pa.array(a - np.searchsorted(slots, base[owner[at]])),
            lists,
        ],
        names=WINDOW.names,
    )


def item_windows(benchmark: DataFrame, width: int = WIDTH, least_words: int = 4) -> DataFrame:
    """Windows of the distinct items: columns of WINDOW, and size (places of a window)."""
    items = (
        benchmark.where(F.col("item_id").isNotNull())
        .select(F.col("item_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .groupBy("text")
        .agg(F.min("id").alias("id"))
    )
    schema = T.StructType([*WINDOW.fields, T.StructField("size", T.LongType())])

    def sized(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, size))], names=schema.names)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("leaks", forget)
        for rows, texts in text_steps(batches, "text"):
            words = words_of(texts)
            literal, missed = None, np.ones(len(texts), bool)
            for reading in (CASELESS, INNER, OPENING):
                owner, kind, template, value = templates(words, reading)
                lengths = np.bincount(owner, minlength=len(texts))
                # a reading without further names is the one before
                before, literal = literal, np.bincount(owner[kind == WORD], minlength=len(texts))
                further = literal < before if reading else np.ones(len(texts), bool)
                summed = sums(template)
                for size in range(LEAST_TOKENS, width + 1):
                    # an item shorter than a window is one window of its own length
                    mine = further & (lengths >= width if size == width else lengths == size)
                    at, hashes = windows(owner, kind, summed, size, min(least_words, size), reading)
                    some = mine[owner[at]]
                    if some.any():
                        missed[owner[at[some]]] = False
                        yield sized(_rows(rows.column("id"), texts, reading, owner, kind, value, at[some], hashes[some], size), size)
            owner, kind, template, value = templates(words, EXACT)
            lengths = np.bincount(owner, minlength=len(texts))
            summed = sums(template)
            for size in np.unique(lengths[missed & (lengths > 0)]).tolist():
                at, hashes = windows(owner, kind, summed, size, 0, EXACT)
                some = (missed & (lengths == size))[owner[at]]
                yield sized(_rows(rows.column("id"), texts, EXACT, owner, kind, value, at[some], hashes[some], size), size)

    return items.mapInArrow(cut, schema)


ALIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("item_text", T.LongType()),
        T.StructField("reading", T.IntegerType()),
        T.StructField("places", T.ArrayType(T.LongType())),
    ]
)


def agreeing(found: list[dict]) -> list[int]:
    """Places of the windows of one alignment whose slots all agree."""
    # windows overlap: each slot is counted once
    met = {(w["item_slot"] + k, a, b) for w in found for k, (a, b) in enumerate(zip(w["item_slots"], w["slots"]))}
    times = Counter((a, b) for _, a, b in met)
    most: dict[int, tuple] = {}
    for (a, b), n in times.items():
        most[a] = max(most.get(a, (0, False, 0)), (n, a == b, b))
    return [
        w["item_place"] for w in found if all(a == b or most[a][2] == b for a, b in zip(w["item_slots"], w["slots"]))
    ]


def _agreeing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ALIGNED.names[:-1]
    # few alignments at once: as Python objects their windows are large
    for rows in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
        places = [agreeing(found) for found in rows.column("found").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(rows.column(c) for c in names), pa.array(places, pa.list_(pa.int64()))], names=ALIGNED.names
        )


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    least_words: int = 4,
    least_share: float = 0.5,
    least_run: int = 6,
) -> DataFrame:
    """(doc_id, item_id, matched, item_windows, run): one row for each document that leaks an item.

    matched: distinct windows of the item at consistent alignments, run: most at one alignment; both
    are of the first reading in which a row of the document leaks a text of the item, and of the rows that match most.
    """
    items = stored(item_windows(benchmark, width, least_words), "item-windows")
    word = F.shiftright(F.col("window").bitwiseAND((1 << FILTER_BITS) - 1), 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("window").bitwiseAND(63).cast("int"))
    # 2^18 rows at most, whatever the number of items
    filled = items.groupBy(word.cast("int").alias("word")).agg(F.bit_or(bit).alias("mask")).toPandas()
    shapes = sorted(map(tuple, items.select("reading", "size").distinct().collect()))
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    np.bitwise_or.at(table, filled["word"].to_numpy(np.int64), filled["mask"].to_numpy(np.int64).view(np.uint64))
    held = documents.sparkSession.sparkContext.broadcast((table, shapes))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("leaks", forget)
        table, shapes = held.value
        for rows, texts in text_steps(batches, "__text"):
            words = words_of(texts)
            for reading, sizes in groupby(shapes, itemgetter(0)):
                owner, kind, template, value = templates(words, reading)
                summed = sums(template)
                for _, size in sizes:
                    at, hashes = windows(owner, kind, summed, size, min(least_words, size), reading)
                    place = hashes & np.uint64((1 << FILTER_BITS) - 1)
                    seen = (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)
                    some = np.flatnonzero(seen)
                    if len(some):
                        yield _rows(rows.column("__id"), texts, reading, owner, kind, value, at[some], hashes[some], size)

    passed = (
        documents.where(F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text"))
        .mapInArrow(scan, WINDOW)
    )
    mine = items.select(
        "window",
        F.col("id").alias("item_id"),
        F.col("text").alias("item_text"),
        F.col("place").alias("item_place"),
        F.col("slot").alias("item_slot"),
        F.col("slots").alias("item_slots"),
    )
    hits = passed.join(mine, "window").where(F.size("slots") == F.size("item_slots"))
    # an alignment holds at most one row for each window of the item
    aligned = (
        hits.groupBy(F.col("id").alias("doc_id"), "text", "item_id", "item_text", "reading", (F.col("place") - F.col("item_place")).alias("shift"))
        .agg(F.collect_set(F.struct("item_place", "item_slot", "item_slots", "slots")).alias("found"))
        .mapInArrow(_agreeing, ALIGNED)
    )
    totals = items.groupBy(F.col("id").alias("item_id"), F.col("text").alias("item_text"), "reading").agg(F.count(F.lit(1)).alias("item_windows"))
    return (
        aligned.withColumn("run", F.size("places"))
        .withColumn("place", F.explode("places"))
        .groupBy("doc_id", "text", "item_id", "item_text", "reading")
        .agg(F.countDistinct("place").alias("matched"), F.max("run").cast("long").alias("run"))
        .join(totals, ["item_id", "item_text", "reading"])
        .where((F.col("matched") >= least_share * F.col("item_windows")) | (F.col("run") >= least_run))
        .groupBy("doc_id", "item_id")
        .agg(F.min(F.struct("reading", -F.col("matched"), "item_windows", -F.col("run"), "matched", "run")).alias("of"))
        .select("doc_id", "item_id", "of.matched", "of.item_windows", "of.run")
    )
