"""Exact Jaccard join of word n-gram sets by a token-group matrix.

Documents with equal sets are one class. Similar sets (those that share a frequent segment, see below)
form groups of bounded size; each group stores the union of its members' tokens. A set can only reach the threshold
with a member of a group if enough of its tokens are in that union, so the union bounds the overlap,
and only qualifying groups are opened and compared member by member.

To find the groups worth bounding without meeting all of them, the matrix is also kept by segments:
the tokens of a set are dealt by hash into more segments than two linked sets can differ in, so two
linked sets agree in at least one that is not empty, and a group that shares no segment with a set
cannot hold a link. Levels of sizes keep the number of segments equal for sets that can link.

Links inside a cluster of near copies are not all listed. Groups find the components of their own
members first, while one set of each segment visits the segment's other groups; in one more round
another set of the largest component visits those groups that are still apart. Then every set
outside the largest component of a segment visits the groups that are not of its own component
already and share enough segments with it, so that no link between components is lost. No candidates are capped. A hot cluster is split over groups, hot segments over tasks by AQE.

Sets are compared as 64-bit token hashes, classes by 128 bits. Text: A-Z are lower-cased, words are stretches
without ASCII white space. Null, empty and blank texts have an empty set and link with nothing. Repeated rows
and rows with a null doc_id belong to the class of their text and link like all others (a component_id
is the least doc_id that is not null; null if there is none).
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.common import mix64, stored, task_of, text_steps
from bazaarlens.llm.components import components

#: Members of a group, on average at most, and visitors that one task compares with a group.
GROUP = 128
WORDS_KEPT = 150_000
#: Characters of texts that a task hashes at once.
STEP = 1_000_000
#: Most bits of the table that tells which texts to read again; its size never exceeds 2 MB.
TABLE_BITS = 24
#: Parts in which segments are counted, so many times fewer of them are in a task's memory at once.
SLICES = 8
#: Columns of a token matrix held at once.
COLUMNS = 20_000


class Words(dict):
    """Numbers of words with a hash each; emptied when it holds too many."""

    def __init__(self):
        super().__init__()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.hashes = np.zeros(0, np.uint64)
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at

    def hash(self, words: list[list[bytes]]) -> np.ndarray:
        if len(self) > WORDS_KEPT:
            self.clear()
        index = np.fromiter((i for w in words for i in map(self.__getitem__, w)), np.int32, sum(map(len, words)))
        if self.fresh:
            new = np.fromiter(map(xxhash.xxh64_intdigest, self.fresh), np.uint64, len(self.fresh))
            self.hashes = np.concatenate([self.hashes, new])
            self.fresh = []
        return self.hashes[index]


_WORDS = Words()


def _forget() -> None:
    _WORDS.clear()


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat sorted shingle hashes of all texts and the offsets of each text."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    hashes = _WORDS.hash(split)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    starts, begin = np.cumsum(sizes) - sizes, np.r_[0, np.cumsum(counts)]
    at = np.repeat(starts, counts) + np.arange(int(counts.sum())) - np.repeat(begin[:-1], counts)
    width = np.repeat(np.minimum(sizes, n), counts)
    flat = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = k < width
        flat[inside] = mix64(flat[inside] + hashes[at[inside] + k] + np.uint64(k + 1))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        flat[a:b].sort()
    owner = np.repeat(np.arange(len(texts)), counts)
    once = np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])][: len(flat)]
    return flat[once], np.r_[0, np.cumsum(np.bincount(owner[once], minlength=len(texts)))]


@lru_cache
def size_levels(percent: int, most: int = 1 << 40) -> list[int]:
    """First sizes of the classes: sets can only link within a class or with the next one."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 100 // percent + 1)
    return out


@lru_cache
def segments_of(level: int, percent: int) -> tuple[int, int]:
    """Segments of a level, and how many of a set may be empty without being signatures.

    For sizes a <= b and a similarity of p, sets differ in (a + b)(1 - p) / (1 + p) tokens at most,
    and b is a / p at most. With one segment more than that and `spare` others, linked sets agree in
    spare + 1 segments, one of which is not empty if one of the sets has no more than spare empty
    ones. Sets with more of these count the empty ones too; spare is chosen so that they are rare.
    (0, 0) if only equal sets can link.
    """
    low, a = size_levels(percent)[level], size_levels(percent)[level + 1] - 1
    differ = (a + a * 100 // percent) * (100 - percent) // (100 + percent)
    if not differ:
        return 0, 0
    best = (1.0, 0)
    for spare in range(17 + differ // 8):
        empty = (differ + 1 + spare) * math.exp(-low / (differ + 1 + spare))
        tail, term = 1.0, math.exp(-empty)
        for k in range(spare + 1):
            tail -= term
            term *= empty / (k + 1)
        best = min(best, (max(tail, 1e-5), spare))
        if tail <= 1e-5:
            break
    return differ + 1 + best[1], best[1]


def segment_signatures(flat: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Signatures of all sets, and the set, level and need of each, in no order.

    need: so many signatures of the level, at least, a set shares with any that it links with at
    that level. Linked sets agree in spare + 1 segments; of these, no more can be empty than a set
    has empty ones. (1 for sets that have more than spare of them.)
    """
    sizes = np.diff(offsets)
    levels = size_levels(percent)
    own = np.array([bisect_right(levels, s) - 1 for s in sizes.tolist()], np.int64)
    out = []
    for below in (0, 1):
        level = own - below
        shape = [segments_of(k, percent) if k >= 0 and s else (0, 0) for k, s in zip(level.tolist(), sizes.tolist())]
        count, spare = np.array(shape, np.int64).reshape(-1, 2).T
        base = np.r_[0, np.cumsum(count)]
        if not base[-1]:
            continue
        used = np.repeat(count > 0, sizes)
        tokens = flat[used]
        per = np.repeat(count, sizes)[used].astype(np.uint64)
        slot = np.repeat(base[:-1], sizes)[used] + ((tokens >> np.uint64(20)) % per).astype(np.int64)
        total, filled = np.zeros(base[-1], np.uint64), np.zeros(base[-1], bool)
        np.add.at(total, slot, mix64(tokens))
        filled[slot] = True
        owner = np.repeat(np.arange(len(sizes)), count)
        number = np.arange(base[-1]) - np.repeat(base[:-1], count)
        tag = (np.repeat(level, count).astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) + np.uint64(1)
        signature = mix64(total ^ mix64(tag))
        empty = np.bincount(owner[~filled], minlength=len(sizes))
        kept = filled | (empty > spare)[owner]
        need = np.where(empty > spare, 1, spare + 1 - empty)
        out.append((signature[kept], owner[kept], level[owner[kept]].astype(np.int32), need[owner[kept]].astype(np.int32)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*out))


ROWS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "text_key", "size", "set", "check")]
    + [T.StructField("signatures", T.ArrayType(T.LongType())), T.StructField("needs", T.ArrayType(T.ShortType()))]
    + [T.StructField("levels", T.ArrayType(T.ByteType()))]
)
CELLS = "set long, signature long, level int, need int"


def _set_names(flat: np.ndarray, offsets: np.ndarray) -> list[int]:
    return [xxhash.xxh128_intdigest(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _low(names: list[int], shift: int = 0) -> np.ndarray:
    return np.array([(w >> shift) & ((1 << 64) - 1) for w in names], np.uint64).view(np.int64)


def _described(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """One pass over the texts: doc_id, text_key, size, set and check (128 bits of the set) of each
    row, and the signatures of its segments (48 bits) with their levels and needs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("shingles", _forget)
        for rows, texts in text_steps(batches, "text", STEP):
            flat, offsets = shingle_sets(texts, n)
            signature, owner, level, need = segment_signatures(flat, offsets, percent)
            order = np.argsort(owner, kind="stable")
            bounds = pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))].astype(np.int32))
            lists = (
                (signature[order] >> np.uint64(16)).astype(np.int64),
                np.minimum(need[order], 2**15 - 1).astype(np.int16),
                level[order].astype(np.int8),
            )
            names = _set_names(flat, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("text_key"),
                    pa.array(np.diff(offsets)),
                    pa.array(_low(names)),
                    pa.array(_low(names, 64)),
                    *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in lists),
                ],
                names=ROWS.names,
            )

    text = F.col("text").cast("string")
    columns = F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")
    return documents.select(*columns).mapInArrow(run, ROWS)


def _cells_in(rows: DataFrame, wanted: Broadcast) -> DataFrame:
    """(set, signature, level, need) of all signatures whose bit is in the table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = wanted.value
        for batch in batches:
            lists = batch.column("signatures")
            signature = lists.flatten().to_numpy()
            place = signature & (len(held) * 64 - 1)
            some = (held[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[some]
            level, need = (batch.column(c).flatten().to_numpy()[some].astype(np.int32) for c in ("levels", "needs"))
            columns = batch.column("set").to_numpy()[owner], signature[some], level, need
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["set", "signature", "level", "need"])

    return rows.select("set", "signatures", "levels", "needs").mapInArrow(run, CELLS)


def bit_table(rows: DataFrame, number: Column, bits: int) -> Broadcast:
    """A table of 2^bits bits in which the low bits of each row's number are set, on all executors.

    Its size is fixed, whatever the number of rows: where it fills up it lets more rows pass, and the
    exact join that follows every use does more work.
    """
    place = number.bitwiseAND((1 << bits) - 1)
    word = F.shiftright(place, 6).cast("int").alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    filled = rows.groupBy(word).agg(F.bit_or(bit).alias("mask")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[filled["word"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(table)


def _sets_of(documents: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """wanted (set, text_key, ...) with tokens (sorted hashes as bytes), read again from the texts.

    A table of bits, at most 2 MB, says which texts may be wanted; the join with wanted is exact. A task hands on
    each set once, so the copies of a hot text do not meet in one task of the join with all their tokens.
    """
    held = bit_table(wanted, F.col("text_key"), TABLE_BITS)
    schema = T.StructType([T.StructField("set", T.LongType()), T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("shingles", _forget)
        table = held.value
        keys, names = set(), set()
        for batch in batches:
            key = batch.column("text_key").to_numpy()
            place = key & ((1 << TABLE_BITS) - 1)
            seen = (table[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            # equal texts have equal keys; the first of each key is read
            fresh = [i for i, k in zip(np.flatnonzero(seen).tolist(), key[seen].tolist()) if not (k in keys or keys.add(k))]
            for _, texts in text_steps([batch.take(pa.array(fresh, pa.int64()))], "text", STEP):
                flat, offsets = shingle_sets(texts, n)
                low = _low(_set_names(flat, offsets)).tolist()
                once = [i for i, k in enumerate(low) if not (k in names or names.add(k))]
                parts = [flat[offsets[i] : offsets[i + 1]].tobytes() for i in once]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([low[i] for i in once], pa.int64()), pa.array(parts, pa.binary())], names=schema.names
                )

    text = F.col("text").cast("string")
    rows = documents.select(F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(run, schema).join(wanted, "set").dropDuplicates(["set"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], union: np.ndarray) -> np.ndarray:
    """Sizes of all intersections, by blocks of columns of the token matrix."""
    out = np.zeros((len(left), len(right)))

    def entries(sets):
        flat = np.concatenate(sets) if sets else union[:0]
        at = np.minimum(np.searchsorted(union, flat), len(union) - 1)
        hit = union[at] == flat
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]

    (lr, lc), (rr, rc) = entries(left), entries(right)
    for a in range(0, len(union), COLUMNS):
        width = min(COLUMNS, len(union) - a)
        x = np.zeros((len(left), width), np.float32)
        y = np.zeros((len(right), width), np.float32)
        inside = (lc >= a) & (lc < a + width)
        x[lr[inside], lc[inside] - a] = 1
        inside = (rc >= a) & (rc < a + width)
        y[rr[inside], rc[inside] - a] = 1
        out += x @ y.T
    return out


def _linked(overlap: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (left[:, None] + right[None, :] - overlap)


LINK = "a long, b long"


def compare_group(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that one group finds: members, visitors (those of a block) and their tokens.

    Member links come as a spanning forest (each member to the first of its component), and a
    visitor links to one member of each component it meets. Where the known components are given,
    members are not compared again.
    """
    rows = rows.sort_values(["visitor", "set"], kind="stable")
    sets = [np.frombuffer(t, np.uint64) for t in rows["tokens"]]
    ids, visitor = rows["set"].to_numpy(), rows["visitor"].to_numpy()
    sizes = np.array([len(s) for s in sets], float)
    m = int((~visitor).sum())
    if not m:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    members, visitors = sets[:m], sets[m:]
    union = np.concatenate(members)
    union.sort()
    union = union[np.r_[True, union[1:] != union[:-1]]]
    links: list[tuple[int, int]] = []
    root = rows["component"].to_numpy()[:m].copy()
    if rows["fresh"].iloc[0]:
        near = _linked(_overlaps(members, members, union), sizes[:m], sizes[:m], percent)
        root = np.full(m, -1)
        for at in range(m):
            if root[at] < 0:
                front = np.array([at])
                root[at] = at
                while len(front):  # all members that the front reaches
                    front = np.flatnonzero(near[front].any(0) & (root < 0))
                    root[front] = at
        links += [(ids[i], ids[r]) for i, r in enumerate(root.tolist()) if i != r]
    # the bound: tokens of a visitor in the union; only those that can reach the threshold open the group
    held = [np.isin(v, union, assume_unique=True).sum() for v in visitors]
    open_ = [i for i, h in enumerate(held) if 100 * h >= percent * len(visitors[i])]
    if open_:
        hits = _linked(_overlaps([visitors[i] for i in open_], members, union), sizes[m:][open_], sizes[:m], percent)
        for i, row in zip(open_, hits):
            met = np.flatnonzero(row)
            _, first = np.unique(root[met], return_index=True)
            links += [(ids[m + i], ids[met[k]]) for k in first.tolist()]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _visits(sets: DataFrame, visits: DataFrame, percent: int, fresh: bool) -> DataFrame:
    """Links found by the groups that are visited (all groups if fresh).

    sets: set, group, component, tokens. visits: set, target. The visitors of a group are dealt into
    blocks, and its members go to each of them, so no task holds more than a group and a block.
    """
    blocks = visits.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks"))
    visited = sets.join(blocks, sets["group"] == blocks["target"], "left" if fresh else "inner")
    if fresh:  # one member alone that nothing visits has nothing to compare
        sizes = sets.groupBy("group").agg(F.count(F.lit(1)).alias("members"))
        visited = visited.join(sizes, "group").where("members > 1 OR blocks IS NOT NULL")
    members = visited.select(
        "group",
        F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("blocks", F.lit(1)), F.lit(1)) - 1)).alias("block"),
        "set",
        "component",
        "tokens",
        F.lit(False).alias("visitor"),
    )
    guests = (
        visits.join(blocks, "target")
        .join(sets.select("set", "component", "tokens"), "set")
        .select(
            F.col("target").alias("group"),
            F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int").alias("block"),
            "set",
            "component",
            "tokens",
            F.lit(True).alias("visitor"),
        )
    )
    rows = members.unionByName(guests).withColumn("fresh", F.lit(fresh) & (F.col("block") == 0))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return compare_group(group, percent)

    return rows.groupBy("group", "block").applyInPandas(run, LINK)


def _with_components(sets: DataFrame, known: DataFrame) -> DataFrame:
    return sets.drop("component").join(known, "set", "left").withColumn("component", F.coalesce("component", "set"))


def _apart(matrix: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells with components, those of segments that hold more than one component, with the largest
    one, and the groups of these segments with the least and largest component of their members."""
    now = stored(_with_components(matrix, known), "matrix-components")
    major = (
        now.groupBy("signature", "component")
        .agg(F.count(F.lit(1)).alias("times"))
        .groupBy("signature")
        .agg(F.max(F.struct("times", "component"))["component"].alias("major"), F.count(F.lit(1)).alias("kinds"))
        .where("kinds > 1")
    )
    mixed = now.groupBy(F.col("group").alias("target")).agg(F.min("component").alias("low"), F.max("component").alias("high"))
    held = now.join(major, "signature")
    targets = held.select("signature", F.col("group").alias("target")).distinct().join(mixed, "target")
    return now, held, targets


def jaccard_components(documents: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row, components of the exact links.

    Two sets link when 100 * intersection >= percent * union.
    """
    rows = stored(_described(documents, n, percent), "shingle-rows")
    filled = rows.where("size > 0")
    # segments that two different sets share; 48 bits of each set are enough to tell them apart
    part = F.shiftright("set", 16).alias("part")
    # nearly all segments are of one set, so counting them shrinks nothing before the shuffle: a task
    # counts a slice of them at a time, or its table of them would fill the executor
    spots = filled.select(part, F.explode("signatures").alias("signature"))
    slices = [
        spots.where(F.pmod("signature", F.lit(SLICES)) == at)
        .groupBy("signature")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"))
        .where("low <> high")
        .select("signature")
        for at in range(SLICES)
    ]
    shared = stored(reduce(DataFrame.union, slices), "shared-segments")
    wide = min(TABLE_BITS + 3, max(12, int(shared.count()).bit_length() + 4))
    cells = _cells_in(filled, bit_table(shared, F.col("signature"), wide))
    cells = stored(cells.join(shared, "signature").distinct(), "shared-cells")
    # a set links at a level only if it shares as many segments as that takes
    able = cells.groupBy("set", "level").agg(F.count(F.lit(1)).alias("times"), F.max("need").alias("least"))
    cells = cells.join(able.where("times >= least").select("set", "level"), ["set", "level"], "left_semi")
    cells = stored(cells, "able-cells")
    classes = filled.groupBy("set", "check").agg(F.min("doc_id").alias("leader"), F.min("text_key").alias("text_key"))
    # sets that share their most frequent segment are dealt into groups
    frequent = cells.groupBy("signature").agg(F.count(F.lit(1)).alias("sets"))
    hub = cells.join(frequent, "signature").groupBy("set").agg(F.max(F.struct("sets", "signature")).alias("hub"))
    parts = hub.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    grouped = hub.join(parts, "hub").select(
        "set", F.xxhash64("hub.signature", F.pmod(F.xxhash64("set"), F.col("parts"))).alias("group")
    )
    wanted = stored(classes.select("set", "text_key").join(grouped, "set"), "candidate-sets")
    sets = stored(_sets_of(documents, wanted, n).drop("text_key").withColumn("component", F.col("set")), "candidate-tokens")
    place = sets.select("set", "group")
    matrix = stored(cells.join(place, "set"), "token-groups").select("signature", "level", "need", "set", "group")
    columns = matrix.select("signature", F.col("group").alias("target")).distinct()

    # first round: members of each group, and one set of each segment with the segment's groups
    leads = matrix.groupBy("signature").agg(F.min(F.struct("set", "group")).alias("lead"))
    first = (
        columns.join(leads, "signature")
        .where(F.col("target") != F.col("lead.group"))
        .select(F.col("lead.set").alias("set"), "target")
        .distinct()
    )
    links = stored(_visits(sets, first, percent, True), "group-links")
    for turn in (1,):
        known = stored(components(links), "group-components").withColumnRenamed("node", "set")
        _, held, targets = _apart(matrix, known)
        # another set of the largest component of each mixed segment visits the groups still apart
        leads = (
            held.where(F.col("component") == F.col("major"))
            .groupBy("signature")
            .agg(F.min(F.struct(F.xxhash64("set", F.lit(turn)), "set", "component")).alias("lead"))
        )
        again = (
            targets.join(leads, "signature")
            .where((F.col("low") != F.col("lead.component")) | (F.col("high") != F.col("lead.component")))
            .select(F.col("lead.set").alias("set"), "target")
            .distinct()
        )
        links = stored(links.union(_visits(_with_components(sets, known), again, percent, False)), "group-links")
    known = stored(components(links), "group-components").withColumnRenamed("node", "set")

    # what is left: sets outside the largest component of a segment, and groups of other components
    _, held, targets = _apart(matrix, known)
    # groups meet once for each segment, whatever the number of their sets; then each set looks at
    # the groups its own group meets and counts the segments that are its own
    apart = held.where(F.col("component") != F.col("major"))
    common = (
        apart.select("signature", "level", "group")
        .distinct()
        .join(targets, "signature")
        .where(F.col("target") != F.col("group"))
        .groupBy("group", "level", "target", "low", "high")
        .agg(F.collect_set("signature").alias("common"))
    )
    second = (
        apart.groupBy("set", "group", "component", "level")
        .agg(F.collect_set("signature").alias("own"), F.max("need").alias("least"))
        .join(common, ["group", "level"])
        .where(~((F.col("low") == F.col("high")) & (F.col("low") == F.col("component"))))
        # of the segments that two sets share, each may be seen from the side of either of them
        .where(2 * F.size(F.array_intersect("own", "common")) >= F.col("least"))
        .select("set", "target")
        .distinct()
    )
    more = stored(_visits(_with_components(sets, known), second, percent, False), "second-links")
    final = components(links.union(more)).withColumnRenamed("node", "set")

    owned = classes.select("set", "check", "leader").join(final, "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = owned.groupBy("component").agg(F.min("leader").alias("component_id"))
    named = stored(owned.join(least, "component").select("set", "check", "component_id"), "set-components")
    return rows.join(named, ["set", "check"], "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
